"""Exact vector search and all-pairs scans, in blocks of vectors multiplied as matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decklore.llm.common import stage_table

#: Vectors of a block; blocks meet as matrices.
BLOCK = 2048


def _packed(vectors: DataFrame, id_col: str, v_col: str, names: tuple[str, str]) -> DataFrame:
    """Blocks of at most BLOCK vectors, one row each: the ids, and the matrix as a binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = pa.Table.from_batches([batch.slice(at, BLOCK)])
                ids = pa.array([some.column(0).to_pylist()], pa.list_(some.column(0).type))
                yield pa.RecordBatch.from_arrays([ids, pa.array([_matrix(some.column(1)).tobytes()], pa.binary())], names=list(names))

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(id_col, v_col).mapInArrow(run, f"{names[0]} array<{kind}>, {names[1]} binary")


def knn_scores(queries: DataFrame, vectors: DataFrame, k: int | None = None, among: Callable | None = None) -> DataFrame:
    """queries(qid, qv) x vectors(id, v), unit length, to qid, id, score; with ``k`` only what may be among the best k of a
    query (by score to 9 places, then id). All vectors are scored, or those that ``among`` (query and vector matrices to a mask) lets by: a block of queries meets a block of vectors as a matrix
    product. The query set is stated by the caller, and staged: in as few blocks as hold it, however many partitions it came from,
    for each of them meets every block of vectors. They go wherever Spark's size check sends them."""
    given = stage_table(queries.select("qid", "qv"), "queries")
    few = given.repartition(max(1, -(-given.count() // BLOCK)))
    asked, there = stage_table(_packed(few, "qid", "qv", ("qids", "qm")), "query-blocks"), _packed(vectors, "id", "v", ("ids", "m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                qids, ids = batch.column("qids")[row].values, batch.column("ids")[row].values
                qm, m = (np.frombuffer(batch.column(c)[row].as_py(), "<f8") for c in ("qm", "m"))
                qm, m = qm.reshape(len(qids), -1), m.reshape(len(ids), -1)
                sims = qm @ m.T
                if among:
                    sims[~among(qm, m)] = -np.inf
                i, j = np.divmod(np.arange(sims.size), len(ids))
                if k is not None and k < len(ids):
                    by_id = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"))
                    j = np.lexsort((np.broadcast_to(by_id, sims.shape), -np.round(sims, 9)), axis=1)[:, :k].reshape(-1)
                    i = np.repeat(np.arange(len(qids)), k)
                if among:
                    i, j = i[(there := sims[i, j] > -np.inf)], j[there]
                columns = [qids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(sims[i, j])]
                yield pa.RecordBatch.from_arrays(columns, names=["qid", "id", "score"])

    kinds = [d.schema[c].dataType.simpleString() for d, c in ((queries, "qid"), (vectors, "id"))]
    return there.crossJoin(asked).mapInArrow(run, f"qid {kinds[0]}, id {kinds[1]}, score double")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def similar_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """vectors(id, v) to id_a < id_b with a product of at least ``threshold``, and sim. Blocks of vectors meet pairwise, a
    matrix product each; only pairs over the threshold leave a task."""
    n = vectors.count()
    blocks = max(1, -(-n // BLOCK))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("id", "v", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))

    def meet(table: pa.Table) -> pa.Table:
        block, low, high = (table.column(c).to_numpy() for c in ("block", "low", "high"))
        ids, m = table.column("id").to_numpy(), _matrix(table.column("v"))
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        sims = m[left] @ m[right].T
        i, j = np.nonzero(sims >= threshold)
        a, b, s = ids[left[i]], ids[right[j]], sims[i, j]
        keep = a < b if low[0] == high[0] else a != b
        a, b, s = a[keep], b[keep], s[keep]
        return pa.table({"id_a": np.minimum(a, b), "id_b": np.maximum(a, b), "sim": s})

    return dealt.groupBy("low", "high").applyInArrow(meet, "id_a long, id_b long, sim double")


def signs_index(vectors: DataFrame, planes: int = 8, tables: int = 16, seed: int = 7, dim: int = 64) -> DataFrame:
    """An approximate index: vectors(id, v) to table, bucket, id, v by signs of random projections."""
    normal = np.random.default_rng(seed).normal(size=(dim, tables * planes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(planes)
        for batch in batches:
            t = pa.Table.from_batches([batch])
            bits = (_matrix(t.column("v")) @ normal > 0).reshape(len(t), tables, planes)
            code = (bits * powers).sum(axis=2)
            for k in range(tables):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(t), pa.int32()), pa.array(code[:, k], pa.int32()), batch.column("id"), batch.column("v")],
                    names=["table", "bucket", "id", "v"],
                )

    return vectors.select("id", "v").mapInArrow(run, "table int, bucket int, id long, v array<float>")


def _codes(m: np.ndarray, planes: int, tables: int, seed: int) -> np.ndarray:
    """The bucket of each vector in each table, as signs_index has them."""
    normal = np.random.default_rng(seed).normal(size=(m.shape[1], tables * planes))
    return ((m @ normal > 0).reshape(len(m), tables, planes) * (1 << np.arange(planes))).sum(axis=2)


def approximate_scores(queries: DataFrame, vectors: DataFrame, planes: int = 8, tables: int = 16, seed: int = 7, k: int | None = None) -> DataFrame:
    """Candidates that share a bucket with a query in any table, scored exactly; with ``k`` only what may be among the best k.
    A block of vectors meets a block of queries, so that candidates are found and scored where they are: few bits a table
    make nearly every vector a candidate of some, and as rows those would all be shuffled."""

    def shares(qm: np.ndarray, m: np.ndarray) -> np.ndarray:
        asked, there = _codes(qm, planes, tables, seed), _codes(m, planes, tables, seed)
        met = np.zeros((len(qm), len(m)), bool)
        for t in range(tables):
            met |= asked[:, t, None] == there[None, :, t]
        return met

    return knn_scores(queries, vectors, k, shares)
