"""BM25 (Okapi): term statistics as a table, scores of a batch of questions in one pass over the chunks. Built from the public
formula with k1 1.5, b 0.75; a negative idf becomes a quarter of the mean idf over the vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from decklore.functions.text import terms
from decklore.llm.common import forget, stage_table
from decklore.sources.tables import spread

K1, B, FLOOR = 1.5, 0.75, 0.25
#: Characters of a block of texts, cells of a block's term matrix, rows held before the best are cut out.
BLOCK_CHARS, CELLS, HELD_ROWS = 4_000_000, 2_500_000, 300_000
#: TERM's characters as UTF-8: the bytes that start one (those from C3 to DF lead two bytes, E0 and E1 three), and the length of
#: a run of one character that is no term.
_STARTS, _ALONE = np.zeros(256, bool), np.zeros(256, np.int64)
_STARTS[[*b"0123456789", *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xE2)]] = True
_ALONE[[*range(0x41, 0x5B), *range(0x61, 0x7B)]], _ALONE[0xC3:0xE0], _ALONE[0xE0:0xE2] = 1, 2, 3


def _blocks(texts: pa.Array, rows: int | None = None) -> Iterator[tuple[int, list]]:
    """Runs of a batch's texts with the place of the first: a text, and more up to BLOCK_CHARS and ``rows``."""
    start, held, size = 0, [], 0
    for text in texts.to_pylist():
        if held and (size + len(text or "") > BLOCK_CHARS or len(held) == rows):
            yield start, held
            start, held, size = start + len(held), [], 0
        held.append(text)
        size += len(text or "")
    if held:
        yield start, held


def _words(texts: list) -> tuple[pa.Array, np.ndarray]:
    """The texts' terms, one after the other, and the number of each text: what TERM finds in their lower case. The bytes of all
    texts are looked at together; U+00C0 to U+1EF9 are C3 80 to E1 BB B9."""
    parts = [(t or "").lower().encode() for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts])
    data = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", np.uint8)
    there = _STARTS[data]
    wide = np.flatnonzero(data >= 0xC3)
    lead = data[wide]
    there[wide[lead < 0xE0] + 1] = True
    three = wide[(lead == 0xE0) | (lead == 0xE1)]
    second = data[three + 1]
    inside = (data[three] == 0xE0) | (second < 0xBB) | ((second == 0xBB) & (data[three + 2] <= 0xB9))
    for k in range(3):
        there[three + k] = inside
    edges = np.flatnonzero(there[1:] != there[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    alone = sizes == _ALONE[data[starts]]
    for k in range(3):
        there[starts[alone & (sizes > k)] + k] = False
    starts, sizes = starts[~alone], sizes[~alone]
    offsets = np.append(0, np.cumsum(sizes))
    words = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data[there]))
    return words, np.diff(np.searchsorted(starts, ends), prepend=0)


def _sorted_keys(lengths: np.ndarray, columns: np.ndarray, size: int) -> np.ndarray:
    """Place of the text times ``size`` plus column, for each term of each text that has a column, in order."""
    keys = np.repeat(np.arange(len(lengths)) * size, lengths) + columns
    keys = keys[columns >= 0]
    keys.sort()
    return keys


def cut(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text: what is read of each chunk."""
    return spread(chunks.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))


def counted(docs: DataFrame) -> DataFrame:
    """docs(id, text) to term, df, all, staged, for it is read three times and made in one pass: blocks of texts count their
    terms; the entry of no term counts chunks and sums lengths, chunks without terms too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _blocks(batch.column(0)):
                words, lengths = _words(texts)
                coded = words.dictionary_encode()
                size = len(coded.dictionary)
                keys = _sorted_keys(lengths, coded.indices.to_numpy(), size)
                df = np.bincount(keys[np.diff(keys, prepend=-1) > 0] % max(1, size), minlength=size)
                names = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([""])])
                total = np.zeros(size + 1, np.int64)
                total[-1] = len(words)
                yield pa.RecordBatch.from_arrays([names, pa.array(np.append(df, len(texts)), pa.int64()), pa.array(total)], names=["term", "df", "all"])

    parts = docs.select("text").mapInArrow(run, "term string, df long, all long")
    return stage_table(parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("all").alias("all")), "terms")


def statistics(told: DataFrame) -> DataFrame:
    """What is ``counted`` to term, df, idf, n, avgdl."""
    whole = told.filter("term = ''").select(F.col("df").alias("n"), (F.col("all") / F.nullif("df", F.lit(0))).alias("avgdl"))
    raw = told.filter("term <> ''").crossJoin(F.broadcast(whole))  # one row
    raw = raw.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", idf.alias("idf"), "n", "avgdl")


def vocabulary(docs: DataFrame) -> DataFrame:
    return statistics(counted(docs))


def weight(tf: Column, dl: Column, avgdl: Column, idf: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def weights(queries: DataFrame, chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Row]:
    """queries(qid, q) to rows of qid, term, times, idf, avgdl, on the driver: the questions are a batch, and only their terms
    come back. A term that a query repeats counts as often."""
    asked = queries.select("qid", F.explode(terms(F.col("q"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
    told = counted(cut(chunks, id_col, text_col))
    found = statistics(told).join(F.broadcast(asked), "term").select("qid", "term", "times", "idf", "avgdl").collect()
    forget(told)
    return found


def scored(
    told: list[Row], qid_type: str, chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, within: Column | None = None
) -> DataFrame:
    """The chunks' scores over 0 under ``weights``: qid, id, score; with ``k`` each task returns only what may be among the best
    k of a query (by score to 9 places, then id). Blocks of chunks meet the questions as a matrix product; chunks that share
    an id are scored as one of the terms of all, where their lengths are equal, and summed otherwise. With ``within``, a condition
    on the chunks, the pass over the texts gives two rankings: of all chunks, and (column within) of those that meet it alone."""
    spark = chunks.sparkSession
    many = chunks.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    docs = chunks.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.lit(False) if within is None else within, F.lit(False)).alias("within"))
    docs, names_out = spread(docs if within is not None else docs.drop("within")), ["qid", "id", "score", "within"][: 3 if within is None else 4]
    kind = f"qid {qid_type}, id {docs.schema['id'].dataType.simpleString()}, score double" + (", within boolean" if within is not None else "")
    none = spark.createDataFrame([], kind)
    if not told:
        return none
    qid_arrow = to_arrow_type(none.schema["qid"].dataType)
    alone = many.isEmpty()
    single = docs
    if not alone:
        same = many.withColumnRenamed("id", "other")
        meet = docs["id"].eqNullSafe(same["other"])
        single, repeated = docs.join(same, meet, "left_anti"), docs.join(same, meet, "left_semi")
    qids, names = list(dict.fromkeys(r["qid"] for r in told)), list(dict.fromkeys(r["term"] for r in told))
    q_at, t_at = {q: i for i, q in enumerate(qids)}, {t: i for i, t in enumerate(names)}
    cells = [(t_at[r["term"]], q_at[r["qid"]], r["times"] * r["idf"]) for r in told]
    avgdl = told[0]["avgdl"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, to, value = (np.array(x) for x in zip(*cells, strict=True))
        w = np.zeros((len(names), len(qids)))
        w[at, to] = value
        asked, least = pa.array(qids, qid_arrow), np.zeros(len(qids) * (len(names_out) - 2))
        held: list[tuple] = []

        def best() -> tuple:
            q, s = (np.concatenate([h[i] for h in held]) for i in (0, 2))
            ids = pa.chunked_array([h[1] for h in held]).combine_chunks()
            rank = np.empty(len(ids), np.int64)
            rank[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
            order = np.lexsort((rank, -np.round(s, 9), q))
            q = q[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            order, q, place = order[place < k], q[place < k], place[place < k]
            least[q[place == k - 1]] = s[order[place == k - 1]]
            return q, ids.take(pa.array(order)), s[order]

        def rows(q: np.ndarray, ids: pa.Array, s: np.ndarray) -> pa.RecordBatch:
            columns = [asked.take(pa.array(q % len(qids))), ids, pa.array(s), pa.array(q >= len(qids))]
            return pa.RecordBatch.from_arrays(columns[: len(names_out)], names=names_out)

        known = pa.array(names, pa.large_string())
        for batch in batches:
            for start, texts in _blocks(batch.column(1), max(1, CELLS // len(names))):
                words, lengths = _words(texts)
                n, columns = len(texts), pc.fill_null(pc.index_in(words, known), -1).to_numpy()
                norm = K1 * (1 - B + B * lengths / avgdl)
                keys = _sorted_keys(lengths, columns, len(names))
                first = np.flatnonzero(np.diff(keys, prepend=-1))
                key, tf = keys[first], np.diff(first, append=len(keys))
                x = np.zeros((n, len(names)))
                x.reshape(-1)[key] = tf * (K1 + 1) / (tf + norm[key // len(names)])
                sums = (x @ w).T
                if len(names_out) > 3:
                    met = batch.column(2).slice(start, n).to_numpy(zero_copy_only=False)
                    sums = np.vstack([sums, np.where(met, sums, 0.0)])
                q, j = np.nonzero((sums > 0) & (sums >= least[:, None] - 2e-9))
                some = (q, batch.column(0).take(pa.array(start + j)), sums[q, j])
                if k is None:
                    yield rows(*some)
                    continue
                held.append(some)
                if sum(len(h[0]) for h in held) > HELD_ROWS:
                    held[:] = [best()]
        if held:
            yield rows(*best())

    out = single.mapInArrow(run, kind)
    if alone:
        return out
    table = spark.createDataFrame([tuple(r) for r in told], f"qid {qid_type}, term string, times long, idf double, avgdl double")
    if within is not None:
        repeated = repeated.withColumn("within", F.explode(F.when(F.col("within"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    keys = ["id", *names_out[3:]]
    posts = repeated.select(*keys, terms(F.coalesce("text", F.lit(""))).alias("ts")).select(*keys, F.size("ts").alias("dl"), F.explode("ts").alias("term"))
    posts = posts.groupBy(*keys, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
    one = F.col("times") * weight(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf"))
    summed = posts.join(table, "term").groupBy("qid", *keys).agg(F.sum(one).alias("score")).filter("score > 0")
    return out.unionByName(summed)


def scores(queries: DataFrame, chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> DataFrame:
    """queries(qid, q) to qid, id, score over 0; see ``weights`` and ``scored``."""
    return scored(weights(queries, chunks, id_col, text_col), queries.schema["qid"].dataType.simpleString(), chunks, id_col, text_col, k)
