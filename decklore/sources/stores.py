"""Vector stores and sparse indexes as partitioned tables, behind small interfaces and a registry."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decklore.operators import bm25, ranking, store, vectors
from decklore.operators.filters import where as condition


class VectorIndex(Protocol):
    def upsert(self, rows: DataFrame) -> None: ...

    def delete(self, ids: DataFrame) -> None: ...

    def query(self, queries: DataFrame, k: int, where: dict | None = None) -> DataFrame: ...

    def sync(self, rows: DataFrame) -> int: ...


def collection_name(model_id: str) -> str:
    """The model's name is part of the collection's, so a question of another model finds no table rather than nonsense."""
    return "kb__" + re.sub("[^0-9A-Za-z]+", "_", model_id.rsplit("/", 1)[-1]).strip("_").lower()


class MemoryIndex:
    """A table that lives as long as its session. Rows: id, doc_id, v (unit length), and metadata columns."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows

    def upsert(self, rows: DataFrame) -> None:
        self.rows = store.upsert(self.rows, rows, "id")

    def delete(self, ids: DataFrame) -> None:
        self.rows = self.rows.join(ids.select("id"), "id", "left_anti").select(*self.rows.columns)

    def query(self, queries: DataFrame, k: int, where: dict | None = None) -> DataFrame:
        """queries(qid, qv): the filter comes before the ranking."""
        there = self.rows.filter(condition(where)).select("id", "v")
        return ranking.ranked(vectors.knn_scores(queries, there, k), k)

    def sync(self, rows: DataFrame) -> int:
        """Write the documents anew whose rows differ; the number of documents written."""
        changed = store.sync_diff(self.rows, rows, "doc_id", "id").filter("rewrite").select("doc_id")
        fresh = rows.join(changed, "doc_id", "left_semi").select(*self.rows.columns)
        n = changed.count()
        self.rows = self.rows.join(changed, "doc_id", "left_anti").select(*self.rows.columns).unionByName(fresh)
        return n


class ParquetIndex(MemoryIndex):
    """The same in files, a partition for each document; what changes is written document by document, and a document that
    has no rows left loses its partition."""

    def __init__(self, spark: SparkSession, root: str, model_id: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, f"{root.rstrip('/')}/{collection_name(model_id)}", schema
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy("doc_id").parquet(self.path)
        super().__init__(self._read())

    def _read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _remove(self, docs: DataFrame) -> None:
        """Delete the partitions of a few documents; where a name has marks, Spark's own escapes tell the folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        utils = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        for row in docs.toLocalIterator():
            name = utils.getPartitionPathString("doc_id", None if row["doc_id"] is None else str(row["doc_id"]))
            files.delete(path(f"{self.path}/{name}"), True)

    def _rewrite(self, rows: DataFrame, docs: DataFrame) -> None:
        """Replace the partitions of ``docs`` by ``rows``. Partitions without new rows stay in an overwrite, so they are
        deleted after it."""
        docs = self.spark.createDataFrame(docs.collect(), docs.schema)  # what changed, once and for all
        kept = rows.join(docs, "doc_id", "left_semi").select(*self.rows.columns)
        staged = f"{self.path}__staged"
        kept.write.mode("overwrite").parquet(staged)
        fresh = self.spark.read.schema(self.schema).parquet(staged)
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(self.path)
        self._remove(docs.join(fresh.select("doc_id").distinct(), docs["doc_id"].eqNullSafe(fresh["doc_id"]), "left_anti"))
        self.spark.catalog.refreshByPath(self.path)
        self.rows = self._read()

    def upsert(self, rows: DataFrame) -> None:
        """A row that moves to another document leaves the one that had it."""
        old = self._read()
        touched = rows.select("doc_id").unionByName(old.join(rows.select("id"), "id", "left_semi").select("doc_id"))
        self._rewrite(store.upsert(old, rows, "id"), touched.distinct())

    def delete(self, ids: DataFrame) -> None:
        old = self._read()
        touched = old.join(ids.select("id"), "id", "left_semi").select("doc_id").distinct()
        self._rewrite(old.join(ids.select("id"), "id", "left_anti"), touched)

    def sync(self, rows: DataFrame) -> int:
        changed = store.sync_diff(self._read(), rows, "doc_id", "id").filter("rewrite").select("doc_id")
        n = changed.count()
        if n:
            self._rewrite(rows, changed)
        return n


class Bm25Index:
    """The sparse index: scores over the chunks of one document; statistics are of all its chunks, the filter comes after."""

    def __init__(self, chunks: DataFrame) -> None:
        self.chunks = chunks

    def query(self, queries: DataFrame, doc_id: str, k: int, where: dict | None = None) -> DataFrame:
        of = self.chunks.filter(F.col("doc_id") == doc_id)
        scored = bm25.scores(queries, of, "id", "text")
        return ranking.ranked(scored.join(of.filter(condition(where)).select("id"), "id", "left_semi"), k)


REGISTRY: dict[str, Callable[..., object]] = {"memory": MemoryIndex, "parquet": ParquetIndex, "bm25": Bm25Index}


def create(kind: str, *args, **options):
    if kind not in REGISTRY:
        raise ValueError(f"unknown store {kind}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[kind](*args, **options)
