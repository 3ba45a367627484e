"""Keyed stores: upsert, synchronisation, embedding cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decklore.functions.text import content_key


def upsert(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return store.join(rows.select(key), key, "left_anti").select(*store.columns).unionByName(rows)


def sync_diff(store: DataFrame, rows: DataFrame, group: str, key: str) -> DataFrame:
    """Both sides in one aggregation, by digest of all columns: for each group n_added, n_removed, n_changed, and whether it
    must be written anew. Sides never meet in a join, so wide rows are hashed where they are."""
    def side(df: DataFrame, name: str) -> DataFrame:
        digest = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
        return df.select(group, key, F.lit(name).alias("side"), digest.alias("digest"))

    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("digest"))).alias(s)
    both = side(store, "old").unionByName(side(rows, "new")).groupBy(group, key).agg(pick("old"), pick("new"))
    out = both.groupBy(group).agg(
        F.count_if(F.col("old").isNull()).alias("n_added"),
        F.count_if(F.col("new").isNull()).alias("n_removed"),
        F.count_if(F.col("old") != F.col("new")).alias("n_changed"),
    )
    return out.withColumn("rewrite", (F.col("n_added") + F.col("n_removed") + F.col("n_changed")) > 0)


def cache_misses(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """The distinct texts, by content key, that have no vector yet."""
    keyed = texts.select(content_key(F.lit(model), F.col("text")).alias("text_key"), "text")
    return keyed.dropDuplicates(["text_key"]).join(cache, "text_key", "left_anti")


def misaligned(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Ids that only one of the two has, for a model; a search must not start unless this is empty."""
    v = vectors.filter(F.col("model_id") == model).select("chunk_id", F.lit(1).alias("v"))
    both = chunks.select("chunk_id", F.lit(1).alias("c")).join(v, "chunk_id", "full_outer")
    return both.filter("c is null or v is null").select("chunk_id", F.when(F.col("c").isNull(), "vector").otherwise("chunk").alias("only"))
