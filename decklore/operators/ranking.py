"""Ranks, fusion and grouping by page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from decklore.functions.numeric import POOL, RRF_K, TOP, rrf


def ranked(scored: DataFrame, pool: int = POOL) -> DataFrame:
    """qid, id, score to the best ``pool`` of each query with their rank; equal scores (to 9 places) go by id."""
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= pool)


def fuse(dense: DataFrame, sparse: DataFrame, k: float = RRF_K, wd: float = 1.0, ws: float = 1.0) -> DataFrame:
    """Two rankings to one; a weight of 0 leaves a branch out."""
    d = dense.select("qid", "id", F.col("rank").alias("rank_dense")) if wd else dense.select("qid", "id", F.lit(None).cast("int").alias("rank_dense")).limit(0)
    s = sparse.select("qid", "id", F.col("rank").alias("rank_sparse")) if ws else sparse.select("qid", "id", F.lit(None).cast("int").alias("rank_sparse")).limit(0)
    both = d.join(s, ["qid", "id"], "full_outer")
    return both.withColumn("rrf", rrf(F.col("rank_dense"), F.col("rank_sparse"), k, wd, ws))


def by_page(fused: DataFrame, pages: DataFrame, top: int | None = TOP) -> DataFrame:
    """fused and pages(id, page) to the best chunk of each page, with the number of chunks behind it, in order."""
    order = [F.desc(F.round("rrf", 12)), F.asc_nulls_last("rank_dense"), F.asc_nulls_last("rank_sparse"), F.asc("id")]
    in_page = Window.partitionBy("qid", "page")
    hits = fused.join(pages, "id").withColumn("n_chunks", F.count(F.lit(1)).over(in_page))
    best = hits.withColumn("r", F.row_number().over(in_page.orderBy(*order))).filter("r = 1").drop("r")
    out = best.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    return out.filter(F.col("pos") <= top) if top else out


def gate(pages: DataFrame, chosen: DataFrame, least_margin: float = 0.002) -> DataFrame:
    """pages(qid, page, pos, rrf), chosen(qid, page) to qid, page, margin, action, candidates: jump only to the first page,
    and only if it leads the second by the margin; one candidate has no margin."""
    top = pages.groupBy("qid").agg(
        F.max(F.when(F.col("pos") == 1, F.col("page"))).alias("first"),
        F.max(F.when(F.col("pos") == 2, F.col("page"))).alias("second"),
        F.max(F.when(F.col("pos") == 1, F.col("rrf"))).alias("s1"),
        F.max(F.when(F.col("pos") == 2, F.col("rrf"))).alias("s2"),
    )
    margin = F.coalesce(F.col("s1") - F.col("s2"), F.lit(0.0))
    sure = F.coalesce((F.col("page") == F.col("first")) & (margin >= least_margin), F.lit(False))
    return chosen.join(top, "qid", "left").select(
        "qid",
        "page",
        F.round(margin, 6).alias("margin"),
        F.when(sure, "goto").otherwise("ask_back").alias("action"),
        F.when(~sure, F.array_join(F.array_distinct(F.array_compact(F.array("page", "first", "second"))), ",")).alias("candidates"),
    )
