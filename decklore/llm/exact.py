"""Exact dedup by skew-safe combining, with DataFrame operations alone.

1. Locally: the map side of the first aggregation keeps one row for each text in each task.
2. Salted: what the tasks kept is merged by (digest, salt, text); the salt is taken from the task, so a text in a third
   of all rows sends at most one row from each task, spread over the salts.
3. Globally: the winners of the salts are merged by (digest, text).

The text itself is a grouping key in every stage, so equal digests of different texts stay apart. Rows find their group
by digest; should one digest stand for two texts, rows that bear it find their group by digest and text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decklore.llm.common import skew_join, stage_table

SALTS = 16


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _rows(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].alias("id"), text.alias("body"), digest(text).alias("digest"))


def combine(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """rows(id, body, digest) to one row for each distinct body: digest, body, keep_id (the largest id), group_size."""
    salted = rows.groupBy("digest", "body", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt")).agg(
        F.max("id").alias("winner"), F.count(F.lit(1)).alias("n")
    )
    return salted.groupBy("digest", "body").agg(F.max("winner").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    Of equal texts (null counts as empty) the largest id stays. Rows that repeat the winner's id and text are the same
    document and all say kept; ``exact_dedup`` keeps one of them. Null ids lose to any id; where all ids of a group are
    null, keep_id is null and all of its rows say kept. An empty table gives an empty result.
    """
    rows = _rows(docs, id_col, text_col, digest)
    groups = combine(rows, salts).groupBy("digest").agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.sum("group_size").alias("n"),
        F.max("keep_id").alias("keep_id"),
    )
    groups = stage_table(groups, "exact-groups")
    single = groups.filter("n_texts = 1").select("digest", "keep_id", "n", F.col("n").alias("group_size"))
    out = skew_join(rows.select("id", "digest"), single, ["digest"], "n").select(
        "id", "digest", "keep_id", "group_size"
    )
    several = groups.filter("n_texts > 1").select("digest")
    if several.limit(1).count():  # one digest for several texts: their rows compare the full text
        both = stage_table(rows.join(several, "digest", "left_semi"), "exact-colliding")
        apart = combine(both, salts)
        # Shuffled by text, which may be hot: texts have no bound in bytes to broadcast them by.
        out = out.unionByName(both.join(apart, ["digest", "body"]).select("id", "digest", "keep_id", "group_size"))
    return out.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "digest",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """``docs`` with one row for each distinct text, the one of the largest id; the columns stay as they are.

    A null text counts as empty and is returned as empty. Of rows that repeat an id and a text, the one whose other columns
    have the least hash stays, however the tasks run. The other
    columns, whatever their names, travel as one struct and never with the text.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    rows = _rows(docs, id_col, text_col, sha256)
    winners = combine(rows, salts).select(F.col("keep_id").alias("id"), "digest", "body")
    packed = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(rest)]) if rest else F.lit(0)
    others = docs.select(
        docs[id_col].alias("id"), sha256(F.coalesce(docs[text_col], F.lit(""))).alias("digest"), packed.alias("rest")
    ).groupBy("id", "digest").agg(F.min_by("rest", F.xxhash64("rest")).alias("rest"))
    found = winners.join(others, winners["id"].eqNullSafe(others["id"]) & (winners["digest"] == others["digest"]))
    by_name = {id_col: winners["id"], text_col: F.col("body")}
    by_name |= {c: F.col("rest").getField(f"c{i}") for i, c in enumerate(rest)}
    return found.select(*[by_name[c].alias(c) for c in docs.columns])
