"""Temperature mixing of sources to target weights.

A source's weight is its share of all tokens to the power a, over the sum of those. a is bisected in [0, 1]: 1 keeps the
shares, 0 makes all sources equal. It meets a target entropy, and a limit on how often a source may repeat. Weights
become copies of documents by epochs of block permutations: a source passes in full as often as its budget allows, and
what is left comes from one more permutation of its blocks, of which whole blocks are taken in order, then documents of
the first block that no longer fits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from decklore.llm.common import hex_bits, numbered, stage_table

#: The entropy of the weights as a share of its maximum, the most passes over a source, blocks in a source's permutation.
TARGET_ENTROPY, MAX_EPOCHS, BLOCKS, STEPS = 0.9, 4.0, 1024, 50
#: Steps of the bisection that one pass over the sources takes.
STEP_BITS = 6


def _measure(totals: DataFrame, exponents: list[float], budget: float) -> list[tuple[float, float, float]]:
    """For each exponent, in order: entropy of the weights as a share of its maximum, the most epochs of a source, and the sum
    of the powers. ``totals``: source, tokens (over 0), share. Sums are of whole numbers, so no order of adding changes them."""
    x, scale = F.pow("share", "a"), 1e18
    exact = lambda c: F.sum(F.round(c * scale).cast("decimal(38,0)"))
    each = totals.select("tokens", "share", F.posexplode(F.array(*[F.lit(a) for a in exponents])).alias("i", "a"))
    told = each.groupBy("i").agg(exact(x), exact(x * F.log(x)), F.max(x / F.col("tokens")), F.count(F.lit(1)))
    out = []
    for _, s, t, most, n in sorted(map(tuple, told.collect())):
        s, t = float(s) / scale, float(t) / scale
        out.append(((math.log(s) - t / s) / math.log(n) if n > 1 else 1.0, budget * most / s, s))
    return out


def bisect_exponent(totals: DataFrame, budget: float, target_entropy: float, max_epochs: float) -> tuple[float, float]:
    """The largest exponent that meets the target entropy, raised as far as the limit on repetition asks for, and the sum of
    the powers at it. STEP_BITS steps of the bisection are one pass over ``totals``, which measures all the midpoints that
    they could come to."""

    def bisect(meets_below) -> float:
        low, high, left = 0.0, 1.0, STEPS
        while left:
            bits = min(left, STEP_BITS)
            mids = [low + (high - low) * k / (1 << bits) for k in range(1, 1 << bits)]
            met = [meets_below(m) for m in _measure(totals, mids, budget)]
            at, width = 0, 1 << bits
            for _ in range(bits):
                width //= 2
                at += width * met[at + width - 1]
            low, high, left = low + (high - low) * at / (1 << bits), low + (high - low) * (at + 1) / (1 << bits), left - bits
        return (low + high) / 2

    a, (entropy, most, norm) = 1.0, _measure(totals, [1.0], budget)[0]
    if entropy < target_entropy:
        a = bisect(lambda m: m[0] >= target_entropy)
        _, most, norm = _measure(totals, [a], budget)[0]
    if most > max_epochs:
        a = max(a, bisect(lambda m: m[1] > max_epochs))
        norm = _measure(totals, [a], budget)[0][2]
    return a, norm


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, n_tokens (words), block, copies. The options are those of
    ``_mix``.

    ``budget_tokens`` is the size of the mix, by default that of the input. copies says how often the document is in
    the mix, 0 or more; a source's tokens in the mix are at most its weight times the budget, rounded, and less than one
    document below. Null sources count as the source ''. Documents without words cost nothing and are in every pass.
    Rows that repeat an id, or null ids, are rows like any other; of equal rows at the edge of a budget some may be in
    and others not. An empty table gives an empty result.
    """
    return _mix(docs, F.monotonically_increasing_id(), **options).drop("row")


def _mix(
    docs: DataFrame,
    row: Column,
    target_entropy: float = TARGET_ENTROPY,
    max_epochs: float = MAX_EPOCHS,
    budget_tokens: int | None = None,
    blocks: int = BLOCKS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    within: str | None = None,
) -> DataFrame:
    """What ``mix`` says, and the number of the row; ``row`` tells the rows apart. The columns may be ``within`` a struct."""
    docs = docs.select(row.alias("number"), *[(docs[within].getField(c) if within else docs[c]).alias(n) for c, n in ((id_col, "id"), (text_col, "text"), (source_col, "source"))])
    row, id_col, text_col, source_col = F.col("number"), "id", "text", "source"
    words = F.size(F.filter(F.split(F.coalesce(docs[text_col], F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    # Rows without an id are spread over the blocks by their number.
    key = F.coalesce(docs[id_col].cast("string"), F.concat(F.lit("null "), row.cast("string")))
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("source"),
        words.cast("long").alias("n_tokens"),
        F.pmod(hex_bits(key), F.lit(blocks)).alias("block"),
        hex_bits(key, 15).alias("at"),
        row.alias("row"),
    )
    rows = stage_table(rows, "mix-rows")
    per_block = stage_table(
        rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")).withColumn(
            "at", hex_bits(F.concat("source", F.lit("/"), F.col("block").cast("string")), 15)
        ),
        "mix-blocks",
    )
    totals = per_block.groupBy("source").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
    grand = totals.agg(F.sum("tokens")).first()[0]
    if not grand:
        return rows.select("row", "doc_id", "source", "n_tokens", "block", F.lit(1).cast("long").alias("copies"))
    budget = float(budget_tokens or grand)
    totals = stage_table(totals.withColumn("share", F.col("tokens") / F.lit(float(grand))), "mix-totals")
    a, norm = bisect_exponent(totals, budget, target_entropy, max_epochs)
    power = F.pow("share", F.lit(a))
    plan = totals.select(
        "source", "tokens", F.round(power / F.lit(norm) * F.lit(budget)).cast("long").alias("wanted")
    ).select(
        "source", F.expr("wanted div tokens").alias("full"), F.expr("wanted % tokens").alias("left_over")
    )
    # A source has at most `blocks` rows here, whatever its size.
    order = Window.partitionBy("source").orderBy("at", "block").rowsBetween(Window.unboundedPreceding, 0)
    fill = stage_table(
        per_block.join(plan, "source")
        .withColumn("upto", F.sum("tokens").over(order))
        .select(
            "source",
            "block",
            "full",
            (F.col("upto") <= F.col("left_over")).alias("whole"),
            (F.col("left_over") - F.col("upto") + F.col("tokens")).alias("room"),
            ((F.col("upto") > F.col("left_over")) & (F.col("upto") - F.col("tokens") < F.col("left_over"))).alias("edge"),
        ),
        "mix-fill",
    )
    # (source, block) pairs are no bound on their own, so a broadcast is left to Spark's own check of the size; blocks
    # are even by hash, but for documents that repeat an id.
    marked = rows.join(fill, ["source", "block"], "left")
    edge = (
        rows.join(fill.filter("edge").select("source", "block", "room"), ["source", "block"])
        .withColumn(
            "used",
            F.sum("n_tokens").over(
                Window.partitionBy("source", "block").orderBy("at", "row").rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        .filter("used <= room")
        .select("row", F.lit(1).alias("more"))
    )
    return marked.join(edge, "row", "left").select(
        "row",
        "doc_id",
        "source",
        "n_tokens",
        "block",
        (
            F.coalesce(F.col("full"), F.lit(1))
            + F.when(F.col("whole"), 1).otherwise(F.coalesce(F.col("more"), F.lit(0)))
        ).cast("long").alias("copies"),
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as ``mix`` says of it; the columns stay as they are. Null and repeated ids are rows
    like any other: copies find their row by a number that is staged with it."""
    rows = numbered(docs)
    copies = _mix(rows, F.col("row"), within="doc", **options)
    copies = copies.filter("copies > 0").select("row", F.sequence(F.lit(1).cast("long"), F.col("copies")).alias("times"))
    return rows.join(copies, "row").select("doc", F.explode("times")).select("doc.*")


#: DuckDB SQL for the defaults and the input's size as budget; the bisection of the entropy as a recursive query.
MIX_SQL = """
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce(source, '') AS source, row_number() OVER () AS r,
    CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT)
      AS n_tokens,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) % {blocks} AS block,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 16, 15) AS BIGINT) AS at
  FROM documents
), blocks AS (SELECT source, block, sum(n_tokens) AS tokens,
    CAST('0x' || substr(md5(source || '/' || CAST(block AS VARCHAR)), 16, 15) AS BIGINT) AS at
  FROM rows GROUP BY source, block
), totals AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens FROM blocks GROUP BY source HAVING sum(tokens) > 0
), shares AS (SELECT list(tokens / (SELECT sum(tokens) FROM totals) ORDER BY source) AS ps FROM totals
), bis AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high
  UNION ALL
  SELECT i + 1, CASE WHEN h >= {target} THEN mid ELSE low END, CASE WHEN h >= {target} THEN high ELSE mid END
  FROM (SELECT i, low, high, mid, -list_sum(list_transform(raw, lambda x: x / s * ln(x / s))) / ln(len(raw)) AS h
    FROM (SELECT *, list_sum(raw) AS s FROM (SELECT i, low, high, (low + high) / 2 AS mid,
        list_transform(ps, lambda p: pow(p, (low + high) / 2)) AS raw FROM bis, shares WHERE i < {steps})))
), proportional AS (SELECT -list_sum(list_transform(ps, lambda p: p * ln(p))) / ln(len(ps)) AS h FROM shares
), expo AS (SELECT CASE WHEN (SELECT h FROM proportional) >= {target} THEN 1 ELSE (low + high) / 2 END AS a
  FROM bis WHERE i = {steps}
), plan AS (SELECT source, tokens, CAST(round(pow(tokens / g, a) / norm * g) AS BIGINT) AS wanted
  FROM totals, expo, (SELECT sum(tokens) AS g FROM totals),
    (SELECT sum(pow(tokens / (SELECT sum(tokens) FROM totals), a)) AS norm FROM totals, expo)
), fill AS (SELECT b.source, b.block, b.tokens, wanted // p.tokens AS full_passes, wanted % p.tokens AS left_over,
    sum(b.tokens) OVER (PARTITION BY b.source ORDER BY b.at, b.block ROWS UNBOUNDED PRECEDING) AS upto
  FROM blocks b JOIN plan p USING (source)
), used AS (SELECT r.*, f.full_passes, f.left_over, f.upto, f.tokens,
    sum(n_tokens) OVER (PARTITION BY r.source, r.block ORDER BY r.at, r.r ROWS UNBOUNDED PRECEDING) AS used
  FROM rows r LEFT JOIN fill f USING (source, block))
SELECT doc_id, source, n_tokens, block,
  CAST(coalesce(full_passes, 1) + CASE WHEN upto <= left_over THEN 1
    WHEN upto - tokens < left_over AND used <= left_over - upto + tokens THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM used
"""
