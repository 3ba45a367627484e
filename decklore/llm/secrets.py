"""Secret scans by multipart credential linking, with DataFrame operations alone.

Single-pattern findings stand by themselves. Weak candidates (identifiers, unlabelled keys and endpoints, each common in
clean text) are reported only where complementary parts meet: within one document, at most SCOPE code points apart, a key
with an identifier, an endpoint or an access identifier (which is a finding by itself), and an identifier or endpoint with
a key or a single-pattern finding. A weak candidate that overlaps a finding isn't reported, but an identifier in front of
an access identifier still names the key beside it.

Positions come from splitting on a pattern: the pieces between matches and the matches alternate, so running sums of
their lengths are the starts. Parts are joined on bins of SCOPE code points as a semi-join, which emits no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from decklore.llm.common import stage_table

SCOPE = 160

# Kind, pattern, group whose length counts, least length. The order is that of equal starts.
BASE = [
    (
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
]
# Kind, pattern, group that is the span's value, least length, patterns that the value must hold.
WEAK = [
    (
        "ident",
        r"""(?i)(?:client_?id|access_?key_?id|account|login|user(?:_?name)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""",
        1,
        3,
        [],
    ),
    ("key", r"[A-Za-z0-9+/_-]{20,}", 0, 20, ["[0-9]", "[a-z]", "[A-Z]"]),
    ("host", r"""(?i)(?:https?|jdbc:[a-z0-9]+|amqps?|rediss?|mongodb)://[^\s"'<>]+""", 0, 10, []),
]
#: Least pattern with the same findings, where short matches need not be made to be dropped.
FAST = {"hex": r"[0-9a-f]{16,}", "access": r"AKIA[A-Z0-9]{14,}"}
KINDS = [k[0] for k in BASE + WEAK]


def _matches(text: Column, kind: str, pattern: str, group: int, must: list[str]) -> Column:
    """An array with, for each match, the length of the piece before it, its own, and that of the group (0: must fails)."""
    pattern = FAST.get(kind, pattern)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits

    def value_length(x: Column) -> Column:
        ok = F.lit(True)
        for m in must:
            ok = ok & x.rlike(m)
        return F.when(ok, F.length(x)).otherwise(0)

    zipped = F.arrays_zip(
        gaps.alias("gap"), F.transform(hits, F.length).alias("size"), F.transform(values, value_length).alias("value")
    )
    found = F.filter(zipped, lambda x: x["size"].isNotNull())
    row = lambda x: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), x["gap"].alias("gap"), x["size"].alias("size"), x["value"].alias("value")
    )
    empty = F.expr("cast(array() as array<struct<kind:int,gap:int,size:int,value:int>>)")
    return F.when(text.rlike(pattern), F.transform(found, row)).otherwise(empty)


def secret_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Staged (row, doc_id) of all rows and (row, kind, start, end) of all candidates, weak ones too."""
    text = F.coalesce(docs[text_col], F.lit(""))
    all_kinds = [(*b, []) for b in BASE] + WEAK
    arrays = [_matches(text, kind, pattern, group, must) for kind, pattern, group, _, must in all_kinds]
    rows = stage_table(
        docs.select(
            docs[id_col].alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.concat(*arrays).alias("m")
        ),
        "secret-matches",
    )
    order = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    least = F.element_at(F.array(*[F.lit(k[3]) for k in all_kinds]), F.col("kind") + 1)
    parts = (
        rows.filter(F.size("m") > 0)
        .select("row", F.posexplode("m").alias("pos", "x"))
        .select("row", "pos", "x.*")
        .withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order))
        .filter(F.col("value") >= least)
        .select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    )
    return rows.select("row", "doc_id"), stage_table(parts, "secret-parts")


def _near(left: DataFrame, right: DataFrame, reach: int) -> DataFrame:
    """The rows of ``left`` with a row of ``right`` in the same document, less than ``reach`` code points away."""
    bins = lambda a, b: F.explode(F.sequence(F.expr(f"{a} div {SCOPE}"), F.expr(f"{b} div {SCOPE}"))).alias("bin")
    l = left.select("row", "kind", "start", "end", bins("start", "end"))
    low, high = f"greatest(start - {reach}, 0)", f"(end + {reach})"
    r = right.select("row", F.col("start").alias("s"), F.col("end").alias("e"), bins(low, high))
    close = (
        (l["row"] == r["row"])
        & (l["bin"] == r["bin"])
        & (l["start"] < r["e"] + reach)
        & (r["s"] < l["end"] + reach)
    )
    return l.join(r, close, "left_semi").select("row", "kind", "start", "end").distinct()


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Base findings, and weak candidates outside of them whose complement is in scope."""
    n = len(BASE)
    access, ident, key, host = KINDS.index("access"), n, n + 1, n + 2
    base, weak = parts.filter(F.col("kind") < n), parts.filter(F.col("kind") >= n)
    # A candidate that overlaps a base finding says nothing new.
    inside = _near(weak, base, 0)
    weak = weak.join(inside, ["row", "kind", "start", "end"], "left_anti")
    keys, named = weak.filter(F.col("kind") == key), weak.filter(F.col("kind").isin(ident, host))
    ids = base.filter(F.col("kind") == access)
    labels = _near(parts.filter(F.col("kind") == ident), ids, 0)
    linked_keys = _near(keys, named.unionByName(ids).unionByName(labels), scope)
    linked_names = _near(named, parts.filter(F.col("kind") < n).unionByName(keys), scope)
    return base.unionByName(linked_keys).unionByName(linked_names)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start, then kind, then end, joined by commas. A null text
    counts as empty: no spans, and the digest of the empty string. Null and repeated ids are rows like any other. An
    empty table gives an empty result.
    """
    rows, parts = secret_parts(docs, id_col, text_col)
    names = F.array(*[F.lit(k) for k in KINDS])
    found = linked_parts(parts, scope).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("all")
    )
    said = lambda xs: F.array_join(
        F.transform(
            xs,
            lambda x: F.concat_ws(
                ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string")
            ),
        ),
        ",",
    )
    everything = F.coalesce(
        F.col("all"), F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")
    )
    count = lambda k: F.size(F.filter(everything, lambda x: x["kind"] == k)).cast("long")
    base = said(F.filter(everything, lambda x: x["kind"] < len(BASE)))
    return rows.join(found, "row", "left").select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        said(everything).alias("spans"),
    )
