"""Retrieval evaluation: anchors, counters, tuning grids, audits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from decklore.functions.numeric import RRF_K, TOP

#: Bytes of a window that anchors are looked up by, bits of the table of windows, windows looked at together.
WINDOW, TABLE_BITS, POSITIONS = 8, 20, 1 << 20
_spread = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)


def _lookup(anchors: list[bytes], step: int) -> Callable[[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Anchors of at least WINDOW + step - 1 bytes to a function of bytes, which gives where which of them may start. Each has
    ``step`` windows, one after the other, from its middle; one of them is where only every ``step``-th place is looked at."""
    middles = [(len(a) - WINDOW - step + 1) // 2 for a in anchors]
    rows = sorted((int.from_bytes(a[at : at + WINDOW], "little"), n, at) for n, a in enumerate(anchors) for at in range(middles[n], middles[n] + step))
    keys = np.array([r[0] for r in rows], np.uint64)
    number, before = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
    table = np.zeros(1 << TABLE_BITS, bool)
    table[_spread(keys)] = True

    def found(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        places = (len(data) - WINDOW) // step + 1 if len(keys) else 0
        for start in range(0, places, POSITIONS):
            windows = np.ndarray(min(POSITIONS, places - start), "<u8", data, start * step, (step,))
            some = np.flatnonzero(table[_spread(windows)])
            left, right = (np.searchsorted(keys, windows[some], side) for side in ("left", "right"))
            times = right - left
            which = np.arange(times.sum()) + np.repeat(left - (np.cumsum(times) - times), times)
            yield np.repeat(some + start, times) * step - before[which], number[which]

    return found


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, none of which is null, as they lie in memory, and where each ends."""
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at[1:] - at[0]


def containing(texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """texts(id, text), anchors(aid, anchor) to (aid, id), one for each text that contains the anchor.

    The anchors, a batch of questions, come to the driver. One pass over the texts looks up windows of eight bytes, every
    eighth one, in a table of those that the anchors have; only where one is found, and the anchor's first and last bytes fit,
    is it compared as a whole. UTF-8 contains a text's bytes where the text contains the characters. Anchors of fewer than 15
    bytes are looked up at every byte, those of fewer than eight searched in every text.
    """
    told = [(r["aid"], r["anchor"].encode()) for r in anchors.select("aid", "anchor").filter("anchor is not null").distinct().collect()]
    kinds = [d.schema[c].dataType.simpleString() for d, c in ((anchors, "aid"), (texts, "id"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = [x for x in told if len(x[1]) < WINDOW]
        sought = []
        for step, some in (
            (1, [x for x in told if WINDOW <= len(x[1]) < 2 * WINDOW - 1]),
            (WINDOW, [x for x in told if len(x[1]) >= 2 * WINDOW - 1]),
        ):
            if some:
                ends = [np.array([int.from_bytes(part(a), "little") for _, a in some], np.uint64) for part in (lambda a: a[:WINDOW], lambda a: a[-WINDOW:])]
                sought.append((some, np.array([len(a) for _, a in some]), *ends, _lookup([a for _, a in some], step)))
        for batch in batches:
            if not batch.num_rows:
                continue
            data, ends = _utf8(batch.column(1))
            found = set()
            if len(data) >= WINDOW:
                every = np.ndarray(len(data) - WINDOW + 1, "<u8", data, 0, (1,))
                for some, sizes, heads, tails, lookup in sought:
                    for at, n in lookup(data):
                        inside = (at >= 0) & (at + sizes[n] <= len(data))
                        at, n = at[inside], n[inside]
                        row = np.searchsorted(ends, at, "right")
                        fits = (at + sizes[n] <= ends[row]) & (every[at] == heads[n]) & (every[at + sizes[n] - WINDOW] == tails[n])
                        for i, k, r in zip(at[fits].tolist(), n[fits].tolist(), row[fits].tolist(), strict=True):
                            if data[i : i + sizes[k]].tobytes() == some[k][1]:
                                found.add((some[k][0], r))
            if short:
                found |= {(aid, row) for row, t in enumerate(batch.column(1).to_pylist()) for aid, anchor in short if anchor in t.encode()}
            aids, rows = zip(*sorted(found, key=lambda x: x[1]), strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(aids, aid_type), batch.column(0).take(pa.array(rows, pa.int64()))], names=["aid", "id"])

    aid_type = to_arrow_type(anchors.schema["aid"].dataType)
    return texts.select("id", "text").filter("text is not null").mapInArrow(run, f"aid {kinds[0]}, id {kinds[1]}")


def first_hits(pages: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """pages(by, qid, page, pos), wanted(qid, page) to by, qid, rank of the first wanted page; only queries that hit."""
    return pages.join(wanted, ["qid", "page"]).groupBy(*by, "qid").agg(F.min("pos").alias("rank"))


def counters(hits: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """hits(by, qid, rank), asked(by, qid): n, top1, top3, top5, mrr (misses count 0)."""
    all_rows = asked.join(hits, [*by, "qid"], "left")
    within = lambda k: F.count_if(F.col("rank") <= k).alias(f"top{k}")
    return all_rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        within(1),
        within(3),
        within(TOP),
        F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))), 6).alias("mrr"),
    )


def grid(spark, ks: list[float], dense: list[float], sparse: list[float]) -> DataFrame:
    """All configurations, the current one among them, each once, without those of two zero weights."""
    rows = {(float(k), float(d), float(s)) for k in ks for d in dense for s in sparse if d or s} | {(float(RRF_K), 1.0, 1.0)}
    return spark.createDataFrame(sorted(rows), "k double, wd double, ws double")


def grid_pages(dense: DataFrame, sparse: DataFrame, pages: DataFrame, configs: DataFrame) -> DataFrame:
    """Both pools, fetched once, fused under every configuration and grouped by page: k, wd, ws, qid, page, pos."""
    d = dense.select("qid", "id", F.col("rank").alias("rd"))
    s = sparse.select("qid", "id", F.col("rank").alias("rs"))
    both = d.join(s, ["qid", "id"], "full_outer").join(pages, "id").crossJoin(F.broadcast(configs))
    there = ((F.col("wd") > 0) & F.col("rd").isNotNull()) | ((F.col("ws") > 0) & F.col("rs").isNotNull())
    part = lambda w, r: F.coalesce(F.col(w) / (F.col("k") + F.col(r)), F.lit(0.0))
    best = both.filter(there).withColumn("rrf", F.round(part("wd", "rd") + part("ws", "rs"), 12))
    best = best.groupBy("k", "wd", "ws", "qid", "page").agg(F.max("rrf").alias("rrf"))
    order = Window.partitionBy("k", "wd", "ws", "qid").orderBy(F.desc("rrf"), "page")
    return best.withColumn("pos", F.row_number().over(order))


def ordered_configurations(counted: DataFrame) -> DataFrame:
    """counters by k, wd, ws, with pos, the best first (top5, top1, top3, mrr, then the configuration), and whether it is the
    best: the first that takes both branches. There are as many rows as configurations."""
    order = [F.desc("top5"), F.desc("top1"), F.desc("top3"), F.desc("mrr"), "k", "wd", "ws"]
    both = (F.col("wd") > 0) & (F.col("ws") > 0)
    first = F.row_number().over(Window.partitionBy(both).orderBy(*order)) == 1
    return counted.withColumn("pos", F.row_number().over(Window.orderBy(*order))).withColumn("best", both & first)


def gained_lost(hits: DataFrame, base: dict[str, float], top: int = TOP) -> DataFrame:
    """hits(k, wd, ws, qid, rank): for each configuration the queries in the top that the base misses, and the reverse."""
    good = hits.filter(F.col("rank") <= top).select("k", "wd", "ws", "qid")
    is_base = (F.col("k") == base["k"]) & (F.col("wd") == base["wd"]) & (F.col("ws") == base["ws"])
    old = good.filter(is_base).select("qid", F.lit(True).alias("old"))
    configs = hits.select("k", "wd", "ws").distinct()
    both = good.withColumn("new", F.lit(True)).join(configs.crossJoin(old), ["k", "wd", "ws", "qid"], "full_outer")
    listed = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("qid")))).cast("array<string>"), ",")
    return both.groupBy("k", "wd", "ws").agg(
        listed(F.col("old").isNull()).alias("gained"), listed(F.col("new").isNull()).alias("lost")
    )


def disagreements(exact: DataFrame, other: DataFrame) -> DataFrame:
    """Two rankings (qid, id, rank): the number of queries whose ordered ids differ."""
    seq = lambda df, n: df.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias(n))
    both = seq(exact, "a").join(seq(other, "b"), "qid", "full_outer")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_differ"))
