"""Substring dedup: Rabin-Karp hashes of windows of words, counted in Spark; repeated windows merge into maximal removal
intervals.

Documents are dealt into groups by a hash of id and text; each group is worked on as a whole, and a group's size is
bounded, so their number grows with the input.

1. Every window has an anchor, the least hash among its runs of ANCHOR_WORDS words. Equal windows have equal anchors, so
   a window whose anchor is in no other document is proven to be in none either. Groups exchange each distinct anchor once,
   packed by range of hash, and get one bit for each: whether another group has it. That spares the rows of step 2 for all
   windows of text that nothing shares.
2. Each window with a shared anchor has a 96-bit Rabin-Karp hash. A group sends each distinct hash as a row, with the smallest
   id of its documents that have it; Spark counts them, and gives back those that another group has with a smaller id.
3. A group marks the windows that a document of a smaller id has, in the group or outside, merges them into intervals and
   drops the words in those.

A window in a third of all documents is one row for each group, no matter how many documents hold it. Windows are equal if
their hashes are: among n distinct windows a false match has a chance of about n^2 / 2^97.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from decklore.llm import arrow

WINDOW, ANCHOR_WORDS = 50, 8
#: Text in a group, and text whose entries meet in a bucket; the least number of either. Groups send at most as many rows as
#: they have entries, and at most one for each bucket, so larger groups suit larger inputs and executors.
GROUP_BYTES, BUCKET_BYTES, LEAST_GROUPS = 8 << 20, 16 << 20, 16
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
ENTRY = "bucket int, pid int, n int, low binary"
WINDOW_ROW = "pid int, low long, high long, first long"
BITS = "pid int, bucket int, bits binary"


def word_hashes(words: pa.Array) -> np.ndarray:
    coded = words.dictionary_encode()
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    return own[coded.indices.to_numpy()] if len(words) else np.empty(0, np.uint64)


def rabin_karp(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hashes mod 2^64 of all runs of ``size`` word hashes, longer runs made of shorter ones."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total, done = None, 0
    run, length, power = words, 1, base
    rest = size
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:  # append the run that follows what is done
                piece = run[done : done + n]
                total = piece.copy() if total is None else total * np.uint64(power) + piece
                done += length
            rest >>= 1
            if rest:
                run = run[: len(run) - length] * np.uint64(power) + run[length:]
                power = power * power % (1 << 64)
                length *= 2
    return total


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    least, n = values, 1
    while 2 * n <= size:
        least = np.minimum(least[: len(least) - n], least[n:])
        n *= 2
    return np.minimum(least[: len(values) - size + 1], least[size - n : len(values) - n + 1])


class Group:
    """The documents of one group, their words and windows."""

    def __init__(self, table: pa.Table, window: int) -> None:
        self.window, self.anchor_words = window, min(ANCHOR_WORDS, window)
        self.ids = table.column("doc_id").combine_chunks()
        self.flat, self.counts = arrow.words(pc.fill_null(table.column("text").combine_chunks(), ""))
        self.words = word_hashes(self.flat)
        of, at = arrow.positions(self.counts)
        known = self.ids.is_valid().to_numpy(zero_copy_only=False)
        self.id = pc.fill_null(self.ids, 0).to_numpy(zero_copy_only=False)
        self.start = np.flatnonzero((at <= self.counts[of] - window) & known[of])
        self.doc = self.id[of[self.start]]
        self.of = of

    def anchors(self) -> np.ndarray:
        if not len(self.start):
            return np.empty(0, np.uint64)
        grams = rabin_karp(self.words, self.anchor_words, BASES[0])
        least = sliding_min(grams, self.window - self.anchor_words + 1)[self.start]
        # Least hashes are small; a product by an odd number, one to one, spreads them over the buckets.
        return least * np.uint64(BASES[1])

    def anchor_entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors; for each window its anchor's place among them; whether two documents here have the anchor."""
        distinct, place = np.unique(self.anchors(), return_inverse=True)
        low = np.full(len(distinct), np.iinfo(np.int64).max)
        high = np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, place, self.doc)
        np.maximum.at(high, place, self.doc)
        return distinct, place, low < high

    def window_entries(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For windows at ``shared`` (places in start): distinct hashes (low, high), smallest ids, and for each window its
        hash's place among them."""
        at = self.start[shared]
        low = rabin_karp(self.words, self.window, BASES[0])[at]
        high = (rabin_karp(self.words, self.window, BASES[1])[at] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((self.doc[shared], high, low))
        l, h, d = low[order], high[order], self.doc[shared][order]
        new = np.ones(len(order), bool)
        new[1:] = (l[1:] != l[:-1]) | (h[1:] != h[:-1])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return l[new], h[new], d[new], place, at


def _send(pid: int, low: np.ndarray, bits: int) -> pa.Table:
    """Entries, sorted by ``low``, as one row for each bucket that has any: by the highest bits, so order is kept."""
    bucket = (low >> np.uint64(64 - bits)).astype(np.int64)
    edges = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(low)]
    cut = list(zip(edges[:-1], edges[1:], strict=True))
    return pa.table(
        {
            "bucket": pa.array(bucket[edges[:-1]], pa.int32()),
            "pid": pa.array([pid] * len(cut), pa.int32()),
            "n": pa.array([z - a for a, z in cut], pa.int32()),
            "low": pa.array([low[a:z].tobytes() for a, z in cut], pa.binary()),
        }
    )


def _received(bits: pa.Table, n: int) -> np.ndarray:
    """The bits of all entries of a group, in the order in which they were sent."""
    rows = sorted(zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist(), strict=True))
    out = [np.frombuffer(b, np.uint8) for _, b in rows]
    out = np.concatenate(out).astype(bool) if out else np.empty(0, bool)
    if len(out) != n:
        raise ValueError(f"{len(out)} answers for {n} entries")
    return out


def _compare(table: pa.Table) -> pa.Table:
    """For each entry of a bucket: does another group have it?"""
    pids, n = table.column("pid").to_pylist(), table.column("n").to_numpy()
    low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint64)
    order = np.argsort(low, kind="stable")
    new = np.ones(len(low), bool)
    new[1:] = low[order][1:] != low[order][:-1]
    run = np.cumsum(new) - 1
    bits = np.empty(len(low), np.uint8)
    bits[order] = np.bincount(run)[run] > 1
    ends = np.cumsum(n)
    return pa.table(
        {
            "pid": pa.array(pids, pa.int32()),
            "bucket": table.column("bucket").cast(pa.int32()),
            "bits": pa.array([bits[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary()),
        }
    )


def _among(low: np.ndarray, high: np.ndarray, rows: pa.Table) -> np.ndarray:
    """Which of the distinct hashes are among the rows' ones?"""
    all_low = np.concatenate([low, rows.column("low").to_numpy().view(np.uint64)])
    all_high = np.concatenate([high.astype(np.int64), rows.column("high").to_numpy()])
    order = np.lexsort((all_high, all_low))
    l, h = all_low[order], all_high[order]
    new = np.ones(len(order), bool)
    new[1:] = (l[1:] != l[:-1]) | (h[1:] != h[:-1])
    run = np.empty(len(order), np.int64)
    run[order] = np.cumsum(new) - 1
    return np.isin(run[: len(low)], run[len(low) :])


def _finish(group: Group, gone: np.ndarray) -> pa.Table:
    """gone: starts of removed windows in the flat words."""
    edge = np.zeros(len(group.flat) + 1, np.int64)
    np.add.at(edge, gone, 1)
    np.subtract.at(edge, gone + group.window, 1)
    keep = np.cumsum(edge[:-1]) == 0
    left = np.bincount(group.of[keep], minlength=len(group.counts))
    offsets = np.concatenate([[0], np.cumsum(left)]).astype(np.int32)
    kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), group.flat.filter(pa.array(keep))), " ")
    return pa.table(
        {
            "doc_id": group.ids,
            "n_words": pa.array(group.counts, pa.int64()),
            "n_removed": pa.array(group.counts - left, pa.int64()),
            "kept_text": kept,
        }
    )


def substring_dedup(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, and kept_text, the words that stay joined by single
    spaces, or without ``keep_text`` kept_sha256.

    A word goes if a window of ``window`` words over it starts in a document with a smaller id as well. Null texts are
    empty. Rows with a null id keep all their words and remove none of others'. Rows that repeat an id don't remove each
    other's words. Texts of any length are worked on whole. An empty table gives an empty result.
    """
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    known = slim.filter("doc_id is not null")
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    groups = max(LEAST_GROUPS, math.ceil(size / GROUP_BYTES))
    bits = max(LEAST_GROUPS, math.ceil(size / BUCKET_BYTES)).bit_length()
    # Rows that repeat an id are spread by their texts.
    dealt = known.withColumn("pid", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int")).groupBy("pid")

    def send_anchors(key: tuple, table: pa.Table) -> pa.Table:
        return _send(key[0].as_py(), Group(table, window).anchor_entries()[0], bits)

    def shared_windows(group: Group, anchors: pa.Table) -> np.ndarray:
        distinct, place, here = group.anchor_entries()
        return np.flatnonzero((_received(anchors, len(distinct)) | here)[place])

    def send_windows(key: tuple, table: pa.Table, anchors: pa.Table) -> pa.Table:
        group = Group(table, window)
        low, high, first, _, _ = group.window_entries(shared_windows(group, anchors))
        pid = np.full(len(low), key[0].as_py(), np.int32)
        return pa.table({"pid": pid, "low": low.view(np.int64), "high": high.astype(np.int64), "first": first})

    def told(out: pa.Table) -> pa.Table:
        if keep_text:
            return out
        digest = [hashlib.sha256(t).hexdigest() for t in out.column("kept_text").cast(pa.binary()).to_pylist()]
        return out.drop_columns(["kept_text"]).append_column("kept_sha256", pa.array(digest, pa.string()))

    def apply(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        group = Group(table, window)
        shared = shared_windows(group, answers.filter(pc.is_valid(answers.column("bits"))))
        low, high, first, place, at = group.window_entries(shared)
        before = _among(low, high, answers.filter(pc.is_null(answers.column("bits"))))
        return told(_finish(group, at[before[place] | (group.doc[shared] > first[place])]))

    def without_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in arrow.steps(batches):
            group = Group(pa.Table.from_batches([step]), window)
            yield from told(_finish(group, np.empty(0, np.int64))).to_batches()

    anchors = dealt.applyInArrow(arrow.giving_back(send_anchors), ENTRY).groupBy("bucket").applyInArrow(_compare, BITS)
    windows = dealt.cogroup(anchors.groupBy("pid")).applyInArrow(arrow.giving_back(send_windows), WINDOW_ROW)
    same = Window.partitionBy("low", "high")
    later = windows.withColumn("least", F.min("first").over(same)).filter("least < first").select("pid", "low", "high")
    answers = anchors.unionByName(later, allowMissingColumns=True)
    last = "kept_text string" if keep_text else "kept_sha256 string"
    schema = f"doc_id long, n_words long, n_removed long, {last}"
    out = dealt.cogroup(answers.groupBy("pid")).applyInArrow(arrow.giving_back(apply), schema)
    return out.unionByName(slim.filter("doc_id is null").mapInArrow(without_id, schema))
