"""Vectorised word work on Arrow batches, for the operators that run Python on the executors."""

from __future__ import annotations

import ctypes
import platform
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes of text that one step works on, whatever the size of Spark's batches.
STEP_ROWS, STEP_BYTES = 1024, 4 << 20


def steps(
    batches: Iterator[pa.RecordBatch], text: str = "text", most_rows: int = STEP_ROWS, most_bytes: int = STEP_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a step holds at most so many bytes of text, or a single row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            n = int(np.searchsorted(ends, before + most_bytes, side="right")) - at
            n = max(1, min(n, most_rows, batch.num_rows - at))
            yield batch.slice(at, n)
            at += n
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task holds none of the last one's."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and platform.libc_ver()[0] == "glibc":
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def giving_back(f):
    """The function of groups, followed by ``give_back``."""

    def keyed(key: tuple, *tables: pa.Table) -> pa.Table:
        out = f(key, *tables)
        give_back()
        return out

    def keyed_one(key: tuple, table: pa.Table) -> pa.Table:
        return keyed(key, table)

    def keyed_two(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return keyed(key, left, right)

    return keyed_two if f.__code__.co_argcount == 3 else keyed_one


def texts(batch: pa.RecordBatch, text: str = "text") -> pa.Array:
    """The column of texts, null as empty."""
    return pc.fill_null(batch.column(text), "")


def words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (runs of anything but ASCII white space) of all texts, and the number of words in each text."""
    lists = pc.ascii_split_whitespace(column)
    flat = lists.flatten()
    of = pc.list_parent_indices(lists).to_numpy()
    there = pc.not_equal(flat, "")
    flat = flat.filter(there)
    counts = np.bincount(of[there.to_numpy(zero_copy_only=False)], minlength=len(column))
    return flat, counts.astype(np.int64)


def codes(values: pa.Array) -> np.ndarray:
    """Small integers, equal for equal values and for those alone."""
    return values.dictionary_encode().indices.to_numpy().astype(np.int64)


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of int64 keys from 0: equal for equal keys and for those alone."""
    import pandas as pd

    return pd.factorize(keys)[0].astype(np.int64)


def positions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items that lie text after text: the text of each, and its position there."""
    of = np.repeat(np.arange(len(counts)), counts)
    starts = np.cumsum(counts) - counts
    return of, np.arange(len(of)) - starts[of]


def window_codes(word: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (in the flat words) of all windows of ``size`` words within a text, and codes that are equal for equal
    windows and for those alone, made by joining codes of ever longer pieces."""
    of, at = positions(counts)
    start = np.flatnonzero(at <= counts[of] - size) if len(of) else np.empty(0, np.int64)
    code, have = word, 1  # code[i]: of the piece of `have` words that starts at i
    while have < size and len(start):
        step = min(have, size - have)
        second = code if step == have else None
        n = len(code) - step
        if second is None:  # overlap: pieces that end where the window ends
            n = len(word) - size + 1
            joined = code[:n] * (code.max() + 1) + code[size - have : size - have + n]
            code, have = dense(joined), size
        else:
            joined = code[:n] * (code.max() + 1) + code[step : step + n]
            code, have = dense(joined), have * 2
    return start, code[start] if len(start) else np.empty(0, np.int64)
