"""Quality rules: compression bands.

A text's zstandard ratio (its bytes over its compressed bytes) tells repetitive text (high) from text without structure
(low). The whole text and each of its fixed chunks have a ratio; limits depend on the length that was compressed, as
short pieces compress less. A text is rejected when the whole of it is out of its band, or when chunks out of theirs
hold more than a set share of its bytes. Base rules on words and repeated 5-word windows come first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from decklore.llm import arrow

LEVEL, CHUNK_BYTES, WINDOW = 3, 4096, 5


@dataclass(frozen=True)
class Bands:
    """Limits by length: (bytes up to which they hold, least ratio, most ratio); the last entry holds for the rest."""

    bands: tuple[tuple[float, float, float], ...] = (
        (128, 0.0, 1.8),
        (256, 0.9, 2.2),
        (512, 1.05, 2.5),
        (1024, 1.2, 2.8),
        (2048, 1.35, 3.2),
        (8192, 1.45, 3.8),
        (65536, 1.5, 4.5),
        (float("inf"), 1.5, 5.5),
    )
    #: Most bytes, as a share of the text's, in chunks that are out of their band.
    bad_share: float = 0.5
    level: int = LEVEL
    chunk_bytes: int = CHUNK_BYTES
    least_words: int = 10
    most_repeated: int = 20
    upto: tuple[float, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "upto", tuple(b[0] for b in self.bands))

    def out(self, n_bytes: int, ratio: float) -> int:
        """-1 for incompressible, 1 for repetitive, 0 within the band."""
        _, low, high = self.bands[int(np.searchsorted(self.upto, n_bytes))]
        return -1 if ratio < low else 1 if ratio > high else 0


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, bad_share double, verdict string"
)


def repeated_words(word: np.ndarray, counts: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """For each text, the words that lie in windows found twice or more in it."""
    start, code = arrow.window_codes(word, counts, size)
    total = np.zeros(len(counts), np.int64)
    if not len(start):
        return total
    of = np.repeat(np.arange(len(counts)), counts)
    key = arrow.dense(code * len(counts) + of[start])
    again = start[np.bincount(key)[key] > 1]
    edge = np.zeros(len(word) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.subtract.at(edge, again + size, 1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(of[covered], minlength=len(counts)).astype(np.int64)


def duplicate_lines(column: pa.Array) -> np.ndarray:
    """For each text, the \\n-split lines with a word that equal an earlier line of it."""
    lists = pc.split_pattern(column, "\n")
    flat, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    there = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0).to_numpy(zero_copy_only=False)
    flat, of = flat.filter(pa.array(there)), of[there]
    if not len(of):
        return np.zeros(len(column), np.int64)
    key = arrow.dense(arrow.codes(flat) * len(column) + of)
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    return np.bincount(of[~first], minlength=len(column)).astype(np.int64)


def compression(text: bytes, bands: Bands, zip_: zstandard.ZstdCompressor) -> tuple[float, float, str]:
    """Ratio of the whole, share of bytes in chunks out of their band, and the verdict: kept or what is wrong."""
    n = len(text)
    if not n:
        return 0.0, 0.0, "kept"
    ratio = n / len(zip_.compress(text))
    whole = bands.out(n, ratio)
    size, odd = bands.chunk_bytes, 0
    if n > size:
        for at in range(0, n, size):
            piece = text[at : at + size]
            odd += len(piece) * (bands.out(len(piece), len(piece) / len(zip_.compress(piece))) != 0)
    share = odd / n
    verdict = {-1: "incompressible", 1: "repetitive"}.get(whole, "chunks" if share > bands.bad_share else "kept")
    return ratio, share, verdict


def quality_batch(batch: pa.RecordBatch, bands: Bands) -> pa.RecordBatch:
    """``batch`` has doc_id and text."""
    column = arrow.texts(batch)
    flat, n_words = arrow.words(column)
    of = np.repeat(np.arange(len(column)), n_words)
    length = pc.utf8_length(flat).to_numpy(zero_copy_only=False)
    word_chars = np.bincount(of, weights=length, minlength=len(column)).astype(np.int64)
    repeat = repeated_words(arrow.codes(flat), n_words)
    symbols = pc.count_substring_regex(column, r"[#*$%&|<>]")
    failed = (n_words < bands.least_words) | (100 * repeat > bands.most_repeated * n_words)
    zip_ = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)
    ratio, share, verdict = zip(
        *(compression(x.as_buffer().to_pybytes() if x.as_buffer() else b"", bands, zip_) for x in column), strict=True
    )
    verdict = np.where(failed, "base", np.array(verdict, dtype=object))
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id").cast(pa.int64()),
            *(pa.array(x, pa.int64()) for x in (n_words, word_chars)),
            symbols.cast(pa.int64()),
            *(pa.array(x, pa.int64()) for x in (duplicate_lines(column), repeat)),
            pa.array(failed),
            pa.array(verdict == "kept"),
            pa.array(ratio, pa.float64()),
            pa.array(share, pa.float64()),
            pa.array(verdict, pa.string()),
        ],
        names=[x.split()[0] for x in SCHEMA.split(", ")],
    )


def quality_report(
    docs: DataFrame, bands: Bands | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of ``docs``: SCHEMA. A map without any shuffle.

    A null or empty text has no words, so the base rules fail it. Texts of any length are judged whole. Null and
    repeated ids are rows like any other; an empty table gives an empty result.
    """
    bands = bands or Bands()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in arrow.steps(batches):
            yield quality_batch(step, bands)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)


def quality_filter(docs: DataFrame, bands: Bands | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they are."""
    bands = bands or Bands()
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [f"c{i}" for i in range(batch.num_columns)]
            plain = pa.RecordBatch.from_arrays(batch.columns, names=names)
            for step in arrow.steps(iter([plain]), names[at]):
                ids = pa.nulls(step.num_rows, pa.int64())
                judged = pa.RecordBatch.from_arrays([ids, step.column(at)], names=["doc_id", "text"])
                out = step.filter(quality_batch(judged, bands).column("kept"))
                yield pa.RecordBatch.from_arrays(out.columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
