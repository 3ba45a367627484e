"""Arithmetic as Column expressions: vectors, ranks, boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K, POOL, TOP = 15, 50, 5


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length (at least 1e-12)."""
    length = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / length)


def rrf(rank_dense: Column, rank_sparse: Column, k: float = RRF_K, dense: float = 1.0, sparse: float = 1.0) -> Column:
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (F.lit(float(k)) + r), F.lit(0.0))
    return part(dense, rank_dense) + part(sparse, rank_sparse)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def parsed_or(text: Column, default: float, low: float, high: float) -> Column:
    """A number out of text, the default where it is none, within limits."""
    return clamp(F.coalesce(text.try_cast("double"), F.lit(default)), low, high)


def overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Area common to two boxes of l, t, r, b."""
    w = F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"])
    h = F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def speaking_seconds(syllables: Column, per_minute: float = 200.0) -> Column:
    return syllables / F.lit(per_minute) * 60
