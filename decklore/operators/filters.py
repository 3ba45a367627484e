"""Metadata predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where(conditions: dict | None) -> Column:
    """All conditions hold: a list means one of, anything else equals; a missing value equals nothing."""
    def one(name: str, value) -> Column:
        if isinstance(value, (list, tuple, set)):
            return F.coalesce(F.col(name).isin(list(value)), F.lit(False))
        return F.coalesce(F.col(name) == F.lit(value), F.lit(False))

    return reduce(lambda a, b: a & b, [one(k, v) for k, v in (conditions or {}).items()], F.lit(True))


def searchable(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("content_type") == "content")


def parse_pages(spec: str) -> list[int]:
    """'9,11' and '9-15' as sorted distinct page numbers."""
    found: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        low, _, high = part.partition("-")
        found.update(range(int(low), int(high or low) + 1))
    return sorted(found)
