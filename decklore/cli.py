"""Run a registered query and show or write its result: python -m decklore.cli NAME SF_DIR [--out PATH] [--rows N].

Ends with 0; with 3 if a query of flags or issues returned rows of level error or red; with 1 on failure.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> int:
    from decklore.plans import asking, decks, search

    found = {f.__name__: f for group in (search, decks, asking) for f in group.QUERIES}
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("name", choices=sorted(found))
    parser.add_argument("sf_dir")
    parser.add_argument("--out")
    parser.add_argument("--rows", type=int, default=20)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName(args.name).getOrCreate()
    result = found[args.name](spark, args.sf_dir)
    if args.out:
        result.write.mode("overwrite").parquet(args.out)
    else:
        result.show(args.rows, truncate=False)
    level = next((c for c in ("severity", "level") if c in result.columns), None)
    return 3 if level and result.filter(F.col(level).isin("error", "red")).limit(1).count() else 0


if __name__ == "__main__":
    sys.exit(main())
