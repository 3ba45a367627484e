"""Readers and writers of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file; a file of another shape fails at once."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_labelled(spark: SparkSession, path: str, by: str | None = None) -> DataFrame:
    """Labelled queries; a single page and a list of pages both come as a list."""
    raw = spark.read.schema("queries array<struct<q: string, page: string, `by`: string, why: string, type: string>>").option("multiLine", True).json(path)
    flat = raw.select(F.posexplode("queries").alias("qid", "x")).select("qid", "x.*")
    digits = F.transform(F.regexp_extract_all("page", F.lit(r"\d+"), F.lit(0)), lambda d: d.cast("int"))
    out = flat.select("qid", "q", digits.alias("pages"), "by", "why", F.coalesce("type", F.lit("?")).alias("type"))
    return out.filter(F.col("by") == by) if by else out


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions that ``df`` has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def as_json_line(df: DataFrame) -> DataFrame:
    """Each row as a JSON object without nulls and empty arrays."""
    cols = [F.when(F.size(c) > 0, F.col(c)).alias(c) if t.startswith(("array", "map")) else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols)).alias("value"))


def spread(rows: DataFrame) -> DataFrame:
    """Dealt over all cores where there are fewer partitions: one file is one task otherwise."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, rows.columns[0]) if rows.rdd.getNumPartitions() < cores else rows
