"""What the operators of this subpackage share: input tables, shared staging and a skew-safe join."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space (fixed value of the contracts).
WORD = r"[^\x20\x09-\x0D]+"
#: A hot key's rows are joined by broadcast; there are at most this many hot keys, whatever the input.
MAX_HOT_KEYS = 100_000
#: Bytes up to which a table of rows of known width is broadcast whole.
BROADCAST_BYTES = 16 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="decklore-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/decklore-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove staged tables whose readers are all written themselves."""
    for table in tables:
        spark = table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(table.staged_path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc): the rows as structs, staged with a number each, so that no column of theirs clashes with one of ours."""
    row = F.monotonically_increasing_id().alias("row")
    return stage_table(docs.select(row, F.struct(*[docs[c] for c in docs.columns]).alias("doc")), "numbered")


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, how: str = "inner", width: int = 0) -> DataFrame:
    """Join ``left`` to ``right``, which has one row for each key and in ``n`` that key's number of rows in ``left``.

    Keys with more than 1/100,000 of all rows (there can be no more than 100,000 of those) go by broadcast, so their
    rows stay where they are; all others have few rows and are shuffled. Both inputs are read twice: stage them.
    ``how`` is inner or left. Null keys match nothing. With ``width``, the bytes of a row of ``right``, which must have no
    column of variable size, all of it goes by broadcast if its number of rows shows that it is within BROADCAST_BYTES.
    """
    if width and right.count() * width <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), keys, how)
    total = right.agg(F.coalesce(F.sum(n), F.lit(0)).alias("s")).first()["s"]
    least = max(64, total // MAX_HOT_KEYS)
    mark = next(f"hot{i}" for i in range(len(left.columns) + 1) if f"hot{i}" not in {*left.columns, *right.columns})
    hot = right.filter(F.col(n) > least).withColumn(mark, F.lit(True))
    cold = right.filter(F.col(n) <= least)
    marked = left.join(F.broadcast(hot), keys, "left")
    far = marked.filter(F.col(mark).isNull()).select(*left.columns).join(cold, keys, how)
    return marked.filter(mark).drop(mark).unionByName(far)


def hex_bits(col: Column, skip: int = 0) -> Column:
    """60 bits of an MD5 digest as a long, 15 hex digits from digit ``skip`` on; SQL engines agree on it."""
    return F.conv(F.substring(F.md5(col.cast("string").cast("binary")), skip + 1, 15), 16, 10).cast("long")
