"""Sharding by extendible hashing, with DataFrame operations alone.

A document's hash is 60 bits of the MD5 of its key, followed by 60 bits of the MD5 of its row number, which only count
where rows share a key. A bucket is a prefix of those bits. The directory starts with the empty prefix; buckets over
the byte limit, and no others, are split on the next bit. Splits are decided on a histogram of prefixes, many bits a
pass: a node is a shard when it fits and its parent doesn't, just what splitting one bit at a time arrives at. Buckets
that don't fit after a pass go on with further bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decklore.llm.common import hex_bits, numbered, skew_join, stage_table

SHARD_BYTES = 16 << 20
KEY_BITS, MAX_PASS_BITS = 60, 24


def _prefix(skip: int, bits: int) -> Column:
    """Bits skip..skip+bits of the hash as a long, none across the seam of key and row number."""
    word, at = ("key_hash", skip) if skip < KEY_BITS else ("row_hash", skip - KEY_BITS)
    return F.shiftright(F.col(word), KEY_BITS - at - bits).bitwiseAND(F.lit((1 << bits) - 1))


def _bit_string(value: Column, bits: Column) -> Column:
    return F.when(bits == 0, F.lit("")).otherwise(F.lpad(F.conv(value.cast("string"), 10, 2), bits, F.lit("0")))


def directory(rows: DataFrame, bits: int, limit: int, first: int = 0) -> DataFrame:
    """rows(path, prefix, bytes) to one row for each prefix in each open bucket (path) of an earlier pass: path, prefix,
    depth, bucket, shard_bytes, shard_docs, n, fits. Depths start at ``first``, 1 where the path is known not to fit.
    """
    fine = stage_table(
        rows.groupBy("path", "prefix").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")),
        "shard-histogram",
    )
    chain = fine.select(
        "path", "prefix", "bytes", "n", F.explode(F.sequence(F.lit(first), F.lit(bits))).alias("depth")
    ).withColumn("bucket", F.expr(f"shiftright(prefix, {bits} - depth)"))
    nodes = chain.groupBy("path", "depth", "bucket").agg(
        F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_docs")
    )
    # The first node down the chain that fits is the shard; with none, the deepest one stays open. Nodes that are neither
    # leave before the join: those near the root hold most prefixes.
    nodes = nodes.filter((F.col("shard_bytes") <= limit) | (F.col("depth") == bits))
    ends = chain.select("path", "prefix", "depth", "bucket", "n").join(nodes, ["path", "depth", "bucket"])
    best = ends.groupBy("path", "prefix").agg(F.min("depth").alias("depth"))
    return ends.join(best, ["path", "prefix", "depth"]).withColumn("fits", F.col("shard_bytes") <= limit)


def extendible_shards(
    docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", pass_bits: int = 0
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, shard (bits, as text), depth, shard_bytes, shard_docs.

    Sizes are UTF-8 bytes of the text, 0 for null. A document over the limit has a shard of its own, named big- and its
    row number. A null id is a key like any other. Rows that repeat a key, however many, part on their row numbers, so
    every other shard fits the limit. An empty table gives an empty result.
    """
    return _shards(docs, F.monotonically_increasing_id(), limit, id_col, text_col, pass_bits).drop("row")


def _shards(docs: DataFrame, row: Column, limit: int, id_col: str, text_col: str, pass_bits: int = 0) -> DataFrame:
    """What ``extendible_shards`` says, and the number of the row."""
    key = F.coalesce(docs[id_col].cast("string"), F.lit("null"))
    slim = docs.select(
        docs[id_col].alias("doc_id"),
        F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long").alias("bytes"),
        hex_bits(key).alias("key_hash"),
        row.alias("row"),
    )
    slim = stage_table(slim.withColumn("row_hash", hex_bits(F.col("row"))), "shard-rows")
    big = slim.filter(F.col("bytes") > limit).select(
        "row",
        "doc_id",
        "bytes",
        F.concat(F.lit("big-"), F.col("row").cast("string")).alias("shard"),
        F.lit(None).cast("int").alias("depth"),
        F.col("bytes").alias("shard_bytes"),
        F.lit(1).cast("long").alias("shard_docs"),
    )
    rows = slim.filter(F.col("bytes") <= limit).withColumn("path", F.lit(""))
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    done, skip, want = [big], 0, 4 + max(0, math.ceil(math.log2(max(total, 1) / limit)))
    while True:
        bits = min(pass_bits or want, MAX_PASS_BITS, KEY_BITS - skip % KEY_BITS)
        rows = rows.withColumn("prefix", _prefix(skip, bits))
        found = stage_table(directory(rows, bits, limit, first=min(skip, 1)), "shard-directory")
        joined = skew_join(rows, found, ["path", "prefix"], "n")
        last = skip + bits >= 2 * KEY_BITS
        closed = joined if last else joined.filter("fits")
        done.append(
            closed.select(
                "row",
                "doc_id",
                "bytes",
                F.concat("path", _bit_string(F.col("bucket"), F.col("depth"))).alias("shard"),
                (F.length("path") + F.col("depth")).cast("int").alias("depth"),
                "shard_bytes",
                "shard_docs",
            )
        )
        if last or not found.filter("not fits").limit(1).count():
            break
        rows = stage_table(
            joined.filter("not fits").select(
                "row",
                "doc_id",
                "bytes",
                "key_hash",
                "row_hash",
                F.concat("path", _bit_string(F.col("bucket"), F.col("depth"))).alias("path"),
            ),
            "shard-open",
        )
        skip += bits
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("bytes", "n_bytes")


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` in one folder for each shard, shard=bits. Rows find their shard by their number, so null and repeated
    ids are rows like any other. A column that is named shard must be renamed first."""
    if "shard" in docs.columns:
        raise ValueError("the column shard names the folders")
    rows = numbered(docs)
    doc = F.col("doc")
    slim = rows.select("row", doc.getField(id_col).alias("id"), doc.getField(text_col).alias("text"))
    of = _shards(slim, F.col("row"), limit, "id", "text").select("row", "shard")
    found = rows.join(of, "row").select("doc.*", "shard")
    found.repartition("shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)


#: DuckDB SQL for one pass over unique keys; {limit} in bytes.
SHARD_SQL = """
WITH rows AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents
), chain AS (SELECT doc_id, bytes, CAST(d AS INTEGER) AS depth, h >> (60 - d) AS bucket
  FROM rows, (SELECT unnest(range(0, 25)) AS d)
), nodes AS (SELECT depth, bucket, CAST(sum(bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs
  FROM chain GROUP BY 1, 2
), ends AS (SELECT c.doc_id, c.bytes, c.depth, c.bucket, n.shard_bytes, n.shard_docs
  FROM chain c JOIN nodes n USING (depth, bucket) WHERE n.shard_bytes <= {limit}
  QUALIFY row_number() OVER (PARTITION BY c.doc_id ORDER BY c.depth) = 1)
SELECT doc_id, bytes AS n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(bucket), 64, '0'), depth) END AS shard,
       depth, shard_bytes, shard_docs
FROM ends
"""
