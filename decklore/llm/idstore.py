"""Token-id files with a minimal perfect hash index.

Documents are dealt out by ranges of their ids and encoded in ascending order. Three kinds of Parquet rows, as only Spark's
own writers reach every shared store:

``kind=ids``    blocks of whole documents, about BLOCK_IDS ids each: the raw little-endian ids of all of them as one binary
                value, and where each ends.
``index``       buckets of about BUCKET_KEYS documents. A bucket has a minimal perfect hash function, by hashing and
                displacing: it maps a document's key to one of as many slots as there are documents. A slot has a 16-bit
                fingerprint of its key and where the document is: range, block, place in it, first id, number of ids.
``kind=parts``  one row for each range of the writer.

Keys aren't stored. A lookup computes the bucket from the key, reads that row (a folder of the index has FOLDER_BUCKETS of
them, a page PAGE_ROWS), compares the fingerprint, and reads the block that the slot names: a bounded number of bytes, however
many documents there are. A foreign key passes for a stored one with a chance of 2^-16.

A key is an id and how many documents with the same id are before this one; null is an id like any other. Where a block
starts among all ids: the ids before it in its range, which the writing task knows, and the sum of all ranges before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from decklore.llm import arrow
from decklore.llm.common import stage_table
from decklore.llm.tokens import ENDED_WORDS, LATIN, MARKS, encoder, gathered

#: Ids of a block, documents of a bucket, buckets of a group that one task call builds and of a folder, ranges of a folder of
#: blocks, rows of a Parquet page.
BLOCK_IDS, BUCKET_KEYS, GROUP_BUCKETS, FOLDER_BUCKETS, FOLDER_PARTS, PAGE_ROWS = 1 << 16, 2048, 16, 4096, 64, 16
#: Larger steps have fewer distinct words for their size.
STEP_ROWS, STEP_BYTES = 8192, 16 << 20
GROUP_KEYS = 3

WRITTEN = (
    "kind string, folder int, part int, block int, ids_before long, id_bytes int, lengths binary, payload binary, "
    "keys array<long>, repeats array<long>, offsets array<int>, sizes array<int>, "
    "n_docs long, n_ids long, first_key long, first_run long, last_key long, last_run long"
)
WRITTEN_SCHEMA = pa.schema(
    [
        ("kind", pa.string()),
        ("folder", pa.int32()),
        ("part", pa.int32()),
        ("block", pa.int32()),
        ("ids_before", pa.int64()),
        ("id_bytes", pa.int32()),
        ("lengths", pa.binary()),
        ("payload", pa.binary()),
        ("keys", pa.list_(pa.int64())),
        ("repeats", pa.list_(pa.int64())),
        ("offsets", pa.list_(pa.int32())),
        ("sizes", pa.list_(pa.int32())),
        *((c, pa.int64()) for c in ("n_docs", "n_ids", "first_key", "first_run", "last_key", "last_run")),
    ]
)
BLOCKS = "folder int, part int, block int, ids_before long, id_bytes int, lengths binary, payload binary"
KEYS = "part int, block int, keys array<long>, repeats array<long>, offsets array<int>, sizes array<int>"
PARTS = "part int, n_docs long, n_ids long, first_key long, first_run long, last_key long, last_run long"
#: What a slot says, behind its fingerprint.
PLACE = ("part", "block", "place", "offset", "size", "same")
INDEX = "folder int, bucket long, seed long, displacements binary, fingerprints binary, places binary"
FOUND = "doc_id long, nth long, part int, block int, place int, offset int, size int, same long"


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


STEP = np.uint64(0x9E3779B97F4A7C15)


def key_hashes(ids: np.ndarray, known: np.ndarray, nth: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of keys: ids (null where not known) and the documents with the same id before."""
    with np.errstate(over="ignore"):
        first = _mix(np.where(known, ids, 0).astype(np.int64).view(np.uint64) + np.uint64(seed + 1) * STEP)
        second = np.where(known, nth, -1 - nth).astype(np.int64).view(np.uint64)
        return _mix(first + second * np.uint64(0xD6E8FEB86659FD93))


class PerfectHash:
    """A minimal perfect hash function of 64-bit hashes by hashing and displacing; about GROUP_KEYS keys share a displacement.

    A displacement from 0 on seeds the hash of all keys of its group; -s - 1 sends the one key there to slot s.
    """

    def __init__(self, displacements: np.ndarray, fingerprints: np.ndarray) -> None:
        self.displacements, self.fingerprints = displacements, fingerprints

    @staticmethod
    def _slots(hashes: np.ndarray, seeds: np.ndarray | int, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (_mix(hashes + np.asarray(seeds, np.uint64) * STEP) % np.uint64(max(n, 1))).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        """hashes: distinct. Larger groups of keys are placed first; those of a size all at once, many seeds at a time, and
        those that get into each other's way try on."""
        n = len(hashes)
        out = np.zeros(max(1, -(-n // GROUP_KEYS)), np.int64)
        if not n:
            return cls(out, np.empty(0, np.uint16))
        group = (hashes % np.uint64(len(out))).astype(np.int64)
        order = np.argsort(group, kind="stable")
        sizes = np.bincount(group, minlength=len(out))
        starts = np.cumsum(sizes) - sizes
        taken = np.zeros(n, bool)
        for size in range(int(sizes.max()), 1, -1):
            waiting = np.flatnonzero(sizes == size)
            seed = 1
            while len(waiting):
                own = hashes[order[starts[waiting][:, None] + np.arange(size)]]  # groups x keys
                many = max(1, min(256, 8192 // own.size))
                seeds = np.arange(seed, seed + many)
                slots = cls._slots(own[None], seeds[:, None, None], n)  # seeds x groups x keys
                ranked = np.sort(slots, axis=2)
                free = ~taken[slots].any(axis=2) & (ranked[:, :, 1:] != ranked[:, :, :-1]).all(axis=2)
                which = free.argmax(axis=0)
                able = np.flatnonzero(free.any(axis=0))
                if len(able):
                    wanted = slots[which[able], able]  # groups x keys
                    _, first = np.unique(wanted.reshape(-1), return_index=True)
                    mine = np.zeros(wanted.size, bool)
                    mine[first] = True
                    won = mine.reshape(wanted.shape).all(axis=1)
                    out[waiting[able[won]]] = seeds[which[able[won]]]
                    taken[wanted[won].reshape(-1)] = True
                    waiting = np.delete(waiting, able[won])
                    if not won.all() and len(able) == free.shape[1]:
                        continue  # the same seeds have more to give
                seed += many
        single = np.flatnonzero(sizes == 1)
        out[single] = -np.flatnonzero(~taken)[: len(single)] - 1
        made = cls(out, np.empty(n, np.uint16))
        made.fingerprints[made.slots(hashes)] = made.fingerprint(hashes)
        return made

    @staticmethod
    def fingerprint(hashes: np.ndarray) -> np.ndarray:
        return (_mix(hashes ^ STEP) >> np.uint64(48)).astype(np.uint16)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        d = self.displacements[(hashes % np.uint64(len(self.displacements))).astype(np.int64)]
        return np.where(d < 0, -d - 1, self._slots(hashes, np.maximum(d, 0), len(self.fingerprints)))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the fingerprint says that it isn't there."""
        if not len(self.fingerprints):
            return np.full(len(hashes), -1)
        at = self.slots(hashes)
        return np.where(self.fingerprints[at] == self.fingerprint(hashes), at, -1)


class _Writer:
    """Collects encoded documents, in order, into blocks."""

    def __init__(self, part: int, width: np.dtype) -> None:
        self.part, self.width, self.block, self.before, self.n_docs = part, width, 0, 0, 0
        self.keys: list[int | None] = []
        self.repeats: list[int] = []
        self.payloads: list[bytes] = []
        self.n = self.run = 0
        self.first: tuple[int | None, int] | None = None
        self.last: int | None = None

    def add(self, key: int | None, ids: bytes) -> Iterator[pa.RecordBatch]:
        if self.n_docs and key == self.last:
            self.run += 1
        else:
            if self.n_docs and self.first is None:
                self.first = self.last, self.run
            self.run = 1
        self.last, self.n_docs = key, self.n_docs + 1
        self.keys.append(key)
        self.repeats.append(self.run - 1)
        self.payloads.append(ids)
        self.n += len(ids) // self.width.itemsize
        if self.n >= BLOCK_IDS:
            yield from self.close()

    def _rows(self, rows: list[dict]) -> pa.RecordBatch:
        common = {"part": self.part, "folder": self.part // FOLDER_PARTS}
        return pa.RecordBatch.from_pylist([common | r for r in rows], schema=WRITTEN_SCHEMA)

    def close(self) -> Iterator[pa.RecordBatch]:
        if not self.keys:
            return
        sizes = np.array([len(p) // self.width.itemsize for p in self.payloads], np.int32)
        ends = np.cumsum(sizes, dtype=np.int64)
        ids = {
            "kind": "ids",
            "block": self.block,
            "ids_before": self.before,
            "id_bytes": self.width.itemsize,
            "lengths": sizes.astype("<u4").tobytes(),
            "payload": b"".join(self.payloads),
        }
        keys = {
            "kind": "keys",
            "block": self.block,
            "keys": self.keys,
            "repeats": self.repeats,
            "offsets": (ends - sizes).tolist(),
            "sizes": sizes.tolist(),
        }
        yield self._rows([ids, keys])
        self.block, self.before = self.block + 1, self.before + self.n
        self.keys, self.repeats, self.payloads, self.n = [], [], [], 0

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self.close()
        if self.n_docs:
            first = self.first or (self.last, self.run)
            told = {"first_key": first[0], "first_run": first[1], "last_key": self.last, "last_run": self.run}
            yield self._rows([{"kind": "parts", "n_docs": self.n_docs, "n_ids": self.before} | told])


def encode_words(column: pa.Array, path: str) -> list[bytes]:
    """Ids of texts for a tokenizer that drops white space and case. Each distinct word is encoded once a call; a word with
    marks behind it is its two parts, and ASCII and Latin words are encoded in lower case."""
    known = encoder(path, ENDED_WORDS)
    flat, counts = arrow.words(column)
    coded = flat.dictionary_encode()
    words = coded.dictionary
    plain = pc.match_substring_regex(words, rf"^{LATIN}+(?:{MARKS})?$")
    words = pc.if_else(plain, pc.utf8_lower(words), words)
    words = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words)
    # Words of letters that the normaliser leaves as they are; marks behind those are a word of their own.
    marked = pc.match_substring_regex(words, rf"^{LATIN}+{MARKS}$")
    marks = pc.if_else(marked, pc.replace_substring_regex(words, rf"^{LATIN}+", ""), "").dictionary_encode()
    base = pc.if_else(marked, pc.replace_substring_regex(words, rf"{MARKS}$", ""), words).dictionary_encode()
    bases = base.dictionary
    alike = pc.and_(pc.match_substring_regex(bases, rf"^{LATIN}+$"), pc.equal(pc.utf8_lower(bases), bases))
    own = np.empty(len(bases), object)
    rows = alike.to_numpy(zero_copy_only=False)
    own[rows] = known.encode_rows(bases.filter(alike).to_pylist())
    own[~rows] = known.encode_all(bases.filter(pc.invert(alike)).to_pylist())
    behind = np.empty(len(marks.dictionary), object)
    behind[:] = known.encode_all(marks.dictionary.to_pylist())
    ids = own[base.indices.to_numpy()]
    both = marked.to_numpy(zero_copy_only=False)
    ids[both] += behind[marks.indices.to_numpy()[both]]
    ids = ids.tolist()
    out, ends = gathered(ids, coded.indices.to_numpy(), known.width)
    upto = np.concatenate([[0], np.cumsum(counts)])
    cuts = (np.concatenate([[0], ends])[upto] * known.width.itemsize).tolist()
    return [out[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def encode_whole(column: pa.Array, path: str) -> list[bytes]:
    return encoder(path).encode_all(column.to_pylist())


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _kind(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """An empty table has no folder of any kind."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind={kind}")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/kind={kind}")


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int | None = 2,
    drops_space: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode ``docs`` and write blocks in ascending order of ids, and their index, to ``path``.

    ``drops_space`` says that the tokenizer drops white space between words. ``end_id`` is appended to each document.
    Null texts are empty. Null ids come first. Rows that repeat an id, or null, follow each other in the order of the input.
    An empty table writes no block.
    """
    encode = encode_words if drops_space else encode_whole
    keyed = docs.select(
        docs[id_col].cast("long").alias("key"), docs[text_col].alias("text"), F.monotonically_increasing_id().alias("row")
    )
    dealt = keyed.repartitionByRange("key", "row").sortWithinPartitions("key", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = encoder(tokenizer, ENDED_WORDS if drops_space else None).width
        end = b"" if end_id is None else np.array([end_id], width).tobytes()
        writer = None
        for step in arrow.steps(batches, most_rows=STEP_ROWS, most_bytes=STEP_BYTES):
            writer = writer or _Writer(step.column("part")[0].as_py(), width)
            ids = encode(arrow.texts(step), tokenizer)
            for key, found in zip(step.column("key").to_pylist(), ids, strict=True):
                yield from writer.add(key, found + end)
        if writer:
            yield from writer.end()

    parts = dealt.select("key", "text", F.spark_partition_id().alias("part"))
    written = parts.mapInArrow(run, WRITTEN).write.option("parquet.page.row.count.limit", PAGE_ROWS)
    written.partitionBy("kind", "folder").parquet(path)
    _write_index(docs.sparkSession, path)
    _remove(docs.sparkSession, f"{path}/kind=keys")


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    """One row for each range of the writer: where it starts, and how many documents of the ranges before have the id of its
    first one. There are as many rows as tasks that wrote."""
    parts = _kind(spark, path, "parts", PARTS)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = parts.select("part", F.col("first_key").alias("key"), F.col("first_run").alias("run"), F.lit(True).alias("first"))
    two = ~F.col("first_key").eqNullSafe(F.col("last_key"))
    ends = ends.unionByName(parts.filter(two).select("part", F.col("last_key").alias("key"), F.col("last_run").alias("run"), F.lit(False).alias("first")))
    same = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carry", F.coalesce(F.sum("run").over(same), F.lit(0))).filter("first").select("part", "carry")
    starts = parts.withColumn("part_start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return starts.join(carried, "part").select("part", "part_start", "first_key", "carry")


def _n_buckets(spark: SparkSession, path: str) -> int:
    n = _kind(spark, path, "parts", PARTS).agg(F.sum("n_docs")).first()[0]
    return max(1, -(-(n or 0) // BUCKET_KEYS))


def _bucket(n_buckets: int):
    return F.pmod(F.xxhash64("doc_id", "nth"), F.lit(n_buckets))


def _write_index(spark: SparkSession, path: str) -> None:
    n_buckets = _n_buckets(spark, path)
    zipped = F.posexplode(F.arrays_zip("keys", "repeats", "offsets", "sizes")).alias("place", "x")
    docs = _kind(spark, path, "keys", KEYS).select("part", "block", zipped)
    docs = docs.join(F.broadcast(_ranges(spark, path)), "part")
    carry = F.when(F.col("x.keys").eqNullSafe(F.col("first_key")), F.col("carry")).otherwise(F.lit(0))
    docs = docs.select(
        F.col("x.keys").alias("doc_id"),
        (F.col("x.repeats") + carry).alias("nth"),
        "part",
        "block",
        "place",
        F.col("x.offsets").alias("offset"),
        F.col("x.sizes").alias("size"),
    )
    several = docs.filter("nth > 0").groupBy("doc_id").agg((F.max("nth") + 1).alias("all"))
    several = stage_table(several.select(F.col("doc_id").alias("k"), "all", F.lit(0).cast("long").alias("z")), "ids-repeated")
    if several.limit(1).count():
        met = docs["doc_id"].eqNullSafe(several["k"]) & (docs["nth"] == several["z"])
        docs = docs.join(several, met, "left").withColumn("same", F.coalesce("all", F.lit(1)).cast("long"))
    else:
        docs = docs.withColumn("same", F.lit(1).cast("long"))
    docs = docs.select("doc_id", "nth", *PLACE, _bucket(n_buckets).alias("bucket"))

    def build(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        edges = [*np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist(), len(order)]
        ids, nth = table.column("doc_id"), table.column("nth").to_numpy()
        known = ids.is_valid().to_numpy(zero_copy_only=False) if isinstance(ids, pa.Array) else ids.combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        ids = pc.fill_null(ids, 0).to_numpy()
        places = np.stack([table.column(c).to_numpy().astype("<i8") for c in PLACE], axis=1)
        rows = []
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            some, seed = order[a:z], 0
            while len(np.unique(hashes := key_hashes(ids[some], known[some], nth[some], seed))) < len(some):
                seed += 1
            made = PerfectHash.build(hashes)
            slots = np.empty((len(some), len(PLACE)), "<i8")
            slots[made.slots(hashes)] = places[some]
            number = int(bucket[some[0]])
            packed = made.displacements.astype("<i4").tobytes(), made.fingerprints.astype("<u2").tobytes(), slots.tobytes()
            rows.append((number // FOLDER_BUCKETS, number, seed, *packed))
        columns = list(zip(*rows, strict=True))
        types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({n.split()[0]: pa.array(c, t) for n, c, t in zip(INDEX.split(", "), columns, types, strict=True)})

    built = docs.groupBy(F.expr(f"bucket div {GROUP_BUCKETS}").alias("group")).applyInArrow(arrow.giving_back(lambda key, t: build(t)), INDEX)
    out = built.repartition("folder").sortWithinPartitions("folder", "bucket").write.option("parquet.page.row.count.limit", PAGE_ROWS)
    out.partitionBy("folder").parquet(f"{path}/index")


def _probe(index: dict, ids: np.ndarray, known: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the keys a bucket has, and what their slots say."""
    made = PerfectHash(np.frombuffer(index["displacements"], "<i4").astype(np.int64), np.frombuffer(index["fingerprints"], "<u2"))
    slot = made.find(key_hashes(ids, known, nth, index["seed"]))
    there = np.flatnonzero(slot >= 0)
    return there, np.frombuffer(index["places"], "<i8").reshape(-1, len(PLACE))[slot[there]]


def _index(spark: SparkSession, path: str, folders: list[int] | None) -> DataFrame:
    """The index, or those of its folders that a few keys need."""
    where = [f"{path}/index"] if folders is None else [f"{path}/index/folder={i}" for i in folders]
    return spark.read.option("basePath", f"{path}/index").schema(INDEX).parquet(*where)


def _find(spark: SparkSession, path: str, keys: DataFrame, n_buckets: int, index: DataFrame) -> DataFrame:
    """keys(doc_id, nth) to FOUND, those that the index knows."""

    def probe(key: tuple, wanted: pa.Table, index: pa.Table) -> pa.Table:
        out = {c.split()[0]: [] for c in FOUND.split(", ")}
        if index.num_rows and wanted.num_rows:
            bucket, rows = wanted.column("bucket").to_numpy(), {r["bucket"]: r for r in index.to_pylist()}
            ids = wanted.column("doc_id").combine_chunks()
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            plain, nth = pc.fill_null(ids, 0).to_numpy(), wanted.column("nth").to_numpy()
            order = np.argsort(bucket, kind="stable")
            edges = [*np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist(), len(order)]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                some = order[a:z]
                if (row := rows.get(int(bucket[some[0]]))) is not None:
                    there, places = _probe(row, plain[some], known[some], nth[some])
                    out["doc_id"].append(ids.take(pa.array(some[there])))
                    out["nth"].append(pa.array(nth[some[there]], pa.int64()))
                    for i, c in enumerate(PLACE):
                        out[c].append(pa.array(places[:, i]).cast(pa.int64() if c == "same" else pa.int32()))
        types = {c.split()[0]: pa.int64() if c.split()[1] == "long" else pa.int32() for c in FOUND.split(", ")}
        return pa.table({c: pa.chunked_array(v, types[c]) for c, v in out.items()})

    group = F.expr(f"bucket div {GROUP_BUCKETS}").alias("group")
    wanted = keys.select(F.col("doc_id").cast("long"), F.col("nth").cast("long")).withColumn("bucket", _bucket(n_buckets))
    return wanted.groupBy(group).cogroup(index.drop("folder").groupBy(group)).applyInArrow(arrow.giving_back(probe), FOUND)


def find_keys(spark: SparkSession, path: str, keys: DataFrame, few: bool = False) -> DataFrame:
    """keys(doc_id) to FOUND: where all documents with those ids are, by the index. Each distinct key is looked up once, and
    those that repeat it by the number that its slot says. With ``few`` the keys are at most some thousands; only the
    folders and pages of the index that they fall in are read."""
    n_buckets = _n_buckets(spark, path)
    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("nth", F.lit(0).cast("long"))

    def looked_up(wanted: DataFrame) -> DataFrame:
        index = _index(spark, path, None)
        if few:
            buckets = [r[0] for r in wanted.select(_bucket(n_buckets)).distinct().collect()]
            index = _index(spark, path, sorted({b // FOLDER_BUCKETS for b in buckets})).filter(F.col("bucket").isin(buckets))
        return _find(spark, path, wanted, n_buckets, index)

    if not _kind(spark, path, "parts", PARTS).limit(1).count() or (few and not wanted.limit(1).count()):
        return spark.createDataFrame([], FOUND)
    found = stage_table(looked_up(wanted), "ids-found")
    again = found.filter("same > 1").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("same") - 1)).alias("nth"))
    if not again.limit(1).count():
        return found
    return found.unionByName(looked_up(again))


def read_ids(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """One row for each document that bears one of the ids in keys(doc_id): doc_id, start (ids of all documents before),
    n_tokens, ids_crc32 (of the ids as unsigned 32-bit integers). The index says where each is; the blocks are read once
    where they lie, and only lengths and checksums leave them. Null and repeated ids are found like any other."""
    found = find_keys(spark, path, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(sizes)
                ids = np.frombuffer(row["payload"], "<u2" if row["id_bytes"] == 2 else "<u4").astype("<u4").tobytes()
                cut = zip((4 * (ends - sizes)).tolist(), (4 * ends).tolist(), strict=True)
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * n, pa.int32()),
                        pa.array([row["block"]] * n, pa.int32()),
                        pa.array(np.arange(n), pa.int32()),
                        pa.array(row["start"] + ends - sizes, pa.int64()),
                        pa.array([zlib.crc32(ids[a:z]) for a, z in cut], pa.int64()),
                    ],
                    names=["part", "block", "place", "start", "ids_crc32"],
                )

    blocks = _kind(spark, path, "ids", BLOCKS).join(F.broadcast(_ranges(spark, path).select("part", "part_start")), "part")
    blocks = blocks.select("part", "block", "id_bytes", "lengths", "payload", (F.col("part_start") + F.col("ids_before")).alias("start"))
    told = blocks.mapInArrow(run, "part int, block int, place int, start long, ids_crc32 long")
    return found.join(told, ["part", "block", "place"]).select("doc_id", "start", F.col("size").cast("long").alias("n_tokens"), "ids_crc32")


def look_up(spark: SparkSession, path: str, keys: list[int | None]) -> DataFrame:
    """doc_id and ids of the documents that bear one of a few given ids. Read are the index rows and the blocks that the keys
    lead to, and of a block the byte range that the slot names."""
    places = find_keys(spark, path, spark.createDataFrame([(k,) for k in keys], "doc_id long"), few=True).collect()
    wanted: dict[tuple[int, int], list] = {}
    for r in places:
        wanted.setdefault((r["part"], r["block"]), []).append((r["doc_id"], r["offset"], r["size"]))
    near = F.lit(False)
    for part, block in wanted:
        near = near | ((F.col("folder") == part // FOLDER_PARTS) & (F.col("part") == part) & (F.col("block") == block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["payload"], "<u2" if row["id_bytes"] == 2 else "<u4")
                for key, at, n in wanted[row["part"], row["block"]]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key], pa.int64()), pa.array([ids[at : at + n].astype(np.int32)])], names=["doc_id", "ids"]
                    )

    blocks = _kind(spark, path, "ids", BLOCKS).filter(near).select("part", "block", "id_bytes", "payload")
    return blocks.mapInArrow(run, "doc_id long, ids array<int>")


__all__ = ["PerfectHash", "find_keys", "look_up", "read_ids", "write_ids"]
