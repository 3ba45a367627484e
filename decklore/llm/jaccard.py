"""N-gram Jaccard join: a MinHash LSH forest, followed by exact verification.

Documents with the same set of shingles are one class with one representative. A representative's signature is TREES paths
of DEPTH MinHashes, each a leaf in one of as many prefix tries; a node of a trie is a prefix, LEAST levels long at least.

Each document shortens its own prefixes, from whole paths on: level by level in all tries whose next node isn't crowded, and
only if that isn't enough in crowded ones too, until the bound on its recall, one less the product over the tries of
1 - threshold^length, reaches the target. A document meets all that share its prefix in some trie, however long theirs are,
so a link is lost only if both ends lose it. Documents with passages that many have so look for each other elsewhere.

Each pair is verified in the first trie in which it meets, on the sets of shingles themselves. Nodes of a trie are worked
on as a whole; large ones in blocks, at most MOST_BLOCKS of a node, and every two blocks meet. What leaves a task is, for
each document, its number of links and the root of its tree of links there, so groups of near copies never turn into rows
of pairs. Roots grow together to connected components by alternating star contractions.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decklore.llm import arrow
from decklore.llm.common import forget, numbered, skew_join, stage_table
from decklore.llm.substring import BASES, rabin_karp, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: Tries, levels of a path, bits of a level; the shortest prefix.
TREES, DEPTH, LEVEL_BITS, LEAST = 24, 8, 8, 4
TARGET_RECALL = 0.9999
#: Members from which on a node is crowded; rows of a block; blocks of a node.
CROWD, BLOCK, MOST_BLOCKS = 512, 512, 64
#: Bytes of a group, of a row's paths; the least number of groups.
GROUP_BYTES, ROW_BYTES, LEAST_GROUPS = 8 << 20, 512, 64
SIGNATURE = "row long, doc_id long, shingles binary, n_shingles int, n_bytes int, paths array<long>"
NODE = ["tree", "len", "key"]


def prefix_lengths(crowded: np.ndarray, threshold: float, target: float) -> np.ndarray:
    """crowded: documents x tries, the longest length at which the document's node is crowded (0: never). The lengths that
    the documents end with."""
    miss = np.log1p(-(threshold ** np.arange(DEPTH + 1, dtype=float)[1:]))  # of a trie, by length from 1 on
    bound = math.log1p(-target)
    if crowded.shape[1] * miss[LEAST - 1] > bound:
        raise ValueError("no prefix reaches the target recall; take more tries")
    length = np.full(crowded.shape, DEPTH, np.int8)

    def open_() -> np.ndarray:
        return miss[length - 1].sum(axis=1) > bound

    for even_crowded in (False, True):
        for k in range(DEPTH - 1, LEAST - 1, -1):
            more = open_()
            if not more.any():
                return length
            down = more[:, None] & (length > k) & (even_crowded | (crowded < k))
            length[down] = k
    return length


def _mix32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def shingle_hashes(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts and their number in each; fewer words than ``size`` are one shingle."""
    flat, counts = arrow.words(column)
    words = word_hashes(flat)
    of, at = arrow.positions(counts)
    start = np.flatnonzero(at <= counts[of] - size) if len(of) else np.empty(0, np.int64)
    full, owner = rabin_karp(words, size, BASES[0])[start], of[start] if len(of) else start
    short = np.flatnonzero((counts > 0) & (counts < size))
    first = np.cumsum(counts) - counts
    extra = [
        xxhash.xxh3_64_intdigest(words[first[i] : first[i] + counts[i]].tobytes(), seed=int(counts[i])) for i in short
    ]
    hashes = np.concatenate([full, np.array(extra, np.uint64)])
    owner = np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    return hashes[order], np.bincount(owner, minlength=len(column)).astype(np.int64)


def signatures(batch: pa.RecordBatch, size: int, trees: int) -> pa.RecordBatch:
    """SIGNATURE: a path has LEVEL_BITS of each MinHash, the first level in the highest bits."""
    column = arrow.texts(batch)
    hashes, counts = shingle_hashes(column, size)
    n = len(column)
    ends = np.cumsum(counts)
    there = np.flatnonzero(counts)
    paths = np.zeros((len(there), trees), np.uint64)
    if len(there):
        small = _mix32((hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32))
        starts = (ends - counts)[there]
        for i in range(trees):
            for j in range(DEPTH):
                seed = np.uint32((0x9E3779B9 * (i * 64 + j + 1)) & 0xFFFFFFFF)
                least = np.minimum.reduceat((small ^ seed) * np.uint32(2 * (i * 64 + j) + 0x85EBCA6B), starts)
                label = _mix32(least) & np.uint32((1 << LEVEL_BITS) - 1)
                paths[:, i] = (paths[:, i] << np.uint64(LEVEL_BITS)) | label.astype(np.uint64)
    new = np.ones(len(hashes), bool)
    owner = np.repeat(np.arange(n), counts)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    distinct = hashes[new]
    per = np.bincount(owner[new], minlength=n)
    upto = np.cumsum(per)
    digest = [
        xxhash.xxh3_128_digest(distinct[z - k : z].tobytes()) if k else b"" for z, k in zip(upto.tolist(), per.tolist(), strict=True)
    ]
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(counts > 0, trees, 0))]).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            batch.column("row"),
            batch.column("doc_id"),
            pa.array(digest, pa.binary()),
            pa.array(per, pa.int32()),
            pa.array(pc.binary_length(column)).cast(pa.int32()),
            pa.ListArray.from_arrays(offsets, pa.array(paths.reshape(-1).view(np.int64))),
        ],
        names=["row", "doc_id", "shingles", "n_shingles", "n_bytes", "paths"],
    )


class Paths:
    """The paths and lengths of the rows of a table, as matrices of rows x tries."""

    def __init__(self, table: pa.Table) -> None:
        self.path, self.len = self._matrix(table, "paths").view(np.uint64), self._matrix(table, "lens")

    @staticmethod
    def _matrix(table: pa.Table, name: str) -> np.ndarray:
        lists = table.column(name).combine_chunks()
        return lists.flatten().to_numpy().reshape(len(lists), -1)

    def meet(self, tree: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """left x right: do the paths share the shorter of the two prefixes?"""
        shortest = self.path >> np.uint64((DEPTH - LEAST) * LEVEL_BITS)
        met = shortest[left, tree][:, None] == shortest[right, tree][None, :]
        if met.any():
            i, j = np.nonzero(met)
            a, b = left[i], right[j]
            length = np.minimum(self.len[a, tree], self.len[b, tree]).astype(np.uint64)
            differ = self.path[a, tree] ^ self.path[b, tree]
            met[i, j] = differ >> ((np.uint64(DEPTH) - length) * np.uint64(LEVEL_BITS)) == 0
        return met

    def first_meetings(self, tree: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """left x right: do the documents meet in ``tree``, and in none before?"""
        new = self.meet(tree, left, right)
        for t in range(tree):
            if not new.any():
                break
            new &= ~self.meet(t, left, right)
        return new


def _units(table: pa.Table):
    """The units of a group: (tree, length, places of rows in one block, places in the other or None for the same)."""
    cols = [table.column(c).to_numpy() for c in (*NODE, "first", "second", "block")]
    order = np.lexsort(cols[::-1])
    if not len(order):
        return
    same = np.ones(len(order), bool)
    same[0] = False
    for c in cols[:5]:
        same[1:] &= c[order][1:] == c[order][:-1]
    edges = [*np.flatnonzero(~same).tolist(), len(order)]
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        rows = order[a:z]
        at = rows[0]
        first, second, block = cols[3][at], cols[4][at], cols[5][rows]
        which = int(cols[0][at]), int(cols[1][at])
        yield (*which, rows, None) if first == second else (*which, rows[block == first], rows[block == second])


def _pairs(unit, paths: Paths, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The candidates of a unit as a matrix over its two blocks: pairs whose shorter prefix is this node's, that meet in no
    trie before, each once, and none whose sizes rule it out."""
    tree, length, left, right = unit
    other = left if right is None else right
    here = (paths.len[left, tree] == length)[:, None] | (paths.len[other, tree] == length)[None, :]
    if right is None:
        here &= np.tri(len(left), len(left), -1, dtype=bool)
    small, large = np.minimum(sizes[left][:, None], sizes[other]), np.maximum(sizes[left][:, None], sizes[other])
    here &= small >= threshold * large - 1e-9
    if here.any():
        here &= paths.first_meetings(tree, left, other)
    return left, other, here


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of codes in ``left`` with all in ``right``."""
    all_codes = np.concatenate([*left, *right])
    _, codes = np.unique(all_codes, return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    is_left = row < len(left)
    n = codes.max() + 1 if len(codes) else 0
    both = (np.bincount(codes[is_left], minlength=n) > 0) & (np.bincount(codes[~is_left], minlength=n) > 0)
    column = np.cumsum(both) - 1
    keep = both[codes]
    row, at = row[keep], column[codes[keep]]
    total, step = np.zeros((len(left), len(right)), np.int64), 4096
    for a in range(0, int(both.sum()), step):
        some = (at >= a) & (at < a + step)
        dense = np.zeros((len(left) + len(right), step), np.float32)
        dense[row[some], at[some] - a] = 1
        total += np.rint(dense[: len(left)] @ dense[len(left) :].T).astype(np.int64)
    return total


def _sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """For each text the distinct codes of its shingles; equal codes for equal runs of words, and for those alone."""
    flat, counts = arrow.words(texts)
    # A run of fewer words than a shingle is filled up with a word that no text has.
    filled = np.where((counts > 0) & (counts < size), size, counts)
    codes = np.full(int(filled.sum()), -1, np.int64)
    of, at = arrow.positions(filled)
    codes[at < counts[of]] = arrow.codes(flat)
    start, code = arrow.window_codes(codes + 1, filled, size)
    owner = of[start]
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    owner, code = owner[new], code[new]
    return np.split(code, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1])


def _needed(table: pa.Table, threshold: float) -> pa.Table:
    """The rows of units with a candidate there."""
    paths, sizes = Paths(table), table.column("n_shingles").to_numpy().astype(np.int64)
    found = []
    for unit in _units(table):
        left, right, new = _pairs(unit, paths, sizes, threshold)
        found += [left[new.any(axis=1)], right[new.any(axis=0)]]
    rows = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return table.take(pa.array(rows, pa.int64())).select(["row", *NODE, "first", "second", "block"])


def _verify(table: pa.Table, threshold: float, size: int) -> pa.Table:
    """For each row with a link in its unit: row, links (documents, not representatives), root."""
    paths = Paths(table)
    ids, weights = table.column("row").to_numpy(), table.column("n").to_numpy()
    # A document may be in several units; its set is made once.
    distinct, first, place = np.unique(ids, return_index=True, return_inverse=True)
    texts = pc.fill_null(table.column("text").combine_chunks().take(pa.array(first)), "")
    sets = _sets(texts, size)
    sizes = np.array([len(s) for s in sets], np.int64)[place]
    out: list[tuple[int, int, int]] = []
    for unit in _units(table):
        left, right, new = _pairs(unit, paths, sizes, threshold)
        if not new.any():
            continue
        shared = _shared([sets[place[i]] for i in left], [sets[place[i]] for i in right])
        union = sizes[left][:, None] + sizes[right][None, :] - shared
        links = new & (shared >= threshold * union - 1e-9)
        a, b = np.nonzero(links)
        count: dict[int, int] = {}
        root: dict[int, int] = {}

        def top(x: int, root: dict[int, int] = root) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(left[a].tolist(), right[b].tolist(), strict=True):
            i, j = int(ids[x]), int(ids[y])
            count[i] = count.get(i, 0) + int(weights[y])
            count[j] = count.get(j, 0) + int(weights[x])
            i, j = sorted((top(i), top(j)))
            root[j] = i
        out += [(i, n, top(i)) for i, n in count.items()]
    columns = list(zip(*out, strict=True)) or [[], [], []]
    return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(("row", "links", "root"), columns, strict=True)})


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v), u > v, to (u, v) with v the smallest node of u's component, for all nodes but those smallest ones.

    Large star: a node's larger neighbours get its smallest neighbour. Small star: its smaller ones and itself do. The
    smallest neighbour comes from an aggregation and goes back by a skew-safe join, so no node's neighbours meet.
    """

    used: list[DataFrame] = []

    def least(pairs: DataFrame) -> DataFrame:
        pairs = stage_table(pairs, "star-pairs")
        low = stage_table(
            pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "star-least"
        )
        used.extend((pairs, low))
        return skew_join(pairs, low, ["u"], "n").withColumn("m", F.least("u", "m"))

    edges = stage_table(edges.distinct(), "star-edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = least(large)
        small = near.select("u", F.col("m").alias("v")).unionByName(
            near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        old, edges = edges, stage_table(small.distinct(), "star-edges")
        forget(old, *used)
        used.clear()
        after = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            return edges
        before = after


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, n_links, n_copies. The options are those of ``_classes``.

    Two documents are linked if the Jaccard similarity of their sets of shingles is at least ``threshold``. n_links is
    the number of documents linked to this one, n_copies that of documents with its set, itself included (they are among
    its links). class_id is the smallest id in the connected component. A text of fewer words than a shingle is one
    shingle; a text without words (null, empty) has no links and is its own class. Rows that repeat an id are documents
    of their own, each with its own text. Rows with a null id are left as classes of their own with a null class_id; with
    ``null_ids`` they are documents like any other, and class_id is null where all ids of a class are. An empty table
    gives an empty result.
    """
    columns = docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")
    slim = stage_table(docs.select(F.monotonically_increasing_id().alias("row"), *columns), "jaccard-texts")
    return _classes(slim, **options).select("doc_id", "class_id", "n_links", "n_copies")


def _node(length) -> list:
    """tree, len and key of the node of a path at a length."""
    shift = F.lit(LEVEL_BITS) * (F.lit(DEPTH) - length)
    return [F.col("tree"), length.cast("int").alias("len"), F.call_function("shiftrightunsigned", F.col("path"), shift.cast("int")).alias("key")]


def forest(reps: DataFrame, threshold: float, target: float, crowd: int, trees: int) -> tuple[DataFrame, DataFrame]:
    """The nodes in which documents meet, as staged (row, tree, len, key, members), and (row, lens), the lengths of the
    prefixes, of those documents whose lengths aren't the usual ones.

    A document is in the node of its own prefix, and in those above it that are another document's own. Those alone in a trie
    at the shortest length drop out of it before any longer prefix is looked at.
    """
    paths = reps.select("row", F.posexplode("paths").alias("tree", "path"))
    shortest = F.call_function("shiftrightunsigned", F.col("path"), F.lit((DEPTH - LEAST) * LEVEL_BITS))
    paths = paths.withColumn("top", shortest)
    several = stage_table(
        paths.groupBy("tree", "top").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "jaccard-shortest"
    )
    near = skew_join(paths, several, ["tree", "top"], "members", width=48).drop("top")
    near = stage_table(near, "jaccard-near")
    level = F.explode(F.sequence(F.lit(LEAST), F.lit(DEPTH))).alias("at")
    levels = near.filter(F.col("members") > crowd).select("row", "tree", "path", level).select("row", *_node(F.col("at")))
    crowded = levels.groupBy(*NODE).agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > crowd)
    crowded = stage_table(crowded, "jaccard-crowded")
    deepest = skew_join(levels, crowded, NODE, "members").groupBy("row", "tree").agg(F.max("len").alias("len"))
    deepest = deepest.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("tree", "len"))).alias("crowded"))

    def lengths(batches):
        for batch in batches:
            seen = np.zeros((batch.num_rows, trees), np.int8)
            for i, known in enumerate(batch.column("crowded").to_pylist()):
                for tree, length in known or ():
                    seen[i, tree] = length
            lens = prefix_lengths(seen, threshold, target)
            offsets = pa.array(np.arange(0, lens.size + 1, trees, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.ListArray.from_arrays(offsets, pa.array(lens.reshape(-1)))], names=["row", "lens"]
            )

    own = stage_table(deepest.mapInArrow(lengths, "row long, lens array<tinyint>"), "jaccard-lengths")
    placed = near.join(own, "row", "left").withColumn("own", F.get(F.coalesce("lens", usual(threshold, target, trees)), F.col("tree")).cast("int"))
    placed = placed.select("row", "tree", "path", "own", F.explode(F.sequence(F.lit(LEAST), F.col("own"))).alias("at"))
    placed = placed.select("row", (F.col("at") == F.col("own")).alias("asks"), *_node(F.col("at")))
    nodes = placed.groupBy(*NODE).agg(F.count(F.lit(1)).alias("members"), F.count_if("asks").alias("askers"))
    nodes = stage_table(nodes.filter("members > 1 and askers > 0").drop("askers"), "jaccard-nodes")
    met = stage_table(skew_join(placed.drop("asks"), nodes, NODE, "members", width=56), "jaccard-met")
    forget(several, near, crowded, nodes)
    return met, own


def usual(threshold: float, target: float, trees: int):
    """The lengths of a document in no crowded node."""
    return F.array(*[F.lit(int(k)).cast("tinyint") for k in prefix_lengths(np.zeros((1, trees)), threshold, target)[0]])


def unit_rows(met: DataFrame, block: int) -> DataFrame:
    """Members of nodes, dealt into blocks of about ``block``, larger where there would be too many, once for each block that
    theirs meets."""
    blocks = F.least(F.ceil(F.col("members") / block), F.lit(MOST_BLOCKS)).cast("int")
    dealt = met.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("row", *NODE, F.least("block", "with").alias("first"), F.greatest("block", "with").alias("second"), "block")


def _classes(
    slim: DataFrame,
    threshold: float = THRESHOLD,
    shingle: int = SHINGLE,
    trees: int = TREES,
    target_recall: float = TARGET_RECALL,
    block: int = BLOCK,
    crowd: int = CROWD,
    null_ids: bool = False,
) -> DataFrame:
    """What ``jaccard_classes`` says of staged (row, doc_id, text), with each row's number, and that of the row that stays
    of its class: the one of the smallest id, then of the smallest number. Rows are told apart by number alone."""
    prefix_lengths(np.zeros((1, trees)), threshold, target_recall)  # can the target be met?
    searched = F.col("n_shingles") > 0
    if not null_ids:
        searched = searched & F.col("doc_id").isNotNull()

    def sign(batches):
        for step in arrow.steps(batches):
            yield signatures(step, shingle, trees)

    signed = stage_table(slim.mapInArrow(sign, SIGNATURE), "jaccard-signatures")
    known = signed.filter(searched)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    sets = stage_table(
        known.groupBy("shingles").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")), "jaccard-sets"
    )
    reps = known.join(sets.select(F.col("first.row").alias("row"), "n"), "row")
    reps = stage_table(reps.select("row", "n", "n_shingles", "n_bytes", "paths"), "jaccard-representatives")
    met, own = forest(reps, threshold, target_recall, crowd, trees)
    lens = F.coalesce("lens", usual(threshold, target_recall, trees)).alias("lens")
    some = met.select("row").distinct().join(own, "row", "left").select("row", lens)
    some = stage_table(reps.join(some, "row"), "jaccard-candidates")
    units = unit_rows(met, block)
    size = units.count()
    groups = max(LEAST_GROUPS, math.ceil(size * ROW_BYTES / GROUP_BYTES))
    where = lambda n: F.pmod(F.xxhash64(*NODE, "first", "second"), F.lit(n)).cast("int").alias("pid")
    slim_rows = units.join(some.select("row", "n_shingles", "paths", "lens"), "row").withColumn("pid", where(groups))
    unit = "tree int, len int, key long, first int, second int, block int"
    needed = slim_rows.groupBy("pid").applyInArrow(
        arrow.giving_back(lambda key, t: _needed(t, threshold)), f"row long, {unit}"
    )
    needed = stage_table(needed.distinct(), "jaccard-needed")
    # Groups are as many as the text asks for, each row's as often as it is repeated.
    size = needed.join(some.select("row", "n_bytes"), "row").agg(F.coalesce(F.sum(F.col("n_bytes") + ROW_BYTES), F.lit(0)).alias("s")).first()["s"]
    groups = max(LEAST_GROUPS, math.ceil(size / GROUP_BYTES))
    columns = [*NODE, "first", "second", "block"]
    wanted = needed.groupBy("row").agg(F.collect_list(F.struct(*columns)).alias("units"))
    full = slim.select("row", "text").join(wanted.hint("shuffle_hash"), "row").join(some.select("row", "n", "paths", "lens"), "row")
    full = full.select("row", "n", "paths", "lens", "text", F.explode("units").alias("u"))
    full = full.select("row", "n", "paths", "lens", "text", "u.*")
    verified = full.withColumn("pid", where(groups)).groupBy("pid").applyInArrow(
        arrow.giving_back(lambda key, t: _verify(t, threshold, shingle)), "row long, links long, root long"
    )
    verified = stage_table(verified, "jaccard-links")
    forget(reps, met, own, some, needed)
    links = verified.groupBy("row").agg(F.sum("links").alias("links"))
    grown = components(verified.filter("root < row").select(F.col("row").alias("u"), F.col("root").alias("v")))
    of_set = (
        sets.withColumn("row", F.col("first.row"))
        .join(links, "row", "left")
        .join(grown.select(F.col("u").alias("row"), F.col("v").alias("top")), "row", "left")
        .select("shingles", "n", "first", F.coalesce("top", "row").alias("top"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    of_set = stage_table(of_set, "jaccard-linked-sets")
    heads = stage_table(
        of_set.groupBy("top").agg(F.min("first").alias("head"), F.count(F.lit(1)).alias("n_sets")), "jaccard-heads"
    )
    of_set = skew_join(of_set, heads, ["top"], "n_sets").select(
        "shingles", "n", "links", F.col("head.doc_id").alias("class_id"), F.col("head.row").alias("stays")
    )
    of_set = stage_table(of_set, "jaccard-classes")
    forget(verified, grown, sets)
    out = skew_join(known.select("row", "doc_id", "shingles"), of_set, ["shingles"], "n").select(
        "row",
        "doc_id",
        "class_id",
        (F.col("links") + F.col("n") - 1).alias("n_links"),
        F.col("n").alias("n_copies"),
        "stays",
    )
    alone = signed.filter(~searched).select(
        "row",
        "doc_id",
        F.col("doc_id").alias("class_id"),
        F.lit(0).cast("long").alias("n_links"),
        F.lit(1).cast("long").alias("n_copies"),
        F.col("row").alias("stays"),
    )
    return out.unionByName(alone)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest id; the columns stay as they are. Rows are removed by their
    own number, so rows that share an id go or stay each by its text. Rows with a null id stay; with ``null_ids`` they are
    searched too, and any id goes before a null one."""
    rows = numbered(docs)
    doc = F.col("doc")
    slim = rows.select("row", doc.getField(id_col).cast("long").alias("doc_id"), doc.getField(text_col).alias("text"))
    gone = _classes(slim, **options).filter("row <> stays").select("row")
    return rows.join(gone, "row", "left_anti").select("doc.*")
