"""Structured documents: sections, links, flags, patches, tables, page types."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from decklore.functions.text import lines, page_span

# Page-type geometry, outline detection, image area.
TITLE_LOW, TITLE_LEFT, TITLE_RIGHT = 0.30, 0.35, 0.65
OUTLINE_PAGES, OUTLINE_ITEMS, OUTLINE_FOUND, OUTLINE_SHARE = 5, 3, 2, 0.60
SMALL_IMAGE = 0.05
#: Boxes of a page's part, and how many links and blocks a tile of areas has.
MEET, TILE = 8192, (64, 2048)
SEVERITY = {"error": 0, "warn": 1, "info": 2}


def section_spans(starts: DataFrame, last_page: Column) -> DataFrame:
    """starts(doc_id, title, start_page, ord): each section ends before the next, the last with the document."""
    following = F.lead("start_page").over(Window.partitionBy("doc_id").orderBy("ord"))
    return starts.withColumn("end_page", F.coalesce(following - 1, last_page))


def pages_in_sections(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """pages(doc_id, page_no) with the first section that holds them, or null. Both sides meet on the document."""
    s = sections.select(F.col("doc_id").alias("d"), "section_id", "start_page", "end_page", "ord")
    inside = (pages["doc_id"] == s["d"]) & pages["page_no"].between(s["start_page"], s["end_page"])
    best = Window.partitionBy("doc_id", "page_no").orderBy(F.asc_nulls_last("ord"))
    found = pages.join(s, inside, "left").withColumn("r", F.row_number().over(best))
    return found.filter("r = 1").select(*[pages[c] for c in pages.columns], "section_id")


def outline_sections(items: DataFrame, titles: DataFrame) -> DataFrame:
    """Sections from an outline page: items(doc_id, page_no, ord, item), titles(doc_id, page_no, title).

    A page of the first five is the outline if at least three items are there and 60 % of them, two at least, are the
    title of a later page or part of it, in order. The walk over a document's items is sequential: one fold each.
    """
    norm = lambda c: F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c), r"\s+([,.;:)!?])", "$1"), r"^\W*\d+\s*[.):\-]?\s+", ""), r"\s+", " ")))
    t = titles.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", norm("title").alias("t")))).alias("titles"), F.max("page_no").alias("last"))
    i = items.filter(F.col("page_no") <= OUTLINE_PAGES).filter(F.length(norm("item")) >= 3)
    i = i.groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(F.struct("ord", norm("item").alias("k"), "item"))).alias("items"))
    both = i.filter(F.size("items") >= OUTLINE_ITEMS).join(t, "doc_id")

    def walk(state: Column, it: Column) -> Column:
        hit = F.get(F.filter(F.col("titles"), lambda x: (x["page_no"] > state["after"]) & F.contains(x["t"], it["k"])), F.lit(0))["page_no"]
        kept = F.when(hit.isNotNull(), F.array_append(state["found"], F.struct(it["item"].alias("title"), hit.alias("page_no")))).otherwise(state["found"])
        return F.struct(F.coalesce(hit, state["after"]).alias("after"), kept.alias("found"))

    start = F.struct(F.col("page_no").alias("after"), F.array().cast("array<struct<title:string,page_no:int>>").alias("found"))
    told = both.withColumn("found", F.aggregate("items", start, walk)["found"]).withColumn("share", F.size("found") / F.size("items"))
    good = told.filter((F.size("found") >= OUTLINE_FOUND) & (F.col("share") >= OUTLINE_SHARE))
    first = good.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no"))).filter("r = 1")
    flat = first.select("doc_id", "last", "share", F.posexplode("found").alias("ord", "f"))
    starts = flat.select("doc_id", "last", F.round("share", 2).alias("confidence"), "ord", F.col("f.title").alias("title"), F.col("f.page_no").alias("start_page"))
    return section_spans(starts, F.col("last")).withColumn("section_id", F.format_string("sec_%02d", F.col("ord"))).drop("last")


def runs(rows: DataFrame, part: list[str], order: str, key: str) -> DataFrame:
    """Runs of neighbours with an equal key: part, run, key, first, last, n. Equal keys apart stay apart."""
    w = Window.partitionBy(*part).orderBy(order)
    changed = (~F.col(key).eqNullSafe(F.lag(key).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    numbered = rows.withColumn("changed", changed).withColumn("run", F.sum("changed").over(w))
    return numbered.groupBy(*part, "run", key).agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")
    )


def deck_map(page_runs: DataFrame, names: Column) -> DataFrame:
    """One text for each document: a line for each run of pages."""
    line = F.concat(F.lit("- "), page_span(F.col("first"), F.col("last")), F.lit(": "), names)
    told = page_runs.withColumn("line", line).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first", "line"))).alias("all"))
    return told.select("doc_id", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("deck_map"))


def fill_down(cells: DataFrame) -> DataFrame:
    """cells(table_id, row_no, first_cell, rest_blank): an empty first cell takes the value above, if its row has other
    text; rows 0 and 1 (the header and what follows it) take nothing from above; a blank row ends the chain."""
    blank = (F.trim("first_cell") == "") & F.col("rest_blank")
    w = Window.partitionBy("table_id").orderBy("row_no")
    marked = cells.withColumn("chain", F.sum(blank.cast("int")).over(w))
    seen = F.when((F.trim("first_cell") != "") & (F.col("row_no") >= 1), F.col("first_cell"))
    above = F.last(seen, ignorenulls=True).over(Window.partitionBy("table_id", "chain").orderBy("row_no"))
    takes = (F.trim("first_cell") == "") & ~F.col("rest_blank") & (F.col("row_no") >= 2)
    return marked.withColumn("filled", F.when(takes, F.coalesce(above, "first_cell")).otherwise(F.col("first_cell"))).drop("chain")


def _dealt(boxes: DataFrame, id_col: str, other: DataFrame, part: str, with_part: str) -> DataFrame:
    """Boxes in parts of about MEET a page, each repeated for every part that ``other`` has of the page."""
    n = lambda df, c: df.groupBy("page_id").agg(F.ceil(F.count(F.lit(1)) / MEET).cast("int").alias(c))
    sized = boxes.join(n(boxes, "own"), "page_id").join(n(other, "met"), "page_id")
    dealt = sized.withColumn(part, F.pmod(F.xxhash64(id_col), F.col("own")).cast("int"))
    return dealt.withColumn(with_part, F.explode(F.sequence(F.lit(0), F.col("met") - 1))).drop("own", "met")


def link_blocks(links: DataFrame, blocks: DataFrame) -> DataFrame:
    """The block of a page with the largest area under each link; none if nothing overlaps. Boxes are l, t, r, b.

    All links of a page meet all its blocks, but in parts, a task each, which returns one block for each of its links: what is
    shuffled are the boxes, once for each part of the other side, and not the pairs."""
    kinds = {c: links.schema[c].dataType.simpleString() for c in ("page_id", "link_id")} | {c: blocks.schema[c].dataType.simpleString() for c in ("block_id", "block_ord")}
    sides = [F.col(c).cast("double").alias(c) for c in "ltrb"]
    l = _dealt(links.select("page_id", "link_id", *sides), "link_id", blocks, "lp", "bp")  # noqa: E741
    b = _dealt(blocks.select("page_id", "block_id", "block_ord", *sides), "block_id", links, "bp", "lp")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right, sort_keys=[("block_ord", "ascending")], null_placement="at_start"))
        box = lambda t: {c: t.column(c).to_numpy() for c in "ltrb"}
        a, o = box(left), box(right)
        area, at = np.zeros(len(left)), np.zeros(len(left), np.int64)
        rows, columns = np.arange(TILE[0]), len(right)
        for i in range(0, len(left), TILE[0]):
            mine = {c: v[i : i + TILE[0], None] for c, v in a.items()}
            some = slice(i, i + len(mine["l"]))
            for j in range(0, columns, TILE[1]):
                theirs = {c: v[None, j : j + TILE[1]] for c, v in o.items()}
                w = np.fmin(mine["r"], theirs["r"]) - np.fmax(mine["l"], theirs["l"])
                h = np.fmin(mine["b"], theirs["b"]) - np.fmax(mine["t"], theirs["t"])
                both = np.fmax(w, 0.0) * np.fmax(h, 0.0)
                best = both.argmax(axis=1)  # the first of equals, which is first in order
                most = both[rows[: len(best)], best]
                more = most > area[some]
                area[some] = np.where(more, most, area[some])
                at[some] = np.where(more, best + j, at[some])
        hit = pa.array(np.flatnonzero(area > 0))
        chosen = right.select(["block_id", "block_ord"]).take(pa.array(at).take(hit))
        return pa.table({**{c: left.column(c).take(hit) for c in ("page_id", "link_id")}, **{c: chosen.column(c) for c in chosen.column_names}, "area": pa.array(area).take(hit)})

    key = ["page_id", "lp", "bp"]
    met = l.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(meet, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", area double")
    best = F.min(F.struct(-F.col("area"), "block_ord", "block_id", "area")).alias("x")
    return met.groupBy("page_id", "link_id").agg(best).select("page_id", "link_id", "x.block_id", F.round("x.area", 6).alias("area"))


def slide_type(blocks: DataFrame) -> DataFrame:
    """blocks(page_id, kind, role, content, cx, cy): a page is a divider if a title, centred and not high up, is all it
    has beside undescribed images."""
    told = F.coalesce(F.trim("content"), F.lit("")) != ""
    text = told & (F.col("kind") != "image")
    centred = (F.col("cy") >= TITLE_LOW) & F.col("cx").between(TITLE_LEFT, TITLE_RIGHT)
    sums = blocks.groupBy("page_id").agg(
        F.count_if(text).alias("texts"),
        F.count_if(text & (F.col("kind") == "paragraph") & (F.col("role") == "title") & centred).alias("titles"),
        F.count_if(told & (F.col("kind") == "image")).alias("told_images"),
    )
    alone = (F.col("texts") == 1) & (F.col("titles") == 1) & (F.col("told_images") == 0)
    return sums.select("page_id", F.when(alone, "section_divider").otherwise("content").alias("slide_type"))


def flags(pages: DataFrame, blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """The five rules over pages(doc_id, page_no, layout_error), blocks(doc_id, page_no, id, kind, content, why_empty),
    sections(doc_id), by severity, then page."""
    row = lambda kind, level, page, block: [F.lit(kind).alias("kind"), F.lit(level).alias("severity"), page.alias("page_no"), block.alias("block_id")]
    none, page = F.lit(None).cast("string"), F.col("page_no")
    filled = blocks.filter(F.coalesce(F.trim("content"), F.lit("")) != "")
    empty = pages.join(filled, ["doc_id", "page_no"], "left_anti").select("doc_id", *row("empty_page", "warn", page, none))
    images = blocks.filter((F.col("kind") == "image") & (F.col("why_empty") == "not_described")).select("doc_id", *row("image_not_described", "warn", page, F.col("id")))
    tables = blocks.filter((F.col("kind") == "table") & (F.coalesce(F.trim("content"), F.lit("")) == "")).select("doc_id", *row("table_empty", "error", page, F.col("id")))
    failed = pages.filter("layout_error is not null").select("doc_id", *row("layout_failed", "error", page, none))
    bare = pages.select("doc_id").distinct().join(sections, "doc_id", "left_anti").select("doc_id", *row("no_sections", "info", F.lit(None).cast("int"), none))
    return empty.unionByName(images).unionByName(tables).unionByName(failed).unionByName(bare)


def flag_counts(flags: DataFrame) -> DataFrame:
    """flags to kind, n."""
    return flags.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def flag_order() -> list[Column]:
    level = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in SEVERITY.items()])
    return [level, F.coalesce("page_no", F.lit(0)), F.col("kind"), F.coalesce("block_id", F.lit(""))]


def patch(blocks: DataFrame, drops: DataFrame, adds: DataFrame, texts: DataFrame) -> DataFrame:
    """blocks(doc_id, id, content) without ``drops``(doc_id, id), with ``texts``(doc_id, id, text) over their contents,
    and ``adds`` appended."""
    kept = blocks.join(drops, ["doc_id", "id"], "left_anti").join(texts, ["doc_id", "id"], "left")
    return kept.withColumn("content", F.coalesce("text", "content")).drop("text").unionByName(adds)


def missing_ids(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """What a patch names that isn't there."""
    return asked.join(blocks, ["doc_id", "id"], "left_anti")


def without_empty_blocks(blocks: DataFrame, flagged: DataFrame) -> DataFrame:
    """Blocks with content, and those without that a flag names."""
    told = F.coalesce(F.trim("content"), F.lit("")) != ""
    named = flagged.filter("block_id is not null").select("doc_id", F.col("block_id").alias("id")).distinct().withColumn("named", F.lit(True))
    return blocks.join(named, ["doc_id", "id"], "left").filter(told | F.col("named")).drop("named")


def block_lines(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text) to one block for each line that isn't blank: doc_id, ord, line."""
    return docs.select("doc_id", F.posexplode(lines(F.coalesce("text", F.lit("")))).alias("ord", "line"))


def page_hashes(blocks: DataFrame) -> DataFrame:
    """blocks(doc_id, page_no, block_ord, kind, content, box) to a digest of each page's blocks, in order: equal pages, equal
    digests."""
    one = F.concat_ws("\x01", "kind", F.coalesce("content", F.lit("")), F.coalesce("box", F.lit("")))
    told = F.sort_array(F.collect_list(F.struct("block_ord", one.alias("x"))))
    all_text = F.array_join(F.transform(told, lambda r: r["x"]), "\x02")
    return blocks.groupBy("doc_id", "page_no").agg(F.substring(F.sha2(all_text.cast("binary"), 256), 1, 16).alias("page_hash"))


def patch_for(documents: DataFrame, patches: DataFrame) -> DataFrame:
    """The first patch file, by name, whose stem is part of the document's id. Patches are few files."""
    met = documents.join(patches, F.contains(F.col("doc_id"), F.lower("stem")))
    best = Window.partitionBy("doc_id").orderBy("stem")
    return met.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r")


def neighbours(pages: DataFrame) -> DataFrame:
    """Titles of the pages before and after, and whether a divider is the document's last page (then it closes it)."""
    w = Window.partitionBy("doc_id").orderBy("page_no")
    last = F.lead("page_no").over(w).isNull()
    return pages.withColumn("title_before", F.lag("title").over(w)).withColumn("title_after", F.lead("title").over(w)).withColumn(
        "closes", last & (F.col("slide_type") == "section_divider")
    )


def vlm_share(counts: Column) -> Column:
    """The share of a provenance map that a model wrote; 0 for an empty one."""
    total = F.aggregate(F.map_values(counts), F.lit(0), lambda s, x: s + x)
    return F.coalesce(F.try_divide(F.coalesce(F.try_element_at(counts, F.lit("vlm")), F.lit(0)), total), F.lit(0.0))


def image_chunks(blocks: DataFrame) -> DataFrame:
    """Described images of pages that have two or more of them; each is a chunk of its own beside its page's."""
    told = blocks.filter((F.col("kind") == "image") & (F.coalesce(F.trim("content"), F.lit("")) != ""))
    return told.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "page_no"))).filter("n >= 2").drop("n")
