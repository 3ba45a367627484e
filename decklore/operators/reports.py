"""Reports as text and JSON, made of aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decklore.operators.scripts import LETTER_NAMES


def markdown_table(rows: DataFrame, columns: list[str], order: list[Column | str]) -> DataFrame:
    """One row: the rows as a Markdown table, in order. For reports of a bounded number of rows."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    told = rows.select(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], line.alias("line")).alias("x"))
    body = told.agg(F.sort_array(F.collect_list("x")).alias("xs")).select(F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("b"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    return body.select(F.concat(F.lit(head), "b").alias("markdown"))


def script_report(sentences: DataFrame, flags: DataFrame) -> DataFrame:
    """sentences(doc_id, page_no, kind, ref, syllables), flags(doc_id, page_no, code, level): one row for each document."""
    told = F.col("kind") == "content"
    sums = sentences.groupBy("doc_id").agg(
        F.countDistinct("page_no").alias("n_pages"),
        F.count(F.lit(1)).alias("n_sentences"),
        F.round(F.coalesce(F.try_divide(F.count_if(told & F.col("ref").isNull()), F.count_if(told)), F.lit(0.0)), 4).alias("ungrounded"),
        F.round(F.coalesce(F.try_divide(F.sum(F.when(~told, F.col("syllables")).otherwise(0)), F.sum("syllables")), F.lit(0.0)), 4).alias("delivery_share"),
        F.round(F.sum("syllables") / 200.0 * 60, 1).alias("seconds"),
    )
    red = flags.filter("level = 'red'").groupBy("doc_id").agg(F.sort_array(F.collect_set("page_no")).alias("red_pages"))
    return sums.join(red, "doc_id", "left")


def document_report(blocks: DataFrame) -> DataFrame:
    """Blocks, links, images (described ones apart) and tables of each document."""
    told = F.coalesce(F.trim("content"), F.lit("")) != ""
    return blocks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.count_if(F.col("kind") == "table").alias("n_tables"),
        F.count_if(F.col("kind") == "image").alias("n_images"),
        F.count_if((F.col("kind") == "image") & told).alias("n_described"),
        F.sum(F.coalesce(F.size("urls"), F.lit(0))).alias("n_links"),
    )


def _spelled(term: Column) -> Column:
    """An abbreviation by the names of its letters and digits."""
    names = F.create_map(*[F.lit(x) for pair in LETTER_NAMES.items() for x in pair])
    return F.array_join(F.transform(F.split(F.lower(term), ""), lambda c: F.coalesce(F.try_element_at(names, c), c)), " ")


def merged_terms(store: DataFrame, found: DataFrame) -> DataFrame:
    """A store of terms (term, say, by) with the ones it lacks, guessed: human rows stay; sorted by the lower case."""
    new = found.join(store, "term", "left_anti").select("term", _spelled(F.col("term")).alias("say"), F.lit("auto").alias("by"))
    return store.select("term", "say", "by").unionByName(new).orderBy(F.lower("term"), "term")
