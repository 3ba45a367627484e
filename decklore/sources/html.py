"""Blocks and links of HTML pages, by patterns that run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANCHOR = r"""<a href="([^"]*)"[^>]*>([^<]*)"""
TITLE = "<title>([^<]*)"
ITEM = "<li>([^<]*)"
PARAGRAPH = "<p>([^<]*)"
HEADING = "<h1[^>]*>([^<]*)"


def without_code(html: Column) -> Column:
    """Scripts and styles hold text that looks like tags."""
    return F.regexp_replace(html, r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, TITLE, 1))


def links(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) to page_id, ord, url, text of web links."""
    html = without_code(F.col("html"))
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("url"), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("text"))
    return pages.select("page_id", F.posexplode(both).alias("ord", "x")).select("page_id", "ord", "x.url", F.trim("x.text").alias("text"))


def blocks(pages: DataFrame) -> DataFrame:
    """page_id, kind, n, chars: how many blocks of a kind a page has, and their characters."""
    html = without_code(F.col("html"))
    kinds = {"heading": HEADING, "item": ITEM, "paragraph": PARAGRAPH, "link": ANCHOR}
    found = [F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(html, F.lit(p), F.lit(2 if k == "link" else 1)).alias("all")) for k, p in kinds.items()]
    each = pages.select("page_id", F.explode(F.array(*found)).alias("x")).select("page_id", "x.*")
    chars = F.aggregate("all", F.lit(0), lambda s, x: s + F.length(F.trim(x)))
    return each.select("page_id", "kind", F.size("all").alias("n"), chars.alias("chars"))
