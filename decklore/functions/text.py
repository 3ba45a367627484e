"""Text rules as Column expressions; all of them run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the retrieval rules.
TERM_BREAK = "[^0-9A-Za-zÀ-ỹ]+"
#: Runs of those, two characters at least, or one digit.
TERM = "[0-9A-Za-zÀ-ỹ]{2,}|[0-9]"
CITATION = r"(?i)\s*[\[(](?:slide|trang)\s*\d+[\])]"
URL_LINE = r"^(?:https?://|www\.)\S+$"
SPOKEN_URL = r"https?://|www\."
DEICTIC = r"(?iU)\b(?:này|đây|kia|bên trái|bên phải|phía trên|phía dưới)\b"
HEADING_WORDS = 12
LABEL_CHARS = 48
# Letters with marks and what they fold to, in order of the plain letter.
FOLDS = {
    "a": "àáảãạăằắẳẵặâầấẩẫậäåāą",
    "c": "çćč",
    "d": "đ",
    "e": "èéẻẽẹêềếểễệëēęě",
    "i": "ìíỉĩịîïī",
    "n": "ñńň",
    "o": "òóỏõọôồốổỗộơờớởỡợöøō",
    "u": "ùúủũụưừứửữựûüū",
    "y": "ỳýỷỹỵÿ",
}


def terms(text: Column) -> Column:
    """Search terms: lower case, cut at anything but digits and letters; single characters only if digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def fold(text: Column) -> Column:
    """Letters without their marks."""
    marked = "".join(FOLDS.values())
    plain = "".join(k * len(v) for k, v in FOLDS.items())
    return F.translate(text, marked + marked.upper(), plain + plain.upper())


def slug(text: Column) -> Column:
    """An id out of a file's stem: no trailing (n), no marks, runs of anything else to _, lower case, doc if empty."""
    stem = F.regexp_replace(text, r"\s*\(\d+\)\s*$", "")
    plain = F.lower(F.regexp_replace(fold(stem), "[^0-9A-Za-z]+", "_"))
    cut = F.regexp_replace(plain, "^_+|_+$", "")
    return F.when(cut == "", "doc").otherwise(cut)


def lines(text: Column) -> Column:
    """Lines that aren't blank, trimmed of spaces. (Given F.trim itself, transform would pass a line's number as what to trim.)"""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def is_heading(line: Column) -> Column:
    return F.trim(line).endswith(":") & (F.size(F.split(F.trim(line), r"\s+")) <= HEADING_WORDS)


def without_citations(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, CITATION, ""))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?;])\s+")


def table_markdown(cells: Column) -> Column:
    """Rows of cells as a Markdown table: pipes escaped, line ends to spaces."""
    row = lambda r: F.concat(
        F.lit("| "),
        F.array_join(F.transform(r, lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))), " | "),
        F.lit(" |"),
    )
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(F.get(cells, F.lit(0)))))
    head, body = F.transform(F.slice(cells, 1, 1), row), F.transform(F.slice(cells, 2, 1 << 30), row)
    return F.when(F.size(cells) > 0, F.array_join(F.concat(head, F.array(rule), body), "\n")).otherwise("")


def context_prefix(parts: list[Column]) -> Column:
    """[a · b · c] of the parts that are there, each once; empty if there are none."""
    found = F.array_distinct(F.array_compact(F.array(*parts)))
    return F.when(F.size(found) > 0, F.concat(F.lit("["), F.array_join(found, " · "), F.lit("] "))).otherwise("")


def page_span(first: Column, last: Column) -> Column:
    a, b = first.cast("string"), last.cast("string")
    return F.when(first == last, F.concat(F.lit("trang "), a)).otherwise(F.concat(F.lit("trang "), a, F.lit("–"), b))


def page_label(title: Column, first_line: Column) -> Column:
    cut = F.trim(first_line)
    short = F.concat(F.substring(cut, 1, LABEL_CHARS), F.when(F.length(cut) > LABEL_CHARS, "…").otherwise(""))
    named = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return F.coalesce(named(title), named(short), F.lit("(không có chữ)"))


def fill_template(template: str | Column, values: dict[str, Column]) -> Column:
    """{{key}} replaced by its value, key after key."""
    start = F.lit(template) if isinstance(template, str) else template
    return reduce(lambda t, kv: F.replace(t, F.lit("{{" + kv[0] + "}}"), kv[1]), values.items(), start)


def link_role(text: Column) -> Column:
    """Are at least half of the lines that aren't blank plain links?"""
    all_lines = lines(text)
    links = F.size(F.filter(all_lines, lambda x: x.rlike(URL_LINE)))
    return (F.size(all_lines) > 0) & (2 * links >= F.size(all_lines))


def content_key(model: Column, text: Column) -> Column:
    """What identifies a text's vector: SHA-1 of model, NUL and text."""
    return F.sha1(F.concat(model.cast("binary"), F.unhex(F.lit("00")), text.cast("binary")))


def stripped_fence(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*|\s*```$", "")


def shown(text: Column, most: int = 80) -> Column:
    """A text on one line, cut for display."""
    flat = F.replace(text, F.lit("\n"), F.lit("⏎"))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def page_of_chunk(chunk_id: Column) -> Column:
    return F.regexp_extract(chunk_id, r"#p(\d+)", 1).try_cast("int")


def title_of_prefix(text: Column) -> Column:
    """The title in a chunk's [section · title · trang n/m] prefix."""
    inner = F.regexp_extract(text, r"^\[([^\]]*)\]", 1)
    parts = F.split(inner, " · ")
    return F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2))


def audit_text(mode: Column, enriched: Column, raw: Column, title: Column) -> Column:
    """What a chunk is searched by in an audit: all of it, its raw text, or its section's title and its start."""
    return F.when(mode == "enriched", enriched).when(mode == "raw", raw).otherwise(F.concat_ws(" ", title, F.substring(raw, 1, 120)))


def rendered_contexts(contexts: Column) -> Column:
    """An array of (chunk_id, page, vlm_ratio, text) as the part of a prompt."""
    one = lambda c: F.concat(
        F.lit("["), c["chunk_id"], F.lit("] trang "), c["page"].cast("string"),
        F.when(c["vlm_ratio"] > 0, F.concat(F.lit(" (có "), F.round(c["vlm_ratio"] * 100).cast("int").cast("string"), F.lit("% do máy tả ảnh — có thể sai con số)"))).otherwise(""),
        F.lit("\n"), c["text"],
    )
    return F.array_join(F.transform(contexts, one), "\n\n")
