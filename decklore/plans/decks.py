"""Structured-document queries over the supplied tables: lines of documents are blocks, languages are documents or sections,
HTML pages have titles, items and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decklore.functions import text as tx
from decklore.operators import chunking, documents as dx, filters, scripts, store
from decklore.sources import html
from decklore.sources.tables import read_table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return dx.block_lines(_docs(spark, d))


def chunk_stats(spark, d):
    rows = _docs(spark, d).select("lang", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("t"))
    return rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("low"), F.percentile("t", F.lit(0.5)).alias("mid"), F.max("t").alias("high"),
        F.sum("t").alias("total"), F.count_if(F.col("t") > 500).alias("n_over"),
    )


def provenance_ratio(spark, d):
    marked = _docs(spark, d).join(read_table(spark, d, "labels"), "doc_id", "left").withColumn("p", F.when(F.col("toxic") == 1, "vlm").when(F.col("toxic") == 0, "text_layer").otherwise("manual"))
    by = marked.groupBy("source", "p").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "p", "n"))), ",")
    share = F.sum(F.when(F.col("p") == "vlm", F.col("n")).otherwise(0)) / F.sum("n")
    return by.groupBy("source").agg(listed.alias("counts"), F.round(share, 6).alias("vlm_ratio"))


def metadata_filter(spark, d):
    kept = _docs(spark, d).filter(filters.where({"lang": ["de", "fr"], "source": "src3"}))
    return kept.select("doc_id", "lang", "source")


def store_sync_diff(spark, d):
    old = _docs(spark, d).select("doc_id", "source", "lang", "n_chars")
    new = old.filter("doc_id % 50 <> 7").withColumn("n_chars", F.when(F.col("doc_id") % 40 == 3, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    added = old.filter("doc_id % 60 = 1").withColumn("doc_id", F.col("doc_id") + 1_000_000_000)
    return store.sync_diff(old, new.unionByName(added), "source", "doc_id")


def store_upsert(spark, d):
    old = _docs(spark, d).select("doc_id", "lang", "n_chars")
    rows = old.filter("lang = 'de'").withColumn("n_chars", -F.col("n_chars"))
    return store.upsert(old, rows, "doc_id")


def embedding_cache_misses(spark, d):
    texts = _docs(spark, d).select("text", "lang")
    cache = store.cache_misses(texts.filter("lang = 'en'"), spark.createDataFrame([], "text_key string"), "m1").select("text_key")
    return store.cache_misses(texts, cache, "m1").select("text_key", F.length("text").alias("chars"))


def sections_range_join(spark, d):
    """Documents are pages of one deck in order of id; the first page of each hundred that has English text opens a section."""
    pages = _docs(spark, d).select(F.lit("deck").alias("doc_id"), F.col("doc_id").cast("int").alias("page_no"), "lang")
    opens = pages.filter("lang = 'en'").groupBy("doc_id", F.floor(F.col("page_no") / 100).alias("ord")).agg(F.min("page_no").alias("start_page"))
    last = pages.agg(F.max("page_no").alias("m"))
    spans = dx.section_spans(opens.crossJoin(F.broadcast(last)), F.col("m")).withColumn("section_id", F.concat(F.lit("sec_"), F.col("ord").cast("string")))
    return dx.pages_in_sections(pages.select("doc_id", "page_no"), spans).select("page_no", "section_id")


def deck_map_islands(spark, d):
    """Runs of one language among each source's documents."""
    runs = dx.runs(_docs(spark, d).select("source", "doc_id", "lang"), ["source"], "doc_id", "lang")
    return runs.select("source", "lang", "first", "last", "n", tx.page_span(F.col("first"), F.col("last")).alias("span"))


def deck_map_text(spark, d):
    runs = dx.runs(_docs(spark, d).select(F.col("source"), "doc_id", "lang"), ["source"], "doc_id", "lang")
    return dx.deck_map(runs.withColumnRenamed("source", "doc_id"), F.col("lang"))


def fill_down(spark, d):
    """Each document's lines as a table whose first cell is blank on two lines of three and whose rest is blank on one of seven."""
    cells = _lines(spark, d).select(
        F.col("doc_id").alias("table_id"), F.col("ord").alias("row_no"),
        F.when((F.col("ord") % 3 != 0) | (F.col("ord") % 7 == 5), "").otherwise(F.substring("line", 1, 12)).alias("first_cell"),
        (F.col("ord") % 7 == 5).alias("rest_blank"),
    )
    return dx.fill_down(cells).select("table_id", "row_no", "filled")


def slide_type_rules(spark, d):
    """The first line is a title, its box from the document's numbers; further lines are body paragraphs."""
    blocks = _lines(spark, d).select(
        F.col("doc_id").alias("page_id"), F.lit("paragraph").alias("kind"), F.when(F.col("ord") == 0, "title").otherwise("body").alias("role"),
        F.col("line").alias("content"), ((F.col("doc_id") % 10) / 10.0).alias("cx"), ((F.col("doc_id") % 7) / 7.0).alias("cy"),
    )
    return dx.slide_type(blocks)


def html_blocks(spark, d):
    return html.blocks(read_table(spark, d, "pages"))


def html_links(spark, d):
    return html.links(read_table(spark, d, "pages"))


def html_titles(spark, d):
    page = read_table(spark, d, "pages").withColumn("title", html.page_title(F.col("html")))
    return page.select("page_id", "title", tx.slug(F.col("title")).alias("slug"))


def _boxes(spark, d, low):
    dim = lambda i: (F.get("embedding", F.lit(i)).cast("double") + 0.5)
    side = lambda f, i: f(dim(i), dim(i + 1))
    v = read_table(spark, d, "embeddings")
    return v.select("vec_id", "label", side(F.least, low).alias("l"), side(F.greatest, low).alias("r"), side(F.least, low + 2).alias("t"), side(F.greatest, low + 2).alias("b"))


def link_overlap_argmax(spark, d):
    """Embedding dimensions 1-4 as a block's box, 5-8 as a link's; the label is the page."""
    blocks = _boxes(spark, d, 0).select(F.col("label").alias("page_id"), F.col("vec_id").alias("block_id"), F.col("vec_id").alias("block_ord"), "l", "t", "r", "b")
    links = _boxes(spark, d, 4).select(F.col("label").alias("page_id"), F.col("vec_id").alias("link_id"), "l", "t", "r", "b")
    return dx.link_blocks(links, blocks)


def link_role(spark, d):
    """Links and items of each HTML page as lines: is it a list of links?"""
    per = html.links(read_table(spark, d, "pages")).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("ord", "url", "text"))).alias("x"))
    lines = F.concat(F.transform("x", lambda r: r["url"]), F.filter(F.transform("x", lambda r: F.concat(r["text"], F.lit(" ."))), lambda t: F.length(t) > 12))
    return per.select("page_id", tx.link_role(F.array_join(lines, "\n")).alias("is_links"), F.size(lines).alias("n_lines"))


def issue_code_lists(spark, d):
    return scripts.issue_codes(_conversation_issues(spark, d))


def flag_histogram(spark, d):
    return dx.flag_counts(flags_rules(spark, d))


def flags_rules(spark, d):
    """Documents are pages of the deck named by their source."""
    docs = _docs(spark, d)
    pages = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("page_no"), F.when(F.col("n_chars") > 15000, "too long").alias("layout_error"))
    kind = F.when(F.col("doc_id") % 5 == 0, "image").when(F.col("doc_id") % 5 == 1, "table").otherwise("paragraph")
    blocks = docs.filter("n_chars > 100").select(
        F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("page_no"), F.concat(F.lit("b"), F.col("doc_id").cast("string")).alias("id"), kind.alias("kind"),
        F.when(F.col("n_chars") > 400, F.col("text")).alias("content"), F.when(F.col("n_chars") <= 400, "not_described").alias("why_empty"),
    )
    sections = docs.filter("lang = 'en' and n_chars > 12000").select(F.col("source").alias("doc_id"))
    return dx.flags(pages, blocks, sections.distinct())


def patch_merge(spark, d):
    rows = _docs(spark, d).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("id"), F.col("lang").alias("content"))
    drops = rows.filter("content = 'fr'").select("doc_id", "id")
    texts = rows.filter("content = 'es'").select("doc_id", "id", F.lit("patched").alias("text"))
    adds = rows.filter("content = 'de'").select("doc_id", (F.col("id") + 1_000_000_000).alias("id"), F.lit("added").alias("content"))
    return dx.patch(rows, drops, adds, texts)


EXTRA_LINES = [(-1, 0, "Bảo hiểm sức khỏe:"), (-1, 1, "Không phải đề mục."), (-1, 2, "một hai ba bốn năm sáu bảy tám chín mười mười một mười hai mười ba:")]
EXTRA_NAMES = [("Bộ Quy Tắc Ứng Xử (2)",), ("Đào tạo -- nội bộ",), ("___",), ("Élan d'été (10)",), ("CHẾ ĐỘ LƯƠNG",)]


def heading_lines(spark, d):
    rows = _lines(spark, d).unionByName(spark.createDataFrame(EXTRA_LINES, "doc_id long, ord int, line string"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(tx.is_heading(F.col("line"))).alias("n_headings"))


def slugify(spark, d):
    named = read_table(spark, d, "pages").select(html.page_title(F.col("html")).alias("name")).unionByName(spark.createDataFrame(EXTRA_NAMES, "name string"))
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select("name", "n", tx.slug(F.col("name")).alias("slug"))


def chunk_pages(spark, d):
    blocks = _lines(spark, d).withColumn("kind", F.lit("paragraph"))
    return chunking.chunk_pages(blocks).select("doc_id", "chunk_no", "n_pieces", "token_count", F.sha1(F.col("text").cast("binary")).alias("text_key"))


def number_coverage(spark, d):
    """What a script of the text's first half leaves unsaid."""
    half = F.substring("text", F.lit(1), (F.length("text") / 2).cast("int"))
    rows = _docs(spark, d).select("doc_id", scripts.source_numbers(F.col("text")).alias("need"), scripts.spoken_numbers(half).alias("said"))
    left = F.array_sort(F.array_except("need", "said"))
    return rows.select("doc_id", F.size("need").alias("n_need"), F.array_join(left, ",").alias("missing")).filter("n_need > 0")


def block_coverage(spark, d):
    blocks = _lines(spark, d).select("doc_id", F.col("ord").alias("id"), F.lit("paragraph").alias("kind"), F.lit("body").alias("role"), F.col("line").alias("content"))
    told = _lines(spark, d).filter("length(line) > 60").select("doc_id", F.col("ord").alias("ref"), F.lit("content").alias("kind"))
    return scripts.uncovered(blocks, told).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_uncovered"), F.min("id").alias("first_uncovered"))


def _conversation_issues(spark, d):
    """A script for each conversation: assistant turns tell the user turn before them, system turns deliver."""
    turns = read_table(spark, d, "conversations")
    blocks = turns.filter("role = 'user'").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("id"), F.lit("paragraph").alias("kind"), F.lit("body").alias("role"), F.col("text").alias("content"))
    said = turns.filter("role <> 'user'").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.when(F.col("role") == "assistant", "content").otherwise("delivery").alias("kind"), "text", (F.col("turn") - 1).alias("ref")
    )
    return scripts.issues(turns.select(F.col("conv_id").alias("doc_id")).distinct(), blocks, said)


def script_issues(spark, d):
    return _conversation_issues(spark, d).groupBy("code", "level").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_scripts"))


def term_extraction(spark, d):
    return scripts.term_counts(_docs(spark, d).select(F.col("doc_id").alias("id"), "text"))


def syllable_counts(spark, d):
    return scripts.syllable_counts(_docs(spark, d), {"NASA": {"say": "na xa"}})


def dirty_propagation(spark, d):
    pages = _docs(spark, d).select(F.concat_ws("/", "source", "lang").alias("section"), F.col("doc_id").alias("page_no"), (F.col("n_chars") > 6000).alias("changed"), (F.col("doc_id") % 6 == 0).alias("human"))
    return scripts.stale(pages)


def prev_scripts_window(spark, d):
    turns = scripts.earlier(read_table(spark, d, "conversations"), "conv_id", "turn", "text")
    return turns.select("conv_id", "turn", "recent", "older")


QUERIES = [
    chunk_stats, provenance_ratio, metadata_filter, store_sync_diff, store_upsert, embedding_cache_misses, sections_range_join,
    deck_map_islands, deck_map_text, fill_down, slide_type_rules, html_blocks, html_links, html_titles, link_overlap_argmax, link_role,
    flags_rules, patch_merge, heading_lines, slugify, chunk_pages, number_coverage, block_coverage, script_issues, term_extraction,
    syllable_counts, dirty_propagation, prev_scripts_window, flag_histogram, issue_code_lists,
]

LINES = """ln AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS ord, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM
  (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ls FROM documents)))"""
CLEAN = """hp AS (SELECT page_id, regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g') AS h FROM pages)"""
RUNS = """r0 AS (SELECT source, doc_id, lang, CASE WHEN lang IS NOT DISTINCT FROM lag(lang) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c
  FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
runs AS (SELECT source, lang, min(doc_id) AS first, max(doc_id) AS last, count(*) AS n FROM
  (SELECT *, sum(c) OVER (PARTITION BY source ORDER BY doc_id) AS run FROM r0) GROUP BY source, run, lang)"""
SPAN = "CASE WHEN first = last THEN 'trang ' || first ELSE 'trang ' || first || '–' || last END"
LINKS = CLEAN + """, lk AS (SELECT page_id, CAST(i - 1 AS INTEGER) AS ord, us[i] AS url, trim(ts[i], ' ') AS text FROM (SELECT page_id, us, ts, unnest(range(1, len(us) + 1)) AS i FROM
  (SELECT page_id, regexp_extract_all(h, '<a href="([^"]*)"[^>]*>([^<]*)', 1) AS us, regexp_extract_all(h, '<a href="([^"]*)"[^>]*>([^<]*)', 2) AS ts FROM hp)))"""
_marked, _plain = "".join(tx.FOLDS.values()), "".join(k * len(v) for k, v in tx.FOLDS.items())
FOLD = "translate({0}, '" + _marked + _marked.upper() + "', '" + _plain + _plain.upper() + "')"
SLUG = """CASE WHEN trim(regexp_replace(lower(regexp_replace({0}, '[^0-9A-Za-z]+', '_', 'g')), '^_+|_+$', '', 'g')) = '' THEN 'doc'
  ELSE regexp_replace(lower(regexp_replace({0}, '[^0-9A-Za-z]+', '_', 'g')), '^_+|_+$', '', 'g') END""".format(FOLD.format("regexp_replace(name, '\\s*\\(\\d+\\)\\s*$', '')"))
_values = lambda rows: ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
_dim = lambda i: f"(CAST(embedding[{i + 1}] AS DOUBLE) + 0.5)"
_box = lambda i: f"least({_dim(i)}, {_dim(i + 1)}) AS l, greatest({_dim(i)}, {_dim(i + 1)}) AS r, least({_dim(i + 2)}, {_dim(i + 3)}) AS t, greatest({_dim(i + 2)}, {_dim(i + 3)}) AS b"
FLAGS = """WITH p AS (SELECT source AS doc_id, CAST(doc_id AS INTEGER) AS page_no, n_chars, doc_id AS d, trim(text) AS t FROM documents),
        b AS (SELECT *, 'b' || d AS id, CASE WHEN d % 5 = 0 THEN 'image' WHEN d % 5 = 1 THEN 'table' ELSE 'paragraph' END AS k FROM p WHERE n_chars > 100)
        SELECT doc_id, 'empty_page' AS kind, 'warn' AS severity, page_no, CAST(NULL AS VARCHAR) AS block_id FROM p WHERE page_no NOT IN (SELECT page_no FROM b WHERE n_chars > 400 AND t <> '')
        UNION ALL SELECT doc_id, 'image_not_described', 'warn', page_no, id FROM b WHERE k = 'image' AND n_chars <= 400
        UNION ALL SELECT doc_id, 'table_empty', 'error', page_no, id FROM b WHERE k = 'table' AND (n_chars <= 400 OR t = '')
        UNION ALL SELECT doc_id, 'layout_failed', 'error', page_no, NULL FROM p WHERE n_chars > 15000
        UNION ALL SELECT DISTINCT source, 'no_sections', 'info', CAST(NULL AS INTEGER), NULL FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'en' AND n_chars > 12000)"""
SQL = {
    "chunk_stats": """SELECT lang, count(*) AS n, min(t) AS low, quantile_cont(t, 0.5) AS mid, max(t) AS high, sum(t) AS total, count(*) FILTER (t > 500) AS n_over
        FROM (SELECT lang, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS t FROM documents) GROUP BY lang""",
    "provenance_ratio": """SELECT source, string_agg(p || '=' || n, ',' ORDER BY p) AS counts, round(sum(CASE WHEN p = 'vlm' THEN n ELSE 0 END) / sum(n), 6) AS vlm_ratio
        FROM (SELECT source, CASE WHEN toxic = 1 THEN 'vlm' WHEN toxic = 0 THEN 'text_layer' ELSE 'manual' END AS p, count(*) AS n
          FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL) GROUP BY source""",
    "metadata_filter": "SELECT doc_id, lang, source FROM documents WHERE lang IN ('de', 'fr') AND source = 'src3'",
    "store_sync_diff": """WITH o AS (SELECT doc_id, source, lang, n_chars FROM documents),
        n AS (SELECT doc_id, source, lang, n_chars + CASE WHEN doc_id % 40 = 3 THEN 1 ELSE 0 END AS n_chars FROM o WHERE doc_id % 50 <> 7
          UNION ALL SELECT doc_id + 1000000000, source, lang, n_chars FROM o WHERE doc_id % 60 = 1)
        SELECT source, count(*) FILTER (od IS NULL) AS n_added, count(*) FILTER (nd IS NULL) AS n_removed, count(*) FILTER (oc <> nc) AS n_changed,
          count(*) FILTER (od IS NULL OR nd IS NULL OR oc <> nc) > 0 AS rewrite
        FROM (SELECT coalesce(o.source, n.source) AS source, o.doc_id AS od, n.doc_id AS nd, o.n_chars AS oc, n.n_chars AS nc
          FROM o FULL JOIN n ON o.doc_id = n.doc_id) GROUP BY source""",
    "store_upsert": "SELECT doc_id, lang, CASE WHEN lang = 'de' THEN -n_chars ELSE n_chars END AS n_chars FROM documents",
    "embedding_cache_misses": """SELECT sha1(encode('m1') || '\\x00'::BLOB || encode(text)) AS text_key, any_value(length(text)) AS chars FROM documents
        WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en') GROUP BY text""",
    "sections_range_join": """WITH s AS (SELECT doc_id // 100 AS ord, min(doc_id) AS a FROM documents WHERE lang = 'en' GROUP BY 1),
        e AS (SELECT ord, a, coalesce(lead(a) OVER (ORDER BY ord) - 1, (SELECT max(doc_id) FROM documents)) AS z FROM s)
        SELECT CAST(doc_id AS INTEGER) AS page_no, 'sec_' || ord AS section_id FROM documents LEFT JOIN e ON doc_id BETWEEN a AND z""",
    "deck_map_islands": f"WITH {RUNS} SELECT source, lang, first, last, n, {SPAN} AS span FROM runs",
    "deck_map_text": f"WITH {RUNS} SELECT source AS doc_id, string_agg('- ' || {SPAN} || ': ' || lang, chr(10) ORDER BY first) AS deck_map FROM runs GROUP BY source",
    "fill_down": f"""WITH {LINES}, c AS (SELECT doc_id AS table_id, ord AS row_no, ord % 7 = 5 AS rest_blank,
          CASE WHEN ord % 3 <> 0 OR ord % 7 = 5 THEN '' ELSE substr(line, 1, 12) END AS v FROM ln),
        m AS (SELECT *, sum(CASE WHEN trim(v) = '' AND rest_blank THEN 1 ELSE 0 END) OVER (PARTITION BY table_id ORDER BY row_no) AS chain FROM c)
        SELECT table_id, row_no, CASE WHEN trim(v) = '' AND NOT rest_blank AND row_no >= 2 THEN coalesce(last_value(CASE WHEN trim(v) <> '' AND row_no >= 1 THEN v END IGNORE NULLS)
          OVER (PARTITION BY table_id, chain ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v) ELSE v END AS filled FROM m""",
    "slide_type_rules": f"""WITH {LINES} SELECT doc_id AS page_id, CASE WHEN count(*) = 1 AND count(*) FILTER (ord = 0 AND (doc_id % 7) / 7.0 >= 0.3
        AND (doc_id % 10) / 10.0 BETWEEN 0.35 AND 0.65) = 1 THEN 'section_divider' ELSE 'content' END AS slide_type FROM ln GROUP BY doc_id""",
    "html_blocks": f"""WITH {CLEAN}, k AS (SELECT page_id, unnest([{{'kind': 'heading', 'x': regexp_extract_all(h, '<h1[^>]*>([^<]*)', 1)}},
        {{'kind': 'item', 'x': regexp_extract_all(h, '<li>([^<]*)', 1)}}, {{'kind': 'paragraph', 'x': regexp_extract_all(h, '<p>([^<]*)', 1)}},
        {{'kind': 'link', 'x': regexp_extract_all(h, '<a href="([^"]*)"[^>]*>([^<]*)', 2)}}]) AS s FROM hp)
        SELECT page_id, s.kind AS kind, len(s.x) AS n, coalesce(list_sum(list_transform(s.x, lambda t: length(trim(t, ' ')))), 0) AS chars FROM k""",
    "html_links": f"WITH {LINKS} SELECT page_id, ord, url, text FROM lk",
    "html_titles": f"""SELECT page_id, name AS title, {SLUG} AS slug FROM (SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)', 1), ' ') AS name FROM pages)""",
    "link_overlap_argmax": f"""WITH bl AS (SELECT label AS page_id, vec_id AS block_id, {_box(0)} FROM embeddings), li AS (SELECT label AS page_id, vec_id AS link_id, {_box(4)} FROM embeddings)
        SELECT page_id, link_id, block_id, round(area, 6) AS area FROM (SELECT li.page_id, link_id, block_id,
          greatest(least(li.r, bl.r) - greatest(li.l, bl.l), 0) * greatest(least(li.b, bl.b) - greatest(li.t, bl.t), 0) AS area FROM li JOIN bl USING (page_id))
        WHERE area > 0 QUALIFY row_number() OVER (PARTITION BY page_id, link_id ORDER BY area DESC, block_id) = 1""",
    "link_role": f"""WITH {LINKS}, al AS (SELECT page_id, list_concat(list(url ORDER BY ord), list_filter(list_transform(list(text ORDER BY ord), lambda t: t || ' .'), lambda t: length(t) > 12)) AS x
          FROM lk GROUP BY page_id), fl AS (SELECT page_id, len(x) AS n_lines, list_filter(list_transform(x, lambda t: trim(t, ' ')), lambda t: t <> '') AS y FROM al)
        SELECT page_id, len(y) > 0 AND 2 * len(list_filter(y, lambda t: regexp_full_match(t, '(?:https?://|www\\.)\\S+'))) >= len(y) AS is_links, n_lines FROM fl""",
    "flag_histogram": "SELECT kind, count(*) AS n FROM (" + FLAGS + ") GROUP BY kind",
    "flags_rules": FLAGS,
    "patch_merge": """SELECT source AS doc_id, doc_id AS id, CASE WHEN lang = 'es' THEN 'patched' ELSE lang END AS content FROM documents WHERE lang <> 'fr'
        UNION ALL SELECT source, doc_id + 1000000000, 'added' FROM documents WHERE lang = 'de'""",
    "heading_lines": f"""WITH {LINES}, al AS (SELECT doc_id, line FROM ln UNION ALL SELECT d, l FROM (VALUES {_values(EXTRA_LINES)}) v(d, o, l))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (ends_with(trim(line), ':') AND len(string_split_regex(trim(line), '\\s+')) <= 12) AS n_headings FROM al GROUP BY doc_id""",
    "slugify": f"""SELECT name, count(*) AS n, any_value({SLUG}) AS slug FROM (SELECT trim(regexp_extract(html, '<title>([^<]*)', 1), ' ') AS name FROM pages
        UNION ALL SELECT v FROM (VALUES {_values(EXTRA_NAMES)}) x(v)) GROUP BY name""",
    "block_coverage": f"""WITH {LINES} SELECT doc_id, count(*) AS n_uncovered, min(ord) AS first_uncovered FROM ln
        WHERE length(line) <= 60 AND len(string_split_regex(trim(line), '\\s+')) >= 3 GROUP BY doc_id""",
    "term_extraction": """SELECT term, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, unnest(string_split_regex(text, '[^0-9A-Za-zÀ-ỹ]+')) AS term FROM documents)
        WHERE regexp_full_match(term, '[A-Z][A-Z0-9]+') GROUP BY term""",
    "dirty_propagation": """SELECT section, page_no, changed, human, NOT human AND (changed OR coalesce(max(CASE WHEN changed AND NOT human THEN 1 ELSE 0 END)
          OVER (PARTITION BY section ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1) AS rewrite
        FROM (SELECT source || '/' || lang AS section, doc_id AS page_no, n_chars > 6000 AS changed, doc_id % 6 = 0 AS human FROM documents)""",
    "prev_scripts_window": """WITH t AS (SELECT conv_id, turn, text, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1] AS f FROM conversations)
        SELECT conv_id, turn, coalesce(string_agg(text, ' / ' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS recent,
          coalesce(string_agg(f, ' / ' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 4 PRECEDING), '') AS older FROM t""",
}
