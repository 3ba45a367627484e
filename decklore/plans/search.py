"""Search over the supplied tables: documents are chunks, their source is the page, benchmark texts are the questions, and a
question's vector is the embedding of the same number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decklore.llm.common import stage_table
from decklore.operators import bm25, evaluation, ranking, vectors
from decklore.sources.tables import read_table

KS, WEIGHTS = (5.0, 15.0, 60.0), (0.0, 1.0, 2.0)


def questions(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("q"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(F.col("doc_id").alias("id"), F.col("source").alias("page"))


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def sparse(spark: SparkSession, d: str) -> DataFrame:
    """Staged, as ``dense`` and ``wanted`` are: few rows a question, which queries read more than once."""
    return stage_table(ranking.ranked(bm25.scores(questions(spark, d), documents(spark, d), k=ranking.POOL)), "sparse")


def dense(spark: SparkSession, d: str, corpus: DataFrame | None = None) -> DataFrame:
    v = unit_vectors(spark, d)
    asked = questions(spark, d).select("qid").join(v.select(F.col("id").alias("qid"), F.col("v").alias("qv")), "qid")
    there = v.join((corpus or documents(spark, d)).select(F.col("doc_id").alias("id")), "id", "left_semi")
    return stage_table(ranking.ranked(vectors.knn_scores(asked, there.select("id", "v"), ranking.POOL)), "dense")


def wanted(spark: SparkSession, d: str) -> DataFrame:
    """qid, page: the pages with a document that contains the question's text, found with it, not looked up by its id."""
    found = evaluation.containing(
        documents(spark, d).select(F.col("source").alias("id"), "text"),
        questions(spark, d).select(F.col("qid").alias("aid"), F.col("q").alias("anchor")),
    )
    return stage_table(found.select(F.col("aid").alias("qid"), F.col("id").alias("page")).distinct(), "wanted")


def found_pages(spark: SparkSession, d: str, *rankings: DataFrame) -> DataFrame:
    """id, page of what the rankings have, staged: one pass over the documents marks them by the ids of these few rows, and no
    later join shuffles all pages."""
    ids = reduce(DataFrame.unionByName, [r.select("id") for r in rankings]).distinct()
    return stage_table(pages(spark, d).join(F.broadcast(ids), "id", "left_semi"), "pages")


def hybrid(spark: SparkSession, d: str) -> DataFrame:
    de, sp = dense(spark, d), sparse(spark, d)
    return ranking.by_page(ranking.fuse(de, sp), found_pages(spark, d, de, sp), top=None)


# ---- queries


def tokenize_terms(spark, d):
    from decklore.functions.text import terms

    return documents(spark, d).select("doc_id", F.array_join(terms(F.col("text")), " ").alias("terms"))


def term_stats(spark, d):
    return bm25.vocabulary(bm25.cut(documents(spark, d), "doc_id", "text")).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, d):
    return sparse(spark, d).select("qid", "id", F.round("score", 6).alias("score"), "rank")


def knn_topk(spark, d):
    return dense(spark, d).select("qid", "id", F.round("score", 6).alias("score"), "rank")


def knn_topk_filtered(spark, d):
    from decklore.operators.filters import where

    v = unit_vectors(spark, d)
    asked = questions(spark, d).select("qid").join(v.select(F.col("id").alias("qid"), F.col("v").alias("qv")), "qid")
    scored = vectors.knn_scores(asked, v.filter(where({"label": [1, 3, 5]})).select("id", "v"), 10)
    return ranking.ranked(scored, 10).select("qid", "id", F.round("score", 6).alias("score"), "rank")


def rrf_fusion(spark, d):
    return ranking.fuse(dense(spark, d), sparse(spark, d)).select("qid", "id", "rank_dense", "rank_sparse", F.round("rrf", 9).alias("rrf"))


def hybrid_search_pages(spark, d):
    hits = hybrid(spark, d).filter("pos <= 5")
    return hits.select("qid", "pos", "page", "id", F.round("rrf", 9).alias("rrf"), "n_chunks")


def search_modes(spark, d):
    de, sp = dense(spark, d), sparse(spark, d)
    pg, out = found_pages(spark, d, de, sp), None
    for mode, wd, ws in (("dense", 1, 0), ("sparse", 0, 1), ("hybrid", 1, 1)):
        hits = ranking.by_page(ranking.fuse(de, sp, wd=wd, ws=ws), pg).select(F.lit(mode).alias("mode"), "qid", "pos", "page")
        out = hits if out is None else out.unionByName(hits)
    return out


def nav_vs_qa_search(spark, d):
    """The filter goes below the ranking: navigation ranks all chunks, answers those that aren't short."""
    asked, docs = questions(spark, d), documents(spark, d)
    told, kind = bm25.weights(asked, docs), asked.schema["qid"].dataType.simpleString()
    both = bm25.scored(told, kind, docs, k=5, within=F.col("n_chars") >= 500)
    best = ranking.ranked(both.withColumn("qid", F.struct("within", "qid")), 5)
    return best.select(F.when(F.col("qid.within"), "qa").otherwise("nav").alias("mode"), "qid.qid", "id", "rank")


def confidence_gate(spark, d):
    hits = hybrid(spark, d)
    chosen = hits.filter("pos = 1 + qid % 2").select("qid", "page")
    return ranking.gate(hits, chosen)


def near_duplicates(spark, d):
    pairs = vectors.similar_pairs(unit_vectors(spark, d).select("id", "v"), 0.35)
    return pairs.select("id_a", "id_b", F.round("sim", 6).alias("sim"))


def exact_duplicates(spark, d):
    from decklore.functions.text import one_space

    same = documents(spark, d).groupBy(F.sha1(one_space(F.col("text")).cast("binary")).alias("text_key"))
    return same.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


def anchor_eval(spark, d):
    found = evaluation.containing(
        documents(spark, d).select(F.col("doc_id").alias("id"), "text"),
        questions(spark, d).select(F.col("qid").alias("aid"), F.col("q").alias("anchor")),
    )
    ranks = sparse(spark, d).select(F.col("qid").alias("aid"), "id", "rank")
    both = found.join(ranks, ["aid", "id"], "left")
    return both.groupBy(F.col("aid").alias("qid")).agg(F.count(F.lit(1)).alias("n_texts"), F.min("rank").alias("rank"), F.count_if(F.col("rank") <= 5).alias("n_top5"))


def eval_counters(spark, d):
    want, de, sp = wanted(spark, d), dense(spark, d), sparse(spark, d)
    pg = found_pages(spark, d, de, sp)
    asked = want.select("qid").distinct()
    out = None
    for mode, wd, ws in (("dense", 1, 0), ("sparse", 0, 1), ("hybrid", 1, 1)):
        hits = evaluation.first_hits(ranking.by_page(ranking.fuse(de, sp, wd=wd, ws=ws), pg, None), want, [])
        one = evaluation.counters(hits, asked, []).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


def eval_by_type(spark, d):
    want = wanted(spark, d)
    kinds = questions(spark, d).withColumn("type", F.when(F.length("q") < 200, "short").otherwise("long")).select("qid", "type")
    hits = evaluation.first_hits(hybrid(spark, d), want, []).join(kinds, "qid")
    asked = want.select("qid").distinct().join(kinds, "qid")
    return evaluation.counters(hits.select("type", "qid", "rank"), asked, ["type"])


def _grid_hits(spark, d):
    configs, want = evaluation.grid(spark, list(KS), list(WEIGHTS), list(WEIGHTS)), wanted(spark, d)
    de, sp = dense(spark, d), sparse(spark, d)
    ranks = evaluation.grid_pages(de, sp, found_pages(spark, d, de, sp), configs)
    return configs, want, evaluation.first_hits(ranks, want, ["k", "wd", "ws"])


def tune_grid(spark, d):
    configs, want, hits = _grid_hits(spark, d)
    asked = configs.crossJoin(want.select("qid").distinct())
    return evaluation.counters(hits, asked, ["k", "wd", "ws"])


def tune_order(spark, d):
    return evaluation.ordered_configurations(tune_grid(spark, d)).select("k", "wd", "ws", "pos", "best")


def tune_gained_lost(spark, d):
    return evaluation.gained_lost(_grid_hits(spark, d)[2], {"k": 15.0, "wd": 1.0, "ws": 1.0})


def self_retrieval_audit(spark, d):
    """Every question's own sources must be found by the start of its text as well as by all of it."""
    full = questions(spark, d)
    asked = full.select(F.col("qid"), F.lit("full").alias("mode"), "q").unionByName(full.select("qid", F.lit("start").alias("mode"), F.substring("q", 1, 80).alias("q")))
    keyed = asked.withColumn("qid", F.concat_ws("/", "mode", "qid"))
    ranks = ranking.ranked(bm25.scores(keyed.select("qid", "q"), documents(spark, d), k=ranking.POOL))
    hits = ranks.join(pages(spark, d), "id").groupBy("qid", "page").agg(F.min("rank").alias("rank"))
    split = F.split("qid", "/")
    hits = hits.select(F.get(split, F.lit(0)).alias("mode"), F.get(split, F.lit(1)).cast("long").alias("qid"), "page", "rank")
    found = wanted(spark, d)
    first = hits.join(found, ["qid", "page"]).groupBy("mode", "qid").agg(F.min("rank").alias("rank"))
    want = found.select("qid").distinct()
    every = want.withColumn("mode", F.lit("full")).unionByName(want.withColumn("mode", F.lit("start")))
    return evaluation.counters(first, every, ["mode"]).withColumn("passes", F.col("top1") >= 0.9 * F.col("n"))


def ann_exact_mismatch(spark, d):
    v = unit_vectors(spark, d).select("id", "v")
    asked = questions(spark, d).select("qid").join(v.select(F.col("id").alias("qid"), F.col("v").alias("qv")), "qid")
    exact = ranking.ranked(vectors.knn_scores(asked, v, 5), 5)
    near = ranking.ranked(vectors.approximate_scores(asked, v, planes=4, tables=24, k=5), 5)
    return evaluation.disagreements(exact, near)


QUERIES = [
    hybrid_search_pages, tokenize_terms, term_stats, bm25_topk, knn_topk, knn_topk_filtered, rrf_fusion, search_modes,
    nav_vs_qa_search, confidence_gate, near_duplicates, exact_duplicates, anchor_eval, eval_counters, eval_by_type, tune_grid, tune_order,
    tune_gained_lost, self_retrieval_audit, ann_exact_mismatch,
]

TERMS = "list_filter(string_split_regex(lower({0}), '[^0-9A-Za-zÀ-ỹ]+'), lambda x: length(x) > 1 OR regexp_matches(x, '^[0-9]+$'))"
DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
POSTS = f"""
toks AS MATERIALIZED (SELECT doc_id AS id, {TERMS.format("text")} AS ts FROM documents),
posts AS MATERIALIZED (SELECT id, term, dl, count(*) AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM toks) GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM toks),
raws AS MATERIALIZED (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM posts, corpus GROUP BY term),
stats AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws)"""
SCORED = POSTS + """,
sq AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({terms}) AS term FROM ({asked})) GROUP BY ALL),
sscore AS (SELECT qid, id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM sq JOIN stats USING (term) JOIN posts USING (term), corpus GROUP BY qid, id HAVING score > 0),
sparse AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM sscore QUALIFY rank <= 50)"""
ASKED = "SELECT item_id AS qid, text AS q FROM benchmark"
SPARSE = SCORED.format(terms=TERMS.format("q"), asked=ASKED)
DENSE = f"""
dscore AS (SELECT q.vec_id AS qid, v.vec_id AS id, {DOT.format("q.embedding", "v.embedding")} AS score
  FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id, embeddings v WHERE v.vec_id IN (SELECT doc_id FROM documents)),
dense AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM dscore QUALIFY rank <= 50)"""
BOTH = "WITH " + SPARSE.strip() + "," + DENSE + """,
fused AS (SELECT qid, id, d.rank AS rank_dense, s.rank AS rank_sparse,
    coalesce(1.0 / (15.0 + d.rank), 0) + coalesce(1.0 / (15.0 + s.rank), 0) AS rrf
  FROM dense d FULL JOIN sparse s USING (qid, id)),
pg AS (SELECT doc_id AS id, source AS page FROM documents),
wanted AS (SELECT DISTINCT b.item_id AS qid, d.source AS page FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
modes AS (SELECT * FROM (VALUES ('dense', 1, 0), ('sparse', 0, 1), ('hybrid', 1, 1)) t(mode, wd, ws)),
per_mode AS (SELECT mode, qid, id, page, CASE WHEN wd = 1 THEN rank_dense END AS rd, CASE WHEN ws = 1 THEN rank_sparse END AS rs
  FROM fused JOIN pg USING (id), modes WHERE (wd = 1 AND rank_dense IS NOT NULL) OR (ws = 1 AND rank_sparse IS NOT NULL)),
best AS (SELECT *, coalesce(1.0 / (15.0 + rd), 0) + coalesce(1.0 / (15.0 + rs), 0) AS s, count(*) OVER (PARTITION BY mode, qid, page) AS n_chunks
  FROM per_mode QUALIFY row_number() OVER (PARTITION BY mode, qid, page
    ORDER BY round(s, 12) DESC, rd NULLS LAST, rs NULLS LAST, id) = 1),
hits AS (SELECT *, row_number() OVER (PARTITION BY mode, qid ORDER BY round(s, 12) DESC, rd NULLS LAST, rs NULLS LAST, id) AS pos FROM best),
firsts AS (SELECT mode, qid, min(pos) AS rank FROM hits JOIN wanted USING (qid, page) GROUP BY ALL)"""
COUNTS = """count(*) AS n, count(*) FILTER (rank <= 1) AS top1, count(*) FILTER (rank <= 3) AS top3,
count(*) FILTER (rank <= 5) AS top5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr"""
GRID = BOTH + """,
configs AS (SELECT k, wd, ws FROM (VALUES (5.0), (15.0), (60.0)) a(k), (VALUES (0.0), (1.0), (2.0)) b(wd), (VALUES (0.0), (1.0), (2.0)) c(ws)
  WHERE wd > 0 OR ws > 0),
gfused AS (SELECT CAST(k AS DOUBLE) AS k, CAST(wd AS DOUBLE) AS wd, CAST(ws AS DOUBLE) AS ws, qid, page,
    max(round(coalesce(CAST(wd AS DOUBLE) / (k + rank_dense), 0) + coalesce(CAST(ws AS DOUBLE) / (k + rank_sparse), 0), 12)) AS s
  FROM fused JOIN pg USING (id), configs WHERE (wd > 0 AND rank_dense IS NOT NULL) OR (ws > 0 AND rank_sparse IS NOT NULL) GROUP BY ALL),
gpos AS (SELECT *, row_number() OVER (PARTITION BY k, wd, ws, qid ORDER BY s DESC, page) AS pos FROM gfused),
gfirst AS (SELECT k, wd, ws, qid, min(pos) AS rank FROM gpos JOIN wanted USING (qid, page) GROUP BY ALL)"""
AUDIT_ASKED = (
    "SELECT 'full/' || item_id AS qid, text AS q FROM benchmark UNION ALL SELECT 'start/' || item_id, substr(text, 1, 80) FROM benchmark"
)
SQL = {
    "hybrid_search_pages": BOTH + " SELECT qid, pos, page, id, round(s, 9) AS rrf, n_chunks FROM hits WHERE mode = 'hybrid' AND pos <= 5",
    "tokenize_terms": f"SELECT doc_id, array_to_string({TERMS.format('text')}, ' ') AS terms FROM documents",
    "term_stats": "WITH " + POSTS + " SELECT term, df, round(idf, 6) AS idf FROM stats",
    "bm25_topk": "WITH " + SPARSE + " SELECT qid, id, round(score, 6) AS score, rank FROM sparse",
    "knn_topk": "WITH " + DENSE + " SELECT qid, id, round(score, 6) AS score, rank FROM dense",
    "knn_topk_filtered": f"""SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank
        FROM (SELECT q.vec_id AS qid, v.vec_id AS id, {DOT.format("q.embedding", "v.embedding")} AS score
          FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id, embeddings v WHERE v.label IN (1, 3, 5)) QUALIFY rank <= 10""",
    "rrf_fusion": BOTH + " SELECT qid, id, rank_dense, rank_sparse, round(rrf, 9) AS rrf FROM fused",
    "search_modes": BOTH + " SELECT mode, qid, pos, page FROM hits WHERE pos <= 5",
    "nav_vs_qa_search": "WITH " + SPARSE + """
        SELECT 'nav' AS mode, qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM sscore QUALIFY rank <= 5
        UNION ALL
        SELECT 'qa', qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank
        FROM sscore WHERE id IN (SELECT doc_id FROM documents WHERE n_chars >= 500) QUALIFY rank <= 5""",
    "confidence_gate": BOTH + """, h AS (SELECT * FROM hits WHERE mode = 'hybrid'),
        tops AS (SELECT qid, max(page) FILTER (pos = 1) AS p1, max(page) FILTER (pos = 2) AS p2,
          coalesce(max(s) FILTER (pos = 1) - max(s) FILTER (pos = 2), 0) AS margin FROM h GROUP BY qid)
        SELECT h.qid, h.page, round(margin, 6) AS margin, CASE WHEN page = p1 AND margin >= 0.002 THEN 'goto' ELSE 'ask_back' END AS action,
          CASE WHEN page = p1 AND margin >= 0.002 THEN NULL
            ELSE page || CASE WHEN p1 <> page THEN ',' || p1 ELSE '' END || CASE WHEN p2 <> page THEN ',' || p2 ELSE '' END END AS candidates
        FROM h JOIN tops USING (qid) WHERE pos = 1 + h.qid % 2""",
    "near_duplicates": f"""SELECT id_a, id_b, round(sim, 6) AS sim FROM (SELECT a.vec_id AS id_a, b.vec_id AS id_b, {DOT.format("a.embedding", "b.embedding")} AS sim
        FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE sim >= 0.35""",
    "exact_duplicates": """SELECT sha1(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text_key, count(*) AS n, min(doc_id) AS first_id
        FROM documents GROUP BY 1 HAVING n > 1""",
    "anchor_eval": "WITH " + SPARSE + """ SELECT b.item_id AS qid, count(*) AS n_texts, min(rank) AS rank, count(*) FILTER (rank <= 5) AS n_top5
        FROM benchmark b JOIN documents d ON contains(d.text, b.text) LEFT JOIN sparse s ON s.qid = b.item_id AND s.id = d.doc_id GROUP BY 1""",
    "eval_counters": BOTH + f" SELECT mode, {COUNTS} FROM (SELECT DISTINCT mode, qid FROM wanted, modes) LEFT JOIN firsts USING (mode, qid) GROUP BY mode",
    "eval_by_type": BOTH + f""" SELECT CASE WHEN length(b.text) < 200 THEN 'short' ELSE 'long' END AS type, {COUNTS}
        FROM (SELECT DISTINCT qid FROM wanted) w JOIN benchmark b ON b.item_id = w.qid
        LEFT JOIN (SELECT * FROM firsts WHERE mode = 'hybrid') f ON f.qid = w.qid GROUP BY 1""",
    "tune_grid": GRID + f""" SELECT k, wd, ws, {COUNTS} FROM (SELECT DISTINCT CAST(k AS DOUBLE) AS k, CAST(wd AS DOUBLE) AS wd, CAST(ws AS DOUBLE) AS ws, qid
        FROM wanted, configs) LEFT JOIN gfirst USING (k, wd, ws, qid) GROUP BY k, wd, ws""",
    "tune_order": GRID + f""", c AS (SELECT k, wd, ws, {COUNTS} FROM (SELECT DISTINCT CAST(k AS DOUBLE) AS k, CAST(wd AS DOUBLE) AS wd, CAST(ws AS DOUBLE) AS ws, qid
        FROM wanted, configs) LEFT JOIN gfirst USING (k, wd, ws, qid) GROUP BY k, wd, ws),
        o AS (SELECT *, row_number() OVER (ORDER BY top5 DESC, top1 DESC, top3 DESC, mrr DESC, k, wd, ws) AS pos FROM c)
        SELECT k, wd, ws, pos, pos = (SELECT min(pos) FROM o WHERE wd > 0 AND ws > 0) AS best FROM o""",
    "tune_gained_lost": GRID + """, good AS (SELECT k, wd, ws, qid FROM gfirst WHERE rank <= 5),
        base AS (SELECT qid FROM good WHERE k = 15 AND wd = 1 AND ws = 1), cs AS (SELECT DISTINCT k, wd, ws FROM gfirst)
        SELECT k, wd, ws, coalesce(string_agg(CAST(qid AS VARCHAR), ',' ORDER BY qid) FILTER (NOT o), '') AS gained,
          coalesce(string_agg(CAST(qid AS VARCHAR), ',' ORDER BY qid) FILTER (NOT nw), '') AS lost
        FROM (SELECT k, wd, ws, qid, g.qid IS NOT NULL AS nw, b.qid IS NOT NULL AS o FROM
          (SELECT k, wd, ws, qid FROM good UNION SELECT k, wd, ws, qid FROM cs, base) u
          LEFT JOIN good g USING (k, wd, ws, qid) LEFT JOIN base b ON b.qid = u.qid) GROUP BY k, wd, ws""",
    "self_retrieval_audit": "WITH " + SCORED.format(terms=TERMS.format("q"), asked=AUDIT_ASKED) + f""",
        wanted AS (SELECT DISTINCT b.item_id AS qid, d.source AS page FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
        fr AS (SELECT string_split(s.qid, '/')[1] AS mode, w.qid, min(rank) AS rank FROM sparse s JOIN documents d ON d.doc_id = s.id
          JOIN wanted w ON w.qid = CAST(string_split(s.qid, '/')[2] AS BIGINT) AND w.page = d.source GROUP BY ALL)
        SELECT mode, {COUNTS}, top1 >= 0.9 * n AS passes FROM (SELECT DISTINCT mode, qid FROM wanted, (VALUES ('full'), ('start')) m(mode))
        LEFT JOIN fr USING (mode, qid) GROUP BY mode""",
}
