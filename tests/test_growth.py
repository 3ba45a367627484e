"""Steps whose work or shuffle must grow no faster than their input."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from decklore.functions.text import TERM
from decklore.operators import bm25, documents as dx, evaluation, ranking, scripts, vectors


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bm25_tasks_return_the_best_alone(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 9))).replace("a", "aa 7 Ünd").replace("b", "bb")) for i in range(200)]
    docs += [(i + 200, t) for i, t in docs] + [(5, "bb bb"), (5, "7 bb"), (400, None)]
    asked = spark.createDataFrame([(1, "bb aa BB"), (2, "ünd"), (3, "none")], "qid long, q string")
    chunks = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    cut = [(i, re.findall(TERM, (t or "").lower())) for i, t in docs]
    df = Counter(w for _, ts in cut for w in set(ts))
    raw = {w: math.log(len(cut) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    idf = {w: 0.25 * sum(raw.values()) / len(raw) if x < 0 else x for w, x in raw.items()}
    mean, want, posts = sum(len(ts) for _, ts in cut) / len(cut), {}, Counter()
    for i, ts in cut:
        posts.update((i, len(ts), w) for w in ts)  # rows of one id and length are one
    for q, asks in ((1, ["bb", "aa", "bb"]), (2, ["ünd"])):
        for (i, dl, w), tf in posts.items():
            if w in asks:
                want[q, i] = want.get((q, i), 0) + asks.count(w) * idf[w] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))
    want = {k: v for k, v in want.items() if v > 0}
    assert {(r["qid"], r["id"]): r["score"] for r in bm25.scores(asked, chunks).collect()} == pytest.approx(want)
    best = bm25.scores(asked, chunks, k=4)
    tasks = spark.sparkContext.defaultParallelism
    assert best.count() <= 2 * 4 * tasks + 2  # two questions that hit, one repeated id
    order = {q: sorted((i for p, i in want if p == q), key=lambda i: (-round(want[q, i], 9), i))[:4] for q in (1, 2)}
    assert [(r["qid"], r["id"]) for r in ranking.ranked(best, 4).orderBy("qid", "rank").collect()] == [(q, i) for q in (1, 2) for i in order[q]]


def test_anchors_need_no_join(spark):
    texts = [(1, "abcdefgh"), (2, "ijklmnop"), (3, "xx này là đoạn neo yy"), (4, "này là đoạn neo này là đoạn neo"), (5, None), (6, "")]
    anchors = [(1, "efghijkl"), (2, "này là đoạn neo"), (3, "k"), (4, "abcdefgh"), (5, "abcdefghi"), (6, None)]
    got = evaluation.containing(spark.createDataFrame(texts, "id int, text string").coalesce(1), spark.createDataFrame(anchors, "aid int, anchor string"))
    assert sorted(tuple(r) for r in got.collect()) == [(2, 3), (2, 4), (3, 2), (4, 1)]
    assert "Join" not in plan(got) and "Exchange" not in plan(got)


def test_anchors_of_any_length_and_place(spark):
    rng = random.Random(8)
    texts = [(i, "".join(rng.choices("aab é", k=rng.randint(0, 60)))) for i in range(400)] + [(400, None)]
    anchors = [(n, t[at : at + n]) for n in range(1, 40) for t, at in [(rng.choice([t for _, t in texts[:400] if len(t) > n + 9]), rng.randint(0, 9))]]
    anchors += [(100 + i, texts[i][1] + texts[i + 1][1]) for i in range(40)] + [(200, ""), (201, "b" * 15)]
    got = evaluation.containing(spark.createDataFrame(texts, "id int, text string").coalesce(1), spark.createDataFrame(anchors, "aid int, anchor string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((a, i) for a, x in anchors for i, t in texts if t is not None and x in t)


def test_anchors_are_looked_up_at_every_eighth_byte():
    data = np.frombuffer("".join(random.Random(9).choices("abcdefgh ", k=1 << 23)).encode(), np.uint8)
    anchor, seconds = data[5_000_003:5_000_103].tobytes(), {}
    for step in (8, 1):
        find, began = evaluation._lookup([anchor], step), time.process_time()
        assert [int(x) for at, _ in find(data) for x in at if data[x : x + 100].tobytes() == anchor] == [5_000_003]
        seconds[step] = time.process_time() - began
    assert seconds[8] < seconds[1] / 2


def _tables(spark, folder, docs):
    """Documents that sf0.001's questions and vectors are asked of."""
    for name in ("benchmark", "embeddings"):
        (folder / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_wanted_pages_are_those_of_the_texts(spark, tmp_path):
    from decklore.plans import search

    docs = search.documents(spark, "/root/testdata/sf0.001")
    first = search.questions(spark, "/root/testdata/sf0.001").orderBy("qid").first()
    odd = spark.createDataFrame([(1, "no question", "en", "elsewhere", 1), (None, f"x {first['q']} y", "en", "of null", 1), (1, f"{first['q']} y", "en", None, 1)], docs.schema)
    d = _tables(spark, tmp_path, docs.unionByName(odd))
    pages = {r["page"] for r in search.wanted(spark, d).filter(F.col("qid") == first["qid"]).collect()}
    assert {"of null", None} <= pages and "elsewhere" not in pages  # looked up by the id before


def test_link_blocks_shuffle_boxes_not_pairs(spark, monkeypatch):
    monkeypatch.setattr(dx, "MEET", 20)
    rng = random.Random(5)
    box = lambda: (lambda x, y: (min(x), max(x), min(y), max(y)))([rng.randint(0, 9) / 10 for _ in "ab"], [rng.randint(0, 9) / 10 for _ in "ab"])
    links = [(p, i, *box()) for p in (1, 2) for i in range(70)] + [(3, 1, 0.0, 1.0, 0.0, 1.0)]
    blocks = [(p, i, -i, *box()) for p in (1, 2) for i in range(90)] + [(4, 1, 1, 0.0, 1.0, 0.0, 1.0)]
    want = set()
    for p, i, l, r, t, b in links:
        met = [(-(max(min(r, r2) - max(l, l2), 0.0) * max(min(b, b2) - max(t, t2), 0.0)), o, j) for q, j, o, l2, r2, t2, b2 in blocks if p == q]
        if met and min(met)[0] < 0:
            want.add((p, i, min(met)[2]))
    sides = "l double, r double, t double, b double"
    got = dx.link_blocks(spark.createDataFrame(links, f"page_id int, link_id int, {sides}"), spark.createDataFrame(blocks, f"page_id int, block_id int, block_ord int, {sides}"))
    assert {(r["page_id"], r["link_id"], r["block_id"]) for r in got.collect()} == want
    assert "Window" not in plan(got)


def test_syllables_of_many_distinct_words(spark):
    texts = [(i, " ".join(f"w{i}x{j}" for j in range(300))) for i in range(5000)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).cache()
    rows.count()
    began = time.time()
    assert scripts.syllable_counts(rows).count() == 5000
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    scripts.syllable_counts(rows).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 30  # each text went through all words of its batch before


def test_approximate_candidates_are_not_shuffled(spark):
    rng = random.Random(1)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(300)], "id long, v array<float>")
    asked = v.filter("id < 5").selectExpr("id as qid", "v as qv")
    index = lambda df, i: df.selectExpr("table", "bucket", f"id as {i}")
    met = index(vectors.signs_index(asked.selectExpr("qid as id", "qv as v"), planes=6, tables=3), "qid").join(index(vectors.signs_index(v, planes=6, tables=3), "id"), ["table", "bucket"])
    want = {(r["qid"], r["id"]) for r in met.distinct().collect()}
    got = vectors.approximate_scores(asked, v, planes=6, tables=3)
    assert {(r["qid"], r["id"]) for r in got.collect()} == want and len(want) < 1500
    assert "Aggregate" not in plan(got)


def test_terms_of_blocks_are_those_of_the_pattern():
    rng = random.Random(11)
    odd = "aZ09 _-.\n\x00@[`{²ÀỹỺ߿ࠀကÿ¿ΣςİIı×÷ßẞ�中😀́ỸỻἀΩ"
    texts = ["".join(rng.choices(odd, k=rng.randint(0, 30))) for _ in range(3000)] + [None, "", "x", "7", "ß", "é1", "Σ", "ΑΣ", "ΑΣ Σ"]
    want = [re.findall(TERM, (t or "").lower()) for t in texts]
    words, lengths = bm25._words(texts)
    assert lengths.tolist() == [len(x) for x in want] and words.to_pylist() == [w for x in want for w in x]
    assert [t for at, block in bm25._blocks(bm25.pa.array(texts), 7) for t in (block if at % 7 == 0 else ["?"])] == texts


def test_questions_meet_vectors_as_few_blocks(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(300, 8))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, v array<double>").repartition(5)
    got = vectors.knn_scores(v.filter("id < 40").selectExpr("id as qid", "v as qv").repartition(9), v, 3)
    assert "CartesianProduct" not in plan(got)  # 9 x 5 tasks before, each of which packed its vectors
    best = ranking.ranked(got, 3).orderBy("qid", "rank").collect()
    order = np.argsort(-(m[:40] @ m.T), axis=1)[:, :3]
    assert [(r["qid"], r["id"]) for r in best] == [(q, i) for q in range(40) for i in order[q]]
    none = vectors.knn_scores(v.filter("id < 0").selectExpr("id as qid", "v as qv"), v, 3)
    assert none.count() == 0


def test_one_pass_ranks_all_and_some(spark):
    docs = [(i, "aa bb" if i % 3 else "aa aa cc", None if i == 4 else i % 2) for i in range(60)] + [(5, "bb aa aa", 0), (5, "cc", 1), (6, None, 1)]
    chunks = spark.createDataFrame(docs, "doc_id long, text string, n int").repartition(3)
    asked = spark.createDataFrame([(1, "aa cc"), (2, "bb"), (3, "none")], "qid long, q string")
    told = bm25.weights(asked, chunks)
    for some in (chunks, chunks.filter("doc_id not in (5, 6)")):
        both = bm25.scored(told, "bigint", some, k=5, within=chunks.n == 1 if some is chunks else some.n == 1)
        assert plan(both).count("MapInArrow") == 1
        for flag, rows in ((False, some), (True, some.filter("n = 1"))):
            got = ranking.ranked(both.filter(both["within"] == flag).drop("within"), 5).collect()
            want = ranking.ranked(bm25.scored(told, "bigint", rows, k=5), 5).collect()
            key = lambda r: (r["qid"], r["rank"], r["id"], round(r["score"], 9))
            assert sorted(map(key, got)) == sorted(map(key, want)) and len(want) >= 5


@pytest.mark.parametrize("name", ["eval_counters", "eval_by_type", "search_modes", "tune_grid", "tune_gained_lost", "confidence_gate", "context_dedup", "gate_replies", "rrf_fusion"])
def test_rankings_are_read_and_not_made_again(spark, name):
    import __spark_entry__

    assert "MapInArrow" not in plan(__spark_entry__.queries()[name](spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("name", ["eval_by_type", "confidence_gate", "search_modes", "eval_counters", "tune_grid", "tune_order", "tune_gained_lost", "context_dedup", "gate_replies"])
def test_pages_are_looked_up_once(spark, name):
    import __spark_entry__

    read = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert read and not [f for f in read if "documents.parquet" in f]  # joins met the pages of all documents before


def test_pages_of_repeated_and_null_ids(spark, tmp_path):
    from decklore.plans import search

    docs = search.documents(spark, "/root/testdata/sf0.001")
    odd = spark.createDataFrame([(1, "a", "en", "elsewhere", 1), (2, "a", "en", None, 1), (None, "a", "en", "of null", 1)], docs.schema)
    d = _tables(spark, tmp_path, docs.unionByName(odd))
    ranks = [spark.createDataFrame([(q, i) for i in ids], "qid long, id long") for q, ids in ((1, [1, 2, 5]), (2, [2, 9, None]))]
    got = search.found_pages(spark, d, *ranks).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, search.pages(spark, d).filter("id in (1, 2, 5, 9)").collect()))) and len(got) == 6
