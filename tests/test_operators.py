"""Unit tests of rules on hand-made rows."""

import itertools

import pytest
from pyspark.sql import functions as F

from decklore.functions import numeric, text as tx
from decklore.operators import bm25, chunking, documents as dx, evaluation, filters, ranking, runtime, scripts, store, vectors
from decklore.providers import HashEmbedder, embed_texts, with_retry
from decklore.sources import tables
from decklore.streaming import intake


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'array<array<string>>' if isinstance(v, list) else 'double'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_terms(spark):
    assert one(spark, tx.terms(F.col("t")), t="Lương thưởng A 7 là BHXH, x2!") == ["lương", "thưởng", "7", "là", "bhxh", "x2"]


@pytest.mark.parametrize(("name", "want"), [("Bộ Quy Tắc (2)", "bo_quy_tac"), ("Đào tạo -- nội bộ", "dao_tao_noi_bo"), ("___", "doc"), ("a.b", "a_b")])
def test_slug(spark, name, want):
    assert one(spark, tx.slug(F.col("t")), t=name) == want


def test_table_markdown(spark):
    got = one(spark, tx.table_markdown(F.col("t")), t=[["a|b", "c"], ["1\n2", "3"]])
    assert got == "| a\\|b | c |\n|---|---|\n| 1 2 | 3 |"
    assert one(spark, tx.table_markdown(F.col("t")), t=[]) == ""


def test_labels_and_prefix(spark):
    assert one(spark, tx.page_span(F.lit(3), F.lit(3)), t="") == "trang 3"
    assert one(spark, tx.page_span(F.lit(3), F.lit(5)), t="") == "trang 3–5"
    assert one(spark, tx.page_label(F.lit(None).cast("string"), F.col("t")), t="x" * 60) == "x" * 48 + "…"
    assert one(spark, tx.page_label(F.lit(""), F.col("t")), t=" ") == "(không có chữ)"
    assert one(spark, tx.context_prefix([F.lit("a"), F.lit(None).cast("string"), F.lit("a"), F.lit("b")]), t="") == "[a · b] "
    assert one(spark, tx.fill_template("{{a}}-{{b}}", {"a": F.col("t"), "b": F.lit("2")}), t="1") == "1-2"


def test_link_role(spark):
    assert one(spark, tx.link_role(F.col("t")), t="https://a.b\n\nwww.c.d\ntext") is True
    assert one(spark, tx.link_role(F.col("t")), t="text\nhttps://a.b and more") is False


def test_where(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, None, 5)], "id int, k string, v int")
    ids = lambda w: [r["id"] for r in rows.filter(filters.where(w)).orderBy("id").collect()]
    assert ids(None) == [1, 2, 3] and ids({"k": ["a", "b"]}) == [1, 2] and ids({"v": 5, "k": "b"}) == [2] and ids({"v": [5]}) == [2, 3]
    assert filters.parse_pages("9,11, 3-5,4") == [3, 4, 5, 9, 11]


def test_rrf_and_weights(spark):
    de = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "qid int, id int, score double, rank int")
    sp = spark.createDataFrame([(1, 11, 5.0, 1), (1, 12, 4.0, 2)], "qid int, id int, score double, rank int")
    both = {r["id"]: r["rrf"] for r in ranking.fuse(de, sp).collect()}
    assert both == pytest.approx({10: 1 / 16, 11: 1 / 17 + 1 / 16, 12: 1 / 17})
    assert {r["id"] for r in ranking.fuse(de, sp, ws=0).collect()} == {10, 11}
    pages = spark.createDataFrame([(10, "p"), (11, "p"), (12, "q")], "id int, page string")
    hits = ranking.by_page(ranking.fuse(de, sp), pages).orderBy("pos").collect()
    assert [(r["page"], r["id"], r["n_chunks"]) for r in hits] == [("p", 11, 2), ("q", 12, 1)]


def test_gate(spark):
    pages = spark.createDataFrame([(1, 5, 1, 0.10), (1, 6, 2, 0.05), (2, 5, 1, 0.1), (3, 5, 1, 0.1), (3, 6, 2, 0.0995)], "qid int, page int, pos int, rrf double")
    chosen = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 9)], "qid int, page int")
    got = {r["qid"]: (r["action"], r["candidates"]) for r in ranking.gate(pages, chosen).collect()}
    assert got == {1: ("goto", None), 2: ("ask_back", "5"), 3: ("ask_back", "5,6"), 4: ("ask_back", "9")}


def test_bm25_on_ties_and_unknown_terms(spark):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "red fox red"), (3, "blue sky"), (4, None), (5, "")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "red red"), (2, "nothing here"), (3, "blue")], "qid int, q string")
    got = ranking.ranked(bm25.scores(asked, docs)).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["id"], r["rank"]) for r in got] == [(1, 1, 1), (1, 2, 2), (3, 3, 1)]
    assert got[0]["score"] == got[1]["score"]


def test_vectors(spark):
    v = spark.createDataFrame([(i, [float(i == j) for j in range(3)] if i < 3 else [0.6, 0.8, 0.0]) for i in range(4)], "id long, v array<float>")
    got = {(r["id_a"], r["id_b"]): r["sim"] for r in vectors.similar_pairs(v, 0.5).collect()}
    assert got == pytest.approx({(0, 3): 0.6, (1, 3): 0.8}, abs=1e-6)
    assert one(spark, numeric.dot(numeric.unit(F.array(F.lit(3.0), F.lit(4.0))), F.array(F.lit(1.0), F.lit(0.0))), t="") == pytest.approx(0.6)


def test_sections(spark):
    titles = [(1, "Cover"), (2, "Agenda"), (3, "01 Pay"), (5, "All about leave"), (8, "Bonus")]
    t = spark.createDataFrame([("d", p, x) for p, x in titles] + [("d", 9, "End")], "doc_id string, page_no int, title string")
    items = spark.createDataFrame([("d", 2, 0, "1. Pay"), ("d", 2, 1, "2. Leave"), ("d", 2, 2, "Bonus"), ("d", 2, 3, "Missing thing")], "doc_id string, page_no int, ord int, item string")
    got = dx.outline_sections(items, t).orderBy("ord").collect()
    assert [(r["start_page"], r["end_page"], r["confidence"]) for r in got] == [(3, 4, 0.75), (5, 7, 0.75), (8, 9, 0.75)]
    assert dx.outline_sections(items.filter("ord < 2"), t).count() == 0
    pages = spark.createDataFrame([("d", p) for p in (1, 3, 4, 9)], "doc_id string, page_no int")
    found = {r["page_no"]: r["section_id"] for r in dx.pages_in_sections(pages, dx.outline_sections(items, t)).collect()}
    assert found == {1: None, 3: "sec_00", 4: "sec_00", 9: "sec_02"}


def test_fill_down(spark):
    rows = [("t", 0, "Head", False), ("t", 1, "", False), ("t", 2, "a", False), ("t", 3, "", False), ("t", 4, "", True), ("t", 5, "", False), ("t", 6, "b", False), ("t", 7, "", False)]
    got = dx.fill_down(spark.createDataFrame(rows, "table_id string, row_no int, first_cell string, rest_blank boolean")).orderBy("row_no")
    assert [r["filled"] for r in got.collect()] == ["Head", "", "a", "a", "", "", "b", "b"]


def test_lines_keep_digits_that_equal_their_number(spark):
    docs = spark.createDataFrame([(1, "0997523947200 \n 1 \n\n  33x3 "), (2, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["ord"], r["line"]) for r in dx.block_lines(docs).collect()] == [(1, 0, "0997523947200"), (1, 1, "1"), (1, 2, "33x3")]


def test_patch_and_empty_blocks(spark):
    blocks = spark.createDataFrame([("d", "a", "x"), ("d", "b", None), ("d", "c", "y")], "doc_id string, id string, content string")
    key = "doc_id string, id string"
    got = dx.patch(blocks, spark.createDataFrame([("d", "a"), ("d", "z")], key), spark.createDataFrame([("d", "n", "new")], key + ", content string"), spark.createDataFrame([("d", "b", "told")], key + ", text string"))
    assert {(r["id"], r["content"]) for r in got.collect()} == {("b", "told"), ("c", "y"), ("n", "new")}
    assert [r["id"] for r in dx.missing_ids(spark.createDataFrame([("d", "a"), ("d", "z")], key), blocks).collect()] == ["z"]
    flagged = spark.createDataFrame([("d", "b"), ("d", "b")], "doc_id string, block_id string")
    assert dx.without_empty_blocks(blocks, flagged).count() == 3 and dx.without_empty_blocks(blocks, flagged.limit(0)).count() == 2


def test_links_to_blocks(spark):
    box = "l double, t double, r double, b double"
    blocks = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 0.5, 0.5), (1, 2, 1, 0.4, 0.0, 1.0, 0.5), (1, 3, 2, 0.4, 0.0, 1.0, 0.5)], "page_id int, block_id int, block_ord int, " + box)
    links = spark.createDataFrame([(1, 1, 0.45, 0.0, 0.9, 0.2), (1, 2, 0.0, 0.9, 0.1, 1.0)], "page_id int, link_id int, " + box)
    assert [(r["link_id"], r["block_id"]) for r in dx.link_blocks(links, blocks).collect()] == [(1, 2)]


def cost_of(cutter, spans):
    return tuple(map(sum, zip(*(cutter.cost(i, j) for i, j in spans), strict=True)))


@pytest.mark.parametrize("seed", range(25))
def test_cuts_are_the_cheapest(seed):
    import random

    rng = random.Random(seed)
    pieces = [
        chunking.Piece("w", rng.randint(5, 120), rng.choice(["block", "line", "sentence"]), h := rng.random() < 0.2, h or rng.random() < 0.1) for _ in range(rng.randint(1, 9))
    ]
    cutter = chunking.Cutter(pieces, 200)
    cutter.merged = lambda spans: spans
    n, best = len(pieces), None
    for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, n), k) for k in range(n)):
        edges = [0, *cuts, n]
        spans = list(zip(edges[:-1], edges[1:], strict=True))
        if all(cutter.size(i, j) <= 200 or j == i + 1 for i, j in spans):
            best = min(best or cost_of(cutter, spans), cost_of(cutter, spans))
    got = cutter.spans()
    assert cost_of(cutter, got) == best
    assert [k for i, j in got for k in range(i, j)] == list(range(n))


def test_table_header_repeats():
    rows = ["| h |", "|---|"] + [f"| row {i} with some words |" for i in range(40)]
    cutter = chunking.Cutter(chunking.pieces_of([("table", "\n".join(rows))], 60), 60)
    for i, j in cutter.spans():
        assert cutter.text(i, j).startswith("| h |\n|---|\n")


@pytest.mark.parametrize(
    ("token", "want"), [("0", 1), ("25", 3), ("105", 4), ("2025", 7), ("230.000", 5), ("1.5", 3), ("2,7", 3), ("10", 1), ("1000000", 2), ("1000000000000", 3)]
)
def test_number_syllables(token, want):
    assert scripts.number_syllables(token) == want


def test_syllable_rules(spark):
    assert scripts.words("THỜI GIAN LÀM VIỆC theo HĐLĐ plt.savefig 230.000") == ["thời", "gian", "làm", "việc", "theo", "HĐLĐ", "plt.savefig", "230.000"]
    assert scripts.is_foreign("Python") and scripts.is_foreign("CBLĐ") and not scripts.is_foreign("trong") and not scripts.is_foreign("1.5")
    texts = spark.createDataFrame([(1, "ba NASA python"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["syllables"], r["n_unknown"]) for r in scripts.syllable_counts(texts, {"NASA": {"say": "na xa"}}).collect()}
    assert got == {1: (5, 1), 2: (0, 0)}


@pytest.mark.parametrize(
    ("text", "want"), [("1 Cấu phần 08:00 và 4.400.000", ["8", "44"]), ("gọi 0912 345 678 hoặc a@b.vn, mã VSF_IT03", []), ("00 và 30%", ["3"]), ("https://x.y/12 có 7", ["7"])]
)
def test_source_numbers(spark, text, want):
    assert sorted(one(spark, scripts.source_numbers(F.col("t")), t=text)) == sorted(want)


def test_spoken_numbers(spark):
    assert set(one(spark, scripts.spoken_numbers(F.col("t")), t="Tám giờ 30, mười người")) == {"8", "3", "1"}


def test_script_issues(spark):
    blocks = spark.createDataFrame([("a", "b1", "paragraph", "body", "có 25 ngày nghỉ"), ("b", "b1", "table", None, "bảng có ba cột")], "doc_id string, id string, kind string, role string, content string")
    said = spark.createDataFrame([("a", 1, "content", "hai mươi lăm", "b1"), ("a", 2, "delivery", "sang trang 4", None), ("b", 1, "content", "x", "b9")], "doc_id string, ord int, kind string, text string, ref string")
    scr = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    got = {(r["doc_id"], r["code"]) for r in scripts.issues(scr, blocks, said).collect()}
    assert got == {("a", "bad_grounding"), ("a", "number_missing"), ("b", "bad_grounding"), ("b", "block_not_covered"), ("c", "empty_script")}


def test_commands(spark):
    said = [("xem slide 7 nhé", "goto", 7, "goto"), ("trang 99", "goto", 99, "ask_back"), ("trang sau", "next", 6, "goto"), ("nói lại", "repeat", None, "meta"), ("q", "stop", None, "meta"), ("trang 3 có gì", None, None, None)]
    asked = spark.createDataFrame([(i, s[0]) for i, s in enumerate(said)], "qid int, text string")
    got = runtime.commands(asked, F.lit(5), F.lit(20)).orderBy("qid").collect()
    assert [(r["command"], r["target"], r["action"]) for r in got] == [s[1:] for s in said]


def test_checked_answers(spark):
    rows = [(1, "Có. [slide 3] Hai. Ba. Bốn.", ["[a]"]), (2, "Có.", ["z"]), (3, "Có.", []), (4, "xem https://a.b", ["a"]), (5, None, ["a"])]
    replies = spark.createDataFrame(rows, "qid int, text string, refs array<string>")
    valid = spark.createDataFrame([(i, ["a", "b"]) for i in range(1, 6)], "qid int, ids array<string>")
    got = {r["qid"]: (r["action"], r["text"]) for r in runtime.checked(replies, valid).collect()}
    assert got[1] == ("answer", "Có. Hai. Ba.") and {got[i][0] for i in (2, 3, 4, 5)} == {"escalate"}


def test_store(spark):
    old = spark.createDataFrame([("d", 1, "x"), ("d", 2, "y"), ("e", 3, "z")], "doc string, id int, v string")
    new = spark.createDataFrame([("d", 1, "x"), ("d", 2, "changed"), ("d", 4, "new"), ("e", 3, "z")], "doc string, id int, v string")
    got = {r["doc"]: tuple(r)[1:] for r in store.sync_diff(old, new, "doc", "id").collect()}
    assert got == {"d": (1, 0, 1, True), "e": (0, 0, 0, False)}
    assert {tuple(r) for r in store.upsert(old, new.filter("id = 2"), "id").collect()} == {("d", 1, "x"), ("d", 2, "changed"), ("e", 3, "z")}
    vecs = spark.createDataFrame([("1", "m"), ("9", "m"), ("2", "other")], "chunk_id string, model_id string")
    chunks = spark.createDataFrame([("1",), ("2",)], "chunk_id string")
    assert {tuple(r) for r in store.misaligned(chunks, vecs, "m").collect()} == {("2", "chunk"), ("9", "vector")}


def test_embedding_cache(spark):
    texts = spark.createDataFrame([("a b",), ("c",), ("a b",)], "text string")
    misses = store.cache_misses(texts, spark.createDataFrame([], "text_key string"), "m")
    made = embed_texts(misses, HashEmbedder(8)).collect()
    assert len(made) == 2 and all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-6 for r in made)
    cache = misses.filter("text = 'c'").select("text_key")
    assert [r["text"] for r in store.cache_misses(texts, cache, "m").collect()] == ["a b"]
    calls = []
    with pytest.raises(OSError):
        with_retry(lambda: calls.append(1) or (_ for _ in ()).throw(OSError()), (0, 0))
    assert len(calls) == 3


def test_counters_and_anchors(spark):
    hits = spark.createDataFrame([(1, 1), (2, 4)], "qid int, rank int")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    r = evaluation.counters(hits, asked, []).first()
    assert (r["n"], r["top1"], r["top3"], r["top5"]) == (3, 1, 1, 2) and r["mrr"] == pytest.approx(1.25 / 3, abs=1e-6)
    texts = spark.createDataFrame([(1, "x one two three four five six seven y"), (2, "one two three four five six other"), (3, None)], "id int, text string")
    anchors = spark.createDataFrame([(1, "ne two three four five six sev"), (2, "two three"), (3, "none of it")], "aid int, anchor string")
    assert {tuple(r) for r in evaluation.containing(texts, anchors).collect()} == {(1, 1), (2, 1), (2, 2)}


def test_readers(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"queries": [{"q": "a", "page": 3, "by": "ai"}, {"q": "b", "page": [4, 5], "by": "nguoi", "type": "t"}]}')
    got = tables.read_labelled(spark, str(tmp_path / "q.json")).orderBy("qid").collect()
    assert [(r["pages"], r["type"]) for r in got] == [([3], "?"), ([4, 5], "t")]
    assert tables.read_labelled(spark, str(tmp_path / "q.json"), "ai").count() == 1
    path = str(tmp_path / "t")
    tables.write_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "d string, v int"), path, ["d"])
    tables.write_partitions(spark.createDataFrame([("b", 3)], "d string, v int"), path, ["d"])
    assert {(r["d"], r["v"]) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}
    line = tables.as_json_line(spark.createDataFrame([(1, None, [])], "a int, b string, c array<int>")).first()["value"]
    assert line == '{"a":1}'


EVENTS = [(1, 1, 0), (1, 2, 10), (1, 3, 29), (1, 4, 30), (1, 5, 45), (1, 6, 61), (2, 7, 5), (2, 8, 100)]


def events(spark):
    rows = spark.createDataFrame(EVENTS, "user_id long, event_id long, s long")
    return rows.select("user_id", "event_id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), F.lit("nav").alias("event_type"))


def test_rate_limit_in_batch_and_stream(spark, tmp_path):
    want = {1, 4, 6, 7, 8}
    assert {r["event_id"] for r in intake.rate_limited(events(spark)).collect()} == want
    source, n = str(tmp_path / "in"), events(spark).count()
    events(spark).orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 3).parquet(source)
    stream = spark.readStream.schema("user_id long, event_id long, ts timestamp, event_type string").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(source)
    out = intake.rate_limited_stream(stream, delay="10 minutes").writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    got = {r["event_id"] for r in spark.table("limited").collect()}
    assert n == 8 and {7, 8} <= got and got <= {r[1] for r in EVENTS} and len([i for i in got if i < 7]) in (2, 3)


def test_bursts(spark):
    got = {(r["user_id"], r["last_id"], r["n"]) for r in intake.bursts(events(spark), ["user_id", "event_type"], 15).collect()}
    assert got == {(1, 2, 2), (1, 4, 2), (1, 5, 1), (1, 6, 1), (2, 7, 1), (2, 8, 1)}


def test_queue(spark):
    waiting = spark.createDataFrame([(0, i, i, float(i % 3)) for i in range(30)], "q int, id int, arrived int, score double")
    got = intake.queue(waiting, ["q"]).orderBy("pos").collect()
    assert len(got) == 20 and {r["id"] for r in got} == set(range(10, 30)) and [r["id"] for r in got[:3]] == [11, 14, 17]


def test_display_and_ids(spark):
    assert one(spark, tx.shown(F.col("t"), 4), t="a\nbcde") == "a⏎bc…"
    assert one(spark, tx.page_of_chunk(F.col("t")), t="doc#p012.1") == 12 and one(spark, tx.page_of_chunk(F.col("t")), t="doc") is None
    assert one(spark, tx.title_of_prefix(F.col("t")), t="[Phần · Lương · trang 3/9] x") == "Lương"
    assert one(spark, tx.audit_text(F.lit("title"), F.lit("e"), F.col("t"), F.lit("T")), t="r" * 200) == "T " + "r" * 120
    ctx = F.array(F.struct(F.col("t").alias("chunk_id"), F.lit(3).alias("page"), F.lit(0.25).alias("vlm_ratio"), F.lit("x").alias("text")))
    assert one(spark, tx.rendered_contexts(ctx), t="c1") == "[c1] trang 3 (có 25% do máy tả ảnh — có thể sai con số)\nx"
    assert one(spark, dx.vlm_share(F.create_map(F.lit("vlm"), F.lit(1), F.lit("manual"), F.lit(3))), t="") == 0.25
    assert one(spark, dx.vlm_share(F.create_map().cast("map<string,int>")), t="") == 0.0


def test_pages(spark):
    pages = spark.createDataFrame([("d", 1, "A", "content"), ("d", 2, "B", "section_divider"), ("d", 3, "C", "section_divider")], "doc_id string, page_no int, title string, slide_type string")
    got = [(r["title_before"], r["title_after"], r["closes"]) for r in dx.neighbours(pages).orderBy("page_no").collect()]
    assert got == [(None, "B", False), ("A", "C", False), ("B", None, True)]
    blocks = "doc_id string, page_no int, block_ord int, kind string, content string, box string"
    rows = [("d", 1, 0, "p", "x", "b"), ("d", 1, 1, "p", None, None), ("d", 2, 0, "p", "x", "b"), ("d", 2, 1, "p", None, None), ("d", 3, 0, "p", "y", "b")]
    h = {r["page_no"]: r["page_hash"] for r in dx.page_hashes(spark.createDataFrame(rows, blocks)).collect()}
    assert h[1] == h[2] != h[3] and len(h[1]) == 16
    docs = spark.createDataFrame([("3_datavisualization_v2",), ("other",)], "doc_id string")
    patches = spark.createDataFrame([("DataVisualization", 1), ("Data", 2)], "stem string, n int")
    assert [(r["doc_id"], r["n"]) for r in dx.patch_for(docs, patches).collect()] == [("3_datavisualization_v2", 2)]
    images = spark.createDataFrame([("d", 1, "image", "a"), ("d", 1, "image", "b"), ("d", 2, "image", "c"), ("d", 2, "image", None)], "doc_id string, page_no int, kind string, content string")
    assert {r["content"] for r in dx.image_chunks(images).collect()} == {"a", "b"}


def test_model_scripts(spark):
    answer = '```json\n{"sentences": [{"kind": "content", "text": " Một hai. ", "ref": "b1", "speed": "9", "emphasis": ["hai", "bốn", "Một"]}, {"text": ""}, {"text": "x", "speed": "no"}]}\n```'
    rows = spark.createDataFrame([("d", 1, answer), ("d", 2, "not json")], "doc_id string, page_no int, answer string")
    got = [(r["kind"], r["text"], r["speed"], r["emphasis"]) for r in scripts.parsed_scripts(rows).collect()]
    assert got == [("content", "Một hai.", 1.5, ["hai", "Một"]), ("content", "x", 1.0, [])]
    used = spark.createDataFrame([("a", "NASA"), ("b", "NASA"), ("b", "AI")], "doc_id string, term string")
    store_ = spark.createDataFrame([("NASA", "na xa"), ("AI", "ây ai"), ("XX", "x")], "term string, say string")
    before = {r["doc_id"]: r[1] for r in scripts.term_hashes(used, store_).collect()}
    after = {r["doc_id"]: r[1] for r in scripts.term_hashes(used, store_.withColumn("say", F.when(F.col("term") == "AI", "a i").otherwise(F.col("say")))).collect()}
    assert before["a"] == after["a"] and before["b"] != after["b"]
    assert one(spark, scripts.red_flags(F.array(F.col("t"), F.lit("number_missing:3"))), t="bad_grounding:2") == ["bad_grounding:2"]


def test_issue_codes(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, "c")], "doc_id long, code string")
    assert {tuple(r) for r in scripts.issue_codes(rows).collect()} == {(1, "a,b"), (2, "c")}


def test_spelled():
    assert scripts.spelled("CBNV") == "xê bê en vê" and scripts.spelled("T7") == "tê bảy"
