"""Layouts, scripts and sessions on hand-made rows."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from decklore.operators import layout, reports, writing
from decklore.streaming import session


def prov(page, left=0, top=90, right=50, bottom=80):
    return [{"page_no": page, "bbox": {"l": left, "t": top, "r": right, "b": bottom, "coord_origin": "BOTTOMLEFT"}}]


TREE = {
    "pages": {"1": {"size": {"width": 100, "height": 100}}},
    "body": {"children": [{"$ref": "#/texts/0"}, {"$ref": "#/groups/0"}, {"$ref": "#/groups/1"}, {"$ref": "#/tables/0"}, {"$ref": "#/pictures/0"}, {"$ref": "#/texts/9"}]},
    "texts": [
        {"self_ref": "#/texts/0", "label": "title", "text": " A  title ", "prov": prov(1)},
        {"self_ref": "#/texts/1", "label": "list_item", "text": "one", "prov": prov(1, 0, 70, 30, 60)},
        {"self_ref": "#/texts/2", "label": "list_item", "text": "two", "prov": prov(1, 10, 60, 40, 50)},
        {"self_ref": "#/texts/3", "label": "page_footer", "text": "foot", "prov": prov(1)},
        {"self_ref": "#/texts/4", "label": "text", "text": "inner", "prov": prov(1)},
        {"self_ref": "#/texts/5", "label": "text", "text": " ", "prov": prov(1)},
    ],
    "groups": [
        {"self_ref": "#/groups/0", "label": "list", "children": [{"$ref": "#/texts/1"}, {"$ref": "#/texts/2"}]},
        {"self_ref": "#/groups/1", "label": "chapter", "children": [{"$ref": "#/texts/3"}, {"$ref": "#/texts/4"}, {"$ref": "#/texts/5"}, {"$ref": "#/texts/0"}]},
    ],
    "tables": [{"self_ref": "#/tables/0", "label": "table", "prov": prov(1), "data": {"grid": [[{"text": "a "}, {"text": None}]]}}],
    "pictures": [{"self_ref": "#/pictures/0", "label": "picture", "prov": prov(1, 0, 10, 10, 0)}],
}


def test_trees(spark):
    trees = spark.createDataFrame([("d", json.dumps(TREE))], "doc_id string, json string")
    got = [(r["id"], r["kind"], r["role"], r["content"], r["why_empty"]) for r in layout.parsed_trees(trees).orderBy("block_ord").collect()]
    assert got == [
        ("p001.b00", "paragraph", "title", "A title", None),
        ("p001.b01", "paragraph", "list", "one\ntwo", None),
        ("p001.b02", "paragraph", "body", "inner", None),
        ("p001.b03", "table", None, '[["a", ""]]', None),
        ("p001.b04", "image", None, None, "area_below_threshold"),
    ]
    row = layout.tree_blocks("d", TREE)[1]
    assert row[7:11] == (0.0, 0.3, 0.4, 0.5)


ITEMS = {"T1": {"kind": "T", "text": "Xin chào…"}, "T2": {"kind": "T", "text": "hai"}, "P1": {"kind": "P"}, "B1": {"kind": "B", "cells": [["x"]]}}


def test_answers():
    answer = {"blocks": [{"kind": "title", "read": "Xin chào..."}, {"kind": "list", "items": [["T2"], {"read": "·"}]}, {"kind": "table", "source": "B1"}, {"kind": "figure", "source": "P1", "describe": "đồ thị"}]}
    blocks, wrong = layout.assemble(answer, ITEMS)
    assert wrong is None
    assert [(b["kind"], b["content"], b["provenance"]) for b in blocks] == [
        ("title", "Xin chào…", "text_layer"), ("list", "hai", "text_layer"), ("table", [["x"]], "text_layer"), ("figure", "đồ thị", "vlm"),
    ]
    _, wrong = layout.assemble({"blocks": [{"kind": "text", "ids": ["T1", "T9"]}]}, ITEMS)
    assert wrong == "missing: T2; unknown: T9; forgotten: P1, B1"
    assert layout.flat_ids(["T1", {"ids": ["T2", ["T3"]]}, {"read": "x"}, []]) == ["T1", "T2", "T3", {"read": "x"}]


def test_snapping():
    page = "Quy định nghỉ phép năm DON’T forget, đột xuất…) hết"
    assert layout.snapped("DON'T forget,", page) == "DON’T forget,"
    assert layout.snapped("nghi phép năm", page) == "nghỉ phép năm"
    assert layout.snapped("không hề có ở đây", page) is None
    cells = layout.mended_cells([["Quy định", "hết"], ["nghỉ\nphép năm", None]], page)
    assert cells == ([["Quy định", "hết"], ["nghỉ phép năm", ""]], 4, 0)
    assert layout.mended_cells([["a", "b"], ["c"]], page) is None
    assert layout.is_anchor("Xem chính sách", ["chính sách"]) and not layout.is_anchor("khác", ["chính sách"])


def test_answer_cache(spark):
    pages = spark.createDataFrame([("d", 1, "p1"), ("d", 2, "p2")], "doc_id string, page_no int, prompt string")
    first = layout.layout_pages(pages, lambda p: p + "!", "m", spark.createDataFrame([], "key string, answer string"))
    known = first.filter("page_no = 1").select("key", F.lit("kept").alias("answer"))
    again = layout.layout_pages(pages, lambda p: p + "?", "m", known)
    assert {r["page_no"]: r["answer"] for r in again.collect()} == {1: "kept", 2: "p2?"}


def test_writing(spark):
    pages = spark.createDataFrame([("s", 1, "a", "h1"), ("s", 2, "b", "NEW"), ("s", 3, "c", "h3"), ("s", 4, "d", "h4"), ("t", 5, "e", "h5")], "section string, page_no int, content string, page_hash string")
    old = spark.createDataFrame([("s", 1, "old1", "h1", False), ("s", 2, "old2", "h2", False), ("s", 3, "old3", "h3", False), ("s", 4, "old4", "h4", True), ("t", 5, "old5", "h5", False)], "section string, page_no int, script string, page_hash string, human boolean")
    got = writing.write_sections(pages, old, lambda p: "new", lambda s, c: []).orderBy("page_no").collect()
    assert [(r["script"], r["rewritten"]) for r in got] == [("old1", False), ("new", True), ("new", True), ("old4", False), ("old5", False)]


@pytest.mark.parametrize(("answers", "want"), [(["ok"], ("ok", 1)), (["bad", "ok"], ("ok", 2)), (["bad", "bad2"], ("bad2", 2)), (["bad", "worse"], ("bad", 2))])
def test_two_passes(answers, want):
    left = iter(answers)
    issues = {"ok": [], "bad": [("x", "fix")], "bad2": [("y", "fix")], "worse": [("z", "red")]}
    assert writing.two_passes("p", "c", lambda p: next(left), lambda s, c: issues[s])[:2] == want


def test_reports(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 1)], "k string, v int")
    assert reports.markdown_table(rows, ["k", "v"], ["k"]).first()["markdown"] == "| k | v |\n|---|---|\n| a | 1 |\n| b | 2 |"
    said = spark.createDataFrame([("d", 1, "content", "x", 10), ("d", 1, "content", None, 10), ("d", 2, "delivery", None, 20)], "doc_id string, page_no int, kind string, ref string, syllables int")
    flags = spark.createDataFrame([("d", 2, "x", "red"), ("d", 1, "y", "fix")], "doc_id string, page_no int, code string, level string")
    r = reports.script_report(said, flags).first()
    assert (r["n_pages"], r["ungrounded"], r["delivery_share"], r["seconds"], r["red_pages"]) == (2, 0.5, 0.5, 12.0, [2])
    store = spark.createDataFrame([("NASA", "na xa", "nguoi")], "term string, say string, by string")
    found = spark.createDataFrame([("NASA",), ("ab",)], "term string")
    assert [tuple(x) for x in reports.merged_terms(store, found).collect()] == [("ab", "a bê", "auto"), ("NASA", "na xa", "nguoi")]
    blocks = spark.createDataFrame([("d", "image", None, None), ("d", "image", "seen", ["u"]), ("d", "table", "x", [])], "doc_id string, kind string, content string, urls array<string>")
    assert tuple(reports.document_report(blocks).first())[1:] == (3, 1, 2, 1, 1)


TURNS = [(1, 1, 0, "next", None), (1, 2, 1, "goto", 4), (1, 3, 2, "goto", 99), (1, 4, 3, "embed_failed", None), (2, 1, 0, "prev", None), (2, 2, 5, "stop", None), (2, 3, 6, "next", None)]


def test_sessions(spark, tmp_path):
    rows = pd.DataFrame(TURNS, columns=["conv_id", "turn", "s", "action", "value"])
    turns = spark.createDataFrame(rows.astype({"value": "float"})).select("conv_id", "turn", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "action", F.nanvl("value", F.lit(None).cast("double")).cast("int").alias("value"))
    turns.coalesce(1).sortWithinPartitions("ts", "turn").write.option("maxRecordsPerFile", 4).parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("conv_id long, turn long, ts timestamp, action string, value int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = session.sessions_stream(stream, 5).writeStream.format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["conv_id"], r["turn"]): (r["page"], r["mode"], r["stopped"]) for r in spark.table("sessions").collect()}
    want = {}
    for conv in (1, 2):
        state = (1, "hybrid", False)
        for c, turn, _, action, value in TURNS:
            if c == conv:
                state = session.step(*state, action, value, 5)
                want[(c, turn)] = state
    assert got == want and got[(1, 4)] == (4, "sparse", False) and got[(2, 3)] == (1, "hybrid", True)


def test_acknowledged(spark):
    at = lambda s: F.timestamp_millis(F.col(s) + 1_700_000_000_000)
    commands = spark.createDataFrame([(1, 0), (2, 0), (3, 500)], "cmd_id int, m long").select("cmd_id", at("m").alias("ts"))
    acks = spark.createDataFrame([(1, 900), (2, 1500), (3, 400)], "cmd_id int, m long").select("cmd_id", at("m").alias("ack_ts"))
    assert [r["cmd_id"] for r in session.acknowledged(commands, acks).collect()] == [1]
