"""Stores, settings, chat clients and the command line."""

import json

import pytest

from decklore import cli, providers
from decklore.config import Settings
from decklore.sources import stores

SCHEMA = "id string, v array<float>, lang string, doc_id string"
ROWS = [("a1", [1.0, 0.0], "en", "a"), ("a2", [0.0, 1.0], "de", "a"), ("b1", [0.6, 0.8], "en", "b")]


@pytest.fixture(params=["memory", "parquet"])
def index(request, spark, tmp_path):
    if request.param == "memory":
        made = stores.create("memory", spark.createDataFrame([], SCHEMA))
    else:
        made = stores.create("parquet", spark, str(tmp_path), "org/Model-1", SCHEMA)
    made.upsert(spark.createDataFrame(ROWS, SCHEMA))
    return made


def test_index(spark, index):
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid int, qv array<float>")
    assert [r["id"] for r in index.query(asked, 2).orderBy("rank").collect()] == ["a1", "b1"]
    assert [r["id"] for r in index.query(asked, 2, {"lang": "de"}).collect()] == ["a2"]
    new = spark.createDataFrame([ROWS[0], ROWS[1], ("b1", [0.0, 1.0], "fr", "b"), ("c1", [1.0, 0.0], "en", "c")], SCHEMA)
    assert index.sync(new) == 2 and index.sync(new) == 0
    assert {(r["id"], r["lang"]) for r in index.rows.collect()} == {("a1", "en"), ("a2", "de"), ("b1", "fr"), ("c1", "en")}
    index.upsert(spark.createDataFrame([("a2", [1.0, 0.0], "es", "a")], SCHEMA))
    assert {r["lang"] for r in index.rows.filter("doc_id = 'a'").collect()} == {"en", "es"}


def test_sparse_index(spark):
    chunks = spark.createDataFrame([("1", "d", "red fox", "x"), ("2", "d", "red dog", "y"), ("3", "e", "red", "x")] + [(str(i), "d", f"word{i} other{i}", "y") for i in range(10, 16)], "id string, doc_id string, text string, kind string")
    asked = spark.createDataFrame([(1, "fox red")], "qid int, q string")
    index = stores.create("bm25", chunks)
    assert [r["id"] for r in index.query(asked, "d", 5).orderBy("rank").collect()][0] == "1"
    assert [r["id"] for r in index.query(asked, "d", 5, {"kind": "y"}).collect()] == ["2"]
    with pytest.raises(ValueError):
        stores.create("other")
    assert stores.collection_name("org/Text-3.small") == "kb__text_3_small"


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"_note": 1, "top_k": "7"}))
    assert Settings.load(str(tmp_path / "s.json")) == Settings(top_k=7)
    (tmp_path / "t.json").write_text('{"other": 1}')
    with pytest.raises(ValueError):
        Settings.load(str(tmp_path / "t.json"))


def test_chat_gives_up_json_for_good():
    modes, log = [], []

    def call(prompt, json_mode):
        modes.append(json_mode)
        if json_mode:
            raise ValueError("no JSON mode")
        return "```json\n{}\n```"

    client = providers.ChatClient(call, log.append, waits=())
    assert client.chat("a", "t") == "{}" and client.chat("b") == "{}"
    assert modes == [True, False, False] and [r["tag"] for r in log] == ["t", ""]


def test_command_line(spark, sf, tmp_path):
    assert cli.main(["flags_rules", sf, "--out", str(tmp_path / "f")]) in (0, 3)
    assert cli.main(["metadata_filter", sf, "--rows", "1"]) == 0


def test_parquet_index_removes_from_its_files(spark, tmp_path):
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def made(*ids):
        known = [{"id": i, "doc_id": d, "v": [1.0, 0.0]} for d, i in ids]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in known], SCHEMA).select(*cols)

    index = stores.create("parquet", spark, str(tmp_path), "m", SCHEMA)
    cols = index.rows.columns
    files = lambda: sorted((r["doc_id"], r["id"]) for r in spark.read.schema(SCHEMA).parquet(index.path).select("doc_id", "id").collect())
    every = [("a b", "1"), ("a b", "2"), ("c/d", "3"), ("e", "4")]
    assert index.sync(made(*every)) == 3 and files() == every
    assert index.sync(made(*every[:2])) == 2 and files() == every[:2]
    assert index.sync(made(*every[:2])) == 0
    index.delete(spark.createDataFrame([("1",)], "id string"))
    assert files() == [("a b", "2")]
    index.delete(spark.createDataFrame([("2",)], "id string"))
    assert files() == [] and index.rows.count() == 0
    index.upsert(made(("a b", "1")))
    index.upsert(made(("e", "1")))
    assert files() == [("e", "1")]
