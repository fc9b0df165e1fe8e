import json

import pytest
from helpers import rows
from pyspark.errors import PySparkException

from attesta import rpc
from attesta.sources import files, journals, tables

KEY = b"0123456789abcdef"


def test_note_folder(spark, tmp_path):
    (tmp_path / "case" / "node_modules").mkdir(parents=True)
    (tmp_path / "case" / "a.md").write_text("# One\npassword: x1y2\n# Two\ntext")
    (tmp_path / "case" / "MEMORY.md").write_text("hidden")
    (tmp_path / "case" / "node_modules" / "n.md").write_text("dep")
    got = files.load_chunks(spark, str(tmp_path), [("case", "case", True)])
    assert rows(got, "file", "heading", "body") == [("a.md", "One", "password: <REDACTED>"), ("a.md", "Two", "text")]


def test_pages_and_links(spark):
    pages = spark.createDataFrame([("b", 1, "tiny"), ("b", 2, "x" * 1600)], "file string, page int, text string")
    assert [r[1:4] for r in rows(files.page_chunks(pages))] == [(2, 0, "p2 (1)"), (2, 1, "p2 (2)")]
    links = spark.createDataFrame([("onenote:///x?resid=AB1",), ("https://h/Plan.one",), ("https://h/Dup",)], "link string")
    known = spark.createDataFrame([("p1", "Other", "ab1"), ("p2", "plan", "zz"), ("p3", "dup", "q"), ("p4", "dup", "r")], "page_id string, title string, resid string")
    assert [r[1:] for r in rows(files.match_links(links, known))] == [(None, "none"), ("p2", "name"), ("p1", "exact")]


def test_golden(spark, tmp_path):
    p = tmp_path / "g.json"
    asked = [{"expect_pages": [1, 3], "expect": ["f"], "q": "a"}, {"expect": [], "q": "b"}]
    p.write_text(json.dumps({"queries": asked}))
    assert rows(files.golden(spark, str(p)), "q", "page_hi", "positive") == [("a", 3, True), ("b", None, False)]


def test_journal_round_trip_tail_and_tampering(spark, tmp_path):
    path = str(tmp_path / "j.bin")
    journals.append(path, journals.encrypt(spark, [{"path": "a", "n": 1}, {"path": "b", "n": 2}], KEY, "j"))
    with open(path, "ab") as f:
        f.write(b"\x00\x00\x01\x00partial")
    journals.append(path, journals.encrypt(spark, [{"path": "a", "n": 3}], KEY, "j"))
    got = journals.read(spark, path, KEY, "j")
    assert [json.loads(r[2])["n"] for r in rows(got)] == [1, 2, 3]
    assert rows(journals.latest_state(got, "path string, n int"), "path", "n") == [("a", 3), ("b", 2)]
    raw = bytearray(open(path, "rb").read())
    raw[-1] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(PySparkException):
        journals.read(spark, path, KEY, "j").collect()


def test_snapshots(spark, tmp_path):
    s = tables.Snapshots(spark, str(tmp_path / "s"))
    with pytest.raises(LookupError):
        s.read("t")
    s.publish({"t": spark.range(3)})
    s.publish({"t": spark.range(5)})
    assert s.read("t").count() == 5 and s.verify()
    s.rollback()
    assert s.read("t").count() == 3


def test_encrypted_column_and_cache(spark):
    df = spark.createDataFrame([("k1", "secret text"), ("k2", None)], "chunk_key string, body string")
    assert rows(tables.decrypted(tables.encrypted(df, "body", KEY, "a"), "body", KEY, "a")) == rows(df)
    cache = spark.createDataFrame([("k1", "m"), ("k2", "other")], "chunk_key string, model string")
    assert rows(tables.missing_vectors(df, cache, "m"), "chunk_key") == [("k2",)]


def test_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert tables.append_log(spark.createDataFrame([("2024-01-02T00:00:00", "cli", "q")], "ts string, src string, q string"), path)
    (tmp_path / "log" / "bad.json").write_text("{broken\n")
    got = tables.read_log(spark, path, "ts string, src string, q string", "2024-01-02", "cli")
    assert rows(got, "q") == [("q",)]


def test_rpc():
    rpc.tool("twice", topk="integer")(lambda topk: topk * 2)
    out = [json.loads(x) for x in rpc.serve(['{"id": 1, "method": "initialize"}', '{"method": "note"}', '{"id": 2, "method": "tools/call", "params": {"name": "twice", "arguments": {"topk": 99}}}', "oops", '{"id": 3, "method": "none"}', '{"id": 4, "method": "tools/call", "params": {"name": "twice"}}'])]
    assert out[0]["result"]["serverInfo"] and out[1]["result"] == {"ok": True, "result": 20}
    assert out[2]["error"]["code"] == -32700 and out[3]["error"]["code"] == -32601 and out[4]["result"]["ok"] is False


def test_policy_rules(spark, tmp_path):
    from attesta.operators.policy import load_rules

    p = tmp_path / "p.json"
    p.write_text(json.dumps({"rules": [{"prefix": "a/b", "scope": "stock", "purpose": "knowledge", "reason": "x"}]}))
    assert rows(load_rules(spark, str(p)), "rule_ord", "prefix", "scope") == [(0, "a/b", "stock")]
    p.write_text(json.dumps({"rules": [{"scope": "stock"}]}))
    with pytest.raises(ValueError):
        load_rules(spark, str(p))
