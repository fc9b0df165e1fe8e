import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attesta.functions import tokens as batch
from attesta.operators import lexical


def plain(t):
    runs = re.findall("[一-鿿]+", t)
    return [x.lower() for x in re.findall(r"[A-Za-z0-9_./:\-]+", t)] + [p for r in runs for p in ([r] if len(r) == 1 else [r[i : i + 2] for i in range(len(r) - 1)])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ9_./:- \né中文字㐀豈😀", max_size=40)), max_size=12), st.integers(0, 3), st.sampled_from((1, 8, 64, 1 << 20)))
def test_batches_have_the_tokens_of_each_text(texts, skip, piece):
    got, before, batch.PIECE = {}, batch.PIECE, piece
    try:
        for a, b, terms, of in batch.tokens(pa.array(texts, pa.string()).slice(min(skip, len(texts)))):
            assert (of < b - a).all()
            for t, i in zip(terms.to_pylist(), of, strict=True):
                got.setdefault(a + i, Counter())[t] += 1
    finally:
        batch.PIECE = before
    assert got == {i: Counter(plain(t)) for i, t in enumerate(texts[skip:]) if t and plain(t)}


TEXTS = ["red fox red", "", None, "The FOX", "a.b red 中文字", "fox " * 300, "nothing", "red", "red", "fox red x fox", "\n", "文 red"]


@pytest.mark.parametrize("ids", ["unique", "text", "repeated"])
def test_scan_equals_joined_postings(spark, ids):
    """Documents without words or text, with ids of two kinds or of the same id, questions without hits, with repeats, twice."""
    name = {"unique": lambda i: i, "text": lambda i: f"d{i}", "repeated": lambda i: i // 2}[ids]
    docs = spark.createDataFrame([(name(i), t, "even" if i % 2 == 0 else None) for i, t in enumerate(TEXTS)], f"id {'string' if ids == 'text' else 'bigint'}, text string, side string").repartition(3)
    q = spark.createDataFrame([(1, "red fox"), (2, "red red"), (3, "absent"), (4, None), (5, "中文 the"), (6, "fox red")], "query_id bigint, q string")
    post, sizes = lexical.postings(docs, "id"), lexical.lengths(docs, "id")
    want = {r[:2]: r[2] for r in rows(lexical.bm25_scores(q, post, sizes), "query_id", "chunk_id", "score")}
    got = {r[:2]: r[2] for r in rows(lexical.bm25_scan(q, docs, "id"), "query_id", "chunk_id", "score")}
    assert want and got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)
    first = lexical.top_k(lexical.bm25_scores(q, post, sizes), 2)
    assert rows(lexical.bm25_scan(q, docs, "id", k=2), "query_id", "chunk_id", "rank") == rows(first, "query_id", "chunk_id", "rank")
    masked = lexical.top_k(lexical.bm25_scores(q, post, sizes).join(docs.where("side = 'even'").select(F.col("id").alias("chunk_id")), "chunk_id"), 2)
    assert rows(lexical.bm25_scan(q, docs, "id", k=2, only=F.col("side") == "even"), "query_id", "chunk_id", "rank") == rows(masked, "query_id", "chunk_id", "rank")
    if ids != "repeated":
        kept = {r[:2]: r[2] for r in rows(lexical.bm25_scan(q, docs, "id", keep=("side",)), "query_id", "chunk_id", "side")}
        assert kept == {x: dict((name(i), "even" if i % 2 == 0 else None) for i in range(len(TEXTS)))[x[1]] for x in want}
        assert rows(lexical.term_documents(docs)) == rows(lexical.document_frequency(post))
    some = spark.createDataFrame([("red",), ("red",), ("中文",), ("absent",)], "term string")
    assert rows(lexical.postings(docs, "id", unique=ids != "repeated", wanted=some), "chunk_id", "term", "tf") == rows(post.where("term IN ('red', '中文')"), "chunk_id", "term", "tf")
    assert rows(lexical.bm25_scan(q.limit(0), docs, "id")) == [] and rows(lexical.bm25_scan(q, docs.limit(0), "id", k=3)) == []


def test_tokens_are_counted_where_they_are_read(spark, sf):
    """Neither postings of unique ids nor the scan of query terms shuffles tokens."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(lexical.postings(docs, "doc_id", unique=True))
    q = spark.createDataFrame([(1, "the that")], "query_id bigint, q string")
    assert "Exchange" not in plan(lexical.bm25_scan(q, docs, "doc_id", unique=True))


def test_pieces_are_of_whole_rows(monkeypatch):
    monkeypatch.setattr(lexical, "PAIRS", 10)
    rng = np.random.default_rng(2)
    for _ in range(50):
        row, times = np.sort(rng.integers(0, 12, 30)), rng.integers(0, 9, 30)
        parts = list(lexical._pieces(row, times))
        assert [i for i, _ in parts] + [30] == [0] + [j for _, j in parts]
        for i, j in parts:
            assert j == 30 or row[j] != row[j - 1]
            assert times[i:j].sum() <= 10 or row[i] == row[j - 1]


def test_compounds_are_those_of_the_columns(spark):
    from attesta.functions import text

    texts = ["Café ＡＢＣ-１ x_y.z", "SYN-DL-88231-40117. pay 128,500.00, 1,234 and 12,34", "中文字 字 a中b", "straße Œuvre é 1́", "--- ./: a--b _a_", "", None, "1,000,000.5 a.b.a.bb.bb 9,999,99 ٣,٣٣٣"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = {i: (Counter([*(w or []), *(a or [])]), len(w or [])) for i, w, a in df.select("i", text.compound_tokens(F.col("t")), text.alternates(F.col("t"))).collect()}
    got = {i: Counter() for i in range(len(texts))}
    for a, b, terms, of, n in batch.compounds(pa.array(texts, pa.string())):
        for t, i in zip(terms.to_pylist(), of, strict=True):
            got[a + i][t] += 1
        assert [want[i][1] for i in range(a, b)] == list(n)
    assert got == {i: c for i, (c, _) in want.items()}
