import math

import pytest
from helpers import rows
from pyspark.sql import functions as F

from attesta.engine import Engine
from attesta.operators import dense, evaluation, fusion, journal, lexical

NOTES = [(1, "case", "a.md", "h", "the quick brown fox", "knowledge"), (2, "case", "b.md", "h", "lazy dogs and foxes", "knowledge"), (3, "case", "c.md", "h", "quick quick quick", "evaluation"), (4, "stock", "d.md", "h", "quick market", "knowledge")]
SCHEMA = "chunk_id bigint, source string, file string, heading string, body string, purpose string"


def notes(spark, extra=()):
    return spark.createDataFrame([*NOTES, *extra], SCHEMA)


def asked(spark, *q):
    return spark.createDataFrame(list(enumerate(q)), "query_id bigint, q string")


def test_other_sources_do_not_move_scores(spark):
    more = [(100 + i, "stock", f"s{i}.md", "h", "quick " * 5, "knowledge") for i in range(20)]
    a = Engine(spark, notes(spark)).search(asked(spark, "quick fox"), "bm25", sources=["case"])
    b = Engine(spark, notes(spark, more)).search(asked(spark, "quick fox"), "bm25", sources=["case"])
    assert rows(a, "chunk_id", "score") == rows(b, "chunk_id", "score")


def test_evaluation_material_is_hidden_but_counted(spark):
    e = Engine(spark, notes(spark))
    assert 3 not in {r[0] for r in rows(e.search(asked(spark, "quick"), "bm25", sources=["case"]), "chunk_id")}
    assert 3 in {r[0] for r in rows(e.search(asked(spark, "quick"), "bm25", sources=["case"], include_evaluation=True), "chunk_id")}


def test_fallback_is_labelled(spark):
    got = Engine(spark, notes(spark)).search(asked(spark, "quick"), "hybrid", sources=["case"])
    assert {r[0] for r in rows(got, "mode")} == {"bm25(fallback)"}


def test_repeated_query_terms_count(spark):
    post, sizes = lexical.postings(notes(spark), "chunk_id", "body"), lexical.lengths(notes(spark), "chunk_id", "body")
    once = dict(rows(lexical.bm25_scores(asked(spark, "fox"), post, sizes), "chunk_id", "score"))
    twice = dict(rows(lexical.bm25_scores(asked(spark, "fox fox"), post, sizes), "chunk_id", "score"))
    assert all(abs(twice[k] - 2 * once[k]) < 1e-9 for k in once)


def test_vector_mask_comes_before_the_cut(spark):
    v = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(10)], "vec_id bigint, embedding array<float>")
    got = dense.vector_search(v.where("vec_id = 0"), v, 2, allowed=v.where("vec_id >= 5").select("vec_id"))
    assert rows(got, "vec_id", "rank") == [(5, 0), (6, 1)]
    assert rows(dense.vector_search(v.where("vec_id < 0"), v, 2)) == []


def test_gate_levels(spark):
    legs = spark.createDataFrame([(1, "bm25", 9.0), (1, "vec", 0.1), (2, "bm25", 1.0), (3, "other", 1.0)], "query_id bigint, leg string, score double")
    assert rows(fusion.gate(legs, {"bm25": 8.0, "vec": 0.4})) == [(1, "medium"), (2, "low"), (3, "high")]


def test_full_rank_ties_go_to_body_then_id(spark):
    legs = spark.createDataFrame([(1, "a", "u", 7, 0, False), (1, "a", "u", 9, 1, True), (1, "b", "u", 8, 1, True)], "query_id bigint, leg string, unit string, chunk_id bigint, rank bigint, body boolean")
    assert rows(fusion.rrf_units(legs), "unit", "chunk_id") == [("u", 8)]


def test_keep_first_lists_aliases(spark):
    d = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("k", 3, "c"), ("z", 4, "d")], "key string, n int, alias string")
    assert rows(journal.keep_first(d, ["key"], "n", "alias"), "key", "alias", "duplicate_sources") == [("k", "a", ["b", "c"]), ("z", "d", [])]


def test_fingerprint_ignores_order_not_content(spark):
    d = spark.range(50).withColumn("x", F.col("id") % 7)
    a, b, c = (journal.fingerprint(x, ["id", "x"]).first() for x in (d, d.repartition(5), d.withColumn("x", F.col("x") + 1)))
    assert a == b != c
    assert journal.fingerprint(d.limit(0), ["id", "x"]).first()["rows"] == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    post, sizes = lexical.postings(none, "chunk_id", "body"), lexical.lengths(none, "chunk_id", "body")
    assert rows(lexical.bm25_search(asked(spark, "x"), post, sizes)) == []
    graded = spark.createDataFrame([], "positive boolean, rank bigint, confidence string, fallback boolean, ms double")
    assert evaluation.summary(graded).first()["questions"] == 0


def test_evidence_gives_whole_short_files(spark):
    e = Engine(spark, notes(spark))
    q = spark.createDataFrame([(1, "fox", "a.md")], "query_id bigint, q string, file string")
    assert rows(e.evidence(q), "file", "body") == [("a.md", "the quick brown fox")]
    long = [(50 + i, "case", "long.md", "h", f"part {i} " + ("needle " if i == 6 else "hay ") * 300, "knowledge") for i in range(12)]
    q = spark.createDataFrame([(1, "needle", "long.md")], "query_id bigint, q string, file string")
    got = rows(Engine(spark, notes(spark, long)).evidence(q, 6000, 2), "ordinal")
    assert (6,) in got and len(got) == 3


def test_postings_search_equals_full_scan(spark, sf):
    """The broadcast-pruned plan against scores summed over all postings."""
    from attesta.functions import numeric

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    post, sizes = lexical.postings(docs, "doc_id"), lexical.lengths(docs, "doc_id")
    q = asked(spark, "the that with", "der die")
    fast = {(a, b): s for a, b, s in rows(lexical.bm25_scores(q, post, sizes), "query_id", "chunk_id", "score")}
    stats = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("m"))
    full = post.join(lexical.document_frequency(post), "term").join(sizes, "chunk_id").crossJoin(stats).join(lexical.query_terms(q), "term")
    w = F.col("times") * numeric.bm25_weight(numeric.idf(F.col("n"), F.col("df")), F.col("tf"), F.col("length"), F.col("m"))
    slow = {(a, b): s for a, b, s in rows(full.groupBy("query_id", "chunk_id").agg(F.sum(w).alias("s")))}
    assert fast.keys() == slow.keys() and all(abs(fast[k] - slow[k]) < 1e-9 for k in fast)


def test_reranker_sees_whole_chunks(spark):
    from attesta.engine import Engine

    class Answers:
        def score(self, pairs):
            seen = F.contains("window", F.lit("answer")) & F.startswith("window", F.lit("f\nh"))
            return pairs.select("query_id", "unit", F.when(seen, 0.9).otherwise(0.01).alias("score"))

    late = "apple " + "filler " * 120 + "answer"
    chunks = spark.createDataFrame([(1, "case", "f", "h", late, None), (2, "case", "g", "h", "apple other", None)], "chunk_id bigint, source string, file string, heading string, body string, purpose string")
    queries = spark.createDataFrame([(1, "apple")], "query_id bigint, q string")
    got = Engine(spark, chunks, reranker=Answers()).search(queries, "bm25", drop_low=True).select("file", "level").collect()
    assert {tuple(r) for r in got} == {("f", "high"), ("g", "high")}


def test_evidence_of_all_documents(spark, sf):
    """Short documents whole, of long ones the five best passages and the neighbours of the best two, by brute force."""
    import collections
    import math
    import re

    from attesta.plans.more import evidence_of

    tokens = lambda t: [x.lower() for x in re.findall(r"[A-Za-z0-9_./:\-]+", t)] + [p for r in re.findall("[一-鿿]+", t) for p in ([r] if len(r) == 1 else [r[i : i + 2] for i in range(len(r) - 1)])]
    want, long = set(), 0
    for i, t in rows(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text"):
        parts = [t] if len(t) <= 1500 else [t[k * 1350 : k * 1350 + 1500] for k in range((len(t) - 1) // 1350 + 1)]
        if sum(map(len, parts)) <= 12_000:
            want |= {(i, k, len(p)) for k, p in enumerate(parts)}
            continue
        long += 1
        asked = collections.Counter(tokens(t[:80]))
        scores = {k: sum(n * math.log1p(c[w]) for w, n in asked.items()) for k, c in enumerate(map(collections.Counter, map(tokens, parts)))}
        best = sorted((k for k, s in scores.items() if s > 0), key=lambda k: (-round(scores[k], 9), k))[:5]
        order = best + sorted({n for k in best[:2] for n in (k - 1, k + 1) if 0 <= n < len(parts)} - set(best))
        size = 0
        for k in order:
            size += len(parts[k])
            if size > 12_000:
                break
            want.add((i, k, len(parts[k])))
    assert long and set(rows(evidence_of(spark, sf, 1).select("query_id", "ordinal", F.length("body").alias("n")), "query_id", "ordinal", "n")) == want


def test_nearest_rank(spark):
    import math

    from attesta.operators import evaluation

    df = spark.createDataFrame([(g, float(v)) for g in range(3) for v in range(1, 8 + g)] + [(0, None)], "g int, ms double")
    for share in (0.5, 0.95, 1.0):
        got = dict(rows(evaluation.nearest_rank(df, "ms", share, ["g"]), "g", "quantile"))
        assert got == {g: math.ceil(share * (7 + g)) for g in range(3)}


def test_headings_that_begin_alike(spark):
    from attesta.engine import Engine

    c = spark.createDataFrame([("1", "case", "f", "Intro", "a", None), ("2", "case", "f", "Intro two", "b", None), ("3", "case", "f", "Other", "c", None), ("4", "case", "f", "Otter", "d", None)], "chunk_id string, source string, file string, heading string, body string, purpose string")
    e = Engine(spark, c)
    assert [rows(e.get("f", h), "chunk_id") for h in ("Intro", "Intro t", "Ot", "None")] == [[("1",)], [("2",)], [], []]


def test_evidence_carries_bodies_once(spark):
    """Bodies are joined with the passages chosen; no window or aggregate before that sees them. The overlap counts repeats."""
    long = [(50 + i, "case", "long.md", "h", f"part {i} " + ("needle " if i == 6 else "hay ") * 300, "knowledge") for i in range(12)]
    q = spark.createDataFrame([(1, "needle part 6", "long.md"), (2, "fox", "a.md"), (2, "dogs", "b.md"), (3, "absent", "long.md")], "query_id bigint, q string, file string")
    got = Engine(spark, notes(spark, long)).evidence(q, 6000, 2)
    assert {(1, "long.md", 6), (2, "a.md", 0), (2, "b.md", 0)} <= set(rows(got, "query_id", "file", "ordinal")) and not got.where("query_id = 3").count()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if ("Window [" in line or "Aggregate [" in line) and "body#" in line]
    pairs = spark.createDataFrame([("a b a", "x a A b"), ("a", "none"), (None, "a"), ("a", None), ("字中", "字中 字中")], "q string, text string")
    want = [2 * math.log1p(2) + math.log1p(1), 0, 0, 0, math.log1p(2)]
    assert sorted(r[0] for r in rows(lexical.overlap_scores(pairs), "score")) == pytest.approx(sorted(want))
