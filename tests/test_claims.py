from helpers import rows
from pyspark.sql import functions as F

from attesta.functions import text
from attesta.operators import claims


def test_splits_are_those_of_split(spark):
    pattern = r"(?<=[!?])|\n+|(?<=[A-Za-z])\.\s+"
    texts = ["a. b! c", "", "!", "none", "a.\n\nb", "x￿y. z", "\n", " a. ", None, "1. 2"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    kept = lambda c: F.filter(c, lambda s: s != "")
    got = df.select("i", kept(text.split_at(F.col("t"), pattern)).alias("a"), kept(F.split("t", pattern)).alias("b"))
    assert all(a == b for _, a, b in rows(got)) and got.where("b IS NOT NULL").count() == 9


def test_facts_meet_their_question_once(spark):
    """Facts without sentences, repeated facts, facts in unclean sentences only; the facts are read once."""
    facts = [(1, 1, [["cost"]]), (1, 2, [["late", "never"]]), (1, 2, [["cost"], ["euro"]]), (2, 1, [["cost"]]), (3, 1, [["cost"]]), (3, 2, None)]
    said = [(1, "It  COST much", []), (1, "late", ["x"]), (3, "cost", []), (9, "cost", [])]
    f = spark.createDataFrame(facts, "question_id bigint, fact_id bigint, claim_terms array<array<string>>")
    got = claims.grade(f, spark.createDataFrame(said, "question_id bigint, text string, problems array<string>"))
    assert rows(got, "question_id", "matched", "facts", "grounded") == [(1, 3, 3, False), (2, 0, 1, False), (3, 1, 2, False)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_quotes_are_read_once_a_claim(spark):
    """What quotes hold is found below the sentences' Generate; outcomes and dates only where the texts have any."""
    c = spark.createDataFrame([(1, "We bought 5. It was never filled on 7/9.")], "claim_id bigint, text string")
    q = spark.createDataFrame([(1, "e", "we bought 5 on 7/9")], "claim_id bigint, evidence_id string, quote string")
    x = spark.createDataFrame([("e", "we bought 5 on 7/9")], "evidence_id string, text string")
    got = claims.check_answers(c, q, x)
    assert rows(got, "sentence", "problems") == [(0, ["outcome_unproven"])]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "quoted#" not in plan.split("Generate")[0]
