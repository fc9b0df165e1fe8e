"""Sentence-level checks of answers against their citations."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

_ACTIONS = (*"跌破 突破 买入 成交 到位 触发".split(), "broke", "bought", "filled", "triggered")


def outcomes(col):
    """Distinct "action:polarity" of factual fragments, uncertain ones left out. Texts without an action aren't taken apart."""
    found = F.transform(text.factual_fragments(col), lambda f: F.filter(F.transform(F.array(*map(F.lit, _ACTIONS)), lambda a: F.when(F.contains(f, a) & ~f.rlike(r"不能|无法|不确定|是否|不知|\b(?:cannot|unclear|whether)\b"), F.concat(a, F.lit(":"), F.when(f.rlike(r"未|没|\b(?:not|never)\b"), "no").otherwise("yes")))), lambda x: x.isNotNull()))
    some = reduce(or_, (F.contains(col, F.lit(a)) for a in _ACTIONS))
    return F.when(~some, F.array().cast("array<string>")).otherwise(F.array_distinct(F.flatten(found)))


def day_texts(col):
    """Dates as texts; a text without a day's mark after a digit has none."""
    return F.when(~col.rlike(r"\d[-/月]"), F.array().cast("array<string>")).otherwise(F.transform(text.dates(col), text.date_text))


def check_answers(claims: DataFrame, citations: DataFrame, contexts: DataFrame) -> DataFrame:
    """(claim_id, sentence, problems): one row per sentence of each claim.

    ``claims`` (claim_id, text), ``citations`` (claim_id, evidence_id, quote), ``contexts``
    (evidence_id, text). A quote counts if it has four characters or more after normalisation and
    stands in its own context. Sentences may use their claim's valid quotes only: numbers, dates and
    outcomes that no quote has are problems. No problems don't prove a sentence.
    """
    c = citations.join(contexts.select("evidence_id", F.col("text").alias("context")), "evidence_id", "left")
    quote = text.normal(F.col("quote"))
    ok = (F.length(quote) >= 4) & F.coalesce(F.contains(text.normal(F.col("context")), quote), F.lit(False))
    per = c.withColumn("ok", ok).groupBy("claim_id").agg(F.bool_or(~F.col("ok")).alias("bad"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("ok"), F.col("quote")))), "\n").alias("quoted"))
    # what the quotes hold is found once a claim, not once a sentence
    quoted = F.coalesce("quoted", F.lit(""))
    held = claims.join(per, "claim_id", "left").select("claim_id", "text", F.coalesce("bad", F.lit(False)).alias("bad"), text.numbers(quoted).alias("numbers"), day_texts(quoted).alias("dates"), outcomes(quoted).alias("outcomes"))
    rows = held.select("claim_id", "bad", "numbers", "dates", "outcomes", F.posexplode(text.sentences(F.col("text"))).alias("sentence", "s"))
    problems = F.array_compact(F.array(
        F.when(F.col("bad"), "invalid_quote"),
        F.when(F.size(F.array_except(text.numbers(F.col("s")), F.col("numbers"))) > 0, "number_not_quoted"),
        F.when(F.size(F.array_except(day_texts(F.col("s")), F.col("dates"))) > 0, "date_not_quoted"),
        F.when(F.size(F.array_except(outcomes(F.col("s")), F.col("outcomes"))) > 0, "outcome_unproven"),
    ))
    return rows.select("claim_id", "sentence", F.col("s").alias("text"), problems.alias("problems"))


def grade(facts: DataFrame, checked: DataFrame) -> DataFrame:
    """(question_id, matched, facts, grounded): facts whose terms one clean sentence holds."""
    norm = text.collapsed(F.col("text"))
    # a question's sentences meet its facts as one row; all steps are keyed by the question
    said = checked.groupBy("question_id").agg(F.collect_list(F.struct(norm.alias("norm"), (F.size("problems") == 0).alias("clean"))).alias("said"))
    hits = F.filter(F.coalesce("said", F.array().cast("array<struct<norm:string,clean:boolean>>")), lambda s: text.contains_terms(s["norm"], F.col("claim_terms")))
    each = facts.join(said, "question_id", "left").select("question_id", "fact_id", hits.alias("hits"))
    each = each.select("question_id", "fact_id", (F.size("hits") > 0).alias("hit"), F.exists("hits", lambda s: s["clean"]).alias("clean"))
    per = each.groupBy("question_id", "fact_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("hit").alias("hit"), F.bool_or("clean").alias("clean"))
    return per.groupBy("question_id").agg(F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("matched"), F.sum("n").alias("facts"), F.bool_and("clean").alias("grounded"))


def review_reasons(question, context, purpose):
    """Reasons to look again before answering: years asked for but absent, status, roles, drafts."""
    return F.array_compact(F.array(
        F.when(F.size(F.array_except(text.years(question), text.years(context))) > 0, "missing_year"),
        F.when(question.rlike(r"(?i)\b(current|now|latest|today)\b|现在|目前|最新"), "current_status"),
        F.when(question.rlike(r"(?i)\b(my role|position|appointed)\b|职位|任命"), "role"),
        F.when(question.rlike(r"(?i)\b(birth ?date|born)\b|生日|出生"), "birth_date"),
        F.when(purpose == "draft", "draft_source"),
    ))
