"""Labels, grading, summaries and paired comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def contaminated_chunks(questions: DataFrame, chunks: DataFrame, least: int = 12) -> DataFrame:
    """(question_id, chunk_id): chunks that hold a question of ``least`` characters or more.

    Questions are the stated query set. They are joined by a word they share with the chunk (their
    longest, which is rare) before the exact containment test, so no cross product is formed.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    longest = F.expr("array_max(transform(ws, w -> struct(length(w) AS n, w AS w))).w")
    q = questions.where(F.length("q") >= least).withColumn("ws", words(F.col("q")))
    # the first and last words may be cut inside the chunk's words; take inner ones where there are any
    inner = F.when(F.size("ws") > 2, F.slice("ws", 2, F.size("ws") - 2)).otherwise(F.col("ws"))
    q = q.withColumn("ws", inner).select("question_id", "q", longest.alias("w"))
    keyed = chunks.select("chunk_id", "text", F.explode(words(F.col("text"))).alias("w"))
    return keyed.join(F.broadcast(q) if q.limit(100_001).count() <= 100_000 else q, "w").where(F.contains(F.lower("text"), F.lower("q"))).select("question_id", "chunk_id").distinct()


def label_problems(questions: DataFrame) -> DataFrame:
    """(case_group, problem): groups split over several splits, questions without expectation."""
    split = questions.groupBy("case_group").agg(F.countDistinct("split").alias("n")).where("n > 1").select("case_group", F.lit("split_leak").alias("problem"))
    empty = questions.where(F.col("expect").isNull() & F.col("positive")).select("case_group", F.lit("no_expectation").alias("problem"))
    return split.unionByName(empty).distinct()


def document_ranks(hits: DataFrame) -> DataFrame:
    """Adds doc_rank: 1-based rank among distinct files, by first appearance."""
    first = F.min("rank").over(Window.partitionBy("question_id", "file"))
    return hits.withColumn("first", first).withColumn("doc_rank", F.dense_rank().over(Window.partitionBy("question_id").orderBy("first"))).drop("first")


def first_relevant(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """(question_id, rank): 1-based document rank of the first expected file (with its page interval), null if none."""
    ranked = document_ranks(hits)
    page = F.col("page_lo").isNull() | F.col("page").between(F.col("page_lo"), F.col("page_hi"))
    hit = ranked.join(expected, ["question_id", "file"]).where(page)
    best = hit.groupBy("question_id").agg(F.min("doc_rank").cast("bigint").alias("rank"))
    return expected.select("question_id").distinct().join(best, "question_id", "left")


def group_ranks(matches: DataFrame, groups: DataFrame) -> DataFrame:
    """(question_id, evidence_rank): the last of the groups' first ranks, null unless all are found."""
    best = groups.join(matches.groupBy("question_id", "grp").agg(F.min("rank").alias("rank")), ["question_id", "grp"], "left")
    return best.groupBy("question_id").agg(F.when(F.count("rank") == F.count(F.lit(1)), F.max("rank")).alias("evidence_rank"))


def summary(graded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """hits at 1 and 5, MRR at 10, confidence counts, fallbacks and mean time."""
    positive, rank = F.col("positive"), F.col("rank")
    out = graded.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("questions"), F.count_if(positive).alias("positives"), F.count_if(positive & (rank <= 1)).alias("hit_1"), F.count_if(positive & (rank <= 5)).alias("hit_5"),
        F.coalesce(F.sum(F.when(positive & (rank <= 10), 1 / rank)), F.lit(0.0)).alias("rr"),
        F.count_if(F.col("confidence") == "high").alias("high"), F.count_if(F.col("confidence") == "low").alias("low"), F.count_if("fallback").alias("fallbacks"), F.avg("ms").alias("mean_ms"),
    )
    return out.select(*(by or []), "questions", "positives", "hit_1", "hit_5", F.round(F.col("rr") / F.greatest(F.col("positives"), F.lit(1)), 6).alias("mrr_10"), "high", "low", "fallbacks", F.round("mean_ms", 3).alias("mean_ms"))


def nearest_rank(df: DataFrame, value: str, share: float, by: list[str] | None = None) -> DataFrame:
    """The ceil(share * n)-th smallest value of each group, from counts of its distinct values that tasks
    make before the shuffle, without sorting rows."""
    rank = F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY `{value}`)").alias("quantile")
    rows = df.where(F.col(value).isNotNull())
    return rows.groupBy(*by).agg(rank) if by else rows.agg(rank).where("quantile IS NOT NULL")


def latency(df: DataFrame, value: str = "ms", by: list[str] | None = None) -> DataFrame:
    """(p50, p95): exact median, nearest-rank 95th percentile."""
    keys = by or []
    out = df.groupBy(*keys).agg(F.percentile(value, 0.5).alias("p50"), F.count(F.lit(1)).alias("n"))
    high = nearest_rank(df, value, 0.95, by)
    joined = out.join(high, keys) if keys else out.crossJoin(high)
    return joined.select(*keys, "n", "p50", F.col("quantile").alias("p95"))


def calibrate(scores: DataFrame, grid: DataFrame) -> DataFrame:
    """Adds to every (hi, lo) of the grid what it does to labelled scores, and whether it's feasible.

    Scores are first counted by value, so the grid meets distinct values only.
    """
    counted = scores.groupBy("score", "positive").agg(F.count(F.lit(1)).alias("n"))
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    pos = F.col("positive")
    out = grid.crossJoin(F.broadcast(counted)).groupBy("hi", "lo").agg(n(pos & (F.col("score") >= F.col("hi"))).alias("pos_high"), n(pos & (F.col("score") < F.col("lo"))).alias("pos_low"), n(~pos & (F.col("score") >= F.col("hi"))).alias("neg_high"), n(~pos & (F.col("score") < F.col("lo"))).alias("neg_low"))
    return out.withColumn("feasible", (F.col("neg_high") == 0) & (F.col("pos_low") == 0))


def paired(before: DataFrame, after: DataFrame, k: int = 5) -> DataFrame:
    """gains, regressions and groups won whole, over questions that both runs have."""
    both = before.select("question_id", "case_group", F.coalesce(F.col("rank") <= k, F.lit(False)).alias("a")).join(after.select("question_id", F.coalesce(F.col("rank") <= k, F.lit(False)).alias("b")), "question_id")
    groups = both.groupBy("case_group").agg(F.count_if(~F.col("a") & F.col("b")).alias("gains"), F.count_if(F.col("a") & ~F.col("b")).alias("regressions"), F.bool_and("b").alias("whole"), F.count(F.lit(1)).alias("n"))
    return groups.agg(F.sum("n").alias("questions"), F.sum("gains").alias("gains"), F.sum("regressions").alias("regressions"), F.count_if("whole").alias("complete_groups"), F.count(F.lit(1)).alias("groups"))


def unmatched(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids that only one of the runs has; empty where they can be compared."""
    a, b = before.select("question_id", F.lit(1).alias("a")), after.select("question_id", F.lit(1).alias("b"))
    return a.join(b, "question_id", "full").where("a IS NULL OR b IS NULL").select("question_id")


def ranks_matrix(ranks: DataFrame, modes: list[str]) -> DataFrame:
    """One row per question with its first rank under each mode."""
    return ranks.groupBy("question_id").pivot("mode", modes).agg(F.min("rank"))


def overlapping_units(units: DataFrame) -> DataFrame:
    """Pairs of questions in different splits whose source units overlap: same file, source equal or ``*``, pages meet."""
    a, b = units.alias("a"), units.alias("b")
    pages = F.col("a.lo").isNull() | F.col("b.lo").isNull() | (F.greatest("a.lo", "b.lo") <= F.least("a.hi", "b.hi"))
    source = (F.col("a.source") == F.col("b.source")) | (F.col("a.source") == "*") | (F.col("b.source") == "*")
    cond = (F.col("a.file") == F.col("b.file")) & (F.col("a.question_id") < F.col("b.question_id")) & (F.col("a.split") != F.col("b.split")) & source & pages
    return a.join(b, cond).select(F.col("a.question_id").alias("left_id"), F.col("b.question_id").alias("right_id"), F.col("a.file").alias("file")).distinct()


def passage_match(evidence: DataFrame, chunks: DataFrame, norm: Column) -> DataFrame:
    """(label_id, chunk_id): same source and file, heading contained, every fact in one of its forms present."""
    from ..functions.text import contains_terms

    c = chunks.withColumn("norm", norm)
    hit = evidence.join(c, ["source", "file"]).where(F.coalesce(F.contains("heading", "heading_contains"), F.lit(True)))
    return hit.where(contains_terms(F.col("norm"), F.col("required_text"))).select("label_id", "chunk_id")


def context_budget(passages: DataFrame, total: int = 18000, each: int = 6000) -> DataFrame:
    """Adds used: characters granted in order, ``each`` per passage at most, until ``total`` is spent."""
    want = F.least(F.length("text"), F.lit(each))
    before = F.coalesce(F.sum(want).over(Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return passages.withColumn("used", F.greatest(F.lit(0), F.least(want, total - before)).cast("bigint"))


def take_until(passages: DataFrame, budget: int = 12000, size: Column | None = None) -> DataFrame:
    """Passages in order until the first that would exceed the budget; none after it. A passage takes the length of
    its text unless ``size`` is given."""
    w = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return passages.withColumn("sum", F.sum(F.length("text") if size is None else size).over(w)).where(F.col("sum") <= budget).drop("sum")


def neighbours(best: DataFrame, passages: DataFrame, reach: int = 1) -> DataFrame:
    """Passages up to ``reach`` places from the given ones of the same document."""
    near = best.select("doc_id", F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda d: F.col("ordinal") + d)).alias("ordinal")).distinct()
    return passages.join(near, ["doc_id", "ordinal"], "left_semi")
