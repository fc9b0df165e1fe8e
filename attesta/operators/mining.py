"""Query logs and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUESTION = r"(?i)[?？]|^(what|why|how|when|where|which|who|is|are|does|can)\b|什么|怎么|为什么|如何|多少|哪"


def implicit_positives(searches: DataFrame, gets: DataFrame, seconds: int = 120) -> DataFrame:
    """(q, file, n): files opened within the time after a search that returned them, first search only counted once.

    ``searches`` (search_id, ts, q, files), ``gets`` (get_id, ts, file). The time is taken between
    rounded seconds. Both sides are keyed by file and a time bucket of the window's length, so the
    range join is an equi join on two buckets.
    """
    second = lambda c: F.rint(F.unix_micros(c.cast("timestamp")) / 1e6).cast("bigint")
    s = searches.select("search_id", F.col("ts").alias("s_ts"), "q", F.explode(F.array_distinct("files")).alias("file"))
    bucket = lambda c: F.floor(second(c) / seconds)
    s = s.withColumn("b", F.explode(F.array(bucket(F.col("s_ts")), bucket(F.col("s_ts")) + 1)))
    g = gets.select("get_id", F.col("ts").alias("g_ts"), "file").withColumn("b", bucket(F.col("g_ts")))
    joined = s.join(g, ["file", "b"]).where((F.col("g_ts") >= F.col("s_ts")) & (second(F.col("g_ts")) - second(F.col("s_ts")) <= seconds))
    first = joined.withColumn("n", F.row_number().over(Window.partitionBy("get_id").orderBy(F.desc("s_ts"), "search_id"))).where("n = 1")
    return first.select("search_id", "q", "file").distinct().groupBy("q", "file").agg(F.count(F.lit(1)).alias("n"))


def top_files(searches: DataFrame, k: int = 10) -> DataFrame:
    """Files most often ranked first."""
    first = searches.where(F.size("files") > 0).groupBy(F.element_at("files", 1).alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return first.orderBy(F.desc("n"), "file").limit(k)


def zero_hits(searches: DataFrame) -> DataFrame:
    return searches.where(F.size("files") == 0).groupBy("q").agg(F.count(F.lit(1)).alias("n"))


def turns(events: DataFrame, session: str = "session", seq: str = "seq") -> DataFrame:
    """Adds turn: number of user events so far, so that what follows belongs to the latest question."""
    w = Window.partitionBy(session).orderBy(seq)
    return events.withColumn("turn", F.sum((F.col("type") == "user").cast("bigint")).over(w))


def questions_with_reads(events: DataFrame) -> DataFrame:
    """(session, turn, q, files): each question and the distinct files read after it."""
    t = turns(events).where("turn > 0")
    return t.groupBy("session", "turn").agg(F.max(F.when(F.col("type") == "user", F.col("text"))).alias("q"), F.array_sort(F.collect_set("file")).alias("files"))


def candidates(mined: DataFrame, junk: str = r"(?i)^(ok|yes|no|continue|thanks)\b", procedural: str = r"(?i)(changelog|handoff|readme)") -> DataFrame:
    """Question-like turns of 6 to 60 characters that read exactly one ordinary file, once each."""
    ok = F.length("q").between(6, 60) & F.col("q").rlike(QUESTION) & ~F.col("q").rlike(junk) & (F.size("files") == 1) & ~F.element_at("files", 1).rlike(procedural)
    return mined.where(ok).select("q", F.element_at("files", 1).alias("file")).dropDuplicates(["q"])


def buckets(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("bucket", F.when(F.col("rank").isNull(), "miss").when(F.col("rank") <= 5, "easy").otherwise("hard"))
