"""Structured Streaming: index upkeep, latest state by key, and searches followed by reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window


def upsert_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Keeps the newest row per key of an append log in a Parquet table of numbered generations.

    Each micro-batch writes generation n from n-1 and the batch and then names it in a pointer, so
    a batch that is run again after a failure rewrites the same generation.
    """
    spark = stream.sparkSession
    schema = stream.schema

    def merge(batch: DataFrame, number: int) -> None:
        old = spark.read.schema(schema).parquet(f"{path}/g{number - 1}") if number else spark.createDataFrame([], schema)
        newest = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
        merged = old.unionByName(batch).withColumn("n_", F.row_number().over(newest)).where("n_ = 1").drop("n_")
        merged.write.mode("overwrite").parquet(f"{path}/g{number}")
        spark.createDataFrame([(number,)], "generation bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/current")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    number = spark.read.parquet(f"{path}/current").first()[0]
    return spark.read.parquet(f"{path}/g{number}")


def refresh_postings(chunks: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new postings, kept postings): only chunks whose key the cache lacks are tokenised; keys no longer live go."""
    from ..operators.lexical import postings

    missing = chunks.join(cached.select("key").distinct(), "key", "left_anti")
    new = postings(missing, "key")
    kept = cached.join(chunks.select("key"), "key", "left_semi")
    return new.withColumnRenamed("chunk_id", "key"), kept


def search_get_pairs(searches: DataFrame, gets: DataFrame, seconds: int = 120) -> DataFrame:
    """(search_id, get_id, file): reads up to ``seconds`` after a search that returned the file.

    Works on batches and, with the watermarks it sets, on streams: both sides' state is bounded by
    the window. Both are keyed by file and a time bucket of the window's length; a read stands in its
    own bucket and the one before, so it meets searches of two buckets and not all of its file.
    """
    bucket = lambda c: F.floor(F.unix_seconds(c) / seconds)
    s = searches.select("search_id", F.col("ts").cast("timestamp").alias("s_ts"), "files")
    g = gets.select("get_id", F.col("ts").cast("timestamp").alias("g_ts"), F.col("file").alias("g_file"))
    if s.isStreaming:
        s, g = s.withWatermark("s_ts", "10 minutes"), g.withWatermark("g_ts", "10 minutes")
    s = s.select("search_id", "s_ts", bucket(F.col("s_ts")).alias("s_bucket"), F.explode("files").alias("file"))
    g = g.select("get_id", "g_ts", "g_file", F.explode(F.array(bucket(F.col("g_ts")), bucket(F.col("g_ts")) - 1)).alias("g_bucket"))
    return s.join(g, F.expr(f"file = g_file AND s_bucket = g_bucket AND g_ts >= s_ts AND g_ts <= s_ts + INTERVAL {seconds} SECONDS")).select("search_id", "get_id", "file")


def count_search_get_pairs(searches: DataFrame, gets: DataFrame, seconds: int = 120) -> DataFrame:
    """(pairs): how many rows ``search_get_pairs`` has, without making them.

    A search's reads are those up to the end of its window less those before it, so both ends and
    the reads are put in order once and the reads counted along. Windows are of one file and
    ``seconds`` * 30 of time, with the reads that follow in the next ``seconds``.
    """
    width, span = seconds * 1_000_000, seconds * 30_000_000
    s = searches.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.explode("files").alias("file"))
    g = gets.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "file")
    into = F.pmod(F.col("at"), F.lit(span))
    point = lambda at, place, step: F.struct(at.alias("at"), F.lit(place).alias("place"), F.lit(step).alias("step"))
    ends = s.select("file", (F.col("at") - into).alias("begin"), F.explode(F.array(point(F.col("at"), 0, -1), point(F.col("at") + width, 2, 1))).alias("p"))
    begins = F.when(into <= width, F.array(F.col("at") - into, F.col("at") - into - span)).otherwise(F.array(F.col("at") - into))
    reads = g.select("file", F.explode(begins).alias("begin"), point(F.col("at"), 1, 0).alias("p"))
    along = Window.partitionBy("file", "begin").orderBy("p.at", "p.place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    points = ends.unionByName(reads).where("file IS NOT NULL AND begin IS NOT NULL")
    counted = points.select("p.step", F.sum((F.col("p.place") == 1).cast("bigint")).over(along).alias("n"))
    return counted.agg(F.coalesce(F.sum(F.col("step") * F.col("n")), F.lit(0)).cast("bigint").alias("pairs"))


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """(user_id, started, n): activity sessions; open ones are withheld on streams until the watermark passes."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    e = e.withWatermark("at", watermark) if e.isStreaming else e
    out = e.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("started"), "n")
