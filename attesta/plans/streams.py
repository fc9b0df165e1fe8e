"""Streaming queries run to the end of their input, so that they can be checked like batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..streaming import incremental
from .registry import query, table


def _stream(spark, d: str, name: str):
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parquet*")


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@query("J06_stream_upsert", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def _(spark, d):
    base = _folder(spark)
    rows = _stream(spark, d, "events").select("user_id", "event_id", "event_type")
    incremental.upsert_latest(rows, f"{base}/state", f"{base}/checkpoint", ["user_id"], ["event_id"]).awaitTermination()
    return incremental.read_latest(spark, f"{base}/state")


@query("J07_stream_search_get", None)
def _(spark, d):
    base = _folder(spark)
    e, u = _stream(spark, d, "events"), F.col("user_id")
    s = e.where("event_id % 2 = 0").select(F.col("event_id").alias("search_id"), "ts", F.array(F.concat(F.lit("f"), u % 50), F.concat(F.lit("f"), (u + 1) % 50)).alias("files"))
    g = _stream(spark, d, "events").where("event_id % 2 = 1").select(F.col("event_id").alias("get_id"), "ts", F.concat(F.lit("f"), u % 50).alias("file"))
    out = incremental.search_get_pairs(s, g)
    out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@query("J01_incremental_postings", "SELECT md5(text) AS key, count(*) AS n FROM (SELECT text, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_./:\\-]+'), lambda x: lower(x)))) AS t FROM (SELECT DISTINCT text FROM documents)) GROUP BY 1")
def _(spark, d):
    """An index whose cache holds half of the texts and some that are gone, brought up to date."""
    from ..operators import lexical

    docs = table(spark, d, "documents").select(F.md5("text").alias("key"), "text").distinct()
    old = docs.where("key < '8'").unionByName(docs.where("key < '1'").select(F.concat(F.lit("gone"), "key").alias("key"), "text"))
    cached = lexical.postings(old, "key").withColumnRenamed("chunk_id", "key")
    new, kept = incremental.refresh_postings(docs, cached)
    return new.unionByName(kept).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("J10_sessions", None)
def _(spark, d):
    return incremental.sessions(table(spark, d, "events"))
