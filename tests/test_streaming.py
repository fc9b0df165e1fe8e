from helpers import rows

from attesta.streaming import incremental


def test_upsert_keeps_newest_over_several_batches(spark, tmp_path):
    source = tmp_path / "in"
    schema = "k int, seq int, v string"
    for i, batch in enumerate(([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c"), (3, 1, "d")], [(1, 1, "old")])):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        incremental.upsert_latest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], ["seq"]).awaitTermination()
    assert rows(incremental.read_latest(spark, str(tmp_path / "out"))) == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")]


def test_sessions(spark):
    from pyspark.sql import functions as F

    e = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00")], "user_id int, t string").select("user_id", F.col("t").cast("timestamp_ntz").alias("ts"))
    assert rows(incremental.sessions(e), "n") == [(1,), (2,)]


def test_incremental_equals_full(spark):
    from attesta.operators import lexical

    old = spark.createDataFrame([("a", "x y"), ("b", "y z")], "key string, text string")
    new = spark.createDataFrame([("b", "y z"), ("c", "z z")], "key string, text string")
    cached = lexical.postings(old, "key").withColumnRenamed("chunk_id", "key")
    fresh, kept = incremental.refresh_postings(new, cached)
    assert rows(fresh.unionByName(kept), "key", "term", "tf") == rows(lexical.postings(new, "key"), "chunk_id", "term", "tf")


def log_rows(spark, start=0):
    """Searches and reads at ends of windows and of buckets, with ties, fractions, times before 1970 and nothing."""
    from pyspark.sql import functions as F

    at = (-7200.0, -3600.5, -1.0, 0.0, 0.0, 119.999999, 120.0, 120.000001, 240.0, 3479.5, 3480.0, 3599.999999, 3600.0, 3600.0, 3720.0, 3720.000001, 7199.0, 7320.0)
    ts = F.timestamp_micros(F.round((F.col("at") + start) * 1_000_000).cast("bigint")).cast("timestamp_ntz").alias("ts")
    s = [(i, t, f) for i, t in enumerate(at) for f in (["a", "b"], ["a"], [], None)] + [(99, None, ["a"])]
    g = [(i, t, f) for i, t in enumerate(at) for f in ("a", "b", "c", None)] + [(99, None, "a")]
    searches = spark.createDataFrame(s, "search_id bigint, at double, files array<string>").select("search_id", ts, "files")
    gets = spark.createDataFrame(g, "get_id bigint, at double, file string").select("get_id", ts, "file")
    want = [(i, j, f) for i, t, files in s for f in files or () for j, u, h in g if f == h and t is not None and u is not None and 0 <= round((u - t) * 1e6) <= 120_000_000]
    return searches, gets, sorted(want, key=repr)


def test_pairs_at_ends_of_windows(spark):
    searches, gets, want = log_rows(spark)
    assert rows(incremental.search_get_pairs(searches, gets)) == want
    assert rows(incremental.count_search_get_pairs(searches, gets)) == [(len(want),)]
    assert rows(incremental.count_search_get_pairs(searches.limit(0), gets)) == [(0,)]


def test_streamed_pairs_are_keyed_by_time(spark, tmp_path):
    """A read meets the searches of its file in two buckets only; the state is keyed so."""
    searches, gets, want = log_rows(spark, 1_699_999_200)
    for name, df in (("s", searches), ("g", gets)):
        df.write.parquet(str(tmp_path / name))
    s, g = (spark.readStream.schema(df.schema).parquet(str(tmp_path / name)) for name, df in (("s", searches), ("g", gets)))
    out = incremental.search_get_pairs(s, g)
    run = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert rows(spark.read.schema(out.schema).parquet(str(tmp_path / "out"))) == want
    plan = run._jsq.explainInternal(False)
    assert "s_bucket" in plan.split("StreamingSymmetricHashJoin")[1].split("\n")[0]
