"""Helpers that several training-data operators share.

Words are maximal runs of bytes other than space and ``\\x09``-``\\x0D``; that is exactly what
``bytes.split()`` yields on UTF-8, so every operator splits encoded text and never decodes twice.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import time
import uuid
from collections.abc import Callable, Iterator
from functools import reduce, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Rows and bytes in an Arrow batch. Texts run to 100 kB and more, and a batch exists several times
#: over: in the JVM's buffers, in Arrow and as Python objects.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id's decimal text, modulo ``modulus``; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def unused(name: str, df: DataFrame) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lean(run: Callable[[Iterator], Iterator], keep: bool = False) -> Callable[[Iterator], Iterator]:
    """``run`` over a partition's batches, with the worker's memory given back before and after.

    Workers live on from stage to stage, and so does what an earlier operator cached in them or
    its allocator kept; ``keep`` leaves the tokenizer's cache.
    """

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        if not keep and (tokens := sys.modules.get("attesta.llm.tokens")):
            tokens.encoder.cache_clear()
        _trim()
        try:
            yield from run(batches)
        finally:
            _trim()

    return wrapped


def pieces(batches: Iterator[pa.RecordBatch], text: int, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batches`` with some ``size`` bytes in column ``text``, for steps that need many times a text's memory."""
    for b in batches:
        ends = np.cumsum(np.array([len(t or b"") + 16 for t in b.column(text).cast(pa.binary()).to_pylist()], np.int64))
        cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(size, ends[-1] if len(ends) else 0, size)) + 1, [b.num_rows]]))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield b.slice(lo, hi - lo)


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class Scratch:
    """Intermediate tables in the shared folder; they cut lineage and survive lost executors.

    Tables stay until :meth:`drop` or the end of the process, since lazy results may read them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        try:
            self.drop()
        except Exception:  # noqa: BLE001 - the session may be gone by the end of the process
            pass


def free(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps; else they stay until the driver happens to collect its garbage.
    What refers to a shuffle often goes in a first collection and the shuffle in a second."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the smallest node it reaches.

    Alternates large-star and small-star steps, which need O(log n) rounds in practice. Every
    step is a min-aggregation joined back on the node, so a hub's neighbours are never collected.
    Self loops and nulls are ignored; no edges give no rows.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before, step = scratch.table(e, f"{name}-0"), None, 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step += 1
        nxt = scratch.table(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{step}")
        now = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        scratch.drop(f"{name}-{step - 1}")
        e = nxt
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
