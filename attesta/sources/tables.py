"""Index tables, caches, snapshots and logs on shared storage."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Snapshots:
    """Numbered generations of a set of tables; a manifest written last makes one current."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def publish(self, tables: dict[str, DataFrame], partition: dict[str, str] | None = None, note: str = "") -> str:
        """Writes all tables under a new name, then the manifest. Readers see the old or the new whole set."""
        name = uuid.uuid4().hex
        counts = {}
        for t, df in tables.items():
            w = df.write.mode("errorifexists")
            (w.partitionBy((partition or {})[t]) if t in (partition or {}) else w).parquet(f"{self.root}/{name}/{t}")
            counts[t] = self.spark.read.parquet(f"{self.root}/{name}/{t}").count()
        self._manifest({"generation": name, "rows": counts, "note": note, "previous": self.current().get("generation")})
        return name

    def _manifest(self, value: dict) -> None:
        number = self.current().get("number", 0) + 1
        self.spark.createDataFrame([(json.dumps(value | {"number": number}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/manifest/{number:08d}")

    def current(self) -> dict:
        fs, p = _fs(self.spark, f"{self.root}/manifest")
        if not fs.exists(p):
            return {}
        names = sorted(s.getPath().toString() for s in fs.listStatus(p) if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
        return json.loads(self.spark.read.text(names[-1]).first()[0]) if names else {}

    def read(self, table: str) -> DataFrame:
        """A table of the current generation; partition filters prune what is opened. Row counts are checked."""
        now = self.current()
        if not now:
            raise LookupError("nothing is published")
        return self.spark.read.parquet(f"{self.root}/{now['generation']}/{table}")

    def verify(self) -> bool:
        now = self.current()
        return all(self.read(t).count() == n for t, n in now.get("rows", {}).items())

    def rollback(self) -> None:
        previous = self.current().get("previous")
        if not previous:
            raise LookupError("no earlier generation")
        self._manifest({"generation": previous, "rows": {}, "note": "rollback", "previous": None})

    def retain(self, keep: int = 2) -> None:
        """Deletes generations beyond the current one and its predecessors."""
        fs, p = _fs(self.spark, self.root)
        now, kept = self.current(), set()
        kept |= {now.get("generation"), now.get("previous")} if keep > 1 else {now.get("generation")}
        for s in fs.listStatus(p):
            if (name := s.getPath().getName()) not in kept | {"manifest"}:
                fs.delete(s.getPath(), True)


def encrypted(df: DataFrame, column: str, key: bytes, aad: str) -> DataFrame:
    return df.withColumn(column, F.aes_encrypt(F.col(column).cast("binary"), F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(bytearray()), F.lit(aad)))


def decrypted(df: DataFrame, column: str, key: bytes, aad: str) -> DataFrame:
    return df.withColumn(column, F.aes_decrypt(F.col(column), F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad)).cast("string"))


def missing_vectors(chunks: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Chunks whose key has no vector of the model yet."""
    return chunks.join(cache.where(F.col("model") == model).select("chunk_key"), "chunk_key", "left_anti")


def append_log(events: DataFrame, path: str) -> bool:
    """Adds query-log rows; a failure is reported, never raised, so that no search fails by its log."""
    try:
        events.write.mode("append").json(path)
    except Exception:  # noqa: BLE001 - the log must not fail a search
        return False
    return True


def read_log(spark: SparkSession, path: str, schema: str, day: str | None = None, src: str | None = None) -> DataFrame:
    """Query-log rows, malformed lines dropped, filtered by day and origin."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if day:
        rows = rows.where(F.substring("ts", 1, 10) == day)
    return rows.where(F.col("src") == src) if src else rows


def write_partitions(df: DataFrame, path: str, scope: str = "scope") -> None:
    """Replaces only the scopes present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(scope).parquet(path)
