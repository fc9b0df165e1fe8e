"""Session settings and the shared folder for tables that executors write and read."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build(name: str = "attesta", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and skew handling; other settings as given."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, as in tests, a local master gets a temporary folder; a cluster must name one,
    since executors can't read a folder of the driver's machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="attesta-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")
