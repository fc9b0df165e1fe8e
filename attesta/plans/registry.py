"""Query registry and literal fixtures that Spark and SQL share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: name -> (schema, rows)
FIXTURES: dict[str, tuple[str, list[tuple]]] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = FIXTURES[name]
    plain = ", ".join(f"{c} {'string' if t == 'timestamp' else t}" for c, t in (x.strip().split(" ", 1) for x in _columns(schema)))
    df = spark.createDataFrame(rows, plain)
    for c, t in (x.strip().split(" ", 1) for x in _columns(schema)):
        if t == "timestamp":
            df = df.withColumn(c, df[c].cast("timestamp_ntz"))
    return df


def _columns(schema: str) -> list[str]:
    return [c for c in schema.split(", ") if c]


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_literal, v)) + "]"
    if not isinstance(v, str):
        return repr(v)
    quote = "'"
    return quote + v.replace(quote, 2 * quote) + quote


_TYPES = {"string": "VARCHAR", "array<string>": "VARCHAR[]", "array<array<string>>": "VARCHAR[][]", "timestamp": "TIMESTAMP"}


def ctes(*names: str) -> str:
    """WITH clause that holds the fixtures."""
    out = []
    for n in names:
        schema, rows = FIXTURES[n]
        cols = [x.split(" ", 1) for x in _columns(schema)]
        values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
        casts = ", ".join(f"CAST({c} AS {_TYPES.get(t, t)}) AS {c}" for c, t in cols)
        out.append(f"{n} AS (SELECT {casts} FROM (VALUES {values}) v({', '.join(c for c, _ in cols)}))")
    return "WITH " + ", ".join(out)
