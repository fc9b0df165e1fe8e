"""Reciprocal-rank fusion, representatives, gating and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 60


def rrf(legs: DataFrame, k: int = K) -> DataFrame:
    """Chunk grain: (query_id, chunk_id, score) from (query_id, leg, chunk_id, rank)."""
    return legs.groupBy("query_id", "chunk_id").agg(F.sum(1 / (k + 1 + F.col("rank"))).alias("score"))


def unit_key(source: Column, file: Column, heading: Column, by_page: bool = False) -> Column:
    """What counts as one document: the file, or its page where only pages are searched."""
    whole = F.concat_ws("/", source, file)
    return F.concat(whole, F.lit("#"), F.substring_index(heading, " (", 1)) if by_page else whole


def rrf_units(legs: DataFrame, k: int = K) -> DataFrame:
    """(query_id, unit, score, ranks, chunk_id) from (query_id, leg, unit, chunk_id, rank, body).

    A unit's rank in a leg is that of its best chunk; ranks maps legs to them. The representative
    is the chunk with the highest (is body, own fused score), ties to the smaller id.
    """
    per_leg = legs.groupBy("query_id", "unit", "leg").agg(F.min("rank").alias("rank"))
    units = per_leg.groupBy("query_id", "unit").agg(F.sum(1 / (k + 1 + F.col("rank"))).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("leg", "rank")))).alias("ranks"))
    chunks = legs.groupBy("query_id", "unit", "chunk_id").agg(F.max("body").alias("body"), F.sum(1 / (k + 1 + F.col("rank"))).alias("own"))
    order = Window.partitionBy("query_id", "unit").orderBy(F.desc("body"), F.desc(F.round("own", 12)), "chunk_id")
    best = chunks.withColumn("n", F.row_number().over(order)).where("n = 1").select("query_id", "unit", "chunk_id")
    return units.join(best, ["query_id", "unit"])


def order_fused(fused: DataFrame, similarity: str | None = None) -> DataFrame:
    """Adds rank: fused score, then dense similarity (units without one first), then unit."""
    keys = [F.desc(F.round("score", 12))] + ([F.desc_nulls_first(similarity)] if similarity else []) + [F.asc("unit")]
    return fused.withColumn("rank", (F.row_number().over(Window.partitionBy("query_id").orderBy(*keys)) - 1).cast("bigint"))


def interleave(a: DataFrame, b: DataFrame, key: str = "chunk_id", k: int | None = None) -> DataFrame:
    """Two ranked lists, place by place, first occurrences only."""
    both = a.select("query_id", key, "rank", F.lit(0).alias("list")).unionByName(b.select("query_id", key, "rank", F.lit(1).alias("list")))
    first = both.groupBy("query_id", key).agg(F.min(F.struct("rank", "list")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at.rank", "at.list")
    out = first.select("query_id", key, (F.row_number().over(order) - 1).cast("bigint").alias("rank"))
    return out.where(F.col("rank") < k) if k else out


def gate(legs: DataFrame, floors: dict[str, float]) -> DataFrame:
    """(query_id, level): high if every leg with a floor reaches it, low if none does, else medium; high without checks."""
    top = legs.groupBy("query_id", "leg").agg(F.max("score").alias("top"))
    floor = F.create_map(*[x for leg, v in floors.items() for x in (F.lit(leg), F.lit(v))])[F.col("leg")]
    checked = top.withColumn("ok", F.when(floor.isNotNull(), (F.col("top") >= floor).cast("int")))
    sums = checked.groupBy("query_id").agg(F.count("ok").alias("n"), F.coalesce(F.sum("ok"), F.lit(0)).alias("k"))
    return sums.select("query_id", F.when(F.col("k") == F.col("n"), "high").when(F.col("k") == 0, "low").otherwise("medium").alias("level"))


def rerank_gate(ranked: DataFrame, scores: DataFrame, lo: float = 0.10, hi: float = 0.50, first: int = 3, wide: int = 5) -> DataFrame:
    """(query_id, level, best, n_scored) from window scores (query_id, unit, score) in [0, 1].

    The first units are scored; where the best stays under ``lo`` the search widens. Levels follow
    the thresholds: high from ``hi``, low under ``lo``.
    """
    per_unit = ranked.join(scores.groupBy("query_id", "unit").agg(F.max("score").alias("p")), ["query_id", "unit"], "left")
    early = F.max(F.when(F.col("rank") < first, F.col("p")))
    late = F.max(F.when(F.col("rank") < wide, F.col("p")))
    best = per_unit.groupBy("query_id").agg(early.alias("a"), late.alias("b"), F.count_if((F.col("rank") < first) & F.col("p").isNotNull()).alias("n3"), F.count_if((F.col("rank") < wide) & F.col("p").isNotNull()).alias("n5"))
    widened = F.coalesce(F.col("a") < lo, F.lit(True))
    out = best.select("query_id", F.when(widened, F.col("b")).otherwise(F.col("a")).alias("best"), F.when(widened, F.col("n5")).otherwise(F.col("n3")).alias("n_scored"))
    return out.withColumn("level", F.when(F.col("best") >= hi, "high").when(F.col("best") < lo, "low").otherwise("medium"))


def rescue(units: DataFrame, bodies: DataFrame, lo: float = 0.10) -> DataFrame:
    """Representatives scoring under ``lo`` give way to their unit's best lexical body of ``lo`` or more; order stays."""
    best = bodies.where(F.col("p") >= lo).groupBy("query_id", "unit").agg(F.max_by("chunk_id", F.struct("p", "chunk_id")).alias("new"), F.max("p").alias("new_p"))
    out = units.join(best, ["query_id", "unit"], "left")
    swap = (F.col("p") < lo) & F.col("new").isNotNull()
    return out.select("query_id", "unit", "rank", F.when(swap, F.col("new")).otherwise(F.col("chunk_id")).alias("chunk_id"), F.when(swap, F.col("new_p")).otherwise(F.col("p")).alias("p"), swap.alias("rescued"))


def reorder(ranked: DataFrame, scores: DataFrame, first: int = 15) -> DataFrame:
    """The first places by given scores, the rest as they were."""
    joined = ranked.join(scores, ["query_id", "unit"], "left")
    key = F.when(F.col("rank") < first, F.coalesce(F.col("p"), F.lit(-1.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(key), "rank")
    return joined.withColumn("new_rank", (F.row_number().over(order) - 1).cast("bigint"))


def protect_literal(ranked: DataFrame, queries: DataFrame, bodies: DataFrame, least: int = 12) -> DataFrame:
    """Units whose body holds the whole query (``least`` characters or more) move ahead, in their order."""
    joined = ranked.join(queries, "query_id").join(bodies, "unit", "left")
    literal = (F.length("q") >= least) & F.coalesce(F.contains(F.lower("body"), F.lower("q")), F.lit(False))
    order = Window.partitionBy("query_id").orderBy(F.desc(literal.cast("int")), "rank")
    return joined.select("query_id", "unit", literal.alias("literal"), (F.row_number().over(order) - 1).cast("bigint").alias("rank"))


def with_fallback(dense: DataFrame | None, lexical: DataFrame, hybrid: DataFrame | None) -> DataFrame:
    """Hybrid hits where vectors exist, else the lexical ones, with the mode as a column."""
    if dense is None or hybrid is None:
        return lexical.withColumn("mode", F.lit("bm25(fallback)"))
    return hybrid.withColumn("mode", F.lit("hybrid"))
