"""Append-only journals: latest state, inventories, de-duplication and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_inventory(records: DataFrame) -> DataFrame:
    """The newest inventory row set per owner; of equal times the first to arrive stays."""
    order = Window.partitionBy("owner").orderBy(F.desc("time"), "seq")
    return records.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def latest_narrative(records: DataFrame) -> DataFrame:
    """The newest narrative per owner; of equal times the last to arrive wins."""
    return records.groupBy("owner").agg(F.max_by(F.struct(*records.columns), F.struct("time", "seq")).alias("r")).select("r.*")


def latest_records(records: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row per path: best by (matches inventory, read_ok, version, has text), later arrivals win ties."""
    known = inventory.select("path", F.col("mtime").alias("i_mtime"), F.col("size").alias("i_size"))
    joined = records.join(known, "path", "left")
    match = F.coalesce((F.col("mtime") == F.col("i_mtime")) & (F.col("size") == F.col("i_size")), F.lit(False))
    order = Window.partitionBy("path").orderBy(F.desc(match.cast("int")), F.desc(F.col("read_ok").cast("int")), F.desc("version"), F.desc((F.length(F.coalesce("text", F.lit(""))) > 0).cast("int")), F.desc("seq"))
    return joined.withColumn("current", match).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "i_mtime", "i_size")


def readable(latest: DataFrame, blocked: tuple[str, ...] = ("skipped", "unsupported")) -> DataFrame:
    """Current rows that were read whole and hold text."""
    return latest.where(F.col("current") & F.col("read_ok") & (F.trim(F.coalesce("text", F.lit(""))) != "") & ~F.coalesce("changed_during_read", F.lit(False)) & ~F.coalesce("method", F.lit("")).isin(*blocked))


def archive_members(members: DataFrame, archives: DataFrame, inventory: DataFrame) -> DataFrame:
    """Members whose archive is in the inventory and whose recorded archive digest is still its own."""
    inv = inventory.select(F.col("path").alias("archive"), F.lit(True).alias("present"))
    digests = archives.select("archive", F.col("source_sha256").alias("own"))
    joined = members.join(inv, "archive", "left").join(digests, "archive", "left")
    return joined.withColumn("valid", F.coalesce("present", F.lit(False)) & F.coalesce(F.col("archive_sha256") == F.col("own"), F.lit(False))).drop("present", "own")


def still_present(records: DataFrame, inventory: DataFrame) -> DataFrame:
    return records.join(inventory.select("path"), "path", "left_semi")


def unprocessed(inventory: DataFrame, latest: DataFrame) -> DataFrame:
    return inventory.join(latest.select("path"), "path", "left_anti")


def keep_first(documents: DataFrame, keys: list[str], order: str, alias: str) -> DataFrame:
    """First row per key by ``order``; the others' ``alias`` values, sorted, become duplicate_sources.

    Grouping carries only the alias, not the texts, of the duplicates.
    """
    first = Window.partitionBy(*keys).orderBy(order)
    rows = documents.withColumn("n", F.row_number().over(first))
    others = rows.where("n > 1").groupBy(*keys).agg(F.array_sort(F.collect_list(alias)).alias("duplicate_sources"))
    return rows.where("n = 1").drop("n").join(others, keys, "left").withColumn("duplicate_sources", F.coalesce("duplicate_sources", F.array().cast("array<string>")))


def newest_paragraphs(chunks: DataFrame) -> DataFrame:
    """Of equal (heading, body) in recursive sources the newest file's copy stays."""
    order = Window.partitionBy("source", F.md5(F.concat_ws("\n", "heading", "body"))).orderBy(F.desc("mtime"), "file", "pos")
    return chunks.withColumn("n", F.when(F.col("recursive"), F.row_number().over(order)).otherwise(1)).where("n = 1").drop("n")


def canonical(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """(asked, document): aliases resolved to the document that stands for them."""
    own = documents.select(F.col("doc_id").alias("asked"), F.col("doc_id").alias("document"))
    alias = documents.select(F.explode("aliases").alias("asked"), F.col("doc_id").alias("document"))
    return ids.join(own.unionByName(alias), "asked", "left")


def coverage(latest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Counters by (method) and (scope, method), and the number of inventory rows not processed."""
    grouped = latest.groupingSets([["method"], ["scope", "method"]], "scope", "method").agg(F.count(F.lit(1)).alias("files"), F.count_if("read_ok").alias("read"), F.count_if(~F.col("read_ok")).alias("gaps"))
    return grouped.crossJoin(F.broadcast(unprocessed(inventory, latest).agg(F.count(F.lit(1)).alias("unprocessed"))))


def fingerprint(rows: DataFrame, columns: list[str], digest: str = "sha256") -> DataFrame:
    """(rows, digest) over all rows in any order: the exclusive or of row digests beside their sum, so nothing
    is collected or sorted; equal for equal multisets."""
    h = F.xxhash64(*columns)
    total = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("s"))
    joined = F.concat_ws("|", F.col("rows").cast("string"), F.col("x").cast("string"), F.col("s").cast("string"))
    return total.select("rows", (F.sha2(joined, 256) if digest == "sha256" else F.md5(joined)).alias("digest"))


def ordered_digest(rows: DataFrame, line, order: list[str], group: list[str] | None = None) -> DataFrame:
    """sha256 over lines in order, for bounded sets such as one source's files."""
    packed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda s: s["line"]), "\n")
    return rows.groupBy(*(group or [])).agg(F.sha2(packed, 256).alias("digest"))
