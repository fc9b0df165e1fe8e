"""Note directories, page tables, question files and notebooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunking

LEDGERS = r"(?i)(^|/)(memory\.md|.*(secret|credential|keys?)[^/]*\.md)$"
PRUNED = r"/(node_modules|\.git|__pycache__|\.venv)/"
#: Key, folder below the root, recursive or not.
Source = tuple[str, str, bool]


def scan(spark: SparkSession, root: str, source: Source, suffix: str = "md") -> DataFrame:
    """(source, file, path, mtime, size, text) of a note folder; ledgers of secrets and dependency
    folders are skipped by path, before their content is read."""
    key, folder, recursive = source
    base = f"{root.rstrip('/')}/{folder.strip('/')}"
    raw = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", str(recursive).lower()).load(base)
    clean = base.split("://", 1)[-1].lstrip("/")
    file = F.regexp_replace("path", rf"^[a-z]+:/*{clean.replace('.', '[.]')}/", "")
    rows = raw.where(~F.col("path").rlike(PRUNED)).withColumn("file", file).where(~F.col("file").rlike(LEDGERS))
    return rows.select(F.lit(key).alias("source"), "file", "path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.decode("content", "utf-8").alias("text"))


def load_chunks(spark: SparkSession, root: str, sources: list[Source], skip: tuple[str, ...] = ()) -> DataFrame:
    """Chunks (source, file, heading, part, body, chunk_id, chunk_key, kind) of all sources, redacted before and after the cut."""
    frames = [scan(spark, root, s) for s in sources if s[0] not in skip]
    docs = frames[0]
    for f in frames[1:]:
        docs = docs.unionByName(f)
    return chunk_documents(docs)


def chunk_documents(docs: DataFrame) -> DataFrame:
    """Chunks of documents (source, file, text)."""
    keyed = docs.select("source", "file", F.concat_ws("\u0001", "source", "file").alias("id"), text.redact(F.col("text")).alias("text"))
    blocks = chunking.heading_blocks(keyed, "id").select(F.split("id", "\u0001")[0].alias("source"), F.split("id", "\u0001")[1].alias("file"), "block", "heading", "body")
    parts = chunking.char_chunks(blocks, ["source", "file", "block"]).withColumn("body", text.redact(F.col("body")))
    return parts.select(
        "source", "file", "heading", "block", "part", "body", chunking.chunk_id(F.col("source"), F.col("file"), F.col("heading")).alias("chunk_id"),
        chunking.chunk_key(F.col("file"), F.col("heading"), F.col("body")).alias("chunk_key"), chunking.evidence_kind(F.col("heading"), F.col("body")).alias("kind"))


def page_chunks(pages: DataFrame, least: int = 40) -> DataFrame:
    """(file, page, part, heading, body) from a table of page texts (file, page, text); near-empty pages are dropped."""
    clean = pages.select("file", "page", text.redact(F.translate(F.col("text"), text._FULL_WIDTH, text._HALF_WIDTH)).alias("body"), F.concat(F.lit("p"), "page").alias("heading"))
    cut = chunking.char_chunks(clean.where(F.length(F.trim("body")) >= least), ["file", "page"])
    return cut.withColumn("body", text.redact(F.col("body")))


def bad_labels(labels: DataFrame, known: tuple[str, ...] = ("knowledge", "evaluation", "navigation", "draft", "historical")) -> DataFrame:
    """Label rows with an unknown purpose or without a file."""
    return labels.where(~F.coalesce(F.col("purpose").isin(*known), F.lit(False)) | F.col("file").isNull())


def golden(spark: SparkSession, path: str) -> DataFrame:
    """(q, expect, source, page_lo, page_hi, positive) of a question file with a ``queries`` array."""
    schema = "queries array<struct<q:string, expect:array<string>, source:string, expect_pages:array<int>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("queries").alias("x"))
    pages = F.col("x.expect_pages")
    return rows.select("x.q", "x.expect", "x.source", F.get(pages, F.lit(0)).alias("page_lo"), F.get(pages, F.lit(1)).alias("page_hi"), (F.size(F.coalesce("x.expect", F.array().cast("array<string>"))) > 0).alias("positive"))


def notebook_records(pages: DataFrame, known: DataFrame) -> DataFrame:
    """(page_id, title, body, digest) of notebook pages (page_id, xml) that changed since ``known`` (page_id, digest)."""
    rows = pages.select("page_id", F.sha2("xml", 256).alias("digest"), "xml").join(known.select("page_id", "digest"), ["page_id", "digest"], "left_anti")
    title = F.regexp_extract("xml", r"(?s)<title[^>]*>(.*?)</title>", 1)
    return rows.select("page_id", title.alias("title"), text.visible_text(F.regexp_replace("xml", r"(?s)<title[^>]*>.*?</title>", "")).alias("body"), "digest")


def match_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(link, page_id, how): the page of the same resource id, else the only page of that name."""
    l = links.withColumn("resid", F.lower(F.regexp_extract("link", r"(?i)[?&]resid=([^&#]+)", 1))).withColumn("name", F.lower(F.regexp_extract("link", r"([^/#?]+?)(?:\.one)?(?:[?#].*)?$", 1)))
    exact = l.where("resid <> ''").join(pages.select(F.lower("resid").alias("resid"), F.col("page_id").alias("a")), "resid", "left").select("link", "a")
    names = pages.groupBy(F.lower("title").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("b")).where("n = 1")
    out = l.join(exact, "link", "left").join(names, "name", "left")
    return out.select("link", F.coalesce("a", "b").alias("page_id"), F.when(F.col("a").isNotNull(), "exact").when(F.col("b").isNotNull(), "name").otherwise("none").alias("how"))


def staged_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, sha256) of a staged folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.col("path").alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def tree_fingerprint(listing: DataFrame) -> DataFrame:
    """Digest over (path, mtime, size) in any order, without reading contents."""
    from ..operators.journal import fingerprint

    return fingerprint(listing, ["path", "mtime", "size"])


def transcript(seconds: Column, said: Column) -> Column:
    """One timestamped line of a transcribed recording."""
    return F.concat(F.lit("["), text.clock(seconds), F.lit("] "), said)
