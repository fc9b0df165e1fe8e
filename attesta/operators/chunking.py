"""Splitting documents into headed blocks, chunks and windows."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST, OVERLAP = 1500, 150
START = "(start)"


def heading_blocks(docs: DataFrame, id_col: str = "file", text_col: str = "text") -> DataFrame:
    """(id, block, heading, body): blocks between ``#``..``###`` headings outside fenced code.

    Text before the first heading is headed (start); blocks without text are left out. Lines of
    one document are one window partition, bounded by that document.
    """
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, r"\r?\n")).alias("pos", "line"))
    upto = Window.partitionBy("id").orderBy("pos")
    fence = F.col("line").rlike(r"^ {0,3}(```|~~~)")
    lines = lines.withColumn("open", F.sum(fence.cast("int")).over(upto) % 2 == 1)
    lines = lines.withColumn("head", ~F.col("open") & ~fence & F.col("line").rlike(r"^#{1,3}\s"))
    lines = lines.withColumn("block", F.sum(F.col("head").cast("int")).over(upto))
    grouped = lines.groupBy("id", "block").agg(
        F.max(F.when(F.col("head"), F.trim(F.regexp_replace("line", "^#+", "")))).alias("heading"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))), lambda s: s["line"]), "\n").alias("body"),
    )
    body = F.regexp_replace("body", r"^\s+|\s+$", "")
    return grouped.select("id", "block", F.coalesce("heading", F.lit(START)).alias("heading"), body.alias("body")).where("body <> ''")


def wrapped(text: Column, most: int = MOST, overlap: int = OVERLAP) -> Column:
    """Pieces of ``most`` characters that begin every ``most - overlap``; the text itself if it is short."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(most - overlap))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(most))))


def char_chunks(blocks: DataFrame, keys: list[str], heading: str = "heading", body: str = "body") -> DataFrame:
    """(keys, part, heading, body): long bodies in overlapping pieces headed "heading (n)"."""
    parts = blocks.select(*keys, F.col(heading).alias("h"), (F.length(body) > MOST).alias("long"), F.posexplode(wrapped(F.col(body))).alias("part", "body"))
    return parts.select(*keys, "part", F.when(F.col("long"), F.format_string("%s (%d)", "h", F.col("part") + 1)).otherwise(F.col("h")).alias("heading"), "body")


_SOFT = re.compile("[;；?？!！。]" + "[’”'\"]?" + r"\s*" + "|" + r"(?<=[.])\s+" + "|" + r"\n")
_PARAGRAPH = re.compile(r"\n(?:[\t ]*\n)+")


def _units(body: str, most: int) -> Iterator[tuple[int, int]]:
    """Paragraphs, and where one is too long its longest runs of sentences or lines, else hard cuts."""
    edges = [0, *(gap.end() for gap in _PARAGRAPH.finditer(body)), len(body)]
    for left, right in zip(edges, edges[1:], strict=False):
        while right - left > most:
            soft = max((m.end() for m in _SOFT.finditer(body, left, left + most)), default=left + most)
            yield left, soft
            left = soft
        if left < right:
            yield left, right


def paragraph_spans(body: str, most: int = MOST, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of at most ``most`` characters that cover the text in whole units. Each begins with the
    last units of the one before: the fewest that make up ``overlap``, within a third of a span and
    what the next unit leaves free."""
    units = list(_units(body, most))
    begins, stops, found, first = [a for a, _ in units], [b for _, b in units], [], 0
    while first < len(units):
        fit = max(first + 1, bisect_right(stops, begins[first] + most))
        found.append((begins[first], stops[fit - 1]))
        if fit == len(units):
            break
        room = min(most // 3, most + begins[fit] - stops[fit])
        tails = [k for k in range(first + 1, fit) if stops[fit - 1] - begins[k] <= room]
        enough = [k for k in tails if stops[fit - 1] - begins[k] >= overlap]
        first = max(enough) if enough else min(tails, default=fit)
    return found


def paragraph_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, start, stop, body). The greedy overlap carries state, so it runs batch-wise in Python."""
    kind = dict(docs.dtypes)[id_col]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, n, a, b, t[a:b]) for i, t in zip(f["id"], f["text"], strict=True) if t for n, (a, b) in enumerate(paragraph_spans(t))]
            yield pd.DataFrame(rows, columns=["id", "part", "start", "stop", "body"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInPandas(run, f"id {kind}, part int, start int, stop int, body string")


def fixed_windows(text: Column, header: Column, width: int = 450, most: int = 4) -> Column:
    """At most ``most`` windows of ``width`` characters, each under the header."""
    starts = F.slice(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(width)), 1, most)
    return F.transform(starts, lambda i: F.concat(header, F.lit("\n"), F.substring(text, i + 1, F.lit(width))))


def token_windows(text: Column, label: Column, budget: int = 480) -> Column:
    """``passage:`` windows of white-space tokens with an overlap of a quarter, 64 at most."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lap = min(64, budget // 4)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(budget - lap)), lambda i: (i == 0) | (i + lap < F.size(words)))
    return F.transform(starts, lambda i: F.concat(F.lit("passage: "), label, F.lit(" "), F.array_join(F.slice(words, i + 1, F.lit(budget)), " ")))


def chunk_id(source: Column, file: Column, heading: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", source, file, heading)), 1, 12)


def chunk_key(file: Column, heading: Column, body: Column) -> Column:
    return F.md5(F.concat_ws("\n", file, heading, body))


def indexed_text(file: Column, heading: Column, body: Column) -> Column:
    return F.concat_ws(" ", file, heading, body)


def evidence_kind(heading: Column, body: Column) -> Column:
    """navigation for link lists and tables of contents, else body."""
    lines = F.filter(F.split(body, r"\n"), lambda x: F.trim(x) != "")
    links = F.filter(lines, lambda x: x.rlike(r"^\s*[-*+]?\s*\[[^\]]*\]\([^)]*\)"))
    listed = (F.size(lines) > 0) & (F.size(links) * 2 > F.size(lines))
    return F.when(heading.rlike(r"(?i)^(contents|index|links|目录|索引)$") | listed, "navigation").otherwise("body")


def frontmatter_purpose(text: Column) -> Column:
    block = F.regexp_extract(text, r"(?s)\A﻿?---[ \t]*\n(.*?)\n---", 1)
    return F.nullif(F.trim(F.regexp_extract(block, r"(?m)^rag_purpose:\s*(\w+)\s*$", 1)), F.lit(""))
