"""Exact token totals for every context limit from one histogram of document lengths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tokens import TOKENIZER, encoder

QUANTILES = (0.5, 0.9, 0.99)


def lengths(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(tokens bigint, docs bigint): distinct lengths in each Arrow batch and how many documents have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for b in batches:
            seen = pa.array([len(ids) // 4 for ids in encode(b.column(0).cast(pa.binary()).to_pylist())], pa.int64()).value_counts()
            yield pa.record_batch([seen.field(0), seen.field(1)], ["tokens", "docs"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "tokens bigint, docs bigint")


def length_histogram(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per encoded length: tokens, docs."""
    return lengths(docs, text_col, tokenizer).groupBy("tokens").agg(F.sum("docs").alias("docs"))


def context_report(histogram: DataFrame) -> DataFrame:
    """For every length L of the histogram, exact answers for a context limit of L tokens.

    docs_over, tokens_over: documents of more than L tokens and their total; truncated_tokens:
    total when each document is cut at L; dropped_tokens: what that loses; quantile: share of
    documents of at most L tokens. Between two lengths, the answers for a limit follow from the
    lower row: truncated_tokens + (limit - L) * docs_over. The window runs over distinct lengths,
    whose number is bounded by the longest document, not by the corpus. Null and empty texts have
    length 0; no documents give no rows.
    """
    upto = Window.orderBy("tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    n, t = F.col("docs"), F.col("docs") * F.col("tokens")
    sums = histogram.select(
        "tokens", "docs", F.sum(n).over(whole).alias("all_docs"), F.sum(t).over(whole).alias("all_tokens"),
        F.sum(n).over(upto).alias("docs_within"), F.sum(t).over(upto).alias("tokens_within"),
    )
    over = F.col("all_docs") - F.col("docs_within")
    cut = F.col("tokens_within") + over * F.col("tokens")
    return sums.select(
        "tokens", "docs", "docs_within", over.alias("docs_over"), (F.col("all_tokens") - F.col("tokens_within")).alias("tokens_over"),
        cut.alias("truncated_tokens"), (F.col("all_tokens") - cut).alias("dropped_tokens"), "all_docs", "all_tokens",
        (F.col("docs_within") / F.col("all_docs")).alias("quantile"),
    )


def quantile_lengths(histogram: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(q, tokens): the smallest length that a share q of the documents does not exceed."""
    report = context_report(histogram)
    return report.select(F.explode(F.array(*map(F.lit, quantiles))).alias("q"), "tokens", "quantile").where("quantile >= q").groupBy("q").agg(F.min("tokens").alias("tokens"))
