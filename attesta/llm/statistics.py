"""Per-document statistics that the quality operators share."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import lean

#: Exact counts, long.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratios, double; 0 where the denominator is 0.
RATIOS = (
    "mean_word_chars", "symbol_ratio", "upper_ratio", "digit_ratio", "punct_ratio", "pipe_ratio", "bang_ratio", "distinct_ratio",
    "echo_ratio", "repeat_ratio", "dup_line_ratio", "words_per_line", "other_ratio", "log_words",
)
FEATURES = RATIOS

_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_PUNCT = np.frombuffer(b".,;:?'\"-()", np.uint8)
#: Windows are keyed by three word numbers; beyond this vocabulary their product leaves 63 bits.
_WIDE = 1 << 20


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a ``width``-word window found twice or more in the text."""
    n = len(words)
    if n <= width:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    key = ids[: n - width + 1].copy()
    for k in range(1, width):
        if len(numbers) > _WIDE:  # renumber the prefixes so that keys stay exact
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * len(numbers) + ids[k : n - width + 1 + k]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for k in range(width):
        inside[k : k + len(twice)] |= twice
    return int(inside.sum())


def measure(text: str | bytes | None) -> tuple[list[int], list[float]]:
    """COUNTS and RATIOS of one text; all zero for null and wordless texts."""
    raw = text.encode() if isinstance(text, str) else text or b""
    words = raw.split()
    n = len(words)
    if not n:
        return [0, 0, int(np.isin(np.frombuffer(raw, np.uint8), _SYMBOLS).sum()), 0, 0], [0.0] * len(RATIOS)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = int(by.sum() - by[0x80:0xC0].sum() - by[9:14].sum() - by[32])
    symbols = int(by[_SYMBOLS].sum())
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    upper, lower, digits = int(by[65:91].sum()), int(by[97:123].sum()), int(by[48:58].sum())
    high, punct, bang = int(by[0xC0:].sum()), int(by[_PUNCT].sum()), int(by[33])
    other = chars - upper - lower - digits - high - punct - bang - symbols
    ratios = [
        chars / n, symbols / n, upper / max(1, upper + lower), digits / chars, punct / n, int(by[124]) / n, bang / n, len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n, repeats / n, dup / max(1, len(lines)), n / max(1, len(lines)), other / chars, float(np.log1p(n)),
    ]
    return [n, chars, symbols, dup, repeats], ratios


def measure_batch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    found = [measure(x) for x in texts.cast(pa.binary()).to_pylist()]
    counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(COUNTS))
    return counts, np.array([r for _, r in found], np.float64).reshape(-1, len(RATIOS))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts, ratios = measure_batch(b.column(1))
        yield pa.record_batch([b.column(0), *map(pa.array, counts.T.copy()), *map(pa.array, ratios.T.copy())], ["id", *COUNTS, *RATIOS])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS, RATIOS) per row, in one pass and without a shuffle; null texts count as empty."""
    kind = dict(docs.dtypes)[id_col]
    schema = ", ".join([f"id {kind}", *(f"{c} bigint" for c in COUNTS), *(f"{r} double" for r in RATIOS)])
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(lean(_statistics), schema)


def with_statistics(docs: DataFrame, into: str, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column of RATIOS. Batches pass through Python as Arrow, column by column;
    a scalar UDF would queue whole rows in the JVM meanwhile."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, ratios = measure_batch(b.column(at))
            yield pa.record_batch([*b.columns, pa.StructArray.from_arrays([pa.array(x) for x in ratios.T.copy()], list(RATIOS))], [*b.schema.names, into])

    kind = StructType([StructField(r, DoubleType()) for r in RATIOS])
    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields, StructField(into, kind)]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train, limit: int) -> DataFrame:
    """Documents (doc_id, text, label) of at most ``limit`` labelled rows, chosen by hash of doc_id.

    ``train`` is a predicate on doc_id. Null ids and null labels are left out. Of several labels of
    one id the greatest counts; texts that share an id are one row each. The chosen labels are at
    most ``limit`` rows, which bounds the broadcast, and ids tied in their hash are taken in order.
    """
    chosen = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where(train & F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
