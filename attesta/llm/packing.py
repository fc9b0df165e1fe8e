"""Best-two-fit packing of token sequences, planned on the histogram of their lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, lean
from .common import pieces as slices
from .tokens import STEP, TOKENIZER, encoder

LIMIT, END_ID = 2048, 0
#: Pieces in one ranking bucket on average.
BUCKET = 200_000


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end_id: int = END_ID, tokenizer: str = TOKENIZER, with_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids) of every document cut at ``limit`` tokens.

    A document is its token ids and then ``end_id``, so null and empty texts give one piece of
    one token. ``ids`` is binary, little-endian unsigned 32-bit; it is left out, and never leaves
    the worker, without ``with_ids``.
    """
    kind = dict(docs.dtypes)[id_col]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for b in slices(batches, 1, STEP):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, all_ids in enumerate(encode(b.column(1).cast(pa.binary()).to_pylist())):
                all_ids += end
                for k, at in enumerate(range(0, len(all_ids), 4 * limit)):
                    part = all_ids[at : at + 4 * limit]
                    row.append(i), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            arrays = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), *[pa.array(ids, pa.binary())] * with_ids]
            yield pa.record_batch([b.column(0).take(pa.array(row, pa.int64())), *arrays], ["id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(lean(run, keep=True), f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, list[int]]]:
    """(times, lengths) of bins that hold ``counts[length]`` pieces of each length.

    Fills a bin greedily with the longest pieces that fit; then, if a gap is left, replaces its
    smallest piece by the two unpacked ones that fit the gap so widened most tightly, where they
    fill more of it. The bin found is used as often as the counts allow, which uses up at least
    one length, so a plan has no more entries than lengths, however many pieces there are.
    """
    left = np.zeros(limit + 1, np.int64)
    for k, n in counts.items():
        left[k] = n
    found = []
    while left.any():
        bin_, gap = [], limit
        while gap and (fits := np.flatnonzero(left[: gap + 1])).size:
            k = int(fits[-1])
            n = int(min(left[k] - bin_.count(k), gap // k))
            if n <= 0:  # all of this length are in the bin already: take the next shorter
                free = [int(f) for f in fits[::-1] if left[f] > bin_.count(f)]
                if not free:
                    break
                k = free[0]
                n = int(min(left[k] - bin_.count(k), gap // k))
            bin_ += [k] * n
            gap -= k * n
        if gap and len(bin_) > 1:
            bin_ = _replace_smallest(bin_, gap, left)
        used = np.bincount(bin_, minlength=limit + 1)
        at = np.flatnonzero(used)
        times = int((left[at] // used[at]).min())
        left -= times * used
        found.append((times, bin_))
    return found


def _replace_smallest(bin_: list[int], gap: int, left: np.ndarray) -> list[int]:
    smallest = bin_[-1]
    wide = gap + smallest
    free = left - np.bincount(bin_, minlength=len(left))
    free[smallest] += 1
    for total in range(wide, smallest, -1):
        a = np.arange(1, total // 2 + 1)
        ok = (free[a] > 0) & (free[total - a] > (a == total - a))
        if ok.any():
            k = int(a[ok][-1])
            return [*bin_[:-1], total - k, k]
    return bin_


def pack(sized: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds sequence_id and offset to rows (id, piece, length, ...).

    Pieces of one length are interchangeable, so the plan speaks of the n-th piece of a length.
    Ranks come from buckets of (length, hash): counts by bucket are summed up first, and only a
    bucket, never a whole length, is sorted in one task. The plan has at most ``limit`` bins of
    at most ``limit`` pieces with at most 63 lengths each (their sum is bounded), so the table
    broadcast is small whatever the input.
    """
    spark = sized.sparkSession
    total = sized.count()
    n_buckets = max(1, -(-total // BUCKET))
    keyed = sized.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(n_buckets)))
    by_bucket = keyed.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = by_bucket.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    counts = {int(r["length"]): int(r["count"]) for r in sized.groupBy("length").count().collect()}
    rows, first, used = [], 0, dict.fromkeys(counts, 0)
    for times, lengths in plan(counts, limit):
        at = 0
        for k in sorted(set(lengths), reverse=True):
            n = lengths.count(k)
            rows.append((k, used[k], used[k] + n * times, n, first, at))
            used[k] += n * times
            at += n * k
        first += times
    planned = spark.createDataFrame(rows, "length bigint, low bigint, high bigint, per_bin int, first_bin bigint, at bigint")
    within = Window.partitionBy("length", "bucket").orderBy("id", "piece", "start")
    ranked = keyed.withColumn("n", F.row_number().over(within) - 1).join(by_bucket, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("n") + F.col("before")).drop("bucket", "n", "before")
    placed = ranked.join(F.broadcast(planned), (ranked.length == planned.length) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).drop(planned.length)
    nth = F.col("rank") - F.col("low")
    return placed.select(
        *sized.columns,
        (F.col("first_bin") + F.floor(nth / F.col("per_bin"))).cast("bigint").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("per_bin")) * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and its ids if asked for.

    Sequences hold at most ``limit`` tokens without gaps. Ids may be null or repeat; every row is
    packed on its own. No documents give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    return pack(scratch.table(pieces(docs, id_col, text_col, limit, with_ids=with_ids), "pieces"), limit)
