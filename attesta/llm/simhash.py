"""SimHash fingerprints and their linking by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, lean, unused

SHINGLE, SEED, BITS, DISTANCE = 4, 42, 64, 4
#: Shingles whose bits are counted at once; bounds memory for very long texts.
STEP = 1 << 15


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text; 0 for null or wordless texts."""
    raw = text.encode() if isinstance(text, str) else text or b""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        n, hashes = 1, [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: -shingle].tolist()]
        parts = map(joined.__getitem__, map(slice, starts, (ends[shingle - 1 :] - 1).tolist()))
        n, hashes = len(words) - shingle + 1, map(xxhash.xxh64_intdigest, parts, repeat(SEED))
    values = np.fromiter(hashes, np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, STEP):
        block = values[i : i + STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.fromiter(map(fingerprint, b.column(1).cast(pa.binary()).to_pylist()), np.int64, b.num_rows)
        yield pa.record_batch([b.column(0), pa.array(found)], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of each row, in one pass and without a shuffle."""
    kind = dict(docs.dtypes)[id_col]
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(lean(_fingerprints), f"id {kind}, fp bigint")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def blocks_for(n: int, distance: int = DISTANCE, per_key: int = 8) -> int:
    """Number of blocks for n fingerprints: two more than the distance at least, and as many more
    as keep buckets near ``per_key`` rows. Any number of blocks beyond the distance finds all pairs."""
    for blocks in range(distance + 2, distance + 4):
        if n <= per_key << (BITS * (blocks - distance) // blocks):
            return blocks
    return distance + 4


def block_keys(fp: Column, blocks: int, distance: int = DISTANCE) -> Column:
    """Array with a key for each choice of blocks that two close fingerprints may have in common."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for i, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << cuts[c + 1]) - (1 << cuts[c])) for c in chosen)
        mask = mask - (1 << BITS) if mask >> (BITS - 1) else mask
        keys.append(F.struct(F.lit(i).cast("smallint").alias("t"), fp.bitwiseAND(F.lit(mask)).alias("b")))
    return F.array(*keys)


def links(fps: DataFrame, blocks: int, distance: int = DISTANCE) -> DataFrame:
    """Edges (u, v) among distinct fingerprints ``fp`` that connect all that lie within ``distance``.

    Two such fingerprints agree in ``blocks - distance`` blocks at least, hence share a key. Each
    bucket has a pivot, its smallest member, found by aggregation and joined back, so adaptive
    execution can split a bucket; members near the pivot get one edge to it, and pairs of two such
    members need none, being connected. Only the others are joined with their bucket. So a bucket
    of thousands of near copies costs linear work, yet no connection is lost.
    """
    rows = fps.select("fp", F.explode(block_keys(F.col("fp"), blocks, distance)).alias("k")).select("fp", "k.t", "k.b")
    pivots = rows.groupBy("t", "b").agg(F.min("fp").alias("pivot"), F.max("fp").alias("last")).where("pivot <> last").drop("last")
    rows = rows.join(pivots, ["t", "b"]).withColumn("near", hamming(F.col("fp"), F.col("pivot")) <= distance)
    star = rows.where("near AND fp <> pivot").select(F.col("fp").alias("u"), F.col("pivot").alias("v"))
    far = rows.where("NOT near").select("t", "b", F.col("fp").alias("u"))
    rest = far.join(rows.select("t", "b", F.col("fp").alias("v"), "near"), ["t", "b"]).where(
        (F.col("near") | (F.col("u") < F.col("v"))) & (hamming(F.col("u"), F.col("v")) <= distance)
    )
    return star.unionByName(rest.select("u", "v")).distinct()


def _linked(prints: DataFrame, scratch: Scratch, distance: int) -> DataFrame:
    """(fp, root, least): of each distinct fingerprint of ``prints`` (id, fp), the smallest it is connected with, and its smallest id."""
    classes = scratch.table(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    edges = links(classes.select("fp"), blocks_for(classes.count(), distance), distance)
    linked = connected_components(edges, scratch).withColumnRenamed("node", "fp")
    return classes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per document: id, fp, component (smallest id reachable over links).

    Equal fingerprints collapse to one node before linking. Null texts count as empty; all
    wordless texts share fingerprint zero. Null ids keep their row and never name a component
    unless no other id is there. Rows that share an id each get their own text's fingerprint and
    component; other columns don't matter. No documents give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.table(fingerprints(docs, id_col, text_col), "prints")
    linked = _linked(prints, scratch, distance)
    roots = linked.groupBy("root").agg(F.min("least").alias("component"))
    return prints.join(linked.join(roots, "root").select("fp", "component"), "fp").select("id", "fp", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row for each component: of its rows that of the smallest id, and of several
    texts under that id the one whose hash is smallest. Other rows that share an id belong to their
    own text's component. Rows without an id stay."""
    scratch = Scratch(docs.sparkSession)
    copy, times = unused("copy", docs), unused("times", docs)
    texts = docs.where(F.col(id_col).isNotNull()).withColumn(copy, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    prints = texts.select(F.struct(F.col(id_col).alias("id"), F.col(copy).alias("copy")).alias("id"), text_col)
    prints = scratch.table(fingerprints(prints, "id", text_col), "prints")
    first = _linked(prints, scratch, distance).groupBy("root").agg(F.min("least").alias("id"))
    first = first.join(prints.groupBy("id").agg(F.count(F.lit(1)).alias(times)), "id")
    first = scratch.table(first.select(F.col("id.id").alias(id_col), F.col("id.copy").alias(copy), times), "first")
    kept = texts.join(first.where(F.col(times) == 1).drop(times), [id_col, copy], "left_semi")
    if not (several := first.where(F.col(times) > 1).drop(times)).isEmpty():
        kept = kept.unionByName(texts.join(several, [id_col, copy], "left_semi").dropDuplicates([id_col, copy]))
    return kept.drop(copy).unionByName(docs.where(F.col(id_col).isNull()))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
