"""Size-partitioned MinHash containment search of short items in long documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import lean, union_all
from .words import run_hashes, word_hashes

SHINGLE, CONTAINMENT, HASHES = 5, 0.8, 32
#: Items whose signatures and shingles are shipped to the workers in one pass over the documents.
ITEMS_PER_PASS = 20_000
#: Bytes of text searched at once; a longer text is searched whole.
BYTES_PER_STEP = 6 << 20

_MULTIPLIERS = np.random.default_rng(20).integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def minima(values: np.ndarray, starts: np.ndarray, i: int) -> np.ndarray:
    """Minimum under the i-th hash function of each run of ``values`` that begins at ``starts``."""
    mixed = (values * _MULTIPLIERS[i]) >> np.uint64(16)
    return np.minimum.reduceat(mixed, starts)


def size_class(n: int) -> int:
    """Items of (2^(c/2-1/2), 2^(c/2)] distinct shingles are in class c."""
    return max(0, int(np.ceil(2 * np.log2(max(1, n)) - 1e-9)))


def shingles(texts: list[bytes | None], width: int, hashed: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words of ``texts`` laid end to end, and each text's number of them."""
    h, cuts = hashed or word_hashes(texts)
    lengths = np.maximum(np.diff(cuts) - width + 1, 0)
    at = np.arange(lengths.sum()) + np.repeat(cuts[:-1] - (np.cumsum(lengths) - lengths), lengths)
    return run_hashes(h, width)[at], lengths


@dataclass
class Items:
    """Signatures of some items by their shingles' width and their size class, and their exact shingles."""

    ids: list
    shingles: list[np.ndarray]
    classes: dict[int, dict[int, list[tuple[np.ndarray, np.ndarray]]]]

    @classmethod
    def build(cls, rows: list[tuple]) -> Items:
        texts = [(text or "").encode() for _, text in rows]
        n_words = [len(t.split()) for t in texts]
        ids, found, by = [], [], {}
        for width in range(1, SHINGLE + 1):
            own = [i for i, n in enumerate(n_words) if min(n, SHINGLE) == width]
            values, lengths = shingles([texts[i] for i in own], width)
            for i, s in zip(own, np.split(values, np.cumsum(lengths)[:-1]) if own else [], strict=True):
                s = np.unique(s)
                by.setdefault(width, {}).setdefault(size_class(len(s)), []).append(len(ids))
                ids.append(rows[i][0]), found.append(s)
        classes = {}
        for width, sizes in by.items():
            for c, members in sizes.items():
                members = np.array(members)
                flat = np.concatenate([found[m] for m in members])
                starts = np.concatenate([[0], np.cumsum([len(found[m]) for m in members])[:-1]])
                signatures = classes.setdefault(width, {}).setdefault(c, [])
                for i in range(HASHES):
                    least = minima(flat, starts, i)
                    order = np.argsort(least)
                    signatures.append((least[order], members[order]))
        return cls(ids, found, classes)

    def candidates(self, width: int, values: np.ndarray, lengths: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs that share a minimum, for documents laid end to end in ``values``.

        For class c with items of at most m shingles, a document is covered by windows of 1.5 m
        that begin every m / 2, so an item inside it lies whole in one of them and makes up nearly
        half of it or more: its 32 minima are missed with a chance below one in a million.
        """
        found: set[tuple[int, int]] = set()
        ends = np.cumsum(lengths)
        begins = ends - lengths
        for c, signatures in self.classes[width].items():
            step = max(1, -(-int(2 ** (c / 2)) // 2))
            blocks = -(-lengths // step)
            starts = np.repeat(begins, blocks) + step * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
            doc = np.repeat(np.arange(len(lengths)), blocks)
            same1, same2 = doc[:-1] == doc[1:], doc[:-2] == doc[2:]
            for i, (least, members) in enumerate(signatures):
                low = minima(values, starts, i)
                win = low.copy()
                win[:-1] = np.where(same1, np.minimum(win[:-1], low[1:]), win[:-1])
                win[:-2] = np.where(same2, np.minimum(win[:-2], low[2:]), win[:-2])
                at = np.searchsorted(least, win)
                hit = np.flatnonzero(least[np.minimum(at, len(least) - 1)] == win)
                for k in hit.tolist():
                    j = int(at[k])
                    while j < len(least) and least[j] == win[k]:
                        found.add((int(doc[k]), int(members[j])))
                        j += 1
        return found

    def search(self, texts: list[bytes | None]) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, shingles of the item found, shingles of the item), verified exactly."""
        at = 0
        while at < len(texts):
            first, size = at, 0
            while at < len(texts) and size < BYTES_PER_STEP:
                size += len(texts[at] or b"")
                at += 1
            part = texts[first:at]
            hashed = word_hashes(part)
            for width in self.classes:
                values, lengths = shingles(part, width, hashed)
                rows = np.flatnonzero(lengths)
                if not len(rows):
                    continue
                ends = np.cumsum(lengths[rows])
                for d, item in sorted(self.candidates(width, values, lengths[rows])):
                    own = self.shingles[item]
                    n = int(np.isin(own, values[ends[d] - lengths[rows[d]] : ends[d]]).sum())
                    if n >= CONTAINMENT * len(own):
                        yield first + int(rows[d]), item, n, len(own)


def contained_items(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc, item, n_found, n_shingles, containment): items of which 0.8 or more of the distinct
    five-word shingles (words lower-cased in A-Z) occur in a document.

    Items are the stated queries: they are taken in blocks of ITEMS_PER_PASS, each sent to the
    workers for a pass over the documents, so memory is bounded however many there are. An item of
    fewer than five words is one shingle of all its words, found wherever these stand in a row;
    null and wordless texts on either side match nothing. Repeated rows each count, also those of
    one id with different texts; other columns don't matter.
    """
    kind, item_kind = dict(docs.dtypes)[doc_col], items.schema[item_col].dataType
    arrow = to_arrow_type(item_kind)
    schema = f"doc {kind}, item {item_kind.simpleString()}, n_found bigint, n_shingles bigint, containment double"
    picked = docs.select(F.col(doc_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def one_pass(shipped) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shipped.value
            for b in batches:
                hits = list(own.search(b.column(1).cast(pa.binary()).to_pylist()))
                row, item, n, of = zip(*hits, strict=True) if hits else ((), (), (), ())
                columns = [pa.array([own.ids[i] for i in item], arrow), pa.array(n, pa.int64()), pa.array(of, pa.int64())]
                columns.append(pa.array([x / y for x, y in zip(n, of, strict=True)], pa.float64()))
                yield pa.record_batch([b.column(0).take(pa.array(row, pa.int64())), *columns], ["doc", "item", "n_found", "n_shingles", "containment"])

        return picked.mapInArrow(lean(run), schema)

    return union_all([one_pass(x) for x in _blocks(items, item_col, text_col)])


def _blocks(items: DataFrame, item_col: str, text_col: str) -> list:
    """Broadcasts of ITEMS_PER_PASS items each; one at least. Rows come to the driver one partition at a time."""
    context, blocks, rows = items.sparkSession.sparkContext, [], []
    for r in items.select(item_col, F.col(text_col).cast("string")).toLocalIterator():
        rows.append((r[0], r[1]))
        if len(rows) == ITEMS_PER_PASS:
            blocks.append(context.broadcast(Items.build(rows)))
            rows = []
    return [*blocks, context.broadcast(Items.build(rows))] if rows or not blocks else blocks


def without_items(docs: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that hold no item, all columns kept, without a shuffle."""
    kept, at = docs, docs.columns.index(text_col)
    for shipped in _blocks(items, item_col, "text"):

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            own = shipped.value
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                clean[[row for row, *_ in own.search(b.column(at).cast(pa.binary()).to_pylist())]] = False
                yield b.filter(pa.array(clean))

        kept = kept.mapInArrow(lean(run), docs.schema)
    return kept
