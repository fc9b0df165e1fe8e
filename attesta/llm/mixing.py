"""Logistic context mixing over the code bits of words, with a unigram baseline beside it.

Each token is a path of binary decisions in a Huffman tree over the commonest words and a few
buckets for all others. Context predictors give each decision a log-odds from counts over
the whole training corpus; weights gated by depth, the same for every text to begin with, combine
them; within a text they are refined online, block by block, from what was already coded. The log-probabilities of a token's
decisions add up to its own, so a text's total is its code length in bits.

Each context has counts of its own, however many there are: pairs of a context and a symbol are
numbered so that a context's symbols lie in order of their codes, tasks ask shards of contexts for
the pairs in their texts, and the shards answer with the log-odds along each pair's path, once for
neighbours that share its beginning. Callers
who rather have no shuffle may give a number of slots; contexts are then hashed into tables of that
size, which travel to every worker.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold, free, lean

HELD_OUT = (7, 2)
#: Words with a code of their own; all others share BUCKETS codes and are told apart by their counts.
HEAD, BUCKETS = 131_071, 256
#: Least and most slots of a hashed context that ``slots_for`` advises, and how many of the commonest words serve as long-range context.
SLOTS, FREQUENT = (1 << 16, 1 << 20), 256
CONTEXTS, GATES = 3, 16
#: Weights that each text begins with, by gate: the share of the hashed contexts falls with the depth, as their counts do.
_TRUST = np.array([0.8] * 10 + [0.75, 0.7, 0.65, 0.55, 0.35, 0.2], np.float32)
WEIGHTS = np.stack([np.full(GATES, -0.2, np.float32), 0.85 * _TRUST, 0.85 * _TRUST], axis=1)
#: Decisions that a context must have seen at a node to count for half.
DOUBT = 3
#: Slots that are summed together.
CHUNK = 1 << 14
#: Tokens between refinements of a text's weights, their rate, and tokens worked on at once.
BLOCK, RATE, STEP = 64, 1.5, 150_000
#: Tokens that ask for their pairs together, training tokens to a shard of contexts, and pairs worked on at once.
UNIT, SHARD, PAIRS = 1_500_000, 2_000_000, 1 << 16
#: What rows of symbols have in place of a shard; they come after all shards.
TEXTS = 1 << 30
#: Log-odds travel rounded to LEVELS steps either side of nothing: 0.02 wide there, a thirtieth of large ones; FINE has their values by the byte.
LEVELS, BEND, WIDEST = 127, 2.0, 24.0
_BYTE = np.arange(256, dtype=np.uint8).view(np.int8).astype(float)
FINE = (np.sinh(_BYTE / LEVELS * np.arcsinh(BEND * WIDEST)) / BEND).astype(np.float32)


def coded_words(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (binary), the number of each word in turn, and where texts begin and end among them."""
    lowered = pa.array([(t or b"").lower() for t in texts], pa.large_binary()).cast(pa.large_string(), safe=False)
    split = pc.ascii_split_whitespace(lowered)
    coded = split.flatten().dictionary_encode()
    distinct = coded.dictionary.cast(pa.large_binary()).cast(pa.binary())
    index, cuts = coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
    empty = pc.index(distinct, pa.scalar(b"", pa.binary())).as_py()
    if empty >= 0:  # white space at either end splits off an empty word
        real = index != empty
        cuts = np.concatenate([[0], np.cumsum(real)])[cuts]
        index = index[real]
    return distinct, index, cuts


def steps(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of bounded size together."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"") + 8
        if size > 4 * STEP:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def token_counts(texts: DataFrame) -> DataFrame:
    """(token binary, c bigint) over all rows of ``texts`` (text); the end token is the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).cast(pa.binary()).to_pylist()
            for lo, hi in steps(texts):
                distinct, index, _ = coded_words(texts[lo:hi])
                n = np.bincount(index, minlength=len(distinct))
                tokens = pa.concat_arrays([distinct, pa.array([b""], pa.binary())])
                yield pa.record_batch([tokens, pa.array(np.append(n, hi - lo))], ["token", "c"])

    return texts.mapInArrow(run, "token binary, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


def bucket(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) % BUCKETS


@dataclass
class Codes:
    """Huffman paths of all symbols: head words by falling count, then the end, then the buckets."""

    symbols: dict[bytes, int]
    counts: np.ndarray  # of head words and the end
    start: np.ndarray
    length: np.ndarray
    path: np.ndarray  # 2 * node + bit
    gate: np.ndarray  # by node

    @classmethod
    def build(cls, head: list[tuple[bytes, int]], ends: int, tail: np.ndarray) -> Codes:
        weights = [c for _, c in head] + [ends] + tail.tolist()
        n = len(weights)
        heap = [(w + 1, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, bit = np.zeros(2 * n - 1, np.int32), np.zeros(2 * n - 1, np.int32)
        for k in range(n, 2 * n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i], parent[j], bit[j] = k, k, 1
            heapq.heappush(heap, (a + b, k))
        root = 2 * n - 2
        depth = np.zeros(2 * n - 1, np.int64)
        for k in range(root - 1, -1, -1):  # parents come after their children
            depth[k] = depth[parent[k]] + 1
        length = depth[:n].copy()
        start = np.cumsum(length) - length
        path, at, left = np.zeros(length.sum(), np.int32), np.arange(n), length.copy()
        symbol = np.arange(n)
        while (more := left > 0).any():
            at, left, symbol = at[more], left[more], symbol[more]
            path[start[symbol] + left - 1] = 2 * (parent[at] - n) + bit[at]
            at, left = parent[at], left - 1
        gate = np.minimum(depth[n:], GATES - 1).astype(np.uint8)
        return cls({w: i for i, (w, _) in enumerate(head)}, np.array([c for _, c in head] + [ends], np.int64), start, length, path, gate)

    def tokens(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Symbols with an end after each text, where texts begin and end, the distinct words and
        the number of each token's word (-1 for ends)."""
        distinct, index, cuts = coded_words(texts)
        end = len(self.counts) - 1
        get = self.symbols.get
        by = np.array([end + 1 + bucket(w) if (s := get(w)) is None else s for w in distinct.to_pylist()], np.int32)
        sym = np.insert(by[index], cuts[1:], end)
        return sym, cuts + np.arange(len(cuts)), distinct, np.insert(index.astype(np.int64), cuts[1:], -1)

    def contexts(self, sym: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's contexts: the word before (0: none, else its symbol + 1) and the last frequent word before (none: the number of symbols)."""
        n = len(sym)
        first = np.zeros(n, bool)
        first[cuts[:-1]] = True
        before = np.concatenate([[0], sym[:-1]]).astype(np.uint32) + np.uint32(1)
        before[first] = 0
        at = np.maximum.accumulate(np.where(sym < min(FREQUENT, len(self.counts) - 1), np.arange(n), -1))
        at = np.concatenate([[-1], at[:-1]])
        known = at >= np.repeat(cuts[:-1], np.diff(cuts))
        far = np.where(known, sym[at], len(self.length)).astype(np.uint32)
        return before, far

    def slots(self, sym: np.ndarray, cuts: np.ndarray) -> Iterator[np.ndarray]:
        """Hashes of each token's contexts."""
        before, far = self.contexts(sym, cuts)
        yield before * np.uint32(0x9E3779B1)
        yield far * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F)

    def bits(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Path entries of the tokens laid end to end, and each token's number of them."""
        n = self.length[sym]
        return self.path[np.arange(n.sum()) + np.repeat(self.start[sym] - (np.cumsum(n) - n), n)], n


def slots_for(tokens: int) -> int:
    """Slots to give to ``score_texts`` for tables that go to every worker: one for each four tokens, in powers of two and within bounds."""
    least, most = SLOTS
    return min(most, max(least, 1 << (max(1, tokens) // 4).bit_length()))


def context_slots(node: np.ndarray, hashes: list[np.ndarray], n: np.ndarray, slots: int) -> list[np.ndarray]:
    """Slots of each decision: the node itself, and hashes of it with each context."""
    mixed, shift = node.astype(np.uint32) * np.uint32(0xC2B2AE35), np.uint32(32 - slots.bit_length() + 1)
    return [node, *(((np.repeat(h, n) ^ mixed) * np.uint32(0x2C1B3C6D) >> shift).astype(np.int32) for h in hashes)]


def slot_tables(texts: DataFrame, shipped, slots: int, nodes: int) -> list[np.ndarray]:
    """Log-odds of each decision by context slot, from how often it went either way over all rows.

    Each task sends its counts in chunks of CHUNK slots, which are summed by chunk; the driver gets
    one number for each slot, whatever the size of the corpus.
    """
    sizes = [-(-nodes // CHUNK) * CHUNK, *[-(-slots // CHUNK) * CHUNK] * (CONTEXTS - 1)]
    firsts = np.concatenate([[0], np.cumsum(sizes)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shipped.value
        total = np.zeros(2 * firsts[-1], np.int64)
        for b in batches:
            texts = b.column(0).cast(pa.binary()).to_pylist()
            for lo, hi in steps(texts):
                sym, cuts, _, _ = codes.tokens(texts[lo:hi])
                hashes = list(codes.slots(sym, cuts))
                path, n = codes.bits(sym)
                for k, slot in enumerate(context_slots(path >> 1, hashes, n, slots)):
                    total[2 * firsts[k] : 2 * firsts[k + 1]] += np.bincount(slot * 2 + (path & 1), minlength=2 * sizes[k])
        parts = total.reshape(-1, 2 * CHUNK)
        used = np.flatnonzero(parts.any(axis=1))
        for k in used.tolist():
            wide = parts[k].max() >> 31
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([parts[k].astype("<i8" if wide else "<i4").tobytes()], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(raw, "<i4" if len(raw) == 8 * CHUNK else "<i8")
                sums[k] = sums[k] + counts if k in sums else counts.astype(np.int64)
        for k, c in sums.items():
            odds = stretch(c[0::2], c[1::2], DOUBT if k * CHUNK >= firsts[1] else 0)
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([odds.tobytes()], pa.binary())], ["chunk", "odds"])

    summed = texts.mapInArrow(run, "chunk int, counts binary").repartition("chunk").mapInArrow(add, "chunk int, odds binary")
    table = np.zeros(firsts[-1], np.float32)
    for k, odds in summed.toLocalIterator():
        table[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(odds, np.float32)
    return [table[a:b] for a, b in zip(firsts[:-1], firsts[1:], strict=True)]


def stretch(n0: np.ndarray, n1: np.ndarray, doubt: float = 0) -> np.ndarray:
    """Log-odds from counts; ``doubt`` draws those of few counts to nothing, so rare contexts have little say."""
    return (np.log((n1 + 0.4) / (n0 + 0.4)) * (n0 + n1) / np.maximum(n0 + n1 + doubt, 1)).astype(np.float32)


def node_odds(codes: Codes, seen: np.ndarray) -> np.ndarray:
    """Log-odds of each decision without context, from how often each symbol was seen."""
    by = np.bincount(codes.path, weights=np.repeat(seen, codes.length), minlength=2 * len(codes.gate))
    return stretch(by[0::2], by[1::2])


def coarse(odds: np.ndarray) -> np.ndarray:
    """Log-odds rounded to a byte, the same for either sign."""
    return np.rint(np.arcsinh(np.clip(odds, -WIDEST, WIDEST) * BEND) * (LEVELS / np.arcsinh(BEND * WIDEST))).astype(np.int8)


def pack(a: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, empty upper ones left out, compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    used = 1 + max(np.flatnonzero(planes.any(axis=1)).tolist(), default=0)
    return len(a).to_bytes(8, "little") + bytes([used]) + pa.compress(planes[:used].tobytes(), "zstd", asbytes=True)


def unpack(raw: bytes, kind: str) -> np.ndarray:
    n, used = int.from_bytes(raw[:8], "little"), raw[8]
    a = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    a[:, :used] = np.frombuffer(pa.decompress(raw[9:], n * used, "zstd", asbytes=True), np.uint8).reshape(used, n).T
    return a.view(kind).reshape(n)


def ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[heads], np.add.reduceat(counts[order], heads) if len(heads) else counts


@dataclass
class Pairs:
    """Numbers for pairs of a context and a symbol: the context's times the number of symbols, and the
    rank of the symbol's code. A node's symbols lie side by side in a context, so do a shard's contexts."""

    rank: np.ndarray  # by symbol
    code: np.ndarray  # bits from the top, by rank
    length: np.ndarray  # by rank
    shards: np.ndarray  # first pair of each shard

    @classmethod
    def build(cls, codes: Codes, seen: np.ndarray, shards: int) -> Pairs:
        depth = np.arange(len(codes.path)) - np.repeat(codes.start, codes.length)
        code = np.bitwise_or.reduceat((codes.path & 1).astype(np.uint64) << (63 - depth).astype(np.uint64), codes.start)
        order = np.argsort(code)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        # Shards have like numbers of distinct pairs, which grow less than a context's tokens do.
        end = len(codes.counts) - 1
        far = np.zeros(FREQUENT + 1)
        far[: min(FREQUENT, end)] = seen[: min(FREQUENT, end)]
        far *= seen.sum() / max(1, far.sum())
        much = np.cumsum(np.concatenate([seen[end : end + 1], seen, far]) ** 0.75)
        first = np.unique(np.searchsorted(much, much[-1] * np.arange(1, shards) / shards))
        return cls(rank, code[order], codes.length[order], np.concatenate([[0], first[first > 0]]) * len(order))

    def of(self, codes: Codes, sym: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
        """Pairs of each token with the word before it and with the last frequent word."""
        before, far = codes.contexts(sym, cuts)
        n = len(self.rank)
        return [before.astype(np.int64) * n + self.rank[sym], (n + 1 + np.minimum(far, FREQUENT).astype(np.int64)) * n + self.rank[sym]]

    def cuts(self, keys: np.ndarray) -> np.ndarray:
        """Where the shards begin and end in sorted pairs."""
        return np.append(np.searchsorted(keys, self.shards), len(keys))

    def shared(self, keys: np.ndarray) -> np.ndarray:
        """How many first decisions of each pair's path are at nodes that the pair before it passed in the same context."""
        context, rank = keys // len(self.rank), keys % len(self.rank)
        differ = self.code[rank[1:]] ^ self.code[rank[:-1]]
        high = (differ >> np.uint64(32)).astype(float)
        low = (differ & np.uint64(0xFFFFFFFF)).astype(float)
        same = 1 + np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1])
        return np.concatenate([[0], np.where(context[1:] == context[:-1], same, 0)])[: len(keys)]

    def blocks(self, keys: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of sorted pairs, of whole contexts and bounded size."""
        begins = np.flatnonzero(np.diff(keys // len(self.rank), prepend=-1))
        if len(begins):
            cuts = np.unique(np.append(begins[np.searchsorted(begins, np.arange(0, begins[-1] + 1, PAIRS))], len(keys))).tolist()
            yield from zip(cuts[:-1], cuts[1:], strict=True)

    def odds(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log-odds (coarse) of the decisions taken along the paths of sorted distinct pairs, laid end to end,
        from the counts of all pairs of the same contexts."""
        parts = [np.zeros(0, np.int8)]
        for a, b in self.blocks(keys):
            shared, length, n = self.shared(keys[a:b]), self.length[keys[a:b] % len(self.rank)], counts[a:b]
            out = np.zeros((int(length.max()), b - a), np.int8)
            above = np.flatnonzero(shared == 0)
            total = np.add.reduceat(n, above)
            for d in range(len(out)):  # pairs that take the same way at a node lie side by side
                heads = np.flatnonzero(shared <= d + 1)
                own = np.add.reduceat(n, heads)
                node = total[np.searchsorted(above, heads, "right") - 1]
                out[d] = np.repeat(coarse(stretch(node - own, own, DOUBT)), np.diff(np.append(heads, b - a)))
                above, total = heads, own
            parts.append(out.T[np.arange(len(out)) < length[:, None]])
        return np.concatenate(parts)

    def spread(self, keys: np.ndarray, taken: np.ndarray) -> np.ndarray:
        """Log-odds (coarse) of ones along the paths of sorted distinct pairs, laid end to end, from those of the
        decisions taken at nodes that aren't shared with the pair before."""
        parts, begin = [np.zeros(0, np.int8)], 0
        for a, b in self.blocks(keys):
            rank = keys[a:b] % len(self.rank)
            shared, length = self.shared(keys[a:b]), self.length[rank]
            depth = np.arange(int(length.max()))
            own = (depth >= shared[:, None]) & (depth < length[:, None])
            one = (self.code[rank][:, None] >> (63 - depth).astype(np.uint64) & np.uint64(1)).astype(bool)
            out, n = np.zeros(own.shape, np.int8), int(own.sum())
            out[own] = taken[begin : begin + n] * np.where(one[own], np.int8(1), np.int8(-1))
            begin += n
            for d in depth.tolist():
                out[:, d] = out[np.maximum.accumulate(np.where(shared <= d, np.arange(b - a), 0)), d]
            parts.append(out[depth < length[:, None]])
        return np.concatenate(parts)


def answers(pairs) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (shard, again, unit, keys, counts), sorted by the first two: each unit's pairs of a shard twice, first to be
    counted, then to be answered. Memory goes by the distinct pairs of a shard, not by how many units ask for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, size = pairs.value, None, 0
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        odds = None
        for b in batches:
            for k, again, unit, raw, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != shard:
                    shard, size, parts, odds = k, 0, [], None
                keys = np.cumsum(unpack(raw, "<i8"))
                if not again:
                    parts.append((keys, unpack(counts, "<i8")))
                    size += len(keys)
                    if size > 2 * len(parts[0][0]) + 16 * PAIRS:
                        parts = [summed(*map(np.concatenate, zip(*parts, strict=True)))]
                        size = len(parts[0][0])
                    continue
                if odds is None:
                    known, n = summed(*map(np.concatenate, zip(*parts, strict=True)))
                    parts, odds, length = [], own.odds(known, n), own.length[known % len(own.rank)]
                    start = np.cumsum(length) - length
                at, shared = np.searchsorted(known, keys), own.shared(keys)
                yield pa.record_batch(
                    [pa.array([unit]), pa.array([k], pa.int32()), pa.array([pack(odds[ragged(start[at] + shared, length[at] - shared)])], pa.binary()), pa.array([None], pa.binary()), pa.array([None], pa.int64())],
                    ["unit", "shard", "keys", "counts", "row"],
                )

    return lean(run)


def unit_logs(mixer, pairs) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row, logs) from (unit, shard, keys, counts, row), sorted by the first two: a unit's answers, then its texts' symbols."""

    def score(odds: list[bytes], texts: list[tuple[np.ndarray, np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
        own, codes = pairs.value, mixer.value.codes
        at, asked, end = [], [], 0
        for kind in range(CONTEXTS - 1):  # the contexts of a kind follow those of the other
            distinct, place = np.unique(np.concatenate([own.of(codes, sym, cuts)[kind] for sym, cuts, _ in texts]), return_inverse=True)
            length = own.length[distinct % len(own.rank)]
            at.append((end + np.cumsum(length) - length).astype(np.int32)[place])
            end += int(length.sum())
            asked.append(distinct)
            del place
        found = own.spread(np.concatenate(asked), np.concatenate([unpack(o, "i1") for o in odds])).view(np.uint8)
        odds.clear()
        begin = 0
        for sym, cuts, row in texts:
            logs = mixer.value.score(sym, cuts, (found, [a[begin : begin + len(sym)] for a in at])) / np.log(10)
            begin += len(sym)
            yield pa.record_batch([pa.array(np.arange(row, row + len(logs))), pa.array(logs)], ["row", "logs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, odds, texts = None, [], []
        for b in batches:
            for u, shard, raw, cuts, row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if u != unit and texts:
                    yield from score(odds, texts)
                    odds, texts = [], []
                unit = u
                if shard < TEXTS:
                    odds.append(raw)
                else:
                    texts.append((unpack(raw, "<i4"), np.cumsum(unpack(cuts, "<i8")), row))
        if texts:
            yield from score(odds, texts)

    return lean(run)


@dataclass
class Mixer:
    codes: Codes
    stretched: list[np.ndarray]
    slots: int
    weights: np.ndarray = field(default_factory=lambda: WEIGHTS)
    rate: float = RATE

    def score(self, sym: np.ndarray, cuts: np.ndarray, found: tuple[np.ndarray, list[np.ndarray]] | None = None) -> np.ndarray:
        """Natural log-probability of each text's symbols; ``found`` has log-odds of decisions, and
        where each token's begin by context, in place of hashed slots.

        All texts move on together, a block of tokens at a time; a block is coded with weights that
        only earlier blocks of the same text have refined.
        """
        lengths = np.diff(cuts)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        block = (np.arange(len(sym)) - np.repeat(cuts[:-1], lengths)) // BLOCK
        order = np.argsort(block, kind="stable")
        path, n = self.codes.bits(sym[order])
        node, sign = path >> 1, (1 - 2 * (path & 1)).astype(np.float32)
        if found:
            x = [self.stretched[0][node], *(FINE[found[0][ragged(at[order].astype(np.int64), n)]] for at in found[1])]
        else:
            hashes = [h[order] for h in self.codes.slots(sym, cuts)]
            x = [t[s] for t, s in zip(self.stretched, context_slots(node, hashes, n, self.slots), strict=True)]
        gate = self.codes.gate[node]
        z = sum(xk * self.weights[:, k][gate] for k, xk in enumerate(x))
        ends = np.cumsum(n)
        edges = np.flatnonzero(np.diff(block[order])) + 1
        edges = np.concatenate([[0], edges, [len(sym)]])
        total = np.zeros(len(lengths))
        shift = np.zeros((len(lengths), CONTEXTS), np.float32)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if a == b:
                continue
            lo, hi = int(ends[a] - n[a]), int(ends[b - 1])
            docs = doc[order[a:b]]
            heads = np.concatenate([[0], np.flatnonzero(np.diff(docs)) + 1])
            begins = (ends[a + heads] - n[a + heads]) - lo
            own = docs[heads]
            sizes = np.diff(np.concatenate([begins, [hi - lo]]))
            zb = z[lo:hi]
            if a:
                zb = zb + sum(x[k][lo:hi] * np.repeat(shift[own, k], sizes) for k in range(CONTEXTS))
            e = np.exp(np.clip(zb * sign[lo:hi], -30, 30))  # odds of the decision not taken
            total[own] -= np.add.reduceat(np.log1p(e), begins)
            if b < len(sym):
                error = -sign[lo:hi] * (e / (1 + e))
                for k in range(CONTEXTS):
                    shift[own, k] += self.rate * np.add.reduceat(x[k][lo:hi] * error, begins) / (sizes * 8)
        return total


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int | None = None) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Counts come from all rows outside the held-out fold. base_score is the log10 probability under
    add-one smoothed token counts, score that of the mixed model; both treat an unknown word as one
    event. Common words' counts travel by broadcast (HEAD of them); all others are joined by token.
    Null texts count as empty, hence as one end token. No documents give no rows; repeated rows are
    scored alike, rows that share an id each by their own text; other columns don't matter. Each
    context has its own counts unless ``slots`` (a power of two) has them hashed.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    modulus, held = HELD_OUT
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), (fold(F.col(id_col), modulus) == held).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    train = rows.where(~F.col("held_out")).select("text")
    counts = scratch.table(token_counts(train).where("c > 0"), "counts")
    n_train, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    end = F.length("token") == 0
    # The head is cut at a count, found from the histogram of counts, so that nothing is sorted and
    # no task sees more than its own part; ties at the cut stay out.
    sizes = counts.where(~end).groupBy("c").count().toArrow().sort_by([("c", "descending")])
    within = np.flatnonzero(np.cumsum(sizes["count"].to_numpy()) <= HEAD)
    least = int(sizes["c"][int(within[-1])].as_py()) if len(within) else 1 << 62
    top_rows = counts.where(~end & (F.col("c") >= least)).toArrow()
    top = sorted(zip(top_rows["token"].to_pylist(), top_rows["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    ends = counts.where(end).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]

    rare = counts.where(~end & (F.col("c") < least))

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([bucket(t) for t in b.column(0).to_pylist()], pa.int32())], ["token", "c", "bucket"])

    tail = rare.mapInArrow(by_bucket, "token binary, c bigint, bucket int")
    per = {r["bucket"]: (r["c"], r["once"]) for r in tail.groupBy("bucket").agg(F.sum("c").alias("c"), F.count_if(F.col("c") == 1).alias("once")).collect()}
    mass = np.array([per.get(k, (0, 0)) for k in range(BUCKETS)], float)
    codes = Codes.build(top, ends, (mass[:, 0] + mass[:, 1]).astype(np.int64))
    shipped, pairs = spark.sparkContext.broadcast(codes), None
    seen = np.concatenate([codes.counts, mass[:, 0]])
    if slots:
        mixer = spark.sparkContext.broadcast(Mixer(codes, slot_tables(train, shipped, slots, len(codes.gate)), slots))
    else:
        mixer = spark.sparkContext.broadcast(Mixer(codes, [node_odds(codes, seen)], 0))
        pairs = spark.sparkContext.broadcast(Pairs.build(codes, seen, 1 + int(n_train or 0) // SHARD))
    del top_rows, sizes
    head_logs = np.log10(codes.counts + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, nth = mixer.value, TaskContext.get().partitionId() << 40
        end_symbol = len(own.codes.counts) - 1
        unit, size = nth, 0
        asked: list[list[np.ndarray]] = []
        for b in batches:
            texts = b.column(2).cast(pa.binary()).to_pylist()
            parts = []
            for lo, hi in steps(texts):
                sym, cuts, distinct_words, index = own.codes.tokens(texts[lo:hi])
                if slots:
                    logs = own.score(sym, cuts) / np.log(10)
                else:
                    if size > UNIT:
                        yield from requests(b, unit, asked)
                        unit, size, asked = nth + lo, 0, []
                    yield whole_rows(b, {"unit": pa.array([unit]), "shard": pa.array([TEXTS], pa.int32()), "keys": pa.array([pack(sym.astype("<i4"))], pa.binary()), "counts": pa.array([pack(np.diff(cuts, prepend=0).astype("<i8"))], pa.binary()), "row": pa.array([nth + lo])})
                    learnt = np.repeat(~b.column(1)[lo:hi].to_numpy(zero_copy_only=False), np.diff(cuts))
                    asked.append([k * 2 + learnt for k in pairs.value.of(own.codes, sym, cuts)])
                    size += len(sym)
                    logs = np.zeros(hi - lo)
                plain = sym <= end_symbol
                base = np.add.reduceat(np.where(plain, head_logs[np.minimum(sym, end_symbol)], 0.0), cuts[:-1])
                known = np.add.reduceat((plain & (codes_known[np.minimum(sym, end_symbol)])).astype(np.int64), cuts[:-1])
                tail = np.flatnonzero(~plain)
                doc = np.repeat(np.arange(hi - lo), np.diff(cuts))[tail]
                key, n = np.unique(doc * len(distinct_words) + index[tail], return_counts=True)
                place = np.concatenate([[0], np.cumsum(np.bincount(key // max(1, len(distinct_words)), minlength=hi - lo))]).astype(np.int32)
                which = key % max(1, len(distinct_words))
                by_word = np.zeros(len(distinct_words), np.int32)
                by_word[index[tail]] = sym[tail] - end_symbol - 1
                lists = [pa.ListArray.from_arrays(pa.array(place), v) for v in (distinct_words.take(pa.array(which)), pa.array(n.astype(np.int32)), pa.array(by_word[which]))]
                parts.append((np.diff(cuts), known, base, logs, *lists))
            cols = [np.concatenate([p[i] for p in parts]) for i in range(4)]
            row = nth + np.arange(b.num_rows)
            nth += b.num_rows
            arrays = [pa.array(row), b.column(0), b.column(1), pa.array(cols[0].astype(np.int64)), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3])]
            arrays += [pa.concat_arrays([p[i] for p in parts]) for i in (4, 5, 6)]
            arrays.append(pa.array([len(t or b"") for t in texts], pa.int64()))
            yield whole_rows(b, dict(zip(["row", "id", "held_out", "n_tokens", "known", "base", "logs", "words", "times", "buckets", "bytes"], arrays, strict=True)))
        if asked:
            yield from requests(b, unit, asked)

    def whole_rows(b: pa.RecordBatch, given: dict[str, pa.Array]) -> pa.RecordBatch:
        """Rows of texts, of symbols or of pairs, with nulls for what the others have."""
        types = {
            "row": pa.int64(), "id": b.column(0).type, "held_out": pa.bool_(), "n_tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "logs": pa.float64(), "words": pa.list_(pa.binary()),
            "times": pa.list_(pa.int32()), "buckets": pa.list_(pa.int32()), "bytes": pa.int64(), "unit": pa.int64(), "shard": pa.int32(), "keys": pa.binary(), "counts": pa.binary(),
        }
        n = len(next(iter(given.values())))
        return pa.record_batch([given[k] if k in given else pa.nulls(n, t) for k, t in types.items()], list(types))

    def requests(b: pa.RecordBatch, unit: int, asked: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        parts = []
        for kind_of in zip(*asked, strict=True):  # the contexts of a kind follow those of the other
            both = np.concatenate(kind_of)
            both.sort()
            heads = np.flatnonzero(np.diff(both >> 1, prepend=-1))
            parts.append((both[heads] >> 1, np.add.reduceat(both & 1, heads)))
        keys, counts = (np.concatenate(p) for p in zip(*parts, strict=True))
        cuts = pairs.value.cuts(keys).tolist()
        for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if lo < hi:
                yield whole_rows(b, {"unit": pa.array([unit]), "shard": pa.array([k], pa.int32()), "keys": pa.array([pack(np.diff(keys[lo:hi], prepend=0))], pa.binary()), "counts": pa.array([pack(counts[lo:hi])], pa.binary())})

    codes_known = codes.counts > 0
    schema = f"row bigint, id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, logs double, words array<binary>, times array<int>, buckets array<int>, bytes bigint, unit bigint, shard int, keys binary, counts binary"
    coded = scratch.table(rows.mapInArrow(lean(run), schema), "coded")
    scored = coded.where("shard IS NULL").drop("unit", "shard", "keys", "counts")
    if not slots:
        free(spark)
        tasks = len(pairs.value.shards)
        twice = coded.where(F.col("shard") < TEXTS).withColumn("again", F.explode(F.array(F.lit(False), F.lit(True)))).select("shard", "again", "unit", "keys", F.when(~F.col("again"), F.col("counts")).alias("counts"))
        found = twice.repartitionById(tasks, "shard").sortWithinPartitions("shard", "again").mapInArrow(answers(pairs), "unit bigint, shard int, keys binary, counts binary, row bigint")
        symbols = coded.where(F.col("shard") == TEXTS).select("unit", "shard", "keys", "counts", "row")
        by_unit = found.unionByName(symbols).repartition(2 * tasks, "unit").sortWithinPartitions("unit", "shard", "row")
        logs = scratch.table(by_unit.mapInArrow(unit_logs(mixer, pairs), "row bigint, logs double"), "logs")
        scored = scored.drop("logs").join(logs, "row")
        free(spark)
    # What is known of the words without a code: their count, and their share of their bucket, of
    # which as much is left to unknown words as words seen once make up.
    masses = spark.createDataFrame([(k, float(c), float(once)) for k, (c, once) in enumerate(mass.tolist())], "bucket int, mass double, once double")
    unknown = (F.col("once") + 1) / (F.col("mass") + F.col("once") + 2)
    pairs = scored.select("row", F.explode(F.arrays_zip("words", "times", "buckets")).alias("z")).select("row", F.col("z.words").alias("token"), F.col("z.times").alias("n"), F.col("z.buckets").alias("bucket"))
    looked = pairs.join(rare, "token", "left").join(F.broadcast(masses), "bucket")
    share = F.log10(F.when(F.col("c").isNull(), unknown).otherwise((1 - unknown) * F.col("c") / F.col("mass")))
    rest = looked.select("row", F.when(F.col("c").isNull(), 0).otherwise(F.col("n")).alias("known"), (F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("base"), (F.col("n") * share).alias("logs"))
    rest = rest.groupBy("row").agg(*(F.sum(k).alias(f"{k}_") for k in ("known", "base", "logs")))
    whole = scored.drop("words", "times", "buckets").join(rest, "row", "left").na.fill(0, ["known_", "base_", "logs_"])
    score = F.col("logs") + F.col("logs_")
    return whole.select(
        "id", "held_out", "n_tokens", (F.col("known") + F.col("known_")).alias("n_known"), F.lit(int(n_train)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("base_") - F.col("n_tokens") * float(np.log10(n_train + distinct + 1))).alias("base_score"), score.alias("score"),
        F.when(F.col("bytes") > 0, -score * float(np.log2(10)) / F.col("bytes")).alias("bits_per_byte"),
    )
