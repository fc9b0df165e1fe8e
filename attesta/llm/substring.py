"""Repeated passages across documents, by compact windows of token min-hashes.

Tokens are five-word shingles. Under each hash function the Cartesian tree of a text's token hashes
gives its compact windows: all runs of tokens inside [lo, hi] that hold ``at`` have their min-hash
there. So two similar passages of 50 words lie in windows of one min-hash with the probability of
their similarity, and equal passages always. Windows of equal min-hashes are joined where their
intervals leave room for such a passage, and what they join is verified on the tokens themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, free, lean, pieces, union_all, unused
from .words import run_hashes, word_hashes

SHINGLE, MIN_WORDS, SIMILARITY = 5, 50, 0.8
#: Hash functions, and how many of them must join a passage that isn't an exact copy.
HASHES, ENOUGH = 4, 2
#: Tokens of a passage of MIN_WORDS, and those shown on either side of a window's minimum.
LEAST = MIN_WORDS - SHINGLE + 1
REACH = LEAST - 1
#: Two windows are compared if the tokens that end or begin at their minima agree this far; any exact
#: passage does, and so does one of 0.8, whose longest equal stretch is about twice as long.
SIDE = 10
#: Rows of one min-hash that one task compares; larger groups are split.
HOT = 16_384
#: Two passages of SIMILARITY have so many equal tokens in a row; a run of STRETCH among them is picked of each PICK.
ANCHORED, STRETCH, PICK = 20, 16, 5
#: Groups up to this size are compared without picking anchors.
FEW = 64
#: Words by which one passage may be shifted against the other within REACH of a minimum.
SHIFT = 3
#: Tokens that two runs of SIMILARITY and LEAST tokens share at least: k of l, with k / (2 l - k) at SIMILARITY.
SHARED = int(np.ceil(2 * SIMILARITY / (1 + SIMILARITY) * LEAST - 1e-9))

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_WIDTH = 2 * REACH + 1


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all five-word shingles of ``texts`` laid end to end, words lower-cased in A-Z, and where those
    of each text begin and end. Each text's last words begin none; their places lie between."""
    hashes, cuts = word_hashes(texts)
    return run_hashes(hashes, SHINGLE), cuts[:-1], np.maximum(cuts[1:] - SHINGLE + 1, cuts[:-1])


def mixed(values: np.ndarray, i: int) -> np.ndarray:
    x = values * _MULTIPLIERS[i]
    return (x ^ (x >> np.uint64(31))) * _MULTIPLIERS[(i + 1) % len(_MULTIPLIERS)]


def _sliding(values: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` (minimum or maximum) over each run of ``width`` values."""
    out, span = values, 1
    while span * 2 <= width:
        out, span = of(out[:-span], out[span:]), span * 2
    return of(out[: len(values) - width + 1], out[width - span :]) if span < width else out


def compact_windows(values: np.ndarray, least: int = LEAST, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, at, hi) of the Cartesian tree's nodes that span ``least`` values or more, in order of ``at``.

    Each run of that length or more belongs to exactly one window, the one inside whose [lo, hi] it
    holds ``at``, and has its minimum there. Of equal values a pseudo-random one counts as least, so a text
    of one word gives few windows too. Values are 64-bit hashes, compared in their upper 48 bits;
    no window holds a place in ``breaks``.
    """
    n = len(values)
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    noise = (np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    key = ((values | np.uint64(0xFFFF)) ^ noise) | np.uint64(1 << 16)
    edge = np.zeros(n, bool)
    if breaks is not None:
        edge[breaks] = True
        key[breaks] = 0
    low, pad = _sliding(key, least, np.minimum), np.zeros(least - 1, np.uint64)
    # a place is the least of some run if it is as great as the greatest least of the runs that hold it;
    # whatever bounds such a place's window is such a place itself, so the tree needs no others
    places = np.flatnonzero((_sliding(np.concatenate([pad, low, pad]), least, np.maximum) == key) | edge)
    at, keys = places.tolist(), key[places].tolist()
    lo, hi, stack = [0] * len(at), [n - 1] * len(at), []
    for i, k in enumerate(keys):
        p = at[i]
        while stack and keys[stack[-1]] > k:
            hi[stack.pop()] = p - 1
        if stack:
            lo[i] = at[stack[-1]] + 1
        stack.append(i)
    lo, hi = np.array(lo, np.int64), np.array(hi, np.int64)
    kept = (hi - lo + 1 >= least) & ~edge[places]
    return lo[kept], places[kept], hi[kept]


def _run_hashes(shingles: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` shingles, by where it begins."""
    n = len(shingles) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key, span = shingles, 1
    while span * 2 <= width:
        key, span = (key[:-span] * np.uint64(0xFF51AFD7ED558CCD)) ^ (key[span:] + (key[:-span] >> np.uint64(33))), span * 2
    if span < width:
        key = (key[:n] * np.uint64(0xC4CEB9FE1A85EC53)) ^ (key[width - span : width - span + n] + (key[:n] >> np.uint64(33)))
    return mixed(key[:n], 0)


def _near_again(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which tokens stand a second time within REACH."""
    padded = np.concatenate([np.zeros(REACH, s.dtype), s, np.zeros(REACH, s.dtype)])
    out = np.zeros(len(at), bool)
    for a in range(0, len(at), 10_000):
        p = slice(a, a + 10_000)
        out[p] = (padded[at[p, None] + np.arange(_WIDTH)] == s[at[p], None]).sum(axis=1) > 1
    return out


def windows(texts: DataFrame) -> DataFrame:
    """(sign, doc, copy, h, lo, at, hi, before, after, again, first) of all compact windows of ``texts`` (doc, copy, text).

    ``sign`` is the min-hash, told apart by hash function; ``before`` and ``after`` hash the SIDE
    tokens that end and begin at it (0: there aren't so many). ``again`` is 1 if it stands a second
    time within REACH: which of the two counts as least may differ between texts, and so may the sides.
    ``first`` is 1 for one window of each sign in a document. One pass, some HASHES rows for each 23 words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2):
            s, begins, ends = tokens(b.column(2).cast(pa.binary()).to_pylist())
            if not len(s):
                continue
            inside = np.zeros(len(s) + 1, np.int8)
            np.add.at(inside, begins, 1), np.add.at(inside, ends, -1)
            breaks = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8) == 0)
            sides = (_run_hashes(s, SIDE) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            for h in range(HASHES):
                v = mixed(s, h)
                lo, at, hi = compact_windows(v, LEAST, breaks)
                doc = np.searchsorted(begins, at, "right") - 1
                begin, end = begins[doc], ends[doc]
                before = np.where(at - SIDE + 1 >= begin, sides[np.maximum(at - SIDE + 1, 0)], 0)
                after = np.where(at + SIDE <= end, sides[np.minimum(at, len(sides) - 1)], 0)
                sign = mixed(v[at] ^ np.uint64(h), 5).view(np.int64)
                order = np.lexsort((sign, doc))
                new = np.concatenate([[True], (np.diff(sign[order]) != 0) | (np.diff(doc[order]) != 0)])[: len(at)]
                first = np.zeros(len(at), np.int8)
                first[order[new]] = 1
                which = pa.array(doc)
                ints = [pa.array(x.astype(np.int32)) for x in (lo - begin, at - begin, hi - begin, before, after)]
                columns = [pa.array(sign), b.column(0).take(which), b.column(1).take(which), pa.array(np.full(len(at), h, np.int8)), *ints, pa.array(_near_again(s, at).astype(np.int8)), pa.array(first)]
                yield pa.record_batch(columns, ["sign", "doc", "copy", "h", "lo", "at", "hi", "before", "after", "again", "first"])

    kind = dict(texts.dtypes)["doc"]
    return texts.select("doc", "copy", "text").mapInArrow(lean(run), f"sign bigint, doc {kind}, copy bigint, h tinyint, lo int, at int, hi int, before int, after int, again tinyint, first tinyint")


def _among(rows: DataFrame, on: list[Column], keys: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows of ``rows`` one of whose ``on`` (bigint) is among the distinct ``keys`` (key), and a few others.

    A bitmap of hashed keys, of 32 MB at most, goes to all tasks and spares the rows a shuffle.
    Beyond 2^24 keys it would be full, and joins on each key take its place.
    """
    keys = scratch.table(keys, name)
    n = keys.count()
    if n > 1 << 24:
        for k, c in enumerate(on):
            rows = rows.withColumn("key_", c).join(keys.select(F.col("key").alias("key_"), F.lit(True).alias(f"has_{k}")), "key_", "left").drop("key_")
        return rows.where(" OR ".join(f"has_{k}" for k in range(len(on)))).drop(*(f"has_{k}" for k in range(len(on))))
    bits = 1 << max(20, (16 * n).bit_length())
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    maps = keys.select(bit("key").alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    names, tests = rows.columns, []
    for k, c in enumerate(on):
        rows = rows.withColumn(f"bit_{k}", bit(c)).withColumn(f"bucket_{k}", F.bitmap_bucket_number(f"bit_{k}"))
        rows = rows.join(F.broadcast(maps.select(F.col("bucket").alias(f"bucket_{k}"), F.col("map").alias(f"map_{k}"))), f"bucket_{k}", "left")
        place = F.bitmap_bit_position(f"bit_{k}")
        byte = F.conv(F.hex(F.substring(f"map_{k}", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        tests.append(F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)))
    return rows.where(union_of(tests)).select(*names)


def union_of(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests)


def members(found: DataFrame, scratch: Scratch) -> DataFrame:
    """Windows (sign, doc, copy, h, lo, at, hi) of which another document has one of the same sign and an
    equal side, and a few others.

    Signs and sides are counted by aggregation, so one that a third of the rows hold is no burden.
    """
    counts = found.groupBy("sign").agg(F.sum("first").alias("docs")).where("docs > 1").select(F.col("sign").alias("key"))
    rows = scratch.table(_among(found.drop("first"), [F.col("sign")], counts, scratch, "signs"), "rows")
    side = lambda k, c: F.when(F.col(c) != 0, F.xxhash64("sign", F.lit(k), F.col(c).cast("int")))
    sides, key = [side(k, c) for k, c in enumerate(("before", "after", "again"))], F.struct("doc", "copy")
    counts = rows.select("doc", "copy", F.explode(F.array(*sides)).alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.min(key).alias("a"), F.max(key).alias("b"))
    return _among(rows, sides, counts.where("a <> b").select("key"), scratch, "sides").select("sign", "doc", "copy", "h", "lo", "at", "hi")


def _packed(around: np.ndarray) -> pa.Array:
    """Rows of 24-bit tokens as binary values."""
    raw = around.astype("<u4").view(np.uint8).reshape(len(around), _WIDTH, 4)[:, :, :3].tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(3 * _WIDTH), len(around), [None, pa.py_buffer(raw)]).cast(pa.binary())


def _unpacked(values: pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(values.to_pylist()), np.uint8).reshape(-1, _WIDTH, 3)
    out = np.zeros((len(raw), _WIDTH, 4), np.uint8)
    out[:, :, :3] = raw
    return out.view("<u4").reshape(-1, _WIDTH)


def surroundings(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` with ``around``: 24 bits of each of the _WIDTH tokens around ``at``, 0 beyond the window.

    One document's windows are brought together with its text, which is read once; their number is
    bounded by the text's length.
    """
    kind = dict(texts.dtypes)["doc"]
    own = rows.groupBy("doc", "copy").agg(F.collect_list(F.struct("sign", "h", "lo", "at", "hi")).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad, steps = np.zeros(REACH, np.uint32), np.arange(_WIDTH)
        for b in pieces(batches, 2):
            cuts, w = b.column(3).offsets.to_numpy(), b.column(3).values
            field = {k: w.field(k).to_numpy(zero_copy_only=False) for k in ("sign", "h", "lo", "at", "hi")}
            s, begins, _ = tokens(b.column(2).cast(pa.binary()).to_pylist())
            s = np.concatenate([pad, np.maximum((s >> np.uint64(40)).astype(np.uint32), 1), pad])
            for row, begin in enumerate(begins.tolist()):
                for a in range(int(cuts[row]), int(cuts[row + 1]), 10_000):
                    part = slice(a, min(a + 10_000, int(cuts[row + 1])))
                    lo, at, hi = (field[k][part].astype(np.int64) for k in ("lo", "at", "hi"))
                    place = at[:, None] + steps - REACH
                    around = np.where((place >= lo[:, None]) & (place <= hi[:, None]), s[begin + at[:, None] + steps], 0)
                    which = pa.array(np.full(len(at), row))
                    yield pa.record_batch(
                        [pa.array(field["sign"][part]), b.column(0).take(which), b.column(1).take(which), pa.array(field["h"][part]), pa.array(at.astype(np.int32)), _packed(around)],
                        ["sign", "doc", "copy", "h", "at", "around"],
                    )

    both = own.join(texts, ["doc", "copy"]).select("doc", "copy", "text", "w")
    return both.mapInArrow(lean(run), f"sign bigint, doc {kind}, copy bigint, h tinyint, at int, around binary")


def runs_of(around: np.ndarray, salt: np.ndarray, width: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(hash, whether it is whole) of each run of ``width`` tokens, by rows."""
    base = np.uint64(0x9E3779B97F4A7C15)
    top = np.uint64(pow(int(base), width, 1 << 64))
    sums = np.zeros((len(around), _WIDTH + 1), np.uint64)
    for k in range(_WIDTH):
        sums[:, k + 1] = sums[:, k] * base + around[:, k]
    whole = np.zeros((len(around), _WIDTH + 1), np.int32)
    np.cumsum(around != 0, axis=1, out=whole[:, 1:])
    return mixed((sums[:, width:] - sums[:, :-width] * top) ^ salt[:, None], 3), whole[:, width:] - whole[:, :-width] == width


def anchors(around: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash): of any PICK neighbouring runs of STRETCH tokens the one of the least hash, or more.

    Passages of SIMILARITY have ANCHORED equal tokens in a row, hence an anchor in common; texts that share no more
    than a common phrase have none, and needn't be compared.
    """
    keys, whole = runs_of(around, salt, STRETCH)
    keys = np.where(whole, keys, np.uint64((1 << 64) - 1))
    low = keys[:, : -PICK + 1]
    for k in range(1, PICK):
        low = np.minimum(low, keys[:, k : keys.shape[1] - PICK + 1 + k])
    high = np.zeros_like(keys)
    for k in range(PICK):
        np.maximum(high[:, k : k + low.shape[1]], low, out=high[:, k : k + low.shape[1]])
    row, at = np.nonzero((high == keys) & whole)
    return row, keys[row, at]


def parts_of(around: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """A number for each row; rows of one sign that are connected by common anchors have the same."""
    row, key = anchors(around, sign.view(np.uint64))
    label = np.arange(len(sign))
    order = np.argsort(key, kind="stable")
    row, key = row[order], key[order]
    if not len(row):
        return label
    heads = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0]))
    sizes = np.diff(np.concatenate([heads, [len(row)]]))
    while True:
        least = np.repeat(np.minimum.reduceat(label[row], heads), sizes)
        new = label.copy()
        np.minimum.at(new, row, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def exact_links(around: np.ndarray, sign: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, tokens, source row, start there) of runs of LEAST tokens or more that an earlier document holds.

    Rows are sorted by sign and document. Each run's source is the first row that holds it.
    """
    keys, whole = runs_of(around, sign)
    row, step = np.nonzero(whole)
    if not len(row):
        return (np.zeros(0, np.int64),) * 5
    _, first, which = np.unique(keys[row, step], return_index=True, return_inverse=True)
    source, place = row[first[which]], step[first[which]]
    other = doc[source] != doc[row]
    row, step, source, place = row[other], step[other], source[other], place[other]
    if not len(row):
        return (np.zeros(0, np.int64),) * 5
    new = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(step) != 1) | (np.diff(source) != 0) | (np.diff(place) != 1)])
    at_new = np.flatnonzero(new)
    n = np.diff(np.concatenate([at_new, [len(row)]])) + LEAST - 1
    return row[at_new], at[row[at_new]] - REACH + step[at_new], n, source[at_new], at[source[at_new]] - REACH + place[at_new]


def near_spans(x: np.ndarray, y: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, from in y, to in y) of each row's longest run around the minimum that may be SIMILARITY like; from > to if there is none.

    A token counts as shared if it stands at the same distance from the minimum, give or take SHIFT.
    Runs are tried only where SHARED tokens are shared and, with ``low`` and ``high``, one of them lies outside these.
    """
    n, shift = len(x), np.full(x.shape, SHIFT + 1, np.int8)
    padded = np.zeros((n, _WIDTH + 2 * SHIFT), x.dtype)
    padded[:, SHIFT : SHIFT + _WIDTH] = y
    for d in sorted(range(-SHIFT, SHIFT + 1), key=abs, reverse=True):
        shift[(padded[:, SHIFT + d : SHIFT + d + _WIDTH] == x) & (x != 0)] = d
    shared = shift <= SHIFT
    start, stop, source, end = np.full(n, 1), np.zeros(n, np.int64), np.full(n, 1), np.zeros(n, np.int64)
    tried = shared.sum(axis=1) >= SHARED
    if low is not None:
        tried &= (shared.argmax(axis=1) < low) | (_WIDTH - 1 - shared[:, ::-1].argmax(axis=1) > high)
    tried = np.flatnonzero(tried)
    if len(tried):
        start[tried], stop[tried], source[tried], end[tried] = _longest(x[tried], shared[tried], shift[tried])
    return start, stop, source, end


def _longest(x: np.ndarray, shared: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(x)
    # of runs of one length, k of l shared, k / (2 l - k) is SIMILARITY or more where the sum below isn't negative
    gain = np.where(shared, 1 - SIMILARITY, np.where(x != 0, -2 * SIMILARITY, -1e6))
    left = np.cumsum(gain[:, REACH - 1 :: -1], axis=1)[:, ::-1]
    left = np.concatenate([left, np.zeros((n, 1))], axis=1)  # by where the run begins
    right = np.cumsum(gain[:, REACH:], axis=1)  # by where it ends
    start, stop = np.full(n, 1), np.zeros(n, np.int64)
    begins, ends = np.arange(REACH + 1), np.arange(REACH, _WIDTH)
    length = ends[None, :] - begins[:, None] + 1
    for a in range(0, n, 1000):
        p = slice(a, a + 1000)
        fits = (left[p, :, None] + right[p, None, :] >= -1e-9) & (length >= LEAST) & shared[p, : REACH + 1, None] & shared[p, None, REACH:]
        best = np.where(fits, length, 0).reshape(len(fits), -1)
        k = best.argmax(axis=1)
        good = best[np.arange(len(best)), k] > 0
        start[p] = np.where(good, begins[k // len(ends)], 1)
        stop[p] = np.where(good, ends[k % len(ends)], 0)
    each = np.arange(n)
    return start, stop, start + shift[each, start], stop + shift[each, stop]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    a, b = set(a.tolist()), set(b.tolist())
    return len(a & b) / max(1, len(a | b))


def near_links(around: np.ndarray, sign: np.ndarray, doc: np.ndarray) -> tuple[list[tuple[int, int, int, int, int, float]], np.ndarray]:
    """(row, from, to, source row, from there, similarity) of passages that an earlier document holds with
    edits, and which rows stand for their group: those that no earlier row equals for LEAST tokens.

    Rows are sorted by sign and document. In each round the first row left of every group is compared
    with all others left in it, so each row meets all earlier ones that stand for the group. A row
    gets links that cover more of it or connect it with rows it isn't yet connected with. Groups of
    more than FEW rows are first divided by their anchors.
    """
    n = len(sign)
    group = np.cumsum(np.concatenate([[0], np.diff(sign) != 0])) if n else np.zeros(0, np.int64)
    large = np.flatnonzero(np.bincount(group)[group] > FEW) if n else group
    if len(large):
        part = np.zeros(n, np.int64)
        part[large] = parts_of(around[large], sign[large]) + 1
        order = np.lexsort((np.arange(n), part, group))
        group = np.cumsum(np.concatenate([[0], (np.diff(group[order]) != 0) | (np.diff(part[order]) != 0)]))
    else:
        order = np.arange(n)
    around, alone = around[order], np.zeros(n, bool)
    large = np.flatnonzero(np.bincount(group)[group] > FEW) if n else group
    alone[large] = lonely(around[large], group[large])
    links, stands = _rounds(around, group, doc[order], alone)
    return [(int(order[i]), a, b, int(order[p]), c, like) for i, a, b, p, c, like in links], order[stands]


def lonely(around: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which rows hold fewer than SHARED tokens that any other row of their group holds, lonely rows left out.

    No row can be like them, so those that have no more than a common phrase need no comparison.
    """
    out, left = np.zeros(len(group), bool), np.arange(len(group))
    while len(left):
        held = around[left]
        row, at = np.nonzero(held)
        order = np.lexsort((held[row, at], group[left[row]]))  # stable: rows of a token stand in turn
        row, token, own = row[order], held[row, at][order], group[left[row]][order]
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (token[1:] != token[:-1])])[: len(row)])
        ends = np.concatenate([heads[1:], [len(row)]])[: len(heads)]
        shared = np.repeat(row[heads] != row[ends - 1], ends - heads)
        alone = np.bincount(row[shared], minlength=len(left)) < SHARED
        out[left[alone]] = True
        if not alone.any():
            break
        left = left[~alone]
    return out


def _rounds(around: np.ndarray, group: np.ndarray, doc: np.ndarray, alone: np.ndarray) -> tuple[list[tuple[int, int, int, int, int, float]], np.ndarray]:
    n = len(group)
    label, low, high = np.arange(n), np.full(n, _WIDTH), np.full(n, -1)
    left, stands, links = np.flatnonzero(~alone), alone.copy(), []
    while len(left):
        head = np.concatenate([[True], np.diff(group[left]) != 0])
        pivots = left[head]
        stands[pivots] = True
        pivot = pivots[np.cumsum(head) - 1]
        row, pivot = left[~head], pivot[~head]
        x, y = around[row], around[pivot]
        same = (x == y) & (x != 0)
        back = np.where(same[:, REACH::-1].all(axis=1), REACH + 1, same[:, REACH::-1].argmin(axis=1))
        ahead = np.where(same[:, REACH:].all(axis=1), REACH + 1, same[:, REACH:].argmin(axis=1))
        equal = back + ahead - 1
        other = doc[row] != doc[pivot]
        room = np.minimum((x[:, :REACH] != 0).sum(axis=1), (y[:, :REACH] != 0).sum(axis=1)) + np.minimum((x[:, REACH:] != 0).sum(axis=1), (y[:, REACH:] != 0).sum(axis=1))
        exact = other & (equal >= LEAST)
        # an edit on either side may keep equal tokens out of reach of the equal run, or shift them
        more = np.where(equal >= LEAST, same.sum(axis=1) - equal >= SIDE, np.maximum(back, ahead) >= SIDE)
        near = np.flatnonzero(other & more & (room + 2 * SHIFT >= LEAST))
        if len(near):
            # a run within what the row's links cover adds nothing if both rows are connected already
            joined = label[row[near]] == label[pivot[near]]
            a, b, c, d = near_spans(x[near], y[near], np.where(joined, low[row[near]], _WIDTH), np.where(joined, high[row[near]], -1))
            for k in np.flatnonzero((a <= b) & (c <= d)).tolist():
                i, p = int(row[near[k]]), int(pivot[near[k]])
                if label[i] == label[p] and low[i] <= a[k] and high[i] >= b[k]:
                    continue
                like = jaccard(around[i, a[k] : b[k] + 1], around[p, max(0, c[k]) : d[k] + 1])
                if like >= SIMILARITY:
                    links.append((i, int(a[k]), int(b[k]), p, int(c[k]), like))
                    low[i], high[i] = min(low[i], a[k]), max(high[i], b[k])
                    own = slice(np.searchsorted(group, group[i]), np.searchsorted(group, group[i], "right"))
                    label[own][label[own] == label[i]] = label[p]
        left = row[~(exact | (~other & (equal >= LEAST)))]
    return links, stands


_LINK = "doc {0}, copy bigint, start bigint, n bigint, source {0}, source_copy bigint, source_start bigint, similarity double, h tinyint"


def _link_batch(ids: pa.Array, copies: pa.Array, row, start, n, source, source_start, like, h) -> pa.RecordBatch:
    row, source = (pa.array(np.asarray(v, np.int64)) for v in (row, source))
    columns = [ids.take(row), copies.take(row), pa.array(np.asarray(start, np.int64)), pa.array(np.asarray(n, np.int64)), ids.take(source), copies.take(source)]
    columns += [pa.array(np.asarray(source_start, np.int64)), pa.array(np.asarray(like, np.float64)), pa.array(np.asarray(h, np.int8))]
    return pa.record_batch(columns, ["doc", "copy", "start", "n", "source", "source_copy", "source_start", "similarity", "h"])


def _whole_groups(batches: Iterator[pa.RecordBatch], size: int = 6_000) -> Iterator[pa.RecordBatch]:
    """Batches, sorted by their first column, joined and cut so that no group is divided."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        kept.append(b)
        if sum(k.num_rows for k in kept) >= size:
            whole = pa.concat_batches(kept)
            keys = whole.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield whole.slice(0, cut)
                kept = [whole.slice(cut)]
            else:
                kept = [whole]
    if kept:
        yield pa.concat_batches(kept)


def compared(rows: DataFrame, exact: bool = True, survivors: bool = False) -> DataFrame:
    """Links among the rows (key, sign, doc, copy, h, at, around) of each key; with ``survivors``, rows that
    stand for their key come along, with no source but their sign as ``key``, and ``around``.

    Each key has a bounded number of rows, which one task sorts and compares.
    """
    kind = dict(rows.dtypes)["doc"]
    schema = _LINK.format(kind) + (", key bigint, around binary" if survivors else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole_groups(batches):
            sign, at, h = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 5, 4))
            around = _unpacked(b.column(6))
            ids, copies = b.column(2), b.column(3)
            changes = pc.or_(pc.not_equal(ids[1:], ids[:-1]), pc.not_equal(copies[1:], copies[:-1])).to_numpy(zero_copy_only=False)
            doc = np.cumsum(np.concatenate([[True], changes | (np.diff(sign) != 0)]))  # a document's rows of a key stand together
            out = []
            if exact and (first := np.flatnonzero(h == 0)).size:
                r, start, n, s, s_start = exact_links(around[first], sign[first].view(np.uint64), doc[first], at[first])
                out.append(_link_batch(ids, copies, first[r], start, n, first[s], s_start, np.ones(len(r)), np.zeros(len(r))))
            links, stands = near_links(around, sign, doc)
            if links:
                r, a, z, s, c, like = (np.array(v) for v in zip(*links, strict=True))
                out.append(_link_batch(ids, copies, r, at[r] - REACH + a, z - a + 1, s, at[s] - REACH + c, like, h[r]))
            for o in out:
                if survivors:
                    o = pa.record_batch([*o.columns, pa.nulls(o.num_rows, pa.int64()), pa.nulls(o.num_rows, pa.binary())], [*o.schema.names, "key", "around"])
                yield o
            if survivors:
                k = stands
                w = pa.array(k)
                columns = [ids.take(w), copies.take(w), pa.array(at[k]), pa.nulls(len(k), pa.int64()), pa.nulls(len(k), ids.type), *(pa.nulls(len(k), pa.int64()),) * 2, pa.nulls(len(k), pa.float64())]
                columns += [pa.array(h[k].astype(np.int8)), b.column(1).take(w), b.column(6).take(w)]
                yield pa.record_batch(columns, ["doc", "copy", "start", "n", "source", "source_copy", "source_start", "similarity", "h", "key", "around"])

    rows = rows.select("key", "sign", "doc", "copy", "h", "at", "around")
    return rows.repartition("key").sortWithinPartitions("key", "sign", "doc", "copy", "at").mapInArrow(lean(run), schema)


def hot_links(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Links among rows whose sign has more than HOT of them, in keys of bounded size.

    Exact runs are matched by aggregation and a join, which need no group together. For edited
    passages rows are compared by each anchor they share with another document. Those of an anchor
    with more than HOT rows are split by document; the ones that stand for their part are compared
    with those of every other part, two parts to a task.
    """
    kind = dict(rows.dtypes)["doc"]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            around = _unpacked(b.column(4))
            keys, whole = runs_of(around, b.column(0).to_numpy().view(np.uint64))
            row, step = np.nonzero(whole)
            which = pa.array(row)
            start = b.column(3).to_numpy()[row].astype(np.int64) - REACH + step
            yield pa.record_batch([b.column(0).take(which), pa.array(keys[row, step].view(np.int64)), b.column(1).take(which), b.column(2).take(which), pa.array(start)], ["sign", "run", "doc", "copy", "start"])

    runs = rows.where("h = 0").select("sign", "doc", "copy", "at", "around").mapInArrow(lean(explode), f"sign bigint, run bigint, doc {kind}, copy bigint, start bigint")
    firsts = runs.groupBy("sign", "run").agg(F.min(F.struct("doc", "copy", "start")).alias("first"), F.max(F.struct("doc", "copy")).alias("last")).where("first.doc <> last.doc OR first.copy <> last.copy")
    held = runs.join(firsts.select("sign", "run", "first"), ["sign", "run"]).where("doc <> first.doc OR copy <> first.copy")
    exact = held.select("doc", "copy", "start", F.lit(LEAST).cast("bigint").alias("n"), F.col("first.doc").alias("source"), F.col("first.copy").alias("source_copy"), F.col("first.start").alias("source_start"), F.lit(1.0).alias("similarity"), F.lit(0).cast("tinyint").alias("h"))
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            around = _unpacked(b.column(5))
            row, keys = anchors(around, b.column(0).to_numpy().view(np.uint64))
            yield pa.record_batch([pa.array(keys.view(np.int64)), *(c.take(pa.array(row)) for c in b.columns)], ["key", *b.schema.names])

    keyed = rows.select("sign", "doc", "copy", "h", "at", "around").mapInArrow(lean(pick), f"key bigint, sign bigint, doc {kind}, copy bigint, h tinyint, at int, around binary")
    shared = keyed.groupBy("key").agg(F.min(F.struct("doc", "copy")).alias("a"), F.max(F.struct("doc", "copy")).alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("key", "n")
    shared = scratch.table(shared, "anchors")
    keyed = scratch.table(_among(keyed, [F.col("key")], shared.select("key"), scratch, "anchor_keys").join(shared, "key"), "keyed")
    part = lambda n: F.pmod(F.xxhash64("doc", "copy"), F.ceil(F.col(n) / HOT))
    few = compared(keyed.where(F.col("n") <= HOT), False)
    once = scratch.table(compared(keyed.where(F.col("n") > HOT).withColumn("sign", F.col("key")).withColumn("key", F.xxhash64("key", part("n"))), False, True), "once")
    standing = once.where("source IS NULL").select("key", "doc", "copy", "h", F.col("start").cast("int").alias("at"), "around").withColumnRenamed("key", "sign")
    parts = standing.join(standing.groupBy("sign").agg(F.count(F.lit(1)).alias("m")), "sign")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("m") / HOT) - 1))
    parts = parts.withColumn("own", part("m")).withColumn("other", other)
    again = compared(parts.withColumn("key", F.xxhash64("sign", F.least("own", "other"), F.greatest("own", "other"))), False)
    return union_all([exact, few, once.where("source IS NOT NULL").drop("key", "around"), again])


def merged(links: DataFrame) -> DataFrame:
    """(doc, copy, start, n_words, source, source_copy, source_start, similarity): links of one document to one
    place of another that overlap in both, as one passage; ``similarity`` is that of its least similar part.

    A link by edited tokens stands if ENOUGH hash functions join the passage, with whichever
    documents, or if it goes on from an exact run, whose hash functions agree by themselves.
    """
    kind = dict(links.dtypes)["doc"]
    own = links.groupBy("doc", "copy").agg(F.collect_list(F.struct("start", "n", "source", "source_copy", "source_start", "similarity", "h")).alias("l"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts, values = b.column(2).offsets.to_pylist(), b.column(2).values
            start, n, copy, there, h = (values.field(k).to_numpy().astype(np.int64) for k in ("start", "n", "source_copy", "source_start", "h"))
            like, ids = values.field("similarity").to_numpy(), values.field("source")
            row = np.repeat(np.arange(b.num_rows), np.diff(cuts))
            kept = np.ones(len(start), bool)
            for i in np.unique(row[like < 1]).tolist():
                p = slice(cuts[i], cuts[i + 1])
                kept[p] = supported(start[p], n[p], like[p], h[p])
            k = np.flatnonzero(kept)
            source = ids.take(pa.array(k)).dictionary_encode().indices.to_numpy().astype(np.int64) if len(k) else k
            order = np.lexsort((there[k], start[k], copy[k], source, row[k]))
            k, source = k[order], source[order]
            same = (np.diff(row[k]) == 0) & (np.diff(source) == 0) & (np.diff(copy[k]) == 0)
            heads, last, open_ = [], [], []
            columns = (v.tolist() for v in (start[k], start[k] + n[k], there[k], there[k] + n[k], like[k]))
            for j, (joins, a, z, c, d, s) in enumerate(zip([False, *same.tolist()], *columns)):
                # passages that go on where others of the same source end; usually there is one such
                open_ = [i for i in open_ if last[i][0] >= a] if joins else []
                at = next((i for i in open_ if c <= last[i][3] and d >= last[i][2]), None)
                if at is None:
                    open_.append(len(last)), heads.append(j), last.append([z, s, c, d])
                else:
                    p = last[at]
                    p[:] = max(p[0], z), min(p[1], s), min(p[2], c), max(p[3], d)
            at, last = k[np.array(heads, np.int64)], np.array(last, float).reshape(-1, 4)
            at, last = _outermost(row[at], start[at], source[np.array(heads, np.int64)], at, last)
            which, pick = pa.array(row[at]), pa.array(at)
            words = last[:, 0].astype(np.int64) - start[at] + SHINGLE - 1
            columns = [b.column(0).take(which), b.column(1).take(which), pa.array(start[at]), pa.array(words), ids.take(pick), pa.array(copy[at]), pa.array(last[:, 2].astype(np.int64)), pa.array(last[:, 1])]
            yield pa.record_batch(columns, ["doc", "copy", "start", "n_words", "source", "source_copy", "source_start", "similarity"])

    return own.mapInArrow(lean(run), f"doc {kind}, copy bigint, start bigint, n_words bigint, source {kind}, source_copy bigint, source_start bigint, similarity double")


def _outermost(row: np.ndarray, start: np.ndarray, source: np.ndarray, at: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``at`` and ``last`` (end, similarity) without passages that lie within an exact one, or within one of the
    same source. Both sources of an exact passage hold it, so what links them is kept elsewhere."""
    order = np.lexsort((-last[:, 0], start, row))
    kept, now, reach, own = [], -1, -1.0, {}
    for j in order.tolist():
        if row[j] != now:
            now, reach, own = row[j], -1.0, {}
        z, like = last[j, :2]
        if z <= own.get(source[j], -1.0) or (like == 1 and z <= reach):
            continue
        own[source[j]] = max(z, own.get(source[j], -1.0))
        if like == 1:
            reach = max(reach, z)
        kept.append(j)
    return at[kept], last[kept]


def supported(start: np.ndarray, n: np.ndarray, like: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which links of one document ENOUGH hash functions, or an exact run, agree on over half a least passage."""
    base = int(start.min())
    size, votes = int((start + n).max()) - base + 1, np.zeros(len(start), np.int64)
    for group, weight in [*((np.flatnonzero((like < 1) & (h == k)), 1) for k in range(HASHES)), (np.flatnonzero(like == 1), ENOUGH)]:
        if len(group):
            edge = np.zeros(size, np.int64)
            np.add.at(edge, start[group] - base, 1)
            np.add.at(edge, start[group] + n[group] - base, -1)
            covered = np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)])
            votes += weight * (covered[start + n - base] - covered[start - base] >= LEAST // 2)
    return (votes >= ENOUGH) | (like == 1)


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of :func:`merged` for all of ``docs``; a row of ``docs`` is known by its id and ``copy``, a hash of its text."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    texts = texts.select("doc", F.xxhash64("text").alias("copy"), "text")
    rows = scratch.table(members(scratch.table(windows(texts), "windows"), scratch), "members")
    for name in ("windows", "rows"):
        scratch.drop(name)
    free(spark)
    ids = rows.select(F.xxhash64("doc", "copy").alias("key")).distinct()
    kept = _among(texts, [F.xxhash64("doc", "copy")], ids, scratch, "ids").groupBy("doc", "copy").agg(F.first("text").alias("text"))
    around = scratch.table(surroundings(rows, kept), "around")
    free(spark)
    many = scratch.table(rows.groupBy("sign").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT), "many")
    if many.isEmpty():
        links = compared(around.withColumn("key", F.col("sign")))
    else:
        sized = around.join(F.broadcast(many) if many.count() <= 100_000 else many, "sign", "left")
        links = compared(sized.where("n IS NULL").withColumn("key", F.col("sign"))).unionByName(hot_links(sized.where("n IS NOT NULL"), scratch))
    found = scratch.table(merged(links), "found")
    for name in ("members", "around", "once", "keyed"):
        scratch.drop(name)
    free(spark)
    return found


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, start, n_words, source, source_start, similarity, class, n_links): passages of 50 words or more that a
    document shares, with a similarity of 0.8 or more on five-word shingles, with an earlier one
    (of smaller id).

    Each run of 50 words of a document that an earlier one holds lies in a passage, whatever holds
    it; edited passages are found with the probability that ENOUGH of HASHES min-hashes agree. The
    source is the earliest holder of an exact run. ``class`` is the smallest document that links
    lead to, ``n_links`` the number of documents that a document has links with; copies have links
    with one holder only. Positions count words from 0, lower-cased in A-Z. Rows without an id are
    left out; rows that share an id and a text count as one, those that share only an id as
    several, told apart by a hash of their text. Null, empty and shorter texts have no passages,
    and no documents give no rows. Repeats inside one document aren't reported.
    """
    found = passages(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession)
    edges = found.where("doc <> source").select(F.col("doc").alias("u"), F.col("source").alias("v")).distinct()
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    classes = connected_components(edges, scratch).select(F.col("node").alias("doc"), F.col("root").alias("class"))
    classes = classes.join(both.groupBy(F.col("u").alias("doc")).agg(F.count(F.lit(1)).alias("n_links")), "doc")
    rows = found.select("doc", "start", "n_words", "source", "source_start", "similarity").distinct().join(classes, "doc", "left")
    return rows.withColumn("class", F.coalesce("class", "doc")).na.fill({"n_links": 0})


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the given runs (start, number) of words and the white space after each."""
    gone = np.zeros(len(text.split()), bool)
    for start, n in spans:
        gone[start : start + n] = True
    out, at = [], 0
    places = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    for k, dead in enumerate(gone):
        if dead:
            out.append(text[at : places[k]])
            at = places[k + 1]
    return b"".join([*out, text[at:]])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every repeated passage cut out of all documents but the earliest that holds it.

    Documents of which no word is left are dropped; others keep their row and columns, so texts
    that had no words to begin with stay. Of rows that share an id each loses what its own text repeats.
    """
    name, copy = unused("spans", docs), unused("copy", docs)
    spans = passages(docs, id_col, text_col).groupBy(F.col("doc").alias(id_col), F.col("copy").alias(copy)).agg(F.collect_set(F.struct("start", "n_words")).alias(name))
    joined = docs.withColumn(copy, F.xxhash64(F.col(text_col).cast("string"))).join(spans, [id_col, copy], "left").select(*docs.columns, name)
    at, last = docs.columns.index(text_col), len(docs.columns)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, cuts = b.column(at), b.column(last)
            kept, alive = [], np.ones(b.num_rows, bool)
            for row in range(b.num_rows):
                text, gone = texts[row].as_py(), cuts[row].as_py()
                if gone and text is not None:
                    text = cut(text.encode(), [(v["start"], v["n_words"]) for v in gone]).decode("utf-8", "replace")
                    alive[row] = bool(text.encode().split())
                kept.append(text)
            columns = [pa.array(kept, pa.string()) if k == at else c for k, c in enumerate(b.columns[:last])]
            yield pa.record_batch(columns, b.schema.names[:last]).filter(pa.array(alive))

    return joined.mapInArrow(lean(shorten), docs.schema)
