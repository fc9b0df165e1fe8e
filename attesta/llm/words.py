"""Hashes of the words of many texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes hashed at once. Longer words are hashed by another function, which none else meet.
SPAN = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_UNIT = np.uint64(pow(_BASE, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CODES = np.random.default_rng(31).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_CODES[65:91] = _CODES[97:123]
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64) -> np.ndarray:
    out = np.full(SPAN, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS, _INVERSE = _powers(np.uint64(_BASE)), _powers(_UNIT)


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts``, A-Z and a-z alike, and where texts begin and end among them.

    A word's hash is a polynomial of its bytes, taken from the differences of one running sum.
    """
    blob = b" ".join([*(t or b"" for t in texts), b""])
    raw = np.frombuffer(blob, np.uint8)
    space = _SPACE[raw]
    before = np.concatenate([[True], space[:-1]])
    begin, end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    offsets = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts], dtype=np.int64)])
    out, i = np.zeros(len(begin), np.uint64), 0
    while i < len(begin):
        at = int(begin[i])
        j = int(np.searchsorted(end, at + SPAN, "right"))
        if j <= i:
            out[i] = xxhash.xxh3_64_intdigest(blob[at : int(end[i])].lower(), 1)
            i += 1
            continue
        sums = np.zeros(int(end[j - 1]) - at + 1, np.uint64)
        np.cumsum(_CODES[raw[at : int(end[j - 1])]] * _POWERS[: len(sums) - 1], out=sums[1:])
        a, z = begin[i:j] - at, end[i:j] - at
        h = (sums[z] - sums[a]) * _INVERSE[a]
        out[i:j] = (h ^ (h >> np.uint64(29))) * _MIX
        i = j
    return out, np.searchsorted(begin, offsets)


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, by where it begins; those that would pass the end are 0."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(len(hashes), np.uint64)
    key = hashes[:n].copy()
    for k in range(1, width):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(_BASE) + hashes[k : n + k]
    return np.concatenate([(key ^ (key >> np.uint64(32))) * np.uint64(_BASE), np.zeros(width - 1, np.uint64)])
