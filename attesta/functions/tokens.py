"""Tokens of whole batches of texts at once: those of ``text.tokenize``, as Arrow strings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import _ACCENTED, _FULL_WIDTH, _GROUPED, _HALF_WIDTH, _MARKS, _PLAIN

#: Bytes of text taken at once, and bytes of one text that is taken in pieces.
PIECE = 4 << 20

_CJK = re.compile("[一-鿿]+")
_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_./:-")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: First bytes of the characters from 一 to 鿿, with others.
_MAYBE_CJK = np.zeros(256, bool)
_MAYBE_CJK[0xE4:0xEA] = True


def _bigrams(text: str) -> list[str]:
    return [p for run in _CJK.findall(text) for p in ([run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)])]


def _piece(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    inside = _TOKEN[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = edges[:-1][edges[:-1] < len(raw)]
    first[heads] |= inside[heads]
    begin = np.flatnonzero(first)
    ends = np.concatenate([np.cumsum(inside, dtype=np.int32)[begin] - 1, [int(inside.sum())]]).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(_LOWER[raw[inside]]))
    rows = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(begin, edges)))
    if len(raw) and _MAYBE_CJK[raw].any():
        more, of = [], []
        for i in np.unique(np.searchsorted(edges, np.flatnonzero(_MAYBE_CJK[raw]), "right") - 1):
            found = _bigrams(raw[edges[i] : edges[i + 1]].tobytes().decode("utf-8", "replace"))
            more += found
            of += [i] * len(found)
        if more:
            terms, rows = pa.concat_arrays([terms, pa.array(more, pa.string())]), np.concatenate([rows, np.array(of, np.int64)])
    return terms, rows


def tokens(texts: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """(from, to, terms, rows) of consecutive pieces of the batch: the tokens of its texts ``from`` to ``to`` - 1 in
    any order, and the text of each, counted from ``from``. No text gives no tokens."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.string()), "")
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + PIECE, "right")))
        yield a, b, *_piece(texts.slice(a, b - a))
        a = b


def counted(terms: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, code, tf, dictionary) of the distinct tokens of each text; the dictionary's terms by code."""
    coded = terms.dictionary_encode()
    k = max(1, len(coded.dictionary))
    keys, tf = np.unique(rows * k + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return keys // k, keys % k, tf, coded.dictionary


_FOLDED = str.maketrans(dict(zip(_FULL_WIDTH + _ACCENTED, _HALF_WIDTH + _PLAIN, strict=True)))
_LIGATURES = (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"))
_AFTER_LETTER = re.compile("(?<=[a-zA-Z])" + _MARKS)
_NUMBER, _PARTS = re.compile(_GROUPED, re.ASCII), re.compile(r"[./:\-_]+")


def _fold(t: str) -> str:
    """``text.fold``"""
    if t.isascii():
        return t
    for a, b in _LIGATURES:
        t = t.replace(a, b)
    return _AFTER_LETTER.sub("", t.translate(_FOLDED))


def compounds(texts: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """As ``tokens``, for ``text.compound_tokens`` and ``text.alternates``, with each text's number of the former."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    plain = [t or "" for t in texts.to_pylist()]
    for a, b, terms, rows in tokens(pa.array(map(_fold, plain), pa.string())):
        coded = terms.dictionary_encode()
        codes, words = coded.indices.to_numpy(zero_copy_only=False), [w if w.isalnum() else w.strip("./:-") for w in coded.dictionary.to_pylist()]
        full = np.array([w != "" for w in words], bool)[codes] if words else np.zeros(0, bool)
        codes, rows = codes[full], rows[full]
        parts = [[] if w.isalnum() or not _PARTS.search(w) else list(dict.fromkeys(p for p in _PARTS.split(w) if len(p) > 1)) for w in words]
        sizes = np.array([len(p) for p in parts], np.int64)
        first, flat = np.cumsum(sizes) - sizes, [p for ps in parts for p in ps]
        reps = sizes[codes] if words else np.zeros(0, np.int64)
        at = np.repeat(first[codes] - np.cumsum(reps) + reps, reps) + np.arange(int(reps.sum())) if words else np.zeros(0, np.int64)
        numbers = [(i, x) for i, t in enumerate(plain[a:b]) if "," in t for n in _NUMBER.findall(t) for x in dict.fromkeys((n.replace(",", ""), n.replace(",", "").split(".")[0]))]
        found = [pa.array(words, pa.string()).take(pa.array(codes)), pa.array(flat, pa.string()).take(pa.array(at)), pa.array([x for _, x in numbers], pa.string())]
        yield a, b, pa.concat_arrays(found), np.concatenate([rows, np.repeat(rows, reps), np.array([i for i, _ in numbers], np.int64)]), np.bincount(rows, minlength=b - a)
