"""Token ids of whole texts by a public tokenizer file, word by word, with a bounded cache."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

TOKENIZER = "word_bpe_49k.json"
#: Bytes of text whose words are looked up together.
STEP = 1 << 22
_NONE = np.int32(1 << 30)
#: Lower-case Latin words, which normalisers leave as they are and which are one pre-token.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


class Merges:
    """Byte-pair merges of many words at once.

    Each round merges, in every word that still has one, the adjacent pair of lowest rank (the
    leftmost of equal ones), as the tokenizer does one word at a time.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        shown = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in kept)}
        self.inner = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[shown[b] + suffix] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.order[at], _NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are one pre-token each, as bytes."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            raw = np.frombuffer(b"".join([words[i] for i in rows.tolist()]), np.uint8).reshape(-1, size)
            sym = np.concatenate([self.inner[raw[:, :-1]], self.last[raw[:, -1:]], np.full((len(raw), 1), -1, np.int32)], axis=1)
            rank = self.rank(sym[:, :-1], sym[:, 1:])
            left, active, cols = np.full(len(rows), size), np.arange(len(rows)), np.arange(size)
            done = sym.copy()
            while len(active):
                at = rank.argmin(axis=1)
                each = np.arange(len(active))
                best = rank[each, at]
                more = best < _NONE
                if not more.all():
                    done[active[~more]] = sym[~more]
                    active, sym, rank, at, best = active[more], sym[more], rank[more], at[more], best[more]
                    each = np.arange(len(active))
                if not len(active):
                    break
                left[active] -= 1
                src = np.minimum(cols + (cols > at[:, None]), size)
                sym = np.concatenate([np.take_along_axis(sym, src, axis=1), sym[:, -1:]], axis=1)
                sym[each, at] = self.made[best]
                src = np.minimum(cols + (cols >= at[:, None]), size - 1)
                rank = np.take_along_axis(rank, src, axis=1)
                rank[:, -1] = _NONE
                rank[each, at] = self.rank(sym[each, at], sym[each, at + 1])
                inner = np.flatnonzero(at > 0)
                rank[inner, at[inner] - 1] = self.rank(sym[inner, at[inner] - 1], sym[inner, at[inner]])
            flat = done.astype("<u4").tobytes()
            width = 4 * (size + 1)
            for k, (i, n) in enumerate(zip(rows.tolist(), left.tolist(), strict=True)):
                out[i] = flat[k * width : k * width + 4 * n]
        return out


class WordEncoder:
    """Encodes with a tokenizer that drops white space, by way of the distinct words.

    White space ends every pre-token of such a tokenizer and none of its normalisers looks across
    it, so a text's ids are those of its words in order. ASCII capitals are lowered and ASCII
    punctuation at a word's end is cut off before the lookup, which the tokenizer would do itself;
    texts and words with its special tokens' brackets go to it untouched. Plain Latin words are
    merged here, many at once, other words by the tokenizer. The cache holds about ``most`` words,
    some 200 bytes each.
    """

    def __init__(self, name: str = TOKENIZER, most: int = 800_000):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.merges = Merges(public_tokenizers.path(name))
        self.most = most
        #: Words met since the cache was last half full, and those of the time before.
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, words: list[bytes]) -> dict[bytes, bytes]:
        plain = [w for w in words if len(w) <= 48 and _PLAIN.fullmatch(w)]
        found = dict(zip(plain, self.merges.encode(plain), strict=True))
        rest = [w for w in words if w not in found]
        encoded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)
        found |= {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(rest, encoded, strict=True)}
        return found

    def _learn(self, missing: set[bytes]) -> None:
        """Put words that neither generation has into the new one."""
        cut = {w: _stem(w) for w in missing}
        parts = {p for pair in cut.values() for p in pair if p}.difference(self.new)
        known = {p: self.old[p] for p in parts.intersection(self.old)}
        known |= self._ids(list(parts.difference(known)))
        known[b""] = b""
        self.new |= known
        self.new |= {w: self.new[a] + self.new[b] for w, (a, b) in cut.items() if b}

    def _ready(self, words: set[bytes]) -> None:
        missing = words.difference(self.new)
        if not missing:
            return
        if len(self.new) > self.most // 2:
            self.old, self.new, missing = self.new, {}, words
        again = missing.intersection(self.old)
        self.new.update((w, self.old[w]) for w in again)
        if rest := missing.difference(again):
            self._learn(rest)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; empty for null."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            docs, size = [], 0
            while at < len(texts) and size < STEP:
                text = texts[at] or b""
                docs.append(text if b"<|" in text else text.lower())
                size += len(text)
                at += 1
            split = pc.ascii_split_whitespace(pa.array(docs, pa.large_binary()).cast(pa.large_string(), safe=False))
            words = split.flatten().dictionary_encode()
            distinct = words.dictionary.cast(pa.large_binary()).to_pylist()
            self._ready(set(distinct))
            ids = list(map(self.new.__getitem__, distinct))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            begins, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), "<u4")
            index = words.indices.to_numpy()
            n = sizes[index]
            ends = np.cumsum(n)
            spread = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[index] - (ends - n), n)].tobytes()
            cuts = (4 * np.concatenate([[0], ends])[split.offsets.to_numpy()]).tolist()
            out += [spread[a:b] for a, b in zip(cuts, cuts[1:])]
        return out


def _stem(word: bytes) -> tuple[bytes, bytes]:
    """A word as two parts that the tokenizer keeps apart; the second may be empty."""
    stem = word.rstrip(b".,;:?!*$%#&")
    if len(stem) < len(word) and b"'" not in word and b"<|" not in word and (stem[-1:].isalnum() or stem.decode("utf-8", "replace")[-1:].isalnum()):
        return stem, word[len(stem) :]
    return word, b""


@lru_cache(maxsize=2)
def encoder(name: str = TOKENIZER) -> WordEncoder:
    """One encoder for each worker process, which has a core of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(name)
