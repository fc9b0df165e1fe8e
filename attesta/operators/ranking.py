"""The best rows of many queries, held in little memory."""

from __future__ import annotations

import numpy as np


class Best:
    """The best ``k`` rows of each query that were added: by score to nine digits, then by the smaller id."""

    def __init__(self, k: int):
        self.k, self.held, self.least, self.full = k, [], np.zeros(0), 0

    def floors(self, n: int) -> np.ndarray:
        """Scores under which a row of the first ``n`` queries needn't be added, less what rounding may add."""
        if len(self.least) < n:
            self.least = np.concatenate([self.least, np.full(n - len(self.least), -np.inf)])
        return self.least[:n] - 2e-9

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Rows of queries 0, 1, ..."""
        if not len(query):
            return
        self.floors(int(query.max()) + 1)
        self.held.append((query, ids, score))
        if sum(len(q) for q, _, _ in self.held) > 2 * self.full + 16_384:
            self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        query, ids, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((ids, -np.round(score, 9), query))
        query, ids, score = query[order], ids[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        place = np.arange(len(query)) - np.repeat(first, np.diff([*first, len(query)]))
        last = place == self.k - 1
        self.least[query[last]] = score[last]
        kept = place < self.k
        self.held, self.full = [(query[kept], ids[kept], score[kept])], int(kept.sum())
        return self.held[0]
