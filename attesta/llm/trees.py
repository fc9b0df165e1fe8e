"""Boosted histogram trees as flat numpy node arrays, with optional monotonic constraints."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Nodes of all trees in one set of arrays; ``left`` is -1 at leaves and ``roots`` starts the trees.

    A row goes left where its feature is at most the threshold. The margin is ``base`` plus the
    values of the leaves reached.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            low = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(self.left[at] < 0, at, np.where(low, self.left[at], self.right[at]))
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray, step: int = 4096) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return np.concatenate([sigmoid(self.margin(x[i : i + step])) for i in range(0, len(x), step)])

    def paths(self) -> list[tuple[tuple[int, bool, float], ...]]:
        """Every path from a root to a node below it, as conditions (feature, at most?, threshold)."""
        found = []
        todo = [(int(r), ()) for r in self.roots]
        while todo:
            at, path = todo.pop()
            if path:
                found.append(path)
            if self.left[at] >= 0:
                f, t = int(self.feature[at]), float(self.threshold[at])
                todo += [(int(self.left[at]), (*path, (f, True, t))), (int(self.right[at]), (*path, (f, False, t)))]
        return found


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, monotone: dict[int, int] | None = None,
    subsample: float = 1.0, features: float = 1.0, bins: int = 64, l2: float = 1.0, least: float = 5.0, seed: int = 7,
) -> Forest:
    """Gradient boosting on logistic loss.

    ``monotone`` maps a feature to +1 (margin never falls as it rises) or -1. A split on such a
    feature must order its children's values, and each child's subtree stays on its side of their
    midpoint, so the whole forest is monotone. No rows give a constant forest.
    """
    monotone, rng = monotone or {}, np.random.default_rng(seed)
    n, width = x.shape
    rate_of = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(rate_of / (1 - rate_of)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1) if n else np.zeros((0, width), int)
    nodes: list[list] = []
    roots, margin = [], np.full(n, base)
    for _ in range(rounds if n else 0):
        p = sigmoid(margin)
        g, h = y - p, p * (1 - p)
        used = np.flatnonzero(rng.random(n) < subsample) if subsample < 1 else np.arange(n)
        chosen = rng.permutation(width)[: max(1, round(features * width))]
        roots.append(len(nodes))
        todo = [(used, 0, -np.inf, np.inf, len(nodes))]
        nodes.append([0, 0.0, -1, -1, 0.0])
        while todo:
            rows, level, low, high, at = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            clip = lambda v, lo=low, hi=high: np.clip(v, lo, hi)
            nodes[at][4] = rate * float(clip(gs / (hs + l2)))
            if level == depth or len(rows) < 2 * least:
                continue
            best = (1e-6, None)
            for f in chosen:
                if not len(cuts[f]):
                    continue
                b, m = binned[rows, f], len(cuts[f]) + 1
                gl, hl, nl = (np.cumsum(np.bincount(b, w, m))[:-1] for w in (g[rows], h[rows], None))
                gr, hr, nr = gs - gl, hs - hl, len(rows) - nl
                vl, vr = clip(gl / (hl + l2)), clip(gr / (hr + l2))
                gain = 2 * (gl * vl + gr * vr) - (hl + l2) * vl**2 - (hr + l2) * vr**2
                ok = (nl >= least) & (nr >= least)
                if (sign := monotone.get(int(f), 0)) != 0:
                    ok &= sign * (vr - vl) >= 0
                gain = np.where(ok, gain, -np.inf)
                v0 = clip(gs / (hs + l2))
                k = int(np.argmax(gain))
                if (up := gain[k] - (2 * gs * v0 - (hs + l2) * v0**2)) > best[0]:
                    best = (up, (int(f), k, vl[k], vr[k]))
            if best[1] is None:
                continue
            f, k, vl, vr = best[1]
            goes = binned[rows, f] <= k
            left, right = len(nodes), len(nodes) + 1
            nodes += [[0, 0.0, -1, -1, 0.0], [0, 0.0, -1, -1, 0.0]]
            nodes[at][:4] = [f, float(cuts[f][k]), left, right]
            mid, sign = (vl + vr) / 2, monotone.get(f, 0)
            todo.append((rows[goes], level + 1, mid if sign < 0 else low, mid if sign > 0 else high, left))
            todo.append((rows[~goes], level + 1, mid if sign > 0 else low, mid if sign < 0 else high, right))
        tree = Forest(*_arrays(nodes), np.array(roots[-1:]), 0.0, depth)
        margin = margin + tree.margin(x)
    return Forest(*_arrays(nodes), np.array(roots, int), base, depth)


def _arrays(nodes: list[list]) -> tuple[np.ndarray, ...]:
    kinds = (int, float, int, int, float)
    return tuple(np.array([n[i] for n in nodes], k) for i, k in enumerate(kinds))
