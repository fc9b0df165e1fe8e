"""Two quality judges over document statistics: a sparse rule ensemble and a monotone forest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trees
from .common import fold, unused
from .statistics import COUNTS, FEATURES, labelled_sample, measure_batch, statistics, with_statistics

#: Labelled rows that either judge learns from at most.
SAMPLE = 20_000
THRESHOLD = 0.7
HELD_OUT = (4, 2)


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Feature matrix and quality labels of the bounded training sample; rows of the fold held out never enter."""
    modulus, held = HELD_OUT
    sample = labelled_sample(docs, labels, "quality", fold(F.col("doc_id"), modulus) != held, limit)
    measured = statistics(sample.select("doc_id", "text")).dropDuplicates(["id"])
    known = sample.select("doc_id", "label").dropDuplicates(["doc_id"])
    rows = measured.join(known, measured.id == known.doc_id).select("id", "label", *FEATURES).toPandas().sort_values("id")
    return rows[list(FEATURES)].to_numpy(float), (rows["label"].to_numpy(float) > 0).astype(float)


@dataclass
class RuleEnsemble:
    """Logistic weights on conjunctive rules; a rule is a tuple of (feature, at most?, threshold)."""

    rules: list[tuple[tuple[int, bool, float], ...]]
    weights: np.ndarray
    bias: float

    def column(self, of: str = "") -> Column:
        """The score as a Spark expression over the statistics columns, or over those of a struct."""
        feature = [F.col(f"{of}.{name}" if of else name) for name in FEATURES]
        margin = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights.tolist(), strict=True):
            holds = None
            for f, low, t in rule:
                c = (feature[f] <= t) if low else (feature[f] > t)
                holds = c if holds is None else holds & c
            margin = margin + F.when(holds, w).otherwise(0.0)
        return 1 / (1 + F.exp(-margin))

    def score(self, x: np.ndarray) -> np.ndarray:
        return trees.sigmoid(self.bias + rule_matrix(self.rules, x) @ self.weights)


def rule_matrix(rules: list, x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for f, low, t in rule:
            out[:, j] *= (x[:, f] <= t) if low else (x[:, f] > t)
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of an L1-penalised logistic regression, by accelerated proximal gradients."""
    n = max(1, len(y))
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w, b = np.zeros(r.shape[1]), float(np.log(rate / (1 - rate)))
    if not len(y) or not r.shape[1]:
        return w, b
    v, c, t = w.copy(), b, 1.0
    step = 4 / (np.linalg.norm(np.column_stack([r, np.ones(len(r))]), 2) ** 2 / n)
    for _ in range(steps):
        e = trees.sigmoid(r @ v + c) - y
        nw, nb = v - step * (r.T @ e) / n, c - step * e.mean()
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


def fit_rules(x: np.ndarray, y: np.ndarray, rounds: int = 40, most: int = 160, seed: int = 7) -> RuleEnsemble:
    """Paths of small randomised trees as candidate rules; the penalty is picked on a fifth of the rows."""
    forest = trees.fit(x, y, rounds=rounds, depth=3, rate=0.3, subsample=0.5, features=0.6, seed=seed)
    rules = list(dict.fromkeys(tuple(sorted(p)) for p in forest.paths()))
    if not rules:
        return RuleEnsemble([], np.zeros(0), forest.base)
    m = rule_matrix(rules, x)
    support = m.mean(axis=0)
    _, first = np.unique(m, axis=1, return_index=True)  # rules that hold for the same rows are one
    keep = sorted((j for j in first if 0.002 < support[j] < 0.998), key=lambda j: -abs(np.cov(m[:, j], y)[0, 1]))[:most]
    m, rules = m[:, keep], [rules[j] for j in keep]
    test = np.arange(len(y)) % 5 == 0
    best = (np.inf, 0.001)
    for penalty in (0.01, 0.003, 0.001, 0.0003):
        w, b = lasso_logistic(m[~test], y[~test], penalty, 200)
        p = np.clip(trees.sigmoid(m[test] @ w + b), 1e-6, 1 - 1e-6)
        loss = -np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)) if test.any() else 0.0
        best = min(best, (float(loss), penalty))
    w, b = lasso_logistic(m, y, best[1])
    kept = np.flatnonzero(np.abs(w) > 1e-9)
    return RuleEnsemble([rules[j] for j in kept], w[kept], b)


def rule_quality(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted): quality of every row by the sparse rule ensemble.

    Learns from at most ``limit`` labelled rows outside the held-out fold; scores whole texts. Null
    and empty texts are scored as texts whose statistics are all zero. Without labels the score is
    a constant half; no documents give no rows, and repeated rows are scored alike.
    """
    model = fit_rules(*training_rows(docs, labels, limit))
    modulus, held = HELD_OUT
    return statistics(docs).select(
        F.col("id").alias("doc_id"), (fold(F.col("id"), modulus) == held).alias("held_out"), model.column().alias("score")
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that the rule ensemble scores at ``threshold`` or more, all columns kept."""
    model = fit_rules(*training_rows(docs, labels, limit))
    name = unused("quality", docs)
    return with_statistics(docs, name).where(model.column(name) >= threshold).drop(name)


#: Direction of features whose effect on quality is known beforehand.
MONOTONE = {"symbol_ratio": -1, "pipe_ratio": -1, "bang_ratio": -1, "echo_ratio": -1, "repeat_ratio": -1}
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def forest_quality(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """(doc_id, COUNTS, base_failed, score, kept): base rules, then the boosted trees' verdict.

    base_failed: fewer than 50 words, or over half of the words in repeated three-word windows.
    Others are kept where the forest's score is ``threshold`` or more. Null texts count as empty;
    no documents give no rows.
    """
    x, y = training_rows(docs, labels, limit)
    forest = trees.fit(x, y, rounds=60, depth=4, monotone={FEATURES.index(k): v for k, v in MONOTONE.items()})
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, ratios = measure_batch(b.column(1))
            n, repeats = counts[:, 0], counts[:, 4]
            failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
            score = forest.score(ratios)
            columns = [b.column(0), *map(pa.array, counts.T.copy()), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
            yield pa.record_batch(columns, ["doc_id", *COUNTS, "base_failed", "score", "kept"])

    schema = ", ".join([f"doc_id {kind}", *(f"{c} bigint" for c in COUNTS), "base_failed boolean, score double, kept boolean"])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
