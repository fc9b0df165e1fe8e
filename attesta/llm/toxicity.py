"""Weak supervision for toxicity: lexicon and pattern voters, a label model, a linear classifier."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold
from .statistics import labelled_sample
from .trees import sigmoid

#: Labelled rows that voters and models are drawn from at most.
SAMPLE = 20_000
VOTERS = 400
#: A pattern may occur in so many other rows for each toxic one; how much it says is the label model's to find.
IMPURE = 0.2
THRESHOLD = 0.7
HELD_OUT = (3, 1)
PREFIXES = (3, 4, 5, 6, 7)

#: Voters that exist before any label is seen.
LEXICON = ("idiot", "moron", "stupid", "scum", "loser", "trash", "worthless", "pathetic", "disgusting", "clown")

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def bare(word: bytes) -> str:
    return _EDGES.sub("", word.decode("utf-8", "replace").lower())


def patterns(word: bytes) -> list[str]:
    """What can vote on a word: ``=`` and the whole word, ``^`` and its first characters."""
    w = bare(word)
    return ["=" + w, *("^" + w[:k] for k in PREFIXES if len(w) >= k)] if w else []


class Memo(dict):
    """Results of a function of words, remembered up to a bound."""

    def __init__(self, of, most: int = 400_000):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, word: bytes):
        if len(self) >= self.most:
            self.clear()
        self[word] = found = self.of(word)
        return found


def voters_of(sample: DataFrame, most: int = VOTERS) -> list[str]:
    """Patterns that occur in toxic rows far more often than chance explains.

    ``sample`` is bounded (id, text, label) rows, copies already removed. A pattern must be so
    frequent among toxic rows and so rare among others that about one of all patterns seen would
    get there by chance. Of prefixes of one another the shortest stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(patterns)
        for b in batches:
            toxic, all_ = Counter(), Counter()
            for text, label in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = {p for w in set((text or b"").split()) for p in memo[w]}
                all_.update(found)
                if label:
                    toxic.update(found)
            names = list(all_)
            counts = [pa.array([c[k] for k in names], pa.int64()) for c in (toxic, all_)]
            yield pa.record_batch([pa.array(names, pa.string()), *counts], ["pattern", "toxic", "total"])

    n, pos = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not pos:
        return []
    counts = sample.select("text", "label").mapInArrow(run, "pattern string, toxic bigint, total bigint").groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("total").alias("total"))
    rate = max(pos / n, 1e-6)
    # the number of patterns tested enters by its logarithm only, so a round figure does
    least = max(3, math.ceil(math.log(300_000) / -math.log(min(rate, 0.5))))
    good = counts.where((F.col("toxic") >= least) & (F.col("total") - F.col("toxic") <= IMPURE * F.col("toxic")))
    rows = good.orderBy(F.desc("toxic"), F.length("pattern"), "pattern").limit(8 * most).collect()
    known = {r["pattern"] for r in rows}
    kept = [p for p in known if p[0] == "=" or p[:-1] not in known or len(p) <= 1 + PREFIXES[0]]
    support = {r["pattern"]: r["toxic"] for r in rows}
    return sorted(kept, key=lambda p: (-support[p], len(p), p))[:most]


@dataclass
class Sums:
    """What a label model is made from: rows by class, votes by class, and how surely rows belong to one."""

    rows: np.ndarray  # 2
    votes: np.ndarray  # 2 x voters
    squares: np.ndarray  # sums of p0 p0, p0 p1 and p1 p1 for rows that are of class 0 and 1 with p0 and p1
    silent: np.ndarray  # rows by class on which no voter fires

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.rows + other.rows, self.votes + other.votes, self.squares + other.squares, self.silent + other.silent)

    @classmethod
    def of(cls, votes: np.ndarray, q: np.ndarray, times: np.ndarray) -> Sums:
        p = np.stack([1 - q, q]) * times
        return cls(p.sum(axis=1), p @ votes, np.array([(p[0] * (1 - q)).sum(), (p[0] * q).sum(), (p[1] * q).sum()]), p @ (votes.sum(axis=1) == 0))


@dataclass
class LabelModel:
    """Voters' firing rates given the label, and how strongly they repeat one another.

    rates[y, j] is the chance that voter j fires on a row of label y; shares[j] discounts it by
    the correlations with other voters that remain once the label is known.
    """

    prior: float
    silent: float
    rates: np.ndarray
    shares: np.ndarray
    correlations: np.ndarray

    def margin(self, votes: np.ndarray) -> np.ndarray:
        """Log-odds of the toxic label. A voter that doesn't fire abstains, as most know words of one
        language only; that none fires at all is a vote of its own."""
        fired = np.log(self.prior / (1 - self.prior)) + votes @ (np.log(self.rates[1] / self.rates[0]) * self.shares)
        return np.where(votes.any(axis=1), fired, np.log(self.silent / (1 - self.silent)))

    @classmethod
    def made(cls, sums: Sums, together: np.ndarray) -> LabelModel:
        """The model that the sums speak for; ``together`` counts rows by pairs of voters that fire on them."""
        n, m = max(1.0, sums.rows.sum()), sums.votes.shape[1]
        rates = np.clip((sums.votes + np.array([[0.02], [0.2]])) / (sums.rows[:, None] + 2), 1e-5, 1 - 1e-5)
        both = sums.votes[0][:, None] * rates[0] + sums.votes[1][:, None] * rates[1]
        low, mid, high = sums.squares
        means = low * np.outer(rates[0], rates[0]) + mid * (np.outer(rates[0], rates[1]) + np.outer(rates[1], rates[0])) + high * np.outer(rates[1], rates[1])
        cov = (together - both - both.T + means) / n  # of votes less what their label makes one expect
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = np.clip(cov / np.outer(sd, sd), 0, 1)
        corr = np.where(corr > 0.3, corr, 0)
        if m:
            np.fill_diagonal(corr, 1)
        prior, silent = (float(np.clip((r[1] + 0.5) / (r.sum() + 1), 0.001, 0.999)) for r in (sums.rows, sums.silent))
        return cls(prior, silent, rates, 1 / np.maximum(1, corr.sum(axis=1)), corr)

    @classmethod
    def fit(cls, labelled: Sums, together: np.ndarray, expected: Callable[[LabelModel], Sums], rounds: int = 6) -> LabelModel:
        """By expectation maximisation: labelled rows say where to begin and count as seen, all others
        (whose ``together`` comes in too) by the label that the model expects of their votes."""
        model = cls.made(labelled, together[0])
        for _ in range(rounds):
            model = cls.made(labelled + expected(model), together[0] + together[1])
        return model


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradients."""
    n = max(1, len(y))
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w, b = np.zeros(x.shape[1]), float(np.log(rate / (1 - rate)))
    if not len(y) or not x.shape[1]:
        return w, b
    step = 4 / (np.linalg.norm(np.column_stack([x, np.ones(len(x))]), 2) ** 2 / n + l2)
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        e = sigmoid(x @ v + c) - y
        nw, nb = v - step * (x.T @ e / n + l2 * v), c - step * e.mean()
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


class Votes:
    """Numbers of the given voters that fire on a text, and how many of its words they fire on."""

    def __init__(self, voters: list[str]):
        self.index = {v: j for j, v in enumerate(voters)}
        self.memo = Memo(lambda w: tuple(self.index[p] for p in patterns(w) if p in self.index))

    def of(self, text: bytes | None) -> tuple[bytes, int]:
        hits = [v for v in map(self.memo.__getitem__, set((text or b"").split())) if v]
        return np.array(sorted({j for v in hits for j in v}), "<u2").tobytes(), len(hits)


def vote_table(docs: DataFrame, voters: list[str]) -> DataFrame:
    """(doc_id, ..., votes, hits) for rows (doc_id, text, ...); votes are the voters' numbers, two bytes each."""
    at, rest = docs.columns.index("text"), [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Votes(voters)
        for b in batches:
            found = [own.of(t) for t in b.column(at).cast(pa.binary()).to_pylist()]
            columns = [c for k, c in enumerate(b.columns) if k != at] + [pa.array([v for v, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int32())]
            yield pa.record_batch(columns, [*rest, "votes", "hits"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in rest), "votes binary, hits int"]))


def matrix(votes: list[bytes], m: int) -> np.ndarray:
    out = np.zeros((len(votes), m))
    for i, v in enumerate(votes):
        out[i, np.frombuffer(v, "<u2")] = 1
    return out


def expected_sums(votes: DataFrame, m: int) -> Callable[[LabelModel], Sums]:
    """What a model expects of all rows of ``votes`` (votes, times); each task sends one row of sums."""

    def of(model: LabelModel) -> Sums:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(7 + 2 * m)
            for b in batches:
                x = matrix(b.column(0).to_pylist(), m)
                s = Sums.of(x, sigmoid(model.margin(x)), b.column(1).to_numpy().astype(float))
                total += np.concatenate([s.rows, s.squares, s.silent, s.votes.ravel()])
            yield pa.record_batch([pa.array(np.flatnonzero(total).astype(np.int32)), pa.array(total[np.flatnonzero(total)])], ["k", "v"])

        total = np.zeros(7 + 2 * m)
        for k, v in votes.select("votes", "times").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v")).collect():
            total[k] = v
        return Sums(total[:2], total[7:].reshape(2, m), total[2:5], total[5:7])

    return of


def fired_together(votes: DataFrame, m: int) -> np.ndarray:
    """Rows of ``votes`` (votes, times) by pairs of voters that fire on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m, m))
        for b in batches:
            x = matrix(b.column(0).to_pylist(), m)
            total += (x * b.column(1).to_numpy()[:, None]).T @ x
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], ["k", "v"])

    out = np.zeros(m * m)
    for k, v in votes.select("votes", "times").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v")).collect():
        out[k] = v
    return out.reshape(m, m)


def score_toxicity(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted): toxicity of every whole text.

    Voters come from a fixed lexicon and from at most ``limit`` labelled rows outside the held-out
    fold, equal texts of one label counted once. The label model is fitted to their labels and to
    the votes on all other rows outside that fold; a linear classifier over the votes learns the
    labels that it then expects of the labelled rows, by their votes alone. Null and empty texts
    get the score of a text without votes; without labels only the lexicon votes. Rows that share
    an id are scored by their own texts, ties in the sample go by id; other columns don't matter.
    No documents give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    modulus, held = HELD_OUT
    sample = labelled_sample(docs, labels, "toxic", fold(F.col("doc_id"), modulus) != held, limit)
    sample = sample.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("label") > 0).cast("int").alias("label"))
    once = sample.groupBy(F.xxhash64("text").alias("copy"), "label").agg(F.min(F.struct("doc_id", "text")).alias("row"))
    sample = scratch.table(once.select("row.doc_id", "row.text", "label"), "sample")
    voters = list(dict.fromkeys(["=" + w for w in LEXICON] + voters_of(sample.select("text", "label"))))
    m = len(voters)
    every = docs.select("doc_id", F.col("text").cast("string").alias("text"), (fold(F.col("doc_id"), modulus) == held).alias("held_out"))
    every = scratch.table(vote_table(every, voters), "votes")
    rows = vote_table(sample, voters).select("doc_id", "votes", "hits", "label").toPandas().sort_values("doc_id")
    votes, y = matrix(rows["votes"].tolist(), m), rows["label"].to_numpy(float)
    if len(y):
        known = scratch.table(sample.select("doc_id").distinct(), "known")
        others = every.where("NOT held_out").join(F.broadcast(known), "doc_id", "left_anti").groupBy("votes").agg(F.count(F.lit(1)).alias("times"))
        others = scratch.table(others, "others")
        model = LabelModel.fit(Sums.of(votes, y, np.ones(len(y))), (votes.T @ votes, fired_together(others, m)), expected_sums(others, m))
        w, b0 = fit_linear(features(votes, rows["hits"].to_numpy(float)), sigmoid(model.margin(votes)))
    else:  # nothing to learn from: any vote of the lexicon counts
        w, b0 = np.zeros(m + 2), -3.0
        w[-2] = 6.0
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(matrix(b.column(2).to_pylist(), m), b.column(3).to_numpy().astype(float))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(sigmoid(x @ w + b0))], ["doc_id", "held_out", "score"])

    scored = every.select("doc_id", "held_out", "votes", "hits").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def features(votes: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Votes, whether there is any, and how many words they fire on."""
    return np.column_stack([votes, (hits > 0).astype(float), np.log1p(hits) / 3])
