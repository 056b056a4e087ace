"""Quality by positive-unlabelled learning.

Trusted positives are documents labelled as good; all documents of the corpus are the unlabelled text. No text counts as bad:
labels of 0 are never looked at. Each text becomes measures of its shape (shares of kinds of characters, words and lines,
repetition), each measure one of a few bins by the quantiles of the corpus, and a linear model over bins is fitted by
minimising the non-negative unbiased risk (Kiryo et al. 2017) with a logistic loss,

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)),

R_u over all documents, R_p over the positives. What the maximum is taken of is the risk of bad text: it falls below zero only where weights follow the
chance of the sample, and so it says how far they may grow: the penalty on weights falls step by step as long as the minimum's
risk of bad text isn't negative. The prior is estimated first: a model of one half of the positives ranks texts, and the
share of unlabelled texts over a score relative to that of the other half is least, but for chance, where
hardly any bad text is over it (best bin, Garg et al. 2021). Scores are the share of good text among texts of such log odds, prior * f_p / f_u, made monotone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.llm.common import stored

#: Trusted positives to learn from, at most: those whose ids come first by hash. Documented bound of the fit.
POSITIVES = 20_000
#: Labels with this remainder of crc32(doc_id) by FOLDS are held out.
FOLDS, HELD = 5, 0
#: Steps of a measure, and shares of the corpus at which its bins end: finer at both ends, where odd texts are.
STEPS = 1024
QUANTILES = (0.005, 0.01, 0.02, 0.04, 0.08, 0.16, 0.3, 0.5, 0.7, 0.84, 0.92, 0.96, 0.98, 0.99, 0.995)
BINS = len(QUANTILES) + 1
#: What is paid for large weights, a positive's share of it, from the first try on; rounds of Newton's method at most for each, and the change of weights at which they end.
PENALTIES, ROUNDS, SETTLED = (320, 160, 80, 40, 20, 10, 5, 2.5, 1.25), 8, 0.02
#: Penalty of the model that ranks texts for the prior.
FIRST = (160,)
#: Step by which the risk of bad text is led back if it is negative under the largest penalty.
BACK = 0.5
#: Certainty of the estimated prior; log odds between -REACH and REACH fall into ODDS bins.
DOUBT, REACH, ODDS = 0.1, 12.0, 4096
SUM_BLOCKS, TOGETHER = 16, 8192
WORD = re.compile(rb"[^\x00-\x20]+")
#: Kinds of bytes: the share of each among a text's bytes is a measure.
KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t", "line": b"\n\r", "stop": b".,;:", "call": b"!?", "bar": b"|", "mark": b"*#$%&@^~=+<>\\_{}[]/", "quote": b"\"'`()-", "high": bytes(range(128, 256))}
KIND = np.full(256, len(KINDS), dtype=np.uint8)
for _k, _bytes in enumerate(KINDS.values()):
    KIND[list(_bytes)] = _k
MEASURES = (*KINDS, "other", "bytes", "word length", "short words", "distinct words", "commonest word", "repeated word", "capital words", "marked words", "line length", "repeated lines", "full lines")


def held_out(doc_id: Column) -> Column:
    return (F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD) & doc_id.isNotNull()


def measures(text: str | None) -> list[int]:
    """The MEASURES of a whole text in steps of 0 to STEPS - 1. Lengths are on a logarithmic scale."""
    raw = (text or "").encode()
    size = len(raw) or 1
    log = lambda x, most: x and math.log2(1 + x) / most
    found = (np.bincount(KIND[np.frombuffer(raw, np.uint8)], minlength=len(KINDS) + 1) / size).tolist()
    words = WORD.findall(raw)
    n = len(words) or 1
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = len(lines) or 1
    found += [
        log(len(raw), 24),
        log(sum(map(len, words)) / n, 8),
        sum(c for w, c in counts.items() if len(w) < 4) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        sum(c for w, c in counts.items() if w.isupper()) / n,
        sum(c for w, c in counts.items() if KIND[w[-1]] >= MARKED) / n,
        log(len(raw) / k, 16),
        1 - len(set(lines)) / k if lines else 0,
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / k,
    ]
    return [min(STEPS - 1, int(x * STEPS)) for x in found]


#: The first kind that seldom ends a word.
MARKED = list(KINDS).index("call")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, m) for each row of docs: its measures as 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 1000) for x in batches for i in range(0, len(x), 1000)):
            m = [np.array(measures(t), dtype=np.uint16).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m, pa.binary())], ["doc_id", "m"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, m binary")


def matrix(column: pa.Array) -> np.ndarray:
    """The measures of a batch: (rows, measures)."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), len(MEASURES))


def summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of of(measures), `size` numbers, over all rows: in tasks, then by blocks in two steps. The driver gets `size` numbers."""
    edge = [size * k // SUM_BLOCKS for k in range(SUM_BLOCKS + 1)]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size), False
        for b in (x.slice(i, TOGETHER) for x in batches for i in range(0, len(x), TOGETHER)):
            total += of(matrix(b.column(0)))
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(SUM_BLOCKS), pa.int32()), pa.array([total[a:z].tobytes() for a, z in zip(edge, edge[1:])], pa.binary())], ["block", "data"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "data": [np.sum([np.frombuffer(x) for x in pdf["data"]], axis=0).tobytes()]})

    each = rows.select("m").mapInArrow(part, "block int, data binary").withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(16)))
    some = each.groupBy("block", "slot").applyInPandas(add, "block int, data binary")
    out = np.zeros(size)
    for r in some.groupBy("block").applyInPandas(add, "block int, data binary").collect():  # SUM_BLOCKS rows
        out[edge[r["block"]] : edge[r["block"] + 1]] = np.frombuffer(r["data"])
    return out


def histogram(m: np.ndarray) -> np.ndarray:
    """Rows by measure and step."""
    at = m.astype(np.int64) + np.arange(m.shape[1]) * STEPS
    return np.bincount(at.ravel(), minlength=m.shape[1] * STEPS).astype(float)


def edges(counts: np.ndarray) -> np.ndarray:
    """(measure, edge): the least step at which a share of QUANTILES of the rows lies under or on it, exactly."""
    below = counts.reshape(-1, STEPS).cumsum(axis=1)
    need = np.array(QUANTILES) * below[0, -1]
    return np.array([np.searchsorted(row, need) for row in below])


def binned(m: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """(rows, measures): numbers of bins, over all measures; above an edge is the next bin."""
    return np.stack([np.searchsorted(e, m[:, k], side="left") + k * BINS for k, e in enumerate(edge)], axis=1)


def logits(at: np.ndarray, w: np.ndarray) -> np.ndarray:
    return w[at].sum(axis=1) + w[-1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def losses(at: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Over rows, to be summed: their number, the logistic losses of +1 and of -1, and of the latter the gradient and the curvature."""
    z, size = logits(at, w), len(w)
    p = sigmoid(z)
    curve = p * (1 - p)
    at = np.hstack([at, np.full((len(at), 1), size - 1)])
    gradient = np.bincount(at.ravel(), np.repeat(p, at.shape[1]), minlength=size)
    second = np.zeros((size, size))
    for i in range(at.shape[1]):
        for j in range(i, at.shape[1]):
            pair = np.bincount(at[:, i] * size + at[:, j] - at[:, i].min() * size, curve)
            lo = int(at[:, i].min())
            rows = -(-len(pair) // size)
            second[lo : lo + rows] += np.pad(pair, (0, rows * size - len(pair))).reshape(rows, size)
    upper = np.triu(second, 1)
    return np.concatenate([[len(at), np.logaddexp(0, -z).sum(), np.logaddexp(0, z).sum()], gradient, (upper + upper.T + np.diag(np.diag(second))).ravel()])


@dataclass(frozen=True)
class Risk:
    """The parts of the risk at some weights, as means."""

    plus: float  # of positives as +1
    minus: float  # of positives as -1
    unlabelled: float  # of unlabelled text as -1
    gradient_p: np.ndarray  # of minus; that of plus is less by the mean features
    mean_p: np.ndarray
    gradient_u: np.ndarray
    curve_u: np.ndarray

    def negative(self, prior: float) -> float:
        """The risk of bad text; it can't be negative but by chance or by overfitting."""
        return self.unlabelled - prior * self.minus

    def total(self, prior: float) -> float:
        return prior * self.plus + max(0.0, self.negative(prior))


def step(w: np.ndarray, risk: Risk, prior: float, penalty: np.ndarray) -> np.ndarray:
    """The Newton step of the whole risk. prior * (gradient of plus - gradient of minus) is -prior * mean_p: the positives' losses differ by a line."""
    return -np.linalg.solve(risk.curve_u + np.diag(penalty), risk.gradient_u - prior * risk.mean_p + penalty * w)


def step_back(risk: Risk, prior: float, penalty: np.ndarray) -> np.ndarray:
    """A step that leads the risk of bad text up."""
    return BACK * np.linalg.solve(risk.curve_u + np.diag(penalty), risk.gradient_u - prior * risk.gradient_p)


def minimised(rows: DataFrame | np.ndarray, positives: np.ndarray, edge: np.ndarray, prior: float, penalties: tuple[float, ...] = PENALTIES) -> np.ndarray:
    """Weights of the bins (the last is the intercept) that minimise the risk under the least of penalties, from the largest on, for which the risk of bad text isn't negative.

    rows: the unlabelled text as measures; positives: measures. Each penalty sets out from the weights of the one before.
    """
    size = edge.shape[0] * BINS + 1
    own = binned(positives, edge)
    mean_p = np.append(np.bincount(own.ravel(), minlength=size - 1), len(own)) / len(own)

    def risk_at(w: np.ndarray) -> Risk:
        of = lambda m: losses(binned(m, edge), w)
        u, p = of(rows) if isinstance(rows, np.ndarray) else summed(rows, of, 3 + size + size * size), of(positives)
        u, p = u[1:] / u[0], p[1:] / p[0]
        return Risk(p[0], p[1], u[1], p[2 : 2 + size], mean_p, u[2 : 2 + size], u[2 + size :].reshape(size, size))

    best = w = np.zeros(size)
    risk = risk_at(w)
    for number, weight in enumerate(penalties):
        penalty = np.append(np.full(size - 1, weight / len(own)), 1e-6)
        for _ in range(ROUNDS):
            move = step(w, risk, prior, penalty)
            aim = lambda at, r: prior * r.plus + r.negative(prior) + (penalty * at * at).sum() / 2  # noqa: B023, E731
            after = risk_at(w + move)
            while aim(w + move, after) > aim(w, risk) + 1e-9 and np.abs(move).max() >= SETTLED:  # too far: half of it
                move = move / 2
                after = risk_at(w + move)
            w, risk = w + move, after
            if np.abs(move).max() < SETTLED:
                break
        if risk.negative(prior) < 0:
            for _ in range(0 if number else ROUNDS):
                w = w + step_back(risk, prior, penalty)
                risk = risk_at(w)
                if risk.negative(prior) >= 0:
                    return w
            return best
        best = w
    return best


def best_bin(unlabelled: np.ndarray, positives: np.ndarray, doubt: float = DOUBT) -> float:
    """The prior of positives from histograms of scores, lowest bin first: the least ratio of the shares over a score, counted with its chance error."""
    over = lambda h: h[::-1].cumsum()[::-1] / max(1.0, h.sum())
    q_u, q_p = over(unlabelled), over(positives)
    chance = lambda h: math.sqrt(math.log(4 / doubt) / (2 * max(1.0, h.sum())))
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = np.where(q_p > 0, (q_u + chance(unlabelled) + chance(positives)) / q_p, math.inf)
        at = int(bound.argmin())
        return float(np.clip(q_u[at] / q_p[at], 0.01, 0.99))


def odds_bin(z: np.ndarray) -> np.ndarray:
    return np.clip((z + REACH) * (ODDS / (2 * REACH)), 0, ODDS - 1).astype(int)


def monotone(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nearest values that never fall: neighbours that do are pooled."""
    pools: list[list[float]] = []
    for v, w in zip(value, weight):
        pools.append([v * w, w, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            total, w, n = pools.pop()
            pools[-1] = [pools[-1][0] + total, pools[-1][1] + w, pools[-1][2] + n]
    return np.repeat([p[0] / p[1] for p in pools], [int(p[2]) for p in pools])


@dataclass(frozen=True)
class Model:
    """odds, good: log odds of the bins that the corpus has, and the share of good text there."""

    edges: np.ndarray
    weights: np.ndarray
    prior: float = 0.5
    odds: np.ndarray | None = None
    good: np.ndarray | None = None

    def logits(self, m: np.ndarray) -> np.ndarray:
        return np.round(logits(binned(m, self.edges), self.weights), 9)

    def seen(self, m: np.ndarray) -> np.ndarray:
        """Rows by bin of log odds."""
        return np.bincount(odds_bin(self.logits(m)), minlength=ODDS).astype(float)

    def calibrated(self, unlabelled: np.ndarray, positives: np.ndarray) -> Model:
        has = np.flatnonzero(unlabelled)
        f_u, f_p = unlabelled[has] / unlabelled.sum(), positives[has] / positives.sum()
        return replace(self, odds=(has + 0.5) * (2 * REACH / ODDS) - REACH, good=np.clip(monotone(self.prior * f_p / f_u, f_u), 0, 1))

    def scores(self, m: np.ndarray) -> np.ndarray:
        """Shares of good text; a thousandth of the score is by log odds alone and orders texts of one share."""
        z = self.logits(m)
        return sigmoid(z) if self.odds is None else 0.999 * np.interp(z, self.odds, self.good) + 0.001 * sigmoid(z)


def trusted(docs: DataFrame, labels: DataFrame, most: int = POSITIVES) -> DataFrame:
    """(doc_id): a bounded sample of the documents that a label calls good and none calls bad, without those held out."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    good = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    return good.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the measures of all rows of docs that it was fitted on. Without a trusted positive every text scores one half."""
    rows = stored(measured(docs), "quality-measures")
    edge = edges(summed(rows, histogram, len(MEASURES) * STEPS))
    size = len(MEASURES) * BINS + 1
    found = rows.join(F.broadcast(trusted(docs, labels)), "doc_id").select("doc_id", "m").distinct().orderBy("doc_id", "m").collect()  # POSITIVES, and rows that share an id
    if not found:
        return Model(edge, np.zeros(size)), rows
    positives = np.frombuffer(b"".join(r["m"] for r in found), np.uint16).reshape(len(found), len(MEASURES))
    prior = 0.5
    if len(positives) > 1:
        ranking = Model(edge, minimised(rows, positives[::2], edge, prior, FIRST))
        prior = best_bin(summed(rows, ranking.seen, ODDS), ranking.seen(positives[1::2]))
    model = Model(edge, np.round(minimised(rows, positives, edge, prior), 9), prior)
    return model.calibrated(summed(rows, model.seen, ODDS), model.seen(positives)), rows


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text).

    Null and empty texts have the measures of an empty text and are scored by them. A null doc_id counts as not held out. Repeated rows stay
    repeated; a doc_id with several texts lends its label to each. Columns other than doc_id and text are not looked at.
    """
    model, rows = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(matrix(b.column(1))))], ["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id long, score double").withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
