"""Toxicity by weak supervision.

Many voters look at a text: lexicon units (words and word beginnings that toxic or clean labelled texts
favour) and patterns (shouting, repeated marks, direct address). All documents are turned into votes in one
pass over whole texts. A generative label model then learns from the votes of all documents, labelled or not, how
each voter votes given the hidden class and how voters depend on each other: EM, whose voters form a forest
within the class, grown by conditional mutual information. Its posteriors are the labels of a linear classifier, which
is fitted on all documents, too. Given labels choose the voters, begin EM and calibrate its posteriors, from a
bounded sample of labelled rows; they are no witness of any document's class.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.llm.common import stored

#: Labelled rows to learn from, at most: those whose ids come first by hash. Documented bound of the fit.
LABELLED_ROWS = 20_000
#: Lexicon voters, at most; labelled texts that must hold a unit; lengths of word beginnings.
LEXICON, LEAST_TEXTS, BEGINNINGS = 400, 4, (4, 5, 6)
#: Log-likelihood ratio from which a unit may vote (chance alone passes it for one unit in some hundred thousand).
LEAST_RATIO = 20.0
#: Labels with this remainder of crc32(doc_id) by FOLDS are held out.
FOLDS, HELD = 5, 0
#: Units that a task counts before it hands its counts on.
MOST_UNITS = 100_000
#: Rounds of EM; share of the lesser entropy that two voters must share within the class to be linked.
EM_ROUNDS, LINKED = 5, 0.05
#: Given labels count as so many rows of each class at most in the voters' rates.
PRIOR_ROWS = 50
#: Newton steps of the classifier, and what it pays for large weights.
NEWTON_ROUNDS, RIDGE = 6, 1.0
#: Documents of which a task holds votes as a dense matrix; blocks that sums are dealt in.
DENSE, SUM_BLOCKS = 4096, 16
#: Words whose voters a task remembers.
REMEMBERED = 300_000
WORD = re.compile(r"[^\W\d_]{3,}")
#: Pattern voters, as text patterns over the whole text and the count from which they vote.
PATTERNS = (
    ("marks", re.compile(r"[!?]{2,}"), 1),
    ("many marks", re.compile(r"[!?]{2,}"), 8),
    ("shouting", re.compile(r"\b[A-Z]{4,}\b"), 3),
    ("stretched", re.compile(r"([a-z])\1{3,}"), 1),
    ("masked", re.compile(r"\b\w+[*@#$%]{2,}\w*"), 2),
    ("address", re.compile(r"\b(?:you|your|du|dein|tu|vous)\b", re.IGNORECASE), 3),
)

#: What every match of "masked" holds.
MASKS = re.compile(r"[*@#$%]{2}")


def held_out(doc_id: Column) -> Column:
    return (F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD) & doc_id.isNotNull()


def units(text: str) -> set[str]:
    """Distinct lexicon units of a text: words, and beginnings of longer words with a `-` after them."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "-" for w in words for n in BEGINNINGS if len(w) > n}


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of a bounded sample of the labelled rows that aren't held out. A document with both labels is toxic."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def lexicon(texts: DataFrame, most: int = LEXICON) -> list[str]:
    """The units whose share among toxic texts differs most surely from that among clean ones."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[int]] = {}

        def out() -> pd.DataFrame:
            rows = pd.DataFrame(list(seen.values()), columns=["c", "t"], dtype="int64")
            rows.insert(0, "unit", list(seen))
            seen.clear()
            return rows[["unit", "t", "c"]]

        for b in batches:
            for text, y in zip(b["text"], b["toxic"]):
                for u in units(text or ""):
                    seen.setdefault(u, [0, 0])[int(y > 0)] += 1
                if len(seen) > MOST_UNITS:  # bounded memory: hand on and begin anew
                    yield out()
        if seen:
            yield out()

    n = texts.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    t, c = n["t"], n["n"] - n["t"]
    if not t or not c:
        return []
    found = texts.select("text", "toxic").mapInPandas(count, "unit string, t long, c long").groupBy("unit").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    found = found.where(F.col("t") + F.col("c") >= LEAST_TEXTS)
    # log-likelihood ratio of "the unit's share differs" to "it doesn't": many texts and a clear side, both count
    share = (F.col("t") + F.col("c")) / (t + c)
    surprise = lambda seen, due: F.when(seen > 0, seen * F.log(seen / due)).otherwise(0.0)
    ratio = 2 * (surprise(F.col("t"), t * share) + surprise(F.col("c"), c * share))
    best = found.select("unit", F.round(ratio, 6).alias("g")).where(F.col("g") >= LEAST_RATIO).orderBy(F.desc("g"), "unit").limit(most)
    return sorted(r["unit"] for r in best.collect())


class Voters:
    """Who speaks up on a text: lexicon units by number, then the patterns. Remembers the units of words that it has seen."""

    def __init__(self, units: tuple[str, ...]):
        self.at = {u: k for k, u in enumerate(units)}
        self.count = len(units) + len(PATTERNS)
        self.known: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        own = [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        found = self.known[word] = tuple(self.at[u] for u in own if u in self.at)
        return found

    def votes(self, text: str | None) -> list[int]:
        text = text or ""
        out: set[int] = set()
        known = self.known
        for w in set(WORD.findall(text.lower())):
            found = known.get(w)
            if found is None:
                found = self.of_word(w)
            if found:
                out.update(found)
        for k, (name, pattern, least) in enumerate(PATTERNS):
            if name == "masked" and not MASKS.search(text):  # a fast look first
                continue
            n = 0
            for _ in pattern.finditer(text):
                n += 1
                if n >= least:
                    out.add(len(self.at) + k)
                    break
        return sorted(out)


def text_keys() -> list[Column]:
    """128 bits of a text; a null text is an empty one."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("key"), F.xxhash64(F.lit(1), text).alias("other_key")]


def cast_votes(docs: DataFrame, voters: Voters) -> DataFrame:
    """(doc_id, key, other_key, v) for each row of docs: the numbers of the voters that speak up, and the keys of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 1000) for x in batches for i in range(0, len(x), 1000)):
            found = [voters.votes(t) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.list_(pa.int32()))], ["doc_id", "key", "other_key", "v"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(), "text").mapInArrow(run, "doc_id long, key long, other_key long, v array<int>")


def dense(v: pa.Array, m: int) -> Iterator[np.ndarray]:
    """0/1 matrices of a list column, DENSE rows at most each."""
    for lo in range(0, len(v), DENSE):
        part = v.slice(lo, DENSE)
        out = np.zeros((len(part), m))
        out[np.repeat(np.arange(len(part)), part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), part.flatten().to_numpy(zero_copy_only=False)] = 1
        yield out


def sums(cast: DataFrame, m: int, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of of(matrix), an array of `size` numbers, over all rows of cast: in tasks, then by blocks in two steps. The driver gets `size` numbers."""
    edge = [size * k // SUM_BLOCKS for k in range(SUM_BLOCKS + 1)]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size), False
        for b in batches:
            for x in dense(b.column(0), m):
                total += of(x).ravel()
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(SUM_BLOCKS), pa.int32()), pa.array([total[a:z].tobytes() for a, z in zip(edge, edge[1:])], pa.binary())], ["block", "data"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "data": [np.sum([np.frombuffer(x) for x in pdf["data"]], axis=0).tobytes()]})

    each = cast.select("v").mapInArrow(part, "block int, data binary").withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(16)))
    some = each.groupBy("block", "slot").applyInPandas(add, "block int, data binary")
    out = np.zeros(size)
    for r in some.groupBy("block").applyInPandas(add, "block int, data binary").collect():  # SUM_BLOCKS rows
        out[edge[r["block"]] : edge[r["block"] + 1]] = np.frombuffer(r["data"])
    return out


@dataclass(frozen=True)
class LabelModel:
    """P(class) and P(vote | class, parent's vote): class 1 is toxic; parent -1: none."""

    prior: float
    rate: np.ndarray  # class, voter
    parent: np.ndarray
    given: np.ndarray  # class, parent's vote, voter

    def logit(self, v: np.ndarray) -> np.ndarray:
        """Log odds of toxic for rows of votes."""
        ratio = lambda r: (np.log(r[1] / r[0]), np.log((1 - r[1]) / (1 - r[0])))
        free, kids = np.flatnonzero(self.parent < 0), np.flatnonzero(self.parent >= 0)
        on, off = ratio(self.rate[:, free])
        out = math.log(self.prior / (1 - self.prior)) + v[:, free] @ (on - off) + off.sum()
        if len(kids):
            (on0, off0), (on1, off1) = ratio(self.given[:, 0, kids]), ratio(self.given[:, 1, kids])
            own, up = v[:, kids], v[:, self.parent[kids]]
            out = out + own @ (on0 - off0) + up @ (off1 - off0) + (own * up) @ (on1 - off1 - on0 + off0) + off0.sum()
        return out

    def posterior(self, v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(v), -30, 30)))

    def expected(self, v: np.ndarray) -> np.ndarray:
        """Of each class: rows, votes of each voter, common votes of each two."""
        q = self.posterior(v)
        out = []
        for w in (1 - q, q):
            out += [[w.sum()], w @ v, ((v * w[:, None]).T @ v).ravel()]
        return np.concatenate(out)


def unpacked(total: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """expected()'s sums as rows (2), votes (2, m), common votes (2, m, m)."""
    two = total.reshape(2, 1 + m + m * m)
    return two[:, 0], two[:, 1 : 1 + m], two[:, 1 + m :].reshape(2, m, m)


def forest(mass: np.ndarray, one: np.ndarray, both: np.ndarray, linked: float = LINKED) -> np.ndarray:
    """The parent of each voter in the forest of the strongest dependences within the class (-1: none)."""
    m = one.shape[1]
    n = mass.sum()
    information, entropy = np.zeros((m, m)), np.zeros(m)
    for c in range(2):
        if mass[c] <= 0:
            continue
        p, pair = one[c] / mass[c], both[c] / mass[c]
        for a in (1, 0):
            pa_ = p if a else 1 - p
            entropy -= mass[c] / n * pa_ * np.log(np.maximum(pa_, 1e-12))
            for b in (1, 0):
                pb = p if b else 1 - p
                joint = np.maximum(pair if a and b else p[:, None] - pair if a else p[None, :] - pair if b else 1 - p[:, None] - p[None, :] + pair, 0)
                information += mass[c] / n * joint * np.log(np.maximum(joint, 1e-12) / np.maximum(pa_[:, None] * pb[None, :], 1e-12))
    share = information / np.maximum(np.minimum(entropy[:, None], entropy[None, :]), 1e-9)
    parent = np.full(m, -1)
    # the strongest links first, none that closes a ring; then each tree hangs from its most frequent voter
    group, near = np.arange(m), [[] for _ in range(m)]
    i, j = np.nonzero(np.triu(share >= linked, 1))
    for k in np.lexsort((j, i, -information[i, j])):
        a, b = int(i[k]), int(j[k])
        if group[a] != group[b]:
            group[group == group[b]] = group[a]
            near[a].append(b)
            near[b].append(a)
    seen = np.zeros(m, dtype=bool)
    for root in np.lexsort((np.arange(m), -one.sum(axis=0))):
        todo = [] if seen[root] else [int(root)]
        seen[root] = True
        while todo:
            a = todo.pop()
            for b in near[a]:
                if not seen[b]:
                    seen[b], parent[b] = True, a
                    todo.append(b)
    return parent


def maximised(mass: np.ndarray, one: np.ndarray, both: np.ndarray, parent: np.ndarray, prior: tuple[np.ndarray, np.ndarray]) -> LabelModel:
    """The model of expected sums; prior: rows and votes of each class that count beside them."""
    rows, ones = prior
    rate = (one + ones + 0.5) / (mass + rows + 1.0)[:, None]
    given = np.stack([rate, rate], axis=1)
    for j in np.flatnonzero(parent >= 0):
        up = parent[j]
        on = (both[:, j, up] + 2 * rate[:, j]) / (one[:, up] + 2)
        off = (one[:, j] - both[:, j, up] + 2 * rate[:, j]) / (mass - one[:, up] + 2)
        given[:, 1, j], given[:, 0, j] = on, off
    share = float((mass[1] + 1) / (mass.sum() + 2))
    return LabelModel(share, np.clip(rate, 1e-6, 1 - 1e-6), parent, np.clip(given, 1e-6, 1 - 1e-6))


def label_model(cast: DataFrame, v: np.ndarray, y: np.ndarray, rounds: int = EM_ROUNDS, linked: float = LINKED) -> LabelModel:
    """EM over all rows of cast (v array<int>). v, y: votes and labels of the labelled sample, of which EM sets out; PRIOR_ROWS of each class stay as a prior.

    Every E step goes over all documents; the labels of none are looked at. In each round the forest of
    dependences is grown anew from the expected common votes, and its rates are estimated with the others.
    """
    m = v.shape[1]
    sample = unpacked(np.concatenate([np.concatenate([[w.sum()], w @ v, ((v * w[:, None]).T @ v).ravel()]) for w in (1 - y, y)]), m)
    scale = np.minimum(1, PRIOR_ROWS / np.maximum(sample[0], 1))
    model = maximised(*sample, forest(*sample, linked), (np.zeros(2), np.zeros((2, m))))
    for _ in range(rounds):
        total = unpacked(sums(cast, m, model.expected, 2 * (1 + m + m * m)), m)
        model = maximised(*total, forest(*total, linked), (sample[0] * scale, sample[1] * scale[:, None]))
    return model


def calibration(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) by which log odds z say best what labels y are; the slope is never negative."""
    w = linear(np.clip(z, -30, 30)[:, None] / 10, y, ridge=1e-2)
    return max(0.0, float(w[0]) / 10), float(w[1])


def linear(v: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic regression on soft targets, by Newton steps."""
    w = np.zeros(v.shape[1] + 1)
    for _ in range(rounds):
        w = newton_step(w, newton_parts(v, target, w), ridge)
    return w


def newton_parts(v: np.ndarray, target: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and curvature of a logistic regression on rows v, to be summed."""
    x = np.hstack([v, np.ones((len(v), 1))])
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return np.concatenate([x.T @ (target - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])


def newton_step(w: np.ndarray, total: np.ndarray, ridge: float) -> np.ndarray:
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    g, h = total[: len(w)], total[len(w) :].reshape(len(w), len(w))
    return w + np.linalg.solve(h + np.diag(penalty), g - penalty * w)


@dataclass(frozen=True)
class Model:
    units: tuple[str, ...]
    weights: tuple[float, ...]

    def column(self, text: Column) -> Column:
        """The score of text as a column, between 0 and 1."""
        voters, w = Voters(self.units), self.weights

        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            return pd.Series([1 / (1 + math.exp(-max(-30.0, min(30.0, w[-1] + sum(w[k] for k in voters.votes(t)))))) for t in texts], dtype="float64")

        return score(text)


@dataclass(frozen=True)
class Fitted:
    """What fit() learned, and the votes of all documents that it learned from."""

    model: Model
    cast: DataFrame
    labels: LabelModel | None = None
    slope: float = 1.0
    shift: float = 0.0

    def target(self, v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.labels.logit(v) + self.shift, -30, 30)))

    def scores(self) -> DataFrame:
        """(doc_id, key, other_key, score, posterior) of every document, from its votes; posterior: what the label model says, null without one."""
        w, m, labels, target = np.array(self.model.weights), len(self.model.weights) - 1, self.labels, replace(self, cast=None).target  # a DataFrame can't travel

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = 0
                for x in dense(b.column(3), m):
                    score = 1 / (1 + np.exp(-np.clip(np.round(x @ w[:-1] + w[-1], 9), -30, 30)))
                    post = pa.array(target(x)) if labels else pa.nulls(len(x), pa.float64())
                    yield pa.RecordBatch.from_arrays([*[c.slice(at, len(x)) for c in b.columns[:3]], pa.array(score), post], ["doc_id", "key", "other_key", "score", "posterior"])
                    at += len(x)

        return self.cast.mapInArrow(run, "doc_id long, key long, other_key long, score double, posterior double")


def fit(docs: DataFrame, labels: DataFrame) -> Fitted:
    """Without labels of both classes every text scores as low as the lowest: there is nothing to learn from."""
    texts = stored(labelled_texts(docs, labels), "toxicity-labelled")
    known = tuple(lexicon(texts))
    voters = Voters(known)
    cast = stored(cast_votes(docs, voters), "toxicity-votes")
    if not known:
        return Fitted(Model((), (0.0,) * len(PATTERNS) + (-30.0,)), cast)
    m = voters.count
    rows = cast_votes(texts, voters).join(F.broadcast(texts.select("doc_id", "toxic")), "doc_id").orderBy("doc_id").select("v", "toxic").collect()  # LABELLED_ROWS at most
    v, y = np.zeros((len(rows), m)), np.array([float(r["toxic"]) for r in rows])
    for i, r in enumerate(rows):
        v[i, r["v"]] = 1
    generative = label_model(cast, v, y)
    out = Fitted(Model(known, ()), None, generative, *calibration(generative.logit(v), y))
    w = np.zeros(m + 1)
    for _ in range(NEWTON_ROUNDS):
        w = newton_step(w, sums(cast, m, lambda x: newton_parts(x, out.target(x), w), (m + 1) * (m + 2)), RIDGE)  # noqa: B023
    return Fitted(Model(known, tuple(np.round(w, 9).tolist())), cast, generative, out.slope, out.shift)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, posterior (of the label model) for each row of docs (doc_id, text).

    Null and empty texts get the score of a text on which no voter speaks. A null doc_id counts as not held
    out. Repeated rows stay repeated. Columns other than doc_id and text are not looked at.
    """
    out = fit(docs, labels).scores().withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "posterior")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects: null and empty texts are scored like any other, equal texts stay or go together. Any column names are fine.

    Scores come from the votes that fit() has written; a row is found again by 128 bits of its text.
    """
    bad = stored(fit(docs, labels).scores().where("score >= 0.5").select("key", "other_key").distinct(), "toxicity-rejected")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, *text_keys()).join(bad, ["key", "other_key"], "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
