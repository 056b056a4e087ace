"""Training over tables: gradients are summed by shards of examples over the cluster, weights live on the driver.

A net says what its weights are and what a batch of examples loses, with the gradient. Each step is one job over a slice of the
examples: shards of bounded size are grouped, a shard's rows are taken in the order of their ids, and sums are added in the order of
shards, so that a run gives the same weights however its tasks are dealt. After each epoch the whole state is written
as a table of its own; a run that is started again goes on from the last whole one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.sources.files import whole_tables

Weights = dict[str, np.ndarray]
#: Examples of a shard, about; sums that reach the driver at once.
SHARD, SUMS = 2048, 64
#: Decay of the first and second moments, and what keeps the division whole.
BETA_1, BETA_2, EPSILON = 0.9, 0.999, 1e-8


class Net(Protocol):
    def shapes(self) -> dict[str, tuple[int, ...]]: ...

    def slopes(self, w: Weights, examples: pd.DataFrame) -> tuple[float, Weights]:
        """The loss of the examples, summed, and its gradient."""


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def cross_entropy(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return -(y * np.log(p) + (1 - y) * np.log(1 - p))


def first_weights(net: Net, seed: int) -> Weights:
    """Matrices with the variance that keeps a layer's outputs level, gains of 1, others 0."""
    rng = np.random.default_rng(seed)
    out = {}
    for name, shape in net.shapes().items():
        if len(shape) > 1:
            out[name] = rng.standard_normal(shape) * math.sqrt(1 / shape[0])
        else:
            out[name] = np.ones(shape) if name.endswith("gain") else rng.standard_normal(shape) * 0.02 if name.endswith("vector") else np.zeros(shape)
    return out


def flat(w: Weights, net: Net) -> np.ndarray:
    return np.concatenate([w[name].ravel() for name in net.shapes()])


def shaped(w: np.ndarray, net: Net) -> Weights:
    out, at = {}, 0
    for name, shape in net.shapes().items():
        n = math.prod(shape)
        out[name], at = w[at : at + n].reshape(shape), at + n
    return out


@dataclass(frozen=True)
class Mlp:
    """x (array of `inputs` numbers) through one layer of `hidden` rectified units to a logistic output; cross-entropy with label."""

    inputs: int
    hidden: int = 32

    def shapes(self) -> dict[str, tuple[int, ...]]:
        return {"in": (self.inputs, self.hidden), "in_bias": (self.hidden,), "out_vector": (self.hidden,), "out_bias": (1,)}

    def scores(self, w: Weights, x: np.ndarray) -> np.ndarray:
        return sigmoid(np.maximum(x @ w["in"] + w["in_bias"], 0) @ w["out_vector"] + w["out_bias"])

    def slopes(self, w: Weights, examples: pd.DataFrame) -> tuple[float, Weights]:
        x, y = np.stack(examples["x"]).astype(float), examples["label"].to_numpy(float)
        h = np.maximum(x @ w["in"] + w["in_bias"], 0)
        p = sigmoid(h @ w["out_vector"] + w["out_bias"])
        d = p - y
        dh = d[:, None] * w["out_vector"] * (h > 0)
        return float(cross_entropy(p, y).sum()), {"in": x.T @ dh, "in_bias": dh.sum(axis=0), "out_vector": h.T @ d, "out_bias": np.array([d.sum()])}


@dataclass(frozen=True)
class Phase:
    """Epochs over the examples of some kinds; shares: of each kind, the part that takes part, by hash of the example."""

    name: str
    shares: dict[str, float]
    epochs: int
    rate: float = 1e-3

    def of(self, examples: DataFrame) -> DataFrame:
        share = F.create_map(*[F.lit(x) for kv in self.shares.items() for x in kv])[F.col("kind")]
        return examples.where(share.isNotNull() & (F.pmod(F.xxhash64("example", F.lit(self.name)), F.lit(1_000_000)) < share * 1_000_000))


@dataclass
class State:
    """What a run needs to go on: epochs that are done, in all and in the phase, weights and their moments, the best of the phase."""

    epoch: int
    phase: int
    in_phase: int
    step: int
    w: np.ndarray
    m: np.ndarray
    v: np.ndarray
    best: np.ndarray
    least: float
    stale: int
    history: list[tuple] = field(default_factory=list)  # epoch, phase, examples, loss, held_loss


STATE = "epoch long, phase long, in_phase long, step long, w array<double>, m array<double>, v array<double>, best array<double>, least double, stale long, history array<struct<epoch: long, phase: string, examples: long, loss: double, held_loss: double>>"


def save(spark: SparkSession, path: str, s: State) -> None:
    row = (s.epoch, s.phase, s.in_phase, s.step, s.w.tolist(), s.m.tolist(), s.v.tolist(), s.best.tolist(), s.least, s.stale, s.history)
    spark.createDataFrame([row], STATE).coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch-{s.epoch:06d}")


def load(spark: SparkSession, path: str) -> State | None:
    """The last state that was written to its end."""
    tables = whole_tables(spark, path, "epoch-")
    if not tables:
        return None
    r = spark.read.schema(STATE).parquet(tables[-1]).first()
    vectors = [np.array(r[c]) for c in ("w", "m", "v", "best")]
    return State(r["epoch"], r["phase"], r["in_phase"], r["step"], *vectors, r["least"], r["stale"], [tuple(x) for x in r["history"]])


def summed_slopes(examples: DataFrame, net: Net, w: np.ndarray, shards: int) -> tuple[int, float, np.ndarray]:
    """(examples, loss, gradient), summed over examples (example, shard and what the net reads); always in the same order."""
    shared = examples.sparkSession.sparkContext.broadcast(w)

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        loss, slope = net.slopes(shaped(shared.value, net), pdf.sort_values("example", kind="stable"))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "n": [len(pdf)], "loss": [loss], "slope": [flat(slope, net).tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        slope = np.sum([np.frombuffer(x) for x in pdf["slope"]], axis=0)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "n": [pdf["n"].sum()], "loss": [float(sum(pdf["loss"]))], "slope": [slope.tobytes()]})

    schema = "shard long, n long, loss double, slope binary"
    each = examples.groupBy("shard").applyInPandas(part, schema)
    if shards > SUMS:
        each = each.groupBy(F.floor(F.col("shard") * SUMS / shards).alias("lot")).applyInPandas(add, schema)
    rows = sorted(each.collect(), key=lambda r: r["shard"])  # SUMS rows at most
    n, slope = sum(r["n"] for r in rows), np.zeros(len(w))
    for r in rows:
        slope = slope + np.frombuffer(r["slope"])
    shared.unpersist()
    return n, float(sum(r["loss"] for r in rows)), slope


def dealt(examples: DataFrame, rows: int = SHARD) -> tuple[DataFrame, int]:
    """examples with shard, and how many there are: about `rows` examples each, by hash of the id."""
    shards = max(1, -(-examples.count() // rows))
    return examples.withColumn("shard", F.pmod(F.xxhash64("example"), F.lit(shards))), shards


def fitted(
    examples: DataFrame, net: Net, phases: list[Phase], path: str, *, steps: int = 4, decay: float = 0.01, warm: float = 0.1, patience: int = 3, seed: int = 42, rows: int = SHARD, until: int | None = None,
) -> State:
    """AdamW over examples (example long, kind, held boolean, and what the net reads), phase by phase.

    An epoch has `steps` steps over slices by hash. Held-out examples are only looked at for the loss that ends a phase after
    `patience` epochs without a better one; the phase's best weights go on. path: a folder in shared storage, of this run alone; if it has states, the
    run goes on from there. until: ends after so many epochs in all. Null ids make examples that can't be told apart, so they are refused.
    """
    spark = examples.sparkSession
    all_, shards = dealt(examples, rows)
    if not examples.where(F.col("example").isNull()).isEmpty():
        raise ValueError("an example needs an id")
    s = load(spark, path)
    if s is None:
        w = flat(first_weights(net, seed), net)
        s = State(0, 0, 0, 0, w, np.zeros_like(w), np.zeros_like(w), w, math.inf, 0)
    while s.phase < len(phases) and (until is None or s.epoch < until):
        phase = phases[s.phase]
        own, held = phase.of(all_.where("not held")), all_.where("held")
        slot = F.pmod(F.xxhash64("example", F.lit(seed), F.lit(s.epoch)), F.lit(steps))
        seen, loss, w = 0, 0.0, s.w
        for k in range(steps):
            n, lost, slope = summed_slopes(own.where(slot == k), net, w, shards)
            seen, loss = seen + n, loss + lost
            if n:
                s.step += 1
                w = adam(w, slope / n, s, phase.rate * min(1.0, (s.in_phase * steps + k + 1) / max(1.0, warm * phase.epochs * steps)), decay)
        s.w, s.epoch, s.in_phase = w, s.epoch + 1, s.in_phase + 1
        n, lost, _ = summed_slopes(held, net, w, shards)
        judged = lost / n if n else loss / max(1, seen)  # without held-out examples the loss of training decides
        s.history.append((s.epoch, phase.name, seen, round(loss / max(1, seen), 9), round(judged, 9)))
        if judged < s.least - 1e-9:
            s.best, s.least, s.stale = w, judged, 0
        else:
            s.stale += 1
        if s.in_phase >= phase.epochs or s.stale >= patience or not seen:
            s.phase, s.in_phase, s.stale, s.least, s.w, s.step = s.phase + 1, 0, 0, math.inf, s.best, 0
            s.m, s.v = np.zeros_like(w), np.zeros_like(w)  # a phase begins with moments of its own
        save(spark, path, s)
    return s


def adam(w: np.ndarray, slope: np.ndarray, s: State, rate: float, decay: float) -> np.ndarray:
    s.m = BETA_1 * s.m + (1 - BETA_1) * slope
    s.v = BETA_2 * s.v + (1 - BETA_2) * slope * slope
    m, v = s.m / (1 - BETA_1**s.step), s.v / (1 - BETA_2**s.step)
    return w - rate * (m / (np.sqrt(v) + EPSILON) + decay * w)


def weight_table(spark: SparkSession, s: State, net: Net) -> DataFrame:
    """(name, shape, value): the best weights as a table."""
    rows = [(name, list(x.shape), x.ravel().tolist()) for name, x in shaped(s.best, net).items()]
    return spark.createDataFrame(rows, "name string, shape array<int>, value array<double>")


def read_weights(table: DataFrame, net: Net) -> Weights:
    """Weights of a table, which must have those of the net and no others."""
    found = {r["name"]: np.array(r["value"]).reshape(r["shape"]) for r in table.collect()}  # a row for each matrix
    if {k: v.shape for k, v in found.items()} != net.shapes():
        raise ValueError("the table's weights aren't those of the net")
    return found


def held_out(group: Column, share: float = 0.15) -> Column:
    """Whole groups, by hash of their text."""
    return F.conv(F.substring(F.md5(group.cast("string")), 1, 8), 16, 10).cast("long") < int(share * 2**32)


def batches_of(pdf: pd.DataFrame, n: int) -> Iterator[pd.DataFrame]:
    for k in range(0, len(pdf), n):
        yield pdf.iloc[k : k + n]
