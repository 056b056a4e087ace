"""Co-activation of anchors: a two-layer encoder over all cards of a query refines their scores and sets a threshold.

A card's token is a projection of (score, centroid, features) beside one of the query's vector and frame, the same for all its cards. Layers
normalise after each part. Scores are a linear head of the cards' states; the threshold comes from the states
pooled by their attention to a learned vector. Cards are few by contract (MOST_CARDS is checked) and travel to all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.operators.learning import Weights, batches_of, cross_entropy, sigmoid

#: Weight of the threshold's squared error in the loss; cards of an atlas, at most; numbers of an attention matrix that are held at once.
THRESHOLD_SHARE, MOST_CARDS, AT_ONCE = 0.3, 4096, 4_000_000
FEATURES, FRAME = 8, 11
Back = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Cards:
    """Cards in order: ids, centroids (cards, dims), features (cards, FEATURES)."""

    ids: tuple[int, ...]
    centroids: np.ndarray
    features: np.ndarray


def cards_of(cards: DataFrame) -> Cards:
    """cards (doc, centroid, features) in the order of doc; a card without features has zeros."""
    rows = cards.select("doc", "centroid", "features").orderBy("doc").limit(MOST_CARDS + 1).collect()
    if len(rows) > MOST_CARDS:
        raise ValueError(f"an atlas has {MOST_CARDS} cards at most")
    zeros = [0.0] * FEATURES
    return Cards(tuple(r["doc"] for r in rows), np.array([r["centroid"] for r in rows], dtype=float), np.array([r["features"] or zeros for r in rows], dtype=float))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def normalised(x: np.ndarray, gain: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, Callable]:
    """Layer normalisation, and its way back: the gradients of x, gain and bias."""
    sd = np.sqrt(x.var(axis=-1, keepdims=True) + 1e-5)
    y = (x - x.mean(axis=-1, keepdims=True)) / sd

    def back(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = d * gain
        dx = (own - own.mean(axis=-1, keepdims=True) - y * (own * y).mean(axis=-1, keepdims=True)) / sd
        return dx, (d * y).sum(axis=tuple(range(d.ndim - 1))), d.sum(axis=tuple(range(d.ndim - 1)))

    return y * gain + bias, back


def over_rows(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The gradient of a matrix that rows x were multiplied by."""
    return x.reshape(-1, x.shape[-1]).T @ d.reshape(-1, d.shape[-1])


@dataclass(frozen=True)
class CoActivation:
    """The net. Examples: ce (scores in the order of cards), qvec, frame (array or null), gold_mask, gold_k."""

    cards: Cards
    width: int = 32
    heads: int = 4
    layers: int = 2
    inner: int = 64
    frame: int = FRAME

    def shapes(self) -> dict[str, tuple[int, ...]]:
        d, half, dims = self.width, self.width // 2, self.cards.centroids.shape[1]
        out: dict[str, tuple[int, ...]] = {"card": (1 + dims + FEATURES, half), "card_bias": (half,), "query": (dims + self.frame, half), "query_bias": (half,)}
        for k in range(self.layers):
            out |= {
                f"{k}.attend": (d, 3 * d), f"{k}.attend_bias": (3 * d,), f"{k}.join": (d, d), f"{k}.join_bias": (d,), f"{k}.first_gain": (d,), f"{k}.first_bias": (d,),
                f"{k}.widen": (d, self.inner), f"{k}.widen_bias": (self.inner,), f"{k}.narrow": (self.inner, d), f"{k}.narrow_bias": (d,), f"{k}.second_gain": (d,), f"{k}.second_bias": (d,),
            }
        return out | {"score_vector": (d,), "score_bias": (1,), "pool_vector": (d,), "threshold": (d, half), "threshold_bias": (half,), "threshold_vector": (half,), "threshold_last_bias": (1,)}

    def asked(self, pdf: pd.DataFrame) -> np.ndarray:
        """Vectors of queries and their frames; without a frame there are zeros."""
        q = np.stack(pdf["qvec"]).astype(float)
        zeros = np.zeros(self.frame)
        frames = pdf["frame"] if "frame" in pdf else [None] * len(pdf)
        return np.hstack([q, np.stack([zeros if f is None else np.asarray(f, dtype=float) for f in frames])]) if self.frame else q

    def layer(self, w: Weights, k: int, t: np.ndarray) -> tuple[np.ndarray, Callable]:
        b, n, d = t.shape
        h = self.heads
        split = lambda x: x.reshape(b, n, h, d // h).transpose(0, 2, 1, 3)
        merge = lambda x: x.transpose(0, 2, 1, 3).reshape(b, n, d)
        q, key, v = (split(x) for x in np.split(t @ w[f"{k}.attend"] + w[f"{k}.attend_bias"], 3, axis=-1))
        scale = 1 / math.sqrt(d // h)
        p = softmax(q @ key.transpose(0, 1, 3, 2) * scale)
        o = merge(p @ v)
        u, back_1 = normalised(t + o @ w[f"{k}.join"] + w[f"{k}.join_bias"], w[f"{k}.first_gain"], w[f"{k}.first_bias"])
        wide = np.maximum(u @ w[f"{k}.widen"] + w[f"{k}.widen_bias"], 0)
        out, back_2 = normalised(u + wide @ w[f"{k}.narrow"] + w[f"{k}.narrow_bias"], w[f"{k}.second_gain"], w[f"{k}.second_bias"])

        def back(dy: np.ndarray, g: Weights) -> np.ndarray:
            du, g[f"{k}.second_gain"], g[f"{k}.second_bias"] = back_2(dy)
            g[f"{k}.narrow"], g[f"{k}.narrow_bias"] = over_rows(wide, du), du.sum(axis=(0, 1))
            dw = (du @ w[f"{k}.narrow"].T) * (wide > 0)
            g[f"{k}.widen"], g[f"{k}.widen_bias"] = over_rows(u, dw), dw.sum(axis=(0, 1))
            dt, g[f"{k}.first_gain"], g[f"{k}.first_bias"] = back_1(du + dw @ w[f"{k}.widen"].T)
            g[f"{k}.join"], g[f"{k}.join_bias"] = over_rows(o, dt), dt.sum(axis=(0, 1))
            do = split(dt @ w[f"{k}.join"].T)
            dp = do @ v.transpose(0, 1, 3, 2)
            ds = p * (dp - (dp * p).sum(axis=-1, keepdims=True)) * scale
            three = np.concatenate([merge(ds @ key), merge(ds.transpose(0, 1, 3, 2) @ q), merge(p.transpose(0, 1, 3, 2) @ do)], axis=-1)
            g[f"{k}.attend"], g[f"{k}.attend_bias"] = over_rows(t, three), three.sum(axis=(0, 1))
            return dt + three @ w[f"{k}.attend"].T

        return out, back

    def forward(self, w: Weights, ce: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable]:
        """(refined scores, thresholds, way back) for scores (queries, cards) and queries."""
        b, n = ce.shape
        half = self.width // 2
        fixed = np.hstack([self.cards.centroids, self.cards.features])
        of_cards = ce[:, :, None] * w["card"][0] + fixed @ w["card"][1:] + w["card_bias"]
        of_query = asked @ w["query"] + w["query_bias"]
        t = np.concatenate([of_cards, np.broadcast_to(of_query[:, None], (b, n, half))], axis=-1)
        backs = []
        for k in range(self.layers):
            t, back = self.layer(w, k, t)
            backs.append(back)
        refined = sigmoid(t @ w["score_vector"] + w["score_bias"])
        a = softmax(t @ w["pool_vector"])
        z = np.einsum("bn,bnd->bd", a, t)
        h = np.maximum(z @ w["threshold"] + w["threshold_bias"], 0)
        threshold = sigmoid(h @ w["threshold_vector"] + w["threshold_last_bias"])

        def backward(d_score: np.ndarray, d_threshold: np.ndarray) -> Weights:
            """The gradient from those of the two outputs' log odds."""
            g: Weights = {"score_vector": np.einsum("bn,bnd->d", d_score, t), "score_bias": np.array([d_score.sum()]), "threshold_vector": h.T @ d_threshold, "threshold_last_bias": np.array([d_threshold.sum()])}
            dh = d_threshold[:, None] * w["threshold_vector"] * (h > 0)
            g["threshold"], g["threshold_bias"] = z.T @ dh, dh.sum(axis=0)
            dz = dh @ w["threshold"].T
            da = np.einsum("bd,bnd->bn", dz, t)
            dl = a * (da - (da * a).sum(axis=1, keepdims=True))
            g["pool_vector"] = np.einsum("bn,bnd->d", dl, t)
            dt = d_score[..., None] * w["score_vector"] + a[..., None] * dz[:, None] + dl[..., None] * w["pool_vector"]
            for back in reversed(backs):
                dt = back(dt, g)
            dc, dq = dt[..., :half], dt[..., half:].sum(axis=1)
            g["card"] = np.vstack([np.einsum("bn,bnd->d", ce, dc)[None], fixed.T @ dc.sum(axis=0)])
            g["card_bias"], g["query"], g["query_bias"] = dc.sum(axis=(0, 1)), asked.T @ dq, dq.sum(axis=0)
            return g

        return refined, threshold, backward

    def together(self) -> int:
        """Queries that are looked at together, so that attention stays within AT_ONCE numbers."""
        return max(1, AT_ONCE // (self.heads * max(1, len(self.cards.ids)) ** 2))

    def slopes(self, w: Weights, examples: pd.DataFrame) -> tuple[float, Weights]:
        loss, total = 0.0, {name: np.zeros(shape) for name, shape in self.shapes().items()}
        for pdf in batches_of(examples, self.together()):
            ce, y = np.stack(pdf["ce"]).astype(float), np.stack(pdf["gold_mask"]).astype(float)
            n = ce.shape[1]
            target = pdf["gold_k"].to_numpy(float) / n
            refined, threshold, backward = self.forward(w, ce, self.asked(pdf))
            loss += float(cross_entropy(refined, y).mean(axis=1).sum() + THRESHOLD_SHARE * ((threshold - target) ** 2).sum())
            g = backward((refined - y) / n, 2 * THRESHOLD_SHARE * (threshold - target) * threshold * (1 - threshold))
            for name in total:
                total[name] += g[name]
        return loss, total


def refined(rows: DataFrame, net: CoActivation, w: Weights) -> DataFrame:
    """(query_id, doc, refined, threshold) for each card of each of rows (query_id long, qvec, ce in the order of cards, frame)."""
    shared = rows.sparkSession.sparkContext.broadcast((net, w))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, w = shared.value
        for b in batches:
            for pdf in batches_of(b, net.together()):
                score, threshold, _ = net.forward(w, np.stack(pdf["ce"]).astype(float), net.asked(pdf))
                n = len(net.cards.ids)
                yield pd.DataFrame({"query_id": np.repeat(pdf["query_id"].to_numpy(), n), "doc": np.tile(np.array(net.cards.ids), len(pdf)), "refined": np.round(score, 6).ravel(), "threshold": np.repeat(np.round(threshold, 6), n)})

    return rows.mapInPandas(run, "query_id long, doc int, refined double, threshold double")


def chosen(scores: DataFrame, least: int = 1) -> DataFrame:
    """scores (query_id, doc, refined, threshold) that reach their query's threshold, the best `least` at any rate, with rank."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("refined"), "doc")
    ranked = scores.withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked.where((F.col("refined") >= F.col("threshold")) | (F.col("rank") <= max(1, least)))
