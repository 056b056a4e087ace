"""Training: gradients, forward passes, restarts, draws and sweeps."""

import math
import random
import tempfile
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestore.operators import coactivation as co
from lodestore.operators import learning as le
from lodestore.operators import training as tr


def small_net(cards=5, dims=6, layers=2):
    rng = np.random.default_rng(1)
    c = co.Cards(tuple(range(cards)), rng.standard_normal((cards, dims)), rng.random((cards, co.FEATURES)))
    return co.CoActivation(c, width=8, heads=2, layers=layers, inner=12)


def examples(net, n=4, seed=2):
    rng = np.random.default_rng(seed)
    cards, dims = net.cards.centroids.shape
    gold = (rng.random((n, cards)) < 0.4).astype(float)
    frames = [rng.random(co.FRAME).tolist() if i % 3 else None for i in range(n)]
    return pd.DataFrame({"example": range(n), "query_id": range(n), "ce": rng.standard_normal((n, cards)).tolist(), "qvec": rng.standard_normal((n, dims)).tolist(), "frame": frames, "gold_mask": gold.tolist(), "gold_k": gold.sum(axis=1).astype(int)})


def noisy(net, seed=3):
    rng = np.random.default_rng(seed)
    return {k: v + 0.3 * rng.standard_normal(v.shape) for k, v in le.first_weights(net, 5).items()}


@pytest.mark.parametrize("net", [small_net(), le.Mlp(4, 7)], ids=["encoder", "perceptron"])
def test_gradient_by_finite_differences(net):
    if isinstance(net, le.Mlp):
        rng = np.random.default_rng(0)
        pdf = pd.DataFrame({"x": rng.standard_normal((9, 4)).tolist(), "label": rng.integers(0, 2, 9)})
    else:
        pdf = examples(net)
    w = le.flat(noisy(net), net)
    slope = le.flat(net.slopes(le.shaped(w, net), pdf)[1], net)
    rnd = random.Random(1)
    for k in rnd.sample(range(len(w)), min(len(w), 250)):
        step = np.zeros_like(w)
        step[k] = 1e-5
        up, down = (net.slopes(le.shaped(w + s, net), pdf)[0] for s in (step, -step))
        assert abs((up - down) / 2e-5 - slope[k]) < 1e-5 * max(1, abs(slope[k])), k


def naive_forward(net, w, ce, asked):
    """One query, by loops over Python's numbers."""
    n, d, half = len(ce), net.width, net.width // 2
    times = lambda x, m: [sum(x[i] * m[i][j] for i in range(len(x))) for j in range(len(m[0]))]
    plus = lambda a, b: [x + y for x, y in zip(a, b)]
    soft = lambda z: [math.exp(x - max(z)) / sum(math.exp(y - max(z)) for y in z) for x in z]
    sig = lambda x: 1 / (1 + math.exp(-x))

    def norm(x, gain, bias):
        mean = sum(x) / d
        sd = math.sqrt(sum((v - mean) ** 2 for v in x) / d + 1e-5)
        return [(v - mean) / sd * g + b for v, g, b in zip(x, gain, bias)]

    query = plus(times(asked, w["query"]), w["query_bias"])
    tokens = [plus(times([ce[i], *net.cards.centroids[i], *net.cards.features[i]], w["card"]), w["card_bias"]) + query for i in range(n)]
    for k in range(net.layers):
        three = [plus(times(t, w[f"{k}.attend"]), w[f"{k}.attend_bias"]) for t in tokens]
        size = d // net.heads
        out = [[0.0] * d for _ in range(n)]
        for h in range(net.heads):
            at = slice(h * size, (h + 1) * size)
            q, key, v = ([x[part * d : (part + 1) * d][at] for x in three] for part in range(3))
            for i in range(n):
                p = soft([sum(a * b for a, b in zip(q[i], key[j])) / math.sqrt(size) for j in range(n)])
                out[i][at] = [sum(p[j] * v[j][c] for j in range(n)) for c in range(size)]
        tokens = [norm(plus(t, plus(times(o, w[f"{k}.join"]), w[f"{k}.join_bias"])), w[f"{k}.first_gain"], w[f"{k}.first_bias"]) for t, o in zip(tokens, out)]
        wide = [[max(0.0, x) for x in plus(times(t, w[f"{k}.widen"]), w[f"{k}.widen_bias"])] for t in tokens]
        tokens = [norm(plus(t, plus(times(x, w[f"{k}.narrow"]), w[f"{k}.narrow_bias"])), w[f"{k}.second_gain"], w[f"{k}.second_bias"]) for t, x in zip(tokens, wide)]
    inner = lambda a, b: sum(x * y for x, y in zip(a, b))
    refined = [sig(inner(t, w["score_vector"]) + w["score_bias"][0]) for t in tokens]
    a = soft([inner(t, w["pool_vector"]) for t in tokens])
    pooled = [sum(a[i] * tokens[i][c] for i in range(n)) for c in range(d)]
    hidden = [max(0.0, x) for x in plus(times(pooled, w["threshold"]), w["threshold_bias"])]
    assert len(query) == half
    return refined, sig(inner(hidden, w["threshold_vector"]) + w["threshold_last_bias"][0])


def test_encoder_equals_loops(spark):
    net, pdf = small_net(), examples(small_net(), 7)
    w = noisy(net)
    rows = spark.createDataFrame(pdf[["query_id", "ce", "qvec", "frame"]].values.tolist(), "query_id long, ce array<double>, qvec array<double>, frame array<double>").repartition(3)
    table = spark.createDataFrame([(k, list(v.shape), v.ravel().tolist()) for k, v in w.items()], "name string, shape array<int>, value array<double>")
    out = {(r.query_id, r.doc): r for r in co.refined(rows, net, le.read_weights(table, net)).collect()}
    asked = net.asked(pdf)
    for i in range(len(pdf)):
        refined, threshold = naive_forward(net, w, pdf["ce"][i], asked[i])
        for doc, score in enumerate(refined):
            assert abs(out[i, doc].refined - score) < 1e-6 and abs(out[i, doc].threshold - threshold) < 1e-6
    with pytest.raises(ValueError):
        le.read_weights(table.where("name <> 'card'"), net)


def test_chosen_cards(spark):
    rows = [(1, 0, 0.9, 0.5), (1, 1, 0.5, 0.5), (1, 2, 0.4, 0.5), (2, 0, 0.1, 0.5), (2, 1, 0.1, 0.5)]
    s = spark.createDataFrame(rows, "query_id long, doc int, refined double, threshold double")
    assert sorted((r.query_id, r.doc, r.rank) for r in co.chosen(s).collect()) == [(1, 0, 1), (1, 1, 2), (2, 0, 1)]
    assert len(co.chosen(s, 3).collect()) == 5


def test_cards_in_order_and_too_many(spark, monkeypatch):
    rows = [(2, [1.0, 0.0], None), (1, [0.0, 1.0], [0.5] * 8)]
    c = co.cards_of(spark.createDataFrame(rows, "doc int, centroid array<double>, features array<double>"))
    assert c.ids == (1, 2) and c.features.tolist() == [[0.5] * 8, [0.0] * 8]
    monkeypatch.setattr(co, "MOST_CARDS", 1)
    with pytest.raises(ValueError):
        co.cards_of(spark.createDataFrame(rows, "doc int, centroid array<double>, features array<double>"))


def pairs(spark, n=600):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((n, 4))
    y = (x[:, 0] - x[:, 1] > 0).astype(int)
    return spark.createDataFrame([(i, "hard" if i % 3 == 0 else "pair", i % 7 == 0, x[i].tolist(), int(y[i])) for i in range(n)], "example long, kind string, held boolean, x array<double>, label int")


PHASES = [le.Phase("one", {"pair": 1.0}, 3, 3e-2), le.Phase("two", {"hard": 1.0, "pair": 0.5}, 2, 1e-2)]


def test_loss_falls_and_a_restart_gives_the_same_weights(spark):
    rows, net = pairs(spark), le.Mlp(4, 8)
    a = le.fitted(rows.repartition(5), net, PHASES, tempfile.mkdtemp(), steps=3, rows=100)
    path = tempfile.mkdtemp()
    for until in (1, 3, 4):  # dies thrice, in a phase and between two
        le.fitted(rows.repartition(2), net, PHASES, path, steps=3, rows=100, until=until)
    b = le.fitted(rows, net, PHASES, path, steps=3, rows=100)
    assert (a.best == b.best).all() and a.history == b.history  # bit by bit, however rows are dealt
    assert [h[1] for h in a.history] == ["one"] * 3 + ["two"] * 2
    assert a.history[0][3] > a.history[2][3] and a.history[-1][4] < 0.8 * a.history[0][4]
    assert a.history[0][2] == sum(1 for i in range(600) if i % 3 and i % 7)  # held-out examples are not learned


def test_a_phase_ends_when_it_gets_no_better_and_keeps_its_best(spark):
    rows = pairs(spark, 60).withColumn("label", F.when(F.col("held"), 1 - F.col("label")).otherwise(F.col("label")))  # held-out ones say the opposite
    s = le.fitted(rows, le.Mlp(4, 8), [le.Phase("one", {"pair": 1.0, "hard": 1.0}, 30, 0.1)], tempfile.mkdtemp(), steps=1, patience=2)
    held = [h[4] for h in s.history]
    assert len(held) < 30 and held.index(min(held)) == len(held) - 3


def test_a_phase_without_examples_and_examples_without_ids(spark):
    s = le.fitted(pairs(spark, 30).where("kind = 'pair'"), le.Mlp(4, 3), [le.Phase("none", {"hard": 1.0}, 3), le.Phase("one", {"pair": 1.0}, 1)], tempfile.mkdtemp(), steps=2)
    assert [h[1] for h in s.history] == ["none", "one"]
    with pytest.raises(ValueError):
        le.fitted(pairs(spark, 5).withColumn("example", F.lit(None).cast("long")), le.Mlp(4, 3), PHASES, tempfile.mkdtemp())


def test_many_shards_give_the_same_sums(spark, monkeypatch):
    monkeypatch.setattr(le, "SUMS", 3)
    net, rows = le.Mlp(4, 8), pairs(spark)
    w = le.flat(le.first_weights(net, 1), net)
    n, loss, slope = le.summed_slopes(*(lambda d: (d[0], net, w, d[1]))(le.dealt(rows, 50)))
    whole = net.slopes(le.shaped(w, net), rows.toPandas())
    assert n == 600 and abs(loss - whole[0]) < 1e-8 and np.allclose(slope, le.flat(whole[1], net))


def test_weighted_draws_by_loops(spark):
    import hashlib

    rnd = random.Random(3)
    rows = [(k, f"{k}{i}", rnd.choice([0, 1, 1, 2, 50])) for k in ("a", "b") for i in range(40)] + [("a", "a1", 3), ("c", "c", 0)]
    out = tr.weighted_draws(spark.createDataFrame(rows, "kind string, key string, weight long"), spark.createDataFrame([(k, i) for k in "abcd" for i in range(3000)], "kind string, draw long"), seed=9)
    got = {(r.kind, r.draw): r.key for r in out.collect()}
    assert {k for k, _ in got} == {"a", "b"} and len(got) == 6000
    for kind in "ab":
        line = [key for k, key, w in sorted(rows, key=lambda r: (hashlib.md5(r[1].encode()).hexdigest(), r[1])) if k == kind for _ in range(w)]
        points = [int(hashlib.md5(f"{kind}-{i}-9".encode()).hexdigest()[:15], 16) % len(line) for i in range(3000)]
        assert [got[kind, i] for i in range(3000)] == [line[p] for p in points]
    heavy = Counter(got.values()).most_common(1)[0][0]
    assert max(w for k, key, w in rows if key == heavy) == 50


def test_sweep_goes_on_where_it_stopped(spark):
    path, fits = tempfile.mkdtemp(), []

    def fit(c):
        if c["a"] == 3 and len(fits) < 3:
            fits.append("dies")
            raise OSError("lost")
        fits.append(c["a"])
        return 0.1 * c["a"], 1.0

    many = [{"a": 1, "b": "x"}, {"b": "x", "a": 2}, {"a": 3, "b": "x"}]
    with pytest.raises(OSError):
        tr.swept(spark, many, fit, path)
    out = tr.swept(spark, many, fit, path)
    assert fits == [1, 2, "dies", 3]
    assert sorted((r.metric, r.round) for r in out.collect()) == [(0.1, 1), (0.2, 2), (pytest.approx(0.3), 3)]
    assert tr.swept(spark, many[:1], fit, path).count() == 1 and fits[-1] == 3
    with pytest.raises(ValueError):
        tr.swept(spark, [*many, {"b": "x", "a": 1}], fit, path)  # the same parameters in another order
    new = tr.upserted(out, spark.createDataFrame([(tr.candidate_key(many[0]), 0.9, 1.0, 4)], tr.RESULTS))
    assert sorted(round(r.metric, 6) for r in new.collect()) == [0.2, 0.3, 0.9]


def test_selector_phases():
    from lodestore.plans.learning import selector_phases

    p = selector_phases({"positive": 100, "easy": 50, "hard": 20, "adversarial": 5})
    assert [x.name for x in p] == ["warm start", "hard negatives", "adversarial"]
    assert p[1].shares == {"hard": 1.0, "positive": 0.2} and p[2].shares == {"adversarial": 1.0, "hard": 0.25}
    assert [x.name for x in selector_phases({"positive": 1})] == ["warm start"]
