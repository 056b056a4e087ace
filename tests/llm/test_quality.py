import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestore.llm import quality as q


def spoiled(words, rnd):
    """A text of bad shape in one of four ways."""
    kind = rnd.randrange(4)
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 1:
        return " | ".join(words)
    if kind == 2:
        return " ".join(w + rnd.choice(["***", "%%%", "$$$"]) for w in words)
    return " ".join(w for w in words[:4] for _ in range(10))


def corpus(spark, prose, n=1500, bad=0.2):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        text, good = prose(i, rnd.randint(10, 60)), rnd.random() >= bad
        rows.append((i, text if good else spoiled(text.split(), rnd)))
        if i % 2:
            labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((i, y) for i, y, _ in labels)


def test_held_out_accuracy(spark, prose):
    docs, labels, y = corpus(spark, prose)
    out = {r.doc_id: r for r in q.score_documents(docs, labels).collect()}
    held = [i for i in out if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in out.items() if r.held_out} == set(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())
    assert np.mean([out[i].predicted == y[i] for i in held if i in y]) > 0.95


def test_neither_held_out_labels_nor_bad_ones_are_learned(spark, prose):
    docs, labels, _ = corpus(spark, prose, n=300)
    flipped = labels.withColumn("quality", F.when(q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    without = labels.where("quality = 1 or doc_id % 7 = 3")
    a, b, c = (sorted(tuple(r) for r in q.score_documents(docs, x).collect()) for x in (labels, flipped, without))
    assert a == b == c


def some(n_u=4000, n_p=800, prior=0.7, seed=1, apart=2.0):
    """Measures of unlabelled rows, of positives, and which unlabelled ones are good."""
    rng = np.random.default_rng(seed)
    good = rng.random(n_u) < prior
    draw = lambda y: np.clip(512 + 100 * (rng.standard_normal((len(y), len(q.MEASURES))) + np.where(y, 0, apart)[:, None] * (np.arange(len(q.MEASURES)) < 3)), 0, 1023).astype(np.uint16)
    return draw(good), draw(np.ones(n_p, dtype=bool)), good


def test_prior_of_a_mixture():
    for prior in (0.3, 0.7, 0.9):
        u, p, _ = some(20_000, 8000, prior)
        e = q.edges(q.histogram(u))
        ranking = q.Model(e, q.minimised(u, p[::2], e, 0.5, q.FIRST))
        assert abs(q.best_bin(ranking.seen(u), ranking.seen(p[1::2])) - prior) < 0.05


def test_losses_and_their_slopes():
    u, _, _ = some(200)
    e = q.edges(q.histogram(u))
    at, size = q.binned(u, e), len(q.MEASURES) * q.BINS + 1
    rng = np.random.default_rng(3)
    w = rng.standard_normal(size) * 0.1
    whole = q.losses(at, w)
    x = np.zeros((len(at), size))
    x[np.arange(len(at))[:, None], at], x[:, -1] = 1, 1
    z = x @ w
    assert np.allclose(whole[:3], [len(at), np.log1p(np.exp(-z)).sum(), np.log1p(np.exp(z)).sum()])
    p = 1 / (1 + np.exp(-z))
    assert np.allclose(whole[3 : 3 + size], x.T @ p)
    assert np.allclose(whole[3 + size :].reshape(size, size), (x * (p * (1 - p))[:, None]).T @ x)
    for k in (0, 17, size - 1):  # finite differences
        up, down = (q.losses(at, w + s * np.eye(size)[k])[2] for s in (1e-5, -1e-5))
        assert abs((up - down) / 2e-5 - whole[3 + k]) < 1e-4


def plain_risk(u, p, w, prior):
    z_u, z_p = q.logits(u, w), q.logits(p, w)
    loss = lambda z: np.logaddexp(0, z).mean()
    return prior * loss(-z_p) + max(0.0, loss(z_u) - prior * loss(z_p)), loss(z_u) - prior * loss(z_p)


def test_minimum_of_the_risk_by_plain_descent():
    u, p, good = some(3000, 1500)
    e = q.edges(q.histogram(u))
    prior, pay = 0.7, 320 / len(p)
    w = q.minimised(u, p, e, prior, (320,))
    at_u, at_p = q.binned(u, e), q.binned(p, e)
    whole = lambda at, weight, v: np.bincount(np.hstack([at, np.full((len(at), 1), len(v) - 1)]).ravel(), np.repeat(weight, at.shape[1] + 1), minlength=len(v)) / len(at)
    penalised = lambda w: plain_risk(at_u, at_p, w, prior)[0] + pay / 2 * (w[:-1] ** 2).sum()
    v = np.zeros_like(w)
    for _ in range(3000):
        v = v - 0.3 * (whole(at_u, q.sigmoid(q.logits(at_u, v)), v) - prior * whole(at_p, np.ones(len(p)), v) + np.append(pay * v[:-1], 0))
    assert plain_risk(at_u, at_p, w, prior)[1] >= 0
    assert abs(penalised(w) - penalised(v)) < 1e-3
    assert np.corrcoef(q.logits(at_u, w), good)[0, 1] > 0.7


def test_risk_of_bad_text_is_never_negative():
    """Few positives, a prior that is too high: the unpenalised minimum follows chance, its risk of bad text is negative, and it isn't taken."""
    for n_p, prior in ((1500, 0.7), (30, 0.95), (12, 0.99)):
        u, p, _ = some(1500, n_p, 0.3)
        e = q.edges(q.histogram(u))
        at_u, at_p = q.binned(u, e), q.binned(p, e)
        assert plain_risk(at_u, at_p, q.minimised(u, p, e, prior), prior)[1] >= 0


def test_step_back_raises_the_risk_of_bad_text():
    u, p, _ = some(1500, 30, 0.3)
    e = q.edges(q.histogram(u))
    at_u, at_p = q.binned(u, e), q.binned(p, e)
    size = len(q.MEASURES) * q.BINS + 1
    w = np.zeros(size)
    w[np.unique(at_p)], w[-1] = 2.0, -25.0
    before = plain_risk(at_u, at_p, w, 0.95)[1]
    assert before < 0
    a, b = (x[1:] / x[0] for x in (q.losses(at_u, w), q.losses(at_p, w)))
    risk = q.Risk(b[0], b[1], a[1], b[2 : 2 + size], np.zeros(size), a[2 : 2 + size], a[2 + size :].reshape(size, size))
    assert abs(risk.negative(0.95) - before) < 1e-9
    move = q.step_back(risk, 0.95, np.full(size, 0.1))
    assert plain_risk(at_u, at_p, w + 0.01 * move, 0.95)[1] > before


def test_monotone_shares():
    rng = np.random.default_rng(4)
    v, w = rng.random(40) + np.arange(40) / 40, rng.random(40) + 0.1
    out = q.monotone(v, w)
    assert (np.diff(out) >= -1e-12).all() and abs((out * w).sum() - (v * w).sum()) < 1e-9
    for k in range(40):  # the minimax formula
        assert abs(out[k] - max(min((v[i : j + 1] * w[i : j + 1]).sum() / w[i : j + 1].sum() for j in range(k, 40)) for i in range(k + 1))) < 1e-9


def test_edges_are_quantiles():
    rng = np.random.default_rng(0)
    m = rng.integers(0, 1024, (999, len(q.MEASURES))).astype(np.uint16)
    e = q.edges(q.histogram(m))
    for k, share in enumerate(q.QUANTILES):
        assert e[4, k] == np.sort(m[:, 4])[int(np.ceil(share * 999)) - 1]
    at = q.binned(m, e)
    assert all(at[i, 2] == 2 * q.BINS + sum(m[i, 2] > x for x in e[2]) for i in range(50))


@pytest.mark.parametrize("text", ["", None, " \n\t ", "x", "É" * 1000, "A!! | b***\nA!! | b***\n", "\x00" * 5])
def test_measures_of_odd_texts(text):
    found = q.measures(text)
    assert len(found) == len(q.MEASURES) and all(0 <= x < q.STEPS for x in found)


def test_measures_by_hand():
    m = dict(zip(q.MEASURES, q.measures("The the cat!\nThe the cat!\nx | y")))
    n = len("The the cat!\nThe the cat!\nx | y")
    step = lambda x: min(q.STEPS - 1, int(x * q.STEPS))
    assert m["upper"] == step(2 / n) and m["bar"] == step(1 / n) and m["line"] == step(2 / n)
    assert m["distinct words"] == step(6 / 9) and m["commonest word"] == step(2 / 9) and m["repeated word"] == 0
    assert m["repeated lines"] == step(1 / 3) and m["full lines"] == step(2 / 3) and m["marked words"] == step(3 / 9)


def test_edges_of_tables(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, None), (4, 0, 1), (None, 1, 1), (6, None, 0), (99, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    out = q.score_documents(edge, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == edge.count()
    assert all(r.score is not None and r.held_out is not None for r in out.collect())
    assert q.score_documents(empty, labels).collect() == []
    assert {r.score for r in q.score_documents(edge, labels.where("false")).collect()} == {0.5}
