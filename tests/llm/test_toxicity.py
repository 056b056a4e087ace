import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestore.llm import toxicity


def labelled(spark, prose, n=400):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = prose(i, 40).split()
        bad = i % 5 == 0
        if bad:
            for w in rnd.sample(["blarg", "snorf", "quux", "zonkmoo", "zonkbee"], 2):
                words.insert(rnd.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, prose):
    docs, labels = labelled(spark, prose)
    out = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    held = [i for i in out if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in out.items() if r.held_out} == set(held)
    assert np.mean([out[i].predicted == (i % 5 == 0) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())


def test_held_out_labels_are_not_learned(spark, prose):
    docs, labels = labelled(spark, prose)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(toxicity.score_documents(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_votes_equal_units(prose):
    voters = toxicity.Voters(("kori", "kori-", "tum", "bako-"))
    for t in [*map(prose, range(50)), "", None, "KORITUM tum!! what?? kori", "you f**k s#@t you d%%n", "a*b #c"] * 2:  # twice: words are remembered
        own = {voters.at[u] for u in toxicity.units(t or "") if u in voters.at}
        own |= {4 + k for k, (_, p, least) in enumerate(toxicity.PATTERNS) if len(p.findall(t or "")) >= least}
        assert voters.votes(t) == sorted(own)


def planted(n=3000, seed=1):
    """Votes of four good voters, one of them doubled with faults, and ten copies of a voter that knows nothing."""
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(float)
    good = (rng.random((n, 4)) < np.where(y[:, None] > 0, 0.7, 0.1)).astype(float)
    double = np.where(rng.random(n) < 0.1, 1 - good[:, 0], good[:, 0])
    noise = (rng.random(n) < 0.3).astype(float)
    return y, np.hstack([good, double[:, None], np.repeat(noise[:, None], 10, axis=1)]), rng


def as_rows(spark, v):
    return spark.createDataFrame([([int(k) for k in np.flatnonzero(r)],) for r in v], "v array<int>").repartition(5)


def test_sums_equal_brute_force(spark):
    y, v, _ = planted(500)
    rows, ones = np.array([(1 - y).sum(), y.sum()]), np.stack([(1 - y) @ v, y @ v])
    for parent in (np.full(15, -1), np.array([-1, 0, 1, 1, 0, *[-1] * 10])):
        model = toxicity.maximised(rows, ones, np.stack([(v * w[:, None]).T @ v for w in (1 - y, y)]), parent, (np.zeros(2), np.zeros((2, 15))))
        z = []
        for r in v:  # row by row
            side = [math.log(1 - model.prior), math.log(model.prior)]
            for c in range(2):
                for j, x in enumerate(r):
                    p = model.rate[c, j] if parent[j] < 0 else model.given[c, int(r[parent[j]]), j]
                    side[c] += math.log(p if x else 1 - p)
            z.append(side[1] - side[0])
        assert np.allclose(model.logit(v), z)
        q = 1 / (1 + np.exp(-np.array(z)))
        mass, one, both = toxicity.unpacked(toxicity.sums(as_rows(spark, v), 15, model.expected, 2 * 241), 15)
        assert np.allclose(mass, [(1 - q).sum(), q.sum()]) and np.allclose(one[1], q @ v) and np.allclose(both[0], (v * (1 - q)[:, None]).T @ v)


def test_label_model_learns_accuracies_and_correlations(spark):
    """Labels of 150 of 3000 rows, a tenth of them wrong: rates come near the true ones, copies hang together, wrong labels are overruled."""
    y, v, rng = planted()
    wrong = rng.random(150) < 0.1
    given = np.where(wrong, 1 - y[:150], y[:150])
    model = toxicity.label_model(as_rows(spark, v), v[:150], given)
    assert np.abs(model.rate[:, :4] - [[0.1] * 4, [0.7] * 4]).max() < 0.08
    assert (model.parent[5:] >= 5).sum() == 9 and model.parent[4] == 0 or model.parent[0] == 4
    alone = toxicity.label_model(as_rows(spark, v), v[:150], given, linked=9.0)
    right = lambda m: ((m.logit(v) > 0) == (y > 0)).mean()
    assert right(model) > 0.85 and right(model) >= right(alone)
    overruled = (model.posterior(v[:150]) > 0.5) != (given > 0)
    assert overruled[wrong].mean() > 0.6 > 0.2 > overruled[~wrong].mean()


def test_classifier_learns_from_posteriors_of_unlabelled_rows(spark, prose):
    """A word that only unlabelled documents show beside known voters gets no vote; all documents, labelled or not, have a posterior."""
    docs, labels = labelled(spark, prose)
    some = labels.where("doc_id < 150")
    out = toxicity.score_documents(docs, some).collect()
    assert len(out) == 400 and all(r.posterior is not None for r in out)
    late = [r for r in out if r.doc_id >= 150]
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in late]) > 0.95
    assert np.mean([(r.posterior >= 0.5) == r.predicted for r in out]) > 0.97


def test_edges(spark, edge, empty, prose):
    docs, labels = labelled(spark, prose, 100)
    none = labels.limit(0)
    out = toxicity.score_documents(edge, none).collect()
    assert len(out) == edge.count() and {r.predicted for r in out} == {0}
    assert toxicity.score_documents(empty, labels).count() == 0
    odd = labels.union(spark.createDataFrame([(None, 1, 1), (1, None, None), (0, 0, 0)], "doc_id long, quality int, toxic int"))
    assert toxicity.score_documents(docs, odd).count() == 100
    kept = toxicity.without_toxic(edge, labels)
    assert kept.columns == edge.columns and sorted(map(str, kept.collect())) == sorted(map(str, edge.collect()))
    odd = edge.withColumnRenamed("blob", "row").withColumnRenamed("h1", "v").withColumn("_toxicity", F.lit(1)).withColumn("a.b", F.lit(2))
    assert toxicity.without_toxic(odd, labels).columns == odd.columns
