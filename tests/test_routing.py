"""Rooms by hand; k-means and its stability against loops."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestore.functions import unit
from lodestore.operators import atlas, ignore, routing

ROOMS = ("tech_stack", "family", "general")


def test_rooms_of_answers():
    room = lambda a: routing.room_of(a, ROOMS)
    assert [room(a) for a in ("Family.", "TECH_STACK", "tech", "stack_of", "", None, "nothing", "fam life")] == ["family", "tech_stack", "tech_stack", "tech_stack", "general", "general", "general", "family"]
    rooms = lambda a: routing.rooms_of(a, ROOMS)
    assert rooms("family, tech_stack") == ["tech_stack", "family"] and rooms("family general tech_stack") == ["tech_stack", "family"]
    assert rooms("fam,gen") == ["family", "general"] and rooms("xyz") == list(ROOMS) == rooms(None)
    assert [routing.picked(a, 3) for a in ("2", "no. 3!", "4", "0", "two", None, "a1")] == [2, 3, None, None, None, None, None]


def test_routed_search(spark):
    vec = lambda x: [float(np.cos(x)), float(np.sin(x))]
    sessions = spark.createDataFrame([(i, ["tech talk", "family talk", "??"][i % 3] + f" {i}", vec(i / 10)) for i in range(12)], "session_id long, text string, vec array<double>")
    known = spark.createDataFrame([(0, "family")], "session_id long, room string")
    asked = []

    def model(prompts):
        asked.extend(prompts)
        if any("Which of the following" in p for p in prompts):
            return ["2" for _ in prompts]
        return [p.rsplit(":", 1)[1].strip().split()[0] for p in prompts]

    path = tempfile.mkdtemp()
    rooms = routing.assigned_rooms(sessions, known, ROOMS, model, f"{path}/a")
    got = {r.session_id: r.room for r in rooms.collect()}
    assert got == {i: "family" if i == 0 or i % 3 == 1 else "tech_stack" if i % 3 == 0 else "general" for i in range(12)}
    q = spark.createDataFrame([(1, "family plans", vec(0.0)), (2, "who knows", vec(0.0))], "query_id long, question string, qvec array<double>")
    routes = routing.routed(q, ROOMS, model, f"{path}/b")
    found = routing.searched_rooms(q, routes, sessions.select("session_id", "vec").join(rooms, "session_id"), 4)
    hits = {k: [r.session_id for r in sorted(found.where(F.col("query_id") == k).collect(), key=lambda r: r.near)] for k in (1, 2)}
    assert hits == {1: [0, 1, 4, 7], 2: [0, 1, 2, 3]}  # question 2 is sent everywhere
    all_ = found.withColumnRenamed("near", "rank").join(q.select("query_id", "question"), "query_id").join(sessions.select("session_id", "text"), "session_id")
    out = routing.repicked(all_, model, f"{path}/c")
    assert [r.session_id for r in out.where("query_id = 1").orderBy("rank").collect()] == [1, 0, 4, 7]
    one = routing.repicked(all_.where("rank = 1"), model, f"{path}/d")
    assert sorted((r.query_id, r.session_id, r.rank) for r in one.collect()) == [(1, 0, 1), (2, 0, 1)]


def loops(x, k, seed, drawn):
    """Lloyd steps in one place, from the same start."""
    now = atlas.spread_out(drawn, k, seed)
    for step in range(200):
        label = np.argsort(-np.round(x @ now.T, 6), axis=1, kind="stable")[:, 0]
        new = drawn[np.random.default_rng([seed, step]).integers(len(drawn), size=len(now))]
        for c in range(len(now)):
            if (label == c).any() and (size := np.linalg.norm(x[label == c].mean(axis=0))) > 0:
                new[c] = x[label == c].mean(axis=0) / size
        shift, now = np.linalg.norm(new - now, axis=1).max(), new
        if shift < 1e-4:
            break
    return np.argsort(-np.round(x @ now.T, 6), axis=1, kind="stable")[:, 0]


def index(a, b):
    choose = lambda n: n * (n - 1) / 2
    pairs = sum(choose(np.count_nonzero((a == i) & (b == j))) for i in set(a.tolist()) for j in set(b.tolist()))
    rows, columns = (sum(choose(np.count_nonzero(v == i)) for i in set(v.tolist())) for v in (a, b))
    due = rows * columns / choose(len(a))
    return ((pairs - due) / ((rows + columns) / 2 - due) + 1) / 2


def test_clusterings_to_the_end_equal_loops(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), unit("embedding").alias("vec")).cache()
    rows = sorted(v.collect())
    x, ids = np.array([r.vec for r in rows]), [r.id for r in rows]
    labels = []
    for seed in (0, 1, 2):
        drawn = np.array([r.vec for r in v.orderBy(F.xxhash64(F.lit(seed), "id"), "id").collect()])
        labels.append(loops(x, 10, seed, drawn))
    path = tempfile.mkdtemp()
    atlas.spherical_kmeans(v, 10, 0, rounds=2, path=f"{path}/seed-0")  # dies after two rounds
    centroids, stable = atlas.stable_atlas(v, 10, path=path)
    got = {r.id: r.anchor_id for r in atlas.nearest(v, centroids).collect()}
    assert [got[i] for i in ids] == labels[0].tolist()
    want = np.mean([round(index(labels[i], labels[j]), 6) for i, j in ((0, 1), (0, 2), (1, 2))])
    r = stable.first()
    assert r.stability == pytest.approx(want, abs=1e-5) and r.accepted == (want >= 0.6)
    v.unpersist()


def test_prose_first(spark):
    files = [("a", f"x/{i}.md") for i in range(2)] + [("a", "x/b.py"), ("a", "dist/c.md"), ("a", "z.jsonl")]
    files += [("b", f"{i:02}.txt") for i in range(12)] + [("b", "a.py")] + [("c", "a.md"), ("c", "b.RST"), ("c", "c.csv"), ("c", "a.py")]
    out = ignore.prose_first(spark.createDataFrame(files, "project string, file string").repartition(3)).collect()
    got = {p: [r.file for r in sorted(out, key=lambda r: r.rank) if r.project == p] for p in "abc"}
    assert got == {"a": ["x/0.md", "x/1.md", "x/b.py"], "b": [f"{i:02}.txt" for i in range(10)], "c": ["a.md", "b.RST", "c.csv"]}


def test_emitted_labels(spark):
    from lodestore.operators import evaluation

    rows = [("a", 0.1, [3, 1, 3], [1, 9]), ("b", 0.9, [2, 1], [7]), ("c", 0.1, [2], None), ("d", 0.5, [5, 4, 5], []), ("e", 0.4, [1], None), ("f", 0.9, None, None)]
    out = evaluation.emitted_labels(spark.createDataFrame(rows, "question string, f1 double, selected array<int>, gold array<int>"))
    assert {r.question: r.winning for r in out.collect()} == {"a": [1], "b": [], "c": [], "d": [4, 5], "f": []}
    assert {r.label_id for r in out.where("question = 'a'").collect()} == {"q_0cc175b9"}


def test_memories_of_sessions(spark):
    from lodestore.operators import store

    paths = [(1, "/a/session1/x"), (2, "/a/session12/x"), (3, None), (4, "/b/other"), (5, "")]
    sources = spark.createDataFrame(paths, "source_id long, source_path string").repartition(3)
    memories = spark.createDataFrame([(f"m{i}", [i, 1]) for i, _ in paths], "memory_object_id string, source_ids array<long>")
    names = ["session1", "session12", "n1/x", "", "none", None, "session1"]
    found = lambda most: {(r.session, r.memory_object_id) for r in store.from_sessions(memories, sources, spark.createDataFrame([(n,) for n in names], "session string"), most).collect()}
    want = {(n, f"m{i}") for n in names if n is not None for i, _ in paths for s in (i, 1) if (p := dict(paths)[s]) is not None and n in p}
    assert found(4096) == found(2) == want
    assert store.from_sessions(memories, sources, spark.createDataFrame([], "session string")).count() == 0


def test_clusterings_share_their_passes(spark):
    """F1: a round is one job for all seeds, whatever their number; ties go to the first centroid, as they do in double precision."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = np.concatenate([x[:20], x[:20], x[:20] + 1e-8])
    assert atlas.closest(x, c).tolist() == np.argsort(-np.round(x @ c.T, 6), axis=1, kind="stable")[:, 0].tolist()
    v = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "id long, vec array<double>").cache()
    loops_of = []
    for seed in (0, 1, 2):
        drawn = np.array([r.vec for r in v.orderBy(F.xxhash64(F.lit(seed), "id"), "id").collect()])
        loops_of.append(loops(x, 9, seed, drawn))
    sc, path = spark.sparkContext, tempfile.mkdtemp()
    sc.setJobGroup("clusterings", "")
    atlas.stable_atlas(v, 9, path=path)
    sc.setLocalProperty("spark.jobGroup.id", None)
    rounds = [int(max(os.listdir(f"{path}/seed-{s}")).rpartition("-")[2]) for s in (0, 1, 2)]
    assert len(sc.statusTracker().getJobIdsForGroup("clusterings")) < 2 * max(rounds) + 40 and sum(rounds) > 20
    centroids = atlas.spherical_kmeans(v, 9, 1)
    got = {r.id: r.anchor_id for r in atlas.nearest(v, centroids).collect()}
    assert [got[i] for i in range(300)] == loops_of[1].tolist()
    v.unpersist()
