import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestore.llm import simhash


def brute_fingerprint(text):
    data = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0d]+", data)
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aBcÉ \n\t\x0b-", max_size=60))
def test_fingerprint_equals_brute_force(text):
    assert simhash.fingerprint(text) % (1 << 64) == brute_fingerprint(text)


def test_spark_hash_agrees(spark):
    assert spark.sql("select xxhash64('a b c d') h").first().h % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_components_equal_brute_force(spark, prose):
    rows = []
    for i in range(60):
        text = prose(i % 20, 150)
        if i % 3:
            text = text.replace(" ", "  ", i) if i % 2 else " ".join(w if k != i else "other" for k, w in enumerate(text.split()))
        rows.append((i + 100, text))
    rows += [(7, ""), (3, None), (9, "  ")]
    out = {r.doc_id: r for r in simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    rows.sort()
    fps = [brute_fingerprint(t) for _, t in rows]
    want = brute_components(fps)
    assert len(out) == len(rows)
    for (i, _), fp, c in zip(rows, fps, want):
        assert out[i].fingerprint == f"{fp:016x}" and out[i].component_id == rows[c][0]
    assert len({r.component_id for r in out.values()}) < len(rows)


def test_large_tiles_equal_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    fps = np.unique(np.concatenate([base, near, near ^ np.uint64(3)]))
    u, v = simhash.tile_links(fps, None, 4)
    groups = len(set(brute_components([int(x) for x in fps])))
    assert len(fps) - len(u) == groups and (np.bitwise_count(u ^ v) >= 1).all()


def test_edges(edge, empty):
    out = simhash.simhash_components(edge).collect()
    assert len(out) == edge.count()
    zero = [r for r in out if r.fingerprint == "0" * 16]
    assert {r.component_id for r in zero} == {2} and len(zero) == 4
    assert sorted(r.component_id for r in out if r.doc_id == 7) == [1, 1]
    assert simhash.simhash_components(empty).count() == 0


def spoiled(text, at):
    w = text.split()
    for k in at:
        w[k] = "other" + w[k]
    return " ".join(w)


def near_corpus(prose):
    rows = [(i, prose(i, 150)) for i in range(30)]
    rows += [(1000 + 10 * i + k, spoiled(prose(i, 150), range(5 + k, 5 + k + 20 * k, 20))) for i in range(10) for k in range(1, 5)]
    return rows + [(5000, ""), (5001, None), (5002, "one word"), (5003, "one word")]


def near_kept(rows):
    """Smallest id of each component of the pairs of Jaccard >= 0.8."""
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and (not sets[i] | sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return {rows[k][0] for k in set(label)}


def test_near_copies_beyond_four_bits_go(spark, prose):
    rows = sorted(near_corpus(prose), key=lambda r: r[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_kept(rows)
    assert {r.doc_id for r in simhash.near_dedup(docs).collect()} == want
    four = {r.component_id for r in simhash.simhash_components(docs).collect()}
    assert four - want  # near copies that 4 bits leave


def test_large_group_of_near_copies(spark, prose, monkeypatch):
    monkeypatch.setattr(simhash, "MANY", 1)
    base = prose(1, 200)
    rows = [(i, spoiled(base, [i])) for i in range(120)] + [(500 + i, prose(i + 50, 150)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.near_dedup(docs).collect()} == near_kept(rows)


def test_near_dedup_edges(edge, empty):
    assert simhash.near_dedup(empty).count() == 0
    kept = simhash.near_dedup(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 5, 6, 8]


def test_unlike_texts_of_one_id_are_all_kept(spark, prose):
    rows = [(1, prose(1, 80), "a"), (1, prose(2, 80), "b"), (2, prose(3, 80), "c"), (3, prose(2, 80), "d"), (1, prose(1, 80), "a"), (None, prose(1, 80), "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th string").repartition(4)
    kept = sorted((r.doc_id or 0, r.th) for r in simhash.near_dedup(docs).collect())
    assert kept == [(0, "e"), (1, "a"), (1, "b"), (2, "c")]


def test_tiles_have_a_bound_of_their_own(monkeypatch):
    first, slices, meets = simhash.count_tiles({30: 100_000, 32: 50_000}, 16_384, 20)
    assert slices[30] == 7 and slices[32] == 4 and meets[0] == (0, 10)


def test_small_tiles_find_the_same(spark, prose, monkeypatch):
    monkeypatch.setattr(simhash, "NEAR_MOST", 7)
    rows = sorted(near_corpus(prose), key=lambda r: r[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.near_dedup(docs).collect()} == near_kept(rows)


def test_alike_is_the_jaccard_of_texts(prose):
    texts = [prose(1, 60), spoiled(prose(1, 60), [5]), spoiled(prose(1, 60), [5, 20]), spoiled(prose(1, 60), [0]), prose(1, 50), "", "one two", None, prose(2, 60)]
    sets = [np.unique(simhash.shingle_hashes(t)) for t in texts]
    for x, s in zip(texts, sets):
        for y, t in zip(texts, sets):
            assert simhash.alike(s, t) == (simhash.jaccard(x, y) >= 0.8)


def test_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[k // 4 :], rng.integers(0, 2**63, k % 7, dtype=np.uint64)])) for k in range(60)]
    tile = np.zeros(60, dtype=simhash.TILE)
    tile["node"] = tile["label"] = np.arange(60)
    links = simhash.forest_of_links(tile, None, sets, sets)
    group = list(range(60))
    for i in range(60):
        for j in range(i):
            if simhash.alike(sets[i], sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    got = list(range(60))
    for i, j in links:
        got = [got[j] if g == got[i] else g for g in got]
    assert len(links) == 60 - len(set(group)) and len({(a, b) for a, b in zip(group, got)}) == len(set(group)) == len(set(got))
