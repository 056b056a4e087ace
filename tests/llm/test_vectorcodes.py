import hashlib
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lodestore.llm import vectorcodes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int, part long"


def naive(rows):
    """The contract's codes of rows (vec_id, embedding, label), by loops over Python's integers."""
    own = [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    length = max(1, -(-max(len(v) for _, v, _ in own) // 16))
    cut = lambda v: [[math.floor(256 * x) for x in ([*v] + [0.0] * (16 * length))[p * length : (p + 1) * length]] for p in range(16)]
    parts = [cut(v) for _, v, _ in own]
    first = sorted((i, v, k) for k, (i, v, _) in enumerate(own) if i is not None)[:64]
    books = [[parts[k][p] for *_, k in first] for p in range(16)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min((away(part, e), j) for j, e in enumerate(books[p])) for p, part in enumerate(v)] for v in parts]

    for _ in range(2):
        found = assign()
        for p in range(16):
            for j in range(len(books[p])):
                mine = [v[p] for v, f in zip(parts, found) if f[p][1] == j]
                if mine:
                    books[p][j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = assign()
    error = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, y), e in zip(own, error):
        by_label[y] = by_label.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return [(i, "".join(f"{j:02x}" for _, j in f), e, by_label[y], digest) for (i, _, y), f, e in zip(own, found, error)]


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1, 2) for i, v, y in rows], SCHEMA)


def singles(rows):
    """Components as the table holds them."""
    return [(i, v and [x if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]


def test_transform_is_the_hadamard_matrix_by_sign_changes():
    for h in (1, 2, 4, 8, 16, 32):
        m = vc.walsh(np.eye(h, dtype=np.int64)).T
        assert [(np.diff(r) != 0).sum() for r in m] == list(range(h))
        assert (m @ m.T == h * np.eye(h)).all()


@pytest.mark.parametrize(("length", "most"), [(1, 3), (3, 4), (4, 50), (8, 2**40)])
def test_nearest_entry_is_the_least_of_equals(length, most):
    rnd = random.Random(length)
    h = 1 << (length - 1).bit_length()
    kind = object if most > 2**30 else np.int64
    pad = lambda n: np.array([[rnd.randint(-most, most) if k < length else 0 for k in range(h)] for _ in range(n)], dtype=kind)
    x, entries = pad(300), pad(20)
    entries[7] = entries[3]
    index, far = vc.nearest(vc.walsh(x), vc.walsh(entries))
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, e)), j) for j, e in enumerate(entries)) for r in x]
    assert [(f // h, j) for f, j in zip(far.tolist(), index.tolist())] == want
    assert all(f % h == 0 for f in far.tolist())


def test_equals_loops(spark):
    rnd = random.Random(3)
    near = lambda c: [round(c + rnd.gauss(0, 0.2), 1) for _ in range(48)]  # noqa: E731  many ties, length 3
    rows = [(k, near(k % 5), k % 3) for k in range(150)] + [(9, near(2), None)] * 3 + [(None, near(1), 1), (151, None, 1), (152, [None] * 48, 1), (153, [math.nan] + [0.0] * 47, 1), (154, [math.inf] * 48, 1), (155, near(0)[:20], None), (156, [], 2)]
    assert plain(vc.code_table(frame(spark, rows).repartition(5)).collect()) == plain(naive(singles(rows)))


def test_huge_components_are_exact(spark):
    rows = [(1, [1e30] + [0.0] * 31, 1), (2, [-1e30] * 32, 1), (3, [2.0**55] * 32, 2), (4, [0.5] * 32, 2)]
    out = plain(vc.code_table(frame(spark, rows)).collect())
    assert out == plain(naive(singles(rows)))  # four entries for four vectors: each its own


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1)], [(None, [1.0], 1)]):
        assert vc.code_table(frame(spark, rows)).collect() == []


def test_equals_sql(spark, sf_dir):
    duckdb_ = duckdb.connect()
    duckdb_.sql(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    want = duckdb_.sql(vc.ORACLE_SQL)
    df = vc.code_table(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    assert df.columns == want.columns
    assert plain(df.collect()) == plain(want.fetchall())


def test_codes_stand_for_near_vectors(spark, sf_dir):
    found = vc.kept(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    books = vc.fit(found)
    vectors = {r.vec_id: r.vector for r in found.collect()}
    coded = vc.encode(found, books).collect()
    back = books.decode([r.code for r in coded])
    x = np.array([vectors[r.vec_id] for r in coded])
    low = vc.integers(pa.array(x.tolist(), pa.list_(pa.float64())), 64)
    assert [int(e) for e in ((low - back * 256) ** 2).sum(axis=1)] == [r.error for r in coded]
    assert ((x - back) ** 2).sum() < 0.6 * ((x - x.mean(axis=0)) ** 2).sum()
