import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lodestore.llm import divergence as dv
from lodestore.llm.transducer import States, Transducer, unpacked


def some_words(seed, n=400):
    rnd = random.Random(seed)
    return sorted({"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 7))).encode() for _ in range(n)})


def walked(t, words):
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    return t.places(data, end - [len(w) for w in words], end).tolist()


@pytest.mark.parametrize("seed", range(4))
def test_transducer_gives_places_and_is_minimal(seed):
    words = some_words(seed)
    states = States()
    t = Transducer.of(states, states.added(words))
    assert t.terms() == words
    others = [w for w in some_words(seed + 10) if w not in words] + [b"", b"zz", words[-1] + b"a"]
    assert walked(t, words) == list(range(len(words)))
    assert walked(t, others) == [-1] * len(others)
    # as many states as there are different sets of what may follow a beginning
    follows = defaultdict(set)
    for w in words:
        for k in range(len(w) + 1):
            follows[w[:k]].add(w[k:])
    assert len(t.final) == len({frozenset(x) for x in follows.values()})


@pytest.mark.parametrize("size", [1, 7, 50])
def test_union_of_pieces_is_the_whole(size):
    words = some_words(9)
    whole = States()
    want = Transducer.of(whole, whole.added(words))
    states, first = States(), None
    for k in range(0, len(words), size):
        own = States()
        piece = unpacked(states, *Transducer.of(own, own.added(words[k : k + size])).packed())
        first = piece if first is None else states.union(first, piece)
    joined = Transducer.of(states, first)
    assert joined.terms() == words
    assert len(joined.final) == len(want.final)
    assert walked(joined, words) == list(range(len(words)))


def test_terms_end_with_their_text():
    texts = [b"", b"ab", b"cd", b"", b" e", b"f ", b"g\x00h", b""]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    begin, end = dv.term_edges(data, offsets)
    assert [data[b:e].tobytes() for b, e in zip(begin, end)] == [b"ab", b"cd", b"e", b"f", b"g", b"h"]
    assert dv.term_edges(data[:0], offsets[:1])[0].tolist() == []


def naive(rows, least=30, listed=50):
    docs = [tuple(x or "" for x in (r[1], r[2], r[3])) for r in rows]
    pattern = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        found = pattern.findall(text.translate(lower))
        seen[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang in {d[1] for d in docs}:
        kept = sorted((t for t, n in seen[lang].items() if n >= least), key=str.encode)
        own = {s: {t: c[t] for t in kept} for (x, s), c in counts.items() if x == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        p = lambda c: {t: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for t, n in c.items()}
        q, each = p(whole), {s: p(c) for s, c in own.items()}
        for s in own:
            pairs = sorted((-sum(abs(each[s][t] - each[o][t]) for t in kept), o.encode(), o) for o in own if o != s)
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)]
            terms = sorted((q[t] - each[s][t], t.encode(), t) for t in kept if own[s][t] and each[s][t] > q[t])
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(terms[:listed])]
    return sorted(out)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place long, p long, number long"


def corpus(n=300):
    rnd = random.Random(5)
    words = ["Éa", "ba", "BA", "ko", "tum", "ñ", "sel", "x1y", "ne-vor", "ga_li", " mo", "日本"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))), rnd.choice(["en", "de", None]), rnd.choice(["s", "t", "u", None, "v"] + ["hot"] * 3)) for i in range(n)]
    rows += [(1, None, "xx", "a"), (1, "ba ba", "xx", "b"), (None, "tum", "yy", None), (2, "é" * 100_000 + " ba " * 50_000, "en", "t")] + [(3, "ba ko ko", "en", "u")] * 40
    return [(*r, 1, 2, 3, 4) for r in rows]


@pytest.mark.parametrize(("piece", "block", "places", "sources"), [(8192, 10**6, 2048, 256), (2, 1, 3, 2), (3, 12, 4, 1)])
def test_equals_loops(spark, monkeypatch, piece, block, places, sources):
    monkeypatch.setattr(dv, "PLACES", places)
    monkeypatch.setattr(dv, "SOURCES", sources)
    monkeypatch.setattr(dv, "MOST_COUNTS", 5)
    monkeypatch.setattr(dv, "IN_STEP", 100)
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = dv.audit(docs, piece=piece, block=block)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in out.collect()) == naive(rows)


def test_edges(spark, edge, empty):
    assert dv.audit(empty).collect() == []
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in edge.collect()]
    assert sorted(tuple(r) for r in dv.audit(edge, least=2).collect()) == naive(rows, 2)
    assert sorted(tuple(r) for r in dv.audit(edge).collect()) == naive(rows)


def test_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    df = dv.audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert sorted(tuple(r) for r in df.collect()) == sorted(con.sql(dv.ORACLE_SQL).fetchall())
