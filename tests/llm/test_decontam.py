import itertools
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestore.llm import decontam


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-1, 4), max_size=30), st.lists(st.integers(-1, 4), max_size=30))
def test_lcs(a, b):
    a = [x if x >= 0 else 0 for x in a]
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
    assert decontam.lcs(np.array(a, dtype=int), np.array(b, dtype=int)) == (row[-1] if a else 0)


def corpus(prose):
    items = [(i, prose(1000 + i, 20 + 3 * (i % 12))) for i in range(30)]
    docs, planted = [], set()
    for i in range(150):
        words = prose(i, 160).split()
        if i % 3 == 0:
            item, text = items[i % 30]
            words[i % 100 : i % 100] = text.split()
            planted.add((i, item))
        docs.append((i, " ".join(words)))
    rnd = random.Random(7)
    para = [w if rnd.random() > 0.15 else "altered" for w in items[5][1].split()]
    docs.append((500, prose(700, 40) + " " + " ".join(para) + " " + prose(701, 40)))
    return docs, items, planted


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_planted_items_are_found_and_clean_documents_left(spark, prose):
    docs, items, planted = corpus(prose)
    out = decontam.find_leaks(*frames(spark, docs, items)).collect()
    got = {(r.doc_id, r.item_id) for r in out}
    assert planted <= got and {d for d, _ in got} == {d for d, _ in planted} | {500}
    for r in out:
        own = decontam.WORD.findall(dict(docs)[r.doc_id].lower())[r.start_word : r.end_word]
        it = decontam.WORD.findall(dict(items)[r.item_id].lower())
        ids = {w: k for k, w in enumerate(it + own)}
        assert abs(r.lcs - decontam.lcs(np.array([ids[w] for w in it]), np.array([ids[w] for w in own])) / len(it)) < 1e-3


def prepared(spark, docs, rows):
    df, _ = frames(spark, docs, rows)
    items = decontam.Items(rows)
    items.extend(decontam.frequent_words(df, len(docs)))
    words, freq = decontam.numbered(df, items)
    items.weigh(freq, len(docs))
    return words, freq, items


def test_numbers_frequencies_and_decomposition_equal_brute_force(spark, prose):
    """Words and document frequencies one by one; A'A basis from the whole matrix; the latent directions against a full decomposition."""
    docs, rows, _ = corpus(prose)
    words, freq, items = prepared(spark, docs + [(501, None), (502, "")], rows)
    found = {r.doc_id: r.ids for r in words.collect()}
    texts = {d: decontam.WORD.findall(t.lower()) for d, t in docs}
    assert found == {d: [items.vocabulary.get(w, -1) for w in t] for d, t in texts.items()}
    for w, k in list(items.vocabulary.items())[:200]:
        assert freq[k] == sum(w in set(t) for t in texts.values())
    step, matrix = decontam.STRIDE * decontam.PASSAGE, []
    for t in found.values():
        for a in range(0, len(t), step):
            x = np.zeros(len(items.weight))
            for i in t[a : a + step]:
                if i >= 0:
                    x[i] += items.weight[i]
            if x.any():
                matrix.append(x / np.sqrt(sum(items.weight[i] ** 2 for i in t[a : a + step] if i >= 0)))
    matrix = np.array(matrix)
    basis = np.random.default_rng(1).standard_normal((len(items.weight), 5))
    got, n = decontam.gram_times(words, items, basis, 3)
    assert n == len(matrix) and np.allclose(got, matrix.T @ (matrix @ basis), atol=1e-2)
    latent = decontam.latent_basis(words, items)
    k = latent.shape[1]
    assert k < len(items.parts) and np.allclose(latent.T @ latent, np.eye(k), atol=1e-3)
    both = np.vstack([matrix, items.matrix * np.sqrt(len(matrix) / len(items.parts))])
    best = (np.linalg.svd(both, compute_uv=False)[:k] ** 2).sum()
    assert ((both @ latent) ** 2).sum() > 0.9 * best


def test_candidates_equal_brute_force(spark, prose):
    """Window by window and part by part in the latent space; no window of any text is left out."""
    docs, rows, _ = corpus(prose)
    words, _, items = prepared(spark, docs[:25], rows)
    basis = decontam.latent_basis(words, items)
    texts = [np.array(r.ids, dtype=np.int32) for r in words.orderBy("doc_id").collect()]
    edge = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = decontam.Search(items, basis)
    got = {(r, p, a): (z, c) for r, p, a, z, c in found.candidates(np.concatenate(texts), edge, -2.0, False)}
    latent = [(q @ basis) / np.linalg.norm(q @ basis) for q in items.matrix]
    want = {}
    for r, t in enumerate(texts):
        for p, it in enumerate(items.parts):
            width = next(w for longest, w in decontam.CLASSES if len(it) <= longest) * decontam.STRIDE
            for a in range(0, max(1, -(-len(t) // decontam.STRIDE) * decontam.STRIDE - width + 1), decontam.STRIDE):
                x = np.zeros(len(items.weight))
                for i in t[a : a + width]:
                    if i >= 0:
                        x[i] += items.weight[i]
                y = x @ basis
                want[r, p, a] = (min(a + width, len(t)), y @ latent[p] / max(np.linalg.norm(y), 1e-12))
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-3 for k in want)
    some = {(r, p, a) for r, p, a, _, _ in found.candidates(np.concatenate(texts), edge, -2.0)}
    for key in want:  # what isn't counted out is a candidate; what is can't have the words in common order
        r, p, a = key
        share = decontam.lcs(items.parts[p], texts[r][a : want[key][0]]) / len(items.parts[p])
        assert key in some or share < 0.5
        names = items.names[p]
        assert key in some or want[key][1] < decontam.LATENT - 1e-3 or decontam.lcs(names, texts[r][a : want[key][0]]) < decontam.NAMES * len(names)
    assert len(some) < len(want) / 50


def wordy(seed, subjects=10, count=30, documents=600):
    """Words of some subjects; each of a subject's twelve notions has two words that are used alike."""
    rnd = random.Random(seed)
    notion = lambda s, k: (f"sub{s}not{k}a", f"sub{s}not{k}b")
    filler = lambda n: " ".join(f"filler{rnd.randrange(3000)}" for _ in range(n))
    docs = [(i, " ".join(rnd.choice(notion(s, rnd.randrange(12))) if rnd.random() < 0.7 else f"filler{rnd.randrange(3000)}" for _ in range(96))) for i in range(documents) for s in [i % subjects]]
    items, paraphrases, decoys = [], [], []
    for k in range(count):
        picks = [notion(k % subjects, rnd.randrange(12)) for _ in range(10)]
        names = [f"name{k}x{j}" for j in range(6)]
        # all notions by their likes, one of the names left out: the order of the others stays
        less = [n if j != k % 6 else None for j, n in enumerate(names)]
        mixed = lambda words, own: " ".join(w for pair in itertools.zip_longest(words, own) for w in pair if w)
        items.append((k, mixed([p[0] for p in picks], names)))
        paraphrases.append((10_000 + k, f"{filler(40)} {mixed([p[1] for p in picks], less)} {filler(40)}"))
        # the same names in the same order amid words of another subject
        other = [notion((k + subjects // 2) % subjects, rnd.randrange(12))[0] for _ in range(10)]
        decoys.append((20_000 + k, f"{filler(40)} {mixed(other, less)} {filler(40)}"))
    return docs, items, paraphrases, decoys


def test_latent_search_finds_paraphrases_that_plain_cosine_misses(spark):
    """Words swapped for others that keep the same company. Plain: the same windows and weights without the decomposition."""
    docs, rows, paraphrases, _ = wordy(2)
    words, _, items = prepared(spark, docs + paraphrases, rows)
    basis = decontam.latent_basis(words, items)
    assert basis.shape[1] < len(items.parts)
    texts = [np.array([items.vocabulary.get(w, -1) for w in decontam.WORD.findall(t)], dtype=np.int32) for _, t in paraphrases]
    edge = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    best = []
    for b in (basis, np.eye(len(items.weight), dtype=np.float32)):
        own = np.zeros(len(rows))
        for r, p, _, _, c in decontam.Search(items, b).candidates(np.concatenate(texts), edge, -2.0, False):
            if r == p:
                own[r] = max(own[r], c)
        best.append(own)
    least = 0.75
    assert (best[0] >= least).mean() >= 0.9 and (best[1] >= least).mean() <= 0.1


def test_paraphrases_are_leaks_and_names_alone_are_not(spark, monkeypatch):
    """Through the whole operator: paraphrases that share a third of their words with an item, and texts that have its names but mean something else."""
    docs, rows, paraphrases, decoys = wordy(3)
    found = lambda: {(r.doc_id, r.item_id) for r in decontam.find_leaks(*frames(spark, docs + paraphrases + decoys, rows)).collect()}
    got, planted = found(), {(10_000 + k, k) for k in range(len(rows))}
    assert len(got & planted) >= 0.9 * len(planted) and len(got - planted) <= 0.1 * len(planted)
    # without the decomposition paraphrases are lost: it is the latent space that finds them
    monkeypatch.setattr(decontam, "latent_basis", lambda words, items, tasks=8: np.eye(len(items.weight), dtype=np.float32))
    assert len(found() & planted) <= 0.2 * len(planted)


def test_edges(spark, edge, empty, prose):
    items = spark.createDataFrame([(1, prose(1)), (2, None), (None, prose(3)), (3, "too short"), (1, prose(1)), (4, "word"), (5, "...")], "item_id long, text string")
    out = decontam.find_leaks(edge, items).collect()
    got = {(r.doc_id, r.item_id) for r in out}
    assert {(1, 1), (7, 1), (None, None), (5, 4)} <= got and got <= {(1, 1), (6, 1), (7, 1), (6, None), (None, None), (5, 4)}
    assert decontam.find_leaks(empty, items).count() == 0 and decontam.find_leaks(edge, items.limit(0)).count() == 0
    odd = edge.withColumnRenamed("blob", "row").withColumnRenamed("h1", "text_key").withColumnRenamed("fp", "_key").withColumn("a.b", F.lit(1))
    clean = decontam.decontaminate(odd, items)
    assert clean.columns == odd.columns
    gone = {r.text_key for r in out}
    want = [r for r in odd.withColumn("k", F.xxhash64(F.coalesce("text", F.lit("")))).collect() if r.k not in gone]
    assert sorted(map(tuple, clean.collect()), key=str) == sorted((tuple(r)[:-1] for r in want), key=str)


def test_short_items_are_phrases(spark):
    docs = [(1, "the capital is Paris."), (2, "Paris is the"), (3, "capital"), (4, "is paris"), (5, "it is"), (6, "Paris")]
    out = decontam.find_leaks(*frames(spark, docs, [(1, "Is Paris"), (2, "capital is paris the"), (3, "")])).collect()
    assert sorted((r.doc_id, r.item_id, r.start_word, r.end_word) for r in out) == [(1, 1, 2, 4), (4, 1, 0, 2)]


def test_copies_are_found_whatever_the_number_and_the_surroundings(spark, prose):
    """An item in a third of the documents, so that its words weigh little, unaligned and amid rare words; weights as of many more documents too."""
    item = prose(900, 15)
    rows = [(i, f"{prose(i, 37 + i % 16)} {item} {prose(5000 + i, 40)}" if i % 3 == 0 else prose(i, 90)) for i in range(600)]
    bench = [(1, item), (2, prose(901, 20))] + [(3 + k, prose(910 + k, 30)) for k in range(8)]
    assert {r.doc_id for r in decontam.find_leaks(*frames(spark, rows, bench)).collect()} >= {i for i in range(0, 600, 3)}
    for words in (5, 9, 15, 33, 59):
        it = prose(902, words)
        around = [(prose(3, at), prose(4, 80)) for at in range(0, 70, 3)]
        items = decontam.Items([(1, it)])
        items.extend(sorted({w for a, b in around for w in decontam.WORD.findall(a + " " + b)}))
        df = np.where(np.arange(len(items.vocabulary)) < items.own, 1_000_000.0, 3.0)
        items.weigh(df, 3_000_000)
        ids = [np.array([items.vocabulary[w] for w in decontam.WORD.findall(f"{a} {it} {b}")], dtype=np.int32) for a, b in around]
        edge = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        found = decontam.Search(items, np.eye(len(df), dtype=np.float32)).leaks(np.concatenate(ids), edge)
        assert {r for r, _, _, share, _, _ in found if share == 1} == set(range(len(ids))), words


def test_blocks_of_items_and_long_texts(spark, prose, monkeypatch):
    """The same leaks if the benchmark goes through in several blocks, and if texts are longer than a stretch of work."""
    docs, items, planted = corpus(prose)
    monkeypatch.setattr(decontam, "BLOCK", 16)
    docs.append((900, " ".join(prose(3000 + i, 400) for i in range(60)) + " " + items[3][1]))
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(*frames(spark, docs, items)).collect()}
    assert planted | {(900, 3)} <= got and {d for d, _ in got} == {d for d, _ in planted} | {500, 900}
    flat = pa.RecordBatch.from_arrays([pa.array([[1] * 5, [], [2] * 300_000, [3] * 7], pa.list_(pa.int32()))], ["ids"])
    parts = list(decontam.chunks(flat, 0))
    assert [p[0] for p in parts] == [0, 2, 3] and [len(p[1]) for p in parts] == [5, 300_000, 7] and parts[0][2].tolist() == [0, 5, 5]


def test_frequent_words_come_from_all_documents(spark, monkeypatch):
    """a word counts wherever it stands, however many documents there are said to be, and over several rows of read words."""
    docs = [(i, f"every w{i} w{i} half{i % 2} null") for i in range(60)] + [(60, None), (61, ""), (62, "last " * 5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    want = ["every", "null", "half0", "half1", "last", *sorted(f"w{i}" for i in range(60))]
    assert decontam.frequent_words(df, 10_000_000) == want
    monkeypatch.setattr(decontam, "TEXTS", 7)
    read = decontam.read_words(df)
    assert read.count() >= 8 and decontam.frequent_words(read) == want
    items = decontam.Items([(1, "every half0 w3 w4 nowhere")])
    words, df_of = decontam.numbered(read, items)
    assert df_of.tolist() == [60, 30, 1, 1, 0]
    assert {r.doc_id: r.ids for r in words.collect()}[3] == [0, 2, 2, -1, -1] and words.count() == 61


def test_words_are_cut_as_by_the_pattern_and_summed_as_in_loops(spark, monkeypatch):
    """Pieces between white space give the words of whole texts; sums by word don't depend on how often a word stands."""
    texts = ["Ab ab-AB\tc_d 9x Ω", None, "", "--- ...", "ΣΑΣ ΑΣ, İx\x1cy z᠎q", "l\r\nm\nn\x0bo\x0cp", "áb ½ 東京 x" * 3]
    words, count, ids = decontam.cut(pa.array(texts, pa.string()))
    want = [decontam.WORD.findall((t or "").lower()) for t in texts]
    assert len(set(words)) == len(words) and [words[i] for i in ids] == [w for t in want for w in t] and count.tolist() == [len(t) for t in want]
    assert [len(x) for x in decontam.cut(pa.array([None, "!"], pa.string()))] == [0, 2, 0] and [len(x) for x in decontam.cut(pa.array([], pa.string()))] == [0, 0, 0]
    monkeypatch.setattr(decontam, "OFTEN", 5)
    rng = np.random.default_rng(2)
    word, number, y = np.minimum(rng.geometric(0.2, 400), 30).astype(np.int32), rng.integers(0, 50, 400), rng.normal(size=(50, 3))
    each, sums = decontam.sums_by_word(word, number, y, 31)
    assert sorted(each.tolist()) == sorted(set(word.tolist()))
    assert all(np.allclose(s, y[number[word == w]].sum(axis=0)) for w, s in zip(each, sums))


def test_texts_are_read_as_words_and_not_written_again(spark, prose, monkeypatch):
    """op1: what read_words() wrote goes to the decomposition and the search as it is."""
    docs, items, planted = corpus(prose)

    def written(*_):
        raise AssertionError("numbers of words are written a second time")

    monkeypatch.setattr(decontam, "numbered", written)
    assert planted <= {(r.doc_id, r.item_id) for r in decontam.find_leaks(*frames(spark, docs, items)).collect()}
