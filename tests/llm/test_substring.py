from collections import defaultdict

from lodestore.llm import substring


def brute(rows, least=substring.RUN, words=substring.WORDS):
    """Every run by its text; places but the first cover their characters. Rows are (doc, text); documents without id come last, by their place."""
    places = defaultdict(list)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    for row in order:
        text = rows[row][1] or ""
        at = substring.pieces(text)
        size = [len(text[a:b].split()) for a, b in at]
        fits = []
        for i in range(len(at)):
            j = next((j for j in range(i + least, len(at) + 1) if sum(size[i:j]) >= words), None)
            if j:
                fits.append((i, j))
        if sum(size):
            fits.append((fits[-1][0] if fits else 0, len(at)))
        for i, j in sorted(set(fits)):
            places[tuple(text[a:b].strip() for a, b in at[i:j])].append((row, at[i][0], at[j - 1][1]))
    covered, kept = defaultdict(set), defaultdict(set)
    for found in places.values():
        for row, s, e in found[1:]:
            covered[row] |= set(range(s, e))
            kept[row].add(rows[found[0][0]][0])
    return covered, kept


def test_spans_equal_brute_force(spark, prose):
    passage = prose(999, 70)
    rows = [(i, prose(i, 80)) for i in range(20)]
    rows += [(100, prose(50, 13) + " " + passage + " " + prose(51, 15)), (101, prose(52, 20) + " " + passage + " tail"), (102, prose(3, 80)), (103, passage + ". " + passage)]
    rows += [(110 + i, "Three short words. Then three more. And an end.") for i in range(3)] + [(120, "word"), (121, "word"), (122, "words")]
    rows += [(130, prose(7, 80) + " " + prose(11, 80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, kept = defaultdict(set), defaultdict(set)
    for r in substring.removed_spans(docs).collect():
        got[r.doc_id] |= set(range(r.start, r.end))
        kept[r.doc_id] |= set(r.kept_doc_ids)
    want, holders = brute(rows)
    assert got == {rows[i][0]: c for i, c in want.items()} and set(got) == {101, 102, 103, 111, 112, 121, 130}
    assert kept == {rows[i][0]: k for i, k in holders.items()} and kept[130] == {7, 11}
    texts = dict(rows)
    assert all(len(got[d]) == len(texts[d]) for d in (102, 111, 112, 121))  # whole copies go whole
    clean = {r.doc_id: r.text for r in substring.dedup_documents(docs).collect()}
    for doc, text in texts.items():
        assert clean[doc] == "".join(c for k, c in enumerate(text) if k not in got.get(doc, ()))
    assert clean[100] == texts[100]


def test_rows_without_id(spark, prose):
    """A copy with an id stays before those without; of two without ids one stays."""
    rows = [(None, prose(1, 60)), (None, prose(1, 60)), (5, prose(1, 60)), (None, prose(2, 60)), (None, prose(2, 60)), (None, "short"), (None, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = substring.removed_spans(docs).collect()
    assert sorted((r.doc_id is None, tuple(r.kept_doc_ids)) for r in found) == [(True, ()), (True, ()), (True, (5,)), (True, (5,))]
    texts = [r.text for r in substring.dedup_documents(docs).collect()]
    assert sorted(t for t in texts if t) == sorted([prose(1, 60), prose(2, 60), "short"]) and len(texts) == 7


def test_a_passage_in_the_midst_of_other_sentences_is_found():
    passage = "Alpha beta, gamma delta epsilon zeta. " * 1 + "One two three four, five six seven eight nine ten. Red green blue, more words than these are not needed here. Last bit of it"
    inner = set(substring.runs("some words before " + passage + " and after. End")[0].tolist())
    assert inner & set(substring.runs("other " + passage + " else, yes.")[0].tolist())


def test_pieces_cover_the_text():
    for text in ("", "a", "a.b. c", "\n\n", "x,, y;z! ", "no end"):
        assert "".join(text[a:b] for a, b in substring.pieces(text)) == text


def test_edges(edge, empty):
    rows = edge.select("doc_id", "text").collect()
    got = {r.doc_id for r in substring.removed_spans(edge).collect()}
    assert 7 in got and got <= {6, 7, 8, None}
    assert substring.removed_spans(empty).count() == 0 and substring.dedup_documents(empty).count() == 0
    out = substring.dedup_documents(edge)
    assert out.columns == edge.columns and out.count() == len(rows)
    same = lambda df: sorted(str(r[2:]) for r in df.collect())
    assert same(out) == same(edge)
