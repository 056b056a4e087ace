"""Substring deduplication by sliding runs of sentences.

Texts are cut into sentences, and these at clause marks and, where they are long, at words that hashes pick,
so that a passage set into the midst of another sentence still shares its inner pieces. From each piece a run of at least RUN pieces is taken that holds at
least WORDS words; the last one that fits also goes on to the text's end, and a text that holds none is one run
by itself, so that whole copies are covered to the last piece. Runs are hashed from a rolling polynomial of the pieces' hashes.
The first place of each repeated run (by document, then position) stays; pieces that any other place covers are removed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.common import stored

#: Pieces of a run and words of it, at least.
RUN, WORDS = 3, 25
PIECE = re.compile(r"[^.!?,;:\n]*(?:[.!?,;:\n]+\s*|$)")
#: Pieces of more words are cut, after about one word in CUT.
LONG, CUT = 24, 5
SPACED = re.compile(r"(\S+)\s*")
#: Documents that a task holds as Python objects at a time.
DOCS = 500
#: Odd multipliers of the two rolling hashes.
P1, P2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
MASK = (1 << 64) - 1


def pieces(text: str) -> list[tuple[int, int]]:
    """(start, end) of each piece of text, in characters; together they are the text.

    A piece of more than LONG words is cut after words that their own hash picks, so that two texts which share
    a long stretch without marks share the cuts in it, whatever stands before.
    """
    out = []
    for m in PIECE.finditer(text):
        a, b = m.span()
        if b - a > 2 * LONG and text.count(" ", a, b) >= LONG:
            for w in SPACED.finditer(text, a, b):
                if zlib.crc32(w[1].encode("utf-8", "surrogatepass")) % CUT == 0 and w.end() < b:
                    out.append((a, w.end()))
                    a = w.end()
        if b > a:
            out.append((a, b))
    return out


def _powers(p: int, n: int) -> np.ndarray:
    out = np.full(n, p, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def runs(text: str, least: int = RUN, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(h1, h2, start, end) of the shortest run from each piece that has enough pieces and words, in characters, and of the run that the text's end closes. Texts without words have none."""
    at = pieces(text)
    own = [text[a:b].strip() for a, b in at]
    n = len(own)
    size = np.fromiter((len(x.split()) for x in own), dtype=np.int64, count=n)
    keys = np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 7) for x in own), dtype=np.uint64, count=n)
    total = np.concatenate([[0], np.cumsum(size)])
    end = np.maximum(np.searchsorted(total, total[:-1] + words), np.arange(n) + least) if n else np.zeros(0, dtype=np.int64)
    start = np.flatnonzero(end <= n)
    end = end[start]
    if total[-1] and (not len(end) or end[-1] < n):
        start, end = np.append(start, start[-1] if len(start) else 0), np.append(end, n)
    out = []
    for p in (P1, P2):
        # sum of key[j] * p^(n-1-j) up to each piece; a run's hash is the difference, brought to one power
        up = _powers(p, n + 1) if n else np.ones(1, dtype=np.uint64)
        inverse = _powers(pow(p, -1, 1 << 64), n + 1) if n else up
        prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((keys + np.uint64(1)) * up[:n], dtype=np.uint64)])
        out.append((prefix[end] - prefix[start]) * inverse[start])
    edge = np.array([a for a, _ in at] + [len(text)], dtype=np.int64)
    return out[0], out[1], edge[start], edge[end]


RUNS = "doc long, known boolean, h1 long, h2 long, start int, end int"


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc, known, text) for each row of docs: doc is its doc_id or, for rows without one (known is false), a number of its own.

    Those rows are written with their numbers, so that every later read sees the same ones.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    named = docs.where("doc_id is not null").select(row, F.col("doc_id").cast("long").alias("doc"), F.lit(True).alias("known"), "text")
    nameless = docs.where("doc_id is null").select(row, F.monotonically_increasing_id().alias("doc"), F.lit(False).alias("known"), "text")
    return named.unionByName(stored(nameless, "nameless-rows"))


def all_runs(keyed: DataFrame, least: int, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, DOCS) for x in batches for i in range(0, len(x), DOCS)):
            docs, known, cols = [], [], [[], [], [], []]
            for doc, k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                got = runs(text or "", least, words)
                if len(got[0]):
                    docs.append(np.full(len(got[0]), doc, dtype=np.int64))
                    known.append(np.full(len(got[0]), k))
                    for c, g in zip(cols, got):
                        c.append(g)
            if docs:
                h1, h2, start, end = (np.concatenate(c) for c in cols)
                columns = (np.concatenate(docs), np.concatenate(known), h1.view(np.int64), h2.view(np.int64), start.astype(np.int32), end.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in RUNS.split(", ")])

    return keyed.select("doc", "known", "text").mapInArrow(run, RUNS)


def repeated_runs(keyed: DataFrame, least: int = RUN, words: int = WORDS) -> DataFrame:
    """(doc, known, start, end, kept): each run of numbered() rows whose hash has an earlier place; kept is the id of the document that holds the first, null if it has none.

    Rows with one doc_id count as one document. Documents with ids come first, by id, then those without.
    The first places are written before the join, so that the join is a stage of its own and a run
    that a third of all documents share is split by adaptive execution.
    """
    every = stored(all_runs(keyed, least, words), "sentence-runs")
    place = F.struct((~F.col("known")).alias("late"), "doc", "start")
    firsts = every.groupBy("h1", "h2").agg(F.min(place).alias("at"), F.count("*").alias("places")).where("places > 1").select("h1", "h2", "at")
    later = every.join(stored(firsts, "sentence-firsts"), ["h1", "h2"]).where("doc <> at.doc or known = at.late or start <> at.start")
    return later.select("doc", "known", "start", "end", F.when(~F.col("at.late"), F.col("at.doc")).alias("kept"))


def merge_spans(spans: list) -> list[tuple[int, int, list[int]]]:
    """Overlapping or touching runs as one stretch, with the ids of all documents that hold first places of its runs."""
    out: list[tuple[int, int, set]] = []
    for start, end, kept in spans:
        own = set() if kept is None else {kept}
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2] | own)
        else:
            out.append((start, end, own))
    return [(s, e, sorted(k)) for s, e, k in out]


def _removed(keyed: DataFrame, least: int, words: int) -> DataFrame:
    """(doc, known, start, end, kept_doc_ids) for each stretch that is removed from a numbered() row."""
    one = F.struct("start", "end", "kept")
    grouped = repeated_runs(keyed, least, words).groupBy("doc", "known").agg(F.sort_array(F.collect_list(one)).alias("spans"))  # a document's own runs only

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(doc, known, *span) for doc, known, found in zip(b["doc"], b["known"], b["spans"]) for span in merge_spans([(r["start"], r["end"], r["kept"]) for r in found])]
            yield pd.DataFrame(rows, columns=["doc", "known", "start", "end", "kept_doc_ids"]).astype({"doc": "int64", "known": bool, "start": "int32", "end": "int32"})

    return grouped.mapInPandas(run, "doc long, known boolean, start int, end int, kept_doc_ids array<long>")


def removed_spans(docs: DataFrame, least: int = RUN, words: int = WORDS) -> DataFrame:
    """One row for each stretch that is removed: doc_id, start, end (characters), kept_doc_ids (of all documents whose first places it repeats).

    Documents without repeated runs have no row; so have null and empty texts and texts of white space. A text shorter than a run
    counts whole. The first place of a run is that of the smallest doc_id, then position, so copies inside one
    document go too; rows without doc_id come after all others, each a document of its own. Repeated rows
    of one document (same doc_id) yield the same spans as one.
    """
    return _removed(numbered(docs), least, words).select(F.when(F.col("known"), F.col("doc")).alias("doc_id"), "start", "end", "kept_doc_ids")


def dedup_documents(docs: DataFrame, least: int = RUN, words: int = WORDS) -> DataFrame:
    """docs with the removed stretches cut from text; other rows and columns unchanged. A row travels as one struct, so any column names are fine."""
    keyed = numbered(docs)
    spans = _removed(keyed, least, words).groupBy("doc", "known").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    joined = keyed.drop("text").join(spans, ["doc", "known"], "left")
    text = F.col("row")["text"]

    def step(acc, s):  # noqa: ANN001
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"])).alias("out"))

    cut = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    new = F.when(F.col("spans").isNull(), text).otherwise(cut)
    return joined.select(*[(new if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
