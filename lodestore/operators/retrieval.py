"""Query frames, BM25, dense ranks, fusion, anchor selection.

Cards are few (hundreds), queries many: cards are broadcast after their count is checked, queries stay dealt out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lodestore.functions import any_of, first_of, total

#: Stop words of tokenizer A.
STOP = (
    "a an the and or but of in on at to for with by from is are was were be been being have has had do does did will would can could shall should "
    "may might must that this these those it its i you he she we they me him her us them my your his our their what when where who which how"
).split()
K1, B, RRF, SHORTLIST = 1.5, 0.75, 60, 48
#: Cards that may be broadcast.
MOST_CARDS = 4096

#: Patterns of the query frame.
PROCEDURE = (r"\bhow\s+do\s+I\b", r"\bhow\s+to\b", r"\bsteps\s+to\b", r"\bset\s+up\b", r"\bconfigure\b", r"\binstall\b")
FAILURE = (r"\bwhat\s+went\s+wrong\b", r"\bwhy\s+did\s+it\s+fail\b", r"\bbroke\b", r"\bbug\b", r"\berror\b", r"\bfailed\b", r"\bfailure\b")
TEMPORAL = (r"\bchanged\b", r"\bused\s+to\b", r"\bcurrently\b", r"\bover\s+time\b", r"\bwhen\s+did\b", r"\bhistory\b", r"\bevolved\b", r"\bpreviously\b")
PREFERENCE = (r"\bprefer\b", r"\brecommend\b", r"\bbest\s+way\b", r"\bshould\s+we\s+use\b", r"\bwhich\s+is\s+better\b")
COMPARISON = (r"\bcompare\b", r"\bdifference\b", r"\bvs\b", r"\bversus\b", r"\btrade-off\b", r"\btradeoff\b", r"\bpros\s+and\s+cons\b")
SELF = (r"\byou\s+told\s+me\b", r"\bI\s+said\b", r"\bI\s+told\s+you\b", r"\byou\s+mentioned\b")
ASKED_SPEAKER, NAMED_SPEAKER = r"(?i)\bwhat\s+did\s+([A-Z][a-z]+)\s+(?:say|tell|mention)\b", r"\b([A-Z][a-z]+)\s+said\b"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
TIMES = (
    r"\blast\s+week\b", r"\blast\s+month\b", r"\blast\s+year\b", r"\byesterday\b", r"\btoday\b", r"\bthis\s+week\b", r"\bthis\s+month\b",
    r"\bbefore\s+[\p{L}\p{N}_]+\b", rf"\bin\s+(?:{MONTHS})\b", r"\bin\s+Q[1-4]\b", r"\brecently\b", r"\bearlier\b",
)
LABELLED_TIMES = {0: "last week", 1: "last month", 2: "last year", 3: "yesterday", 4: "today", 5: "this week", 6: "this month", 10: "recently", 11: "earlier"}
NEGATION = r"(?i)\b(?:not|never|without|don't|doesn't|didn't|shouldn't|can't|won't|no longer)\b"
CAPITAL_TERMS = r"\b[A-Z][a-z]+[A-Z][\p{L}\p{N}_]*\b|\b[A-Z]{2,}[\p{L}\p{N}_]*\b"


def small(cards: DataFrame) -> DataFrame:
    """cards for a broadcast join if they are few enough; beyond that the join shuffles."""
    return F.broadcast(cards) if cards.limit(MOST_CARDS + 1).count() <= MOST_CARDS else cards


def card_blocks(cards: DataFrame, key: str) -> list[DataFrame]:
    """cards in parts of about MOST_CARDS, by hash of their key: each fits a broadcast, however many there are."""
    n = max(1, -(-cards.count() // MOST_CARDS))
    return [cards.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) if n > 1 else cards for k in range(n)]


Scorer = Callable[[pa.Array], np.ndarray]


def top_by_row(rows: DataFrame, key: str, value: str, blocks: list[tuple[list, Scorer]], card_key: StructField, most: int | None, positive: bool = False, keep: bool = False) -> DataFrame:
    """(key, card_key, score, rank[, value]) of the `most` best cards (None: all) of each of rows, ties by card; without a shuffle if there is one block.

    blocks: card keys in order, and what scores a column of values against them as a matrix. Rows without a value have none.
    """
    types = [rows.schema[key].dataType, card_key.dataType, DoubleType(), LongType()]
    names = [key, card_key.name, "score", "rank"]
    if keep:
        types, names = [*types, rows.schema[value].dataType], [*names, value]
    given = rows.where(F.col(value).isNotNull()).select(key, value)
    out = []
    for docs, scorer in blocks:
        shared = rows.sparkSession.sparkContext.broadcast((docs, scorer))
        doc_type = to_arrow_type(card_key.dataType)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, doc_type=doc_type) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            docs, scorer = shared.value
            cards, step = pa.array(docs, doc_type), max(1, 1_000_000 // max(1, len(docs)))
            for b in (x.slice(i, step) for x in batches for i in range(0, len(x), step)):
                score = np.round(scorer(b.column(1)), 6)
                if most == 1 and not np.isnan(score).any():
                    order = score.argmax(axis=1)[:, None]
                else:
                    order = np.argsort(-score, axis=1, kind="stable")[:, :most]
                best = np.take_along_axis(score, order, axis=1)
                row, col = np.nonzero(best > 0 if positive else np.ones_like(best, dtype=bool))
                at = pa.array(row)
                columns = [b.column(0).take(at), cards.take(pa.array(order[row, col])), pa.array(best[row, col] + 0.0), pa.array(col + 1)]
                yield pa.RecordBatch.from_arrays(columns + ([b.column(1).take(at)] if keep else []), names)

        out.append(given.mapInArrow(run, StructType([StructField(n, t) for n, t in zip(names, types)])))
    every = reduce(DataFrame.unionByName, out)
    if len(out) > 1:
        w = Window.partitionBy(key).orderBy(F.desc("score"), card_key.name)
        every = every.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= (most or 1 << 30))
    return every


class VectorScorer:
    """Dot products of list values with the rows of a matrix."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix

    def __call__(self, values: pa.Array) -> np.ndarray:
        if not len(values):
            return np.zeros((0, len(self.matrix)))
        return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1) @ self.matrix.T


def vector_top(rows: DataFrame, key: str, value: str, cards: DataFrame, card_key: str, card_value: str, most: int | None, keep: bool = False) -> DataFrame:
    """top_by_row() by the dot product of vectors. Cards go out in bounded blocks."""
    blocks = []
    for part in card_blocks(cards, card_key):
        got = part.where(F.col(card_value).isNotNull()).select(card_key, card_value).orderBy(card_key).collect()  # MOST_CARDS, about
        blocks.append(([r[0] for r in got], VectorScorer(np.array([r[1] for r in got], dtype=np.float64).reshape(len(got), -1))))
    return top_by_row(rows, key, value, blocks, cards.schema[card_key], most, keep=keep)


class TermScorer:
    """Sums of the weights that a card gives to each token; a token counts as often as it comes."""

    def __init__(self, cards: int, weights: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.cards, self.weights = cards, weights

    def __call__(self, values: pa.Array) -> np.ndarray:
        out = np.zeros((len(values), self.cards))
        for row, tokens in zip(out, values.to_pylist()):
            for t in tokens:
                if (found := self.weights.get(t)) is not None:
                    row[found[0]] += found[1]
        return out


def query_frame(q: Column) -> dict[str, Column]:
    """answer_target, time_constraint, speaker_role, person, entities, quoted, negation, mode, confidence of a query."""
    some = lambda ps: any_of([q.rlike("(?i)" + p) for p in ps])
    nothing = F.lit("")
    person = F.coalesce(F.nullif(F.regexp_extract(q, ASKED_SPEAKER, 1), nothing), F.nullif(F.regexp_extract(q, NAMED_SPEAKER, 1), nothing))
    self_said = person.isNull() & some(SELF)
    stated = person.isNotNull() | self_said
    procedures = total([q.rlike("(?i)" + p).cast("int") for p in PROCEDURE])
    target = first_of((stated, "prior_statement"), (procedures > 0, "procedure"), (some(FAILURE), "failure"), (some(COMPARISON), "comparison"), (some(PREFERENCE), "preference"), default=F.lit("fact"))
    time = F.coalesce(*[F.when(q.rlike("(?i)" + p), F.lit(LABELLED_TIMES[i])) if i in LABELLED_TIMES else F.nullif(F.regexp_extract(q, "(?i)" + p, 0), nothing) for i, p in enumerate(TIMES)])
    timed = F.when(time.isNotNull() & ~target.isin("prior_statement", "comparison"), "temporal_change").otherwise(target)
    changed = timed.isin("fact", "temporal_change") & some(TEMPORAL)
    final = F.when(changed, "temporal_change").otherwise(timed)
    entities = F.array_distinct(F.concat(F.regexp_extract_all(q, F.lit(CAPITAL_TERMS), F.lit(0)), F.regexp_extract_all(q, F.lit('"([^"]+)"'), F.lit(1))))
    signals = F.when(stated, 2).otherwise(F.when(procedures > 0, F.least(procedures, F.lit(2))).when(target != "fact", 1).otherwise(0)) + time.isNotNull().cast("int") + changed.cast("int") + (F.size(entities) > 0).cast("int")
    return {
        "answer_target": final,
        "time_constraint": time,
        "speaker_role": F.when(self_said, "assistant"),
        "person": F.initcap(person),
        "entities": entities,
        "quoted": F.regexp_extract_all(q, F.lit('"([^"]{2,60})"'), F.lit(1)),
        "negation": q.rlike(NEGATION),
        "mode": first_of((final == "temporal_change", "compare_over_time"), (final == "comparison", "multi_hop"), default=F.lit("single_hop")),
        "confidence": F.least(signals / 4.0, F.lit(1.0)),
    }


def tokens(text: Column) -> Column:
    """Tokenizer A: letters in lower case, two at least, no stop words."""
    stop = F.array(*[F.lit(w) for w in STOP])
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1)), lambda x: (F.length(x) >= 2) & ~F.array_contains(stop, x))


def card_text(name: Column, meaning: Column, include: Column, exclude: Column, patterns: Column, examples: Column | None = None, fingerprints: Column | None = None) -> Column:
    """Text of a card: 8 terms it includes, 4 it excludes, 15 patterns; the full text also has 3 examples and the last 20 queries."""
    parts = [name, meaning, F.concat(F.lit("Includes: "), F.array_join(F.slice(include, 1, 8), ", ")), F.concat(F.lit("Excludes: "), F.array_join(F.slice(exclude, 1, 4), ", ")), F.array_join(F.slice(patterns, 1, 15), "\n")]
    if examples is not None:
        parts.append(F.array_join(F.slice(examples, 1, 3), "\n"))
    if fingerprints is not None:
        parts.append(F.array_join(F.slice(fingerprints, F.greatest(F.size(fingerprints) - 19, F.lit(1)), 20), "\n"))
    return F.concat_ws("\n", *parts)


def postings(docs: DataFrame, key: str = "doc") -> DataFrame:
    """(key, term, tf, dl) of docs (key, tokens)."""
    return docs.select(key, F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))


def bm25_index(docs: DataFrame) -> DataFrame:
    """(doc, term, tf, dl, idf, avgdl) of docs (doc, tokens): idf = ln((N - df + .5) / (df + .5) + 1). Totals are one row each."""
    p = postings(docs)
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    all_ = docs.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return p.join(df, "term").crossJoin(F.broadcast(all_)).select("doc", "term", "tf", "dl", idf.alias("idf"), "avgdl")


def bm25_scores(queries: DataFrame, cards: DataFrame, most: int | None = None, positive: bool = False) -> DataFrame:
    """(query_id, doc, score, rank) of queries (query_id, tokens) and cards (doc, tokens); a query word counts as often as it comes; 0 without a match.

    The `most` best of each query, ties by doc; None: all. positive: only those with a match. What a card gives to a word
    doesn't depend on the query, so it is worked out once, and each query is scored where it lies.
    """
    tf = F.col("tf")
    weight = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    index = bm25_index(cards).select("doc", "term", weight.alias("w"))
    blocks = []
    for part in card_blocks(cards.select("doc"), "doc"):
        docs = [r[0] for r in part.orderBy("doc").collect()]  # MOST_CARDS, about
        at, weights = {d: i for i, d in enumerate(docs)}, {}
        for r in index.join(F.broadcast(part), "doc", "left_semi").collect():  # the words of these cards
            weights.setdefault(r["term"], []).append((at[r["doc"]], r["w"]))
        held = {t: (np.array([i for i, _ in sorted(p)]), np.array([w for _, w in sorted(p)])) for t, p in weights.items()}
        blocks.append((docs, TermScorer(len(docs), held)))
    return top_by_row(queries, "query_id", "tokens", blocks, cards.schema["doc"], most, positive)


def ranked(scores: DataFrame, most: int, *ties: str) -> DataFrame:
    """The first `most` of each query by score, with rank."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *(ties or ("doc",)))
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)


def dense_scores(queries: DataFrame, cards: DataFrame, most: int | None = None) -> DataFrame:
    """(query_id, doc, score, rank): the dot products of each query's vector with the `most` best cards' centroids, ties by doc; None: all."""
    return vector_top(queries, "query_id", "qvec", cards, "doc", "centroid", most)


def fused(a: DataFrame, b: DataFrame, most: int) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: sum of 1 / (60 + rank); ranks 999 where a list lacks the card."""
    j = a.select("query_id", "doc", F.col("rank").alias("a_rank")).join(b.select("query_id", "doc", F.col("rank").alias("b_rank")), ["query_id", "doc"], "full")
    one = lambda r: F.coalesce(1.0 / (RRF + F.col(r)), F.lit(0.0))
    s = j.select("query_id", "doc", F.round(one("a_rank") + one("b_rank"), 9).alias("score"), F.coalesce("a_rank", F.lit(999)).alias("a_rank"), F.coalesce("b_rank", F.lit(999)).alias("b_rank"))
    return ranked(s, most)


def selected(scores: DataFrame, threshold: float, most: int, least: int = 0) -> DataFrame:
    """Trained selection from sorted scores: all over the threshold up to `most`, filled up to `least`, one at least."""
    passed = F.least(F.count_if(F.col("score") >= threshold).over(Window.partitionBy("query_id")), F.lit(most))
    r = ranked(scores, max(most, least, 1)).withColumn("_p", passed)  # beyond these ranks none is selected
    return r.where(F.col("rank") <= F.greatest("_p", F.lit(least), F.lit(1))).drop("_p")


def gates(oracle: int, held: int, recall: float, families: DataFrame) -> DataFrame:
    """Reasons why training may not start: one row with ok and reasons."""
    low = families.agg(F.array_sort(F.collect_list(F.when(F.col("n") < 50, F.col("family")))).alias("f"))
    reasons = F.array_compact(F.array(F.when(F.lit(oracle) < 300, "oracle"), F.when(F.lit(held) < 200, "held out"), F.when(F.lit(recall) < 0.95, "recall"), F.when(F.size("f") > 0, F.concat(F.lit("families: "), F.array_join("f", ",")))))
    return low.select(reasons.alias("reasons")).select((F.size("reasons") == 0).alias("ok"), F.array_join("reasons", "; ").alias("reasons"))


TARGETS = ("fact", "preference", "procedure", "failure", "temporal_change", "prior_statement", "comparison")
MODES = ("single_hop", "compare_over_time", "multi_hop", "abstention_risk")


def frame_features(target: Column, mode: Column) -> Column:
    """One-hot of the answer target and the retrieval mode: 11 numbers."""
    return F.array(*[(target == t).cast("double") for t in TARGETS], *[(mode == m).cast("double") for m in MODES])
