"""Retrieval and answer metrics, and the re-ranking rules of the benchmark harnesses."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, DoubleType, StructField, StructType

from lodestore.functions import any_of, first_of, total
from lodestore.sources.files import stored

#: Words that are no keywords of a question.
NO_KEYWORDS = (
    "what when where who how which did do was were have has had is are the a an my me i you your their it its in on at to for of with by from ago last that this there about get got give gave buy bought made make"
).split()
#: Phrases of questions about what the assistant said; offsets in days with their tolerance.
ASSISTANT = (
    "you suggested", "you told me", "you mentioned", "you said", "you recommended", "remind me what you", "you provided", "you listed", "you gave me", "you described", "what did you",
    "you came up with", "you helped me", "you explained", "can you remind me", "you identified",
)
OFFSETS = (
    (r"(\d+)\s+days?\s+ago", 1, 2), (r"a\s+couple\s+(?:of\s+)?days?\s+ago", 2, 2), ("yesterday", 1, 1), (r"a\s+week\s+ago", 7, 3), (r"(\d+)\s+weeks?\s+ago", 7, 5), (r"last\s+week", 7, 3),
    (r"a\s+month\s+ago", 30, 7), (r"(\d+)\s+months?\s+ago", 30, 10), (r"last\s+month", 30, 7), (r"last\s+year", 365, 30), (r"a\s+year\s+ago", 365, 30), ("recently", 14, 14),
)
#: Signals of a session's hall.
PREFERENCE = ("i prefer", "i usually", "i've been having trouble", "i've been feeling", "i've been struggling", "i want to", "i'm worried", "i've been thinking", "i've been considering", "lately i", "recently i", "i tend to")
ADVICE = ("i suggest", "i recommend", "here are", "you might want to", "option 1", "option 2", "1.", "2.", "3.", "first,", "second,", "you could try", "i would recommend", "my recommendation")
EVENTS = ("milestone", "graduation", "promotion", "anniversary", "birthday", "moved", "started", "finished", "completed", "launched", "opened", "achieved", "won", "accepted", "hired", "married", "born")
FACTS = ("degree", "major", "university", "college", "job", "position", "role", "company", "city", "country", "street", "born in", "grew up", "studied", "works at", "lives in", "years old", "salary", "budget")
#: What introduces a preference in a user's turn.
WISHES = (
    r"i(?:'ve been| have been) having (?:trouble|issues?|problems?) with ([^,\.!?]{5,80})",
    r"i(?:'ve been| have been) feeling ([^,\.!?]{5,60})",
    r"i(?:'ve been| have been) (?:struggling|dealing) with ([^,\.!?]{5,80})",
    r"i(?:'ve been| have been) (?:worried|concerned) about ([^,\.!?]{5,80})",
    r"i(?:'m| am) (?:worried|concerned) about ([^,\.!?]{5,80})",
    r"i prefer ([^,\.!?]{5,60})",
    r"i usually ([^,\.!?]{5,60})",
    r"i(?:'ve been| have been) (?:trying|attempting) to ([^,\.!?]{5,80})",
    r"i(?:'ve been| have been) (?:considering|thinking about) ([^,\.!?]{5,80})",
    r"lately[,\s]+(?:i've been|i have been|i'm|i am) ([^,\.!?]{5,80})",
    r"recently[,\s]+(?:i've been|i have been|i'm|i am) ([^,\.!?]{5,80})",
    r"i(?:'ve been| have been) (?:working on|focused on|interested in) ([^,\.!?]{5,80})",
    r"i want to ([^,\.!?]{5,60})",
    r"i(?:'m| am) looking (?:to|for) ([^,\.!?]{5,60})",
    r"i(?:'m| am) thinking (?:about|of) ([^,\.!?]{5,60})",
    r"i(?:'ve been| have been) (?:noticing|experiencing) ([^,\.!?]{5,80})",
)
#: What the fourth version adds, memories.
MEMORIES = (
    r"i (?:still )?remember (?:the |my )?([^,\.!?]{5,80})",
    r"i used to ([^,\.!?]{5,60})",
    r"when i was (?:in high school|in college|young|a kid|growing up)[,\s]+([^,\.!?]{5,80})",
    r"growing up[,\s]+([^,\.!?]{5,80})",
    r"(?:happy|fond|good|positive) (?:high school|college|childhood|school) (?:experience|memory|memories|time)[^,\.!?]{0,60}",
)
#: Ranks at which retrieval is measured; sessions that a question fetches before they are re-ranked; questions that are sent out together.
KS, FETCH, QUESTIONS = (1, 3, 5, 10, 30, 50), 50, 512
#: Questions whose vectors go out together; pairs that are compared at a time; more than rounding to six decimals and the order of a sum change of a distance.
VECTORS, TOGETHER, NEAR = 4096, 1 << 20, 2e-6
#: Questions of one vector that meet what was found together, and questions of a task.
PART, TASK = 32, 64
#: The same where terms of a part's questions are looked for together.
SHARED, SHARED_TASK = 128, 256
#: Rows whose tokens are counted at a time.
ROWS = 256
OVERLAP, TEMPORAL, QUOTED, NAMED = 0.30, 0.40, 0.60, 0.40


def keywords(text: Column) -> Column:
    """Words of three letters, with their repeats, that aren't common in questions."""
    stop = F.array(*[F.lit(w) for w in NO_KEYWORDS])
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"\b([a-z]{3,})\b"), F.lit(1)), lambda w: ~F.array_contains(stop, w))


def share_within(terms: Column, low: Column) -> Column:
    """The share of terms that low, a text in lower case, holds as substrings; 0 without terms."""
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.filter(terms, lambda k: F.contains(low, F.lower(k)))) / F.greatest(F.size(terms), F.lit(1)))


def quoted(text: Column) -> Column:
    both = F.concat(F.regexp_extract_all(text, F.lit("'([^']{3,60})'"), F.lit(1)), F.regexp_extract_all(text, F.lit('"([^"]{3,60})"'), F.lit(1)))
    return F.filter(F.transform(both, F.trim), lambda p: F.length(p) >= 3)


def names(text: Column, no_names: list[str]) -> Column:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]{2,15})\b"), F.lit(1)))
    return F.filter(found, lambda w: ~F.array_contains(F.array(*[F.lit(x) for x in no_names]), w))


def time_offset(question: Column) -> Column:
    """(days, tolerance) of the first offset phrase of a question, else null."""
    low, out = F.lower(question), F.lit(None).cast("struct<days:int,tolerance:int>")
    for pattern, days, tolerance in reversed(OFFSETS):
        n = F.regexp_extract(low, pattern, 1).cast("int") * days if "(\\d+)" in pattern else F.lit(days)
        out = F.when(low.rlike(pattern), F.struct(n.alias("days"), F.lit(tolerance).alias("tolerance"))).otherwise(out)
    return out


def temporal_boost(day: Column, asked_day: Column, offset: Column) -> Column:
    """Up to .40 within the tolerance around the day that is asked for, falling to 0 at three times it."""
    away, tol = F.abs(day - (asked_day - offset["days"])), offset["tolerance"]
    return F.when(offset.isNull(), 0.0).when(away <= tol, TEMPORAL).when(away <= 3 * tol, TEMPORAL * (1 - (away - tol) / (2.0 * tol))).otherwise(0.0)


def about_assistant(question: Column) -> Column:
    low = F.lower(question)
    return any_of([F.contains(low, F.lit(t)) for t in ASSISTANT])


def session_hall(user: Column, assistant: Column) -> Column:
    """Preferences before advice (two signals) before events before facts (two signals) before general."""
    u, a = F.lower(user), F.lower(assistant)
    both = F.concat(u, a)
    hits = lambda text, signals: total([F.contains(text, F.lit(s)).cast("int") for s in signals])
    return first_of((hits(u, PREFERENCE) > 0, "preferences"), (hits(a, ADVICE) >= 2, "assistant"), (hits(both, EVENTS) > 0, "events"), (hits(both, FACTS) >= 2, "facts"), default=F.lit("general"))


def question_halls(question: Column) -> Column:
    """Halls a question is about, the likeliest first, as `a,b`."""
    low = F.lower(question)
    wants = any_of([F.contains(low, F.lit(s)) for s in ("i prefer", "i usually", "battery", "lately", "recently been", "struggling with")])
    return first_of((about_assistant(question), "assistant,general"), (wants, "preferences,general"), default=F.lit("events,facts"))


def preferences(turns: Column, patterns: tuple[str, ...] = WISHES, most: int = 10) -> Column:
    """Ordered distinct wishes of a session's user turns (array), 5 to 80 characters, `most` at most."""
    of = lambda t: F.concat(*[F.regexp_extract_all(F.lower(t), F.lit(p), F.lit(int("([^" in p))) for p in patterns])
    clean = F.transform(F.flatten(F.transform(turns, of)), lambda m: F.regexp_replace(F.trim(m), r"[.,;!? ]+$", ""))
    return F.slice(F.array_distinct(F.filter(clean, lambda m: F.length(m).between(5, 80))), 1, most)


def in_blocks(questions: DataFrame, most: int = QUESTIONS) -> list[DataFrame]:
    """questions in parts of about `most` rows, by hash: each can be broadcast whatever their number."""
    n = max(1, -(-questions.count() // most))
    return [questions.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k) if n > 1 else questions for k in range(n)]


def searched_once(questions: DataFrame, docs: DataFrame, k: int = FETCH, on: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Questions (query_id, qvec, and more) with `lead`, the smallest id of those that share their vector (and value of `on`), and `led`, how many these are;
    and (lead, led, doc_id, dist, near, and `on` if given): the k docs (doc_id, vec) closest to each lead, by 1 - cosine, then doc_id.

    A stated set of questions meets all docs block by block, by vectors alone, as a product of matrices where the docs lie; each task hands on
    what may be among its own best k of a question, with a distance that sums in the order of dot(). on: a column that both must share.
    """
    shared = [on] if on else []
    given, out = docs.where("vec is not null").select("doc_id", "vec", *shared), []
    every = questions.where("qvec is not null")
    if on:
        every = every.where(F.col(on).isNotNull())
    leads = every.groupBy("qvec", *shared).agg(F.min("query_id").alias("lead"), F.count("*").alias("led"))
    blocks = in_blocks(leads.withColumnRenamed("lead", "query_id"), VECTORS)
    if len(blocks) > 1:
        given = stored(docs.sparkSession, given, "searched")
    for block in blocks:
        asked = {}
        for r in block.select("query_id", "qvec", *shared).collect():  # VECTORS, about, each with its values of `on`
            asked.setdefault(r[2] if on else None, []).append((r[0], r[1]))
        out.append(_near_docs(given, asked, k, on, questions.schema["query_id"].dataType))
    found = reduce(DataFrame.unionByName, out).withColumn("dist", F.round("dist", 6)).withColumnRenamed("query_id", "lead")
    few = F.broadcast(leads) if len(blocks) == 1 else leads
    named = every.join(few, ["qvec", *shared])
    return named, _closest(found, k, "lead", *shared).join(few.drop("qvec"), ["lead", *shared])


def _closest(found: DataFrame, k: int, *of: str) -> DataFrame:
    w = Window.partitionBy(*of).orderBy(F.asc_nulls_last("dist"), "doc_id")
    return found.withColumn("near", F.row_number().over(w)).where(F.col("near") <= k)


def nearest(questions: DataFrame, docs: DataFrame, k: int = FETCH, on: str | None = None) -> DataFrame:
    """(query_id, doc_id, dist, near): the k docs (doc_id, vec) closest to each of questions (query_id, qvec), see searched_once()."""
    shared = [on] if on else []
    named, found = searched_once(questions.select("query_id", "qvec", *shared), docs, k, on)
    found = named.select("query_id", "lead", *shared).join(found, ["lead", *shared]).select("query_id", "doc_id", "dist", "near")
    return _closest(found, k, "query_id") if on else found


def met(named: DataFrame, found: DataFrame) -> DataFrame:
    """Each of named (lead, led, query_id, and more) with each row of found (lead, led, and more) that has its lead.

    Questions of a lead are dealt into parts of about PART, and what was found, with its texts, goes once to each part: neither a lead nor a doc
    is a key that one task must serve whole, and no question is sent once for each doc.
    """
    asked, given = _dealt(named, found, PART, TASK)
    return asked.join(given.hint("shuffle_hash"), ["lead", "part"]).drop("lead", "part")


def _dealt(named: DataFrame, found: DataFrame, part: int, task: int) -> tuple[DataFrame, DataFrame]:
    """named and found, each by lead and part; parts have about `part` questions, tasks `task`."""
    parts = F.ceil(F.col("led") / part)
    tasks = max(1, -(-named.count() // task))  # the work is in the pairs, not in the bytes that are sent
    asked = named.withColumn("part", F.pmod(F.xxhash64("query_id"), parts)).drop("led")
    given = found.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("led")
    return asked.repartition(tasks, "lead", "part"), given.repartition(tasks, "lead", "part")


def shares(named: DataFrame, found: DataFrame, within: dict[str, tuple[str, str]]) -> DataFrame:
    """Each of named with each row of found that has its lead, as met() gives them, and as each name of `within` (terms, low) the share of terms, an array of named,
    that low, a text of found in lower case, holds: see share_within(). Terms and texts don't go on.

    Of a part, each distinct term is looked for once in a text, and only if the text has all runs of three bytes that the term has; questions then sum what their terms found.
    """
    terms, texts = sorted({a for a, _ in within.values()}), sorted({b for _, b in within.values()})
    of_asked, of_found = [f for f in named.schema if f.name not in (*terms, "lead", "led")], [f for f in found.schema if f.name not in (*texts, "lead", "led")]
    asked = named.select("led", "lead", *[f.name for f in of_asked], *[F.transform(a, lambda x: F.lower(x).cast("binary")).alias(a) for a in terms])
    given = found.select("led", "lead", *[f.name for f in of_found], *[F.col(b).cast("binary").alias(b) for b in texts])
    schema = StructType([*of_asked, *of_found, *[StructField(n, DoubleType()) for n in within]])

    def grams(text: bytes) -> np.ndarray:
        """Runs of three bytes, by six bits of each; those after the end, of zeros, do no harm."""
        b = np.frombuffer(text + b"\0\0\0", dtype=np.uint8).astype(np.int32) & 63
        return b[:-2] << 12 | b[1:-1] << 6 | b[2:]

    def shared(asked: pa.ListArray, told: list[bytes | None]) -> pa.Array:
        """The share of each of asked in each of told; null for null terms."""
        n = pc.list_value_length(asked).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        code = asked.flatten().dictionary_encode()
        every = code.dictionary.to_pylist()
        holds = np.zeros((len(every) + 1, len(told)), dtype=np.int64)  # the last row: a null term is in no text
        size = np.array([len(term) for term in every], dtype=np.int64)
        begin, wanted = np.cumsum(size) - size, grams(b"".join(every))
        cut, seen = np.maximum(np.stack([begin, begin + size - 2], axis=1), 0).ravel(), np.zeros(1 << 18, dtype=bool)
        for j, text in enumerate(told):
            if text is not None and every:
                own = grams(text)
                seen[own] = True
                maybe = (size < 3) | np.logical_and.reduceat(seen[wanted], cut)[::2]
                seen[own] = False
                for i in np.flatnonzero(maybe):
                    holds[i, j] = every[i] in text
        upto = np.zeros((len(code) + 1, len(told)), dtype=np.int64)
        np.cumsum(holds[code.indices.fill_null(len(every)).to_numpy(zero_copy_only=False)], axis=0, out=upto[1:])
        end = np.cumsum(n)
        share = (upto[end] - upto[end - n]) / np.maximum(n, 1)[:, None]
        return pa.array(share.ravel(), mask=np.repeat(np.asarray(asked.is_null()), len(told)))

    def run(q: pa.Table, d: pa.Table) -> pa.Table:
        row, doc = pa.array(np.repeat(np.arange(len(q)), len(d))), pa.array(np.tile(np.arange(len(d)), len(q)))
        out = {f.name: q[f.name].take(row) for f in of_asked} | {f.name: d[f.name].take(doc) for f in of_found}
        for name, (a, b) in within.items():
            out[name] = shared(q[a].combine_chunks(), d[b].to_pylist())
        return pa.table(out)

    asked, given = _dealt(asked, given, SHARED, SHARED_TASK)
    return asked.groupBy("lead", "part").cogroup(given.groupBy("lead", "part")).applyInArrow(run, schema)


def _near_docs(docs: DataFrame, asked: dict, k: int, on: str | None, id_type: DataType) -> DataFrame:
    """(query_id, doc_id, dist, and `on` if given) of the docs that may be among the k closest to a question; dist isn't rounded. asked: [(query_id, qvec)] by value of `on`."""
    groups = {v: ([q for q, _ in own], np.array([x for _, x in own], dtype=np.float64)) for v, own in asked.items()}
    shared = docs.sparkSession.sparkContext.broadcast(groups)
    fields = [StructField("query_id", id_type), StructField("doc_id", docs.schema["doc_id"].dataType), StructField("dist", DoubleType()), *([docs.schema[on]] if on else [])]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        total = np.zeros(len(q))
        for i in range(q.shape[1]):
            total = total + q[:, i] * v[:, i]
        return 1 - total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {}  # of each group: (rows of questions, docs, distances) that may still be among the best
        step = max(64, TOGETHER // max(1, sum(len(v) for _, v in shared.value.values())))
        for b in (x.slice(i, step) for x in batches for i in range(0, len(x), step)):
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(b), -1)
            ids, values = b.column(0).to_numpy(zero_copy_only=False), np.array(b.column(2).to_pylist(), dtype=object) if on else None
            for value, (_, vectors) in shared.value.items():
                mine = np.flatnonzero(values == value) if on else np.arange(len(b))
                if not len(mine):
                    continue
                near = 1 - vectors @ x[mine].T
                row, doc, dist, bound = best.get(value) or (np.zeros(0, np.int64), ids[:0], np.zeros(0), np.full(len(vectors), np.inf))
                if len(mine) > k:
                    bound = np.minimum(bound, np.partition(near, k - 1, axis=1)[:, k - 1])
                r, c = np.nonzero(~(near > (bound + NEAR)[:, None]))
                row, doc, dist = np.concatenate([row, r]), np.concatenate([doc, ids[mine][c]]), np.concatenate([dist, exact(vectors[r], x[mine[c]])])
                order = np.lexsort((dist, row))
                row, doc, dist = row[order], doc[order], dist[order]
                starts = np.searchsorted(row, np.arange(len(vectors)))
                full = np.flatnonzero(np.diff(np.append(starts, len(row))) >= k)
                bound[full] = np.minimum(bound[full], dist[starts[full] + k - 1])
                keep = ~(dist > bound[row] + NEAR)
                best[value] = row[keep], doc[keep], dist[keep], bound
        for value, (row, doc, dist, _) in best.items():
            names = pa.array(shared.value[value][0], kinds[0])
            columns = [names.take(pa.array(row)), pa.array(doc, kinds[1]), pa.array(dist), *([pa.array([value] * len(row), kinds[3])] if on else [])]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return docs.mapInArrow(run, StructType(fields))


def ranked(scored: DataFrame, *order: Column | str) -> DataFrame:
    """scored with rank by score ascending in each query."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", *(order or ("session_id",)))).cast("long"))


def two_pass(scored: DataFrame, twice: Column | None = None) -> DataFrame:
    """(query_id, session_id, rank): the five closest by dist, re-ranked by score; then the others by session. scored: query_id, session_id, dist, score.

    twice: the queries for which this holds, by default all; the others are ranked by score alone.
    """
    near = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "session_id"))
    late = (near > 5).cast("int")
    s = scored.withColumn("late", late if twice is None else F.when(twice, late).otherwise(0))
    w = Window.partitionBy("query_id").orderBy("late", F.when(F.col("late") == 0, F.col("score")), "session_id")
    return s.select("query_id", "session_id", F.row_number().over(w).cast("long").alias("rank"))


def best_per_session(scored: DataFrame) -> DataFrame:
    """The best (smallest) score of each query and session."""
    return scored.groupBy("query_id", "session_id").agg(F.min("score").alias("score"))


def first_items(items: DataFrame, most: int | None = None) -> DataFrame:
    """items (query_id, category): the `most` smallest of each category, by default all."""
    if most is None:
        return items
    place = F.row_number().over(Window.partitionBy("category").orderBy("query_id"))
    return items.withColumn("place", place).where(F.col("place") <= most).drop("place")


def metrics(ranking: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Recall of any and all gold sessions and nDCG at each k, by query. The ideal order is that of the retrieved relevances.

    ranking: query_id, session_id, rank; gold: query_id, session_id.
    """
    r = ranking.where(F.col("rank") <= max(ks)).join(gold.select("query_id", "session_id", F.lit(1.0).alias("rel")).distinct(), ["query_id", "session_id"], "left").fillna(0.0, ["rel"])
    n = gold.distinct().groupBy("query_id").agg(F.count("*").alias("n_gold"))
    out = []
    for k in ks:
        at = F.col("rank") <= k
        hit = F.sum(F.when(at, F.col("rel")).otherwise(0.0))
        gain = F.sum(F.when(at, F.col("rel") / F.log2(F.col("rank") + 1)).otherwise(0.0))
        out += [hit.alias(f"hits_{k}"), gain.alias(f"dcg_{k}")]
    g = n.join(r.groupBy("query_id").agg(*out), "query_id", "left").fillna(0.0)
    ideal = lambda h: F.aggregate(F.sequence(F.lit(1), F.greatest(h.cast("int"), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    columns = []
    for k in ks:
        h = F.col(f"hits_{k}")
        columns += [(h > 0).cast("double").alias(f"any_{k}"), (h >= F.col("n_gold")).cast("double").alias(f"all_{k}"), F.when(h == 0, 0.0).otherwise(F.round(F.col(f"dcg_{k}") / ideal(h), 6)).alias(f"ndcg_{k}")]
    return g.select("query_id", *columns)


def answer_tokens(text: Column) -> Column:
    """Lower-case words without articles and punctuation, repeats kept."""
    t = F.regexp_replace(F.regexp_replace(text, ",", ""), r"\b(a|an|the|and)\b", " ")
    t = F.trim(F.lower(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"[!-/:-@\[-`{-~]", "")))
    return F.filter(F.split(t, " +"), lambda w: w != "")


def multiset_f1(rows: DataFrame, key: str) -> DataFrame:
    """(key, f1) of rows (key, a, b: token arrays): shared tokens count as often as both sides have them; two empty sides are equal, null ones give null.

    Both sides of a row are counted where it lies, a slice of rows at a time; no token is shuffled.
    """
    given = rows.schema[key]

    def counted(side: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        n = pc.list_value_length(side).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return n, np.repeat(np.arange(len(side)), n), side.flatten()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, ROWS) for x in batches for i in range(0, len(x), ROWS)):
            (na, ra, a), (nb, rb, c) = counted(b.column(1)), counted(b.column(2))
            code = pa.concat_arrays([a, c]).dictionary_encode()
            width, at = len(code.dictionary) + 1, code.indices.fill_null(len(code.dictionary)).to_numpy().astype(np.int64)
            ka, ca = np.unique(ra * width + at[: len(a)], return_counts=True)
            kb, cb = np.unique(rb * width + at[len(a) :], return_counts=True)
            both, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
            known = both % width < width - 1  # nulls equal nothing
            same = np.bincount((both // width)[known], np.minimum(ca[i], cb[j])[known], len(b))
            none = (na == 0) | (nb == 0)
            f1 = np.where(none, na == nb, 2 * same / np.maximum(na + nb, 1))
            unknown = np.asarray(pc.or_(b.column(1).is_null(), b.column(2).is_null()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f1, mask=unknown)], [key, "f1"])

    f1 = rows.select(key, "a", "b").mapInArrow(run, StructType([given, StructField("f1", DoubleType())]))
    return f1.select(key, F.round("f1", 6).alias("f1"))


#: F1 under which an answer has failed, and from which on it is right.
FAILED, RIGHT = 0.3, 0.5


def emitted_labels(results: DataFrame) -> DataFrame:
    """results with label_id and winning: training labels of answered questions (question, f1, selected, gold: arrays of anchors, and any other columns).

    With gold anchors the winning ones are those that were selected, in order; maybe none. Without them a failed answer has none, a right one
    all that were selected, and what lies between gives no label. Null arrays are empty.
    """
    none = F.array().cast("array<int>")
    selected, gold = F.array_sort(F.array_distinct(F.coalesce("selected", none))), F.coalesce("gold", none)
    winning = F.when(F.size(gold) > 0, F.array_intersect(selected, gold)).when(F.col("f1") < FAILED, none).when(F.col("f1") >= RIGHT, selected)
    label = F.concat(F.lit("q_"), F.substring(F.md5("question"), 1, 8))
    return results.withColumns({"label_id": label, "winning": winning}).where("winning is not null")
