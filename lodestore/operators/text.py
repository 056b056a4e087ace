"""Chunks, retention, regex facets, entities, spelling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestore.functions import first_of, total
from lodestore.sources.files import stored

#: Facet patterns.
CAMEL = r"\b[A-Z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*\b"
URL = r"https?://[^ \t\n\r]+"
MENTION = r"@[A-Za-z][A-Za-z0-9_.-]+"
PATH = r"[a-zA-Z0-9_.-]+/[a-zA-Z0-9_./:-]+"
ISO_DATE = r"\b(\d{4}-\d{2}(?:-\d{2})?)\b"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
RELATIVE = r"\b(?:last\s+(?:week|month|year|quarter)|yesterday|today|this\s+(?:week|month|year|quarter)|Q[1-4])\b"
STANCES = {
    "switched": r"\b(switched|migrated|moved|transitioned)\s+(to|from|away)\b",
    "stopped": r"\b(stopped\s+using|no\s+longer\s+using|abandoned|dropped)\b",
    "deprecated": r"\b(deprecated|obsolete|legacy|removed)\b",
    "failed": r"\b(failed|broke|broken|crashing|crash)\b",
    "fixed": r"\b(fixed|resolved|patched|repaired)\b",
    "prefers": r"\b(prefer[s]?|recommend[s]?|suggest[s]?|advocate[s]?)\b",
}
ACTOR = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s+(?:said|told|mentioned|suggested|noted|added|explained|asked|replied)\b"
#: Boundaries of sections by kind of text.
BOUNDARY = {"code": r"\n(?=class |def |async def )", "conversation": r"\n(?=Human:|User:|>)", "prose": r"\n(?=#{1,3} )|\n(?=\n)"}
RETENTION, DUPLICATE = 0.65, 0.92
#: Vectors of a tile that is compared whole.
TILE = 4096
#: Texts that are cut into a hierarchy at a time.
TEXTS = 64


def sections(docs: DataFrame, kind: str) -> DataFrame:
    """(doc_id, start, text): segments between boundaries with their offsets, blank ones left out; the boundary belongs to what follows."""
    cuts = F.split("text", BOUNDARY[kind])
    s = docs.select("doc_id", F.posexplode(cuts).alias("i", "part"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("start", F.coalesce(F.sum(F.length("part") + 1).over(w), F.lit(0)))
    s = s.select("doc_id", F.when(F.col("i") > 0, F.col("start") - 1).otherwise(0).alias("start"), F.concat(F.when(F.col("i") > 0, "\n").otherwise(""), "part").alias("text"))
    return s.where(F.regexp_replace("text", r"\s", "") != "")


def token_windows(text: str, size: int, overlap: int = 40, compat: bool = False) -> list[tuple[int, str]]:
    """(start, window) of `size` characters that end at a sentence past their middle. compat: go on one by one after the text's end."""
    if len(text) <= size:
        return [(0, text)]
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text) and (at := text.rfind(". ", start, end)) > start + size // 2:
            end = at + 2
        if text[start:end].strip():
            out.append((start, text[start:end]))
        if end == len(text) and not compat:
            break
        start = max(start + 1, end - overlap)
    return out


def hierarchy(docs: DataFrame, mid: int = 450 * 4, fine: int = 180 * 4) -> DataFrame:
    """(doc_id, chunk, level, parent, start, text): sections, windows of about 450 tokens in them, and of 180 in those; one index a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a few texts at a time, so that what a task holds doesn't grow with its batches
        for b in (x.slice(i, TEXTS) for x in batches for i in range(0, len(x), TEXTS)):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, at = 0, 0
                for part in (text or "").split("\n\n"):
                    if part.strip():
                        section, n = n, n + 1
                        rows.append((doc, section, "section", None, at, part))
                        for s, m in token_windows(part, mid):
                            middle, n = n, n + 1
                            rows.append((doc, middle, "mid", section, at + s, m))
                            for f, x in token_windows(m, fine):
                                rows.append((doc, n, "fine", middle, at + s + f, x))
                                n += 1
                    at += len(part) + 2
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)

    made = "doc_id long, chunk long, level string, parent long, start long, text string"
    out = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in made.split(", ")])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, made)


def chunk_kind(source_type: Column, path: Column) -> Column:
    return first_of((source_type == "conversation", "conversation"), (path.rlike(r"\.(py|js|ts|tsx|jsx|go|rs|java|rb)$"), "code"), default=F.lit("prose"))


def retained(kind: Column, score: Column, title: Column, body: Column) -> Column:
    """Score at the threshold; beyond procedural, failure and tool_use also text of 30 characters."""
    return (score >= RETENTION) & (kind.isin("procedural", "failure", "tool_use") | (F.length(F.trim(F.concat(body, F.lit(" "), title))) >= 30))


def evidence(memories: DataFrame, chunks: DataFrame) -> DataFrame:
    """(memory, spans): offsets of the named chunks; the whole source if none is known. memories: memory, ids, n_chars."""
    named = memories.select("memory", F.posexplode("ids").alias("i", "chunk_id")).join(chunks, "chunk_id")
    spans = named.groupBy("memory").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "start_offset", "end_offset"))), lambda s: F.struct(s["start_offset"].alias("start_offset"), s["end_offset"].alias("end_offset"))).alias("spans"))
    whole = F.array(F.struct(F.lit(0).alias("start_offset"), F.col("n_chars").cast("int").alias("end_offset")))
    return memories.join(spans, "memory", "left").select("memory", F.coalesce("spans", whole).alias("spans"))


def near_pairs(memories: DataFrame, least: float = DUPLICATE, rows: int = TILE) -> DataFrame:
    """(late, early): each two memories of one kind whose cosine reaches `least`, by id. memories: memory long, kind, vec (unit vectors).

    Vectors are dealt into tiles of about `rows`; each two tiles of a kind are compared in a task of their own as matrices, and
    only near pairs leave it. Exact, and quadratic in the memories of a kind, as a comparison with the whole store is;
    near_duplicates_lsh() is for stores where that is too much.
    """
    n = max(1, -(-memories.count() // rows))
    kind = F.col("kind").cast("string").alias("kind")
    tiled = memories.where("vec is not null").select(F.col("memory").cast("long").alias("memory"), kind, F.col("vec").cast("array<double>").alias("vec"), F.pmod(F.xxhash64("memory"), F.lit(n)).cast("int").alias("tile"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"kind": [key[0]], "tile": [key[1]], "ids": [pdf["memory"].to_numpy(np.int64).tobytes()], "vecs": [np.stack(pdf["vec"]).tobytes()]})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        tiles = [(np.frombuffer(r.ids, np.int64), np.frombuffer(r.vecs, np.float64)) for r in pdf.sort_values("tile").itertuples()]
        if len(tiles) == 1 and pdf["a"].iloc[0] != pdf["b"].iloc[0]:  # the other tile of this pair is empty
            return pd.DataFrame({"late": [], "early": []}, dtype="int64")
        (i, x), (j, y) = tiles[0], tiles[-1]
        a, b = np.nonzero(x.reshape(len(i), -1) @ y.reshape(len(j), -1).T >= least)
        a, b = i[a], j[b]
        keep = a > b if len(tiles) == 1 else a != b
        return pd.DataFrame({"late": np.maximum(a, b)[keep], "early": np.minimum(a, b)[keep]})

    packed = tiled.groupBy("kind", "tile").applyInPandas(pack, "kind string, tile int, ids binary, vecs binary")
    other = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("kind", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "ids", "vecs")
    return other.groupBy("kind", "a", "b").applyInPandas(compare, "late long, early long")


def near_duplicates(memories: DataFrame, least: float = DUPLICATE) -> DataFrame:
    """(memory, duplicate_of): memories in the order of their ids, each against all earlier ones of its kind that aren't duplicates themselves; the newest that is near enough.

    memories: memory long, kind, vec (unit vectors).
    """
    return kept_first(near_pairs(memories, least))


def kept_first(pairs: DataFrame) -> DataFrame:
    """(memory, duplicate_of) of pairs (late, early): late is a duplicate if any of its early ones isn't, of the last of these.

    All that can be decided is decided in each round, over all chains at once; there are as many rounds as the longest chain of
    doubts, a few in practice.
    """
    spark = pairs.sparkSession
    edges = stored(spark, pairs.distinct(), "duplicate-pairs")
    late, early = edges.select(F.col("late").alias("m")).distinct(), edges.select(F.col("early").alias("m")).distinct()
    kept, gone, open_ = early.join(late, "m", "left_anti"), None, late
    while True:
        kept = stored(spark, kept, "duplicate-kept")
        hit = edges.join(kept.withColumnRenamed("m", "early"), "early", "left_semi").select(F.col("late").alias("m")).distinct()
        gone = stored(spark, hit, "duplicate-gone")
        left = stored(spark, open_.join(gone, "m", "left_anti").join(kept, "m", "left_anti"), "duplicate-open")
        if left.isEmpty():
            break
        waits = edges.join(left.withColumnRenamed("m", "early"), "early", "left_semi").select(F.col("late").alias("m")).distinct()
        kept, open_ = kept.unionByName(left.join(waits, "m", "left_anti")), left
    sure = edges.join(kept.withColumnRenamed("m", "early"), "early", "left_semi")
    return sure.groupBy(F.col("late").alias("memory")).agg(F.max("early").alias("duplicate_of"))


def near_duplicates_lsh(memories: DataFrame, least: float = DUPLICATE, tables: int = 8) -> DataFrame:
    """near_duplicates() for any number of memories (memory, kind, vec): pairs that meet in a bucket of random projections, checked exactly.

    On unit vectors a cosine is a distance, sqrt(2 - 2 cos); buckets are four distances wide. More tables find more.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    away = math.sqrt(2 - 2 * least)
    v = memories.select("memory", "kind", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=4 * away, numHashTables=tables, seed=7).fit(v)
    pairs = model.approxSimilarityJoin(v, v, away + 1e-9, "distance")
    near = pairs.where("datasetA.kind = datasetB.kind and datasetA.memory > datasetB.memory")
    return kept_first(near.select(F.col("datasetA.memory").alias("late"), F.col("datasetB.memory").alias("early")))


def facet_entities(text: Column) -> Column:
    """Sorted distinct CamelCase words, quoted strings, paths, URLs and mentions."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in ((CAMEL, 0), ('"([^"]+)"', 1), ("'([^']+)'", 1), (PATH, 0), (URL, 0), (MENTION, 0))]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def mentioned_at(text: Column) -> Column:
    """An ISO date, else a month with a year, else a relative mark."""
    first = lambda p, g: F.nullif(F.regexp_extract(text, p, g), F.lit(""))
    return F.coalesce(first(ISO_DATE, 1), first(rf"\b(?:{MONTHS})\s+\d{{4}}\b", 0), first("(?i)" + RELATIVE, 0))


def speaker_role(text: Column) -> Column:
    return F.when(text.rlike(r"(^|\n)>\s"), "user").otherwise("assistant")


def stance(text: Column) -> Column:
    return first_of(*[(text.rlike("(?i)" + p), s) for s, p in STANCES.items()])


def actors(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ACTOR), F.lit(1)))


def candidates(docs: DataFrame, common: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, name, n): capitalised words, and phrases of them, of which no word is common (word), that come `least` times in a document."""
    one = F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z]{1,19})\b"), F.lit(1))
    many = F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"), F.lit(1))
    counted = docs.select("doc_id", F.explode(F.concat(one, many)).alias("name")).groupBy("doc_id", "name").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    words = counted.select("name").distinct().select("name", F.explode(F.split(F.lower("name"), r"\s+")).alias("word"))
    return counted.join(words.join(common, "word", "left_semi").select("name").distinct(), "name", "left_anti").select("doc_id", "name", "n")


def known_people(queries: DataFrame, people: DataFrame) -> DataFrame:
    """(query_id, name): people (name, alias) of whom an alias stands in a query (query_id, query) as whole words, in any case.

    A query's words lead to the aliases that begin with one of them; only these are looked for.
    """
    first = F.regexp_extract(F.lower("alias"), r"[\p{L}\p{N}_]+", 0)
    words = queries.select("query_id", "query", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))).alias("w"))
    found = words.join(people.select("name", "alias", first.alias("w")), "w")
    whole = F.concat(F.lit(r"(?iU)\b\Q"), "alias", F.lit(r"\E\b"))
    return found.where(F.rlike("query", whole)).select("query_id", "name").distinct()


def classified(signals: DataFrame) -> DataFrame:
    """signals with type and confidence. kinds, how many kinds of signals tell of a person, are those that occur if signals don't say."""
    ps = 3 * F.col("dialogue") + 2 * F.col("action") + 2 * F.col("pronoun") + 4 * F.col("direct")
    prs = 2 * F.col("project") + 3 * F.col("versioned") + 3 * F.col("code")
    kinds = total([(F.col(c) > 0).cast("int") for c in ("dialogue", "action", "pronoun", "direct")])
    none, person = F.col("person_score") + F.col("project_score") == 0, F.col("ratio") >= 0.7
    sure = person & (F.col("kinds") >= 2) & (F.col("person_score") >= 5)
    s = signals.withColumns({"person_score": ps, "project_score": prs} | ({} if "kinds" in signals.columns else {"kinds": kinds}))
    s = s.withColumn("ratio", F.when(none, 0.5).otherwise(F.try_divide(F.col("person_score"), F.col("person_score") + F.col("project_score"))))
    kind = first_of((none, "uncertain"), (sure, "person"), (person, "uncertain"), (F.col("ratio") <= 0.3, "project"), default=F.lit("uncertain"))
    confidence = F.when(none, F.least(F.lit(0.4), F.col("n") / 50)).when(sure, F.least(F.lit(0.99), 0.5 + F.col("ratio") * 0.5)).when(person, 0.4).when(F.col("ratio") <= 0.3, F.least(F.lit(0.99), 0.5 + (1 - F.col("ratio")) * 0.5)).otherwise(0.5)
    return s.withColumns({"type": kind, "confidence": F.round(confidence, 2)})


def top_entities(entities: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The surest of each type, up to its cap."""
    w = Window.partitionBy("type").orderBy(F.desc("confidence"), F.desc("n"), "doc_id", "name")
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    first = entities.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(caps.values()))  # a literal bound: each task keeps its first rows alone
    return first.where(F.col("rank") <= cap[F.col("type")]).withColumn("rank", F.col("rank").cast("long"))


def lookup(words: DataFrame, people: DataFrame, projects: DataFrame, confirmed: DataFrame) -> DataFrame:
    """word, type, name, confidence: people (name, alias, confidence) before projects (name) before confirmed words (name, type, confidence)."""
    key = F.lower("word")
    p = people.select(F.lower("alias").alias("_k"), F.col("name").alias("p"), F.col("confidence").alias("pc")).dropDuplicates(["_k"])
    j = projects.select(F.lower("name").alias("_k"), F.col("name").alias("j")).dropDuplicates(["_k"])
    c = confirmed.select(F.lower("name").alias("_k"), F.col("type").alias("ct"), F.col("confidence").alias("cc")).dropDuplicates(["_k"])
    w = words.withColumn("_k", key).join(p, "_k", "left").join(j, "_k", "left").join(c, "_k", "left")
    kind = F.when(F.col("p").isNotNull(), "person").when(F.col("j").isNotNull(), "project").when(F.col("ct").isNotNull(), F.col("ct")).otherwise("unknown")
    sure = F.when(F.col("p").isNotNull(), F.col("pc")).when(F.col("j").isNotNull(), 1.0).otherwise(F.coalesce("cc", F.lit(0.0)))
    return w.select(*words.columns, kind.alias("type"), F.coalesce("p", "j", "word").alias("name"), sure.alias("confidence"))


#: Contexts of a name used for a person.
PERSON_CONTEXT = (
    r"\b{name}\s+said\b",
    r"\b{name}\s+told\b",
    r"\b{name}\s+asked\b",
    r"\b{name}\s+laughed\b",
    r"\b{name}\s+smiled\b",
    r"\b{name}\s+was\b",
    r"\b{name}\s+is\b",
    r"\b{name}\s+called\b",
    r"\b{name}\s+texted\b",
    r"\bwith\s+{name}\b",
    r"\bsaw\s+{name}\b",
    r"\bcalled\s+{name}\b",
    r"\btook\s+{name}\b",
    r"\bpicked\s+up\s+{name}\b",
    r"\bdrop(?:ped)?\s+(?:off\s+)?{name}\b",
    r"\b{name}(?:'s|s')\b",
    r"\bhey\s+{name}\b",
    r"\bthanks?\s+{name}\b",
    r"^{name}[:\s]",
    r"\bmy\s+(?:son|daughter|kid|child|brother|sister|friend|partner|colleague|coworker)\s+{name}\b",
)
#: Contexts of a word that isn't used as a name.
CONCEPT_CONTEXT = (
    r"\bhave\s+you\s+{name}\b",
    r"\bif\s+you\s+{name}\b",
    r"\b{name}\s+since\b",
    r"\b{name}\s+again\b",
    r"\bnot\s+{name}\b",
    r"\b{name}\s+more\b",
    r"\bwould\s+{name}\b",
    r"\bcould\s+{name}\b",
    r"\bwill\s+{name}\b",
    r"(?:the\s+)?{name}\s+(?:of|in|at|for|to)\b",
)


def disambiguated(word: Column, context: Column) -> Column:
    """(type, confidence) of a word that is both a name and a common word; equal counts leave it a person without more confidence."""
    hit = lambda p: F.rlike(F.lower(context), F.replace(F.lit(p), F.lit("{name}"), F.lower(word))).cast("int")
    person, concept = total([hit(p) for p in PERSON_CONTEXT]), total([hit(p) for p in CONCEPT_CONTEXT])
    return F.struct(F.when(concept > person, "concept").otherwise("person").alias("type"), F.round(F.when(person > concept, F.least(F.lit(0.95), 0.7 + person * 0.1)).when(concept > person, F.least(F.lit(0.90), 0.7 + concept * 0.1)).otherwise(0.7), 4).alias("confidence"))


def spelling_skipped(token: Column, known: Column) -> Column:
    """Whether a token is left as it is: short, digits, CamelCase, capitals, - or _, URL-like, code, or a known name (array)."""
    rules = (r"\d", r"[A-Z][a-z]+[A-Z]", r"^[A-Z_@#$%^&*()+=\[\]{}|<>?.:/\\]+$", r"[-_]", r"(?i)https?://|www\.|/Users/|~/|\.[a-z]{2,4}$", r"[`*_#{}\[\]\\]")
    out = F.length(token) < 4
    for r in rules:
        out = out | token.rlike(r)
    return out | F.array_contains(known, F.lower(token)) | token.rlike("^[A-Z]")


def corrections(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(token, word, edits): the closest dictionary word (word, n) with two edits at most, three for tokens of over 7 letters; the commonest of equals.

    A word cut into one piece more than there may be edits has a piece that no edit touches. Tokens and words meet
    on such a piece, shifted by no more than the edits, so no word within them is missed. Tokens in the dictionary aren't corrected.
    """
    size, edits = F.length("word"), F.col("most")
    cut = lambda i, n, parts: F.floor(i * n / parts).cast("int")
    d = dictionary.select("word", "n", F.explode(F.array(F.lit(2), F.lit(3))).alias("most")).select("*", size.alias("size"), F.explode(F.sequence(F.lit(0), edits)).alias("i"))
    begin, end = cut(F.col("i"), F.col("size"), edits + 1), cut(F.col("i") + 1, F.col("size"), edits + 1)
    d = d.withColumns({"begin": begin, "end": end}).select("word", "n", "most", "size", "i", F.substring("word", F.col("begin") + 1, F.col("end") - F.col("begin")).alias("piece"))
    t = tokens.join(dictionary.select(F.col("word").alias("token")), "token", "left_anti").withColumn("most", F.when(F.length("token") <= 7, 2).otherwise(3))
    t = t.withColumn("size", F.explode(F.sequence(F.greatest(F.length("token") - edits, F.lit(1)), F.length("token") + edits))).withColumn("i", F.explode(F.sequence(F.lit(0), edits)))
    t = t.withColumns({"begin": begin, "end": end}).withColumn("at", F.explode(F.sequence(F.col("begin") - edits, F.col("begin") + edits)))
    t = t.where((F.col("at") >= 0) & (F.col("at") + F.col("end") - F.col("begin") <= F.length("token")))
    t = t.select("token", "most", "size", "i", F.substring("token", F.col("at") + 1, F.col("end") - F.col("begin")).alias("piece")).distinct()
    near = t.join(d, ["most", "size", "i", "piece"]).select("token", "word", "n", "most").distinct()
    near = near.withColumn("edits", F.levenshtein("token", "word")).where(F.col("edits") <= F.col("most"))
    w = Window.partitionBy("token").orderBy("edits", F.desc("n"), "word")
    return near.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("token", "word", F.col("edits").cast("long").alias("edits"))
