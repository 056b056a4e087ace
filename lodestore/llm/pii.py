"""Personal data: found by form, then terms by what they disclose, all over the corpus.

The protected entities are what the base kinds find: each kind as a whole, and each value that enough different
texts hold. Co-occurrence is that of documents. For a term t and an entity e the corpus tells how strongly t
reveals e: the pointwise mutual information log2(N n(e,t) / (n(e) n(t))) over the information of the entity,
log2(N / n(e)); n counts documents. The ratio is 1 if t never occurs without e. A term whose ratio reaches the
threshold for any entity, in enough different texts, is disclosing wherever it stands, also where the entity
itself isn't written (after Sanchez and Batet's C-sanitised documents). It is replaced by the nearest of its
generalisations that discloses nothing: its beginning, then what it is made of; it is removed if both disclose.
Counts are taken over all documents.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.common import stored

#: Kinds in their listed order; terms come last.
KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")

#: Different texts that must show a pair; share of an entity's information from which a term discloses it.
SUPPORT, THRESHOLD = 3, 0.8
#: Letters of a term's beginning, its first generalisation.
BEGINNING = 3
#: Words and generalisations are broadcast up to so many; beyond, both sides are shuffled.
BROADCAST_TERMS = 200_000
#: Documents that a task holds as Python objects at a time.
DOCS = 500
#: Units that a task counts before it hands its counts on.
MOST_UNITS = 400_000


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, sorted; leftmost and non-overlapping in each kind, failing matches dropped."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:  # each @ with the local part before it that no earlier match has taken; the same as a regex's leftmost matches, in linear time
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def span_string(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def generalisations(term: str) -> tuple[str, str]:
    """What a term can be generalised to, the nearest first: its beginning, and what it is made of."""
    return term[:BEGINNING] + "*", "[NUMBER]" if term.isdigit() else "[CODE]" if any(c.isdigit() for c in term) else "[WORD]"


class Units:
    """The units of texts: distinct terms, and their generalisations, which are remembered by word."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[str, str, str]] = {}

    def terms(self, words: Iterable[str]) -> tuple[set[str], set[str]]:
        """(terms, generalisations) of words as they are written."""
        if len(self.known) > MOST_UNITS:
            self.known.clear()
        terms, wide = set(), set()
        for w in set(words):
            found = self.known.get(w)
            if found is None:
                low = w.lower()
                found = self.known[w] = (low, *generalisations(low))
            terms.add(found[0])
            wide.update(found[1:])
        return terms, wide


def outside(text: str, covered: list[tuple[int, int]]) -> Iterator[re.Match]:
    """The words of text that touch none of covered (start, end), which come by start."""
    k, reach = 0, -1
    for m in WORD.finditer(text):
        while k < len(covered) and covered[k][0] < m.end():
            reach, k = max(reach, covered[k][1]), k + 1
        if m.start() >= reach:
            yield m


ENTITIES = "texthash long, entities array<string>, units array<string>"


def find_entities(docs: DataFrame) -> DataFrame:
    """ENTITIES of each document that holds any: kinds, and values as kind and SHA-1, so that values don't travel; the document's units outside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units()
        for b in (x.slice(i, DOCS) for x in batches for i in range(0, len(x), DOCS)):
            rows = []
            for text in b.column(0).to_pylist():
                if text and (spans := base_spans(text)):
                    raw = text.encode("utf-8", "surrogatepass")
                    values = {f"{KINDS[k]}:{hashlib.sha1(text[s:e].encode('utf-8', 'surrogatepass')).hexdigest()[:20]}" for s, k, e in spans}
                    rows.append((xxhash.xxh64_intdigest(raw) - (1 << 63), sorted(values | {KINDS[k] for _, k, _ in spans}), sorted(set().union(*units.terms(m[0] for m in outside(text, [(s, e) for s, _, e in spans]))))))
            h, e, u = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(e, pa.list_(pa.string())), pa.array(u, pa.list_(pa.string()))], ["texthash", "entities", "units"])

    return docs.select("text").mapInArrow(run, ENTITIES)


def unit_counts(docs: DataFrame, wanted: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """(u, n_u): documents of docs that hold each unit of wanted (u, each once). Units are counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        units = Units()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["u", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                for own in units.terms(WORD.findall(text or "")):
                    counts.update(own)
                if len(counts) > MOST_UNITS:  # bounded memory: hand on and begin anew
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    found = docs.select("text").mapInArrow(run, "u string, n long")
    small = wanted.count() <= most
    return found.join(F.broadcast(wanted) if small else wanted, "u", "left_semi").groupBy("u").agg(F.sum("n").alias("n_u"))


def disclosures(docs: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD, most: int = BROADCAST_TERMS) -> DataFrame:
    """(e, u, ratio) of the entities and units whose disclosure ratio reaches threshold and that `support` different texts show together.

    Copies of a text are counted as documents, but support the pair once. Values that fewer texts hold can't reach
    the support with any unit and are left out before pairs are made.
    """
    found = stored(find_entities(docs), "pii-entities")
    texts = stored(found.groupBy("texthash").agg(F.count("*").alias("n"), F.first("entities").alias("entities"), F.first("units").alias("units")), "pii-texts")
    held = texts.select("texthash", "n", F.explode("entities").alias("e"))
    n_e = stored(held.groupBy("e").agg(F.sum("n").alias("n_e"), F.count("*").alias("texts")).where(F.col("texts") >= support).select("e", "n_e"), "pii-held")
    kept = held.join(n_e.select("e"), "e", "left_semi")
    # an entity's texts are dealt by hash as well, so that a kind's third of all rows is many tasks' work
    pairs = kept.join(texts.select("texthash", "units"), "texthash").select("e", "n", F.explode("units").alias("u"))
    pairs = pairs.groupBy("e", "u").agg(F.sum("n").alias("n_eu"), F.count("*").alias("texts")).where(F.col("texts") >= support).select("e", "u", "n_eu")
    pairs = stored(pairs, "pii-pairs")
    n_u = unit_counts(docs, stored(pairs.select("u").distinct(), "pii-units"), most)
    n = docs.count()
    joined = pairs.join(n_e, "e").join(n_u, "u").withColumn("n", F.lit(float(max(n, 1))))
    # a unit within an entity's span only isn't counted there: n_u counts all places
    pmi = F.log2(F.col("n") * F.col("n_eu") / (F.col("n_e") * F.greatest("n_u", "n_eu")))
    info = F.log2(F.col("n") / F.col("n_e"))
    return joined.select("e", "u", F.when(info > 0, pmi / info).otherwise(0.0).alias("ratio")).where(F.col("ratio") >= threshold)


def replacements(disclosing: DataFrame) -> DataFrame:
    """(t, put): each disclosing term with its nearest generalisation that isn't among the disclosing units; '' if both are."""
    bad = stored(disclosing.select("u").distinct(), "pii-disclosing")
    terms = bad.where(~F.col("u").endswith("*") & ~F.col("u").startswith("["))
    first = F.concat(F.substring("u", 1, BEGINNING), F.lit("*"))
    kind = F.when(F.col("u").rlike("^[0-9]+$"), "[NUMBER]").when(F.col("u").rlike("[0-9]"), "[CODE]").otherwise("[WORD]")
    chain = terms.select(F.col("u").alias("t"), first.alias("a"), kind.alias("b"))
    wide = bad.where(F.col("u").endswith("*") | F.col("u").startswith("["))
    has = lambda c: wide.select(F.col("u").alias(c), F.lit(True).alias(f"{c}_bad"))
    chain = chain.join(has("a"), "a", "left").join(has("b"), "b", "left")
    return chain.select("t", F.when(F.col("a_bad").isNull(), F.col("a")).when(F.col("b_bad").isNull(), F.col("b")).otherwise("").alias("put"))


SANITISED = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_terms long, n_removed long, sanitised string"


def sanitised(text: str, put: dict[str, str]) -> tuple:
    """SANITISED of a text: base spans masked by kind, words in put replaced or removed; a word that touches a base span stays as it is."""
    base = base_spans(text)
    covered = [(s, e) for s, _, e in base]
    has = bool(put) and any(w.lower() in put for w in set(WORD.findall(text)))
    terms = [(m.start(), len(KINDS) - 1, m.end()) for m in outside(text, covered) if m[0].lower() in put] if has else []
    out, at = [], 0
    for s, k, e in sorted(base + terms):
        if s >= at:
            out += [text[at:s], put[text[s:e].lower()] if k == len(KINDS) - 1 else f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    count = [sum(k == j for _, k, _ in base) for j in range(len(KINDS) - 1)]
    said = hashlib.sha256(span_string(base).encode()).hexdigest()
    gone = sum(put[text[s:e].lower()] == "" for s, _, e in terms)
    return *count, said, span_string(sorted(base + terms)), len(terms), gone, "".join([*out, text[at:]])


def with_sanitised(docs: DataFrame, put: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """docs' columns (doc_id, text) and SANITISED. put: replacements(), broadcast up to `most` terms; beyond, each text gets its own terms by a join of words."""
    spark = docs.sparkSession
    few = put.limit(most + 1).count() <= most
    if few:
        shared = spark.sparkContext.broadcast({r["t"]: r["put"] for r in put.collect()})  # `most` terms at most
        given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("map<string,string>").alias("own"))
    else:
        shared = spark.sparkContext.broadcast(None)
        keyed = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("rid")), "pii-rows")
        words = keyed.mapInArrow(_words, "rid long, t string").join(put, "t")
        own = words.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("t", "put"))).alias("own"))  # a text's own words
        given = keyed.join(own, "rid", "left").select("doc_id", "text", "own")
    names = [x.split()[0] for x in SANITISED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for b in (x.slice(i, DOCS) for x in batches for i in range(0, len(x), DOCS)):
            own = [dict(m or ()) for m in b.column(2).to_pylist()] if shared.value is None else [shared.value] * len(b)
            rows = [sanitised(text or "", put) for text, put in zip(b.column(1).to_pylist(), own)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], ["doc_id", "text", *names])

    return given.mapInArrow(run, f"doc_id long, text string, {SANITISED}")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (x.slice(i, DOCS) for x in batches for i in range(0, len(x), DOCS)):
        rows = [(rid, w) for rid, text in zip(b.column(2).to_pylist(), b.column(1).to_pylist()) for w in sorted({w.lower() for w in set(WORD.findall(text or ""))})]
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.string())], ["rid", "t"])


def sanitise(docs: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """doc_id, text and SANITISED for each row of docs (doc_id, text): base spans are masked by kind, disclosing terms generalised or removed.

    Null and empty texts have no spans and an empty sanitised text. Repeated rows stay repeated, a null doc_id
    keeps its row, other columns are not looked at, an empty table has no rows.
    """
    return with_sanitised(docs, stored(replacements(disclosures(docs, most=most)), "pii-replacements"), most)


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms, n_removed, sanitised_sha256 for each row of docs (doc_id, text).

    spans: base spans and the spans of disclosing terms, by start, then kind as listed, terms last. Null and
    empty texts have none: counts 0, spans '' and the SHA-256 of ''. Repeated rows stay repeated.
    """
    return sanitise(docs).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_terms", "n_removed",
        F.sha2(F.col("sanitised").cast("binary"), 256).alias("sanitised_sha256"),
    )
