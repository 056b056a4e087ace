"""Source divergence audit: how far the sources of a language differ in their use of its common terms.

Terms that enough documents of a language hold are its vocabulary. They are sorted by range over the cluster, cut into
pieces, and each piece becomes a minimal acyclic transducer in a task of its own; the pieces of a block of bounded size are
joined into one that is minimal again. Whole texts stream through it, all terms of a batch in step, and come
out as places in byte order, which are counted by source and settle ties. A vocabulary of several blocks takes as many passes over the texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestore.llm.common import stored
from lodestore.llm.transducer import States, Transducer, unpacked

#: Documents of a language that must hold a term; what is added to each count; the scale of shares; terms listed by source.
LEAST_DOCS, ADDED, SCALE, LISTED = 30, 5, 10**9, 50
#: Terms of a piece, which a task turns into a transducer; arcs of the pieces of a block, which all tasks hold (some 20 bytes each).
PIECE, BLOCK_ARCS = 8192, 8_000_000
#: Entries that a task counts before it hands its counts on; terms that walk in step.
MOST_COUNTS, IN_STEP = 400_000, 500_000
#: Places, and sources, of a tile of shares that is compared as a matrix.
PLACES, SOURCES = 2048, 256
#: Letters and all that isn't ASCII, in UTF-8 after A-Z are lower-cased.
TERM = re.compile(rb"[a-z\x80-\xff]+")
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
INSIDE = np.array([97 <= c <= 122 or c >= 128 for c in range(256)])


def filled(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def document_counts(texts: DataFrame) -> DataFrame:
    """(lang, term, n): in how many texts (lang, text) of a language a term stands. Tasks count first and hand on what they have seen when it is much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in seen.items():
                terms = pa.array(list(counts), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), terms, pa.array(list(counts.values()), pa.int64())], ["lang", "term", "n"])
            seen.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(set(TERM.findall(text.encode().lower())))
                if sum(map(len, seen.values())) > MOST_COUNTS:
                    yield from out()
        yield from out()

    each = texts.select("lang", "text").mapInArrow(run, "lang string, term string, n long")
    return each.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def vocabulary(texts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, place): the terms of `least` texts and more of a language; place counts from 0 in byte order, by ranges and prefix counts."""
    kept = stored(document_counts(texts).where(F.col("n") >= least).select("lang", "term"), "divergence-kept")
    parts = max(1, -(-kept.count() // PIECE))
    sorted_ = kept.repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term")
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = stored(sorted_.select("lang", "term", F.spark_partition_id().alias("part"), within.alias("at")), "divergence-ranged")
    ranges = ranged.groupBy("lang", "part").agg(F.count("*").alias("n"), F.min("at").alias("begin"))  # a row for each range and language
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("part")) - F.col("n")
    return ranged.join(ranges.select("lang", "part", "begin", before.alias("before")), ["lang", "part"]).select("lang", "term", (F.col("before") + F.col("at") - F.col("begin")).alias("place"))


def pieces(terms: DataFrame, size: int = PIECE) -> DataFrame:
    """(lang, piece, n, final, key, to): transducers of `size` terms each."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        words = [t.encode() for t in pdf.sort_values("place")["term"]]
        states = States()
        packed = Transducer.of(states, states.added(words)).packed()
        return pd.DataFrame([(pdf["lang"].iloc[0], pdf["piece"].iloc[0], len(words), *packed)], columns=["lang", "piece", "n", "final", "key", "to"])

    cut = terms.withColumn("piece", F.floor(F.col("place") / size).cast("long"))
    return cut.groupBy("lang", "piece").applyInPandas(build, "lang string, piece long, n long, final binary, key binary, to binary")


def blocks(cut: DataFrame, most: int = BLOCK_ARCS) -> Iterator[dict[str, tuple[int, Transducer]]]:
    """By language the place of its first term and the transducer of its pieces, block by block; the pieces of a block have `most` arcs, or are one."""
    sized = cut.select("lang", "piece", "n", (F.length("key") / 8).cast("long").alias("arcs"))
    after = Window.orderBy("lang", "piece")
    sizes = sized.withColumn("block", F.floor((F.sum("arcs").over(after) - 1) / most))  # a row for each piece
    for (block,) in sizes.select("block").distinct().orderBy("block").collect():
        rows = cut.join(F.broadcast(sizes.where(F.col("block") == block).select("lang", "piece")), ["lang", "piece"]).orderBy("lang", "piece").collect()
        out = {}
        for lang in dict.fromkeys(r["lang"] for r in rows):
            own = [r for r in rows if r["lang"] == lang]
            states = States()
            first = unpacked(states, own[0]["final"], own[0]["key"], own[0]["to"])
            for r in own[1:]:
                first = states.union(first, unpacked(states, r["final"], r["key"], r["to"]))
            out[lang] = (int(own[0]["piece"]), Transducer.of(states, first))
        yield out


def term_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the terms of texts that lie one after the other begin and end; none goes beyond its text."""
    inside = INSIDE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def recounted(texts: DataFrame, block: dict[str, tuple[int, Transducer]], piece: int = PIECE) -> DataFrame:
    """(lang, source, place, n): how often the terms of a block stand in the texts of each source. Tasks count first."""
    shared = texts.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, groups = shared.value, {}
        keys, counts, held = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(key), dtype=np.int64)
            np.add.at(total, inverse, np.concatenate(counts))
            return key, total

        def out(key: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
            names, which = list(groups), key >> 40
            return pa.RecordBatch.from_arrays([pa.array([names[g][c] for g in which.tolist()], pa.string()) for c in (0, 1)] + [pa.array(key & ((1 << 40) - 1)), pa.array(total)], ["lang", "source", "place", "n"])

        for b in batches:
            langs, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
            group = np.array([groups.setdefault(x, len(groups)) for x in zip(langs, sources)], dtype=np.int64)
            text = b.column(2).cast(pa.large_binary())
            _, places, data = text.buffers()
            offsets = np.frombuffer(places, np.int64)[text.offset : text.offset + len(text) + 1]
            data = LOWER[np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]]
            begin, end = term_edges(data, offsets - offsets[0])
            row = np.searchsorted(offsets - offsets[0], begin, side="right") - 1
            for lang in dict.fromkeys(langs):
                if lang not in block:
                    continue
                first, automaton = block[lang]
                own = np.flatnonzero(np.array([x == lang for x in langs])[row])
                for i in range(0, len(own), IN_STEP):
                    some = own[i : i + IN_STEP]
                    place = automaton.places(data, begin[some], end[some])
                    known = place >= 0
                    key, n = np.unique((group[row[some[known]]] << 40) + first * piece + place[known], return_counts=True)
                    keys.append(key)
                    counts.append(n)
                    held += len(key)
                    if held > 4 * MOST_COUNTS:
                        key, total = merged()
                        keys, counts, held = [key], [total], len(key)
                        if held > 2 * MOST_COUNTS:
                            yield out(key, total)
                            keys, counts, held = [key[:0]], [total[:0]], 0
        yield out(*merged())

    each = texts.select("lang", "source", "text").mapInArrow(run, "lang string, source string, place long, n long")
    return each.groupBy("lang", "source", "place").agg(F.sum("n").alias("n"))


def shares(counts: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """counts (by, n) with p = 1 + floor(SCALE * (n + ADDED) / (total + ADDED * terms)), in decimals: exact for any long. groups: by, terms, total."""
    over = "(cast(n as decimal(20,0)) + {a}) * cast({s} as decimal(11,0)) div (cast(total as decimal(20,0)) + {a} * cast(terms as decimal(20,0)))"
    return counts.join(groups.select(*by, "terms", "total"), by).withColumn("p", F.expr("1 + " + over.format(a=ADDED, s=SCALE)))


def distances(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, i, j, value): sums of |p - q| over all places of a language, for each two of its sources, i < j by number.

    cells: lang, number, place, p. groups: lang, number, terms, p (that of a count of 0). Shares are compared in tiles of
    SOURCES sources and PLACES places as matrices; a source without a term in a tile still has its p of 0 there.
    """
    tiles = F.floor(F.max("number").over(Window.partitionBy("lang")) / SOURCES) + 1
    own = groups.select("lang", "number", "terms", "p", tiles.alias("tiles"))
    part = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("terms") / PLACES) - 1, F.lit(0)))
    base = own.select("lang", "number", F.lit(None).cast("long").alias("place"), "p", F.explode(part).alias("part"), "terms", "tiles")
    known = cells.join(own.select("lang", "number", "terms", "tiles"), ["lang", "number"]).select("lang", "number", "place", "p", F.floor(F.col("place") / PLACES).alias("part"), "terms", "tiles")
    tile = F.floor(F.col("number") / SOURCES).cast("long")
    dealt = base.unionByName(known).withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles").cast("long") - 1)))
    dealt = dealt.withColumns({"a": F.least("tile", "other"), "b": F.greatest("tile", "other")})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        lang, lo = pdf["lang"].iloc[0], int(pdf["part"].iloc[0]) * PLACES
        width = max(0, min(PLACES, int(pdf["terms"].iloc[0]) - lo))
        zero = pdf[pdf["place"].isna()]
        numbers = np.sort(zero["number"].to_numpy(np.int64))
        p = np.zeros((len(numbers), width), dtype=np.int64)
        p[np.searchsorted(numbers, zero["number"].to_numpy(np.int64))] = zero["p"].to_numpy(np.int64)[:, None]
        some = pdf[pdf["place"].notna()]
        p[np.searchsorted(numbers, some["number"].to_numpy(np.int64)), some["place"].astype("int64").to_numpy() - lo] = some["p"].to_numpy(np.int64)
        a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        i, j, value = [], [], []
        for k in np.flatnonzero(numbers // SOURCES == a):
            far = np.flatnonzero((numbers > numbers[k]) & (numbers // SOURCES == b))
            i.append(np.full(len(far), numbers[k]))
            j.append(numbers[far])
            value.append(np.abs(p[far] - p[k]).sum(axis=1))
        return pd.DataFrame({"lang": lang, "i": np.concatenate(i), "j": np.concatenate(j), "value": np.concatenate(value)})

    each = dealt.groupBy("lang", "part", "a", "b").applyInPandas(compare, "lang string, i long, j long, value long")
    return each.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, listed: int = LISTED, piece: int = PIECE, block: int = BLOCK_ARCS) -> DataFrame:
    """lang, source, part, item, value, rank of docs (text, lang, source): part 'pair' has a source's distance to each other source of its language, 'term' the terms that it favours most.

    Nulls count as ''. Repeated rows and rows of one doc_id are documents of their own; doc_id isn't looked at. A language in which no term is common
    enough has pairs of value 0 and no terms; a source without terms has the share of a count of 0 everywhere. Equal values are ranked by
    the bytes of their item.
    """
    texts = filled(docs)
    terms = stored(vocabulary(texts, least), "divergence-terms")
    cut = stored(pieces(terms, piece), "divergence-pieces")
    counts = docs.sparkSession.createDataFrame([], "lang string, source string, place long, n long")
    for b in blocks(cut, block):  # one at a time: the driver and the tasks hold no other
        counts = counts.unionByName(stored(recounted(texts, b, piece), "divergence-counts"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    sources = texts.select("lang", "source").distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left")
    sources = sources.select("lang", "source", number.alias("number"), F.coalesce("terms", F.lit(0)).cast("long").alias("terms"), F.coalesce("total", F.lit(0)).cast("long").alias("total"))
    sources = stored(sources, "divergence-sources")
    cells = stored(shares(counts, sources, ["lang", "source"]).join(sources.select("lang", "source", "number"), ["lang", "source"]).select("lang", "source", "number", "place", "n", "p"), "divergence-cells")

    zero = shares(sources.where("terms > 0").select("lang", "source", "number", F.lit(0).cast("long").alias("n")), sources, ["lang", "source"])
    none = sources.where("terms = 0").select("lang", "number", "terms", F.lit(0).cast("long").alias("p"))
    far = distances(cells, zero.select("lang", "number", "terms", "p").unionByName(none))
    both = far.select("lang", F.explode(F.array(F.struct(F.col("i").alias("number"), F.col("j").alias("other")), F.struct(F.col("j").alias("number"), F.col("i").alias("other")))).alias("of"), "value").select("lang", "of.*", "value")
    names = sources.select("lang", "number", "source")
    pair = both.join(names, ["lang", "number"]).join(names.select("lang", F.col("number").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))

    whole = counts.groupBy("lang", "place").agg(F.sum("n").alias("n"))
    in_all = sources.groupBy("lang").agg(F.max("terms").alias("terms"), F.sum("total").alias("total"))
    q = shares(whole, in_all, ["lang"]).select("lang", "place", F.col("p").alias("q"))
    more = cells.join(q, ["lang", "place"]).where("p > q").select("lang", "source", "place", (F.col("p") - F.col("q")).alias("value"))
    first = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "place"))
    more = more.withColumn("rank", first).where(F.col("rank") <= listed)  # each task keeps its own first ones before rows are dealt
    term = more.join(terms, ["lang", "place"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pair.unionByName(term).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


ORACLE_SQL = f"""
with d as (
  select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(
      translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'
    ) as terms
  from documents
),
words as (select rid, lang, source, unnest(terms) as term from d),
kept as (select lang, term from words group by lang, term having count(distinct rid) >= {LEAST_DOCS}),
sizes as (select lang, count(*) as v from kept group by lang),
groups as (select lang, source from d group by lang, source),
counts as (select w.lang, w.source, w.term, count(*) as n from words w join kept k on k.lang = w.lang and k.term = w.term group by all),
cells as (
  select g.lang, g.source, k.term, coalesce(c.n, 0)::hugeint as n
  from groups g join kept k on k.lang = g.lang
    left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
),
own as (
  select c.*, (1 + ({SCALE}::hugeint * (n + {ADDED})) // (sum(n) over (partition by c.lang, c.source) + {ADDED} * s.v))::bigint as p
  from cells c join sizes s on s.lang = c.lang
),
whole as (select lang, term, sum(n)::hugeint as n from cells group by lang, term),
overall as (
  select w.lang, w.term, (1 + ({SCALE}::hugeint * (n + {ADDED})) // (sum(n) over (partition by w.lang) + {ADDED} * s.v))::bigint as q
  from whole w join sizes s on s.lang = w.lang
),
far as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p))::bigint as value
  from own a join own b on b.lang = a.lang and b.term = a.term and b.source <> a.source
  group by a.lang, a.source, b.source
),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value
  from groups a join groups b on b.lang = a.lang and b.source <> a.source
    left join far f on f.lang = a.lang and f.source = a.source and f.item = b.source
),
favoured as (
  select o.lang, o.source, 'term' as part, o.term as item, o.p - a.q as value
  from own o join overall a on a.lang = o.lang and a.term = o.term
  where o.n > 0 and o.p > a.q
),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
  from (select * from pairs union all select * from favoured)
)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= {LISTED}
"""
