"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Fingerprints are made in Arrow batches, one per document. Distinct fingerprints are sorted into tiles by
population count. Two fingerprints at distance d differ in population count by d at most, so only pairs of
tiles whose counts lie within the radius meet; within such a pair numpy compares by exclusive-or and bit
counts, again skipping cells whose counts over parts of the word differ beyond the radius. A pair of tiles
hands on a spanning forest of its links, never the links themselves, so that large groups of near copies
stay linear in their size. The components of the forests are the components of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.common import salted_join, stored
from lodestore.llm.graph import connected_components

SEED = 42
#: Rows of a tile: at least, and at most however many fingerprints there are.
TILE_LEAST, TILE_MOST, TILES_AIMED_AT = 16384, 262144, 128


def fingerprint(text: str | None, words: int = 4) -> int:
    """64 bits, as a signed integer. A bit is set if it is set in over half of the shingles' hashes; no words: 0."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(w)
    if n == 0:
        return 0
    joined = b" ".join(w)
    if n <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        size = np.fromiter(map(len, w), dtype=np.int64, count=n)
        end = np.cumsum(size + 1) - 1
        a, b = (end - size)[: n - words + 1].tolist(), end[words - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(a, b)), dtype=np.uint64, count=len(a))
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    bits = np.packbits(2 * votes > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) for each row of docs; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t, words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """fp sorted into cells of equal counts over parts of the word; the cells' counts, starts and ends."""
    q = np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int16)
    if len(fp) < 50_000:
        q = np.stack([q[:, 0] + q[:, 1], q[:, 2] + q[:, 3]], axis=1)
    code = np.zeros(len(fp), dtype=np.int64)
    for k in range(q.shape[1]):
        code = code * 64 + q[:, k]
    order = np.argsort(code, kind="stable")
    _, start = np.unique(code[order], return_index=True)
    return fp[order], q[order][start], start, np.append(start[1:], len(fp))


def _join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the groups of i and j in labels, in place, until nothing changes."""
    while True:
        a, b = labels[i], labels[j]
        if (differ := a != b).sum() == 0:
            return
        a, b = a[differ], b[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as two arrays, of the links within radius between tiles a and b (None: within a)."""
    fa, qa, sa, ea = _cells(a)
    fb, qb, sb, eb = (fa, qa, sa, ea) if b is None else _cells(b)
    nodes = fa if b is None else np.concatenate([fa, fb])
    shift = 0 if b is None else len(fa)
    labels = np.arange(len(nodes))
    for k in range(len(sa)):
        near = np.flatnonzero(np.abs(qb - qa[k]).sum(axis=1) <= radius)
        if b is None:
            near = near[near >= k]
        if not len(near):
            continue
        at = np.concatenate([np.arange(sb[c], eb[c]) for c in near])
        other = fb[at]
        step = max(1, 2_000_000 // len(other))
        for lo in range(sa[k], ea[k], step):
            mine = fa[lo : min(lo + step, ea[k])]
            i, j = np.nonzero(np.bitwise_count(mine[:, None] ^ other[None, :]) <= radius)
            i, j = i + lo, at[j] + shift
            keep = i != j
            if keep.any():
                _join_labels(labels, i[keep], j[keep])
    child = np.flatnonzero(labels != np.arange(len(nodes)))
    return nodes[child], nodes[labels[child]]


def _tile_links_group(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    tiles = [np.frombuffer(x, dtype="<u8") for x in pdf.sort_values("tile")["data"]]
    u, v = tile_links(tiles[0], tiles[1] if len(tiles) > 1 else None, radius)
    return pd.DataFrame({"src": u.view(np.int64), "dst": v.view(np.int64)})


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Edges (src, dst) whose components are those of all pairs of fp within radius. distinct: fp, each once."""
    spark = distinct.sparkSession
    by_count = {r["pc"]: r["n"] for r in distinct.groupBy(F.bit_count("fp").alias("pc")).agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    if not by_count:
        return spark.createDataFrame([], "src long, dst long")
    rows = max(TILE_LEAST, min(TILE_MOST, sum(by_count.values()) // TILES_AIMED_AT))
    first, slices, t = {}, {}, 0
    for pc in range(65):
        first[pc], slices[pc] = t, -(-by_count.get(pc, 0) // rows)
        t += slices[pc]
    first[65] = t
    number = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    pc = F.bit_count("fp")
    tile = number(first)[pc] + F.pmod(F.xxhash64("fp"), number({k: max(1, v) for k, v in slices.items()})[pc]).cast("int")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.sort(pdf["fp"].to_numpy(np.int64).view(np.uint64)).astype("<u8").tobytes()
        return pd.DataFrame({"tile": [pdf["tile"].iloc[0]], "pc": [pdf["pc"].iloc[0]], "data": [data]})

    packed = distinct.select("fp", pc.alias("pc"), tile.alias("tile")).groupBy("tile").applyInPandas(pack, "tile int, pc int, data binary")
    lo = number({k: first[max(0, k - radius)] for k in range(65)})[F.col("pc")]
    hi = number({k: first[min(64, k + radius) + 1] - 1 for k in range(65)})[F.col("pc")]
    pairs = (
        packed.withColumn("other", F.explode(F.sequence(lo, hi)))
        .select(F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "data")
    )
    n = min(2000, max(spark.sparkContext.defaultParallelism * 2, 3 * t))
    return pairs.repartition(n, "a", "b").groupBy("a", "b").applyInPandas(lambda p: _tile_links_group(p, radius), "src long, dst long")


def simhash_components(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text).

    fingerprint: 16 hex digits. component_id: the smallest doc_id of the documents that links of `radius`
    differing bits or fewer reach, itself included. Null and empty texts have fingerprint zero and are linked
    like any other. A null doc_id keeps its row and never names a component unless no member has an id.
    Repeated rows stay repeated. No documents: no rows.
    """
    fps = stored(fingerprints(docs, words), "simhash-fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = connected_components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = distinct.join(roots, "fp", "left").select("fp", "rep", F.col("root"))
    least = named.where("root is not null").groupBy("root").agg(F.min("rep").alias("least"))
    label = named.join(least, "root", "left").select("fp", F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"))
    out = salted_join(fps, label, "fp", F.coalesce("doc_id", F.lit(0)))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies of a pipeline stage: words of a shingle, least Jaccard similarity of two texts' sets of shingles.
NEAR_WORDS, NEAR_LEAST = 5, 0.8
#: Differing bits of candidates. Two sets of J = 0.8 share 2J/(1+J) = 0.89 of their shingles, so bits differ by
#: arccos(0.89)/pi = 0.15: 9.7 of 64 and 19.4 of 128 on average, with deviations of 2.9 and 4.1. Over the first 64, over all 128:
#: three and a half deviations more.
NEAR_RADIUS, NEAR_RADIUS_BOTH = 20, 34
#: A pair of tiles hands on all its candidates up to so many for each of its texts; with more it gets its texts' shingles and checks them itself.
MANY = 8
#: Tiles, about, while they are small; beyond that there are more of them, each of NEAR_MOST texts at most, so that a task's work stays the same.
NEAR_TILES, NEAR_MOST = 32, 16_384


def count_tiles(by_count: dict[int, int], rows: int, radius: int) -> tuple[dict[int, int], dict[int, int], dict[int, tuple[int, int]]]:
    """(first tile and tiles of each population count, tiles that each tile meets): neighbouring counts share tiles of about `rows`; tiles whose counts differ beyond radius don't meet."""
    groups: list[list[int]] = []  # lowest count, highest count, fingerprints
    for pc, n in sorted(by_count.items()):
        if groups and groups[-1][2] + n <= rows:
            groups[-1][1:] = [pc, groups[-1][2] + n]
        else:
            groups.append([pc, pc, n])
    first, slices, spans, t = {}, {}, [], 0
    for lo, hi, n in groups:
        k = max(1, -(-n // rows))
        for pc in range(lo, hi + 1):
            first[pc], slices[pc] = t, k
        spans.append((lo, hi, t, t + k - 1))
        t += k
    meets = {}
    for lo, hi, a, z in spans:
        near = [(x, y) for l2, h2, x, y in spans if l2 - hi <= radius and lo - h2 <= radius]
        for tile in range(a, z + 1):
            meets[tile] = (min(x for x, _ in near), max(y for _, y in near))
    return first, slices, meets


def shingle_hashes(text: str | None, words: int = NEAR_WORDS) -> np.ndarray:
    """The hash of each shingle of text; of all words if there are fewer; none without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(w[i : i + words]), SEED) for i in range(max(1, len(w) - words + 1))], dtype=np.uint64)


def jaccard(a: str | None, b: str | None, words: int = NEAR_WORDS) -> float:
    """Of the sets of shingles of two texts; 1 if neither has any."""
    x, y = set(shingle_hashes(a, words).tolist()), set(shingle_hashes(b, words).tolist())
    return len(x & y) / len(x | y) if x or y else 1.0


def _votes(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


def _near_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, th, node, fp, more) for each row of docs (doc_id, text, th): node stands for the set of shingles, fp and more are 128 bits of votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fp, more = [], [], []
            for t in b.column(1).to_pylist():
                h = np.unique(shingle_hashes(t))
                second = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                second = (second ^ (second >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                node.append(xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63))
                fp.append(_votes(h))
                more.append(_votes(second ^ (second >> np.uint64(31))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *[pa.array(x, pa.int64()) for x in (node, fp, more)]], ["doc_id", "th", "node", "fp", "more"])

    return docs.mapInArrow(run, "doc_id long, th long, node long, fp long, more long")


TILE = np.dtype([("node", "<i8"), ("fp", "<u8"), ("more", "<u8"), ("label", "<i8")])


def close_pairs(a: np.ndarray, b: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row of a, i, j, differing bits of 128) of the candidates of different labels between tiles a and b (None: within a), for some rows of a at a time."""
    other = a if b is None else b
    step = max(1, 2_000_000 // max(1, len(other)))
    fp, more, label = (np.ascontiguousarray(other[c]) for c in ("fp", "more", "label"))
    for lo in range(0, len(a), step):
        mine = a[lo : lo + step]
        first = np.bitwise_count(mine["fp"][:, None] ^ fp[None, :])
        i, j = np.nonzero(first <= NEAR_RADIUS)
        both = first[i, j].astype(np.int16) + np.bitwise_count(mine["more"][i] ^ more[j])
        keep = (both <= NEAR_RADIUS_BOTH) & (mine["label"][i] != label[j])
        if keep.any():
            yield lo, i[keep], j[keep], both[keep]


def near_candidates(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Candidate links (nodes, nodes) of different labels between tiles a and b (None: within a), and whether these are all: none are given if they are more than MANY for each text."""
    other = a if b is None else b
    most = MANY * (len(a) + len(other))
    every, count = [], 0
    for lo, i, j, _ in close_pairs(a, b):
        if b is None:
            up = i + lo < j
            i, j = i[up], j[up]
        count += len(i)
        if count > most:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), False
        every.append((a["node"][lo + i], other["node"][j]))
    if not every:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), True
    return np.concatenate([x for x, _ in every]), np.concatenate([y for _, y in every]), True


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of shingles, each in order, reach NEAR_LEAST."""
    if min(len(x), len(y)) < NEAR_LEAST * max(len(x), len(y)):
        return False
    at = np.minimum(np.searchsorted(y, x), max(0, len(y) - 1))
    same = int((y[at] == x).sum()) if len(y) else 0
    return same / (len(x) + len(y) - same) >= NEAR_LEAST if len(x) or len(y) else True


def forest_of_links(a: np.ndarray, b: np.ndarray | None, sets: list[np.ndarray], other_sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (node, node) that join what the candidates that reach NEAR_LEAST join; what is joined already isn't looked at again."""
    other = a if b is None else b
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out = []
    for lo, i, j, both in close_pairs(a, b):
        order = np.lexsort((j, i, both))
        for x, y in zip((i[order] + lo).tolist(), j[order].tolist()):
            u, v = top(int(a["label"][x])), top(int(other["label"][y]))
            if u != v and alike(sets[x], other_sets[y]):
                root[u] = v
                out.append((int(a["node"][x]), int(other["node"][y])))
    return out


def _near_candidates_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("tile")
    tiles = [np.frombuffer(x, dtype=TILE) for x in pdf["data"]]
    u, v, done = near_candidates(tiles[0], tiles[1] if len(tiles) > 1 else None)
    out = pd.DataFrame({"src": u, "dst": v, "again": False})
    if not done:
        out.loc[len(out)] = [pdf["a"].iloc[0], pdf["b"].iloc[0], True]
    return out.astype({"src": "int64", "dst": "int64", "again": bool})


def _forest_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("tile")
    tiles = [np.frombuffer(x, dtype=TILE) for x in pdf["data"]]
    sets = [np.split(np.frombuffer(h, np.uint64), np.frombuffer(e, np.int64)) for h, e in zip(pdf["hashes"], pdf["edges"])]
    links = forest_of_links(tiles[0], tiles[1] if len(tiles) > 1 else None, sets[0], sets[-1])
    return pd.DataFrame(links, columns=["src", "dst"], dtype="int64")


def _pack(pdf: pd.DataFrame) -> np.ndarray:
    out = np.zeros(len(pdf), dtype=TILE)
    for c in TILE.names:
        out[c] = pdf[c].to_numpy(np.int64).view(np.uint64) if TILE[c].kind == "u" else pdf[c].to_numpy(np.int64)
    return out


def _pack_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"tile": [pdf["tile"].iloc[0]], "data": [np.sort(_pack(pdf), order="node").tobytes()]})


def _pack_sets(pdf: pd.DataFrame) -> pd.DataFrame:
    """A tile with the sets of shingles of its texts, one after the other, and where each but the first begins."""
    pdf = pdf.sort_values("node")
    sets = [np.unique(shingle_hashes(t)) for t in pdf["text"]]
    hashes, edges = np.concatenate(sets), np.cumsum([len(x) for x in sets])[:-1]
    return pd.DataFrame({"tile": [pdf["tile"].iloc[0]], "data": [_pack(pdf).tobytes()], "hashes": [hashes.tobytes()], "edges": [edges.astype(np.int64).tobytes()]})


def _checked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (src, dst) of nodes whose texts reach NEAR_LEAST. nodes: node, rep (doc_id, th)."""
    wanted = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    ids = nodes.join(wanted, "node", "left_semi").select("node", "rep.doc_id", "rep.th")
    texts = stored(docs.join(ids, ["doc_id", "th"]).dropDuplicates(["node"]).select("node", "text"), "near-texts")

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[str | None, np.ndarray] = {}  # a text comes in several pairs, which lie side by side

        def shingles(t: str | None) -> np.ndarray:
            if len(known) > 1000:
                known.clear()
            if t not in known:
                known[t] = np.unique(shingle_hashes(t))
            return known[t]

        return pd.Series([alike(shingles(x), shingles(y)) for x, y in zip(a, b)], dtype="bool")

    side = lambda n, t: texts.select(F.col("node").alias(n), F.col("text").alias(t))
    return pairs.join(side("src", "_a"), "src").join(side("dst", "_b"), "dst").where(similar("_a", "_b")).select("src", "dst")


def near_links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (src, dst) whose components are those of all candidates that reach NEAR_LEAST.

    nodes: node (each once), fp, more, rep. Pairs of tiles with few candidates hand them on to be checked. Then what these join has one label, and
    the pairs of tiles that hold a large group of near copies get the shingles of their texts and
    check all the rest where they lie: no more links leave a pair of tiles than it has texts.
    """
    spark = nodes.sparkSession
    by_count = {r["pc"]: r["n"] for r in nodes.groupBy(F.bit_count("fp").alias("pc")).agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    n = sum(by_count.values())
    first, slices, meets = count_tiles(by_count, min(NEAR_MOST, max(TILE_LEAST, n // NEAR_TILES)), NEAR_RADIUS)
    if not meets:
        return spark.createDataFrame([], "src long, dst long")
    number = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    pc = F.bit_count("fp")
    tile = (number(first)[pc] + F.pmod(F.xxhash64("node"), number(slices)[pc])).cast("int").alias("tile")
    lo, hi = (number({k: v[i] for k, v in meets.items()})[F.col("tile")] for i in (0, 1))
    width = min(2000, max(spark.sparkContext.defaultParallelism * 2, sum(z - a + 1 for a, z in meets.values())))

    def met(packed: DataFrame, *columns: str) -> DataFrame:
        """Each two tiles that meet, side by side; after the first round those alone that aren't done."""
        pairs = packed.withColumn("other", F.explode(F.sequence(lo, hi))).select(F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", *columns)
        return pairs if pending is None else pairs.join(F.broadcast(pending), ["a", "b"], "left_semi")

    pending = None
    label = lambda labels: nodes.join(labels, "node", "left").select("node", "fp", "more", F.coalesce("root", "node").alias("label"), tile, "rep")
    packed = label(spark.createDataFrame([], "node long, root long")).drop("rep").groupBy("tile").applyInPandas(_pack_tile, "tile int, data binary")
    found = stored(met(packed, "data").repartition(width, "a", "b").groupBy("a", "b").applyInPandas(_near_candidates_group, "src long, dst long, again boolean"), "near-candidates")
    good = stored(_checked(found.where("not again").select("src", "dst"), nodes, docs), "near-links")
    left = [(r["src"], r["dst"]) for r in found.where("again").collect()]  # pairs of tiles
    if not left:
        return good
    pending = spark.createDataFrame(left, "a int, b int")
    some = label(connected_components(good)).join(F.broadcast(pending.select(F.explode(F.array("a", "b")).alias("tile")).distinct()), "tile", "left_semi")
    texts = some.select("*", "rep.doc_id", "rep.th").join(docs, ["doc_id", "th"]).dropDuplicates(["node"]).select("node", "fp", "more", "label", "tile", "text")
    packed = texts.groupBy("tile").applyInPandas(_pack_sets, "tile int, data binary, hashes binary, edges binary")
    links = met(packed, "data", "hashes", "edges").repartition(width, "a", "b").groupBy("a", "b").applyInPandas(_forest_group, "src long, dst long")
    return stored(good.unionByName(links), "near-links")


def near_dedup(docs: DataFrame) -> DataFrame:
    """docs without all but one document of each group of near copies: the one with the smallest doc_id stays, of several with that id the one with the least text hash.

    Two texts are linked if their sets of NEAR_WORDS-word shingles have a Jaccard similarity of NEAR_LEAST or
    more, exactly; they are compared if their votes lie within NEAR_RADIUS and NEAR_RADIUS_BOTH bits. Texts without words
    are copies of each other. Rows of one doc_id with unlike texts are documents of their own; of rows with one doc_id and text one stays.
    Rows without doc_id are kept: they can't be told apart by their id. Any column names are fine.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    th = F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")
    keyed = docs.where("doc_id is not null").select(row, F.col("doc_id").cast("long").alias("doc_id"), "text", th)
    texts = keyed.select("doc_id", "text", "th")
    keys = stored(_near_keys(texts), "near-keys")
    nodes = stored(keys.groupBy("node").agg(F.min("fp").alias("fp"), F.min("more").alias("more"), F.min(F.struct("doc_id", "th")).alias("rep")), "near-nodes")
    roots = connected_components(near_links(nodes, texts))
    named = nodes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "rep")
    keep = named.groupBy("root").agg(F.min("rep").alias("rep")).select("rep.doc_id", "rep.th").distinct()
    kept = keyed.drop("text").join(keep, ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns]).unionByName(docs.where("doc_id is null"))
