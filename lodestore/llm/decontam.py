"""Benchmark decontamination by latent semantic retrieval.

Passages are word windows of whole texts, as TF-IDF vectors over the benchmark's words and the corpus' most
frequent ones. All passages of all documents, with the benchmark's items beside them, are decomposed by a distributed
randomised SVD into fewer dimensions than there are items. Items and windows are compared by cosine in that
latent space, where words that keep the same company lie close, and close pairs are checked word by word: by longest
common subsequence and, for paraphrases, by the item's answer.

Texts are read as words once; all later passes read their numbers. Windows come in the length class of the item
that they are compared with, every STRIDE words, so that a copy lies whole in one and makes up a fair part of it.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.common import scratch_path, stored

WORD, WORD_OR_MARK = re.compile(r"\w+"), re.compile(r"\w+|\n")
#: Words from one window to the next; windows of the passages that are decomposed, in strides.
STRIDE, PASSAGE = 8, 4
#: Windows for items of up to so many words, in strides: a stretch of that length lies whole in one of them.
CLASSES = ((8, 2), (16, 3), (24, 4), (32, 5), (48, 7), (64, 9))
#: Items go through in blocks of about so many; words of an item's part, from one part to the next; items under LEAST_ITEM words are matched as phrases.
BLOCK, PART, PART_STEP, LEAST_ITEM = 4096, 64, 48, 5
#: Corpus words beside the benchmark's: the most frequent ones of all documents. Texts and bytes of them that go into a row of numbers, at most (a longer text is one by itself).
VOCABULARY, TEXTS, READ_BYTES = 8192, 4000, 1 << 24
#: Words in a larger share of the documents have no weight, unless over half of an item's words are such.
COMMON = 0.2
#: Least weight of the benchmark's words and largest of the others, as shares of the largest inverse document frequency. However many documents there are
#: and however many hold an item, it keeps a fair part of its windows.
LEAST_OWN, MOST_OTHER = 0.6, 0.5
#: Latent dimensions, at most and as a share of the items; oversampling.
DIMS, DIMS_SHARE, OVER = 48, 0.75, 16
#: Latent cosine from which a pair is a candidate.
COSINE = 0.4
#: Share of an item's words in common order: a copy; a paraphrase, if it has so much (and that latent cosine) and so much of the answer is there too.
COPY, PARAPHRASES, ANSWER = 0.8, ((0.6, 0.0), (0.5, 0.75)), 0.5
#: A paraphrase that shares few words but means the same: from this latent cosine on, this share of the part's names in common order (and the answer). Names are the rarest
#: third of its words, two at least.
LATENT, NAMES = 0.75, 0.6
#: Share of a part's words, the rarest, that are counted first.
RARE = 0.7
#: Parts whose words are counted at a time.
GROUP = 256
#: Rows of numbers that are summed at a time; a word that stands more often than this in a task's stretch of words is frequent.
NEAR_ROWS, OFTEN = 1024, 64
#: More words than any window has.
MANY = 256
#: Words that a task works on at a time; words that a task of the decomposition has at least, since each hands on a matrix.
CHUNK, WORDS_PER_TASK = 1 << 17, 1 << 22
TERM_BLOCKS = 16
SEED = 42


class Items:
    """A block of benchmark items on the driver: parts as word ids, vocabulary, and after weigh() their vectors."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.vocabulary: dict[str, int] = {}
        self.item: list[int | None] = []
        self.parts: list[np.ndarray] = []
        self.phrases: list[tuple[int | None, np.ndarray]] = []
        for item, text in rows:
            words = WORD.findall((text or "").lower())
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], dtype=np.int32)
            if len(words) < LEAST_ITEM:
                if words:
                    self.phrases.append((item, ids))
                continue
            for s in range(0, max(1, len(ids) - PART + PART_STEP), PART_STEP) if len(ids) > PART else [0]:
                self.item.append(item)
                self.parts.append(ids[s : s + PART])
        self.own = len(self.vocabulary)

    def extend(self, words: list[str]) -> None:
        for w in words:
            self.vocabulary.setdefault(w, len(self.vocabulary))

    def weigh(self, df: np.ndarray, n: int) -> None:
        idf = np.log((n + 1) / (df + 1)) + 0.1
        common = df > COMMON * n
        for ids in self.parts:
            if common[ids].mean() > 0.5:  # nothing else to find it by
                common[ids] = False
        self.idf, top = idf, np.log(n + 1) + 0.1
        own = np.arange(len(idf)) < self.own
        self.weight = np.where(common, 0.0, np.where(own, np.maximum(idf, LEAST_OWN * top), np.minimum(idf, MOST_OTHER * top))).astype(np.float32)
        self.matrix = np.zeros((len(self.parts), len(idf)), dtype=np.float32)
        for k, ids in enumerate(self.parts):
            np.add.at(self.matrix[k], ids, self.weight[ids])
        self.matrix /= np.maximum(np.linalg.norm(self.matrix, axis=1, keepdims=True), 1e-12)
        self.size = np.array([len(ids) for ids in self.parts], dtype=np.int64)
        #: the answer has no column of its own: the rarest quarter of a part's words stands for it
        rarest = [sorted(set(ids.tolist()), key=lambda i: (-idf[i], i)) for ids in self.parts]
        self.answers = [set(words[: max(1, len(words) // 4)]) for words in rarest]
        self.names = [ids[np.isin(ids, words[: max(2, len(words) // 3)])] for ids, words in zip(self.parts, rarest)]


READ = "words array<string>, df array<long>, doc_id array<long>, text_key array<long>, size array<int>, ids binary"


def cut(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, how many words each text has, all words as numbers of distinct ones). Texts are split at white space by Arrow, and only distinct pieces are read as words."""
    pieces = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    own = pieces.flatten().dictionary_encode()
    number: dict[str, int] = defaultdict(itertools.count().__next__)
    number["\n"]  # no piece holds it: a mark after each
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own.dictionary)], pa.int32()), own.dictionary), "\n")[0].as_py() + "\n"
    read = np.fromiter(map(number.__getitem__, WORD_OR_MARK.findall(lines.lower())), dtype=np.int32)
    marks = np.flatnonzero(read == 0)
    begin = np.append(0, marks[:-1] + 1)
    many = marks - begin
    at = own.indices.to_numpy(zero_copy_only=False)
    count = many[at]
    end = np.concatenate([[0], np.cumsum(count)])
    ids = read[np.repeat(begin[at] - end[:-1], count) + np.arange(end[-1])] - 1
    edge = np.concatenate([[0], np.cumsum(pieces.value_lengths().to_numpy(zero_copy_only=False))])
    return list(number)[1:], np.diff(end[edge]), ids


def read_words(docs: DataFrame) -> DataFrame:
    """READ, written: texts as numbers of words, TEXTS of them to a row, whose own `words` they point at; df: in how many of its texts each word is. The one pass that reads text."""
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
            lo = 0
            while lo < len(b):
                hi = max(lo + 1, min(lo + TEXTS, int(np.searchsorted(size, size[lo] + READ_BYTES, side="right")) - 1))
                words, count, ids = cut(b.column(2).slice(lo, hi - lo))
                df, last, k = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64), 0
                for n in count.tolist():
                    own, place = ids[k : k + n], np.arange(n)
                    last[own] = place
                    df[own[last[own] == place]] += 1  # each word once
                    k += n
                some = pa.array(count > 0)
                values = (words, df, b.column(0).slice(lo, hi - lo).filter(some), b.column(1).slice(lo, hi - lo).filter(some), count[count > 0])
                lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v, t.value_type)) for v, t in zip(values, kinds)]
                if len(ids):
                    yield pa.RecordBatch.from_arrays([*lists, pa.array([ids.tobytes()], pa.binary())], names)
                lo = hi

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    path = scratch_path(docs.sparkSession, "leak-read")
    keyed.mapInArrow(run, READ).write.option("maxRecordsPerFile", 4).parquet(path)  # a reader holds many rows of a file
    return docs.sparkSession.read.schema(READ).parquet(path)


def word_counts(read: DataFrame) -> DataFrame:
    """(w, n), written: in how many of the documents that read_words() read each word is."""
    each = read.select(F.explode(F.arrays_zip("words", "df")).alias("x")).select(F.col("x.words").alias("w"), F.col("x.df").alias("n"))
    return stored(each.groupBy("w").agg(F.sum("n").alias("n")), "leak-counts")


def frequent_words(docs: DataFrame, n: int | None = None) -> list[str]:
    """The VOCABULARY words that most documents hold, counted over all of them (n is no longer asked for). docs: documents, or what read_words() or word_counts() made of them."""
    counts = docs if docs.columns == ["w", "n"] else word_counts(docs if "words" in docs.columns else read_words(docs))
    return [r["w"] for r in counts.orderBy(F.desc("n"), "w").limit(VOCABULARY).collect()]


def held_in(counts: DataFrame, items: Items) -> np.ndarray:
    """In how many documents each word of the vocabulary is, by word_counts()."""
    own = counts.sparkSession.createDataFrame(list(items.vocabulary.items()), "w string, k int")
    out = np.zeros(len(items.vocabulary))
    for r in counts.join(F.broadcast(own), "w").select("k", "n").collect():  # a row for each word of the vocabulary
        out[r["k"]] = r["n"]
    return out


def numbered(docs: DataFrame, items: Items) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, text_key, ids) of each document that has words: their numbers, -1 for words outside the vocabulary; and in how many documents each word is.

    docs: documents, or what read_words() made of them. Written once; each task adds one row with its document frequencies, which are summed by word.
    """
    read = docs if "words" in docs.columns else read_words(docs)
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)
    names = ["df", "doc_id", "text_key", "ids"]
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, df = shared.value, np.zeros(len(shared.value), dtype=np.int64)
        for b in (x.slice(i, 1) for x in batches for i in range(len(x))):
            words, held, doc, key, size = (b.column(i).flatten() for i in range(5))
            to = np.fromiter(map(vocabulary.get, words.to_pylist(), itertools.repeat(-1)), dtype=np.int32)
            df[to[to >= 0]] += held.to_numpy()[to >= 0]
            flat = to[np.frombuffer(b.column(5)[0].as_buffer(), dtype=np.int32)]
            edge = np.concatenate([[0], np.cumsum(size.to_numpy())]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([False] * len(doc), pa.bool_()), doc, key, pa.ListArray.from_arrays(pa.array(edge), pa.array(flat))], names)
        if df.any():
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((True, None, None, df.tolist()), kinds)], names)

    path = scratch_path(docs.sparkSession, "leak-words")
    read.mapInArrow(run, "df boolean, doc_id long, text_key long, ids array<int>").write.partitionBy("df").parquet(path)
    every = docs.sparkSession.read.schema("doc_id long, text_key long, ids array<int>, df boolean").parquet(path)
    out = np.zeros(len(items.vocabulary))
    for r in every.where("df").select(F.posexplode("ids").alias("w", "n")).groupBy("w").agg(F.sum("n").alias("n")).collect():  # a row for each word of the vocabulary
        out[r["w"]] = r["n"]
    return every.where("not df").drop("df"), out


def chunks(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, words, rows' starts in them and their end) for stretches of a batch of about CHUNK words; a longer text is one by itself."""
    lists = b.column(column)
    edge = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return stretches(lists.flatten().to_numpy(zero_copy_only=False), edge)


def stretches(flat: np.ndarray, edge: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """chunks() of texts whose words are flat and that begin and end at edge."""
    lo = 0
    while lo < len(edge) - 1:
        hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + CHUNK, side="right")) - 1)
        yield lo, flat[edge[lo] : edge[hi]], edge[lo : hi + 1] - edge[lo]
        lo = hi


def renumbered(b: pa.RecordBatch, row: int, vocabulary: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """chunks() of the texts of a row of READ, whose last columns are words, size and ids; -1 for words outside the vocabulary."""
    words, size, ids = (b.column(b.num_columns - 3 + i).slice(row, 1) for i in range(3))
    to = pc.fill_null(pc.index_in(words.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int32)
    flat = to[np.frombuffer(ids[0].as_buffer(), dtype=np.int32)]
    return stretches(flat, np.concatenate([[0], np.cumsum(size.flatten().to_numpy(zero_copy_only=False))]).astype(np.int64))


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where a new value begins in x, which is in order."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, dtype=np.int64)


def slots(ids: np.ndarray, place: np.ndarray, within: np.ndarray, rows: int, width: int, none: int) -> np.ndarray:
    """ids laid out as `rows` stretches of `width` words; ids under 0 and free places are `none`."""
    out = np.full(rows * width, none, dtype=np.int32)
    out[place * width + within] = np.where(ids < 0, none, ids)
    return out.reshape(rows, width)


def added(table: np.ndarray, laid: np.ndarray) -> np.ndarray:
    """The sum of table's rows for each row of laid, a few rows at a time, so that they stay in the processor's cache."""
    out = np.empty((len(laid), table.shape[1]), dtype=table.dtype)
    more = np.empty((min(NEAR_ROWS, len(laid)), table.shape[1]), dtype=table.dtype)
    for lo in range(0, len(laid), NEAR_ROWS):
        columns, own = np.ascontiguousarray(laid[lo : lo + NEAR_ROWS].T), out[lo : lo + NEAR_ROWS]
        np.take(table, columns[0], axis=0, out=own, mode="clip")
        for j in range(1, len(columns)):
            np.take(table, columns[j], axis=0, out=more[: len(own)], mode="clip")
            own += more[: len(own)]
    return out


def sums_by_word(word: np.ndarray, number: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct words, for each the sum of y's rows `number`). size: more than any word. Words that come up OFTEN as a product of matrices, the others occurrence by occurrence."""
    order = np.argsort(word.astype(np.uint16) if size <= 1 << 16 else word, kind="stable")  # short numbers are sorted by their digits
    word, number = word[order], number[order]
    begin = _firsts(word)
    many = np.diff(np.append(begin, len(word)))
    often, few = np.flatnonzero(many > OFTEN), np.flatnonzero(many <= OFTEN)
    out = []
    for some in (often[i : i + GROUP] for i in range(0, len(often), GROUP)):
        place = np.repeat(begin[some], many[some]) + np.arange(many[some].sum()) - np.repeat(np.cumsum(many[some]) - many[some], many[some])
        times = np.bincount(np.repeat(np.arange(len(some)), many[some]) * len(y) + number[place], minlength=len(some) * len(y))
        out.append(times.reshape(len(some), -1).astype(y.dtype) @ y)
    few = few[np.argsort(-many[few], kind="stable")]
    total = y[number[begin[few]]]
    for j in range(1, int(many[few].max(initial=0))):
        n = np.count_nonzero(many[few] > j)
        total[:n] += y[number[begin[few[:n]] + j]]
    return word[begin[np.concatenate([often, few])]], np.concatenate([*out, total])


def gram_part(ids: np.ndarray, edge: np.ndarray, weight: np.ndarray, weighted: np.ndarray, total: np.ndarray) -> int:
    """Adds A'A basis to total, A being the passages of some texts, each divided by the root of its words' squared weights; weighted is basis times the words' weights.

    The last rows of weight and weighted are zeros and stand for no word. Returns the passages that have words with weight.
    """
    step, none = STRIDE * PASSAGE, len(weight) - 1
    own = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    per = -(-np.diff(edge) // step)
    at = np.arange(len(ids)) - edge[own]
    place = (np.cumsum(per) - per)[own] + at // step
    laid = slots(ids, place, at % step, int(per.sum()), step, none)
    square = added((weight**2)[:, None], laid)[:, 0]
    y = added(weighted, laid) / np.maximum(square, 1e-12)[:, None]
    keep = (ids >= 0) & (weight[ids] > 0)
    word, number = ids[keep], place[keep]
    if len(word):
        each, sums = sums_by_word(word, number, y, none)
        total[each] += sums * weight[each, None]
    return int((square > 0).sum())


def _sum_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, dtype=np.float32).astype(np.float64) for x in pdf["data"])
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "n": [pdf["n"].sum()], "data": [total.astype(np.float32).tobytes()]})


def gram_times(words: DataFrame, items: Items, basis: np.ndarray, tasks: int) -> tuple[np.ndarray, int]:
    """A'A basis and the number of rows of A, A being all passages of words: in tasks, then summed by blocks of words in two steps.

    words: what read_words() or numbered() made of documents.
    """
    raw = "words" in words.columns
    known = words.sparkSession.sparkContext.broadcast(list(items.vocabulary))
    shared = words.sparkSession.sparkContext.broadcast((np.append(items.weight, np.float32(0)), np.vstack([basis * items.weight[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)))
    terms, dims = basis.shape
    edge = [terms * k // TERM_BLOCKS for k in range(TERM_BLOCKS + 1)]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, weighted = shared.value
        vocabulary = pa.array(known.value, pa.string())
        total, n = np.zeros((terms, dims), dtype=np.float32), 0
        for b in batches:
            for _, ids, at in itertools.chain.from_iterable(renumbered(b, k, vocabulary) for k in range(len(b))) if raw else chunks(b, 0):
                n += gram_part(ids, at, weight, weighted, total)
        if n:
            data = [total[a:z].tobytes() for a, z in zip(edge, edge[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(range(TERM_BLOCKS), pa.int32()), pa.array([n] + [0] * (TERM_BLOCKS - 1), pa.int64()), pa.array(data, pa.binary())], ["block", "n", "data"])

    kind = "block int, n long, data binary"
    each = words.select(*(["words", "size"] if raw else []), "ids").coalesce(tasks).mapInArrow(part, kind).withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = each.groupBy("block", "slot").applyInPandas(lambda pdf: _sum_blocks(pdf), kind)
    out, n = np.zeros((terms, dims)), 0
    for r in some.groupBy("block").applyInPandas(lambda pdf: _sum_blocks(pdf), kind).collect():  # TERM_BLOCKS rows, together the size of basis
        out[edge[r["block"]] : edge[r["block"] + 1]] = np.frombuffer(r["data"], dtype=np.float32).reshape(-1, dims)
        n += r["n"]
    return out, n


def latent_basis(words: DataFrame, items: Items, tasks: int = 8) -> np.ndarray:
    """The leading right singular vectors of all passages and items, by a randomised SVD in one pass (Nystrom's form, Tropp et al. 2017).

    The items together weigh as much as all passages together, so that what few documents leak has its directions
    too; yet there are fewer dimensions than items, and a dimension of its own for none.
    """
    terms, parts = len(items.weight), len(items.parts)
    k = max(1, min(DIMS, int(DIMS_SHARE * parts), terms))
    ell = min(terms, k + OVER)
    omega, _ = np.linalg.qr(np.random.default_rng(SEED).standard_normal((terms, ell)))
    y, n = gram_times(words, items, omega, tasks)
    y += max(n, 1) / parts * (items.matrix.T.astype(np.float64) @ (items.matrix @ omega))
    shift = 1e-6 * np.linalg.norm(y)
    y += shift * omega
    core = omega.T @ y
    lower = np.linalg.cholesky((core + core.T) / 2)
    left, _, _ = np.linalg.svd(np.linalg.solve(lower, y.T).T, full_matrices=False)
    return left[:, :k].astype(np.float32)


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel steps; ids under 0 match nothing."""
    where: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << k
    every = (1 << len(a)) - 1
    v = every
    for y in b.tolist():
        if (m := where.get(y)) and y >= 0:
            u = v & m
            v = (v + u | v - u) & every
    return len(a) - v.bit_count()


def accepted(share: float, cosine: float, answer: float, names: float) -> bool:
    """A copy, or a paraphrase with the answer: by its words, or by what it means and its names."""
    return share >= COPY or answer >= ANSWER and (any(share >= s and cosine >= c for s, c in PARAPHRASES) or cosine >= LATENT and names >= NAMES)


LEAKS = "doc_id long, text_key long, item_id long, cosine double, lcs double, start_word int, end_word int"


class Search:
    """Windows of texts against items in the latent space, then word by word."""

    def __init__(self, items: Items, basis: np.ndarray):
        self.parts, self.item, self.size, self.answers, self.phrases = items.parts, items.item, items.size, items.answers, items.phrases
        self.names = items.names
        # the last rows stand for no word
        self.weighted = np.vstack([basis * items.weight[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)
        latent = items.matrix @ basis
        self.latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        # the rarest words of each part that make up RARE of it, and how many of them a common subsequence of the least share must have
        least = self.least = min([COPY, *(s for s, _ in PARAPHRASES)])
        # in the same table and count: names, times MANY, for windows that mean the same
        self.rare, self.need, self.need_names = np.zeros((len(items.weight) + 1, len(items.parts)), dtype=np.uint16), np.zeros(len(items.parts), dtype=np.uint16), np.zeros(len(items.parts), dtype=np.uint16)
        self.holds = np.zeros(self.rare.shape, dtype=bool)
        for k, ids in enumerate(items.parts):
            words, times = np.unique(ids, return_counts=True)
            order = np.lexsort((words, -items.idf[words]))
            keep = order[: 1 + int(np.searchsorted(np.cumsum(times[order]), RARE * len(ids)))]
            self.rare[words[keep], k] = 1
            self.rare[np.unique(self.names[k]), k] += MANY
            self.need_names[k] = np.ceil(NAMES * len(self.names[k]) - 1e-6) if len(self.names[k]) > 1 else MANY - 1  # one name tells nothing
            self.holds[ids, k] = True
            self.need[k] = max(1, int(np.ceil(least * len(ids) - 1e-6)) - (len(ids) - int(times[keep].sum())))
        # GROUP parts at a time of a class: (width in strides, parts, their columns of `rare`)
        self.groups = []
        for (longest, width), (before, _) in zip(CLASSES, ((0, 0), *CLASSES)):
            mine = np.flatnonzero((self.size <= longest) & (self.size > before))
            self.groups += [(width, mine[i : i + GROUP], np.ascontiguousarray(self.rare[:, mine[i : i + GROUP]])) for i in range(0, len(mine), GROUP)]

    def candidates(self, ids: np.ndarray, edge: np.ndarray, least: float = COSINE, counted: bool = True) -> Iterator[tuple[int, int, int, int, float]]:
        """(row, part, start, end, cosine) of the windows and parts from latent cosine `least`, start and end as words of the row.

        counted: leave out windows that hold too few of a part's rare words, in any order, for any check of words to pass, unless they have names enough and
        a cosine of LATENT. Both are counted for whole matrices, so that such pairs aren't looked at one by one.
        """
        length = np.diff(edge)
        per = -(-length // STRIDE)
        pad = max(width for _, width in CLASSES)  # blocks of no words between texts
        base = np.cumsum(per + pad) - per - pad
        own = np.repeat(np.arange(len(length)), length)
        block = base[own] + (np.arange(len(ids)) - edge[own]) // STRIDE
        blocks = int((per + pad).sum())
        laid = slots(ids, block, (np.arange(len(ids)) - edge[own]) % STRIDE, blocks, STRIDE, len(self.weighted) - 1)
        row = np.repeat(np.arange(len(length)), per + pad)
        number = np.arange(blocks) - base[row]
        for width, group, rare in self.groups:
            valid = number[: blocks - width + 1] < np.maximum(1, per[row[: blocks - width + 1]] - width + 1)
            valid &= per[row[: blocks - width + 1]] > 0
            need, need_names = self.need[group], self.need_names[group] * MANY
            # sums go round at 2 ** 16, differences of a window's length don't
            count = np.zeros((blocks + 1, len(group)), dtype=np.uint16)
            np.cumsum(added(rare, laid), axis=0, dtype=np.uint16, out=count[1:])
            for lo in range(0, len(valid), 1024):
                hi = min(lo + 1024, len(valid))
                held = count[lo + width : hi + width] - count[lo:hi]
                by_words = (held & (MANY - 1)) >= need if counted else np.ones(held.shape, dtype=bool)
                may = (by_words | (held >= need_names)) & valid[lo:hi, None]
                some = np.flatnonzero(may.any(axis=1)) + lo
                if not len(some):
                    continue
                x = added(self.weighted, laid[some[:, None] + np.arange(width)].reshape(len(some), -1))
                cosine = x @ self.latent[group].T
                cosine /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                for w, m in zip(*np.nonzero((cosine >= np.where(by_words[some - lo], least, LATENT)) & may[some - lo])):
                    r, a = int(row[some[w]]), int(number[some[w]]) * STRIDE
                    yield r, int(group[m]), a, min(a + width * STRIDE, int(length[r])), float(cosine[w, m])

    def leaks(self, ids: np.ndarray, edge: np.ndarray) -> list[tuple[int, int | None, float, float, int, int]]:
        """(row, item, cosine, LCS share, start, end) of the best window of each row and part that passes all checks, and of phrases."""
        found: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        for r, part, a, z, cosine in self.candidates(ids, edge):
            found.setdefault((r, part), []).append((a, z, cosine))
        best: dict[tuple[int, int], tuple] = {}
        for (r, part), windows in found.items():
            it, text, names = self.parts[part], ids[edge[r] : edge[r + 1]], self.names[part]
            enough, enough_names = self.least * len(it) - 1e-6, NAMES * len(names) - 1e-6
            windows.sort()
            at = 0
            while at < len(windows):  # neighbouring windows as one stretch: what it doesn't hold none of them does
                to, end = at + 1, windows[at][1]
                while to < len(windows) and windows[to][0] <= end:
                    to, end = to + 1, max(end, windows[to][1])
                begin = windows[at][0]
                in_part = self.holds[text[begin:end], part]  # nothing else can be in common
                stretch = text[begin:end][in_part]
                same = max(c for _, _, c in windows[at:to]) >= LATENT and np.count_nonzero(self.rare[stretch, part] >= MANY) >= enough_names
                if len(stretch) >= enough and lcs(it, stretch) >= enough or same and lcs(names, stretch) >= enough_names:
                    for a, z, cosine in windows[at:to]:
                        own = text[a:z][in_part[a - begin : z - begin]]
                        share = lcs(it, own) / len(it)
                        answer = len(self.answers[part].intersection(own.tolist())) / len(self.answers[part])
                        if accepted(share, cosine, answer, lcs(names, own) / len(names)):
                            one = (round(share, 4), round(min(cosine, 1.0), 4), -a, z)
                            best[r, part] = max(best.get((r, part), one), one)
                at = to
        out = [(r, self.item[part], cosine, share, -a, z) for (r, part), (share, cosine, a, z) in best.items()]
        for item, phrase in self.phrases:
            at = np.flatnonzero(ids[: len(ids) - len(phrase) + 1] == phrase[0])
            for j in range(1, len(phrase)):
                at = at[ids[at + j] == phrase[j]]
            row = np.searchsorted(edge, at, side="right") - 1
            whole = at + len(phrase) <= edge[row + 1]
            for k in _firsts(row[whole]):
                r, a = int(row[whole][k]), int(at[whole][k] - edge[row[whole][k]])
                out.append((r, item, 1.0, 1.0, a, a + len(phrase)))
        return out


def search(read: DataFrame, items: Items, basis: np.ndarray) -> DataFrame:
    """LEAKS of all documents that read_words() read."""
    shared = read.sparkSession.sparkContext.broadcast((Search(items, basis), list(items.vocabulary)))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vocabulary = shared.value[0], pa.array(shared.value[1], pa.string())
        for b, k in ((b, k) for b in batches for k in range(len(b))):
            doc, key = b.column(0).slice(k, 1).flatten(), b.column(1).slice(k, 1).flatten()
            for lo, ids, edge in renumbered(b, k, vocabulary):
                if found := own.leaks(ids, edge):
                    at = pa.array([lo + f[0] for f in found], pa.int64())
                    rest = [pa.array(c, k) for c, k in zip(list(zip(*found))[1:], kinds[2:])]
                    yield pa.RecordBatch.from_arrays([doc.take(at), key.take(at), *rest], [x.split()[0] for x in LEAKS.split(", ")])

    return read.select("doc_id", "text_key", "words", "size", "ids").mapInArrow(run, LEAKS)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """LEAKS, the best of each document and item, of docs (doc_id, text) against benchmark (item_id, text).

    Documents without a leak have no row; so have null and empty texts, and an empty table on either side has
    none. Items under LEAST_ITEM words are found as phrases, word for word; items without words never. Null ids
    are kept as they are. Texts are read once, however many blocks there are. Repeated rows of a document give one row for each item. Frequencies and the decomposition
    are taken over all of docs. A benchmark of up to BLOCK items takes one scan of the texts; a larger one goes
    through in blocks of about that size, so that what is broadcast doesn't grow with it.
    """
    spark = docs.sparkSession
    blocks = max(1, -(-benchmark.count() // BLOCK))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    n = docs.count()
    every, read = spark.createDataFrame([], LEAKS), None
    for k in range(blocks):
        rows = benchmark.where(number == k).select(F.col("item_id").cast("long"), "text").distinct().orderBy("item_id", "text").collect()  # about BLOCK rows
        items = Items([(r[0], r[1]) for r in rows])
        if not n or not items.vocabulary:
            continue
        if read is None:
            read = read_words(docs)
            counts = word_counts(read)
            frequent = frequent_words(counts)
            total = read.agg(F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
        items.extend(frequent)
        items.weigh(held_in(counts, items), n)
        tasks = max(spark.sparkContext.defaultParallelism, -(-total // WORDS_PER_TASK))
        basis = latent_basis(read, items, tasks) if items.parts else np.zeros((len(items.vocabulary), 1), dtype=np.float32)
        every = every.unionByName(search(read, items, basis))
    best = F.max(F.struct("lcs", "cosine", (-F.col("start_word")).alias("s"), F.col("end_word").alias("e"))).alias("b")
    return every.groupBy("doc_id", "text_key", "item_id").agg(best).select("doc_id", "text_key", "item_id", F.col("b.cosine").alias("cosine"), F.col("b.lcs").alias("lcs"), (-F.col("b.s")).alias("start_word"), F.col("b.e").alias("end_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold an item: found by what they say, so rows without doc_id go too, and copies together. Any column names are fine."""
    bad = stored(find_leaks(docs, benchmark).select("text_key").distinct(), "leak-keys")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    return keyed.join(bad, "text_key", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
