"""Product codes of vectors, found exactly in integers by Walsh-Hadamard transforms.

Components become integers, vectors are cut into parts, and each part is coded by its nearest codebook entry.
Parts and entries are padded with zeros to a power of two and transformed; the transform is orthogonal up to
its length h, so that the sum of squared differences of coefficients is h times the squared distance. Sums
are built up in sequency order (slow changes first, where most of a difference lies), and an entry
is out as soon as its sum exceeds the whole sum of the entry that led after the first coefficient. No floating point
after the components are integers: ties are ties.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.common import stored

#: Parts of a vector, entries of a part's codebook, rounds of refinement, and what components are multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that are looked at together.
TOGETHER = 4096
MOST_LONG = 2**63 - 1


def sequency(h: int) -> np.ndarray:
    """Rows of the Hadamard matrix of size h (a power of two) in the order of their sign changes: reversed bits of the Gray code."""
    bits = h.bit_length() - 1
    gray = np.arange(h) ^ (np.arange(h) >> 1)
    return sum((((gray >> b) & 1) << (bits - 1 - b) for b in range(bits)), np.zeros(h, dtype=np.int64))


def walsh(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the last axis (of a length that is a power of two), in sequency order."""
    h, step = x.shape[-1], 1
    while step < h:
        pair = x.reshape(*x.shape[:-1], h // (2 * step), 2, step)
        a, b = pair[..., 0, :], pair[..., 1, :]
        x = np.stack([a + b, a - b], axis=-2).reshape(x.shape)
        step *= 2
    return x[..., sequency(h)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the index of its nearest entry (the lowest of equals) and the squared distance times h. Both in sequency order: (n, h), (k, h)."""
    first = x[:, :1] - entries[:, 0]
    first = first * first
    lead = x - entries[first.argmin(axis=1)]
    bound = (lead * lead).sum(axis=1)
    row, entry = np.nonzero(first <= bound[:, None])
    so_far = first[row, entry]
    for k in range(1, x.shape[1]):
        away = x[row, k] - entries[entry, k]
        so_far = so_far + away * away
        stay = so_far <= bound[row]  # the leader stays always
        row, entry, so_far = row[stay], entry[stay], so_far[stay]
    begin = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(so_far, begin)
    best = np.flatnonzero(so_far == least[row])  # in the order of rows, then of entries
    return entry[best[np.diff(row[best], prepend=-1) != 0]], least


def integers(column: pa.Array, dim: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of a list column of doubles as (n, dim), shorter vectors filled up with zeros: int64, or Python's integers if any doesn't fit 53 bits."""
    flat, size = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    low = np.floor(flat.astype(np.float64) * scale)  # scale is a power of two: exact
    out = np.zeros((len(size), dim), dtype=np.int64)
    if len(low) and np.abs(low).max() >= 2**53:
        out, low = out.astype(object), np.array([int(v) for v in low], dtype=object)
    if len(size) and (size == dim).all():
        return low.reshape(len(size), dim).astype(out.dtype)
    out[np.arange(dim) < size[:, None]] = low
    return out


@dataclass(frozen=True)
class Codebooks:
    """entries: (parts, entries, length of a part) integers."""

    entries: np.ndarray
    scale: int = SCALE

    @property
    def dim(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assigned(self, v: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, its vectors, index of the nearest entry, squared distance) for each part of v (n, dim)."""
        parts, count, length = self.entries.shape
        h = 1 << (length - 1).bit_length()
        most = max(int(np.abs(v).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        kind = np.int64 if (2 * most * h) ** 2 < 2**62 else object  # else Python's integers
        padded = np.zeros((len(v), h), dtype=kind)
        own = np.zeros((count, h), dtype=kind)
        for p in range(parts):
            x = v[:, p * length : (p + 1) * length]
            padded[:, :length], own[:, :length] = x, self.entries[p]
            index, far = nearest(walsh(padded), walsh(own))
            yield p, x, index, far // h

    def decode(self, codes: list[str]) -> np.ndarray:
        """The vectors that codes stand for, as floats."""
        at = np.array([list(bytes.fromhex(c)) for c in codes], dtype=np.int64).reshape(len(codes), len(self.entries))
        return np.hstack([self.entries[p][at[:, p]] for p in range(len(self.entries))]).astype(float) / self.scale


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vector array<double>) of the rows of vectors (vec_id, embedding, label) whose vector is there and has no null or non-finite component."""
    x = F.col("embedding").cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & ~odd).select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("vector"))


def fit(found: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of kept() vectors; None if there are none.

    They begin with the vectors of the smallest vec_ids (those without one never; equal ones by their components) and each round assigns
    all vectors. The driver and each task hold `entries` vectors; sums of a part's entry meet as Python's integers.
    """
    length = found.agg(F.max(F.size("vector"))).first()[0]
    rows = [] if length is None else found.where("vec_id is not null").orderBy("vec_id", "vector").select("vector").limit(entries).collect()
    if not rows:
        return None
    length = max(1, -(-length // parts))
    first = integers(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())), parts * length, scale)
    books = Codebooks(np.ascontiguousarray(first.reshape(len(rows), parts, length).swapaxes(0, 1)), scale)
    for _ in range(rounds):
        books = refined(found, books)
    return books


def refined(found: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry becomes the floor of the mean of its parts; unused ones stay."""
    parts, count, length = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, count), dtype=np.int64), np.zeros((parts, count, length), dtype=object)
        for b in (x.slice(i, TOGETHER) for x in batches for i in range(0, len(x), TOGETHER)):
            v = integers(b.column(0), books.dim, books.scale)
            for p, x, index, _ in books.assigned(v):
                n[p] += np.bincount(index, minlength=count)
                some = np.zeros((count, length), dtype=v.dtype)
                np.add.at(some, index, x)
                total[p] += some
        used = np.argwhere(n)
        if len(used):
            sums_ = [[str(s) for s in total[p, e]] for p, e in used]
            yield pa.RecordBatch.from_arrays([pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array([n[p, e] for p, e in used], pa.int64()), pa.array(sums_, pa.list_(pa.string()))], ["part", "entry", "n", "total"])

    def means(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (part, entry), own in pdf.groupby(["part", "entry"]):
            n = int(own["n"].sum())
            out.append((part, entry, [str(sum(int(t[k]) for t in own["total"]) // n) for k in range(length)]))
        return pd.DataFrame(out, columns=["part", "entry", "mean"])

    some = found.select("vector").mapInArrow(sums, "part int, entry int, n long, total array<string>")
    new = books.entries.astype(object)
    for r in some.groupBy("part", (F.col("entry") % 4).alias("lot")).applyInPandas(means, "part int, entry int, mean array<string>").collect():  # a row for each entry
        new[r["part"], r["entry"]] = [int(x) for x in r["mean"]]
    fits = all(abs(x) < 2**53 for x in new.ravel())
    return Codebooks(new.astype(np.int64) if fits else new, books.scale)


def encode(found: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distances summed over parts; MOST_LONG if it doesn't fit) of kept() vectors."""
    schema = found.select("vec_id", "label").schema.add("code", "string").add("error", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, TOGETHER) for x in batches for i in range(0, len(x), TOGETHER)):
            codes, error = np.zeros((len(b), len(books.entries)), dtype=np.uint8), np.zeros(len(b), dtype=object)
            for p, _, index, far in books.assigned(integers(b.column(2), books.dim, books.scale)):
                codes[:, p] = index
                error = error + far
            out = [pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array([min(int(e), MOST_LONG) for e in error], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *out], ["vec_id", "label", "code", "error"])

    return found.select("vec_id", "label", "vector").mapInArrow(run, schema)


def code_table(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each row of vectors (vec_id, embedding, label) with a whole vector.

    Rows whose vector is null or has null, NaN or infinite components are dropped. A null vec_id is coded but is never
    part of a codebook; repeated rows are coded like any other. Fewer than ENTRIES vectors make smaller codebooks.
    Vectors of other lengths than a multiple of PARTS, or of different lengths, count as filled up with zeros; an empty vector
    is one of zeros. Sums that don't fit a long are its maximum. If no row has both an id and a vector, there is no row.
    """
    found = kept(vectors)
    books = fit(found)
    if books is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = stored(encode(found, books), "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST_LONG).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """Assignment a{k} by the codebooks c{k}: the nearest entry of each part; the key holds distance and entry."""
    return f"""
s{k} as (
  select x.rid, x.part, min(d * 64 + entry) as near
  from (
    select x.rid, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v)) as d
    from x join c{k} c on c.part = x.part and c.pos = x.pos
    group by x.rid, x.part, c.entry
  ) x
  group by x.rid, x.part
),
a{k} as (select rid, part, near % 64 as entry, near // 64 as d from s{k})"""


def _means(k: int) -> str:
    """Codebooks c{k + 1}: floors of the means of what c{k} was assigned."""
    return f"""
m{k} as (
  select a.part, a.entry, x.pos, sum(x.v)::hugeint as s, count(*)::hugeint as n
  from a{k} a join x on x.rid = a.rid and x.part = a.part
  group by a.part, a.entry, x.pos
),
c{k + 1} as (
  select c.part, c.entry, c.pos, coalesce(((m.s - ((m.s % m.n) + m.n) % m.n) // m.n)::bigint, c.v) as v
  from c{k} c left join m{k} m on m.part = c.part and m.entry = c.entry and m.pos = c.pos
)"""


ORACLE_SQL = f"""
with kept as (
  select row_number() over (order by vec_id) as rid, vec_id, label, embedding
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0
),
flat as (select rid, unnest(embedding) as e, unnest(range(len(embedding))) as i, len(embedding) // 16 as length from kept),
x as materialized (select rid, i // length as part, i % length as pos, floor(256 * e::double)::bigint as v from flat),
c0 as (select part, rid - 1 as entry, pos, v from x where rid <= 64),
{_round(0)},
{_means(0)},
{_round(1)},
{_means(1)},
{_round(2)},
coded as (
  select k.vec_id, k.label, c.code, c.error
  from kept k join (
    select rid, string_agg(lpad(to_hex(entry), 2, '0'), '' order by part) as code, sum(d)::bigint as error from a2 group by rid
  ) c on c.rid = k.rid
),
by_label as (select label, sum(error)::bigint as label_error from coded group by label)
select c.vec_id, lower(c.code) as code, c.error, l.label_error,
  (select sha256(string_agg(v::varchar, ',' order by part, entry, pos)) from c2) as codebooks_sha256
from coded c join by_label l on l.label is not distinct from c.label
"""
