"""Conflict-constrained best-fit packing of documents into bins of a fixed number of tokens.

Documents are dealt by hash into shards of bounded size; each shard is packed on its own, so nothing is
gathered beyond a shard. Within one, documents come longest first. Open bins are ordered by residual and
carry bitmaps of the source slots and duplicate clusters they hold. The successor search begins at the least
residual that fits and goes on to the next until the tightest bin without a conflict is found.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.common import stored

#: Tokens of a bin; documents of a shard, about.
CAPACITY, SHARD = 2048, 8192
#: A source with this share or more of a bin's worth of documents gets slots by its share; others get one slot.
PIECES = "bin_id long, doc_id long, piece int, start_token int, n_tokens int, residual int"


class Bins:
    """Open bins of one shard by residual, for best-fit with conflicts."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.occupied = 0  # bit r: some open bin has residual r
        self.residual: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def open(self) -> int:
        self.residual.append(self.capacity)
        self.sources.append(0)
        self.clusters.append(0)
        return len(self.residual) - 1

    def successors(self, size: int) -> Iterator[int]:
        """Open bins that have room for size, the tightest first, oldest first among equals."""
        r, rest = size, self.occupied >> size
        while rest:
            step = (rest & -rest).bit_length() - 1
            r, rest = r + step, rest >> step
            yield from self.by_residual[r]
            r, rest = r + 1, rest >> 1

    def put(self, b: int, size: int, source: int, cluster: int) -> None:
        old, new = self.residual[b], self.residual[b] - size
        if b in (at := self.by_residual[old]):
            at.remove(b)
            if not at:
                self.occupied &= ~(1 << old)
        if new:
            self.by_residual[new].append(b)
            self.occupied |= 1 << new
        self.residual[b] = new
        self.sources[b] |= source
        self.clusters[b] |= cluster


def pack_shard(docs: list[tuple], capacity: int, quota: dict[str | None, int]) -> list[tuple[int, int | None, int, int, int]]:
    """(bin, index of the document, piece, start token, tokens) for docs (index, source, cluster, tokens) of one shard.

    A document longer than a bin fills bins of its own and packs what is left over. A document without
    tokens gets an empty piece. No bin holds two documents of one cluster, or more of one source than its quota.
    """
    bins, out = Bins(capacity), []
    copies = Counter(cluster for _, _, cluster, _ in docs)
    shared = {cluster: k for k, cluster in enumerate(c for c, n in copies.items() if n > 1)}
    source_at: dict[object, tuple[int, int]] = {}
    slots = 0
    items = []
    for i, source, cluster, tokens in docs:
        if source not in source_at:
            source_at[source] = (slots, q := quota.get(source, 1))
            slots += q
        full, rest = divmod(tokens, capacity)
        for piece in range(full):
            b = bins.open()
            bins.residual[b] = 0
            out.append((b, i, piece, piece * capacity, capacity))
        if rest or not full:
            items.append((rest, source, cluster, i, full))
    # equal size, cluster and source stand together: a later copy takes up the search where the last one left off
    items.sort(key=lambda x: (-x[0], str(x[2]), str(x[1]), x[3]))
    last, cursor = None, None
    for size, source, cluster, i, piece in items:
        cbit = 1 << shared[cluster] if cluster in shared else 0
        at, q = source_at[source]
        mask = (1 << q) - 1
        if cbit and last == (size, cluster, source):
            search = cursor
        else:
            # a snapshot: placing a copy moves its bin to a lower residual, which this size has passed or can't use again
            search = iter(list(bins.successors(size))) if cbit else bins.successors(size)
        last, cursor = (size, cluster, source), search
        chosen, slot = None, 0
        for b in search:
            held = (bins.sources[b] >> at) & mask
            if not bins.clusters[b] & cbit and held != mask and bins.residual[b] >= size:
                chosen, slot = b, (~held & (held + 1))
                break
        if chosen is None:
            chosen, slot = bins.open(), 1
        bins.put(chosen, size, slot << at, cbit)
        out.append((chosen, i, piece, piece * capacity, size))
    return [(*row, bins.residual[row[0]]) for row in out]


def source_quota(sized: DataFrame, capacity: int) -> dict[str | None, int]:
    """Slots of the sources that have more than one document in an average bin: twice their share. At most twice as many sources as a bin has documents."""
    total = sized.agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).first()
    if not total["n"]:
        return {}
    per_bin = max(1.0, total["n"] / max(1.0, (total["t"] or 0) / capacity))
    per_bin = min(per_bin, 64.0)
    big = sized.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") * 2 * per_bin > total["n"])
    return {r["source"]: max(1, -(-int(2 * per_bin * r["n"]) // total["n"])) for r in big.collect()}


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """One row for each piece of each document of docs (doc_id, text, source): bin_id, doc_id, piece, start_token, n_tokens, residual.

    Tokens are runs of anything but white space. Two texts that differ only in case and white space are of one
    duplicate cluster and never share a bin. Null and empty texts have 0 tokens and still get a bin; a null
    source is a source; null doc_ids and repeated rows are packed like any other row. bin_id is unique
    over all shards; residual is the bin's free room at the end.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^ \t-\r]+")).cast("int").alias("tokens"),
        F.xxhash64(F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[ \t-\r]+", " "))).alias("cluster"),
        F.monotonically_increasing_id().alias("rid"),
    )
    sized = stored(sized, "packing-sizes")
    shards = max(1, -(-sized.count() // shard))
    quota = source_quota(sized, capacity)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "cluster", "tokens"], kind="stable", na_position="first").reset_index(drop=True)
        ids, base = pdf["doc_id"], int(pdf["shard"].iloc[0]) << 32
        sources = [None if s is None or s != s else s for s in pdf["source"]]
        rows = pack_shard(list(zip(range(len(pdf)), sources, pdf["cluster"].tolist(), pdf["tokens"].tolist())), capacity, quota)
        out = pd.DataFrame(rows, columns=["bin_id", "i", "piece", "start_token", "n_tokens", "residual"])
        out["bin_id"] += base
        out["doc_id"] = ids.iloc[out["i"]].astype("Int64").to_numpy(dtype=object, na_value=None)
        return out[["bin_id", "doc_id", "piece", "start_token", "n_tokens", "residual"]].astype({"doc_id": "Int64"})

    # rows without an id are dealt by their place, so that many of them don't meet
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", F.when(F.col("doc_id").isNull(), F.col("rid"))), F.lit(shards)).cast("int"))
    return dealt.repartition(min(shards, 2000), "shard").groupBy("shard").applyInPandas(run, PIECES)
