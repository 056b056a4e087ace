"""The atlas of anchors: clustering, stability, matching, assignment, health, forgetting."""

from __future__ import annotations

import time
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestore.functions import unit
from lodestore.operators.retrieval import small, vector_top
from lodestore.sources.files import stored, whole_tables

NOVEL = 0.7
ANCHOR_BUDGET, NOVELTY_ANCHORS = 20, 32
#: Vectors that a clustering begins with, at most; stability under which one is rejected.
SEEDED, STABLE = 20_000, 0.6
#: Vectors of a block, which are compared with all centroids at once; seconds after which a clustering writes where it is.
TOGETHER, WRITE_EVERY = 4096, 10
CENTROIDS = "anchor_id int, centroid array<double>"


def clusters(n: int) -> int:
    """Clusters for n memories: a fifth of them, 8 to 224."""
    return min(224, max(8, n // 5))


def nearest(vectors: DataFrame, centroids: DataFrame, most: int = 1, keep: bool = False) -> DataFrame:
    """(id, anchor_id, similarity, rank[, vec]): the closest centroids (anchor_id, centroid) of each vector (id, vec), found where the vector lies."""
    return vector_top(vectors, "id", "vec", centroids, "anchor_id", "centroid", most, keep).withColumnRenamed("score", "similarity")


def lloyd_step(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(anchor_id, centroid): unit means of the vectors nearest to each centroid; one without vectors stays.

    Each task hands on one partial sum for each anchor.
    """
    near = nearest(vectors, centroids, keep=True)
    mean = near.groupBy("anchor_id").agg(Summarizer.mean(array_to_vector(F.col("vec").cast("array<double>"))).alias("m"))
    return centroids.join(mean.select("anchor_id", vector_to_array("m").alias("m")), "anchor_id", "left").select("anchor_id", F.coalesce(unit("m"), F.col("centroid").cast("array<double>")).alias("centroid"))


def spread_out(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows of sample (unit vectors): the first at random, each next one with a chance in proportion to max(0, 1 - its cosine to the nearest so far)."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(sample)))]
    near = sample @ sample[chosen[0]]
    while len(chosen) < min(k, len(sample)):
        weight = np.maximum(0.0, 1.0 - near)
        weight[chosen] = 0.0
        p = weight / weight.sum() if weight.sum() > 0 else None
        pick = int(rng.choice(len(sample), p=p)) if p is not None else next(i for i in range(len(sample)) if i not in set(chosen))
        chosen.append(pick)
        near = np.maximum(near, sample @ sample[pick])
    return sample[chosen]


def packed(vectors: DataFrame) -> DataFrame:
    """(block): the vectors (vec) as blocks of their doubles, written once for the many passes that read them."""
    spark = vectors.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, TOGETHER) for x in batches for i in range(0, len(x), TOGETHER)):
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes()], pa.binary())], ["block"])

    given = vectors.where("vec is not null").repartition(spark.sparkContext.defaultParallelism, "id").select("vec")
    return stored(spark, given.mapInArrow(run, "block binary"), "vectors")


def closest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The first row of centroids with the greatest cosine (six decimals) to each row of x (unit vectors).

    Single precision finds it, unless another one comes so near that it takes double precision and the rounding.
    """
    s = x.astype(np.float32) @ centroids.T.astype(np.float32)
    first = s.argmax(axis=1)
    margin = np.float32(2e-6 + 2.0**-22 * (x.shape[1] + 2))
    near = np.count_nonzero(s >= (s[np.arange(len(s)), first] - margin)[:, None], axis=1)
    if len(close := np.flatnonzero(near != 1)):
        first[close] = np.argsort(-np.round(x[close] @ centroids.T, 6), axis=1, kind="stable")[:, 0]
    return first


def member_sums(blocks: DataFrame, centroids: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sums, counts) of the vectors nearest to each of the centroids, for each clustering. One pass for all; a task hands on one row for each centroid."""
    d, starts = centroids[0].shape[1], np.cumsum([0] + [len(c) for c in centroids])
    shared = blocks.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((starts[-1], d)), np.zeros(starts[-1], dtype=np.int64)
        for block in (v.as_buffer() for b in batches for v in b.column(0)):
            x = np.frombuffer(block, dtype=np.float64).reshape(-1, d)
            for start, own in zip(starts, shared.value):
                label = closest(x, own)
                order = np.argsort(label, kind="stable")
                at = np.flatnonzero(np.append(True, label[order][1:] != label[order][:-1]))
                some = start + label[order][at]
                total[some] += np.add.reduceat(x[order], at, axis=0)
                n[some] += np.diff(np.append(at, len(x)))
        held = np.flatnonzero(n)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * d, pa.int32()), pa.array(total[held].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held]), flat], ["at", "n", "total"])

    parts = blocks.mapInArrow(run, "at long, n long, total array<double>")
    got = parts.groupBy("at").agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("total")).alias("total")).collect()  # a row for each centroid
    shared.unpersist()
    total, n = np.zeros((starts[-1], d)), np.zeros(starts[-1], dtype=np.int64)
    for r in got:
        total[r["at"]], n[r["at"]] = r["total"].toArray(), r["n"]
    return [(total[i:j], n[i:j]) for i, j in zip(starts, starts[1:])]


def clusterings(vectors: DataFrame, blocks: DataFrame, k: int, seeds: tuple[int, ...], rounds: int, tolerance: float, sample: int, paths: list[str | None]) -> list[np.ndarray]:
    """Centroids of spherical_kmeans() for each seed. All seeds that aren't settled take their next step in the same pass over blocks, the packed() vectors."""
    spark = vectors.sparkSession
    now, drawn, done, settled = [], [], [], []
    for seed, path in zip(seeds, paths):
        rows = vectors.where("vec is not null").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).select("vec").collect()
        drawn.append(np.array([r["vec"] for r in rows], dtype=float))
        made = whole_tables(spark, path, "round-") if path and rows else []
        done.append(int(made[-1].rpartition("-")[2]) if made else 0)
        state = spark.read.parquet(made[-1]).orderBy("anchor_id").collect() if made else []  # k rows
        settled.append(not rows or bool(state and state[0]["settled"]))
        now.append(np.array([r["centroid"] for r in state]) if state else spread_out(drawn[-1], k, seed) if rows else drawn[-1])
    written = time.monotonic()
    while some := [i for i in range(len(seeds)) if not settled[i] and done[i] < rounds]:
        late = time.monotonic() - written > WRITE_EVERY
        for i, (total, n) in zip(some, member_sums(blocks, [now[i] for i in some])):
            new = drawn[i][np.random.default_rng([seeds[i], done[i]]).integers(len(drawn[i]), size=len(now[i]))]
            mean = total / np.maximum(n, 1)[:, None]
            size = np.linalg.norm(mean, axis=1)
            new[size > 0] = mean[size > 0] / size[size > 0, None]
            shift, now[i], done[i] = np.linalg.norm(new - now[i], axis=1).max(), new, done[i] + 1
            settled[i] = bool(shift < tolerance)
            if paths[i] and (late or settled[i] or done[i] == rounds):
                state = spark.createDataFrame([(j, c, settled[i]) for j, c in enumerate(now[i].tolist())], CENTROIDS + ", settled boolean")
                state.coalesce(1).write.mode("overwrite").parquet(f"{paths[i]}/round-{done[i]:06d}")
                written = time.monotonic()
    return now


def spherical_kmeans(vectors: DataFrame, k: int, seed: int, rounds: int = 200, tolerance: float = 1e-4, sample: int = SEEDED, path: str | None = None) -> DataFrame:
    """(anchor_id, centroid) after Lloyd steps over all unit vectors (id, vec), until no centroid moves by `tolerance`.

    It begins with spread_out() of up to `sample` vectors, drawn by hash of seed and id; a centroid that no vector is nearest to is
    drawn anew from them. Centroids are k rows and pass the driver each round; vectors beyond the sample never do.
    path: a folder of this clustering alone, where the last round is written and one every WRITE_EVERY seconds; a run that is started
    again goes on from the last whole one.
    """
    now = clusterings(vectors, packed(vectors), k, (seed,), rounds, tolerance, sample, [path])[0]
    return vectors.sparkSession.createDataFrame(list(enumerate(now.tolist())), CENTROIDS)


def rand_index(pairs: DataFrame) -> DataFrame:
    """One row: the adjusted Rand index (ari) of two labellings (a, b), from their contingency counts, and its stability (ari + 1) / 2."""
    c = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    choose = lambda col: F.sum(col * (col - 1) / 2)
    both = c.agg(choose(F.col("n")).alias("s"), F.sum("n").alias("n"))
    rows = c.groupBy("a").agg(F.sum("n").alias("n")).agg(choose(F.col("n")).alias("sa"))
    columns = c.groupBy("b").agg(F.sum("n").alias("n")).agg(choose(F.col("n")).alias("sb"))
    one = both.crossJoin(rows).crossJoin(columns)
    due = F.col("sa") * F.col("sb") / (F.col("n") * (F.col("n") - 1) / 2)
    ari = (F.col("s") - due) / ((F.col("sa") + F.col("sb")) / 2 - due)
    return one.select(F.round(ari, 6).alias("ari"), F.round((ari + 1) / 2, 6).alias("stability"))


def stability(labels: DataFrame, columns: list[str], least: float = STABLE) -> DataFrame:
    """One row: the mean of the stabilities of each two of columns (labellings of one row each), and whether it reaches `least`."""
    each = [rand_index(labels.select(F.col(x).alias("a"), F.col(y).alias("b"))).select("stability") for x, y in combinations(columns, 2)]
    mean = F.round(F.avg("stability"), 6)
    return reduce(DataFrame.unionByName, each).agg(mean.alias("stability"), (mean >= least).alias("accepted"))


def stable_atlas(vectors: DataFrame, k: int, seeds: tuple[int, ...] = (0, 1, 2), least: float = STABLE, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(centroids of the first seed, stability() of the clusterings of all seeds). Each clustering labels all vectors. path: as in spherical_kmeans().

    The clusterings go on side by side, so that a pass over the vectors serves all of them.
    """
    spark, blocks = vectors.sparkSession, packed(vectors)
    made = clusterings(vectors, blocks, k, seeds, 200, 1e-4, SEEDED, [path and f"{path}/seed-{seed}" for seed in seeds])
    shared, names = spark.sparkContext.broadcast(made), [f"l{n}" for n in range(len(seeds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (v.as_buffer() for b in batches for v in b.column(0)):
            x = np.frombuffer(block, dtype=np.float64).reshape(-1, shared.value[0].shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(closest(x, c), pa.int32()) for c in shared.value], names)

    labels = stored(spark, blocks.mapInArrow(run, ", ".join(f"{n} int" for n in names)), "labels")
    return spark.createDataFrame(list(enumerate(made[0].tolist())), CENTROIDS), stability(labels, names, least)


def matched(new: DataFrame, old: DataFrame, least: float = 0.5) -> DataFrame:
    """(new_id, old_id, similarity): one to one, greedily from the highest cosine. new: (new_id, vec), old: (old_id, vec); a few hundred each, one group."""

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        out, used_new, used_old = [], set(), set()
        for r in pdf.sort_values(["similarity", "new_id", "old_id"], ascending=[False, True, True]).itertuples():
            if r.new_id not in used_new and r.old_id not in used_old:
                used_new.add(r.new_id)
                used_old.add(r.old_id)
                out.append((r.new_id, r.old_id, r.similarity))
        return pd.DataFrame(out, columns=["new_id", "old_id", "similarity"])

    unit_rows = lambda df, key: df.select(key, unit("vec").alias("vec"))
    s = vector_top(unit_rows(new, "new_id"), "new_id", "vec", unit_rows(old, "old_id"), "old_id", "vec", None)
    s = s.select("new_id", "old_id", F.col("score").alias("similarity")).where(F.col("similarity") >= least)
    return s.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(greedy, "new_id int, old_id int, similarity double")


def assigned(vectors: DataFrame, centroids: DataFrame, near: float = NOVEL) -> DataFrame:
    """(id, primary, secondary, confidence): the two nearest anchors; one under `near` to all learned ones goes to its nearest novelty anchor alone.

    centroids: anchor_id, centroid, is_novelty.
    """
    top = nearest(vectors, centroids.select("anchor_id", "centroid"), 3).join(small(centroids.select("anchor_id", "is_novelty")), "anchor_id")
    pick = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    learned = F.min(F.when(~F.col("is_novelty"), F.struct("rank", "similarity")))["similarity"]
    one = top.groupBy("id").agg(pick(1, "anchor_id").alias("primary"), pick(2, "anchor_id").alias("secondary"), pick(1, "similarity").alias("confidence"), learned.alias("learned"))
    novel = nearest(vectors, centroids.where("is_novelty").select("anchor_id", "centroid")).select("id", F.col("anchor_id").alias("n_id"), F.col("similarity").alias("n_sim"))
    far = (F.col("learned") < near) & F.col("n_id").isNotNull()
    j = one.join(novel, "id", "left")
    return j.select("id", F.when(far, F.col("n_id")).otherwise(F.col("primary")).alias("primary"), F.when(~F.coalesce(far, F.lit(False)), F.col("secondary")).alias("secondary"), F.when(far, F.col("n_sim")).otherwise(F.col("confidence")).alias("confidence"))


def skew(counts: Column) -> list[Column]:
    """n, mean, min, max and max over median of counts."""
    m = F.percentile(counts, 0.5)
    ratio = F.when(F.count("*") < 2, 1.0).when(m == 0, F.max(counts).cast("double")).otherwise(F.max(counts) / m)
    return [F.count("*").alias("n_anchors"), F.round(F.avg(counts), 6).alias("mean"), F.min(counts).alias("least"), F.max(counts).alias("most"), F.round(ratio, 6).alias("skew")]


def rebuild_reasons(novelty: Column, now: Column, built: Column) -> Column:
    """Why an atlas should be rebuilt: novelty over .08; skew over 3 and over 1.5 times the skew it was built with."""
    worse = F.when(built.isNull(), now > 3).otherwise((now > built * 1.5) & (now > 3))
    return F.array_compact(F.array(F.when(novelty > 0.08, "novelty"), F.when(worse, "skew")))


def days_since(then_s: Column, now_s: int) -> Column:
    return F.coalesce(F.greatest((F.lit(now_s) - then_s) / 86400.0, F.lit(0.0)), F.lit(0.0))


def ordered(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with `name`: their place from 1 within each group `by` in `order`, which leaves no ties; groups aren't null.

    A group of any size is put in order by many tasks: rows are dealt by range of group and order, and counted in each range;
    a row's place is that in its range and what the group has in the ranges before.
    """
    spark = rows.sparkSession
    group = [F.col(c) for c in by]
    dealt = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_at", F.monotonically_increasing_id())
    # written, so that ranges and places are the same ones in both uses
    dealt = stored(spark, dealt, "ordered").withColumn("_range", F.shiftright("_at", 33))
    ranges = dealt.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # as many rows as a group has ranges
    ranges = ranges.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    return dealt.join(ranges, [*by, "_range"]).withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_at", "_range", "_first", "_before")


def pressure(memories: DataFrame, *by: str) -> DataFrame:
    """memories with pressure: 1 for the least used of its peers down to 0; 0 for under five peers or none used. Ties spread by age, then seq."""
    groups = memories.groupBy(*by).agg(F.count("*").alias("n_peers"), F.max(F.col("pack_count") + F.col("select_count")).alias("_used"))
    order = [F.col(c) for c in ("pack_count", "select_count", "quality_score", "created_s", "seq")]
    placed = ordered(memories, list(by), order, "_k").join(groups, list(by))
    p = 1 - (F.col("_k") - 1) / F.greatest(F.col("n_peers") - 1, F.lit(1))
    return placed.withColumn("pressure", F.when((F.col("n_peers") < 5) | (F.col("_used") == 0), 0.0).otherwise(p)).drop("_used", "_k")


def forgetting_score(usage: Column, size: Column, budget: int, now_s: int) -> Column:
    """Higher is more disposable: pressure and crowding against usage and quality; under a day old: -10."""
    crowd = F.least(F.greatest(size - budget, F.lit(0)) / float(max(budget, 1)), F.lit(1.0))
    score = usage + crowd - F.least(F.ln(1 + F.col("pack_count")) / 3.0, F.lit(1.0)) - F.col("quality_score")
    return F.round(F.when(days_since(F.col("created_s"), now_s) < 1, -10.0).otherwise(score), 6)


def pruned(memories: DataFrame, now_s: int, budget: int = ANCHOR_BUDGET) -> DataFrame:
    """(anchor, seq, score) of what to archive: of every anchor over its budget the most disposable, all anchors at once."""
    p = pressure(memories.withColumn("anchor", F.col("primary_anchor_id")), "anchor").withColumn("score", forgetting_score(F.col("pressure"), F.col("n_peers"), budget, now_s))
    full = p.where(F.col("n_peers") > budget).select("anchor", "seq", "score", "n_peers")
    return ordered(full, ["anchor"], [F.desc("score"), F.col("seq")], "k").where(F.col("k") <= F.col("n_peers") - budget).select("anchor", "seq", "score")


def over_cap(memories: DataFrame, now_s: int, most: int) -> DataFrame:
    """(tenant_id, seq, score) of what each tenant over `most` active memories should archive, by .7 of its anchor's and .3 of the tenant's pressure."""
    a = pressure(memories, "tenant_id", "primary_anchor_id").select("tenant_id", "seq", "pack_count", "select_count", "quality_score", "created_s", F.col("pressure").alias("pa"))
    t = pressure(a, "tenant_id").withColumn("score", forgetting_score(0.7 * F.col("pa") + 0.3 * F.col("pressure"), F.col("n_peers"), ANCHOR_BUDGET, now_s))
    full = t.where(F.col("n_peers") > most).select("tenant_id", "seq", "score", "n_peers")
    return ordered(full, ["tenant_id"], [F.desc("score"), F.col("seq")], "k").where(F.col("k") <= F.col("n_peers") - most).select("tenant_id", "seq", "score")
