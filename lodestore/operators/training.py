"""Oracle labels, training pools, splits and thresholds."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestore.functions import first_of
from lodestore.operators.atlas import ordered
from lodestore.sources.files import whole_tables

#: Weights of the oracle score; candidate sets by size and their caps; mix of examples in tenths (60 % made of positives and easy negatives); adversarial rewrites.
ORACLE = {"support": 0.45, "procedural": 0.20, "success": 0.15, "noise": -0.10, "cost": -0.10}
SET_CAPS = {1: 8, 2: 10, 3: 5, 4: 2}
MIX = {"positive": 3, "easy": 3, "hard": 2, "adversarial": 2}
FORMS = 7
SUCCESS, LEAST_SAMPLE, POSITIVE_FLOOR = 0.6, 10, 0.25


def candidate_sets(candidates: DataFrame, size: int) -> DataFrame:
    """(query_id, set): combinations of the first max(8, 4 size) candidates (query_id, pos, anchor_id) in lexicographic order, up to the size's cap.

    Positions are few, so the self-joins stay within a query and its first candidates.
    """
    c = candidates.where(F.col("pos") < max(8, 4 * size))
    out = c.select("query_id", F.array("pos").alias("at"), F.array("anchor_id").alias("set"))
    for _ in range(size - 1):
        nxt = c.select("query_id", F.col("pos").alias("p"), F.col("anchor_id").alias("a"))
        out = out.join(nxt, "query_id").where(F.col("p") > F.element_at("at", -1)).select("query_id", F.array_append("at", F.col("p")).alias("at"), F.array_append("set", F.col("a")).alias("set"))
    w = Window.partitionBy("query_id").orderBy("at")
    return out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= SET_CAPS[size]).select("query_id", "rank", "set")


def set_scores(chosen: Column, gold: Column, tokens: Column, budget: int, procedural: Column) -> dict[str, Column]:
    """Support coverage, procedural utility, noise penalty and token cost of a chosen set of anchors."""
    return {
        "support": F.when(F.size(gold) == 0, 0.0).otherwise(F.size(F.array_intersect(chosen, gold)) / F.greatest(F.size(gold), F.lit(1))),
        "procedural": procedural,
        "noise": F.when(F.size(chosen) == 0, 0.0).otherwise(F.size(F.array_except(chosen, gold)) / F.greatest(F.size(chosen), F.lit(1))),
        "cost": F.least(tokens / float(budget), F.lit(1.0)),
    }


def oracle_score(parts: dict[str, Column], success: Column) -> Column:
    return parts["support"] * ORACLE["support"] + parts["procedural"] * ORACLE["procedural"] + success * ORACLE["success"] + parts["noise"] * ORACLE["noise"] + parts["cost"] * ORACLE["cost"]


def winners(scored: DataFrame) -> DataFrame:
    """The best set of each query; the first of equals."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return scored.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def sampled_for_labels(queries: DataFrame) -> DataFrame:
    """All poor queries (score under .6) and a hash sample of the others, half as many as poor ones, ten at least. One count goes to the driver."""
    poor = queries.where(F.col("score") < SUCCESS)
    n = max(poor.count() // 2, LEAST_SAMPLE)
    good = queries.where(F.col("score") >= SUCCESS).orderBy(F.md5(F.col("query_id").cast("string")), "query_id").limit(n)
    return poor.unionByName(good)


def negatives(labels: DataFrame, anchors: DataFrame) -> DataFrame:
    """(query_id, kind, anchor_id): easy negatives are all anchors but the winners, hard ones the candidates but the winners.

    labels: query_id, winning, candidates. Anchors are one row of a few hundred ids.
    """
    all_ = F.broadcast(anchors.agg(F.array_sort(F.collect_set("anchor_id")).alias("all")))
    x = labels.crossJoin(all_)
    easy = x.select("query_id", F.lit("easy").alias("kind"), F.explode(F.array_except("all", "winning")).alias("anchor_id"))
    hard = x.select("query_id", F.lit("hard").alias("kind"), F.explode(F.array_except("candidates", "winning")).alias("anchor_id"))
    return easy.unionByName(hard)


def hashed(*parts: Column) -> Column:
    """60 bits of the MD5 of parts joined by `-`, the same in any engine."""
    text = F.concat_ws("-", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def weighted_draws(rows: DataFrame, draws: DataFrame, seed: int = 42) -> DataFrame:
    """draws (kind, draw) with a row of rows (kind, key, weight) each: drawn with replacement, by weight, by hash of kind, draw and seed.

    Rows lie side by side in the order of their keys' MD5, each as long as its weight (a whole number, 0: never drawn); a draw is a point on
    this line. The line is cut into cells of a row's mean length. A row lies in the cells that it reaches into, at
    most two for each row on the average, and points meet rows in their cell: no kind is sorted or searched by one task.
    Draws of a kind without rows are left out. Equal (kind, key) rows are rows of their own.
    """
    r = rows.where(F.col("weight") > 0).select("kind", "key", "weight", F.md5("key").alias("_h"))
    placed = ordered(r.withColumn("_i", F.monotonically_increasing_id()), ["kind"], [F.col("_h"), F.col("key"), F.col("_i")], "_place")
    # running sums of weight: by thousands of places first
    placed = placed.withColumn("_lot", F.floor(F.col("_place") / 1000))
    lots = placed.groupBy("kind", "_lot").agg(F.sum("weight").alias("_w"))
    before = F.coalesce(F.sum("_w").over(Window.partitionBy("kind").orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.sum("weight").over(Window.partitionBy("kind", "_lot").orderBy("_place"))
    line = placed.join(lots.withColumn("_before", before), ["kind", "_lot"]).withColumn("_end", F.col("_before") + inner)
    total = r.groupBy("kind").agg(F.sum("weight").alias("_total"), F.ceil(F.sum("weight") / F.count("*")).alias("_cell"))  # a row for each kind
    line = line.join(F.broadcast(total), "kind").select("kind", "key", (F.col("_end") - F.col("weight")).alias("_begin"), "_end", "_cell")
    reach = F.sequence(F.floor(F.col("_begin") / F.col("_cell")), F.floor((F.col("_end") - 1) / F.col("_cell")))
    line = line.withColumn("_in", F.explode(reach)).drop("_cell")
    d = draws.join(F.broadcast(total), "kind").withColumn("_point", hashed(F.col("kind"), F.col("draw"), F.lit(seed)) % F.col("_total"))
    d = d.withColumn("_in", F.floor(F.col("_point") / F.col("_cell"))).drop("_total", "_cell")
    return d.join(line, ["kind", "_in"]).where("_point >= _begin and _point < _end").drop("_in", "_point", "_begin", "_end")


def mixed(pools: DataFrame, tens: int, seed: int = 42) -> DataFrame:
    """10 * tens examples by MIX from pools (kind, key, weight), with replacement: kind, draw, key, form.

    Adversarial ones are positives whose query is rewritten; form is the number of the rewrite, null for others.
    """
    all_ = pools.unionByName(pools.where("kind = 'positive'").withColumn("kind", F.lit("adversarial")))
    spark = pools.sparkSession
    draws = [spark.range(tens * share).select(F.lit(kind).alias("kind"), F.col("id").alias("draw")) for kind, share in MIX.items()]
    each = reduce(DataFrame.unionByName, draws)
    form = F.when(F.col("kind") == "adversarial", hashed(F.lit("form"), F.col("draw"), F.lit(seed)) % FORMS)
    return weighted_draws(all_, each, seed).select("kind", "draw", "key", form.alias("form"))


def family(size: Column, complex_: Column) -> Column:
    return first_of((complex_, "multi_hop"), (size <= 1, "single"), (size == 2, "pair"), default=F.lit("broad"))


def adversarial(query: Column, kind: Column) -> Column:
    """Seven rewrites of a query by kind % 7."""
    bare = F.regexp_replace(query, r"[?.]+$", "")
    forms = [F.concat(F.lit("What about "), bare, F.lit("?")), F.concat(bare, F.lit(" again")), F.regexp_replace(query, r"(?i)\bthe\b", "that"), F.concat(F.lit("Not "), query), F.upper(bare), F.regexp_replace(query, r"\s+", " "), F.concat(bare, F.lit(" please"))]
    return F.get(F.array(*forms), (kind % 7).cast("int"))


def oversampled(rows: DataFrame, least: float = POSITIVE_FLOOR) -> DataFrame:
    """rows (label) with positives repeated until they are `least` of all. The factor is one number on the driver."""
    c = rows.agg(F.count_if(F.col("label") == 1).alias("p"), F.count("*").alias("n")).first()
    if not c["p"] or c["p"] / c["n"] >= least:
        return rows.withColumn("copy", F.lit(0))
    times = -(-int(least * (c["n"] - c["p"]) / (1 - least)) // c["p"])
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("label") == 1, times - 1).otherwise(0))))


def before_in_hash_order(groups: DataFrame) -> DataFrame:
    """groups (group, n) with before_groups and before_rows: how many groups and rows come earlier in the order of the groups' MD5.

    Sums over the 4096 buckets of the hash's first digits are taken first, then those within a bucket, so that no task sees all groups.
    """
    g = groups.withColumn("_h", F.md5(F.col("group").cast("string"))).withColumn("_b", F.substring("_h", 1, 3))
    up = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    across, within = up(Window.partitionBy(F.lit(0)).orderBy("_b")), up(Window.partitionBy("_b").orderBy("_h", "group"))
    b = g.groupBy("_b").agg(F.count("*").alias("_g"), F.sum("n").alias("_n"))
    b = b.select("_b", F.coalesce(F.sum("_g").over(across), F.lit(0)).alias("_bg"), F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_bn"))
    j = g.join(F.broadcast(b), "_b")
    return j.select("group", "n", (F.col("_bg") + F.count("*").over(within)).alias("before_groups"), (F.col("_bn") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("before_rows"))


def split(rows: DataFrame, share: float, least: int = 10) -> DataFrame:
    """rows with is_val: whole groups, in hash order, go to validation until it has its share of groups and rows.

    Groups are counted first; the running sums go over groups, not rows.
    """
    g = rows.groupBy("group").agg(F.count("*").alias("n"))
    total = g.agg(F.count("*").alias("groups"), F.sum("n").alias("rows"))
    before = before_in_hash_order(g).crossJoin(F.broadcast(total))
    full = (F.col("before_groups") >= F.greatest(F.ceil(F.col("groups") * share), F.lit(1))) & (F.col("before_rows") >= F.greatest(F.ceil(F.col("rows") * share), F.lit(least)))
    return rows.join(before.select("group", (~full).alias("is_val")), "group")


def in_card_order(scores: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, ce, gold_mask, gold_k): a query's scores (query_id, doc, score) as an array in card order, with its gold anchors (query_id, doc)."""
    j = scores.join(gold.select("query_id", "doc", F.lit(1.0).alias("g")).distinct(), ["query_id", "doc"], "left")
    a = j.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("doc", "score", F.coalesce("g", F.lit(0.0)).alias("g")))).alias("a"))
    return a.select("query_id", F.transform("a", lambda x: x["score"]).alias("ce"), F.transform("a", lambda x: x["g"]).alias("gold_mask"), F.aggregate("a", F.lit(0.0), lambda s, x: s + x["g"]).cast("long").alias("gold_k"))


def threshold(scored: DataFrame, beta: float = 2.0, most: float = 0.25) -> DataFrame:
    """One row: tau with the best F-beta over .05 to .95 (the first of equals), capped, its F, and the accuracy at .5. scored: score, label.

    Scores are counted by twentieths first, so the sweep runs over a few rows.
    """
    taus = [round(0.05 * i, 2) for i in range(1, 20)]
    b2 = beta * beta
    tp = [F.count_if((F.col("score") >= t) & (F.col("label") == 1)) for t in taus]
    fp = [F.count_if((F.col("score") >= t) & (F.col("label") == 0)) for t in taus]
    pos = F.count_if(F.col("label") == 1)
    f = [F.when(x == 0, 0.0).otherwise((1 + b2) * x / ((1 + b2) * x + b2 * (pos - x) + y)) for x, y in zip(tp, fp)]
    best = F.array_max(F.array(*[F.struct(F.round(v, 9).alias("f"), F.lit(-t).alias("tau")) for v, t in zip(f, taus)]))
    accuracy = F.round(F.count_if((F.col("score") >= 0.5) == (F.col("label") == 1)) / F.count("*"), 6)
    return scored.agg(best.alias("b"), accuracy.alias("accuracy")).select(F.least(-F.col("b.tau"), F.lit(most)).alias("tau"), F.round("b.f", 6).alias("f"), "accuracy")


def sweep_winner(results: DataFrame, margin: float = 0.005, faster: float = 0.8) -> DataFrame:
    """The candidate (candidate, metric, seconds) with the best metric, unless one within the margin takes at most .8 of its time: then the fastest such."""
    best = results.orderBy(F.desc("metric"), "seconds", "candidate").limit(1).select(F.col("metric").alias("bm"), F.col("seconds").alias("bs"), F.col("candidate").alias("bc"))
    x = results.crossJoin(F.broadcast(best))
    ok = (F.col("candidate") == F.col("bc")) | ((F.col("metric") >= F.col("bm") - margin) & (F.col("seconds") <= F.col("bs") * faster))
    return x.where(ok).orderBy("seconds", F.desc("metric"), "candidate").limit(1).select("candidate", "metric", "seconds")


RESULTS = "candidate string, metric double, seconds double, round long"


def candidate_key(candidate: dict) -> str:
    return json.dumps(candidate, sort_keys=True)


def results_of(spark: SparkSession, path: str) -> DataFrame | None:
    tables = whole_tables(spark, path, "results-")
    return spark.read.schema(RESULTS).parquet(tables[-1]) if tables else None


def upserted(results: DataFrame | None, rows: DataFrame) -> DataFrame:
    """results with rows in the place of those of the same candidate; rows have each candidate once."""
    return rows if results is None else results.join(rows.select("candidate"), "candidate", "left_anti").unionByName(rows)


def swept(spark: SparkSession, candidates: list[dict], fit: Callable[[dict], tuple[float, float]], path: str) -> DataFrame:
    """(candidate, metric, seconds, round) of all candidates: those that path's table has are not fitted again.

    A finished candidate's row goes into a new version of the table, whole or not at all, so a sweep that dies loses only the fit it was
    at. round: which fit of this table it was, from 1. Two candidates with the same parameters are refused.
    """
    keys = [candidate_key(c) for c in candidates]
    if twice := sorted({k for k in keys if keys.count(k) > 1}):
        raise ValueError(f"candidates that are there twice: {twice}")
    for key, candidate in zip(keys, candidates):
        known = results_of(spark, path)
        number = 1 + (known.agg(F.max("round")).first()[0] or 0) if known is not None else 1
        if known is None or known.where(F.col("candidate") == key).isEmpty():
            metric, seconds = fit(candidate)
            row = spark.createDataFrame([(key, metric, seconds, number)], RESULTS)
            upserted(known, row).coalesce(1).write.mode("overwrite").parquet(f"{path}/results-{number:06d}")
    found = results_of(spark, path)
    return found.join(spark.createDataFrame([(k,) for k in keys], "candidate string"), "candidate", "left_semi")
