"""The credit ledger of query patterns, its decay and removal, n-gram curation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestore.functions import normalized

#: Fixed values of the ledger.
RETRIEVED, PICKED, DECLINED, SHADOW_DECLINED = 1.0, 2.0, 0.25, 0.5
TAU_DAYS, GRACE_DAYS, SUSTAINED, SHADOW_SUSTAINED, FLOOR, EPSILON = 45, 30, 21, 7, 5, 0.05
K1, B = 1.5, 0.75
#: Stop words of n-grams.
GRAM_STOP = (
    "a an the is are was were be been being have has had do does did will would could should may might can i you he she it we they this that these those "
    "what who when where why which how about and or but in on at to for of with by from up into through during before after above below between"
).split()
MOST_PATTERNS = 20


def pattern_id(anchor: Column, pattern: Column) -> Column:
    """lp_ and 24 hex digits of the SHA-256 of anchor::normalized pattern."""
    return F.concat(F.lit("lp_"), F.substring(F.sha2(F.concat_ws("::", anchor.cast("string"), normalized(pattern)), 256), 1, 24))


def tokens(text: Column) -> Column:
    """Tokenizer B: runs of letters and digits in lower case; no stop words."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def attribution(queries: DataFrame, patterns: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """(query_id, anchor_id, pattern, score, argmax): patterns that a query's retrieved anchors credit.

    queries: (query_id, anchor_id, tokens); patterns: (anchor_id, pos, pattern). BM25 without idf inside an anchor's own
    patterns; the first best is the argmax, others within epsilon tie with it; nothing is credited at score 0.
    """
    p = patterns.withColumn("t", tokens(F.col("pattern"))).withColumn("avg", F.avg(F.size("t")).over(Window.partitionBy("anchor_id")))
    terms = p.select("anchor_id", "pos", F.size("t").alias("dl"), "avg", F.explode("t").alias("term")).groupBy("anchor_id", "pos", "dl", "avg", "term").agg(F.count("*").alias("tf"))
    asked = queries.select("query_id", "anchor_id", F.explode("tokens").alias("term")).groupBy("query_id", "anchor_id", "term").agg(F.count("*").alias("qn"))
    part = F.col("qn") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.greatest("avg", F.lit(1e-9))))
    s = asked.join(terms, ["anchor_id", "term"]).groupBy("query_id", "anchor_id", "pos").agg(F.round(F.sum(part), 9).alias("score"))
    w = Window.partitionBy("query_id", "anchor_id")
    s = s.withColumn("most", F.max("score").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("score"), "pos")))
    kept = s.where((F.col("most") - F.col("score") <= epsilon) & (F.col("score") > 0))
    return kept.join(patterns, ["anchor_id", "pos"]).select("query_id", "anchor_id", "pattern", "score", (F.col("k") == 1).alias("argmax"))


def signals(credited: DataFrame, selected: Column) -> DataFrame:
    """credited with delta and shadow: credit for retrieval, more if selected, a penalty if not; shared among a query's credited patterns."""
    n = F.count("*").over(Window.partitionBy("query_id", "anchor_id"))
    return credited.withColumns({"delta": (RETRIEVED + F.when(selected, PICKED).otherwise(-DECLINED)) / n, "shadow": (RETRIEVED + F.when(selected, PICKED).otherwise(-SHADOW_DECLINED)) / n})


def running(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """events (key, delta) with ledger (running sum) and streak: how many times in a row the ledger has been under 0."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    e = events.withColumns({"ledger": F.round(F.sum("delta").over(w), 6), "rn": F.row_number().over(Window.partitionBy(key).orderBy(*order))})
    return e.withColumn("streak", (F.col("rn") - F.coalesce(F.max(F.when(F.col("ledger") >= 0, F.col("rn"))).over(w), F.lit(0))).cast("long")).drop("rn")


def decayed(ledger: DataFrame, tau: int = TAU_DAYS) -> DataFrame:
    """ledger with active rows' ledger times exp(-1/tau); counters stay."""
    return ledger.withColumn("ledger", F.when(F.col("removed_s").isNull(), F.col("ledger") * math.exp(-1 / tau)).otherwise(F.col("ledger")))


def removable(ledger: DataFrame, now_s: int) -> DataFrame:
    """ledger rows with in_grace, at_risk, primary (to remove) and shadow_only decisions.

    ledger: pattern_id, anchor_id, streak, shadow_streak, grace_s, removed_s, shielded, pinned, n_patterns. Removals of an
    anchor go in order of pattern_id as long as the floor of patterns holds.
    """
    a = ledger.where("removed_s is null").withColumn("in_grace", F.col("grace_s") > now_s)
    open_ = ~F.col("in_grace") & ~F.col("shielded") & ~F.col("pinned")
    due = open_ & (F.col("streak") >= SUSTAINED)
    order = Window.partitionBy("anchor_id").orderBy("pattern_id").rowsBetween(Window.unboundedPreceding, 0)
    a = a.withColumn("before", F.sum(F.when(due, 1).otherwise(0)).over(order) - F.when(due, 1).otherwise(0))
    taken = F.least("before", F.greatest(F.col("n_patterns") - FLOOR, F.lit(0)))
    room = F.col("n_patterns") - taken - 1 >= FLOOR
    return a.withColumns({"at_risk": ~F.col("in_grace") & (F.col("streak") >= max(1, SUSTAINED // 2)), "primary": due & room, "shadow": open_ & room & (F.col("shadow_streak") >= SHADOW_SUSTAINED)})


def reset(ledger: DataFrame, patterns: DataFrame, now_s: int) -> DataFrame:
    """After a rebuild: archived history, and a fresh active row for every pattern (anchor_id, pattern) of the new atlas, also one that was there before."""
    old = ledger.withColumn("removed_s", F.coalesce("removed_s", F.lit(now_s).cast("long")))
    new = patterns.select(pattern_id(F.col("anchor_id"), F.col("pattern")).alias("pattern_id"), "anchor_id", F.lit(0.0).alias("ledger"), F.lit(None).cast("long").alias("removed_s"))
    return old.select("pattern_id", "anchor_id", "ledger", "removed_s").unionByName(new)


def status(ledger: DataFrame, now_s: int, bins: int = 20) -> DataFrame:
    """(bin, n): equal-width histogram of active rows' ledger; the last bin is closed."""
    a = ledger.where("removed_s is null")
    edge = F.broadcast(a.agg(F.min("ledger").alias("lo"), F.max("ledger").alias("hi")))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("ledger") - F.col("lo")) / F.when(width == 0, 1.0).otherwise(width)), F.lit(bins - 1)))
    return a.crossJoin(edge).groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def reinforced(traces: DataFrame, patterns: DataFrame) -> DataFrame:
    """(anchor_id, pattern, last): when a trace last selected the anchor and asked for the pattern's words. traces: (anchor_id, query, ts). The equi join on the anchor carries the theta test."""
    p = patterns.withColumn("p", normalized("pattern"))
    return traces.join(p, "anchor_id").where(F.contains(normalized("query"), F.col("p"))).groupBy("anchor_id", "pattern").agg(F.max("ts").alias("last"))


def shielded(counts: DataFrame, least: int = 10, percentile: float = 25.0) -> DataFrame:
    """counts (anchor_id, n) with shielded: under `least` activations, or a share of anchors with as many or fewer under the percentile. One row an anchor."""
    share = 100 * F.cume_dist().over(Window.partitionBy(F.lit(0)).orderBy("n"))
    return counts.withColumn("percentile", F.round(share, 6)).withColumn("shielded", (F.col("n") < least) | (F.col("percentile") < percentile))


def stale(patterns: DataFrame, now_s: int, grace: int = 30, window: int = 60) -> DataFrame:
    """Patterns to remove: not pinned, not of a shielded anchor, past grace, not reinforced within the window. Whole days, rounded down."""
    days = lambda s: F.floor((F.lit(now_s) - s) / 86400)
    return patterns.where(~F.col("pinned") & ~F.col("shielded") & (days(F.col("created_s")) >= grace) & (F.col("last_s").isNull() | (days(F.col("last_s")) > window)))


def ngrams(text: Column, least: int = 3, most: int = 6) -> Column:
    """n-grams of a text's words, longer first, that hold a word other than stop words."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    stop = F.array(*[F.lit(w) for w in GRAM_STOP])

    def of(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        grams = F.transform(starts, lambda i: F.slice(words, i, n))
        return F.transform(F.filter(grams, lambda g: F.exists(g, lambda w: ~F.array_contains(stop, w))), lambda g: F.array_join(g, " "))

    return F.concat(*[of(n) for n in range(most, least - 1, -1)])


def new_patterns(pool: DataFrame, existing: DataFrame, most: int = MOST_PATTERNS) -> DataFrame:
    """(anchor_id, pattern, rank): n-grams of each anchor's pool (anchor_id, n, query) in first-seen order, new ones up to `most` patterns in all.

    At most four grams for each free place are looked at, as the curator does.
    """
    held = existing.groupBy("anchor_id").agg(F.count("*").alias("held"))
    g = pool.join(held, "anchor_id", "left").withColumn("room", F.greatest(most - F.coalesce("held", F.lit(0)), F.lit(0))).where("room > 0")
    g = g.select("anchor_id", "room", "n", F.posexplode(ngrams(F.col("query"))).alias("i", "pattern"))
    first = g.groupBy("anchor_id", "room", "pattern").agg(F.min(F.struct("n", "i")).alias("at"))
    w = Window.partitionBy("anchor_id").orderBy("at", "pattern")
    first = first.withColumn("k", F.row_number().over(w)).where(F.col("k") <= 4 * F.col("room"))
    fresh = first.join(existing.select("anchor_id", "pattern"), ["anchor_id", "pattern"], "left_anti")
    return fresh.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= F.col("room")).select("anchor_id", "pattern", "rank")
