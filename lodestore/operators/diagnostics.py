"""Rollups over the trace of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Schema of trace records; readers tolerate missing fields and drop malformed lines.
RECORD = "run_id string, timestamp string, query string, query_origin string, result_kind string, selected_anchor_ids array<int>, packed_memories array<struct<memory_id:string,source_anchor_id:int>>, top_anchor_scores array<struct<anchor_id:int,score:double,rank:int>>, tokens_used int, token_budget int, timing_ms map<string,double>"


def records(lines: DataFrame) -> DataFrame:
    """Trace records of JSON lines (value); malformed lines are skipped, a missing origin is interactive."""
    j = lines.select(F.from_json("value", RECORD).alias("j")).where("j is not null and j.run_id is not null").select("j.*")
    return j.withColumn("query_origin", F.coalesce("query_origin", F.lit("interactive")))


def of_origins(traces: DataFrame, origins: set[str] | None) -> DataFrame:
    """None: all; a set: those; an empty set: nothing."""
    if origins is None:
        return traces
    return traces.where(F.coalesce("query_origin", F.lit("interactive")).isin(*origins)) if origins else traces.where("false")


def activation(traces: DataFrame) -> DataFrame:
    """(anchor_id, n_selected, n_carried, carry_rate) of traces (selected, packed: arrays of anchors)."""
    e = traces.select(F.explode("selected").alias("anchor_id"), "packed")
    g = e.groupBy("anchor_id").agg(F.count("*").alias("n_selected"), F.count_if(F.array_contains("packed", F.col("anchor_id"))).alias("n_carried"))
    return g.withColumn("carry_rate", F.round(F.col("n_carried") / F.col("n_selected"), 6))


def advertisement_gap(cards: DataFrame, memories: DataFrame, activations: DataFrame) -> DataFrame:
    """(anchor_id, memory_pct, activation_pct, gap) of every card; counts (anchor_id, n), missing ones 0. A row an anchor."""
    c = cards.select("anchor_id").join(memories.withColumnRenamed("n", "m"), "anchor_id", "left").join(activations.withColumnRenamed("n", "a"), "anchor_id", "left")
    c = c.select("anchor_id", F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("a", F.lit(0)).alias("a"))
    pct = lambda x: F.round(100 * F.cume_dist().over(Window.partitionBy(F.lit(0)).orderBy(x)), 6)
    c = c.select("anchor_id", pct("m").alias("memory_pct"), pct("a").alias("activation_pct"))
    return c.withColumn("gap", F.round(F.col("memory_pct") - F.col("activation_pct"), 6))


def misses(traces: DataFrame, near: int = 3) -> DataFrame:
    """(anchor_id, n, mean_rank, mean_score) of anchors ranked `near` or better in records without a selection. traces: result_kind, top (anchor_id, rank, score)."""
    e = traces.where("result_kind = 'empty_selection'").select(F.inline("top")).where(F.col("rank") <= near)
    return e.groupBy("anchor_id").agg(F.count("*").alias("n"), F.round(F.avg("rank"), 6).alias("mean_rank"), F.round(F.avg("score"), 4).alias("mean_score"))


def diffs(runs: DataFrame) -> DataFrame:
    """(key, run, added, removed, token_delta): each run (key, run, anchors, tokens) against the one before it with its key."""
    w = Window.partitionBy("key").orderBy("run")
    p = runs.withColumns({"old": F.lag("anchors").over(w), "old_tokens": F.lag("tokens").over(w)}).where("old is not null")
    return p.select("key", "run", F.array_sort(F.array_except("anchors", "old")).alias("added"), F.array_sort(F.array_except("old", "anchors")).alias("removed"), (F.col("tokens") - F.col("old_tokens")).alias("token_delta"))
