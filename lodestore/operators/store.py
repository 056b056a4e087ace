"""The memory store: scans, lookups, counts, upserts, top-k by vector, usage and pruning."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestore.functions import dot

ACTIVE = "not is_archived and not is_duplicate"
PREFETCH = 200
#: Names of sessions that tasks hold at a time.
MOST_NAMES = 4096


def insert_ignored(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table with the rows of new whose key it lacks; of several new rows with a key one stays."""
    return table.unionByName(new.dropDuplicates([key]).join(table.select(key), key, "left_anti").select(table.columns))


def replaced(table: DataFrame, new: DataFrame, key: str, order: Column) -> DataFrame:
    """table with new's rows put in by key; of several new rows with a key the last in order wins."""
    both = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("_new"), order.desc())
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def by_anchor(memories: DataFrame, query: Column, most: int = 50) -> DataFrame:
    """Of each anchor the PREFETCH best by quality, of these the `most` closest to the query; ranks by (quality, created_s), then similarity."""
    best = Window.partitionBy("anchor_id").orderBy(F.desc("quality_score"), F.desc("created_s"), "seq")
    near = Window.partitionBy("anchor_id").orderBy(F.desc("similarity"), "seq")
    pre = memories.where(ACTIVE).withColumn("_q", F.row_number().over(best)).where(F.col("_q") <= PREFETCH)
    return pre.withColumn("similarity", F.round(F.coalesce(dot("embedding", query), F.lit(0.0)), 6)).withColumn("rank", F.row_number().over(near).cast("long")).where(F.col("rank") <= most)


def top_by_vector(rows: DataFrame, query: Column, most: int, *ties: str) -> DataFrame:
    """The `most` rows closest to query by dot product, with column similarity: a top-k per task, then one merge."""
    return rows.where("embedding is not null").withColumn("similarity", F.round(dot("embedding", query), 6)).orderBy(F.desc("similarity"), *ties).limit(most)


def with_usage(memories: DataFrame, used: DataFrame) -> DataFrame:
    """memories after the usage events (memory_object_id, ts_s) have been counted in: pack_count, last_packed_s."""
    counts = used.groupBy("memory_object_id").agg(F.count("*").alias("n"), F.max("ts_s").alias("last_packed_s"))
    return memories.join(counts, "memory_object_id", "left").withColumn("pack_count", F.col("pack_count") + F.coalesce("n", F.lit(0))).drop("n")


def from_sessions(memories: DataFrame, sources: DataFrame, sessions: DataFrame, most: int = MOST_NAMES) -> DataFrame:
    """(session, memory_object_id): memories whose source's path holds the session's name; an empty name is in every path.

    Names go out in blocks of about `most`, and each path is looked through once for all names of a block by an automaton, so that
    neither their number nor their product with the paths counts. Nulls are in nothing.
    """
    names = sessions.select("session").where("session is not null").distinct()
    blocks = max(1, -(-names.count() // most))
    schema = StructType([StructField("session", StringType()), sources.schema["source_id"]])
    found = sources.sparkSession.createDataFrame([], schema)
    for k in range(blocks):
        block = [r["session"] for r in names.where(F.pmod(F.xxhash64("session"), F.lit(blocks)) == k).collect()]  # about `most`

        def run(batches: Iterator[pd.DataFrame], block: list[str] = block) -> Iterator[pd.DataFrame]:
            automaton = ahocorasick.Automaton()
            for name in block:
                if name:
                    automaton.add_word(name, name)
            automaton.make_automaton()
            for b in batches:
                rows = []
                for source, path in zip(b["source_id"], b["source_path"]):
                    if path is not None:
                        own = {name for _, name in automaton.iter(path)} if len(automaton) else set()
                        rows += [(name, source) for name in own | ({""} & set(block))]
                yield pd.DataFrame(rows, columns=["session", "source_id"])

        found = found.unionByName(sources.select("source_id", "source_path").mapInPandas(run, schema))
    return memories.select("memory_object_id", F.explode("source_ids").alias("source_id")).join(found, "source_id").select("session", "memory_object_id").distinct()


def statistics(memories: DataFrame) -> DataFrame:
    return memories.agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("is_archived")).alias("active"),
        F.count_if("is_archived").alias("archived"),
        F.count_if(~F.col("is_archived") & (F.col("pack_count") == 0)).alias("never_packed"),
        F.count_if(~F.col("is_archived") & (F.col("select_count") == 0)).alias("never_selected"),
    )
