"""Connected components over DataFrames of edges."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.common import checkpointed


def connected_components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, root) for each node of edges (src, dst): root is the smallest node that can be reached.

    Alternates large-star and small-star rounds (Kiveris et al. 2014), each cut by a checkpoint; the number
    of edges never grows and a round count of the order of log(n) suffices. Goes on until a
    round changes nothing; raises if max_rounds is given and reached before. Loops, repeats and nulls in the
    edges do no harm. Nodes without an edge to another node are not returned.
    """
    e = (
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    e, before = checkpointed(e), None
    for done in count():
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now[0] == 0 or now == before:
            break
        if done == max_rounds:
            raise RuntimeError(f"components have not settled in {max_rounds} rounds")
        before = now
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        e = checkpointed(
            small.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
