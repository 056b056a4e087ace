"""The trace of queries as a stream: windows, an exactly-once ledger, keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestore.sources.files import whole_tables


def read(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files: int | None = None) -> DataFrame:
    """A file source; new files under path are new records. files: that many of them make a batch."""
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


def windowed_activation(traces: DataFrame, every: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by tumbling or sliding windows of ts; records later than `late` are left out."""
    w = traces.withWatermark("ts", late).groupBy(F.window("ts", every, slide or every).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(traces: DataFrame, key: str, gap: str, late: str = "2 hours") -> DataFrame:
    """(key, start, end, n): runs of a key's records less than `gap` apart; the end is the last record and the gap."""
    w = traces.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def unique(traces: DataFrame, key: str = "run_id", late: str = "1 day") -> DataFrame:
    """Each record once, as long as its repeats come within the watermark."""
    return traces.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


LEDGER = "pid string, ledger double, streak long, n long"


def running_ledger(deltas: DataFrame) -> DataFrame:
    """(pid, ledger, streak, n) after each batch of deltas (pid, ts, event_id, delta): sums and runs under zero are kept as state by key."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, streak, n = state.get if state.exists else (0.0, 0, 0)
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for d in pdf["delta"]:
            total, n = total + float(d), n + 1
            streak = streak + 1 if round(total, 6) < 0 else 0
        state.update((total, streak, n))
        yield pd.DataFrame({"pid": [key[0]], "ledger": [round(total, 6)], "streak": [streak], "n": [n]})

    return deltas.groupBy("pid").applyInPandasWithState(update, LEDGER, "ledger double, streak long, n long", "update", GroupStateTimeout.NoTimeout)


class TraceThenLedger:
    """Two sinks of one stream: the trace first, then the ledger of what the trace has, then a line in the batch log.

    Use it as a foreachBatch function. Every write is a table of its own under the batch's number, so a batch that died half way and comes again takes the place of
    its own leavings and of nothing else. The ledger after a batch is that of the last batch in the log before it, plus the batch; a batch in the log is
    done and isn't looked at again. Readers go by the log: trace() and ledger() show batches that are whole. tracking False: the trace alone.
    """

    def __init__(self, path: str, deltas: Callable[[DataFrame], DataFrame], tracking: bool = True, between: Callable[[int], None] | None = None):
        """deltas: a batch of the trace to (pid, delta). between: called after the trace and before the ledger (tests)."""
        self.path, self.deltas, self.tracking, self.between = path, deltas, tracking, between

    def done(self, spark: SparkSession) -> list[int]:
        return sorted(int(p.rpartition("=")[2]) for p in whole_tables(spark, f"{self.path}/log", "batch="))

    def _at(self, sink: str, batch_id: int) -> str:
        return f"{self.path}/{sink}/batch={batch_id}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = self.done(spark)
        if batch_id in done:
            return
        batch.write.mode("overwrite").parquet(self._at("trace", batch_id))
        if self.between:
            self.between(batch_id)
        written = spark.read.schema(batch.schema).parquet(self._at("trace", batch_id))
        if self.tracking:
            before = [n for n in done if n < batch_id]
            known = self._ledger(spark, before[-1]) if before else spark.createDataFrame([], LEDGER_TABLE)
            new = self.deltas(written).groupBy("pid").agg(F.sum("delta").alias("ledger"), F.count("*").alias("n"))
            both = known.unionByName(new).groupBy("pid").agg(F.sum("ledger").alias("ledger"), F.sum("n").alias("n"))
            both.write.mode("overwrite").parquet(self._at("ledger", batch_id))
        log = written.agg(F.lit(batch_id).cast("long").alias("id"), F.count("*").alias("records"))
        log.coalesce(1).write.mode("overwrite").parquet(self._at("log", batch_id))

    def _ledger(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return spark.read.schema(LEDGER_TABLE).parquet(self._at("ledger", batch_id))

    def trace(self, spark: SparkSession, schema: str) -> DataFrame:
        paths = [self._at("trace", n) for n in self.done(spark)]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def ledger(self, spark: SparkSession) -> DataFrame:
        """(pid, ledger, n) after the last batch of the log."""
        done = self.done(spark)
        return self._ledger(spark, done[-1]) if done and self.tracking else spark.createDataFrame([], LEDGER_TABLE)


LEDGER_TABLE = "pid string, ledger double, n long"


def run_to_end(stream: DataFrame, handle: Callable[[DataFrame, int], None], state: str) -> None:
    """All data that is there now through handle, batch by batch; state: the stream's checkpoint folder. Raises what handle raises."""
    q = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(handle).start()
    q.awaitTermination()


def drained(stream: DataFrame, path: str, mode: str = "update") -> DataFrame:
    """What a stream has to say about all data that is there now: each batch is written under its number, a repeated batch in its own place."""
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data/batch=*")
