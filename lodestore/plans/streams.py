"""Queries of sinks, streams and plugged-in models (STO-22, LED-14, CON-05, DEC-06, STR)."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.functions import models
from lodestore.operators import atlas
from lodestore.operators import retrieval as r
from lodestore.plans.atlas import _ASSIGN, VEC, centroids
from lodestore.plans.base import MEM, Tables, query
from lodestore.plans.ledger import _RUN, PATTERNS, patterns
from lodestore.plans.retrieval import _BM25, _FRAME, active_cards, framed, queries
from lodestore.sources import files
from lodestore.streaming import trace


@query("sto_22", f"with {MEM} select memory_type, count(*) as n, sum(length(body))::bigint as chars from mem group by 1")
def sinks(t: Tables) -> DataFrame:
    """Memories to a versioned Parquet table, replaced, and to JSON lines; read back from there."""
    path = files.shared_path(t.spark, "sinks")
    m = t.memories().select("memory_object_id", "memory_type", "body")
    files.write_version(m.limit(1), f"{path}/table", 1)
    files.write_version(m, f"{path}/table", 2)
    files.append_json(files.latest_version(t.spark, f"{path}/table").drop("version"), f"{path}/log")
    back = files.json_lines(t.spark, f"{path}/log", "memory_object_id string, memory_type string, body string")
    files.replace(back, f"{path}/final")
    return files.current(t.spark, f"{path}/final").groupBy("memory_type").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("chars"))


def stream(t: Tables) -> DataFrame:
    # a pattern, since a table may be one file and a stream's path is a folder or a pattern
    return trace.read(t.spark, f"{t.sf_dir}/event[s].parquet", t("events").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))


@query("str_01", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def windowed_stream(t: Tables) -> DataFrame:
    """Hourly counts of the trace stream by event time."""
    s = trace.windowed_activation(stream(t).withColumn("ts", F.col("ts").cast("timestamp")))
    out = trace.drained(s, files.shared_path(t.spark, "windows"), "complete")
    last = out.agg(F.max("batch").alias("batch"))
    return out.join(F.broadcast(last), "batch").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("str_02", "select time_bucket(interval 1 hour, ts) - to_hours(i) as start, event_type, count(*) as n, round(sum(value), 2) as total from events, range(6) r(i) group by 1, 2")
def sliding_stream(t: Tables) -> DataFrame:
    """Six-hour counts, each hour anew."""
    s = trace.windowed_activation(stream(t).withColumn("ts", F.col("ts").cast("timestamp")), "6 hours", slide="1 hour")
    out = trace.drained(s, files.shared_path(t.spark, "sliding"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("str_03", "with g as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 2 hour then 0 else 1 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as start, max(ts) + interval 2 hour as end, count(*) as n from s group by user_id, k")
def session_stream(t: Tables) -> DataFrame:
    """Sessions of users: events less than two hours apart."""
    s = trace.sessions(stream(t).withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "2 hours")
    out = trace.drained(s, files.shared_path(t.spark, "sessions"), "complete")
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("user_id", ntz("start"), ntz("end"), "n")


_DELTA = "case event_id % 4 when 0 then 3.0 when 1 then 0.75 else -1.25 end"


def deltas(d: DataFrame) -> DataFrame:
    i = F.col("event_id") % 4
    return d.select(F.concat(F.lit("p"), "user_id").alias("pid"), "ts", "event_id", F.when(i == 0, 3.0).when(i == 1, 0.75).otherwise(-1.25).alias("delta"))


@query("led_14", f"""with e as (select concat('p', user_id) as pid, {_DELTA} as delta from events)
 select pid, round(sum(delta), 6)::double as ledger, count(*) as n, (select count(*) from events) as traced from e group by pid""")
def trace_then_ledger(t: Tables) -> DataFrame:
    """The trace in four batches with its ledger. The run dies in the second one, after the trace and before the ledger, and is started again: each batch counts once."""
    path = files.shared_path(t.spark, "trace-ledger")
    t("events").repartition(4, "event_id").write.parquet(f"{path}/in")
    schema = t("events").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")

    def dies(batch_id: int) -> None:
        if batch_id == 1:
            raise OSError("lost between the two sinks")

    first = trace.TraceThenLedger(f"{path}/out", deltas, between=dies)
    try:
        trace.run_to_end(trace.read(t.spark, f"{path}/in", schema, files=1), first, f"{path}/state")
    except StreamingQueryException:  # that of dies()
        pass
    again = trace.TraceThenLedger(f"{path}/out", deltas)
    trace.run_to_end(trace.read(t.spark, f"{path}/in", schema, files=1), again, f"{path}/state")
    traced = again.trace(t.spark, schema).agg(F.count("*").alias("traced"))
    return again.ledger(t.spark).select("pid", F.round("ledger", 6).alias("ledger"), "n").crossJoin(F.broadcast(traced))


@query("led_14_keyed", f"with {_RUN} select pid, arg_max(ledger, (ts, event_id)) as ledger, arg_max(streak, (ts, event_id)) as streak, count(*) as n from st group by pid")
def ledger_stream(t: Tables) -> DataFrame:
    """The ledger as keyed state of the stream; the last word on each pattern."""
    out = trace.drained(trace.running_ledger(deltas(stream(t))), files.shared_path(t.spark, "ledger"))
    last = F.max(F.struct("n", "ledger", "streak")).alias("x")
    return out.groupBy("pid").agg(last).select("pid", "x.ledger", "x.streak", "x.n")


@query("dec_06", f"with {PATTERNS} select anchor_id, sha256(string_agg(pattern, '|' order by pos)) as stamp, anchor_id % 5 <> 0 as may_promote from pt group by anchor_id")
def promotion_gate(t: Tables) -> DataFrame:
    """A candidate may be promoted if the cards are still those it was made from; here every fifth anchor's cards have changed."""
    p = patterns(t)
    stamp = lambda df: df.groupBy("anchor_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "pattern"))), lambda x: x["pattern"]), "|"), 256).alias("stamp"))
    now = stamp(p.withColumn("pattern", F.when(F.col("anchor_id") % 5 == 0, F.upper(F.concat(F.lit("new "), "pattern"))).otherwise(F.col("pattern")))).withColumnRenamed("stamp", "now")
    return stamp(p).join(now, "anchor_id").select("anchor_id", "stamp", (F.col("stamp") == F.col("now")).alias("may_promote"))


@query("qf_05", f"""{_FRAME},
 m as (select query_id, least((case when person is not null or self then 2 when proc > 0 then least(proc, 2) when target <> 'fact' then 1 else 0 end
   + (time is not null)::int + changed::int + (len(ents) > 0)::int) / 4.0, 1.0)::double as confidence from e)
 select query_id, 'fact' as answer_target from m where confidence < 0.6""")
def frame_fallback(t: Tables) -> DataFrame:
    """Queries whose frame is unsure go to a model; here a stand-in answers `fact`."""
    unsure = framed(t).select("query_id", "q", "confidence").where("confidence < 0.6")

    def model(pdf):  # noqa: ANN001, ANN202
        return pdf[["query_id"]].assign(answer_target="fact")

    return models.with_model(unsure, model, "query_id long, answer_target string")


_INSERT = f"{MEM}, " + _ASSIGN.replace(VEC, "v as (select seq as id, embedding::double[] as vec from mem where embedding is not null)")


@query("con_11", f"with {_INSERT} select id, case when learned < 0.15 then n_id else p end as \"primary\", case when learned < 0.15 then n_sim else c end as confidence from o join n using (id)")
def assigned_on_insert(t: Tables) -> DataFrame:
    """New memories with vectors get their anchors at once; those without wait for the next build."""
    new = t.memories().where("embedding is not null").select(F.col("seq").alias("id"), F.col("embedding").alias("vec"))
    return atlas.assigned(new, centroids(t), 0.15).select("id", "primary", "confidence")


@query("sel_08", f"with {_BM25}, l as (select query_id, doc, score, 1 as level from de where score >= 0.25 union all select query_id, doc, score, 2 from de where score >= 0.1 union all select query_id, doc, score, 3 from de), b as (select *, min(level) over (partition by query_id) as best from l), s as (select query_id, doc, score, level, row_number() over (partition by query_id order by score desc, doc) as rank from b where level = best) select * from s where rank <= 6")
def degradation(t: Tables) -> DataFrame:
    """The first level that has anything for a query: refined selection, full atlas, plain embedding search."""
    from pyspark.sql import Window

    d = r.dense_scores(queries(t), active_cards(t))
    level = F.when(F.col("score") >= 0.25, 1).when(F.col("score") >= 0.1, 2).otherwise(3)
    best = F.min(level).over(Window.partitionBy("query_id"))
    kept = d.withColumn("level", best).where(F.col("score") >= F.when(F.col("level") == 1, 0.25).when(F.col("level") == 2, 0.1).otherwise(-2.0))
    return r.ranked(kept, 6)
