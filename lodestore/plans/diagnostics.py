"""Queries of the trace rollups (DIA)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.operators import diagnostics as d
from lodestore.plans.base import ANCHORS, CARDS, MEM, TRACE, Tables, query
from lodestore.plans.ledger import _ACTIVATION, activation

ORIGINS = "coalesce(query_origin, 'interactive') in ('interactive', 'benchmark')"


def traces(t: Tables) -> DataFrame:
    tr = t.traces()
    top = F.array(*[F.struct(((F.col("anchor_a") + i) % ANCHORS).alias("anchor_id"), F.lit(i + 1).alias("rank"), (F.col("score") / (i + 1)).alias("score")) for i in range(5)])
    return tr.withColumns({"selected": F.array_distinct(F.array("anchor_a", "anchor_b")), "packed": F.when(F.col("carried"), F.array("anchor_a")).otherwise(F.array(F.lit(-1))), "top": top})


@query("dia_01", f"with {TRACE} select run_id, coalesce(query_origin, 'interactive') as query_origin, tokens_used from trace where {ORIGINS} and event_id % 11 <> 0")
def reader(t: Tables) -> DataFrame:
    """Records written as JSON lines, some of them broken, and read again."""
    line = F.when(F.col("event_id") % 11 == 0, "{broken").otherwise(F.to_json(F.struct("run_id", "query_origin", "tokens_used")))
    return d.of_origins(d.records(t.traces().select(line.alias("value"))), {"interactive", "benchmark"}).select("run_id", "query_origin", "tokens_used")


_ACT = f"{TRACE}, x as (select anchor_a as anchor_id, carried from trace union all select anchor_b, carried and anchor_a = anchor_b from trace where anchor_a <> anchor_b), ra as (select anchor_id, count(*) as n_selected, count(*) filter (carried) as n_carried, round(count(*) filter (carried) / count(*), 6) as carry_rate from x group by 1)"


@query("dia_02", f"with {_ACT} select * from ra")
def activation_report(t: Tables) -> DataFrame:
    return d.activation(traces(t))


@query("dia_03", f"with {_ACT} select *, (1 - carry_rate) * n_selected as waste from ra where n_selected >= 5 order by waste desc, anchor_id limit 10")
def activation_view(t: Tables) -> DataFrame:
    a = d.activation(traces(t)).where("n_selected >= 5").withColumn("waste", (1 - F.col("carry_rate")) * F.col("n_selected"))
    return a.orderBy(F.desc("waste"), "anchor_id").limit(10)


_GAP = f"{MEM}, {CARDS}, {_ACTIVATION}, mc as (select primary_anchor_id as anchor_id, count(*) as m from mem group by 1), j as (select c.anchor_id, coalesce(m, 0) as m, coalesce(n, 0) as a from cards c left join mc using (anchor_id) left join ac on ac.anchor_id = c.anchor_id), p as (select anchor_id, round(100 * cume_dist() over (order by m), 6) as memory_pct, round(100 * cume_dist() over (order by a), 6) as activation_pct from j), gp as (select *, round(memory_pct - activation_pct, 6) as gap from p)"


def gap(t: Tables) -> DataFrame:
    memories = t.memories().groupBy(F.col("primary_anchor_id").alias("anchor_id")).agg(F.count("*").alias("n"))
    return d.advertisement_gap(t.cards(), memories, activation(t))


@query("dia_04", f"with {_GAP} select * from gp")
def advertisement(t: Tables) -> DataFrame:
    return gap(t)


_MISS = f"{TRACE}, m as (select (anchor_a + i) % {ANCHORS} as anchor_id, i + 1 as rank, score / (i + 1) as score from trace, range(5) r(i) where result_kind = 'empty_selection'), mr as (select anchor_id, count(*) as n, round(avg(rank), 6) as mean_rank, round(avg(score), 4) as mean_score from m where rank <= 3 group by 1)"


@query("dia_05", f"with {_MISS} select * from mr")
def miss_report(t: Tables) -> DataFrame:
    return d.misses(traces(t))


@query("dia_06", f"with {TRACE} select run_id, (anchor_a + i) % {ANCHORS} as anchor_id, i + 1 as rank, (anchor_a + i) % {ANCHORS} in (anchor_a, anchor_b) as selected from trace, range(5) r(i)")
def inspected(t: Tables) -> DataFrame:
    x = traces(t).select("run_id", "selected", F.inline("top"))
    return x.select("run_id", "anchor_id", "rank", F.array_contains("selected", F.col("anchor_id").cast("int")).alias("selected"))


@query("dia_07", f"with {TRACE}, p as (select tenant_id, event_id, list_distinct([anchor_a, anchor_b]) as s, tokens_used, lag(list_distinct([anchor_a, anchor_b])) over (partition by tenant_id order by event_id) as o, lag(tokens_used) over (partition by tenant_id order by event_id) as ot from trace) select event_id, array_to_string(list_sort(list_filter(s, lambda x: not list_contains(o, x))), ',') as added, array_to_string(list_sort(list_filter(o, lambda x: not list_contains(s, x))), ',') as removed, tokens_used - ot as token_delta from p where o is not null")
def log_diffs(t: Tables) -> DataFrame:
    runs = traces(t).select(F.col("tenant_id").alias("key"), F.col("event_id").alias("run"), F.col("selected").alias("anchors"), F.col("tokens_used").alias("tokens"))
    x = d.diffs(runs)
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return x.select(F.col("run").alias("event_id"), text("added").alias("added"), text("removed").alias("removed"), "token_delta")


@query("dia_08", f"with {TRACE} select tenant_id, stage, round(sum(case stage when 'retrieve' then tokens_used * 0.5 else tokens_used % 7 end), 4)::double as ms from trace, (values ('retrieve'), ('pack')) s(stage) group by 1, 2")
def stage_timing(t: Tables) -> DataFrame:
    m = F.create_map(F.lit("retrieve"), F.col("tokens_used") * 0.5, F.lit("pack"), (F.col("tokens_used") % 7).cast("double"))
    return t.traces().select("tenant_id", F.explode(m).alias("stage", "v")).groupBy("tenant_id", "stage").agg(F.round(F.sum("v"), 4).alias("ms"))


@query("dia_09", f"with {_GAP} select anchor_id, gap from gp order by gap desc, anchor_id limit 10")
def gap_view(t: Tables) -> DataFrame:
    return gap(t).orderBy(F.desc("gap"), "anchor_id").limit(10).select("anchor_id", "gap")
