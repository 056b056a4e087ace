"""Queries of the ledger, decay and curation operators (LED, DEC, CUR)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestore.functions import normalized
from lodestore.operators import ledger as l
from lodestore.plans.base import ANCHORS, ASKED, NOW, START, TRACE, Tables, query

NORM = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
#: Patterns of anchors: the sentences of benchmark items.
PATTERNS = f"pt as (select item_id % {ANCHORS} as anchor_id, item_id * 100 + i as pos, trim(s[i]) as pattern from (select item_id, string_split(text, '.') as s from benchmark), range(1, 20) r(i) where i <= len(s) and trim(s[i]) <> '')"


def patterns(t: Tables) -> DataFrame:
    s = t("benchmark").select("item_id", F.posexplode(F.split("text", r"\.")).alias("i", "s"))
    return s.select((F.col("item_id") % ANCHORS).alias("anchor_id"), (F.col("item_id") * 100 + F.col("i") + 1).alias("pos"), F.trim("s").alias("pattern")).where("pattern <> ''")


#: Each query's retrieved anchors: two by its number.
RETRIEVED = f"rt as (select query_id, query, unnest([query_id % {ANCHORS}, query_id * 5 % {ANCHORS}]) as anchor_id from asked)"


def retrieved(t: Tables) -> DataFrame:
    q = F.col("query_id")
    return t.asked().select("query_id", "query", F.explode(F.array(q % ANCHORS, q * 5 % ANCHORS)).alias("anchor_id"))


@query("led_01", f"with {PATTERNS} select pos, {NORM.format('pattern')} as norm, 'lp_' || substr(sha256(anchor_id || '::' || {NORM.format('pattern')}), 1, 24) as pattern_id from pt")
def pattern_ids(t: Tables) -> DataFrame:
    return patterns(t).select("pos", normalized("pattern").alias("norm"), l.pattern_id(F.col("anchor_id"), F.col("pattern")).alias("pattern_id"))


_TOK = "regexp_extract_all(lower({}), '([a-z0-9]+)', 1)"
_ATTR = f"""{ASKED}, {PATTERNS}, {RETRIEVED}, tk as (select *, {_TOK.format('pattern')} as t from pt), av as (select anchor_id, pos, t, avg(len(t)) over (partition by anchor_id) as a from tk),
 tf as (select anchor_id, pos, len(t) as dl, a, term, count(*) as tf from (select *, unnest(t) as term from av) group by all_cols),
 qn as (select query_id, anchor_id, term, count(*) as qn from (select query_id, anchor_id, unnest({_TOK.format('query')}) as term from rt) group by 1, 2, 3),
 sc as (select query_id, anchor_id, pos, round(sum(qn * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 9) as score from qn join tf using (anchor_id, term) group by 1, 2, 3),
 rk as (select *, max(score) over (partition by query_id, anchor_id) as most, row_number() over (partition by query_id, anchor_id order by score desc, pos) as k from sc),
 cr as (select query_id, anchor_id, pattern, score, k = 1 as argmax from rk join pt using (anchor_id, pos) where most - score <= 0.05 and score > 0)""".replace(
    "(select *, unnest(t) as term from av) group by all_cols", "(select anchor_id, pos, t, a, unnest(t) as term from av) group by anchor_id, pos, t, a, term"
)


def credited(t: Tables) -> DataFrame:
    return l.attribution(retrieved(t).withColumn("tokens", l.tokens(F.col("query"))), patterns(t))


@query("led_02", f"with {_ATTR} select * from cr")
def attribution(t: Tables) -> DataFrame:
    return credited(t)


@query("led_03", f"with {_ATTR} select * from cr where anchor_id % 3 <> 0")
def floor_gate(t: Tables) -> DataFrame:
    shortlist = patterns(t).select("anchor_id").distinct().where("anchor_id % 3 <> 0")
    return credited(t).join(shortlist, "anchor_id", "left_semi")


_SIGNALS = f"{_ATTR}, sg as (select *, (1 + case when anchor_id % 2 = 0 then 2 else -0.25 end) / count(*) over (partition by query_id, anchor_id) as delta, (1 + case when anchor_id % 2 = 0 then 2 else -0.5 end) / count(*) over (partition by query_id, anchor_id) as shadow from cr)"


@query("led_04", f"with {_SIGNALS} select query_id, anchor_id, pattern, round(delta::double, 6) as delta, round(shadow::double, 6) as shadow from sg")
def signal_deltas(t: Tables) -> DataFrame:
    s = l.signals(credited(t), F.col("anchor_id") % 2 == 0)
    return s.select("query_id", "anchor_id", "pattern", F.round("delta", 6).alias("delta"), F.round("shadow", 6).alias("shadow"))


_EVENTS = "ev as (select concat('p', user_id) as pid, ts, event_id, case when event_id % 4 = 0 then 3 when event_id % 4 = 1 then 0.75 else -1.25 end::double as delta from events)"
_RUN = f"{_EVENTS}, rn as (select *, round(sum(delta) over (partition by pid order by ts, event_id rows unbounded preceding), 6) as ledger, row_number() over (partition by pid order by ts, event_id) as rn from ev), st as (select *, rn - coalesce(max(case when ledger >= 0 then rn end) over (partition by pid order by ts, event_id rows unbounded preceding), 0) as streak from rn)"


def events(t: Tables) -> DataFrame:
    i = F.col("event_id") % 4
    return t("events").select(F.concat(F.lit("p"), "user_id").alias("pid"), "ts", "event_id", F.when(i == 0, 3.0).when(i == 1, 0.75).otherwise(-1.25).alias("delta"))


@query("led_05", f"with {_RUN} select pid, event_id, ledger, streak from st")
def upserts(t: Tables) -> DataFrame:
    return l.running(events(t), "pid", ["ts", "event_id"]).select("pid", "event_id", "ledger", "streak")


#: The state after all events: one row a pattern.
_STATE = f"{_RUN}, ls as (select pid as pattern_id, cast(substr(pid, 2) as bigint) % {ANCHORS} as anchor_id, arg_max(ledger, (ts, event_id)) as ledger, arg_max(streak, (ts, event_id)) + cast(substr(pid, 2) as bigint) % 30 as streak, cast(substr(pid, 2) as bigint) % 9 as shadow_streak, {START} + cast(substr(pid, 2) as bigint) * 86400 % 14000000 as grace_s, case when cast(substr(pid, 2) as bigint) % 10 = 0 then {START} + cast(substr(pid, 2) as bigint) * 1000 end as removed_s, cast(substr(pid, 2) as bigint) % {ANCHORS} = 3 as shielded, cast(substr(pid, 2) as bigint) % 13 = 1 as pinned from st group by pid)"


def state(t: Tables) -> DataFrame:
    r = l.running(events(t), "pid", ["ts", "event_id"])
    n = F.substring("pid", 2, 20).cast("long")
    last = r.groupBy("pid").agg(F.max(F.struct("ts", "event_id", "ledger", "streak")).alias("x"))
    return last.select(
        F.col("pid").alias("pattern_id"), (n % ANCHORS).alias("anchor_id"), F.col("x.ledger").alias("ledger"), (F.col("x.streak") + n % 30).alias("streak"), (n % 9).alias("shadow_streak"),
        (START + n * 86400 % 14_000_000).alias("grace_s"), F.when(n % 10 == 0, START + n * 1000).alias("removed_s"), (n % ANCHORS == 3).alias("shielded"), (n % 13 == 1).alias("pinned"),
    )


@query("led_06", f"with {_STATE} select pattern_id, round(case when removed_s is null then ledger * exp(-1 / 45.0) else ledger end, 6) as ledger, streak from ls")
def decay(t: Tables) -> DataFrame:
    return l.decayed(state(t)).select("pattern_id", F.round("ledger", 6).alias("ledger"), "streak")


_REMOVAL = f"""{_STATE}, np as (select *, count(*) over (partition by anchor_id) as n_patterns, grace_s > {NOW} as in_grace from ls where removed_s is null),
 du as (select *, not in_grace and not shielded and not pinned and streak >= 21 as due, not in_grace and not shielded and not pinned as op from np),
 bf as (select *, sum(due::int) over (partition by anchor_id order by pattern_id rows unbounded preceding) - due::int as bef from du),
 rm as (select pattern_id, in_grace, not in_grace and streak >= 10 as at_risk, due and n_patterns - least(bef, greatest(n_patterns - 5, 0)) - 1 >= 5 as "primary", op and n_patterns - least(bef, greatest(n_patterns - 5, 0)) - 1 >= 5 and shadow_streak >= 7 as shadow from bf)"""


def removal(t: Tables) -> DataFrame:
    s = state(t).withColumn("n_patterns", F.count(F.when(F.col("removed_s").isNull(), 1)).over(Window.partitionBy("anchor_id")))
    return l.removable(s, NOW)


@query("led_07", f"with {_REMOVAL} select * from rm")
def evaluate_removal(t: Tables) -> DataFrame:
    return removal(t).select("pattern_id", "in_grace", "at_risk", "primary", "shadow")


@query("led_08", f"with {PATTERNS} select anchor_id, string_agg(pattern, '|' order by pos) as patterns from pt where pos % 3 <> 0 group by anchor_id")
def apply_removals(t: Tables) -> DataFrame:
    p = patterns(t)
    cards = p.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "pattern"))), lambda x: x["pattern"]).alias("ps"))
    removed = p.where("pos % 3 = 0").groupBy("anchor_id").agg(F.collect_set(normalized("pattern")).alias("gone"))
    kept = F.filter("ps", lambda x: ~F.array_contains(F.coalesce("gone", F.array().cast("array<string>")), normalized(x)))
    return cards.join(removed, "anchor_id", "left").select("anchor_id", F.array_join(kept, "|").alias("patterns")).where("patterns <> ''")


@query("led_09", f"with {_STATE}, {PATTERNS} select pattern_id, anchor_id, round(ledger, 6) as ledger, coalesce(removed_s, {NOW}) as removed_s from ls union all select 'lp_' || substr(sha256(anchor_id || '::' || {NORM.format('pattern')}), 1, 24), anchor_id, 0, null from pt")
def rebuild_reset(t: Tables) -> DataFrame:
    return l.reset(state(t), patterns(t), NOW).withColumn("ledger", F.round("ledger", 6))


_LAST = "(select epoch(max(ts)) from events)"


@query("led_10", f"with {TRACE}, c as (select anchor_a as anchor_id, event_id % 5 as p, ts, carried, 1 + event_id % 3 as n from trace), s as (select anchor_id, p, (1 + case when carried then 2 else -0.25 end) / n * exp(-greatest(({_LAST} - epoch(ts)) / 86400.0, 0) / 45) as v from c) select anchor_id, p, round(sum(v)::double, 4) as ledger from s group by 1, 2")
def from_trace(t: Tables) -> DataFrame:
    tr = t.traces()
    last = tr.agg(F.max("ts").alias("last"))
    age = F.greatest((F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86400e6, F.lit(0.0))
    base = (l.RETRIEVED + F.when(F.col("carried"), l.PICKED).otherwise(-l.DECLINED)) / (1 + F.col("event_id") % 3)
    c = tr.crossJoin(F.broadcast(last)).select(F.col("anchor_a").alias("anchor_id"), (F.col("event_id") % 5).alias("p"), (base * F.exp(-age / l.TAU_DAYS)).alias("v"))
    return c.groupBy("anchor_id", "p").agg(F.round(F.sum("v"), 4).alias("ledger"))


@query("led_11", f"with {_STATE}, a as (select * from ls where removed_s is null), e as (select min(ledger) as lo, max(ledger) as hi from a) select least(floor((ledger - lo) / ((hi - lo) / 20)), 19)::bigint as bin, count(*) as n from a, e group by 1")
def ledger_histogram(t: Tables) -> DataFrame:
    return l.status(state(t), NOW)


@query("led_12", f"with {_REMOVAL} select pattern_id, case when \"primary\" and shadow then 'both' when \"primary\" then 'primary' else 'shadow' end as side from rm where \"primary\" or shadow")
def removal_diff(t: Tables) -> DataFrame:
    r = removal(t).select("pattern_id", "primary", "shadow")
    one, two = r.where("primary").select("pattern_id"), r.where("shadow").select("pattern_id")
    label = lambda df, side: df.withColumn("side", F.lit(side))
    return label(one.intersect(two), "both").union(label(one.subtract(two), "primary")).union(label(two.subtract(one), "shadow"))


@query("led_13", f"with {_STATE} select pattern_id from ls where not coalesce(removed_s < {NOW} - 30 * 86400, false)")
def purge(t: Tables) -> DataFrame:
    return state(t).where(~F.coalesce(F.col("removed_s") < NOW - 30 * 86400, F.lit(False))).select("pattern_id")


@query("led_16", f"with {PATTERNS}, m as (select anchor_id, {NORM.format('pattern')} as p, true as pinned from pt where pos % 4 = 0) select pt.pos, coalesce(bool_or(pinned), false) as pinned from pt left join m on m.anchor_id = pt.anchor_id and m.p = {NORM.format('pattern')} group by pt.pos")
def pin_check(t: Tables) -> DataFrame:
    p = patterns(t).withColumn("p", normalized("pattern"))
    meta = p.where("pos % 4 = 0").select("anchor_id", "p", F.lit(True).alias("pinned")).distinct()
    return p.join(meta, ["anchor_id", "p"], "left").select("pos", F.coalesce("pinned", F.lit(False)).alias("pinned"))


@query("dec_01", f"with {ASKED}, {PATTERNS}, {RETRIEVED}, q as (select query_id, anchor_id, query || ' ' || anchor_id || ' ' || coalesce((select pattern from pt where pos = 100 * (query_id % 40) + 1), '') as query from rt) select q.anchor_id, pattern, max(query_id) as last from q join pt on pt.anchor_id = q.anchor_id and contains({NORM.format('query')}, {NORM.format('pattern')}) group by 1, 2")
def reinforcement(t: Tables) -> DataFrame:
    first = patterns(t).where("pos % 100 = 1").select((F.col("pos") / 100).cast("long").alias("k"), F.col("pattern").alias("first"))
    q = retrieved(t).withColumn("k", F.col("query_id") % 40).join(first, "k", "left")
    tr = q.select("anchor_id", F.concat("query", F.lit(" "), "anchor_id", F.lit(" "), F.coalesce("first", F.lit(""))).alias("query"), F.col("query_id").alias("ts"))
    return l.reinforced(tr, patterns(t).select("anchor_id", "pattern"))


_ACTIVATION = f"{TRACE}, ac as (select r.i as anchor_id, count(run_id) as n from range({ANCHORS}) r(i) left join (select run_id, anchor_a as a from trace where coalesce(query_origin, 'interactive') in ('interactive', 'labeling') union all select run_id, anchor_b from trace where coalesce(query_origin, 'interactive') in ('interactive', 'labeling')) on a = i group by 1)"


def activation(t: Tables) -> DataFrame:
    tr = t.traces().where(F.coalesce("query_origin", F.lit("interactive")).isin("interactive", "labeling"))
    n = tr.select("run_id", F.explode(F.array("anchor_a", "anchor_b")).alias("anchor_id")).groupBy("anchor_id").agg(F.count("*").alias("n"))
    return t.spark.range(ANCHORS).withColumnRenamed("id", "anchor_id").join(n, "anchor_id", "left").select("anchor_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("dec_02", f"with {_ACTIVATION} select * from ac")
def activation_counts(t: Tables) -> DataFrame:
    return activation(t)


@query("dec_03", f"with {_ACTIVATION}, p as (select *, round(100 * cume_dist() over (order by n), 6) as percentile from ac) select *, n < 10 or percentile < 25 as shielded from p")
def shield(t: Tables) -> DataFrame:
    return l.shielded(activation(t))


@query("dec_04", f"with {PATTERNS}, m as (select *, pos % 7 = 0 as pinned, anchor_id % 5 = 1 as shielded, {START} + pos * 3001 % 13132800 as created_s, case when pos % 3 = 0 then {START} + pos * 7001 % 13132800 end as last_s from pt) select anchor_id, pattern from m where not pinned and not shielded and floor(({NOW} - created_s) / 86400) >= 30 and (last_s is null or floor(({NOW} - last_s) / 86400) > 60)")
def stale_patterns(t: Tables) -> DataFrame:
    pos = F.col("pos")
    m = patterns(t).withColumns({"pinned": pos % 7 == 0, "shielded": F.col("anchor_id") % 5 == 1, "created_s": START + pos * 3001 % 13132800, "last_s": F.when(pos % 3 == 0, START + pos * 7001 % 13132800)})
    return l.stale(m, NOW).select("anchor_id", "pattern")


@query("dec_05", f"with {PATTERNS} select anchor_id, pos, case when pos % 2 = 0 then 'manual' else 'unknown' end as source from pt")
def backfill(t: Tables) -> DataFrame:
    p = patterns(t).select("anchor_id", "pos")
    known = p.where("pos % 2 = 0").withColumn("source", F.lit("manual"))
    return known.unionByName(p.join(known, ["anchor_id", "pos"], "left_anti").withColumn("source", F.lit("unknown")))


_STOPS = "[" + ", ".join(f"'{w}'" for w in l.GRAM_STOP) + "]"


def _grams(source: str, key: str) -> str:
    """Rows (key, i, g): n-grams in order."""
    return f"""wd as (select {key}, query, list_filter(string_split_regex(lower(query), '\\s+'), lambda x: x <> '') as w from {source}),
 gr as (select {key}, query, 6 - k as len_, i, w[i : i + 6 - k - 1] as g from wd, range(4) a(k), range(1, 5000) b(i) where i <= len(w) - (6 - k) + 1),
 gm as (select {key}, query, row_number() over (partition by {key}, query order by len_ desc, i) - 1 as i, len_, array_to_string(g, ' ') as g from gr where len(list_filter(g, lambda x: not list_contains({_STOPS}, x))) > 0)"""


@query("cur_01", f"with {ASKED}, {_grams('asked', 'query_id')} select query_id, i, g as gram from gm")
def ngrams(t: Tables) -> DataFrame:
    return t.asked().select("query_id", F.posexplode(l.ngrams(F.col("query"))).alias("i", "gram")).withColumn("i", F.col("i").cast("long"))


_POOL = f"{ASKED}, po as (select query_id % {ANCHORS} as anchor_id, query_id as n, query from asked where query_id % 2 = 0 union all select query_id * 5 % {ANCHORS}, 100000 + query_id, query from asked where query_id * 5 % {ANCHORS} in (select query_id % {ANCHORS} from asked where query_id % 2 = 0))"


def pool(t: Tables) -> DataFrame:
    q = F.col("query_id")
    labels = t.asked().where("query_id % 2 = 0").select((q % ANCHORS).alias("anchor_id"), q.alias("n"), "query")
    prints = t.asked().select((q * 5 % ANCHORS).alias("anchor_id"), (q + 100000).alias("n"), "query")
    return labels.unionByName(prints.join(labels, "anchor_id", "left_semi"))


@query("cur_02", f"with {_POOL} select * from po")
def pools(t: Tables) -> DataFrame:
    return pool(t)


_CURATED = f"""with {_POOL}, {PATTERNS}, {_grams('po', 'anchor_id, n')}, ex as (select anchor_id, count(*) as held from pt group by 1),
 fs as (select anchor_id, greatest(20 - coalesce(held, 0), 0) as room, g, min((n, i)) as at_ from gm left join ex using (anchor_id) group by 1, 2, 3),
 k1 as (select *, row_number() over (partition by anchor_id order by at_, g) as k from fs where room > 0),
 fr as (select * from k1 where k <= 4 * room and (anchor_id, g) not in (select (anchor_id, pattern) from pt)),
 cu as (select anchor_id, g as pattern, row_number() over (partition by anchor_id order by at_, g) as rank, room from fr)""".replace("partition by anchor_id, n, query", "partition by anchor_id, n, query")


@query("cur_03", _CURATED + " select anchor_id, pattern, rank from cu where rank <= room")
def curated(t: Tables) -> DataFrame:
    return l.new_patterns(pool(t), patterns(t))


@query("cur_04", _CURATED + " select count(distinct anchor_id) as n_anchors, count(*) as n_patterns, count(*) > 0 as wrote from cu where rank <= room")
def curation_summary(t: Tables) -> DataFrame:
    n = l.new_patterns(pool(t), patterns(t))
    return n.agg(F.count_distinct("anchor_id").alias("n_anchors"), F.count("*").alias("n_patterns"), (F.count("*") > 0).alias("wrote"))


@query("cur_05", f"with {ASKED}, mi as (select query_id % {ANCHORS} as anchor_id, query_id, query from asked where query_id % 3 = 0), {_grams('mi', 'anchor_id, query_id')}, u as (select distinct anchor_id, len_, g from gm), k as (select anchor_id, g as pattern, row_number() over (partition by anchor_id order by len_ desc, g) as rank from u) select * from k where rank <= 12")
def miss_refinement(t: Tables) -> DataFrame:
    m = t.asked().where("query_id % 3 = 0").select((F.col("query_id") % ANCHORS).alias("anchor_id"), F.explode(l.ngrams(F.col("query"))).alias("pattern")).distinct()
    w = Window.partitionBy("anchor_id").orderBy(F.size(F.split("pattern", " ")).desc(), "pattern")
    return m.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 12")
