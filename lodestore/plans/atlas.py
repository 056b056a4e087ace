"""Queries of atlas building, health and forgetting (ATL, HLT, FGT)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestore.functions import normalized, unit
from lodestore.operators import atlas as a
from lodestore.plans.base import CARDS, MEM, NOW, Tables, query
from lodestore.sources.files import shared_path

ACTIVE = "not is_archived and not is_duplicate"
VEC = "v as (select vec_id as id, embedding::double[] as vec from embeddings)"
#: The given vectors are far apart, so near is .15 here.
_NEAR = "round(list_dot_product(vec, centroid::double[]), 6) as similarity"


def vectors(t: Tables) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def centroids(t: Tables) -> DataFrame:
    return t.cards().select("anchor_id", "centroid", "is_novelty")


@query("atl_01", "select vec_id, round(list_dot_product(u, u), 6) as n, round(u[5], 6) as x from (select vec_id, list_transform(list_transform(embedding::double[], lambda x: x * 3), lambda x: x / 3 / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as u from embeddings)")
def unit_rows(t: Tables) -> DataFrame:
    from lodestore.functions import dot

    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    u = t("embeddings").select("vec_id", unit(tripled).alias("u"))
    return u.select("vec_id", F.round(dot("u", "u"), 6).alias("n"), F.round(F.col("u")[4], 6).alias("x"))


_LLOYD = f"""with {VEC}, {CARDS}, n as (select id, anchor_id from (select id, anchor_id, row_number() over (partition by id order by round(list_dot_product(vec, centroid::double[]), 6) desc, anchor_id) as k from v cross join cards) where k = 1),
 m as (select anchor_id, i, avg(vec[i]) as x from n join v using (id), range(1, 65) r(i) group by 1, 2), s as (select anchor_id, i, x / sqrt(sum(x * x) over (partition by anchor_id)) as x from m)
 select anchor_id, round(sum(x * i), 5) as checksum, round(max(x), 5) as most from s group by anchor_id"""


@query("atl_02", _LLOYD)
def lloyd_step(t: Tables) -> DataFrame:
    c = a.lloyd_step(vectors(t), centroids(t).select("anchor_id", "centroid"))
    x = c.select("anchor_id", F.posexplode("centroid").alias("i", "x"))
    return x.groupBy("anchor_id").agg(F.round(F.sum(F.col("x") * (F.col("i") + 1)), 5).alias("checksum"), F.round(F.max("x"), 5).alias("most"))


def clustered(t: Tables) -> tuple[DataFrame, int]:
    """Unit vectors and how many clusters are due."""
    v = t("embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), unit("embedding").alias("vec"))
    return v, a.clusters(v.count())


@query("atl_02_converged")
def converged(t: Tables) -> DataFrame:
    """The cluster of every vector after Lloyd steps to the end; where they are is written to shared storage from time to time."""
    v, k = clustered(t)
    centroids = a.spherical_kmeans(v, k, 0, path=shared_path(t.spark, "kmeans"))
    return a.nearest(v, centroids).select("id", "anchor_id", F.round("similarity", 5).alias("similarity"))


@query("atl_04_seeds")
def stability_of_seeds(t: Tables) -> DataFrame:
    """How alike the clusterings of three seeds are, each over all vectors and to the end."""
    v, k = clustered(t)
    return a.stable_atlas(v, k, path=shared_path(t.spark, "atlas"))[1]


@query("atl_03", f"with {MEM} select tenant_id, count(*) as n, least(224, greatest(8, count(*) // 5)) as k, count(*) >= 200 as enough from mem where embedding is not null group by tenant_id")
def cluster_counts(t: Tables) -> DataFrame:
    g = t.memories().where("embedding is not null").groupBy("tenant_id").agg(F.count("*").alias("n"))
    return g.select("tenant_id", "n", F.least(F.lit(224), F.greatest(F.lit(8), F.floor(F.col("n") / 5))).alias("k"), (F.col("n") >= 200).alias("enough"))


def _ari(x: str, y: str) -> str:
    """The adjusted Rand index of two labellings in lb, brought to 0 to 1."""
    choose = "sum(n * (n - 1) / 2)"
    side = lambda c: f"(select {choose} from (select count(*)::double as n from lb group by {c}))"
    both = f"(select {choose} from (select count(*)::double as n from lb group by {x}, {y}))"
    due = f"({side(x)} * {side(y)} / (select count(*)::double * (count(*) - 1) / 2 from lb))"
    return f"round((({both} - {due}) / (({side(x)} + {side(y)}) / 2 - {due}) + 1) / 2, 6)"


@query("atl_04", f"""with lb as (select label as l0, vec_id * 7 // 100 as l1, label * 2 + (vec_id % 50 = 0)::int as l2 from embeddings),
 s as (select round(({_ari('l0', 'l1')} + {_ari('l0', 'l2')} + {_ari('l1', 'l2')}) / 3, 6) as stability) select stability, stability >= 0.6 as accepted from s""")
def stability(t: Tables) -> DataFrame:
    """Three labellings stand for those of three seeds."""
    v = F.col("vec_id")
    labels = t("embeddings").select(F.col("label").alias("l0"), F.floor(v * 7 / 100).alias("l1"), (F.col("label") * 2 + (v % 50 == 0).cast("int")).alias("l2"))
    return a.stability(labels, ["l0", "l1", "l2"])


@query("atl_05", f"with {CARDS} select anchor_id, case when is_novelty then 'novelty-' else 'cluster-' end || anchor_id as name from cards")
def stub_cards(t: Tables) -> DataFrame:
    return t.cards().select("anchor_id", F.concat(F.when(F.col("is_novelty"), "novelty-").otherwise("cluster-"), "anchor_id").alias("name"))


_MATCH = f"""{_LLOYD.split(" select anchor_id, round(sum")[0]},
 u as (select anchor_id as new_id, list(x order by i) as vec from s group by 1),
 o as (select new_id, old_id, similarity, row_number() over (order by similarity desc, new_id, old_id) as i from (
   select new_id, c.anchor_id as old_id, round(list_dot_product(u.vec::double[], c.centroid::double[]) / sqrt(list_dot_product(c.centroid::double[], c.centroid::double[])), 6) as similarity from u, cards c) where similarity >= 0.3),
 f as (select 0::bigint as i, []::int[] as used_new, []::int[] as used_old, false as kept union all
   select o.i, case when ok then list_append(used_new, new_id) else used_new end, case when ok then list_append(used_old, old_id) else used_old end, ok
   from (select o.i, new_id, old_id, used_new, used_old, not list_contains(used_new, new_id) and not list_contains(used_old, old_id) as ok from f join o on o.i = f.i + 1) o)
 select new_id, old_id, similarity from o join f using (i) where kept""".replace("with ", "with recursive ", 1)


@query("atl_06", _MATCH)
def anchor_matching(t: Tables) -> DataFrame:
    old = centroids(t).select(F.col("anchor_id").alias("old_id"), F.col("centroid").cast("array<double>").alias("vec"))
    new = a.lloyd_step(vectors(t), centroids(t).select("anchor_id", "centroid")).select(F.col("anchor_id").alias("new_id"), F.col("centroid").alias("vec"))
    return a.matched(new, old, 0.3)


@query("atl_07", f"with {CARDS} select anchor_id, cast(case when anchor_id % 3 = 0 then greatest(24, (select max(anchor_id) + 1 from cards)) + (select count(*) from cards c where c.anchor_id % 3 = 0 and c.anchor_id < cards.anchor_id) else anchor_id end as bigint) as new_id from cards")
def fresh_ids(t: Tables) -> DataFrame:
    """Every third anchor plays a cluster without a match."""
    c = t.cards().select("anchor_id")
    start = c.agg(F.greatest(F.lit(24), F.max("anchor_id") + 1).alias("s"))
    w = Window.partitionBy((F.col("anchor_id") % 3 == 0)).orderBy("anchor_id")
    return c.crossJoin(F.broadcast(start)).select("anchor_id", F.when(F.col("anchor_id") % 3 == 0, F.col("s") + F.row_number().over(w) - 1).otherwise(F.col("anchor_id")).cast("long").alias("new_id"))


@query("atl_08", f"with {VEC}, {CARDS}, s as (select id, max(round(list_dot_product(vec, centroid::double[]), 6)) as best from v cross join cards where not is_novelty group by id) select id, best from s order by best, id limit 32")
def novelty_anchors(t: Tables) -> DataFrame:
    learned = centroids(t).where("not is_novelty").select("anchor_id", "centroid")
    return a.nearest(vectors(t), learned).select("id", F.col("similarity").alias("best")).orderBy("best", "id").limit(a.NOVELTY_ANCHORS)


_ASSIGN = f"""{VEC}, {CARDS}, r as (select id, anchor_id, is_novelty, {_NEAR} from v cross join cards), k as (select *, row_number() over (partition by id order by similarity desc, anchor_id) as rank from r),
 o as (select id, max(anchor_id) filter (rank = 1) as p, max(anchor_id) filter (rank = 2) as s, max(similarity) filter (rank = 1) as c, arg_min(similarity, rank) filter (not is_novelty) as learned from k where rank <= 3 group by id),
 n as (select id, arg_max(anchor_id, (similarity, -anchor_id)) as n_id, max(similarity) as n_sim from r where is_novelty group by id)"""


@query("atl_09", f"with {_ASSIGN} select id, case when learned < 0.15 then n_id else p end as \"primary\", case when coalesce(learned < 0.15, false) then null else s end as secondary, case when learned < 0.15 then n_sim else c end as confidence from o join n using (id)")
def assignment(t: Tables) -> DataFrame:
    return a.assigned(vectors(t), centroids(t), 0.15)


@query("atl_10", f"with {_ASSIGN}, l as (select id, anchor_id, similarity, row_number() over (partition by id order by similarity desc, anchor_id) as rank from r where not is_novelty) select id, case when id % 40 = 7 then 7 else max(anchor_id) filter (rank = 1) end as \"primary\", max(anchor_id) filter (rank = 2) as secondary, max(similarity) filter (rank = 1) as confidence from l group by id")
def bulk_assignment(t: Tables) -> DataFrame:
    """The two nearest learned centroids; memories of a novelty anchor (here by number) keep it."""
    near = a.nearest(vectors(t), centroids(t).where("not is_novelty").select("anchor_id", "centroid"), 2)
    pick = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    g = near.groupBy("id").agg(pick(1, "anchor_id").alias("p"), pick(2, "anchor_id").alias("secondary"), pick(1, "similarity").alias("confidence"))
    novelty = t("embeddings").where("vec_id % 40 = 7").select(F.col("vec_id").alias("id"), F.lit(7).alias("novel"))
    return g.join(novelty, "id", "left").select("id", F.coalesce("novel", "p").alias("primary"), "secondary", "confidence")


_COUNTS = f"{MEM}, c as (select primary_anchor_id, count(*) as n from mem where {ACTIVE} group by 1)"


def counts(t: Tables) -> DataFrame:
    return t.memories().where(ACTIVE).groupBy("primary_anchor_id").agg(F.count("*").alias("n"))


@query("atl_11", f"with {_COUNTS} select count(*) as n_anchors, round(avg(n), 6) as mean, min(n) as least, max(n) as most, round(case when count(*) < 2 then 1 when median(n) = 0 then max(n) else max(n) / median(n) end, 6) as skew from c")
def cluster_statistics(t: Tables) -> DataFrame:
    return counts(t).agg(*a.skew(F.col("n")))


@query("atl_12", "with o as (select item_id as anchor_id, trim(regexp_replace(lower(split_part(text, '.', 1)), '\\s+', ' ', 'g')) as p, 'atlas_build' as source from benchmark where item_id % 2 = 0), n as (select item_id as anchor_id, concat('  ', split_part(text, '.', 1), ' ') as pattern from benchmark) select n.anchor_id, pattern, source from n join o on o.anchor_id = n.anchor_id and o.p = trim(regexp_replace(lower(pattern), '\\s+', ' ', 'g'))")
def inherited_metadata(t: Tables) -> DataFrame:
    b = t("benchmark").withColumn("first", F.split_part("text", F.lit("."), F.lit(1)))
    old = b.where("item_id % 2 = 0").select(F.col("item_id").alias("anchor_id"), normalized("first").alias("p"), F.lit("atlas_build").alias("source"))
    new = b.select(F.col("item_id").alias("anchor_id"), F.concat(F.lit("  "), "first", F.lit(" ")).alias("pattern")).withColumn("p", normalized("pattern"))
    return new.join(old, ["anchor_id", "p"]).select("anchor_id", "pattern", "source")


@query("atl_13", "select anchor_id, event_id from (select user_id % 24 as anchor_id, event_id, row_number() over (partition by user_id % 24 order by ts desc, event_id desc) as k from events) where k <= 50")
def fingerprints(t: Tables) -> DataFrame:
    w = Window.partitionBy("anchor_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = t("events").select((F.col("user_id") % 24).alias("anchor_id"), "event_id", "ts")
    return e.withColumn("k", F.row_number().over(w)).where("k <= 50").select("anchor_id", "event_id")


@query("atl_14", "with v as (select item_id % 10 as anchor_id, item_id // 10 as version, text from benchmark), l as (select * from v where version = (select max(version) from v)) select l.anchor_id, l.version, coalesce(r.text, l.text) as meaning from l left join (select anchor_id, concat('Refined: ', text) as text from l where anchor_id % 2 = 0) r using (anchor_id)")
def latest_version(t: Tables) -> DataFrame:
    v = t("benchmark").select((F.col("item_id") % 10).alias("anchor_id"), F.floor(F.col("item_id") / 10).alias("version"), "text")
    latest = v.join(F.broadcast(v.agg(F.max("version").alias("version"))), "version")
    refined = latest.where("anchor_id % 2 = 0").select("anchor_id", F.concat(F.lit("Refined: "), "text").alias("refined"))
    return latest.join(refined, "anchor_id", "left").select("anchor_id", "version", F.coalesce("refined", "text").alias("meaning"))


@query("atl_15", f"with {CARDS} select c.anchor_id, coalesce(p.name, c.name) as name from cards c left join cards p on p.anchor_id = c.anchor_id + 1 and p.anchor_id % 2 = 0 where c.status = 'active'")
def carried_cards(t: Tables) -> DataFrame:
    c = t.cards()
    p = c.where("anchor_id % 2 = 0").select((F.col("anchor_id") - 1).alias("anchor_id"), F.col("name").alias("old"))
    return c.where("status = 'active'").join(p, "anchor_id", "left").select("anchor_id", F.coalesce("old", "name").alias("name"))


_NOVELTY = f"{_COUNTS}, {CARDS}, nv as (select coalesce(sum(n) filter (is_novelty), 0) / greatest(sum(n), 1) as rate from cards left join c on primary_anchor_id = anchor_id)"


def novelty_rate(t: Tables) -> DataFrame:
    j = t.cards().select("anchor_id", "is_novelty").join(counts(t), F.col("anchor_id") == F.col("primary_anchor_id"), "left")
    return j.agg((F.coalesce(F.sum(F.when(F.col("is_novelty"), F.col("n"))), F.lit(0)) / F.greatest(F.sum("n"), F.lit(1))).alias("rate"))


@query("hlt_01", f"with {_NOVELTY} select round(rate::double, 6) as novelty_rate from nv")
def novelty(t: Tables) -> DataFrame:
    return novelty_rate(t).select(F.round("rate", 6).alias("novelty_rate"))


@query("hlt_02", f"with {MEM}, c as (select tenant_id, primary_anchor_id, count(*) as n from mem where {ACTIVE} group by 1, 2) select tenant_id, round(case when count(*) < 2 then 1 when median(n) = 0 then max(n) else max(n) / median(n) end, 6) as skew from c group by tenant_id")
def utilization_skew(t: Tables) -> DataFrame:
    c = t.memories().where(ACTIVE).groupBy("tenant_id", "primary_anchor_id").agg(F.count("*").alias("n"))
    return c.groupBy("tenant_id").agg(a.skew(F.col("n"))[-1])


_SKEWED = f"{MEM}, c as (select tenant_id, primary_anchor_id, count(*) as n from mem where {ACTIVE} group by 1, 2), s as (select tenant_id, case when count(*) < 2 then 1 else max(n) / median(n) end as skew, avg(primary_anchor_id % 8 = 7) as novelty from c group by 1)"


@query("hlt_03", f"with {_SKEWED} select tenant_id, array_to_string(list_filter([case when novelty > 0.08 then 'novelty' end, case when skew > 3 and skew > 1.5 * 1.2 then 'skew' end], lambda x: x is not null), ',') as reasons from (select tenant_id, skew, (select avg((c.primary_anchor_id % 8 = 7)::int) from c where c.tenant_id = s.tenant_id) as novelty from s)".replace(", avg(primary_anchor_id % 8 = 7) as novelty", ""))
def rebuild(t: Tables) -> DataFrame:
    c = t.memories().where(ACTIVE).groupBy("tenant_id", "primary_anchor_id").agg(F.count("*").alias("n"))
    s = c.groupBy("tenant_id").agg(a.skew(F.col("n"))[-1], F.avg((F.col("primary_anchor_id") % 8 == 7).cast("int")).alias("novelty"))
    return s.select("tenant_id", F.array_join(a.rebuild_reasons(F.col("novelty"), F.col("skew"), F.lit(1.2)), ",").alias("reasons"))


@query("hlt_04", f"with {MEM} select tenant_id, count(*) filter (not is_archived) as active, count(*) filter (is_archived) as archived, count(*) filter (not is_archived and pack_count = 0) as never_packed, round(100.0 * count(*) filter (not is_archived) / 1000, 4)::double as capacity from mem group by tenant_id")
def health_report(t: Tables) -> DataFrame:
    live = ~F.col("is_archived")
    return t.memories().groupBy("tenant_id").agg(F.count_if(live).alias("active"), F.count_if("is_archived").alias("archived"), F.count_if(live & (F.col("pack_count") == 0)).alias("never_packed"), F.round(100.0 * F.count_if(live) / 1000, 4).alias("capacity"))


@query("hlt_05", f"with {_COUNTS}, {CARDS} select anchor_id, name, n from cards join c on primary_anchor_id = anchor_id where status = 'active' order by n desc, anchor_id limit 5")
def wake_up(t: Tables) -> DataFrame:
    j = t.cards().where("status = 'active'").join(counts(t), F.col("anchor_id") == F.col("primary_anchor_id"))
    return j.orderBy(F.desc("n"), "anchor_id").limit(5).select("anchor_id", "name", "n")


def _pressure(by: str, source: str) -> str:
    return f"(select *, count(*) over (partition by {by}) as n_peers, case when count(*) over (partition by {by}) < 5 or max(pack_count + select_count) over (partition by {by}) = 0 then 0 else 1 - (row_number() over (partition by {by} order by pack_count, select_count, quality_score, created_s, seq) - 1) / (count(*) over (partition by {by}) - 1) end as pressure from {source})"


def _score(pressure: str, budget: int) -> str:
    return f"round(case when greatest(({NOW} - created_s) / 86400.0, 0) < 1 then -10 else {pressure} + least(greatest(n_peers - {budget}, 0) / {float(budget)}, 1) - least(ln(1 + pack_count) / 3, 1) - quality_score end::double, 6)"


LIVE = f"live as (select * from mem where {ACTIVE})"


@query("fgt_01", f"with {MEM}, {LIVE} select seq, round(pressure::double, 6) as pressure from {_pressure('primary_anchor_id', 'live')}")
def usage_pressure(t: Tables) -> DataFrame:
    return a.pressure(t.memories().where(ACTIVE), "primary_anchor_id").select("seq", F.round("pressure", 6).alias("pressure"))


@query("fgt_02", f"with {MEM}, {LIVE} select seq, {_score('pressure', 20)} as score from {_pressure('primary_anchor_id', 'live')}")
def scores(t: Tables) -> DataFrame:
    p = a.pressure(t.memories().where(ACTIVE), "primary_anchor_id")
    return p.select("seq", a.forgetting_score(F.col("pressure"), F.col("n_peers"), a.ANCHOR_BUDGET, NOW).alias("score"))


@query("fgt_03", f"with {MEM}, {LIVE}, p as (select *, {_score('pressure', 20)} as score from {_pressure('primary_anchor_id', 'live')}) select anchor, seq, score from (select primary_anchor_id as anchor, seq, score, n_peers, row_number() over (partition by primary_anchor_id order by score desc, seq) as k from p) where k <= n_peers - 20")
def prune(t: Tables) -> DataFrame:
    return a.pruned(t.memories().where(ACTIVE), NOW)


@query("fgt_04", f"with {MEM}, {LIVE}, pa as (select *exclude(n_peers, pressure), pressure as pa from {_pressure('tenant_id, primary_anchor_id', 'live')}), p as (select *, {_score('0.7 * pa + 0.3 * pressure', 20)} as score from {_pressure('tenant_id', 'pa')}) select tenant_id, seq, score from (select tenant_id, seq, score, n_peers, row_number() over (partition by tenant_id order by score desc, seq) as k from p) where k <= n_peers - 30")
def global_cap(t: Tables) -> DataFrame:
    return a.over_cap(t.memories().where(ACTIVE), NOW, 30)


@query("fgt_05", f"with {MEM} select seq, round(coalesce(greatest(({NOW} - archived_s) / 86400.0, 0), 0)::double, 6) as days from mem")
def days_since(t: Tables) -> DataFrame:
    return t.memories().select("seq", F.round(a.days_since(F.col("archived_s"), NOW), 6).alias("days"))
