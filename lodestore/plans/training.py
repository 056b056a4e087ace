"""Queries of labels and training data (LAB, TRN)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestore.functions import models, set_f1, words
from lodestore.operators import retrieval as r
from lodestore.operators import training as tr
from lodestore.operators import context as c
from lodestore.plans.base import ANCHORS, ASKED, CARDS, MEM, NOW, Tables, query
from lodestore.plans.context import _SCORED
from lodestore.plans.context import scored as fetched_memories
from lodestore.plans.retrieval import _BM25, _RANK, active_cards, queries
from lodestore.sources.files import shared_path

#: Candidates of every query: the dense ranking. Gold anchors: two by its number.
CAND = f"{_BM25}, ca as (select query_id, (rank - 1)::int as pos, doc as anchor_id from (select *, {_RANK} from de) where rank <= 12)"


def candidates(t: Tables) -> DataFrame:
    d = r.dense_scores(queries(t), active_cards(t), 12)
    return d.select("query_id", (F.col("rank") - 1).cast("int").alias("pos"), F.col("doc").alias("anchor_id"))


def gold(q: object = None) -> object:
    q = F.col("query_id")
    return F.array((q % ANCHORS).cast("int"), (q * 5 % ANCHORS).cast("int"))


_SETS = f"""{CAND}, s1 as (select query_id, 1 as size, row_number() over (partition by query_id order by pos) as rank, [anchor_id] as st from ca where pos < 8),
 s2 as (select a.query_id, 2 as size, row_number() over (partition by a.query_id order by a.pos, b.pos) as rank, [a.anchor_id, b.anchor_id] as st from ca a join ca b on a.query_id = b.query_id and a.pos < b.pos where b.pos < 8),
 s3 as (select a.query_id, 3 as size, row_number() over (partition by a.query_id order by a.pos, b.pos, c.pos) as rank, [a.anchor_id, b.anchor_id, c.anchor_id] as st from ca a join ca b on a.query_id = b.query_id and a.pos < b.pos join ca c on a.query_id = c.query_id and b.pos < c.pos where c.pos < 12),
 s4 as (select a.query_id, 4 as size, row_number() over (partition by a.query_id order by a.pos, b.pos, c.pos, d.pos) as rank, [a.anchor_id, b.anchor_id, c.anchor_id, d.anchor_id] as st
   from ca a join ca b on a.query_id = b.query_id and a.pos < b.pos join ca c on a.query_id = c.query_id and b.pos < c.pos join ca d on a.query_id = d.query_id and c.pos < d.pos
   where d.pos < 16 and a.query_id % 9 = 0),
 ss as (select * from s1 where rank <= 8 union all select * from s2 where rank <= 10 union all select * from s3 where rank <= 5 union all select * from s4 where rank <= 2)"""


def sets(t: Tables) -> DataFrame:
    """Sets of one to three candidates, and of four for complex queries; here those whose id 9 divides."""
    c = candidates(t)
    one, two, three = (tr.candidate_sets(c, k).withColumn("size", F.lit(k)) for k in (1, 2, 3))
    four = tr.candidate_sets(c.where("query_id % 9 = 0"), 4).withColumn("size", F.lit(4))
    return one.unionByName(two).unionByName(three).unionByName(four)


@query("lab_01", f"with {_SETS} select query_id, size, rank, array_to_string(st, ',') as set from ss")
def candidate_sets(t: Tables) -> DataFrame:
    return sets(t).select("query_id", "size", "rank", F.array_join(F.transform("set", lambda x: x.cast("string")), ",").alias("set"))


_PARTS = f"{_SETS}, gs as (select *, list_distinct([(query_id % {ANCHORS})::int, (query_id * 5 % {ANCHORS})::int]) as gold from ss), ps as (select *, len(list_intersect(st, gold)) / len(gold) as support, 0.5 as procedural, (len(st) - len(list_intersect(st, gold))) / len(st) as noise, least(size * 450 / 1200, 1.0) as cost from gs), os as (select *, 0.45 * support + 0.2 * procedural + 0.15 * (case when support > 0 then 1 else 0 end) - 0.1 * noise - 0.1 * cost as score from ps)"


def scored(t: Tables) -> DataFrame:
    g = F.array_distinct(gold())
    parts = tr.set_scores(F.col("set"), g, F.col("size") * 450, 1200, F.lit(0.5))
    s = sets(t).withColumns(parts)
    named = {k: F.col(k) for k in parts}
    return s.withColumn("score", F.round(tr.oracle_score(named, (F.col("support") > 0).cast("double")), 6))


@query("lab_02", f"with {_PARTS} select query_id, size, rank, round(support::double, 6) as support, round(noise::double, 6) as noise, round(cost::double, 6) as cost from ps")
def set_parts(t: Tables) -> DataFrame:
    return scored(t).select("query_id", "size", "rank", *[F.round(c, 6).alias(c) for c in ("support", "noise", "cost")])


@query("lab_03", f"with {_PARTS} select query_id, size, rank, round(score::double, 6) as score from os")
def oracle_scores(t: Tables) -> DataFrame:
    return scored(t).select("query_id", "size", "rank", "score")


_WIN = f"{_PARTS}, wi as (select query_id, st, score from (select *, row_number() over (partition by query_id order by round(score::double, 6) desc, size * 100 + rank) as k from os) where k = 1)"


def winning(t: Tables) -> DataFrame:
    return tr.winners(scored(t).withColumn("rank", F.col("size") * 100 + F.col("rank"))).select("query_id", "set", "score")


@query("lab_04", f"with {_WIN} select query_id, array_to_string(st, ',') as winning, round(score::double, 6) as score from wi")
def oracle_winner(t: Tables) -> DataFrame:
    return winning(t).select("query_id", F.array_join(F.transform("set", lambda x: x.cast("string")), ",").alias("winning"), "score")


JUDGED = ("support_coverage", "noise_penalty")


def stand_in_judge(prompts: list[str]) -> list[str]:
    """Support by the size of a set. Of a question that has more than ten sets it says nothing about the last of them; sets with anchor 7 it garbles."""
    out = []
    for p in prompts:
        sets = [line.partition(": ")[2].split(",") for line in p.split("\n")[1:]]
        scores = [{"support_coverage": "?" if "7" in s else str(len(s) / 4), "noise_penalty": 0.5} for s in sets]
        out.append(json.dumps({"sets": scores[:-1] if len(sets) > 10 else scores}))
    return out


@query("lab_05", f"""with {_SETS},
 nr as (select *, row_number() over (partition by query_id order by size, rank) - 1 as number, count(*) over (partition by query_id) as sets from ss)
 select query_id, number::int as number, array_to_string(st, ',') as payload, case when list_contains(st, 7) then 0 else size / 4 end::double as support_coverage,
   case when list_contains(st, 7) then 0 else 0.5 end::double as noise_penalty,
   case when list_contains(st, 7) then 0 when sets > 10 and number = sets - 1 then 2 else 1 end::int as attempt from nr""")
def judged(t: Tables) -> DataFrame:
    """All sets of a query by one question to a judge, a stand-in that leaves some out; these alone are asked again, and what stays open is zero."""
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("size", "rank")) - 1
    items = sets(t).select(F.col("query_id").alias("key"), number.cast("int").alias("number"), F.array_join(F.transform("set", lambda x: x.cast("string")), ",").alias("payload"))
    return models.judged(items, stand_in_judge, JUDGED, shared_path(t.spark, "judge")).withColumnRenamed("key", "query_id")


def stand_in_relevance(prompts: list[str]) -> list[str]:
    """A memory is relevant if its title has an even number of characters; every tenth it can't judge."""
    titles = [[line.partition(": ")[2] for line in p.split("\n")[1:]] for p in prompts]
    return [json.dumps({"sets": [{} if len(x) % 10 == 3 else {"relevant": 1 - len(x) % 2} for x in own]}) for own in titles]


@query("lab_08", f"""with {_SCORED},
 nr as (select query_id, seq, row_number() over (partition by query_id order by seq) - 1 as number, length(regexp_replace(title, '\\n', ' ', 'g')) as n from sc)
 select query_id, seq, (n % 2 = 0 and n % 10 <> 3)::int as relevant from nr""")
def relevance_labels(t: Tables) -> DataFrame:
    """Which of its fetched memories are relevant to a query, by one question for each query (a stand-in judge); failures are 0."""
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("seq")) - 1
    s = fetched_memories(t).select("query_id", "seq", F.regexp_replace("title", "\n", " ").alias("payload"), number.cast("int").alias("number"))
    items = s.select(F.col("query_id").alias("key"), "number", "payload")
    out = models.judged(items, stand_in_relevance, ("relevant",), shared_path(t.spark, "relevance"))
    return out.select(F.col("key").alias("query_id"), "number", F.col("relevant").cast("int").alias("relevant")).join(s.select("query_id", "number", "seq"), ["query_id", "number"]).select("query_id", "seq", "relevant")


@query("lab_06", f"with {MEM}, {ASKED} select query_id, array_to_string(list_sort(list(distinct primary_anchor_id)), ',') as gold from asked join mem on contains(source_path, 'session' || (query_id % 50) || '/') group by query_id")
def gold_anchors(t: Tables) -> DataFrame:
    """Sessions of a query to their memories' anchors. A path's session is taken out of it, so the join is an equi join."""
    m = t.memories().select(F.regexp_extract("source_path", r"/session(\d+)/", 1).cast("long").alias("s"), "primary_anchor_id").distinct()
    g = t.asked().select("query_id", (F.col("query_id") % 50).alias("s")).join(m, "s").groupBy("query_id").agg(F.array_sort(F.collect_set("primary_anchor_id")).alias("g"))
    return g.select("query_id", F.array_join(F.transform("g", lambda x: x.cast("string")), ",").alias("gold"))


@query("lab_07", f"with {_WIN}, q as (select query_id, round(score::double, 6) as score from wi), p as (select * from q where score < 0.6), g as (select * from q where score >= 0.6 order by md5(query_id::varchar), query_id limit greatest((select count(*) from p) // 2, 10)) select * from p union all select * from g")
def label_sample(t: Tables) -> DataFrame:
    return tr.sampled_for_labels(winning(t).select("query_id", "score"))


@query("lab_09", f"with {ASKED} select query_id from asked where query_id not in (select doc_id from labels where doc_id is not null)")
def unlabelled(t: Tables) -> DataFrame:
    return t.asked().select("query_id").join(t("labels").select(F.col("doc_id").alias("query_id")), "query_id", "left_anti")


_NEG = f"{_WIN}, {CARDS.replace('cards as', 'allc as')}, ng as (select query_id, 'easy' as kind, anchor_id from wi, allc where not list_contains(st, anchor_id) union all select ca.query_id, 'hard', anchor_id from ca join wi using (query_id) where not list_contains(st, anchor_id))"


def pools(t: Tables) -> DataFrame:
    c = candidates(t).groupBy("query_id").agg(F.array_sort(F.collect_list("anchor_id")).alias("candidates"))
    labels = winning(t).select("query_id", F.col("set").alias("winning")).join(c, "query_id")
    return tr.negatives(labels, t.cards())


@query("trn_02", f"with {_NEG} select * from ng")
def negatives(t: Tables) -> DataFrame:
    return pools(t)


_POOLS = f"{_NEG}, pl as (select kind, query_id || '-' || anchor_id as key from ng union all select 'positive', query_id || '-' || unnest(st) from wi)"


def with_positives(t: Tables) -> DataFrame:
    key = F.concat("query_id", F.lit("-"), "anchor_id").alias("key")
    pos = winning(t).select("query_id", F.explode("set").alias("anchor_id")).select(F.lit("positive").alias("kind"), key)
    return pools(t).select("kind", key).unionByName(pos)


#: Ten draws for each query; a draw's point is 60 bits of its MD5.
_HASH = "('0x' || substr(md5({}), 1, 15))::bigint"
_MIX = f"""{_POOLS},
 al as (select kind, key from pl union all select 'adversarial', key from pl where kind = 'positive'),
 pr as (select kind, key, row_number() over (partition by kind order by md5(key), key) - 1 as at, count(*) over (partition by kind) as n from al),
 tens as (select count(*) as q from wi),
 dr as (select kind, unnest(range(q * share)) as draw from tens, (values ('positive', 3), ('easy', 3), ('hard', 2), ('adversarial', 2)) k(kind, share)),
 mx as (
   select d.kind, d.draw, p.key, case when d.kind = 'adversarial' then {_HASH.format("'form-' || draw || '-42'")} % 7 end as form
   from dr d join pr p on p.kind = d.kind and p.at = {_HASH.format("d.kind || '-' || d.draw || '-42'")} % p.n
 )"""


@query("trn_01", f"with {_MIX} select * from mx")
def mix(t: Tables) -> DataFrame:
    """Ten examples a query, drawn with replacement."""
    return tr.mixed(with_positives(t).withColumn("weight", F.lit(1).cast("long")), winning(t).count())


@query("trn_03", f"with {_WIN} select query_id, case when query_id % 9 = 0 then 'multi_hop' when len(st) <= 1 then 'single' when len(st) = 2 then 'pair' else 'broad' end as family from wi")
def families(t: Tables) -> DataFrame:
    return winning(t).select("query_id", tr.family(F.size("set"), F.col("query_id") % 9 == 0).alias("family"))


@query("trn_04", f"with {ASKED}, b as (select *, regexp_replace(query, '[?.]+$', '') as bare from asked) select query_id, case query_id % 7 when 0 then 'What about ' || bare || '?' when 1 then bare || ' again' when 2 then regexp_replace(regexp_replace(query, '(?i)(^|[^\\p{{L}}\\p{{N}}_])the([^\\p{{L}}\\p{{N}}_]|$)', '\\1that\\2', 'g'), '(?i)(^|[^\\p{{L}}\\p{{N}}_])the([^\\p{{L}}\\p{{N}}_]|$)', '\\1that\\2', 'g') when 3 then 'Not ' || query when 4 then 'UPPER' when 5 then regexp_replace(query, '\\s+', ' ', 'g') else bare || ' please' end as rewritten from b")
def adversarial(t: Tables) -> DataFrame:
    x = t.asked().select("query_id", tr.adversarial(F.col("query"), F.col("query_id")).alias("x"))
    # upper case of some letters differs between engines, so that it is upper case is what is compared
    return x.select("query_id", F.when((F.col("query_id") % 7 == 4) & (F.upper("x") == F.col("x")), "UPPER").otherwise(F.col("x")).alias("rewritten"))


@query("trn_05", "with r as (select doc_id, toxic as label from labels), c as (select count(*) filter (label = 1) as p, count(*) as n from r), x as (select case when p = 0 or p / n >= 0.25 then 1 else ceil(floor(0.25 * (n - p) / 0.75) / p) end::bigint as times from c) select doc_id, label, i as copy from r, x, range(100) g(i) where i < case when label = 1 then times else 1 end")
def oversampled(t: Tables) -> DataFrame:
    return tr.oversampled(t("labels").select("doc_id", F.col("toxic").alias("label"))).withColumn("copy", F.col("copy").cast("long"))


@query("trn_06", 'with g as (select conv_id as "group", count(*) as n from conversations group by 1), b as (select *, count(*) over (order by md5("group"::varchar), "group" rows between unbounded preceding and 1 preceding) as bg, coalesce(sum(n) over (order by md5("group"::varchar), "group" rows between unbounded preceding and 1 preceding), 0) as br, count(*) over () as ag, sum(n) over () as ar from g) select c.conv_id as "group", turn, not (bg >= greatest(ceil(ag * 0.1), 1) and br >= greatest(ceil(ar * 0.1), 10)) as is_val from conversations c join b on b."group" = c.conv_id')
def split(t: Tables) -> DataFrame:
    return tr.split(t("conversations").select(F.col("conv_id").alias("group"), "turn"), 0.1)


@query("trn_07", f"with {_BM25}, g as (select query_id, doc, score, case when doc in (query_id % {ANCHORS}, query_id * 5 % {ANCHORS}) then 1 else 0 end as g from de) select query_id, array_to_string(list(g::varchar order by doc), '') as gold_mask, sum(g)::bigint as gold_k, round(list_sum(list(score order by doc)), 6) as ce_sum from g group by query_id")
def coactivation(t: Tables) -> DataFrame:
    s = r.dense_scores(queries(t), active_cards(t))
    g = t.asked().select("query_id", F.explode(gold()).alias("doc"))
    x = tr.in_card_order(s, g)
    return x.select("query_id", F.array_join(F.transform("gold_mask", lambda v: v.cast("int").cast("string")), "").alias("gold_mask"), "gold_k", F.round(F.aggregate("ce", F.lit(0.0), lambda a, b: a + b), 6).alias("ce_sum"))


_WORDS = "list_distinct(list_filter(string_split_regex(lower(regexp_replace({}, '[^a-zA-Z0-9\\s]', ' ', 'g')), '\\s+'), lambda w: w <> ''))"
_F1 = "case when len(list_intersect({a}, {b})) = 0 then 0 else 2 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) end"


@query("trn_08", f"""with {_SCORED},
 p as (select query_id, seq, {_WORDS.format('query')} as a, {_WORDS.format('title')} as b from sc join asked using (query_id))
 select query_id, seq, round({_F1.format(a='a', b='b')}::double, 6) as f1, ({_F1.format(a='a', b='b')} > 0.3)::int as label from p""")
def scorer_rows(t: Tables) -> DataFrame:
    """The memories that a query fetches, labelled by the words that their titles share with it."""
    return memory_examples(t).select("query_id", "seq", "f1", "label")


def memory_examples(t: Tables) -> DataFrame:
    s = fetched_memories(t).join(t.asked().select("query_id", "query"), "query_id")
    f1 = set_f1(words("query"), words("title"))
    x = c.features(F.col("cosine"), F.col("memory_type"), F.col("quality_score"), F.col("body"), F.col("created_s"), F.col("cosine"), NOW, 2000)
    return s.select("query_id", "seq", F.round(f1, 6).alias("f1"), (f1 > 0.3).cast("int").alias("label"), x.alias("x"))


@query("trn_09", "with s as (select (doc_id * 37 % 101) / 101.0 * 0.6 + toxic * 0.35 as score, toxic as label from labels), p as (select tau, count(*) filter (score >= tau and label = 1) as tp, count(*) filter (score >= tau and label = 0) as fp, count(*) filter (label = 1) as pos from s, (select i * 0.05::double as tau from range(1, 20) r(i)) group by tau), f as (select tau, round(case when tp = 0 then 0 else 5.0 * tp / (5.0 * tp + 4.0 * (pos - tp) + fp) end::double, 9) as f from p) select least(round(arg_max(tau, (f, -tau)), 2), 0.25)::double as tau, round(max(f), 6) as f, (select round(count(*) filter ((score >= 0.5) = (label = 1)) / count(*), 6) from s) as accuracy from f")
def threshold(t: Tables) -> DataFrame:
    s = (F.col("doc_id") * 37 % 101) / 101.0 * 0.6 + F.col("toxic") * 0.35
    return tr.threshold(t("labels").select(s.alias("score"), F.col("toxic").alias("label")))


@query("trn_11", "with c as (select l_returnflag || l_linestatus as candidate, avg(l_discount)::double as metric, sum(l_quantity)::double as seconds from lineitem group by 1), b as (select * from c order by metric desc, seconds, candidate limit 1) select c.candidate, round(c.metric, 6) as metric, c.seconds from c, b where c.candidate = b.candidate or c.metric >= b.metric - 0.005 and c.seconds <= b.seconds * 0.8 order by c.seconds, c.metric desc, c.candidate limit 1")
def sweep_winner(t: Tables) -> DataFrame:
    c = t("lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("candidate")).agg(F.avg("l_discount").cast("double").alias("metric"), F.sum("l_quantity").cast("double").alias("seconds"))
    return tr.sweep_winner(c).withColumn("metric", F.round("metric", 6))


@query("trn_13", f"with {_WIN}, {CARDS.replace('cards as', 'allc as')} select w.query_id, w.anchor_id, name from (select query_id, unnest(st) as anchor_id from wi) w join allc using (anchor_id)")
def positive_pairs(t: Tables) -> DataFrame:
    w = winning(t).select("query_id", F.explode("set").alias("anchor_id"))
    return w.join(t.cards().select("anchor_id", "name"), "anchor_id").select("query_id", "anchor_id", "name")
