"""Queries of memory scoring and packing (MEM, PCK)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestore.functions import cosine, dot
from lodestore.operators import context as c
from lodestore.operators import retrieval as r
from lodestore.plans.base import ASKED, CARDS, MEM, NOW, QUERIES, Tables, query
from lodestore.plans.retrieval import _BM25, _FRAME, _RANK, active_cards, framed, queries

ACTIVE = "not is_archived and not is_duplicate"


def fetched(t: Tables) -> DataFrame:
    """Memories of the three closest anchors of each query."""
    top = r.dense_scores(queries(t), active_cards(t), 3)
    return c.fetched(top, t.memories().where(ACTIVE), 10, 5)


_FETCH = f"""{MEM}, {_BM25}, top as (select * from (select *, {_RANK} from de) where rank <= 3), live as (select * from mem where {ACTIVE}),
 one as (select primary_anchor_id as anchor_id, seq, 0 as phase from (select *, row_number() over (partition by primary_anchor_id order by quality_score desc, created_s desc, seq) as k from live) where k <= 10),
 two as (select anchor_id, seq, 1 as phase from (select *, row_number() over (partition by anchor_id order by quality_score desc, created_s desc, seq) as k from (select distinct seq, quality_score, created_s, unnest(secondary_anchor_ids) as anchor_id from live)) where k <= 5),
 fe as (select query_id, seq, anchor_id, phase from (select query_id, seq, anchor_id, phase, row_number() over (partition by query_id, seq order by phase, rank, anchor_id) as k from top join (select * from one union all select * from two) on doc = anchor_id) where k = 1)"""


@query("mem_01", f"with {_FETCH} select * from fe")
def fetch(t: Tables) -> DataFrame:
    return fetched(t)


#: Fetched memories with their cosine to the query; a missing vector has relevance 0.
_SCORED = f"{_FETCH}, sc as (select fe.query_id, fe.seq, m.*exclude(seq), coalesce(round(greatest(-1, least(1, list_dot_product(m.embedding::double[], a.qvec::double[]) / (sqrt(list_dot_product(m.embedding::double[], m.embedding::double[])) * sqrt(list_dot_product(a.qvec::double[], a.qvec::double[]))))), 6), 0)::double as cosine from fe join mem m using (seq) join asked a using (query_id))"


def scored(t: Tables) -> DataFrame:
    f = fetched(t).select("query_id", "seq").join(t.memories(), "seq").join(t.asked().select("query_id", "qvec"), "query_id")
    return f.withColumn("cosine", F.coalesce(F.round(cosine("embedding", "qvec"), 6), F.lit(0.0)))


@query("mem_02", f"with {_SCORED} select query_id, memory_object_id, row_number() over (partition by query_id order by cosine desc, quality_score desc, seq) as rank from sc")
def sorted_memories(t: Tables) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), F.desc("quality_score"), "seq")
    return scored(t).select("query_id", "memory_object_id", F.row_number().over(w).cast("long").alias("rank"))


@query("mem_03", f"with {_SCORED} select query_id, seq, round(0.5 + quality_score + least(1.0, length(body) / 4.0 / 2000) + 1 / (1 + ln(1 + greatest(({NOW} - created_s) / 86400.0, 0))) + cosine + case when memory_type = 'FAILURE' then 1 else 0 end, 5) as s from sc")
def memory_features(t: Tables) -> DataFrame:
    x = c.features(F.lit(0.5), F.col("memory_type"), F.col("quality_score"), F.col("body"), F.col("created_s"), F.col("cosine"), NOW, 2000)
    s = scored(t).select("query_id", "seq", x.alias("x"))
    return s.select("query_id", "seq", F.round(F.col("x")[0] + F.col("x")[4] + F.col("x")[7] + F.col("x")[8] + F.col("x")[9] + F.col("x")[10], 5).alias("s"))


@query("mem_04", f"with {_SCORED}, x as (select query_id, seq, quality_score as q, least(1.0, length(body) / 4.0 / 2000) as b, cosine as v from sc) select query_id, seq, round(1 / (1 + exp(-(0.1 + greatest(0, 0.2 + 0.5 * q - b) * 1.5 - greatest(0, v - 0.5 * q) * 0.7))), 6) as score from x")
def reranked(t: Tables) -> DataFrame:
    x = c.features(F.lit(0.5), F.col("memory_type"), F.col("quality_score"), F.col("body"), F.col("created_s"), F.col("cosine"), NOW, 2000)
    hidden = [[0.0] * 7 + [0.5, -1.0, 0.0, 0.0], [0.0] * 7 + [-0.5, 0.0, 0.0, 1.0]]
    return scored(t).select("query_id", "seq", F.round(c.mlp(x, hidden, [0.2, 0.0], [1.5, -0.7], 0.1), 6).alias("score"))


#: Facets of memories for the constraint queries, by their number.
_FACETS = "fm as (select query_id, seq, memory_type, body, quality_score, [split_part(title, ' ', 1), 'GraphQL'] as ents, case when seq % 2 = 0 then 'assistant' end as role, case when seq % 3 = 0 then ['bob', 'Ann'] else [] end as actors, case when seq % 4 = 0 then 'said Last Week' when seq % 4 = 1 then 'today' end as mentioned_at, case seq % 7 when 0 then 'switched' when 1 then 'deprecated' when 2 then 'failed' when 3 then 'fixed' when 4 then 'prefers' end as stance from sc)"
_CONSTRAINTS = """cf as (select f.query_id, f.seq, f.quality_score,
 case when len(e.ents) = 0 then 0.5 else len(list_intersect(list_distinct(list_transform(e.ents, lambda x: lower(x))), list_distinct(list_transform(f.ents, lambda x: lower(x))))) / len(list_distinct(list_concat(list_transform(e.ents, lambda x: lower(x)), list_transform(f.ents, lambda x: lower(x))))) end as entity,
 case when not (e.person is null and self) or f.role is null then 0.5 when f.role = 'assistant' then 1 else 0 end as role,
 case when e.person is null or len(f.actors) = 0 then 0.5 when list_contains(list_transform(f.actors, lambda x: lower(x)), lower(e.person)) then 1 else 0 end as actor,
 case when e.time is null or f.mentioned_at is null then 0.5 when contains(lower(f.mentioned_at), lower(e.time)) then 1 else 0.3 end as time,
 case when f.stance is null or final not in ('temporal_change', 'failure', 'procedure', 'preference') then 0.5 when final = 'temporal_change' and f.stance in ('switched', 'stopped') or final = 'failure' and f.stance = 'failed' or final = 'procedure' and f.stance in ('fixed', 'prefers') or final = 'preference' and f.stance = 'prefers' then 1 else 0 end as stance,
 case when final not in ('failure', 'procedure', 'fact', 'preference') then 0.5 when f.memory_type = case final when 'failure' then 'FAILURE' when 'procedure' then 'PROCEDURAL' else 'SEMANTIC' end then 1 else 0.3 end as type,
 case when len(regexp_extract_all(q, '"([^"]{2,60})"', 1)) = 0 then 0.5 when len(list_filter(regexp_extract_all(q, '"([^"]{2,60})"', 1), lambda x: contains(lower(f.body), lower(x)))) > 0 then 1 else 0 end as phrase,
 case when final in ('fact', 'preference') and f.stance in ('deprecated', 'stopped') then 0.2 when final = 'failure' and f.stance = 'fixed' then 0.3 else 0.5 end as contradiction
 from fm f join e using (query_id))"""
_ALL = _FRAME.replace("with ", "", 1) + ", " + _SCORED.replace(f"{ASKED}, ", "", 1) + f", {_FACETS}, {_CONSTRAINTS}"


def constrained(t: Tables) -> tuple[DataFrame, dict]:
    n = F.col("seq")
    facets = {
        "entities": F.array(F.split_part("title", F.lit(" "), F.lit(1)), F.lit("GraphQL")),
        "role": F.when(n % 2 == 0, "assistant"),
        "actors": F.when(n % 3 == 0, F.array(F.lit("bob"), F.lit("Ann"))).otherwise(F.array().cast("array<string>")),
        "mentioned_at": F.when(n % 4 == 0, "said Last Week").when(n % 4 == 1, "today"),
        "stance": F.get(F.array(*[F.lit(x) for x in ("switched", "deprecated", "failed", "fixed", "prefers", None, None)]), (n % 7).cast("int")),
        "type": F.col("memory_type"),
        "body": F.col("body"),
    }
    f = framed(t).withColumnRenamed("speaker_role", "frame_role").withColumnRenamed("entities", "frame_entities")
    frame = {"target": F.col("answer_target"), "entities": F.col("frame_entities"), "role": F.col("frame_role"), "person": F.col("person"), "time": F.col("time_constraint"), "quoted": F.col("quoted")}
    return scored(t).join(f, "query_id"), c.constraint_features(frame, facets)


@query("mem_05", f"with {_ALL} select query_id, seq, " + ", ".join(f"round({w}::double, 6) as {w}" for w in c.WEIGHTS) + " from cf")
def constraint_features(t: Tables) -> DataFrame:
    rows, f = constrained(t)
    return rows.select("query_id", "seq", *[F.round(v.cast("double"), 6).alias(k) for k, v in f.items()])


_BOOST = " + ".join(f"{w} * {v}" for w, v in c.WEIGHTS.items())


@query("mem_06", f"with {_ALL} select query_id, seq, round((0.7 * quality_score + 0.3 * ({_BOOST}))::double, 6) as score from cf")
def adjusted(t: Tables) -> DataFrame:
    rows, f = constrained(t)
    return rows.select("query_id", "seq", F.round(c.blended(F.col("quality_score"), f), 6).alias("score"))


@query("pck_01", f"with {_SCORED} select query_id, seq, row_number() over (partition by query_id order by round(cosine * 0.7 + quality_score * 0.3, 6) desc, seq) as rank from sc")
def relevance_rank(t: Tables) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round(F.col("cosine") * 0.7 + F.col("quality_score") * 0.3, 6).desc(), "seq")
    return scored(t).select("query_id", "seq", F.row_number().over(w).cast("long").alias("rank"))


_CUT = "case when length(body) > {n} then substr(body, 1, {n} - 3) || '...' else body end"
_ITEM = f"""it as (select query_id, seq, memory_type, rank, title || case when body <> '' and body <> title then ' — ' || case when rank <= 10 then {_CUT.format(n=800)} else {_CUT.format(n=300)} end else '' end
 || case when memory_type = 'EPISODIC' and success_label is not null then ' — outcome: ' || case when success_label then 'success' else 'failure' end else '' end
 || case when cosine > 0 then ' — (relevance: ' || printf('%.2f', cosine) || ')' else '' end || chr(10) || '  Source: ' || split_part(source_path, '/', 4) as item
 from (select *, row_number() over (partition by query_id order by round(cosine * 0.7 + quality_score * 0.3, 6) desc, seq) as rank from sc))"""


def items(t: Tables) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round(F.col("cosine") * 0.7 + F.col("quality_score") * 0.3, 6).desc(), "seq")
    s = scored(t).withColumn("rank", F.row_number().over(w).cast("long"))
    source = F.element_at(F.split("source_path", "/"), -1)
    text = c.item_text(F.col("title"), F.col("body"), F.col("memory_type"), F.col("success_label"), F.col("cosine"), F.col("rank") <= 10, source)
    return s.select("query_id", "seq", "memory_type", "rank", text.alias("item"))


@query("pck_02", f"with {_SCORED}, {_ITEM} select query_id, seq, length(item) as n, md5(item) as item from it")
def rendered(t: Tables) -> DataFrame:
    return items(t).select("query_id", "seq", F.length("item").cast("long").alias("n"), F.md5("item").alias("item"))


@query("pck_03", """with d as (select doc_id, text, list_filter(regexp_extract_all(lower(substr(text, 11, 60)), '[a-z0-9_]{4,}', 0), lambda w: contains(lower(text), w)) as words, case when doc_id % 2 = 0 then list_filter([trim(substr(text, 6, 100)), trim(substr(text, 201, 300))], lambda x: x <> '') else [] end as parts from documents),
 a as (select *, instr(lower(text), words[1]) - 1 as pp from d)
 select doc_id, case when len(parts) > 0 then substr(array_to_string(parts, ' ... '), 1, 500) when len(words) > 0 then trim(substr(text, (greatest(pp - 250, 0) + 1)::bigint, (pp + 250 - greatest(pp - 250, 0))::bigint)) end as evidence from a""")
def evidence(t: Tables) -> DataFrame:
    spans = F.when(F.col("doc_id") % 2 == 0, F.expr("array(named_struct('start', 5, 'end', 105), named_struct('start', 200, 'end', 500))")).otherwise(F.expr("cast(array() as array<struct<start:int,end:int>>)"))
    return t("documents").select("doc_id", c.evidence_text(F.col("text"), spans, F.substring("text", 11, 60)).alias("evidence"))


_ORDER = "case memory_type " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(c.SECTIONS)) + " end"


@query("pck_04", f"with {_SCORED} select query_id, seq, {_ORDER} as section, row_number() over (partition by query_id order by {_ORDER}, cosine desc, seq) as position from sc")
def sections(t: Tables) -> DataFrame:
    s = scored(t).withColumn("section", c.section_order(F.col("memory_type")).cast("long"))
    w = Window.partitionBy("query_id").orderBy("section", F.desc("cosine"), "seq")
    return s.select("query_id", "seq", "section", F.row_number().over(w).cast("long").alias("position"))


@query("pck_05", f"with recursive {_SCORED}, {_ITEM}, " + f"""
 b as (select query_id, {_ORDER} as section, list(length(item) order by rank) as chars from it group by 1, 2),
 h as (select *, [{", ".join(str(len(x)) for x in c.SECTIONS.values())}][section + 1] as head, row_number() over (partition by query_id order by section) as k from b),
 p as (select *, head + 1 + list_sum(chars) + 2 * len(chars) + len(chars) - 1 as whole from h),
 pk as (select distinct query_id, 0::bigint as k, (900 - (70 + length(query)) // 4)::bigint as lft, 0::bigint as section, 0::bigint as n_items, 0::bigint as tokens from p join asked using (query_id)
  union all
  select query_id, k, (lft - case when n > 0 then cost else 0 end)::bigint, section, n::bigint, case when n > 0 then cost else 0 end::bigint from (
   select *, (head + 1 + coalesce(list_sum(chars[1:n]), 0) + 2 * n + greatest(n - 1, 0)) // 4 + 2 as cost from (
    select p.query_id, p.k, p.section, lft, head, chars, case when whole // 4 + 2 <= lft then len(chars) when lft - head // 4 - 2 > 0 then
     coalesce(list_max(list_filter(range(1, len(chars) + 1), lambda j: list_sum(list_transform(chars[1:j], lambda x: (x + 3) // 4)) <= lft - head // 4 - 2)), 0) else 0 end as n
    from pk join p on p.query_id = pk.query_id and p.k = pk.k + 1)))
 select query_id, section, n_items, tokens from pk where n_items > 0""")
def budgeted(t: Tables) -> DataFrame:
    i = items(t).select("query_id", c.section_order(F.col("memory_type")).alias("section"), F.col("rank").alias("n"), F.length("item").alias("chars"))
    i = i.join(t.asked().select("query_id", F.length("query").alias("q")), "query_id")
    return c.packed(i.withColumn("header_chars", F.col("q") + 70), 900).select("query_id", F.col("section").cast("long").alias("section"), F.col("n_items").cast("long").alias("n_items"), "tokens")


_HEADS = "(values " + ", ".join(f"({i}, {len(h)}, '{k}')" for i, (k, h) in enumerate(c.SECTIONS.items())) + ") heads(section, head, kind)"


@query("pck_06", f"""with recursive {_SCORED}, {_ITEM},
 hi as (
   select i.query_id, i.rank as n, regexp_replace(body, '^\\s+|\\s+$', '', 'g') as text, case when i.seq % 3 > 0 then section end as section,
     case when i.seq % 3 > 0 then length(item) else length('[' || source || '/general] ' || case when length(body) > 400 then substr(body, 1, 397) || '...' else body end) end as chars
   from it i join sc using (query_id, seq) join (select seq, tenant_id as source from mem) using (seq) join {_HEADS} on kind = sc.memory_type
 ),
 hd as (select * from (select *, row_number() over (partition by query_id, md5(text) order by n) as k from hi where text <> '') where k = 1),
 co as (select query_id, section, (max(head) + 1 + sum(chars + 2) + count(*) - 1)::bigint // 4 + 2 as cost from hd join {_HEADS} using (section) group by query_id, section),
 fo as (
   select query_id, -1 as section, false as taken, 900 - (80 + length(query)) // 4 as lft from asked
   union all
   select f.query_id, f.section + 1, coalesce(cost <= lft, false), lft - case when cost <= lft then cost else 0 end
   from fo f left join co on co.query_id = f.query_id and co.section = f.section + 1
   where f.section < 5
 ),
 ra as (select query_id, n, sum((chars + 3) // 4) over (partition by query_id order by n) as used from hd where section is null)
 select h.query_id, h.n, h.section::int as section from hd h join fo on fo.query_id = h.query_id and fo.section = h.section where taken
 union all
 select r.query_id, r.n, -1 from ra r join fo on fo.query_id = r.query_id and fo.section = 5 where used <= lft - 20""")
def raw_hits(t: Tables) -> DataFrame:
    """What a query has found; a third of it plays hits that are no memories. Whole sections first, then raw hits with what is left."""
    i = items(t).join(t.memories().select("seq", "body", F.col("tenant_id").alias("source")), "seq").join(t.asked().select("query_id", F.length("query").alias("q")), "query_id")
    preview = F.when(F.length("body") > 400, F.concat(F.substring("body", 1, 397), F.lit("..."))).otherwise(F.col("body"))
    typed = F.col("seq") % 3 > 0
    chars = F.when(typed, F.length("item")).otherwise(F.length(F.concat(F.lit("["), "source", F.lit("/general] "), preview)))
    section = F.when(typed, c.section_order(F.col("memory_type")))
    hits = i.select("query_id", F.col("rank").alias("n"), F.col("body").alias("text"), section.alias("section"), chars.alias("chars"), (F.col("q") + 80).alias("header_chars"))
    return c.packed_hits(hits, 900)


@query("pck_07", f"with {_SCORED}, k as (select query_id, seq, cosine, body, row_number() over (partition by query_id order by cosine desc, seq) as k from sc), u as (select *, sum((length(body) + 3) // 4) over (partition by query_id order by k) as used from k where k <= 30) select query_id, seq from u where used <= 2000")
def synthesis_input(t: Tables) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "seq")
    k = scored(t).withColumn("n", F.row_number().over(w)).where("n <= 30").select("query_id", "seq", "n", F.col("body").alias("item"))
    return c.within_budget(k, "query_id", 2000).select("query_id", "seq")


@query("pck_08", f"with {_SCORED}, k as (select query_id, seq, title, memory_type, row_number() over (partition by query_id order by cosine desc, seq) as position from sc) select * from k where position <= 5")
def hit_list(t: Tables) -> DataFrame:
    ids = scored(t).groupBy("query_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "seq"))), lambda x: x["seq"]), 1, 5).alias("ids"))
    hits = ids.select("query_id", F.posexplode("ids").alias("p", "seq"))
    return hits.join(t.memories(), "seq").select("query_id", "seq", "title", "memory_type", (F.col("p") + 1).cast("long").alias("position"))


@query("pck_09", f"with {MEM}, {CARDS}, k as (select primary_anchor_id as anchor_id, seq, row_number() over (partition by primary_anchor_id order by quality_score desc, created_s desc, seq) as rank from mem where {ACTIVE} and primary_anchor_id in (2, 5, 11)) select * from k where rank <= 20")
def for_anchors(t: Tables) -> DataFrame:
    m = t.memories().where(ACTIVE).where(F.col("primary_anchor_id").isin(2, 5, 11))
    w = Window.partitionBy("primary_anchor_id").orderBy(F.desc("quality_score"), F.desc("created_s"), "seq")
    return m.select(F.col("primary_anchor_id").alias("anchor_id"), "seq", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 20")


@query("pck_10", f"with {MEM} select seq, case when embedding is null then 0 else round(greatest(-1, least(1, list_dot_product(embedding::double[], q::double[]))), 6) end::double as relevance from mem, (select embedding as q from embeddings where vec_id = 3)")
def relevance(t: Tables) -> DataFrame:
    q = t("embeddings").where("vec_id = 3").select(F.col("embedding").alias("q"))
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot("embedding", "q")))
    return t.memories().crossJoin(F.broadcast(q)).select("seq", F.when(F.col("embedding").isNull(), 0.0).otherwise(F.round(value, 6)).alias("relevance"))


@query("pck_11", f"with {MEM} select seq, split_part(source_path, '/', 4) as source, '[' || tenant_id || '/' || lower(memory_type) || '] ' || case when length(body) > 400 then substr(body, 1, 397) || '...' else body end as raw from mem")
def provenance(t: Tables) -> DataFrame:
    from lodestore.functions import cut

    raw = F.concat(F.lit("["), "tenant_id", F.lit("/"), F.lower("memory_type"), F.lit("] "), cut(F.col("body"), 400))
    return t.memories().select("seq", F.element_at(F.split("source_path", "/"), -1).alias("source"), raw.alias("raw"))


#: The search from query to packed text, with fused ranks in place of dense ones.
_SEARCH = (_SCORED + ", " + _ITEM).replace("top as (select * from (select *, row_number() over (partition by query_id order by score desc, doc) as rank from de) where rank <= 3)", "@@")
_FUSED_TOP = "x as (select * from (select *, {r} from bm) where rank <= 10), y as (select * from (select *, {r} from de) where rank <= 10), fu as (select query_id, doc, round(coalesce(1.0 / (60 + x.rank), 0) + coalesce(1.0 / (60 + y.rank), 0), 9)::double as score from x full join y using (query_id, doc)), top as (select * from (select *, {r} from fu) where rank <= 3)".format(r=_RANK)
_LINES = f"li as (select query_id, {_ORDER} as section, list('- ' || item order by rank) as lines from it group by 1, 2)"


def _search_sql() -> str:
    budget = QUERIES["pck_05"].sql
    head, tail = f"with recursive {_SCORED}, {_ITEM}, ", " select query_id, section, n_items, tokens from pk where n_items > 0"
    middle = budget[len(head) : -len(tail)]
    names = "[" + ", ".join(f"'{x}'" for x in c.SECTIONS.values()) + "]"
    return f"with recursive {_SEARCH.replace('@@', _FUSED_TOP)}, {middle}, {_LINES} select pk.query_id, pk.section, n_items, tokens, md5({names}[pk.section + 1] || chr(10) || array_to_string(lines[1:n_items], chr(10))) as text from pk join li on li.query_id = pk.query_id and li.section = pk.section where n_items > 0"


@query("search", _search_sql())
def search(t: Tables) -> DataFrame:
    """The whole way from a query to its packed context."""
    from lodestore import api

    cards = active_cards(t)
    return api.search(t.asked(), cards, t.memories().where(ACTIVE)).withColumn("text", F.md5("text"))
