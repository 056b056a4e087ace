"""Queries of query frames, retrieval and selection (QF, RET, SEL)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.operators import retrieval as r
from lodestore.plans.base import ASKED, CARDS, MEM, Tables, query
from lodestore.plans.text import OUT, bounded, spread

#: What is put after a query so that its frame has something to say, by query_id % 8.
ENDS = (
    " How do I install it? How to set up", " what did Bob say last week", " what went wrong in March", ' compare "GraphQL" vs REST', " which is better, do you recommend it",
    " I said it changed over time", " never before Easter", " currently nothing",
)
FRAMED = "framed as (select query_id, query || case query_id % 8 " + " ".join(f"when {i} then '{e}'" for i, e in enumerate(ENDS)) + " end as q from asked)"


def framed(t: Tables) -> DataFrame:
    ends = F.element_at(F.array(*[F.lit(e) for e in ENDS]), (F.col("query_id") % 8 + 1).cast("int"))
    a = t.asked().select("query_id", F.concat("query", ends).alias("q"))
    return a.select("query_id", "q", *[c.alias(n) for n, c in r.query_frame(F.col("q")).items()])


def _any(patterns: tuple[str, ...]) -> str:
    return "(" + " or ".join(bounded(p.replace(r"\b", ""), "q") for p in patterns) + ")"


def _first(pattern: str) -> str:
    return f"nullif(regexp_extract(q, '(?:^|{OUT})((?i:{pattern.replace(chr(92) + 'b', '')}))(?:{OUT}|$)', 1), '')"


_PERSON = f"coalesce(nullif(regexp_extract(q, '(?:^|{OUT})(?i:what\\s+did\\s+([A-Z][a-z]+)\\s+(?:say|tell|mention))(?:{OUT}|$)', 1), ''), nullif(regexp_extract(q, '(?:^|{OUT})([A-Z][a-z]+)\\s+said(?:{OUT}|$)', 1), ''))"
_TIME = "coalesce(" + ", ".join(f"case when {_any((p,))} then '{r.LABELLED_TIMES[i]}' end" if i in r.LABELLED_TIMES else _first(p) for i, p in enumerate(r.TIMES)) + ")"
_PROC = " + ".join(f"({_any((p,))})::int" for p in r.PROCEDURE)
_FRAME = f"""with {ASKED}, {FRAMED},
 a as (select *, {_PERSON} as person, {_any(r.SELF)} as self, {_PROC} as proc, {_TIME} as time from framed),
 b as (select *, case when person is not null or self then 'prior_statement' when proc > 0 then 'procedure' when {_any(r.FAILURE)} then 'failure' when {_any(r.COMPARISON)} then 'comparison' when {_any(r.PREFERENCE)} then 'preference' else 'fact' end as target from a),
 c as (select *, case when time is not null and target not in ('prior_statement', 'comparison') then 'temporal_change' else target end as timed from b),
 d as (select *, timed in ('fact', 'temporal_change') and {_any(r.TEMPORAL)} as changed from c),
 e as (select *, case when changed then 'temporal_change' else timed end as final, list_distinct(list_concat(list_filter(regexp_extract_all({spread('q')}, '{OUT}([A-Z][a-z]+[A-Z][\\p{{L}}\\p{{N}}_]*|[A-Z]{{2,}}[\\p{{L}}\\p{{N}}_]*){OUT}', 1), lambda x: x <> ''), regexp_extract_all(q, '"([^"]+)"', 1))) as ents from d)"""


@query("qf_01", _FRAME + " select query_id, final as answer_target, case when person is null and self then 'assistant' end as speaker_role, upper(person[1]) || lower(person[2:]) as person from e")
def answer_targets(t: Tables) -> DataFrame:
    return framed(t).select("query_id", "answer_target", "speaker_role", "person")


@query("qf_02", _FRAME + " select query_id, time as time_constraint from e")
def time_constraints(t: Tables) -> DataFrame:
    return framed(t).select("query_id", "time_constraint")


@query("qf_03", _FRAME + f""" select query_id, array_to_string(list_sort(ents), '|') as entities, array_to_string(regexp_extract_all(q, '"([^"]{{2,60}})"', 1), '|') as quoted, {bounded("not|never|without|don''t|doesn''t|didn''t|shouldn''t|can''t|won''t|no longer", 'q')} as negation from e""")
def frame_entities(t: Tables) -> DataFrame:
    return framed(t).select("query_id", F.array_join(F.array_sort("entities"), "|").alias("entities"), F.array_join("quoted", "|").alias("quoted"), "negation")


@query("qf_04", _FRAME + " select query_id, case final when 'temporal_change' then 'compare_over_time' when 'comparison' then 'multi_hop' else 'single_hop' end as mode, least((case when person is not null or self then 2 when proc > 0 then least(proc, 2) when target <> 'fact' then 1 else 0 end + (time is not null)::int + changed::int + (len(ents) > 0)::int) / 4.0, 1.0)::double as confidence from e")
def modes(t: Tables) -> DataFrame:
    return framed(t).select("query_id", "mode", "confidence")


@query("ret_01", f"with {CARDS}, p as (select *, string_split(meaning, ' ') as w, list_filter(string_split(meaning, '. '), lambda x: x <> '') as s from cards) select anchor_id, name || chr(10) || meaning || chr(10) || 'Includes: ' || array_to_string(w[1:8], ', ') || chr(10) || 'Excludes: ' || array_to_string(w[1:4], ', ') || chr(10) || array_to_string(s[1:15], chr(10)) || chr(10) || array_to_string(s[1:3], chr(10)) || chr(10) || array_to_string(w[greatest(len(w) - 19, 1):], chr(10)) as card_text from p")
def card_texts(t: Tables) -> DataFrame:
    w, s = F.split("meaning", " "), F.filter(F.split("meaning", r"\. "), lambda x: x != "")
    return t.cards().select("anchor_id", r.card_text(F.col("name"), F.col("meaning"), w, w, s, s, w).alias("card_text"))


_STOP = "[" + ", ".join(f"'{w}'" for w in r.STOP) + "]"


def _tokens(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower({column}), '([a-z]+)', 1), lambda x: length(x) >= 2 and not list_contains({_STOP}, x))"


@query("ret_02", f"select doc_id, len({_tokens('text')}) as n, md5(array_to_string({_tokens('text')}, ' ')) as tokens from documents")
def tokenized(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", r.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


_INDEX = """ix as (select d.doc, term, tf, dl, df, n, avgdl, ln((n - df + 0.5) / (df + 0.5) + 1) as idf from (select doc, term, len(any_value(tokens)) as dl, count(*) as tf from (select doc, tokens, unnest(tokens) as term from docs) group by doc, term) d
 join (select term, count(distinct doc) as df from (select doc, unnest(tokens) as term from docs) group by term) using (term), (select count(*) as n, avg(len(tokens)) as avgdl from docs))"""


@query("ret_03", f"with docs as (select doc_id as doc, {_tokens('text')} as tokens from documents), {_INDEX} select term, count(*) as df, sum(tf)::bigint as tf, round(max(idf), 6) as idf from ix group by term")
def bm25_index(t: Tables) -> DataFrame:
    docs = t("documents").select(F.col("doc_id").alias("doc"), r.tokens(F.col("text")).alias("tokens"))
    return r.bm25_index(docs).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.round(F.max("idf"), 6).alias("idf"))


def active_cards(t: Tables) -> DataFrame:
    return t.cards().where("status = 'active'").select(F.col("anchor_id").alias("doc"), r.tokens(F.col("meaning")).alias("tokens"), "centroid")


def queries(t: Tables) -> DataFrame:
    return t.asked().select("query_id", r.tokens(F.col("query")).alias("tokens"), "qvec")


_BM25 = f"""{ASKED}, {CARDS}, docs as (select anchor_id as doc, {_tokens('meaning')} as tokens, centroid from cards where status = 'active'), qs as (select query_id, {_tokens('query')} as tokens, qvec from asked), {_INDEX},
 hits as (select query_id, doc, sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as s from (select query_id, term, count(*) as qn from (select query_id, unnest(tokens) as term from qs) group by 1, 2) join ix using (term) group by 1, 2),
 bm as (select query_id, d.doc, round(coalesce(s, 0), 6) as score from qs cross join docs d left join hits using (query_id, doc)),
 de as (select query_id, doc, round(list_dot_product(qvec::double[], centroid::double[]), 6) as score from qs cross join docs)"""


@query("ret_04", f"with {_BM25} select * from bm")
def bm25_scores(t: Tables) -> DataFrame:
    return r.bm25_scores(queries(t), active_cards(t)).drop("rank")


_RANK = "row_number() over (partition by query_id order by score desc, doc) as rank"


@query("ret_05", f"with {_BM25} select * from (select *, {_RANK} from de) where rank <= 10")
def dense_top_k(t: Tables) -> DataFrame:
    return r.dense_scores(queries(t), active_cards(t), 10)


_FUSED = f"""x as (select * from (select *, {_RANK} from bm) where rank <= 10), y as (select * from (select *, {_RANK} from de) where rank <= 10),
 fu as (select query_id, doc, round(coalesce(1.0 / (60 + x.rank), 0) + coalesce(1.0 / (60 + y.rank), 0), 9)::double as score, coalesce(x.rank, 999) as a_rank, coalesce(y.rank, 999) as b_rank from x full join y using (query_id, doc))"""


@query("ret_06", f"with {_BM25}, {_FUSED} select * from (select *, {_RANK} from fu) where rank <= 8")
def hybrid(t: Tables) -> DataFrame:
    q, c = queries(t), active_cards(t)
    return r.fused(r.bm25_scores(q, c, 10), r.dense_scores(q, c, 10), 8)


@query("ret_07", f"with {_BM25} select * from (select *, {_RANK} from bm where score > 0) where rank <= 48")
def shortlist(t: Tables) -> DataFrame:
    return r.bm25_scores(queries(t), active_cards(t), r.SHORTLIST, positive=True)


@query("ret_09", f"with {_BM25} select *, {_RANK} from de")
def full_atlas(t: Tables) -> DataFrame:
    return r.dense_scores(queries(t), active_cards(t))


@query("sel_01", f"with {_BM25} select * from (select *, {_RANK} from de) where rank <= 6 and score >= 0.05")
def cosine_selection(t: Tables) -> DataFrame:
    return r.dense_scores(queries(t), active_cards(t), 6).where("score >= 0.05")


@query("sel_02", f"with {_BM25}, p as (select *, {_RANK}, least(count(*) filter (score >= 0.1) over (partition by query_id), 6) as p from de) select query_id, doc, score, rank from p where rank <= greatest(p, 2, 1)")
def trained_selection(t: Tables) -> DataFrame:
    return r.selected(r.dense_scores(queries(t), active_cards(t), 6), 0.1, 6, 2)


@query("sel_03", "select false as ok, 'recall; families: ' || (select string_agg(lang, ',' order by lang) from (select lang from documents group by lang having count(*) < 50)) as reasons where exists (select 1 from documents group by lang having count(*) < 50) union all select false, 'recall' where not exists (select 1 from documents group by lang having count(*) < 50)")
def training_gates(t: Tables) -> DataFrame:
    families = t("documents").groupBy(F.col("lang").alias("family")).agg(F.count("*").alias("n"))
    return r.gates(400, 250, 0.9, families)


@query("sel_05", f"with {_BM25}, p as (select *, {_RANK} from de), b as (select *, count(*) filter (score >= 0.02) over (partition by query_id) as p from p where rank <= 12) select query_id, doc, score, rank from b where rank <= greatest(p, 4, 1)")
def adaptive_selection(t: Tables) -> DataFrame:
    budget = r.dense_scores(queries(t), active_cards(t), 12).drop("rank")
    return r.selected(budget, 0.02, 12, 4)


@query("sel_06", _FRAME + ", m as (select query_id, final, case final when 'temporal_change' then 'compare_over_time' when 'comparison' then 'multi_hop' else 'single_hop' end as mode from e) select query_id, array_to_string(list_transform([" + ", ".join(f"'{x}'" for x in r.TARGETS) + "], lambda x: (x = final)::int), '') || array_to_string(list_transform([" + ", ".join(f"'{x}'" for x in r.MODES) + "], lambda x: (x = mode)::int), '') as features from m")
def frame_features(t: Tables) -> DataFrame:
    f = framed(t).select("query_id", r.frame_features(F.col("answer_target"), F.col("mode")).alias("f"))
    return f.select("query_id", F.array_join(F.transform("f", lambda x: x.cast("int").cast("string")), "").alias("features"))


_KINDS = ("SEMANTIC", "EPISODIC", "PROCEDURAL", "FAILURE", "TOOL_USE", "WORKING_DERIVATIVE")


@query("sel_07", f"with {MEM}, c as (select primary_anchor_id as anchor_id, count(*) as n, avg(quality_score) as q, " + ", ".join(f"count(*) filter (memory_type = '{k}') / count(*) as {k.lower()}" for k in _KINDS) + " from mem where not is_archived and not is_duplicate group by 1) select anchor_id, " + ", ".join(f"round({k.lower()}, 6) as {k.lower()}" for k in _KINDS) + ", round(q, 6) as avg_quality, round(n / max(n) over (), 6) as memory_count_norm from c")
def anchor_features(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    m = t.memories().where("not is_archived and not is_duplicate").groupBy(F.col("primary_anchor_id").alias("anchor_id"))
    c = m.agg(F.count("*").alias("n"), F.avg("quality_score").alias("q"), *[(F.count_if(F.col("memory_type") == k) / F.count("*")).alias(k.lower()) for k in _KINDS])
    whole = Window.partitionBy(F.lit(0))  # one row for each anchor
    return c.select("anchor_id", *[F.round(k.lower(), 6).alias(k.lower()) for k in _KINDS], F.round("q", 6).alias("avg_quality"), F.round(F.col("n") / F.max("n").over(whole), 6).alias("memory_count_norm"))
