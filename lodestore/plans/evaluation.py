"""Queries of the evaluation operators (EVL)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestore.functions import set_f1, words
from lodestore.operators import evaluation as e
from lodestore.operators import routing
from lodestore.plans.base import ASKED, ASKED_VECTORS, Tables, query
from lodestore.plans.retrieval import OUT, spread
from lodestore.plans.training import _F1, _WORDS
from lodestore.sources import files

ENDS = (" yesterday", " as you suggested 3 weeks ago", " about 'the' last month", "", " lately, recently", ' what Bob told "there" a week ago')
NO_NAMES = ["The", "That"]


#: Questions that search: those whose id this divides; of evl_07 and others that say so, all.
EVERY = 50
#: Answer sessions of a question, by their distance from its own.
GOLD = (0, 1, 4)


def sessions(t: Tables, some: DataFrame | None = None) -> DataFrame:
    """A conversation is a session: its user's, its assistant's and all its turns (also in lower case, made once), a day, a vector and a room. some: those alone that have a row of it (session_id)."""
    c, v = t("conversations"), t("embeddings").select(F.col("vec_id").alias("session_id"), F.col("embedding").alias("vec"), F.col("label").alias("room"))
    if some is not None:
        some = some.select("session_id").distinct()
        c, v = c.join(some, c["conv_id"] == some["session_id"], "left_semi"), v.join(some, "session_id", "left_semi")
    said = lambda who: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(who, F.struct("turn", "text")))), lambda x: x["text"]), "\n")
    role = F.col("role")
    s = c.groupBy(F.col("conv_id").alias("session_id")).agg(
        said(role == "user").alias("user_text"),
        said(role == "assistant").alias("asst_text"),
        said(role.isNotNull()).alias("full_text"),
        F.count_if(role == "user").alias("n_user"),
    )
    s = s.withColumn("hall", e.session_hall(F.col("user_text"), F.col("asst_text")))
    s = s.withColumns({"low_user": F.lower("user_text"), "low_full": F.lower("full_text")})
    return s.where("n_user > 0").join(v, "session_id").withColumn("day", F.col("session_id") % 200)


def questions(t: Tables) -> DataFrame:
    end = F.get(F.array(*[F.lit(x) for x in ENDS]), (F.col("query_id") % 6).cast("int"))
    v = t("embeddings").where(ASKED_VECTORS).select((F.col("vec_id") - 300).alias("v"))
    q = t.asked().join(F.broadcast(v), F.col("query_id") % 200 == F.col("v")).select("query_id", F.concat("query", end).alias("question"), "qvec", (F.col("query_id") % 30 + 100).alias("asked_day"))
    # what depends on the question alone is made once, before questions meet sessions
    question = F.col("question")
    q = q.withColumns({
        "kw": e.keywords(question), "qt": e.quoted(question), "nm": e.names(question, NO_NAMES), "off": e.time_offset(question),
        "about": e.about_assistant(question), "halls": F.split(e.question_halls(question), ","),
    })
    low = F.transform("nm", F.lower)
    return q.withColumn("pk", F.filter("kw", lambda k: ~F.array_contains(low, k)))


def searched(t: Tables) -> DataFrame:
    return questions(t).where(F.col("query_id") % EVERY == 0)


def hits(t: Tables, k: int = e.FETCH) -> DataFrame:
    """Questions with the k closest of all sessions: dist is 1 - cosine. Questions and what each vector finds are written; after that come texts, of found sessions alone, once for each vector that finds them."""
    q = files.stored(t.spark, searched(t), "asked")
    named, found = e.searched_once(q, sessions(t).withColumnRenamed("session_id", "doc_id"), k)
    found = files.stored(t.spark, found.withColumnRenamed("doc_id", "session_id"), "hits")
    return e.met(named.drop("qvec"), found.join(sessions(t, found).drop("vec"), "session_id"))


def whole_hits(t: Tables, within: dict[str, tuple[str, str]], k: int = e.FETCH, asked: tuple[str, ...] = (), told: tuple[str, ...] = ()) -> DataFrame:
    """hits() of all questions: query_id, session_id, dist, near, the columns asked of questions and told of sessions, and shares of terms as within says, see shares()."""
    terms, texts = sorted({a for a, _ in within.values()}), sorted({b for _, b in within.values()})
    q = files.stored(t.spark, questions(t).select("query_id", "qvec", *asked, *terms), "asked")
    named, found = e.searched_once(q, sessions(t).withColumnRenamed("session_id", "doc_id"), k)
    found = files.stored(t.spark, found.withColumnRenamed("doc_id", "session_id"), "hits")
    return e.shares(named.drop("qvec"), found.join(sessions(t, found).select("session_id", *told, *texts), "session_id"), within)


def wishes(t: Tables) -> DataFrame:
    """(session_id, turns): users' turns in order; some get a wish, since given turns rarely hold any."""
    c = t("conversations").where("role = 'user'")
    begin = F.when(F.col("turn") % 4 == 0, "I prefer ").when(F.col("turn") % 4 == 2, "I still remember my ")
    wish = F.when(begin.isNotNull(), F.concat(begin, F.substring("text", 1, 30), F.lit(". "), "text")).otherwise(F.col("text"))
    return c.groupBy(F.col("conv_id").alias("session_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", wish.alias("w")))), lambda x: x["w"]).alias("turns"))


def preference_docs(t: Tables, patterns: tuple[str, ...], most: int) -> DataFrame:
    p = wishes(t).select("session_id", e.preferences(F.col("turns"), patterns, most).alias("p")).where(F.size("p") > 0)
    return p.select("session_id", F.concat(F.lit("User has mentioned: "), F.array_join("p", "; ")).alias("doc"))


_SESSIONS = """se0 as (select conv_id as session_id,
    coalesce(string_agg(text, chr(10) order by turn) filter (role = 'user'), '') as user_text,
    coalesce(string_agg(text, chr(10) order by turn) filter (role = 'assistant'), '') as asst_text,
    string_agg(text, chr(10) order by turn) as full_text, count(*) filter (role = 'user') as n_user from conversations group by 1),
se as (select se0.*, embedding as vec, label as room, session_id % 200 as day from se0 join embeddings on vec_id = session_id where n_user > 0)"""
_ENDS = " ".join("when {} then '{}'".format(i, x.replace("'", "''")) for i, x in enumerate(ENDS))
_QUESTIONS = f"""{ASKED}, qu as (select query_id, query || case query_id % 6 {_ENDS} end as question, qvec, query_id % 30 + 100 as asked_day
    from asked join embeddings on vec_id - 300 = query_id % 200)"""
_NOK = "[" + ", ".join(f"'{w}'" for w in e.NO_KEYWORDS) + "]"
_KW = f"list_filter(regexp_extract_all({spread('lower(question)')}, '{OUT}([a-z]{{3,}}){OUT}', 1), lambda w: not list_contains({_NOK}, w))"
_SHARE = "case when len({terms}) = 0 then 0 else len(list_filter({terms}, lambda k: contains(lower({text}), lower(k)))) / len({terms}) end"
_QT = """list_filter(list_transform(list_concat(regexp_extract_all(question, '''([^'']{3,60})''', 1), regexp_extract_all(question, '"([^"]{3,60})"', 1)), lambda p: trim(p)), lambda p: length(p) >= 3)"""
_NM = f"list_filter(list_distinct(regexp_extract_all({spread('question')}, '{OUT}([A-Z][a-z]{{2,15}}){OUT}', 1)), lambda w: not list_contains(['The', 'That'], w))"
_OFF = "case " + " ".join(
    f"when regexp_matches(lower(question), '{p}') then " + (f"[cast(regexp_extract(lower(question), '{p}', 1) as int) * {d}, {tol}]" if "(\\d+)" in p else f"[{d}, {tol}]")
    for p, d, tol in e.OFFSETS
) + " end"
_ABOUT = "(" + " or ".join(f"contains(lower(question), '{x}')" for x in e.ASSISTANT) + ")"
_STATED = f" where query_id % {EVERY} = 0"
_QK = f"""{_SESSIONS}, {_QUESTIONS},
qk0 as (select *, {_KW} as kw, {_QT} as qt, {_NM} as nm, {_OFF} as off, {_ABOUT} as about from qu{_STATED}),
qk as (select *, list_filter(kw, lambda k: not list_contains(list_transform(nm, lambda n: lower(n)), k)) as pk from qk0)"""
_DIST = "round(1 - list_dot_product(qvec::double[], vec::double[]), 6)"
_TB = "case when off is null then 0 when away <= off[2] then 0.4 when away <= 3 * off[2] then 0.4 * (1 - (away - off[2]) / (2.0 * off[2])) else 0 end"
_HITS = f"""{_QK},
hi0 as (select *, {_DIST} as dist from qk, se),
hi as (select *, row_number() over (partition by query_id order by dist, session_id) as near from hi0),
ho as (select *, {_SHARE.format(terms='kw', text='user_text')} as ov, abs(day - (asked_day - off[1])) as away from hi where near <= {e.FETCH}),
hb as (select *, round((dist * (1 - 0.3 * ov))::double, 6) as v1, {_TB} as tb from ho)"""
_RANKED = "row_number() over (partition by query_id order by score, session_id) as rank"
_GOLD = f"go as (select query_id, session_id from qk, (select unnest({list(GOLD)}) as away), se where session_id = query_id + away)"


def whole(sql: str) -> str:
    """sql for all questions."""
    return sql.replace(_STATED, "")


def v1(text: str = "low_user") -> object:
    return F.round(F.col("dist") * (1 - e.OVERLAP * e.share_within(F.col("kw"), F.col(text))), 6)


def half_up(x: object) -> object:
    """x to six decimals, halves away from 0 as SQL has them: F.round() takes a product that lies a hair under a half, such as 0.804175 * 0.9, down."""
    return F.signum(x) * F.floor(F.abs(x) * 1e6 + 0.5) / 1e6


def overlapped(share: str) -> object:
    return half_up(F.col("dist") * (1 - e.OVERLAP * F.col(share)))


def boost() -> object:
    return e.temporal_boost(F.col("day"), F.col("asked_day"), F.col("off"))


#: A document's text as the answer, the next one's as the truth.
_PAIRS = f"pa as (select d.doc_id, {_WORDS.format('d.text')} as a, {_WORDS.format('n.text')} as b from documents d join documents n on n.doc_id = d.doc_id + 1)"


def pairs(t: Tables) -> DataFrame:
    d = t("documents").select("doc_id", "text")
    return d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("truth")), "doc_id")


def word_pairs(t: Tables, *more: str) -> DataFrame:
    """pairs() as their distinct words, a and b. Each text is cut into words before the join, so that nothing that uses them does it again."""
    d = t("documents").select("doc_id", "text", words("text").alias("a"))
    return d.select("doc_id", "a", *more).join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")


@query("evl_01", f"with {_PAIRS} select doc_id, round({_F1.format(a='a', b='b')}::double, 6) as f1 from pa")
def set_f1_scores(t: Tables) -> DataFrame:
    d = word_pairs(t)
    return d.select("doc_id", F.round(set_f1(F.col("a"), F.col("b")), 6).alias("f1"))


def _answer(column: str) -> str:
    spaced = f"regexp_replace(replace({column}, ',', ''), '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g')"
    return f"list_filter(string_split_regex(trim(lower(regexp_replace(regexp_replace(regexp_replace(' ' || {spaced} || ' ', '{OUT}(a|an|the|and){OUT}', ' ', 'g'), '\\s+', ' ', 'g'), '[!-/:-@\\[-`{{-~]', '', 'g'))), ' +'), lambda w: w <> '')"


@query("evl_02", f"with x as (select d.doc_id, {_answer('d.text')} as a, {_answer('n.text')} as b from documents d join documents n on n.doc_id = d.doc_id + 1), ca as (select doc_id, w, count(*) as n from (select doc_id, unnest(a) as w from x) group by 1, 2), cb as (select doc_id, w, count(*) as n from (select doc_id, unnest(b) as w from x) group by 1, 2), s as (select doc_id, sum(least(ca.n, cb.n)) as same from ca join cb using (doc_id, w) group by 1) select doc_id, round(case when len(a) = 0 or len(b) = 0 then (len(a) = len(b))::int else 2.0 * coalesce(same, 0) / (len(a) + len(b)) end::double, 6) as f1 from x left join s using (doc_id)")
def multiset_f1(t: Tables) -> DataFrame:
    d = pairs(t).select("doc_id", e.answer_tokens(F.col("text")).alias("a"), e.answer_tokens(F.col("truth")).alias("b"))
    return e.multiset_f1(d, "doc_id")


_RK = f"""{_HITS}, {_GOLD}, sc as (select query_id, session_id, v1 as score from hb), rk as (select *, {_RANKED} from sc)"""


def ranking(t: Tables, k: int = e.FETCH) -> DataFrame:
    return e.ranked(hits(t, k).select("query_id", "session_id", v1().alias("score")))


def whole_ranking(t: Tables, k: int = e.FETCH) -> DataFrame:
    """ranking() of all questions."""
    return e.ranked(whole_hits(t, {"ov": ("kw", "low_user")}, k).select("query_id", "session_id", overlapped("ov").alias("score")))


def gold(t: Tables, asked: Callable[[Tables], DataFrame] = searched) -> DataFrame:
    """Answer sessions of each question, of those that there are."""
    g = asked(t).select("query_id", F.explode(F.array(*[F.lit(x) for x in GOLD])).alias("away"))
    return g.select("query_id", (F.col("query_id") + F.col("away")).alias("session_id")).join(sessions(t).select("session_id"), "session_id", "left_semi").select("query_id", "session_id")


def _metric(k: int) -> str:
    return f"(coalesce(sum(rel) filter (rank <= {k}), 0) > 0)::int::double as any_{k}, (coalesce(sum(rel) filter (rank <= {k}), 0) >= max(n_gold))::int::double as all_{k}, case when coalesce(sum(rel) filter (rank <= {k}), 0) = 0 then 0 else round(sum(rel / log2(rank + 1)) filter (rank <= {k}) / list_sum(list_transform(range(1, (sum(rel) filter (rank <= {k}))::bigint + 1), lambda i: 1 / log2(i + 1))), 6) end::double as ndcg_{k}"


@query("evl_03", f"with {_RK}, n as (select query_id, count(*) as n_gold from go group by 1), j as (select n.query_id, n_gold, rank, case when go.session_id is not null then 1 else 0 end as rel from n join rk using (query_id) left join go on go.query_id = rk.query_id and go.session_id = rk.session_id) select query_id, {', '.join(_metric(k) for k in e.KS)} from j group by query_id")
def retrieval_metrics(t: Tables) -> DataFrame:
    return e.metrics(ranking(t), gold(t))


@query("evl_04", f"with {_RK}, m as (select query_id, max((contains('/s/' || session_id || '/', '/' || (query_id % 10)))::int) as hit from rk where rank <= 5 group by 1) select * from m")
def recall_by_path(t: Tables) -> DataFrame:
    hit = F.contains(F.concat(F.lit("/s/"), "session_id", F.lit("/")), F.concat(F.lit("/"), F.col("query_id") % 10))
    return ranking(t).where("rank <= 5").groupBy("query_id").agg(F.max(hit.cast("int")).alias("hit"))


@query("evl_05", f"with {_PAIRS}, f as (select doc_id, {_F1.format(a='a', b='b')} as f1, doc_id % 4 as n_anchors, doc_id % 3 = 0 as gold_hit from pa) select n_anchors, count(*) as n, round(avg(f1), 6) as mean_f1, round(avg(gold_hit::int), 6) as gold_rate, count(*) filter (f1 > 0.5) as success, count(*) filter (f1 < 0.3) as failed from f group by 1")
def benchmark_scores(t: Tables) -> DataFrame:
    d = word_pairs(t)
    f = d.select((F.col("doc_id") % 4).alias("n_anchors"), (F.col("doc_id") % 3 == 0).cast("int").alias("g"), set_f1(F.col("a"), F.col("b")).alias("f1"))
    return f.groupBy("n_anchors").agg(F.count("*").alias("n"), F.round(F.avg("f1"), 6).alias("mean_f1"), F.round(F.avg("g"), 6).alias("gold_rate"), F.count_if(F.col("f1") > 0.5).alias("success"), F.count_if(F.col("f1") < 0.3).alias("failed"))


@query("evl_05_labels", f"""with {_PAIRS},
 f as (
   select pa.doc_id, text, {_F1.format(a='a', b='b')} as f1, [pa.doc_id % 7, pa.doc_id % 5, pa.doc_id % 3] as selected,
     case pa.doc_id % 4 when 0 then [pa.doc_id % 5, 9] when 1 then [] end as gold
   from pa join documents d on d.doc_id = pa.doc_id
 ),
 w as (
   select *, case when len(coalesce(gold, [])) > 0 then list_sort(list_distinct(list_intersect(selected, gold))) when f1 < 0.3 then [] when f1 >= 0.5 then list_sort(list_distinct(selected)) end as winning
   from f
 )
 select 'q_' || substr(md5(text), 1, 8) as label_id, doc_id, array_to_string(winning, ',') as winning, round(f1::double, 6) as score from w where winning is not null""")
def emitted_labels(t: Tables) -> DataFrame:
    """Labels that a benchmark run gives to training: a document's text as the question, anchors by its number."""
    d = word_pairs(t, "text")
    part = lambda n: (F.col("doc_id") % n).cast("int")
    gold = F.when(part(4) == 0, F.array(part(5), F.lit(9))).when(part(4) == 1, F.array().cast("array<int>"))
    results = d.select(F.col("text").alias("question"), set_f1(F.col("a"), F.col("b")).alias("f1"), F.array(part(7), part(5), part(3)).alias("selected"), gold.alias("gold"), "doc_id")
    joined = F.array_join(F.transform("winning", lambda x: x.cast("string")), ",")
    return e.emitted_labels(results).select("label_id", "doc_id", joined.alias("winning"), F.round("f1", 6).alias("score"))


@query("evl_06", f"with {_RK}, a as (select query_id, list(session_id order by session_id) as s from rk where rank <= 5 group by 1), r2 as (select query_id, session_id, row_number() over (partition by query_id order by dist, session_id) as rank from hb), b as (select query_id, list(session_id order by session_id) as s from r2 where rank <= 5 group by 1) select query_id, round((len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))))::double, 6) as jaccard, a.s = b.s as same from a join b using (query_id)")
def ablation(t: Tables) -> DataFrame:
    top = lambda r: r.where("rank <= 5").groupBy("query_id").agg(F.array_sort(F.collect_list("session_id")).alias("s"))
    h = files.stored(t.spark, hits(t).select("query_id", "session_id", "dist", v1().alias("v1")), "ablation")
    by = lambda score: top(e.ranked(h.select("query_id", "session_id", F.col(score).alias("score"))))
    a, b = by("v1").withColumnRenamed("s", "a"), by("dist").withColumnRenamed("s", "b")
    j = a.join(b, "query_id")
    return j.select("query_id", F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6).alias("jaccard"), (F.col("a") == F.col("b")).alias("same"))


@query("evl_07", whole(f"with {_RK} select * from rk"))
def hybrid_v1(t: Tables) -> DataFrame:
    return whole_ranking(t)


_V2 = f"{_HITS}, nr as (select *, round((dist * (1 - 0.3 * {_SHARE.format(terms='kw', text='full_text')}))::double, 6) as full_, round((v1 * (1 - tb))::double, 6) as v2 from hb)"


@query("evl_08", whole(f"with {_V2}, o as (select query_id, session_id, case when about then (near > 5)::int else 0 end as late, case when about then case when near <= 5 then full_ else 0 end else v2 end as score from nr) select query_id, session_id, row_number() over (partition by query_id order by late, score, session_id) as rank from o"))
def hybrid_v2(t: Tables) -> DataFrame:
    """Questions about the assistant are ranked in two passes, the others by their words and the day that they ask for."""
    about = F.col("about")
    h = whole_hits(t, {"ov": ("kw", "low_user"), "ov_full": ("kw", "low_full")}, asked=("about", "asked_day", "off"), told=("day",))
    score = F.when(about, overlapped("ov_full")).otherwise(half_up(overlapped("ov") * (1 - boost())))
    return e.two_pass(h.select("query_id", "session_id", "dist", "about", score.alias("score")), about)


def _preferences(patterns: tuple[str, ...], most: int) -> str:
    """pd: session_id, doc."""
    found = ", ".join("regexp_extract_all(lower(w), '{}', {})".format(p.replace("'", "''"), int("([^" in p)) for p in patterns)
    wish = "case turn % 4 when 0 then 'I prefer ' || substr(text, 1, 30) || '. ' || text when 2 then 'I still remember my ' || substr(text, 1, 30) || '. ' || text else text end"
    return f"""pw as (select conv_id as session_id, turn, {wish} as w from conversations where role = 'user'),
pm as (select session_id, flatten(list(flatten([{found}]) order by turn)) as m from pw group by 1),
pc as (select session_id, list_filter(list_transform(m, lambda x: regexp_replace(trim(x), '[.,;!? ]+$', '')), lambda x: length(x) between 5 and 80) as c from pm),
pd as (select session_id, 'User has mentioned: ' || array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i)[1:{most}], '; ') as doc from pc where len(c) > 0)"""


@query("evl_09", f"with {_preferences(e.WISHES, 10)} select * from pd")
def preference_documents(t: Tables) -> DataFrame:
    """Users' wishes by session, as documents that are indexed beside it (see evl_10)."""
    return preference_docs(t, e.WISHES, 10)


_V4 = f"""{_QK}, {_preferences(e.WISHES + e.MEMORIES, 12)},
px as (select query_id, session_id * 2 as doc, session_id, full_text, user_text as text, vec, day from se, (select query_id from qk)
       union all select query_id, session_id * 2 + 1, session_id, full_text, doc, embedding, session_id % 200
       from pd join embeddings on vec_id = session_id + 1 join se using (session_id), (select query_id from qk where not about)),
hi0 as (select qk.*, px.* exclude(query_id), {_DIST} as dist from qk join px using (query_id)),
hi as (select *, row_number() over (partition by query_id order by dist, doc) as near, abs(day - (asked_day - off[1])) as away from hi0),
sx as (select query_id, session_id, case when about
    then dist * (1 - 0.3 * {_SHARE.format(terms='kw', text='full_text')}) * (1 - 0.6 * {_SHARE.format(terms='qt', text='full_text')})
    else dist * (1 - 0.3 * {_SHARE.format(terms='kw', text='text')}) * (1 - {_TB}) * (1 - 0.4 * {_SHARE.format(terms='nm', text='text')}) end as score
    from hi where near <= {e.FETCH}),
m as (select query_id, session_id, round(min(score)::double, 6) as score from sx group by 1, 2)"""


@query("evl_10", whole(f"with {_V4} select *, {_RANKED} from m"))
def hybrid_v4(t: Tables) -> DataFrame:
    """Sessions and their preference documents in one search; the best of both stands for the session. Questions about the assistant look at whole sessions alone.

    All questions search by vectors; texts join once for each vector that finds them.
    """
    q = files.stored(t.spark, questions(t).select("query_id", "qvec", "about", "asked_day", "off", "kw", "qt", "nm"), "asked")
    wish = files.stored(t.spark, preference_docs(t, e.WISHES + e.MEMORIES, 12), "wishes")
    own = sessions(t).select((F.col("session_id") * 2).alias("doc_id"), "vec")
    vec = t("embeddings").select((F.col("vec_id") - 1).alias("session_id"), F.col("embedding").alias("vec"))
    more = wish.join(vec, "session_id").join(sessions(t).select("session_id"), "session_id", "left_semi").select((F.col("session_id") * 2 + 1).alias("doc_id"), "vec")
    score = {
        True: F.col("dist") * (1 - e.OVERLAP * F.col("by_word")) * (1 - e.QUOTED * F.col("by_quote")),
        False: F.col("dist") * (1 - e.OVERLAP * F.col("by_word")) * (1 - boost()) * (1 - e.NAMED * F.col("by_name")),
    }
    scored = []
    for about, docs in ((True, own), (False, own.unionByName(more))):
        named, found = e.searched_once(q.where(F.coalesce("about", F.lit(True)) == about), docs)
        found = files.stored(t.spark, found.withColumn("session_id", F.floor(F.col("doc_id") / 2).cast("long")), "hits")
        told = sessions(t, found).select("session_id", F.col("low_full" if about else "low_user").alias("low"), "day")
        wishes_told = found.where("doc_id % 2 <> 0").join(wish, "session_id").withColumns({"low": F.lower("doc"), "day": F.col("session_id") % 200}).drop("doc")
        h = found.where("doc_id % 2 = 0").join(told, "session_id")
        h = h if about else h.unionByName(wishes_told)
        within = {"by_word": ("kw", "low")} | ({"by_quote": ("qt", "low")} if about else {"by_name": ("nm", "low")})
        named = named.select("query_id", "lead", "led", "asked_day", "off", *[terms for terms, _ in within.values()])
        scored.append(e.shares(named, h, within).select("query_id", "session_id", score[about].alias("score")))
    return e.ranked(e.best_per_session(scored[0].unionByName(scored[1])).withColumn("score", half_up(F.col("score"))))


def _count(text: str, signals: tuple[str, ...]) -> str:
    return "(" + " + ".join("contains({}, '{}')::int".format(text, s.replace("'", "''")) for s in signals) + ")"


_HALL = f"case when {_count('lower(user_text)', e.PREFERENCE)} > 0 then 'preferences' when {_count('lower(asst_text)', e.ADVICE)} >= 2 then 'assistant' when {_count('lower(user_text) || lower(asst_text)', e.EVENTS)} > 0 then 'events' when {_count('lower(user_text) || lower(asst_text)', e.FACTS)} >= 2 then 'facts' else 'general' end"
_QHALL = f"case when {_ABOUT} then 'assistant,general' when contains(lower(question), 'i prefer') or contains(lower(question), 'i usually') or contains(lower(question), 'battery') or contains(lower(question), 'lately') or contains(lower(question), 'recently been') or contains(lower(question), 'struggling with') then 'preferences,general' else 'events,facts' end"
_HALLS = f"{_HITS}, ha as (select query_id, session_id, v1, tb, {_HALL} as hall, {_QHALL} as halls from hb)"
_HALLED = "case when split_part(halls, ',', 1) = hall then 0.75 when split_part(halls, ',', 2) = hall then 0.9 else 1 end"


@query("evl_11", f"with {_HALLS}, x as (select query_id, session_id, hall, round((v1 * {_HALLED} * (1 - tb))::double, 6) as score from ha) select *, {_RANKED} from x")
def hall_boosts(t: Tables) -> DataFrame:
    h = hits(t)
    factor = F.when(F.col("halls")[0] == F.col("hall"), 0.75).when(F.col("halls")[1] == F.col("hall"), 0.9).otherwise(1.0)
    return e.ranked(h.select("query_id", "session_id", "hall", F.round(v1() * factor * (1 - boost()), 6).alias("score")))


_PRED = "round((dist * (1 - 0.5 * {pk}) * (1 - 0.6 * {qt}) * (1 - 0.2 * {nm}))::double, 6)".format(**{k: _SHARE.format(terms=k, text="full_text") for k in ("pk", "qt", "nm")})
_ROOMS = f"""{_QK}, {_GOLD},
ra as (select room, string_agg(lower(substr(full_text, 1, 80)), ' ') as said from se group by 1),
rs as (select query_id, room, case when len(pk) = 0 then 0 else len(list_filter(pk, lambda k: contains(said, k))) / len(pk) end as part from qk, ra),
rr as (select *, row_number() over (partition by query_id order by part desc, room desc) as place, max(part) over (partition by query_id) as best from rs),
ro as (select query_id, room from rr where place <= 3 or best = 0),
hi0 as (select qk.*, se.*, {_DIST} as dist from qk join ro using (query_id) join se using (room)),
hi as (select *, row_number() over (partition by query_id order by dist, session_id) as near from hi0),
s as (select query_id, session_id, {_PRED} as score from hi where near <= {e.FETCH}), r as (select *, {_RANKED} from s)"""


def predicate_score() -> object:
    low = F.col("low_full")
    score = F.col("dist") * (1 - 0.5 * e.share_within(F.col("pk"), low)) * (1 - 0.6 * e.share_within(F.col("qt"), low)) * (1 - 0.2 * e.share_within(F.col("nm"), low))
    return F.round(score, 6).alias("score")


def question_rooms(q: DataFrame, s: DataFrame) -> DataFrame:
    """(query_id, qvec, room): the three rooms whose sessions' summaries hold most of a question's predicate words; all rooms if none holds any.

    A word has no spaces, so a room's summaries hold it together if one of them does: no room's text is gathered.
    """
    said = s.select("room", F.substring("low_full", 1, 80).alias("said"))
    found = []
    for block in e.in_blocks(q):
        asked = F.broadcast(block.select("query_id", "pk"))
        place = F.sequence(F.lit(0), F.size("pk") - 1)
        held = said.join(asked.where(F.size("pk") > 0)).select("query_id", "room", F.explode(F.filter(place, lambda i: F.contains("said", F.get("pk", i)))).alias("i"))
        found.append(held.distinct())
    part = reduce(DataFrame.unionByName, found).groupBy("query_id", "room").agg(F.count("*").alias("held"))
    rooms = s.select("room").distinct()
    every = q.select("query_id", "qvec").join(F.broadcast(rooms)).join(part, ["query_id", "room"], "left").fillna(0, ["held"])  # as many rows as questions have rooms
    own = Window.partitionBy("query_id")
    placed = every.withColumns({"place": F.row_number().over(own.orderBy(F.desc("held"), F.desc("room"))), "best": F.max("held").over(own)})
    return placed.where("place <= 3 or best = 0").select("query_id", "qvec", "room")


@query("evl_12", f"with {_ROOMS} select go.query_id, round(avg((coalesce(rank, 99) <= 10)::int)::double, 6) as recall from go left join r using (query_id, session_id) group by 1")
def locomo(t: Tables) -> DataFrame:
    """Sessions of the rooms that a question leads to, re-ranked; the share of its answers among the first ten."""
    q, s = searched(t), sessions(t)
    found = e.nearest(files.stored(t.spark, question_rooms(q, s), "rooms"), s.withColumnRenamed("session_id", "doc_id"), e.FETCH, "room").withColumnRenamed("doc_id", "session_id")
    h = found.join(F.broadcast(q.drop("qvec")), "query_id").join(s.drop("vec"), "session_id")
    r = e.ranked(h.select("query_id", "session_id", predicate_score()))
    j = gold(t).join(r.select("query_id", "session_id", "rank"), ["query_id", "session_id"], "left")
    return j.groupBy("query_id").agg(F.round(F.avg((F.coalesce("rank", F.lit(99)) <= 10).cast("int")), 6).alias("recall"))


#: Sessions that count, and that are fetched before they are re-ranked.
TOP, MORE = 5, 15


@query("evl_13", whole(f"with {_RK}, f as (select query_id, session_id, row_number() over (partition by query_id order by v1, session_id) as rank from hb where near <= {MORE}), h as (select f.query_id, max((g.session_id is not null)::int) as hit from f left join go g on g.query_id = f.query_id and g.session_id = f.session_id where rank <= {TOP} group by 1) select query_id % 6 as category, count(*) as n, round(avg(hit), 6) as hit_rate from h group by 1"))
def membench(t: Tables) -> DataFrame:
    top = whole_ranking(t, MORE).where(F.col("rank") <= TOP).join(gold(t, questions).withColumn("hit", F.lit(1)), ["query_id", "session_id"], "left")
    h = top.groupBy("query_id").agg(F.coalesce(F.max("hit"), F.lit(0)).alias("hit"))
    return h.groupBy((F.col("query_id") % 6).alias("category")).agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("hit_rate"))


@query("evl_14", "with m as (select conv_id, text, turn from conversations where text <> ''), ev as (select conv_id, case when turn % 2 = 0 then substr(text, 3, 40) else 'x' || text || 'y' end as evidence, turn from m) select ev.conv_id, count(distinct ev.turn) filter (m.turn is not null) as found, count(distinct ev.turn) as n from ev left join m on m.conv_id = ev.conv_id and m.turn <> ev.turn + 1 and (contains(m.text, evidence) or contains(evidence, m.text)) group by 1")
def evidence_recall(t: Tables) -> DataFrame:
    """Evidence is found if it holds a message of its conversation or is held by one."""
    m = t("conversations").where("text <> ''").select("conv_id", "text", "turn")
    ev = m.select(F.col("conv_id").alias("c"), F.when(F.col("turn") % 2 == 0, F.substring("text", 3, 40)).otherwise(F.concat(F.lit("x"), "text", F.lit("y"))).alias("evidence"), F.col("turn").alias("k"))
    near = (F.col("c") == F.col("conv_id")) & (F.col("turn") != F.col("k") + 1) & (F.contains("text", F.col("evidence")) | F.contains("evidence", F.col("text")))
    return ev.join(m, near, "left").groupBy(F.col("c").alias("conv_id")).agg(F.count_distinct(F.when(F.col("turn").isNotNull(), F.col("k"))).alias("found"), F.count_distinct("k").alias("n"))


@query("evl_15", f"with {ASKED}, r as (select query_id, row_number() over (order by md5(query_id::varchar), query_id) as k from asked) select query_id, k <= 50 as dev from r")
def dev_split(t: Tables) -> DataFrame:
    """The first 50 in hash order: a limit, not a window over all."""
    order = F.md5(F.col("query_id").cast("string"))
    dev = t.asked().select("query_id").orderBy(order, "query_id").limit(50).withColumn("dev", F.lit(True))
    return t.asked().select("query_id").join(F.broadcast(dev), "query_id", "left").select("query_id", F.coalesce("dev", F.lit(False)).alias("dev"))


@query("evl_16", f"with {_SESSIONS}, u as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as k, text from conversations where role = 'user') select conv_id || '_turn_' || k as corpus_id, md5(text) as doc from u union all select session_id::varchar, md5(full_text) from se")
def corpora(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    u = t("conversations").where("role = 'user'").withColumn("k", F.row_number().over(w) - 1)
    turns = u.select(F.concat("conv_id", F.lit("_turn_"), "k").alias("corpus_id"), F.md5("text").alias("doc"))
    return turns.union(sessions(t).select(F.col("session_id").cast("string"), F.md5("full_text")))


ROOMS = ("technical", "architecture", "planning", "decisions", "problems", "general")


def stand_in_rooms(prompts: list[str]) -> list[str]:
    """A room by the length of a conversation's first word; of some lengths it makes nothing."""
    n = [p.split("Conversation:\n")[1].find(" ") + 1 for p in prompts]
    return ["zzz" if x % 7 == 3 else f"Room: {ROOMS[x % 6].upper()}" for x in n]


def stand_in_router(prompts: list[str]) -> list[str]:
    """One or two rooms by the length of a question; of some it has no idea."""
    n = [len(p.split("Question: ")[1]) for p in prompts]
    return ["no idea" if x % 5 == 4 else ROOMS[x % 6] + (f", {ROOMS[(x + 2) % 6]}" if x % 3 == 0 else "") for x in n]


def stand_in_pick(prompts: list[str]) -> list[str]:
    out = []
    for p in prompts:
        n, most = len(p.split("Question: ")[1].split("\n\nWhich of")[0]), int(p.split("(1-")[1].split(")")[0])
        out.append("none" if n % 4 == 1 else f"I choose {1 + n % most}.")
    return out


@query("evl_17", f"""with {_RK},
 p as (
   select rk.query_id, session_id, rank, case when length(question) % 4 <> 1 then 1 + length(question) % least(10, count(*) over (partition by rk.query_id)) end as pick
   from rk join qk using (query_id)
 )
 select query_id, session_id, row_number() over (partition by query_id order by case when rank = pick and pick <= 10 then 0 else 1 end, rank) as rank from p""")
def reranked(t: Tables) -> DataFrame:
    """A model, here a stand-in, sees the first ten hits of a question and picks one, which moves to the front."""
    h = hits(t).select("query_id", "session_id", "question", F.col("user_text").alias("text"), v1().alias("score"))
    return routing.repicked(e.ranked(h), stand_in_pick, files.shared_path(t.spark, "pick"))


@query("evl_19", f"with {_HALLS}, l as (select query_id, session_id, v1 * {_HALLED} * (1 - tb) as score from ha union all select query_id, session_id, v1 * 0.8 * (1 - tb) from ha where session_id % 2 = 0), m as (select query_id, session_id, round(min(score)::double, 6) as score from l group by 1, 2) select *, {_RANKED} from m")
def diary(t: Tables) -> DataFrame:
    """Layers share the session's id; the diary layer (here every second session) weighs .80; the best of a session counts."""
    factor = F.when(F.col("halls")[0] == F.col("hall"), 0.75).when(F.col("halls")[1] == F.col("hall"), 0.9).otherwise(1.0)
    h = hits(t).select("query_id", "session_id", v1().alias("v1"), factor.alias("factor"), (1 - boost()).alias("rest"))
    raw, layer = F.col("v1") * F.col("factor") * F.col("rest"), F.col("v1") * 0.8 * F.col("rest")
    layers = F.when(F.col("session_id") % 2 == 0, F.array(raw, layer)).otherwise(F.array(raw))
    scored = h.select("query_id", "session_id", F.explode(layers).alias("score"))
    return e.ranked(e.best_per_session(scored).withColumn("score", F.round("score", 6)))


_ROOMS = "[" + ", ".join(f"'{r}'" for r in ROOMS) + "]"


@query("evl_20", f"""with {_QK},
 sr as (select *, case when session_id % 10 = 0 then 'planning' when word % 7 = 3 then 'general' else {_ROOMS}[word % 6 + 1] end as cell
   from (select *, instr(replace(substr(full_text, 1, 600), chr(10), ' '), ' ') as word from se)),
 ro as (
   select query_id, unnest(case when length(question) % 5 = 4 then {_ROOMS} when length(question) % 3 = 0 then [{_ROOMS}[length(question) % 6 + 1], {_ROOMS}[(length(question) + 2) % 6 + 1]]
     else [{_ROOMS}[length(question) % 6 + 1]] end) as cell from qk
 ),
 di as (select query_id, question, session_id, {_DIST} as dist from qk join ro using (query_id) join sr using (cell)),
 ra as (select *, row_number() over (partition by query_id order by dist, session_id) as rank from di),
 fe as (select *, least(10, count(*) over (partition by query_id)) as n from ra where rank <= {e.FETCH}),
 pi as (select *, case when n > 1 and length(question) % 4 <> 1 then 1 + length(question) % n end as pick from fe)
 select query_id, session_id, row_number() over (partition by query_id order by case when rank = pick then 0 else 1 end, rank) as rank from pi""")
def routed(t: Tables) -> DataFrame:
    """Sessions and questions are put into rooms by a stand-in model, every tenth session's room is known; questions search their rooms alone, and one of the first ten hits is picked."""
    path = files.shared_path(t.spark, "rooms")
    q = searched(t).select("query_id", "question", "qvec")
    s = sessions(t).select("session_id", F.col("full_text").alias("text"), "vec")
    known = s.where("session_id % 10 = 0").select("session_id", F.lit("planning").alias("room"))
    rooms = routing.assigned_rooms(s.select("session_id", "text"), known, ROOMS, stand_in_rooms, f"{path}/assigned")
    found = routing.searched_rooms(q, routing.routed(q, ROOMS, stand_in_router, f"{path}/routes"), s.select("session_id", "vec").join(rooms, "session_id"))
    found = files.stored(t.spark, found.withColumnRenamed("near", "rank"), "hits")
    text = sessions(t, found.where(F.col("rank") <= routing.PICKED)).select("session_id", F.col("full_text").alias("text"))
    hits = found.join(q.select("query_id", "question"), "query_id").join(text, "session_id", "left")
    return routing.repicked(hits, stand_in_pick, f"{path}/picks")


@query("evl_21", whole(f"with {_HITS}, s as (select query_id, session_id, {_PRED} as score from hb where near <= {MORE}) select * from (select *, {_RANKED} from s) where rank <= {TOP}"))
def locomo_standard(t: Tables) -> DataFrame:
    h = whole_hits(t, {k: (k, "low_full") for k in ("pk", "qt", "nm")}, MORE)
    score = half_up(F.col("dist") * (1 - 0.5 * F.col("pk")) * (1 - 0.6 * F.col("qt")) * (1 - 0.2 * F.col("nm")))
    return e.ranked(h.select("query_id", "session_id", score.alias("score"))).where(F.col("rank") <= TOP)


@query("evl_22", "select min(conv_id) as session_id, md5(text) as h from conversations where turn = 0 group by md5(text)")
def unique_sessions(t: Tables) -> DataFrame:
    return t("conversations").where("turn = 0").groupBy(F.md5("text").alias("h")).agg(F.min("conv_id").alias("session_id"))


@query("evl_23", f"with {_QUESTIONS} select query_id, array_to_string({_KW}, ' ') as keywords, array_to_string({_QT}, '|') as quoted, array_to_string(list_sort({_NM}), '|') as names, '[' || asked_day || '] [User] ' || question as rendered, regexp_replace(query_id || '_turn_' || asked_day, '_turn_[0-9]+$', '') as session from qu")
def helpers(t: Tables) -> DataFrame:
    q = F.col("question")
    return questions(t).select("query_id", F.array_join(e.keywords(q), " ").alias("keywords"), F.array_join(e.quoted(q), "|").alias("quoted"), F.array_join(F.array_sort(e.names(q, NO_NAMES)), "|").alias("names"), F.concat(F.lit("["), "asked_day", F.lit("] [User] "), q).alias("rendered"), F.substring_index(F.concat("query_id", F.lit("_turn_"), "asked_day"), "_turn_", 1).alias("session"))


@query("evl_24", whole(f"with {_RK}, k as (select distinct query_id, query_id % 5 as category from rk), r as (select k.category, k.query_id, count(g.session_id) filter (coalesce(rank, 99) <= 5) / greatest(count(g.session_id), 1) as recall from k left join go g using (query_id) left join rk on rk.query_id = g.query_id and rk.session_id = g.session_id group by 1, 2) select category, count(*) as n, round(avg(recall), 6) as mean_recall, count(*) filter (recall = 1) as perfect, count(*) filter (recall = 0) as zero from r group by 1"))
def convomem(t: Tables, most: int | None = None) -> DataFrame:
    """Recall of the first five by category, of all its questions or the first `most`."""
    r = files.stored(t.spark, whole_ranking(t).where("rank <= 5"), "ranking")
    k = e.first_items(r.select("query_id").distinct().withColumn("category", F.col("query_id") % 5), most)
    j = k.join(gold(t, questions), "query_id", "left").join(r.select("query_id", "session_id", "rank"), ["query_id", "session_id"], "left")
    hit = F.count_if(F.col("session_id").isNotNull() & (F.coalesce("rank", F.lit(99)) <= 5)) / F.greatest(F.count("session_id"), F.lit(1))
    q = j.groupBy("category", "query_id").agg(hit.alias("recall"))
    return q.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.count_if(F.col("recall") == 1).alias("perfect"), F.count_if(F.col("recall") == 0).alias("zero"))
