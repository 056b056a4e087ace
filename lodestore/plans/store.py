"""Queries of the store operators (STO)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestore.functions import dot
from lodestore.operators import store
from lodestore.plans.base import ANCHORS, ASKED, MEM, NOW, Tables, query

BASIC = ("memory_object_id", "memory_type", "quality_score")


def probe(t: Tables, vec_id: int = 3) -> DataFrame:
    """One row: the vector that is searched for."""
    return t("embeddings").where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q"))


DOT = "round(list_dot_product(embedding::double[], q::double[]), 6)"


@query("sto_01", "select * from (select doc_id as source_id, source, n_chars from documents where doc_id % 2 = 0 union all select doc_id, 'new' as source, n_chars from documents where doc_id % 3 = 0 and doc_id % 2 <> 0)")
def insert_or_ignore(t: Tables) -> DataFrame:
    d = t("documents").select(F.col("doc_id").alias("source_id"), "source", "n_chars")
    return store.insert_ignored(d.where("source_id % 2 = 0"), d.where("source_id % 3 = 0").withColumn("source", F.lit("new")), "source_id")


@query("sto_02", "select doc_id as source_id, case when doc_id % 3 = 0 then 'new' else source end as source, case when doc_id % 3 = 0 then n_chars + 2 else n_chars end as version from documents")
def insert_or_replace(t: Tables) -> DataFrame:
    d = t("documents").select(F.col("doc_id").alias("source_id"), "source", F.col("n_chars").alias("version"))
    new = d.where("source_id % 3 = 0").withColumn("source", F.lit("new"))
    twice = new.withColumn("version", F.col("version") + 1).union(new.withColumn("version", F.col("version") + 2))
    return store.replaced(d, twice, "source_id", F.col("version"))


@query("sto_03", f"with {MEM} select memory_object_id, title, memory_type from mem where memory_object_id = 'm7'")
def point_lookup(t: Tables) -> DataFrame:
    return t.memories().where("memory_object_id = 'm7'").select("memory_object_id", "title", "memory_type")


@query("sto_04", f"with {MEM} select tenant_id, count(*) as n from mem where not is_archived group by tenant_id")
def count_active(t: Tables) -> DataFrame:
    return t.memories().where("not is_archived").groupBy("tenant_id").agg(F.count("*").alias("n"))


@query("sto_05", f"with {MEM} select primary_anchor_id, memory_type, count(*) as n from mem where not is_archived and not is_duplicate group by 1, 2")
def count_by_anchor_and_type(t: Tables) -> DataFrame:
    return t.memories().where(store.ACTIVE).groupBy("primary_anchor_id", "memory_type").agg(F.count("*").alias("n"))


@query("sto_06", f"with {MEM} select memory_object_id, created_s from mem where memory_type = 'FAILURE' and not is_archived and not is_duplicate order by created_s desc, seq limit 100")
def by_type(t: Tables) -> DataFrame:
    return t.memories().where(store.ACTIVE).where("memory_type = 'FAILURE'").orderBy(F.desc("created_s"), "seq").limit(100).select("memory_object_id", "created_s")


_BY_ANCHOR = """
 p as (select *, row_number() over (partition by anchor_id order by quality_score desc, created_s desc, seq) as rq from a),
 s as (select *, coalesce({dot}, 0) as similarity from p, (select embedding as q from embeddings where vec_id = 3) where rq <= 200),
 r as (select anchor_id, memory_object_id, similarity, row_number() over (partition by anchor_id order by similarity desc, seq) as rank from s)
 select * from r where rank <= {most}"""


@query("sto_07", f"with {MEM}, a as (select *, primary_anchor_id as anchor_id from mem where not is_archived and not is_duplicate), {_BY_ANCHOR.format(dot=DOT, most=50)}")
def by_primary_anchor(t: Tables) -> DataFrame:
    m = t.memories().withColumn("anchor_id", F.col("primary_anchor_id")).crossJoin(F.broadcast(probe(t)))
    return store.by_anchor(m, F.col("q")).select("anchor_id", "memory_object_id", "similarity", "rank")


@query("sto_08", f"with {MEM}, a as (select *, unnest(secondary_anchor_ids) as anchor_id from mem where not is_archived and not is_duplicate), {_BY_ANCHOR.format(dot=DOT, most=25)}")
def by_secondary_anchor(t: Tables) -> DataFrame:
    m = t.memories().withColumn("anchor_id", F.explode("secondary_anchor_ids")).crossJoin(F.broadcast(probe(t)))
    return store.by_anchor(m, F.col("q"), 25).select("anchor_id", "memory_object_id", "similarity", "rank")


@query("sto_09", f"with {MEM} select memory_object_id, created_s, len(embedding) as dims from mem where embedding is not null and not is_archived order by created_s, seq")
def with_embeddings(t: Tables) -> DataFrame:
    return t.memories().where("embedding is not null and not is_archived").orderBy("created_s", "seq").select("memory_object_id", "created_s", F.size("embedding").cast("long").alias("dims"))


@query("sto_10", f"with {MEM} select memory_object_id, {DOT} as similarity from mem, (select embedding as q from embeddings where vec_id = 3) where embedding is not null and not is_archived and not is_duplicate order by 2 desc, seq limit 20")
def vector_top_k(t: Tables) -> DataFrame:
    m = t.memories().where(store.ACTIVE).crossJoin(F.broadcast(probe(t)))
    return store.top_by_vector(m, F.col("q"), 20, "seq").select("memory_object_id", "similarity")


@query("sto_11", f"with {MEM} select memory_object_id from mem where list_contains(secondary_anchor_ids, 10) order by seq limit 1")
def by_source_id(t: Tables) -> DataFrame:
    return t.memories().where(F.array_contains("secondary_anchor_ids", 10)).orderBy("seq").limit(1).select("memory_object_id")


@query("sto_12", f"with {MEM} select distinct s.session, memory_object_id from mem, (select * from (values ('session3/'), ('session17/'), ('session4')) v(session)) s where contains(source_path, s.session)")
def by_session(t: Tables) -> DataFrame:
    m = t.memories().withColumn("source_ids", F.array("seq"))
    sources = t.memories().select(F.col("seq").alias("source_id"), "source_path")
    sessions = t.spark.createDataFrame([("session3/",), ("session17/",), ("session4",)], "session string")
    return store.from_sessions(m, sources, sessions)


@query("sto_13", f"with {MEM} select memory_object_id, cast(case when seq % 4 = 0 then (seq + 1) % {ANCHORS} else primary_anchor_id end as int) as primary_anchor_id, case when seq % 4 = 0 then 0.9 end as assignment_confidence from mem")
def update_assignments(t: Tables) -> DataFrame:
    m = t.memories().select("memory_object_id", "primary_anchor_id", "seq")
    new = m.where("seq % 4 = 0").select("memory_object_id", ((F.col("seq") + 1) % ANCHORS).cast("int").alias("new_anchor"), F.lit(0.9).alias("assignment_confidence"))
    return m.join(new, "memory_object_id", "left").select("memory_object_id", F.coalesce("new_anchor", "primary_anchor_id").alias("primary_anchor_id"), "assignment_confidence")


@query("sto_14", f"with {MEM}, u as (select concat('m', user_id) as memory_object_id, count(*) as n, max(ts) as last_packed from events group by 1) select memory_object_id, pack_count + coalesce(n, 0) as pack_count, last_packed from mem left join u using (memory_object_id)")
def usage(t: Tables) -> DataFrame:
    used = t("events").select(F.concat(F.lit("m"), "user_id").alias("memory_object_id"), F.col("ts").alias("ts_s"))
    return store.with_usage(t.memories(), used).select("memory_object_id", "pack_count", F.col("last_packed_s").alias("last_packed"))


@query("sto_15", f"with {MEM} select memory_object_id, pack_count, select_count, quality_score from mem where not is_archived and primary_anchor_id = 5 order by pack_count, select_count, quality_score, seq")
def worst_first(t: Tables) -> DataFrame:
    m = t.memories().where("not is_archived and primary_anchor_id = 5")
    return m.orderBy("pack_count", "select_count", "quality_score", "seq").select("memory_object_id", "pack_count", "select_count", "quality_score")


@query("sto_16", f"with {MEM} select memory_object_id, is_archived or pack_count = 0 as is_archived from mem where not (is_archived and archived_s < {NOW} - 90 * 86400)")
def archive_and_expire(t: Tables) -> DataFrame:
    kept = t.memories().where(~(F.col("is_archived") & (F.col("archived_s") < NOW - 90 * 86400)))
    return kept.select("memory_object_id", (F.col("is_archived") | (F.col("pack_count") == 0)).alias("is_archived"))


@query("sto_17", f"with {MEM} select count(*) as total, count(*) filter (not is_archived) as active, count(*) filter (is_archived) as archived, count(*) filter (not is_archived and pack_count = 0) as never_packed, count(*) filter (not is_archived and select_count = 0) as never_selected from mem")
def forgetting_statistics(t: Tables) -> DataFrame:
    return store.statistics(t.memories())


@query("sto_18", f"with {MEM} select memory_object_id, case when regexp_matches(coalesce(d.text, body), '\\b(deprecated|legacy)\\b') then 'deprecated' end as stance, length(coalesce(d.text, body)) as n from mem left join documents d on d.doc_id = seq + 1")
def backfill_facets(t: Tables) -> DataFrame:
    d = t("documents").select((F.col("doc_id") - 1).alias("seq"), "text")
    text = F.coalesce("text", "body")
    return t.memories().join(d, "seq", "left").select("memory_object_id", F.when(text.rlike(r"\b(deprecated|legacy)\b"), "deprecated").alias("stance"), F.length(text).cast("long").alias("n"))


@query("sto_19", "select source as wing, lang as room, count(*) as n from documents group by rollup (source, lang)")
def taxonomy(t: Tables) -> DataFrame:
    return t("documents").rollup(F.col("source").alias("wing"), F.col("lang").alias("room")).agg(F.count("*").alias("n"))


@query("sto_20", "select d.doc_id, round(1 - (1 - list_dot_product(e.embedding::double[], q.embedding::double[])), 3) as similarity from documents d join embeddings e on e.vec_id = d.doc_id, (select embedding from embeddings where vec_id = 3) q where d.lang = 'en' order by 2 desc, 1 limit 5")
def drawer_search(t: Tables) -> DataFrame:
    d = t("documents").where("lang = 'en'").select("doc_id").join(t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").crossJoin(F.broadcast(probe(t)))
    return d.select("doc_id", F.round(1 - (1 - dot("embedding", "q")), 3).alias("similarity")).orderBy(F.desc("similarity"), "doc_id").limit(5)


@query("sto_21", "select vec_id, round(list_dot_product(embedding::double[], q::double[]), 6) as similarity from embeddings, (select embedding as q from embeddings where vec_id = 3) where list_dot_product(embedding::double[], q::double[]) >= 0.9 order by 2 desc, 1 limit 5")
def duplicate_check(t: Tables) -> DataFrame:
    e = t("embeddings").crossJoin(F.broadcast(probe(t)))
    return store.top_by_vector(e, F.col("q"), 5, "vec_id").where("similarity >= 0.9").select("vec_id", "similarity")


@query("sto_24", f"with {MEM}, {ASKED} select concat('new-', query_id) as memory_object_id, 'SEMANTIC' as memory_type, substr(query, 1, 256) as summary, concat(substr(query, 1, 60), chr(10), query) as embed_text from asked")
def store_through_api(t: Tables) -> DataFrame:
    a = t.asked()
    return a.select(F.concat(F.lit("new-"), "query_id").alias("memory_object_id"), F.lit("SEMANTIC").alias("memory_type"), F.substring("query", 1, 256).alias("summary"), F.concat(F.substring("query", 1, 60), F.lit("\n"), "query").alias("embed_text"))


@query("sto_25", "select event_id, cast(json_extract(props, '$.k') as bigint) as k, event_id % 2 = 1 as flag from events")
def decode_rows(t: Tables) -> DataFrame:
    return t("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), (F.col("event_id") % 2).cast("boolean").alias("flag"))
