"""Queries by operator ID, and the memory-store tables that they derive from the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Tables under name; sql is its equivalent over the same tables."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = Query(lambda spark, sf_dir: f(Tables(spark, sf_dir)), sql)
        return f

    return register


#: 2024-01-01 and the fixed clock of the queries, 2024-06-01, in seconds.
START, NOW = 1_704_067_200, 1_717_200_000
ANCHORS = 24
TYPES = ("SEMANTIC", "EPISODIC", "PROCEDURAL", "FAILURE", "TOOL_USE", "WORKING_DERIVATIVE")

#: Columns of the memory objects, valid in either dialect. From documents d, labels l and embeddings e.
_MEMORY = {
    "memory_object_id": "concat('m', d.doc_id)",
    "seq": "d.doc_id",
    "tenant_id": "d.source",
    "memory_type": "case d.doc_id % 6 " + " ".join(f"when {i} then '{t}'" for i, t in enumerate(TYPES)) + " end",
    "title": "substr(d.text, 1, 60)",
    "body": "d.text",
    "summary": "substr(d.text, 1, 256)",
    "source_path": "concat('/', d.source, '/session', d.doc_id % 50, '/', d.doc_id, case d.doc_id % 3 when 0 then '.jsonl' when 1 then '.md' else '.py' end)",
    "quality_score": "coalesce(l.quality, 0) * 0.5e0 + (d.doc_id * 37 % 50) / 100e0",
    "pack_count": "d.doc_id * 7 % 11",
    "select_count": "d.doc_id * 5 % 7",
    "primary_anchor_id": f"cast(d.doc_id % {ANCHORS} as int)",
    "is_duplicate": "d.doc_id % 13 = 5",
    "is_archived": "d.doc_id % 17 = 3",
    "success_label": "case d.doc_id % 5 when 0 then true when 1 then false end",
    "created_s": f"{START} + d.doc_id * 3571 % 13132800",
    "archived_s": f"case when d.doc_id % 17 = 3 then {START} + d.doc_id * 7919 % 13132800 end",
    "embedding": "e.embedding",
}
_FROM = "documents d left join (select doc_id, max(quality) as quality from labels group by doc_id) l on l.doc_id = d.doc_id left join embeddings e on e.vec_id = d.doc_id"
MEM = "mem as (select " + ", ".join(f"{e} as {n}" for n, e in _MEMORY.items()) + f", [cast(d.doc_id * 5 % {ANCHORS} as int), cast(d.doc_id * 11 % {ANCHORS} as int)] as secondary_anchor_ids from {_FROM})"

#: Anchor cards: one for each benchmark item; the centroid is a given vector. ANCHORS of them hold memories.
_CARD = {
    "anchor_id": "cast(b.item_id as int)",
    "name": "substr(b.text, 1, 20)",
    "meaning": "b.text",
    "centroid": "e.embedding",
    "is_novelty": "b.item_id % 8 = 7",
    "status": "case when b.item_id % 11 = 10 then 'retired' else 'active' end",
}
_CARD_FROM = "benchmark b join embeddings e on e.vec_id = b.item_id"
CARDS = "cards as (select " + ", ".join(f"{e} as {n}" for n, e in _CARD.items()) + f" from {_CARD_FROM})"

#: Queries: what users say first; the vector is a given one.
_ASKED = {"query_id": "c.conv_id", "query": "c.text", "qvec": "e.embedding"}
_ASKED_FROM = "conversations c join embeddings e on e.vec_id = 300 + c.conv_id % 200 where c.turn = 0 and c.role = 'user'"
ASKED = "asked as (select " + ", ".join(f"{e} as {n}" for n, e in _ASKED.items()) + f" from {_ASKED_FROM})"

#: The vectors that can be a question's, 300 + conv_id % 200 (whatever its sign): they are few, so questions stay where they lie.
ASKED_VECTORS = "vec_id between 101 and 499"

#: Trace of queries: one record for each event.
K = "cast({json} as int)"
_TRACE = {
    "run_id": "concat('r', v.event_id)",
    "event_id": "v.event_id",
    "ts": "v.ts",
    "tenant_id": "concat('t', v.user_id % 7)",
    "query_origin": "case v.event_id % 5 when 0 then 'labeling' when 1 then 'benchmark' when 2 then null else 'interactive' end",
    "result_kind": "case v.event_id % 7 when 0 then 'empty_selection' when 1 then 'packer_fallback' else 'synthesized' end",
    "anchor_a": f"cast(k % {ANCHORS} as int)",
    "anchor_b": f"cast(k * 7 % {ANCHORS} as int)",
    "carried": "v.event_id % 3 = 0",
    "tokens_used": "cast(k * 13 as int)",
    "token_budget": "1000",
    "score": "v.value",
}
TRACE = "trace as (select " + ", ".join(f"{e} as {n}" for n, e in _TRACE.items()) + " from (select *, cast(json_extract(props, '$.k') as int) as k from events) v)"


class Tables:
    """The given tables and those derived from them, read once for each query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def memories(self) -> DataFrame:
        columns = ", ".join(f"{e} as {n}" for n, e in _MEMORY.items())
        secondary = f"array(cast(d.doc_id * 5 % {ANCHORS} as int), cast(d.doc_id * 11 % {ANCHORS} as int)) as secondary_anchor_ids"
        sql = f"select {columns}, {secondary} from {_FROM}"
        return self._sql(sql, "documents", "labels", "embeddings")

    def cards(self) -> DataFrame:
        return self._sql("select " + ", ".join(f"{e} as {n}" for n, e in _CARD.items()) + f" from {_CARD_FROM}", "benchmark", "embeddings")

    def asked(self) -> DataFrame:
        return self._sql("select " + ", ".join(f"{e} as {n}" for n, e in _ASKED.items()) + f" from {_ASKED_FROM}", "conversations", embeddings=F.broadcast(self("embeddings").where(ASKED_VECTORS)))

    def traces(self) -> DataFrame:
        return self._sql("select " + ", ".join(f"{e} as {n}" for n, e in _TRACE.items()) + " from (select *, cast(get_json_object(props, '$.k') as int) as k from events) v", "events")

    def _sql(self, sql: str, *names: str, **tables: DataFrame) -> DataFrame:
        """sql over the given tables that are named, and over others in their place."""
        import re

        tables |= {n: self(n) for n in names}
        for n in tables:
            sql = re.sub(rf"\b(from|join) {n}\b", rf"\1 {{{n}}}", sql)
        return self.spark.sql(sql, **tables)
