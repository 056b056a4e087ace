"""What a user calls: ingest, build, search, forget, curate, report. Each function takes and returns DataFrames."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestore.functions import cosine, models
from lodestore.operators import atlas, context, diagnostics, ingest, ledger, retrieval, text


def ingest_conversations(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(file, chunk_index, content, room) of new chat files (file, content): transcripts by exchange, others by paragraph. known (file): already ingested."""
    new = files if known is None else files.join(known.select("file"), "file", "left_anti")
    kind = ingest.file_format(F.col("content"), F.col("file").cast("string"))
    marked = new.withColumn("kind", kind)
    chunks = ingest.exchange_chunks(marked.where("kind = 'transcript'")).unionByName(ingest.paragraph_chunks(marked.where("kind <> 'transcript'")))
    return chunks.withColumn("room", ingest.topic_of(F.col("content")))


def consolidate(chunks: DataFrame, extractor: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What an extractor makes of chunks, with facets, if it passes retention. schema has type, title, body, retention_score."""
    raw = models.with_model(chunks, extractor, schema)
    kept = raw.where(text.retained(F.col("type"), F.col("retention_score"), F.col("title"), F.col("body")))
    said = F.concat_ws("\n", "title", "body")
    return kept.withColumns({"entities": text.facet_entities(said), "mentioned_at": text.mentioned_at(said), "speaker_role": text.speaker_role(said), "stance": text.stance(said), "actor_entities": text.actors(said)})


def build_atlas(vectors: DataFrame, seed: int = 0, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """(cards, assignments) of unit vectors (id, vec): a fifth as many clusters as vectors, 8 to 224; each vector's two nearest."""
    centroids = atlas.spherical_kmeans(vectors, atlas.clusters(vectors.count()), seed, rounds)
    near = atlas.nearest(vectors, centroids, 2)
    pick = lambda k: F.max(F.when(F.col("rank") == k, F.col("anchor_id")))
    assigned = near.groupBy("id").agg(pick(1).alias("primary"), pick(2).alias("secondary"), F.max("similarity").alias("confidence"))
    cards = centroids.join(assigned.groupBy(F.col("primary").alias("anchor_id")).agg(F.count("*").alias("memory_count")), "anchor_id", "left").fillna(0, ["memory_count"])
    return cards, assigned


def search(queries: DataFrame, cards: DataFrame, memories: DataFrame, budget: int = 900, anchors: int = 3) -> DataFrame:
    """(query_id, section, n_items, tokens, text): the packed context of each query, section by section.

    queries: query_id, query, qvec; cards: doc, tokens, centroid; memories as in the store. BM25 and dense ranks of
    the cards are fused, the memories of the best anchors fetched, ranked by cosine and quality, and packed.
    """
    q = queries.withColumn("tokens", retrieval.tokens(F.col("query")))
    fused = retrieval.fused(retrieval.bm25_scores(q, cards, 10), retrieval.dense_scores(q, cards, 10), anchors)
    hits = context.fetched(fused, memories, 10, 5).select("query_id", "seq").join(memories, "seq").join(q.select("query_id", "qvec"), "query_id")
    hits = hits.withColumn("cosine", F.coalesce(F.round(cosine("embedding", "qvec"), 6), F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.round(F.col("cosine") * 0.7 + F.col("quality_score") * 0.3, 6).desc(), "seq")
    hits = hits.withColumn("n", F.row_number().over(order))
    source = F.element_at(F.split("source_path", "/"), -1)
    item = context.item_text(F.col("title"), F.col("body"), F.col("memory_type"), F.col("success_label"), F.col("cosine"), F.col("n") <= 10, source)
    items = hits.select("query_id", context.section_order(F.col("memory_type")).alias("section"), "n", item.alias("item"))
    head = q.select("query_id", (F.length("query") + 70).alias("header_chars"))
    sized = items.select("query_id", "section", "n", F.length("item").alias("chars")).join(head, "query_id")
    taken = context.packed(sized, budget)
    lines = items.groupBy("query_id", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda x: F.concat(F.lit("- "), x["item"])).alias("lines"))
    heads = F.array(*[F.lit(h) for h in context.SECTIONS.values()])
    said = F.concat(F.get(heads, F.col("section")), F.lit("\n"), F.array_join(F.slice("lines", 1, F.col("n_items")), "\n"))
    return taken.join(lines, ["query_id", "section"]).select("query_id", F.col("section").cast("long").alias("section"), F.col("n_items").cast("long").alias("n_items"), "tokens", said.alias("text"))


def forget(memories: DataFrame, now_s: int, per_anchor: int = atlas.ANCHOR_BUDGET, per_tenant: int | None = None) -> DataFrame:
    """(seq) to archive: over the anchors' budget, and over the tenants' cap if there is one."""
    out = atlas.pruned(memories, now_s, per_anchor).select("seq")
    return out if per_tenant is None else out.union(atlas.over_cap(memories, now_s, per_tenant).select("seq")).distinct()


def curate(pool: DataFrame, patterns: DataFrame) -> DataFrame:
    """patterns (anchor_id, pattern) with the new ones that the pool of queries gives."""
    return patterns.select("anchor_id", "pattern").unionByName(ledger.new_patterns(pool, patterns).select("anchor_id", "pattern"))


def report(traces: DataFrame) -> dict[str, DataFrame]:
    """Activation and misses of traces (selected, packed, top, result_kind)."""
    return {"activation": diagnostics.activation(traces), "misses": diagnostics.misses(traces)}
