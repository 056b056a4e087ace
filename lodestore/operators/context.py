"""From selected anchors to a packed context: fetch, features, constraint scores, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestore.functions import cut, first_of, tokens_of

#: Sections in packing order and their headers; memory types in feature order.
SECTIONS = {
    "FAILURE": "FAILURE WARNINGS", "PROCEDURAL": "PROCEDURAL GUIDANCE", "TOOL_USE": "TOOL-USE NOTES",
    "EPISODIC": "RELEVANT PRIOR EPISODES", "SEMANTIC": "FACTS & CONCEPTS", "WORKING_DERIVATIVE": "WORKING NOTES",
}
FEATURE_TYPES = ("EPISODIC", "SEMANTIC", "PROCEDURAL", "FAILURE", "TOOL_USE", "WORKING_DERIVATIVE")
#: Weights of the constraint features and of their blend with the score.
WEIGHTS = {"entity": 0.17, "role": 0.12, "actor": 0.12, "time": 0.17, "stance": 0.10, "type": 0.12, "phrase": 0.10, "contradiction": 0.10}
SCORE_SHARE, CONSTRAINT_SHARE = 0.70, 0.30
ALIGNED = {"temporal_change": ("switched", "stopped"), "failure": ("failed",), "procedure": ("fixed", "prefers"), "preference": ("prefers",)}
EXPECTED = {"failure": "FAILURE", "procedure": "PROCEDURAL", "fact": "SEMANTIC", "preference": "SEMANTIC"}


def fetched(selected: DataFrame, memories: DataFrame, most: int = 50, most_secondary: int = 25) -> DataFrame:
    """(query_id, seq, anchor_id, phase): memories of the selected anchors (query_id, doc, rank), primary before secondary; a memory comes once, from the first selected anchor.

    Each anchor's best are cut by rank before the join, so a large anchor never meets every query whole.
    """
    best = lambda key: Window.partitionBy(key).orderBy(F.desc("quality_score"), F.desc("created_s"), "seq")
    one = memories.withColumn("anchor_id", F.col("primary_anchor_id")).withColumn("k", F.row_number().over(best("anchor_id"))).where(F.col("k") <= most).select("anchor_id", "seq", F.lit(0).alias("phase"))
    two = memories.withColumn("anchor_id", F.explode(F.array_distinct("secondary_anchor_ids"))).withColumn("k", F.row_number().over(best("anchor_id"))).where(F.col("k") <= most_secondary).select("anchor_id", "seq", F.lit(1).alias("phase"))
    hits = selected.join(one.unionByName(two), selected["doc"] == F.col("anchor_id"))
    w = Window.partitionBy("query_id", "seq").orderBy("phase", "rank", "anchor_id")
    return hits.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("query_id", "seq", "anchor_id", "phase")


def recency(created_s: Column, now_s: int) -> Column:
    days = F.greatest((F.lit(now_s) - created_s) / 86400.0, F.lit(0.0))
    return 1 / (1 + F.log1p(days))


def features(score: Column, memory_type: Column, quality: Column, body: Column, created_s: Column, cosine: Column, now_s: int, budget: int) -> Column:
    """11 numbers: score, type one-hot, quality, body length against the budget, recency, cosine."""
    return F.array(score, *[(memory_type == t).cast("double") for t in FEATURE_TYPES], quality, F.least(F.lit(1.0), F.length(body) / 4.0 / budget), recency(created_s, now_s), cosine)


def mlp(x: Column, hidden: list[list[float]], bias: list[float], out: list[float], out_bias: float) -> Column:
    """A two-layer perceptron with ReLU and sigmoid; the weights are literals."""
    relu = [F.greatest(F.lit(0.0), F.aggregate(F.zip_with(x, F.array(*[F.lit(w) for w in row]), lambda a, b: a * b), F.lit(b), lambda s, v: s + v)) for row, b in zip(hidden, bias)]
    total = F.lit(out_bias)
    for h, w in zip(relu, out):
        total = total + h * w
    return 1 / (1 + F.exp(-total))


def constraint_features(f: dict[str, Column], m: dict[str, Column]) -> dict[str, Column]:
    """The eight constraint features of a frame (target, entities, role, person, time, quoted) and a memory (entities, role, actors, mentioned_at, stance, type, body); unknown is 0.5."""
    low = lambda a: F.array_distinct(F.transform(a, F.lower))
    a, b = low(f["entities"]), low(m["entities"])
    known = (F.size(a) > 0) & (F.size(b) > 0)
    aligned = first_of(*[((f["target"] == t), "|".join(s)) for t, s in ALIGNED.items()])
    expected = first_of(*[((f["target"] == t), e) for t, e in EXPECTED.items()])
    half = F.lit(0.5)
    return {
        "entity": F.when(known, F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))).otherwise(half),
        "role": F.when(f["role"].isNull() | m["role"].isNull(), half).when(f["role"] == m["role"], 1.0).otherwise(0.0),
        "actor": F.when(f["person"].isNull() | (F.size(m["actors"]) == 0), half).when(F.array_contains(low(m["actors"]), F.lower(f["person"])), 1.0).otherwise(0.0),
        "time": F.when(f["time"].isNull() | m["mentioned_at"].isNull(), half).when(F.contains(F.lower(m["mentioned_at"]), F.lower(f["time"])), 1.0).otherwise(0.3),
        "stance": F.when(m["stance"].isNull() | aligned.isNull(), half).when(F.array_contains(F.split(aligned, r"\|"), F.lower(m["stance"])), 1.0).otherwise(0.0),
        "type": F.when(expected.isNull(), half).when(m["type"] == expected, 1.0).otherwise(0.3),
        "phrase": F.when(F.size(f["quoted"]) == 0, half).when(F.exists(f["quoted"], lambda q: F.contains(F.lower(m["body"]), F.lower(q))), 1.0).otherwise(0.0),
        "contradiction": F.when(f["target"].isin("fact", "preference") & m["stance"].isin("deprecated", "stopped"), 0.2).when((f["target"] == "failure") & (m["stance"] == "fixed"), 0.3).otherwise(half),
    }


def blended(score: Column, features_: dict[str, Column]) -> Column:
    boost = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        boost = boost + features_[name] * weight
    return score * SCORE_SHARE + boost * CONSTRAINT_SHARE


def item_text(title: Column, body: Column, kind: Column, success: Column, relevance: Column, top: Column, source: Column) -> Column:
    """A memory as a line: title, body (800 characters for the top, else 300), outcome of an episode, relevance; then its source."""
    shown = F.when(top, cut(body, 800)).otherwise(cut(body, 300))
    parts = F.concat_ws(
        " — ",
        title,
        F.when((body != "") & (body != title), shown),
        F.when((kind == "EPISODIC") & success.isNotNull(), F.when(success, "outcome: success").otherwise("outcome: failure")),
        F.when(relevance > 0, F.concat(F.lit("(relevance: "), F.format_string("%.2f", relevance), F.lit(")"))),
    )
    return F.when(source.isNotNull(), F.concat(parts, F.lit("\n  Source: "), source)).otherwise(parts)


def evidence_text(text: Column, spans: Column, hints: Column, most: int = 500) -> Column:
    """The spans' texts joined, cut at `most`; without spans a window around the first hint word of four letters that the text has."""
    parts = F.filter(F.transform(spans, lambda s: F.trim(F.substring(text, s["start"] + 1, s["end"] - s["start"]))), lambda p: p != "")
    words = F.filter(F.regexp_extract_all(F.lower(hints), F.lit(r"[a-z0-9_]{4,}"), F.lit(0)), lambda w: F.contains(F.lower(text), w))
    at = F.instr(F.lower(text), F.get(words, F.lit(0))) - 1
    window = F.trim(F.substring(text, F.greatest(at - most // 2, F.lit(0)) + 1, at + most // 2 - F.greatest(at - most // 2, F.lit(0))))
    return F.when(F.size(parts) > 0, F.substring(F.array_join(parts, " ... "), 1, most)).when(F.size(words) > 0, window)


def section_order(kind: Column) -> Column:
    out = F.lit(list(SECTIONS).index("SEMANTIC"))
    for i, t in enumerate(SECTIONS):
        out = F.when(kind == t, i).otherwise(out)
    return out


def within_budget(items: DataFrame, key: str, budget: int) -> DataFrame:
    """items (key, n, item) in order as long as their tokens fit: the first that doesn't fit ends the list."""
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum(tokens_of(F.length("item") + 3)).over(w)).where(F.col("used") <= budget)


def rendered_chars(head: int | Column, chars: Column) -> Column:
    """Characters of a section: its header, then each item (array of lengths) as a line with a mark before it."""
    return F.lit(head) + 1 + F.aggregate(chars, F.lit(0), lambda a, c: a + c + 2) + F.greatest(F.size(chars) - 1, F.lit(0))


#: Tokens that are kept free before raw hits are trimmed.
RAW_SPARE = 20


def packed_hits(hits: DataFrame, budget: int) -> DataFrame:
    """(query_id, n, section) of the hits that a budget takes.

    hits: query_id, n (order), text, section (number, null for a hit that is no memory), chars of its line, header_chars of the whole context. Hits with blank texts go, and of
    equal texts but the first. Sections are taken or left as a whole, one after the other, with what those before have left; raw hits
    come last (section -1), as many of the first as fit. A query has as many hits as its search gives, so they meet as one list.
    """
    text = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    first = Window.partitionBy("query_id", F.md5(text)).orderBy("n")
    d = hits.where(text != "").withColumn("_k", F.row_number().over(first)).where("_k = 1")
    one = F.struct("n", "section", F.col("chars").cast("int").alias("chars"))
    q = d.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("hits"), F.max("header_chars").alias("h"))
    q = q.withColumn("left", F.lit(budget).cast("long") - tokens_of(F.col("h"))).withColumn("taken", F.array().cast("array<int>"))
    for number, header in enumerate(SECTIONS.values()):
        own = F.transform(F.filter("hits", lambda x: x["section"] == number), lambda x: x["chars"])
        cost = tokens_of(rendered_chars(len(header), own)) + 2
        fits = (F.size(own) > 0) & (cost <= F.col("left"))
        q = q.withColumns({"left": F.when(fits, F.col("left") - cost).otherwise(F.col("left")), "taken": F.when(fits, F.array_append("taken", F.lit(number))).otherwise(F.col("taken"))})
    raw = F.filter("hits", lambda x: x["section"].isNull())
    free = F.struct((F.col("left") - RAW_SPARE).alias("room"), F.lit(0).alias("k"))
    # the room of a list that has ended is under 0, so nothing more fits
    step = lambda a, x: F.when(tokens_of(x["chars"] + 3) <= a["room"], F.struct((a["room"] - tokens_of(x["chars"] + 3)).alias("room"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.lit(-1).cast("long").alias("room"), a["k"].alias("k")))
    few = F.slice(raw, 1, F.aggregate(raw, free, step, lambda a: a["k"]))
    kept = F.concat(F.filter("hits", lambda x: F.array_contains(F.col("taken"), x["section"])), few)
    out = q.select("query_id", F.explode(kept).alias("x"))
    return out.select("query_id", "x.n", F.coalesce("x.section", F.lit(-1)).alias("section"))


def packed(items: DataFrame, budget: int) -> DataFrame:
    """(query_id, section, n_items, tokens) of the sections that a budget takes.

    items: query_id, section (order), n, chars, header_chars (of the whole context). A section goes in whole if it fits, else its header and the prefix of items
    that fits. Sections take what they use, one after the other: a fold over a query's few sections.
    """
    costs = F.transform(F.array_sort(F.collect_list(F.struct("n", "chars"))), lambda x: x["chars"])
    s = items.groupBy("query_id", "section").agg(costs.alias("chars"), F.max("header_chars").alias("header_chars"))
    heads = F.array(*[F.lit(len(h)) for h in SECTIONS.values()])
    s = s.withColumn("head", F.get(heads, F.col("section")))
    q = s.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("section", "head", "chars"))).alias("s"), F.max("header_chars").alias("h"))
    state = F.struct((F.lit(budget).cast("long") - tokens_of(F.col("h"))).alias("left"), F.array().cast("array<struct<section:int,n_items:int,tokens:bigint>>").alias("out"))

    def rendered(head: Column, chars: Column) -> Column:
        return head + 1 + F.aggregate(chars, F.lit(0), lambda a, c: a + c + 2) + F.greatest(F.size(chars) - 1, F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        whole = tokens_of(rendered(x["head"], x["chars"])) + 2
        room = acc["left"] - tokens_of(x["head"]) - 2
        take = F.aggregate(
            x["chars"], F.struct(room.alias("room"), F.lit(0).alias("k"), F.lit(False).alias("full")),
            lambda a, c: F.struct(F.when(a["full"] | (tokens_of(c + 3) > a["room"]), a["room"]).otherwise(a["room"] - tokens_of(c + 3)).alias("room"), F.when(a["full"] | (tokens_of(c + 3) > a["room"]), a["k"]).otherwise(a["k"] + 1).alias("k"), (a["full"] | (tokens_of(c + 3) > a["room"])).alias("full")),
            lambda a: a["k"],
        )
        k = F.when(whole <= acc["left"], F.size(x["chars"])).when(room > 0, take).otherwise(0)
        cost = F.when(k > 0, tokens_of(rendered(x["head"], F.slice(x["chars"], 1, k))) + 2).otherwise(F.lit(0).cast("long"))
        row = F.array(F.struct(x["section"].alias("section"), k.alias("n_items"), cost.alias("tokens")))
        return F.struct((acc["left"] - cost).alias("left"), F.when(k > 0, F.concat(acc["out"], row)).otherwise(acc["out"]).alias("out"))

    return q.select("query_id", F.inline(F.aggregate("s", state, step, lambda a: a["out"])))
