"""Queries of trained models: co-activation, the selector's three phases, the memory scorer, sweeps (SEL-04, TRN-10, TRN-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.functions import dot, set_f1, words
from lodestore.operators import coactivation as co
from lodestore.operators import learning as le
from lodestore.operators import retrieval as r
from lodestore.operators import training as tr
from lodestore.plans.base import Tables, query
from lodestore.plans.retrieval import active_cards, anchor_features, framed, queries
from lodestore.plans.training import gold, memory_examples, mix
from lodestore.sources.files import shared_path

SCORER = le.Mlp(11, 32)
PAIR = le.Mlp(5, 16)


def history(t: Tables, s: le.State) -> DataFrame:
    return t.spark.createDataFrame(s.history, "epoch long, phase string, examples long, loss double, held_loss double").select(
        "epoch", "phase", "examples", F.round("loss", 6).alias("loss"), F.round("held_loss", 6).alias("held_loss")
    )


def atlas_cards(t: Tables) -> co.Cards:
    kinds = [c for c in anchor_features(t).columns if c != "anchor_id"]
    f = anchor_features(t).select(F.col("anchor_id").alias("doc"), F.array(*[F.col(k).cast("double") for k in kinds]).alias("features"))
    return co.cards_of(active_cards(t).select("doc", "centroid").join(f, "doc", "left"))


def coactivation_rows(t: Tables) -> DataFrame:
    """Each query's scores in the order of cards, its vector, frame and gold anchors."""
    cards = t.asked().select("query_id", F.explode(gold()).alias("doc"))
    x = tr.in_card_order(r.dense_scores(queries(t), active_cards(t)), cards)
    frame = framed(t).select("query_id", r.frame_features(F.col("answer_target"), F.col("mode")).cast("array<double>").alias("frame"))
    return x.join(t.asked().select("query_id", "qvec"), "query_id").join(frame, "query_id")


def trained_coactivation(t: Tables, path: str) -> tuple[co.CoActivation, le.State, DataFrame]:
    rows = coactivation_rows(t).withColumns({"example": F.col("query_id"), "kind": F.lit("query"), "held": le.held_out(F.col("query_id"))})
    rows.write.parquet(f"{path}/rows")
    rows = t.spark.read.parquet(f"{path}/rows")
    net = co.CoActivation(atlas_cards(t))
    return net, le.fitted(rows, net, [le.Phase("all", {"query": 1.0}, 3, 3e-3)], f"{path}/states", steps=2, rows=256), rows


@query("sel_04")
def coactivation(t: Tables) -> DataFrame:
    """The cards of every query that reach its threshold, refined by the encoder; its weights are read from the table that training wrote."""
    path = shared_path(t.spark, "coactivation")
    net, state, rows = trained_coactivation(t, path)
    le.weight_table(t.spark, state, net).write.parquet(f"{path}/weights")
    weights = le.read_weights(t.spark.read.parquet(f"{path}/weights"), net)
    return co.chosen(co.refined(rows, net, weights))


@query("trn_10")
def trained_encoder(t: Tables) -> DataFrame:
    """Epochs of the co-activation encoder: cross-entropy of cards and .3 of the threshold's squared error."""
    return history(t, trained_coactivation(t, shared_path(t.spark, "coactivation"))[1])


def pair_examples(t: Tables) -> DataFrame:
    """The drawn pairs of query and card as numbers: cosine, words in common, the part of each one's words in the other, length."""
    key = F.split("key", "-")
    m = mix(t).select("kind", "draw", key[0].cast("long").alias("query_id"), key[1].cast("int").alias("anchor_id"), "form")
    m = m.join(t.asked(), "query_id").join(t.cards().select("anchor_id", "meaning", "centroid"), "anchor_id")
    m = m.withColumn("query", F.when(F.col("form").isNotNull(), tr.adversarial(F.col("query"), F.col("form"))).otherwise(F.col("query")))
    m = m.withColumns({"a": words("query"), "b": words("meaning")})
    both = F.size(F.array_intersect("a", "b"))
    part = lambda c: F.coalesce(F.try_divide(both, F.size(c)), F.lit(0.0))
    x = F.array(dot("qvec", "centroid"), set_f1(F.col("a"), F.col("b")), part("a"), part("b"), F.log1p(F.length("query")) / 10)
    example = F.xxhash64("kind", "draw")
    return m.select(example.alias("example"), "kind", le.held_out(F.col("query_id")).alias("held"), x.alias("x"), F.col("kind").isin("positive", "adversarial").cast("int").alias("label"))


def selector_phases(counts: dict[str, int], epochs: int = 3) -> list[le.Phase]:
    """Warm start on positives and easy negatives; hard negatives with as many positives; adversarial ones with as many hard negatives. Phases without examples are left out."""
    share = lambda of, kind: min(1.0, counts.get(of, 0) / max(1, counts.get(kind, 0)))
    plan = (("positive", le.Phase("warm start", {"positive": 1.0, "easy": 1.0}, epochs, 1e-2)), ("hard", le.Phase("hard negatives", {"hard": 1.0, "positive": share("hard", "positive")}, epochs, 5e-3)), ("adversarial", le.Phase("adversarial", {"adversarial": 1.0, "hard": share("adversarial", "hard")}, epochs, 5e-3)))
    return [phase for kind, phase in plan if counts.get(kind)]


@query("trn_10_selector")
def trained_selector(t: Tables) -> DataFrame:
    """Epochs of the selector's three phases over drawn pairs."""
    path = shared_path(t.spark, "selector")
    pair_examples(t).write.parquet(f"{path}/rows")
    rows = t.spark.read.parquet(f"{path}/rows")
    counts = {x["kind"]: x["n"] for x in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # four kinds
    return history(t, le.fitted(rows, PAIR, selector_phases(counts), f"{path}/states", steps=2))


def memory_rows(t: Tables, path: str) -> DataFrame:
    x = memory_examples(t).select(F.xxhash64("query_id", "seq").alias("example"), F.lit("pair").alias("kind"), le.held_out(F.col("query_id")).alias("held"), "x", "label")
    x.write.parquet(f"{path}/rows")
    return t.spark.read.parquet(f"{path}/rows")


@query("trn_10_memory")
def trained_scorer(t: Tables) -> DataFrame:
    """Epochs of the memory scorer; the run is broken off after two of four and goes on from its last state."""
    path = shared_path(t.spark, "memory-scorer")
    rows, phases = memory_rows(t, path), [le.Phase("all", {"pair": 1.0}, 4, 1e-2)]
    le.fitted(rows, SCORER, phases, f"{path}/states", steps=2, until=2)
    return history(t, le.fitted(rows, SCORER, phases, f"{path}/states", steps=2))


@query("trn_12")
def parameter_sweep(t: Tables) -> DataFrame:
    """Two sweeps of the memory scorer into one table: the second has one candidate more, and only that one is fitted (round 3)."""
    path = shared_path(t.spark, "sweep")
    rows = memory_rows(t, path)

    def fit(c: dict) -> tuple[float, float]:
        s = le.fitted(rows, le.Mlp(11, c["hidden"]), [le.Phase("all", {"pair": 1.0}, 2, c["rate"])], f"{path}/{c['hidden']}-{c['rate']}", steps=1)
        return -min(h[4] for h in s.history), float(c["hidden"])  # the cost of a scorer is its width

    candidates = [{"hidden": 8, "rate": 0.01}, {"hidden": 8, "rate": 0.001}, {"hidden": 32, "rate": 0.01}]
    tr.swept(t.spark, candidates[:2], fit, f"{path}/table")
    found = tr.swept(t.spark, candidates, fit, f"{path}/table")
    best = tr.sweep_winner(found).select(F.col("candidate").alias("_best"))
    return found.join(F.broadcast(best), F.col("candidate") == F.col("_best"), "left").select("candidate", F.round("metric", 6).alias("metric"), "seconds", "round", F.col("_best").isNotNull().alias("best"))
