"""Trace first, then ledger: batches count once, wherever a run dies."""

import random
import tempfile
from collections import defaultdict

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lodestore.operators import context
from lodestore.streaming import trace

SCHEMA = "event_id long, user_id long, delta double"


def deltas(batch):
    return batch.select(F.concat(F.lit("p"), "user_id").alias("pid"), "delta")


def events(n=40):
    return [(i, i % 3, float(i % 4 - 1)) for i in range(n)]


def wanted(rows):
    out = defaultdict(lambda: [0.0, 0])
    for _, user, delta in rows:
        out[f"p{user}"][0] += delta
        out[f"p{user}"][1] += 1
    return {k: tuple(v) for k, v in out.items()}


def found(sinks, spark):
    return {r.pid: (r.ledger, r.n) for r in sinks.ledger(spark).collect()}


@pytest.mark.parametrize("where", ["between", "ledger", "log"])
def test_a_run_that_dies_counts_each_batch_once(spark, where, monkeypatch):
    path = tempfile.mkdtemp()
    spark.createDataFrame(events(), SCHEMA).repartition(4, "event_id").write.parquet(f"{path}/in")
    stream = lambda: trace.read(spark, f"{path}/in", SCHEMA, files=1)
    at, died = trace.TraceThenLedger._at, []

    def dies(self, sink, batch_id):
        if sink == where and batch_id == 2 and not died and len(self.done(spark)) == 2:
            died.append(1)
            raise OSError("lost")
        return at(self, sink, batch_id)

    def between(batch_id):
        if where == "between" and batch_id == 2 and not died:
            died.append(1)
            raise OSError("lost")

    monkeypatch.setattr(trace.TraceThenLedger, "_at", dies)
    sinks = trace.TraceThenLedger(f"{path}/out", deltas, between=between)
    with pytest.raises(StreamingQueryException):
        trace.run_to_end(stream(), sinks, f"{path}/state")
    assert sinks.done(spark) == [0, 1] and sinks.trace(spark, SCHEMA).count() == sum(n for _, n in found(sinks, spark).values()) < 40
    trace.run_to_end(stream(), sinks, f"{path}/state")
    assert died and sinks.done(spark) == [0, 1, 2, 3]
    assert found(sinks, spark) == wanted(events())
    assert sorted(tuple(r) for r in sinks.trace(spark, SCHEMA).collect()) == events()


def test_a_batch_that_comes_again_is_not_counted(spark):
    path = tempfile.mkdtemp()
    sinks = trace.TraceThenLedger(path, deltas)
    a, b = (spark.createDataFrame(events()[k : k + 20], SCHEMA) for k in (0, 20))
    sinks(a, 0)
    sinks(b, 1)
    sinks(a, 0)
    sinks(b, 1)
    assert found(sinks, spark) == wanted(events())


def test_without_tracking_there_is_a_trace_alone(spark):
    path = tempfile.mkdtemp()
    sinks = trace.TraceThenLedger(path, deltas, tracking=False)
    sinks(spark.createDataFrame(events(), SCHEMA), 0)
    assert sinks.trace(spark, SCHEMA).count() == 40 and found(sinks, spark) == {}
    assert trace.TraceThenLedger(tempfile.mkdtemp(), deltas).ledger(spark).count() == 0


def packed_by_loops(hits, budget):
    heads = list(context.SECTIONS.values())
    out = []
    for q in {h[0] for h in hits}:
        own, seen = [], set()
        for h in sorted(h for h in hits if h[0] == q):
            text = (h[2] or "").strip()
            if text and text not in seen:
                seen.add(text)
                own.append(h)
        if not own:
            continue
        left = budget - own[0][5] // 4
        for k, head in enumerate(heads):
            items = [h for h in own if h[3] == k]
            cost = len(head + "\n" + "\n".join("- " + "x" * h[4] for h in items)) // 4 + 2
            if items and cost <= left:
                left -= cost
                out += [(q, h[1], k) for h in items]
        left -= 20
        for h in own:
            if h[3] is None:
                cost = len("- " + "x" * h[4] + "\n") // 4
                if cost > left:
                    break
                left -= cost
                out.append((q, h[1], -1))
    return sorted(out)


@pytest.mark.parametrize("budget", [40, 100, 200, 400, 2000])
def test_packed_hits_by_loops(spark, budget):
    rnd = random.Random(budget)
    hits = [(q, n, rnd.choice(["a", "b", " a ", "", None, f"t{n}", f"u{n}"]), rnd.choice([None, None, 0, 1, 2, 3, 4, 5]), rnd.choice([3, 40, 120, 400]), 90) for q in range(12) for n in range(rnd.randint(1, 25))]
    df = spark.createDataFrame(hits, "query_id long, n long, text string, section int, chars int, header_chars int").repartition(3)
    assert sorted(tuple(r) for r in context.packed_hits(df, budget).collect()) == packed_by_loops(hits, budget)
