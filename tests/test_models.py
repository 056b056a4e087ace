"""Models that fail: outcomes by row, second passes, dead letters, zeros."""

import json
import tempfile

import pyarrow as pa

from lodestore.functions import models
from lodestore.operators import text


def test_outcomes_of_rows():
    def model(prompts):
        if "bad" in prompts:
            raise OSError("lost")
        return [None if p == "none" else p.upper() for p in prompts]

    got = models.answers(["a", "bad", "none", "b"] + ["c"] * 100, model)
    assert got[:4] == [("A", None), (None, "OSError: lost"), (None, "no answer"), ("B", None)] and got[4:] == [("C", None)] * 100
    assert models.answers(["a", "b"], lambda p: ["x"]) == [("x", None), ("x", None)]  # too few answers to two, one to each alone
    assert models.answers([], model) == []


def test_failed_rows_alone_are_asked_again(spark):
    def model(prompts):
        out = []
        for p in prompts:
            n = int(p.split()[0])
            again = "AGAIN" in p
            out.append("wrong" if n % 3 == 1 and not again or n % 5 == 4 else f"good {n} {again}")
        return out

    rows = spark.createDataFrame([(i, f"{i} question") for i in range(30)], "key long, prompt string").repartition(4)
    path = tempfile.mkdtemp()
    good, dead = models.asked(rows, model, lambda a: None if a.startswith("good") else "not good", "AGAIN", path)
    got = {r.key: (r.attempt, r.answer) for r in good.collect()}
    assert got == {i: (2, f"good {i} True") if i % 3 == 1 else (1, f"good {i} False") for i in range(30) if i % 5 != 4}
    assert {r.key: r.error for r in dead.collect()} == {i: "not good" for i in range(30) if i % 5 == 4}
    assert all("wrong" in r.prompt and r.prompt.endswith("AGAIN") for r in dead.collect())
    assert spark.read.parquet(f"{path}/second").count() == len({i for i in range(30) if i % 3 == 1 or i % 5 == 4})


def test_extraction(spark):
    docs = spark.createDataFrame([(i, f"Part one of {i}.\n\nPart two.") for i in range(12)] + [(20, ""), (21, None)], "doc_id long, text string")

    def model(prompts):
        out = []
        for p in prompts:
            key, again = int(p.split("[")[1].split("-")[0]), models.REPAIR in p
            memories = [{"type": "failure", "title": f"t{key}", "body": "b", "retention_score": 0.9, "evidence_chunk_ids": [f"{key}-1"]}] * (key % 3)
            out.append("{" if key == 7 or key == 8 and not again else json.dumps({"memories": memories}))
        return out

    found, dead = models.extracted(text.hierarchy(docs), model, tempfile.mkdtemp())
    got = sorted((r.doc_id, r.attempt, r.position, r.title, r.evidence_chunk_ids[0]) for r in found.collect())
    assert got == [(i, 2 if i == 8 else 1, k, f"t{i}", f"{i}-1") for i in range(12) if i != 7 for k in range(i % 3)]
    assert {r.key: r.error for r in dead.collect()} == {7: "no JSON"} | {i: "no memories" for i in (0, 3, 6, 9)}
    assert models.no_memories("[1]") and models.no_memories('{"memories": 3}') and models.no_memories("{}") == "no memories"


def test_prompts_hold_the_first_chunks_and_are_cut(spark):
    rows = [(1, k, "section" if k % 2 else "fine", str(k % 10) * 5000) for k in range(100)] + [(1, 100, "mid", "m"), (2, 0, "section", "s")]
    got = {r.key: r.prompt for r in models.extraction_prompts(spark.createDataFrame(rows, "doc_id long, chunk long, level string, text string").repartition(3)).collect()}
    sections, fines = got[1].split("\n\n=== FINE CHUNKS (for evidence references) ===\n")
    sections, fines = sections.split("\n", 1)[1].split("\n---\n"), fines.split("\n\nExtract")[0].split("\n")
    assert sections == [f"[1-{k}] " + str(k % 10) * 4000 for k in range(1, 20, 2)]
    assert fines == [f"[1-{k}] " + str(k % 10) * 300 for k in range(0, 60, 2)]
    assert "[2-0] s" in got[2]


def test_a_judge_that_leaves_some_out(spark):
    def model(prompts):
        out = []
        for p in prompts:
            sets = [line.split(": ")[1] for line in p.split("\n")[1:]]
            if "boom" in sets and len(sets) > 1:
                raise OSError("lost")
            one = [{"a": len(s), "b": "0.5"} if s != "never" else {"a": 1} for s in sets]
            out.append(json.dumps({"sets": one[:2]}) if "boom" not in sets else "no JSON")
        return out

    items = [(1, k, s) for k, s in enumerate(["x", "yy", "zzz", "wwww", "never"])] + [(2, 5, "boom"), (2, 3, "x"), (3, 0, "never")]
    df = spark.createDataFrame(items, "key long, number int, payload string").repartition(3)
    got = {(r.key, r.number): (r.a, r.b, r.attempt) for r in models.judged(df, model, ("a", "b"), tempfile.mkdtemp()).collect()}
    assert got == {(1, 0): (1, 0.5, 1), (1, 1): (2, 0.5, 1), (1, 2): (3, 0.5, 2), (1, 3): (4, 0.5, 2), (1, 4): (0, 0, 0), (2, 3): (0, 0, 0), (2, 5): (0, 0, 0), (3, 0): (0, 0, 0)}
    assert models.numbers(None, ("a",), 3) == {} and models.numbers('{"sets": 3}', ("a",), 3) == {} and models.numbers('{"sets": [{"a": null}, {"a": "2"}]}', ("a",), 1) == {}


def test_chunks_and_answers_are_made_a_few_texts_at_a_time(spark):
    """What a task holds in Python is bounded by a few texts, whatever the batches that Spark gives it."""

    class Run:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    n = 300
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([f"Part {i}.\n\nMore of it." for i in range(n)])], ["doc_id", "text"])
    made = list(text.hierarchy(Run())(iter([batch])))
    assert sum(map(len, made)) == n * 6 and max(map(len, made)) <= text.TEXTS * 6
    seen = []
    asked = models.asked_once(Run(), lambda prompts: seen.append(len(prompts)) or [p[:6] for p in prompts], lambda a: None, 1)
    got = [next(answers := asked(iter([batch])))]
    assert seen == [models.TOGETHER]  # the rest is asked when it is wanted
    got += answers
    assert [r["key"] for b in got for r in b.to_pylist()] == list(range(n)) and max(map(len, got)) == models.TOGETHER
