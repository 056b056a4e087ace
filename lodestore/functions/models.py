"""Where models plug in: functions over batches, with an outcome for each row.

What a model has answered is written, so that it isn't asked again when a task is. Rows that it failed on go through a second pass of
their own; what fails there too is kept as a dead letter, or counts as zero where a judge must give a number.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Answers to prompts, in their order: None for one that it has no answer to. It may raise, which fails the batch.
Model = Callable[[list[str]], list[str | None]]
#: Prompts that a model gets at once.
TOGETHER = 64


def with_model(df: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """model over Arrow batches of df: an extractor, judge, embedder or scorer. A batch that fails once is tried once more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                yield model(b)
            except ValueError:
                yield model(b)

    return df.mapInPandas(run, schema)


def answers(prompts: list[str], model: Model) -> list[tuple[str | None, str | None]]:
    """(answer, error) of each prompt. A batch that raises is asked one by one, so that it fails for the prompts alone that make it fail."""

    def ask(some: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            got = model(some)
            if len(got) != len(some):
                raise ValueError(f"{len(got)} answers to {len(some)} prompts")
            return [(a, None if a else "no answer") for a in got]
        except Exception as e:  # whatever a model raises is an outcome of its rows
            if len(some) > 1:
                return [x for p in some for x in ask([p])]
            return [(None, f"{type(e).__name__}: {e}"[:500])]

    return [x for k in range(0, len(prompts), TOGETHER) for x in ask(prompts[k : k + TOGETHER])]


def asked_once(rows: DataFrame, model: Model, why_not: Callable[[str], str | None], attempt: int) -> DataFrame:
    """rows (key long, prompt) with attempt, answer, error; why_not: what is wrong with an answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # only the prompts that the model gets at once are held as Python's strings
        for b in (x.slice(i, TOGETHER) for x in batches for i in range(0, len(x), TOGETHER)):
            got = answers(b.column(1).to_pylist(), model)
            error = [e or why_not(a) for a, e in got]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([attempt] * len(b), pa.int32()), pa.array([a for a, _ in got], pa.string()), pa.array(error, pa.string())],
                ["key", "prompt", "attempt", "answer", "error"],
            )

    return rows.select(F.col("key").cast("long").alias("key"), "prompt").mapInArrow(run, "key long, prompt string, attempt int, answer string, error string")


def asked(rows: DataFrame, model: Model, why_not: Callable[[str], str | None], repair: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, dead): the answers (key, attempt, answer) that nothing is wrong with, and the rows (key, prompt, answer, error) that failed twice.

    rows: key long, prompt. The second time a row's prompt ends with what it answered and `repair`. All passes are
    written under path, a folder of this run alone.
    """
    spark = rows.sparkSession
    asked_once(rows, model, why_not, 1).write.parquet(f"{path}/first")
    first = spark.read.parquet(f"{path}/first")
    again = first.where("error is not null").select("key", F.concat_ws("\n\n", "prompt", "answer", F.lit(repair)).alias("prompt"))
    asked_once(again, model, why_not, 2).write.parquet(f"{path}/second")
    second = spark.read.parquet(f"{path}/second")
    both = first.unionByName(second)
    second.where("error is not null").select("key", "prompt", "answer", "error").write.parquet(f"{path}/dead")
    return both.where("error is null").select("key", "attempt", "answer"), spark.read.parquet(f"{path}/dead")


#: Sections and fine chunks of a prompt, and their characters; what asks for an answer anew.
SECTIONS, SECTION_CHARS, FINES, FINE_CHARS = 10, 4000, 30, 300
REPAIR = "The previous response was not valid JSON. Return ONLY a JSON object with a 'memories' array. No prose, no markdown."
MEMORIES = "struct<memories: array<struct<type: string, title: string, body: string, retention_score: double, evidence_chunk_ids: array<string>>>>"


def extraction_prompts(chunks: DataFrame) -> DataFrame:
    """(key, prompt) of each document of chunks (doc_id, chunk, level, text): its first sections and fine chunks, cut to what a prompt may hold.

    Only these are gathered, however long a document is.
    """
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("doc_id", "level").orderBy("chunk"))
    few = chunks.where("level in ('section', 'fine')").withColumn("_k", place).where(F.col("_k") <= max(SECTIONS, FINES))
    few = few.where((F.col("level") == "fine") & (F.col("_k") <= FINES) | (F.col("level") == "section") & (F.col("_k") <= SECTIONS))
    line = F.concat(F.lit("["), F.col("doc_id"), F.lit("-"), F.col("chunk"), F.lit("] "), F.when(F.col("level") == "section", F.substring("text", 1, SECTION_CHARS)).otherwise(F.substring("text", 1, FINE_CHARS)))
    q = few.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "level", line.alias("line")))).alias("c"))
    part = lambda level, between: F.array_join(F.transform(F.filter("c", lambda x: x["level"] == level), lambda x: x["line"]), between)
    prompt = F.concat(F.lit("=== SECTION CHUNKS ===\n"), part("section", "\n---\n"), F.lit("\n\n=== FINE CHUNKS (for evidence references) ===\n"), part("fine", "\n"), F.lit("\n\nExtract memory objects from the above source."))
    return q.select(F.col("doc_id").cast("long").alias("key"), prompt.alias("prompt"))


def no_memories(answer: str) -> str | None:
    """What is wrong with an extractor's answer: no JSON, or no memory in it."""
    try:
        found = json.loads(answer)
    except ValueError:
        return "no JSON"
    if not isinstance(found, dict) or not isinstance(found.get("memories", []), list):
        return "no list of memories"
    return None if found.get("memories") else "no memories"


def extracted(chunks: DataFrame, model: Model, path: str) -> tuple[DataFrame, DataFrame]:
    """(memories, dead): doc_id, attempt, position and the fields of MEMORIES; and dead letters. Chunks are those of a hierarchy."""
    good, dead = asked(extraction_prompts(chunks), model, no_memories, REPAIR, path)
    m = good.select(F.col("key").alias("doc_id"), "attempt", F.posexplode(F.from_json("answer", MEMORIES)["memories"]).alias("position", "m"))
    return m.select("doc_id", "attempt", "position", "m.*"), dead


def numbers(answer: str | None, fields: tuple[str, ...], count: int) -> dict[int, tuple[float, ...]]:
    """What a judge's answer, {"sets": [{field: number}]}, says of each of `count` things; those that it leaves out or garbles aren't there."""
    out: dict[int, tuple[float, ...]] = {}
    try:
        found = json.loads(answer or "")["sets"]
    except (ValueError, KeyError, TypeError):
        return out
    for k, one in enumerate(found[:count] if isinstance(found, list) else []):
        try:
            out[k] = tuple(float(one[f]) for f in fields)
        except (KeyError, TypeError, ValueError):
            pass
    return out


def judged(items: DataFrame, model: Model, fields: tuple[str, ...], path: str) -> DataFrame:
    """items (key long, number int, payload) with fields and attempt: a prompt for each key with all its payloads, then one with those alone that got no numbers.

    What has none after the second has zeros, and attempt 0. A key's payloads are those of one question: a few.
    """
    spark = items.sparkSession
    schema = "key long, number int, " + ", ".join(f"{f} double" for f in fields) + ", attempt int"

    def one_pass(some: DataFrame, attempt: int) -> DataFrame:
        q = some.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("number", "payload"))).alias("own"))
        lines = F.array_join(F.transform("own", lambda x, i: F.concat(F.lit("set_"), i, F.lit(": "), x["payload"])), "\n")
        q = q.select("key", F.transform("own", lambda x: x["number"]).alias("numbers"), F.concat(F.lit("Score each of these sets.\n"), lines).alias("prompt"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for key, own, (answer, _) in zip(b["key"], b["numbers"], answers(b["prompt"].tolist(), model)):
                    rows += [(key, own[k], *values, attempt) for k, values in numbers(answer, fields, len(own)).items()]
                yield pd.DataFrame(rows, columns=["key", "number", *fields, "attempt"])

        q.mapInPandas(run, schema).write.parquet(f"{path}/attempt-{attempt}")
        return spark.read.schema(schema).parquet(f"{path}/attempt-{attempt}")

    first = one_pass(items, 1)
    second = one_pass(items.join(first.select("key", "number"), ["key", "number"], "left_anti"), 2)
    out = items.join(first.unionByName(second), ["key", "number"], "left")
    return out.select("key", "number", "payload", *[F.coalesce(f, F.lit(0.0)).alias(f) for f in fields], F.coalesce("attempt", F.lit(0)).alias("attempt"))
