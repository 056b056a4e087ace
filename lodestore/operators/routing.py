"""Rooms: sessions and questions are put into rooms by a model, questions search the sessions of their rooms, and a model picks the best of the first hits."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestore.functions.models import Model, asked_once
from lodestore.operators.evaluation import FETCH, nearest

#: Characters of a session and of a hit that a model sees; hits that it picks from; rooms of a question; where else a session goes.
SESSION_CHARS, HIT_CHARS, PICKED, ROUTES, ELSEWHERE = 600, 300, 10, 2, "general"


def room_of(answer: str | None, rooms: tuple[str, ...]) -> str:
    """The first room that the answer names or is a part of, else the first that its first word is a part of; without either, or an answer, ELSEWHERE."""
    low = (answer or "").lower().strip()
    if not low:
        return ELSEWHERE
    first = (low.split("_")[0].split() or [""])[0]
    return next((r for r in rooms if r in low or low in r), None) or next((r for r in rooms if first and first in r), ELSEWHERE)


def rooms_of(answer: str | None, rooms: tuple[str, ...]) -> list[str]:
    """The first ROUTES rooms that the answer names, else those that a word of it is a part of, else all."""
    low = (answer or "").lower()
    found = [r for r in rooms if r in low][:ROUTES]
    if not found:
        parts = [p.strip("_").strip() for p in re.split(r"[,\s]+", low)]
        found = list(dict.fromkeys(r for p in parts if p for r in rooms if p in r))[:ROUTES]
    return found or list(rooms)


def picked(answer: str | None, n: int) -> int | None:
    """The first number of the answer, if it is one of 1 to n."""
    m = re.search(r"\b(\d+)\b", answer or "")
    return int(m[1]) if m and 1 <= int(m[1]) <= n else None


def _answered(prompts: DataFrame, model: Model, path: str) -> DataFrame:
    asked_once(prompts, model, lambda a: None, 1).write.parquet(path)
    return prompts.sparkSession.read.parquet(path).select("key", "answer")


def assigned_rooms(sessions: DataFrame, known: DataFrame, rooms: tuple[str, ...], model: Model, path: str) -> DataFrame:
    """(session_id, room) of sessions (session_id long, text): those of known (session_id, room) as they are, a model's word for the others."""
    new = sessions.join(known.select("session_id"), "session_id", "left_anti")
    snippet = F.replace(F.substring(F.coalesce("text", F.lit("")), 1, SESSION_CHARS), F.lit("\n"), F.lit(" "))
    head = "Read this conversation and assign it to exactly one room from the list below.\n\nRooms:\n" + "\n".join(rooms) + "\n\nConversation:\n"
    answers = _answered(new.select(F.col("session_id").alias("key"), F.concat(F.lit(head), snippet).alias("prompt")), model, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"session_id": b["key"], "room": [room_of(a, rooms) for a in b["answer"]]})

    own = answers.mapInPandas(run, "session_id long, room string")
    return sessions.select("session_id").join(known, "session_id").select("session_id", "room").unionByName(own)


def routed(questions: DataFrame, rooms: tuple[str, ...], model: Model, path: str) -> DataFrame:
    """(query_id, room): a row for each room that a question (query_id long, question) is sent to."""
    head = f"Which 1 or {ROUTES} rooms from the list below does this question relate to?\n\nRooms:\n" + "\n".join(rooms) + "\n\nQuestion: "
    answers = _answered(questions.select(F.col("query_id").alias("key"), F.concat(F.lit(head), F.col("question")).alias("prompt")), model, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, r) for k, a in zip(b["key"], b["answer"]) for r in rooms_of(a, rooms)]
            yield pd.DataFrame(rows, columns=["query_id", "room"])

    return answers.mapInPandas(run, "query_id long, room string")


def searched_rooms(questions: DataFrame, routes: DataFrame, sessions: DataFrame, k: int = FETCH) -> DataFrame:
    """(query_id, session_id, dist, near): the k closest sessions (session_id, room, vec) in the rooms of each question (query_id, qvec)."""
    q = questions.select("query_id", "qvec").join(routes, "query_id")
    return nearest(q, sessions.withColumnRenamed("session_id", "doc_id"), k, "room").withColumnRenamed("doc_id", "session_id")


def repicked(hits: DataFrame, model: Model, path: str) -> DataFrame:
    """(query_id, session_id, rank): of the first PICKED hits (query_id long, question, session_id, rank, text) the one that a model picks comes first, the others stay in order."""
    line = F.concat(F.col("rank"), F.lit(". ["), F.col("session_id"), F.lit("] "), F.replace(F.substring("text", 1, HIT_CHARS), F.lit("\n"), F.lit(" ")))
    few = hits.where(F.col("rank") <= PICKED).groupBy("query_id").agg(F.max("question").alias("question"), F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("own"))
    few = few.where(F.size("own") > 1)
    lines = F.array_join(F.transform("own", lambda x: x["line"]), "\n")
    prompt = F.concat(F.lit("Question: "), "question", F.lit("\n\nWhich of the following passages most directly answers this question? Reply with just the number (1-"), F.size("own"), F.lit(").\n\n"), lines)
    answers = _answered(few.select(F.col("query_id").alias("key"), prompt.alias("prompt")), model, path)
    sizes = hits.where(F.col("rank") <= PICKED).groupBy(F.col("query_id").alias("key")).agg(F.count("*").alias("n"))  # without texts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, p) for k, a, n in zip(b["key"], b["answer"], b["n"]) if (p := picked(a, n))]
            yield pd.DataFrame(rows, columns=["query_id", "pick"])

    picks = answers.join(sizes, "key").mapInPandas(run, "query_id long, pick long")
    w = Window.partitionBy("query_id").orderBy(F.when(F.col("rank") == F.col("pick"), 0).otherwise(1), "rank")
    return hits.join(picks, "query_id", "left").select("query_id", "session_id", F.row_number().over(w).cast("long").alias("rank"))
