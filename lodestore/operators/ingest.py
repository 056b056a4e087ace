"""Ingest: format sniffing, chat exports to turns, transcripts, chunking, routing.

Files are rows (file, content). A file's lines meet by its key, never more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestore.functions import first_of, total
from lodestore.operators.atlas import ordered
from lodestore.sources.files import stored

#: Readable extensions, skipped folders, conversation extensions.
READABLE = (".txt", ".md", ".py", ".js", ".ts", ".jsx", ".tsx", ".json", ".yaml", ".yml", ".html", ".css", ".java", ".go", ".rs", ".rb", ".sh", ".csv", ".sql", ".toml")
SKIPPED = (".git", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", ".next", "coverage", ".cache", ".tox", ".idea", ".vscode", ".ipynb_checkpoints", ".eggs", "htmlcov", "target")
CONVERSATIONS = (".txt", ".md", ".json", ".jsonl")
#: Topic rooms in their order and their keywords.
TOPICS = {
    "technical": "code python function bug error api database server deploy git test debug refactor",
    "architecture": "architecture design pattern structure schema interface module component service layer",
    "planning": "plan roadmap milestone deadline priority sprint backlog scope requirement spec",
    "decisions": "decided chose picked switched migrated replaced trade-off alternative option approach",
    "problems": "problem issue broken failed crash stuck workaround fix solved resolved",
}
#: Legacy rooms and the memory type each becomes.
ROOM_TYPES = {
    "EPISODIC": "episodic episodes experience", "SEMANTIC": "semantic facts concepts", "PROCEDURAL": "procedural procedures how_to",
    "FAILURE": "failure failures errors", "TOOL_USE": "tool_use tools tool", "WORKING_DERIVATIVE": "working scratch draft",
}
LEAST_CHUNK, REPLY_LINES, LINE_GROUP = 30, 8, 25
#: Character windows: size, overlap, least size.
WINDOW, OVERLAP, LEAST = 800, 100, 50
MESSAGE = "type string, uuid string, message struct<role:string,content:string>, timestamp string, payload struct<type:string,message:string>"


def conversation_files(files: DataFrame) -> DataFrame:
    """Those of files (file, a path) that hold conversations: by their extension in any case, no `.meta.json`, in no skipped folder."""
    parts = F.split("file", "/")
    skipped = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*SKIPPED))
    suffix = F.lower(F.regexp_extract("file", r"[^/](\.[^./]+)$", 1))
    return files.where(suffix.isin(*CONVERSATIONS) & ~F.endswith("file", F.lit(".meta.json")) & ~skipped)


def lines(files: DataFrame) -> DataFrame:
    """(file, n, line), n from 0."""
    return files.select("file", F.posexplode(F.split("content", "\n")).alias("n", "line"))


def file_format(content: Column, path: Column) -> Column:
    """transcript if three lines start with `>`, else json by extension or first character, else raw."""
    quotes = F.size(F.filter(F.split(content, "\n"), lambda x: F.startswith(F.trim(x), F.lit(">"))))
    json = path.rlike(r"\.jsonl?$") | F.substring(F.trim(content), 1, 1).isin("{", "[")
    return first_of((F.trim(content) == "", "empty"), (quotes >= 3, "transcript"), (json, "json"), default=F.lit("raw"))


def flat_content(block: Column) -> Column:
    """Text of a JSON content value: a string, a list of strings and text blocks, or an object with text."""
    kind = F.schema_of_variant(block)
    parts = F.from_json(F.to_json(block), "array<string>")
    text = F.transform(parts, lambda p: F.when(F.startswith(p, F.lit("{")), F.when(F.get_json_object(p, "$.type") == "text", F.get_json_object(p, "$.text"))).otherwise(p))
    return F.trim(
        F.when(kind == "STRING", F.try_variant_get(block, "$", "string"))
        .when(F.startswith(kind, F.lit("ARRAY")), F.array_join(text, " "))
        .when(F.startswith(kind, F.lit("OBJECT")), F.coalesce(F.try_variant_get(block, "$.text", "string"), F.lit("")))
        .otherwise("")
    )


def _complete(turns: DataFrame, least: int = 2) -> DataFrame:
    """The turns of files with at least `least` of them."""
    w = Window.partitionBy("file")
    return turns.withColumn("_all", F.count("*").over(w)).where(F.col("_all") >= least).drop("_all")


def agent_session_turns(files: DataFrame) -> DataFrame:
    """(file, n, role, text) of JSON-lines agent sessions: types human, user and assistant with text; two turns at least."""
    j = lines(files).select("file", "n", F.from_json("line", MESSAGE).alias("j"))
    role = first_of((F.col("j.type").isin("human", "user"), "user"), (F.col("j.type") == "assistant", "assistant"))
    return _complete(j.select("file", "n", role.alias("role"), F.trim("j.message.content").alias("text")).where("role is not null and text <> ''"))


def meta_session_turns(files: DataFrame) -> DataFrame:
    """(file, n, role, text) of session-meta JSON lines: event_msg with user_message or agent_message; a session_meta line is required."""
    j = lines(files).select("file", "n", F.from_json("line", MESSAGE).alias("j"))
    known = j.withColumn("meta", F.bool_or(F.coalesce(F.col("j.type") == "session_meta", F.lit(False))).over(Window.partitionBy("file"))).where("meta and j.type = 'event_msg'")
    role = first_of((F.col("j.payload.type") == "user_message", "user"), (F.col("j.payload.type") == "agent_message", "assistant"))
    return _complete(known.select("file", "n", role.alias("role"), F.trim("j.payload.message").alias("text")).where("role is not null and text <> ''"))


def export_turns(files: DataFrame) -> DataFrame:
    """(file, n, role, text) of JSON exports: a list of messages, or objects with chat_messages."""
    one = "array<struct<role:string,sender:string,content:string,text:string>>"
    flat = F.filter(F.from_json("content", one), lambda m: m["role"].isNotNull() | m["sender"].isNotNull())
    nested = F.flatten(F.transform(F.from_json("content", f"array<struct<chat_messages:{one}>>"), lambda c: F.coalesce(c["chat_messages"], F.array().cast(one))))
    m = files.select("file", F.posexplode(F.when(F.size(flat) > 0, flat).otherwise(nested)).alias("n", "m"))
    said = F.coalesce("m.role", "m.sender")
    role = first_of((said.isin("user", "human"), "user"), (said.isin("assistant", "ai"), "assistant"))
    return _complete(m.select("file", "n", role.alias("role"), F.trim(F.coalesce("m.content", "m.text")).alias("text")).where("role is not null and text <> ''"))


def tree_turns(nodes: DataFrame) -> DataFrame:
    """(file, n, role, text) of tree exports, nodes being (file, node, parent, pos, role, text).

    From the root (no parent and no message, else the first without parent) along first children to a leaf.
    A tree is one file's, so each is walked in its own group.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        rows = {r.node: r for r in pdf.itertuples()}
        child: dict[str, str] = {}
        for r in pdf.itertuples():
            if r.parent in rows:
                child.setdefault(r.parent, r.node)
        tops = [r for r in pdf.itertuples() if r.parent not in rows]
        at = next((r.node for r in tops if not r.text), tops[0].node if tops else None)
        out, seen = [], set()
        while at is not None and at not in seen:
            seen.add(at)
            r = rows[at]
            if r.role in ("user", "assistant") and r.text:
                out.append((r.file, len(out), r.role, r.text))
            at = child.get(at)
        return pd.DataFrame(out, columns=["file", "n", "role", "text"])

    return nodes.groupBy("file").applyInPandas(walk, nodes.select("file").schema.add("n", "integer").add("role", "string").add("text", "string"))


def channel_turns(messages: DataFrame) -> DataFrame:
    """(file, n, role, text) of channel exports (file, n, user, text): a new speaker answers the last role; the first is the user.

    A speaker keeps the role, so it hangs on the one who spoke just before the first message alone: the chain of these, whose length is
    odd or even, is followed by doubling steps over speakers. A channel of any size is dealt over many tasks.
    """
    spark = messages.sparkSession
    said = messages.where("text <> '' and user <> ''").withColumn("channel", F.struct("file"))
    placed = stored(spark, ordered(said.select("channel", "n", "user"), ["channel"], [F.col("n"), F.col("user")], "place"), "channel-places")
    first = placed.groupBy("channel", "user").agg(F.min("place").alias("place"))
    before = placed.select("channel", (F.col("place") + 1).alias("place"), F.col("user").alias("up"))
    speakers = first.join(before, ["channel", "place"], "left").select("channel", "user", "up", F.col("up").isNotNull().alias("odd"))
    while True:
        speakers = stored(spark, speakers, "channel-speakers")
        if speakers.where("up is not null").isEmpty():
            break
        above = speakers.select("channel", F.col("user").alias("up"), F.col("up").alias("next"), F.col("odd").alias("more"))
        speakers = speakers.join(above, ["channel", "up"], "left").select("channel", "user", F.col("next").alias("up"), (F.col("odd") != F.coalesce("more", F.lit(False))).alias("odd"))
    talks = placed.groupBy("channel").agg(F.max("place").alias("many")).where("many >= 2").select("channel")
    role = F.when(F.col("odd"), "assistant").otherwise("user").alias("role")
    return said.join(speakers.join(talks, "channel", "left_semi"), ["channel", "user"]).select("file", F.col("n").cast("int").alias("n"), role, "text")


def transcripts(turns: DataFrame) -> DataFrame:
    """(file, content): user lines marked with `>`, the reply on the next line, then a blank one."""
    nxt = F.lead("role").over(Window.partitionBy("file").orderBy("n"))
    gap = F.when((F.col("role") == "user") & (F.col("nxt") == "assistant"), "").otherwise("\n")
    said = turns.withColumn("nxt", nxt).select("file", "n", F.concat(F.when(F.col("role") == "user", "> ").otherwise(""), "text", gap).alias("said"))
    return said.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "said"))), lambda x: x["said"]), "\n").alias("content"))


def plain_turns(files: DataFrame) -> DataFrame:
    """(file, turn, role, text): `> ` lines are the user's, others the assistant's; lines of one role run together, blanks within kept."""
    w = Window.partitionBy("file").orderBy("n")
    own = first_of((F.startswith("line", F.lit("> ")), "user"), (F.trim("line") != "", "assistant"))
    l = lines(files).withColumn("own", own).withColumn("role", F.last("own", ignorenulls=True).over(w)).where("role is not null")
    l = l.withColumn("turn", F.sum(F.when(F.lag("role").over(w) == F.col("role"), 0).otherwise(1)).over(w))
    said = F.when(F.col("own") == "user", F.expr("substr(line, 3)")).when(F.col("own").isNull(), "").otherwise(F.col("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("said")))), lambda x: x["said"]), "\n")
    out = l.withColumn("said", said).groupBy("file", "turn", "role").agg(text.alias("text"))
    return out.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where("text <> ''")


def room_of(path_parts: Column, filename: Column, content: Column, rooms: dict[str, list[str]], default: str = "general") -> Column:
    """Room by folder, then by file name, then by the most keyword hits in the first 2000 characters; the first room wins ties."""
    low = F.lower(F.substring(content, 1, 2000))
    fits = lambda p, c: (p == c) | F.contains(F.lit(c), p) | F.contains(p, F.lit(c))
    folders = F.slice(path_parts, 1, F.greatest(F.size(path_parts) - 1, F.lit(0)))
    # the first folder that fits any room decides, and in it the first room
    hit = F.transform(folders, lambda p: first_of(*[(total([F.when(fits(p, c.lower()), 1).otherwise(0) for c in [r, *k]]) > 0, r) for r, k in rooms.items()]))
    by_folder = F.get(F.array_compact(hit), F.lit(0))
    by_name = first_of(*[(F.contains(filename, F.lit(r.lower())) | F.contains(F.lit(r.lower()), filename), r) for r in rooms])
    count = lambda kw: (F.length(low) - F.length(F.replace(low, F.lit(kw.lower())))) / len(kw)
    scores = F.array(*[total([count(kw) for kw in [*k, r]]) for r, k in rooms.items()])
    by_text = F.get(F.transform(F.array(scores), lambda s: F.when(F.array_max(s) > 0, F.element_at(F.array(*[F.lit(r) for r in rooms]), F.array_position(s, F.array_max(s)).cast("int")))), F.lit(0))
    return F.coalesce(by_folder, by_name, by_text, F.lit(default))


def topic_of(content: Column, topics: dict[str, str] = TOPICS, most: int = 3000) -> Column:
    """The topic room with the most distinct keywords in the first characters; the first room wins ties; none: general."""
    low = F.lower(F.substring(content, 1, most))
    scores = [(r, total([F.contains(low, F.lit(k)).cast("int") for k in kws.split()])) for r, kws in topics.items()]
    best = F.greatest(*[s for _, s in scores])
    return first_of(*[((s == best) & (best > 0), r) for r, s in scores], default=F.lit("general"))


def exchange_chunks(files: DataFrame) -> DataFrame:
    """(file, chunk_index, content): a `>` line with the first non-blank lines of the reply up to the next `>` or `---`."""
    w = Window.partitionBy("file").orderBy("n")
    l = lines(files).withColumn("line", F.trim("line"))
    l = l.withColumn("g", F.sum(F.startswith("line", F.lit(">")).cast("int")).over(w)).where("g > 0")
    in_g = Window.partitionBy("file", "g").orderBy("n")
    l = l.withColumn("ended", F.max(F.startswith("line", F.lit("---")).cast("int")).over(in_g)).where("ended = 0 and line <> ''")
    l = l.withColumn("k", F.row_number().over(in_g)).where(F.col("k") <= REPLY_LINES + 1)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"])
    c = l.groupBy("file", "g").agg(parts.alias("p"))
    reply = F.array_join(F.expr("slice(p, 2, 100)"), " ")
    c = c.withColumn("content", F.when(reply != "", F.concat(F.col("p")[0], F.lit("\n"), reply)).otherwise(F.col("p")[0])).where(F.length("content") > LEAST_CHUNK)
    return c.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("g")) - 1).cast("long").alias("chunk_index"), "content")


def paragraph_chunks(files: DataFrame) -> DataFrame:
    """(file, chunk_index, content): paragraphs; groups of lines if there is one paragraph of many lines."""
    parts = F.filter(F.transform(F.split("content", "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    row = F.split("content", "\n")
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(row) - 1) / LINE_GROUP).cast("int")), lambda i: F.regexp_replace(F.array_join(F.slice(row, i * LINE_GROUP + 1, LINE_GROUP), "\n"), r"^\s+|\s+$", ""))
    chunks = F.when((F.size(parts) <= 1) & (F.size(row) > 21), groups).otherwise(parts)
    return files.select("file", F.posexplode(F.filter(chunks, lambda p: F.length(p) > LEAST_CHUNK)).alias("chunk_index", "content")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


def windows(text: str, size: int = WINDOW, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Overlapping windows that break at a blank line, else at a line end, past their middle."""
    text, out, start = text.strip(), [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            for mark in ("\n\n", "\n"):
                if (at := text.rfind(mark, start, end)) > start + size // 2:
                    end = at
                    break
        if len(piece := text[start:end].strip()) >= least:
            out.append(piece)
        start = end - overlap if end < len(text) else end
    return out


def window_chunks(files: DataFrame) -> DataFrame:
    """(file, chunk_index, content): windows(), whose cursor depends on each break before it, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, i, c) for f, t in zip(b["file"], b["content"]) for i, c in enumerate(windows(t or ""))]
            yield pd.DataFrame(rows, columns=["file", "chunk_index", "content"])

    return files.select("file", "content").mapInPandas(run, files.select("file").schema.add("chunk_index", "long").add("content", "string"))


def sessions(files: DataFrame, header: str, restored: list[str], least: int = 10) -> DataFrame:
    """(file, session, first_line, n_lines, subject): files cut at header lines that no restore mark follows within six lines."""
    w = Window.partitionBy("file").orderBy("n")
    near = w.rowsBetween(0, 5)
    mark = total([F.contains("line", F.lit(r)).cast("int") for r in restored])
    l = lines(files).withColumn("restored", F.sum(mark).over(near))
    l = l.withColumn("session", F.sum((F.contains("line", F.lit(header)) & (F.col("restored") == 0)).cast("int")).over(w)).where("session > 0")
    prompt = F.trim(F.expr("substr(line, 3)"))
    usable = F.startswith("line", F.lit("> ")) & (F.length(prompt) > 5) & ~prompt.rlike(r"^(\./|cd |ls |python|bash|git |cat |source |export )")
    subject = F.min(F.when(usable, F.struct("n", prompt.alias("p"))))["p"]
    out = l.groupBy("file", "session").agg(F.min("n").cast("long").alias("first_line"), F.count("*").alias("n_lines"), subject.alias("p"))
    out = out.withColumn("all", F.count("*").over(Window.partitionBy("file"))).where((F.col("all") >= 2) & (F.col("n_lines") >= least))
    name = F.substring(F.regexp_replace(F.trim(F.regexp_replace("p", r"[^A-Za-z0-9_\s-]", "")), r"\s+", "-"), 1, 60)
    return out.select("file", F.col("session").cast("long").alias("session"), "first_line", "n_lines", F.coalesce(name, F.lit("session")).alias("subject"))


def harvested(turns: DataFrame, most: int) -> DataFrame:
    """User texts of 30 to 800 characters, each once, from the newest file on. turns: (file, n, role, text, modified)."""
    ok = turns.where("role = 'user'").withColumn("text", F.trim("text")).where("length(text) between 30 and 800").where(~F.col("text").rlike(r"^(/|<|https?://|```|\.)"))
    first = ok.withColumn("_k", F.row_number().over(Window.partitionBy("text").orderBy(F.desc("modified"), "file", "n"))).where("_k = 1").drop("_k")
    return first.orderBy(F.desc("modified"), "file", "n").limit(most)


def drawer_id(wing: Column, room: Column, path: Column, index: Column) -> Column:
    return F.concat(F.lit("drawer_"), wing, F.lit("_"), room, F.lit("_"), F.substring(F.md5(F.concat(path, index.cast("string"))), 1, 16))


def memory_type_of(room: Column) -> Column:
    return first_of(*[(F.lower(room).isin(*names.split()), t) for t, names in ROOM_TYPES.items()], default=F.lit("SEMANTIC"))
