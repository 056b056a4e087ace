"""Queries of the ingest operators (ING)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.operators import ignore, ingest
from lodestore.plans.base import MEM, Tables, query

TRANSCRIPT = """
 t as (select conv_id as file, turn as n, role, text, lead(role) over (partition by conv_id order by turn) as nxt from conversations),
 f as (select file, string_agg(case when role = 'user' then '> ' else '' end || text || case when role = 'user' and nxt = 'assistant' then '' else chr(10) end, chr(10) order by n) as content from t group by file)"""
LINES = "l as (select file, unnest(string_split(content, chr(10))) as line, unnest(range(len(string_split(content, chr(10))))) as n from f)"


def turns(t: Tables) -> DataFrame:
    return t("conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("n"), "role", "text")


def transcripts(t: Tables) -> DataFrame:
    return ingest.transcripts(turns(t))


def jsonl(t: Tables, line: object) -> DataFrame:
    """Files of JSON lines, one for each conversation."""
    l = turns(t).select("file", "n", F.to_json(line).alias("line"))
    return l.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("content"))


@query("ing_01", f"with {TRANSCRIPT}, m as (select 'd' || doc_id as file, text as content, doc_id % 3 = 0 as j from documents union all select 'c' || file, content, false from f) select file, case when trim(content) = '' then 'empty' when len(list_filter(string_split(content, chr(10)), lambda x: starts_with(trim(x), '>'))) >= 3 then 'transcript' when j or substr(trim(content), 1, 1) in ('{{', '[') then 'json' else 'raw' end as format from m")
def formats(t: Tables) -> DataFrame:
    d = t("documents").select(F.concat(F.lit("d"), "doc_id").alias("file"), F.col("text").alias("content"), F.when(F.col("doc_id") % 3 == 0, "x.jsonl").otherwise("x.txt").alias("path"))
    c = transcripts(t).select(F.concat(F.lit("c"), "file").alias("file"), "content", F.lit("x.txt").alias("path"))
    return d.union(c).select("file", ingest.file_format(F.col("content"), F.col("path")).alias("format"))


_TURNS = "with c as (select conv_id as file, role, trim(text) as text, count(*) over (partition by conv_id) as all_n, turn as n from conversations where trim(text) <> '' and role in ('user', 'assistant')) select file, n, role, text from c where all_n >= 2"


@query("ing_02", _TURNS)
def agent_sessions(t: Tables) -> DataFrame:
    line = F.struct(F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("type"), F.struct(F.col("text").alias("content")).alias("message"))
    return ingest.agent_session_turns(jsonl(t, line)).withColumn("n", F.col("n").cast("long"))


@query("ing_03", _TURNS.replace("from conversations where", "from conversations where conv_id % 2 = 0 and"))
def meta_sessions(t: Tables) -> DataFrame:
    kind = F.when(F.col("role") == "user", "user_message").when(F.col("role") == "assistant", "agent_message").otherwise("other")
    files = jsonl(t, F.struct(F.lit("event_msg").alias("type"), F.struct(kind.alias("type"), F.col("text").alias("message")).alias("payload")))
    meta = F.concat("content", F.when(F.col("file") % 2 == 0, '\n{"type":"session_meta"}').otherwise(""))
    return ingest.meta_session_turns(files.withColumn("content", meta)).withColumn("n", F.col("n").cast("long"))


@query("ing_04", _TURNS)
def exports(t: Tables) -> DataFrame:
    one = F.array_sort(F.collect_list(F.struct("n", F.struct("role", F.col("text").alias("content")).alias("m"))))
    files = turns(t).groupBy("file").agg(F.transform(one, lambda x: x["m"]).alias("m"))
    flat = F.to_json("m")
    nested = F.to_json(F.array(F.struct(F.col("m").alias("chat_messages"))))
    files = files.select("file", F.when(F.col("file") % 2 == 0, flat).otherwise(nested).alias("content"))
    return ingest.export_turns(files).withColumn("n", F.col("n").cast("long"))


@query("ing_05", """with recursive nodes as (select conv_id as file, 'n' || turn as node, 'n' || (turn - 1) as parent, turn as pos, role, text from conversations union all select conv_id, 'x' || turn, 'n' || (turn - 1), turn + 1000, 'assistant', 'other branch' from conversations where turn % 3 = 1),
 walk as (select file, node, role, text, 0 as n from nodes where pos = 0 union all select c.file, c.node, c.role, c.text, w.n + 1 from walk w join (select *, row_number() over (partition by file, parent order by pos) as k from nodes) c on c.file = w.file and c.parent = w.node and c.k = 1)
 select file, row_number() over (partition by file order by n) - 1 as n, role, text from walk where role in ('user', 'assistant') and text <> ''""")
def trees(t: Tables) -> DataFrame:
    c = turns(t)
    main = c.select("file", F.concat(F.lit("n"), "n").alias("node"), F.concat(F.lit("n"), F.col("n") - 1).alias("parent"), F.col("n").alias("pos"), "role", "text")
    side = c.where("n % 3 = 1").select("file", F.concat(F.lit("x"), "n"), F.concat(F.lit("n"), F.col("n") - 1), F.col("n") + 1000, F.lit("assistant"), F.lit("other branch"))
    return ingest.tree_turns(main.union(side)).withColumn("n", F.col("n").cast("long"))


@query("ing_06", """with recursive c as (
   select conv_id % 50 as file, conv_id * 100 + turn as n, 'u' || conv_id % 4 as user, text from conversations where text <> ''
 ),
 o as (select *, row_number() over (partition by file order by n) as k, count(*) over (partition by file) as many from c),
 w as (
   select file, k, n, text, many, map([user], ['user']) as who, 'user' as role from o where k = 1
   union all
   select o.file, o.k, o.n, o.text, o.many,
     case when map_contains(w.who, o.user) then w.who else map_concat(w.who, map([o.user], [case when w.role = 'user' then 'assistant' else 'user' end])) end,
     case when map_contains(w.who, o.user) then w.who[o.user] when w.role = 'user' then 'assistant' else 'user' end
   from w join o on o.file = w.file and o.k = w.k + 1
 )
 select file, n::int as n, role, text from w where many >= 2""")
def channels(t: Tables) -> DataFrame:
    c = t("conversations").select((F.col("conv_id") % 50).alias("file"), (F.col("conv_id") * 100 + F.col("turn")).alias("n"), F.concat(F.lit("u"), F.col("conv_id") % 4).alias("user"), "text")
    return ingest.channel_turns(c)


@query("ing_07", "select conv_id, turn, case turn % 3 when 0 then trim(text) when 1 then trim(role || ' ' || text) else trim(text) end as content from conversations")
def contents(t: Tables) -> DataFrame:
    plain, listed = F.to_json(F.array("text")), F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("x").alias("text"))))
    body = F.expr("substr(j, 2, length(j) - 2)")
    head = F.regexp_replace(F.to_json(F.array("role")), r"\]$", ",")
    c = t("conversations").withColumn("j", plain)
    raw = F.when(F.col("turn") % 3 == 0, body).when(F.col("turn") % 3 == 1, F.concat(head, F.regexp_replace(listed, r"^\[", ""))).otherwise(F.to_json(F.struct("text")))
    return c.select("conv_id", "turn", ingest.flat_content(F.parse_json(raw)).alias("content"))


@query("ing_08", f"with {TRANSCRIPT} select file, content from f")
def rendered(t: Tables) -> DataFrame:
    return transcripts(t)


@query("ing_09", "select conv_id as file, turn as n, role, text, cast(turn * 60 as bigint) as ts, map {'lang': 'x' || turn} as metadata from conversations")
def parsed_turns(t: Tables) -> DataFrame:
    line = F.create_map(F.lit("role"), "role", F.lit("content"), "text", F.lit("timestamp"), (F.col("n") * 60).cast("string"), F.lit("lang"), F.concat(F.lit("x"), "n"))
    l = ingest.lines(jsonl(t, line)).select("file", F.col("n").cast("long").alias("n"), F.from_json("line", "map<string,string>").alias("m"))
    rest = F.map_filter("m", lambda k, _: ~k.isin("role", "content", "timestamp", "created_at"))
    return l.select("file", "n", F.col("m")["role"].alias("role"), F.col("m")["content"].alias("text"), F.coalesce(F.col("m")["timestamp"], F.col("m")["created_at"]).cast("long").alias("ts"), rest.alias("metadata"))


@query("ing_10", f"""with {TRANSCRIPT}, {LINES},
 o as (select *, case when starts_with(line, '> ') then 'user' when trim(line) <> '' then 'assistant' end as own from l),
 r as (select *, last_value(own ignore nulls) over (partition by file order by n) as role from o),
 c as (select *, case when lag(role) over (partition by file order by n) = role then 0 else 1 end as new from r where role is not null),
 g as (select *, sum(new) over (partition by file order by n)::bigint as turn from c)
 select * from (select file, turn, role, regexp_replace(string_agg(case when own = 'user' then substr(line, 3) when own is null then '' else line end, chr(10) order by n), '^\\s+|\\s+$', '', 'g') as text from g group by file, turn, role) where text <> ''""")
def plain_text(t: Tables) -> DataFrame:
    return ingest.plain_turns(transcripts(t))


@query("ing_11", f"with {MEM} select source_path from mem where regexp_matches(source_path, '[.](py|md)$') and not contains(source_path, '/src3/')")
def project_scan(t: Tables) -> DataFrame:
    """Of all paths those with a readable extension in no skipped folder; src3 plays a skipped folder."""
    extension = F.regexp_extract("source_path", r"(\.[a-z]+)$", 1)
    skipped = F.arrays_overlap(F.split("source_path", "/"), F.array(*[F.lit(x) for x in (*ingest.SKIPPED, "src3")]))
    return t.memories().where(extension.isin(*ingest.READABLE) & ~skipped).select("source_path")


#: Ignore files of folders of the paths of memories, and their rules as SQL has them: what folder, is it for folders alone, does it let in, and as a pattern.
IGNORE_FILES = {
    "": "session1*\n!*.md\n/src2/\n# a remark\n\n\\#odd\nsrc7/**/*[0-4].*",
    "src4": "*.py\n!session3?/*.py\nsession7/",
    "src5/session5": "**\n!5?.jsonl",
    "src6": "/**/6*.md\nsession[0-2][!0-5]/\n!session26",
    "src2": "!*.py",
}
_RULES = """rules(base, pos, folders, negated, regex) as (values
  ('', 0, false, false, '(?:^|/)session1[^/]*/'),
  ('', 1, false, true, '(?:^|/)[^/]*[.]md/'),
  ('', 2, true, false, '^src2/'),
  ('', 5, false, false, '(?:^|/)#odd/'),
  ('', 6, false, false, '^src7/(?:[^/]+/)*[^/]*[0-4][.][^/]*/'),
  ('src4', 0, false, false, '(?:^|/)[^/]*[.]py/'),
  ('src4', 1, false, true, '^session3[^/]/[^/]*[.]py/'),
  ('src4', 2, true, false, '(?:^|/)session7/'),
  ('src5/session5', 0, false, false, '(?:^|/)[^/]+/'),
  ('src5/session5', 1, false, true, '(?:^|/)5[^/][.]jsonl/'),
  ('src6', 0, false, false, '^(?:[^/]+/)*6[^/]*[.]md/'),
  ('src6', 1, true, false, '(?:^|/)session[0-2][^0-5/]/'),
  ('src6', 2, false, true, '(?:^|/)session26/'),
  ('src2', 0, false, true, '(?:^|/)[^/]*[.]py/')
)"""
_ENTRIES = f"""{MEM},
 f as (select distinct substr(source_path, 2) as entry, false as is_dir from mem),
 d as (select distinct unnest([split_part(entry, '/', 1), split_part(entry, '/', 1) || '/' || split_part(entry, '/', 2)]) as entry, true as is_dir from f),
 e as (select * from f union all select * from d),
 {_RULES},
 x as (select e.*, r.*, case when base = '' then entry else substr(entry, length(base) + 2) end || '/' as rest from e join rules r on base = '' or starts_with(entry, base || '/')),
 h as (select * from x where regexp_matches(case when folders and not is_dir then regexp_replace(rest, '[^/]*/$', '') else rest end, regex)),
 ig as (select entry from h group by entry having not arg_max(negated, length(base) * 100 + pos))"""


def project_paths(t: Tables) -> DataFrame:
    return t.memories().select(F.substring("source_path", 2, 10_000).alias("file")).distinct()


def ignore_rules(t: Tables) -> DataFrame:
    return ignore.rules_of(t.spark.createDataFrame(list(IGNORE_FILES.items()), "base string, content string"))


@query("ing_12", f"with {_ENTRIES} select entry, is_dir from e where entry in (select entry from ig)")
def gitignore(t: Tables) -> DataFrame:
    """The files and folders of a project that the ignore files of their ancestors keep out."""
    f = project_paths(t).select(F.col("file").alias("entry"), F.lit(False).alias("is_dir"))
    d = f.select(F.explode(ignore.above(F.col("entry"))).alias("entry")).where("entry <> ''").distinct().withColumn("is_dir", F.lit(True))
    entries = f.unionByName(d)
    return entries.join(ignore.ignored(entries, ignore_rules(t)), "entry", "left_semi")


INCLUDES = (" /src2/session12/ ", "src4/session7", "src5/./session5//5.py", "src6")
_FORCED = "(in_ like 'src2/session12/%' or in_ in ('src2', 'src2/session12', 'src4', 'src4/session7', 'src5', 'src5/session5', 'src5/session5/5.py', 'src6') or in_ like 'src4/session7/%' or in_ like 'src6/%')"


@query("ing_13", f"""with {_ENTRIES},
 s as (select entry, is_dir, entry in (select entry from ig) as out, {_FORCED.replace('in_', 'entry')} as forced from e),
 gone as (select entry from s where is_dir and out and not forced)
 select entry as file from s
 where not is_dir and (regexp_matches(entry, '[.](py|md)$') or entry = 'src5/session5/5.py') and (forced or not out)
   and split_part(entry, '/', 1) not in (select entry from gone)
   and split_part(entry, '/', 1) || '/' || split_part(entry, '/', 2) not in (select entry from gone)""")
def forced(t: Tables) -> DataFrame:
    """The files that a scan reads: readable ones in no folder that is out, and what is stated, what lies in it and what leads to it."""
    return ignore.scanned(project_paths(t), ignore_rules(t), t.spark.createDataFrame([(p,) for p in INCLUDES], "path string"))


_ROOMS = {"auth": ["licensed", "token"], "data": ["public", "secret"], "src7": []}


@query("ing_14", f"""with {MEM}, c as (select *, lower(substr(body, 1, 2000)) as low from mem),
 s as (select *, (length(low) - length(replace(low, 'licensed', ''))) / 8 + (length(low) - length(replace(low, 'token', ''))) / 5 + (length(low) - length(replace(low, 'auth', ''))) / 4 as a,
  (length(low) - length(replace(low, 'public', ''))) / 6 + (length(low) - length(replace(low, 'secret', ''))) / 6 + (length(low) - length(replace(low, 'data', ''))) / 4 as d, (length(low) - length(replace(low, 'src7', ''))) / 4 as e from c)
 select memory_object_id, case when tenant_id in ('src7') then 'src7' when a > 0 and a >= d and a >= e then 'auth' when d > 0 and d >= e then 'data' when e > 0 then 'src7' else 'general' end as room from s""")
def routing(t: Tables) -> DataFrame:
    parts = F.filter(F.split(F.lower("source_path"), "/"), lambda p: p != "")
    name = F.regexp_extract(F.lower("source_path"), r"([^/]+)\.[a-z]+$", 1)
    return t.memories().select("memory_object_id", ingest.room_of(parts, F.concat(F.lit("#"), name), F.col("body"), _ROOMS).alias("room"))


#: The end of a window of 800 characters from `start`: a blank line, else a line end, past its middle.
_END = """case when start + 800 >= length(t) then length(t)
     when strpos(reverse(substr(t, start + 1, 800)), chr(10) || chr(10)) between 1 and 398 then start + 799 - strpos(reverse(substr(t, start + 1, 800)), chr(10) || chr(10))
     when strpos(reverse(substr(t, start + 1, 800)), chr(10)) between 1 and 399 then start + 800 - strpos(reverse(substr(t, start + 1, 800)), chr(10))
     else start + 800 end"""


@query("ing_15", f"""with recursive d as (select doc_id as file, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t from documents where text is not null),
 w as (
   select file, t, i, start, {_END} as stop from (select file, t, 0 as i, 0::bigint as start from d where t <> '')
   union all
   select file, t, i, start, {_END} as stop from (select file, t, i + 1 as i, stop - 100 as start from w where stop < length(t))
 ),
 p as (select file, i, regexp_replace(substr(t, start + 1, stop - start), '^\\s+|\\s+$', '', 'g') as content from w)
 select file, row_number() over (partition by file order by i) - 1 as chunk_index, content from p where length(content) >= 50""")
def character_windows(t: Tables) -> DataFrame:
    return ingest.window_chunks(t("documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content")))


@query("ing_16", f"""with {TRANSCRIPT}, {LINES},
 g as (select file, n, trim(line) as line, sum(case when starts_with(trim(line), '>') then 1 else 0 end) over (partition by file order by n) as g from l),
 e as (select *, max(case when starts_with(line, '---') then 1 else 0 end) over (partition by file, g order by n) as ended from g where g > 0),
 k as (select *, row_number() over (partition by file, g order by n) as k from e where ended = 0 and line <> ''),
 c as (select file, g, max(case when k = 1 then line end) as head, string_agg(line, ' ' order by k) filter (k between 2 and 9) as reply from k group by file, g),
 r as (select file, g, case when reply is not null then head || chr(10) || reply else head end as content from c)
 select file, row_number() over (partition by file order by g) - 1 as chunk_index, content from r where length(content) > 30""")
def exchanges(t: Tables) -> DataFrame:
    return ingest.exchange_chunks(transcripts(t))


@query("ing_17", r"""with b as (select doc_id as file, text, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') as parts, string_split(text, chr(10)) as row from documents),
 c as (select file, case when len(parts) <= 1 and len(row) > 21 then list_transform(range(0, cast(floor((len(row) - 1) / 25) as bigint) + 1), lambda i: regexp_replace(array_to_string(row[i * 25 + 1 : i * 25 + 25], chr(10)), '^\s+|\s+$', '', 'g')) else parts end as chunks from b),
 k as (select file, list_filter(chunks, lambda p: length(p) > 30) as chunks from c)
 select file, unnest(range(len(chunks))) as chunk_index, unnest(chunks) as content from k""")
def paragraphs(t: Tables) -> DataFrame:
    return ingest.paragraph_chunks(t("documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content")))


def _topic_sql() -> str:
    score = {r: " + ".join(f"cast(contains(low, '{k}') as int)" for k in kws.split()) for r, kws in ingest.TOPICS.items()}
    columns = ", ".join(f"{s} as {r}" for r, s in score.items())
    best = f"greatest({', '.join(score)})"
    return f"with c as (select conv_id, turn, lower(substr(text, 1, 3000)) as low from conversations), s as (select conv_id, turn, {columns} from c) select conv_id, turn, case when {best} = 0 then 'general' " + " ".join(f"when {r} = {best} then '{r}'" for r in score) + " end as room from s"


@query("ing_18", _topic_sql())
def topics(t: Tables) -> DataFrame:
    return t("conversations").select("conv_id", "turn", ingest.topic_of(F.col("text")).alias("room"))


#: Extensions of the files of a scan, by the memory's number; one of seven folders is a skipped one.
SCANNED = (".txt", ".MD", ".json", ".jsonl", ".meta.json", ".py", "")
_SCANNED = "regexp_replace(source_path, '[.][a-z]+$', '') || case seq % 7 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(SCANNED)) + " end"


@query("ing_19", f"""with {MEM}, f as (select case when seq % 5 = 2 then '/node_modules' else '' end || {_SCANNED} as file from mem)
 select file from f where regexp_matches(lower(file), '[.](txt|md|json|jsonl)$') and not ends_with(file, '.meta.json') and not starts_with(file, '/node_modules/')""")
def conversation_scan(t: Tables) -> DataFrame:
    ends = F.element_at(F.array(*[F.lit(x) for x in SCANNED]), (F.col("seq") % 7 + 1).cast("int"))
    folder = F.when(F.col("seq") % 5 == 2, "/node_modules").otherwise("")
    return ingest.conversation_files(t.memories().select(F.concat(folder, F.regexp_replace("source_path", "[.][a-z]+$", ""), ends).alias("file")))


@query("ing_20", "select doc_id from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def not_yet_ingested(t: Tables) -> DataFrame:
    return t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id")


@query("ing_21", "select event_id, ts from events where ts > (select max(ts) - interval 1 day from events)")
def new_since(t: Tables) -> DataFrame:
    last = t("events").agg((F.max("ts") - F.expr("interval 1 day")).alias("cutoff"))
    return t("events").crossJoin(F.broadcast(last)).where("ts > cutoff").select("event_id", "ts")


_SPLIT = """lines as (select conv_id % 40 as file, unnest(string_split(case when turn = 0 then 'Session v1' || chr(10) else '' end || case when conv_id % 7 = 3 and turn = 0 then 'previous messages' || chr(10) else '' end || case when role = 'user' then '> ' else '' end || text, chr(10))) as line,
  unnest(range(len(string_split(case when turn = 0 then 'Session v1' || chr(10) else '' end || case when conv_id % 7 = 3 and turn = 0 then 'previous messages' || chr(10) else '' end || case when role = 'user' then '> ' else '' end || text, chr(10))))) as i, conv_id, turn from conversations),
 l as (select file, line, row_number() over (partition by file order by conv_id, turn, i) - 1 as n from lines)"""


@query("ing_22", f"""with {_SPLIT},
 m as (select *, sum(case when contains(line, 'Ctrl+E') or contains(line, 'previous messages') then 1 else 0 end) over (partition by file order by n rows between current row and 5 following) as restored from l),
 s as (select *, sum(case when contains(line, 'Session v') and restored = 0 then 1 else 0 end) over (partition by file order by n)::bigint as session from m),
 p as (select *, trim(substr(line, 3)) as prompt from s where session > 0),
 a as (select file, session, min(n) as first_line, count(*) as n_lines, arg_min(prompt, n) filter (starts_with(line, '> ') and length(prompt) > 5 and not regexp_matches(prompt, '^(\\./|cd |ls |python|bash|git |cat |source |export )')) as p, count(*) over (partition by file) as all_n from p group by file, session)
 select file, session, first_line, n_lines, coalesce(substr(regexp_replace(trim(regexp_replace(p, '[^A-Za-z0-9_\\s-]', '', 'g')), '\\s+', '-', 'g'), 1, 60), 'session') as subject from a where all_n >= 2 and n_lines >= 10""")
def mega_files(t: Tables) -> DataFrame:
    head = F.when(F.col("turn") == 0, F.concat(F.lit("Session v1\n"), F.when(F.col("conv_id") % 7 == 3, "previous messages\n").otherwise(""))).otherwise("")
    c = t("conversations").select((F.col("conv_id") % 40).alias("file"), "conv_id", "turn", F.concat(head, F.when(F.col("role") == "user", "> ").otherwise(""), "text").alias("said"))
    files = c.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "said"))), lambda x: x["said"]), "\n").alias("content"))
    return ingest.sessions(files, "Session v", ["Ctrl+E", "previous messages"])


@query("ing_23", r"with c as (select conv_id, turn, trim(text) as text, conv_id % 13 as modified from conversations where role = 'user'), k as (select *, row_number() over (partition by text order by modified desc, conv_id, turn) as k from c where length(text) between 30 and 800 and not regexp_matches(text, '^(/|<|https?://|```|\.)')) select conv_id, turn, text from k where k = 1 order by modified desc, conv_id, turn limit 500")
def harvest(t: Tables) -> DataFrame:
    c = turns(t).withColumn("modified", F.col("file") % 13)
    return ingest.harvested(c, 500).select(F.col("file").alias("conv_id"), F.col("n").alias("turn"), "text")


@query("ing_24", "select conv_id, count(*) as n, count(*) % 15 = 0 as save from conversations where role = 'user' and not contains(text, '<command-message>') group by conv_id")
def human_messages(t: Tables) -> DataFrame:
    c = t("conversations").where((F.col("role") == "user") & ~F.contains("text", F.lit("<command-message>")))
    return c.groupBy("conv_id").agg(F.count("*").alias("n"), (F.count("*") % 15 == 0).alias("save"))


@query("ing_25", "select concat('m', doc_id) as id, case lang when 'en' then 'FAILURE' when 'de' then 'TOOL_USE' when 'fr' then 'PROCEDURAL' else 'SEMANTIC' end as memory_type, coalesce(nullif(substr(text, 1, 40), ''), 'Untitled') as title, substr(text, 1, 256) as summary from documents where doc_id not in (select doc_id from labels)")
def migration(t: Tables) -> DataFrame:
    room = F.when(F.col("lang") == "en", "Errors").when(F.col("lang") == "de", "tool").when(F.col("lang") == "fr", "how_to").otherwise("lobby")
    d = t("documents").join(t("labels"), "doc_id", "left_anti")
    return d.select(F.concat(F.lit("m"), "doc_id").alias("id"), ingest.memory_type_of(room).alias("memory_type"), F.coalesce(F.nullif(F.substring("text", 1, 40), F.lit("")), F.lit("Untitled")).alias("title"), F.substring("text", 1, 256).alias("summary"))


@query("ing_26", "select distinct concat('drawer_', source, '_', lang, '_', substr(md5(concat('/', source, '/', doc_id % 50, 0)), 1, 16)) as id from documents where length(text) >= 50")
def filing(t: Tables) -> DataFrame:
    d = t("documents").where(F.length("text") >= 50)
    path = F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id") % 50)
    return d.select(ingest.drawer_id(F.col("source"), F.col("lang"), path, F.lit(0)).alias("id")).dropDuplicates(["id"])
