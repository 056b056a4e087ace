"""Queries of the chunk, facet, entity and spelling operators (CON, FAC, ENT, SPL)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.functions import models, normalized
from lodestore.operators import ignore, text
from lodestore.operators import signals as sg
from lodestore.plans.base import ASKED, MEM, Tables, query
from lodestore.sources.files import shared_path

#: What a word boundary is in SQL: no letter, digit or underscore of any script.
OUT = r"[^\p{L}\p{N}_]"


def bounded(body: str, column: str = "text") -> str:
    return f"regexp_matches({column}, '(^|{OUT})(?i:{body})({OUT}|$)')"


def spread(column: str) -> str:
    """Each separator twice, so that neighbouring words have one each."""
    return f"(' ' || regexp_replace({column}, '({OUT})', '\\1\\1', 'g') || ' ')"


@query("con_01", r"""with p as (select doc_id, regexp_replace(text, '\n(#{1,3} )', chr(1) || chr(10) || '\1', 'g') as t from documents),
 q as (select doc_id, regexp_replace(t, '\n(\n)', chr(1) || chr(10) || '\1', 'g') as t from p),
 s as (select doc_id, unnest(string_split(t, chr(1))) as text, unnest(range(len(string_split(t, chr(1))))) as i from q),
 o as (select doc_id, text, i, coalesce(sum(length(text)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as start from s)
 select doc_id, start, text from o where regexp_replace(text, '\s', '', 'g') <> ''""")
def prose_sections(t: Tables) -> DataFrame:
    return text.sections(t("documents"), "prose").withColumn("start", F.col("start").cast("long"))


#: What takes the place of the blank after a sentence, by doc_id % 3, so that a text has boundaries of code or of a conversation.
CODE, TALK = ("class ", "def ", "async def "), ("Human:", "User:", "> ")


def broken(t: Tables, marks: tuple[str, ...]) -> DataFrame:
    mark = F.element_at(F.array(*[F.lit("\n" + m) for m in marks]), (F.col("doc_id") % 3 + 1).cast("int"))
    return t("documents").select("doc_id", F.replace("text", F.lit(". "), mark).alias("text"))


def _sections(marks: tuple[str, ...], boundary: str) -> str:
    broken_ = "replace(text, '. ', chr(10) || case doc_id % 3 " + " ".join(f"when {i} then '{m}'" for i, m in enumerate(marks)) + " end)"
    return f"""with q as (select doc_id, regexp_replace({broken_}, '\\n({boundary})', chr(1) || chr(10) || '\\1', 'g') as t from documents),
 s as (select doc_id, unnest(string_split(t, chr(1))) as text, unnest(range(len(string_split(t, chr(1))))) as i from q),
 o as (select doc_id, text, coalesce(sum(length(text)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as start from s)
 select doc_id, start, text from o where regexp_replace(text, '\\s', '', 'g') <> ''"""


@query("con_01_code", _sections(CODE, "class |def |async def "))
def code_sections(t: Tables) -> DataFrame:
    return text.sections(broken(t, CODE), "code").withColumn("start", F.col("start").cast("long"))


@query("con_01_conversation", _sections(TALK, "Human:|User:|>"))
def conversation_sections(t: Tables) -> DataFrame:
    return text.sections(broken(t, TALK), "conversation").withColumn("start", F.col("start").cast("long"))


def _windows(name: str, source: str, size: int) -> str:
    """A recursive table of the windows of source (doc_id, part, mid, off, t): they end after a sentence past their middle, and begin 40 characters before the last one's end."""
    mark = f"strpos(reverse(substr(t, start + 1, {size})), ' .')"
    stop = f"case when start + {size} >= length(t) then length(t) when {mark} between 1 and {size - size // 2 - 2} then start + {size} + 1 - {mark} else start + {size} end"
    return f"""{name} as (
   select doc_id, part, mid, off, t, k, start, {stop} as stop from (select *, 0 as k, 0::bigint as start from {source})
   union all
   select doc_id, part, mid, off, t, k, start, {stop} as stop from (select doc_id, part, mid, off, t, k + 1 as k, greatest(start + 1, stop - 40) as start from {name} where stop < length(t))
 )"""


_HIERARCHY = f"""with recursive d as (select doc_id, string_split(coalesce(text, ''), chr(10) || chr(10)) as parts from documents),
 p0 as (select doc_id, unnest(parts) as t, unnest(range(len(parts))) as part from d),
 p1 as (select *, coalesce(sum(length(t) + 2) over (partition by doc_id order by part rows between unbounded preceding and 1 preceding), 0)::bigint as off from p0),
 pa as (select doc_id, part, 0 as mid, off, t from p1 where regexp_matches(t, '[^\\s]')),
 {_windows('mw', 'pa', 1800)},
 mi as (select doc_id, part, k as mid, off + start as off, substr(t, start + 1, stop - start) as t from mw where regexp_matches(substr(t, start + 1, stop - start), '[^\\s]')),
 {_windows('fw', 'mi', 720)},
 fi as (select doc_id, part, mid, k as fine, off + start as off, substr(t, start + 1, stop - start) as t from fw where regexp_matches(substr(t, start + 1, stop - start), '[^\\s]'))"""


@query("con_02", _HIERARCHY + ' select doc_id, off as start, t as text from mi')
def token_windows(t: Tables) -> DataFrame:
    d = t("documents").select("doc_id", F.concat_ws("", "text").alias("text"))
    return text.hierarchy(d).where("level = 'mid'").select("doc_id", "start", "text")


@query("con_03", _HIERARCHY + """,
 al as (
   select doc_id, part, -1 as mid, -1 as fine, 'section' as level, off, t from pa
   union all select doc_id, part, mid, -1, 'mid', off, t from mi
   union all select doc_id, part, mid, fine, 'fine', off, t from fi
 ),
 nu as (select *, row_number() over (partition by doc_id order by part, mid, fine) - 1 as chunk from al)
 select n.doc_id, n.chunk, n.level, u.chunk as parent, n.off as start, n.t as text
 from nu n left join nu u on u.doc_id = n.doc_id and u.part = n.part
   and (n.level = 'mid' and u.level = 'section' or n.level = 'fine' and u.level = 'mid' and u.mid = n.mid)""")
def hierarchy(t: Tables) -> DataFrame:
    return text.hierarchy(t("documents"))


@query("con_04", f"with {MEM} select memory_object_id, case when memory_type = 'EPISODIC' then 'conversation' when regexp_matches(source_path, '[.](py|js|ts|tsx|jsx|go|rs|java|rb)$') then 'code' else 'prose' end as strategy from mem")
def strategy(t: Tables) -> DataFrame:
    kind = F.when(F.col("memory_type") == "EPISODIC", "conversation").otherwise("project_file")
    return t.memories().select("memory_object_id", text.chunk_kind(kind, F.col("source_path")).alias("strategy"))


def stand_in_extractor(prompts: list[str]) -> list[str]:
    """A memory of a prompt's first section. Documents whose id 7 leaves at 3 get prose around it at first, those that 11 leaves at 5 always."""
    out = []
    for p in prompts:
        head, _, rest = p.split("\n", 1)[1].partition("] ")
        key, again = int(head[1:].split("-")[0]), models.REPAIR in p
        section = rest.split("\n---\n")[0].split("\n\n=== FINE CHUNKS")[0]
        fine = p.split("(for evidence references) ===\n")[1].split("\n\nExtract")[0]
        memory = {"type": "semantic", "title": section[:40], "body": f"{len(section)} characters", "retention_score": 0.7, "evidence_chunk_ids": [fine.partition("]")[0][1:]]}
        bad = key % 7 == 3 and not again or key % 11 == 5
        out.append(("Here you are: " if bad else "") + json.dumps({"memories": [memory]}))
    return out


@query("con_05", """with s as (
   select doc_id, list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_matches(p, '[^\\s]')) as parts from documents
 )
 select doc_id, case when doc_id % 7 = 3 then 2 else 1 end as attempt, 0 as position, 'semantic' as type, substr(parts[1], 1, 40) as title, least(length(parts[1]), 4000) || ' characters' as body, 0.7::double as retention_score
 from s where len(parts) > 0 and doc_id % 11 <> 5""")
def extracted(t: Tables) -> DataFrame:
    """Memories by a stand-in extractor that at times fails once or twice: what fails is asked again, and what fails again is a dead letter."""
    chunks = text.hierarchy(t("documents"))
    found, _ = models.extracted(chunks, stand_in_extractor, shared_path(t.spark, "extraction"))
    return found.drop("evidence_chunk_ids")


@query("con_06", f"with {MEM} select memory_object_id from mem where quality_score >= 0.65 and (memory_type in ('PROCEDURAL', 'FAILURE', 'TOOL_USE') or length(trim(body || ' ' || title)) >= 30)")
def retention(t: Tables) -> DataFrame:
    ok = text.retained(F.lower("memory_type"), F.col("quality_score"), F.col("title"), F.col("body"))
    return t.memories().where(ok).select("memory_object_id")


_CHUNKS = "chunks as (select concat(doc_id, '-', i) as chunk_id, i * 100 as start_offset, i * 100 + 100 as end_offset from documents, range(5) r(i) where n_chars >= i * 100 + 100)"


@query("con_07", f"with {_CHUNKS}, m as (select doc_id as memory, n_chars, [concat(doc_id, '-3'), concat(doc_id, '-', doc_id % 7)] as ids from documents), e as (select memory, unnest(ids) as chunk_id, unnest([0, 1]) as i from m), s as (select memory, string_agg(start_offset || '-' || end_offset, ',' order by i) as spans from e join chunks using (chunk_id) group by memory) select memory, coalesce(spans, '0-' || n_chars) as spans from m left join s using (memory)")
def evidence(t: Tables) -> DataFrame:
    d = t("documents")
    chunks = d.select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).where("n_chars >= i * 100 + 100")
    chunks = chunks.select(F.concat("doc_id", F.lit("-"), "i").alias("chunk_id"), (F.col("i") * 100).alias("start_offset"), (F.col("i") * 100 + 100).alias("end_offset"))
    m = d.select(F.col("doc_id").alias("memory"), "n_chars", F.array(F.concat("doc_id", F.lit("-3")), F.concat("doc_id", F.lit("-"), F.col("doc_id") % 7)).alias("ids"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start_offset"], F.lit("-"), s["end_offset"])), ",")
    return text.evidence(m, chunks).select("memory", spans.alias("spans"))


@query("con_08", f"with {MEM} select memory_object_id, case when seq % 5 = 0 then 'SEMANTIC' else memory_type end as memory_type, substr(coalesce(title, 'Untitled'), 1, 200) as title, substr(body, 1, 300) as summary, case when seq % 4 in (0, 1) then case seq % 4 when 0 then 'user' else 'assistant' end end as speaker_role, case when seq % 3 = 0 then null else coalesce(cast(case when seq % 3 = 1 then 2020 end as varchar), '') || ':' || '2024' end as validity_interval from mem")
def coerced(t: Tables) -> DataFrame:
    raw = F.to_json(F.struct(F.when(F.col("seq") % 5 == 0, "nonsense").otherwise(F.lower("memory_type")).alias("type"), "title", F.col("body").alias("summary"), F.element_at(F.array(F.lit("user"), F.lit("assistant"), F.lit("robot"), F.lit("")), (F.col("seq") % 4 + 1).cast("int")).alias("speaker_role"), F.when(F.col("seq") % 3 == 1, "2020").alias("vf"), F.when(F.col("seq") % 3 != 0, "2024").alias("vt")))
    j = t.memories().select("memory_object_id", F.from_json(raw, "type string, title string, summary string, speaker_role string, vf string, vt string").alias("j"))
    kind, known = F.upper("j.type"), ["SEMANTIC", "EPISODIC", "PROCEDURAL", "FAILURE", "TOOL_USE", "WORKING_DERIVATIVE"]
    interval = F.when(F.coalesce("j.vf", "j.vt").isNotNull(), F.concat(F.coalesce("j.vf", F.lit("")), F.lit(":"), F.coalesce("j.vt", F.lit(""))))
    return j.select("memory_object_id", F.when(kind.isin(known), kind).otherwise("SEMANTIC").alias("memory_type"), F.substring(F.coalesce("j.title", F.lit("Untitled")), 1, 200).alias("title"), F.substring("j.summary", 1, 300).alias("summary"), F.when(F.col("j.speaker_role").isin("user", "assistant", "system", "external"), F.col("j.speaker_role")).alias("speaker_role"), interval.alias("validity_interval"))


@query("con_09", """with recursive e as (select vec_id as memory, vec_id % 2 as kind, embedding::double[] as vec from embeddings),
 p as (select a.memory, list(b.memory) as near from e a join e b on a.kind = b.kind and a.memory > b.memory and list_dot_product(a.vec, b.vec) >= 0.3 group by a.memory),
 o as (select e.memory, coalesce(near, []) as near, row_number() over (order by e.memory) as i from e left join p using (memory)),
 f as (select 0::bigint as i, []::bigint[] as kept, null::bigint as memory, null::bigint as duplicate_of union all
   select o.i, case when len(list_intersect(near, kept)) = 0 then list_append(kept, o.memory) else kept end, o.memory, list_max(list_intersect(near, kept)) from f join o on o.i = f.i + 1)
 select memory, duplicate_of from f where duplicate_of is not null""")
def near_duplicates(t: Tables) -> DataFrame:
    """The given vectors are far apart, so near is .3 here."""
    e = t("embeddings").select(F.col("vec_id").alias("memory"), (F.col("vec_id") % 2).alias("kind"), F.col("embedding").alias("vec"))
    return text.near_duplicates(e, 0.3)


@query("con_10", f"with {MEM} select memory_object_id, lower(memory_type) || ': ' || title || chr(10) || summary || chr(10) || body as embed_text from mem")
def embed_text(t: Tables) -> DataFrame:
    return t.memories().select("memory_object_id", F.concat(F.lower("memory_type"), F.lit(": "), F.concat_ws("\n", "title", "summary", "body")).alias("embed_text"))


def _entities(column: str = "text") -> str:
    return f"regexp_extract_all({spread(column)}, '{OUT}([A-Z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*){OUT}', 1)"


_QUOTED = """list_concat(regexp_extract_all(text, '"([^"]+)"', 1), regexp_extract_all(text, '''([^'']+)''', 1))"""


#: What is put after a text so that it has facets of each kind.
TAIL = ' GraphQL at https://ex.org/a?b=1 by @ann_1, see src/app.py and "exact words" or \'others\' MyService2.'
_TAILED = "(select doc_id, text || '{}' as text from documents)".format(TAIL.replace("'", "''"))


@query("fac_01", f"with d as (select doc_id, text, list_distinct(list_concat(list_concat({_entities()}, {_QUOTED}), list_concat(list_concat(regexp_extract_all(text, '{text.PATH}', 0), regexp_extract_all(text, '{text.URL}', 0)), regexp_extract_all(text, '{text.MENTION}', 0)))) as e from {_TAILED}) select doc_id, len(e) as n, md5(array_to_string(list_sort(e), chr(1))) as entities from d")
def entities(t: Tables) -> DataFrame:
    e = text.facet_entities(F.col("text"))
    d = t("documents").select("doc_id", F.concat("text", F.lit(TAIL)).alias("text"))
    return d.select("doc_id", e.alias("e")).select("doc_id", F.size("e").cast("long").alias("n"), F.md5(F.array_join("e", "\x01")).alias("entities"))


_SAID = "(select doc_id, concat(text, case doc_id % 6 when 0 then ' on 2026-03-15.' when 1 then ' in March 2026.' when 2 then ' and Last  week' when 3 then ' since Q1 2026' when 4 then ' Ann Lee said so, Bob told me. Ann Lee asked. We switched to it' else ' It was deprecated and fixed.' end, case when doc_id % 4 = 0 then chr(10) || '> ask' else '' end) as text from documents)"


def said(t: Tables) -> DataFrame:
    """Documents with a last sentence that has facets."""
    n = F.col("doc_id") % 6
    more = F.element_at(F.array(*[F.lit(x) for x in (" on 2026-03-15.", " in March 2026.", " and Last  week", " since Q1 2026", " Ann Lee said so, Bob told me. Ann Lee asked. We switched to it", " It was deprecated and fixed.")]), (n + 1).cast("int"))
    return t("documents").select("doc_id", F.concat("text", more, F.when(F.col("doc_id") % 4 == 0, "\n> ask").otherwise("")).alias("text"))


def _first(pattern: str, group: int) -> str:
    return f"nullif(regexp_extract(text, '(?:^|{OUT})({pattern})(?:{OUT}|$)', {group}), '')"


@query("fac_02", f"select doc_id, coalesce({_first(chr(92) + 'd{4}-' + chr(92) + 'd{2}(?:-' + chr(92) + 'd{2})?', 1)}, {_first('(?:' + text.MONTHS + ')' + chr(92) + 's+' + chr(92) + 'd{4}', 1)}, {_first('(?i:last' + chr(92) + 's+(?:week|month|year|quarter)|yesterday|today|this' + chr(92) + 's+(?:week|month|year|quarter)|Q[1-4])', 1)}) as mentioned_at from {_SAID}")
def mentioned(t: Tables) -> DataFrame:
    return said(t).select("doc_id", text.mentioned_at(F.col("text")).alias("mentioned_at"))


@query("fac_03", f"select doc_id, case when regexp_matches(text, '(^|\\n)>\\s') then 'user' else 'assistant' end as speaker_role from {_SAID}")
def speaker(t: Tables) -> DataFrame:
    return said(t).select("doc_id", text.speaker_role(F.col("text")).alias("speaker_role"))


@query("fac_04", "select doc_id, case " + " ".join(f"when {bounded(p.replace(chr(92) + 'b', ''))} then '{s}'" for s, p in text.STANCES.items()) + f" end as stance from {_SAID}")
def stances(t: Tables) -> DataFrame:
    return said(t).select("doc_id", text.stance(F.col("text")).alias("stance"))


@query("fac_05", f"select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all({spread('text')}, '{OUT}([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)?)\\s+(?:said|told|mentioned|suggested|noted|added|explained|asked|replied){OUT}', 1))), ',') as actors from {_SAID}")
def acting(t: Tables) -> DataFrame:
    # two blanks in a row stand for one in the check's text, so names are compared without inner blanks
    return said(t).select("doc_id", F.array_join(F.array_sort(F.transform(text.actors(F.col("text")), lambda x: F.regexp_replace(x, r"\s+", "  "))), ",").alias("actors"))


def common_words(t: Tables) -> DataFrame:
    """Lower-case words of the benchmark stand for the stop words."""
    return t("benchmark").select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("word")).where("word <> ''").distinct()


_COMMON = "common as (select distinct unnest(string_split_regex(lower(text), '[^a-z]+')) as word from benchmark)"
#: Separators are doubled for the patterns, and halved again in what they find.
_NAMES = f"""list_concat(regexp_extract_all({spread('text')}, '{OUT}([A-Z][a-z]{{1,19}}){OUT}', 1),
    list_transform(regexp_extract_all({spread('text')}, '{OUT}([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+){OUT}', 1), lambda x: regexp_replace(x, '(\\s)\\s', '\\1', 'g')))"""
_CAND = f"""c0 as (select doc_id, name, count(*) as n from (select doc_id, unnest({_NAMES}) as name from documents) group by 1, 2 having count(*) >= 3),
 c as (select * from c0 where not exists (select 1 from common where list_contains(string_split_regex(lower(name), '\\s+'), word)))"""


@query("ent_01", f"with {_COMMON}, {_CAND} select * from c")
def candidates(t: Tables) -> DataFrame:
    return text.candidates(t("documents"), common_words(t))


#: What is put after a text, by doc_id % 5, so that its first capitalised word X has signals of each kind.
SIGNALS = (
    "\nX said hey X she\nthanks X and dear X",
    "\n> X: yes\nX: no\n[X] well\nhe is\n\n\nX wrote",
    "\nbuilding X and pip install X; the X pipeline\nsee X.py and X-core or X-v2 X v3",
    "\nimport X\nX.json X X\ntheir\n\n\nnone",
    "\n\"X said\" X thinks X knows\nfar\nfar\nher",
)


def signalled(t: Tables) -> DataFrame:
    tail = F.element_at(F.array(*[F.lit(x) for x in SIGNALS]), (F.col("doc_id") % 5 + 1).cast("int"))
    return t("documents").select("doc_id", F.concat("text", F.replace(tail, F.lit("X"), F.regexp_extract("text", r"\b([A-Z][a-z]{1,19})\b", 1))).alias("text"))


def signals(t: Tables) -> DataFrame:
    """Each document's own candidates against its whole text."""
    d = signalled(t)
    return sg.entity_signals(text.candidates(d, common_words(t), 2), d)


def _matches(pattern: str, name: str = "name", column: str = "text") -> str:
    """How often a pattern around {name} matches, in SQL. Where the pattern begins or ends with a word, separators are doubled, so that neighbouring matches have one each."""
    body = pattern.replace("\\w", "[\\p{L}\\p{N}_]")
    ends, begins = body.endswith("\\b"), body.startswith("\\b")
    core = body.removeprefix("\\b").removesuffix("\\b")
    whole = ends and begins and not any(x in core for x in ("\\.", "-"))  # a doubled point or dash would be another text
    core = (f"(?:^|{OUT})" if begins else "") + core + (f"(?:{OUT}|$)" if ends else "")
    parts = [("'" + p.replace("'", "''") + "'") for p in core.split("{name}")]
    literal = f"regexp_replace({name}, '(\\s)', '\\1\\1', 'g')" if whole else name
    return f"len(regexp_extract_all({spread(column) if whole else column}, '(?im)' || {parts[0]} || {literal} || {parts[1]}))"


_sum = lambda ps: " + ".join(_matches(p) for p in ps)
_fired = lambda ps: " + ".join(f"({_matches(p)} > 0)::int" for p in ps)
_TAIL = "replace(case doc_id % 5 " + " ".join(f"when {k} then '" + x.replace("'", "''") + "'" for k, x in enumerate(SIGNALS)) + f" end, 'X', regexp_extract({spread('text')}, '{OUT}([A-Z][a-z]{{1,19}}){OUT}', 1))"
_SIGNALS = f"""{_COMMON},
 sd as (select doc_id, text || {_TAIL} as text from documents),
 s0 as (select doc_id, name, count(*) as n from (select doc_id, unnest({_NAMES}) as name from sd) group by 1, 2 having count(*) >= 2),
 s1 as (select doc_id, name, n, text from s0 join sd using (doc_id) where not exists (select 1 from common where list_contains(string_split_regex(lower(name), '\\s+'), word))),
 li as (select doc_id, unnest(string_split(lower(text), chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from sd),
 wi as (select doc_id, line, string_agg(line, ' ') over (partition by doc_id order by i rows between 2 preceding and 2 following) as around from li),
 pr as (select doc_id, name, count(*) as pronoun from s1 join wi using (doc_id) where contains(line, lower(name)) and {bounded('she|her|hers|he|him|his|they|them|their', 'around')} group by 1, 2),
 s2 as (
   select doc_id, name, n, {_sum(sg.DIALOGUE)} as dialogue, {_sum(sg.PERSON_VERBS)} as action, coalesce(pronoun, 0) as pronoun, {_sum(sg.DIRECT)} as direct,
     {_sum(sg.PROJECT_VERBS)} as project, {_sum(sg.VERSIONED)} as versioned, {_sum(sg.CODE)} as code,
     {_fired(sg.DIALOGUE)} as d, {_fired(sg.PERSON_VERBS)} as v
   from s1 left join pr using (doc_id, name)
 ),
 sn as (
   select doc_id, name, n, dialogue, action, pronoun, direct, project, versioned, code,
     (d > 0)::int + (v > 0 and d < 3)::int + (pronoun > 0 and d + v < 3)::int + (direct > 0 and d + v + (pronoun > 0)::int < 3)::int as kinds
   from s2
 )"""
_TYPED = f"""{_SIGNALS},
 sp as (select *, 3 * dialogue + 2 * action + 2 * pronoun + 4 * direct as ps, 2 * project + 3 * versioned + 3 * code as prs from sn),
 sr as (select *, case when ps + prs = 0 then 0.5 else ps / (ps + prs) end as ratio, ps + prs = 0 as none from sp),
 ty as (
   select *, case when none then 'uncertain' when ratio >= 0.7 and kinds >= 2 and ps >= 5 then 'person' when ratio >= 0.7 then 'uncertain' when ratio <= 0.3 then 'project' else 'uncertain' end as type,
     round(case when none then least(0.4, n / 50) when ratio >= 0.7 and kinds >= 2 and ps >= 5 then least(0.99, 0.5 + ratio * 0.5) when ratio >= 0.7 then 0.4
       when ratio <= 0.3 then least(0.99, 0.5 + (1 - ratio) * 0.5) else 0.5 end::double, 2) as confidence
   from sr
 )"""


@query("ent_02", f"with {_SIGNALS} select * from sn")
def entity_signals(t: Tables) -> DataFrame:
    return signals(t)


@query("ent_03", """with s as (select event_id as doc_id, concat('n', user_id) as name, cast(floor(value) as bigint) % 40 as n, event_id % 3 as dialogue, event_id % 4 as action, event_id % 2 as pronoun, event_id % 5 // 3 as direct, event_id % 7 as project, event_id % 2 as versioned, 0 as code from events),
 t as (select *, 3 * dialogue + 2 * action + 2 * pronoun + 4 * direct as ps, 2 * project + 3 * versioned as prs, (dialogue > 0)::int + (action > 0)::int + (pronoun > 0)::int + (direct > 0)::int as kinds from s),
 r as (select *, case when ps + prs = 0 then 0.5 else ps / (ps + prs) end as ratio from t)
 select doc_id, name, case when ps + prs = 0 then 'uncertain' when ratio >= 0.7 and kinds >= 2 and ps >= 5 then 'person' when ratio >= 0.7 then 'uncertain' when ratio <= 0.3 then 'project' else 'uncertain' end as type,
 round(case when ps + prs = 0 then least(0.4, n / 50) when ratio >= 0.7 and kinds >= 2 and ps >= 5 then least(0.99, 0.5 + ratio * 0.5) when ratio >= 0.7 then 0.4 when ratio <= 0.3 then least(0.99, 0.5 + (1 - ratio) * 0.5) else 0.5 end::double, 2) as confidence from r""")
def classification(t: Tables) -> DataFrame:
    i = F.col("event_id")
    s = t("events").select(i.alias("doc_id"), F.concat(F.lit("n"), "user_id").alias("name"), (F.floor("value") % 40).alias("n"), (i % 3).alias("dialogue"), (i % 4).alias("action"), (i % 2).alias("pronoun"), F.floor(i % 5 / 3).alias("direct"), (i % 7).alias("project"), (i % 2).alias("versioned"), F.lit(0).alias("code"))
    return text.classified(s).select("doc_id", "name", "type", "confidence")


@query("ent_04", f"""with {_TYPED},
 k as (select doc_id, name, type, confidence, row_number() over (partition by type order by confidence desc, n desc, doc_id, name) as rank from ty)
 select * from k where rank <= case type when 'person' then 15 when 'project' then 10 else 8 end""")
def ranked_entities(t: Tables) -> DataFrame:
    return text.top_entities(text.classified(signals(t)), {"person": 15, "project": 10, "uncertain": 8}).select("doc_id", "name", "type", "confidence", "rank")


@query("ent_05", "with w as (select c_custkey, case c_custkey % 4 when 0 then upper(n_name) when 1 then r_name when 2 then 'Alias' || c_nationkey else 'zzz' end as word, n_name from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey) select c_custkey, word, case c_custkey % 4 when 0 then 'person' when 1 then 'project' when 2 then 'person' else 'unknown' end as type, case c_custkey % 4 when 0 then n_name when 1 then word when 2 then n_name else word end as name, case c_custkey % 4 when 0 then 0.9 when 1 then 1.0 when 2 then 0.9 else 0.0 end as confidence from w")
def registry(t: Tables) -> DataFrame:
    nation = t("nation")
    people = nation.select(F.col("n_name").alias("name"), F.explode(F.array("n_name", F.concat(F.lit("alias"), "n_nationkey"))).alias("alias"), F.lit(0.9).alias("confidence"))
    c = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey") % 4
    words = c.select("c_custkey", F.when(k == 0, F.upper("n_name")).when(k == 1, F.col("r_name")).when(k == 2, F.concat(F.lit("Alias"), "c_nationkey")).otherwise("zzz").alias("word"))
    none = people.select("name", F.lit("person").alias("type"), "confidence").where("false")
    return text.lookup(words, people, t("region").select(F.col("r_name").alias("name")), none)


_hits = lambda ps: " + ".join(f"({_matches(p, 'lower(word)', 'low').replace('(?im)', '(?i)')} > 0)::int" for p in ps)


@query("ent_06", f"""with w as (select doc_id, regexp_extract({spread('text')}, '{OUT}([A-Z][a-z]+){OUT}', 1) as word, lower(text) as low from documents),
 h as (select doc_id, word, {_hits(text.PERSON_CONTEXT)} as p, {_hits(text.CONCEPT_CONTEXT)} as c from w where word <> '')
 select doc_id, word, case when c > p then 'concept' else 'person' end as type,
   round(case when p > c then least(0.95, 0.7 + p * 0.1) when c > p then least(0.9, 0.7 + c * 0.1) else 0.7 end::double, 4) as confidence from h""")
def disambiguation(t: Tables) -> DataFrame:
    d = t("documents").select("doc_id", F.regexp_extract("text", r"\b([A-Z][a-z]+)\b", 1).alias("word"), "text").where("word <> ''")
    return d.select("doc_id", "word", text.disambiguated(F.col("word"), F.col("text")).alias("r")).select("doc_id", "word", "r.type", "r.confidence")


@query("ent_07", "with a as (select n_name as name, unnest([n_name, 'Alias' || n_nationkey]) as alias from nation) select name, alias, lower(alias) in (select lower(r_name) from region) as ambiguous from a")
def seeded(t: Tables) -> DataFrame:
    a = t("nation").select(F.col("n_name").alias("name"), F.explode(F.array("n_name", F.concat(F.lit("Alias"), "n_nationkey"))).alias("alias"))
    common = t("region").select(F.lower("r_name").alias("_c"))
    return a.join(common, F.lower("alias") == F.col("_c"), "left").select("name", "alias", F.col("_c").isNotNull().alias("ambiguous"))


@query("ent_08", f"with {_TYPED} select name, max(confidence) as confidence from ty where type = 'person' and confidence >= 0.75 and lower(name) not in (select lower(n_name) from nation) group by name")
def learned(t: Tables) -> DataFrame:
    known = t("nation").select(F.lower("n_name").alias("_k"))
    people = text.classified(signals(t)).where("type = 'person' and confidence >= 0.75")
    return people.join(known, F.lower("name") == F.col("_k"), "left_anti").select("name", "confidence").groupBy("name").agg(F.max("confidence").alias("confidence"))


#: People are known by the first two words of items, one of them capitalised as an alias of its own.
_PEOPLE = "pe as (select distinct unnest([name, split_part(name, ' ', 1)]) as alias, name from (select regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+') as name from benchmark) where length(name) > 6)"


@query("ent_09", f"""with {ASKED}, w as (select query_id, unnest(regexp_extract_all({spread('query')}, '{OUT}([A-Z][a-z]{{2,15}}){OUT}', 1)) as word from asked), {_COMMON}, {_PEOPLE},
 k as (select distinct query_id, name from asked, pe where regexp_matches({spread('lower(query)')}, '{OUT}' || replace(lower(alias), ' ', '  ') || '{OUT}'))
 select query_id, 'unknown' as kind, word as name from w where lower(word) not in (select word from common) group by all union all select query_id, 'person', name from k""")
def people_and_unknown_words(t: Tables) -> DataFrame:
    """Known people in a query, and capitalised words that are neither common nor known."""
    w = t.asked().select("query_id", F.explode(F.regexp_extract_all("query", F.lit(r"\b([A-Z][a-z]{2,15})\b"), F.lit(1))).alias("name")).distinct()
    unknown = w.join(common_words(t).withColumnRenamed("word", "_c"), F.lower("name") == F.col("_c"), "left_anti")
    name = t("benchmark").select(F.regexp_extract("text", "^[A-Za-z]+ [A-Za-z]+", 0).alias("name")).where("length(name) > 6")
    people = name.select("name", F.explode(F.array("name", F.split("name", " ")[0])).alias("alias")).distinct()
    known = text.known_people(t.asked().select("query_id", "query"), people)
    return unknown.select("query_id", F.lit("unknown").alias("kind"), "name").unionByName(known.select("query_id", F.lit("person").alias("kind"), "name"))


_SKIP = " or ".join(f"regexp_matches(token, '{r}')" for r in (r"\d", r"[A-Z][a-z]+[A-Z]", r"^[A-Z_@#$%^&*()+=\[\]{}|<>?.:/\\]+$", r"[-_]", r"(?i)https?://|www\.|/Users/|~/|\.[a-z]{2,4}$", r"[`*_#{}\[\]\\]", "^[A-Z]"))


@query("spl_01", f"with k as (select conv_id, turn, unnest(string_split_regex(text, '\\s+')) as raw from conversations where role = 'user'), s as (select distinct regexp_replace(raw, '[.,!?;:]+$', '') as token from k) select token, length(token) < 4 or {_SKIP} as skipped from s where token <> ''")
def skipped_tokens(t: Tables) -> DataFrame:
    k = t("conversations").where("role = 'user'").select(F.explode(F.split("text", r"\s+")).alias("raw"))
    s = k.select(F.regexp_replace("raw", r"[.,!?;:]+$", "").alias("token")).where("token <> ''").distinct()
    return s.select("token", text.spelling_skipped(F.col("token"), F.array().cast("array<string>")).alias("skipped"))


def dictionary(t: Tables) -> DataFrame:
    """Words of the benchmark by count stand for the dictionary."""
    return t("benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("length(word) >= 4").groupBy("word").agg(F.count("*").alias("n"))


@query("spl_02", """with d as (select word, count(*) as n from (select unnest(string_split_regex(lower(text), '[^a-z]+')) as word from benchmark) where length(word) >= 4 group by word),
 t as (select distinct unnest(string_split_regex(lower(text), '[^a-z]+')) as token from conversations where role = 'user'),
 c as (select token, word, levenshtein(token, word) as edits, n from t join d on abs(length(token) - length(word)) <= 3 where length(token) >= 4 and token not in (select word from d)),
 r as (select *, row_number() over (partition by token order by edits, n desc, word) as k from c where edits <= case when length(token) <= 7 then 2 else 3 end)
 select token, word, edits from r where k = 1""")
def corrected(t: Tables) -> DataFrame:
    tokens = t("conversations").where("role = 'user'").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("token")).where("length(token) >= 4").distinct()
    return text.corrections(tokens, dictionary(t))


@query("spl_03", "select conv_id, turn, case when turn % 2 = 0 then concat('> ', trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) else text end as line from conversations")
def user_lines(t: Tables) -> DataFrame:
    """Only lines that begin with > are touched; here the touch is white space and case."""
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("> "), "text")).otherwise(F.col("text"))
    c = t("conversations").withColumn("raw", raw)
    return c.select("conv_id", "turn", F.when(F.startswith(F.trim("raw"), F.lit(">")), F.concat(F.lit("> "), normalized(F.expr("substr(raw, 3)")))).otherwise(F.col("raw")).alias("line"))


@query("ent_11", f"""with {MEM},
 f as (select split_part(source_path, '/', 3) || '-' || tenant_id as project, source_path as file, regexp_matches(source_path, '[.]md$') as prose from mem where not regexp_matches(source_path, '[.]jsonl$') and seq % 4 > 0),
 r as (select *, count(*) filter (prose) over (partition by project) >= 3 as enough, row_number() over (partition by project order by prose desc, file) as rank from (select distinct * from f))
 select project, file, rank from r where (prose or not enough) and rank <= 10""")
def prose_files(t: Tables) -> DataFrame:
    """The files of each project, here a session of a tenant, that entities are looked for in."""
    m = t.memories().where("seq % 4 > 0")
    f = m.select(F.concat(F.split("source_path", "/")[2], F.lit("-"), "tenant_id").alias("project"), F.col("source_path").alias("file")).distinct()
    return ignore.prose_first(f)
