"""Secret scans over an incremental blob ledger, in DataFrame functions alone.

Each version of a text is a blob, addressed by the SHA-256 of its content. A blob is scanned once for each
rule version; the ledger remembers which pairs of blob and rule version have been scanned, so that a later
run scans unseen pairs only. Findings are joined back to every path (document) that holds the blob.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.llm.common import salted_join, scratch_path


@dataclass(frozen=True)
class Rule:
    """A pattern; what it finds counts if group `group` has `least` characters or more. hint: text that every match holds."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base kinds in their listed order. Runs are maximal, so the counted forms of `access` and `hex` match what an open run with a later length test does.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20, ("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
#: What the method adds: key blocks and tokens of a public, documented form. Each pattern is found in linear time and without recursion.
ADDED = (
    Rule("pem", 2, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20, ("-----BEGIN ",)),
    Rule("jwt", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30, ("eyJ",)),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
)
RULES = BASE + ADDED
#: Spans of one rule, as the ledger has them; and of all rules, with the rule's place in the list of rules.
PLACES, SPANS = "array<struct<start:int,end:int>>", "array<struct<start:int,k:int,end:int>>"
#: A ledger: the rules that were applied to a blob, each with what it found.
LEDGER = f"blob binary, findings array<struct<rule:string,spans:{PLACES}>>"
#: Arrivals of the query: each goes through the ledger that the ones before have written.
ARRIVALS = 2


def rule_spans(text: Column, rule: Rule) -> Column:
    """PLACES of the rule's matches in text, leftmost and non-overlapping, in code points; matches that fail the length test are dropped."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), hits.alias("hit"), sized.alias("sized"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["sized"]) >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(PLACES).alias("out"))
    found = F.aggregate(parts, start, step, lambda acc: acc["out"])
    may = reduce(lambda a, b: a | b, [F.contains(text, F.lit(h)) for h in rule.hint]) if rule.hint else F.lit(True)
    return F.when(may & text.rlike(rule.pattern), found).otherwise(F.array().cast(PLACES))


def address(text: Column) -> Column:
    """The content's address: the SHA-256 of the text; a null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New LEDGER rows for versions (text): one for each blob with a rule version that the ledger doesn't have for it.

    Pairs without findings are recorded too, so that they aren't scanned again. None: nothing was scanned yet.
    """
    todo = versions.select(address(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    unseen = {r: F.lit(True) for r in rules}
    if ledger is not None:
        known = ledger.select("blob", F.explode(F.transform("findings", lambda f: f["rule"])).alias("rule")).where(F.col("rule").isin([r.key for r in rules]))
        todo = todo.join(known.groupBy("blob").agg(F.collect_set("rule").alias("seen")), "blob", "left")  # as many as there are rules
        unseen = {r: ~F.coalesce(F.array_contains("seen", r.key), F.lit(False)) for r in rules}
        todo = todo.where(reduce(lambda a, b: a | b, unseen.values()))
    made = [F.when(unseen[r], F.struct(F.lit(r.key).alias("rule"), rule_spans(F.col("text"), r).alias("spans"))) for r in rules]
    return todo.select("blob", F.array_compact(F.array(*made)).alias("findings"))


def update_ledger(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger at path (made if it isn't there) hasn't seen of versions, appends it, and returns the whole ledger.

    A run that is lost before its append commits leaves the ledger as it was; the next run scans the same pairs.
    """
    spark = versions.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    scan(versions, spark.read.schema(LEDGER).parquet(path) if there else None, rules).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans): SPANS of each blob in which any of rules found something, by start, then by the rules' order; over all rows of the ledger."""
    place = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.key, k)])
    flat = ledger.select("blob", F.explode("findings").alias("f")).where(F.col("f.rule").isin([r.key for r in rules]) & (F.size("f.spans") > 0))
    one = F.transform("f.spans", lambda s: F.struct(s["start"].alias("start"), place[F.col("f.rule")].alias("k"), s["end"].alias("end")))
    return flat.select("blob", one.alias("s")).groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("spans"))


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, spans): for every row of versions (path, text) its blob's findings, whenever they were made; null if there are none."""
    return salted_join(versions.select("path", address(F.col("text")).alias("blob")), findings(ledger, rules), "blob", F.col("path").cast("string")).select("path", "spans")


def span_string(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame, arrivals: int = ARRIVALS) -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    All rows go through one ledger, in `arrivals` parts by id hash, so that a text that came before isn't
    scanned again. Null and empty texts have no findings: counts 0, spans '' and the SHA-256 of ''. Repeated rows
    stay repeated, a null doc_id keeps its row, other columns are not looked at.
    """
    versions = docs.select(F.col("doc_id").alias("path"), "text")
    ledger = scratch_path(docs.sparkSession, "secret-ledger")
    for k in range(arrivals):
        known = update_ledger(versions.where(F.pmod(F.xxhash64("path"), F.lit(arrivals)) == k), ledger)
    found = findings_by_path(versions, known)
    spans = F.coalesce("spans", F.array().cast(SPANS))
    base = F.filter(spans, lambda s: s["k"] < len(BASE))
    count = lambda k: F.size(F.filter(spans, lambda s: s["k"] == k)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"),
        *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
        F.sha2(span_string(base).cast("binary"), 256).alias("base_sha256"),
        span_string(spans).alias("spans"),
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with each span replaced by mark; overlapping spans are replaced as one."""

    def step(acc: Column, s: Column) -> Column:
        keep = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], keep, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def redact_documents(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """docs (with text, perhaps n_chars) with secrets replaced in text. Each blob is scanned once; documents without findings are unchanged.

    ledger: where one is kept from run to run. The scan returns to the rows by content address, so nulls and repeated
    rows do no harm. A row travels as one struct, so any column names are fine.
    """
    found = findings(update_ledger(docs.select("text"), ledger or scratch_path(docs.sparkSession, "secret-ledger")))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), address(F.col("text")).alias("blob"))
    joined = salted_join(keyed, found, "blob", F.xxhash64("row"))
    row, none = F.col("row"), F.col("spans").isNull()
    text = F.when(none, row["text"]).otherwise(redacted(row["text"], F.col("spans")))
    new = {"text": text, "n_chars": F.when(none, row["n_chars"]).otherwise(F.length(text).cast("long")) if "n_chars" in docs.columns else None}
    return joined.select(*[new.get(c, row[c]).alias(c) for c in docs.columns])


#: Kind: pattern, group that is the match, group whose length counts, least length. SQL's patterns have no lookbehind, so that of `jwt` takes in the character before.
_KINDS_SQL = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 0, 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 0, 20),
    "hex": (r"[0-9a-f]+", 0, 0, 24),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, 20),
    "jwt": (r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 1, 30),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, 40),
}


def oracle_sql() -> str:
    kinds = []
    for k, (kind, (pattern, match, sized, least)) in enumerate(_KINDS_SQL.items()):
        kinds.append(f"""
        select rid, {k} as k, '{kind}' as kind, string_split_regex(t, '{pattern}') as gaps, regexp_extract_all(t, '{pattern}', 0) as whole,
               regexp_extract_all(t, '{pattern}', {match}) as hits, regexp_extract_all(t, '{pattern}', {sized}) as sized, {least} as least
        from d where regexp_matches(t, '{pattern}')""")
    return f"""
    with d as (select doc_id, coalesce(text, '') as t, row_number() over () as rid from documents),
    m as ({" union all ".join(kinds)}),
    i as (select *, unnest(range(1, len(hits) + 1)) as i from m),
    s as (select rid, k, kind, len(hits[i]) as n,
                 list_sum(list_transform(gaps[1:i], lambda x: len(x))) + list_sum(list_transform(whole[1:i], lambda x: len(x))) - len(hits[i]) as start
          from i where len(sized[i]) >= least),
    a as (select rid, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access,
                 count(*) filter (where kind = 'hex') as n_hex,
                 string_agg(kind || ':' || start::bigint || ':' || (start + n)::bigint, ',' order by start, k) filter (where k < 3) as base,
                 string_agg(kind || ':' || start::bigint || ':' || (start + n)::bigint, ',' order by start, k) as spans
          from s group by rid)
    select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
           sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from d left join a using (rid)"""
