"""Which files of a project are read: ignore files of any folder, folders that are always skipped, paths that are included in spite of them.

Ignore files become a table of rules by folder. A path meets the rules of its ancestors by an equi join on the folder; of the rules that
match, the last one of the deepest folder decides. A folder that is out takes all that lies in it with it, whatever the rules there
say. All paths lie in the root, so the join is dealt by a share of the path's hash as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestore.operators.ingest import READABLE, SKIPPED

#: Files that are never read: ignore and lock files, and the engine's own settings.
SKIPPED_FILES = ("lodestore.yaml", "lodestore.yml", ".gitignore", "package-lock.json")
#: Parts that the paths of one folder are dealt over.
SALTS = 16
RULES = "base string, pos int, regex string, folders boolean, negated boolean"


def one_part(glob: str) -> str:
    """A glob without `/` as a pattern for one part of a path: `*`, `?`, `[ab]`, `[a-c]`, `[!ab]`; an unclosed `[` is itself."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := glob.find("]", i + 1 + glob.startswith("!", i))) > 0:
            inner, i = glob[i:end], end + 1
            out += one_of(inner)
        else:
            out += literal(c)
    return out


def literal(c: str) -> str:
    return c if c.isalnum() or ord(c) > 127 else "\\" + c


def one_of(inner: str) -> str:
    """The inside of `[]` as a class; a range that runs backwards has no members."""
    negated = inner.startswith("!")
    inner = inner[negated:]
    members, k = "", 0
    while k < len(inner):
        if inner[k + 1 : k + 2] == "-" and k + 2 < len(inner):
            if inner[k] <= inner[k + 2]:
                members += literal(inner[k]) + "-" + literal(inner[k + 2])
            k += 3
        else:
            members += literal(inner[k])
            k += 1
    if negated:
        return f"[^/{members}]"
    return f"[{members}]" if members else "(?!)"


def parsed(line: str) -> tuple[str, bool, bool] | None:
    """(regex, folders alone, negated) of a line of an ignore file; None for one without a rule.

    The regex looks at a path that ends with `/` after each part. A rule with a `/` at its start or within begins at the
    folder of its file and holds for all that lies in what it matches; `**` stands for any number of parts. Others hold for any part.
    """
    line = line.strip()
    if line.startswith(("\\#", "\\!")):
        line = line[1:]
    elif not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    anchored = line.startswith("/")
    line = line.lstrip("/")
    folders = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    parts = line.split("/")
    if anchored or len(parts) > 1:
        return "^" + "".join("(?:[^/]+/)*" if p == "**" else one_part(p) + "/" for p in parts), folders, negated
    return "(?:^|/)" + one_part(line) + "/", folders, negated


def rules_of(ignore_files: DataFrame) -> DataFrame:
    """RULES of ignore files (base, content): base is the folder, '' for the root. Null contents have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(base, k, *rule) for base, content in zip(b["base"], b["content"]) for k, line in enumerate((content or "").splitlines()) if (rule := parsed(line))]
            yield pd.DataFrame(rows, columns=["base", "pos", "regex", "folders", "negated"])

    return ignore_files.select("base", "content").mapInPandas(run, RULES)


def above(path: Column) -> Column:
    """The folders that path lies in, the root ('') first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def ignored(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """(entry): those of entries (entry, is_dir; each once) that the rules keep out. Rules of the folder itself aren't asked about it, those of its ancestors are."""
    by_folder = rules.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("pos", "regex", "folders", "negated"))).alias("rules"))  # a file's lines
    by_folder = by_folder.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    e = entries.select("entry", "is_dir", F.explode(above(F.col("entry"))).alias("base"), F.pmod(F.xxhash64("entry"), F.lit(SALTS)).cast("int").alias("salt"))
    j = e.join(by_folder, ["base", "salt"])
    rest = F.when(F.col("base") == "", F.col("entry")).otherwise(F.substr(F.col("entry"), F.length("base") + 2))
    j = j.withColumn("rest", F.concat(rest, F.lit("/")))
    j = j.withColumn("folder", F.when(F.col("is_dir"), F.col("rest")).otherwise(F.regexp_replace("rest", r"[^/]*/$", "")))
    hits = F.filter("rules", lambda r: F.when(r["folders"], (F.col("folder") != "") & F.rlike(F.col("folder"), r["regex"])).otherwise(F.rlike(F.col("rest"), r["regex"])))
    last = j.withColumn("last", F.try_element_at(hits, F.lit(-1))).where("last is not null")
    return last.groupBy("entry").agg(F.max_by(~F.col("last.negated"), F.length("base")).alias("out")).where("out").select("entry")


def included(paths: DataFrame) -> DataFrame:
    """(path): stated paths without blanks and slashes around them, `.` parts and doubled slashes, each once."""
    p = F.trim("path")
    p = F.regexp_replace(F.regexp_replace(p, r"/+", "/"), r"(?<=^|/)\.(/|$)", "")
    return paths.select(F.regexp_replace(p, r"^/+|/+$", "").alias("path")).where("path <> ''").distinct()


def forced(entries: DataFrame, includes: DataFrame) -> DataFrame:
    """(entry, exact): those of entries (entry) that are included: stated (exact), in a stated folder, or a folder that leads to what is stated."""
    salt = F.pmod(F.xxhash64("entry"), F.lit(SALTS)).cast("int").alias("salt")
    e = entries.select("entry", F.explode(F.array_append(above(F.col("entry")), F.col("entry"))).alias("path"), salt).where("path <> ''")
    own = e.join(includes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["path", "salt"])
    own = own.groupBy("entry").agg(F.bool_or(F.col("path") == F.col("entry")).alias("exact"))
    leads = includes.select(F.explode(above(F.col("path"))).alias("entry")).where("entry <> ''").distinct()
    found = own.unionByName(entries.select("entry").join(leads, "entry", "left_semi").withColumn("exact", F.lit(False)))
    return found.groupBy("entry").agg(F.bool_or("exact").alias("exact"))


def scanned(files: DataFrame, rules: DataFrame | None, includes: DataFrame) -> DataFrame:
    """(file): which of files (file: paths from the project's root, each once) are read.

    rules None: ignore files don't count. A null file is not read. An included path needs no readable extension if it is stated itself.
    """
    f = files.where("file is not null").select(F.col("file").alias("entry"), F.lit(False).alias("is_dir"))
    d = f.select(F.explode(above(F.col("entry"))).alias("entry")).where("entry <> ''").distinct().withColumn("is_dir", F.lit(True))
    entries = f.unionByName(d)
    inc = included(includes)
    state = entries.join(forced(entries, inc), "entry", "left")
    if rules is not None:
        state = state.join(ignored(entries, rules).withColumn("out", F.lit(True)), "entry", "left")
    else:
        state = state.withColumn("out", F.lit(False))
    out, kept = F.coalesce("out", F.lit(False)), F.col("exact").isNotNull()
    base = name(F.col("entry"))
    gone = state.where(F.col("is_dir") & ~kept & (out | base.isin(*SKIPPED) | base.endswith(".egg-info"))).select(F.col("entry").alias("folder"))
    under = d.select(F.col("entry").alias("parent"), F.explode(F.array_append(above(F.col("entry")), F.col("entry"))).alias("folder")).join(gone, "folder", "left_semi").select("parent").distinct()
    suffix = F.lower(F.regexp_extract(base, r"^.+(\.[^.]+)$", 1))
    ok = (kept | ~base.isin(*SKIPPED_FILES)) & (suffix.isin(*READABLE) | F.coalesce("exact", F.lit(False))) & (kept | ~out)
    return state.where(~F.col("is_dir") & ok).withColumn("parent", parent(F.col("entry"))).join(under, "parent", "left_anti").select(F.col("entry").alias("file"))


#: Prose extensions and the others that names are looked for in; how many prose files make others needless; files at most.
PROSE = (".txt", ".md", ".rst", ".csv")
OTHER_TEXT = (".py", ".js", ".ts", ".json", ".yaml", ".yml", ".toml", ".sh", ".rb", ".go", ".rs")
PROSE_ENOUGH, FILES_READ = 3, 10


def prose_first(files: DataFrame, most: int = FILES_READ) -> DataFrame:
    """(project, file, rank) of files (project, file) that entities are looked for in: prose if a project has PROSE_ENOUGH such files, else prose and then other readable ones.

    Files in skipped folders don't count. `most` of a project, by path; each task keeps its own first ones, and a project's
    prose is counted to PROSE_ENOUGH from these alone.
    """
    suffix = F.lower(F.regexp_extract(name(F.col("file")), r"^.+(\.[^.]+)$", 1))
    skipped = F.exists(F.slice(F.split("file", "/"), 1, F.size(F.split("file", "/")) - 1), lambda p: p.isin(*SKIPPED))
    f = files.where(suffix.isin(*PROSE, *OTHER_TEXT) & ~skipped).withColumn("prose", suffix.isin(*PROSE))
    place = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("prose"), "file"))
    first = f.withColumn("rank", place).where(F.col("rank") <= max(most, PROSE_ENOUGH))
    enough = F.count_if("prose").over(Window.partitionBy("project")) >= PROSE_ENOUGH
    return first.withColumn("enough", enough).where((F.col("prose") | ~F.col("enough")) & (F.col("rank") <= most)).select("project", "file", F.col("rank").cast("long").alias("rank"))
