"""Ignore files and forced paths against a walk over a tree, folder by folder."""

import fnmatch
import random

import pytest

from lodestore.operators import ignore
from lodestore.operators.ingest import READABLE, SKIPPED


def rule_of(line):
    line = line.strip()
    if line[:2] in ("\\#", "\\!"):
        line = line[1:]
    elif not line or line[0] == "#":
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    rooted = line.startswith("/")
    line = line.lstrip("/")
    folders = line.endswith("/")
    line = line.rstrip("/")
    return (line.split("/"), rooted, folders, negated) if line else None


def leads(path, pattern):
    """Whether pattern's parts are the first ones of path."""
    if not pattern:
        return True
    if not path:
        return all(p == "**" for p in pattern)
    if pattern[0] == "**":
        return leads(path, pattern[1:]) or leads(path[1:], pattern)
    return fnmatch.fnmatchcase(path[0], pattern[0]) and leads(path[1:], pattern[1:])


def hit(rule, path, is_dir):
    pattern, rooted, folders, _ = rule
    if folders and not is_dir:
        path = path[:-1]
    if not path:
        return False
    return leads(path, pattern) if rooted or len(pattern) > 1 else any(fnmatch.fnmatchcase(p, pattern[0]) for p in path)


def is_out(path, is_dir, files):
    """path (parts) against the rules of its ancestors, the root's first."""
    out = False
    for k in range(len(path)):
        for line in files.get("/".join(path[:k]), "").splitlines():
            rule = rule_of(line)
            if rule and hit(rule, path[k:], is_dir):
                out = not rule[3]
    return out


def walked(paths, files, includes, respect=True):
    inc = {"/".join(p for p in i.strip().split("/") if p not in ("", ".")) for i in includes} - {""}
    forced = lambda p: any(p == i or p.startswith(i + "/") or i.startswith(p + "/") for i in inc)
    out = set()
    for path in paths:
        parts = path.split("/")
        ok = True
        for k in range(1, len(parts)):
            folder = "/".join(parts[:k])
            if not forced(folder) and (parts[k - 1] in SKIPPED or parts[k - 1].endswith(".egg-info") or respect and is_out(parts[:k], True, files)):
                ok = False
        name = parts[-1]
        stem, dot, suffix = name.rpartition(".")
        if not forced(path) and (name in ignore.SKIPPED_FILES or respect and is_out(parts, False, files)):
            ok = False
        if not (stem and dot and "." + suffix.lower() in READABLE) and path not in inc:
            ok = False
        if ok:
            out.add(path)
    return out


def tree(seed):
    rnd = random.Random(seed)
    names = ["a", "b", "build", "src", "x1", "x2", ".git", "lib.egg-info"]
    paths = {"/".join([rnd.choice(names) for _ in range(rnd.randint(0, 4))] + [rnd.choice(["a.py", "b.md", "c.log", "keep.log", "README", "x.PY", ".gitignore", "package-lock.json", ".env", "#odd.txt", "!odd.txt", "a[1].md", "é.txt"])]) for _ in range(150)}
    lines = ["*.py", "!a.py", "build/", "/src", "a/**/b.md", "**/x1", "**/x?/", "x[0-1]", "x[!2]", "# no", "\\#odd.txt", "\\!odd.txt", "", "  *.log ", "!keep.log", "a/", "/b/*", "!/b/a.py", "**", "!**/", "b/**", "a[[]1].md", "a[1", "x[2-0]", "//src//", "*/build/a.py", "?.md"]
    files = {base: "\n".join(rnd.sample(lines, rnd.randint(1, 5))) for base in {"", *("/".join(p.split("/")[: rnd.randint(1, 3)]) for p in rnd.sample(sorted(paths), 12))}}
    includes = rnd.sample(sorted(paths), 2) + [" /a/ ", "b/./build//", "", "src/a"]
    return paths, files, includes


@pytest.mark.parametrize("seed", range(6))
def test_scan_equals_a_walk(spark, seed):
    paths, files, includes = tree(seed)
    f = spark.createDataFrame([(p,) for p in sorted(paths)] + [(None,)], "file string").repartition(3)
    rules = ignore.rules_of(spark.createDataFrame([*files.items(), ("zz", None)], "base string, content string"))
    inc = spark.createDataFrame([(i,) for i in includes], "path string")
    assert {r.file for r in ignore.scanned(f, rules, inc).collect()} == walked(paths, files, includes)
    assert {r.file for r in ignore.scanned(f, rules, inc.where("false")).collect()} == walked(paths, files, [])
    assert {r.file for r in ignore.scanned(f, None, inc).collect()} == walked(paths, files, includes, respect=False)


def test_a_rule_cannot_bring_back_what_lies_in_a_folder_that_is_out(spark):
    files = {"": "gen/\n*.md", "gen": "!keep.py", "docs": "!*.md\n/old.md"}
    f = spark.createDataFrame([("gen/keep.py",), ("docs/new.md",), ("docs/old.md",), ("docs/sub/old.md",), ("top.md",)], "file string")
    rules = ignore.rules_of(spark.createDataFrame(list(files.items()), "base string, content string"))
    out = ignore.scanned(f, rules, spark.createDataFrame([], "path string"))
    assert {r.file for r in out.collect()} == {"docs/new.md", "docs/sub/old.md"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "file string")
    rules = ignore.rules_of(spark.createDataFrame([], "base string, content string"))
    assert ignore.scanned(none, rules, spark.createDataFrame([], "path string")).collect() == []
    one = spark.createDataFrame([("a.py",)], "file string")
    assert [r.file for r in ignore.scanned(one, rules, spark.createDataFrame([], "path string")).collect()] == ["a.py"]
