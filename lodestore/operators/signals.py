"""What stands around a name: signals of a person and of a project.

A document and its names meet once. An automaton of the names finds all their places in one pass over the text, and only there are the
patterns looked at, what stands before a name backwards from it and what stands after it forwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What persons do.
PERSON_VERBS = (
    r"\b{name}\s+said\b",
    r"\b{name}\s+asked\b",
    r"\b{name}\s+told\b",
    r"\b{name}\s+replied\b",
    r"\b{name}\s+laughed\b",
    r"\b{name}\s+smiled\b",
    r"\b{name}\s+cried\b",
    r"\b{name}\s+felt\b",
    r"\b{name}\s+thinks?\b",
    r"\b{name}\s+wants?\b",
    r"\b{name}\s+loves?\b",
    r"\b{name}\s+hates?\b",
    r"\b{name}\s+knows?\b",
    r"\b{name}\s+decided\b",
    r"\b{name}\s+pushed\b",
    r"\b{name}\s+wrote\b",
    r"\bhey\s+{name}\b",
    r"\bthanks?\s+{name}\b",
    r"\bhi\s+{name}\b",
    r"\bdear\s+{name}\b",
)
#: Pronouns.
PRONOUNS = (
    r"\bshe\b",
    r"\bher\b",
    r"\bhers\b",
    r"\bhe\b",
    r"\bhim\b",
    r"\bhis\b",
    r"\bthey\b",
    r"\bthem\b",
    r"\btheir\b",
)
#: Marks of dialogue.
DIALOGUE = (
    r"^>\s*{name}[:\s]",
    r"^{name}:\s",
    r"^\[{name}\]",
    r'"{name}\s+said',
)
#: Direct address; matches of all of them don't overlap.
DIRECT = (
    r"\bhey\s+{name}\b",
    r"\bthanks?\s+{name}\b",
    r"\bhi\s+{name}\b",
)
#: What is done with projects.
PROJECT_VERBS = (
    r"\bbuilding\s+{name}\b",
    r"\bbuilt\s+{name}\b",
    r"\bship(?:ping|ped)?\s+{name}\b",
    r"\blaunch(?:ing|ed)?\s+{name}\b",
    r"\bdeploy(?:ing|ed)?\s+{name}\b",
    r"\binstall(?:ing|ed)?\s+{name}\b",
    r"\bthe\s+{name}\s+architecture\b",
    r"\bthe\s+{name}\s+pipeline\b",
    r"\bthe\s+{name}\s+system\b",
    r"\bthe\s+{name}\s+repo\b",
    r"\b{name}\s+v\d+\b",
    r"\b{name}\.py\b",
    r"\b{name}-core\b",
    r"\b{name}-local\b",
    r"\bimport\s+{name}\b",
    r"\bpip\s+install\s+{name}\b",
)
#: Versions and code files.
VERSIONED = (r"\b{name}[-v]\w+",)
CODE = (r"\b{name}\.(py|js|ts|yaml|yml|json|sh)\b",)
#: Lines before and after a name's in which a pronoun counts; signals that tell a person's kinds.
NEAR, TOLD = 2, 3

#: By column: patterns that are counted, each on its own or, if shared, as alternatives of one pattern.
GROUPS = {"dialogue": (DIALOGUE, False), "action": (PERSON_VERBS, False), "direct": (DIRECT, True), "project": (PROJECT_VERBS, False), "versioned": (VERSIONED, False), "code": (CODE, False)}
PRONOUN = re.compile("|".join(PRONOUNS))


def in_word(text: str, at: int) -> bool:
    """Whether the character before `at` belongs to a word."""
    return at > 0 and (text[at - 1].isalnum() or text[at - 1] == "_")


class Around:
    """A pattern around {name}, to be tried where the name stands."""

    def __init__(self, pattern: str):
        before, after = pattern.split("{name}")
        self.edge = before.startswith(r"\b")  # what comes first begins a word
        before = before.removeprefix(r"\b")
        self.before = regex.compile("(?rim)" + before) if before else None
        self.after = re.compile(after, re.IGNORECASE | re.MULTILINE)

    def span(self, text: str, start: int, end: int) -> tuple[int, int] | None:
        right = self.after.match(text, end)
        if right is None:
            return None
        if self.before:
            left = self.before.match(text, 0, start)
            if left is None:
                return None
            start = left.start()
        return None if self.edge and in_word(text, start) else (start, right.end())


AROUND = {column: ([Around(p) for p in patterns], shared) for column, (patterns, shared) in GROUPS.items()}


def folded(text: str) -> str:
    """text in lower case, letter by letter, for matching A-Z in any case."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.replace("ſ", "s").replace("ı", "i")


def places(text: str, names: list[str]) -> dict[str, list[tuple[int, int]]]:
    """Where names stand in text, in any case, whatever is around them."""
    automaton = ahocorasick.Automaton()
    for name in names:
        automaton.add_word(folded(name), folded(name))
    automaton.make_automaton()
    found: dict[str, list[tuple[int, int]]] = {}
    for last, key in automaton.iter(folded(text)):
        found.setdefault(key, []).append((last + 1 - len(key), last + 1))
    return {name: found.get(folded(name), []) for name in names}


def counted(text: str, at: list[tuple[int, int]]) -> dict[str, list[int]]:
    """By column the matches of each of its patterns around a name at these places; matches of a pattern don't overlap."""
    out = {}
    for column, (patterns, shared) in AROUND.items():
        counts, ends = [0] * len(patterns), [0] * len(patterns)
        for start, end in at:
            for k, pattern in enumerate(patterns):
                span = pattern.span(text, start, end)
                slot = 0 if shared else k
                if span and span[0] >= ends[slot]:
                    counts[slot], ends[slot] = counts[slot] + 1, span[1]
        out[column] = counts
    return out


def kinds(dialogue: list[int], action: list[int], pronoun: int, direct: int) -> int:
    """Kinds among the first TOLD signals; each pattern of dialogue and of action that matches is one of them."""
    told = ["dialogue"] * sum(n > 0 for n in dialogue) + ["action"] * sum(n > 0 for n in action) + ["pronoun"] * (pronoun > 0) + ["direct"] * (direct > 0)
    return len(set(told[:TOLD]))


def signals(text: str, names: list[str]) -> list[tuple]:
    """dialogue, action, pronoun, direct, project, versioned, code, kinds of each name."""
    lines = text.lower().splitlines()
    near: dict[int, bool] = {}

    def pronoun_near(i: int) -> bool:
        if i not in near:
            near[i] = bool(PRONOUN.search(" ".join(lines[max(0, i - NEAR) : i + NEAR + 1])))
        return near[i]

    out = []
    found = places(text, names)
    for name in names:
        c, low = counted(text, found[name]), name.lower()
        pronoun = sum(pronoun_near(i) for i, line in enumerate(lines) if low in line)
        total = {k: sum(v) for k, v in c.items()}
        out.append((total["dialogue"], total["action"], pronoun, total["direct"], total["project"], total["versioned"], total["code"], kinds(c["dialogue"], c["action"], pronoun, total["direct"])))
    return out


COUNTS = ("dialogue", "action", "pronoun", "direct", "project", "versioned", "code", "kinds")


def entity_signals(names: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, name, n) of names with the counts of COUNTS in the text of their document. docs: doc_id, text.

    Names of a document meet it as one list. A document without a text has no signals; names of a null doc_id are left out.
    """
    listed = names.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("name", "n"))).alias("names"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(doc, x["name"], x["n"], *s) for doc, own, text in zip(b["doc_id"], b["names"], b["text"]) for x, s in zip(own, signals(text or "", [x["name"] for x in own]))]
            yield pd.DataFrame(rows, columns=["doc_id", "name", "n", *COUNTS])

    schema = "doc_id long, name string, n long, " + ", ".join(f"{c} long" for c in COUNTS)
    return listed.join(docs.select("doc_id", "text"), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "names", "text").mapInPandas(run, schema)
