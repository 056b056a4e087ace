"""Signals of names against one regular expression for each name and pattern."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestore.operators import signals as sg
from lodestore.operators import text


def naive(body, name):
    n = re.escape(name)
    count = lambda p, flags=0: len([m for m in re.finditer(p.replace("{name}", n), body, re.IGNORECASE | flags)])
    dialogue = [count(p, re.MULTILINE) for p in sg.DIALOGUE]
    action = [count(p) for p in sg.PERSON_VERBS]
    lines = body.splitlines()
    pronoun = 0
    for i, line in enumerate(lines):
        if name.lower() in line.lower():
            around = " ".join(lines[max(0, i - 2) : i + 3]).lower()
            pronoun += any(re.search(p, around) for p in sg.PRONOUNS)
    direct = count("|".join(sg.DIRECT))
    told = [k for k, found in [("d", dialogue), ("a", action), ("p", [pronoun]), ("x", [direct])] for n in found if n]
    return (sum(dialogue), sum(action), pronoun, direct, sum(count(p) for p in sg.PROJECT_VERBS), count(sg.VERSIONED[0]), count(sg.CODE[0]), len(set(told[:3])))


def made(seed):
    rnd = random.Random(seed)
    names = ["Bob", "Bob Bob", "Ann", "Ann Lee", "Hey", "Elle", "Sik", "The"]
    shapes = [p.replace(r"\b", "").replace(r"\s+", rnd.choice([" ", "  ", "\n"])).replace(r"\s*", "").replace("(?:ping|ped)?", "ped").replace("(?:ing|ed)?", "").replace("?", "").replace(r"\d+", "3").replace(r"\w+", "x").replace("[:\\s]", ":").replace(r":\s", ": ").replace("^", "\n").replace("\\", "").replace("(py|js|ts|yaml|yml|json|sh)", "js").replace("[-v]", "v") for p in (*sg.DIALOGUE, *sg.PERSON_VERBS, *sg.PROJECT_VERBS, *sg.VERSIONED, *sg.CODE)]
    words = ["she", "her", "é", "x", "\n", "\n\n", ">", "Éelle", "hey", "hi", "_", "said", "-", ".", "thanks", "İ", "ſik", "the", "bobé"]
    parts = []
    for _ in range(rnd.randint(5, 60)):
        name = rnd.choice(names)
        name = rnd.choice([name, name.lower(), name.upper()])
        parts.append(rnd.choice([name, rnd.choice(shapes).replace("{name}", name), rnd.choice(words)]))
    return "".join(p + rnd.choice([" ", " ", "", "\n", ": "]) for p in parts), names


@pytest.mark.parametrize("seed", range(60))
def test_signals_equal_patterns_one_by_one(seed):
    body, names = made(seed)
    for name, got in zip(names, sg.signals(body, names)):
        assert got == naive(body, name), name


def test_window_of_pronouns():
    count = lambda body: sg.signals(body, ["Bob"])[0][2]
    assert [count(x) for x in ("she\n\nBob", "she\n\n\nBob", "Bob\n\nshe", "Bob\n\n\nshe", "Bob she\nBob", "there\nBob")] == [1, 0, 1, 0, 2, 0]


def test_weights_by_hand(spark):
    """hey, thanks and hi are deeds and address at once, dear is a deed; `pip install` counts as `install` as well."""
    s = dict(zip(sg.COUNTS, sg.signals("hey Bob, thanks Bob, hi Bob, dear Bob", ["Bob"])[0]))
    assert (s["action"], s["direct"]) == (4, 3)
    assert dict(zip(sg.COUNTS, sg.signals("pip install bob", ["Bob"])[0]))["project"] == 2
    df = spark.createDataFrame([(1, "Bob", 4), (1, "Zed", 1), (2, "Bob", 1)], "doc_id long, name string, n long")
    docs = spark.createDataFrame([(1, "hey Bob. Bob said she\n[Bob] ok"), (2, None)], "doc_id long, text string")
    out = {(r.doc_id, r.name): r for r in text.classified(sg.entity_signals(df, docs)).collect()}
    r = out[1, "Bob"]
    assert (r.dialogue, r.action, r.pronoun, r.direct, r.person_score, r.type, r.confidence) == (1, 2, 2, 1, 15, "person", 0.99)
    assert out[2, "Bob"].type == "uncertain" and out[1, "Zed"].person_score == 0


def test_only_the_first_signals_tell_kinds():
    assert sg.kinds([1, 1, 1, 0], [1], 1, 1) == 1
    assert sg.kinds([1, 1, 0, 0], [0, 1], 5, 1) == 2
    assert sg.kinds([0] * 4, [0], 2, 1) == 2 and sg.kinds([0] * 4, [0], 0, 0) == 0


def test_disambiguation_by_loops(spark):
    contexts = ["with Grace", "the grace of it", "Dropped off Grace", "my colleague Grace", "Grace: hi", "x Grace: hi", "have you grace again", "would Grace", "Grace's"]
    rows = [("Grace", f"{a} and {b}") for a in contexts for b in contexts]
    out = {r.context: r for r in spark.createDataFrame(rows, "word string, context string").select("context", text.disambiguated(F.col("word"), F.col("context")).alias("r")).select("context", "r.*").collect()}
    for word, context in rows:
        hits = [sum(bool(re.search(p.replace("{name}", word.lower()), context.lower())) for p in ps) for ps in (text.PERSON_CONTEXT, text.CONCEPT_CONTEXT)]
        person, concept = hits
        want = ("person", min(0.95, 0.7 + person * 0.1)) if person > concept else ("concept", min(0.9, 0.7 + concept * 0.1)) if concept > person else ("person", 0.7)
        assert (out[context].type, out[context].confidence) == (want[0], pytest.approx(want[1], abs=1e-4)), context
