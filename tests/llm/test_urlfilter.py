import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodestore.llm import urlfilter


def brute(url):
    m = re.match(r"^.*?://([^/?#]*)([^?#]*)", url or "", re.DOTALL)
    host = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]) if m else ""
    path = m[2] if m else ""
    best = None
    for r in urlfilter.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.name) > len(best.name)):
            best = r
    return host, path, best


URLS = [f"http{'s' * (i % 2)}://{w}.example.{t}/{l}/{i}?q=1" for i, (w, t, l) in enumerate((w, t, l) for w in ("www", "Blog", "spam-farm") for t in ("net", "com", "org") for l in ("en", "de", "fr", "es"))]
URLS += [None, "", "example.net/en/", "http://net", "http://net/", "http://net?x=/", "ftp://a.NET#f", "http://xexample.net/en/", "http://a.example.net:80/en/", "a://b://c.net/d"]


def test_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    for r in urlfilter.judge_urls(pages).collect():
        host, path, rule = brute(URLS[r.page_id])
        assert (r.host, r.path) == (host, path)
        assert r.rule == (rule.name if rule else None)
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")


def brute_verdicts(urls):
    """Counts in dictionaries over all of urls, then threshold and verdicts, by the definitions. urls: url -> times."""
    label = {u: {"block": 1, "allow": 0}[brute(u)[2].verdict] for u in urls if brute(u)[2]}
    held = {u for u in label if in_held(u)}
    counts = [defaultdict(int), defaultdict(int)]
    grams = lambda u: [("\x02" * 4 + u + "\x03")[i : i + 5] for i in range(len(u) + 1)]
    for u, block in label.items():
        if u not in held:
            for g in grams(u):
                for o in range(5):
                    counts[block]["g", g[4 - o :]] += urls[u]
                    counts[block]["c", o, g[4 - o : 4]] += urls[u]

    def score(u):
        total = 0.0
        for g in grams(u):
            logs = []
            for c in counts:
                p = 1 / 256
                for o in range(5):
                    p = (c["g", g[4 - o :]] + 2 * p) / (c["c", o, g[4 - o : 4]] + 2)
                logs.append(math.log(p))
            total += logs[1] - logs[0]
        return round(total / len(grams(u)), 9)

    got = {u: score(u) for u in urls}
    edges = [k / urlfilter.BINS * 8 - 4 for k in range(urlfilter.BINS + 1)]
    size = [sum(urls[u] for u in held if label[u] == b) for b in (0, 1)]
    if not all(size):
        return got, 0.0, label
    error = [sum(urls[u] for u in held if label[u] == 1 and got[u] < x) / size[1] + sum(urls[u] for u in held if label[u] == 0 and got[u] >= x) / size[0] for x in edges]
    best = [k for k, e in enumerate(error) if e <= min(error) + 1e-9]
    return got, edges[best[len(best) // 2]], label


def web(seed=3):
    rnd = random.Random(seed)
    words = ["essay", "library", "cheap", "pills", "notes", "win", "bonus", "history"]
    urls = [f"http://{rnd.choice(words)}{rnd.randrange(9)}.example.{rnd.choice(['net', 'com', 'org', 'info'])}/{rnd.choice(['en', 'de', 'fr'])}/{rnd.choice(words)}-{rnd.randrange(50)}" for _ in range(400)]
    return urls + urls[:60] * 3 + ["http://one.example.net/x"] * 200 + ["", "é", "http://x/" + "y" * 3000]


def test_scores_and_verdicts_equal_brute_force(spark, monkeypatch):
    urls = web()
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    keys = {r.url: r.h for r in pages.select("url", (F.pmod(F.xxhash64(F.unhex(F.sha2(F.col("url").cast("binary"), 256))), F.lit(urlfilter.HELD_OUT)) == 0).alias("h")).collect()}
    monkeypatch.setitem(globals(), "in_held", keys.get)
    score, limit, label = brute_verdicts(Counter(urls))
    out = urlfilter.judge_urls(pages).collect()
    assert len(out) == len(urls)
    for r in out:
        u = urls[r.page_id]
        assert abs(r.score - score[u]) < 1e-8
        if brute(u)[2] is None:
            assert r.verdict == ("block" if score[u] >= limit else "allow"), (u, score[u], limit)
    assert len({r.verdict for r in out if r.rule is None}) == 2


def test_counts_grow_with_the_input(spark):
    """Every gram of every order has a row of its own, with its counts and its context's; what isn't counted has zeros."""
    rows = [(i, f"http://{i:x}.example/", 1 + i % 2, i % 2, i % 7 == 0) for i in range(300)]
    urls = spark.createDataFrame(rows, "uid long, url string, n long, block int, held boolean")
    tables = urlfilter.gram_counts(urlfilter.url_grams(urls), ~F.col("held"))
    want = [defaultdict(lambda: [0, 0, 0, 0]) for _ in range(5)]
    context = [defaultdict(lambda: [0, 0]) for _ in range(5)]
    for _, u, n, block, held in rows:
        t = "\x02" * 4 + u + "\x03"
        for i in range(4, len(t)):
            for o in range(5):
                want[o][t[i - o : i + 1]][block] += n * (not held)
                context[o][t[i - o : i]][block] += n * (not held)
    for o, table in enumerate(tables):
        assert {r.g: [r.allow, r.block, r.of_allow, r.of_block] for r in table.collect()} == {g: [*c[:2], *context[o][g[:-1]]] for g, c in want[o].items()}


def test_edges(spark):
    pages = spark.createDataFrame([(1, None), (None, "http://x/y"), (2, "http://x/y"), (2, "http://x/y")], "page_id long, url string")
    out = urlfilter.judge_urls(pages).collect()
    assert len(out) == 4 and {r.verdict for r in out} == {"allow"}
    assert urlfilter.judge_urls(pages.limit(0)).count() == 0
