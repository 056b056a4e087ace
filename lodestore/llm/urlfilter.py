"""URL filter: host rules first, then the ratio of two character language models.

URLs that rules allow or block are the accepted and rejected text. For each class the characters after contexts of
0 to ORDER characters are counted over all pages, exactly: a table of grams that grows with what the pages
hold, never gathered anywhere. A longer context backs off to a shorter one (Dirichlet smoothing), which makes
the order variable: unseen contexts weigh nothing. Each distinct gram is judged once, by a join with the
counts of its contexts, and each distinct URL by a join with its grams. The score is the log-likelihood
difference divided by the URL's length, and its threshold is calibrated on URLs of known verdict that were
left out of the counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestore.llm.common import ascii_lower, salted_join, stored

#: Longest context, weight of the shorter context, share of a character that no text shows.
ORDER, ALPHA, FLAT = 4, 2.0, 1 / 256
#: What stands before and after a URL.
BEFORE, AFTER = "\x02", "\x03"
#: URLs that a task cuts at a time.
URLS = 500
#: Tasks that the rows of one gram or URL are dealt over.
SALTS = 4
#: One in so many labelled URLs calibrates instead of being counted.
HELD_OUT = 5
#: Scores are binned for calibration: bins over [-LIMIT, LIMIT].
BINS, LIMIT = 2001, 4.0


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values.
RULES = (UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; null or no `://`: empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; null or no `://`: empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def url_grams(urls: DataFrame) -> DataFrame:
    """(uid, n, block, held, g, m) for each distinct gram of ORDER + 1 characters of each row of urls (uid, url, n, block, held): m times in the URL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, URLS) for x in batches for i in range(0, len(x), URLS)):
            seen = []
            for url in b.column(1).to_pylist():
                text = BEFORE * ORDER + (url or "") + AFTER
                seen.append(Counter(text[i : i + ORDER + 1] for i in range(len(text) - ORDER)))
            at = pa.array(np.repeat(np.arange(len(b)), [len(c) for c in seen]))
            same = [b.column(c).take(at) for c in (0, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays([*same, pa.array([g for c in seen for g in c], pa.string()), pa.array([m for c in seen for m in c.values()], pa.int64())], ["uid", "n", "block", "held", "g", "m"])

    return urls.select("uid", "url", "n", "block", "held").mapInArrow(run, "uid long, n long, block int, held boolean, g string, m long")


def gram_counts(grams: DataFrame, counted: Column) -> list[DataFrame]:
    """Of each order a table (g, allow, block, of_allow, of_block): how often each of its grams comes in URLs that are counted, by class, and how often its context.

    Every gram of every URL has a row, also where nothing is counted. Each order is summed from the next longer one.
    """
    times = lambda c: F.sum(F.when(counted & (F.col("block") == c), F.col("n") * F.col("m")).otherwise(0))
    now, out = grams.groupBy("g").agg(times(0).alias("allow"), times(1).alias("block")), []
    for o in range(ORDER, -1, -1):
        same = Window.partitionBy(F.substring("g", 1, o))  # as many rows as characters follow a context
        out.append(now.withColumns({"of_allow": F.sum("allow").over(same), "of_block": F.sum("block").over(same)}))
        now = now.groupBy(F.substring("g", 2, o).alias("g")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    return out[::-1]


def gram_ratios(counts: list[DataFrame]) -> DataFrame:
    """(g, ratio) for each gram of the highest order: log P(last character | context), as rejected minus as accepted."""
    under = None
    for o, table in enumerate(counts):
        now = table
        if under is None:
            now = now.withColumns({"p_allow": F.lit(FLAT), "p_block": F.lit(FLAT)})
        else:  # a gram's end is shared by as many grams as there are characters
            now = now.join(under, F.substring("g", 2, o) == F.col("end"))
        p = {c: ((F.col(c) + ALPHA * F.col(f"p_{c}")) / (F.col(f"of_{c}") + ALPHA)) for c in ("allow", "block")}
        under = now.select(F.col("g").alias("end"), p["allow"].alias("p_allow"), p["block"].alias("p_block"))
    return under.select(F.col("end").alias("g"), (F.log("p_block") - F.log("p_allow")).alias("ratio"))


def url_scores(grams: DataFrame, ratios: DataFrame) -> DataFrame:
    """(uid, score) of each URL of grams: the log-likelihood difference by character; over 0: more like the rejected."""
    per = salted_join(grams.select("uid", "g", "m"), ratios, "g", F.col("uid"), salts=SALTS)
    return per.groupBy("uid").agg(F.round(F.sum(F.col("m") * F.col("ratio")) / F.sum("m"), 9).alias("score"))


def calibrated(scored: DataFrame) -> float:
    """The threshold with the least balanced error on scored (score, block, n times): URLs at or over it are blocked. One class alone: 0."""
    bin_ = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + LIMIT) / (2 * LIMIT) * BINS))).cast("int")
    hist = np.zeros((2, BINS + 1))
    for r in scored.groupBy(bin_.alias("b"), "block").agg(F.sum("n").alias("n")).collect():  # 2 x BINS rows at most
        hist[r["block"], r["b"]] = r["n"]
    if not hist.sum(axis=1).all():
        return 0.0
    share = hist / hist.sum(axis=1, keepdims=True)
    missed = np.concatenate([[0], np.cumsum(share[1])[:-1]])  # rejected under the bin's lower edge
    wrong = 1 - np.concatenate([[0], np.cumsum(share[0])[:-1]])  # accepted at or over it
    error = missed + wrong
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(best[len(best) // 2] / BINS * 2 * LIMIT - LIMIT)


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score for each row of pages (page_id, url).

    A rule's verdict stands; else the model's: block at or over the calibrated threshold. Null and empty urls
    have empty host and path, no rule, and the model's verdict on the empty text. If rules mark no URL of one
    class there is nothing to compare and URLs without a rule are allowed. Repeated rows stay repeated.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    base = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", name).withColumn("ruled", verdict).withColumn("key", F.unhex(F.sha2(F.col("url").cast("binary"), 256)))
    # each distinct URL is read once, however many pages have it
    urls = base.groupBy("key").agg(F.first("url").alias("url"), F.count("*").alias("n"), F.first((F.col("ruled") == "block").cast("int")).alias("block"))
    urls = stored(urls.withColumn("uid", F.monotonically_increasing_id()).withColumn("held", F.pmod(F.xxhash64("key"), F.lit(HELD_OUT)) == 0), "url-list")
    grams = stored(url_grams(urls), "url-grams")
    ratios = stored(gram_ratios(gram_counts(grams, F.col("block").isNotNull() & ~F.col("held"))), "url-gram-ratios")
    scores = stored(url_scores(grams, ratios), "url-scores")
    known = urls.where("block is not null").select("uid", "n", "block", "held")
    classes = known.where(~F.col("held")).agg(F.count_distinct("block")).first()[0]
    limit = calibrated(known.where("held").join(scores, "uid")) if classes == 2 else float("inf")
    guess = F.when(F.col("score") >= limit, "block").otherwise("allow")
    named = urls.select("uid", "key").join(scores, "uid").select("key", "score")
    out = salted_join(base.drop("url"), named, "key", F.coalesce("page_id", F.lit(0)), salts=SALTS)
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", guess).alias("verdict"), "score")
