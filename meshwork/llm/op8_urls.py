"""URL filter: longest host/path rule first, else logistic regression on hashed character n-grams.

Plain DataFrame code. The n-grams of the host are hashed into the first `HOST_BUCKETS` counters,
those of the path into the other `PATH_BUCKETS`; a URL's counters are divided by the root of their
number. The model is fitted on the driver from a small labelled table of URLs (at most `MAX_LABELLED`
rows, which is checked) by gradient descent; pages are judged by an expression that holds its weights.

Defined results: a null url, or one without `://`, has empty host and path, fits no rule and is
judged by the model on no n-grams (its intercept). Repeated rows are judged one by one; an empty
table gives no rows. Columns that are not asked for are ignored, whatever their names; a column to
be kept must not be named like a result.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, table

RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))

# Primes: n-gram hashes are taken modulo them.
HOST_BUCKETS, PATH_BUCKETS = 8191, 509
BUCKETS = HOST_BUCKETS + PATH_BUCKETS
STEPS, RATE, DECAY, MAX_LABELLED = 300, 4.0, 1e-3, 2000
SIZES = (3, 4)
#: A little above a half: hosts of unknown n-grams are allowed.
THRESHOLD = 0.6
HOST, PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"

# Words of which the labelled table's hosts are made, those of hosts to be blocked first.
BAD = "casino poker slots jackpot betting gambling bets viagra pills pharmacy meds adult porn xxx escort webcam dating warez crack keygen torrent nulled serial spam clickbait malware phishing scam lottery prize winner giveaway payday loan cash replica counterfeit weightloss miracle ads popup track linkfarm contentfarm spammer adults xrated nude sexy".split()
BAD_BESIDE = "free cheap best online win hot live super mega easy".split()
GOOD = "university library museum science history garden recipes kitchen weather school city council news journal music archive travel mountain hiking cycling football books reading poetry theatre film photo nature forest river ocean earth north south health clinic hospital research physics chemistry biology math engineering software code review docs project wiki forum community church family baby pets dog bird market food coffee bakery wine design art gallery craft knitting wood home house furniture train station airport hotel map government statistics law court election theory thesis thread thing method other together education nation motion".split()
GOOD_BESIDE = "the our my new old daily open green that little".split()
PREFIXES, SUFFIXES = ("", "www.", "m.", "blog.", "de.", "shop."), ("com", "net", "org", "info", "biz", "shop", "site", "example.com", "example.net", "example.org")
PATHS = ("/", "/en/412", "/de/articles/88.html", "/fr/history/", "/es/7", "/index.html", "/2021/05/a-page", "/en/9063/")


def _hosts(words: list[str], beside: list[str], each: int) -> Iterator[str]:
    """Hosts of two words, `each` for every word; what surrounds the words goes round."""
    for i, a in enumerate(words):
        for k in range(each):
            b = words[(i * 7 + 11 * k + 3) % len(words)] if (i + k) % 3 else beside[(i + k) % len(beside)]
            if a != b:
                yield PREFIXES[(i + k) % len(PREFIXES)] + ("", "-")[(i + k) % 2].join((a, b) if k % 2 else (b, a)) + "." + SUFFIXES[(3 * i + k) % len(SUFFIXES)]


def labelled_rows() -> list[tuple[str, int]]:
    """The labelled URLs, used where the caller brings none: 1 is to be blocked. Paths don't tell."""
    return [(f"https://{h}{PATHS[k % len(PATHS)]}", y) for y, words, beside, each in ((1, BAD, BAD_BESIDE, 8), (0, GOOD, GOOD_BESIDE, 4)) for k, h in enumerate(_hosts(words, beside, each))]


def held_out(url: str) -> bool:
    """Whether a labelled URL is kept for measuring: a quarter, by its host."""
    return zlib.crc32(url.split("/")[2].encode()) % 4 == 0


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "url string, label int").repartition(1)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased) and path of a URL; empty where there is none."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    return ascii_lower(F.regexp_extract(u, HOST, 1)), F.regexp_extract(u, PATH, 1)


def _ngrams(codes: Column, n: int, buckets: int, shift: int) -> Column:
    def at(i: Column) -> Column:
        h = F.lit(n).cast("long")
        for k in range(n):
            h = h * F.lit(131) + F.element_at(codes, (i + F.lit(k)).cast("int"))
        return (h % F.lit(buckets) + F.lit(shift)).cast("int")

    last = F.size(codes) - F.lit(n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), at)).otherwise(F.array().cast("array<int>"))


def _codes(c: str) -> Column:
    """Code points first: the n-grams then read an array."""
    return F.when(F.length(c) > 0, F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def plain_buckets(host: str, path: str) -> list[int]:
    """The buckets of all n-grams of host and path, as often as they occur."""
    out = []
    for s, buckets, shift in ((host, HOST_BUCKETS, 0), (path, PATH_BUCKETS, HOST_BUCKETS)):
        for n in SIZES:
            for i in range(len(s) - n + 1):
                h = n
                for c in s[i : i + n]:
                    h = h * 131 + ord(c)
                out.append(h % buckets + shift)
    return out


def plain_parts(url: str | None) -> tuple[str, str]:
    host, path = re.match(HOST, url or ""), re.match(PATH, url or "")
    return (host[1] if host else "").translate(str.maketrans(UPPER, LOWER)), path[1] if path else ""


def fit_rows(rows: list[tuple[str, int]]) -> list[float]:
    """Weights by bucket, then the intercept."""
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled URLs")
    if not rows:
        return [0.0] * (BUCKETS + 1)
    rows = sorted(rows)
    found = [plain_buckets(*plain_parts(u)) for u, _ in rows]
    sizes = np.array([len(b) for b in found])
    row, col, y = np.repeat(np.arange(len(rows)), sizes), np.concatenate([np.array(b, np.int64) for b in found]), np.array([float(label) for _, label in rows])
    value = 1 / np.sqrt(np.maximum(sizes, 1))[row]
    w, intercept = np.zeros(BUCKETS), 0.0
    for _ in range(STEPS):
        error = y - 1 / (1 + np.exp(-(np.bincount(row, w[col] * value, len(rows)) + intercept)))
        w += RATE * (np.bincount(col, value * error[row], BUCKETS) / len(rows) - DECAY * w)
        intercept += RATE * error.mean()
    return [float(x) for x in (*w, intercept)]


def fit(labelled: DataFrame) -> list[float]:
    """The same from a table of url and label; rows with a null in either are not learned from."""
    return fit_rows([(r["url"], r["label"]) for r in labelled.where("url is not null and label is not null").select("url", "label").limit(MAX_LABELLED + 1).collect()])


def rule_column(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits (ties: host, then path in order) and its verdict; nulls where none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the last that fits wins
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, weights: list[float], rules=RULES, url: str = "url", threshold: float = THRESHOLD, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns of `pages` to keep, then host, path, rule, score (chance to be blocked) and verdict."""
    if clash := {"host", "path", "rule", "score", "verdict"} & set(keep):
        raise ValueError(f"columns to keep are named like results: {sorted(clash)}")
    host, path = parts(F.col(f"`{url}`"))
    got = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), host.alias("host"), path.alias("path"))
    got = got.select("*", _codes("host").alias("h"), _codes("path").alias("p"))
    b = F.concat(*[_ngrams(F.col(c), n, buckets, shift) for c, buckets, shift in (("h", HOST_BUCKETS, 0), ("p", PATH_BUCKETS, HOST_BUCKETS)) for n in SIZES])
    w = F.split(F.lit(",".join(map(repr, weights[:BUCKETS]))), ",").cast("array<double>")  # a constant: folded once
    got = got.select("kept", "host", "path", b.alias("b"))
    total = F.aggregate("b", F.lit(0.0), lambda s, j: s + F.element_at(w, j + 1))
    score = 1 / (1 + F.exp(-(F.lit(float(weights[BUCKETS])) + total / F.sqrt(F.greatest(F.size("b"), F.lit(1)).cast("double")))))
    rule, verdict = rule_column(F.col("host"), F.col("path"), rules)
    got = got.select("kept", "host", "path", rule.alias("rule"), score.alias("score"), verdict.alias("given"))
    return got.select("kept.*", "host", "path", "rule", "score", F.coalesce("given", F.when(F.col("score") > threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), fit(labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict")


@functools.cache
def oracle_sql() -> str:
    """The same judgement as DuckDB SQL, with the weights of the same fit."""
    w = fit_rows(labelled_rows())
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rules = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    spread = (("host", HOST_BUCKETS, 0), ("path", PATH_BUCKETS, HOST_BUCKETS))
    grams = " + ".join(
        f"coalesce(list_sum(list_transform(range(1, length({c}) - {n - 2}), lambda i: w[{1 + shift} + (({'(' * (n - 1)}{n}::BIGINT * 131 + unicode({c}[i]))"
        + "".join(f" * 131 + unicode({c}[i + {k}]))" for k in range(1, n)) + f" % {buckets})])), 0)"
        for c, buckets, shift in spread for n in SIZES
    )
    count = " + ".join(f"greatest(length({c}) - {n - 1}, 0)" for c in ("host", "path") for n in SIZES)
    return f"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{HOST}', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '{PATH}', 1) AS path, [{', '.join(f'{x!r}::DOUBLE' for x in w[:BUCKETS])}] AS w
  FROM pages),
s AS (SELECT page_id, host, path, {w[BUCKETS]!r}::DOUBLE + ({grams}) / sqrt(greatest({count}, 1)) AS z FROM p)
SELECT page_id, host, path,
       CASE {' '.join(f"WHEN {fits(h, q)} THEN '{h}{q}'" for h, q, _ in rules)} END AS rule,
       CASE {' '.join(f"WHEN {fits(h, q)} THEN '{v}'" for h, q, v in rules)} WHEN z > {math.log(THRESHOLD / (1 - THRESHOLD))!r}::DOUBLE THEN 'block' ELSE 'allow' END AS verdict
FROM s"""
