"""Secret scan with multipart credential linking.

Base spans come from three fixed patterns. On top of them, weak candidates (account identifiers,
secret-looking strings, endpoints), each too common to report alone, are linked by an interval
join within their scope: parts of one scope with at most `reach` code points between the end of one
and the start of the other. Parts that overlap don't complement each other.
An identifier is reported only with a secret in reach, a secret only with an identifier, an endpoint
only with both; base spans count as parts too, access keys as identifiers, the others as secrets.
Names of identifiers are taken in any case, with any prefix, in snake, kebab and camel case; a
secret may stand right after the '=' of an assignment, not after base64 padding, and an
identifier's own value is no secret. One Arrow batch of texts is worked on at a time; nothing is
shuffled, so a lost executor costs its own partitions only.

Defined results: a null text counts as empty and has no spans; spans are code-point offsets, end
exclusive; repeated rows are scanned one by one; an empty table gives no rows; extra columns of
the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table

# The base patterns, their kinds in order and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
LEAST_ASSIGN = 6

#: Weak parts. None of them is reported alone.
WEAK = {
    "id": re.compile(r"\bASIA[A-Z0-9]{12,}|(?i:(?:client|account|user|tenant|app(?:lication)?)[_-]?(?:id|name))[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}", re.ASCII),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_~.-])[A-Za-z0-9_~.]{3}[0-9]Q~[A-Za-z0-9_~.-]{31,34}(?![A-Za-z0-9+/_~=-])|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])", re.ASCII),
    "endpoint": re.compile(r"\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]+", re.ASCII),
}
SCOPE_END = re.compile(r"\n[ \t]*\n|-----|\n[}\]]")
WEAK_HINT = re.compile(r"://|(?:[iI][dD]|[nN][aA][mM][eE])[\"']?\x20*[:=]|ASIA|[A-Za-z0-9+/_-]{24}|[0-9]Q~", re.ASCII)
PADDED = re.compile(r"(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])([A-Za-z0-9+/_-]{22,}={1,2})\Z", re.ASCII)


def padding(text: str, at: int) -> bool:
    """Whether the '=' before `at` pads a base64 value (whole groups of four) rather than follows a name."""
    if not at or text[at - 1] != "=":
        return False
    start = at
    while start and text[start - 1] == "=":
        start -= 1
    while start and (text[start - 1] in "+/_-" or text[start - 1].isascii() and text[start - 1].isalnum()):
        start -= 1
    return (at - start) % 4 == 0 and PADDED.match(text, start, at) is not None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base patterns: leftmost, not overlapping per kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def within(parts: list[tuple[int, int, int]], at: int) -> bool:
    """Whether one of the parts (scope, start, end; in order, not overlapping) lies over the place."""
    i = bisect_left(parts, at + 1, key=lambda p: p[1])
    return i > 0 and parts[i - 1][2] > at


def _by_ends(parts: list[tuple[int, int, int]]) -> tuple[list, list]:
    """(scope, start) and (scope, end) of parts, each in order."""
    return sorted((scope, s) for scope, s, _ in parts), sorted((scope, e) for scope, _, e in parts)


def linked_spans(text: str, base: list[tuple[int, int, int]], reach: int = 400) -> list[tuple[int, int, int]]:
    """Weak parts that have their complement in the same scope, at most `reach` apart."""
    if not WEAK_HINT.search(text):
        return []
    ends = [m.start() for m in SCOPE_END.finditer(text)]
    starts, reached = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    parts: dict[str, list[tuple[int, int, int]]] = {k: [] for k in WEAK}  # (scope, start, end)
    for kind, pattern in WEAK.items():
        for m in pattern.finditer(text):
            i = bisect_left(starts, m.end())
            if kind == "secret" and (padding(text, m.start()) or within(parts["id"], m.start())):
                continue
            if not i or reached[i - 1] <= m.start():  # no base span lies over it
                parts[kind].append((bisect_left(ends, m.start()), m.start(), m.end()))
    strong: dict[str, list[tuple[int, int, int]]] = {"id": [], "secret": []}
    for s, k, e in base:
        strong["id" if k == 1 else "secret"].append((bisect_left(ends, s), s, e))
    ids, secrets = _by_ends(parts["id"] + strong["id"]), _by_ends(parts["secret"] + strong["secret"])

    def near(part, others) -> bool:
        """Interval join: some other part of the scope starts within reach of this one's end, or ends within reach of its start."""
        scope, start, end = part
        starts, stops = others
        i, j = bisect_left(starts, (scope, end)), bisect_left(stops, (scope, start - reach))
        return i < len(starts) and starts[i] <= (scope, end + reach) or j < len(stops) and stops[j] <= (scope, start)

    out = {(s, 3, e) for sc, s, e in parts["id"] if near((sc, s, e), secrets)}
    out |= {(s, 4, e) for sc, s, e in parts["secret"] if near((sc, s, e), ids)}
    out |= {(s, 5, e) for sc, s, e in parts["endpoint"] if near((sc, s, e), ids) and near((sc, s, e), secrets)}
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, reach: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: counts by base kind, digest of the base spans, all spans and how many were linked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                t = t or ""
                base = base_spans(t)
                more = linked_spans(t, base, reach)
                n = [sum(k == x for _, k, _ in base) for x in range(3)]
                rows.append((i, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)), len(more)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"]).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"
    return mapped(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
