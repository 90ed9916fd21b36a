"""Quality classifier: Gaussian-kernel ridge by random Fourier features, calibrated isotonically.

Each text becomes `len(STATISTICS)` numbers (shares of character classes, word and line shape,
repetition). They are standardized, mapped to `FEATURES` random Fourier features, and a ridge
regression is solved from normal equations that each partition sums for its own rows. Isotonic
regression on training rows kept out of the fit turns the ridge score into a probability, linear
between the centres of its steps.

Bound: the fit uses at most about `MAX_LABELLED` labelled rows, picked by a hash of their id so
that all are equally likely; their statistics are written, read in `FIT_PARTITIONS` partitions, and
each of those sends one matrix. Every document is scored, whole texts, without a shuffle. Labels,
language, source and id are never inputs of a score.

Defined results: null or empty texts are scored like any other, on statistics of nothing. Rows
with null labels are not learned from; of several labels for an id the larger holds; a null id is
not held out. With nothing to learn from, every score is 1 (nothing is rejected). Repeated rows
are scored one by one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import key_columns, mapped, materialize, remainder, table, without

FOLDS, HELD, CALIBRATION = 5, 0, 1
MAX_LABELLED, FIT_PARTITIONS = 16_000, 8
FEATURES, GAMMA, RIDGE, SEED = 384, 0.035, 1.0, 20240607
REJECT = 0.3

CLASSES = ("other", "lower", "upper", "digit", "space", "newline", "stop", "comma", "pipe", "hash", "dollar", "percent", "ampersand", "star", "bang", "quote", "bracket", "slash", "letter", "control")
_CHARS = {".": "stop", "?": "stop", ",": "comma", ";": "comma", ":": "comma", "|": "pipe", "#": "hash", "$": "dollar", "%": "percent", "&": "ampersand", "*": "star", "!": "bang", '"': "quote", "'": "quote", "<": "bracket", ">": "bracket", "{": "bracket", "}": "bracket", "[": "bracket", "]": "bracket", "/": "slash", "\\": "slash", "\n": "newline", "�": "control"}
STATISTICS = (*CLASSES, "chars", "words", "word_length", "distinct_words", "commonest_word", "lines", "line_length", "distinct_lines", "repeated_neighbours", "long_words", "odd_words")


@functools.cache
def _classes() -> np.ndarray:
    kinds = {"Ll": "lower", "Lu": "upper", "Lt": "upper", "Lo": "letter", "Lm": "letter", "Nd": "digit", "Zs": "space", "Cc": "control", "Cf": "control", "Co": "control", "Cn": "control"}
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        out[c] = CLASSES.index(_CHARS.get(chr(c)) or kinds.get(unicodedata.category(chr(c)), "other"))
    for c in "\t\r":
        out[ord(c)] = CLASSES.index("space")
    return out


def statistics(texts: list[str]) -> np.ndarray:
    """One row of STATISTICS per text."""
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    k = len(CLASSES)
    at = np.repeat(np.arange(len(texts)) * k, lengths)
    counts = np.bincount(at + _classes()[raw], minlength=k * len(texts)).reshape(-1, k)
    out = np.zeros((len(texts), len(STATISTICS)))
    out[:, :k] = counts / np.maximum(lengths, 1)[:, None]
    for i, t in enumerate(texts):
        words, lines = t.split(), t.split("\n")
        n = len(words)
        times: dict[str, int] = {}
        for w in words:
            times[w] = times.get(w, 0) + 1
        out[i, k:] = (
            np.log1p(len(t)), np.log1p(n), (len(t) - len(lines) + 1) / max(n, 1), len(times) / max(n, 1), max(times.values(), default=0) / max(n, 1),
            np.log1p(len(lines)), np.log1p(len(t) / len(lines)), len(set(lines)) / len(lines),
            sum(map(str.__eq__, words, words[1:])) / max(n - 1, 1), sum(len(w) * c for w, c in times.items() if len(w) > 16) / max(len(t), 1),
            sum(c for w, c in times.items() if not w[0].isalnum() or not w[-1].isalnum()) / max(n, 1),
        )
    return np.nan_to_num(out)


def _batches(b: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """Statistics of a batch in parts of bounded size: (rows before, statistics)."""
    texts, start, size = [t if isinstance(t, str) else "" for t in b["text"]], 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size > 500_000 or k == len(texts) - 1:
            yield start, statistics(texts[start : k + 1])
            start, size = k + 1, 0


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, np.sqrt(2 * GAMMA), (len(STATISTICS), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta = self.x = self.y = None

    def features(self, s: np.ndarray) -> np.ndarray:
        z = np.clip((s - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(s), 1))])

    def score(self, s: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.ones(len(s))
        raw = self.features(s) @ self.beta
        return np.clip(np.interp(raw, self.x, self.y) if self.x is not None else raw, 0.0, 1.0)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and heights of the steps of the best rising curve."""
    order = np.argsort(score, kind="stable")
    steps: list[list[float]] = []  # weight, sum of labels, sum of scores
    for s, y in zip(score[order], label[order], strict=True):
        steps.append([1.0, float(y), float(s)])
        while len(steps) > 1 and steps[-2][1] * steps[-1][0] >= steps[-1][1] * steps[-2][0]:
            last = steps.pop()
            steps[-1] = [a + b for a, b in zip(steps[-1], last, strict=True)]
    return np.array([s[2] / s[0] for s in steps]), np.array([s[1] / s[0] for s in steps])


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, label and role (fit or calibration) of the rows that may be learned from; a bounded share."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), FOLDS) != HELD)).groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    n = usable.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit("quality sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = usable.where(place < min(1.0, MAX_LABELLED / max(n, 1)))  # about MAX_LABELLED small rows at most: broadcast
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").withColumn("calibration", remainder(F.col("doc_id"), FOLDS) == CALIBRATION).select("text", "label", "calibration")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    d = len(STATISTICS)

    def stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start, s in _batches(b):
                part = b.iloc[start : start + len(s)]
                yield pd.DataFrame({"s": list(s), "label": part["label"].to_numpy(), "calibration": part["calibration"].to_numpy()})

    # the corpus is read and mapped at full width; only the small table of statistics is drawn together
    rows = materialize(mapped(_labelled(docs, labels), stats, "s array<double>, label double, calibration boolean"))
    each = [f for j in range(d) for f in (F.avg(F.col("s")[j]), F.stddev_pop(F.col("s")[j]))]
    moments = rows.agg(*each, F.count("*")).head()
    if not moments[-1]:
        return Model(np.zeros(d), np.ones(d))
    model = Model(np.array(moments[0:-1:2]), np.maximum(np.array(moments[1:-1:2]), 1e-6))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, v = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for b in batches:
            z = model.features(np.stack(b["s"].to_list())) if len(b) else np.zeros((0, FEATURES + 1))
            a += z.T @ z
            v += z.T @ b["label"].to_numpy()
        yield pd.DataFrame({"a": [a.tobytes()], "v": [v.tobytes()]})

    parts = mapped(rows.where("not calibration").coalesce(FIT_PARTITIONS), sums, "a binary, v binary").collect()
    a = sum(np.frombuffer(p["a"]).reshape(FEATURES + 1, -1) for p in parts)
    v = sum(np.frombuffer(p["v"]) for p in parts)
    penalty = RIDGE * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-6
    model.beta = np.linalg.solve(a + penalty, v)
    kept = rows.where("calibration").select("s", "label").toPandas()  # a share of the bounded sample
    if len(kept):
        model.x, model.y = isotonic(model.features(np.stack(kept["s"].to_list())) @ model.beta, kept["label"].to_numpy())
    return model


def score(docs: DataFrame, model: Model, extra: list[str] | None = None) -> DataFrame:
    """doc_id, the `extra` columns, and score for every row."""

    extra = extra or []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [model.score(s) for _, s in _batches(b)]
            if parts:
                yield b.drop(columns="text").assign(score=np.concatenate(parts))

    had = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *extra, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in had.dtypes if c != "text") + ", score double"
    return mapped(had, run, schema)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not rejected, columns kept."""
    i, h = key_columns()
    plain = docs.select(i.alias("_i"), h.alias("_h"), "doc_id", "text")
    return without(docs, score(plain, fit(docs, labels), ["_i", "_h"]).where(F.col("score") < REJECT))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    got = score(docs.withColumn("held_out", held), fit(docs, table(spark, sf_dir, "labels")), ["held_out"])
    return got.select("doc_id", "held_out", "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
