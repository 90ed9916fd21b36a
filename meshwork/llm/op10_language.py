"""Language identification by interpolated Kneser-Ney character models.

For each learned language, character n-grams up to `ORDER` are counted on the whole texts of all
training rows and turned into interpolated Kneser-Ney log probabilities. They are stored as one
sorted array of 64-bit n-gram hashes with a row of costs per language; a text's n-grams are looked
up by binary search, through a small direct-mapped cache. The lowest cross-entropy per character
wins. The margin over the second best is calibrated by a logistic curve, and so is the rejection
threshold on the cross-entropy itself: the training rows are halved by a hash of their id, and each
half is judged by a model that was counted on the other.

Scale: tasks count the different n-grams of `ORDER` letters by language and half, a shuffle sums
them, and the shorter ones follow from these; only sums reach the driver. They and the model grow
with the different n-grams of a language, which level off in alphabets, not with the rows; every
executor holds the model. Every language with training rows is learned: model and the work on a text
grow in proportion to the number of languages. Languages share their arrays in blocks of `BLOCK`, and
the cache shrinks and texts are worked on in shorter slices as languages are added, so working memory
besides the model does not grow. The curve's sums and the threshold are taken in Spark, over all
training rows (the threshold is a value among them, its rank right within a millionth). All rows are
scored, whole texts, batch by batch, without a shuffle.

Defined results: null texts and texts without a letter get `und` and score 0. Rows with null lang
or null id are never learned from; a null id is not held out. With nothing to learn from, every
text is `und`. Ties go to the language that sorts first. Repeated rows are judged one by one; an
empty table gives no rows; extra columns are ignored.
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

from .common import mapped, materialize, remainder, table

ORDER, DISCOUNT = 4, 0.75
FOLDS, HELD = 4, 2
MASK = (1 << 21) - 1  # a code point takes 21 bits
CACHE_BITS = 20
BLOCK = 8  # languages that share an array
COSTS = 1 << 23  # costs held at a time, and in the cache
SLICE = 400_000  # characters of texts worked on at a time
HELD_GRAMS = 1 << 20  # different n-grams that a counting task holds before it hands them on
ACCEPT = 0.995


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a space."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts, runs of other characters as one space; the text of each place, and
    whether it counts: each text begins with spaces that don't, so no n-gram spans two texts."""
    lead = " " * (ORDER - 1)
    raw = np.frombuffer("".join([lead + t for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64) + len(lead)
    seq, text = _letters()[raw], np.repeat(np.arange(len(texts)), lengths)
    counts = np.ones(len(seq), bool)
    counts[((np.cumsum(lengths) - lengths)[:, None] + np.arange(len(lead))).ravel()] = False
    keep = ~counts | (seq != 32) | (np.concatenate([[0], seq[:-1]]) != 32)
    return seq[keep], text[keep], counts[keep]


def ngrams(seq: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each place (places before the first n-gram hold fewer)."""
    h = np.zeros(len(seq), np.uint64)
    for k in range(n - 1, -1, -1):
        part = seq if k == 0 else np.concatenate([np.full(k, 32, seq.dtype), seq[:-k]])[: len(seq)]
        h = h * np.uint64(0x9E3779B97F4A7C15) + (part.astype(np.uint64) + np.uint64(n * 7919 + 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def windows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams of ORDER letters, a row of code points each, and how often they occur."""
    seq, _, counted = letters_of(texts)
    place = np.flatnonzero(counted)
    _, first, n = np.unique(ngrams(seq, ORDER)[place], return_index=True, return_counts=True)
    return np.stack([seq[place[first] - k] for k in range(ORDER - 1, -1, -1)], 1), n


def window_hashes(window: np.ndarray, n: int, end: int = ORDER) -> np.ndarray:
    """Hashes of the n letters of each window that end before place `end`."""
    return ngrams(np.ascontiguousarray(window[:, end - n : end]).reshape(-1), n)[n - 1 :: n]


class Model:
    """Costs (negative log probabilities) of n-grams by language, in sorted hash arrays."""

    def __init__(self, languages: list[str], samples: dict[str, list[str] | tuple[np.ndarray, np.ndarray]]):
        """`samples` has the texts of each language, or their different n-grams and counts."""
        self.languages = languages
        self.a, self.b, self.most = 1.0, 0.0, np.inf
        tables = [self._train(*(x if isinstance(x, tuple) else windows_of(x))) for x in map(samples.get, languages)]
        self.blocks = [self._block(tables[k : k + BLOCK]) for k in range(0, len(tables), BLOCK)]
        self.floor = 1e-5
        self._keys = self._rows = None

    @staticmethod
    def _block(tables: list) -> tuple[list, list, list]:
        """Hashes and discounted probabilities by order, and weights of what an order falls back to, by the length of its context."""
        hashes, parts, lams = [np.unique(np.concatenate([t[1][n][0] for t in tables])) for n in range(ORDER)], [], []
        for n, known in enumerate(hashes):
            p = np.zeros((len(known), len(tables)), np.float32)
            for j, t in enumerate(tables):
                h, disc = t[1][n]
                p[np.searchsorted(known, h), j] = disc
            parts.append(p)
        for n in range(1, ORDER):
            known = np.unique(np.concatenate([t[0][n][0] for t in tables]))
            lam = np.ones((len(known), len(tables)), np.float32)
            for j, t in enumerate(tables):
                h, v = t[0][n]
                lam[np.searchsorted(known, h), j] = v
            lams.append((known, lam))
        return hashes, parts, lams

    @staticmethod
    def _train(window: np.ndarray, often: np.ndarray):
        """Per order: discounted probabilities of n-grams, and back-off weights of their contexts."""
        grams, context = [window_hashes(window, n) for n in range(1, ORDER + 1)], [window_hashes(window, n, ORDER - 1) for n in range(1, ORDER)]
        counts, contexts = [], {}
        for n in range(1, ORDER + 1):
            if n == ORDER:
                h, first = np.unique(grams[n - 1], return_index=True)
                c = often[first]
            else:  # continuation counts: in how many different n+1-grams it ends
                _, longer = np.unique(grams[n], return_index=True)
                h, at, c = np.unique(grams[n - 1][longer], return_index=True, return_counts=True)
                first = longer[at]
            if n == 1:
                disc = np.maximum(c - DISCOUNT, 0) / c.sum()
                counts.append((h, disc.astype(np.float32)))
                continue
            u, inv = np.unique(context[n - 2][first], return_inverse=True)
            total = np.bincount(inv, weights=c, minlength=len(u))
            kinds = np.bincount(inv, minlength=len(u))
            counts.append((h, (np.maximum(c - DISCOUNT, 0) / total[inv]).astype(np.float32)))
            contexts[n - 1] = (u, (DISCOUNT * kinds / total).astype(np.float32))
        return contexts, counts

    @staticmethod
    def _find(known: np.ndarray, rows: np.ndarray, h: np.ndarray, missing: float) -> np.ndarray:
        out = np.full((len(h), rows.shape[1]), missing, np.float32)
        if len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            out[hit] = rows[at[hit]]
        return out

    def cost(self, grams: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        """Interpolated cost of n-grams given by their hashes of every order, and of their contexts'."""
        out = []
        for hashes, parts, lams in self.blocks:
            p = np.maximum(self._find(hashes[0], parts[0], grams[0], 0.0), self.floor)
            for n in range(1, ORDER):
                known, lam = lams[n - 1]
                p = self._find(hashes[n], parts[n], grams[n], 0.0) + self._find(known, lam, before[n - 1], 1.0) * p
            out.append(-np.log(p))
        return out[0] if len(out) == 1 else np.concatenate(out, 1)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean cost by text and language, and the letters of each text."""
        seq, text, counted = letters_of(texts)
        place = np.flatnonzero(counted)
        top = ngrams(seq, ORDER)[place]
        many = len(self.languages)
        bits = min(CACHE_BITS, max(COSTS // many, 2).bit_length() - 1)
        if self._keys is None:
            self._keys, self._rows = np.zeros(1 << bits, np.uint64), np.zeros((1 << bits, many), np.float32)
        n = np.bincount(text[place], minlength=len(texts))
        letters = np.bincount(text[place], weights=seq[place] != 32, minlength=len(texts))
        total, step = np.zeros((len(texts), many)), max(COSTS // many, 1)
        for k in range(0, len(place), step):
            costs, of = self._costs(seq, place[k : k + step], top[k : k + step], bits), text[place[k : k + step]]
            lo, hi = of[0], of[-1] + 1  # texts are in order
            for j in range(many):
                total[lo:hi, j] += np.bincount(of - lo, weights=costs[:, j], minlength=hi - lo)
        return total / np.maximum(n, 1)[:, None], letters

    def _costs(self, seq: np.ndarray, place: np.ndarray, top: np.ndarray, bits: int) -> np.ndarray:
        """Costs by place and language; `top` has the hashes of the longest n-grams that end there."""
        slot = (top >> np.uint64(64 - bits)).astype(np.int64)
        todo = np.flatnonzero(self._keys[slot] != top)
        costs = self._rows[slot]
        if len(todo):
            _, first, back = np.unique(top[todo], return_index=True, return_inverse=True)
            at = todo[first]
            window = np.stack([seq[place[at] - k] for k in range(ORDER - 1, -1, -1)], 1)  # the ORDER letters that end there
            grams = [window_hashes(window, n) for n in range(1, ORDER + 1)]
            before = [window_hashes(window, n, ORDER - 1) for n in range(1, ORDER)]
            got = self.cost(grams, before)
            costs[todo] = got[back]
            self._keys[slot[at]], self._rows[slot[at]] = top[at], got
        return costs

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (chance to be right) and whether the text fits no learned language."""
        if not self.languages or not texts:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        e, letters = self.entropies([t or "" for t in texts])
        s = np.sort(e, 1)
        margin = s[:, 1] - s[:, 0] if s.shape[1] > 1 else np.ones(len(s))
        score = 1 / (1 + np.exp(-(self.a * np.log1p(100 * margin) + self.b)))
        none = letters == 0
        lang = ["und" if no else self.languages[k] for no, k in zip(none, e.argmin(1), strict=True)]
        return lang, np.where(none, 0.0, np.clip(score, 0.0, 1.0)), ~none & (e.min(1) > self.most)


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """The texts in their order, about SLICE characters at a time."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size > SLICE or k == len(texts) - 1:
            yield texts[start : k + 1]
            start, size = k + 1, 0


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows and counts of all parts, each window once."""
    window, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    _, first, back = np.unique(window_hashes(window, ORDER), return_index=True, return_inverse=True)
    return window[first], np.bincount(back, weights=n).astype(np.int64)


def counted(learn: DataFrame) -> DataFrame:
    """(lang, half, head, tail, n): how often each n-gram of ORDER letters occurs, two letters to a
    number; and a row with n = 0 for every language and half, whose texts may have no letters."""

    def rows(key: tuple[str, int], window: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        w = window.astype(np.int64)
        return pd.DataFrame({"lang": key[0], "half": np.full(len(n), key[1], np.int32), "head": w[:, 0] << 21 | w[:, 1], "tail": w[:, 2] << 21 | w[:, 3], "n": n.astype(np.int64)})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, int], list] = {}
        known: set[tuple[str, int]] = set()
        size = most = 0
        for b in batches:
            for key, mine in b.groupby(["lang", "half"])["text"]:
                known.add(key)
                for part in _slices(list(mine)):
                    held.setdefault(key, []).append(windows_of(part))
                    size += len(held[key][-1][1])
                    if size > max(HELD_GRAMS, 2 * most):
                        held = {k: [_merged(v)] for k, v in held.items()}
                        size = most = sum(len(v[0][1]) for v in held.values())
                        if size > HELD_GRAMS:
                            yield from (rows(k, *v[0]) for k, v in held.items())
                            held, size, most = {}, 0, 0
        yield from (rows(k, *_merged(v)) for k, v in held.items())
        yield from (rows(k, np.zeros((1, ORDER), np.uint32), np.zeros(1, np.int64)) for k in known)

    return mapped(learn, count, "lang string, half int, head long, tail long, n long").groupBy("lang", "half", "head", "tail").agg(F.sum("n").alias("n"))


def _judged(learn: DataFrame, halves: list[Model]) -> DataFrame:
    """(margin, least, right) of each training row by the model of the other half, if that knows its language."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for half, mine in b.groupby("half"):
                model = halves[1 - half]
                mine = mine[mine["lang"].isin(model.languages)]
                for texts, lang in zip(_slices(list(mine["text"])), _like(list(mine["lang"]), _slices(list(mine["text"]))), strict=True):
                    e = model.entropies(texts)[0]
                    s = np.sort(e, 1)
                    margin = np.log1p(100 * (s[:, 1] - s[:, 0])) if s.shape[1] > 1 else np.zeros(len(s))
                    yield pd.DataFrame({"margin": margin, "least": s[:, 0], "right": np.array(model.languages, object)[e.argmin(1)] == np.array(lang, object)})

    return mapped(learn, judge, "margin double, least double, right boolean")


def _like(values: list, slices: Iterator[list]) -> Iterator[list]:
    """`values` in slices of the same lengths."""
    at = 0
    for x in slices:
        yield values[at : at + len(x)]
        at += len(x)


def calibrate(model: Model, judged: DataFrame) -> None:
    """Logistic curve for 'the best is right' over the margin, and the entropy above which to reject."""
    most = judged.agg(F.count("*"), F.percentile_approx(F.when(F.col("right"), F.col("least")), ACCEPT, 1_000_000)).head()
    if not most[0]:
        return
    model.most = np.inf if most[1] is None else most[1]
    if len(model.languages) < 2:
        return
    w = np.array([1.0, 0.0])
    for _ in range(30):  # Newton steps with a weak prior
        p = 1 / (1 + F.exp(-(F.col("margin") * float(w[0]) + float(w[1]))))
        d, x, off = p * (1 - p), F.col("margin"), p - F.col("right").cast("double")
        xx, x1, one, gx, g1 = judged.agg(F.sum(d * x * x), F.sum(d * x), F.sum(d), F.sum(off * x), F.sum(off)).head()
        step = np.linalg.solve(np.array([[xx, x1], [x1, one]]) + 0.1 * np.eye(2), np.array([gx, g1]) + 0.1 * (w - [1.0, 0.0]))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    model.a, model.b = map(float, w)


def fit(docs: DataFrame) -> Model:
    """Learns from every row whose id's remainder is not held out, whole texts."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), FOLDS) != HELD))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    learn = learn.select(F.col("lang").cast("string").alias("lang"), half.alias("half"), F.col("text").cast("string").alias("text"))
    got = materialize(counted(learn)).toArrow()
    by = {k: got["lang"].combine_chunks().dictionary_encode() if k == "lang" else got[k].to_numpy() for k in ("lang", "half", "head", "tail", "n")}
    names, of = by["lang"].dictionary.to_pylist(), by["lang"].indices.to_numpy()
    window = np.stack([x for k in ("head", "tail") for x in (by[k] >> 21, by[k] & MASK)], 1).astype(np.uint32)
    some = by["n"] > 0

    def model(*halves: int) -> Model:
        mine = {x: (of == k) & np.isin(by["half"], halves) for k, x in enumerate(names)}
        samples = {x: _merged([(window[at & some], by["n"][at & some])]) for x, at in mine.items() if at.any()}
        return Model(sorted(samples), samples)

    out = model(0, 1)
    if out.languages:
        calibrate(out, materialize(_judged(learn, [model(0), model(1)])))
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row."""
    model._keys = model._rows = None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # bounded working memory, whatever the texts' lengths
            parts = [model.predict([t if isinstance(t, str) else None for t in part]) for part in _slices(list(b["text"]))]
            if parts:
                yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": [x for p in parts for x in p[0]], "score": np.concatenate([p[1] for p in parts]), "rejected": np.concatenate([p[2] for p in parts])})

    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text")), run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
