"""Similarity join on word shingles by chosen paths (Jaccard similarity of at least `THRESHOLD`).

Texts become sets of hashed `WORDS`-word shingles; equal sets are one class. Each class carries a
signature of `T` coordinates that agree between two sets with a chance equal to their similarity.
A node of the tree samples coordinates, in runs that each take one with chance 1 / (THRESHOLD T),
until pairs at the threshold share `LEAST` sampled coordinates with chance `RECALL`; sets that agree on
one meet in a child. Sets that meet others in fewer than `LEAST` children of the root leave there. Children of up to `BUCKET` sets are compared pair by pair; larger ones are
split again on coordinates sampled anew, unless their sets agree so much on average that splitting
would only repeat them, or the tree is `DEPTH` deep: those are compared in blocks, pairs of blocks
spread over tasks. A pair is compared in one place only: where the sampled coordinates before the
child's all differ. Pairs whose signatures agree enough are verified on the full sets.

Scale: texts are read twice; the second time, to fetch the sets of those that have a partner, they
are shuffled only if the list of those is too long to broadcast (measured).
Otherwise what moves are hashes, and signatures of sets that share a bucket. Links are never
shuffled: each bucket sends one row per set, with its number of links and the least set it is
linked to. Equal texts collapse on the map side.

Defined results: texts of 1 to `WORDS` - 1 words are one shingle; null texts and texts without
words have no links and are each a class of their own. Rows that repeat an id and text are copies.
Ties do not arise: labels are least ids. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.operators.components import connected_components

from .common import bounded, key_columns, mapped, materialize, table, without, wrapped

WORDS, THRESHOLD = 5, 0.8
T, LEAST, RECALL = 64, 2, 1 - 5e-7  # T is also the bits of a mask of coordinates
#: Agreeing coordinates that a pair must have to be verified; of pairs at the threshold, 1 in 3,000,000 has fewer.
#: With the pairs that the tree misses, fewer than 1 in 1,000,000 is lost.
AGREE = 34
BUCKET, DENSE, DEPTH = 4096, 0.4, 4
SHARD_ROWS = 10_000
EMPTY = np.uint32(0xFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case of each byte, and whether it belongs to words."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return low, (low >= 128) | ((low >= 48) & (low < 58)) | ((low >= 97) & (low < 123))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; empty arrays where there are no words."""
    parts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
    raw = np.frombuffer(b" ".join([b"", *parts, b""]), np.uint8)
    low, inside = _bytes()
    up, down = _powers(1 << max(16, len(raw).bit_length()))
    low, word = low[raw], inside[raw]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)])])
    h = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    begins = np.cumsum([1] + [len(p) + 1 for p in parts])
    first = np.searchsorted(starts, begins)
    weights = [np.uint64(pow(0xD1B54A32D192ED03, k + 1, 1 << 64)) for k in range(words)]
    n = max(0, len(h) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled += h[k : k + n] * weights[k]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            short = np.array([(h[a:b] * np.array(weights[: b - a])).sum()], np.uint64)
            out.append(mixed(short + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of T coordinates per set (not empty): the least hash in each bin, in the first round that fills it."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), T), EMPTY, np.uint32)
    tokens, owner = np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.repeat(np.arange(len(sets)), sizes)
    bits = np.uint64(64 - T.bit_length() + 1)
    for r in range(2 * T):
        x = mixed(tokens + np.uint64((r * 2 + 1) * 0x2545F4914F6CDD1D % (1 << 64)))
        at = (x >> bits).astype(np.int64) if r < T else np.full(len(x), r - T)
        got = np.full(out.size, EMPTY, np.uint32)
        np.minimum.at(got, owner * T + at, np.minimum(x & np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFE)).astype(np.uint32))
        out = np.where(out == EMPTY, got.reshape(out.shape), out)
        open_ = (out == EMPTY).any(1)
        if not open_.any():
            break
        keep = open_[owner]
        tokens, owner = tokens[keep], owner[keep]
    return out


def coordinates_needed(threshold: float, recall: float, least: int) -> int:
    """How many sampled coordinates make pairs at the threshold share `least` of them with chance `recall`."""
    n = least
    while sum(math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k) for k in range(least)) > 1 - recall:
        n += 1
    return n


def sampled(path: int, threshold: float = THRESHOLD, recall: float = RECALL, used: tuple[int, ...] = ()) -> list[int]:
    """Coordinates that a node samples, run by run, until there are enough for the recall."""
    need = coordinates_needed(threshold, recall, LEAST)
    out: list[int] = []
    run = 0
    free = [c for c in range(T) if c not in used]
    while len(out) < min(need, len(free)):
        u = mixed(np.uint64(path % (1 << 64)) + np.array(free, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(run * 0xA24BAED4963EE407 % (1 << 64)))
        out += [c for c, x in zip(free, u, strict=True) if x < (1 << 64) / (threshold * T) and c not in out]
        run += 1
    return out[:need]


def child_key(path: int, coordinate: int, values: np.ndarray) -> np.ndarray:
    return mixed(np.uint64(path % (1 << 64)) ^ mixed(values.astype(np.uint64) + np.uint64((coordinate + 1) << 33))).view(np.int64)


def _parts(texts, most: int = 250_000) -> Iterator[tuple[int, int]]:
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t) if isinstance(t, str) else 0
        if size > most or k == len(texts) - 1:
            yield start, k + 1
            start, size = k + 1, 0


def sketches(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, _i, _h, d1, d2 (digest of its set, null without words), n, sig."""
    i, h = key_columns()
    had = docs.select(F.col("doc_id").cast("long").alias("doc_id"), i.alias("_i"), h.alias("_h"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = list(b["text"])
            for s, e in _parts(texts):
                sets = shingle_sets(texts[s:e])
                digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
                sig = iter(signatures([x for x in sets if len(x)]))
                yield pd.DataFrame({
                    "doc_id": b["doc_id"].iloc[s:e].to_numpy(), "_i": b["_i"].iloc[s:e].to_numpy(), "_h": b["_h"].iloc[s:e].to_numpy(),
                    "d1": pd.array([int.from_bytes(d[:8], "little", signed=True) if d else None for d in digests], "Int64"),
                    "d2": pd.array([int.from_bytes(d[8:], "little", signed=True) if d else None for d in digests], "Int64"),
                    "n": [len(x) for x in sets], "sig": [next(sig).tobytes() if len(x) else None for x in sets],
                }).astype({"doc_id": "Int64"})

    return mapped(had, run, "doc_id long, _i long, _h long, d1 long, d2 long, n long, sig binary")


def _places(mask: int) -> tuple[int, ...]:
    """The coordinates of a 64-bit mask."""
    return tuple(c for c in range(T) if mask >> c & 1)


def _signed(mask: int) -> int:
    mask %= 1 << 64
    return mask - (1 << 64) if mask >> 63 else mask


def _children(nodes: DataFrame) -> DataFrame:
    """Members of each node (path, differ, d1, d2, sig) dealt to its children: the same columns but sig, with path replaced, parent and depth."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (path, used), at in b.groupby(["path", "used"]).indices.items():
                part = b.iloc[at]
                sig = np.frombuffer(b"".join(part["sig"]), np.uint32).reshape(len(part), T)
                differ = int(part["differ"].iloc[0])
                for c in sampled(int(path), used=_places(int(used))):
                    yield pd.DataFrame({"parent": path, "path": child_key(int(path), c, sig[:, c]), "differ": _signed(differ), "used": _signed(int(used) | 1 << c), "d1": part["d1"].to_numpy(), "d2": part["d2"].to_numpy()})
                    differ |= 1 << c

    return mapped(nodes, run, "parent long, path long, differ long, used long, d1 long, d2 long")


def buckets(classes: DataFrame) -> DataFrame:
    """Where sets meet: path, differ, x, y (blocks to compare), block (the member's), split (whether there are several blocks), d1, d2."""
    root = classes.select(*[F.lit(0).cast("long").alias(c) for c in ("path", "differ", "used")], "d1", "d2", "sig")
    leaves = None
    for depth in range(1, DEPTH + 1):
        dealt = materialize(_children(root))
        sizes = dealt.groupBy("path").agg(F.count("*").alias("m"), F.first("parent").alias("parent")).where("m > 1")
        sizes = materialize(sizes)
        if depth > 1:  # nodes whose sets agree so much that splitting does not part them: their parents stay whole
            split = sizes.groupBy("parent").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("met")).join(root.groupBy("path").agg(F.count("*").alias("all")).withColumnRenamed("path", "parent"), "parent")
            dense = split.where(F.col("met") > DENSE * len(sampled(1)) * F.col("all") * F.col("all")).select("parent")
            whole = root.join(dense.withColumnRenamed("parent", "path"), "path", "left_semi").select("path", "differ", "used", "d1", "d2").withColumn("m", F.lit(BUCKET + 1).cast("long"))
            counted = whole.join(root.groupBy("path").agg(F.count("*").alias("m2")), "path").withColumn("m", F.col("m2")).drop("m2")
            leaves = leaves.unionByName(counted)
            dealt, sizes = dealt.join(dense, "parent", "left_anti"), sizes.join(dense, "parent", "left_anti")
        members = materialize(dealt.join(bounded(sizes.select("path", "m"), 32), "path").select("path", "differ", "used", "d1", "d2", "m"))
        if depth == 1:
            enough = members.groupBy("d1", "d2").agg(F.count("*").alias("met")).where(F.col("met") >= LEAST).select("d1", "d2")
            members = materialize(members.join(enough, ["d1", "d2"], "left_semi"))
        done = members if depth == DEPTH else members.where(F.col("m") <= BUCKET)
        leaves = done if leaves is None else leaves.unionByName(done)
        if depth == DEPTH or not members.where(F.col("m") > BUCKET).head(1):
            break
        large = bounded(members.where(F.col("m") > BUCKET).select("path", "differ", "used", "d1", "d2"))
        root = materialize(classes.select("d1", "d2", "sig").join(large, ["d1", "d2"]).select("path", "differ", "used", "d1", "d2", "sig"))
    blocks = F.ceil(F.col("m") / BUCKET).cast("int")
    leaves = leaves.withColumn("block", F.pmod(F.xxhash64("d1", "path"), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return leaves.select("path", "differ", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"), "block", (F.col("m") > BUCKET).alias("split"), "d1", "d2")


def _pairs(b: pd.DataFrame, sig: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of a shard that are this bucket's to compare and agree enough. Rows in order of path, x, y."""
    where = b[["path", "x", "y"]].to_numpy()
    group = np.cumsum(np.r_[False, (where[1:] != where[:-1]).any(1)]) if len(b) else np.zeros(0, int)
    differ = (b["differ"].to_numpy(np.int64)[:, None] >> np.arange(T)) & 1 > 0
    block, cross = b["block"].to_numpy(), (b["x"] != b["y"]).to_numpy()
    left = np.arange(len(b))
    for d in range(1, len(b)):
        left = left[left + d < len(b)]
        left = left[group[left] == group[left + d]]
        if not len(left):
            break
        for s in range(0, len(left), 50_000):
            i = left[s : s + 50_000]
            j = i + d
            same = sig[i] == sig[j]
            good = (same.sum(1) >= AGREE) & ~(same & differ[i]).any(1) & (~cross[i] | (block[i] != block[j]))
            if good.any():
                yield i[good], j[good]


def _sharded(rows: DataFrame, n: int) -> DataFrame:
    """`rows`, n of them, with a shard: whole buckets together, about SHARD_ROWS rows each."""
    return rows.withColumn("shard", F.pmod(F.xxhash64("path", "x", "y"), F.lit(max(1, n // SHARD_ROWS))))


def promising(met: DataFrame, classes: DataFrame) -> DataFrame:
    """The members of `met` that have a partner to be verified in that bucket. Buckets of one group of
    similar sets get one home, the value most of their members have at the root's first coordinate;
    blocks of a large bucket are at home alone."""
    lead = sampled(0)[0]

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["path", "x", "y"], ignore_index=True)
        keep = np.zeros(len(b), bool)
        sig = np.frombuffer(b"".join(b["sig"]), np.uint32).reshape(len(b), T)
        for i, j in _pairs(b, sig):
            keep[i] = keep[j] = True
        out, value = b.loc[keep, ["path", "differ", "x", "y", "block", "split", "d1", "d2"]], sig[keep][:, lead]
        if not len(out):
            return out.drop(columns="split").assign(home=0)
        group = out.groupby(["path", "x", "y"], sort=False).ngroup().to_numpy()
        order = np.lexsort((value, group))
        first = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
        middle = value[order[(first + np.r_[first[1:], len(out)]) // 2]].astype(np.int64)  # what a majority has stands in the middle
        alone = out["path"].to_numpy(np.int64) ^ (out["x"].to_numpy(np.int64) << 20) ^ out["y"].to_numpy(np.int64)
        return out.drop(columns="split").assign(home=np.where(out["split"], alone, middle[group]))

    full = _sharded(met, met.count()).join(classes.select("d1", "d2", "sig"), ["d1", "d2"])
    return full.groupBy("shard").applyInPandas(lambda b: run(b), "path long, differ long, x int, y int, block int, d1 long, d2 long, home long")


def verified(wanted: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Per home and set: d1, d2, links (sets at least THRESHOLD similar), r1, r2 (the least set linked to it there)."""
    i, h = key_columns()
    need = bounded(wanted.select("d1", "d2").distinct().join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).select("d1", "d2", "rep._i", "rep._h"))
    texts = docs.select(i.alias("_i"), h.alias("_h"), F.col("text").cast("string").alias("text")).join(need, ["_i", "_h"]).dropDuplicates(["d1", "d2"]).select("d1", "d2", "text")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, e in _parts(list(b["text"])):
                yield pd.DataFrame({"d1": b["d1"].iloc[s:e].to_numpy(), "d2": b["d2"].iloc[s:e].to_numpy(), "tokens": [x.tobytes() for x in shingle_sets(list(b["text"].iloc[s:e]))]})

    sets = materialize(texts.mapInPandas(fetch, "d1 long, d2 long, tokens binary"))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        tokens = [np.frombuffer(t, np.uint64) for t in b["tokens"]]
        sizes = np.array([len(t) for t in tokens])
        row = np.repeat(np.arange(len(b)), [len(x) for x in b["path"]])
        met = pd.DataFrame({c: np.concatenate(b[c].to_list()) for c in ("path", "differ", "x", "y", "block")} | {"row": row}).sort_values(["path", "x", "y"], ignore_index=True)
        row = met["row"].to_numpy()
        links, parent = np.zeros(len(b), np.int64), list(range(len(b)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        _, ids = np.unique(np.concatenate(tokens), return_inverse=True)
        at = np.cumsum(sizes) - sizes
        flag = np.zeros(ids.max() + 1, np.int32)
        partners: dict[int, list[np.ndarray]] = {}
        for i, j in _pairs(met, signatures(tokens)[row]):
            for x, y in zip(row[i].tolist(), row[j].tolist(), strict=True):
                partners.setdefault(x, []).append(y)
        for i, js in partners.items():
            js = np.array(js)
            flag[ids[at[i] : at[i] + sizes[i]]] = 1
            flat = np.concatenate([ids[at[j] : at[j] + sizes[j]] for j in js])
            shared = np.add.reduceat(flag[flat], np.r_[0, np.cumsum(sizes[js])[:-1]])
            flag[ids[at[i] : at[i] + sizes[i]]] = 0
            # similarity >= THRESHOLD in whole numbers: 5 shared >= 4 united
            good = js[shared * 5 >= (sizes[js] + sizes[i] - shared) * 4] if THRESHOLD == 0.8 else js[shared >= THRESHOLD * (sizes[js] + sizes[i] - shared)]
            links[i] += len(good)
            links[good] += 1
            for j in good:
                x, y = find(i), find(int(j))
                if x != y:
                    parent[max(x, y)] = min(x, y)
        d = list(zip(b["d1"], b["d2"], strict=True))
        least: dict[int, tuple] = {}
        for k in range(len(b)):
            r = find(k)
            least[r] = min(least.get(r, d[k]), d[k])
        rows = [(*d[k], int(links[k]), *least[find(k)]) for k in range(len(b)) if links[k]]
        return pd.DataFrame(rows, columns=["d1", "d2", "links", "r1", "r2"])

    # a set moves once to each home; full sets are larger than signatures: a twentieth of the rows in a shard
    places = wanted.groupBy("home", "d1", "d2").agg(F.collect_list(F.struct("path", "differ", "x", "y", "block")).alias("at"))
    places = materialize(places.select("home", "d1", "d2", *[F.col(f"at.{c}").alias(c) for c in ("path", "differ", "x", "y", "block")]))
    shard = F.pmod(F.xxhash64("home"), F.lit(max(1, 20 * places.count() // SHARD_ROWS)))
    return sets.join(bounded(places.withColumn("shard", shard), F.size("path") * 40 + 64), ["d1", "d2"]).groupBy("shard").applyInPandas(lambda b: run(b), "d1 long, d2 long, links long, r1 long, r2 long")


def groups(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, _i, _h, class_id and rep (least document of its group), n_links (different sets linked), n_copies (rows with the same set), n_shingles."""
    rows = materialize(sketches(docs))
    classes = materialize(rows.where("d1 is not null").groupBy("d1", "d2").agg(F.min(F.struct("_i", "_h")).alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig")))
    met = materialize(buckets(classes))
    wanted = materialize(promising(met, classes))
    links = materialize(verified(wanted, docs, classes))
    edges = links.select(F.struct("d1", "d2").alias("src"), F.struct(F.col("r1").alias("d1"), F.col("r2").alias("d2")).alias("dst"))
    parts = materialize(connected_components(edges))
    counted = links.groupBy("d1", "d2").agg(F.sum("links").alias("links"))
    named = classes.select("d1", "d2", "rep", "copies").join(parts.select("v.d1", "v.d2", "root"), ["d1", "d2"], "left").join(counted, ["d1", "d2"], "left")
    heads = named.where("root is not null").groupBy("root").agg(F.min("rep").alias("head"))
    named = named.join(heads, "root", "left").select("d1", "d2", F.coalesce("head", "rep").alias("rep"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    got = rows.select("doc_id", "_i", "_h", "d1", "d2", "n").join(named, ["d1", "d2"], "left")
    rep = F.coalesce("rep", F.struct("_i", "_h"))
    return got.select("doc_id", "_i", "_h", F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("rep._i")).alias("class_id"), rep.alias("rep"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"), F.col("n").alias("n_shingles"))


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs`, columns kept, without all but the least document of each group; rows without words stay."""
    found = materialize(groups(docs).where("n_shingles > 0").groupBy("_i", "_h").agg(F.first(F.col("rep") != F.struct("_i", "_h")).alias("gone"), F.count("*").alias("n")))
    again = bounded(found.where("n > 1 and not gone").select("_i", "_h"))  # kept, but their rows repeat
    once = without(docs, found.where("gone or n > 1"))
    return once.unionByName(wrapped(docs).join(again, ["_i", "_h"], "left_semi").dropDuplicates(["_i", "_h"]).select("doc.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies", "n_shingles")
