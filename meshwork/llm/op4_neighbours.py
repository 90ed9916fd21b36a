"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample (`SAMPLE` vectors, picked by a hash) down to leaves that
stand for about `LEAF` vectors. Leaves that turn out to hold more than `CROWDED` times that are
refitted, each from a bounded sample of its own (`REFIT` vectors) in a task of its own, so leaves
multiply with the data. Every vector is indexed: it descends to one leaf. A query walks the tree with
a priority queue, the branch with the best expected inner product first, and visits leaves in that
order. How many is calibrated: for `CALIBRATION` sampled queries the exact neighbours are found
among all vectors, and the leaf budget is widened until `TARGET` of them lie in visited leaves.
Products and scores are in double precision on the original vectors.

Scale: leaves that are neighbours in the tree share a block of at most `BLOCK` vectors; a leaf with
more (or one repeated vector) that holds a third of all rows is salted into several. Vectors move to
their block, and a query once to each block in which it visits leaves, with the list of those
leaves; blocks that more than `ASKED` queries visit are copied for parts of them, so no task holds
an unbounded group. The search has two rounds: the block of a query's first leaf gives the score of
its `k`-th neighbour so far, and from other blocks only better rows leave the task, so what leaves is
about in proportion to the queries. A block keeps at most the `k` + 1 smallest ids of equal vectors,
which no query can look beyond. What the driver and every task hold is the tree: a row of centres
for each leaf, at most about `SAMPLE` / `LEAST` leaves, each refitted into `REFIT` / `LEAST`.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components, and rows with null ids take no part. Ties go to the smaller id. Rows that
repeat an id are rows of their own: each is a candidate of all others, and each is a query if its id
is one. A query whose leaves hold fewer than `k` + 1 vectors visits more, so fewer than `k` rows are
returned only if there are no more candidates. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, materialize, table

K, EVERY = 20, 20
SAMPLE, REFIT, BRANCH, ROUNDS, SEED = 20_000, 2_000, 8, 12, 7
LEAF, LEAST, CROWDED = 128, 32, 8
CALIBRATION, TARGET = 100, 0.94
BLOCK, ASKED = 8_192, 8_192


class Tree:
    """Centres and spreads of a hierarchical k-means tree; leaves are numbered from left to right."""

    def __init__(self, x: np.ndarray, share: float = 1.0):
        """`share`: how many of the vectors that the tree is for are in the sample `x`."""
        self.nodes: list[tuple[np.ndarray, np.ndarray, list[int]]] = []  # centres, spreads, children (negative: leaf)
        self.leaves, self.share = 0, share
        self.root = self._grow(x, np.random.default_rng(SEED))

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, x: np.ndarray, rng) -> int:
        if len(x) <= max(LEAST, LEAF * self.share):
            return self._leaf()
        c = x[rng.choice(len(x), BRANCH, replace=False)]
        for _ in range(ROUNDS):
            at = self._nearest(x, c)
            c = np.stack([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
        c = np.unique(c, axis=0)
        at = self._nearest(x, c)
        parts = [x[at == j] for j in range(len(c))]
        if max(map(len, parts)) == len(x):
            return self._leaf()
        me = len(self.nodes)
        self.nodes.append((c, np.array([self._spread(p, m) for p, m in zip(parts, c, strict=True)]), []))
        self.nodes[me][2].extend(self._grow(p, rng) for p in parts)
        return me

    def _spread(self, x: np.ndarray, centre: np.ndarray) -> float:
        """How far beyond its centre the best of a branch's vectors is expected along a direction:
        the largest of as many normal deviates, whose variance is the branch's, shared by its dimensions."""
        many = max(2.0, len(x) / self.share)
        return float(np.sqrt(((x - centre) ** 2).sum(1).mean() * 2 * np.log(many) / x.shape[1])) if len(x) else 0.0

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)

    def graft(self, below: dict[int, Tree]) -> None:
        """Replaces leaves by trees and numbers the leaves anew."""
        for leaf, t in below.items():
            shift = len(self.nodes)
            self.nodes += [(c, r, [k + shift if k >= 0 else k for k in kids]) for c, r, kids in t.nodes]
            for _, _, kids in self.nodes[:shift]:
                kids[:] = [shift + t.root if k == -leaf - 1 else k for k in kids]
            if self.root == -leaf - 1:
                self.root = shift + t.root
            for _, _, kids in self.nodes[shift:]:
                kids[:] = [k if k >= 0 else k - (1 << 40) for k in kids]  # not a leaf of this tree to be replaced next
        self.leaves, todo = 0, [(None, 0, self.root)]
        while todo:
            kids, j, node = todo.pop()
            if node >= 0:
                todo += [(self.nodes[node][2], j, k) for j, k in reversed(list(enumerate(self.nodes[node][2])))]
            elif kids is None:
                self.root = self._leaf()
            else:
                kids[j] = self._leaf()

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf (from 0) of each vector."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                c, _, below = self.nodes[node]
                at = self._nearest(x[rows], c)
                todo += [(child, rows[at == j]) for j, child in enumerate(below)]
        return out

    def visit(self, q: np.ndarray, budget: int, held: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """The first `budget` leaves, best bin first, and more until they hold (vectors by leaf) at least `least`."""
        out, size, found = [], np.sqrt((q * q).sum()), 0
        queue = [(-np.inf, self.root)]
        while queue and (len(out) < budget or found < least):
            _, node = heapq.heappop(queue)
            if node < 0:
                out.append(-node - 1)
                found += (held or {}).get(out[-1], 0)
                continue
            c, spread, below = self.nodes[node]
            for s, child in zip(c @ q + spread * size, below, strict=True):
                heapq.heappush(queue, (-s, child))
        return out


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id and v of the rows that take part; v stays an array of floats where it is one."""
    kind = "array<float>" if dict(rows.dtypes)[embedding] == "array<float>" else "array<double>"
    v = F.col(embedding).cast(kind)
    ok = F.col(vec_id).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")).cast(kind[6:-1]))) & F.exists(v, lambda x: x != 0)
    good = rows.where(ok).select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))
    common = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head()
    return good.where(F.size("v") == (common["n"] if common else 0))


def _stack(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_list()).astype(np.float64, copy=False)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of two sets of rows, pair by pair in one order: equal vectors score equally."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def best(qrow: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, bound: np.ndarray | None = None, leaf: np.ndarray | None = None, asked: list | None = None) -> tuple[np.ndarray, ...]:
    """The k nearest rows of a block to each query, itself (by row) left out: places of queries, rows,
    ids, scores. `bound`: scores below it are of no interest. `leaf` of each row and `asked`, the
    leaves that each query visits: products are made for those only."""
    leaf = np.zeros(len(ids), np.int64) if leaf is None else leaf
    order = np.lexsort((rows, ids, leaf))
    rows, ids, leaf, x = rows[order], ids[order], leaf[order], np.ascontiguousarray(x[order])
    _, inverse = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    by = np.lexsort((np.arange(len(ids)), leaf, inverse))  # equal vectors have one leaf
    start = np.r_[0, np.flatnonzero(np.diff(inverse[by])) + 1]
    nth = np.arange(len(by)) - np.repeat(start, np.diff(np.r_[start, len(by)]))
    few = np.sort(by[nth <= k])  # of equal vectors, k and the query itself can count
    rows, ids, leaf, x = rows[few], ids[few], leaf[few], x[few]
    first = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
    cuts, last = list(zip(leaf[first].tolist(), first.tolist(), np.r_[first[1:], len(leaf)].tolist(), strict=True)), -np.finfo(float).max
    low = np.full(len(q), last) if bound is None else np.maximum(bound - 1e-9 * np.maximum(1.0, np.abs(bound)), last)
    out = []
    for s in range(0, len(q), 512):
        part = q[s : s + 512]
        rough = np.full((len(part), len(ids)), -np.inf)
        wants = None if asked is None else pd.Series(asked[s : s + 512]).explode()
        by_leaf = {} if wants is None else {n: g.to_numpy() for n, g in wants.reset_index().groupby(0)["index"]}
        for n, a, b in cuts:
            if asked is None:
                rough[:, a:b] = part @ x[a:b].T
            elif n in by_leaf:
                rough[by_leaf[n], a:b] = part[by_leaf[n]] @ x[a:b].T
        rough[qrow[s : s + 512, None] == rows[None, :]] = -np.inf
        n = min(k, len(ids))
        kth = low[s : s + 512]
        if len(ids) > n:
            top = -np.partition(-rough, n - 1, axis=1)[:, n - 1]
            kth = np.maximum(kth, np.where(np.isfinite(top), top - 1e-9 * np.maximum(1.0, np.abs(top)), last))
        at, row = np.nonzero(rough >= kth[:, None])
        exact = products(part[at], x[row])
        o = np.lexsort((rows[row], ids[row], -exact, at))
        at, row, exact = at[o], row[o], exact[o]
        keep = np.arange(len(at)) - np.searchsorted(at, at) < k
        out.append((s + at[keep], rows[row[keep]], ids[row[keep]], exact[keep]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


FOUND = "query_row long, query_id long, vec_row long, vec_id long, score double"


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query row, with their rank."""
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_neighbours(rows: DataFrame, queries: list, k: int) -> dict[int, list[int]]:
    """Brute force for a bounded list of queries (row, id, v): each partition sends k rows per query."""
    qrow, qid, q = np.array([r["row"] for r in queries]), np.array([r["id"] for r in queries]), np.array([r["v"] for r in queries], float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def found() -> pd.DataFrame:
            b = pd.concat(held)
            at, row, ids, s = best(qrow, q, b["row"].to_numpy(), b["id"].to_numpy(), _stack(b["v"]), k)
            return pd.DataFrame({"query_row": qrow[at], "query_id": qid[at], "vec_row": row, "vec_id": ids, "score": s})

        for b in batches:
            held += [b] if len(b) else []
            if sum(map(len, held)) >= BLOCK:
                yield found()
                held.clear()
        if held:
            yield found()

    out: dict[int, list[int]] = {}
    for r in nearest(mapped(rows.select("row", "id", "v"), run, FOUND), k).collect():
        out.setdefault(r["query_row"], []).append(r["vec_row"])
    return out


def _place(seed: str):
    """A number from 0 to 1 by hash of the row."""
    return F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _assigned(rows: DataFrame, tree: Tree) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(leaf=tree.assign(_stack(b["v"])))

    return mapped(rows.select("row", "id", "v"), run, f"row long, id long, v {dict(rows.dtypes)['v']}, leaf long")


def _sizes(assigned: DataFrame) -> dict[int, int]:
    return {r["leaf"]: r["n"] for r in assigned.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row per leaf: bounded by the tree


def build(rows: DataFrame) -> tuple[Tree, DataFrame, dict[int, int]] | None:
    """The tree, the index (every vector with its leaf) and how many vectors each leaf holds."""
    n = rows.count()
    if not n:
        return None
    share = min(1.0, SAMPLE / n)
    sample = rows.where(_place("tree sample") < share).orderBy("row").limit(2 * SAMPLE).toPandas()
    sample = sample if len(sample) else rows.limit(1).toPandas()
    tree = Tree(_stack(sample["v"]), share)
    indexed = materialize(_assigned(rows, tree))
    sizes = _sizes(indexed)
    crowded = [(leaf, min(1.0, REFIT / m)) for leaf, m in sizes.items() if m > CROWDED * LEAF]
    if crowded:
        shares = dict(crowded)

        def refit(b: pd.DataFrame) -> pd.DataFrame:
            leaf = int(b["leaf"].iloc[0])
            return pd.DataFrame({"leaf": [leaf], "tree": [pickle.dumps(Tree(_stack(b.sort_values("row")["v"]), shares[leaf]))]})

        small = rows.sparkSession.createDataFrame(crowded, "leaf long, share double")
        picked = indexed.join(F.broadcast(small), "leaf").where(_place("refit") < F.col("share")).select("leaf", "row", "v")
        below = {r["leaf"]: pickle.loads(r["tree"]) for r in picked.groupBy("leaf").applyInPandas(refit, "leaf long, tree binary").collect()}
        tree.graft({leaf: t for leaf, t in below.items() if t.leaves > 1})
        indexed = materialize(_assigned(rows, tree))
        sizes = _sizes(indexed)
    return tree, indexed, sizes


def calibrated_budget(tree: Tree, indexed: DataFrame, queries: DataFrame, k: int, target: float = TARGET) -> int:
    """Leaves to visit so that `target` of the exact neighbours of sampled queries are in them."""
    asked = queries.select("row", "id", "v").orderBy(F.xxhash64("row"), "row").limit(CALIBRATION).collect()
    truth = exact_neighbours(indexed, asked, k)
    wanted = sorted({i for rows in truth.values() for i in rows})  # at most CALIBRATION x k
    leaf = {r["row"]: r["leaf"] for r in indexed.where(F.col("row").isin(wanted)).select("row", "leaf").collect()}
    ranks = []
    for r in asked:
        place = {x: n for n, x in enumerate(tree.visit(np.array(r["v"], float), tree.leaves))}
        ranks += [place[leaf[x]] + 1 for x in truth.get(r["row"], [])]
    return int(np.quantile(ranks, target, method="higher")) if ranks else tree.leaves


def blocks(sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """For each leaf that holds vectors its block, and into how many it is salted: leaves next to each
    other share a block of BLOCK vectors at most."""
    out, block, used = {}, 0, 0
    for leaf in sorted(sizes):
        n = sizes[leaf]
        if used and used + n > BLOCK:
            block, used = block + 1, 0
        out[leaf] = (block, -(-n // BLOCK))
        used += n
    return out


def search(rows: DataFrame, is_query, k: int = K, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: for rows where `is_query` holds (a column over `id`), their k nearest others."""
    spark = rows.sparkSession
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    built = build(rows)
    if built is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree, indexed, sizes = built
    queries, kind = indexed.where(is_query).select("row", "id", "v"), dict(rows.dtypes)["v"]
    budget = calibrated_budget(tree, indexed, queries, k, target)
    at = blocks(sizes)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["row", "id", "v", "block", "salt", "first", "leaves"]
        for b in batches:
            for s in range(0, len(b), 128):
                got, part = [], b.iloc[s : s + 128]
                for row, i, v, y in zip(part["row"], part["id"], part["v"], _stack(part["v"]), strict=True):
                    by: dict[int, list[int]] = {}  # in the order of visits
                    for leaf in tree.visit(y, budget, sizes, k + 1):
                        if leaf in at:
                            by.setdefault(at[leaf][0], []).append(leaf)
                    got += [(row, i, v, block, salt, n == 0, leaves) for n, (block, leaves) in enumerate(by.items()) for salt in range(max(at[x][1] for x in leaves))]
                yield pd.DataFrame(got, columns=names)

    asked = materialize(mapped(queries, route, f"row long, id long, v {kind}, block long, salt int, first boolean, leaves array<long>"))
    parts = asked.groupBy("block", "salt").agg(F.ceil(F.count("*") / F.lit(ASKED)).cast("int").alias("parts"))
    known = spark.createDataFrame([(int(x), int(b), int(n)) for x, (b, n) in at.items()], "leaf long, block long, salts int")  # a row per leaf
    salted = indexed.join(F.broadcast(known), "leaf").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int"))
    salted = salted.join(parts, ["block", "salt"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("block", "salt", "part", "row", "id", "v", "leaf")
    asked = asked.join(parts, ["block", "salt"]).withColumn("part", F.pmod(F.xxhash64("row", F.lit("part")), F.col("parts")).cast("int")).drop("parts")
    # equal vectors that are salted apart may come k + 1 times from each salt; the last window cuts them

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")})
        qrow, qid = left["row"].to_numpy(), left["id"].to_numpy()
        bound = left["bound"].fillna(-np.inf).to_numpy(float) if "bound" in left else None
        n, row, ids, s = best(qrow, _stack(left["v"]), right["row"].to_numpy(), right["id"].to_numpy(), _stack(right["v"]), k, bound, right["leaf"].to_numpy(), list(left["leaves"]))
        return pd.DataFrame({"query_row": qrow[n], "query_id": qid[n], "vec_row": row, "vec_id": ids, "score": s})

    def looked(queries: DataFrame) -> DataFrame:
        key = ["block", "salt", "part"]
        return queries.groupBy(*key).cogroup(salted.groupBy(*key)).applyInPandas(look, FOUND)

    home = materialize(nearest(looked(asked.where("first")), k).drop("rank"))
    bound = home.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count("*") == k, F.min("score")).alias("bound"))
    rest = looked(asked.where("not first").join(bound, "row", "left"))
    return nearest(home.unionByName(rest), k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(usable(table(spark, sf_dir, "embeddings")), F.pmod(F.col("id"), F.lit(EVERY)) == 0)
