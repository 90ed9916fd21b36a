"""Dense graphs as packed blocks of their adjacency: (i, j, rows, cols, bits).

Twins, vertices in exactly the same groups, have the same neighbours, so a block holds one of them
for all: the least of a class, and what a class has of members stands in a table beside the blocks.
Vertices are dealt to blocks by ranges of ids, twins by the least id of theirs; a block's part of a
larger class is a class of its own. A row holds the classes that it has of block i and of block j
(ascending 64-bit numbers) and a bit, deflated, for each of their pairs, a vertex and itself included;
i <= j, and a block against itself holds both directions. Pairs are never shuffled: what moves are the
members of groups, each once for each block that its group reaches, and packed blocks. A Python worker
holds one block at a time, `BLOCK` vertices wide, more or less.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.plans.storage import materialize, measured

#: Vertices of a block, more or less, and the least number of blocks, for tasks to share a small graph.
BLOCK, LEAST_BLOCKS = 4096, 4
#: Vertices up to which their blocks are sent to every executor.
BROADCAST_VERTICES = 1 << 20
#: Pairs that are worked on or handed on at a time, and rows of a batch that a Python worker gets.
CHUNK, BATCH_ROWS = 1 << 19, 256
#: Pairs of one group up to which groups are spelt out together.
SMALL = 1 << 7
#: Rows of a block that are multiplied at a time: what they have no edge to is left out.
STRIP = 256

SCHEMA = "i int, j int, rows binary, cols binary, bits binary"


class Blocks(NamedTuple):
    """Packed blocks, and (b, c, n, m) of block b: its classes of several vertices, ascending, their
    numbers of members and the members, class by class. None: there are no twins."""

    cells: DataFrame
    twins: DataFrame | None
    few: bool


class _Cell:
    """Which pairs of the vertices of two blocks (or of one) were seen."""

    def __init__(self, same: bool):
        self.same, self.rows, self.cols = same, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.seen = np.zeros((0, 0), bool)

    def _widen(self, left: np.ndarray, right: np.ndarray) -> None:
        rows = np.union1d(self.rows, np.union1d(left, right) if self.same else left)
        cols = rows if self.same else np.union1d(self.cols, right)
        if len(rows) > len(self.rows) or len(cols) > len(self.cols):
            seen = np.zeros((len(rows), len(cols)), bool)
            seen[np.ix_(np.searchsorted(rows, self.rows), np.searchsorted(cols, self.cols))] = self.seen
            self.rows, self.cols, self.seen = rows, cols, seen

    def add(self, left: pa.ListArray, right: pa.ListArray) -> None:
        """Members on either side, group by group."""
        (a, u), (b, v) = _lists(left), _lists(right)
        self._widen(u, v)
        u, v = np.searchsorted(self.rows, u), np.searchsorted(self.cols, v)
        n, m = np.diff(a), np.diff(b)
        for k in np.flatnonzero(n * m > SMALL):
            self.seen[np.ix_(u[a[k] : a[k + 1]], v[b[k] : b[k + 1]])] = True
        few = np.flatnonzero(n * m <= SMALL)
        for part in np.split(few, np.flatnonzero(np.diff(np.cumsum((n * m)[few]) // CHUNK)) + 1):
            pairs = (n * m)[part]
            of = np.repeat(np.arange(len(part)), pairs)
            at = np.arange(len(of)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            width = m[part][of]
            self.seen[u[a[part][of] + at // width], v[b[part][of] + at % width]] = True

    def packed(self) -> tuple[bytes, bytes, bytes] | None:
        if self.seen.any():
            return self.rows.tobytes(), self.cols.tobytes(), zlib.compress(np.packbits(self.seen).tobytes(), 1)
        return None


def _lists(x: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each list begins and ends, and the values."""
    ends = x.offsets.to_numpy().astype(np.int64)
    return ends - ends[0], x.flatten().to_numpy(zero_copy_only=False)


def unpacked(rows: bytes, cols: bytes, bits: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r, c = np.frombuffer(rows, np.int64), np.frombuffer(cols, np.int64)
    return r, c, np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=len(r) * len(c)).reshape(len(r), len(c)).view(bool)


def _mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow over batches of at most BATCH_ROWS rows: a row may hold megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(key)) > BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def _dealt(df: DataFrame, blocks: int, *then: str) -> DataFrame:
    """All rows of a pair of blocks together, pairs dealt evenly over tasks."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(blocks * (blocks + 1) // 2, 2000))
    place = (F.col("j").cast("long") * (F.col("j") + 1) / 2).cast("long") + F.col("i")
    return df.repartitionById(parts, F.pmod(place, F.lit(parts)).cast("int")).sortWithinPartitions("i", "j", *then)


def _marks(group: list[str]) -> list:
    """What vertices of the same groups agree in."""
    return [F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(F.lit(k), *group)).alias(f"h{k}") for k in (1, 2)]]


def _small(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _twins(one: DataFrame, items: DataFrame, group: list[str], few: bool) -> DataFrame | None:
    """(v, rep) of all vertices, rep the least one in the same groups; None if there are no twins."""
    alike, seen = measured(items.groupBy("n", "h1", "h2").agg(F.min("v").alias("rep"), F.count("*").alias("size")).where("size > 1"))
    if not seen["rows"]:
        return None
    of = materialize(items.join(alike, ["n", "h1", "h2"], "left").select("v", "rep", "size"))
    # equal marks prove nothing: each group of a class must have all of it
    met = one.join(_small(of.where("rep is not null"), few), "v").groupBy("rep", "size", *group).agg(F.count("*").alias("n"))
    wrong = materialize(met.where("n <> size").select("rep").distinct().withColumn("wrong", F.lit(True)))
    return of.join(wrong, "rep", "left").select("v", F.when(F.col("rep").isNull() | F.col("wrong").isNotNull(), F.col("v")).otherwise(F.col("rep")).alias("rep"))


def together(df: DataFrame, item: str, *by: str) -> Blocks:
    """Packed blocks of the graph that joins items which share a group; rows with nulls share none."""
    group = [f"g{k}" for k in range(len(by))]
    known = df.select(F.col(item).cast("long").alias("v"), *[F.col(c).alias(g) for c, g in zip(by, group, strict=True)])
    for c in known.columns:
        known = known.where(F.col(c).isNotNull())
    one = materialize(known.distinct())
    items, seen = measured(one.groupBy("v").agg(*_marks(group)))
    blocks, few = max(LEAST_BLOCKS, -(-seen["rows"] // BLOCK)), seen["rows"] <= BROADCAST_VERTICES
    classes, twins = _twins(one, items, group, few), None
    if classes is None:
        of = materialize(items.repartitionByRange(blocks, "v").select("v", F.spark_partition_id().alias("b")))
    else:
        dealt = materialize(classes.repartitionByRange(blocks, "rep", "v").select("v", "rep", F.spark_partition_id().alias("b")))
        parts = materialize(dealt.groupBy("b", "rep").agg(F.array_sort(F.collect_list("v")).alias("m")).select("b", F.col("m")[0].alias("c"), F.size("m").alias("n"), "m"))
        several = parts.where("n > 1").groupBy("b").agg(F.array_sort(F.collect_list(F.struct("c", "n", "m"))).alias("s"))
        of, twins = parts.select(F.col("c").alias("v"), "b"), materialize(several.select("b", "s.c", "s.n", F.flatten("s.m").alias("m")))
    member = one.join(_small(of, few), "v")
    held = materialize(member.groupBy(*group, "b").agg(F.collect_list("v").alias("m")))
    x, y = held.select(*group, F.col("b").alias("i"), F.col("m").alias("l")), held.select(*group, F.col("b").alias("j"), F.col("m").alias("r"))

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell = None, None
        for b in batches:
            i, j = b.column("i").to_numpy(), b.column("j").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0)) + 1), len(i)]
            for st, ed in zip(cuts[:-1], cuts[1:], strict=True):
                if ed > st:
                    if key != (i[st], j[st]):
                        yield from _row(key, cell)
                        key, cell = (i[st], j[st]), _Cell(i[st] == j[st])
                    cell.add(b.column("l").slice(st, ed - st), b.column("r").slice(st, ed - st))
        yield from _row(key, cell)

    both = x.join(y, [*group]).where("i <= j").select("i", "j", "l", "r")
    return Blocks(_mapped(_dealt(both, blocks), union, SCHEMA), twins, few)


def _row(key, cell: _Cell | None) -> Iterator[pa.RecordBatch]:
    if cell is not None and (p := cell.packed()):
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), *[pa.array([x], pa.binary()) for x in p]], ["i", "j", "rows", "cols", "bits"])


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def _with_twins(df: DataFrame, blocks: Blocks, *sides: tuple[str, str]) -> DataFrame:
    """For each (column of a block's number, prefix): the block's classes of several, or nulls."""
    for at, prefix in sides:
        names = [f"{prefix}{x}" for x in "cnm"]
        if blocks.twins is None:
            df = df.withColumns({x: F.lit(None).cast(kind) for x, kind in zip(names, ("array<bigint>", "array<int>", "array<bigint>"), strict=True)})
        else:
            df = df.join(_small(blocks.twins.toDF(at, *names), blocks.few), at, "left")
    return df


def _list(b: pa.RecordBatch, column: str, x: int) -> np.ndarray | None:
    got = b.column(column)[x]
    return got.values.to_numpy(zero_copy_only=False) if got.is_valid else None


def _sizes(classes: np.ndarray, c: np.ndarray | None, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of members, and which of `c` are among the classes."""
    sizes = np.ones(len(classes), np.int64)
    if c is None or not len(classes):
        return sizes, np.zeros(0 if c is None else len(c), bool)
    at = np.minimum(np.searchsorted(classes, c), len(classes) - 1)
    here = classes[at] == c
    sizes[at[here]] = n[here]
    return sizes, here


def _spelt(classes: np.ndarray, c: np.ndarray | None, n: np.ndarray | None, m: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """All members of the classes, class by class, and the place of each one's class."""
    sizes, here = _sizes(classes, c, n)
    of = np.repeat(np.arange(len(classes)), sizes)
    ids = classes[of]
    if here.any():
        ids[sizes[of] > 1] = m[np.repeat(here, n)]
    return ids, of


def _ones(seen: np.ndarray, up: np.ndarray, down: np.ndarray, same: bool, once: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of members whose classes are set, some rows at a time; up, down: the members'
    classes. Of a block and itself, no vertex meets itself, and pairs come in both orders or only once."""
    step = max(1, CHUNK // max(1, len(down)))
    whole = len(down) == seen.shape[1]
    for k in range(0, len(up), step):
        part = seen[up[k : k + step]]
        part = part if whole else part[:, down]
        if same and once:
            part = np.triu(part, k + 1)
        elif same:
            at = np.arange(len(part))
            part[at, at + k] = False
        r, c = np.nonzero(part)
        if len(r):
            yield r + k, c


def edges(blocks: Blocks) -> DataFrame:
    """(src, dst) in both directions."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in range(b.num_rows):
                i, j, *packed = (b.column(k)[x].as_py() for k in ("i", "j", "rows", "cols", "bits"))
                rows, cols, seen = unpacked(*packed)
                (rows, up), (cols, down) = (_spelt(ids, *(_list(b, f"{side}{k}", x) for k in "cnm")) for ids, side in ((rows, "i"), (cols, "j")))
                for r, c in _ones(seen, up, down, i == j):
                    yield _batch(src=rows[r], dst=cols[c])
                if i != j:
                    for c, r in _ones(np.ascontiguousarray(seen.T), down, up, False):
                        yield _batch(src=cols[c], dst=rows[r])

    return _mapped(_with_twins(blocks.cells, blocks, ("i", "i"), ("j", "j")), spell, "src long, dst long")


def closed_common(blocks: Blocks) -> DataFrame:
    """(src, dst, sim) of every canonical edge: vertices in both closed neighbourhoods, the full count.

    A pair of blocks sums, over all blocks k, products of the adjacency of either with k, a class of k
    as often as it has members; it is sent the packed blocks of its two rows, and counts of pairs are
    never moved.
    """
    held, seen = measured(blocks.cells, most=F.max("j"))
    n = (seen["most"] or 0) + 1
    at, plain = held.select("i", "j"), held.select("i", F.col("j").alias("k"), "rows", "cols", "bits", F.lit(False).alias("flip"))
    ways = plain.union(held.where("i <> j").select("j", F.col("i").alias("k"), "rows", "cols", "bits", F.lit(True)))
    sizes = Blocks(blocks.cells, blocks.twins.select("b", "c", "n", F.lit(None).cast("array<bigint>").alias("m")) if blocks.twins is not None else None, blocks.few)
    ways = _with_twins(ways, sizes, ("k", "i")).withColumns({f"j{x}": F.col(f"i{x}") for x in "cnm"})
    own = [f"{side}{x}" for side in "ij" for x in "cnm"]
    cols = ["i", "j", "k", "side", "flip", "rows", "cols", "bits", *own]
    first = at.join(ways, "i").withColumn("side", F.lit(0)).select(cols)
    second = at.where("i <> j").join(ways.withColumnRenamed("i", "j"), "j").withColumn("side", F.lit(1)).select(cols)
    target = _with_twins(held, blocks, ("i", "i"), ("j", "j")).select("*", F.lit(-1).alias("k"), F.lit(0).alias("side"), F.lit(False).alias("flip")).select(cols)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = cols = wanted = total = left = members = None
        for b in batches:
            for x in range(b.num_rows):
                i, j, k, side, flip, *packed = (b.column(c)[x].as_py() for c in ("i", "j", "k", "side", "flip", "rows", "cols", "bits"))
                if k < 0:
                    yield from _counted(members, wanted, total)
                    rows, cols, wanted = unpacked(*packed)
                    members = i == j, *(_spelt(ids, *(_list(b, f"{s}{c}", x) for c in "cnm")) for ids, s in ((rows, "i"), (cols, "j")))
                    total, left = np.zeros(wanted.shape, np.int32), None
                    continue
                u, v, has = unpacked(*packed)
                u, v, has = (v, u, has.T) if flip else (u, v, has)
                if side == 0:
                    left = k, _aligned(rows, u), v, has
                if i == j or side == 1 and left and left[0] == k:
                    sizes = _sizes(v, *(_list(b, f"i{c}", x) for c in "cn"))[0]
                    _add(total, left, left[1:] if i == j else (_aligned(cols, u), v, has), sizes)
        yield from _counted(members, wanted, total)

    rows = _dealt(first.union(second).union(target), n, "k", "side")
    return _mapped(rows, count, "src long, dst long, sim long")


def _aligned(wanted: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both arrays of what stands in both."""
    return np.intersect1d(wanted, has, assume_unique=True, return_indices=True)[1:]


def _add(total: np.ndarray, left: tuple, right: tuple, sizes: np.ndarray) -> None:
    """Adds the products of two blocks' rows, over the vertices that both have as columns; sizes: of the right one's."""
    _, (to_r, of_r), v, a = left
    (to_c, of_c), w, b = right
    x, y = _aligned(v, w)
    a, b = a[np.ix_(of_r, x)], b[np.ix_(of_c, y)]
    ones = b.astype(np.float32)  # sums of a block's vertices are exact
    if (sizes > 1).any():
        ones *= sizes[y].astype(np.float32)
    for k in range(0, len(a), STRIP):
        part, at = a[k : k + STRIP], to_r[k : k + STRIP]
        use = np.flatnonzero(part.any(0))
        if 2 * len(use) > len(x):
            total[np.ix_(at, to_c)] += (part.astype(np.float32) @ ones.T).astype(np.int32)
        elif len(use):
            met = np.flatnonzero(b[:, use].any(1))
            total[np.ix_(at, to_c[met])] += (part[:, use].astype(np.float32) @ ones[np.ix_(met, use)].T).astype(np.int32)


def _counted(members, wanted, total) -> Iterator[pa.RecordBatch]:
    if wanted is not None:
        same, (rows, up), (cols, down) = members
        for r, c in _ones(wanted, up, down, same, once=True):
            u, v = rows[r], cols[c]
            yield _batch(src=np.minimum(u, v), dst=np.maximum(u, v), sim=total[up[r], down[c]].astype(np.int64))
