"""Graph files: edge text, flat binary adjacency, and the text forms of results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.sources.graph import normalize_edges


def read_edges_text(spark: SparkSession, path: str, sep: str = r"\s+") -> DataFrame:
    """Edges of a text file with two ids a line; lines that begin with # are comments."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    ids = F.split(F.trim("value"), sep)
    return normalize_edges(rows.select(ids[0].alias("src"), ids[1].alias("dst")))


def write_adjacency_binary(edges: DataFrame, vertices: DataFrame, path: str) -> None:
    """One row per vertex: its place among all neighbours (offset) and its ascending neighbours as native unsigned 32-bit numbers."""
    from meshwork.plans.layout import csr_offsets
    from meshwork.sources.graph import adjacency, degrees

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"v": b["v"], "st": b["st"], "bytes": [np.asarray([] if x is None else x, np.uint32).tobytes() for x in b["nbrs"]]})

    rows = csr_offsets(degrees(edges, vertices)).join(adjacency(edges), "v", "left").select("v", "st", "nbrs")
    rows.mapInPandas(pack, "v long, st long, bytes binary").repartitionByRange("v").sortWithinPartitions("v").write.parquet(path)


#: Numbers in a block of a flat file, at most.
BLOCK = 1 << 14
SIZE = np.dtype(np.uint32).itemsize


def _block(numbers: int) -> int:
    """The largest block that divides a file of so many numbers: the reader takes whole records only."""
    return next(b for b in range(min(BLOCK, numbers), 0, -1) if numbers % b == 0)


def read_adjacency_binary(spark: SparkSession, path: str, offsets: DataFrame) -> DataFrame:
    """Edges of a flat binary adjacency file (native unsigned 32-bit neighbour ids, vertex after vertex).

    `offsets` (v, st, ed) gives each vertex's slice in numbers; vertices that are not in it are left
    out. The file is read in blocks by Spark's splittable reader of fixed-length records, wherever it
    lies; a block meets the slices that lie in it (at most one row for each of its numbers) once. A
    file that is too short for its offsets, or a list that does not ascend within a block, is an error.
    """
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).head()[0] or 0
    if size % SIZE:
        raise ValueError(f"{path} does not hold whole numbers")
    slices = offsets.where("ed > st").select("v", "st", "ed")
    if not size:
        if slices.head(1):
            raise ValueError(f"{path} is shorter than its offsets")
        return spark.createDataFrame([], "src long, dst long")
    n = _block(size // SIZE)
    records = spark.sparkContext.binaryRecords(path, n * SIZE).zipWithIndex().map(lambda r: (r[1], bytearray(r[0])))
    blocks = spark.createDataFrame(records, "block long, bytes binary")
    first, last = F.floor(F.col("st") / F.lit(n)), F.floor((F.col("ed") - 1) / F.lit(n))
    per = slices.select("v", "st", "ed", F.explode(F.sequence(first, last)).alias("block")).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("st", "ed", "v"))).alias("parts"))
    joined = per.join(blocks, "block", "left").select("block", "bytes", *[F.col(f"parts.{c}").alias(c) for c in ("v", "st", "ed")])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, data, v, st, ed in b.itertuples(index=False, name=None):
                if data is None:
                    raise ValueError(f"{path} is shorter than its offsets")
                nbrs = np.frombuffer(data, np.uint32).astype(np.int64)
                at, to = np.maximum(np.asarray(st) - block * n, 0), np.minimum(np.asarray(ed) - block * n, n)
                place = np.repeat(at - np.r_[0, np.cumsum(to - at)[:-1]], to - at) + np.arange(int((to - at).sum()))
                src, dst = np.repeat(np.asarray(v, np.int64), to - at), nbrs[place]
                bad = (src[1:] == src[:-1]) & (dst[1:] <= dst[:-1])
                if bad.any():
                    raise ValueError(f"adjacency of {src[1:][bad][0]} is not ascending")
                yield pd.DataFrame({"src": src, "dst": dst})

    return joined.mapInPandas(scan, "src long, dst long")


def write_flat(lists: DataFrame, path: str) -> None:
    """A flat binary adjacency file of `lists` (v, nbrs), by v. One file has one writer: the lists
    pass through the driver, a partition at a time."""
    jvm, conf = lists.sparkSession.sparkContext._jvm, lists.sparkSession.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(conf).create(at)
    try:
        for r in lists.orderBy("v").toLocalIterator():
            out.write(bytearray(np.asarray(r["nbrs"], np.uint32).tobytes()))
    finally:
        out.close()


def point_scan(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The adjacency of wanted vertices only: ids(v)."""
    return edges.join(ids.select(F.col("v").alias("src")).distinct(), "src", "left_semi")


def clustering_text(clusters: DataFrame, sentinel: int) -> DataFrame:
    """(v, line): `c v cluster epsdeg` for cores, `n v cluster` for others, the sentinel where there is no cluster."""
    v = F.col("v").cast("string")
    line = F.when(F.col("role") == "core", F.concat_ws(" ", F.lit("c"), v, F.col("cluster_id").cast("string"), F.col("eps_degree").cast("string")))
    return clusters.select("v", line.otherwise(F.concat_ws(" ", F.lit("n"), v, F.coalesce("cluster_id", F.lit(sentinel)).cast("string"))).alias("line"))


def similarity_text(common: DataFrame) -> DataFrame:
    """(src, dst, line): `u v common` for every directed edge."""
    return common.select("src", "dst", F.concat_ws(" ", "src", "dst", "common").alias("line"))


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """Lines as text files whose order, file by file, is that of `order`."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)

