"""Places and ranges: prefix sums, numbering, partitions of vertex ids and what they ask of each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.functions.bounds import handles, partition_of, verdict
from meshwork.operators.similarity import with_degrees
from meshwork.plans.storage import materialize, measured
from meshwork.sources.graph import degrees

#: Rows that a range holds, more or less; there are as many ranges as that takes, and as shuffles have tasks.
RANGE_ROWS = 1 << 20


def _ranged(df: DataFrame, cols: list[str]) -> DataFrame:
    """`df` in ranges of `cols`, each row with its range's number; written, so the ranges stay as they
    are. It is written before, too: ranges are drawn from a sample, which would compute `df` again."""
    rows, seen = measured(df)
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-seen["rows"] // RANGE_ROWS))
    return materialize(rows.repartitionByRange(ranges, *cols).withColumn("_range", F.spark_partition_id()))


def positions(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """`df` with each row's place from 1 within its group. Groups of any size are numbered in ranges."""
    rows = _ranged(df, [*group, *order])
    counts = rows.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*group).orderBy("_range")) - F.col("_n")).drop("_n")
    numbered = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order)))
    return numbered.join(before, [*group, "_range"]).select(*df.columns, (F.col("_in") + F.col("_before")).cast("long").alias(name))


def prefix_sums(df: DataFrame, order: str, **values: Column) -> DataFrame:
    """`df` with the sums of the values over all rows before each, by `order`: sums of ranges first."""
    of = {n: f"_value{k}" for k, n in enumerate(values)}
    rows = _ranged(df.select("*", *[c.cast("long").alias(of[n]) for n, c in values.items()]), [order])
    totals = rows.groupBy("_range").agg(*[F.sum(v).alias(f"_sum{v}") for v in of.values()])
    upto, inside = Window.orderBy("_range"), Window.partitionBy("_range").orderBy(order)  # the first over one row for each range
    before = totals.select("_range", *[(F.sum(f"_sum{v}").over(upto) - F.col(f"_sum{v}")).alias(f"_before{v}") for v in of.values()])
    within = rows.select("*", *[(F.sum(v).over(inside) - F.col(v)).alias(f"_within{v}") for v in of.values()])
    return within.join(F.broadcast(before), "_range").select(*df.columns, *[(F.col(f"_before{v}") + F.col(f"_within{v}")).cast("long").alias(n) for n, v in of.items()])


def csr_offsets(degs: DataFrame) -> DataFrame:
    """(v, st, ed): where each vertex's neighbours lie when all lists stand in a row."""
    return prefix_sums(degs, "v", st=F.col("deg")).select("v", "st", (F.col("st") + F.col("deg")).alias("ed"))


def balanced_ranges(degs: DataFrame, parts: int) -> DataFrame:
    """(i, st, ed, weight): contiguous runs of vertices (places by id) of about equal sums of degrees.

    Run i takes vertices until the sum reaches what was done plus an equal share of the rest; the
    last takes what is left. One small job per run.
    """
    spark = degs.sparkSession
    rows = materialize(_numbered(degs))
    total, n = rows.agg(F.coalesce(F.sum("deg"), F.lit(0)), F.count("*")).head()
    done, st, out = 0, 0, []
    for i in range(1, parts):
        expected = done + (total - done) // (parts - i + 1)
        if done >= expected:
            ed, upto = st, done
        else:
            ed, upto = rows.where((F.col("before") + F.col("deg") >= expected) & (F.col("k") >= st)).agg(F.min(F.struct((F.col("k") + 1).alias("k"), (F.col("before") + F.col("deg")).alias("s"))).alias("m")).select("m.k", "m.s").head()
        out.append((i - 1, st, ed, upto - done))
        st, done = ed, upto
    out.append((parts - 1, st, n, total - done))
    return spark.createDataFrame(out, "i long, st long, ed long, weight long")


def _numbered(degs: DataFrame) -> DataFrame:
    """Vertices by id with their place from 0 (k) and the degrees before them."""
    return prefix_sums(degs, "v", before=F.col("deg"), k=F.lit(1))


def equal_offsets(n: int, parts: int) -> list[int]:
    return [n * i // parts for i in range(parts + 1)]


def partitioned(edges: DataFrame, offsets: list[int]) -> DataFrame:
    """Directed edges with the partitions p, q of their ends; local is whether they agree."""
    got = edges.select("src", "dst", partition_of(F.col("src"), offsets).alias("p"), partition_of(F.col("dst"), offsets).alias("q"))
    return got.withColumn("local", F.col("p") == F.col("q"))


def owned_cross_edges(edges: DataFrame, vertices: DataFrame, eps: float, offsets: list[int]) -> DataFrame:
    """Undecided edges to another partition, on the side that handles them: src, dst, p, q."""
    parts = len(offsets) - 1
    undecided = with_degrees(edges, degrees(edges, vertices)).where(verdict(F.col("du"), F.col("dv"), eps) == "open").select("src", "dst")
    return partitioned(undecided, offsets).where(~F.col("local") & handles(F.col("p"), F.col("q"), parts)).drop("local")


def foreign_requests(edges: DataFrame, vertices: DataFrame, eps: float, offsets: list[int]) -> DataFrame:
    """(p, q, n_vertices, n_edges): how many vertices of q partition p needs the neighbours of, and how many those are."""
    asked = owned_cross_edges(edges, vertices, eps, offsets).select("p", "q", "dst").distinct()
    return asked.join(degrees(edges, vertices).withColumnRenamed("v", "dst"), "dst").groupBy("p", "q").agg(F.count("*").alias("n_vertices"), F.sum("deg").alias("n_edges"))


def source_index(edges: DataFrame, vertices: DataFrame, eps: float, offsets: list[int]) -> DataFrame:
    """(p, v, n_sources, sum_degree): by foreign vertex, the local ends of its edges and their degrees."""
    owned = owned_cross_edges(edges, vertices, eps, offsets).join(degrees(edges, vertices).withColumnRenamed("v", "src"), "src")
    return owned.groupBy("p", F.col("dst").alias("v")).agg(F.count("*").alias("n_sources"), F.sum("deg").alias("sum_degree"))
