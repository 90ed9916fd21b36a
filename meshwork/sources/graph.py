"""Graphs as DataFrames: vertices(v), and edges(src, dst) in both directions without loops or repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.sources import blocks


def normalize_edges(df: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Both directions of every edge once; loops and rows with a null end are dropped."""
    pairs = df.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a <> b")
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return once.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.src", "e.dst")


def canonical(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, src < dst."""
    return edges.where("src < dst")


def mirrored(once: DataFrame) -> DataFrame:
    """Canonical edges and their mirror images, other columns kept."""
    rest = [c for c in once.columns if c not in ("src", "dst")]
    return once.select("src", "dst", *rest).union(once.select("dst", "src", *rest))


def _pairs(df: DataFrame, item: str, *together: str, least: int = 1) -> DataFrame:
    """Pairs of items that share the `together` values in at least `least` groups."""
    one = df.select(F.col(item).cast("long").alias("i"), *together).distinct()
    got = one.alias("x").join(one.withColumnRenamed("i", "j").alias("y"), [*together]).where("i < j")
    return got.groupBy("i", "j").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("i").alias("src"), F.col("j").alias("dst"))


def copart2(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts that at least two orders have in common."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    vertices = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("v"))
    return normalize_edges(_pairs(lines, "l_partkey", "l_orderkey", least=2)), vertices


def custmonth(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers who bought the same part, shipped in the same month."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    vertices = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("v"))
    return normalize_edges(_pairs(lines.join(orders, "l_orderkey"), "o_custkey", "l_partkey", "month")), vertices


def _user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", F.date_trunc("hour", "ts").alias("hour"))


def userhour_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of `userhour` in packed blocks: it is dense, most pairs of users are edges."""
    return blocks.together(_user_events(spark, sf_dir), "user_id", "event_type", "hour")


def userhour(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users with the same kind of event in the same hour."""
    return blocks.edges(userhour_blocks(spark, sf_dir)), _user_events(spark, sf_dir).select(F.col("user_id").cast("long").alias("v")).distinct()


def degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, deg) of every vertex, 0 for isolated ones."""
    n = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("deg"))
    return vertices.select("v").join(n, "v", "left").select("v", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(v, nbrs): ascending neighbour ids of every vertex that has any."""
    return edges.groupBy(F.col("src").alias("v")).agg(F.array_sort(F.collect_list("dst")).alias("nbrs"))


def degree_tail_histogram(degs: DataFrame) -> DataFrame:
    """(i, n): how many vertices have degree i or more, for i from 2 to the greatest degree."""
    per = degs.where("deg >= 2").groupBy("deg").agg(F.count("*").alias("m"))  # one row per different degree
    return per.select(F.explode(F.sequence(F.lit(2), F.col("deg").cast("int"))).alias("i"), "m").groupBy(F.col("i").cast("long").alias("i")).agg(F.sum("m").alias("n"))
