"""Structural clustering: cores, their components, border vertices and roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.operators.components import connected_components
from meshwork.operators.similarity import similar_edges
from meshwork.plans.storage import materialize, measured
from meshwork.sources.graph import mirrored


def eps_degree(similar: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, eps_degree): similar neighbours of every vertex, itself not counted."""
    n = mirrored(similar).groupBy(F.col("src").alias("v")).agg(F.count("*").alias("eps_degree"))
    return vertices.select("v").join(n, "v", "left").select("v", F.coalesce("eps_degree", F.lit(0)).cast("long").alias("eps_degree"))


def cores(counts: DataFrame, mu: int) -> DataFrame:
    return counts.where(F.col("eps_degree") >= mu).select("v")


def core_core_edges(similar: DataFrame, core: DataFrame) -> DataFrame:
    """Similar canonical edges between two cores."""
    return similar.join(core.select(F.col("v").alias("src")), "src", "left_semi").join(core.select(F.col("v").alias("dst")), "dst", "left_semi").select("src", "dst")


def core_components(similar: DataFrame, core: DataFrame, figures: dict | None = None) -> DataFrame:
    """(v, cluster_id) of every core: the least core of its component."""
    return connected_components(core_core_edges(similar, core), core, figures=figures).select("v", F.col("root").alias("cluster_id"))


def same_set(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs (src, dst) with `same`: whether both lie in one component of parts(v, cluster_id); vertices outside are alone."""
    a, b = parts.select(F.col("v").alias("src"), F.col("cluster_id").alias("x")), parts.select(F.col("v").alias("dst"), F.col("cluster_id").alias("y"))
    got = pairs.join(a, "src", "left").join(b, "dst", "left")
    return got.select("src", "dst", (F.coalesce("x", "src") == F.coalesce("y", "dst")).alias("same"))


def border_candidates(similar: DataFrame, core_clusters: DataFrame) -> DataFrame:
    """(v, cluster_id) for every similar edge from a core to a vertex that is none; repeats dropped."""
    near = mirrored(similar).join(core_clusters.withColumnRenamed("v", "src"), "src").select(F.col("dst").alias("v"), "cluster_id")
    return near.join(core_clusters.select("v"), "v", "left_anti").distinct()


def border_assignment(similar: DataFrame, core_clusters: DataFrame) -> DataFrame:
    """(v, cluster_id): the least candidate of each border vertex."""
    return border_candidates(similar, core_clusters).groupBy("v").agg(F.min("cluster_id").alias("cluster_id"))


def cluster(edges: DataFrame, vertices: DataFrame, eps: float, mu: int, strategy: str = "auto", figures: dict | None = None) -> DataFrame:
    """(v, role, cluster_id, eps_degree) of every vertex; role core, border or none, cluster_id null for none.

    `figures` gets what each stage wrote, observed while it was written: directed edges, edges by the
    verdict of their degrees, similar edges, vertices, cores, rounds of the components, clusters."""
    figures = {} if figures is None else figures
    edges, seen = measured(edges)
    figures["edges"] = seen["rows"]
    similar, seen = measured(similar_edges(edges, vertices, eps, strategy=strategy, figures=figures))
    figures["similar edges"] = seen["rows"]
    counts, seen = measured(eps_degree(similar, vertices), cores=F.count_if(F.col("eps_degree") >= mu))
    figures |= {"vertices": seen["rows"], "cores": seen["cores"]}
    core = cores(counts, mu)
    named, seen = measured(core_components(similar, core, figures), clusters=F.count_if(F.col("v") == F.col("cluster_id")))
    figures["clusters"] = seen["clusters"]
    border = border_assignment(similar, named)
    joined = counts.join(named.withColumnRenamed("cluster_id", "own"), "v", "left").join(border.withColumnRenamed("cluster_id", "near"), "v", "left")
    role = F.when(F.col("eps_degree") >= mu, F.lit("core")).when(F.col("near").isNotNull(), F.lit("border")).otherwise(F.lit("none"))
    return joined.select("v", role.alias("role"), F.coalesce("own", "near").alias("cluster_id"), "eps_degree")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """(cluster_id, n_core, n_border) of every cluster."""
    return clusters.where("cluster_id is not null").groupBy("cluster_id").agg(F.count_if(F.col("role") == "core").alias("n_core"), F.count_if(F.col("role") == "border").alias("n_border"))


def role_counts(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("role").agg(F.count("*").alias("n"))
