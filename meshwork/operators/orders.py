"""Orders of neighbours and of vertices by similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.plans.layout import positions


def neighbor_order(similarity: DataFrame, descending: bool = False) -> DataFrame:
    """(src, rank, similarity, dst): each vertex's neighbours by (similarity, id), ascending unless told otherwise."""
    key = F.desc("similarity") if descending else F.asc("similarity")
    w = Window.partitionBy("src").orderBy(key, "dst")
    return similarity.select("src", F.row_number().over(w).cast("long").alias("rank"), "similarity", "dst")


def core_order(order: DataFrame) -> DataFrame:
    """(rank, pos, similarity, v): for each rank of 2 or more, the vertices that have a neighbour of that
    rank, by (similarity there, id). Low ranks hold nearly all vertices, so places are numbered in
    ranges and not by one task per rank."""
    rows = order.where("rank >= 2").select("rank", "similarity", F.col("src").alias("v"))
    return positions(rows, ["rank"], ["similarity", "v"], "pos")
