"""Connected components with the smallest id of each component as its label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.plans.storage import materialize, measured, release


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, src: str = "src", dst: str = "dst", figures: dict | None = None) -> DataFrame:
    """(v, root) for every vertex of `vertices` and every end of an edge; root is the least id connected to v.

    Edges count in both directions; self-loops and repeats do no harm. Ids may be of any type that
    has an order. Rounds alternate two steps until nothing changes, about the logarithm of the
    longest path: every vertex hands its least neighbour to its greater neighbours, then to its
    smaller ones, so each component ends as a star around its least vertex. Each round shuffles a
    number of rows in proportion to the edges; both steps are written to the shared folder, and what
    the step before had written goes. `figures` gets the number of rounds.
    """
    pairs = materialize(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, rounds = None, 0
    while True:
        rounds += 1
        # every vertex with the least of itself and its neighbours
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("n")).select("a", F.least("a", "n").alias("m"))
        upper = pairs.select(F.col("b").alias("a"), F.col("a").alias("o")).join(least, "a").select(F.col("o").alias("a"), F.col("m").alias("b"))
        large = materialize(upper.distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        last = pairs
        pairs, now = measured(small, hashes=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        release(last)
        release(large)
        if now == before:
            break
        before = now
    if figures is not None:
        figures["component rounds"] = rounds
    roots = pairs.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("v"), "root")
    ends = edges.select(F.col(src).alias("v")).union(edges.select(F.col(dst)))
    every = (ends if vertices is None else ends.union(vertices.select("v"))).distinct()
    return every.join(roots, "v", "left").select("v", F.coalesce("root", "v").alias("root"))
