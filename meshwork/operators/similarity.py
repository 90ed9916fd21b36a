"""Common neighbours and similar edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.functions.bounds import bound, open_cosine, reaches, verdict
from meshwork.plans.storage import measured
from meshwork.sources.graph import adjacency, canonical, degrees, mirrored

#: Neighbour arrays of more entries are never copied to edges: one row would be too large.
ARRAY_DEGREE = 1 << 16
#: A wedge (a row that is shuffled to find its closing edge) costs about as much as so many array entries.
WEDGE_COST = 6


def with_degrees(once: DataFrame, degs: DataFrame) -> DataFrame:
    """Edges with du and dv."""
    return once.join(degs.select(F.col("v").alias("src"), F.col("deg").alias("du")), "src").join(degs.select(F.col("v").alias("dst"), F.col("deg").alias("dv")), "dst")


def _by_arrays(once: DataFrame, edges: DataFrame) -> DataFrame:
    adj = adjacency(edges)
    rest = [c for c in once.columns if c not in ("src", "dst")]
    got = once.join(adj.select(F.col("v").alias("src"), F.col("nbrs").alias("nu")), "src").join(adj.select(F.col("v").alias("dst"), F.col("nbrs").alias("nv")), "dst")
    return got.select("src", "dst", *rest, F.size(F.array_intersect("nu", "nv")).cast("long").alias("common"))


def _by_triangles(once: DataFrame, edges: DataFrame) -> DataFrame:
    """Each triangle is found once, from its end of least (degree, id): out-degrees there stay below
    the square root of twice the edges, however large a hub is."""
    degs = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("deg"))
    ranked = with_degrees(canonical(edges), degs)
    up = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("src") < F.col("dst")))
    low, high = F.when(up, F.col("src")).otherwise(F.col("dst")), F.when(up, F.col("dst")).otherwise(F.col("src"))
    out = ranked.select(low.alias("w"), high.alias("x"))
    wedges = out.join(out.withColumnRenamed("x", "y"), "w").where("x < y")
    closed = wedges.join(canonical(edges).select(F.col("src").alias("x"), F.col("dst").alias("y")), ["x", "y"])
    sides = closed.select(F.explode(F.array(*[F.struct(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")) for a, b in (("x", "y"), ("w", "x"), ("w", "y"))])).alias("e"))
    found = sides.groupBy("e.src", "e.dst").agg(F.count("*").alias("common"))
    return once.join(found, ["src", "dst"], "left").withColumn("common", F.coalesce("common", F.lit(0)).cast("long"))


def _costs(once: DataFrame, edges: DataFrame) -> tuple[int, int, int]:
    """The greatest degree, the neighbours of both ends summed over the edges asked for, and the wedges at ends of lower degree."""
    degs = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("deg"))
    ends = with_degrees(once.select("src", "dst"), degs)
    low = F.when((F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("src") < F.col("dst"))), F.col("src")).otherwise(F.col("dst"))
    out = with_degrees(canonical(edges), degs).groupBy(low.alias("w")).agg(F.count("*").alias("n"))
    none = F.lit(None).cast("long")
    rows = degs.agg(F.max("deg").alias("most"), none.alias("entries"), none.alias("wedges"))
    rows = rows.union(ends.agg(none, F.sum(F.col("du") + F.col("dv")), none)).union(out.agg(none, none, F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long")))
    got = rows.agg(F.max("most"), F.max("entries"), F.max("wedges")).head()
    return tuple(int(x or 0) for x in got)


def common_neighbours(once: DataFrame, edges: DataFrame, strategy: str = "auto") -> DataFrame:
    """Canonical edges `once` with the number of open common neighbours in the graph of `edges`.

    "arrays" intersects the neighbour lists of both ends; "triangles" counts closed wedges, for
    graphs with hubs, whose lists would be copied to each of their edges. "auto" measures, in one
    job, how many list entries and how many wedges either would move.
    """
    if strategy == "auto":
        most, entries, wedges = _costs(once, edges)
        strategy = "arrays" if most <= ARRAY_DEGREE and entries <= WEDGE_COST * wedges + (1 << 20) else "triangles"
    return {"arrays": _by_arrays, "triangles": _by_triangles}[strategy](once, edges)


def open_common(edges: DataFrame, strategy: str = "auto") -> DataFrame:
    """(src, dst, common) of every directed edge: open neighbourhoods."""
    return mirrored(common_neighbours(canonical(edges), edges, strategy).select("src", "dst", "common"))


def closed_common(edges: DataFrame, strategy: str = "auto") -> DataFrame:
    """(src, dst, sim) of every canonical edge: closed neighbourhoods, the full count."""
    return common_neighbours(canonical(edges), edges, strategy).select("src", "dst", (F.col("common") + 2).alias("sim"))


def open_similarity(edges: DataFrame, vertices: DataFrame, strategy: str = "auto") -> DataFrame:
    """(src, dst, similarity) of every directed edge: squared cosine of open neighbourhoods."""
    got = with_degrees(common_neighbours(canonical(edges), edges, strategy), degrees(edges, vertices))
    return mirrored(got.select("src", "dst", open_cosine(F.col("common"), F.col("du"), F.col("dv")).alias("similarity")))


def prune_verdict(edges: DataFrame, vertices: DataFrame, eps: float) -> DataFrame:
    """(src, dst, verdict) of every canonical edge: what the degrees alone decide."""
    return with_degrees(canonical(edges), degrees(edges, vertices)).select("src", "dst", verdict(F.col("du"), F.col("dv"), eps).alias("verdict"))


def similar_edges(edges: DataFrame, vertices: DataFrame, eps: float, prune: bool = True, strategy: str = "auto", figures: dict | None = None) -> DataFrame:
    """Canonical edges whose ends are similar. Neighbours are intersected only where degrees leave it
    open. `figures` gets how many edges the degrees decided and left open."""
    ranked = with_degrees(canonical(edges), degrees(edges, vertices)).withColumn("verdict", verdict(F.col("du"), F.col("dv"), eps) if prune else F.lit("open"))
    # read twice below: degrees are joined once
    left, seen = measured(ranked.where("verdict <> 'out'"), open=F.count_if(F.col("verdict") == "open"))
    if figures is not None:
        figures |= {"edges similar by degree": seen["rows"] - seen["open"], "edges left open": seen["open"]}
    counted = common_neighbours(left.where("verdict = 'open'"), edges, strategy)
    kept = counted.where(reaches(F.col("common") + 2, bound(F.col("du"), F.col("dv"), eps))).select("src", "dst")
    return kept.union(left.where("verdict = 'in'").select("src", "dst"))
