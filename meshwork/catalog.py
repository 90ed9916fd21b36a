"""Registered queries and their SQL oracles, on graphs derived from the order tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.functions.bounds import TOLERANCE, partition_of, ring_owner
from meshwork.operators import clusters as C
from meshwork.operators import similarity as S
from meshwork.operators.orders import core_order, neighbor_order
from meshwork.plans import layout as L
from meshwork.plans.storage import materialize, table_path
from meshwork.sources import blocks, files, graph

EPS, MU, PARTS = 0.4, 3, 4


def flagship(spark: SparkSession, sf_dir: str, eps: float = 0.3, mu: int = 3) -> DataFrame:
    return C.cluster(*graph.copart2(spark, sf_dir), eps, mu)


def _graph(make):
    """A query over the copart2 graph as (edges, vertices)."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges, vertices = graph.copart2(spark, sf_dir)
        return make(materialize(edges), vertices)

    return query


def _similar(make, eps: float = EPS, mu: int = MU):
    """A query over similar edges, eps-degrees and cores."""

    def of(edges: DataFrame, vertices: DataFrame) -> DataFrame:
        similar = materialize(S.similar_edges(edges, vertices, eps))
        counts = C.eps_degree(similar, vertices)
        return make(similar, counts, C.cores(counts, mu), edges)

    return _graph(of)


def _offsets(vertices: DataFrame) -> list[int]:
    return L.equal_offsets(vertices.count(), PARTS)


def _partition(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return vertices.select("v", partition_of(F.col("v"), _offsets(vertices)).alias("p"))


def _owners(edges: DataFrame, vertices: DataFrame, parts: int) -> DataFrame:
    cross = L.partitioned(graph.canonical(edges), L.equal_offsets(vertices.count(), parts)).where(~F.col("local"))
    return cross.select("src", "dst", "p", "q", ring_owner(F.col("p"), F.col("q"), parts).alias("owner"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("similarity", F.round("similarity", 12))


def _named(similar: DataFrame, core: DataFrame) -> DataFrame:
    return materialize(C.core_components(similar, core))


def _clustering(source, eps: float, mu: int):
    return lambda spark, sf_dir: C.cluster(*source(spark, sf_dir), eps, mu)


def _binary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph written as packed neighbour lists and read again."""
    import numpy as np
    import pandas as pd

    edges, vertices = graph.copart2(spark, sf_dir)
    path = table_path(spark, "adjacency")
    files.write_adjacency_binary(edges, vertices, path)

    def unpack(batches):
        for b in batches:
            for v, data in zip(b["v"], b["bytes"], strict=True):
                nbrs = np.frombuffer(data, np.uint32).astype(np.int64)
                yield pd.DataFrame({"src": np.full(len(nbrs), v, np.int64), "dst": nbrs})

    return spark.read.parquet(path).select("v", "bytes").mapInPandas(unpack, "src long, dst long")


def _flat(edges: DataFrame, vertices: DataFrame) -> tuple[str, DataFrame]:
    """The graph as a flat binary adjacency file, and its offsets."""
    path = table_path(edges.sparkSession, "flat")
    files.write_flat(graph.adjacency(edges), path)
    return path, L.csr_offsets(graph.degrees(edges, vertices))


def _flat_scan(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    path, offsets = _flat(edges, vertices)
    return files.read_adjacency_binary(edges.sparkSession, path, offsets)


def _flat_point_scan(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The lists of wanted vertices only, read from the flat file."""
    path, offsets = _flat(edges, vertices)
    wanted = L.source_index(edges, vertices, EPS, _offsets(vertices)).select("v").distinct()
    return files.read_adjacency_binary(edges.sparkSession, path, offsets.join(wanted, "v", "left_semi"))


def _stage_figures(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """What each stage of a clustering wrote; rounds are left to `figures`, they depend on the plan."""
    figures: dict = {}
    C.cluster(edges, vertices, EPS, MU, figures=figures)
    rounds = figures.pop("component rounds")
    assert rounds > 0
    return edges.sparkSession.createDataFrame(sorted(figures.items()), "stage string, n long")


def queries() -> dict:
    g, s = _graph, _similar
    return {
        "edges": lambda spark, d: graph.copart2(spark, d)[0],
        "edges_custmonth": lambda spark, d: graph.custmonth(spark, d)[0],
        "edges_userhour": lambda spark, d: graph.userhour(spark, d)[0],
        "degrees": g(graph.degrees),
        "max_degree": g(lambda e, v: graph.degrees(e, v).agg(F.max("deg").alias("max_deg"), F.sum("deg").alias("sum_deg"), F.count_if(F.col("deg") == 0).alias("n_isolated"))),
        "degree_tail_histogram": g(lambda e, v: graph.degree_tail_histogram(graph.degrees(e, v))),
        "csr_offsets": g(lambda e, v: L.csr_offsets(graph.degrees(e, v))),
        "adjacency": g(lambda e, v: graph.adjacency(e).select("v", F.array_join("nbrs", ",").alias("nbrs"))),
        "adjacency_sizes": g(lambda e, v: graph.adjacency(e).select("v", F.size("nbrs").cast("long").alias("n"))),
        "binary_adjacency": _binary_round_trip,
        "flat_adjacency": g(_flat_scan),
        "flat_point_scan": g(_flat_point_scan),
        "stage_figures": g(_stage_figures),
        "point_scan": g(lambda e, v: files.point_scan(e, L.source_index(e, v, EPS, _offsets(v)).select("v"))),
        "open_common": g(lambda e, v: S.open_common(e)),
        "open_common_triangles": g(lambda e, v: S.open_common(e, "triangles")),
        "open_similarity": g(lambda e, v: _rounded(S.open_similarity(e, v))),
        "closed_common": g(lambda e, v: S.closed_common(e)),
        "closed_common_userhour": lambda spark, d: blocks.closed_common(graph.userhour_blocks(spark, d)),
        "prune_verdict": g(partial(S.prune_verdict, eps=EPS)),
        "similar_edges": g(partial(S.similar_edges, eps=EPS)),
        "eps_degree": s(lambda sim, n, core, e: n),
        "core_vertices": s(lambda sim, n, core, e: core),
        "core_count": s(lambda sim, n, core, e: core.agg(F.count("*").alias("n_core"))),
        "core_core_edges": s(lambda sim, n, core, e: C.core_core_edges(sim, core)),
        "core_components": s(lambda sim, n, core, e: C.core_components(sim, core)),
        "same_set": s(lambda sim, n, core, e: C.same_set(graph.canonical(e), _named(sim, core))),
        "border_candidates": s(lambda sim, n, core, e: C.border_candidates(sim, _named(sim, core))),
        "border_assignment": s(lambda sim, n, core, e: C.border_assignment(sim, _named(sim, core))),
        "clustering": _clustering(graph.copart2, EPS, MU),
        "clustering_deep": _clustering(graph.copart2, 0.2, 5),
        "clustering_custmonth": _clustering(graph.custmonth, 0.2, 5),
        "cluster_sizes": g(lambda e, v: C.cluster_sizes(C.cluster(e, v, EPS, MU))),
        "role_counts": g(lambda e, v: C.role_counts(C.cluster(e, v, EPS, MU))),
        "clustering_text": g(lambda e, v: files.clustering_text(C.cluster(e, v, EPS, MU), v.count())),
        "similarity_text": g(lambda e, v: files.similarity_text(S.open_common(e))),
        "neighbor_order": g(lambda e, v: _rounded(neighbor_order(S.open_similarity(e, v)))),
        "neighbor_order_descending": g(lambda e, v: _rounded(neighbor_order(S.open_similarity(e, v), descending=True))),
        "core_order": g(lambda e, v: _rounded(core_order(neighbor_order(S.open_similarity(e, v))))),
        "partition_of": g(_partition),
        "local_edges": g(lambda e, v: L.partitioned(e, _offsets(v))),
        "ring_owner": g(partial(_owners, parts=PARTS)),
        "ring_owner_odd": g(partial(_owners, parts=5)),
        "foreign_requests": g(lambda e, v: L.foreign_requests(e, v, EPS, _offsets(v))),
        "source_index_sizes": g(lambda e, v: L.source_index(e, v, EPS, _offsets(v))),
        "balanced_ranges": g(lambda e, v: L.balanced_ranges(graph.degrees(e, v), PARTS)),
        "balanced_sources": g(lambda e, v: L.balanced_ranges(L.source_index(e, v, EPS, _offsets(v)).groupBy("v").agg(F.sum("sum_degree").alias("deg")), PARTS)),
        "dense_numbers": s(lambda sim, n, core, e: L.positions(core, [], ["v"], "k").select("v", (F.col("k") - 1).alias("k"))),
    }


# The oracles repeat the definitions and not the plans: wedges are counted by a plain join, and
# components by a recursive closure.
_COPART2 = """
po AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
e AS (SELECT a.p AS src, b.p AS dst FROM po a JOIN po b ON a.o = b.o AND a.p <> b.p GROUP BY 1, 2 HAVING count(*) >= 2),
vx AS (SELECT p_partkey AS v FROM part),"""
_CUSTMONTH = """
po AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p, strftime(l_shipdate, '%Y-%m') AS m FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
e AS (SELECT DISTINCT a.c AS src, b.c AS dst FROM po a JOIN po b ON a.p = b.p AND a.m = b.m AND a.c <> b.c),
vx AS (SELECT c_custkey AS v FROM customer),"""
_USERHOUR = """
po AS (SELECT DISTINCT user_id AS u, event_type AS t, date_trunc('hour', ts) AS h FROM events),
e AS (SELECT DISTINCT a.u AS src, b.u AS dst FROM po a JOIN po b ON a.t = b.t AND a.h = b.h AND a.u <> b.u),
vx AS (SELECT DISTINCT user_id AS v FROM events),"""


def _with(source: str = _COPART2, eps: float = EPS, mu: int = MU) -> str:
    b = f"CAST({eps} AS DOUBLE) * CAST({eps} AS DOUBLE) * (du + CAST(1 AS DOUBLE)) * (dv + CAST(1 AS DOUBLE))"
    return f"""WITH RECURSIVE {source}
d AS (SELECT v, count(dst) AS deg FROM vx LEFT JOIN e ON src = v GROUP BY v),
w AS (SELECT a.src AS src, b.src AS dst, count(*) AS common FROM e a JOIN e b ON a.dst = b.dst AND a.src < b.src GROUP BY 1, 2),
c AS (SELECT e.src, e.dst, x.deg AS du, y.deg AS dv, coalesce(w.common, 0) AS common FROM e JOIN d x ON x.v = e.src JOIN d y ON y.v = e.dst LEFT JOIN w ON w.src = e.src AND w.dst = e.dst WHERE e.src < e.dst),
s AS (SELECT src, dst FROM c WHERE CAST(common + 2 AS DOUBLE) * CAST(common + 2 AS DOUBLE) + CAST({TOLERANCE} AS DOUBLE) >= {b}),
ss AS (SELECT src, dst FROM s UNION ALL SELECT dst, src FROM s),
n AS (SELECT v, count(dst) AS eps_degree FROM vx LEFT JOIN ss ON src = v GROUP BY v),
core AS (SELECT v FROM n WHERE eps_degree >= {mu}),
cc AS (SELECT src, dst FROM ss WHERE src IN (SELECT v FROM core) AND dst IN (SELECT v FROM core)),
r AS (SELECT v, v AS lab FROM core UNION SELECT cc.dst, r.lab FROM r JOIN cc ON cc.src = r.v),
part_of AS (SELECT v, min(lab) AS cluster_id FROM r GROUP BY v),
cand AS (SELECT DISTINCT ss.dst AS v, part_of.cluster_id FROM ss JOIN part_of ON part_of.v = ss.src WHERE ss.dst NOT IN (SELECT v FROM core)),
bord AS (SELECT v, min(cluster_id) AS cluster_id FROM cand GROUP BY v),
cl AS (SELECT n.v, CASE WHEN part_of.v IS NOT NULL THEN 'core' WHEN bord.v IS NOT NULL THEN 'border' ELSE 'none' END AS role, coalesce(part_of.cluster_id, bord.cluster_id) AS cluster_id, eps_degree FROM n LEFT JOIN part_of USING (v) LEFT JOIN bord USING (v)),
oc AS (SELECT src, dst, common, CAST(1.0 AS DOUBLE) * common * common / (CAST(du AS DOUBLE) * CAST(dv AS DOUBLE)) AS similarity FROM c),
o2 AS (SELECT src, dst, common, similarity FROM oc UNION ALL SELECT dst, src, common, similarity FROM oc),
nd AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY similarity, dst) AS rank, similarity, dst FROM o2),
nv AS (SELECT count(*) AS n FROM vx),
"""


def _verdict(eps: float = EPS) -> str:
    b = f"CAST({eps} AS DOUBLE) * CAST({eps} AS DOUBLE) * (du + CAST(1 AS DOUBLE)) * (dv + CAST(1 AS DOUBLE))"
    t = f"CAST({TOLERANCE} AS DOUBLE)"
    return f"CASE WHEN CAST(du + 2 AS DOUBLE) * (du + 2) + {t} < {b} OR CAST(dv + 2 AS DOUBLE) * (dv + 2) + {t} < {b} THEN 'out' WHEN CAST(4 AS DOUBLE) + {t} >= {b} THEN 'in' ELSE 'open' END"


def _part(v: str, parts: int = PARTS) -> str:
    return "CAST(CASE " + " ".join(f"WHEN {v} < n * {p + 1} // {parts} THEN {p}" for p in range(parts)) + " END AS INTEGER)"


def _cross(parts: int) -> str:
    """Canonical cross edges with the handler of their partitions, from an explicit table of all pairs."""

    def owner(p: int, q: int) -> int:
        after = [(p + k) % parts for k in range(1, (parts - 1) // 2 + 1)]
        if parts % 2 == 0 and abs(p - q) == parts // 2:
            return min(p, q)
        return p if q in after else q

    table = ", ".join(f"({p}, {q}, {owner(p, q)})" for p in range(parts) for q in range(parts) if p != q)
    return f"x AS (SELECT src, dst, {_part('src', parts)} AS p, {_part('dst', parts)} AS q FROM e, nv), own(p, q, owner) AS (VALUES {table})"


def _balanced(weights: str = "d", parts: int = PARTS) -> str:
    sql = "k AS (SELECT row_number() OVER (ORDER BY v) AS k, sum(deg) OVER (ORDER BY v) AS upto FROM " + weights + "), z AS (SELECT 0 AS k, 0 AS upto UNION ALL SELECT k, upto FROM k), t AS (SELECT max(upto) AS total, max(k) AS n FROM z), r0 AS (SELECT 0 AS ed, 0 AS done)"
    for i in range(1, parts):
        sql += f", r{i} AS (SELECT min(z.k) AS ed, min(z.upto) AS done FROM z, t, r{i - 1} p WHERE z.k >= p.ed AND z.upto >= p.done + (t.total - p.done) // {parts - i + 1})"
    rows = [f"SELECT {i - 1} AS i, p.ed AS st, q.ed AS ed, q.done - p.done AS weight FROM r{i - 1} p, r{i} q" for i in range(1, parts)]
    rows.append(f"SELECT {parts - 1}, p.ed, t.n, t.total - p.done FROM r{parts - 1} p, t")
    return sql + " SELECT CAST(i AS BIGINT) AS i, CAST(st AS BIGINT) AS st, CAST(ed AS BIGINT) AS ed, CAST(weight AS BIGINT) AS weight FROM (" + " UNION ALL ".join(rows) + ")"


def oracle_sql() -> dict:
    base, last = _with(), "z0 AS (SELECT 1)\n"
    q = lambda sql, w=base: f"{w}{last}{sql}"
    round12 = "round(similarity, 12) AS similarity"
    asked = f"{_cross(PARTS)}, f AS (SELECT x.* FROM x JOIN own USING (p, q) JOIN (SELECT src, dst, {_verdict()} AS verdict FROM c) y ON y.src = least(x.src, x.dst) AND y.dst = greatest(x.src, x.dst) WHERE verdict = 'open' AND owner = p)"
    clustering = "SELECT v, role, cluster_id, eps_degree FROM cl"
    return {
        "edges": q("SELECT src, dst FROM e"),
        "edges_custmonth": q("SELECT src, dst FROM e", _with(_CUSTMONTH)),
        "edges_userhour": q("SELECT src, dst FROM e", _with(_USERHOUR)),
        "degrees": q("SELECT v, deg FROM d"),
        "max_degree": q("SELECT max(deg) AS max_deg, CAST(sum(deg) AS BIGINT) AS sum_deg, count(*) FILTER (WHERE deg = 0) AS n_isolated FROM d"),
        "degree_tail_histogram": q("SELECT i, count(*) AS n FROM (SELECT unnest(range(2, deg + 1)) AS i FROM d) GROUP BY i"),
        "csr_offsets": q("SELECT v, CAST(sum(deg) OVER (ORDER BY v) - deg AS BIGINT) AS st, CAST(sum(deg) OVER (ORDER BY v) AS BIGINT) AS ed FROM d"),
        "adjacency": q("SELECT src AS v, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS nbrs FROM e GROUP BY src"),
        "adjacency_sizes": q("SELECT src AS v, count(*) AS n FROM e GROUP BY src"),
        "binary_adjacency": q("SELECT src, dst FROM e"),
        "flat_adjacency": q("SELECT src, dst FROM e"),
        "flat_point_scan": q("SELECT src, dst FROM e WHERE src IN (SELECT dst FROM f)", f"{base}{asked}, "),
        "stage_figures": q(f"""SELECT 'edges' AS stage, count(*) AS n FROM e UNION ALL SELECT 'edges similar by degree', count(*) FILTER (WHERE {_verdict()} = 'in') FROM c UNION ALL SELECT 'edges left open', count(*) FILTER (WHERE {_verdict()} = 'open') FROM c
UNION ALL SELECT 'similar edges', count(*) FROM s UNION ALL SELECT 'vertices', count(*) FROM n UNION ALL SELECT 'cores', count(*) FROM core UNION ALL SELECT 'clusters', count(DISTINCT cluster_id) FROM part_of"""),
        "point_scan": q("SELECT src, dst FROM e WHERE src IN (SELECT dst FROM f)", f"{base}{asked}, "),
        "open_common": q("SELECT src, dst, common FROM o2"),
        "open_common_triangles": q("SELECT src, dst, common FROM o2"),
        "open_similarity": q(f"SELECT src, dst, {round12} FROM o2"),
        "closed_common": q("SELECT src, dst, common + 2 AS sim FROM c"),
        "closed_common_userhour": q("SELECT src, dst, common + 2 AS sim FROM c", _with(_USERHOUR)),
        "prune_verdict": q(f"SELECT src, dst, {_verdict()} AS verdict FROM c"),
        "similar_edges": q("SELECT src, dst FROM s"),
        "eps_degree": q("SELECT v, eps_degree FROM n"),
        "core_vertices": q("SELECT v FROM core"),
        "core_count": q("SELECT count(*) AS n_core FROM core"),
        "core_core_edges": q("SELECT src, dst FROM cc WHERE src < dst"),
        "core_components": q("SELECT v, cluster_id FROM part_of"),
        "same_set": q("SELECT src, dst, coalesce(x.cluster_id, src) = coalesce(y.cluster_id, dst) AS same FROM e LEFT JOIN part_of x ON x.v = src LEFT JOIN part_of y ON y.v = dst WHERE src < dst"),
        "border_candidates": q("SELECT v, cluster_id FROM cand"),
        "border_assignment": q("SELECT v, cluster_id FROM bord"),
        "clustering": q(clustering),
        "clustering_deep": q(clustering, _with(eps=0.2, mu=5)),
        "clustering_custmonth": q(clustering, _with(_CUSTMONTH, 0.2, 5)),
        "cluster_sizes": q("SELECT cluster_id, count(*) FILTER (WHERE role = 'core') AS n_core, count(*) FILTER (WHERE role = 'border') AS n_border FROM cl WHERE cluster_id IS NOT NULL GROUP BY cluster_id"),
        "role_counts": q("SELECT role, count(*) AS n FROM cl GROUP BY role"),
        "clustering_text": q("SELECT v, CASE WHEN role = 'core' THEN 'c ' || v || ' ' || cluster_id || ' ' || eps_degree ELSE 'n ' || v || ' ' || coalesce(cluster_id, n) END AS line FROM cl, nv"),
        "similarity_text": q("SELECT src, dst, src || ' ' || dst || ' ' || common AS line FROM o2"),
        "neighbor_order": q(f"SELECT src, rank, {round12}, dst FROM nd"),
        "neighbor_order_descending": q(f"SELECT src, row_number() OVER (PARTITION BY src ORDER BY o2.similarity DESC, dst) AS rank, {round12}, dst FROM o2"),
        "core_order": q(f"SELECT rank, row_number() OVER (PARTITION BY rank ORDER BY nd.similarity, src) AS pos, {round12}, src AS v FROM nd WHERE rank >= 2"),
        "partition_of": q(f"SELECT v, {_part('v')} AS p FROM vx, nv"),
        "local_edges": q(f"SELECT src, dst, {_part('src')} AS p, {_part('dst')} AS q, {_part('src')} = {_part('dst')} AS local FROM e, nv"),
        "ring_owner": q("SELECT src, dst, p, q, owner FROM x JOIN own USING (p, q) WHERE src < dst", f"{base}{_cross(PARTS)}, "),
        "ring_owner_odd": q("SELECT src, dst, p, q, owner FROM x JOIN own USING (p, q) WHERE src < dst", f"{base}{_cross(5)}, "),
        "foreign_requests": q("SELECT p, q, count(*) AS n_vertices, CAST(sum(deg) AS BIGINT) AS n_edges FROM (SELECT DISTINCT p, q, dst FROM f) JOIN d ON d.v = dst GROUP BY p, q", f"{base}{asked}, "),
        "source_index_sizes": q("SELECT p, dst AS v, count(*) AS n_sources, CAST(sum(deg) AS BIGINT) AS sum_degree FROM f JOIN d ON d.v = f.src GROUP BY p, dst", f"{base}{asked}, "),
        "balanced_ranges": f"{base}{_balanced()}",
        "balanced_sources": f"{base}{asked}, y0 AS (SELECT dst AS v, sum(deg) AS deg FROM f JOIN d ON d.v = f.src GROUP BY dst), {_balanced('y0')}",
        "dense_numbers": q("SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM core"),
    }
