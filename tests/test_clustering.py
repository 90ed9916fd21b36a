"""Clustering on hand-made graphs, against a plain set implementation, and under changes that must not matter."""

from __future__ import annotations

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from meshwork import catalog
from meshwork.operators import clusters, similarity
from meshwork.operators.components import connected_components
from meshwork.operators.orders import core_order, neighbor_order
from meshwork.plans import layout
from meshwork.sources import blocks, files, graph


def make(spark, pairs, vertices):
    edges = graph.normalize_edges(spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "src long, dst long"))
    return edges, spark.createDataFrame([(int(v),) for v in vertices], "v long")


def plain(pairs, vertices, eps, mu):
    """Roles, clusters and counts by the definition."""
    nbr = defaultdict(set)
    for a, b in pairs:
        if a != b:
            nbr[a].add(b)
            nbr[b].add(a)
    def similar(a, b):
        sim = 2 + len(nbr[a] & nbr[b])
        return float(sim) * sim + 1e-8 >= eps * eps * (len(nbr[a]) + 1.0) * (len(nbr[b]) + 1.0)

    near = {v: {u for u in nbr[v] if similar(v, u)} for v in vertices}
    core = {v for v in vertices if len(near[v]) >= mu}
    label = {v: v for v in core}
    changed = True
    while changed:
        changed = False
        for v in core:
            m = min([label[v], *(label[u] for u in near[v] & core)])
            if m < label[v]:
                label[v], changed = m, True
    out = {}
    for v in vertices:
        got = [label[u] for u in near[v] & core]
        out[v] = ("core", label[v], len(near[v])) if v in core else ("border", min(got), len(near[v])) if got else ("none", None, len(near[v]))
    return out


def run(spark, pairs, vertices, eps, mu, **kw):
    return {r["v"]: (r["role"], r["cluster_id"], r["eps_degree"]) for r in clusters.cluster(*make(spark, pairs, vertices), eps, mu, **kw).collect()}


TRIANGLE = [(0, 1), (1, 2), (0, 2)]
CLIQUES = [(a, b) for a in range(5) for b in range(a)] + [(a, b) for a in range(5, 10) for b in range(5, a)] + [(10, 0), (10, 1), (10, 5), (10, 6)]
STAR = [(0, k) for k in range(1, 10)]


@pytest.mark.parametrize(
    ("pairs", "n", "eps", "mu", "want"),
    [
        (TRIANGLE, 3, 1.0, 2, {0: "core", 1: "core", 2: "core"}),
        (TRIANGLE, 3, 1.0, 3, {0: "none", 1: "none", 2: "none"}),
        (TRIANGLE, 4, 1.0, 1, {3: "none"}),
        (TRIANGLE, 4, 1.0, 0, {3: "core"}),
        ([(0, 1)], 2, 1.0, 1, {0: "core", 1: "core"}),
        ([(0, 1)], 2, 1.1, 1, {0: "none", 1: "none"}),
        (CLIQUES, 11, 0.5, 5, {0: "core", 1: "core", 5: "core", 6: "core", 2: "border", 10: "border"}),
        (STAR, 10, 0.4, 1, {0: "core", 1: "core"}),
        (STAR, 10, 0.45, 1, {0: "none", 1: "none"}),
    ],
)
def test_hand_made(spark, pairs, n, eps, mu, want):
    got = run(spark, pairs, range(n), eps, mu)
    assert {v: got[v][0] for v in want} == want
    assert got == plain(pairs, range(n), eps, mu)


def test_bridge_takes_the_smaller_cluster(spark):
    got = run(spark, CLIQUES, range(11), 0.5, 5)
    assert got[10][1] == 0 and got[5][1] == 5
    assert {c for _, c, _ in run(spark, CLIQUES, range(11), 0.5, 4).values()} == {0}


def test_isolated_core_is_its_own_cluster(spark):
    assert run(spark, TRIANGLE, range(4), 1.0, 0)[3] == ("core", 3, 0)


def test_boundary_counts_as_similar(spark):
    # degrees 2 and 74, one common neighbour, eps 0.2: the bound is a hair above 9
    pairs = [(0, 1), (0, 2), (1, 2)] + [(1, k) for k in range(3, 75)]
    edges, vertices = make(spark, pairs, range(75))
    assert (0, 1) in {tuple(r) for r in similarity.similar_edges(edges, vertices, 0.2).collect()}
    flipped = [(200 - a, 200 - b) for a, b in pairs]
    edges, vertices = make(spark, flipped, range(126, 201))
    assert (199, 200) in {tuple(r) for r in similarity.similar_edges(edges, vertices, 0.2).collect()}


def test_random_graphs(spark):
    rng = random.Random(5)
    for n, p, eps, mu in ((30, 0.15, 0.4, 2), (40, 0.3, 0.5, 3), (25, 0.6, 0.7, 4), (30, 0.2, 0.0, 2)):
        pairs = [(a, b) for a in range(n) for b in range(a) if rng.random() < p]
        want = plain(pairs, range(n), eps, mu)
        assert run(spark, pairs, range(n), eps, mu) == want
        noisy = [(b, a) for a, b in pairs] + pairs[:10] + [(3, 3)]
        rng.shuffle(noisy)
        assert run(spark, noisy, range(n), eps, mu, strategy="triangles") == want


def test_pruning_changes_nothing(spark):
    rng = random.Random(9)
    edges, vertices = make(spark, [(rng.randrange(40), rng.randrange(40)) for _ in range(200)], range(40))
    for eps in (0.2, 0.5, 0.9):
        a, b = (sorted(map(tuple, similarity.similar_edges(edges, vertices, eps, prune=p).collect())) for p in (True, False))
        assert a == b


def test_empty(spark):
    assert run(spark, [], [], 0.5, 2) == {}
    assert run(spark, [], [7], 0.5, 2) == {7: ("none", None, 0)}
    edges, vertices = make(spark, [], [1, 2])
    assert graph.degree_tail_histogram(graph.degrees(edges, vertices)).count() == 0
    assert [r["ed"] for r in layout.balanced_ranges(graph.degrees(edges, vertices), 3).orderBy("i").collect()] == [0, 0, 2]


def test_components_of_a_long_path(spark):
    ids = list(range(300))
    random.Random(1).shuffle(ids)
    pairs = list(zip(ids[:200], ids[1:200], strict=False)) + list(zip(ids[200:], ids[201:], strict=False))
    got = {r["v"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {v: min(ids[:200]) for v in ids[:200]} | {v: min(ids[200:]) for v in ids[200:]}


def test_same_set(spark):
    parts = spark.createDataFrame([(1, 1), (2, 1), (5, 5)], "v long, cluster_id long")
    got = clusters.same_set(spark.createDataFrame([(1, 2), (1, 5), (8, 9)], "src long, dst long"), parts)
    assert {(r["src"], r["dst"]): r["same"] for r in got.collect()} == {(1, 2): True, (1, 5): False, (8, 9): False}


def test_orders(spark):
    edges, vertices = make(spark, CLIQUES, range(11))
    sim = similarity.open_similarity(edges, vertices)
    order = neighbor_order(sim)
    rows = defaultdict(list)
    for r in order.orderBy("src", "rank").collect():
        rows[r["src"]].append((r["similarity"], r["dst"]))
    assert all(x == sorted(x) for x in rows.values())
    for rank, want in ((2, 11), (5, 4)):
        got = core_order(order).where(F.col("rank") == rank).orderBy("pos").collect()
        assert [r["pos"] for r in got] == list(range(1, want + 1))
        assert [(r["similarity"], r["v"]) for r in got] == sorted((rows[v][rank - 1][0], v) for v in rows if len(rows[v]) >= rank)


@pytest.mark.parametrize("parts", [2, 3, 4, 5, 8])
def test_ring_has_one_owner_for_each_pair(spark, parts):
    from meshwork.functions.bounds import handles, ring_owner

    both = spark.createDataFrame([(p, q) for p in range(parts) for q in range(parts) if p != q], "p int, q int")
    got = both.select("p", "q", handles(F.col("p"), F.col("q"), parts).alias("a"), handles(F.col("q"), F.col("p"), parts).alias("b"), ring_owner(F.col("p"), F.col("q"), parts).alias("o")).collect()
    assert all(r["a"] != r["b"] and r["o"] == (r["p"] if r["a"] else r["q"]) for r in got)


def test_balanced_ranges_follow_the_rule(spark):
    deg = [5, 0, 1, 9, 2, 2, 2, 7, 1, 1]
    degs = spark.createDataFrame(list(enumerate(deg)), "v long, deg long")
    st = done = 0
    want = []
    for i in range(1, 4):
        expected, begun, ed = done + (sum(deg) - done) // (4 - i + 1), done, st
        while done < expected:
            done += deg[ed]
            ed += 1
        want.append((st, ed, done - begun))
        st = ed
    want.append((st, len(deg), sum(deg) - done))
    assert [(r["st"], r["ed"], r["weight"]) for r in layout.balanced_ranges(degs, 4).orderBy("i").collect()] == want


@pytest.mark.parametrize("block", [1 << 14, 4, 1])
def test_flat_binary_round_trip(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(files, "BLOCK", block)
    lists = [[1, 2, 5], [], [0], list(range(3, 40, 3)), [7, 2**32 - 1], []]
    path = f"file://{tmp_path}/adj"
    files.write_flat(spark.createDataFrame(list(enumerate(lists)), "v long, nbrs array<long>"), path)
    ends = [sum(map(len, lists[: k + 1])) for k in range(len(lists))]
    rows = [(k, e - len(x), e) for k, (x, e) in enumerate(zip(lists, ends, strict=True))]
    offsets = spark.createDataFrame(rows, "v long, st long, ed long")
    read = lambda o: sorted(map(tuple, files.read_adjacency_binary(spark, path, o).collect()))
    assert read(offsets) == [(k, x) for k, nbrs in enumerate(lists) for x in nbrs]
    assert read(offsets.where("v in (2, 4)")) == [(2, 0), (4, 7), (4, 2**32 - 1)] and read(offsets.limit(0)) == []
    short, falls = [(0, 0, ends[-1] + 3 * block)], [(0, 0, 4)]  # falls: seen where the block holds it
    for wrong in (short, falls) if block > len(lists[0]) and ends[-1] % 4 == 0 or block > ends[-1] else (short,):
        with pytest.raises(Exception, match="not ascending|shorter"):
            read(spark.createDataFrame(wrong, "v long, st long, ed long"))


def test_flat_file_of_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    files.write_flat(spark.createDataFrame([], "v long, nbrs array<long>"), path)
    none = spark.createDataFrame([], "v long, st long, ed long")
    assert files.read_adjacency_binary(spark, path, none).count() == 0
    with pytest.raises(ValueError, match="shorter"):
        files.read_adjacency_binary(spark, path, spark.createDataFrame([(0, 0, 1)], none.schema))


def test_storage(spark, monkeypatch):
    from meshwork.plans import storage

    got, seen = storage.measured(spark.range(10), total=F.sum("id"))
    assert got.count() == 10 and seen == {"rows": 10, "total": 45}
    assert storage.measured(spark.range(10).where("id < 0"))[1]["rows"] == 0 and storage.measured(spark.createDataFrame([], "a int"))[1]["rows"] == 0
    files_of = got.inputFiles()
    storage.release(got)
    assert files_of and not any(os.path.exists(f.removeprefix("file://")) for f in files_of)
    assert spark.conf.get(storage.CLEAN_SHUFFLES, None) in (None, "false")

    class Remote:
        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="share"):
        storage.shared_dir(Remote)


def test_common_neighbours_choose_by_cost(spark):
    """A hub that all others know: its list would go to each of its edges, while hardly a wedge stands at a lower end."""
    from meshwork.operators import similarity

    hub = graph.normalize_edges(spark.range(1, 3000).selectExpr("0 as src", "id as dst"))
    most, entries, wedges = similarity._costs(graph.canonical(hub), hub)
    assert (most, entries, wedges) == (2999, 2999 * 3000, 0)
    full = graph.normalize_edges(spark.range(900).selectExpr("id div 30 as src", "30 + id % 30 as dst"))
    assert similarity._costs(graph.canonical(full), full) == (30, 900 * 60, sum(30 * 29 // 2 for _ in range(30)))
    for edges in (hub, full):
        assert sorted(similarity.closed_common(edges).collect()) == sorted(similarity.closed_common(edges, "triangles").collect()) == sorted(similarity.closed_common(edges, "arrays").collect())


def test_text_files(spark, tmp_path):
    (tmp_path / "in.txt").write_text("# a graph\n0 1\n1\t2\n\n2 0\n2 2\n")
    edges = files.read_edges_text(spark, str(tmp_path / "in.txt"))
    assert edges.count() == 6
    vertices = spark.range(4).withColumnRenamed("id", "v")
    found = clusters.cluster(edges, vertices, 1.0, 2)
    files.write_lines(files.clustering_text(found, 4), str(tmp_path / "out"), "v")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.splitlines() == ["c 0 0 2", "c 1 0 2", "c 2 0 2", "n 3 4"]
    assert [r["line"] for r in files.similarity_text(similarity.open_common(edges)).orderBy("src", "dst").limit(2).collect()] == ["0 1 1", "0 2 1"]


def co_occurring(rows):
    """Pairs that share a group, by plain sets, and the vertices in both closed neighbourhoods."""
    groups, nbr = defaultdict(set), defaultdict(set)
    for v, *g in rows:
        if v is not None and None not in g:
            groups[tuple(g)].add(v)
    for g in groups.values():
        for v in g:
            nbr[v] |= g - {v}
    return {(a, b): 2 + len(nbr[a] & nbr[b]) for a in nbr for b in nbr[a] if a < b}


@pytest.mark.parametrize(("block", "batch", "small", "strip"), [(4096, 256, 4096, 256), (3, 2, 4, 2), (7, 1, 0, 1)])
def test_packed_blocks(spark, monkeypatch, block, batch, small, strip):
    for name, value in (("BLOCK", block), ("BATCH_ROWS", batch), ("SMALL", small), ("STRIP", strip), ("CHUNK", 8 if block < 9 else 1 << 19)):
        monkeypatch.setattr(blocks, name, value)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        rng = random.Random(block)
        rows = [(10**12 * (v % 3) - v, rng.choice("ab"), rng.choice([1, 2, 3, None])) for v in (rng.randrange(40) for _ in range(60))]
        rows += [(None, "a", 1), (5, None, 2), (77, "alone", 1), (78, "b", None)] + [(1000 + k, "many", 1) for k in range(20)]
        rows += rows[:20]
        got = blocks.together(spark.createDataFrame(rows, "v long, t string, n int"), "v", "t", "n")
        want = co_occurring(rows)
        assert sorted(map(tuple, blocks.edges(got).collect())) == sorted([*want, *((b, a) for a, b in want)])
        assert sorted(map(tuple, blocks.closed_common(got).collect())) == sorted((*e, n) for e, n in want.items())
        none = blocks.together(spark.createDataFrame([], "v long, t string"), "v", "t")
        assert blocks.edges(none).count() == 0 and blocks.closed_common(none).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def _shuffled(spark, run):
    """Bytes that `run` writes for shuffles, by Spark's own figures."""
    sc = spark.sparkContext._jsc.sc()

    def bytes_now():
        got = sc.statusStore().executorList(False)
        return sum(got.apply(k).totalShuffleWrite() for k in range(got.size()))

    before = bytes_now()
    run()
    sc.listenerBus().waitUntilEmpty(30_000)
    return bytes_now() - before


@pytest.mark.parametrize(("query", "most"), [("closed_common_userhour", 8), ("edges_userhour", 4)])
def test_dense_pairs_are_not_shuffled(spark, tmp_path, query, most):
    rng = random.Random(3)
    events = spark.createDataFrame([(rng.randrange(600), rng.choice("abc"), 3600 * rng.randrange(40)) for _ in range(12000)], "user_id long, event_type string, s long")
    events.select("user_id", "event_type", F.timestamp_seconds("s").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    moved = _shuffled(spark, lambda: catalog.queries()[query](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out"))
    rows = spark.read.parquet(f"{tmp_path}/out").count()
    assert rows > 150_000 and moved < most * rows  # a shuffled pair takes eight bytes or so, once to be found and once more to be told apart


def _copied(users, rows, copies):
    """Users in the same hours, again and again with shifted ids."""
    rng = random.Random(5)
    some = [(rng.randrange(users), rng.choice("abc"), rng.randrange(20)) for _ in range(rows)]
    return [(v + users * k, t, n) for k in range(copies) for v, t, n in some]


@pytest.mark.parametrize("told", [True, False])
def test_twins_are_spelt_out(spark, monkeypatch, told):
    monkeypatch.setattr(blocks, "BLOCK", 30)
    if not told:  # marks that all vertices agree in: no group of a class has all of it
        monkeypatch.setattr(blocks, "_marks", lambda group: [F.lit(1).alias("n"), F.lit(1).alias("h1"), F.lit(1).alias("h2")])
    rows = [*_copied(40, 160, 3), (7, "a", 99), (10**12, "alone", 1), (10**12 + 1, "pair", 1), (10**12 + 2, "pair", 1), (5, "pair", None)]
    got = blocks.together(spark.createDataFrame(rows, "v long, t string, n int"), "v", "t", "n")
    want = co_occurring(rows)
    assert sorted(map(tuple, blocks.edges(got).collect())) == sorted([*want, *((b, a) for a, b in want)])
    assert sorted(map(tuple, blocks.closed_common(got).collect())) == sorted((*e, n) for e, n in want.items())


def test_blocks_of_twins_are_sent_once(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 400)
    events = spark.createDataFrame(_copied(200, 1000, 12), "v long, t string, n int").coalesce(1)
    got, rows = blocks.together(events, "v", "t", "n"), []
    moved = _shuffled(spark, lambda: rows.append(blocks.closed_common(got).count()))
    assert rows[0] > 900_000 and moved < 1_000_000  # 3,968,662 when each vertex had a row of its own, 232,730 with classes
