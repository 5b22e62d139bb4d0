import itertools
import math
import time

import numpy as np
import pytest

from pathloom.operators import graph as g
from pathloom.operators import graph_kernels as k
from pathloom.operators.components import components

SHAPES = {
    "K3": [(1, 2), (1, 3), (2, 3)],
    "star": [(1, 2), (1, 3), (1, 4)],
    "C4": [(1, 2), (2, 3), (3, 4), (1, 4)],
    "P4": [(1, 2), (2, 3), (3, 4)],
    "bowtie": [(1, 2), (1, 3), (2, 3), (3, 4), (3, 5), (4, 5)],
}
# density, global and mean local clustering, diameter, mean path, algebraic connectivity, spectral radius, symmetry,
# natural connectivity, Kirchhoff index, log of spanning trees, spectral gap, mean Jaccard, mean Adamic-Adar
VALUES = {
    "K3": (1, 1, 1, 1, 1, 3, 2, 1, 0.996311, 2, 1.098612, 3, 0.333333, 1.442695),
    "star": (0.5, 0, 0, 2, 1.5, 1, 1.732051, 1, 0.671560, 9, 0, 1.732051, 0, 0),
    "C4": (0.666667, 0, 0, 2, 1.333333, 2, 2, 1, 0.867562, 5, 1.386294, 2, 0, 0),
    "P4": (0.5, 0, 0, 3, 1.666667, 0.585786, 1.618034, 1, 0.646545, 10, 0, 1, 0, 0),
    "bowtie": (0.6, 0.6, 0.866667, 2, 1.4, 1, 2.561553, 1.333333, 1.201155, 9.333333, 2.197225, 1.561553, 0.244444, 1.202246),
}


def matrix(edges):
    u, v = np.array(edges).T
    return k.adjacency(u, v)


@pytest.fixture(scope="module")
def shapes(spark):
    return spark.createDataFrame([(n, min(e), max(e)) for n, es in SHAPES.items() for e in es], "g string, u bigint, v bigint").cache()


@pytest.mark.parametrize("name", SHAPES)
def test_kernels_on_known_graphs(name):
    row = k.graph_row(matrix(SHAPES[name])[1])
    v = VALUES[name]
    got = [row[c] for c in ("diameter", "avg_path_length", "algebraic_connectivity", "spectral_radius", "symmetry_ratio", "natural_connectivity", "kirchhoff_index", "log_spanning_trees", "spectral_gap")]
    assert got == pytest.approx(v[3:12], abs=2e-6)


def test_relational_measures_on_known_graphs(shapes):
    density = {r.g: r.density for r in g.size_density(shapes, ["g"]).collect()}
    clustering = {r.g: (r.clustering_global, r.clustering_avg_local) for r in g.clustering(shapes, ["g"]).collect()}
    near = {r.g: (r.mean_jaccard, r.mean_adamic_adar) for r in g.neighbor_similarity(shapes, ["g"]).collect()}
    mixing = {r.g: r.assortativity for r in g.assortativity(shapes, ["g"]).collect()}
    for name, v in VALUES.items():
        assert (density[name], *clustering[name], *near[name]) == pytest.approx((v[0], v[1], v[2], v[12], v[13]), abs=2e-6)
    assert mixing["K3"] is None and mixing["C4"] is None
    assert (mixing["star"], mixing["P4"], mixing["bowtie"]) == pytest.approx((-1, -0.5, -0.5))


def test_rich_club_of_a_star(shapes):
    row = g.rich_club(shapes.filter("g = 'star'"), ["g"]).first()
    assert [row[f"rich_club_p{p}"] for p in (25, 50, 75, 90, 95)] == [0.5] * 5


def test_cores_and_connectivity(shapes):
    cores = {(r.g, r.asn): r.core for r in g.core_numbers(shapes, ["g"]).collect()}
    for name, edges in SHAPES.items():
        nodes, a = matrix(edges)
        assert {(name, int(n)): int(c) for n, c in zip(nodes, k.core_numbers(a), strict=True)} == {x: c for x, c in cores.items() if x[0] == name}
    assert [(k.edge_connectivity(matrix(e)[1]), k.node_connectivity(matrix(e)[1])) for e in SHAPES.values()] == [(2, 2), (1, 1), (2, 2), (1, 1), (2, 1)]


def brute_betweenness(a):
    n = len(a)
    paths = {}
    for s in range(n):
        layers, found = [[(s,)]], {s: [(s,)]}
        while layers[-1]:
            new = [p + (int(t),) for p in layers[-1] for t in np.flatnonzero(a[p[-1]]) if t not in p and (t not in found or len(found[t][0]) == len(p) + 1)]
            for p in new:
                found.setdefault(p[-1], []).append(p)
            layers.append(new)
        paths[s] = found
    out = np.zeros(n)
    for s, t in itertools.combinations(range(n), 2):
        for v in set(range(n)) - {s, t}:
            out[v] += sum(v in p for p in paths[s][t]) / len(paths[s][t])
    return out / ((n - 1) * (n - 2) / 2)


def brute_clique(a, v):
    others = np.flatnonzero(a[v])
    return 1 + max(len(c) for r in range(len(others) + 1) for c in itertools.combinations(others, r) if all(a[x, y] for x, y in itertools.combinations(c, 2)))


def test_betweenness_and_cliques_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(12):
        a = np.triu(rng.random((9, 9)) < 0.4, 1).astype(float)
        a = a + a.T
        keep = k.largest_component(a)
        a = a[np.ix_(keep, keep)]
        if len(a) < 4:
            continue
        dist, between = k.distances_and_betweenness(a)
        assert between == pytest.approx(brute_betweenness(a))
        assert list(k.clique_numbers(a, k.core_numbers(a))) == [brute_clique(a, v) for v in range(len(a))]
        cut = min(sum(a[x, y] for x in side for y in set(range(len(a))) - set(side)) for r in range(1, len(a)) for side in itertools.combinations(range(len(a)), r))
        assert k.edge_connectivity(a) == cut
        assert (dist >= 0).all()


def test_equal_graphs_share_one_kernel_call(spark):
    rows = [(w, u, v) for w in "ab" for u, v in SHAPES["bowtie"]] + [("c", 1, 2)]
    out = {r.g: r for r in k.kernel_features(spark.createDataFrame(rows, "g string, u bigint, v bigint"), ["g"]).collect()}
    assert out["a"][1:] == out["b"][1:] and out["c"].n_nodes == 2
    assert math.isclose(out["c"].spectral_radius, 1)


def test_components_of_chains_and_hubs(spark):
    links = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(150)] + [("hub", f"leaf{i}") for i in range(50)] + [("self", "self"), (None, "x")]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert {found[f"c{i:03d}"] for i in range(151)} == {"c000"}
    assert {found[f"leaf{i}"] for i in range(50)} == {"hub"} and found["self"] == "self" and "x" not in found
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_pagerank_sums_to_one_and_ego(spark, shapes):
    total = g.pagerank(shapes, ["g"], 12).groupBy("g").sum("pagerank").collect()
    assert all(abs(r[1] - 1) < 1e-9 for r in total)
    targets = spark.createDataFrame([("P4", 1)], "g string, asn bigint")
    assert sorted((r.asn, r.hop) for r in g.ego_nodes(shapes, ["g"], targets, 2).collect()) == [(1, 0), (2, 1), (3, 2)]


def test_core_numbers_within_a_task_and_by_rounds(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = []
    for name, n, p in (("thin", 60, 0.05), ("thick", 40, 0.4)):
        rows += [(name, int(i), int(j)) for i, j in np.argwhere(np.triu(rng.random((n, n)) < p, 1))]
    edges = spark.createDataFrame(rows, "g string, u bigint, v bigint").cache()
    wanted = set()
    for name in ("thin", "thick"):
        nodes, a = matrix([(u, v) for x, u, v in rows if x == name])
        wanted |= {(name, int(n), int(c)) for n, c in zip(nodes, k.core_numbers(a), strict=True)}
    cores = lambda **s: {tuple(r) for r in g.core_numbers(edges, ["g"], **s).select("g", "asn", "core").collect()}
    thin = sum(x == "thin" for x, _, _ in rows)
    assert cores(in_task=thin) == cores(in_task=0) == wanted  # one by rounds; both
    monkeypatch.setattr(g, "cut", lambda df: pytest.fail("rounds over graphs that fit a task"))
    assert cores() == wanted
    empty = g.core_numbers(edges.filter("u < 0"), ["g"])
    assert empty.columns == ["g", "asn", "core"] and empty.count() == 0


def test_core_stats_needs_no_rounds_on_the_driver(spark, data, monkeypatch):
    from pathloom.plans.graph_ops import core_stats, snapshot_edges

    monkeypatch.setattr(g, "cut", lambda df: pytest.fail("a round and a checkpoint"))
    graphs = {}
    for r in snapshot_edges(spark, data).collect():
        graphs.setdefault((r.pair, r.stamp), []).append((r.u, r.v))
    found = core_stats(spark, data).collect()
    assert len(found) == len(graphs) > 1
    for r in found:
        core = k.core_numbers(matrix(graphs[r.pair, r.stamp])[1])
        assert (r.degeneracy, r.innermost_core_size) == (core.max(), (core == core.max()).sum())
        assert (r.core_mean, r.core_std, r.core_median) == pytest.approx((core.mean(), core.std(), np.median(core)))


def test_core_stats_of_graphs_above_a_million_edges_needs_no_rounds(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from pathloom.plans.graph_ops import core_stats, kcore

    n = 180_000  # each node has twelve neighbours; then a chain of 500 nodes, a loop and an edge the other way round
    ring = spark.range(n).select("id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("o")).select(F.col("id").alias("source"), ((F.col("id") + F.col("o")) % n).alias("target"))
    chain = spark.range(n - 1, n + 499).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    rows = ring.union(chain).union(spark.createDataFrame([(7, 7), (1, 0), (None, 3)], "source bigint, target bigint")).selectExpr("'x_as1' as pair", "'20250101_0000' as stamp", "source", "target", "1 as weight")
    rows.write.parquet(str(tmp_path / "edges.parquet"))
    monkeypatch.setattr(g, "cut", lambda df: pytest.fail("a round and a checkpoint"))
    assert kcore(spark, str(tmp_path)).groupBy("core").count().orderBy("core").collect() == [(1, 500), (12, n)]
    found = core_stats(spark, str(tmp_path)).collect()
    assert len(found) == 1 and (found[0].degeneracy, found[0].innermost_core_size, found[0].core_median) == (12, n, 12)


def test_core_stats_shuffles_the_rows_once(spark, data):
    from pathloom.plans.graph_ops import core_stats

    plan = core_stats(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(pair") == 2  # rows by graph; then cores, for their largest


def test_peeling_by_chunks_and_parts_of_a_front():
    rng = np.random.default_rng(11)
    for n, p in ((60, 0.05), (60, 0.3), (200, 0.02)):
        u, v = np.argwhere(np.triu(rng.random((n, n)) < p, 1)).T
        u, v = 10 * u - 5, 10 * v - 5
        nodes, a = matrix(list(zip(u, v, strict=True)))
        wanted = dict(zip(nodes.tolist(), k.core_numbers(a).tolist(), strict=True))
        for cuts, at_once in (([], 1 << 21), ([1, 5, 5, 20], 1), ([30], 7)):
            chunks = zip(np.split(u, cuts), np.split(v, cuts), strict=True)
            nodes, core = g.peel(chunks, at_once)
            assert len(nodes) == len(wanted) and dict(zip(nodes.tolist(), core.tolist(), strict=True)) == wanted


def test_betweenness_takes_nodes_times_edges_whatever_the_levels():
    n = 1500
    a = np.diag(np.ones(n - 1), 1)
    began = time.process_time()
    dist, between = k.distances_and_betweenness(a + a.T)
    assert time.process_time() - began < 60  # products of n * n matrices by level take many times that
    i = np.arange(n)
    assert (dist == abs(i[:, None] - i)).all()
    assert between == pytest.approx(i * (n - 1 - i) / ((n - 1) * (n - 2) / 2))
    rng = np.random.default_rng(3)
    b = np.triu(rng.random((40, 40)) < 0.15, 1).astype(float)
    whole, parts = k.distances_and_betweenness(b + b.T), k.distances_and_betweenness(b + b.T, 1)
    assert (whole[0] == parts[0]).all() and whole[1] == pytest.approx(parts[1])


def test_node_rows_of_a_long_path_and_of_a_random_graph():
    n = 1500
    a = np.diag(np.ones(n - 1), 1)
    a += a.T
    began = time.process_time()
    rows = k.node_rows(np.arange(n), a)
    assert time.process_time() - began < 90  # products of n * n matrices by level take many times that
    i = np.arange(n)
    assert (rows["eccentricity"] == np.maximum(i, n - 1 - i)).all() and (rows["local_clustering"] == 0).all()
    rng = np.random.default_rng(4)
    a = np.triu(rng.random((50, 50)) < 0.2, 1).astype(float)
    a += a.T
    keep = k.largest_component(a)
    a = a[np.ix_(keep, keep)]
    rows, deg = k.node_rows(np.arange(len(a)), a), a.sum(axis=1)
    closed = np.diag(a @ a @ a)
    assert rows["local_clustering"].to_numpy() == pytest.approx(np.where(deg > 1, closed / np.maximum(deg * (deg - 1), 1), 0))
    rank = np.linalg.solve(np.eye(len(a)) - 0.85 * a / deg, np.full(len(a), 0.15 / len(a)))
    assert rows["pagerank"].to_numpy() == pytest.approx(rank, abs=1e-10)
