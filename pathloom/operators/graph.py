"""Graph features as relational plans: for every graph of a table at once, keyed by (keys).

edges: one row per undirected edge, `u` < `v`, within keys. Wedges are built from the end with the smaller
degree, which bounds their number by m * sqrt(m) even with hubs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.stats import correlation
from pathloom.session import cut


def both_ways(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b) in both directions."""
    pairs = F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))
    return edges.select(*keys, F.explode(pairs).alias("e")).select(*keys, "e.a", "e.b")


def edge_counts(log_edges: DataFrame, keys: list[str]) -> DataFrame:
    """An edge multiset as weighted edges."""
    return log_edges.groupBy(*keys, "u", "v").agg(F.count(F.lit(1)).alias("weight"))


def degrees(edges: DataFrame, keys: list[str]) -> DataFrame:
    return both_ways(edges, keys).groupBy(*keys, F.col("a").alias("asn")).agg(F.count(F.lit(1)).alias("degree"))


def size_density(edges: DataFrame, keys: list[str]) -> DataFrame:
    n = F.col("n_nodes")
    out = degrees(edges, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_nodes"), (F.sum("degree") / 2).cast("bigint").alias("n_edges"), F.max("degree").alias("max_degree"), F.avg("degree").alias("avg_degree"))
    return out.withColumn("density", 2 * F.col("n_edges") / (n * (n - 1)))


def _with_degrees(edges: DataFrame, keys: list[str]) -> DataFrame:
    d = degrees(edges, keys)
    u = d.select(*keys, F.col("asn").alias("u"), F.col("degree").alias("du"))
    v = d.select(*keys, F.col("asn").alias("v"), F.col("degree").alias("dv"))
    return edges.select(*keys, "u", "v").join(u, [*keys, "u"]).join(v, [*keys, "v"])


def assortativity(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation of the degrees at the ends of an edge, each edge in both directions; null if all are equal."""
    e = _with_degrees(edges, keys)
    sides = e.select(*keys, F.explode(F.array(F.struct(F.col("du").alias("x"), F.col("dv").alias("y")), F.struct(F.col("dv").alias("x"), F.col("du").alias("y")))).alias("p"))
    return sides.groupBy(*keys).agg(correlation(F.col("p.x"), F.col("p.y")).alias("assortativity"))


def triangles(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Each triangle once: (a, b, c)."""
    e = _with_degrees(edges, keys)
    first = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    up = e.select(*keys, F.when(first, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("b"))
    wedges = up.join(up.select(*keys, "a", F.col("b").alias("c")), [*keys, "a"]).filter("b < c")
    closing = edges.select(*keys, F.col("u").alias("b"), F.col("v").alias("c"))
    return wedges.join(closing, [*keys, "b", "c"])


def node_clustering(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Degree, triangles and local clustering of each node; 0 for a degree below 2."""
    t = triangles(edges, keys).select(*keys, F.explode(F.array("a", "b", "c")).alias("asn")).groupBy(*keys, "asn").agg(F.count(F.lit(1)).alias("triangles"))
    d = degrees(edges, keys).join(t, [*keys, "asn"], "left").na.fill(0, ["triangles"])
    wedges = F.col("degree") * (F.col("degree") - 1)
    return d.withColumn("local_clustering", F.when(wedges > 0, 2 * F.col("triangles") / wedges).otherwise(0.0))


def clustering(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Global clustering (closed of all triples) and the mean of the local one."""
    n = node_clustering(edges, keys)
    triples = F.sum(F.col("degree") * (F.col("degree") - 1) / 2)
    return n.groupBy(*keys).agg(
        (F.sum("triangles") / 3).cast("bigint").alias("n_triangles"),
        F.when(triples > 0, F.sum("triangles") / triples).otherwise(0.0).alias("clustering_global"), F.avg("local_clustering").alias("clustering_avg_local"),
    )


def avg_neighbor_degree(edges: DataFrame, keys: list[str]) -> DataFrame:
    d = degrees(edges, keys).select(*keys, F.col("asn").alias("b"), "degree")
    return both_ways(edges, keys).join(d, [*keys, "b"]).groupBy(*keys, F.col("a").alias("asn")).agg(F.avg("degree").alias("avg_neighbor_degree"))


def rich_club(edges: DataFrame, keys: list[str], percents: tuple[int, ...] = (25, 50, 75, 90, 95)) -> DataFrame:
    """Density among nodes of degree above k, where k is the whole part of a percentile of the degrees, but
    at most the largest k that two nodes exceed. From histograms: nothing is listed by node."""
    d = degrees(edges, keys)
    cuts = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.floor(F.percentile("degree", F.lit(p / 100))).alias(f"k{p}") for p in percents], F.max_by("degree", "degree").alias("_m"))
    second = d.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("degree")))).filter("_r = 2").select(*keys, (F.col("degree") - 1).alias("_last"))
    cuts = cuts.join(second, keys).drop("_m")
    ks = cuts.select(*keys, F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.least(F.col(f"k{p}"), F.col("_last")).alias("k")) for p in percents])).alias("x")).select(*keys, "x.p", "x.k")
    nodes = d.groupBy(*keys, "degree").agg(F.count(F.lit(1)).alias("n"))
    rims = _with_degrees(edges, keys).groupBy(*keys, F.least("du", "dv").alias("degree")).agg(F.count(F.lit(1)).alias("m"))
    hist = nodes.join(rims, [*keys, "degree"], "left")
    above = ks.join(hist, keys).filter("degree > k").groupBy(*keys, "p").agg(F.sum("n").alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("m"))
    phi = above.select(*keys, "p", (2 * F.col("m") / (F.col("n") * (F.col("n") - 1))).alias("phi"))
    return phi.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, F.col("phi"))).alias(f"rich_club_p{p}") for p in percents])


def neighbor_similarity(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Mean Jaccard and Adamic-Adar coefficient over the existing edges: common neighbours are triangles."""
    d = degrees(edges, keys)
    t = triangles(edges, keys)
    sides = F.array(*[F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"), F.col(z).alias("z")) for x, y, z in (("a", "b", "c"), ("a", "c", "b"), ("b", "c", "a"))])
    common = t.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.u", "s.v", F.col("s.z").alias("asn")).join(d, [*keys, "asn"])
    common = common.groupBy(*keys, "u", "v").agg(F.count(F.lit(1)).alias("common"), F.sum(1 / F.log(F.col("degree"))).alias("aa"))
    e = _with_degrees(edges, keys).join(common, [*keys, "u", "v"], "left").na.fill(0, ["common"]).na.fill(0.0, ["aa"])
    return e.groupBy(*keys).agg(F.avg(F.col("common") / (F.col("du") + F.col("dv") - F.col("common"))).alias("mean_jaccard"), F.avg("aa").alias("mean_adamic_adar"))


def degree_ccdf(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Share of nodes of each graph with at least a degree."""
    hist = degrees(edges, keys).groupBy(*keys, "degree").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy(*keys).orderBy(F.desc("degree"))
    return hist.withColumn("ccdf", F.sum("n").over(down) / F.sum("n").over(Window.partitionBy(*keys))).select(*keys, "degree", "n", "ccdf")


def ego_nodes(edges: DataFrame, keys: list[str], targets: DataFrame, hops: int = 2) -> DataFrame:
    """Nodes within `hops` of each graph's target, with their distance. targets: (keys, asn)."""
    found = targets.select(*keys, "asn", F.lit(0).alias("hop"))
    pairs = both_ways(edges, keys)
    frontier = found
    for hop in range(1, hops + 1):
        step = frontier.select(*keys, F.col("asn").alias("a")).join(pairs, [*keys, "a"]).select(*keys, F.col("b").alias("asn")).distinct()
        frontier = step.join(found, [*keys, "asn"], "left_anti").withColumn("hop", F.lit(hop))
        found = found.unionByName(frontier)
    present = pairs.select(*keys, F.col("a").alias("asn")).distinct()
    return found.join(present, [*keys, "asn"], "left_semi")


def induced(edges: DataFrame, keys: list[str], nodes: DataFrame) -> DataFrame:
    """Edges between the given nodes: two semi joins."""
    u, v = nodes.select(*keys, F.col("asn").alias("u")), nodes.select(*keys, F.col("asn").alias("v"))
    return edges.join(u, [*keys, "u"], "left_semi").join(v, [*keys, "v"], "left_semi")


def without_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with no end among the given nodes (asn), such as exchange route servers."""
    return edges.join(nodes.select(F.col("asn").alias("u")), "u", "left_anti").join(nodes.select(F.col("asn").alias("v")), "v", "left_anti")


def _adjacency(chunks: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of one graph, where each one's neighbours start, and the neighbours; both as positions in the nodes. Edges
    are read once, by chunks; 16 bytes an edge are held besides one chunk and what is held by node."""
    known, number, parts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32), []
    for u, v in chunks:
        here, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
        at = np.searchsorted(known, here)
        old = at < len(known)
        old[old] = known[at[old]] == here[old]
        own = np.empty(len(here), dtype=np.int32)
        own[old], own[~old] = number[at[old]], np.arange(len(known), len(known) + (~old).sum())
        known, number = np.insert(known, at[~old], here[~old]), np.insert(number, at[~old], own[~old])
        parts.append(own[flat])
    nodes = np.empty_like(known)
    nodes[number] = known
    start = np.zeros(len(nodes) + 1, dtype=np.int64)
    for part in parts:
        start[1:] += np.bincount(part, minlength=len(nodes))
    np.cumsum(start, out=start)
    free, near = start[:-1].copy(), np.empty(start[-1], dtype=np.int32)
    while parts:
        part = parts.pop()
        order = np.argsort(part, kind="stable")
        ends, first, times = np.unique(part[order], return_index=True, return_counts=True)
        near[np.repeat(free[ends] - first, times) + np.arange(len(part))] = np.roll(part, len(part) // 2)[order]
        free[ends] += times
    return nodes, start, near


def peel(chunks: Iterable[tuple[np.ndarray, np.ndarray]], at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of one graph and their core numbers, from its edges (each once) by chunks: nodes of the least degree left go
    out together, each edge is taken off once, at most about `at_once` of them at a time."""
    nodes, start, near = _adjacency(chunks)
    degree = np.diff(start).astype(np.int32)
    left, core, k = np.ones(len(nodes), dtype=bool), np.zeros(len(nodes), dtype=np.int64), 0
    rest = np.arange(len(nodes))
    while len(rest):
        k = max(k, int(degree[rest].min()))
        out = rest[degree[rest] <= k]
        while len(out):
            core[out], left[out] = k, False
            ends = np.cumsum(start[out + 1] - start[out])
            found = []
            for own in np.split(out, np.searchsorted(ends, np.arange(at_once, ends[-1], at_once))):
                size = start[own + 1] - start[own]
                hit = near[np.repeat(start[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
                hit, times = np.unique(hit[left[hit]], return_counts=True)
                degree[hit] -= times.astype(np.int32)
                found.append(hit)
            hit = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            out = hit[degree[hit] <= k]
        rest = rest[left[rest]]
    return nodes, core


def _chunks(batches: Iterable[pa.RecordBatch], rows: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(u, v) of Arrow's small batches, about `rows` at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for b in batches:
        held.append((b.column("u").to_numpy(zero_copy_only=False), b.column("v").to_numpy(zero_copy_only=False)))
        n += b.num_rows
        if n >= rows:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def core_numbers(
    edges: DataFrame, keys: list[str], rounds: int = 500, in_task: int = 4_000_000, tidy: Callable[[DataFrame], DataFrame] = lambda e: e
) -> DataFrame:
    """Core number of each node of each graph.

    A graph of at most `in_task` edges is peeled in one task, with time linear in its edges and memory of 16 bytes an edge
    and about 40 a node. A larger one is worked out over all tasks, by rounds of the h-index of the neighbours' estimates.

    tidy: makes the edges, if they are given as rows; it has to keep the keys. Rows are then counted (a graph never has
    more edges than rows) and shuffled once, by graph, and tidied where they are peeled.
    """
    large = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") > in_task).select(*keys)
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}

    def solve(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, core = peel(_chunks(batches))
        for i in range(0, len(nodes), 100_000):
            own = slice(i, i + 100_000)
            n = len(nodes[own])
            yield pa.RecordBatch.from_arrays([*[pa.array([x.as_py()] * n, x.type) for x in key], pa.array(nodes[own]), pa.array(core[own])], names=[*keys, "asn", "core"])

    shape = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", asn bigint, core bigint"

    def lone(rows: DataFrame) -> DataFrame:
        e = tidy(rows.repartition(*keys))
        return e.select(*keys, F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).groupBy(*keys).applyInArrow(solve, shape)

    few = large.collect()  # a row a graph of more than in_task edges
    if not few:
        return lone(edges)
    large = edges.sparkSession.createDataFrame(few, large.schema)
    return lone(edges.join(large, keys, "left_anti")).unionByName(_core_rounds(tidy(edges.join(large, keys, "left_semi")), keys, rounds))


def _core_rounds(edges: DataFrame, keys: list[str], rounds: int) -> DataFrame:
    """Core numbers by rounds: estimates start at the degrees and only fall; where a round changes nothing they are the
    core numbers."""
    pairs = cut(both_ways(edges, keys))
    state = cut(degrees(edges, keys).select(*keys, "asn", F.col("degree").alias("core")))
    for _ in range(rounds):
        near = pairs.join(state.select(*keys, F.col("asn").alias("b"), F.col("core").alias("cb")), [*keys, "b"])
        # h-index from a histogram of the neighbours' estimates: the largest c that at least c of them reach
        hist = near.join(state.select(*keys, F.col("asn").alias("a"), "core"), [*keys, "a"]).groupBy(*keys, "a", "core", F.least("cb", "core").alias("c")).agg(F.count(F.lit(1)).alias("n"))
        reach = F.sum("n").over(Window.partitionBy(*keys, "a").orderBy(F.desc("c")))
        h = hist.withColumn("reach", reach).groupBy(*keys, F.col("a").alias("asn"), F.col("core").alias("old")).agg(F.max(F.least("c", "reach")).alias("core"))
        h = cut(h)
        changed = h.filter("core < old").limit(1).count()
        state = h.drop("old")
        if not changed:
            return state
    raise RuntimeError(f"core numbers not settled after {rounds} rounds")


def core_statistics(cores: DataFrame, keys: list[str]) -> DataFrame:
    top = F.max("core").over(Window.partitionBy(*keys))
    c = F.col("core").cast("double")
    return cores.withColumn("_top", top).groupBy(*keys).agg(
        F.max("core").alias("degeneracy"), F.avg(c).alias("core_mean"), F.stddev_pop(c).alias("core_std"), F.median(c).alias("core_median"), F.count_if(F.col("core") == F.col("_top")).alias("innermost_core_size")
    )


def pagerank(edges: DataFrame, keys: list[str], rounds: int = 20, damping: float = 0.85, every: int = 5) -> DataFrame:
    """PageRank after a fixed number of rounds on undirected graphs; lineage is cut every few rounds."""
    d = degrees(edges, keys)
    sizes = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    base = cut(d.join(sizes, keys))
    pairs = cut(both_ways(edges, keys))
    rank = base.withColumn("pagerank", 1 / F.col("n"))
    for i in range(1, rounds + 1):
        given = rank.select(*keys, F.col("asn").alias("b"), (F.col("pagerank") / F.col("degree")).alias("x"))
        got = pairs.join(given, [*keys, "b"]).groupBy(*keys, F.col("a").alias("asn")).agg(F.sum("x").alias("x"))
        rank = base.join(got, [*keys, "asn"]).withColumn("pagerank", (1 - damping) / F.col("n") + damping * F.col("x")).drop("x")
        if i % every == 0 and i < rounds:
            rank = cut(rank)
    return rank.select(*keys, "asn", "pagerank")


def importance(nodes: DataFrame, keys: list[str], top: int, pinned: Column) -> DataFrame:
    """Top nodes of each graph by 0.4 degree + 0.35 core + 0.25 betweenness, each over its maximum; pinned
    nodes are always among them."""
    whole = Window.partitionBy(*keys)
    part = lambda c: F.when(F.max(c).over(whole) > 0, F.col(c) / F.max(c).over(whole)).otherwise(0.0)
    scored = nodes.withColumn("importance", 0.4 * part("degree") + 0.35 * part("core") + 0.25 * part("betweenness"))
    rank = F.row_number().over(whole.orderBy(pinned.desc(), F.desc("importance"), "asn"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top)
