"""Graph measures that are no relational algebra: spectra, shortest paths, connectivity, cliques.

One NumPy kernel call for each graph (a window's or snapshot's ego network); graphs are spread over the
cluster by their keys. Equal graphs of neighbouring windows are recognised by a hash of their edges and
worked out once. A kernel holds n * n numbers, so `most_nodes` guards a task's memory: a larger graph is
an error, not a silent sample.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_COLUMNS = "degree bigint, degree_centrality double, betweenness_centrality double, closeness_centrality double, eigenvector_centrality double, pagerank double, local_clustering double, avg_neighbor_degree double, node_clique_number bigint, eccentricity bigint, core_number bigint"
GRAPH_COLUMNS = (
    "n_nodes bigint, n_edges bigint, diameter bigint, radius bigint, avg_path_length double, algebraic_connectivity double, spectral_radius double, percolation_limit double, "
    "symmetry_ratio double, natural_connectivity double, kirchhoff_index double, log_spanning_trees double, spectral_gap double, adj_eig_ratio_1_2 double, edge_connectivity bigint, node_connectivity bigint, "
    "betweenness_mean double, betweenness_max double, betweenness_std double, betweenness_skewness double, degeneracy bigint, core_mean double, core_std double, core_median double, innermost_core_size bigint"
)


def adjacency(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a = np.zeros((len(nodes), len(nodes)), dtype=np.float64)
    i, j = flat[: len(u)], flat[len(u) :]
    a[i, j] = a[j, i] = 1.0
    np.fill_diagonal(a, 0.0)
    return nodes, a


def largest_component(a: np.ndarray) -> np.ndarray:
    left, best = np.ones(len(a), dtype=bool), np.array([], dtype=np.int64)
    while left.any():
        seen = np.zeros(len(a), dtype=bool)
        front = np.array([np.flatnonzero(left)[0]])
        seen[front] = True
        while len(front):
            reach = a[front].any(axis=0) & ~seen
            seen |= reach
            front = np.flatnonzero(reach)
        left &= ~seen
        if seen.sum() > len(best):
            best = np.flatnonzero(seen)
    return best


def distances_and_betweenness(a: np.ndarray, at_once: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """All hop distances, and normalised betweenness by dependency accumulation, level by level from blocks of sources.

    Each (source, node) is expanded over its own edges once each way, so the work is nodes times edges, whatever the
    number of levels; a block of sources holds about `at_once` of these steps.
    """
    n = len(a)
    head, near = np.nonzero(a)
    degree = np.bincount(head, minlength=n)
    start = np.concatenate([[0], np.cumsum(degree)[:-1]])
    dist, total = np.full((n, n), -1, dtype=np.int64), np.zeros(n)
    block = max(1, at_once // max(1, len(near)))
    for first in range(0, n, block):
        sources = np.arange(first, min(n, first + block))
        hops = dist[sources].ravel()  # at (source - first) * n + node
        sigma, seen = np.zeros(len(hops)), np.zeros(len(hops), dtype=np.int64)
        front = (sources - first) * n + sources
        hops[front], sigma[front], levels = 0, 1.0, []
        while len(front):
            node = front % n
            size = degree[node]
            step = np.repeat(start[node] - np.cumsum(size) + size, size) + np.arange(size.sum())
            back, to = np.repeat(front, size), np.repeat(front - node, size) + near[step]
            fresh = hops[to] < 0
            back, to = back[fresh], to[fresh]
            np.add.at(sigma, to, sigma[back])
            hops[to] = len(levels) + 1
            seen[to] = np.arange(len(to))
            front = to[seen[to] == np.arange(len(to))]  # each once
            levels.append((back, to))
        delta = np.zeros(len(hops))
        for back, to in reversed(levels):
            np.add.at(delta, back, sigma[back] / sigma[to] * (1.0 + delta[to]))
        delta[(sources - first) * n + sources] = 0.0
        total += delta.reshape(len(sources), n).sum(axis=0)
        dist[sources] = hops.reshape(len(sources), n)
    total /= 2
    return dist, total / ((n - 1) * (n - 2) / 2) if n > 2 else total * 0.0


def core_numbers(a: np.ndarray) -> np.ndarray:
    left, deg = np.ones(len(a), dtype=bool), a.sum(axis=1)
    core, k = np.zeros(len(a), dtype=np.int64), 0
    while left.any():
        k = max(k, int(deg[left].min()))
        out = left & (deg <= k)
        while out.any():
            core[out] = k
            left &= ~out
            deg = deg - a[:, out].sum(axis=1)
            out = left & (deg <= k)
    return core


def clique_numbers(a: np.ndarray, core: np.ndarray) -> np.ndarray:
    """The size of the largest clique that holds each node: branch and bound, cut by core numbers and by colouring."""
    near = [set(np.flatnonzero(row).tolist()) for row in a]
    best = np.ones(len(a), dtype=np.int64)

    def colours(nodes: set[int]) -> int:
        """Colours of a greedy colouring: no clique among the nodes is larger."""
        used: list[set[int]] = []
        for x in sorted(nodes, key=lambda x: -len(near[x] & nodes)):
            for group in used:
                if not (near[x] & group):
                    group.add(x)
                    break
            else:
                used.append({x})
        return len(used)

    def grow(clique: list[int], among: set[int], goal: int) -> int:
        if len(clique) > goal:
            goal = len(clique)
            for x in clique:
                best[x] = max(best[x], goal)
        if not among or len(clique) + len(among) <= goal or len(clique) + colours(among) <= goal:
            return goal
        pivot = max(among, key=lambda x: len(near[x] & among))
        among = set(among)
        for x in [pivot, *sorted(among - near[pivot] - {pivot})]:
            goal = grow([*clique, x], among & near[x], goal)
            among.discard(x)
        return goal

    for v in np.argsort(-core, kind="stable").tolist():
        if best[v] < core[v] + 1:
            grow([v], set(near[v]), int(best[v]))
    return best


def max_flow(capacity: list[dict[int, int]], s: int, t: int, most: int) -> int:
    """Unit-augmenting flow from s to t, up to `most`."""
    flow = 0
    while flow < most:
        before, queue = {s: s}, [s]
        for x in queue:
            for y, c in capacity[x].items():
                if c > 0 and y not in before:
                    before[y] = x
                    queue.append(y)
            if t in before:
                break
        if t not in before:
            break
        y = t
        while y != s:
            x = before[y]
            capacity[x][y] -= 1
            capacity[y][x] = capacity[y].get(x, 0) + 1
            y = x
        flow += 1
    return flow


def edge_connectivity(a: np.ndarray) -> int:
    n = len(a)
    near = [np.flatnonzero(r).tolist() for r in a]
    best = min(len(x) for x in near)
    if best <= 1:
        return best
    for t in range(1, n):  # a minimum cut parts node 0 from some node
        best = min(best, max_flow([dict.fromkeys(x, 1) for x in near], 0, t, best))
        if best == 1:
            break
    return best


def node_connectivity(a: np.ndarray) -> int:
    """Least number of nodes whose removal parts the graph; n - 1 for a complete one."""
    n = len(a)
    near = [np.flatnonzero(r).tolist() for r in a]
    degrees = [len(x) for x in near]
    best = min(degrees)
    if best <= 1 or best == n - 1:
        return best

    def parted(s: int, t: int, most: int) -> int:
        split: list[dict[int, int]] = [{} for _ in range(2 * n)]
        for x in range(n):
            split[2 * x][2 * x + 1] = n if x in (s, t) else 1
            for y in near[x]:
                split[2 * x + 1][2 * y] = n
        return max_flow(split, 2 * s, 2 * t + 1, most)

    v = int(np.argmin(degrees))
    for t in range(n):
        if t != v and not a[v, t]:
            best = min(best, parted(v, t, best))
    for i, x in enumerate(near[v]):
        for y in near[v][i + 1 :]:
            if not a[x, y]:
                best = min(best, parted(x, y, best))
    return best


def skewness(x: np.ndarray) -> float | None:
    """The biased one: third over second central moment to the power 1.5."""
    c = x - x.mean()
    m2 = (c**2).mean()
    return float((c**3).mean() / m2**1.5) if m2 > 1e-18 else None


def graph_row(a: np.ndarray) -> dict:
    """Graph-level measures of a connected graph of two nodes or more; null where a measure has no value."""
    n = len(a)
    deg = a.sum(axis=1)
    dist, between = distances_and_betweenness(a)
    ecc = dist.max(axis=1)
    lam = np.linalg.eigvalsh(a)[::-1]
    mu = np.linalg.eigvalsh(np.diag(deg) - a)
    positive = mu[mu > 1e-10]
    core = core_numbers(a)
    second = lam[1] if n > 1 else None
    return {
        "n_nodes": n, "n_edges": int(deg.sum() / 2), "diameter": int(ecc.max()), "radius": int(ecc.min()), "avg_path_length": dist.sum() / (n * (n - 1)),
        "algebraic_connectivity": mu[1], "spectral_radius": lam[0], "percolation_limit": 1 / lam[0] if lam[0] else None,
        "symmetry_ratio": len(np.unique(np.round(lam, 8))) / (ecc.max() + 1), "natural_connectivity": lam[0] + np.log(np.exp(lam - lam[0]).mean()),
        "kirchhoff_index": n * (1 / positive).sum(), "log_spanning_trees": np.log(positive).sum() - np.log(n), "spectral_gap": lam[0] - second,
        "adj_eig_ratio_1_2": lam[0] / second if abs(second) > 1e-12 else None, "edge_connectivity": edge_connectivity(a), "node_connectivity": node_connectivity(a),
        "betweenness_mean": between.mean(), "betweenness_max": between.max(), "betweenness_std": between.std(), "betweenness_skewness": skewness(between),
        "degeneracy": int(core.max()), "core_mean": core.mean(), "core_std": core.std(), "core_median": float(np.median(core)), "innermost_core_size": int((core == core.max()).sum()),
    }


def node_rows(nodes: np.ndarray, a: np.ndarray) -> pd.DataFrame:
    n = len(a)
    deg = a.sum(axis=1)
    head, near = np.nonzero(a)
    dist, between = distances_and_betweenness(a)
    core = core_numbers(a)
    _, vectors = np.linalg.eigh(a)
    lead = np.abs(vectors[:, -1])
    rank = np.full(n, 1 / n)
    for _ in range(200):
        new = 0.15 / n + 0.85 * np.bincount(head, (rank / deg)[near], n)
        if np.abs(new - rank).sum() < 1e-12:
            break
        rank = new
    around = [set(x.tolist()) for x in np.split(near, np.cumsum(deg.astype(np.int64))[:-1])]
    closed = np.bincount(head, [len(around[h] & around[x]) for h, x in zip(head.tolist(), near.tolist(), strict=True)], n)
    pairs = deg * (deg - 1)
    return pd.DataFrame({
        "asn": nodes, "degree": deg.astype(np.int64), "degree_centrality": deg / (n - 1), "betweenness_centrality": between, "closeness_centrality": (n - 1) / dist.sum(axis=1),
        "eigenvector_centrality": lead, "pagerank": rank, "local_clustering": np.divide(closed, pairs, out=np.zeros(n), where=pairs > 0), "avg_neighbor_degree": (a @ deg) / deg,
        "node_clique_number": clique_numbers(a, core), "eccentricity": dist.max(axis=1), "core_number": core,
    })


def _graph_of(rows: pd.DataFrame, most_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    nodes, a = adjacency(rows["u"].to_numpy(), rows["v"].to_numpy())
    if len(nodes) > most_nodes:
        raise ValueError(f"a graph of {len(nodes)} nodes; most_nodes is {most_nodes}")
    keep = largest_component(a)
    return nodes[keep], a[np.ix_(keep, keep)]


def _by_graph(edges: DataFrame, keys: list[str], columns: str, solve) -> DataFrame:
    """Applies a kernel to each different graph once and gives its rows to all keys that have it."""
    # order-free 128-bit signature of a graph's edges
    one, two = F.xxhash64("u", "v").cast("decimal(38,0)"), F.xxhash64(F.lit(1), "u", "v").cast("decimal(38,0)")
    signed = edges.groupBy(*keys).agg(F.concat_ws(":", F.sum(one), F.sum(two), F.count(F.lit(1))).alias("_g"))
    first = signed.groupBy("_g").agg(F.min(F.struct(*keys)).alias("_k"))
    chosen = first.select("_g", *[F.col(f"_k.{k}").alias(k) for k in keys])
    out = edges.select(*keys, "u", "v").join(chosen, keys).select("_g", "u", "v").groupBy("_g").applyInPandas(solve, f"_g string, {columns}")
    return signed.join(out, "_g").drop("_g")


def kernel_features(edges: DataFrame, keys: list[str], most_nodes: int = 6000) -> DataFrame:
    """Graph-level measures of the largest component of each graph."""
    names = [c.split()[0] for c in GRAPH_COLUMNS.split(", ")]

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        found = graph_row(_graph_of(rows, most_nodes)[1])
        return pd.DataFrame([{"_g": rows["_g"].iloc[0]} | found])[["_g", *names]]

    return _by_graph(edges, keys, GRAPH_COLUMNS, solve)


def kernel_nodes(edges: DataFrame, keys: list[str], most_nodes: int = 6000) -> DataFrame:
    """Node-level measures of the largest component of each graph."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        out = node_rows(*_graph_of(rows, most_nodes))
        out.insert(0, "_g", rows["_g"].iloc[0])
        return out

    return _by_graph(edges, keys, f"asn bigint, {NODE_COLUMNS}", solve)
