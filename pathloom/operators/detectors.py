"""Anomaly detectors and clusterings that Spark ML lacks, as NumPy kernels over groups.

A group is one domain's windows, all of them. Groups are spread over the cluster by key. A task's memory is linear in
its group's rows (distances come in blocks), its time quadratic; `most_rows` may be given to refuse larger groups.
Isolation trees are fitted on a bounded hash sample (parameter `sample`) and score every row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.redundancy import hash_sample


def _harmonic(n: float) -> float:
    return 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else (1.0 if n == 2 else 0.0)


def grow_tree(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    if depth == 0 or len(x) <= 1:
        return (len(x),)
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0))
    if not len(spread):
        return (len(x),)
    f = int(rng.choice(spread))
    at = rng.uniform(x[:, f].min(), x[:, f].max())
    left = x[:, f] < at
    return (f, at, grow_tree(x[left], rng, depth - 1), grow_tree(x[~left], rng, depth - 1))


def path_depths(tree: tuple, x: np.ndarray, depth: int = 0) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), depth + _harmonic(tree[0]))
    left = x[:, tree[0]] < tree[1]
    out = np.empty(len(x))
    out[left] = path_depths(tree[2], x[left], depth + 1)
    out[~left] = path_depths(tree[3], x[~left], depth + 1)
    return out


def isolation_forest(rows: DataFrame, key: str, columns: Sequence[str], trees: int = 200, per_tree: int = 256, sample: int = 51_200, seed: int = 42) -> DataFrame:
    """Adds `iforest_score` (0 to 1, high is isolated) and `iforest_outlier` (above one half)."""
    vector = F.array(*[F.col(c).cast("double") for c in columns])
    base = np.array([r[0] for r in hash_sample(rows, key, sample, seed).select(vector).collect()])
    rng = np.random.default_rng(seed)
    size = min(per_tree, len(base))
    forest = [grow_tree(base[rng.choice(len(base), size, replace=False)], rng, int(np.ceil(np.log2(max(size, 2))))) for _ in range(trees)] if size else []
    shared = rows.sparkSession.sparkContext.broadcast(forest)  # trees x per_tree nodes

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(np.float64)
        mean = sum(path_depths(t, x) for t in shared.value) / max(len(shared.value), 1)
        return pd.Series(2.0 ** (-mean / max(_harmonic(size), 1e-12)))

    return rows.withColumn("iforest_score", score(vector)).withColumn("iforest_outlier", F.col("iforest_score") > 0.5)


def _distances(x: np.ndarray) -> np.ndarray:
    s = (x**2).sum(axis=1)
    d = np.sqrt(np.maximum(s[:, None] + s[None] - 2 * x @ x.T, 0.0))
    np.fill_diagonal(d, np.inf)
    return d


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x from those of y, column by column: the same for a row alone or in a block."""
    out = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        gap = x[:, j, None] - y[None, :, j]
        gap *= gap
        out += gap
    return out


def nearest(x: np.ndarray, k: int, rank: int, cells: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest other rows of each row (near, reach; nearest first) and the distance of the rank-th, exactly, over
    blocks of at most `cells` distances."""
    n = len(x)
    k, rank = min(k, n - 1), min(rank, n - 1)
    near, reach, core = np.empty((n, k), dtype=np.int64), np.empty((n, k)), np.empty(n)
    step = max(1, cells // n)
    for at in range(0, n, step):
        d = _squares(x[at : at + step], x)
        own = np.arange(len(d))
        d[own, at + own] = np.inf
        most = max(k, rank)
        first = np.argpartition(d, most - 1, axis=1)[:, :most]
        value = np.take_along_axis(d, first, axis=1)
        order = np.lexsort((first, value), axis=1)
        value = np.sqrt(np.take_along_axis(value, order, axis=1))
        near[at : at + step] = np.take_along_axis(first, order, axis=1)[:, :k]
        reach[at : at + step], core[at : at + step] = value[:, :k], value[:, rank - 1]
    return near, reach, core


def _factor(near: np.ndarray, reach: np.ndarray) -> np.ndarray:
    radius = reach.max(axis=1)
    density = 1 / np.maximum(np.maximum(reach, radius[near]).mean(axis=1), 1e-12)
    return density[near].mean(axis=1) / density


def local_outlier_factor(d: np.ndarray, k: int) -> np.ndarray:
    k = min(k, len(d) - 1)
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    return _factor(near, np.take_along_axis(d, near, axis=1))


CANDIDATES = (5, 10, 15, 20, 25, 30, 40, 50)


def tuned_neighbours(near: np.ndarray, reach: np.ndarray, candidates: Sequence[int] = CANDIDATES, limit: float = 1.5) -> int:
    """The candidate whose outlier rate changes least from its neighbours; ties to the nearest to sqrt(n) within 10 and 50."""
    n = len(near)
    fit = [k for k in candidates if k < n]
    if len(fit) < 2:
        return max(1, min(10, n - 1))
    rates = np.array([(_factor(near[:, :k], reach[:, :k]) > limit).mean() for k in fit])
    change = np.abs(np.diff(rates))
    local = [change[max(i - 1, 0) : i + 1].mean() for i in range(len(fit))]
    wish = np.clip(np.sqrt(n), 10, 50)
    return fit[min(range(len(fit)), key=lambda i: (round(local[i], 12), abs(fit[i] - wish)))]


def robust_covariance(x: np.ndarray, share: float = 0.75, starts: int = 20, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Location and covariance of the `share` of rows of least determinant, by concentration steps."""
    n, p = x.shape
    h, rng, best = max(int(share * n), p + 1), np.random.default_rng(seed), None
    for _ in range(starts):
        use = rng.choice(n, p + 1, replace=False)
        for _ in range(30):
            m, c = x[use].mean(axis=0), np.cov(x[use].T).reshape(p, p) + 1e-9 * np.eye(p)
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            new = np.argpartition(d, h - 1)[:h]
            if len(use) == h and set(new) == set(use):
                break
            use = new
        det = np.linalg.slogdet(np.cov(x[use].T).reshape(p, p) + 1e-9 * np.eye(p))[1]
        if best is None or det < best[0]:
            best = (det, x[use].mean(axis=0), np.cov(x[use].T).reshape(p, p) + 1e-9 * np.eye(p))
    return best[1], best[2]


def density_outliers(x: np.ndarray, core: np.ndarray, smallest: int) -> np.ndarray:
    """Outlier scores of a density hierarchy: how much less dense a point is than the densest point of the
    cluster it leaves. Mutual-reachability spanning tree of the rows x with their core distances, condensed with
    clusters of at least `smallest`. The tree takes the distances of one row at a time."""
    n = len(x)
    left, best, origin, links = np.arange(1, n), np.full(n - 1, np.inf), np.zeros(n - 1, dtype=np.int64), []
    rest, far = x[1:].copy(), core[1:].copy()
    v = 0
    for _ in range(n - 1):
        mutual = np.maximum(np.maximum(np.sqrt(_squares(x[v : v + 1], rest)[0]), far), core[v])
        nearer = mutual < best
        best[nearer], origin[nearer] = mutual[nearer], v
        i = int(np.argmin(best))
        v = int(left[i])
        links.append((best[i], origin[i], v))
        last = len(best) - 1
        for a in (left, best, origin, rest, far):  # the last takes the place of the one that is in
            a[i] = a[last]
        left, best, origin, rest, far = left[:last], best[:last], origin[:last], rest[:last], far[:last]
    links.sort()
    parent, size = list(range(2 * n - 1)), [1] * n + [0] * (n - 1)
    children, weight = {}, {}

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i, (w, a, b) in enumerate(links):
        ra, rb = find(a), find(b)
        new = n + i
        children[new], weight[new] = (ra, rb), w
        size[new] = size[ra] + size[rb]
        parent[ra] = parent[rb] = new
    lam_out, cluster, top = np.zeros(n), np.zeros(n, dtype=np.int64), {0: 0.0}
    up = {0: -1}
    stack, next_id = [(2 * n - 2, 0)], 1

    while stack:
        node, cid = stack.pop()
        if node < n:
            lam_out[node], cluster[node] = max(lam_out[node], top[cid]), cid
            continue
        lam = 1 / max(weight[node], 1e-12)
        a, b = children[node]
        large = [c for c in (a, b) if size[c] >= smallest]
        if len(large) == 2:
            for c in large:
                up[next_id], top[next_id] = cid, lam
                stack.append((c, next_id))
                next_id += 1
            top[cid] = max(top[cid], lam)
            continue
        for c in (a, b):
            if c in large:
                stack.append((c, cid))
                top[cid] = max(top[cid], lam)
            else:
                for x in _leaves(c, children, n):
                    lam_out[x], cluster[x] = lam, cid
                top[cid] = max(top[cid], lam)
    for cid in sorted(up, reverse=True):  # a cluster's densest point may lie in one below it
        if up[cid] >= 0:
            top[up[cid]] = max(top[up[cid]], top[cid])
    most = np.array([top[c] for c in cluster])
    return np.where(most > 0, (most - lam_out) / np.where(most > 0, most, 1.0), 0.0)


def _leaves(node: int, children: dict, n: int):
    stack = [node]
    while stack:
        x = stack.pop()
        if x < n:
            yield x
        else:
            stack.extend(children[x])


def detect(rows: DataFrame, group: str, key: str, columns: Sequence[str], most_rows: int | None = None) -> DataFrame:
    """Per group: LOF with a tuned neighbourhood, robust distance (MCD) and density outlier score of each row."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        if most_rows is not None and len(pdf) > most_rows:
            raise ValueError(f"a group of {len(pdf)} rows; most_rows is {most_rows}")
        pdf = pdf.sort_values(key, ignore_index=True)
        x = pdf[list(columns)].to_numpy(dtype=np.float64)
        n, p = x.shape
        out = pdf[[group, key]].copy()
        out["neighbours"], out["lof"], out["mcd_distance"], out["glosh"] = 0, 1.0, np.nan, 0.0
        if n > 3:
            q = np.percentile(x, [25, 50, 75], axis=0)
            z = (x - q[1]) / np.where(q[2] > q[0], q[2] - q[0], 1.0)
            smallest = min(max(20, int(0.005 * n)), n - 1)
            near, reach, core = nearest(z, max(CANDIDATES), smallest)
            k = tuned_neighbours(near, reach)
            out["neighbours"], out["lof"] = k, _factor(near[:, :k], reach[:, :k])
            if n > 5 * p:
                m, c = robust_covariance(z)
                out["mcd_distance"] = np.sqrt(np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(c), z - m))
            out["glosh"] = density_outliers(z, core, smallest)
        return out

    shape = f"`{group}` {kinds[group]}, `{key}` {kinds[key]}, neighbours int, lof double, mcd_distance double, glosh double"
    return rows.select(group, key, *columns).groupBy(group).applyInPandas(solve, shape)
