"""Which features say the same: pairwise dependence, its stability over days, and selection.

Features are few (tens to some hundred) and rows many: all pairwise numbers come from one pass over the
rows, and only feature-by-feature matrices are worked on further, on the driver where linear algebra is
needed. The two quadratic measures work in random blocks of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.stats import correlation


def usable_columns(rows: DataFrame, columns: Sequence[str], count_null: bool = False) -> list[str]:
    """Columns that are not all null and not constant; with count_null a null counts as a value of its own."""
    counts = rows.agg(*[F.struct(F.min(c).alias("a"), F.max(c).alias("b"), F.count(c).alias("k"), F.count(F.lit(1)).alias("all")).alias(c) for c in columns]).first()
    return [c for c in columns if counts[c]["k"] > 0 and (counts[c]["a"] != counts[c]["b"] or (count_null and counts[c]["k"] < counts[c]["all"]))]


def impute_median(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    m = rows.agg(*[F.median(c).alias(f"_m_{c}") for c in columns])
    return rows.crossJoin(F.broadcast(m)).select(*[c for c in rows.columns if c not in columns], *[F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")).alias(c) for c in columns])


def pearson_pairs(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """feature_a, feature_b, r for all pairs: p(p-1)/2 correlations in one aggregate; constant pairs are 0."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = rows.groupBy(*keys).agg(*[correlation(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)], F.count(F.lit(1)).alias("n"))
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"{i}").alias("r")) for i, (a, b) in enumerate(pairs)]))
    return wide.select(*keys, "n", cells.alias("c")).select(*keys, "n", "c.feature_a", "c.feature_b", F.coalesce("c.r", F.lit(0.0)).alias("r"))


def t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided tail probability of Student's t: the regularised incomplete beta function of df / (df + t^2) at
    (df / 2, 1 / 2), by its continued fraction."""
    from math import lgamma

    def beta(a: float, b: float, x: float) -> float:
        if x <= 0 or x >= 1:
            return float(x >= 1)
        if x > (a + 1) / (a + b + 2):
            return 1 - beta(b, a, 1 - x)
        front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
        tiny = 1e-300
        c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1) or tiny)
        total = d
        for m in range(1, 500):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 / (1 + step * d or tiny)
                c = 1 + step / c or tiny
                total *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return float(front * total)

    return np.array([np.nan if not n > 0 or np.isnan(x) else beta(n / 2, 0.5, n / (n + x * x)) if np.isfinite(x) else 0.0 for x, n in zip(t, df, strict=True)])


def with_p_values(pairs: DataFrame) -> DataFrame:
    """Adds `p_value` of a correlation r over n rows, two-sided, by Student's t with n - 2 degrees; null below 3 rows.
    A row a pair of features is all that reaches Python."""

    def tail(r: pd.Series, n: pd.Series) -> pd.Series:
        df = n.to_numpy(dtype=float) - 2
        r = r.to_numpy(dtype=float)
        with np.errstate(divide="ignore", invalid="ignore"):
            return pd.Series(t_tail(np.abs(r) * np.sqrt(df / (1 - r * r)), df))

    return pairs.withColumn("p_value", F.nanvl(F.pandas_udf(tail, "double")(F.col("r"), F.col("n")), F.lit(None).cast("double")))


def average_ranks(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The columns replaced by their ranks, ties sharing the mean rank.

    Ranks come from the counts of distinct values, joined back: no window over all rows.
    """
    out = rows
    for c in columns:
        counts = rows.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranks = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(c).alias("_v"), (before + (F.col("_n") + 1) / 2).alias("_rank"))
        on = F.col(c).eqNullSafe(F.col("_v"))
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        kept = [x for x in out.columns if x != c]
        out = out.join(ranks, on).select(*kept, F.when(F.col("_v").isNotNull(), F.col("_rank")).alias(c))
    return out


def spearman_pairs(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return pearson_pairs(average_ranks(rows, columns, keys), columns, keys)


def pair_matrix(pairs: DataFrame, columns: Sequence[str], value: str = "r") -> np.ndarray:
    """The symmetric matrix of a feature list, diagonal one: features times features numbers on the driver."""
    at = {c: i for i, c in enumerate(columns)}
    m = np.eye(len(columns))
    for r in pairs.select("feature_a", "feature_b", value).collect():
        m[at[r[0]], at[r[1]]] = m[at[r[1]], at[r[0]]] = r[2] if r[2] is not None else 0.0
    return m


def max_dependency(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each feature's strongest partner (ties: first by name) and dependence."""
    both = F.explode(F.array(F.struct(F.col("feature_a").alias("feature"), F.col("feature_b").alias("partner")), F.struct(F.col("feature_b").alias("feature"), F.col("feature_a").alias("partner"))))
    each = pairs.select(*keys, both.alias("x"), F.abs("r").alias("a")).select(*keys, "x.*", "a")
    return each.groupBy(*keys, "feature").agg(F.max("a").alias("max_abs"), F.min_by("partner", F.struct(-F.col("a"), F.col("partner"))).alias("best_partner"))


def daily_stability(daily: DataFrame, high: float = 0.90, often: float = 0.80, steady: float = 0.10) -> DataFrame:
    """Per pair over days: mean, mean of absolutes, deviations (ddof 0), range, share of days at or above
    `high`, and whether it is stably redundant."""
    a = F.abs("r")
    s = daily.groupBy("feature_a", "feature_b").agg(
        F.count(F.lit(1)).alias("n_days"), F.avg("r").alias("mean"), F.avg(a).alias("mean_abs"), F.stddev_pop("r").alias("std"), F.stddev_pop(a).alias("std_abs"), F.min("r").alias("min"), F.max("r").alias("max"), F.avg((a >= high).cast("double")).alias("fraction_high")
    )
    return s.withColumn("stable_redundant", (F.col("mean_abs") >= high) & (F.col("fraction_high") >= often) & (F.col("std_abs") <= steady))


def ranked_pairs(stability: DataFrame) -> DataFrame:
    """Order of the pairs, and a score mean_abs * fraction * (1 - clipped deviation)."""
    w = Window.orderBy(F.desc("stable_redundant"), F.desc(F.round("mean_abs", 9)), F.desc(F.round("fraction_high", 9)), F.round("std_abs", 9), "feature_a", "feature_b")  # a row a pair of features
    score = F.col("mean_abs") * F.col("fraction_high") * (1 - F.least(F.greatest("std_abs", F.lit(0.0)), F.lit(1.0)))
    return stability.withColumns({"rank": F.row_number().over(w), "rank_score": score})


def method_consensus(pairs: DataFrame) -> DataFrame:
    """Stable pairs (method, feature_a, feature_b) by how many methods name them, sorted in text."""
    a, b = F.least("feature_a", "feature_b"), F.greatest("feature_a", "feature_b")
    return pairs.groupBy(a.alias("feature_a"), b.alias("feature_b")).agg(F.count_distinct("method").alias("n_methods"), F.array_join(F.array_sort(F.collect_set("method")), ", ").alias("methods"))


def daily_feature_stats(rows: DataFrame, columns: Sequence[str], day: Column) -> DataFrame:
    """Per feature over daily means: mean, mean of absolutes, deviation (ddof 0), coefficient of variation (null for tiny means) and a label."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns]))
    days = rows.select(day.alias("day"), cells.alias("c")).groupBy("day", F.col("c.feature").alias("feature")).agg(F.avg("c.x").alias("m"))
    s = days.groupBy("feature").agg(F.count("m").alias("n_days"), F.avg("m").alias("mean"), F.avg(F.abs("m")).alias("mean_abs"), F.stddev_pop("m").alias("std"))
    cv = F.when(F.col("mean_abs") >= 1e-4, F.col("std") / F.col("mean_abs"))
    return s.withColumn("cv", cv).withColumn("temporal_label", F.when(F.col("cv").isNull(), "undefined").when(F.col("cv") <= 0.15, "stable").when(F.col("cv") >= 0.35, "date_sensitive").otherwise("moderate"))


def vif(corr: np.ndarray) -> np.ndarray:
    """Variance inflation: the diagonal of the inverse; infinite where it cannot be inverted."""
    try:
        return np.diag(np.linalg.inv(corr))
    except np.linalg.LinAlgError:
        return np.full(len(corr), np.inf)


def condition_number(corr: np.ndarray) -> tuple[float, str]:
    lam = np.linalg.eigvalsh(corr)
    lam = lam[lam > 1e-12]
    k = float(np.sqrt(lam[-1] / lam[0])) if len(lam) else float("inf")
    return k, "low" if k < 30 else "moderate" if k < 100 else "high" if k < 1000 else "severe"


def average_linkage(distance: np.ndarray, cut: float) -> np.ndarray:
    """Cluster numbers from 1 by average linkage, cut at a distance; numbered by first member."""
    groups: list[list[int]] = [[i] for i in range(len(distance))]
    while len(groups) > 1:
        best = min(((distance[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j), key=lambda x: x)
        if best[0] > cut:
            break
        groups[best[1]] += groups.pop(best[2])
    out = np.zeros(len(distance), dtype=np.int64)
    for n, members in enumerate(sorted(groups, key=min), 1):
        out[members] = n
    return out


def mrmr(relevance: np.ndarray, corr: np.ndarray, names: Sequence[str], k: int) -> list[str]:
    """Greedy order by relevance over mean absolute correlation with those chosen."""
    chosen: list[int] = []
    left = set(range(len(names)))
    while left and len(chosen) < k:
        score = lambda i: relevance[i] / max(np.abs(corr[i, chosen]).mean() if chosen else 1.0, 1e-3)
        best = max(left, key=lambda i: (score(i), -i))
        chosen.append(best)
        left.discard(best)
    return [names[i] for i in chosen]


def hash_sample(rows: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    """At most `most` rows, those with the smallest hashes: the same ones wherever they lie."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(most)


def hash_blocks(rows: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """Adds `_block`: rows fall by a hash of the key into blocks of about `size`, so each block is a random part of all rows."""
    parts = max(1, -(-rows.count() // size))
    return rows.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(parts)))


def centred_distances(v: np.ndarray) -> np.ndarray:
    """The distance matrix less its row and column means."""
    d = np.abs(v[:, None] - v[None])
    return d - d.mean(axis=0) - d.mean(axis=1)[:, None] + d.mean()


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """The V-statistic from double-centred distance matrices."""
    a, b = centred_distances(x), centred_distances(y)
    va, vb = (a * a).mean(), (b * b).mean()
    return float(np.sqrt(max((a * b).mean(), 0.0) / np.sqrt(va * vb))) if va > 0 and vb > 0 else 0.0


def _digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64).copy()
    shift = np.zeros_like(x)
    for _ in range(8):  # psi(x) = psi(x + 1) - 1 / x, then the asymptotic series
        small = x < 8
        shift[small] -= 1 / x[small]
        x[small] += 1
    f = 1 / x**2
    return shift + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def _neighbour_radius(x: np.ndarray, y: np.ndarray, k: int, most_steps: int = 256) -> np.ndarray:
    """Distance (maximum norm) of each point to its k-th nearest other point, exactly.

    Points in the order of one coordinate are compared with those one, two, ... places away on either side, until that
    coordinate alone is as far as the k-th best. What is left after `most_steps` (many equal values) is compared with all.
    """
    n = len(x)
    if len(np.unique(y)) > len(np.unique(x)):
        x, y = y, x
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    px, py = [np.concatenate([np.full(most_steps, -np.inf), v, np.full(most_steps, np.inf)]) for v in (x, y)]
    best = np.full((k, n), np.inf)
    at = np.arange(n)
    for s in range(1, most_steps + 1):
        xi, yi, i = x[at], y[at], at + most_steps
        right, left = px[i + s] - xi, xi - px[i - s]
        top = [b[at] for b in best]
        for d in (np.maximum(right, np.abs(py[i + s] - yi)), np.maximum(left, np.abs(yi - py[i - s]))):
            for j in range(k):
                top[j], d = np.minimum(top[j], d), np.maximum(top[j], d)
        for j in range(k):
            best[j, at] = top[j]
        at = at[np.minimum(right, left) < top[-1]]
        if not len(at):
            break
    out = best[-1]
    for part in np.array_split(at, max(1, len(at) * n // 4_000_000)) if len(at) else ():
        d = np.maximum(np.abs(x[part, None] - x[None]), np.abs(y[part, None] - y[None]))
        d[np.arange(len(part)), part] = np.inf
        out[part] = np.partition(d, k - 1, axis=1)[:, k - 1]
    found = np.empty(n)
    found[order] = out
    return found


def _nearer_than(x: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How many values of x, itself among them, differ from each by less than its radius."""
    values, counts = np.unique(x, return_counts=True)
    upto = np.concatenate([[0], np.cumsum(counts)])
    low, high = np.searchsorted(values, x - radius), np.searchsorted(values, x + radius)
    end = len(values)
    # sums are rounded: the ends are where the differences say
    while (m := (low < end) & (x - values[np.minimum(low, end - 1)] >= radius)).any():
        low[m] += 1
    while (m := (low > 0) & (x - values[np.maximum(low - 1, 0)] < radius)).any():
        low[m] -= 1
    while (m := (high < end) & (values[np.minimum(high, end - 1)] - x < radius)).any():
        high[m] += 1
    while (m := (high > 0) & (values[np.maximum(high - 1, 0)] - x >= radius)).any():
        high[m] -= 1
    return np.maximum(upto[high] - upto[np.minimum(low, high)], 0)


def mutual_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Nearest-neighbour estimate for continuous variables (maximum norm), at least 0."""
    n = len(x)
    x, y = [(v - v.mean()) / (v.std() or 1.0) for v in (x, y)]
    radius = _neighbour_radius(x, y, k)
    nx, ny = _nearer_than(x, radius) - 1, _nearer_than(y, radius) - 1
    return max(0.0, float(_digamma(np.array([n]))[0] + _digamma(np.array([k]))[0] - (_digamma(np.maximum(nx, 0) + 1.0) + _digamma(np.maximum(ny, 0) + 1.0)).mean()))


def pairwise_kernel(rows: DataFrame, columns: Sequence[str], key: str, block: int, kind: str) -> DataFrame:
    """Distance correlation ('dcor') or normalised mutual information ('nmi') of all pairs, over all rows.

    Both measures compare every row with every other one. Rows fall into random blocks of about `block`; a block gives
    its distance covariances, or its nearest-neighbour estimates of information, and the blocks' values are averaged,
    weighted by rows. All rows count, the work is linear in them, and the error falls as they grow. With no
    more than `block` rows it is the measure itself. Rows must have no nulls.
    """
    names = list(columns)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("_h")[names].to_numpy(dtype=np.float64)
        if kind == "dcor":
            d = [centred_distances(x[:, i]) for i in range(len(names))]
            values = [float((d[i] * d[j]).mean()) for i, j in pairs]
        else:
            values = [mutual_information(x[:, i], x[:, j]) if len(x) > 3 else 0.0 for i, j in pairs]
        return pd.DataFrame({"i": [i for i, _ in pairs], "j": [j for _, j in pairs], "x": values, "n": len(x)})

    cells = [F.col(c).cast("double").alias(c) for c in names]
    picked = hash_blocks(rows.select(key, *cells), key, block).withColumn("_h", F.xxhash64(F.lit(1), F.col(key)))
    mean = (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x")
    found = picked.groupBy("_block").applyInPandas(solve, "i int, j int, x double, n long").groupBy("i", "j").agg(mean)
    own = found.filter("i = j").select(F.col("i").alias("_f"), F.col("x").alias("_o"))  # a row a feature
    two = found.filter("i < j").join(own.withColumnsRenamed({"_f": "i", "_o": "_oi"}), "i").join(own.withColumnsRenamed({"_f": "j", "_o": "_oj"}), "j")
    both = F.sqrt(F.col("_oi") * F.col("_oj"))
    r = F.sqrt(F.greatest(F.col("x"), F.lit(0.0)) / both) if kind == "dcor" else F.least(F.lit(1.0), F.col("x") / both)
    name = F.array(*map(F.lit, names))
    return two.select(F.get(name, F.col("i")).alias("feature_a"), F.get(name, F.col("j")).alias("feature_b"), F.when((F.col("_oi") > 0) & (F.col("_oj") > 0), r).otherwise(0.0).alias("r"))


def flag_scores(features: DataFrame, methods: Sequence[str], threshold: float = 0.90) -> DataFrame:
    """Flags of each feature over its methods' maxima, VIF, cluster and mRMR rank, with a recommendation.

    features: feature, a maximum per method, vif, cluster_size, mrmr_rank (null: not selected).
    """
    flags = [F.coalesce((F.col(m) >= threshold).cast("int"), F.lit(0)) for m in methods]
    flags += [F.coalesce((F.col("vif") > 10).cast("int"), F.lit(0)), (F.col("cluster_size") > 1).cast("int"), F.col("mrmr_rank").isNull().cast("int")]
    n = sum(flags[1:], flags[0])
    return features.withColumn("n_flags", n).withColumn("recommendation", F.when(F.col("n_flags") >= 4, "REMOVE").when(F.col("n_flags") >= 2, "REVIEW").otherwise("KEEP"))


def final_selection(flagged: DataFrame) -> DataFrame:
    """Of each cluster the feature with the least 100 * flags + mRMR rank (999 if unranked); VIF above 50 goes unless alone."""
    w = Window.partitionBy("cluster").orderBy(F.col("n_flags") * 100 + F.coalesce("mrmr_rank", F.lit(999)), "feature")
    return flagged.withColumn("_r", F.row_number().over(w)).withColumn("selected", (F.col("_r") == 1) & ~((F.col("vif") > 50) & (F.col("cluster_size") > 1))).drop("_r")
