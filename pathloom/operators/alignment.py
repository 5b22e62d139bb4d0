"""Alignment of two domains' features, and what two views share.

Statistics of all rows are sums and cross-products from one pass; only features-by-features matrices reach
the driver, and what is worked out there goes back into column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.redundancy import hash_sample


def joint_standardize(source: DataFrame, target: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both domains with medians for nulls, then (x - mean) / deviation (ddof 0), all statistics of both together."""
    both = source.select(*columns).unionByName(target.select(*columns))
    medians = both.agg(*[F.median(c).alias(c) for c in columns]).first()
    filled = both.select(*[F.coalesce(F.col(c).cast("double"), F.lit(medians[c])).alias(c) for c in columns])
    s = filled.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).first()

    def scaled(rows: DataFrame) -> DataFrame:
        z = [((F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) - F.lit(s[c]["m"])) / F.lit(s[c]["s"] if s[c]["s"] and s[c]["s"] > 1e-12 else 1.0)).alias(c) for c in columns]
        return rows.select(*[c for c in rows.columns if c not in columns], *z)

    return scaled(source), scaled(target)


def covariance_pairs(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """feature_a <= feature_b in list order, cov (ddof 1): d(d+1)/2 aggregates in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = rows.groupBy(*keys).agg(*[F.covar_samp(F.col(a).cast("double"), F.col(b).cast("double")).alias(str(i)) for i, (a, b) in enumerate(pairs)])
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(str(i)).alias("cov")) for i, (a, b) in enumerate(pairs)]))
    return wide.select(*keys, cells.alias("c")).select(*keys, "c.*")


def covariance_matrix(rows: DataFrame, columns: Sequence[str], reg: float = 0.0) -> np.ndarray:
    at = {c: i for i, c in enumerate(columns)}
    m = np.zeros((len(columns), len(columns)))
    for r in covariance_pairs(rows, columns).collect():
        m[at[r.feature_a], at[r.feature_b]] = m[at[r.feature_b], at[r.feature_a]] = r.cov or 0.0
    return m + reg * np.eye(len(columns))


def covariance_gap(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the Frobenius norm of the difference of the covariances."""
    x = covariance_pairs(a, columns).withColumnRenamed("cov", "ca")
    y = covariance_pairs(b, columns).withColumnRenamed("cov", "cb")
    times = F.when(F.col("feature_a") == F.col("feature_b"), 1).otherwise(2)
    return x.join(y, ["feature_a", "feature_b"]).agg(F.sqrt(F.sum(times * F.pow(F.col("ca") - F.col("cb"), 2))).alias("frobenius_gap"))


def matrix_power(m: np.ndarray, power: float, floor: float = 1e-10) -> np.ndarray:
    lam, q = np.linalg.eigh((m + m.T) / 2)
    return (q * np.maximum(lam, floor) ** power) @ q.T


def apply_matrix(rows: DataFrame, columns: Sequence[str], matrix: np.ndarray, before: np.ndarray, after: np.ndarray) -> DataFrame:
    """(x - before) @ matrix + after, as one linear combination of columns each."""
    centred = F.array(*[F.col(c) - F.lit(float(b)) for c, b in zip(columns, before, strict=True)])
    new = []
    for j, c in enumerate(columns):
        weights = F.array(*[F.lit(float(x)) for x in matrix[:, j]])
        new.append((F.aggregate(F.zip_with("_x", weights, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x) + F.lit(float(after[j]))).alias(c))
    return rows.withColumn("_x", centred).select(*[c for c in rows.columns if c not in columns], *new)


def coral(source: DataFrame, target: DataFrame, columns: Sequence[str], reg: float = 1e-3) -> DataFrame:
    """The source whitened by its covariance and coloured by the target's, moved to the target's mean."""
    means = lambda df: np.array([x or 0.0 for x in df.agg(*[F.avg(c) for c in columns]).first()])
    matrix = matrix_power(covariance_matrix(source, columns, reg), -0.5) @ matrix_power(covariance_matrix(target, columns, reg), 0.5)
    return apply_matrix(source, columns, matrix, means(source), means(target))


def mmd2(x: np.ndarray, y: np.ndarray, bandwidth: float | None = None) -> tuple[float, float]:
    """Biased squared discrepancy with a Gaussian kernel, and its bandwidth."""
    square = lambda p, q: np.maximum((p**2).sum(1)[:, None] + (q**2).sum(1)[None] - 2 * p @ q.T, 0.0)
    every = np.concatenate([x, y])
    if bandwidth is None:
        d = square(every, every)
        bandwidth = float(np.median(d[d > 1e-12])) if (d > 1e-12).any() else 1.0
    k = lambda p, q: float(np.exp(-square(p, q) / bandwidth).mean())
    return k(x, x) + k(y, y) - 2 * k(x, y), bandwidth


def mmd_rbf(a: DataFrame, b: DataFrame, columns: Sequence[str], key: str, most: int = 1024, bandwidth: float | None = None) -> tuple[DataFrame, float]:
    """Squared maximum mean discrepancy (biased) with a Gaussian kernel on a hash sample of at most `most`
    rows of each domain, the documented bound of this quadratic measure; and the bandwidth used: the median
    positive squared distance unless given, so that it can be kept from before an alignment."""
    vector = F.array(*[F.col(c).cast("double") for c in columns])
    x, y = [np.array([r[0] for r in hash_sample(df.filter(F.forall(vector, lambda v: v.isNotNull())), key, most).select(vector).collect()]) for df in (a, b)]
    value, bandwidth = mmd2(x, y, bandwidth)
    return a.sparkSession.createDataFrame([(value, bandwidth, len(x), len(y))], "mmd2 double, bandwidth double, n_source long, n_target long"), bandwidth


def domain_moments(rows: DataFrame, columns: Sequence[str], domain: str) -> dict:
    """(n, means, covariance) of each domain's rows, which have no nulls: one pass, a row a domain on the driver."""
    d, at = len(columns), {c: i for i, c in enumerate(columns)}
    cells = [F.covar_samp(a, b).alias(f"{a}|{b}") for i, a in enumerate(columns) for b in columns[i:]]
    out = {}
    for r in rows.groupBy(domain).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in columns]).alias("m"), *cells).filter(F.col(domain).isNotNull()).collect():
        cov = np.zeros((d, d))
        for name, x in r.asDict().items():
            if "|" in name:
                a, b = name.split("|")
                cov[at[a], at[b]] = cov[at[b], at[a]] = x or 0.0
        out[r[domain]] = (r.n, np.array(r.m), cov)
    return out


def pair_scale(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation (ddof 0; 1 where constant) of two domains together."""
    n = a[0] + b[0]
    mean = (a[0] * a[1] + b[0] * b[1]) / n
    squares = sum((k - 1) * np.diag(c) + k * (m - mean) ** 2 for k, m, c in (a, b))
    s = np.sqrt(squares / n)
    return mean, np.where(s > 1e-12, s, 1.0)


def pair_maps(moments: dict, reg: float = 1e-3) -> dict:
    """For every ordered pair of domains: mean and scale of both together, the standardised covariances, and CORAL's
    (before, matrix, after) for standardised source rows."""
    out = {}
    for a, x in moments.items():
        for b, y in moments.items():
            if a != b:
                mean, s = pair_scale(x, y)
                ca, cb, eye = x[2] / np.outer(s, s), y[2] / np.outer(s, s), reg * np.eye(len(s))
                out[a, b] = {"mean": mean, "scale": s, "cov": (ca, cb), "before": (x[1] - mean) / s, "matrix": matrix_power(ca + eye, -0.5) @ matrix_power(cb + eye, 0.5), "after": (y[1] - mean) / s}
    return out


def mapped_pairs(rows: DataFrame, columns: Sequence[str], domain: str, key: str, maps: dict) -> DataFrame:
    """source, target, key and the columns as (x - before) @ matrix + after, for each row and each pair whose source is
    its domain. maps: (source, target) to (before, matrix, after); features squared numbers a pair are broadcast."""
    spark = rows.sparkSession
    shape = "source string, target string, _b array<double>, _m array<array<double>>, _a array<double>"
    given = spark.createDataFrame([(a, b, list(map(float, before)), [list(map(float, c)) for c in matrix.T], list(map(float, after))) for (a, b), (before, matrix, after) in maps.items()], shape)
    wide = rows.select(F.col(domain).alias("source"), key, F.array(*[F.col(c).cast("double") for c in columns]).alias("_x")).join(F.broadcast(given), "source")
    centred = wide.withColumn("_x", F.zip_with("_x", "_b", lambda x, b: x - b))
    dot = lambda j: F.aggregate(F.zip_with("_x", F.get("_m", F.lit(j)), lambda x, w: x * w), F.lit(0.0), lambda t, x: t + x)
    return centred.select("source", "target", key, *[(dot(j) + F.get("_a", F.lit(j))).alias(c) for j, c in enumerate(columns)])


def pair_reports(rows: DataFrame, columns: Sequence[str], domain: str, key: str, block: int = 1024) -> DataFrame:
    """Covariance gap and MMD of every ordered pair before and after CORAL, the latter with the bandwidth from before.

    All rows count. Gaps come from moments. For the MMD the rows of the two domains fall into random blocks of about
    `block` each, in which they are compared; the blocks' values are averaged, weighted by their rows. Maps, features
    squared numbers a pair of domains, are broadcast.
    """
    moments = domain_moments(rows, columns, domain)
    maps = pair_maps(moments)
    parts = {(a, b): max(1, -(-(moments[a][0] + moments[b][0]) // (2 * block))) for a, b in maps}
    spark = rows.sparkSession
    asked = spark.createDataFrame([(x, a, b, int(k), x == a) for (a, b), k in parts.items() for x in (a, b)], f"{domain} string, source string, target string, parts long, is_source boolean")
    spread = rows.select(domain, F.xxhash64(F.lit(42), F.col(key)).alias("_h"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v")).join(F.broadcast(asked), domain)
    spread = spread.withColumn("_block", F.pmod("_h", "parts"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_h", ignore_index=True)
        pair = (pdf["source"].iloc[0], pdf["target"].iloc[0])
        m = maps[pair]
        x, y = [(np.stack(v.to_numpy()) - m["mean"]) / m["scale"] if len(v) else np.empty((0, len(columns))) for v in (pdf["v"][pdf["is_source"]], pdf["v"][~pdf["is_source"]])]
        if len(x) < 2 or len(y) < 2:
            return pd.DataFrame({"source": [], "target": [], "before": [], "after": [], "n": []})
        before, width = mmd2(x, y)
        after = mmd2((x - m["before"]) @ m["matrix"] + m["after"], y, width)[0]
        return pd.DataFrame({"source": [pair[0]], "target": [pair[1]], "before": [before], "after": [after], "n": [len(x) + len(y)]})

    values = spread.groupBy("source", "target", "_block").applyInPandas(compare, "source string, target string, before double, after double, n long")
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    values = values.groupBy("source", "target").agg(mean("before").alias("before"), mean("after").alias("after"))
    # CORAL makes a covariance C of the source M' C M
    gaps = [(a, b, float(np.linalg.norm(m["cov"][0] - m["cov"][1])), float(np.linalg.norm(m["matrix"].T @ m["cov"][0] @ m["matrix"] - m["cov"][1]))) for (a, b), m in maps.items()]
    known = spark.createDataFrame(gaps, "source string, target string, gap_before double, gap_after double").join(values, ["source", "target"], "left")
    both = F.explode(F.array(F.struct(F.lit("before").alias("stage"), F.col("gap_before").alias("frobenius_gap"), F.col("before").alias("mmd2")), F.struct(F.lit("after").alias("stage"), F.col("gap_after").alias("frobenius_gap"), F.col("after").alias("mmd2"))))
    return known.select("source", "target", both.alias("x")).select("source", "target", "x.*")


def pair_gaps(rows: DataFrame, columns: Sequence[str], domain: str, y: str) -> DataFrame:
    """Covariance gap of each class and of all rows ('global') for every ordered pair of domains."""
    each = covariance_pairs(rows, columns, [domain, y]).withColumn("class", F.col(y).cast("string")).drop(y)
    every = each.unionByName(covariance_pairs(rows, columns, [domain]).withColumn("class", F.lit("global")))
    a = every.withColumnsRenamed({domain: "source", "cov": "ca"})
    b = every.withColumnsRenamed({domain: "target", "cov": "cb"})
    times = F.when(F.col("feature_a") == F.col("feature_b"), 1).otherwise(2)
    both = a.join(b, ["class", "feature_a", "feature_b"]).filter("source <> target")
    return both.groupBy("source", "target", "class").agg(F.sqrt(F.sum(times * F.pow(F.col("ca") - F.col("cb"), 2))).alias("frobenius_gap"))


def class_gaps(a: DataFrame, b: DataFrame, columns: Sequence[str], y: str) -> DataFrame:
    """Covariance gap of each class and of all rows."""
    parts = [covariance_gap(a, b, columns).withColumn("class", F.lit("global"))]
    parts += [covariance_gap(a.filter(F.col(y) == c), b.filter(F.col(y) == c), columns).withColumn("class", F.lit(str(c))) for c in (0, 1)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def canonical_correlations(cov: np.ndarray, first: int, reg: float = 1e-9) -> np.ndarray:
    """Of a joint covariance: the first `first` features against the rest."""
    xx, yy, xy = cov[:first, :first], cov[first:, first:], cov[:first, first:]
    eye = lambda m: m + reg * np.eye(len(m))
    return np.clip(np.linalg.svd(matrix_power(eye(xx), -0.5) @ xy @ matrix_power(eye(yy), -0.5), compute_uv=False), 0.0, 1.0)


def gamma_upper(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function, by series or continued fraction."""
    from math import exp, lgamma, log

    if x <= 0:
        return 1.0
    front = exp(a * log(x) - x - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-15 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def wilks(correlations: np.ndarray, n: int, p: int, q: int) -> tuple[float, float, float]:
    """Wilks' lambda, Bartlett's chi-square and its p-value."""
    lam = float(np.prod(1 - correlations**2))
    chi2 = -(n - 1 - (p + q + 1) / 2) * np.log(max(lam, 1e-300))
    return lam, float(chi2), float(gamma_upper(p * q / 2, chi2 / 2))


def _wishart(rng: np.random.Generator, n: int, d: int) -> np.ndarray:
    """The covariance of n independent normal rows of d columns, drawn without the rows (Bartlett's decomposition)."""
    t = np.tril(rng.standard_normal((d, d)), -1) + np.diag(np.sqrt(rng.chisquare(np.maximum(n - 1 - np.arange(d), 1))))
    return t @ t.T / max(n - 1, 1)


def view_test(rows: DataFrame, first: Sequence[str], second: Sequence[str], key: str, permutations: int = 1000, bootstraps: int = 100, simulations: int = 50, block: int = 8192, seed: int = 42) -> DataFrame:
    """One row: leading canonical correlation of two views, permutation p-values (b / m, and (b+1) / (m+1)),
    bootstrap limits, Wilks' test, the number of components above those of `simulations` of independent normal data
    (their 95 % quantile), and a verdict.

    All rows count in everything. They fall by a hash into random blocks; a permutation shuffles the second view
    within each block, a bootstrap gives each row a Poisson weight, and a block sends its sums of products. Of each
    draw one row of sums, features squared numbers, reaches the driver. Rows with nulls are left out.
    """
    columns = [*first, *second]
    p, d = len(first), len(columns)
    vector = F.array(*[F.col(c).cast("double") for c in columns])
    fit = rows.filter(F.forall(vector, lambda v: v.isNotNull())).select(key, vector.alias("v"))
    parts = [F.avg(F.get("v", F.lit(i))) for i in range(d)]
    wide = fit.select(*[F.get("v", F.lit(i)).alias(c) for i, c in enumerate(columns)])
    head = fit.agg(F.count(F.lit(1)).alias("n"), F.array(*parts).alias("m")).first()
    n, mean = head.n, np.array([x or 0.0 for x in head.m])
    cov = covariance_matrix(wide, columns)
    scale = np.where(np.diag(cov) > 1e-24, np.sqrt(np.abs(np.diag(cov))), 1.0)
    rho = canonical_correlations(cov, p)
    upper = np.triu_indices(d)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_h", ignore_index=True)
        x = (np.stack(pdf["v"].to_numpy()) - mean) / scale
        at, out = int(pdf["_block"].iloc[0]), []
        for i in range(permutations + bootstraps):
            rng = np.random.default_rng([seed, i, at])
            if i < permutations:
                sums = x[:, :p].T @ x[rng.permutation(len(x)), p:]
                out.append((i, *sums.ravel().tolist(), *[0.0] * (len(upper[0]) + d + 1 - p * (d - p))))
            else:
                w = rng.poisson(1.0, len(x)).astype(np.float64)
                out.append((i, *((x * w[:, None]).T @ x)[upper].tolist(), *(w @ x).tolist(), float(w.sum())))
        return pd.DataFrame(out, columns=["id", *[f"s{j}" for j in range(len(upper[0]) + d + 1)]])

    width = len(upper[0]) + d + 1
    assert p * (d - p) <= width
    blocks = fit.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key))).withColumn("_block", F.pmod("_h", F.lit(max(1, -(-n // block)))))
    sums = blocks.groupBy("_block").applyInPandas(draw, "id long, " + ", ".join(f"s{j} double" for j in range(width)))
    done = sums.groupBy("id").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)]).collect()  # a row a draw
    own = cov / np.outer(scale, scale)
    perm, boot = [], []
    for r in done:
        v = np.array(r[1:])
        c = own.copy()
        if r["id"] < permutations:
            c[:p, p:] = v[: p * (d - p)].reshape(p, d - p) / max(n - 1, 1)
            c[p:, :p] = c[:p, p:].T
            perm.append(float(canonical_correlations(c, p)[0]))
        else:
            total, m = v[-1], v[len(upper[0]) : -1] / max(v[-1], 1)
            c[upper] = v[: len(upper[0])] / max(total - 1, 1) - m[upper[0]] * m[upper[1]] * total / max(total - 1, 1)
            c = np.triu(c) + np.triu(c, 1).T
            boot.append(float(canonical_correlations(c, p)[0]))
    b = int(sum(v >= rho[0] for v in perm))
    lam, chi2, pv = wilks(rho, n, p, d - p)
    low, high = np.percentile(boot, [2.5, 97.5]) if boot else (None, None)
    chance = np.array([canonical_correlations(_wishart(np.random.default_rng([seed, 1 << 20, i]), n, d), p) for i in range(simulations)])
    above = int((rho > np.quantile(chance, 0.95, axis=0)).sum()) if simulations else 0
    row = (n, float(rho[0]), b / max(len(perm), 1), (b + 1) / (len(perm) + 1), float(low), float(high), lam, chi2, pv, above, "complementary" if rho[0] < 0.5 else "partly shared" if rho[0] < 0.8 else "redundant")
    return rows.sparkSession.createDataFrame([row], "n long, rho_1 double, p_perm double, p_perm_plus double, ci_low double, ci_high double, wilks_lambda double, chi2 double, p_value double, n_significant int, verdict string")


def joint_individual(rows: DataFrame, first: Sequence[str], second: Sequence[str], share: float = 0.95) -> DataFrame:
    """Joint, individual and noise shares of each view's variance.

    Bases are those of the views' standardised covariances up to `share` of variance. A direction is joint
    if the stacked bases' singular value exceeds 0.9 * sqrt(2). All comes from the joint covariance, so no
    rows-by-rows projection is formed.
    """
    columns, p = [*first, *second], len(first)
    cov = covariance_matrix(rows, columns)
    d = np.sqrt(np.where(np.diag(cov) > 1e-12, np.diag(cov), 1.0))
    c = cov / d[:, None] / d[None]

    def basis(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lam, v = np.linalg.eigh(m)
        lam, v = lam[::-1], v[:, ::-1]
        r = int(np.argmax(np.cumsum(lam) / lam.sum() >= share)) + 1
        return lam[:r], v[:, :r]

    (la, va), (lb, vb) = basis(c[:p, :p]), basis(c[p:, p:])
    # left singular vectors of the data are X v / sqrt(lambda): their products need the covariance only
    cross = (va / np.sqrt(la)).T @ c[:p, p:] @ (vb / np.sqrt(lb))
    gram = np.block([[np.eye(len(la)), cross], [cross.T, np.eye(len(lb))]])
    lam, w = np.linalg.eigh(gram)
    joint = [w[:, i] / np.sqrt(lam[i]) for i in range(len(lam)) if np.sqrt(max(lam[i], 0)) > 0.9 * np.sqrt(2)]
    out = []
    for name, l_, block, at in (("first", la, c[:p, :p], slice(0, len(la))), ("second", lb, c[p:, p:], slice(len(la), None))):
        whole = np.trace(block)
        shares = 0.0
        for u in joint:  # the variance of the view along a joint direction
            load = (gram @ u)[at]
            shares += float(((load * np.sqrt(l_)) ** 2).sum() / whole)
        kept = float(l_.sum() / whole)
        out.append((name, len(l_), len(joint), shares, max(kept - shares, 0.0), 1 - kept))
    return rows.sparkSession.createDataFrame(out, "view string, rank int, joint_rank int, joint double, individual double, noise double")


def scenario(source: Column, target: Column) -> Column:
    """How two domains of the form collector_as differ."""
    c, a = lambda x: F.regexp_extract(x, "^([^_]*)", 1), lambda x: F.regexp_extract(x, "as([0-9]+)$", 1)
    same_c, same_a = c(source) == c(target), a(source) == a(target)
    return F.when(same_c & same_a, "same_domain").when(same_a, "same_as_diff_collector").when(same_c, "same_collector_diff_as").otherwise("diff_as_diff_collector")
