"""Chains of operators: labels from detectors, class-wise alignment, deployment, ensembles and suites of tests."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators import alignment as al
from pathloom.operators import detectors as dt
from pathloom.operators import evaluation as ev
from pathloom.operators import labelling as lb
from pathloom.operators import models as mo
from pathloom.session import cut

VOTERS = ("iforest", "lof", "mcd", "glosh", "z_iqr")


def _components(rows: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, variances from large to small, and directions (columns; their largest entry is positive)."""
    mean = np.array([x or 0.0 for x in rows.agg(F.array(*[F.avg(c) for c in columns])).first()[0]])
    lam, v = np.linalg.eigh(al.covariance_matrix(rows, columns))
    lam, v = np.maximum(lam[::-1], 0.0), v[:, ::-1]
    return mean, lam, v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)


def _needed(lam: np.ndarray, share: float) -> int:
    total = lam.sum()
    return int(np.argmax(np.cumsum(lam) / total >= share - 1e-12)) + 1 if total > 0 else 1


def pca(rows: DataFrame, columns: Sequence[str], share: float = 0.95) -> tuple[DataFrame, list[str]]:
    """Rows with the leading components pc1, pc2, ... that hold `share` of the variance, and their names.

    Only the features' covariance reaches the driver. Columns of the input keep their place; rows must have no nulls.
    """
    mean, lam, v = _components(rows, columns)
    names = [f"pc{i + 1}" for i in range(_needed(lam, share))]
    along = lambda i: sum(((F.col(c) - F.lit(float(m))) * F.lit(float(w)) for c, m, w in zip(columns, mean, v[:, i], strict=True)), F.lit(0.0))
    return rows.withColumns({n: along(i) for i, n in enumerate(names)}), names


def scree(rows: DataFrame, columns: Sequence[str], shares: Sequence[float] = (0.90, 0.95, 0.99)) -> DataFrame:
    """component, variance, share, cumulative, and for each of the shares whether the component is needed for it."""
    _, lam, _ = _components(rows, columns)
    total = lam.sum() or 1.0
    cells = [(i + 1, float(x), float(x / total), float(lam[: i + 1].sum() / total), *[i < _needed(lam, s) for s in shares]) for i, x in enumerate(lam)]
    return rows.sparkSession.createDataFrame(cells, "component int, variance double, share double, cumulative double, " + ", ".join(f"within_{round(s * 100)} boolean" for s in shares))


def votes(rows: DataFrame, group: str, key: str, columns: Sequence[str]) -> DataFrame:
    """The vote (0 or 1) of each detector on each row. rows: group, key and scaled columns without nulls.

    Isolation forest by its own cut; local outlier factor, robust distance and the mean of z and quartile tests beyond
    median + 3 * 1.4826 MAD of their scores; density outliers beyond the largest gap among the group's top scores, or
    that threshold where there is no gap. What a detector cannot score counts as anomalous for it.
    """
    found = dt.detect(rows, group, key, columns)
    forest = dt.isolation_forest(rows, key, columns).select(key, F.col("iforest_outlier").cast("int").alias("iforest"))
    from pathloom.operators.ordered import largest_gap

    scored = cut(found.join(forest, key).join(lb.outlier_score(rows, columns).select(key, "z_iqr_score"), key))
    limits = {c: lb.mad_threshold(scored.filter(F.col(c).isNotNull() & ~F.isnan(c)), c).first().threshold for c in ("lof", "mcd_distance", "glosh", "z_iqr_score")}
    gaps = largest_gap(scored.filter(~F.isnan("glosh")), [group], "glosh").select(group, F.col("threshold").alias("_gap"))  # a row a group
    beyond = lambda c, at: F.coalesce(F.isnan(c) | (F.col(c) > at), F.lit(True)).cast("int")
    at = {c: F.lit(float(x) if x is not None else float("inf")) for c, x in limits.items()}
    return scored.join(gaps, group, "left").select(
        key, group, "iforest", beyond("lof", at["lof"]).alias("lof"), beyond("mcd_distance", at["mcd_distance"]).alias("mcd"),
        beyond("glosh", F.coalesce("_gap", at["glosh"])).alias("glosh"), beyond("z_iqr_score", at["z_iqr_score"]).alias("z_iqr"),
    )


def label_windows(rows: DataFrame, group: str, key: str, columns: Sequence[str], share: float = 0.95, enough: int = 50, clusters: Sequence[int] = range(2, 11)) -> DataFrame:
    """key, group, the votes, `consensus_score` and `label`: finite rows are scaled robustly and turned to their leading
    components, on which the detectors vote; the vote is weighted by how little the detectors repeat each other, and
    uncertain rows of rare clusters become likely anomalous. Fewer than `enough` rows are an error."""
    fit = lb.finite_rows(rows.select(key, group, *columns), columns)
    if fit.limit(enough).count() < enough:
        raise ValueError(f"fewer than {enough} rows with finite values")
    turned, names = pca(lb.robust_scale(fit, columns), columns, share)
    turned = cut(turned.select(key, group, *names))
    labelled = cut(lb.consensus(votes(turned, group, key, names), VOTERS))
    upgraded = mo.kmeans_upgrade(labelled.join(turned.drop(group), key), names, "label", clusters)
    return upgraded.select(key, group, *VOTERS, "consensus_score", F.col("upgraded").alias("label"))


def labelled_source(normal: DataFrame, anomalous: DataFrame) -> DataFrame:
    """Both tables as one, y 0 for the first and 1 for the second."""
    return normal.withColumn("y", F.lit(0)).unionByName(anomalous.withColumn("y", F.lit(1)))


def class_aligned(source: DataFrame, target: DataFrame, columns: Sequence[str], y: str, score: str, low: float = 0.15, high: float = 0.85, relaxed: tuple[float, float] = (0.25, 0.75), least: int = 5) -> DataFrame:
    """Source rows aligned to the target class by class, and how: `aligned_class` is 0 or 1, or null for rows aligned as
    a whole because their class has too few rows.

    The target's classes are guessed: normal below `low`, anomalous above `high`; a class with fewer than `least` rows is
    guessed by the relaxed limits, and given up if it is still short.
    """
    whole = al.coral(source, target, columns).withColumn("aligned_class", F.lit(None).cast("int"))
    out = []
    for c in (0, 1):
        own = source.filter(F.col(y) == c)
        guessed = None
        for a, b in ((low, high), relaxed):
            part = target.filter(F.col(score) < a if c == 0 else F.col(score) > b)
            if part.limit(least).count() >= least and own.limit(least).count() >= least:
                guessed = part
                break
        out.append(al.coral(own, guessed, columns).withColumn("aligned_class", F.lit(c)) if guessed is not None else whole.filter(F.col(y) == c))
    return out[0].unionByName(out[1])


def deploy(source: DataFrame, target: DataFrame, columns: Sequence[str], keep: Sequence[str], model: str = "logistic", y: str = "y") -> DataFrame:
    """Scores of the target's rows under a model of the source: gaps filled by the medians of both, both standardised
    together, the source aligned to the target, the threshold that of best macro-F1 of the source's scores from folds that
    did not see the row. Gives keep, `score`, `tau` and `pred`. A source of one class gives its share as the score."""
    a, b = al.joint_standardize(source, target, columns)
    a, b = cut(a.select(y, *columns)), cut(b.select(*keep, *columns))
    moved = cut(al.coral(a, b, columns).select(F.col(y).cast("double").alias("y"), *columns))
    if moved.select("y").distinct().limit(2).count() < 2:
        share = moved.agg(F.avg("y")).first()[0]
        return b.select(*keep, F.lit(share).cast("double").alias("score"), F.lit(0.5).alias("tau"), (F.lit(share) >= 0.5).cast("int").alias("pred"))
    fitted = mo.fit(moved, columns, model)
    unseen = mo.out_of_fold(moved.withColumn("_key", F.xxhash64(*columns)), columns, "_key", model)
    tau = mo.best_tau(unseen.select(F.col("y").cast("int").alias("y"), "score")).select("tau")  # one row
    return mo.scores(fitted, b, keep).crossJoin(F.broadcast(tau)).withColumn("pred", (F.col("score") >= F.col("tau")).cast("int"))


def ensemble(scores: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Mean, deviation (ddof 0) and number of a row's scores over seeds."""
    return scores.groupBy(*keys).agg(F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"), F.count(score).alias("n_models"))


def test_suite(rows: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Wilcoxon's test of a against b over all rows ('all', the confirmatory one) and for each group (exploratory), the
    latter with p-values after Holm for as many tests as there are groups."""
    every = ev.wilcoxon(rows.select(F.lit("all").alias("scope"), a, b), ["scope"], a, b).withColumn("kind", F.lit("confirmatory"))
    each = ev.wilcoxon(rows.select(F.col(group).alias("scope"), a, b), ["scope"], a, b).withColumn("kind", F.lit("exploratory"))
    both = every.unionByName(each)
    order = Window.partitionBy("kind").orderBy(F.col("p_value").asc_nulls_last(), "scope")  # a row a group
    times = F.count(F.lit(1)).over(Window.partitionBy("kind")) - F.row_number().over(order) + 1
    held = F.max("_p").over(order)
    return both.withColumn("_p", F.least(F.lit(1.0), F.col("p_value") * times)).withColumn("p_holm", F.when(F.col("p_value").isNotNull(), held)).drop("_p")


def stratified_background(rows: DataFrame, y: str, key: str, columns: Sequence[str], size: int = 100, normal: float = 0.8) -> np.ndarray:
    """At most `size` rows as an array, `normal` of them of class 0, those with the smallest hashes: what explanations
    compare with, a bounded sample by their definition."""
    wanted = {0: round(size * normal), 1: size - round(size * normal)}
    order = Window.partitionBy(y).orderBy(F.xxhash64(F.lit(42), F.col(key)), key)
    few = rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= F.when(F.col(y) == 0, wanted[0]).otherwise(wanted[1]))
    return np.array([list(r) for r in few.select(*columns).collect()], dtype=float)
