"""Supervised models on Spark ML: fitting, tuning, out-of-fold scores, calibration, stacking, explanations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.evaluation import best_threshold, confusion, fold_numbers


def classifier(name: str, n_features: int, seed: int = 42, **settings):
    """gbt, rf, mlp or logistic, with the pipeline's default settings unless overridden."""
    common = {"featuresCol": "features", "labelCol": "y"}
    if name == "gbt":
        return GBTClassifier(**common, seed=seed, weightCol="weight", **({"maxIter": 60, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.9} | settings))
    if name == "rf":
        return RandomForestClassifier(**common, seed=seed, weightCol="weight", **({"numTrees": 100, "maxDepth": 8} | settings))
    if name == "mlp":
        return MultilayerPerceptronClassifier(**common, seed=seed, **({"layers": [n_features, 64, 32, 2], "maxIter": 60} | settings))
    if name == "logistic":
        return LogisticRegression(**common, weightCol="weight", **({"maxIter": 50} | settings))
    raise ValueError(f"no such classifier: {name}")


def with_class_weight(rows: DataFrame) -> DataFrame:
    """Positives weigh as many times more as there are more negatives; one row of counts is broadcast."""
    counts = rows.agg(F.count_if(F.col("y") == 1).alias("_p"), F.count_if(F.col("y") == 0).alias("_n"))
    return rows.crossJoin(F.broadcast(counts)).withColumn("weight", F.when((F.col("y") == 1) & (F.col("_p") > 0), F.col("_n") / F.col("_p")).otherwise(1.0)).drop("_p", "_n")


def fit(rows: DataFrame, columns: Sequence[str], name: str, seed: int = 42, **settings):
    """A fitted pipeline: assemble, standardise, classify. rows: columns and y."""
    stages = [VectorAssembler(inputCols=list(columns), outputCol="raw_features", handleInvalid="skip"), StandardScaler(inputCol="raw_features", outputCol="features", withMean=True), classifier(name, len(columns), seed, **settings)]
    return Pipeline(stages=stages).fit(with_class_weight(rows.withColumn("y", F.col("y").cast("double"))))


def scores(model, rows: DataFrame, keep: Sequence[str], name: str = "score") -> DataFrame:
    return model.transform(rows).select(*keep, F.get(vector_to_array("probability"), F.lit(1)).alias(name))


def out_of_fold(rows: DataFrame, columns: Sequence[str], key: str, model: str, folds: int = 3, seed: int = 42, **settings) -> DataFrame:
    """Each row scored by the model that did not see its fold; folds are stratified by a hash of the key."""
    from pathloom.session import cut

    split = cut(fold_numbers(rows, "y", key, folds, seed))
    parts = [scores(fit(split.filter(F.col("fold") != f), columns, model, seed, **settings), split.filter(F.col("fold") == f), [key, "y", "fold"]) for f in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cross_fitted(rows: DataFrame, key: str, fitted: Callable[[DataFrame, DataFrame], DataFrame], folds: int = 3, seed: int = 7) -> DataFrame:
    """What fitted(train, test) gives for each fold's rows, trained on the others: no row is scored by what has seen it."""
    fold = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(folds))
    parts = [fitted(rows.filter(fold != f), rows.filter(fold == f)) for f in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def time_folds(rows: DataFrame, order: Sequence[str], folds: int) -> DataFrame:
    """Adds `fold` for expanding windows in time: train on smaller, test on equal. 0 is never tested."""
    from pathloom.operators.ordered import numbered_by

    numbered = numbered_by(rows, list(order))
    n = numbered.count()
    return numbered.withColumn("fold", F.least(F.floor(F.col("row_no") * (folds + 1) / max(n, 1)), F.lit(folds)).cast("int")).drop("row_no")


def tune(rows: DataFrame, columns: Sequence[str], key: str, model: str, grid: Sequence[dict], folds: int = 3) -> DataFrame:
    """Macro-F1 of out-of-fold scores at one half for each setting, best first. The grid is small and given."""
    found = []
    for settings in grid:
        scored = out_of_fold(rows, columns, key, model, folds, **settings).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
        found.append((str(settings), float(confusion(scored, [], "y", "pred").first()["macro_f1"])))
    return rows.sparkSession.createDataFrame(found, "settings string, macro_f1 double").orderBy(F.desc("macro_f1"))


def calibrate_isotonic(train: DataFrame, rows: DataFrame, score: str, y: str) -> DataFrame:
    """Adds `calibrated` by isotonic regression fitted on train."""
    pack = lambda df: df.withColumn("_f", F.col(score).cast("double")).withColumn("_y", F.col(y).cast("double") if y in df.columns else F.lit(0.0))
    model = IsotonicRegression(featuresCol="_f", labelCol="_y", predictionCol="calibrated").fit(pack(train))
    return model.transform(pack(rows)).drop("_f", "_y")


def calibrate_platt(train: DataFrame, rows: DataFrame, score: str, y: str) -> DataFrame:
    """Adds `calibrated` by a logistic curve of the score."""
    assembler = VectorAssembler(inputCols=["_f"], outputCol="_v")
    pack = lambda df: assembler.transform(df.withColumn("_f", F.col(score).cast("double")))
    model = LogisticRegression(featuresCol="_v", labelCol="_y", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_q").fit(pack(train).withColumn("_y", F.col(y).cast("double")))
    return model.transform(pack(rows)).withColumn("calibrated", F.get(vector_to_array("_p"), F.lit(1))).drop("_f", "_v", "_p", "_r", "_q")


def stack(train: DataFrame, rows: DataFrame, parts: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Balanced logistic fusion of out-of-fold scores; the mean of the parts where only one class is known."""
    if train.select("y").distinct().limit(2).count() < 2:
        return rows.select(*keep, (sum((F.col(p) for p in parts[1:]), F.col(parts[0])) / len(parts)).alias("fused"))
    return scores(fit(train, parts, "logistic"), rows, keep, "fused")


def kmeans_upgrade(rows: DataFrame, columns: Sequence[str], label: str, tries: Sequence[int] = (2, 3, 4, 5), small: float = 0.05, seed: int = 42) -> DataFrame:
    """Adds `cluster` (best number of clusters by silhouette) and `upgraded`: uncertain rows of clusters with
    less than `small` of all rows become likely_anomalous."""
    shaped = VectorAssembler(inputCols=list(columns), outputCol="_v", handleInvalid="skip").transform(rows)
    best: tuple[float, DataFrame] | None = None
    for k in tries:
        placed = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(shaped).transform(shaped)
        quality = ClusteringEvaluator(featuresCol="_v", predictionCol="cluster").evaluate(placed)
        if best is None or quality > best[0]:
            best = (quality, placed)
    placed = best[1].drop("_v")
    sizes = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    rare = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("_n").alias("_all")))).select("cluster", (F.col("_n") < small * F.col("_all")).alias("_rare"))
    out = placed.join(F.broadcast(rare), "cluster")  # a row a cluster
    return out.withColumn("upgraded", F.when((F.col(label) == "uncertain") & F.col("_rare"), "likely_anomalous").otherwise(F.col(label))).drop("_rare")


def linear_explanations(model, rows: DataFrame, columns: Sequence[str], keep: Sequence[str], top: int = 3) -> DataFrame:
    """Exact SHAP values of a logistic model in log-odds, weight * (x - mean): the `top` features of each row."""
    scaler, logistic = model.stages[1], model.stages[2]
    weights = [float(w / s) if s else 0.0 for w, s in zip(logistic.coefficients.toArray(), scaler.std.toArray(), strict=True)]
    means = [float(m) for m in scaler.mean.toArray()]
    parts = F.array(*[F.struct(F.abs((F.col(c) - F.lit(m)) * F.lit(w)).alias("a"), F.lit(c).alias("feature"), ((F.col(c) - F.lit(m)) * F.lit(w)).alias("shap")) for c, w, m in zip(columns, weights, means, strict=True)])
    best = F.slice(F.sort_array(parts, asc=False), 1, top)
    return rows.select(*keep, F.posexplode(best).alias("rank", "e")).select(*keep, (F.col("rank") + 1).alias("rank"), "e.feature", "e.shap")


def sampled_shap(predict: Callable, background, rows: DataFrame, columns: Sequence[str], keep: Sequence[str], draws: int = 64, seed: int = 42) -> DataFrame:
    """SHAP values of any NumPy model by sampled orders of the features against background rows (a small array)."""
    import numpy as np
    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    shape = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", " + ", ".join(f"`shap_{c}` double" for c in columns)

    def explain(batches):
        rng = np.random.default_rng(seed)
        for pdf in batches:
            x = pdf[list(columns)].to_numpy(dtype=float)
            out = np.zeros_like(x)
            for _ in range(draws):
                z = np.repeat(background[rng.integers(len(background))][None], len(x), axis=0)
                before = predict(z)
                for j in rng.permutation(x.shape[1]):
                    z[:, j] = x[:, j]
                    after = predict(z)
                    out[:, j] += after - before
                    before = after
            yield pd.concat([pdf[list(keep)].reset_index(drop=True), pd.DataFrame(out / draws, columns=[f"shap_{c}" for c in columns])], axis=1)

    return rows.select(*keep, *columns).mapInPandas(explain, shape)


def best_tau(scored: DataFrame) -> DataFrame:
    return best_threshold(scored, [], "y", "score")
