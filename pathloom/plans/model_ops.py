"""Queries on redundancy, alignment of domains, detectors and models."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators import alignment as al
from pathloom.operators import detectors as dt
from pathloom.operators import models as mo
from pathloom.operators import redundancy as rd
from pathloom.operators.labelling import finite_rows
from pathloom.plans.label_ops import COLUMNS, _N, _numeric, _scored
from pathloom.plans.series_ops import W_SQL, features
from pathloom.plans.stream_ops import UPDATES_SQL
from pathloom.session import ensure_checkpoint_dir, table
from pathloom.sources import files
from pathloom.streaming import topology as stream

FEATURES = ["announcements", "withdrawals", "total_updates", "ann_rate", "unique_prefixes_ann", "as_path_avg", "unique_peers"]


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = features(spark, d).select("feature_id", "collector", "asn", F.date_format("w", "yyyy-MM-dd").alias("day"), *[F.col(c).cast("double").alias(c) for c in FEATURES])
    return finite_rows(rows, FEATURES).filter("day is not null")


def usable_features(spark: SparkSession, d: str) -> DataFrame:
    kept = rd.usable_columns(features(spark, d), FEATURES)
    return spark.createDataFrame([(c,) for c in kept], "feature string")


def pearson_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rd.pearson_pairs(_matrix(spark, d), FEATURES).drop("n")


def spearman_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rd.spearman_pairs(_matrix(spark, d), FEATURES).drop("n")


def max_dependency(spark: SparkSession, d: str) -> DataFrame:
    return rd.max_dependency(pearson_pairs(spark, d))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return rd.pearson_pairs(_matrix(spark, d), FEATURES, ["day"]).filter("n >= 144")


def daily_pair_stability(spark: SparkSession, d: str) -> DataFrame:
    return rd.daily_stability(_daily(spark, d))


def pair_rank(spark: SparkSession, d: str) -> DataFrame:
    return rd.ranked_pairs(daily_pair_stability(spark, d)).select("feature_a", "feature_b", F.col("rank").cast("bigint").alias("rank"), "rank_score")


def method_consensus(spark: SparkSession, d: str) -> DataFrame:
    strong = lambda df, m: df.filter(F.abs("r") >= 0.5).select(F.lit(m).alias("method"), "feature_a", "feature_b")
    return rd.method_consensus(strong(pearson_pairs(spark, d), "pearson").union(strong(spearman_pairs(spark, d), "spearman")))


def feature_labels(spark: SparkSession, d: str) -> DataFrame:
    return rd.daily_feature_stats(_matrix(spark, d), FEATURES, F.col("day"))


def median_imputed(spark: SparkSession, d: str) -> DataFrame:
    return rd.impute_median(features(spark, d).select("feature_id", "total_updates", "as_path_avg"), ["total_updates", "as_path_avg"])


def _corr(spark: SparkSession, d: str):
    return rd.pair_matrix(pearson_pairs(spark, d), FEATURES)


def vif(spark: SparkSession, d: str) -> DataFrame:
    values = rd.vif(_corr(spark, d))
    return spark.createDataFrame([(f, float(v)) for f, v in zip(FEATURES, values, strict=True)], "feature string, vif double")


def condition_number(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([rd.condition_number(_corr(spark, d))], "condition double, band string")


def daily_vif(spark: SparkSession, d: str) -> DataFrame:
    """Variance inflation and condition number by day: a day's matrix is features times features."""
    import pandas as pd

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = rd.np.eye(len(FEATURES))
        for a, b, r in zip(pdf["feature_a"], pdf["feature_b"], pdf["r"], strict=True):
            m[FEATURES.index(a), FEATURES.index(b)] = m[FEATURES.index(b), FEATURES.index(a)] = r
        k, band = rd.condition_number(m)
        return pd.DataFrame({"day": pdf["day"].iloc[0], "feature": FEATURES, "vif": np.asarray(rd.vif(m), dtype=float), "condition": k, "band": band})

    return _daily(spark, d).groupBy("day").applyInPandas(solve, "day string, feature string, vif double, condition double, band string")


def feature_clusters(spark: SparkSession, d: str) -> DataFrame:
    corr = rd.pair_matrix(spearman_pairs(spark, d), FEATURES)
    found = rd.average_linkage(1 - abs(corr), 0.3)
    return spark.createDataFrame([(f, int(c)) for f, c in zip(FEATURES, found, strict=True)], "feature string, cluster int")


def mrmr(spark: SparkSession, d: str) -> DataFrame:
    corr = _corr(spark, d)
    at = FEATURES.index("total_updates")
    names = rd.mrmr(abs(corr[at]), corr, FEATURES, 5)
    return spark.createDataFrame([(i, n) for i, n in enumerate(names, 1)], "rank int, feature string")


def dcor(spark: SparkSession, d: str) -> DataFrame:
    return rd.pairwise_kernel(_matrix(spark, d), FEATURES, "feature_id", 2000, "dcor")


def nmi(spark: SparkSession, d: str) -> DataFrame:
    return rd.pairwise_kernel(_matrix(spark, d), FEATURES, "feature_id", 3000, "nmi")


def flag_score(spark: SparkSession, d: str) -> DataFrame:
    """All methods' flags together, with recommendation and final selection."""
    p = max_dependency(spark, d).select("feature", F.col("max_abs").alias("pearson"))
    s = rd.max_dependency(spearman_pairs(spark, d)).select("feature", F.col("max_abs").alias("spearman"))
    c = feature_clusters(spark, d)
    sizes = c.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    every = p.join(s, "feature").join(vif(spark, d), "feature").join(c, "feature").join(sizes, "cluster").join(mrmr(spark, d).withColumnRenamed("rank", "mrmr_rank"), "feature", "left")
    return rd.final_selection(rd.flag_scores(every, ["pearson", "spearman"]))


def covariance_pairs(spark: SparkSession, d: str) -> DataFrame:
    return al.covariance_pairs(_matrix(spark, d), FEATURES, ["collector"])


def _pair_maps(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    rows = _matrix(spark, d)
    return rows, al.pair_maps(al.domain_moments(rows, FEATURES, "collector"))


def joint_standardize(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each collector, standardised together with each other collector."""
    rows, maps = _pair_maps(spark, d)
    scaling = {p: (m["mean"], np.diag(1 / m["scale"]), np.zeros(len(FEATURES))) for p, m in maps.items()}
    return al.mapped_pairs(rows, FEATURES, "collector", "feature_id", scaling)


def cov_gap(spark: SparkSession, d: str) -> DataFrame:
    _, maps = _pair_maps(spark, d)
    return spark.createDataFrame([(a, b, float(np.linalg.norm(m["cov"][0] - m["cov"][1]))) for (a, b), m in maps.items()], "source string, target string, frobenius_gap double")


def class_cov_gap(spark: SparkSession, d: str) -> DataFrame:
    return al.pair_gaps(_numeric(spark, d).filter("binary is not null"), COLUMNS, "domain", "binary")


def coral_transform(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each collector aligned to each other collector, in the scale of both together."""
    rows, maps = _pair_maps(spark, d)
    # (x - mean) / scale - before, times matrix: the scale goes into the matrix
    coral = {p: (m["mean"] + m["scale"] * m["before"], m["matrix"] / m["scale"][:, None], m["after"]) for p, m in maps.items()}
    return al.mapped_pairs(rows, FEATURES, "collector", "feature_id", coral)


def alignment_report(spark: SparkSession, d: str) -> DataFrame:
    """Covariance gap and MMD before and after for every ordered pair of collectors."""
    return al.pair_reports(_matrix(spark, d), FEATURES, "collector", "feature_id")


def view_test(spark: SparkSession, d: str) -> DataFrame:
    return al.view_test(_matrix(spark, d), FEATURES[:4], FEATURES[4:], "feature_id")


def joint_individual(spark: SparkSession, d: str) -> DataFrame:
    return al.joint_individual(_matrix(spark, d), FEATURES[:4], FEATURES[4:])


def detectors(spark: SparkSession, d: str) -> DataFrame:
    """LOF, robust distance and density outliers of each domain's windows, all of a domain together."""
    return dt.detect(_numeric(spark, d), "domain", "row_id", COLUMNS)


def isolation_forest(spark: SparkSession, d: str) -> DataFrame:
    return dt.isolation_forest(_numeric(spark, d), "row_id", COLUMNS).select("row_id", "iforest_score", "iforest_outlier")


def kmeans_upgrade(spark: SparkSession, d: str) -> DataFrame:
    return mo.kmeans_upgrade(_numeric(spark, d), COLUMNS, "discovered_label", range(2, 11)).select("row_id", "cluster", "upgraded")


def _training(spark: SparkSession, d: str) -> DataFrame:
    return _numeric(spark, d).filter("binary is not null").select("row_id", "w", F.col("binary").cast("double").alias("y"), *COLUMNS)


def gbt_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of rows by models that did not see them, as the next three."""
    return mo.out_of_fold(_training(spark, d), COLUMNS, "row_id", "gbt", 2).drop("fold")


def rf_scores(spark: SparkSession, d: str) -> DataFrame:
    return mo.out_of_fold(_training(spark, d), COLUMNS, "row_id", "rf", 3).drop("fold")


def mlp_scores(spark: SparkSession, d: str) -> DataFrame:
    return mo.out_of_fold(_training(spark, d), COLUMNS, "row_id", "mlp", 3).drop("fold")


def oof_scores(spark: SparkSession, d: str) -> DataFrame:
    return mo.out_of_fold(_training(spark, d), COLUMNS, "row_id", "logistic", 3)


def time_folds(spark: SparkSession, d: str) -> DataFrame:
    return mo.time_folds(_training(spark, d).select("row_id", "w"), ["w", "row_id"], 4).select("row_id", "fold")


def tuned(spark: SparkSession, d: str) -> DataFrame:
    return mo.tune(_training(spark, d), COLUMNS, "row_id", "logistic", [{"regParam": r, "elasticNetParam": e} for r in (0.0, 0.01, 0.1) for e in (0.0, 0.5)], 3)


def calibrated_scores(spark: SparkSession, d: str) -> DataFrame:
    """The given score, calibrated by curves fitted on the other folds."""
    rows = _scored(spark, d)
    iso = mo.cross_fitted(rows, "row_id", lambda train, test: mo.calibrate_isotonic(train, test, "s1", "y").select("row_id", F.col("calibrated").alias("isotonic")))
    return iso.join(mo.cross_fitted(rows, "row_id", lambda train, test: mo.calibrate_platt(train, test, "s1", "y").select("row_id", F.col("calibrated").alias("platt"))), "row_id")


def stacked_fusion(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).withColumn("y", F.col("y").cast("double"))
    return mo.cross_fitted(rows, "row_id", lambda train, test: mo.stack(train, test, ["s1", "s2"], ["row_id"]))


def explanations(spark: SparkSession, d: str) -> DataFrame:
    """The three strongest features of each row under a logistic model."""
    rows = _training(spark, d)
    return mo.linear_explanations(mo.fit(rows, COLUMNS, "logistic"), rows, COLUMNS, ["row_id"])


def update_files(spark: SparkSession, d: str) -> DataFrame:
    return files.update_files(spark, "rrc91", "2025-07-01 00:00:00", "2025-07-02 00:00:00").select("collector", "path", "ts")


def _update_stream(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """The update table as a stream, and a folder of its own for checkpoints and results in the shared folder."""
    rows = table(spark, d, "updates")
    single = all(name.endswith("/updates.parquet") for name in rows.inputFiles())  # a file, or a folder of parts
    source = stream.read_stream(spark, d if single else f"{d}/updates.parquet", rows.schema, pattern="updates.parquet" if single else None)
    return source, f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """The whole update table as a stream into five-minute windows, written to files; no update is later than the watermark."""
    source, where = _update_stream(spark, d)
    return stream.run_to_parquet(stream.window_counts(source, 5, "400 days"), f"{where}/out", f"{where}/checkpoint", "complete")


def stream_edge_state(spark: SparkSession, d: str) -> DataFrame:
    """Each collector's edges and their references at the end of the stream: the sum of the streamed deltas."""
    source, where = _update_stream(spark, d)
    deltas = stream.run_to_parquet(stream.edge_deltas(source, "400 days"), f"{where}/out", f"{where}/checkpoint")
    return deltas.groupBy("collector", "u", "v").agg(F.sum("delta").alias("refs")).filter("refs <> 0")


QUERIES = {
    f.__name__: f
    for f in (
        usable_features, pearson_pairs, spearman_pairs, max_dependency, daily_pair_stability, pair_rank, method_consensus, feature_labels, median_imputed, vif, condition_number, daily_vif, feature_clusters, mrmr, dcor, nmi, flag_score,
        joint_standardize, covariance_pairs, cov_gap, class_cov_gap, coral_transform, alignment_report, view_test, joint_individual, detectors, isolation_forest, kmeans_upgrade, gbt_scores, rf_scores, mlp_scores, oof_scores, time_folds,
        tuned, calibrated_scores, stacked_fusion, explanations, update_files, stream_window_counts, stream_edge_state,
    )
}

_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]
_M = f"WITH {W_SQL}, m AS MATERIALIZED (SELECT feature_id, collector, asn, strftime(w, '%Y-%m-%d') AS day, {', '.join(f'{c}::DOUBLE AS {c}' for c in FEATURES)} FROM f WHERE w IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)})"
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, coalesce(corr({a}, {b}), 0) AS r FROM m" for a, b in _PAIRS)
_RANK = "rk AS MATERIALIZED (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in FEATURES) + " FROM m)"
_DAILY = "dy AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT day, '{a}' AS feature_a, '{b}' AS feature_b, coalesce(CASE WHEN isnan(corr({a}, {b})) THEN 0 ELSE corr({a}, {b}) END, 0) AS r FROM m GROUP BY day HAVING count(*) >= 144" for a, b in _PAIRS) + ")"
_STAB = _DAILY + """, st AS (SELECT feature_a, feature_b, count(*) AS n_days, avg(r) AS mean, avg(abs(r)) AS mean_abs, stddev_pop(r) AS std, stddev_pop(abs(r)) AS std_abs, min(r) AS min, max(r) AS max, avg((abs(r) >= 0.9)::INT) AS fraction_high FROM dy GROUP BY ALL),
sb AS (SELECT *, mean_abs >= 0.9 AND fraction_high >= 0.8 AND std_abs <= 0.1 AS stable_redundant FROM st)"""
_PAIR = _M + ", pr AS (SELECT a.c AS source, b.c AS target FROM (SELECT DISTINCT collector AS c FROM m) a, (SELECT DISTINCT collector AS c FROM m) b WHERE a.c <> b.c), js AS MATERIALIZED (SELECT source, target, " + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) > 1e-12 THEN stddev_pop({c}) ELSE 1 END AS s_{c}" for c in FEATURES) + " FROM pr JOIN m ON m.collector IN (source, target) GROUP BY ALL)"

ORACLE = {
    "usable_features": f"WITH {W_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS feature FROM f HAVING count({c}) > 0 AND min({c}) <> max({c})" for c in FEATURES),
    "time_folds": f"{_N}, k AS (SELECT row_id, row_number() OVER (ORDER BY w, row_id) - 1 AS r, count(*) OVER () AS n FROM n WHERE \"binary\" IS NOT NULL) SELECT row_id, least(floor(r * 5 / n), 4)::INT AS fold FROM k",
    "pearson_pairs": f"{_M} {_CORR}",
    "spearman_pairs": f"{_M}, {_RANK} " + _CORR.replace("FROM m", "FROM rk"),
    "max_dependency": f"{_M}, p AS ({_CORR}), e AS (SELECT feature_a AS feature, feature_b AS partner, abs(r) AS a FROM p UNION ALL SELECT feature_b, feature_a, abs(r) FROM p) SELECT feature, max(a) AS max_abs, arg_min(partner, (-a, partner)) AS best_partner FROM e GROUP BY ALL",
    "daily_pair_stability": f"{_M}, {_STAB} SELECT * FROM sb",
    "pair_rank": f"{_M}, {_STAB} SELECT feature_a, feature_b, row_number() OVER (ORDER BY stable_redundant DESC, round(mean_abs, 9) DESC, round(fraction_high, 9) DESC, round(std_abs, 9), feature_a, feature_b) AS rank, mean_abs * fraction_high * (1 - least(greatest(std_abs, 0), 1)) AS rank_score FROM sb",
    "method_consensus": f"{_M}, {_RANK}, p AS (SELECT 'pearson' AS method, * FROM ({_CORR}) UNION ALL SELECT 'spearman', * FROM ({_CORR.replace('FROM m', 'FROM rk')})) SELECT least(feature_a, feature_b) AS feature_a, greatest(feature_a, feature_b) AS feature_b, count(DISTINCT method) AS n_methods, string_agg(DISTINCT method, ', ' ORDER BY method) AS methods FROM p WHERE abs(r) >= 0.5 GROUP BY ALL",
    "feature_labels": f"{_M}, d AS (" + " UNION ALL ".join(f"SELECT day, '{c}' AS feature, avg({c}) AS m FROM m GROUP BY day" for c in FEATURES) + "), s AS (SELECT feature, count(*) AS n_days, avg(m) AS mean, avg(abs(m)) AS mean_abs, stddev_pop(m) AS std FROM d GROUP BY ALL), c AS (SELECT *, CASE WHEN mean_abs >= 1e-4 THEN std / mean_abs END AS cv FROM s) SELECT *, CASE WHEN cv IS NULL THEN 'undefined' WHEN cv <= 0.15 THEN 'stable' WHEN cv >= 0.35 THEN 'date_sensitive' ELSE 'moderate' END AS temporal_label FROM c",
    "median_imputed": f"WITH {W_SQL}, m AS (SELECT median(total_updates) AS a, median(as_path_avg) AS b FROM f) SELECT feature_id, coalesce(total_updates, a)::DOUBLE AS total_updates, coalesce(as_path_avg, b) AS as_path_avg FROM f, m",
    "joint_standardize": _PAIR + " SELECT source, target, feature_id, " + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in FEATURES) + " FROM js JOIN m ON m.collector = source",
    "covariance_pairs": f"{_M} " + " UNION ALL ".join(f"SELECT collector, '{a}' AS feature_a, '{b}' AS feature_b, covar_samp({a}, {b}) AS cov FROM m GROUP BY collector" for i, a in enumerate(FEATURES) for b in FEATURES[i:]),
    "cov_gap": _PAIR + ", cv AS MATERIALIZED (SELECT collector, " + ", ".join(f"covar_samp({a}, {b}) AS c{i}_{j}" for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) if i <= j) + " FROM m GROUP BY ALL) SELECT source, target, sqrt(" + " + ".join(f"{1 if i == j else 2} * power((x.c{i}_{j} - y.c{i}_{j}) / (s_{a} * s_{b}), 2)" for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) if i <= j) + ") AS frobenius_gap FROM js JOIN cv x ON x.collector = source JOIN cv y ON y.collector = target",
    "class_cov_gap": _N + ", cl AS (SELECT *, \"binary\"::VARCHAR AS cls FROM n WHERE \"binary\" IS NOT NULL UNION ALL SELECT *, 'global' FROM n WHERE \"binary\" IS NOT NULL), cv AS MATERIALIZED (SELECT domain, cls, " + ", ".join(f"covar_samp({a}, {b}) AS c{i}_{j}" for i, a in enumerate(COLUMNS) for j, b in enumerate(COLUMNS) if i <= j) + " FROM cl GROUP BY ALL) SELECT x.domain AS source, y.domain AS target, x.cls AS class, sqrt(" + " + ".join(f"{1 if i == j else 2} * power(x.c{i}_{j} - y.c{i}_{j}, 2)" for i, a in enumerate(COLUMNS) for j, b in enumerate(COLUMNS) if i <= j) + ") AS frobenius_gap FROM cv x JOIN cv y ON x.cls = y.cls AND x.domain <> y.domain",
    "update_files": "SELECT 'rrc91' AS collector, 'rrc91/' || strftime(ts, '%Y.%m') || '/updates.' || strftime(ts, '%Y%m%d.%H%M') || '.gz' AS path, ts FROM (SELECT unnest(generate_series(TIMESTAMP '2025-07-01', TIMESTAMP '2025-07-01 23:55:00', INTERVAL 5 minutes)) AS ts)",
    "stream_edge_state": f"""WITH {UPDATES_SQL}, eff AS (SELECT collector, peer_as, prefix, type, path, row_number() OVER (PARTITION BY collector, peer_as, prefix ORDER BY ts DESC, seq DESC) AS r FROM u WHERE type = 'W' OR (type = 'A' AND len(path) >= 2)),
hop AS (SELECT collector, peer_as, prefix, unnest(path) AS a, unnest(path[2:]) AS b FROM eff WHERE r = 1 AND type = 'A')
SELECT collector, u, v, count(*) AS refs FROM (SELECT DISTINCT collector, peer_as, prefix, least(a, b) AS u, greatest(a, b) AS v FROM hop WHERE b IS NOT NULL) GROUP BY ALL""",
    "stream_window_counts": "SELECT coalesce(collector, '') AS collector, time_bucket(INTERVAL 5 minutes, timestamp) AS w, count(*) FILTER (type = 'A') AS announcements, count(*) FILTER (type = 'W') AS withdrawals, count(*) AS total_updates FROM (SELECT DISTINCT * FROM updates WHERE timestamp IS NOT NULL) GROUP BY ALL",
}
