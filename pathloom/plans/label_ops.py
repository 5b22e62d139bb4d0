"""Queries on labels, votes, scores and metrics over the labelled windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators import evaluation as ev
from pathloom.operators import labelling as lb
from pathloom.plans.series_ops import L_SQL, labelled

COLUMNS = ["announcements", "as_path_avg", "n_nodes", "consensus_score"]
METHODS = ["m1", "m2", "m3", "m4", "m5"]


def _numeric(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).select("row_id", "domain", "w", "discovered_label", "binary", "event_id", "provenance", "incident_type", *[F.col(c).cast("double").alias(c) for c in COLUMNS])
    return lb.finite_rows(rows, COLUMNS)


def _votes(spark: SparkSession, d: str) -> DataFrame:
    v = {"m1": F.col("announcements") > 500, "m2": F.col("as_path_avg") > 5, "m3": F.col("n_nodes") > 3000, "m4": F.col("consensus_score") >= 0.5, "m5": F.col("announcements") + 100 * F.col("as_path_avg") > 1000}
    return _numeric(spark, d).withColumns({k: c.cast("int") for k, c in v.items()}).select("row_id", "domain", "w", "discovered_label", *METHODS)


def robust_scale(spark: SparkSession, d: str) -> DataFrame:
    return lb.robust_scale(_numeric(spark, d).select("row_id", *COLUMNS), COLUMNS)


def z_iqr_score(spark: SparkSession, d: str) -> DataFrame:
    return lb.outlier_score(_numeric(spark, d), COLUMNS).select("row_id", "z_iqr_score")


def mad_threshold(spark: SparkSession, d: str) -> DataFrame:
    return lb.mad_threshold(_numeric(spark, d), "announcements")


def consensus_weights(spark: SparkSession, d: str) -> DataFrame:
    return lb.vote_weights(_votes(spark, d), METHODS)


def consensus_labels(spark: SparkSession, d: str) -> DataFrame:
    return lb.consensus(_votes(spark, d), METHODS).select("row_id", "consensus_score", "label")


def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    """How many labels of each kind remain when a method is left out."""
    votes = _votes(spark, d)
    parts = [lb.consensus(votes, METHODS, m).groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("left_out", F.lit(m)) for m in METHODS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def subsample_stability(spark: SparkSession, d: str) -> DataFrame:
    return lb.subsample_stability(_votes(spark, d), "row_id", METHODS)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    after = lb.consensus(_votes(spark, d), METHODS).select("row_id", F.col("label").alias("after"))
    return labelled(spark, d).select("row_id", F.col("discovered_label").alias("before")).join(after, "row_id")


def label_churn(spark: SparkSession, d: str) -> DataFrame:
    return lb.label_churn(_pairs(spark, d), "before", "after")


def transition_matrix(spark: SparkSession, d: str) -> DataFrame:
    return lb.transition_matrix(_pairs(spark, d), "before", "after")


def effect_size(spark: SparkSession, d: str) -> DataFrame:
    return lb.effect_sizes(_numeric(spark, d), COLUMNS, F.col("binary") == 1)


def visibility(spark: SparkSession, d: str) -> DataFrame:
    """Whether a domain's anomalous windows stand out from its others."""
    return lb.visibility(_numeric(spark, d).filter("binary is not null"), ["domain"], COLUMNS, F.col("binary") == 1)


def periodic_relabel(spark: SparkSession, d: str) -> DataFrame:
    return lb.corroborated(_numeric(spark, d), COLUMNS, "discovered_label", "announcements").select("row_id", F.col("n_outside").cast("bigint").alias("n_outside"), "relabelled")


def daily_label_stats(spark: SparkSession, d: str) -> DataFrame:
    """Windows, mean score and anomaly rate by day; suspicious above 0.3."""
    rows = labelled(spark, d).groupBy("domain", F.date_format("w", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg("consensus_score").alias("mean_score"), F.count_if(F.col("binary") == 1).alias("n_anomalies"))
    return rows.withColumn("rate", F.col("n_anomalies") / F.col("n")).withColumn("suspicious", F.col("rate") > 0.3)


def label_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return lb.crosstab_with_margins(labelled(spark, d).select("domain", "discovered_label"), "domain", "discovered_label")


def label_shares(spark: SparkSession, d: str) -> DataFrame:
    counts = labelled(spark, d).groupBy("discovered_label").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select("discovered_label", "n", (F.col("n") / F.col("_all")).alias("share"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).filter("binary is not null and consensus_score is not null and announcements is not null")
    event = F.nullif(F.translate(F.lower(F.btrim("event_id")), "-", "_"), F.lit(""))
    second = F.least(F.col("announcements") / 1500.0, F.lit(1.0))
    return rows.select("row_id", "domain", "w", F.col("binary").alias("y"), F.col("consensus_score").alias("s1"), second.alias("s2"), event.alias("event"), (F.col("consensus_score") >= 0.5).cast("int").alias("pred"), F.pmod("row_id", F.lit(5)).alias("seed"))


K = ["domain"]


def _metric(f, *args):
    return lambda spark, d: f(_scored(spark, d), K, *args)


def late_fusion(spark: SparkSession, d: str) -> DataFrame:
    return ev.late_fusion(_scored(spark, d), ["s1", "s2"], [0.5, 0.6]).select("row_id", "fused_mean", "fused_or")


def per_event_recall(spark: SparkSession, d: str) -> DataFrame:
    return ev.event_recall(_scored(spark, d), K, "event", "pred")


def detection_rate(spark: SparkSession, d: str) -> DataFrame:
    return ev.detection_rate(ev.event_recall(_scored(spark, d), [*K, "seed"], "event", "pred"), K, "seed")


def seed_summary(spark: SparkSession, d: str) -> DataFrame:
    return ev.seed_summary(ev.confusion(_scored(spark, d), [*K, "seed"], "y", "pred"), K, "macro_f1")


def class_balance(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).withColumn("event", F.nullif(F.translate(F.lower(F.btrim("event_id")), "-", "_"), F.lit("")))
    return ev.class_balance(rows, K, "binary", "event")


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return ev.latency_summary(_scored(spark, d), K, "s2")


def event_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).filter("event is not null").withColumn("view", F.when(F.col("row_id") % 2 == 0, "graph").otherwise("stat"))
    return ev.event_pivot(rows, "event", "view", ["graph", "stat"], "s1")


def balanced_subsample(spark: SparkSession, d: str) -> DataFrame:
    return ev.balanced_subsample(_scored(spark, d).select("row_id", "y", "s1", "s2"), "y", "row_id")


def balanced_counts(spark: SparkSession, d: str) -> DataFrame:
    return balanced_subsample(spark, d).groupBy("y").agg(F.count(F.lit(1)).alias("n"))


def confusion_at_half(spark: SparkSession, d: str) -> DataFrame:
    return ev.confusion(_scored(spark, d), K, "y", "pred")


QUERIES = {
    f.__name__: f
    for f in (
        robust_scale, z_iqr_score, mad_threshold, consensus_weights, consensus_labels, leave_one_out, subsample_stability, label_churn, transition_matrix, effect_size, visibility, periodic_relabel, daily_label_stats,
        label_crosstab, label_shares, late_fusion, per_event_recall, detection_rate, seed_summary, class_balance, latency_percentiles, event_pivot, balanced_subsample, balanced_counts,
    )
} | {
    "confusion_metrics": confusion_at_half,
    "average_precision": _metric(ev.average_precision, "y", "s1"),
    "ece": _metric(ev.calibration_error, "y", "s1"),
    "brier": _metric(ev.brier, "y", "s1"),
    "tau_f1_sweep": _metric(ev.best_threshold, "y", "s1"),
    "tau_prior_quantile": _metric(ev.prior_threshold, "y", "s1"),
    "tau_grid": _metric(ev.grid_sweep, "y", "s1", [round(0.05 + 0.01 * i, 2) for i in range(91)]),
    "wilcoxon_w": lambda spark, d: ev.wilcoxon(_scored(spark, d), K, "s1", "s2").drop("p_value"),
    "wilcoxon_p": _metric(ev.wilcoxon, "s1", "s2"),
}

_N = (
    f"WITH {L_SQL}, n AS MATERIALIZED (SELECT row_id, domain, w, discovered_label, \"binary\", event_id, announcements::DOUBLE AS announcements, as_path_avg, n_nodes::DOUBLE AS n_nodes, consensus_score FROM l "
    "WHERE announcements IS NOT NULL AND as_path_avg IS NOT NULL AND n_nodes IS NOT NULL AND consensus_score IS NOT NULL AND NOT isnan(consensus_score))"
)
_V = (
    _N
    + """, v AS MATERIALIZED (SELECT row_id, domain, discovered_label, (announcements > 500)::INT AS m1, (as_path_avg > 5)::INT AS m2, (n_nodes > 3000)::INT AS m3, (consensus_score >= 0.5)::INT AS m4, (announcements + 100 * as_path_avg > 1000)::INT AS m5 FROM n),
vs AS (SELECT """
    + ", ".join(f"abs(corr(m{a}, m{b})) AS r{a}{b}" for a in range(1, 6) for b in range(1, 6) if a < b)
    + ", "
    + ", ".join(f"stddev_pop(m{a}) AS sd{a}" for a in range(1, 6))
    + """ FROM v),
wr AS MATERIALIZED ("""
    + " UNION ALL ".join(
        f"SELECT 'm{a}' AS method, 1 / (1 + list_avg([x FOR x IN [{', '.join(f'r{min(a, b)}{max(a, b)}' for b in range(1, 6) if b != a)}] IF x IS NOT NULL AND NOT isnan(x)])) AS w FROM vs WHERE sd{a} > 0" for a in range(1, 6)
    )
    + """),
wt AS MATERIALIZED (SELECT method, w / (SELECT sum(w) FROM wr) AS weight FROM wr),
th AS (SELECT min(weight) AS u, list_sum(list_sort(list(weight))[1:greatest(2, ceil((count(*) + 1) / 2)::INT)]) AS li, max(weight) AS mx, count(*) AS n FROM wt),
th2 AS (SELECT u, li, CASE WHEN n <= 2 THEN 1.0 ELSE least(greatest(1 - mx, li), 1.0) END AS hi FROM th),
cs AS MATERIALIZED (SELECT row_id, discovered_label, """
    + " + ".join(f"coalesce((SELECT weight FROM wt WHERE method = 'm{a}'), 0) * m{a}" for a in range(1, 6))
    + """ AS consensus_score FROM v),
cl AS MATERIALIZED (SELECT row_id, discovered_label, consensus_score, CASE WHEN round(consensus_score, 12) >= round(hi, 12) THEN 'highly_anomalous' WHEN round(consensus_score, 12) >= round(li, 12) THEN 'likely_anomalous'
  WHEN round(consensus_score, 12) >= round(u, 12) THEN 'uncertain' ELSE 'likely_normal' END AS label FROM cs, th2)"""
)
_EVENT = "nullif(replace(lower(trim(event_id)), '-', '_'), '')"
_S = f"""WITH {L_SQL}, sc AS MATERIALIZED (SELECT row_id, domain, "binary" AS y, consensus_score AS s1, least(announcements / 1500.0, 1.0) AS s2, {_EVENT} AS event, (consensus_score >= 0.5)::INT AS pred, row_id % 5 AS seed
  FROM l WHERE "binary" IS NOT NULL AND consensus_score IS NOT NULL AND announcements IS NOT NULL)"""


def _cf(keys: str) -> str:
    return f"""cf AS (SELECT {keys}, count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 0 AND pred = 0) AS tn FROM sc GROUP BY ALL),
cm AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision_1, coalesce(tp / nullif(tp + fn, 0), 0) AS recall_1, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_1,
  coalesce(tn / nullif(tn + fn, 0), 0) AS precision_0, coalesce(tn / nullif(tn + fp, 0), 0) AS recall_0, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f1_0 FROM cf)"""


_STATS = ", ".join(f"avg({c}) AS mean_{c}, stddev_pop({c}) AS sd_{c}, quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.5) AS b_{c}, quantile_cont({c}, 0.75) AS c_{c}" for c in COLUMNS)

ORACLE = {
    "robust_scale": _N + f", st AS (SELECT {_STATS} FROM n) SELECT row_id, " + ", ".join(f"({c} - b_{c}) / CASE WHEN c_{c} > a_{c} THEN c_{c} - a_{c} ELSE 1 END AS {c}" for c in COLUMNS) + " FROM n, st",
    "z_iqr_score": _N + f", st AS (SELECT {_STATS} FROM n) SELECT row_id, (" + " + ".join(f"(abs({c} - mean_{c}) / sd_{c} > 3)::INT + ({c} < a_{c} - 1.5 * (c_{c} - a_{c}) OR {c} > c_{c} + 1.5 * (c_{c} - a_{c}))::INT" for c in COLUMNS) + ") / 8 AS z_iqr_score FROM n, st",
    "mad_threshold": _N + ", m AS (SELECT median(announcements) AS m FROM n), k AS (SELECT m AS median, median(abs(announcements - m)) AS mad FROM n, m GROUP BY m) SELECT median, mad, median + 3 * 1.4826 * mad AS threshold FROM k",
    "consensus_weights": _V + " SELECT method, weight FROM wt",
    "consensus_labels": _V + " SELECT row_id, consensus_score, label FROM cl",
    "label_churn": _V + ", p AS (SELECT discovered_label AS a, label AS b FROM cl) SELECT count(*) AS n, avg((a <> b)::INT) AS changed_4, avg(((a IN ('likely_anomalous', 'highly_anomalous')) <> (b IN ('likely_anomalous', 'highly_anomalous')))::INT) AS changed_2 FROM p",
    "transition_matrix": _V + ", k AS (SELECT unnest(['likely_normal', 'uncertain', 'likely_anomalous', 'highly_anomalous']) AS before) SELECT before, " + ", ".join(f"count(*) FILTER (label = '{x}') AS {x}" for x in lb.LABELS) + " FROM k LEFT JOIN cl ON cl.discovered_label = before GROUP BY ALL",
    "effect_size": _N + ", x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, \"binary\" = 1 AS f, {c} AS x FROM n WHERE \"binary\" IS NOT NULL" for c in COLUMNS) + """),
s AS (SELECT feature, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n0, avg(x) FILTER (f) AS m1, avg(x) FILTER (NOT f) AS m0, var_samp(x) FILTER (f) AS v1, var_samp(x) FILTER (NOT f) AS v0 FROM x GROUP BY ALL),
e AS (SELECT feature, n1, n0, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS d FROM s) SELECT *, CASE WHEN d > 0 THEN 'higher' WHEN d < 0 THEN 'lower' ELSE 'equal' END AS direction FROM e""",
    "visibility": _N + ", x AS (" + " UNION ALL ".join(f"SELECT domain, '{c}' AS feature, \"binary\" = 1 AS f, {c} AS x FROM n WHERE \"binary\" IS NOT NULL" for c in COLUMNS) + """),
z AS (SELECT domain, feature, round(abs(avg(x) FILTER (f) - avg(x) FILTER (NOT f)) / stddev_samp(x) FILTER (NOT f), 3) AS z FROM x GROUP BY ALL
  HAVING count(*) FILTER (NOT f) >= 3 AND stddev_samp(x) FILTER (NOT f) >= greatest(abs(avg(x) FILTER (NOT f)) * 1e-4, 1e-6) AND count(*) FILTER (f) > 0),
g AS (SELECT domain, count(*) FILTER (z >= 2) AS n_deviant, avg(z) AS top_mean_z, string_agg(feature || ':' || format('{:.3f}', z), ' ' ORDER BY z DESC, feature) AS top_z FROM z GROUP BY ALL), c AS (SELECT domain, count(*) FILTER ("binary" = 1) AS n_during, count(*) FILTER ("binary" = 0) AS n_padding FROM n WHERE "binary" IS NOT NULL GROUP BY ALL)
SELECT domain, n_during, n_padding, coalesce(n_deviant, 0) AS n_deviant, coalesce(top_mean_z, 0) AS top_mean_z, coalesce(top_z, '') AS top_z, CASE WHEN n_during = 0 THEN 'no_incident' WHEN n_padding < 3 THEN 'no_padding' WHEN n_deviant >= 3 AND top_mean_z >= 0.5 THEN 'visible'
  WHEN n_deviant >= 1 AND top_mean_z >= 0.5 THEN 'marginal' ELSE 'invisible' END AS verdict FROM c LEFT JOIN g USING (domain)""",
    "periodic_relabel": _N + ", bd AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in COLUMNS) + ", max(announcements) AS most FROM n WHERE discovered_label = 'likely_normal'), o AS (SELECT n.*, most, (" + " + ".join(f"({c} < lo_{c} OR {c} > hi_{c})::INT" for c in COLUMNS if c != "announcements") + """)::BIGINT AS n_outside FROM n, bd)
SELECT row_id, n_outside, CASE WHEN discovered_label IN ('likely_anomalous', 'highly_anomalous') AND n_outside < 2 AND NOT coalesce(announcements > 5 * most, false) THEN 'likely_normal' ELSE discovered_label END AS relabelled FROM o""",
    "daily_label_stats": f"""WITH {L_SQL}, k AS (SELECT domain, strftime(w, '%Y-%m-%d') AS day, count(*) AS n, avg(consensus_score) AS mean_score, count(*) FILTER ("binary" = 1) AS n_anomalies FROM l GROUP BY ALL) SELECT *, n_anomalies / n AS rate, n_anomalies / n > 0.3 AS suspicious FROM k""",
    "label_crosstab": f"""WITH {L_SQL}, k AS (SELECT CASE WHEN grouping(domain) = 1 THEN 'All' ELSE domain END AS domain, CASE WHEN grouping(discovered_label) = 1 THEN 'All' ELSE discovered_label END AS discovered_label, count(*) AS n FROM l GROUP BY CUBE (domain, discovered_label))
SELECT *, n / max(n) FILTER (discovered_label = 'All') OVER (PARTITION BY domain) AS share FROM k""",
    "label_shares": f"WITH {L_SQL} SELECT discovered_label, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM l GROUP BY ALL",
    "late_fusion": _S + " SELECT row_id, (s1 + s2) / 2 AS fused_mean, (s1 >= 0.5 OR s2 >= 0.6)::INT AS fused_or FROM sc",
    "per_event_recall": _S + " SELECT domain, event, count(*) AS n_windows, count(*) FILTER (pred = 1) AS n_hits, count(*) FILTER (pred = 1) / count(*) AS recall, count(*) FILTER (pred = 1) > 0 AS detected FROM sc WHERE event IS NOT NULL GROUP BY ALL",
    "detection_rate": _S + """, e AS (SELECT domain, seed, event, bool_or(pred = 1)::INT AS d FROM sc WHERE event IS NOT NULL GROUP BY ALL), k AS (SELECT domain, seed, avg(d) AS r FROM e GROUP BY ALL)
SELECT domain, avg(r) AS detection_mean, stddev_samp(r) AS detection_std, count(*) AS n_seeds FROM k GROUP BY ALL""",
    "seed_summary": _S + f", {_cf('domain, seed')} SELECT domain, avg((f1_1 + f1_0) / 2) AS macro_f1_mean, stddev_samp((f1_1 + f1_0) / 2) AS macro_f1_std, count(*) AS n FROM cm GROUP BY ALL",
    "class_balance": f"""WITH {L_SQL}, z AS (SELECT domain, {_EVENT} AS event, count(*) AS n FROM l WHERE {_EVENT} IS NOT NULL GROUP BY ALL), e AS (SELECT domain, count(*) AS n_events, min(n) AS min_event, max(n) AS max_event, avg(n) AS mean_event FROM z GROUP BY ALL),
c AS (SELECT domain, count(*) AS n_rows, count(*) FILTER ("binary" = 1) AS n_pos, count(*) FILTER ("binary" = 0) AS n_neg, count(*) FILTER ("binary" IS NULL) AS n_uncertain, count(*) FILTER ("binary" = 0) / nullif(count(*) FILTER ("binary" = 1), 0) AS scale_pos_weight FROM l GROUP BY ALL)
SELECT * FROM c LEFT JOIN e USING (domain)""",
    "latency_percentiles": _S + " SELECT domain, median(s2) AS median, quantile_cont(s2, 0.95) AS p95, count(s2) AS n FROM sc GROUP BY ALL",
    "event_pivot": _S + " SELECT event, avg(s1) FILTER (row_id % 2 = 0) AS graph, avg(s1) FILTER (row_id % 2 <> 0) AS stat FROM sc WHERE event IS NOT NULL GROUP BY ALL",
    "balanced_counts": _S + ", k AS (SELECT count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b FROM sc) SELECT unnest([0, 1]) AS y, least(a, b) AS n FROM k",
    "confusion_metrics": _S + f", {_cf('domain')} SELECT *, (f1_1 + f1_0) / 2 AS macro_f1, (recall_1 + recall_0) / 2 AS balanced_accuracy FROM cm",
    "average_precision": _S + """, g AS (SELECT domain, s1, sum(y) AS p, count(*) AS n FROM sc GROUP BY ALL), c AS (SELECT domain, p, sum(p) OVER k AS tp, sum(n) OVER k AS at_, sum(p) OVER (PARTITION BY domain) AS pos FROM g WINDOW k AS (PARTITION BY domain ORDER BY s1 DESC))
SELECT domain, sum(p / pos * tp / at_) AS average_precision FROM c GROUP BY ALL""",
    "ece": _S + ", b AS (SELECT domain, least(floor(s1 * 15), 14) AS b, count(*) AS n, avg(y) AS y, avg(s1) AS s FROM sc GROUP BY ALL) SELECT domain, sum(n * abs(y - s)) / sum(n) AS ece FROM b GROUP BY ALL",
    "brier": _S + " SELECT domain, avg((s1 - y) * (s1 - y)) AS brier FROM sc GROUP BY ALL",
    "tau_f1_sweep": _S + """, t AS (SELECT DISTINCT domain, s1 AS t FROM sc UNION SELECT DISTINCT domain, 0.0 FROM sc UNION SELECT DISTINCT domain, 1.0 FROM sc),
g AS (SELECT sc.domain, t, count(*) FILTER (y = 1 AND s1 >= t) AS tp, count(*) FILTER (y = 0 AND s1 >= t) AS fp, count(*) FILTER (y = 1 AND s1 < t) AS fn, count(*) FILTER (y = 0 AND s1 < t) AS tn FROM t JOIN sc ON sc.domain = t.domain GROUP BY ALL),
f AS (SELECT domain, t, round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 12) AS f FROM g) SELECT domain, arg_max(t, (f, -t)) AS tau, max(f) AS macro_f1 FROM f GROUP BY ALL""",
    "tau_prior_quantile": _S + ", p AS (SELECT domain, least(greatest(avg(y), 0.01), 0.5) AS prior, list_sort(list(s1)) AS s FROM sc GROUP BY ALL), q AS (SELECT domain, prior, s, (len(s) - 1) * (1 - prior) AS at_ FROM p) SELECT domain, prior, least(greatest(s[floor(at_)::INT + 1] + (at_ - floor(at_)) * (s[ceil(at_)::INT + 1] - s[floor(at_)::INT + 1]), 0.1), 0.9) AS tau FROM q",
    "wilcoxon_w": _S + """, p AS (SELECT domain, round(s1 - s2, 12) AS d FROM sc), r AS (SELECT domain, d, rank() OVER (PARTITION BY domain ORDER BY abs(d)) + (count(*) OVER (PARTITION BY domain, abs(d)) - 1) / 2 AS rk, count(*) OVER (PARTITION BY domain, abs(d)) AS t FROM p WHERE d <> 0),
w AS (SELECT domain, sum(rk) FILTER (d > 0) AS w_plus, coalesce(sum(rk) FILTER (d < 0), 0) AS w_minus, count(*) AS n FROM r GROUP BY ALL), a AS (SELECT domain, count(*) AS n_pairs, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d = 0) AS ties, median(d) AS median_diff FROM p GROUP BY ALL)
SELECT domain, n_pairs, wins, ties, median_diff, w_plus, w_minus, n AS n_used, least(w_plus, w_minus) AS w FROM a JOIN w USING (domain)""",
    "wilcoxon_p": _S + """, p AS (SELECT domain, round(s1 - s2, 12) AS d FROM sc), r AS (SELECT domain, d, rank() OVER (PARTITION BY domain ORDER BY abs(d)) + (count(*) OVER (PARTITION BY domain, abs(d)) - 1) / 2 AS rk, count(*) OVER (PARTITION BY domain, abs(d)) AS t FROM p WHERE d <> 0),
w AS (SELECT domain, sum(rk) FILTER (d > 0) AS w_plus, coalesce(sum(rk) FILTER (d < 0), 0) AS w_minus, count(*) AS n FROM r GROUP BY ALL), a AS (SELECT domain, count(*) AS n_pairs, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d = 0) AS ties, median(d) AS median_diff FROM p GROUP BY ALL)
, tt AS (SELECT domain, sum(t * t * t - t) AS t FROM (SELECT DISTINCT domain, abs(d), t FROM r) GROUP BY ALL),
z AS (SELECT domain, (least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tt.t / 48) AS z FROM w JOIN tt USING (domain)),
q AS (SELECT domain, z, 1 / (1 + 0.2316419 * abs(z)) AS k FROM z),
pv AS (SELECT domain, exp(-z * z / 2) / sqrt(2 * pi()) * (k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))) AS tail, z FROM q)
SELECT domain, n_pairs, wins, ties, median_diff, w_plus, w_minus, n AS n_used, least(w_plus, w_minus) AS w, least(1.0, 2 * CASE WHEN z < 0 THEN tail ELSE 1 - tail END) AS p_value FROM a JOIN w USING (domain) JOIN pv USING (domain)""",
    "tau_grid": _S + """, t AS (SELECT unnest(list_transform(range(91), lambda i: round(0.05 + 0.01 * i, 2))) AS t), g AS (SELECT domain, t, count(*) FILTER (y = 1 AND s1 >= t) AS tp, count(*) FILTER (y = 0 AND s1 >= t) AS fp, count(*) FILTER (y = 1 AND s1 < t) AS fn FROM sc, t GROUP BY ALL),
f AS (SELECT domain, t, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 12) AS f FROM g) SELECT domain, arg_max(t, (f, -t)) AS tau, max(f) AS f1 FROM f GROUP BY ALL""",
}
