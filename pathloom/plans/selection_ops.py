"""Queries of filters, summaries, joins of metadata and top-k reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators import redundancy as rd
from pathloom.operators import selection as sel
from pathloom.plans import label_ops as lo
from pathloom.plans import model_ops as mo
from pathloom.plans.graph_ops import KEYS, snapshot_edges
from pathloom.plans.series_ops import L_SQL, W_SQL, event_manifest, features, labelled
from pathloom.session import table

EVENT_SQL = "nullif(replace(lower(trim(event_id)), '-', '_'), '')"


def _label_filter(mode: str, labels: tuple = ()):
    return lambda spark, d: sel.label_filter(labelled(spark, d).select("row_id", "domain", "discovered_label"), "discovered_label", mode, labels)


def _provenance(mode: str):
    return lambda spark, d: sel.provenance_filter(labelled(spark, d).select("row_id", "provenance"), "provenance", mode)


def numeric_features(spark: SparkSession, d: str) -> DataFrame:
    names = sel.numeric_columns(table(spark, d, "window_features"), ["Feature_ID", "ASN", "segment"])
    return spark.createDataFrame([(i, c) for i, c in enumerate(names)], "position bigint, feature string")


def reordered_features(spark: SparkSession, d: str) -> DataFrame:
    rows = sel.ordered_columns(table(spark, d, "window_features"), ["window_start", "window_id", "collector", "asn"])
    return spark.createDataFrame([(i, c) for i, c in enumerate(rows.columns)], "position bigint, feature string")


def shared_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of the window features that the labelled windows have too, in order."""
    names = sel.ordered_intersection([table(spark, d, t).columns for t in ("window_features", "labelled_windows")])
    return spark.createDataFrame([(i, c) for i, c in enumerate(names)], "position bigint, feature string")


def covered_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes in three quarters of their pair's snapshots, with the number of these."""
    nodes = snapshot_edges(spark, d).select(*KEYS, F.explode(F.array("u", "v")).alias("asn")).distinct()
    return sel.covered_items(nodes, ["pair"], "asn", "stamp").groupBy("pair", "asn").agg(F.count(F.lit(1)).alias("n_snapshots"))


def feature_domains(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of features with the domains they come from and the metadata (mean, spread) of both."""
    pairs = mo.pearson_pairs(spark, d).withColumn("pair_domain", sel.pair_domain(F.col("feature_a"), F.col("feature_b")))
    meta = sel.described(mo._matrix(spark, d), mo.FEATURES).select("feature", "mean", "std", sel.feature_domain(F.col("feature")).alias("domain"))
    return sel.pair_metadata(pairs, meta)


def log_weights(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_edges(spark, d).select(*KEYS, "u", "v", sel.log_weight(F.col("weight")).alias("log_weight"))


def event_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Events of a domain beside the 8-hour snapshots whose time they overlap."""
    index = table(spark, d, "snapshots_index").select(F.lower("pair").alias("domain"), "stamp", F.to_timestamp("stamp", "yyyyMMdd_HHmm").alias("begin")).distinct()
    index = index.withColumn("finish", F.col("begin") + F.expr("interval 8 hours"))
    events = event_manifest(spark, d).select("domain", "event_id", "start_time", "end_time")
    return sel.overlapping(events, index, ["domain"], "start_time", "end_time", "begin", "finish").select("domain", "event_id", F.col("other_stamp").alias("stamp"))


def graph_with_index(spark: SparkSession, d: str) -> DataFrame:
    """Size of each snapshot beside what the index says of it (`_graph`)."""
    from pathloom.operators import graph as g

    own = g.size_density(snapshot_edges(spark, d), KEYS).select(*KEYS, "n_nodes", "n_edges", "density")
    index = table(spark, d, "snapshots_index").select(*KEYS, "n_nodes", "n_edges", "n_self_loops").distinct()
    return sel.joined_with_suffix(own, index, KEYS)


def feature_summary(spark: SparkSession, d: str) -> DataFrame:
    return sel.described(features(spark, d), mo.FEATURES)


def scenario_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean scores by incident type and provenance."""
    rows = labelled(spark, d).withColumn("incident_type", F.coalesce("incident_type", F.lit("none"))).withColumn("provenance", F.coalesce("provenance", F.lit("none")))
    return sel.group_means(rows, ["incident_type", "provenance"], ["consensus_score", "announcements"])


def feature_mentions(spark: SparkSession, d: str) -> DataFrame:
    """How often each feature is named in a strong pair, by method."""
    strong = lambda df, m: df.filter(F.abs("r") >= 0.5).select(F.lit(m).alias("method"), F.explode(F.array("feature_a", "feature_b")).alias("feature"))
    both = strong(mo.pearson_pairs(spark, d), "pearson").union(strong(mo.spearman_pairs(spark, d), "spearman"))
    return sel.mention_table(both, "feature", "method", ["pearson", "spearman"])


def score_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Whether the domains' mean scores of a label agree."""
    rows = labelled(spark, d).filter("consensus_score is not null").groupBy("discovered_label", "domain").agg(F.avg("consensus_score").alias("score"))
    return sel.batch_verdict(rows, ["discovered_label"], "score", F.col("score") < 0.9)


def peak_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).filter("announcements is not null").select("row_id", "domain", "announcements")
    return sel.top_rows(rows, [F.desc("announcements"), F.col("row_id")], 10)


def least_certain_windows(spark: SparkSession, d: str) -> DataFrame:
    """The ten windows nearest to the border between the two classes: by distance, then by the score."""
    rows = labelled(spark, d).filter("consensus_score is not null").select("row_id", F.round(F.abs(F.col("consensus_score") - 0.5), 9).alias("distance"), "consensus_score")
    return sel.top_rows(rows, [F.col("distance"), F.col("consensus_score"), F.col("row_id")], 10)


def event_peaks(spark: SparkSession, d: str) -> DataFrame:
    """The three windows of highest score of each event."""
    event = F.nullif(F.translate(F.lower(F.btrim("event_id")), "-", "_"), F.lit(""))
    rows = labelled(spark, d).withColumn("event", event).filter("event is not null and consensus_score is not null").select("event", "row_id", "consensus_score")
    out = sel.top_of_groups(rows, ["event"], [F.desc("consensus_score"), F.col("row_id")], 3)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


def deviant_features(spark: SparkSession, d: str) -> DataFrame:
    """The highest z of each domain's features between anomalous and other windows."""
    from pathloom.operators.labelling import deviations

    z = deviations(lo._numeric(spark, d).filter("binary is not null"), ["domain"], lo.COLUMNS, F.col("binary") == 1)
    out = sel.top_of_groups(z.select("domain", "feature", "z"), ["domain"], [F.desc("z"), F.col("feature")], 10)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


def balanced_windows(spark: SparkSession, d: str) -> DataFrame:
    """Twenty windows of highest score, as evenly from all domains as can be."""
    rows = labelled(spark, d).filter("consensus_score is not null").select("row_id", "domain", "consensus_score")
    names = [r.domain for r in rows.select("domain").distinct().collect()]  # a row a domain
    return sel.balanced_top(rows, "domain", [F.desc("consensus_score"), F.col("row_id")], 20, names)


def best_label_by_domain(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).filter("announcements is not null and discovered_label is not null")
    return sel.best_of_groups(rows, ["domain"], "discovered_label", "announcements")


def readable_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).select("row_id", "announcements", "as_path_avg", "n_nodes")
    return sel.renamed(rows, {"as_path_avg": "mean_path_length", "n_nodes": "graph_nodes"}, ["announcements"])


def label_comparison(spark: SparkSession, d: str) -> DataFrame:
    return sel.label_comparison(lo._pairs(spark, d), "before", "after")


def pearson_pvalues(spark: SparkSession, d: str) -> DataFrame:
    return rd.with_p_values(rd.pearson_pairs(mo._matrix(spark, d), mo.FEATURES)).select("feature_a", "feature_b", "r", "n", "p_value")


def spearman_pvalues(spark: SparkSession, d: str) -> DataFrame:
    return rd.with_p_values(rd.spearman_pairs(mo._matrix(spark, d), mo.FEATURES)).select("feature_a", "feature_b", "r", "n", "p_value")


QUERIES = {
    "label_filter_anomalies": _label_filter("anomalies"),
    "label_filter_non_normal": _label_filter("non_normal"),
    "label_filter_specific": _label_filter("specific", ("uncertain",)),
    "provenance_study": _provenance("study"),
    "provenance_both": _provenance("both"),
} | {
    f.__name__: f
    for f in (
        numeric_features, reordered_features, shared_columns, covered_nodes, feature_domains, log_weights, event_overlaps, graph_with_index, feature_summary, scenario_means, feature_mentions, score_verdict,
        peak_windows, least_certain_windows, event_peaks, deviant_features, balanced_windows, best_label_by_domain, readable_windows, label_comparison, pearson_pvalues, spearman_pvalues,
    )
}

_E = "e AS MATERIALIZED (SELECT pair, stamp, least(source, target) AS u, greatest(source, target) AS v, max(weight)::BIGINT AS weight FROM edges WHERE source <> target GROUP BY ALL)"
_DOMAIN = lambda c: f"CASE WHEN {c} IN ({', '.join(map(repr, sel.GRAPH_MEASURES))}) THEN 'graph' WHEN {c} IN ({', '.join(map(repr, sel.STAT_MEASURES))}) THEN 'statistical' ELSE 'other' END"
_SUM = lambda source, cast="": " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS min, quantile_cont({c}::DOUBLE, 0.25) AS q25, quantile_cont({c}::DOUBLE, 0.5) AS median, quantile_cont({c}::DOUBLE, 0.75) AS q75, max({c})::DOUBLE AS max FROM {source}"
    for c in mo.FEATURES
)
_SESSIONS = f"""WITH {L_SQL}, a AS (SELECT domain, w, lag(w) OVER (PARTITION BY domain ORDER BY w) AS p FROM (SELECT DISTINCT domain, w FROM l WHERE "binary" = 1))"""

ORACLE = {
    "label_filter_anomalies": f"WITH {L_SQL} SELECT row_id, domain, discovered_label FROM l WHERE discovered_label IN ('likely_anomalous', 'highly_anomalous')",
    "label_filter_non_normal": f"WITH {L_SQL} SELECT row_id, domain, discovered_label FROM l WHERE discovered_label <> 'likely_normal'",
    "label_filter_specific": f"WITH {L_SQL} SELECT row_id, domain, discovered_label FROM l WHERE discovered_label = 'uncertain'",
    "provenance_study": f"WITH {L_SQL} SELECT row_id, provenance FROM l WHERE lower(trim(provenance)) = 'study'",
    "provenance_both": f"WITH {L_SQL} SELECT row_id, provenance FROM l WHERE lower(trim(provenance)) IN ('study', 'historical')",
    "numeric_features": "SELECT row_number() OVER (ORDER BY column_index) - 1 AS position, column_name AS feature FROM duckdb_columns() WHERE table_name = 'window_features' AND data_type IN ('INTEGER', 'BIGINT', 'DOUBLE') AND lower(column_name) NOT IN ('feature_id', 'asn', 'segment')",
    "shared_columns": "SELECT row_number() OVER (ORDER BY a.column_index) - 1 AS position, a.column_name AS feature FROM duckdb_columns() a JOIN duckdb_columns() b USING (column_name) WHERE a.table_name = 'window_features' AND b.table_name = 'labelled_windows'",
    "covered_nodes": f"""WITH {_E}, n AS (SELECT DISTINCT pair, stamp, unnest([u, v]) AS asn FROM e), k AS (SELECT pair, greatest(1, floor(count(DISTINCT stamp) * 0.75)) AS least_ FROM n GROUP BY ALL)
SELECT n.pair, asn, count(*) AS n_snapshots FROM n JOIN k USING (pair) GROUP BY n.pair, asn, least_ HAVING count(*) >= least_""",
    "feature_domains": f"""{mo._M}, p AS ({mo._CORR}), s AS ({_SUM('m')}), t AS (SELECT feature, mean, std, {_DOMAIN('feature')} AS domain FROM s)
SELECT p.feature_a, p.feature_b, p.r, array_to_string(list_sort([a.domain, b.domain]), '-') AS pair_domain, a.mean AS mean_a, a.std AS std_a, a.domain AS domain_a, b.mean AS mean_b, b.std AS std_b, b.domain AS domain_b
FROM p LEFT JOIN t a ON a.feature = feature_a LEFT JOIN t b ON b.feature = feature_b""",
    "log_weights": f"WITH {_E} SELECT pair, stamp, u, v, ln(1 + greatest(coalesce(weight, 0), 0)) AS log_weight FROM e",
    "event_overlaps": _SESSIONS
    + """, s AS (SELECT domain, w, sum((p IS NULL OR epoch_us(w) - epoch_us(p) > 7200000000)::INT) OVER (PARTITION BY domain ORDER BY w) AS n FROM a), x AS (SELECT domain, n, min(w) AS a, max(w) AS b FROM s GROUP BY ALL),
ix AS (SELECT DISTINCT lower(pair) AS domain, stamp, strptime(stamp, '%Y%m%d_%H%M') AS begin_ FROM snapshots_index)
SELECT x.domain, x.domain || '_evt_' || lpad(n::VARCHAR, 3, '0') AS event_id, stamp FROM x JOIN ix ON x.domain = ix.domain AND x.a < ix.begin_ + INTERVAL 8 hours AND x.b > ix.begin_""",
    "graph_with_index": f"""WITH {_E}, n AS (SELECT pair, stamp, count(DISTINCT asn) AS n_nodes FROM (SELECT pair, stamp, unnest([u, v]) AS asn FROM e) GROUP BY ALL), m AS (SELECT pair, stamp, count(*) AS n_edges FROM e GROUP BY ALL),
ix AS (SELECT DISTINCT pair, stamp, n_nodes AS n_nodes_graph, n_edges AS n_edges_graph, n_self_loops FROM snapshots_index)
SELECT pair, stamp, n.n_nodes, m.n_edges, 2 * m.n_edges / (n.n_nodes * (n.n_nodes - 1)) AS density, n_nodes_graph, n_edges_graph, n_self_loops FROM n JOIN m USING (pair, stamp) LEFT JOIN ix USING (pair, stamp)""",
    "feature_summary": f"WITH {W_SQL} {_SUM('f')}",
    "scenario_means": f"WITH {L_SQL} SELECT coalesce(incident_type, 'none') AS incident_type, coalesce(provenance, 'none') AS provenance, count(*) AS n, avg(consensus_score) AS mean_consensus_score, avg(announcements) AS mean_announcements FROM l GROUP BY ALL",
    "feature_mentions": f"""{mo._M}, {mo._RANK}, p AS (SELECT 'pearson' AS method, * FROM ({mo._CORR}) UNION ALL SELECT 'spearman', * FROM ({mo._CORR.replace('FROM m', 'FROM rk')})), t AS (SELECT method, unnest([feature_a, feature_b]) AS feature FROM p WHERE abs(r) >= 0.5)
SELECT feature, count(*) FILTER (method = 'pearson') AS pearson, count(*) FILTER (method = 'spearman') AS spearman FROM t GROUP BY ALL""",
    "score_verdict": f"""WITH {L_SQL}, k AS (SELECT discovered_label, domain, avg(consensus_score) AS s FROM l WHERE consensus_score IS NOT NULL GROUP BY ALL),
v AS (SELECT discovered_label, count(*) AS n_sets, min(s) AS least, max(s) AS greatest, bool_and(s < 0.9) AS all_ok, count(*) FILTER (s < 0.9) AS n_ok FROM k GROUP BY ALL)
SELECT *, CASE WHEN all_ok AND greatest - least <= 0.1 THEN 'consistent' WHEN all_ok THEN 'varying' WHEN n_ok > 0 THEN 'mixed' ELSE 'failing' END AS verdict FROM v""",
    "peak_windows": f"WITH {L_SQL} SELECT row_id, domain, announcements FROM l WHERE announcements IS NOT NULL ORDER BY announcements DESC, row_id LIMIT 10",
    "least_certain_windows": f"WITH {L_SQL} SELECT row_id, round(abs(consensus_score - 0.5), 9) AS distance, consensus_score FROM l WHERE consensus_score IS NOT NULL ORDER BY distance, consensus_score, row_id LIMIT 10",
    "event_peaks": f"WITH {L_SQL} SELECT {EVENT_SQL} AS event, row_id, consensus_score, row_number() OVER (PARTITION BY {EVENT_SQL} ORDER BY consensus_score DESC, row_id) AS rank FROM l WHERE {EVENT_SQL} IS NOT NULL AND consensus_score IS NOT NULL QUALIFY rank <= 3",
    "deviant_features": lo._N + ", x AS (" + " UNION ALL ".join(f"SELECT domain, '{c}' AS feature, \"binary\" = 1 AS f, {c} AS x FROM n WHERE \"binary\" IS NOT NULL" for c in lo.COLUMNS) + """),
z AS (SELECT domain, feature, round(abs(avg(x) FILTER (f) - avg(x) FILTER (NOT f)) / stddev_samp(x) FILTER (NOT f), 3) AS z FROM x GROUP BY ALL
  HAVING count(*) FILTER (NOT f) >= 3 AND stddev_samp(x) FILTER (NOT f) >= greatest(abs(avg(x) FILTER (NOT f)) * 1e-4, 1e-6) AND count(*) FILTER (f) > 0)
SELECT domain, feature, z, row_number() OVER (PARTITION BY domain ORDER BY z DESC, feature) AS rank FROM z QUALIFY rank <= 10""",
    "balanced_windows": f"""WITH {L_SQL}, k AS (SELECT row_id, domain, consensus_score, row_number() OVER (PARTITION BY domain ORDER BY consensus_score DESC, row_id) AS r FROM l WHERE consensus_score IS NOT NULL)
SELECT row_id, domain, consensus_score FROM k WHERE r <= 20 ORDER BY (r > (SELECT greatest(1, 20 // count(DISTINCT domain)) FROM k))::INT, consensus_score DESC, row_id LIMIT 20""",
    "best_label_by_domain": f"""WITH {L_SQL}, k AS (SELECT domain, discovered_label, avg(announcements) AS m FROM l WHERE announcements IS NOT NULL AND discovered_label IS NOT NULL GROUP BY ALL)
SELECT domain, arg_min(discovered_label, (-round(m, 12), discovered_label)) AS discovered_label, max(m) AS mean FROM k GROUP BY ALL""",
    "readable_windows": f"WITH {L_SQL} SELECT row_id, as_path_avg AS mean_path_length, n_nodes AS graph_nodes FROM l",
    "label_comparison": lo._V + """, k AS (SELECT discovered_label AS before, label AS after, count(*) AS n FROM cl GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY before) AS share FROM k)
SELECT *, CASE WHEN before IS NOT DISTINCT FROM after THEN 'keep' WHEN share >= 0.5 THEN 'relabel' ELSE 'review' END AS advice FROM s""",
}
