"""Queries over labelled windows and window features: sessions, rolling statistics, joins in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.functions.stats import correlation
from pathloom.operators import joins as j
from pathloom.operators import ordered as o
from pathloom.operators.grid import floor_time
from pathloom.session import table

MEASURES = ["announcements", "as_path_avg", "n_nodes", "consensus_score"]


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Labelled windows, copies once, with the window's start `w` (from window_id where the time is missing)."""
    rows = table(spark, d, "labelled_windows").distinct()
    w = F.coalesce(floor_time(F.col("window_start").cast("timestamp"), 300), F.try_to_timestamp("window_id", F.lit("yyyyMMdd_HHmm")))
    return rows.withColumns({"w": w, "domain": F.lower(F.btrim("domain")), "as_path_avg": F.nanvl("as_path_avg", F.lit(None)), "binary": F.col("binary_label").cast("bigint")}).filter("w is not null")


def features(spark: SparkSession, d: str) -> DataFrame:
    """Window features, copies once; series is (collector, asn)."""
    rows = table(spark, d, "window_features").distinct()
    w = floor_time(F.col("window_start").cast("timestamp"), 300)
    return rows.withColumns({"collector": F.lower(F.btrim("collector")), "w": w, "ts": F.col("window_start").cast("timestamp"), "as_path_avg": F.nanvl("as_path_avg", F.lit(None))})


def _anomalies(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).filter("binary = 1")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return o.sessions(_anomalies(spark, d).select("row_id", "domain", "w", "discovered_label"), ["domain"], "w", 120, "domain")


def event_manifest(spark: SparkSession, d: str) -> DataFrame:
    return o.event_manifest(event_sessions(spark, d), ["domain"], "w", "discovered_label")


def event_interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Every labelled window with the event of its domain that it lies in."""
    rows = labelled(spark, d).select("row_id", "domain", "w")
    return j.interval_join(rows, event_manifest(spark, d), ["domain"], "w", "start_time", "end_time", "event_id", "event_id")


def nearest_window_join(spark: SparkSession, d: str) -> DataFrame:
    """Every labelled window with the reading of its collector nearest in time, at most 600 s away."""
    left = labelled(spark, d).select("row_id", F.lower(F.btrim("collector")).alias("collector"), "w")
    right = features(spark, d).filter("ts is not null").select("collector", "ts", "feature_id").withColumnRenamed("ts", "w")
    return j.nearest_join(left, right, ["collector"], "w", ["feature_id"], 600, "feature_id")


def floor_snapshot_join(spark: SparkSession, d: str) -> DataFrame:
    """Every labelled window with its 8-hour snapshot, where one was delivered, and the pair's last snapshot."""
    stamp = F.date_format(floor_time(F.col("w"), 28_800), "yyyyMMdd_HHmm")
    index = table(spark, d, "snapshots_index").select(F.lower("pair").alias("domain"), "stamp", "n_nodes", "n_edges").distinct()
    last = index.groupBy("domain").agg(F.max("stamp").alias("last_stamp"))
    rows = labelled(spark, d).select("row_id", "domain", stamp.alias("stamp"))
    return rows.join(index, ["domain", "stamp"], "left").join(last, "domain", "left")


def rolling_features(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).select("row_id", "domain", "w", F.col("announcements").cast("double").alias("x"))
    return o.rolling(rows, ["domain"], "w", ["row_id"], "x").select("row_id", "rolling_median", "trailing_mean")


def trailing_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of ten windows, as text of their announcements."""
    rows = labelled(spark, d).select("row_id", "domain", "w", "announcements")
    out = o.trailing_sequences(rows, ["domain"], "w", ["row_id"], ["announcements"], 10)
    text = F.array_join(F.transform("sequence", lambda x: F.when(F.isnan(x[0]), F.lit("-")).otherwise(x[0].cast("bigint").cast("string"))), " ")
    return out.select("row_id", text.alias("sequence"))


def tail_split(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).filter("binary is not null").select("row_id", "w", "binary")
    return o.tail_split(rows, ["w", "row_id"], "binary").select("row_id", F.col("row_no").cast("bigint").alias("row_no"), "is_validation")


def acf_lags(spark: SparkSession, d: str) -> DataFrame:
    """Autocorrelation of the series of five-minute windows (mean of a window's readings), at lags of 4 to 300 windows."""
    rows = features(spark, d).filter("w is not null and total_updates is not null").groupBy("collector", "asn", "w").agg(F.avg("total_updates").alias("x"))
    return o.autocorrelation(rows, ["collector", "asn"], "w", "x", range(4, 301))


def dominant_period(spark: SparkSession, d: str) -> DataFrame:
    """The period in five-minute windows, from 5 (25 minutes) to 299, past a day's 288."""
    return o.dominant_period(acf_lags(spark, d), ["collector", "asn"])


def spike_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between the anomalous windows of a domain, in windows, against a period of an hour."""
    rows = _anomalies(spark, d).select("domain", F.floor(F.unix_micros("w") / 300_000_000).alias("p")).distinct()
    return o.spike_intervals(rows, ["domain"], "p", 12)


def largest_gap(spark: SparkSession, d: str) -> DataFrame:
    return o.largest_gap(labelled(spark, d), ["domain"], "consensus_score")


def sign_flips(spark: SparkSession, d: str) -> DataFrame:
    """Sign changes of the daily correlation of announcements and path lengths."""
    daily = labelled(spark, d).groupBy("domain", F.to_date("w").alias("day")).agg(F.round(correlation(F.col("announcements"), F.col("as_path_avg")), 9).alias("r"))
    return o.sign_flips(daily.filter("r is not null and not isnan(r)"), ["domain"], ["day"], "r")


def slot_profile(spark: SparkSession, d: str) -> DataFrame:
    return o.slot_profile(labelled(spark, d).select("domain", "w", F.col("announcements").cast("double").alias("x")), ["domain"], "w", "x")


def fourier_template(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).select("row_id", "domain", "w", "discovered_label", F.col("announcements").cast("double").alias("x"))
    return o.fourier_template(rows, ["domain"], "w", "x", F.col("discovered_label") == "likely_normal").select("row_id", "template", "residual_z")


def sampling_interval(spark: SparkSession, d: str) -> DataFrame:
    """Median seconds between a series' windows."""
    w = Window.partitionBy("collector", "asn").orderBy("w")
    rows = features(spark, d).filter("w is not null").select("collector", "asn", "w").distinct()
    gaps = rows.withColumn("gap", (F.unix_micros("w") - F.unix_micros(F.lag("w").over(w))) / 1e6)
    return gaps.groupBy("collector", "asn").agg(F.median("gap").alias("median_s"))


def label_override(spark: SparkSession, d: str) -> DataFrame:
    """Labels of one domain taken over by another for the same window."""
    rows = labelled(spark, d)
    names = rows.select("domain").distinct()
    first = names.agg(F.min("domain").alias("_d"))  # one row
    given = rows.join(F.broadcast(first), F.col("domain") == F.col("_d")).select("w", "row_id", "discovered_label")
    given = j.keep_last(given, ["w"], [F.col("row_id")]).select("w", "discovered_label")
    return j.label_override(rows.select("row_id", "domain", "w", "discovered_label"), given, ["w"], "discovered_label")


def upsert_keep_last(spark: SparkSession, d: str) -> DataFrame:
    """The last of several readings of a window, by time and id."""
    rows = features(spark, d).filter("w is not null").select("collector", "asn", "w", "feature_id", "ts", "total_updates")
    return j.keep_last(rows, ["collector", "asn", "w"], [F.col("ts"), F.col("feature_id")]).select("collector", "asn", "w", "feature_id", "total_updates")


def replace_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Index rows replaced by those made anew from the edges."""
    from pathloom.plans.graph_ops import snapshot_stats

    old = table(spark, d, "snapshots_index").select("pair", "stamp", "n_edges", F.lit("old").alias("origin"))
    new = snapshot_stats(spark, d).filter(F.col("stamp").endswith("0000")).select("pair", "stamp", "n_edges", F.lit("new").alias("origin"))
    return j.replace_by_key(old, new, ["pair", "stamp"])


def domain_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Ordered pairs of domains with their scenario."""
    pairs = j.ordered_pairs(labelled(spark, d), "domain")
    collector = lambda c: F.regexp_extract(c, "^([^_]*)", 1)
    asn = lambda c: F.regexp_extract(c, "as([0-9]+)$", 1)
    same_c, same_a = collector("source_domain") == collector("target_domain"), asn("source_domain") == asn("target_domain")
    return pairs.withColumn("scenario", F.when(same_c & same_a, "same_domain").when(same_a, "same_as_diff_collector").when(same_c, "same_collector_diff_as").otherwise("diff_as_diff_collector"))


def temporal_edges(spark: SparkSession, d: str) -> DataFrame:
    return j.temporal_edges(labelled(spark, d), ["domain"], "w", ["row_id"], "row_id", 2)


def mutual_knn(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    return j.mutual_nearest(rows, "vec_id", "embedding", "label", 5)


QUERIES = {
    f.__name__: f
    for f in (
        event_sessions, event_manifest, event_interval_join, nearest_window_join, floor_snapshot_join, rolling_features, trailing_sequence, tail_split, acf_lags, dominant_period,
        spike_intervals, largest_gap, sign_flips, slot_profile, fourier_template, sampling_interval, label_override, upsert_keep_last, replace_by_key, domain_pairs, temporal_edges, mutual_knn,
    )
}

L_SQL = """
lw AS MATERIALIZED (SELECT DISTINCT row_id, coalesce(time_bucket(INTERVAL 5 minutes, window_start), try_strptime(window_id, '%Y%m%d_%H%M')) AS w, lower(trim(domain)) AS domain, collector,
  announcements, CASE WHEN isnan(as_path_avg) THEN NULL ELSE as_path_avg END AS as_path_avg, n_nodes, consensus_score, discovered_label, binary_label::BIGINT AS "binary", event_id, provenance, incident_type FROM labelled_windows),
l AS MATERIALIZED (SELECT * FROM lw WHERE w IS NOT NULL)
"""
W_SQL = """
f AS MATERIALIZED (SELECT DISTINCT feature_id, window_start AS ts, time_bucket(INTERVAL 5 minutes, window_start) AS w, lower(trim(collector)) AS collector, asn, announcements, withdrawals, total_updates, ann_rate,
  unique_prefixes_ann, CASE WHEN isnan(as_path_avg) THEN NULL ELSE as_path_avg END AS as_path_avg, unique_peers FROM window_features)
"""
S_SQL = (
    L_SQL
    + """, g AS (SELECT row_id, domain, w, discovered_label, CASE WHEN w - lag(w) OVER (PARTITION BY domain ORDER BY w, row_id) <= INTERVAL 120 minutes THEN 0 ELSE 1 END AS s FROM l WHERE "binary" = 1),
s AS MATERIALIZED (SELECT row_id, domain, w, discovered_label, sum(s) OVER (PARTITION BY domain ORDER BY w RANGE UNBOUNDED PRECEDING)::BIGINT AS event_no FROM g),
ss AS MATERIALIZED (SELECT *, domain || '_evt_' || CASE WHEN event_no < 1000 THEN lpad(event_no::VARCHAR, 3, '0') ELSE event_no::VARCHAR END AS event_id FROM s),
bl AS (SELECT domain, event_id, discovered_label, count(*) AS n, min(w) AS a, max(w) AS b FROM ss GROUP BY ALL),
m AS MATERIALIZED (SELECT domain, event_id, min(a) AS start_time, max(b) AS end_time, sum(n)::BIGINT AS n_windows, arg_min(discovered_label, (-n, discovered_label)) AS dominant_label FROM bl GROUP BY ALL)
"""
)
_ACF = (
    f"WITH {W_SQL}"
    + """, h AS (SELECT collector, asn, w AS h, avg(total_updates) AS x FROM f WHERE w IS NOT NULL AND total_updates IS NOT NULL GROUP BY ALL),
c AS MATERIALIZED (SELECT collector, asn, row_number() OVER (PARTITION BY collector, asn ORDER BY h) AS i, x - avg(x) OVER (PARTITION BY collector, asn) AS x FROM h),
p AS (SELECT collector, asn, sum(x * x) AS p FROM c GROUP BY ALL)
SELECT a.collector, a.asn, (b.i - a.i)::BIGINT AS lag, CASE WHEN any_value(p) > 1e-12 THEN sum(a.x * b.x) / any_value(p) END AS acf
FROM c a JOIN c b ON a.collector = b.collector AND a.asn = b.asn AND b.i - a.i BETWEEN 4 AND 300 JOIN p ON p.collector = a.collector AND p.asn = a.asn GROUP BY ALL"""
)

ORACLE = {
    "replace_by_key": """WITH e AS (SELECT DISTINCT pair, stamp, least(source, target) AS u, greatest(source, target) AS v FROM edges WHERE source <> target),
n AS (SELECT pair, stamp, count(*) AS n_edges, 'new' AS origin FROM e WHERE stamp LIKE '%0000' GROUP BY ALL), o AS (SELECT pair, stamp, n_edges, 'old' AS origin FROM snapshots_index)
SELECT * FROM n UNION ALL SELECT o.* FROM o ANTI JOIN n USING (pair, stamp)""",
    "event_sessions": f"WITH {S_SQL} SELECT * FROM ss",
    "event_manifest": f"WITH {S_SQL} SELECT * FROM m",
    "event_interval_join": f"WITH {S_SQL} SELECT l.row_id, l.domain, l.w, max(m.event_id) AS event_id FROM l LEFT JOIN m ON l.domain = m.domain AND l.w BETWEEN m.start_time AND m.end_time GROUP BY ALL",
    "nearest_window_join": f"""WITH {L_SQL}, {W_SQL}, x AS (SELECT row_id, lower(trim(collector)) AS collector, w FROM l)
SELECT x.row_id, x.collector, x.w, arg_min(f.feature_id, (abs(epoch_us(f.ts) - epoch_us(x.w)), f.ts, f.feature_id)) AS near_feature_id
FROM x LEFT JOIN f ON f.collector = x.collector AND abs(epoch_us(f.ts) - epoch_us(x.w)) <= 600000000 GROUP BY ALL""",
    "floor_snapshot_join": f"""WITH {L_SQL}, ix AS (SELECT DISTINCT lower(pair) AS domain, stamp, n_nodes, n_edges FROM snapshots_index), la AS (SELECT domain, max(stamp) AS last_stamp FROM ix GROUP BY ALL),
x AS (SELECT row_id, domain, strftime(time_bucket(INTERVAL 8 hours, w), '%Y%m%d_%H%M') AS stamp FROM l)
SELECT x.domain, x.stamp, row_id, n_nodes, n_edges, last_stamp FROM x LEFT JOIN ix ON x.domain = ix.domain AND x.stamp = ix.stamp LEFT JOIN la ON la.domain = x.domain""",
    "rolling_features": f"""WITH {L_SQL} SELECT row_id, CASE WHEN count(announcements) OVER c >= 4 THEN median(announcements::DOUBLE) OVER c END AS rolling_median, avg(announcements) OVER t AS trailing_mean FROM l
WINDOW c AS (PARTITION BY domain ORDER BY w, row_id ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING), t AS (PARTITION BY domain ORDER BY w, row_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
    "trailing_sequence": f"""WITH {L_SQL}, q AS (SELECT row_id, list(coalesce(announcements::VARCHAR, '-')) OVER (PARTITION BY domain ORDER BY w, row_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS s FROM l)
SELECT row_id, array_to_string(list_concat(list_transform(range(10 - len(s)), lambda i: s[1]), s), ' ') AS sequence FROM q""",
    "acf_lags": _ACF,
    "spike_intervals": f"""WITH {L_SQL}, p AS (SELECT DISTINCT domain, epoch_us(w) // 300000000 AS p FROM l WHERE "binary" = 1), g AS (SELECT domain, (p - lag(p) OVER (PARTITION BY domain ORDER BY p)) AS g FROM p)
SELECT domain, count(*) AS n_gaps, count(*) FILTER (least(g % 12, 12 - g % 12) <= 2) AS n_near, count(*) FILTER (least(g % 12, 12 - g % 12) <= 2) / count(*) AS share_near FROM g WHERE g IS NOT NULL GROUP BY ALL""",
    "largest_gap": f"""WITH {L_SQL}, r AS (SELECT domain, consensus_score AS s, row_number() OVER (PARTITION BY domain ORDER BY consensus_score DESC) AS r, count(*) OVER (PARTITION BY domain) AS n,
  max(consensus_score) OVER (PARTITION BY domain) - min(consensus_score) OVER (PARTITION BY domain) AS span FROM l WHERE consensus_score IS NOT NULL),
g AS (SELECT *, lead(s) OVER (PARTITION BY domain ORDER BY r) AS nx FROM r WHERE r <= least(n, greatest(5, ceil(0.30 * n))))
SELECT domain, max(n) AS n, CASE WHEN max(n) >= 10 AND max(span) > 1e-12 AND max(s - nx) > 0 THEN arg_max((s + nx) / 2, (s - nx, -r)) FILTER (nx IS NOT NULL) END AS threshold FROM g GROUP BY ALL""",
    "sign_flips": f"""WITH {L_SQL}, c AS (SELECT domain, w::DATE AS day, round(corr(announcements, as_path_avg), 9) AS r FROM l GROUP BY ALL), z AS (SELECT *, sign(r) AS s FROM c WHERE r IS NOT NULL AND NOT isnan(r) AND abs(r) > 1e-12),
k AS (SELECT domain, s, lag(s) OVER (PARTITION BY domain ORDER BY day) AS p FROM z) SELECT domain, count(*) FILTER (s <> p) AS sign_flips FROM k GROUP BY ALL""",
    "slot_profile": f"""WITH {L_SQL} SELECT domain, hour(w) AS slot, count(announcements) AS n, quantile_cont(announcements::DOUBLE, 0.5) AS median, quantile_cont(announcements::DOUBLE, 0.25) AS q25, quantile_cont(announcements::DOUBLE, 0.75) AS q75 FROM l GROUP BY ALL""",
    "sampling_interval": f"""WITH {W_SQL}, d AS (SELECT DISTINCT collector, asn, w FROM f WHERE w IS NOT NULL), g AS (SELECT collector, asn, (epoch_us(w) - epoch_us(lag(w) OVER (PARTITION BY collector, asn ORDER BY w))) / 1e6 AS g FROM d)
SELECT collector, asn, median(g) AS median_s FROM g GROUP BY ALL""",
    "label_override": f"""WITH {L_SQL}, g AS (SELECT w, arg_max(discovered_label, row_id) AS discovered_label FROM l WHERE domain = (SELECT min(domain) FROM l) GROUP BY ALL)
SELECT l.w, l.row_id, l.domain, g.discovered_label FROM l JOIN g ON l.w = g.w WHERE g.discovered_label <> 'uncertain'""",
    "upsert_keep_last": f"""WITH {W_SQL}, r AS (SELECT collector, asn, w, feature_id, total_updates, row_number() OVER (PARTITION BY collector, asn, w ORDER BY ts DESC, feature_id DESC) AS r FROM f WHERE w IS NOT NULL) SELECT * EXCLUDE (r) FROM r WHERE r = 1""",
    "domain_pairs": f"""WITH {L_SQL}, n AS (SELECT DISTINCT domain FROM l) SELECT a.domain AS source_domain, b.domain AS target_domain,
CASE WHEN regexp_extract(a.domain, 'as([0-9]+)$', 1) = regexp_extract(b.domain, 'as([0-9]+)$', 1) THEN 'same_as_diff_collector' WHEN split_part(a.domain, '_', 1) = split_part(b.domain, '_', 1) THEN 'same_collector_diff_as' ELSE 'diff_as_diff_collector' END AS scenario
FROM n a JOIN n b ON a.domain <> b.domain""",
    "temporal_edges": f"""WITH {L_SQL}, k AS (SELECT domain, row_id AS target, lag(row_id, 1) OVER x AS p1, lag(row_id, 2) OVER x AS p2 FROM l WINDOW x AS (PARTITION BY domain ORDER BY w, row_id))
SELECT domain, p1 AS source, target, 1 AS step FROM k WHERE p1 IS NOT NULL UNION ALL SELECT domain, p2, target, 2 FROM k WHERE p2 IS NOT NULL""",
    "mutual_knn": """WITH d AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), b.vec_id) AS r
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id), n AS (SELECT * FROM d WHERE r <= 5) SELECT x.label, x.a, x.b FROM n x JOIN n y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b""",
}
