"""Queries over the update stream: path functions and the statistical view of five-minute windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import paths
from pathloom.operators import statview as sv
from pathloom.operators.chunked import with_predecessor
from pathloom.sources.updates import read_updates

FIVE_MINUTES = 300
KEYS = ["collector", "w"]

# Fixed values of the AS numbers that are removed, as DuckDB SQL; asn stands for the number.
PUBLIC = "NOT (asn IN (0, 23456, 65535, 4294967295) OR asn BETWEEN 64512 AND 65534 OR asn BETWEEN 4200000000 AND 4294967294)"

UPDATES_SQL = f"""
raw_u AS (
  SELECT DISTINCT seq, timestamp AS ts, time_bucket(INTERVAL 5 minutes, timestamp) AS w, coalesce(collector, '') AS collector, coalesce(type, '') AS type,
         coalesce(peer_ip, '') AS peer_ip, coalesce(peer_as, '') AS peer_as, coalesce(prefix, '') AS prefix, coalesce(origin, '') AS origin,
         coalesce(next_hop, '') AS next_hop, coalesce(as_path, '') AS as_path FROM updates WHERE timestamp IS NOT NULL),
nums AS (
  SELECT *, list_filter(list_transform(list_filter(string_split_regex(regexp_replace(as_path, '\\{{[^}}]*\\}}', ' ', 'g'), '\\s+'),
    lambda x: regexp_full_match(x, '[0-9]+')), lambda x: x::BIGINT), lambda asn: {PUBLIC}) AS p0 FROM raw_u),
u AS (
  SELECT * EXCLUDE (p0), list_transform(list_filter(list_zip(p0, list_prepend(NULL, p0)), lambda z: z[1] IS NOT NULL AND z[1] IS DISTINCT FROM z[2]), lambda z: z[1]) AS path
  FROM nums)
"""


def _log(spark: SparkSession, d: str, seconds: int = FIVE_MINUTES) -> DataFrame:
    return read_updates(spark, d, seconds)


def _text() -> Column:
    return F.array_join(F.col("path").cast("array<string>"), " ")


def asn_validity(spark: SparkSession, d: str) -> DataFrame:
    tokens = read_updates(spark, d, FIVE_MINUTES, raw=True).select(F.explode(F.split("as_path", r"\s+")).alias("token")).filter(F.col("token").rlike("^[0-9]{1,18}$")).distinct()
    return tokens.select(F.col("token").cast("bigint").alias("asn")).distinct().select("asn", paths.is_public_asn(F.col("asn")).alias("valid"))


def path_clean(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return _log(spark, d).select("seq", _text().alias("clean"), paths.path_length(p).cast("bigint").alias("length"), paths.origin_as(p).alias("origin_as"), paths.path_contains(p, TARGET).alias("has_target"))


def path_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of all paths with their number of occurrences."""
    e = _log(spark, d).select(F.explode(paths.path_edges(F.col("path"))).alias("e"))
    return e.groupBy(F.col("e.u").alias("u"), F.col("e.v").alias("v")).agg(F.count(F.lit(1)).alias("weight"))


def path_edit_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distances between the successive paths of a prefix over the whole log."""
    rows = with_predecessor(_log(spark, d).filter("type = 'A'").filter(F.size("path") > 0).select("seq", "ts", "prefix", "path"), ["prefix"], "ts", ["seq"], "path", "before")
    rows = rows.filter("before is not null")
    return rows.select("seq", paths.edit_distance(F.col("before"), F.col("path")).cast("bigint").alias("distance"))


def _part(name, seconds=FIVE_MINUTES):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return getattr(sv, name)(_log(spark, d, seconds), KEYS)

    return run


TARGET = 1056878


def _ego(log: DataFrame) -> DataFrame:
    """The target's neighbours within the collector's paths."""
    e = log.select("collector", F.explode(paths.path_edges(F.col("path"))).alias("e")).select("collector", "e.u", "e.v")
    near = e.filter((F.col("u") == TARGET) | (F.col("v") == TARGET))
    return near.select("collector", F.explode(F.array("u", "v")).alias("asn")).distinct()


def ego_filter_ratio(spark: SparkSession, d: str, seconds: int = FIVE_MINUTES) -> DataFrame:
    log = _log(spark, d, seconds)
    return sv.ego_filter_ratio(log, sv.ego_filter(log, _ego(log), TARGET, ["collector"]), KEYS)


def ego_filter_any_hop(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    return sv.ego_filter(log, _ego(log), TARGET, ["collector"], "any_hop").select("seq")


WINDOWED = {
    "win_volume": "volumes",
    "win_peers": "peers",
    "win_prefix": "prefixes",
    "win_new_prefixes": "new_prefixes",
    "win_dups": "duplicates",
    "win_path_stats": "path_lengths",
    "win_unique_paths": "distinct_paths",
    "win_edit_hist": "path_edits",
    "win_rare_as": "rare_ases",
    "win_implicit_wd": "implicit_withdrawals",
    "stat_view_full": "stat_view",
}


QUERIES = {
    "asn_validity": asn_validity,
    "path_clean": path_clean,
    "path_edges": path_edges,
    "path_edit_distance": path_edit_distance,
    **{query: _part(name) for query, name in WINDOWED.items()},
    "ego_filter_ratio": ego_filter_ratio,
    "ego_filter_any_hop": ego_filter_any_hop,
}

_VIEW = f"""WITH {UPDATES_SQL},
vol AS (
  SELECT collector, w, count(*) FILTER (type = 'A') AS announcements, count(*) FILTER (type = 'W') AS withdrawals, count(*) AS total_updates,
         greatest(1.0, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS span,
         count(*) FILTER (type = 'A' AND origin = 'IGP') AS "origin_IGP", count(*) FILTER (type = 'A' AND origin = 'INCOMPLETE') AS "origin_INCOMPLETE",
         count(*) FILTER (contains(prefix, '/32')) AS s32, count(DISTINCT peer_as) AS unique_peers FROM u GROUP BY ALL),
vol2 AS (SELECT *, announcements / span AS ann_rate, withdrawals / span AS wd_rate,
         CASE WHEN announcements = 0 THEN 0 ELSE withdrawals / announcements END AS wd_ann_ratio,
         CASE WHEN withdrawals = 0 THEN 0 ELSE announcements / withdrawals END AS ann_wd_ratio FROM vol),
vol3 AS (SELECT *, s32 + CASE WHEN wd_ann_ratio > 0.5 THEN 10 ELSE 0 END AS nadas FROM vol2),
pfx0 AS (SELECT collector, w, prefix, bool_or(type = 'A') AS a, bool_or(type = 'W') AS wd, count(DISTINCT origin) FILTER (type = 'A') AS o FROM u GROUP BY ALL),
pfx AS (SELECT collector, w, count(*) FILTER (a) AS unique_prefixes_ann, count(*) FILTER (wd) AS unique_prefixes_wd, count(*) FILTER (a AND wd) AS flaps,
         count(*) FILTER (o > 1) AS origin_changes FROM pfx0 GROUP BY ALL),
wins AS (SELECT collector, w, lag(w) OVER (PARTITION BY collector ORDER BY w) AS before FROM (SELECT DISTINCT collector, w FROM u)),
fresh AS (SELECT p.collector, p.w, count(*) FILTER (p.a AND wins.before IS NOT NULL AND q.prefix IS NULL) AS new_prefixes
  FROM pfx0 p JOIN wins ON p.collector = wins.collector AND p.w = wins.w
  LEFT JOIN pfx0 q ON q.collector = p.collector AND q.w = wins.before AND q.prefix = p.prefix GROUP BY ALL),
dup AS (SELECT collector, w, sum(n - 1)::BIGINT AS dups FROM
  (SELECT collector, w, count(*) AS n FROM u WHERE type = 'A' GROUP BY collector, w, peer_ip, peer_as, prefix, path, origin, next_hop) GROUP BY ALL),
valid AS (SELECT * FROM u WHERE type = 'A' AND len(path) > 0),
len_ AS (SELECT collector, w, avg(len(path)) AS as_path_avg, max(len(path)) AS as_path_max, coalesce(stddev_samp(len(path)), 0) AS as_path_std FROM valid GROUP BY ALL),
upm AS (SELECT collector, w, max(n) AS unique_as_path_max FROM (SELECT collector, w, prefix, count(DISTINCT path) AS n FROM valid GROUP BY ALL) GROUP BY ALL),
prev AS (SELECT collector, w, prefix, path, lag(path) OVER (PARTITION BY collector, w, prefix ORDER BY ts, seq) AS before FROM valid),
dist AS (SELECT collector, w, prefix, levenshtein(
    array_to_string(list_transform(before, lambda x: chr(64 + list_position(list_distinct(list_sort(before || path)), x)::INT)), ''),
    array_to_string(list_transform(path, lambda x: chr(64 + list_position(list_distinct(list_sort(before || path)), x)::INT)), '')) AS d FROM prev WHERE before IS NOT NULL),
edit AS (SELECT collector, w, avg(d) AS edit_distance_avg, max(d) AS edit_distance_max,
  {", ".join(f"count(*) FILTER (d = {i}) AS edit_distance_dict_{i}" for i in range(7))},
  {", ".join(f"count(DISTINCT prefix) FILTER (d = {i}) AS edit_distance_unique_dict_{i}" for i in range(2))} FROM dist GROUP BY ALL),
rare AS (SELECT collector, w, count(*) FILTER (n < 3) AS number_rare_ases, count(*) FILTER (n < 3) / sum(n) AS rare_ases_ratio
  FROM (SELECT collector, w, asn, count(*) AS n FROM (SELECT collector, w, unnest(path) AS asn FROM valid) GROUP BY ALL) GROUP BY ALL),
imp AS (SELECT collector, w, count(*) FILTER (n > 1) AS imp_wd, count(*) FILTER (n > 1 AND k = 1) AS imp_wd_spath, count(*) FILTER (n > 1 AND k <> 1) AS imp_wd_dpath
  FROM (SELECT collector, w, prefix, peer_ip, count(*) AS n, count(DISTINCT path) AS k FROM u WHERE type = 'A' GROUP BY ALL) GROUP BY ALL)
"""

_VOLUME = "announcements, withdrawals, total_updates, ann_rate, wd_rate, wd_ann_ratio, ann_wd_ratio, \"origin_IGP\", \"origin_INCOMPLETE\", nadas"
_REST = {
    "pfx": "unique_prefixes_ann, unique_prefixes_wd, flaps, origin_changes", "fresh": "new_prefixes", "dup": "dups",
    "len_": "as_path_avg, as_path_max, as_path_std", "upm": "unique_as_path_max",
    "edit": "edit_distance_avg, edit_distance_max, " + ", ".join(f"edit_distance_dict_{i}" for i in range(7)) + ", edit_distance_unique_dict_0, edit_distance_unique_dict_1",
    "rare": "number_rare_ases, rare_ases_ratio", "imp": "imp_wd, imp_wd_spath, imp_wd_dpath",
}
_EGO = f"""WITH {UPDATES_SQL},
e AS (SELECT collector, unnest(path) AS a, unnest(path[2:]) AS b FROM u WHERE len(path) > 1),
ego AS (SELECT DISTINCT collector, unnest([a, b]) AS asn FROM e WHERE b IS NOT NULL AND ({TARGET} IN (a, b)))
"""

ORACLE = {
    "asn_validity": f"""WITH t AS (SELECT DISTINCT x::BIGINT AS asn FROM (SELECT unnest(string_split_regex(as_path, '\\s+')) AS x FROM updates WHERE timestamp IS NOT NULL)
  WHERE regexp_full_match(x, '[0-9]{{1,18}}')) SELECT asn, {PUBLIC} AS valid FROM t""",
    "path_clean": f"WITH {UPDATES_SQL} SELECT seq, array_to_string(path, ' ') AS clean, len(path) AS length, coalesce(path[-1]::VARCHAR, '') AS origin_as, list_contains(path, {TARGET}) AS has_target FROM u",
    "path_edges": f"""WITH {UPDATES_SQL}, e AS (SELECT unnest(path) AS a, unnest(path[2:]) AS b FROM u WHERE len(path) > 1)
SELECT least(a, b) AS u, greatest(a, b) AS v, count(*) AS weight FROM e WHERE b IS NOT NULL GROUP BY ALL""",
    "path_edit_distance": f"""WITH {UPDATES_SQL}, v AS (SELECT seq, path, lag(path) OVER (PARTITION BY prefix ORDER BY ts, seq) AS before FROM u WHERE type = 'A' AND len(path) > 0)
SELECT seq, levenshtein(array_to_string(list_transform(before, lambda x: chr(64 + list_position(list_distinct(list_sort(before || path)), x)::INT)), ''),
  array_to_string(list_transform(path, lambda x: chr(64 + list_position(list_distinct(list_sort(before || path)), x)::INT)), '')) AS distance FROM v WHERE before IS NOT NULL""",
    "win_volume": _VIEW + f"SELECT collector, w, {_VOLUME} FROM vol3",
    "win_peers": _VIEW + "SELECT collector, w, unique_peers FROM vol",
    **{q: _VIEW + f"SELECT collector, w, {_REST[t]} FROM {t}" for q, t in (("win_prefix", "pfx"), ("win_new_prefixes", "fresh"), ("win_dups", "dup"), ("win_path_stats", "len_"), ("win_unique_paths", "upm"), ("win_edit_hist", "edit"), ("win_rare_as", "rare"), ("win_implicit_wd", "imp"))},
    "stat_view_full": _VIEW
    + f"SELECT collector, w, {_VOLUME}, unique_peers, "
    + ", ".join(f"coalesce({c.strip()}, 0) AS {c.strip()}" for cols in _REST.values() for c in cols.split(","))
    + " FROM vol3 "
    + " ".join(f"LEFT JOIN {t} USING (collector, w)" for t in _REST),
    "ego_filter_ratio": _EGO
    + f""", k AS (SELECT u.*, (type = 'A' AND EXISTS (SELECT 1 FROM ego WHERE ego.collector = u.collector AND ego.asn = path[-1]))
   OR list_contains(path, {TARGET}) OR (type = 'W' AND EXISTS (SELECT 1 FROM ego WHERE ego.collector = u.collector AND ego.asn::VARCHAR = peer_as)) AS keep FROM u)
SELECT collector, w, count(*) FILTER (keep) / count(*) AS ego_filter_ratio FROM k GROUP BY ALL""",
    "ego_filter_any_hop": _EGO + "SELECT DISTINCT seq FROM (SELECT seq, collector, unnest(path) AS asn FROM u) SEMI JOIN ego USING (collector, asn)",
}
