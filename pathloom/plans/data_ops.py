"""Queries p3, p5, p6 and p7: grids, implausible readings, heavy keys and snapshot changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.functions.net import as_number, network
from pathloom.functions.paths import clean_path
from pathloom.operators.grid import counter_increments, increments_to_cells, regular_windows, window_id
from pathloom.operators.heavy_keys import key_profile
from pathloom.operators.snapshot_diff import snapshot_changes, snapshot_index, undirected
from pathloom.operators.spikes import implausible
from pathloom.session import table


def _features(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    rows = table(spark, d, "window_features").withColumns(
        {"collector": F.lower(F.btrim("collector")), "window_start": F.col("window_start").cast("timestamp")}
    )
    return rows.select("feature_id", "collector", "asn", "window_start", *columns)


def regular_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = regular_windows(_features(spark, d, "total_updates"), ["collector", "asn"])
    return rows.select(
        "collector", "asn", "segment_no", window_id(F.col("cell_start")).alias("window_id"), F.round("amount").cast("bigint").alias("total_updates"), "missing"
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(spark, d).filter("missing").select("collector", "asn", "window_id")


def counter_grid(spark: SparkSession, d: str) -> DataFrame:
    """Readings as running counters that begin anew with each UTC day, as a device that restarts at midnight would show
    them: resets detected from the values, increments spread over 15-minute cells, stretches over an hour uncovered."""
    rows = _features(spark, d, "total_updates").filter("window_start is not null and total_updates >= 0")
    once = rows.groupBy("collector", "asn", "window_start").agg(F.max("total_updates").alias("n"))
    day = Window.partitionBy("collector", "asn", F.to_date("window_start")).orderBy("window_start")
    counters = once.withColumn("counter", F.sum("n").over(day))
    cells = increments_to_cells(counter_increments(counters, ["collector", "asn"], "window_start", "counter"), ["collector", "asn"], 900, max_span_seconds=3600)
    return cells.withColumn("amount", F.round("amount", 4)).withColumn("covered", F.round("covered", 6))


def implausible_readings(spark: SparkSession, d: str) -> DataFrame:
    measures = ["announcements", "withdrawals", "total_updates"]
    rows = _features(spark, d, *measures)
    return implausible(rows, ["collector", "asn"], "window_start", "feature_id", measures, {"total_updates": measures[:2]})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """What the bounds and the zero-detail runs reveal; a spike within the bounds is no case there."""
    return implausible_readings(spark, d).filter("negative or bound or stuck or sum").select("feature_id", "measure")


def heavy_keys(spark: SparkSession, d: str) -> DataFrame:
    """Per (peer_as, prefix): count, first and last time, distinct cleaned paths of its announcements."""
    rows = table(spark, d, "updates").select("seq", "timestamp", "type", "peer_as", "prefix", "as_path")
    path = F.when(F.col("type") == "A", F.nullif(clean_path(F.col("as_path")), F.lit("")))
    keys = {"peer_as": as_number(F.col("peer_as")), "prefix": network(F.col("prefix"))}
    return key_profile(rows, keys, ["peer_as", "prefix"], F.col("timestamp"), path, F.col("seq"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Shares are of all distinct updates, also those with a missing key part."""
    return heavy_keys(spark, d).filter(F.col("n") >= F.col("records") * 0.01).select("peer_as", "prefix")


def edge_changes(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edges")
    index = snapshot_index(edges, "pair", "stamp")
    return snapshot_changes(undirected(edges, ["pair", "stamp"]), index, "pair", "stamp", ["source", "target"], ["weight"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return edge_changes(spark, d).select("pair", "stamp", "source", "target", "change")


QUERIES = {
    "p3_regular_grid": regular_grid,
    "p3_counter_grid": counter_grid,
    "p3_found": p3_found,
    "p5_implausible_readings": implausible_readings,
    "p5_found": p5_found,
    "p6_key_profile": heavy_keys,
    "p6_found": p6_found,
    "p7_edge_changes": edge_changes,
    "p7_found": p7_found,
}

_GRID = """
WITH readings AS (
  SELECT lower(trim(collector)) AS collector, asn, feature_id, total_updates, window_start,
         time_bucket(INTERVAL 5 minutes, window_start) AS w
  FROM window_features WHERE window_start IS NOT NULL AND total_updates IS NOT NULL),
latest AS (
  SELECT collector, asn, w, CAST(floor(epoch(w) / 28800) AS BIGINT) AS segment_no,
         max_by(total_updates, (window_start, feature_id)) AS total_updates
  FROM readings GROUP BY ALL),
span AS (SELECT collector, asn, segment_no, min(w) AS a, max(w) AS b FROM latest GROUP BY ALL),
grid AS (SELECT collector, asn, segment_no, unnest(generate_series(a, b, INTERVAL 5 minutes)) AS w FROM span)
"""

_FLAGS = """
WITH base AS (SELECT DISTINCT lower(trim(collector)) AS collector, asn, feature_id, window_start,
                     announcements, withdrawals, total_updates FROM window_features),
vals AS (
  SELECT collector, asn, feature_id, window_start, 'announcements' AS measure, announcements AS v, NULL AS parts FROM base
  UNION ALL SELECT collector, asn, feature_id, window_start, 'withdrawals', withdrawals, NULL FROM base
  UNION ALL SELECT collector, asn, feature_id, window_start, 'total_updates', total_updates, announcements + withdrawals FROM base),
known AS (SELECT * FROM vals WHERE v IS NOT NULL),
med AS (SELECT collector, asn, measure, median(v) AS m FROM known WHERE v >= 0 GROUP BY ALL),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY collector, asn, measure ORDER BY window_start, feature_id)
          - row_number() OVER (PARTITION BY collector, asn, measure, v ORDER BY window_start, feature_id) AS island FROM known),
runs AS (SELECT *, count(*) OVER (PARTITION BY collector, asn, measure, v, island) AS n FROM ordered)
SELECT feature_id, runs.measure FROM runs LEFT JOIN med
  ON runs.collector IS NOT DISTINCT FROM med.collector AND runs.asn IS NOT DISTINCT FROM med.asn AND runs.measure = med.measure
WHERE v < 0 OR v > 8 * m OR v < m / 8 OR n >= 8 OR v <> parts
"""

_CHANGES = """
WITH e AS (SELECT pair, stamp, least(source, target) AS source, greatest(source, target) AS target, max(weight) AS weight
           FROM edges WHERE source <> target GROUP BY ALL),
idx AS (SELECT pair, stamp, lag(stamp) OVER (PARTITION BY pair ORDER BY stamp) AS before FROM (SELECT DISTINCT pair, stamp FROM edges)),
now_ AS (SELECT e.*, idx.before FROM e JOIN idx USING (pair, stamp) WHERE idx.before IS NOT NULL),
old_ AS (SELECT e.pair, idx.stamp, e.source, e.target, e.weight FROM e JOIN idx ON e.pair = idx.pair AND e.stamp = idx.before),
both_ AS (
  SELECT pair, stamp, source, target, o.weight AS old_weight, n.weight AS new_weight,
         CASE WHEN o.pair IS NULL THEN 'added' WHEN n.pair IS NULL THEN 'removed'
              WHEN o.weight IS DISTINCT FROM n.weight THEN 'changed' END AS change
  FROM now_ n FULL JOIN old_ o USING (pair, stamp, source, target))
"""

ORACLE = {
    "p3_regular_grid": _GRID
    + """SELECT g.collector, g.asn, g.segment_no, strftime(g.w, '%Y%m%d_%H%M') AS window_id, l.total_updates, l.w IS NULL AS missing
FROM grid g LEFT JOIN latest l ON g.collector = l.collector AND g.asn = l.asn AND g.w = l.w""",
    "p3_found": _GRID
    + """SELECT g.collector, g.asn, strftime(g.w, '%Y%m%d_%H%M') AS window_id
FROM grid g LEFT JOIN latest l ON g.collector = l.collector AND g.asn = l.asn AND g.w = l.w WHERE l.w IS NULL""",
    "p3_counter_grid": """
WITH once AS (SELECT lower(trim(collector)) AS collector, asn, window_start AS t, max(total_updates) AS n FROM window_features
  WHERE window_start IS NOT NULL AND total_updates >= 0 GROUP BY ALL),
c AS (SELECT collector, asn, t, sum(n) OVER (PARTITION BY collector, asn, t::DATE ORDER BY t)::BIGINT AS c FROM once),
l AS (SELECT *, lag(t) OVER k AS pt, lag(c) OVER k AS pc FROM c WINDOW k AS (PARTITION BY collector, asn ORDER BY t)),
i AS (SELECT collector, asn, epoch_us(pt) AS a, epoch_us(t) AS b, CASE WHEN c < pc THEN c ELSE c - pc END AS inc FROM l WHERE pt IS NOT NULL),
f AS (SELECT *, unnest(generate_series(a // 900000000, (b - 1) // 900000000)) AS cell FROM i WHERE b - a <= 3600000000),
o AS (SELECT *, least(b, (cell + 1) * 900000000) - greatest(a, cell * 900000000) AS overlap FROM f)
SELECT collector, asn, make_timestamp(cell * 900000000) AS cell_start, round(sum(inc * (overlap / (b - a))), 4) AS amount, round(sum(overlap / 900000000), 6) AS covered
FROM o GROUP BY ALL""",
    "p5_found": _FLAGS,
    "p7_edge_changes": _CHANGES + "SELECT * FROM both_ WHERE change IS NOT NULL",
    "p7_found": _CHANGES + "SELECT pair, stamp, source, target, change FROM both_ WHERE change IS NOT NULL",
}
