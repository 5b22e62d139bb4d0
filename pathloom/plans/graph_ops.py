"""Queries over the graph snapshots (every pair and stamp at once) and over the evolving topology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators import graph as g
from pathloom.operators import topology as topo
from pathloom.operators.components import components
from pathloom.operators.graph_kernels import kernel_features, kernel_nodes
from pathloom.operators.snapshot_diff import undirected
from pathloom.plans.stream_ops import FIVE_MINUTES, UPDATES_SQL
from pathloom.session import table
from pathloom.sources.updates import read_updates

KEYS = ["pair", "stamp"]


def _tidy(rows: DataFrame) -> DataFrame:
    return undirected(rows, KEYS).select(*KEYS, F.col("source").alias("u"), F.col("target").alias("v"), F.col("weight").cast("bigint").alias("weight"))


def snapshot_edges(spark: SparkSession, d: str) -> DataFrame:
    return _tidy(table(spark, d, "edges"))


def _on_edges(f):
    return lambda spark, d: f(snapshot_edges(spark, d), KEYS)


def _targets(spark: SparkSession, d: str) -> DataFrame:
    """The target of a pair is the number in its name: rrc91_as1200000."""
    return snapshot_edges(spark, d).select(*KEYS).distinct().withColumn("asn", F.regexp_extract("pair", "as([0-9]+)$", 1).cast("bigint"))


def ego_2hop(spark: SparkSession, d: str) -> DataFrame:
    return g.ego_nodes(snapshot_edges(spark, d), KEYS, _targets(spark, d), 2)


def ego_size(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges of the 1-hop ego graph; only graphs of three nodes or more."""
    e = snapshot_edges(spark, d)
    return g.size_density(g.induced(e, KEYS, g.ego_nodes(e, KEYS, _targets(spark, d), 1)), KEYS).filter("n_nodes >= 3")


def snapshot_components(spark: SparkSession, d: str) -> DataFrame:
    """Component of each node within its snapshot, as its smallest node by text."""
    name = lambda c: F.concat_ws("|", "pair", "stamp", F.col(c).cast("string"))
    found = components(snapshot_edges(spark, d).select(name("u").alias("a"), name("v").alias("b")))
    last = lambda c: F.element_at(F.split(c, r"\|"), 3).cast("bigint")
    return found.select(F.element_at(F.split("node", r"\|"), 1).alias("pair"), F.element_at(F.split("node", r"\|"), 2).alias("stamp"), last("node").alias("asn"), last("root").alias("component"))


def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes, components, share of the largest one, and the target's degree in the full graph."""
    c = snapshot_components(spark, d).groupBy(*KEYS, "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = c.groupBy(*KEYS).agg(F.sum("n").alias("n_nodes_full"), F.count(F.lit(1)).alias("n_components"), F.max("n").alias("lcc_nodes"))
    target = g.degrees(snapshot_edges(spark, d), KEYS).join(_targets(spark, d), [*KEYS, "asn"]).select(*KEYS, F.col("degree").alias("target_degree_full"))
    return sizes.withColumn("lcc_fraction", F.col("lcc_nodes") / F.col("n_nodes_full")).join(target, KEYS, "left")


def kcore(spark: SparkSession, d: str) -> DataFrame:
    return g.core_numbers(table(spark, d, "edges"), KEYS, tidy=_tidy)


def core_stats(spark: SparkSession, d: str) -> DataFrame:
    return g.core_statistics(kcore(spark, d), KEYS)


def snapshot_stats(spark: SparkSession, d: str) -> DataFrame:
    """The snapshot index made anew from the edges."""
    rows = table(spark, d, "edges").groupBy(*KEYS).agg(F.count_if(F.col("source") == F.col("target")).alias("n_self_loops"), F.count(F.lit(1)).alias("n_rows"))
    distinct = snapshot_edges(spark, d).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_edges"))
    out = rows.join(distinct, KEYS)
    return out.select(*KEYS, F.split("pair", "_")[0].alias("collector"), "n_edges", "n_self_loops", (F.col("n_rows") - F.col("n_edges") - F.col("n_self_loops")).alias("n_dup_edges"), F.to_timestamp("stamp", "yyyyMMdd_HHmm").alias("snapshot_ts"))


def important_nodes(spark: SparkSession, d: str) -> DataFrame:
    e = snapshot_edges(spark, d)
    last = e.join(e.groupBy("pair").agg(F.max("stamp").alias("stamp")), KEYS, "left_semi")
    nodes = kernel_nodes(last, KEYS).select(*KEYS, "asn", "degree", F.col("core_number").alias("core"), F.col("betweenness_centrality").alias("betweenness"))
    target = F.col("asn") == F.regexp_extract("pair", "as([0-9]+)$", 1).cast("bigint")
    return g.importance(nodes, KEYS, 20, target)


GROUP = ["collector"]


def _log(spark: SparkSession, d: str, seconds: int = FIVE_MINUTES) -> DataFrame:
    return topo.with_segment(read_updates(spark, d, seconds))


def live_edges(spark: SparkSession, d: str, seconds: int = FIVE_MINUTES) -> DataFrame:
    return topo.live_edges(_log(spark, d, seconds), GROUP, seconds)


def topology_evolution(spark: SparkSession, d: str) -> DataFrame:
    return topo.topology_evolution(live_edges(spark, d), GROUP)


def edge_churn(spark: SparkSession, d: str) -> DataFrame:
    """Edges that came to life and died by five-minute window."""
    spans = topo.edge_intervals(topo.edge_deltas(topo.path_lives(_log(spark, d), GROUP), GROUP), GROUP)
    born = spans.select(*GROUP, "segment", "u", "v", F.col("w").alias("at"), F.lit(1).alias("x"))
    gone = spans.filter("until is not null").select(*GROUP, "segment", "u", "v", F.col("until").alias("at"), F.lit(-1).alias("x"))
    # a change of the count alone ends one interval and starts the next in the same window: they cancel
    net = born.union(gone).groupBy(*GROUP, "segment", "u", "v", "at").agg(F.sum("x").alias("x")).filter("x <> 0")
    return net.groupBy(*GROUP, F.col("at").alias("w")).agg(F.count_if(F.col("x") > 0).alias("edges_added"), F.count_if(F.col("x") < 0).alias("edges_removed"))


def state_counters(spark: SparkSession, d: str) -> DataFrame:
    return topo.state_counters(_log(spark, d), GROUP)


QUERIES = {
    "snapshot_edges": snapshot_edges,
    "snapshot_stats": snapshot_stats,
    "snapshot_size_density": _on_edges(g.size_density),
    "degree_stats": _on_edges(g.degrees),
    "assortativity": _on_edges(g.assortativity),
    "triangles_clustering": _on_edges(g.clustering),
    "local_clustering": _on_edges(g.node_clustering),
    "avg_neighbor_degree": _on_edges(g.avg_neighbor_degree),
    "rich_club": _on_edges(g.rich_club),
    "jaccard_adamic": _on_edges(g.neighbor_similarity),
    "degree_ccdf": _on_edges(g.degree_ccdf),
    "ego_2hop": ego_2hop,
    "ego_size": ego_size,
    "components": snapshot_components,
    "component_sizes": component_sizes,
    "kcore": kcore,
    "core_stats": core_stats,
    "pagerank_20": _on_edges(g.pagerank),
    "graph_kernel_features": _on_edges(kernel_features),
    "graph_kernel_nodes": _on_edges(kernel_nodes),
    "important_nodes": important_nodes,
    "live_edges_per_window": live_edges,
    "topology_evolution": topology_evolution,
    "edge_churn": edge_churn,
    "topology_counters": state_counters,
}

E_SQL = """
e AS MATERIALIZED (SELECT pair, stamp, least(source, target) AS u, greatest(source, target) AS v, max(weight)::BIGINT AS weight FROM edges
      WHERE source <> target GROUP BY ALL),
b AS MATERIALIZED (SELECT pair, stamp, u AS a, v AS b FROM e UNION ALL SELECT pair, stamp, v, u FROM e),
deg AS MATERIALIZED (SELECT pair, stamp, a AS asn, count(*) AS degree FROM b GROUP BY ALL)
"""
_TRI = f"""WITH {E_SQL},
tri AS MATERIALIZED (SELECT x.pair, x.stamp, x.u AS a, x.v AS b, y.v AS c FROM e x JOIN e y ON x.pair = y.pair AND x.stamp = y.stamp AND x.v = y.u
        JOIN e z ON z.pair = x.pair AND z.stamp = x.stamp AND z.u = x.u AND z.v = y.v),
tn AS (SELECT pair, stamp, asn, count(*) AS triangles FROM (SELECT pair, stamp, unnest([a, b, c]) AS asn FROM tri) GROUP BY ALL),
nc AS MATERIALIZED (SELECT pair, stamp, asn, degree, coalesce(triangles, 0) AS triangles,
   CASE WHEN degree > 1 THEN 2 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END AS local_clustering FROM deg LEFT JOIN tn USING (pair, stamp, asn))
"""
_TARGET = "CAST(regexp_extract(pair, 'as([0-9]+)$', 1) AS BIGINT)"
_LIVE = f"""WITH {UPDATES_SQL},
lg AS (SELECT *, time_bucket(INTERVAL 8 hours, ts) AS segment FROM u),
eff AS (SELECT collector, segment, peer_as, prefix, w, type, path, lead(w) OVER (PARTITION BY collector, segment, peer_as, prefix ORDER BY ts, seq) AS until
        FROM lg WHERE type = 'W' OR (type = 'A' AND len(path) >= 2)),
wins AS (SELECT DISTINCT collector, segment, w FROM lg),
held AS (SELECT wins.collector, wins.segment, wins.w, eff.path, row_number() OVER () AS id FROM eff JOIN wins ON eff.collector = wins.collector AND eff.segment = wins.segment
         AND wins.w >= eff.w AND (eff.until IS NULL OR wins.w < eff.until) WHERE type = 'A'),
hop AS (SELECT collector, segment, w, id, unnest(path) AS a, unnest(path[2:]) AS b FROM held),
live AS MATERIALIZED (SELECT collector, segment, w, u, v, count(*) AS refs FROM (SELECT DISTINCT collector, segment, w, id, least(a, b) AS u, greatest(a, b) AS v FROM hop WHERE b IS NOT NULL) GROUP BY ALL)
"""

ORACLE = {
    "snapshot_edges": f"WITH {E_SQL} SELECT * FROM e",
    "snapshot_stats": f"""WITH {E_SQL}, r AS (SELECT pair, stamp, count(*) AS n, count(*) FILTER (source = target) AS n_self_loops FROM edges GROUP BY ALL), k AS (SELECT pair, stamp, count(*) AS n_edges FROM e GROUP BY ALL)
SELECT pair, stamp, split_part(pair, '_', 1) AS collector, n_edges, n_self_loops, n - n_edges - n_self_loops AS n_dup_edges, strptime(stamp, '%Y%m%d_%H%M') AS snapshot_ts FROM r JOIN k USING (pair, stamp)""",
    "snapshot_size_density": f"""WITH {E_SQL} SELECT pair, stamp, count(*) AS n_nodes, (sum(degree) / 2)::BIGINT AS n_edges, max(degree) AS max_degree, avg(degree) AS avg_degree,
  sum(degree) / (count(*) * (count(*) - 1)) AS density FROM deg GROUP BY ALL""",
    "degree_stats": f"WITH {E_SQL} SELECT * FROM deg",
    "assortativity": f"""WITH {E_SQL} SELECT b.pair, b.stamp, corr(x.degree, y.degree) AS assortativity FROM b JOIN deg x ON x.pair = b.pair AND x.stamp = b.stamp AND x.asn = b.a
  JOIN deg y ON y.pair = b.pair AND y.stamp = b.stamp AND y.asn = b.b GROUP BY ALL""",
    "triangles_clustering": _TRI
    + """SELECT pair, stamp, (sum(triangles) / 3)::BIGINT AS n_triangles, sum(triangles) / sum(degree * (degree - 1) / 2) AS clustering_global, avg(local_clustering) AS clustering_avg_local FROM nc GROUP BY ALL""",
    "local_clustering": _TRI + "SELECT * FROM nc",
    "avg_neighbor_degree": f"WITH {E_SQL} SELECT b.pair, b.stamp, b.a AS asn, avg(degree) AS avg_neighbor_degree FROM b JOIN deg ON deg.pair = b.pair AND deg.stamp = b.stamp AND deg.asn = b.b GROUP BY ALL",
    "rich_club": f"""WITH {E_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY pair, stamp ORDER BY degree DESC) AS r FROM deg),
ks AS (SELECT pair, stamp, p, least(floor(q), lim) AS k FROM (SELECT pair, stamp, unnest([25, 50, 75, 90, 95]) AS p, unnest(quantile_cont(degree, [0.25, 0.5, 0.75, 0.9, 0.95])) AS q, max(degree) FILTER (r = 2) - 1 AS lim FROM ranked GROUP BY pair, stamp)),
nk AS (SELECT pair, stamp, p, k, count(*) AS n FROM ks JOIN deg USING (pair, stamp) WHERE degree > k GROUP BY ALL),
mk AS (SELECT e.pair, e.stamp, p, count(*) AS m FROM ks JOIN e USING (pair, stamp) JOIN deg x ON x.pair = e.pair AND x.stamp = e.stamp AND x.asn = e.u
       JOIN deg y ON y.pair = e.pair AND y.stamp = e.stamp AND y.asn = e.v WHERE x.degree > k AND y.degree > k GROUP BY ALL),
phi AS (SELECT pair, stamp, p, 2 * coalesce(m, 0) / (n * (n - 1)) AS phi FROM nk LEFT JOIN mk USING (pair, stamp, p))
SELECT pair, stamp, {", ".join(f"max(phi) FILTER (p = {p}) AS rich_club_p{p}" for p in (25, 50, 75, 90, 95))} FROM phi GROUP BY ALL""",
    "jaccard_adamic": f"""WITH {E_SQL}, cn AS (SELECT e.pair, e.stamp, e.u, e.v, count(*) AS c, sum(1 / ln(degree)) AS aa FROM e
  JOIN b x ON x.pair = e.pair AND x.stamp = e.stamp AND x.a = e.u JOIN b y ON y.pair = e.pair AND y.stamp = e.stamp AND y.a = e.v AND y.b = x.b
  JOIN deg ON deg.pair = e.pair AND deg.stamp = e.stamp AND deg.asn = x.b GROUP BY ALL)
SELECT e.pair, e.stamp, avg(coalesce(c, 0) / (p.degree + q.degree - coalesce(c, 0))) AS mean_jaccard, avg(coalesce(aa, 0)) AS mean_adamic_adar
FROM e JOIN deg p ON p.pair = e.pair AND p.stamp = e.stamp AND p.asn = e.u JOIN deg q ON q.pair = e.pair AND q.stamp = e.stamp AND q.asn = e.v
LEFT JOIN cn ON cn.pair = e.pair AND cn.stamp = e.stamp AND cn.u = e.u AND cn.v = e.v GROUP BY ALL""",
    "degree_ccdf": f"WITH {E_SQL}, h AS (SELECT pair, stamp, degree, count(*) AS n FROM deg GROUP BY ALL) SELECT pair, stamp, degree, n, sum(n) OVER (PARTITION BY pair, stamp ORDER BY degree DESC) / sum(n) OVER (PARTITION BY pair, stamp) AS ccdf FROM h",
    "ego_2hop": f"""WITH {E_SQL}, t AS (SELECT DISTINCT pair, stamp, {_TARGET} AS t FROM e),
h AS (SELECT pair, stamp, t AS asn, 0 AS hop FROM t JOIN deg USING (pair, stamp) WHERE deg.asn = t UNION ALL SELECT b.pair, b.stamp, b.b, 1 FROM t JOIN b ON b.pair = t.pair AND b.stamp = t.stamp AND b.a = t.t
  UNION ALL SELECT x.pair, x.stamp, y.b, 2 FROM t JOIN b x ON x.pair = t.pair AND x.stamp = t.stamp AND x.a = t.t JOIN b y ON y.pair = x.pair AND y.stamp = x.stamp AND y.a = x.b)
SELECT pair, stamp, asn, min(hop) AS hop FROM h GROUP BY ALL""",
    "ego_size": f"""WITH {E_SQL}, t AS (SELECT DISTINCT pair, stamp, {_TARGET} AS t FROM e),
n1 AS (SELECT DISTINCT pair, stamp, t AS asn FROM t UNION SELECT b.pair, b.stamp, b.b FROM t JOIN b ON b.pair = t.pair AND b.stamp = t.stamp AND b.a = t.t),
k AS (SELECT b.pair, b.stamp, b.a, count(*) AS degree FROM b JOIN n1 x ON x.pair = b.pair AND x.stamp = b.stamp AND x.asn = b.a JOIN n1 y ON y.pair = b.pair AND y.stamp = b.stamp AND y.asn = b.b GROUP BY ALL)
SELECT pair, stamp, count(*) AS n_nodes, (sum(degree) / 2)::BIGINT AS n_edges, max(degree) AS max_degree, avg(degree) AS avg_degree, sum(degree) / (count(*) * (count(*) - 1)) AS density FROM k GROUP BY ALL HAVING count(*) >= 3""",
    "components": f"""WITH RECURSIVE {E_SQL}, reach(pair, stamp, asn, root) AS (SELECT pair, stamp, asn, asn FROM deg UNION
  SELECT r.pair, r.stamp, b.b, r.root FROM reach r JOIN b ON b.pair = r.pair AND b.stamp = r.stamp AND b.a = r.asn WHERE r.root::VARCHAR < b.b::VARCHAR)
SELECT pair, stamp, asn, min(root::VARCHAR)::BIGINT AS component FROM reach GROUP BY ALL""",
    "pagerank_20": f"""WITH RECURSIVE {E_SQL}, n AS (SELECT pair, stamp, count(*) AS n FROM deg GROUP BY ALL),
pr(i, pair, stamp, asn, x) AS (SELECT 0, pair, stamp, asn, 1 / n FROM deg JOIN n USING (pair, stamp) UNION ALL
  SELECT i + 1, pair, stamp, a, 0.15 / any_value(n) + 0.85 * sum(x / degree) FROM (SELECT pr.i, pr.pair, pr.stamp, b.b AS a, pr.x, deg.degree, n.n FROM pr JOIN deg ON deg.pair = pr.pair AND deg.stamp = pr.stamp AND deg.asn = pr.asn
    JOIN n ON n.pair = pr.pair AND n.stamp = pr.stamp JOIN b ON b.pair = pr.pair AND b.stamp = pr.stamp AND b.a = pr.asn WHERE i < 20) GROUP BY i, pair, stamp, a)
SELECT pair, stamp, asn, x AS pagerank FROM pr WHERE i = 20""",
    "live_edges_per_window": _LIVE + "SELECT * FROM live",
    "edge_churn": _LIVE + """, wn AS (SELECT *, row_number() OVER (PARTITION BY collector, segment ORDER BY w) AS i FROM wins), ln AS (SELECT l.collector, l.segment, l.u, l.v, wn.i FROM live l JOIN wn USING (collector, segment, w)),
born AS (SELECT collector, segment, u, v, i FROM ln ANTI JOIN (SELECT collector, segment, u, v, i + 1 AS i FROM ln) USING (collector, segment, u, v, i)),
gone AS (SELECT collector, segment, u, v, i FROM (SELECT collector, segment, u, v, i + 1 AS i FROM ln) ANTI JOIN ln USING (collector, segment, u, v, i)),
ch AS (SELECT collector, segment, i, 1 AS a, 0 AS r FROM born UNION ALL SELECT collector, segment, i, 0, 1 FROM gone)
SELECT collector, w, sum(a)::BIGINT AS edges_added, sum(r)::BIGINT AS edges_removed FROM ch JOIN wn USING (collector, segment, i) GROUP BY ALL""",
    "topology_counters": _LIVE + """, eb AS (SELECT collector, segment, type, lag(type) OVER (PARTITION BY collector, segment, peer_as, prefix ORDER BY ts, seq) AS before FROM lg WHERE type = 'W' OR (type = 'A' AND len(path) >= 2)),
ap AS (SELECT collector, segment, count(*) FILTER (type = 'A') AS ann_applied, count(*) FILTER (type = 'W' AND before = 'A') AS wd_applied, count(*) FILTER (type = 'A' AND before = 'A') AS replaced FROM eb GROUP BY ALL)
SELECT collector, segment, count(*) FILTER (type = 'A' AND len(path) < 2) AS ann_ignored, coalesce(any_value(ann_applied), 0) AS ann_applied, coalesce(any_value(wd_applied), 0) AS wd_applied, coalesce(any_value(replaced), 0) AS replaced FROM lg LEFT JOIN ap USING (collector, segment) GROUP BY ALL""",
    "component_sizes": f"""WITH RECURSIVE {E_SQL}, reach(pair, stamp, asn, root) AS (SELECT pair, stamp, asn, asn FROM deg UNION
  SELECT r.pair, r.stamp, b.b, r.root FROM reach r JOIN b ON b.pair = r.pair AND b.stamp = r.stamp AND b.a = r.asn WHERE r.root::VARCHAR < b.b::VARCHAR),
c AS (SELECT pair, stamp, asn, min(root::VARCHAR) AS component FROM reach GROUP BY ALL), k AS (SELECT pair, stamp, component, count(*) AS n FROM c GROUP BY ALL),
z AS (SELECT pair, stamp, sum(n)::BIGINT AS n_nodes_full, count(*) AS n_components, max(n) AS lcc_nodes, max(n) / sum(n) AS lcc_fraction FROM k GROUP BY ALL), t AS (SELECT pair, stamp, degree AS target_degree_full FROM deg WHERE asn = {_TARGET})
SELECT z.*, target_degree_full FROM z LEFT JOIN t USING (pair, stamp)""",
    "topology_evolution": _LIVE
    + """, nn AS (SELECT collector, w, count(DISTINCT x) AS n_nodes FROM (SELECT collector, w, unnest([u, v]) AS x FROM live) GROUP BY ALL)
SELECT l.collector, l.w, count(*) AS n_edges, sum(refs)::BIGINT AS references, any_value(n_nodes) AS n_nodes FROM live l JOIN nn USING (collector, w) GROUP BY ALL""".replace("AS references", 'AS "references"'),
}
