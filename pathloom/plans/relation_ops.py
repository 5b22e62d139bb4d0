"""Queries on relationships and exchange memberships.

The tables hold neither, so both follow from the AS numbers by a fixed rule: pairs whose sum is a multiple
of 7 are unknown, of 3 peers; of other pairs the smaller number is the provider. A network is a member of
exchange asn % 7, and of 100 + asn % 11 if even.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators import graph as g
from pathloom.operators import relations as r
from pathloom.plans.graph_ops import E_SQL, KEYS, _targets, snapshot_edges
from pathloom.plans.stream_ops import TARGET, UPDATES_SQL, _ego
from pathloom.sources.updates import read_updates


def _relations_of(pairs: DataFrame) -> DataFrame:
    total = F.col("u") + F.col("v")
    kinds = pairs.select("u", "v").distinct().filter(total % 7 != 0)
    return r.both_directions(kinds.select(F.col("u").alias("as1"), F.col("v").alias("as2"), F.when(total % 3 == 0, 0).otherwise(-1).alias("rel")))


def _memberships_of(nodes: DataFrame) -> DataFrame:
    exchanges = F.array_compact(F.array((F.col("asn") % 7).cast("bigint"), F.when(F.col("asn") % 2 == 0, 100 + F.col("asn") % 11)))
    return nodes.select("asn", F.explode(exchanges).alias("ix_id")).distinct()


def _snapshots(spark: SparkSession, d: str):
    e = snapshot_edges(spark, d)
    nodes = g.degrees(e, KEYS).select("asn").distinct()
    return e, _relations_of(e), _memberships_of(nodes), nodes


def relationship_coverage(spark: SparkSession, d: str) -> DataFrame:
    e, relations, _, _ = _snapshots(spark, d)
    return r.relation_coverage(e, KEYS, relations)


def edge_typing(spark: SparkSession, d: str) -> DataFrame:
    e, relations, _, _ = _snapshots(spark, d)
    return r.typed_edges(e, KEYS, relations)


def node_relationship_profile(spark: SparkSession, d: str) -> DataFrame:
    e, relations, _, nodes = _snapshots(spark, d)
    return r.node_profile(e, KEYS, relations, nodes.filter("asn % 500 = 0"), nodes.filter("asn % 400 = 1"))


def set_counts(spark: SparkSession, d: str) -> DataFrame:
    """Members of the clique and of the exchange list in each snapshot."""
    return node_relationship_profile(spark, d).groupBy(*KEYS).agg(F.sum("is_tier1").cast("bigint").alias("n_tier1_in_subgraph"), F.sum("is_ixp").cast("bigint").alias("n_ixp_in_subgraph"))


def without_exchanges(spark: SparkSession, d: str) -> DataFrame:
    e, _, _, nodes = _snapshots(spark, d)
    return g.without_nodes(e, nodes.filter("asn % 10 = 1")).select(*KEYS, "u", "v")


def _paths(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    log = read_updates(spark, d).filter("type = 'A'").select("seq", "collector", "w", "path")
    hops = log.filter(F.size("path") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.least(F.get("path", i - 1), F.get("path", i)).alias("u"), F.greatest(F.get("path", i - 1), F.get("path", i)).alias("v")))).alias("e"))
    return log, _relations_of(hops.select("e.u", "e.v"))


def valley_free_paths(spark: SparkSession, d: str) -> DataFrame:
    log, relations = _paths(spark, d)
    return r.path_checks(log.select("seq", "path"), relations).select("seq", "valid", F.col("violation").cast("bigint").alias("violation"), F.col("known").cast("bigint").alias("known"))


def vf_rates(spark: SparkSession, d: str) -> DataFrame:
    log, relations = _paths(spark, d)
    return r.valley_free_rates(r.path_checks(log.select("collector", "path"), relations), ["collector"])


def ego_vf_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of the paths through the target's ego network, beside all; and violations by the target's role.

    Each path counts once for every scope it is in (all, the ego network, its target's role), in one aggregate; the
    network's nodes, at most the target's neighbours, are broadcast.
    """
    log, relations = _paths(spark, d)
    hops = log.select("seq", "collector", F.explode("path").alias("asn"))
    near = hops.join(F.broadcast(_ego(log)), ["collector", "asn"], "left_semi").select("seq").distinct().withColumn("near", F.lit(True))
    checks = r.path_checks(log.select("seq", "collector", "path"), relations).withColumn("role", r.target_role(F.col("path"), TARGET)).join(near, "seq", "left")
    scopes = F.array_compact(F.array(F.lit("all"), F.when(F.col("near"), F.lit("ego")), F.when(F.col("near"), F.col("role"))))
    rates = r.valley_free_rates(checks.withColumn("scope", F.explode(scopes)), ["collector", "scope"])
    of = lambda scope, c: F.max(F.when(F.col("scope") == scope, F.col(c)))
    measures = [c for c in rates.columns if c not in ("collector", "scope")]
    bad = [F.coalesce(of(role, "valley_free_violations"), F.lit(0)).alias(f"ego_{role}_violations") for role in ("transit", "origin")]
    bad.append(of("transit", "valley_free_rate").alias("ego_transit_vf_rate"))
    wide = rates.groupBy("collector").agg(*[of("all", c).alias(c) for c in measures], *[of("ego", c).alias(f"ego_{c}") for c in measures], *bad)
    return r.ego_differences(wide)


def ixp_vectors(spark: SparkSession, d: str) -> DataFrame:
    e, _, m, _ = _snapshots(spark, d)
    return r.exchange_vectors(e, KEYS, m)


def edge_ixp_cosine(spark: SparkSession, d: str) -> DataFrame:
    e, _, m, _ = _snapshots(spark, d)
    return r.edge_cosine(e, KEYS, m)


def edge_ixp_stats(spark: SparkSession, d: str) -> DataFrame:
    return r.edge_cosine_stats(edge_ixp_cosine(spark, d), KEYS)


def node_ixp_cosine(spark: SparkSession, d: str) -> DataFrame:
    e, _, m, _ = _snapshots(spark, d)
    return r.node_cosine(e, KEYS, m)


def target_node_rows(spark: SparkSession, d: str) -> DataFrame:
    """The target's own row of each snapshot: degree, clustering and exchange features."""
    e, _, m, _ = _snapshots(spark, d)
    node = g.node_clustering(e, KEYS).join(r.node_cosine(e, KEYS, m), [*KEYS, "asn"], "left")
    return node.join(_targets(spark, d), [*KEYS, "asn"], "left_semi")


QUERIES = {
    f.__name__: f
    for f in (
        relationship_coverage, edge_typing, node_relationship_profile, set_counts, without_exchanges, valley_free_paths, vf_rates, ego_vf_rates, ixp_vectors, edge_ixp_cosine, edge_ixp_stats, node_ixp_cosine, target_node_rows,
    )
}

_REL = "CASE WHEN (a + b) % 7 = 0 THEN NULL WHEN (a + b) % 3 = 0 THEN 0 WHEN a < b THEN -1 ELSE 1 END"
_B = f"WITH {E_SQL}, br AS MATERIALIZED (SELECT *, {_REL} AS rel FROM b), er AS MATERIALIZED (SELECT pair, stamp, u AS a, v AS b, (SELECT 1) AS one, {_REL.replace('a + b', 'u + v').replace('a < b', 'u < v')} AS rel FROM e)"
_IX = f"""WITH {E_SQL}, nodes AS (SELECT DISTINCT asn FROM deg), mem AS (SELECT DISTINCT asn, unnest(CASE WHEN asn % 2 = 0 THEN [asn % 7, 100 + asn % 11] ELSE [asn % 7] END) AS ix_id FROM nodes),
vec AS MATERIALIZED (SELECT pair, stamp, b.a AS asn, ix_id, count(*) AS n FROM b JOIN mem ON mem.asn = b.b GROUP BY ALL), nrm AS MATERIALIZED (SELECT pair, stamp, asn, sqrt(sum(n * n)) AS norm FROM vec GROUP BY ALL),
dots AS (SELECT e.pair, e.stamp, u, v, sum(x.n * y.n) AS dot FROM e JOIN vec x ON x.pair = e.pair AND x.stamp = e.stamp AND x.asn = u JOIN vec y ON y.pair = e.pair AND y.stamp = e.stamp AND y.asn = v AND y.ix_id = x.ix_id GROUP BY ALL),
ec AS MATERIALIZED (SELECT e.pair, e.stamp, e.u, e.v, CASE WHEN p.norm IS NULL OR q.norm IS NULL THEN -1 ELSE 1 - coalesce(dot, 0) / (p.norm * q.norm) END AS ixp_cosine_dist FROM e LEFT JOIN dots USING (pair, stamp, u, v)
  LEFT JOIN nrm p ON p.pair = e.pair AND p.stamp = e.stamp AND p.asn = e.u LEFT JOIN nrm q ON q.pair = e.pair AND q.stamp = e.stamp AND q.asn = e.v)"""
_PATHS = f"""WITH RECURSIVE {UPDATES_SQL}, pa AS (SELECT seq, collector, path FROM u WHERE type = 'A' AND len(path) >= 2),
hops AS (SELECT seq, i, a, b FROM (SELECT seq, unnest(range(len(path) - 1)) AS i, unnest(path[:-2]) AS a, unnest(path[2:]) AS b FROM pa)),
hr AS (SELECT seq, i, {_REL} AS rel FROM hops), kn AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY i) AS k, max(CASE WHEN rel IN (0, -1) THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over_ FROM hr WHERE rel IS NOT NULL),
vi AS (SELECT seq, min(i) FILTER (rel IN (0, 1) AND over_ = 1) AS violation, min(k) FILTER (rel IN (0, 1) AND over_ = 1) AS vk, count(*) AS n FROM kn GROUP BY ALL),
chk AS MATERIALIZED (SELECT pa.seq, collector, vi.violation IS NULL AS valid, vi.violation, coalesce(vk, n, 0)::BIGINT AS known, len(path) - 1 AS n_hops FROM pa LEFT JOIN vi ON vi.seq = pa.seq)"""

ORACLE = {
    "relationship_coverage": _B + """ SELECT pair, stamp, round(count(rel) / count(*), 4) AS rel_coverage, round(count(*) FILTER (rel <> 0) / count(*), 4) AS frac_p2c, round(count(*) FILTER (rel = 0) / count(*), 4) AS frac_p2p,
  round(count(*) FILTER (rel IS NULL) / count(*), 4) AS frac_unknown_edges FROM er GROUP BY ALL""",
    "edge_typing": _B + " SELECT pair, stamp, a AS source, b AS target, CASE rel WHEN 0 THEN 'p2p' WHEN -1 THEN 'p2c' WHEN 1 THEN 'c2p' ELSE 'unknown' END AS type FROM br",
    "node_relationship_profile": _B
    + """ SELECT pair, stamp, a AS asn, count(*) FILTER (rel = 1) AS n_providers, count(*) FILTER (rel = -1) AS n_customers, count(*) FILTER (rel = 0) AS n_peers, count(*) FILTER (rel IS NULL) AS n_unknown_rel,
  round(count(*) FILTER (rel = 1) / count(*), 4) AS provider_ratio, round(count(*) FILTER (rel = -1) / count(*), 4) AS customer_ratio, round(count(*) FILTER (rel = 0) / count(*), 4) AS peer_ratio,
  (a % 500 = 0)::INT AS is_tier1, (a % 400 = 1)::INT AS is_ixp FROM br GROUP BY ALL""",
    "set_counts": _B + " SELECT pair, stamp, count(*) FILTER (asn % 500 = 0) AS n_tier1_in_subgraph, count(*) FILTER (asn % 400 = 1) AS n_ixp_in_subgraph FROM deg GROUP BY ALL",
    "without_exchanges": f"WITH {E_SQL} SELECT pair, stamp, u, v FROM e WHERE u % 10 <> 1 AND v % 10 <> 1",
    "valley_free_paths": _PATHS + " SELECT seq, valid, violation, known FROM chk",
    "vf_rates": _PATHS
    + """ SELECT collector, count(*) FILTER (known > 0 AND NOT valid) AS valley_free_violations, round(count(*) FILTER (known > 0 AND NOT valid) / count(*) FILTER (known > 0), 6) AS valley_free_rate, count(*) FILTER (known > 0) AS paths_checked,
  round(avg(violation / n_hops), 4) AS avg_violation_depth, round(max(violation / n_hops), 4) AS max_violation_depth, count(*) AS paths_total FROM chk GROUP BY ALL""",
    "ixp_vectors": _IX + " SELECT * FROM vec",
    "edge_ixp_cosine": _IX + " SELECT * FROM ec",
    "edge_ixp_stats": _IX
    + """, c AS (SELECT pair, stamp, CASE WHEN ixp_cosine_dist >= -1e-9 THEN ixp_cosine_dist END AS c FROM ec) SELECT pair, stamp, round(avg(c), 6) AS avg_edge_ixp_cosine_dist, round(median(c), 6) AS median_edge_ixp_cosine_dist,
  round(stddev_pop(c), 6) AS std_edge_ixp_cosine_dist, count(c) AS n_edges_with_ixp, count(*) - count(c) AS n_edges_missing_ixp FROM c GROUP BY ALL""",
    "node_ixp_cosine": _IX
    + """, om AS (SELECT asn, count(*) AS k FROM mem GROUP BY ALL), av AS (SELECT pair, stamp, asn, avg(c) AS c FROM (SELECT pair, stamp, unnest([u, v]) AS asn, ixp_cosine_dist AS c FROM ec WHERE ixp_cosine_dist >= -1e-9) GROUP BY ALL)
SELECT deg.pair, deg.stamp, deg.asn, coalesce(k, 0) AS n_ixp_memberships, coalesce(norm, 0) AS ixp_vector_norm, av.c AS avg_ixp_cosine_dist FROM deg LEFT JOIN om USING (asn) LEFT JOIN nrm USING (pair, stamp, asn) LEFT JOIN av USING (pair, stamp, asn)""",
}
