"""Business relationships and exchange memberships over graphs and paths.

relationships: (a, b, rel) in both directions, rel +1 for customer to provider, -1 provider to customer, 0 peers.
memberships: distinct (asn, ix_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.paths import valley_free
from pathloom.operators.graph import both_ways


def both_directions(relations: DataFrame) -> DataFrame:
    """(as1, as2, rel) with rel -1 (as1 is as2's provider) or 0, as seen from either end; other codes go."""
    known = relations.filter(F.col("rel").isin(-1, 0))
    down = known.select(F.col("as1").alias("a"), F.col("as2").alias("b"), F.col("rel").cast("int").alias("rel"))
    return down.union(known.select(F.col("as2").alias("a"), F.col("as1").alias("b"), (-F.col("rel")).cast("int").alias("rel"))).dropDuplicates(["a", "b"])


def edge_relations(edges: DataFrame, keys: list[str], relations: DataFrame) -> DataFrame:
    """Each edge with its relationship as seen from u, null if unknown."""
    r = relations.select(F.col("a").alias("u"), F.col("b").alias("v"), "rel")
    return edges.join(r, ["u", "v"], "left").select(*keys, "u", "v", "rel")


def relation_coverage(edges: DataFrame, keys: list[str], relations: DataFrame) -> DataFrame:
    e = edge_relations(edges, keys, relations)
    share = lambda c: F.round(F.count_if(c) / F.count(F.lit(1)), 4)
    return e.groupBy(*keys).agg(
        share(F.col("rel").isNotNull()).alias("rel_coverage"), share(F.coalesce(F.col("rel") != 0, F.lit(False))).alias("frac_p2c"),
        share(F.coalesce(F.col("rel") == 0, F.lit(False))).alias("frac_p2p"), share(F.col("rel").isNull()).alias("frac_unknown_edges"),
    )


def typed_edges(edges: DataFrame, keys: list[str], relations: DataFrame) -> DataFrame:
    """Typed directed edges: peers and unknown both ways, p2c with c2p the other way."""
    e = edge_relations(edges, keys, relations)
    two = lambda kind: F.array(F.struct(F.col("u").alias("s"), F.col("v").alias("t"), F.lit(kind).alias("k")), F.struct(F.col("v").alias("s"), F.col("u").alias("t"), F.lit(kind).alias("k")))
    down = lambda s, t: F.array(F.struct(F.col(s).alias("s"), F.col(t).alias("t"), F.lit("p2c").alias("k")), F.struct(F.col(t).alias("s"), F.col(s).alias("t"), F.lit("c2p").alias("k")))
    kinds = F.when(F.col("rel") == 0, two("p2p")).when(F.col("rel") == -1, down("u", "v")).when(F.col("rel") == 1, down("v", "u")).otherwise(two("unknown"))
    return e.select(*keys, F.explode(kinds).alias("x")).select(*keys, F.col("x.s").alias("source"), F.col("x.t").alias("target"), F.col("x.k").alias("type"))


def node_profile(edges: DataFrame, keys: list[str], relations: DataFrame, clique: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Providers, customers, peers and unknown neighbours of each node, their shares, and set memberships."""
    pairs = both_ways(edges, keys).join(relations, ["a", "b"], "left")
    n = F.count(F.lit(1))
    counts = pairs.groupBy(*keys, F.col("a").alias("asn")).agg(
        F.count_if(F.col("rel") == 1).alias("n_providers"), F.count_if(F.col("rel") == -1).alias("n_customers"), F.count_if(F.col("rel") == 0).alias("n_peers"), F.count_if(F.col("rel").isNull()).alias("n_unknown_rel"),
        *[F.round(F.count_if(F.col("rel") == r) / n, 4).alias(name) for r, name in ((1, "provider_ratio"), (-1, "customer_ratio"), (0, "peer_ratio"))],
    )
    for name, listed in (("is_tier1", clique), ("is_ixp", exchanges)):
        counts = counts.join(listed.select("asn", F.lit(1).alias(name)).distinct(), "asn", "left").na.fill(0, [name])
    return counts


def path_checks(paths: DataFrame, relations: DataFrame) -> DataFrame:
    """The rows whose path has two or more numbers, with the valley-free check of its hops (valid, violation, known) and
    n_hops beside their own columns. A path is taken apart and looked up once, however many rows have it."""
    rows = paths.filter(F.size("path") >= 2).withColumn("_text", F.array_join(F.col("path").cast("array<string>"), " "))
    pair = lambda i: F.struct(F.get("path", i - 1).alias("a"), F.get("path", i).alias("b"))
    once = rows.groupBy("_text").agg(F.count(F.lit(1)).alias("_n")).select("_text", F.split("_text", " ").cast("array<bigint>").alias("path"))
    hops = once.select("_text", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), pair)).alias("i", "hop"))
    known = hops.select("_text", "i", "hop.a", "hop.b").join(relations, ["a", "b"], "left")
    lists = known.groupBy("_text").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "rel"))), lambda x: x.rel).alias("hops"))  # a path's hops
    checked = lists.withColumn("c", valley_free(F.col("hops"))).select("_text", "c.*", F.size("hops").alias("n_hops"))
    return rows.join(checked, "_text").drop("_text")


def valley_free_rates(checks: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    """Violations among the paths with a known hop; depth is the violating hop's index over the hops."""
    seen, bad = F.col("known") > 0, (F.col("known") > 0) & ~F.col("valid")
    n = F.count_if(seen)
    depth = F.when(bad, F.col("violation") / F.col("n_hops"))
    return checks.groupBy(*keys).agg(
        F.count_if(bad).alias(f"{prefix}valley_free_violations"), F.when(n > 0, F.round(F.count_if(bad) / n, 6)).alias(f"{prefix}valley_free_rate"), n.alias(f"{prefix}paths_checked"),
        F.round(F.avg(depth), 4).alias(f"{prefix}avg_violation_depth"), F.round(F.max(depth), 4).alias(f"{prefix}max_violation_depth"), F.count(F.lit(1)).alias(f"{prefix}paths_total"),
    )


def ego_rates(whole: DataFrame, ego: DataFrame, keys: list[str]) -> DataFrame:
    """Ego-scoped rates beside the global ones; the difference is that of the rounded rates."""
    return ego_differences(whole.join(ego, keys, "left"))


def ego_differences(rates: DataFrame) -> DataFrame:
    out = rates.withColumn("vf_rate_delta", F.round(F.col("ego_valley_free_rate") - F.col("valley_free_rate"), 6))
    return out.withColumn("ego_vf_paths_frac", F.when(F.col("paths_checked") > 0, F.round(F.col("ego_paths_checked") / F.col("paths_checked"), 6)))


def target_role(path: Column, target: int) -> Column:
    """'origin' if the target ends the path on either side, 'transit' if it lies inside, else null."""
    end = (F.get(path, F.lit(0)) == target) | (F.get(path, F.size(path) - 1) == target)
    return F.when(end, "origin").when(F.array_contains(path, target), "transit")


def exchange_vectors(edges: DataFrame, keys: list[str], memberships: DataFrame) -> DataFrame:
    """Sparse vectors: for each node and exchange, how many of the node's neighbours are members."""
    m = memberships.select(F.col("asn").alias("b"), "ix_id").distinct()
    return both_ways(edges, keys).join(m, "b").groupBy(*keys, F.col("a").alias("asn"), "ix_id").agg(F.count(F.lit(1)).alias("n"))


def edge_cosine(edges: DataFrame, keys: list[str], memberships: DataFrame) -> DataFrame:
    """Cosine distance of the two ends' exchange vectors, -1 if either is empty."""
    x = exchange_vectors(edges, keys, memberships)
    norms = x.groupBy(*keys, "asn").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    e = edges.select(*keys, "u", "v")
    xu, xv = x.select(*keys, F.col("asn").alias("u"), "ix_id", F.col("n").alias("nu")), x.select(*keys, F.col("asn").alias("v"), "ix_id", F.col("n").alias("nv"))
    dots = e.join(xu, [*keys, "u"]).join(xv, [*keys, "v", "ix_id"]).groupBy(*keys, "u", "v").agg(F.sum(F.col("nu") * F.col("nv")).alias("dot"))
    nu, nv = norms.select(*keys, F.col("asn").alias("u"), F.col("norm").alias("lu")), norms.select(*keys, F.col("asn").alias("v"), F.col("norm").alias("lv"))
    full = e.join(dots, [*keys, "u", "v"], "left").join(nu, [*keys, "u"], "left").join(nv, [*keys, "v"], "left")
    known = F.col("lu").isNotNull() & F.col("lv").isNotNull()
    return full.select(*keys, "u", "v", F.when(known, 1 - F.coalesce("dot", F.lit(0)) / (F.col("lu") * F.col("lv"))).otherwise(-1.0).alias("ixp_cosine_dist"))


def edge_cosine_stats(cosines: DataFrame, keys: list[str]) -> DataFrame:
    c = F.when(F.col("ixp_cosine_dist") >= -1e-9, F.col("ixp_cosine_dist"))
    return cosines.groupBy(*keys).agg(
        F.round(F.avg(c), 6).alias("avg_edge_ixp_cosine_dist"), F.round(F.median(c), 6).alias("median_edge_ixp_cosine_dist"), F.round(F.stddev_pop(c), 6).alias("std_edge_ixp_cosine_dist"),
        F.count(c).alias("n_edges_with_ixp"), (F.count(F.lit(1)) - F.count(c)).alias("n_edges_missing_ixp"),
    )


def node_cosine(edges: DataFrame, keys: list[str], memberships: DataFrame) -> DataFrame:
    """Own memberships, vector norm and mean cosine distance to neighbours of each node."""
    x = exchange_vectors(edges, keys, memberships)
    norms = x.groupBy(*keys, "asn").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("ixp_vector_norm"))
    own = memberships.distinct().groupBy("asn").agg(F.count(F.lit(1)).alias("n_ixp_memberships"))
    c = edge_cosine(edges, keys, memberships).filter("ixp_cosine_dist >= -1e-9")
    near = c.select(*keys, F.explode(F.array("u", "v")).alias("asn"), "ixp_cosine_dist").groupBy(*keys, "asn").agg(F.avg("ixp_cosine_dist").alias("avg_ixp_cosine_dist"))
    nodes = both_ways(edges, keys).select(*keys, F.col("a").alias("asn")).distinct()
    return nodes.join(own, "asn", "left").join(norms, [*keys, "asn"], "left").join(near, [*keys, "asn"], "left").na.fill(0, ["n_ixp_memberships"]).na.fill(0.0, ["ixp_vector_norm"])
