"""The statistical view: features of each window of the update stream.

All windows are computed at once, in grouped passes keyed by (keys, window): flat conditional aggregates,
sub-aggregates by prefix, by (prefix, peer) and by identical announcement, and path passes. Each pass
combines map-side and shuffles partial states; a window that holds most rows arrives as a few of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.paths import edit_distance, origin_as

HISTOGRAM = 7


def ratio(n: Column, d: Column) -> Column:
    """n / d, 0 where d is 0 or null."""
    return F.when(F.coalesce(d, F.lit(0)) == 0, F.lit(0.0)).otherwise(n / d)


def _announced(log: DataFrame) -> DataFrame:
    return log.filter("type = 'A'")


def _valid(log: DataFrame) -> DataFrame:
    return _announced(log).filter(F.size("path") > 0)


def volumes(log: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates. Rates divide by the observed span in seconds, at least 1, not by the window's length."""
    a, wd = F.count_if(F.col("type") == "A"), F.count_if(F.col("type") == "W")
    span = F.greatest((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / F.lit(1e6), F.lit(1.0))
    out = log.groupBy(*keys).agg(
        a.alias("announcements"), wd.alias("withdrawals"), F.count(F.lit(1)).alias("total_updates"),
        (a / span).alias("ann_rate"), (wd / span).alias("wd_rate"),
        F.count_if((F.col("type") == "A") & (F.col("origin") == "IGP")).alias("origin_IGP"),
        F.count_if((F.col("type") == "A") & (F.col("origin") == "INCOMPLETE")).alias("origin_INCOMPLETE"),
        F.count_if(F.contains(F.col("prefix"), F.lit("/32"))).alias("_slash32"),
    )
    out = out.withColumns({"wd_ann_ratio": ratio(F.col("withdrawals"), F.col("announcements")), "ann_wd_ratio": ratio(F.col("announcements"), F.col("withdrawals"))})
    return out.withColumn("nadas", F.col("_slash32") + F.when(F.col("wd_ann_ratio") > 0.5, 10).otherwise(0)).drop("_slash32")


def peers(log: DataFrame, keys: list[str]) -> DataFrame:
    return log.groupBy(*keys, "peer_as").agg(F.lit(1).alias("_x")).groupBy(*keys).agg(F.count(F.lit(1)).alias("unique_peers"))


def prefixes(log: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct prefixes announced and withdrawn, flaps (both) and origin changes (several ORIGIN values)."""
    by_prefix = log.groupBy(*keys, "prefix").agg(
        F.bool_or(F.col("type") == "A").alias("_a"), F.bool_or(F.col("type") == "W").alias("_w"),
        F.min(F.when(F.col("type") == "A", F.col("origin"))).alias("_o1"), F.max(F.when(F.col("type") == "A", F.col("origin"))).alias("_o2"),
    )
    return by_prefix.groupBy(*keys).agg(
        F.count_if("_a").alias("unique_prefixes_ann"), F.count_if("_w").alias("unique_prefixes_wd"),
        F.count_if(F.col("_a") & F.col("_w")).alias("flaps"), F.count_if(F.col("_o1") != F.col("_o2")).alias("origin_changes"),
    )


def new_prefixes(log: DataFrame, keys: list[str], window: str = "w", segment: str | None = None) -> DataFrame:
    """Announced prefixes that the window before, of those that are not empty, neither announced nor withdrew.

    0 for the first window, and for the first of a segment that does not follow on the one before.
    """
    group = [k for k in keys if k != window]
    order = Window.partitionBy(*group, *([segment] if segment else [])).orderBy(window)
    extra = [segment] if segment else []
    windows = log.select(*keys, *extra).distinct().withColumn("_no", F.row_number().over(order))
    seen = log.groupBy(*keys, *extra, "prefix").agg(F.bool_or(F.col("type") == "A").alias("_a")).join(windows, [*keys, *extra])
    # a prefix's own windows in order: it is new unless its last appearance was in the window just before
    last = F.lag("_no").over(Window.partitionBy(*group, *extra, "prefix").orderBy("_no"))
    fresh = seen.withColumn("_new", F.col("_a") & (F.col("_no") > 1) & ~F.coalesce(last == F.col("_no") - 1, F.lit(False)))
    return fresh.groupBy(*keys).agg(F.count_if("_new").alias("new_prefixes"))


def duplicates(log: DataFrame, keys: list[str]) -> DataFrame:
    same = ["peer_ip", "peer_as", "prefix", "_p", "origin", "next_hop"]
    groups = _announced(log).withColumn("_p", F.array_join(F.col("path").cast("array<string>"), " ")).groupBy(*keys, *same).agg(F.count(F.lit(1)).alias("_n"))
    return groups.groupBy(*keys).agg(F.sum(F.col("_n") - 1).alias("dups"))


def path_lengths(log: DataFrame, keys: list[str]) -> DataFrame:
    """Length statistics of valid paths; the deviation has ddof 1 and is 0 for one path."""
    n = F.size("path").cast("double")
    return _valid(log).groupBy(*keys).agg(
        F.avg(n).alias("as_path_avg"), F.max(n).cast("bigint").alias("as_path_max"), F.coalesce(F.stddev_samp(n), F.lit(0.0)).alias("as_path_std")
    )


def distinct_paths(log: DataFrame, keys: list[str]) -> DataFrame:
    by_path = _valid(log).groupBy(*keys, "prefix", "path").agg(F.lit(1).alias("_x"))
    return by_path.groupBy(*keys, "prefix").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.max("_n").alias("unique_as_path_max"))


def path_edits(log: DataFrame, keys: list[str]) -> DataFrame:
    """Edit distances between successive paths of a prefix within a window, over all its peers."""
    order = Window.partitionBy(*keys, "prefix").orderBy("ts", "seq")
    d = _valid(log).withColumn("_before", F.lag("path").over(order)).filter("_before is not null")
    d = d.withColumn("_d", edit_distance(F.col("_before"), F.col("path")))
    by_prefix = d.groupBy(*keys, "prefix").agg(
        F.sum("_d").alias("_sum"), F.count(F.lit(1)).alias("_n"), F.max("_d").alias("_max"), *[F.count_if(F.col("_d") == i).alias(f"_{i}") for i in range(HISTOGRAM)]
    )
    return by_prefix.groupBy(*keys).agg(
        (F.sum("_sum") / F.sum("_n")).alias("edit_distance_avg"), F.max("_max").cast("bigint").alias("edit_distance_max"),
        *[F.sum(f"_{i}").alias(f"edit_distance_dict_{i}") for i in range(HISTOGRAM)],
        *[F.count_if(F.col(f"_{i}") > 0).alias(f"edit_distance_unique_dict_{i}") for i in range(2)],
    )


def rare_ases(log: DataFrame, keys: list[str], threshold: int = 3) -> DataFrame:
    counts = _valid(log).select(*keys, F.explode("path").alias("_as")).groupBy(*keys, "_as").agg(F.count(F.lit(1)).alias("_n"))
    rare = F.count_if(F.col("_n") < threshold)
    return counts.groupBy(*keys).agg(rare.alias("number_rare_ases"), (rare / F.sum("_n")).alias("rare_ases_ratio"))


def implicit_withdrawals(log: DataFrame, keys: list[str]) -> DataFrame:
    """(prefix, peer_ip) groups with several announcements, by whether their paths are all the same."""
    text = F.array_join(F.col("path").cast("array<string>"), " ")
    groups = _announced(log).groupBy(*keys, "prefix", "peer_ip").agg(F.count(F.lit(1)).alias("_n"), F.min(text).alias("_p1"), F.max(text).alias("_p2"))
    many = F.col("_n") > 1
    return groups.groupBy(*keys).agg(
        F.count_if(many).alias("imp_wd"), F.count_if(many & (F.col("_p1") == F.col("_p2"))).alias("imp_wd_spath"), F.count_if(many & (F.col("_p1") != F.col("_p2"))).alias("imp_wd_dpath")
    )


def stat_view(log: DataFrame, keys: list[str], rare_threshold: int = 3) -> DataFrame:
    """All 37 features of each window; what a window has nothing for is 0."""
    base = volumes(log, keys)
    parts = [
        peers(log, keys), prefixes(log, keys), new_prefixes(log, keys), duplicates(log, keys), path_lengths(log, keys),
        distinct_paths(log, keys), path_edits(log, keys), rare_ases(log, keys, rare_threshold), implicit_withdrawals(log, keys),
    ]
    return reduce(lambda left, right: left.join(right, keys, "left"), parts, base).na.fill(0)


def ego_filter(log: DataFrame, ego: DataFrame, target: int, group: list[str], rule: str = "origin_or_target") -> DataFrame:
    """The updates that touch a target's ego network; ego has (group, asn).

    origin_or_target: the path's origin is in the ego network, the target is on the path, or it is a
    withdrawal of a peer in the network. any_hop: any number of the path is in it. Semi joins, whatever the
    network's size.
    """
    nodes = ego.select(*group, F.col("asn").cast("string").alias("_asn")).distinct()
    tagged = log.withColumn("_id", F.col("seq"))
    if rule == "any_hop":
        hops = tagged.select(*group, "_id", F.explode("path").alias("_hop")).withColumn("_asn", F.col("_hop").cast("string"))
    elif rule == "origin_or_target":
        checks = F.array_compact(F.array(F.when(F.col("type") == "A", origin_as(F.col("path"))), F.when(F.col("type") == "W", F.col("peer_as"))))
        hops = tagged.select(*group, "_id", F.explode(checks).alias("_asn"))
    else:
        raise ValueError(f"no such rule: {rule}")
    ids = hops.join(nodes, [*group, "_asn"], "left_semi").select(*group, "_id")
    if rule == "origin_or_target":
        ids = ids.union(tagged.filter(F.array_contains("path", target)).select(*group, "_id"))
    return tagged.join(ids.distinct(), [*group, "_id"], "left_semi").drop("_id")


def ego_filter_ratio(log: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    total = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    part = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("kept"))
    return total.join(part, keys, "left").select(*keys, ratio(F.coalesce("kept", F.lit(0)), F.col("total")).alias("ego_filter_ratio"))


def align_views(graph: DataFrame, node: DataFrame, stat: DataFrame, keys: list[str]) -> DataFrame:
    """graph left-joined with node and stat on the window keys; columns that already exist are dropped."""
    out = graph
    for right in (node, stat):
        fresh = [c for c in right.columns if c not in out.columns]
        out = out.join(right.select(*keys, *fresh), keys, "left")
    return out


