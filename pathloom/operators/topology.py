"""The evolving topology as signed edge deltas.

The state of a segment is what its (peer_as, prefix) paths use. Each announcement of two or more numbers
replaces the key's path, a withdrawal removes it, shorter announcements change nothing. So a path lives
from its window to the next such event's; its edges count +1 and -1 there, and a running sum over the
windows of an edge gives its reference count: the edge lives while that is positive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.paths import path_edges
from pathloom.operators.grid import MICRO, floor_time

SEGMENT_SECONDS = 28_800


def with_segment(log: DataFrame, seconds: int = SEGMENT_SECONDS) -> DataFrame:
    return log.withColumn("segment", floor_time(F.col("ts"), seconds))


def rib_as_log(rib: DataFrame) -> DataFrame:
    """Snapshot rows (collector, segment, peer_as, prefix, path) as announcements before a segment's first update."""
    return rib.select("collector", "segment", F.col("segment").alias("ts"), F.col("segment").alias("w"), F.lit(-1).cast("bigint").alias("seq"), F.lit("A").alias("type"), "peer_as", "prefix", "path")


def path_lives(log: DataFrame, group: list[str]) -> DataFrame:
    """Each effective announcement with its window `w` and the window `until` in which it ends (null: never)."""
    effective = log.filter((F.col("type") == "W") | ((F.col("type") == "A") & (F.size("path") >= 2)))
    order = Window.partitionBy(*group, "segment", "peer_as", "prefix").orderBy("ts", "seq")
    return effective.withColumn("until", F.lead("w").over(order)).filter("type = 'A'")


def edge_deltas(lives: DataFrame, group: list[str]) -> DataFrame:
    """Change of each edge's reference count by window, summed before any window function; zeros dropped."""
    paths = lives.filter("until is null or until > w").withColumn("e", F.explode(F.array_distinct(path_edges(F.col("path")))))
    ends = F.array_compact(F.array(F.struct("w", F.lit(1).alias("x")), F.when(F.col("until").isNotNull(), F.struct(F.col("until").alias("w"), F.lit(-1).alias("x")))))
    deltas = paths.select(*group, "segment", F.col("e.u").alias("u"), F.col("e.v").alias("v"), F.explode(ends).alias("d"))
    return deltas.groupBy(*group, "segment", "u", "v", F.col("d.w").alias("w")).agg(F.sum("d.x").alias("delta")).filter("delta <> 0")


def edge_intervals(deltas: DataFrame, group: list[str]) -> DataFrame:
    """Each edge's reference count `refs` from window `w` up to, not including, `until` (null: segment's end)."""
    order = Window.partitionBy(*group, "segment", "u", "v").orderBy("w")
    return deltas.withColumns({"refs": F.sum("delta").over(order), "until": F.lead("w").over(order)}).filter("refs > 0").drop("delta")


def live_edges(log: DataFrame, group: list[str], window_seconds: int = 300, segment_seconds: int = SEGMENT_SECONDS) -> DataFrame:
    """The live edges at the end of each window that has updates: group, segment, w, u, v, refs.

    An edge's interval is expanded over its own windows (96 of five minutes in a segment at most), of which those
    that have updates stay: the join is on (group, segment, window), so a busy segment is spread over its windows.
    """
    windows = log.select(*group, "segment", "w").distinct()
    spans = edge_intervals(edge_deltas(path_lives(log, group), group), group)
    step, begin = F.lit(window_seconds * MICRO), F.unix_micros("w")
    end = F.coalesce(F.unix_micros("until"), F.unix_micros("segment") + F.lit(segment_seconds * MICRO))
    at = F.transform(F.sequence(F.lit(0).cast("bigint"), ((end - begin - 1) / step).cast("bigint")), lambda i: F.timestamp_micros(begin + i * step))
    held = spans.filter(end > begin).select(*group, "segment", "u", "v", "refs", F.explode(at).alias("w"))
    return held.join(windows, [*group, "segment", "w"], "left_semi").select(*group, "segment", "w", "u", "v", "refs")


def topology_evolution(live: DataFrame, group: list[str]) -> DataFrame:
    """Nodes, edges and references of each window's topology."""
    nodes = live.select(*group, "w", F.explode(F.array("u", "v")).alias("asn")).distinct().groupBy(*group, "w").agg(F.count(F.lit(1)).alias("n_nodes"))
    return live.groupBy(*group, "w").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("refs").alias("references")).join(nodes, [*group, "w"])


def window_topology(log: DataFrame, group: list[str], target: int) -> DataFrame:
    """What `topology_evolution` gives, and the target's degree and references (null where it has no edge), from changes
    alone: no edge is listed by window.

    An edge's interval counts +1 where it begins and -1 where it ends, for the whole and for both its ends. A node is
    there while the running sum of its edges is positive; sums over the windows that have updates, 96 of five minutes in
    a segment at most, give the rest.
    """
    spans = edge_intervals(edge_deltas(path_lives(log, group), group), group)
    ends = F.array_compact(F.array(F.struct("w", F.lit(1).alias("x")), F.when(F.col("until").isNotNull(), F.struct(F.col("until").alias("w"), F.lit(-1).alias("x")))))
    changes = spans.select(*group, "segment", "u", "v", "refs", F.explode(ends).alias("c")).select(*group, "segment", "u", "v", "refs", "c.*")
    near = F.when((F.col("u") == target) | (F.col("v") == target), F.col("x")).otherwise(0)
    rows = changes.withColumn("near", near).select(*group, "segment", "w", "x", "refs", "near", F.explode(F.array(F.lit(None).cast("bigint"), "u", "v")).alias("asn"))
    # asn null: the whole
    sums = rows.groupBy(*group, "segment", "asn", "w").agg(F.sum("x").alias("x"), F.sum(F.col("x") * F.col("refs")).alias("r"), F.sum("near").alias("t"), F.sum(F.col("near") * F.col("refs")).alias("tr"))
    after = F.sum("x").over(Window.partitionBy(*group, "segment", "asn").orderBy("w"))
    sums = sums.withColumn("after", after).withColumn("n", (F.col("after") > 0).cast("int") - (F.col("after") > F.col("x")).cast("int"))
    whole = lambda c: F.sum(F.when(F.col("asn").isNull(), F.col(c))).alias(c)
    steps = sums.groupBy(*group, "segment", "w").agg(*map(whole, ("x", "r", "t", "tr")), F.sum(F.when(F.col("asn").isNotNull(), F.col("n"))).alias("n"))
    windows = log.select(*group, "segment", "w").distinct()  # each change is at one of these
    upto = Window.partitionBy(*group, "segment").orderBy("w")
    names = {"x": "n_edges", "r": "references", "n": "n_nodes", "t": "target_degree", "tr": "target_references"}
    held = windows.join(steps, [*group, "segment", "w"], "left").select(*group, "w", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(name) for c, name in names.items()])
    near = [F.when(F.col("target_degree") > 0, F.col(c)).alias(c) for c in ("target_degree", "target_references")]
    return held.filter("n_edges > 0").select(*group, "w", "n_edges", "references", "n_nodes", *near)


def state_counters(log: DataFrame, group: list[str]) -> DataFrame:
    """What each segment did: announcements applied and ignored, withdrawals applied."""
    order = Window.partitionBy(*group, "segment", "peer_as", "prefix").orderBy("ts", "seq")
    effective = log.filter((F.col("type") == "W") | ((F.col("type") == "A") & (F.size("path") >= 2))).withColumn("_before", F.lag("type").over(order))
    applied = effective.groupBy(*group, "segment").agg(
        F.count_if(F.col("type") == "A").alias("ann_applied"),
        F.count_if((F.col("type") == "W") & (F.col("_before") == "A")).alias("wd_applied"),
        F.count_if((F.col("type") == "A") & (F.col("_before") == "A")).alias("replaced"),
    )
    short = log.groupBy(*group, "segment").agg(F.count_if((F.col("type") == "A") & (F.size("path") < 2)).alias("ann_ignored"))
    return short.join(applied, [*group, "segment"], "left").na.fill(0)
