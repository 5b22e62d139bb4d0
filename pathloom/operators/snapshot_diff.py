"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def undirected(edges: DataFrame, keep: list[str], source: str = "source", target: str = "target", weight: str = "weight") -> DataFrame:
    """Each edge of a snapshot once, source < target; self-loops and edges with a null end go. Of unequal
    weights of a repeated edge the largest holds, null below all."""
    a, b = F.least(source, target), F.greatest(source, target)
    fit = edges.filter(F.col(source).isNotNull() & F.col(target).isNotNull() & (F.col(source) != F.col(target)))
    return fit.groupBy(*keep, a.alias("source"), b.alias("target")).agg(F.max(weight).alias("weight"))


def snapshot_index(rows: DataFrame, group: str, stamp: str) -> DataFrame:
    """The delivered snapshots of each group numbered in order, with the stamp that follows (null at the end)."""
    w = Window.partitionBy(group).orderBy(stamp)
    stamps = rows.select(group, stamp).filter(F.col(stamp).isNotNull()).distinct()
    return stamps.select(group, stamp, F.row_number().over(w).alias("snapshot_no"), F.lead(stamp).over(w).alias("next_stamp"))


def snapshot_changes(rows: DataFrame, index: DataFrame, group: str, stamp: str, key: list[str], values: list[str]) -> DataFrame:
    """Keys added, removed or changed between each snapshot and the one before it.

    rows: one per (group, stamp, key). Each key's rows are ordered by snapshot number: a lagged hash of the
    values that differs is a change, a gap in the numbers a removal and a later addition. The stamp is that
    of the later snapshot. A group's first snapshot has nothing before it and gives no rows. Values compare
    null-safe; rows with a null group, stamp or key part are compared like any others (null stamps: left out).

    The window is by (group, key): as many rows as there are snapshots at most, whatever a group holds.
    """
    names = {group: "_g", stamp: "_s"}
    small = index.select(F.col(group).alias("_g"), F.col(stamp).alias("_s"), "snapshot_no", "next_stamp")
    rows = rows.select(group, stamp, *key, *values)
    joined = rows.join(small, rows[group].eqNullSafe(small["_g"]) & (rows[stamp] == small["_s"])).drop(*names.values())
    w = Window.partitionBy(group, *key).orderBy("snapshot_no")
    # struct, not only its hash: two values with one hash would hide a change
    state = F.struct(F.xxhash64(*values).alias("h"), *values)
    seen = joined.withColumns(
        {"_no": F.lag("snapshot_no").over(w), "_old": F.lag(state).over(w), "_later": F.lead("snapshot_no").over(w), "_new": state}
    )
    now = (
        F.when((F.col("snapshot_no") > 1) & ~(F.col("_no") == F.col("snapshot_no") - 1).eqNullSafe(F.lit(True)), F.lit("added"))
        .when((F.col("_no") == F.col("snapshot_no") - 1) & ~F.col("_old").eqNullSafe(F.col("_new")), F.lit("changed"))
    )
    gone = F.col("next_stamp").isNotNull() & ~(F.col("_later") == F.col("snapshot_no") + 1).eqNullSafe(F.lit(True))
    old = [F.col(f"_old.{v}") for v in values]
    at = F.when(now.isNotNull(), F.struct(F.col(stamp).alias("at"), now.alias("change"), *[F.when(now == "changed", o).alias(f"old_{v}") for o, v in zip(old, values, strict=True)], *[F.col(v).alias(f"new_{v}") for v in values]))
    left = F.when(gone, F.struct(F.col("next_stamp").alias("at"), F.lit("removed").alias("change"), *[F.col(v).alias(f"old_{v}") for v in values], *[F.lit(None).cast(joined.schema[v].dataType).alias(f"new_{v}") for v in values]))
    out = seen.select(group, *key, F.explode(F.array_compact(F.array(at, left))).alias("c"))
    return out.select(group, F.col("c.at").alias(stamp), *key, "c.change", *[f"c.{p}_{v}" for v in values for p in ("old", "new")])
