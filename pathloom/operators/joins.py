"""Joins on time and intervals, keyed upserts, neighbour joins. Theta conditions are turned into equi-joins on buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.chunked import in_blocks
from pathloom.operators.grid import MICRO


def interval_join(rows: DataFrame, intervals: DataFrame, keys: list[str], time: str, start: str, end: str, take: str, order: str, bucket_seconds: int = 86_400, closed: bool = True) -> DataFrame:
    """Adds `take` of the interval each row's time lies in (both ends count, or not the end if not closed); of
    overlapping ones the last by `order`; null where there is none.

    Intervals are listed by the buckets they touch, so that rows meet only those of their bucket.
    """
    size = F.lit(bucket_seconds * MICRO)
    number = lambda c: F.floor(F.unix_micros(c) / size).cast("bigint")
    spread = intervals.filter(F.col(start) <= F.col(end)).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(start).alias("_a"), F.col(end).alias("_b"), F.col(take).alias("_take"), F.col(order).alias("_order"),
        F.explode(F.sequence(number(start), number(end))).alias("_bucket"),
    )
    tagged = rows.withColumn("_at", number(time)).withColumn("_row", F.monotonically_increasing_id())
    inside = (F.col(time) >= F.col("_a")) & ((F.col(time) <= F.col("_b")) if closed else (F.col(time) < F.col("_b")))
    on = (F.col("_at") == F.col("_bucket")) & inside
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"_k{i}"))
    met = tagged.join(spread, on, "left")
    plain = [c for c in rows.columns if c != take]
    return met.groupBy("_row", *plain).agg(F.max_by("_take", "_order").alias(take)).drop("_row")


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, take: list[str], tolerance_seconds: int = 600, tie: str | None = None) -> DataFrame:
    """Each left row with the columns of the right row nearest in time, within the tolerance; null without.

    Times are cut into buckets of the tolerance; a left row looks into its own and the two beside it. Of
    equally near rows the earlier counts, then the smaller `tie`.
    """
    size = F.lit(tolerance_seconds * MICRO)
    number = lambda c: F.floor(F.unix_micros(c) / size).cast("bigint")
    spread = left.withColumn("_row", F.monotonically_increasing_id()).withColumn("_bucket", F.explode(F.array(*[number(time) + i for i in (-1, 0, 1)])))
    other = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], number(time).alias("_at"), F.col(time).alias("_t"), F.struct(*take).alias("_take"), (F.col(tie) if tie else F.lit(0)).alias("_tie"))
    gap = F.abs(F.unix_micros(time) - F.unix_micros("_t"))
    on = (F.col("_bucket") == F.col("_at")) & (gap <= size)
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"_k{i}"))
    met = spread.join(other, on, "left").withColumn("_gap", gap)
    best = met.groupBy("_row", *left.columns).agg(F.min_by("_take", F.when(F.col("_gap").isNotNull(), F.struct("_gap", "_t", "_tie"))).alias("_take"))
    return best.select(*left.columns, *[F.col(f"_take.{c}").alias(f"near_{c}") for c in take])


def keep_last(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by the given order: upsert of an index."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys that new has, and all of new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def label_override(rows: DataFrame, labels: DataFrame, keys: list[str], label: str, drop: str = "uncertain") -> DataFrame:
    """Rows with the label given for their key; rows without one, and those labelled `drop`, are left out."""
    return rows.drop(label).join(labels.select(*keys, label), keys).filter(F.col(label) != drop)


def ordered_pairs(items: DataFrame, column: str, most: int = 10_000) -> DataFrame:
    """All ordered pairs of different items of a small list (domains, features), at most `most` of them."""
    few = items.select(column).distinct().limit(most + 1)
    names = sorted(r[0] for r in few.collect() if r[0] is not None)
    if len(names) > most:
        raise ValueError(f"more than {most} items")
    pairs = [(a, b) for a in names for b in names if a != b]
    return items.sparkSession.createDataFrame(pairs, f"source_{column} string, target_{column} string")


def temporal_edges(rows: DataFrame, keys: list[str], time: str, order: list[str], node: str, k: int = 2, block: int = 50_000) -> DataFrame:
    """Each row with the k before it by (time, order): edges of a chronological graph. Rows without time are left out."""
    w = Window.partitionBy(*keys, "_block").orderBy("_pos")
    placed = in_blocks(rows.select(*keys, time, *order, F.col(node).alias("target")), keys, time, order, k, 0, block)
    numbered = placed.select(*keys, "target", "_own", *[F.lag("target", i).over(w).alias(f"_{i}") for i in range(1, k + 1)]).filter("_own")
    before = F.explode(F.array(*[F.struct(F.col(f"_{i}").alias("source"), F.lit(i).alias("step")) for i in range(1, k + 1)]))
    return numbered.select(*keys, "target", before.alias("_e")).filter("_e.source is not null").select(*keys, "_e.source", "target", "_e.step")


def mutual_nearest(vectors: DataFrame, key: str, vector: str, group: str, k: int, block: int = 2048, fallback: bool = False) -> DataFrame:
    """Pairs (a < b) that are among each other's k nearest by squared distance (ties: the smaller key) within a group.

    A group falls by a hash into parts of about `block` rows. Each part is compared with each part of its group, one task
    for two parts, and a row keeps its k nearest of a part; the best k of all parts follow from these. So no task holds a
    group. With `fallback` rows without a mutual neighbour keep their own k nearest (the symmetrised graph).
    """
    import numpy as np
    import pandas as pd

    kind, kinds = vectors.schema[key].dataType.simpleString(), vectors.schema[group].dataType.simpleString()
    own = vectors.select(F.col(group).alias("_g"), F.col(key).alias("_key"), F.col(vector).alias("_v"))
    sizes = own.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_parts"))  # a row a group
    rows = own.join(sizes, "_g").withColumn("_part", F.pmod(F.xxhash64(F.col("_key")), F.col("_parts")).cast("int"))
    others = F.sequence(F.lit(0), F.col("_parts") - 1)
    asks = rows.select("_g", "_key", "_v", F.col("_part").alias("_i"), F.explode(others).alias("_j"), F.lit(True).alias("_asks"))
    answers = rows.select("_g", "_key", "_v", F.explode(others).alias("_i"), F.col("_part").alias("_j"), F.lit(False).alias("_asks"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = (pdf[pdf["_asks"] == side].sort_values("_key", ignore_index=True) for side in (True, False))
        out = []
        if len(one) and len(two):
            ids, x, y = two["_key"].to_numpy(), *(np.stack(p["_v"].to_numpy()).astype(np.float64) for p in (one, two))
            d = (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None] - 2 * x @ y.T
            d[one["_key"].to_numpy()[:, None] == ids[None]] = np.inf
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            for n, (at, near) in enumerate(zip(one["_key"].tolist(), best, strict=True)):
                out += [(pdf["_g"].iloc[0], at, ids[m].item(), float(d[n, m])) for m in near if np.isfinite(d[n, m])]
        return pd.DataFrame(out, columns=["_g", "a", "b", "d"])

    met = asks.unionByName(answers).groupBy("_g", "_i", "_j").applyInPandas(solve, f"_g {kinds}, a {kind}, b {kind}, d double")
    order = Window.partitionBy("_g", "a").orderBy(F.round("d", 9), "b")
    near = met.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).select("_g", "a", "b")
    low = near.select("_g", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    counted = low.groupBy("_g", "a", "b").agg(F.count(F.lit(1)).alias("_n"))
    mutual = counted.filter("_n = 2").select("_g", "a", "b")
    if not fallback:
        return mutual.withColumnRenamed("_g", group)
    met_by = mutual.select("_g", F.explode(F.array("a", "b")).alias("a")).distinct()
    alone = near.join(met_by, ["_g", "a"], "left_anti").select("_g", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return mutual.unionByName(alone).distinct().withColumnRenamed("_g", group)
