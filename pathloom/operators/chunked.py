"""Ordered operators on keys of any size.

A window over a whole key puts the key into one task. The operators here cut a key's ordered rows into
chunks (time buckets), work within (key, chunk), and stitch neighbouring chunks from one small row per
chunk. A row per chunk and key is all that is ever brought together: years of hourly chunks are some
ten thousand rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hot_buckets(rows: DataFrame, key: Column, limit: int, buckets: int = 4096) -> list[int]:
    """Hash buckets of `key` that hold more than `limit` rows: every key that large lies in one of them.

    One pass, `buckets` counters at most, combined before the shuffle; the list is as bounded.
    """
    hashed = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")
    counts = rows.select(hashed).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return sorted(r.bucket for r in counts.filter(F.col("n") > limit).collect())


def in_buckets(key: Column, chosen: list[int], buckets: int = 4096) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).isin(*chosen) if chosen else F.lit(False)


def join_same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the columns of right that are no keys; null keys are equal to null keys."""
    named = right.select(*[F.col(k).alias(f"_same{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = reduce(and_, [left[k].eqNullSafe(named[f"_same{i}"]) for i, k in enumerate(keys)], F.lit(True))
    return left.join(named, on).drop(*[f"_same{i}" for i in range(len(keys))])


def with_positions(rows: DataFrame, keys: list[str], time: str, order: list[str], chunk_seconds: int = 86_400) -> DataFrame:
    """Adds `_pos`: the row's number from 0 within its key, by (time, order). Rows without time are left out.

    Rows are numbered within (key, chunk of time); how many came before a chunk is known from one row a chunk.
    """
    chunk = F.floor(F.unix_micros(time) / F.lit(chunk_seconds * 1_000_000)).cast("bigint")
    within = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(time, *order))
    numbered = rows.filter(F.col(time).isNotNull()).withColumn("_chunk", chunk).repartition(*keys, "_chunk").withColumn("_within", within)
    sizes = numbered.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*keys, "_chunk", F.coalesce(before, F.lit(0)).alias("_before"))
    joined = join_same(numbered, sizes, [*keys, "_chunk"])
    return joined.select(*rows.columns, (F.col("_before") + F.col("_within") - 1).alias("_pos"))


def with_predecessor(rows: DataFrame, keys: list[str], time: str, order: list[str], value: str, name: str, chunk_seconds: int = 86_400) -> DataFrame:
    """Adds `name`: the value of the row before, of its key by (time, order). Within (key, chunk of time) by a lag; the
    first row of a chunk takes the last of the chunk before, of which there is one row a chunk."""
    chunk = F.floor(F.unix_micros(time) / F.lit(chunk_seconds * 1_000_000)).cast("bigint")
    w = Window.partitionBy(*keys, "_chunk").orderBy(time, *order)
    placed = rows.filter(F.col(time).isNotNull()).withColumn("_chunk", chunk).repartition(*keys, "_chunk")
    placed = placed.withColumns({"_lag": F.lag(F.struct(F.col(value).alias("x"))).over(w), "_next": F.lead(F.lit(1)).over(w)})
    last = placed.filter("_next is null").select(*keys, "_chunk", F.struct(F.col(value).alias("x")).alias("_last"))
    carried = last.select(*keys, "_chunk", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carried"))
    joined = join_same(placed, carried, [*keys, "_chunk"])
    return joined.select(*rows.columns, F.coalesce("_lag", "_carried")["x"].alias(name))


def in_blocks(rows: DataFrame, keys: list[str], time: str, order: list[str], before: int, after: int, block: int = 50_000) -> DataFrame:
    """Rows with `_pos`, `_block` and `_own`: each row in its own block of `block` positions of its key, and besides, not
    as its own, in the blocks that begin or end within `after` or `before` rows of it. A window over (keys, _block) by
    _pos then sees for each own row the `before` rows before it and the `after` rows after it, whatever the key holds."""
    placed = with_positions(rows, keys, time, order)
    first = F.greatest(F.floor((F.col("_pos") - after) / block), F.lit(0)).cast("bigint")
    spread = placed.withColumn("_block", F.explode(F.sequence(first, F.floor((F.col("_pos") + before) / block).cast("bigint"))))
    return spread.withColumn("_own", F.col("_block") == F.floor(F.col("_pos") / block))


def merge_edge_runs(edges: DataFrame, keys: list[str], joins: Callable[[Column, Column], Column]) -> DataFrame:
    """Which runs go on across chunk borders.

    edges: a row per (keys, chunk) with structs `first` and `last` (the chunk's outermost runs) and
    `runs` (their number). joins(previous_last, first) says whether two neighbouring runs are one.
    Adds `root`: the chunk whose last run the chunk's first run belongs to, null if it starts anew.
    """
    w = Window.partitionBy(*keys).orderBy("chunk")
    goes_on = F.coalesce(joins(F.lag("last").over(w), F.col("first")), F.lit(False))
    marked = edges.withColumn("goes_on", goes_on)
    # a chunk's last run starts within the chunk, unless its only run came from before
    own = F.when((F.col("runs") > 1) | ~F.col("goes_on"), F.col("chunk"))
    before = F.max(own).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return marked.withColumn("root", F.when(F.col("goes_on"), before)).drop("goes_on")
