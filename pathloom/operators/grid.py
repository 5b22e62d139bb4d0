"""Irregular readings onto a regular grid."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICRO = 1_000_000


def floor_time(time: Column, seconds: int) -> Column:
    """The start of the epoch-aligned window that a TIMESTAMP falls in."""
    return F.timestamp_micros(F.floor(F.unix_micros(time) / F.lit(seconds * MICRO)).cast("bigint") * F.lit(seconds * MICRO))


def window_id(time: Column) -> Column:
    return F.date_format(time, "yyyyMMdd_HHmm")


def counter_increments(
    readings: DataFrame,
    series: list[str],
    time: str,
    counter: str,
    restart: str | None = None,
    block_seconds: int = 28_800,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Differences of consecutive readings of a cumulative counter.

    Gives series, `from_ts`, `to_ts` and `increment`: what was counted in (from_ts, to_ts]. A reading
    below the one before is a reset: the counter began at zero, so its value is the increment. With
    `restart` (a time column) the counter is known to have begun at zero then, unless an earlier
    reading lies after it. The first reading of a series has no predecessor and, without `restart`,
    gives no increment. Null readings and null times are left out; of equal times the highest reading
    counts (a counter only grows).

    Readings are ordered within time blocks; the last reading of the block before is carried into the
    next one, so no task holds a whole series. Columns in `keep` come along from the later reading (of equal
    times, their greatest). With `restart` there is nothing to carry but an overlap,
    so the series given must then be short ones (such as a source's 8-hour segments).
    """
    known = readings.filter(F.col(time).isNotNull() & F.col(counter).isNotNull())
    block = F.floor(F.unix_micros(time) / F.lit(block_seconds * MICRO)).cast("bigint")
    keys = series if restart else [*series, "_block"]
    rows = known.select(
        *series, *([] if restart else [block.alias("_block")]), F.col(time).alias("_t"), F.col(counter).alias("_v"),
        (F.col(restart) if restart else F.lit(None).cast("timestamp")).alias("_restart"), *keep,
    ).repartition(*keys)
    rows = rows.groupBy(*keys, "_t").agg(F.max("_v").alias("_v"), F.max("_restart").alias("_restart"), *[F.max(c).alias(c) for c in keep])
    w = Window.partitionBy(*keys).orderBy("_t")
    rows = rows.withColumns({"_pt": F.lag("_t").over(w), "_pv": F.lag("_v").over(w)})
    if not restart:
        edge = rows.groupBy(*keys).agg(F.max(F.struct("_t", "_v")).alias("_last"), F.min("_t").alias("_t0"))
        before = F.lag("_last").over(Window.partitionBy(*series).orderBy("_block"))
        carried = edge.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_t0", before.alias("_before"))
        same = reduce(and_, [rows[k].eqNullSafe(carried[f"_k{i}"]) for i, k in enumerate(keys)]) & (rows["_t"] == carried["_t0"])
        rows = rows.join(carried, same, "left").withColumns(
            {"_pt": F.coalesce("_pt", F.col("_before._t")), "_pv": F.coalesce("_pv", F.col("_before._v"))}
        )
    begun = F.col("_restart").isNotNull() & (F.col("_pt").isNull() | (F.col("_restart") >= F.col("_pt")))
    return rows.select(
        *series,
        F.when(begun, F.col("_restart")).otherwise(F.col("_pt")).alias("from_ts"),
        F.col("_t").alias("to_ts"),
        F.when(begun | (F.col("_v") < F.col("_pv")), F.col("_v")).otherwise(F.col("_v") - F.col("_pv")).alias("increment"),
        *keep,
    ).filter(F.col("from_ts").isNotNull())


def increments_to_cells(
    increments: DataFrame, series: list[str], step_seconds: int, max_span_seconds: int | None = None, reach_seconds: int | None = None, add: Sequence[str] = ()
) -> DataFrame:
    """Spreads each increment over the grid cells it overlaps, in proportion to the overlap.

    Gives series, `cell_start`, `amount` and `covered` (the share of the cell that increments cover).
    Increments longer than max_span_seconds say nothing about when they happened and cover no cell. With
    reach_seconds a reading is known to tell of that long before it at most: its increment falls into that
    stretch, and what lies between the reading before and the stretch stays uncovered. Columns in `add` are spread likewise.
    """
    step = F.lit(step_seconds * MICRO)
    fits = F.col("_to") > F.col("_from")
    if max_span_seconds is not None:
        fits = fits & (F.col("_to") - F.col("_from") <= F.lit(max_span_seconds * MICRO))
    begin = F.unix_micros("from_ts")
    if reach_seconds is not None:
        begin = F.greatest(begin, F.unix_micros("to_ts") - F.lit(reach_seconds * MICRO))
    spans = increments.select(
        *series, begin.alias("_from"), F.unix_micros("to_ts").alias("_to"), F.col("increment").cast("double").alias("_inc"), *add
    ).filter(fits)
    first, last = F.floor(F.col("_from") / step).cast("bigint"), F.floor((F.col("_to") - 1) / step).cast("bigint")
    cells = spans.withColumn("_cell", F.explode(F.sequence(first, last)))
    overlap = F.least(F.col("_to"), (F.col("_cell") + 1) * step) - F.greatest(F.col("_from"), F.col("_cell") * step)
    return (
        cells.groupBy(*series, "_cell")
        .agg(
            F.sum(F.col("_inc") * (overlap / (F.col("_to") - F.col("_from")))).alias("amount"),
            F.sum(overlap / step).alias("covered"),
            *[F.sum(F.col(c) * (overlap / (F.col("_to") - F.col("_from")))).alias(c) for c in add],
        )
        .select(*series, F.timestamp_micros(F.col("_cell") * step).alias("cell_start"), "amount", "covered", *add)
    )


def fill_grid(cells: DataFrame, groups: list[str], step_seconds: int, values: list[str]) -> DataFrame:
    """One row for each cell from the first to the last of each group; `missing` marks those that had none.

    cells: at most one row per (groups, cell_start). Each row also brings forth the empty cells up to
    the next one, so that the grid needs no join.
    """
    w = Window.partitionBy(*groups).orderBy("cell_start")
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(step_seconds).cast("decimal(18,6)"))
    following = F.lead("cell_start").over(w)
    steps = F.coalesce(((F.unix_micros(following) - F.unix_micros("cell_start")) / F.lit(step_seconds * MICRO)).cast("bigint"), F.lit(1))
    return (
        cells.withColumn("_steps", steps)
        .withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_steps") - 1)))
        .select(
            *groups,
            F.timestamp_micros(F.unix_micros("cell_start") + F.col("_i") * F.lit(step_seconds * MICRO)).alias("cell_start"),
            *[F.when(F.col("_i") == 0, F.col(v)).alias(v) for v in values],
            (F.col("_i") > 0).alias("missing"),
        )
    )


def regular_windows(
    readings: DataFrame,
    series: list[str],
    time: str = "window_start",
    value: str = "total_updates",
    order: str = "feature_id",
    step_seconds: int = 300,
    segment_seconds: int = 28_800,
) -> DataFrame:
    """Window readings as a regular series per (series, segment).

    A reading tells what was counted in its window. Their running sum over a segment is a counter that is read at
    each window's end and begins at zero with the segment's first window; it starts anew with each segment.
    Differences of consecutive readings of the counter give increments (a drop would be a reset), which are spread
    over the cells they overlap, a step back from their reading at most. The cells in between, which nothing covers,
    come out with `missing`. A count below zero is none a counter can show: it leaves the counter as it is
    and comes out as read.

    A segment is an epoch-aligned block of segment_seconds. Of several readings of a window the latest (by
    time, then `order`) counts. Null values and times are no readings; a series with none has no rows. Series names
    may be null, which is a series of its own. All windows are over (series, segment), after one shuffle.
    """
    window = floor_time(F.col(time), step_seconds)
    known = readings.filter(F.col(time).isNotNull() & F.col(value).isNotNull())
    segment = F.floor(F.unix_micros(time) / F.lit(segment_seconds * MICRO)).cast("bigint")
    keys = [*series, "segment_no"]
    latest = (
        known.select(*series, segment.alias("segment_no"), window.alias("_w"), F.struct(F.col(time), F.col(order), F.col(value).alias("v")).alias("r"))
        .repartition(*keys)  # before the grouping: a window has one or two readings, nothing to combine
        .groupBy(*keys, "_w")
        .agg(F.max("r").alias("r"))
    )
    counter = F.sum(F.greatest(F.col("r.v"), F.lit(0))).over(Window.partitionBy(*keys).orderBy("_w"))
    read = latest.select(
        *keys, F.timestamp_micros(F.unix_micros("_w") + step_seconds * MICRO).alias("_end"), counter.alias("_counter"),
        F.min("_w").over(Window.partitionBy(*keys)).alias("_begin"), F.least(F.col("r.v"), F.lit(0)).cast("double").alias("below_zero"),
    )
    increments = counter_increments(read, keys, "_end", "_counter", restart="_begin", keep=["below_zero"])
    cells = increments_to_cells(increments, keys, step_seconds, reach_seconds=step_seconds, add=["below_zero"]).filter("covered > 0")
    cells = cells.withColumn("amount", F.col("amount") + F.col("below_zero")).drop("below_zero")
    return fill_grid(cells, keys, step_seconds, ["amount", "covered"])
