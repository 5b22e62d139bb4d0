"""Implausible readings, flagged per source against the source's own normal level.

Each source's ordered readings are split by a stationary Haar wavelet transform: the smooth of level j is
the mean of the last 2**j readings, detail j the smooth of level j - 1 less that of level j. Details are scaled
robustly, by the median of their sizes in that series and level: one that is many times this is a spike. Runs of
zero detail at the first level are stuck values; bounds reveal what cannot be true.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from pathloom.operators.chunked import merge_edge_runs
from pathloom.operators.grid import MICRO


def exact_medians(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The median of each key, exactly, without bringing a key's values together; nulls are left out.

    Values are counted by narrow buckets of their logarithm, which combines map-side into some hundred rows a key;
    a running sum finds the bucket or two that hold the middle; only the distinct values of these are
    counted one by one.
    """
    size = F.floor(F.log2(F.abs(F.col(value))) * 64).cast("bigint")
    bucket = F.when(F.col(value) > 0, size + 200_000).when(F.col(value) < 0, -size - 200_000).otherwise(0)  # logarithms lie within 1,100
    known = values.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), bucket.alias("_bucket"))
    counts = known.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    key, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_bucket")
    ranked = counts.withColumns({"_all": F.sum("_n").over(key), "_upto": F.sum("_n").over(order)})
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)  # the middle ranks, from 0
    middle = ranked.filter((F.col("_upto") > low) & (F.col("_upto") - F.col("_n") <= high))
    middle = middle.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_bucket"])], low.alias("_low"), high.alias("_high"), (F.col("_upto") - F.col("_n")).alias("_base"))
    near = known.join(middle, reduce(and_, [known[k].eqNullSafe(middle[f"_k{i}"]) for i, k in enumerate([*keys, "_bucket"])]))
    near = near.groupBy(*keys, "_v", "_low", "_high", "_base").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v")) + F.min("_base").over(key)
    near = near.withColumn("_upto", upto)
    at = lambda rank: F.max(F.when((F.col("_upto") > F.col(rank)) & (F.col("_upto") - F.col("_n") <= F.col(rank)), F.col("_v")))
    return near.groupBy(*keys).agg(((at("_low") + at("_high")) / 2).alias("median"))


def _haar(value: Column, levels: int, ordered: WindowSpec) -> dict[str, Column]:
    """Detail coefficients by level. The first readings of a chunk average fewer; the first has no detail of level 1."""
    smooth = [value] + [F.avg(value).over(ordered.rowsBetween(1 - (1 << j), 0)) for j in range(1, levels + 1)]
    # as half the difference, which is zero for equal neighbours only
    details = {"_d1": (value - F.lag(value).over(ordered)) / 2}
    return details | {f"_d{j}": smooth[j - 1] - smooth[j] for j in range(2, levels + 1)}


def implausible(
    readings: DataFrame,
    series: list[str],
    time: str,
    order: str,
    measures: list[str],
    sums: Mapping[str, list[str]] | None = None,
    ratio: float = 8.0,
    stuck: int = 8,
    lower: float = 0.0,
    levels: int = 3,
    threshold: float = 12.0,
    chunk_seconds: int = 86_400,
) -> DataFrame:
    """A row for each flagged value: series, order, measure, value, median, detail, flags.

    spike: some detail coefficient is more than `threshold` times the deviation of its series, measure and level,
    which is the median size of those coefficients / 0.6745; a level of which the half are zero has no spikes.
    stuck: one of at least `stuck` equal values in a row (nulls left out), which is a run of zero details of
    level 1. Bounds: negative, below `lower`; bound, more than `ratio` times, or less than 1/ratio of, the median
    of the series' values at or above `lower`. sum: not the sum of the columns in sums[measure]; left out where
    one of them is null. detail is the largest coefficient over its deviation, null where no level has one.

    The order is (time, order); null times come first. Copies repeat (time, order) exactly and count once.
    Null values are never flagged. A series whose median is zero has values beyond the bound only above zero, one
    without median none at all. Readings are worked on in (series, time chunk): runs across chunks are
    stitched from one row per chunk, details do not look back into the chunk before.
    """
    sums = dict(sums or {})
    chunk = F.coalesce(F.floor(F.unix_micros(time) / F.lit(chunk_seconds * MICRO)).cast("bigint"), F.lit(-(1 << 40)))
    needed = list(dict.fromkeys([*series, time, order, *measures, *(c for parts in sums.values() for c in parts)]))
    base = readings.select(*needed).withColumn("_chunk", chunk).repartition(*series, "_chunk").distinct()
    cells = []
    for m in measures:
        parts = sums.get(m)
        total = sum((F.col(p) for p in parts[1:]), F.col(parts[0])).cast("double") if parts else F.lit(None).cast("double")
        cells.append(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"), total.alias("parts")))
    values = (
        base.withColumn("_x", F.explode(F.array(*cells)))
        .select(*series, "_chunk", F.col(time).alias("_t"), F.col(order).alias("_o"), "_x.measure", "_x.value", "_x.parts")
        .filter("value is not null")
    )
    keys = [*series, "measure"]
    medians = exact_medians(values.filter(F.col("value") >= lower), keys, "value")
    medians = medians.select(*[F.col(k).alias(f"_m{i}") for i, k in enumerate(keys)], "median")

    part = [*keys, "_chunk"]
    w = Window.partitionBy(*part).orderBy("_t", "_o")
    rows = values.withColumns(_haar(F.col("value"), levels, w))
    sizes = F.explode(F.array(*[F.struct(F.lit(j).alias("level"), F.abs(F.col(f"_d{j}")).alias("size")) for j in range(1, levels + 1)]))
    scales = exact_medians(rows.select(*keys, sizes.alias("_s")).select(*keys, "_s.level", "_s.size"), [*keys, "level"], "size")
    scales = scales.filter("median > 0").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("level", (F.col("median") / 0.6745).alias("x")))).alias("_scale"))
    scales = scales.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)], "_scale")  # a row a series, with an entry a level
    # zero detail between neighbours: the run goes on
    rows = rows.withColumn("_run", F.sum((~F.col("_d1").eqNullSafe(F.lit(0.0))).cast("int")).over(w))
    rows = rows.withColumn("_length", F.count(F.lit(1)).over(Window.partitionBy(*part, "_run")))

    ends = rows.groupBy(*part).agg(
        F.min(F.struct("_run", F.col("value"), F.col("_length").alias("n"))).alias("first"),
        F.max(F.struct("_run", F.col("value"), F.col("_length").alias("n"))).alias("last"),
    )
    ends = ends.select(*keys, F.col("_chunk").alias("chunk"), "first", "last", F.col("last._run").alias("runs"))
    stitched = merge_edge_runs(ends, keys, lambda last, first: last.value == first.value)
    # a run over chunks: the last run of its root chunk and the first runs of those that go on from it
    went_on = F.when(F.col("root").isNotNull(), F.struct(F.lit(1).cast("bigint").alias("run"), F.col("root"), F.col("first.n").alias("n")))
    began = F.when((F.col("runs") > 1) | F.col("root").isNull(), F.struct(F.col("runs").alias("run"), F.col("chunk").alias("root"), F.col("last.n").alias("n")))
    pieces = stitched.select(*keys, "chunk", F.explode(F.array_compact(F.array(went_on, began))).alias("p")).select(*keys, "chunk", "p.*")
    long = pieces.withColumn("_total", F.sum("n").over(Window.partitionBy(*keys, "root"))).filter(F.col("_total") > F.col("n"))
    long = long.filter(F.col("_total") >= stuck)
    long = long.select(*[F.col(k).alias(f"_l{i}") for i, k in enumerate([*keys, "chunk", "run"])], "_total")

    def same(left: DataFrame, names: list[str], right: DataFrame, mark: str) -> Column:
        out = F.lit(True)
        for i, k in enumerate(names):
            out = out & left[k].eqNullSafe(right[f"{mark}{i}"])
        return out

    rows = rows.join(long, same(rows, [*part, "_run"], long, "_l"), "left")
    rows = rows.join(medians, same(rows, keys, medians, "_m"), "left")

    rows = rows.join(scales, same(rows, keys, scales, "_s"), "left")

    detail = F.greatest(*[F.abs(F.col(f"_d{j}")) / F.try_element_at("_scale", F.lit(j)) for j in range(1, levels + 1)], F.lit(None).cast("double"))
    beyond = (F.col("value") > ratio * F.col("median")) | (F.col("value") < F.col("median") / ratio)
    flags = {
        "negative": F.col("value") < lower,
        "bound": F.coalesce(beyond, F.lit(False)),
        "spike": F.coalesce(detail > threshold, F.lit(False)),
        "stuck": (F.greatest("_length", F.coalesce("_total", F.lit(0))) >= stuck),
        "sum": F.coalesce(F.col("value") != F.col("parts"), F.lit(False)),
    }
    flagged = rows.select(*series, F.col("_o").alias(order), "measure", "value", "median", detail.alias("detail"), *[c.alias(n) for n, c in flags.items()])
    return flagged.filter(F.col("negative") | F.col("bound") | F.col("spike") | F.col("stuck") | F.col("sum"))
