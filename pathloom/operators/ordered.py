"""Ordered operators: sessions, rolling statistics, sequences, periodicity, gaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.chunked import in_blocks, join_same, with_positions


def sessions(rows: DataFrame, keys: list[str], time: str, gap_minutes: int = 120, name: str | None = None, chunk_seconds: int = 604_800) -> DataFrame:
    """Numbers events: an event starts where the gap to the row before is larger than gap_minutes.

    Adds `event_no` (from 1 within keys) and, with `name`, `event_id` as {name}_evt_{number:03d}. Rows with a
    null time are left out.

    Events are numbered within (key, chunk of time). One row a chunk tells its last time and its number of events,
    from which follows how many came before and whether its first event goes on from the chunk before.
    """
    chunk = F.floor(F.unix_micros(time) / F.lit(chunk_seconds * 1_000_000)).cast("bigint")
    w = Window.partitionBy(*keys, "_chunk").orderBy(time)
    wide = lambda later, earlier: F.unix_micros(later) - F.unix_micros(earlier) > F.lit(gap_minutes * 60_000_000)
    placed = rows.filter(F.col(time).isNotNull()).withColumn("_chunk", chunk).repartition(*keys, "_chunk")
    starts = wide(time, F.lag(time).over(w))
    placed = placed.withColumn("_own", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    ends = placed.groupBy(*keys, "_chunk").agg(F.min(time).alias("_first"), F.max(time).alias("_last"), F.max("_own").alias("_events"))
    order = Window.partitionBy(*keys).orderBy("_chunk")
    anew = F.coalesce(wide("_first", F.lag("_last").over(order)), F.lit(True)).cast("int")  # the chunk's first event is a new one
    ends = ends.withColumn("_anew", anew)
    base = F.sum(F.col("_anew") + F.col("_events")).over(order) - F.col("_events")
    ends = ends.select(*keys, "_chunk", base.alias("_base"))
    out = join_same(placed, ends, [*keys, "_chunk"]).select(*rows.columns, (F.col("_base") + F.col("_own")).alias("event_no"))
    if name:
        number = F.col("event_no").cast("string")
        out = out.withColumn("event_id", F.concat(F.col(name), F.lit("_evt_"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)))
    return out


def event_manifest(rows: DataFrame, keys: list[str], time: str, label: str) -> DataFrame:
    """One row for each (keys, event_id): span, windows and the label most of them have (ties: first by text)."""
    by_label = rows.groupBy(*keys, "event_id", label).agg(F.count(F.lit(1)).alias("_n"), F.min(time).alias("_a"), F.max(time).alias("_b"))
    best = F.min_by(label, F.struct(-F.col("_n"), F.col(label)))
    return by_label.groupBy(*keys, "event_id").agg(F.min("_a").alias("start_time"), F.max("_b").alias("end_time"), F.sum("_n").alias("n_windows"), best.alias("dominant_label"))


def rolling(rows: DataFrame, keys: list[str], time: str, order: list[str], value: str, size: int = 12, least: int = 4, block: int = 50_000) -> DataFrame:
    """Adds `rolling_median` (centred: size / 2 before and size / 2 - 1 after, at least `least` values) and
    `trailing_mean` (the last `size` values), by (time, order). Rows without time are left out."""
    w = Window.partitionBy(*keys, "_block").orderBy("_pos")
    centred = w.rowsBetween(-(size // 2), size - size // 2 - 1)
    # a frame of a few rows: its sorted values' middle
    seen = F.sort_array(F.collect_list(value).over(centred))
    n = F.size("_seen")
    middle = (F.get("_seen", F.floor((n - 1) / 2).cast("int")) + F.get("_seen", F.floor(n / 2).cast("int"))) / 2
    placed = in_blocks(rows, keys, time, order, size, size, block)
    out = placed.withColumns({"_seen": seen, "trailing_mean": F.avg(value).over(w.rowsBetween(1 - size, 0))}).filter("_own")
    return out.withColumn("rolling_median", F.when(n >= least, middle)).drop("_seen", "_pos", "_block", "_own")


def trailing_sequences(rows: DataFrame, keys: list[str], time: str, order: list[str], values: list[str], length: int = 10, block: int = 50_000) -> DataFrame:
    """Adds `sequence`: the last `length` rows' values by (time, order), padded at the left with the oldest of them."""
    w = Window.partitionBy(*keys, "_block").orderBy("_pos").rowsBetween(1 - length, 0)
    seen = F.collect_list(F.array(*[F.coalesce(F.col(v).cast("float"), F.lit(float("nan")).cast("float")) for v in values])).over(w)
    out = in_blocks(rows, keys, time, order, length, 0, block).withColumn("sequence", seen).filter("_own").drop("_pos", "_block", "_own")
    return out.withColumn("sequence", F.concat(F.array_repeat(F.get("sequence", F.lit(0)), F.lit(length) - F.size("sequence")), "sequence"))


def tail_split(rows: DataFrame, order: list[str], label: str, share: float = 0.10, grow: float = 0.02, least: int = 5, most: float = 0.5) -> DataFrame:
    """Marks the chronological tail as `is_validation`: the smallest share of a grid that holds at least
    `least` rows of either class (the largest share if none does).

    Only counts by position travel: rows are numbered by a range-partitioned sort and the grid's few cuts
    are worked out from class counts per cut.
    """
    n = rows.count()
    numbered = numbered_by(rows, order)
    steps = max(1, int(round((most - share) / grow)) + 1)
    sizes = sorted({max(1, int(n * (share + i * grow))) for i in range(steps)})
    counts = numbered.agg(*[F.count_if((F.col("row_no") >= n - s) & (F.col(label) == y)).alias(f"c{i}_{y}") for i, s in enumerate(sizes) for y in (0, 1)]).first()
    size = next((s for i, s in enumerate(sizes) if counts[f"c{i}_0"] >= least and counts[f"c{i}_1"] >= least), sizes[-1])
    return numbered.withColumn("is_validation", F.col("row_no") >= n - size)


def numbered_by(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds `row_no` from 0 in a total order without bringing the rows together: a range-partitioned sort, the
    partitions' sizes, and numbers within them."""
    from pathloom.session import cut

    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    w = Window.orderBy("_part")
    before = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.join(before.select("_part", "_before"), "_part").withColumn("row_no", within - 1 + F.col("_before")).drop("_part", "_before")


def autocorrelation(rows: DataFrame, keys: list[str], time: str, value: str, lags: range, block: int = 8192) -> DataFrame:
    """Autocorrelation of each series (by position in time) at each lag, over its lag-0 value; null for a flat series.

    Positions are cut into blocks, each with the readings of the longest lag after it; a block gives a sum of products
    for each lag, and these are added up. So a long series is spread, and a reading goes to two blocks or so. At
    most one reading a time is expected; null values and times are left out.
    """
    reach = max(lags)
    placed = with_positions(rows.filter(F.col(value).isNotNull()).select(*keys, F.col(time).alias("_t"), F.col(value).cast("double").alias("_v")), keys, "_t", [])
    means = placed.groupBy(*keys).agg(F.avg("_v").alias("_mean"))
    centred = join_same(placed, means, keys).select(*keys, "_pos", (F.col("_v") - F.col("_mean")).alias("_x"))
    first = F.greatest(F.floor((F.col("_pos") - reach) / block), F.lit(0)).cast("bigint")
    spread = centred.withColumn("_block", F.explode(F.sequence(first, F.floor(F.col("_pos") / block).cast("bigint"))))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos", ignore_index=True)
        x, own = pdf["_x"].to_numpy(), int((pdf["_pos"] < (pdf["_block"].iloc[0] + 1) * block).sum())
        found = [float(x[: max(0, min(own, len(x) - g))] @ x[g : g + max(0, min(own, len(x) - g))]) for g in (0, *lags)]
        used = [min(own, len(x) - g) > 0 for g in (0, *lags)]
        out = pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(found) for k in keys}, "lag": [0, *lags], "_s": found})
        return out[used]

    sums = spread.groupBy(*keys, "_block").applyInPandas(products, f"{kinds}, lag bigint, _s double").groupBy(*keys, "lag").agg(F.sum("_s").alias("_s"))
    power = F.max(F.when(F.col("lag") == 0, F.col("_s"))).over(Window.partitionBy(*keys))  # a row a lag
    return sums.withColumn("_p", power).filter("lag > 0").select(*keys, "lag", F.when(F.col("_p") > 1e-12, F.col("_s") / F.col("_p")).alias("acf"))


def dominant_period(acf: DataFrame, keys: list[str], height: float = 0.08, distance: int = 3) -> DataFrame:
    """The lag of each series' highest local maximum of at least `height`, no higher one within `distance`; null without."""
    w = Window.partitionBy(*keys).orderBy("lag")
    peak = (F.col("acf") > F.lag("acf").over(w)) & (F.col("acf") > F.lead("acf").over(w)) & (F.col("acf") >= height)
    near = F.max("acf").over(w.rowsBetween(-(distance - 1), distance - 1))
    found = acf.withColumn("_peak", F.coalesce(peak, F.lit(False)) & (F.col("acf") >= near))
    return found.groupBy(*keys).agg(F.max_by(F.when(F.col("_peak"), F.col("lag")), F.when(F.col("_peak"), F.col("acf"))).alias("period"))


def spike_intervals(spikes: DataFrame, keys: list[str], position: str, period: int, within: int = 2) -> DataFrame:
    """Share of the gaps between successive spikes that are near a multiple of the period."""
    gap = F.col(position) - F.lag(position).over(Window.partitionBy(*keys).orderBy(position))
    rest = F.pmod(F.col("gap"), F.lit(period))
    gaps = spikes.withColumn("gap", gap).filter("gap is not null")
    hits = F.count_if(F.least(rest, F.lit(period) - rest) <= within)
    return gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gaps"), hits.alias("n_near"), (hits / F.count(F.lit(1))).alias("share_near"))


def largest_gap(rows: DataFrame, keys: list[str], score: str, share: float = 0.30, least: int = 5, enough: int = 10) -> DataFrame:
    """The midpoint of the largest gap among the top share of each group's scores; null with fewer than
    `enough` scores, a flat range or no gap."""
    group = Window.partitionBy(*keys)
    ranked = rows.filter(F.col(score).isNotNull()).select(*keys, F.col(score).alias("_s")).withColumns(
        {"_r": F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_s"))), "_n": F.count(F.lit(1)).over(group), "_span": F.max("_s").over(group) - F.min("_s").over(group)}
    )
    top = ranked.filter(F.col("_r") <= F.least(F.col("_n"), F.greatest(F.lit(least), F.ceil(F.lit(share) * F.col("_n")))))
    gaps = top.withColumn("_next", F.lead("_s").over(Window.partitionBy(*keys).orderBy("_r"))).withColumn("_gap", F.col("_s") - F.col("_next"))
    best = gaps.groupBy(*keys).agg(F.max("_gap").alias("gap"), F.max_by((F.col("_s") + F.col("_next")) / 2, F.struct("_gap", -F.col("_r"))).alias("_mid"), F.max("_n").alias("n"), F.max("_span").alias("_span"))
    fine = (F.col("n") >= enough) & (F.col("_span") > 1e-12) & (F.col("gap") > 0)
    return best.select(*keys, "n", F.when(fine, F.col("_mid")).alias("threshold"))


def sign_flips(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Sign changes between successive values that are not zero (beyond 1e-12)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    signs = rows.filter(F.abs(value) > 1e-12).withColumn("_s", F.signum(value)).withColumn("_flip", F.coalesce((F.col("_s") != F.lag("_s").over(w)).cast("int"), F.lit(0)))
    return signs.groupBy(*keys).agg(F.sum("_flip").alias("sign_flips"))


def slot_of_day(time: Column, minutes: int) -> Column:
    return F.floor((F.hour(time) * 60 + F.minute(time)) / minutes).cast("bigint")


def slot_profile(rows: DataFrame, keys: list[str], time: str, value: str, minutes: int = 60) -> DataFrame:
    """Median and quartiles by slot of the day."""
    q = lambda p: F.percentile(value, F.lit(p))
    return rows.groupBy(*keys, slot_of_day(F.col(time), minutes).alias("slot")).agg(F.count(value).alias("n"), q(0.5).alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"))


def fourier_template(rows: DataFrame, keys: list[str], time: str, value: str, normal: Column, harmonics: int = 4) -> DataFrame:
    """Adds `template` and `residual_z`: a daily curve of a few harmonics fitted to the normal rows of each
    group by least squares, and the residual over the normal rows' deviation (ddof 0).

    The normal equations are sums over all rows, one row a group; they are solved where they are.
    """
    angle = (F.hour(time) * 60 + F.minute(time)) / F.lit(1440.0) * F.lit(2 * np.pi)
    basis = [F.lit(1.0)] + [f(angle * k) for k in range(1, harmonics + 1) for f in (F.sin, F.cos)]
    p = len(basis)
    shaped = rows.withColumn("_b", F.array(*basis))
    fit = shaped.filter(normal & F.col(value).isNotNull())
    b = lambda i: F.get("_b", F.lit(i))
    sums = fit.groupBy(*keys).agg(
        F.array(*[F.sum(b(i) * b(j)) for i in range(p) for j in range(p)]).alias("_xx"), F.array(*[F.sum(b(i) * F.col(value)) for i in range(p)]).alias("_xy"),
        F.sum(F.col(value) * F.col(value)).alias("_yy"), F.count(F.lit(1)).alias("_n"),
    )

    def solve(batches):
        for pdf in batches:
            coef, dev = [], []
            for xx, xy, yy, n in zip(pdf["_xx"], pdf["_xy"], pdf["_yy"], pdf["_n"], strict=True):
                m, v = np.asarray(xx).reshape(p, p), np.asarray(xy)
                c = np.linalg.lstsq(m, v, rcond=None)[0]
                left = (yy - 2 * c @ v + c @ m @ c) / n - ((v[0] - m[0] @ c) / n) ** 2
                coef.append(c.tolist())
                dev.append(float(np.sqrt(max(left, 0.0))))
            yield pdf.drop(columns=["_xx", "_xy", "_yy", "_n"]).assign(_c=coef, _sd=dev)

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*keys).schema.fields) + ", _c array<double>, _sd double"
    solved = sums.mapInPandas(solve, shape)
    value_at = F.aggregate(F.zip_with("_c", "_b", lambda c, x: c * x), F.lit(0.0), lambda a, x: a + x)
    out = shaped.join(solved, keys).withColumn("template", value_at)
    return out.withColumn("residual_z", F.when(F.col("_sd") > 0, (F.col(value) - F.col("template")) / F.col("_sd"))).drop("_b", "_c", "_sd")
