"""Scores, thresholds and metrics of binary classifiers, by row and by event."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _safe(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(0.0)


def confusion(rows: DataFrame, keys: Sequence[str], y: str, pred: str) -> DataFrame:
    """Counts, precision, recall and F1 of both classes, macro-F1 and balanced accuracy; 0 for 0 / 0."""
    count = lambda a, b: F.count_if((F.col(y) == a) & (F.col(pred) == b))
    c = rows.groupBy(*keys).agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(0, 0).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return c.withColumns({
        "precision_1": _safe(tp, tp + fp), "recall_1": _safe(tp, tp + fn), "f1_1": _safe(2 * tp, 2 * tp + fp + fn), "precision_0": _safe(tn, tn + fn), "recall_0": _safe(tn, tn + fp), "f1_0": _safe(2 * tn, 2 * tn + fp + fn),
    }).withColumns({"macro_f1": (F.col("f1_1") + F.col("f1_0")) / 2, "balanced_accuracy": (F.col("recall_1") + F.col("recall_0")) / 2})


def _by_score(rows: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    """Cumulative positives and rows at each distinct score, from the highest: score counts come first, so
    the running sums are over distinct scores."""
    counts = rows.filter(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(score).alias("_s")).agg(F.sum(y).alias("_p"), F.count(F.lit(1)).alias("_n"))
    down, whole = Window.partitionBy(*keys).orderBy(F.desc("_s")), Window.partitionBy(*keys)
    return counts.withColumns({"_tp": F.sum("_p").over(down), "_at": F.sum("_n").over(down), "_pos": F.sum("_p").over(whole), "_all": F.sum("_n").over(whole)})


def average_precision(rows: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    """Sum of precision times the step of recall over distinct scores; equal scores count together."""
    c = _by_score(rows, keys, y, score)
    return c.groupBy(*keys).agg(F.sum(F.when(F.col("_pos") > 0, F.col("_p") / F.col("_pos") * F.col("_tp") / F.col("_at")).otherwise(0.0)).alias("average_precision"))


def calibration_error(rows: DataFrame, keys: Sequence[str], y: str, score: str, bins: int = 15) -> DataFrame:
    """Expected calibration error over equal bins, the last one closed."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    b = rows.filter(F.col(score).isNotNull()).groupBy(*keys, at.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"), F.avg(y).alias("_y"), F.avg(score).alias("_s"))
    return b.groupBy(*keys).agg((F.sum(F.col("_n") * F.abs(F.col("_y") - F.col("_s"))) / F.sum("_n")).alias("ece"))


def brier(rows: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(F.pow(F.col(score) - F.col(y), 2)).alias("brier"))


def best_threshold(rows: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    """The threshold (a score, 0 or 1; predicted if score >= it) of best macro-F1, the smallest of equals."""
    c = _by_score(rows, keys, y, score)
    ends = c.groupBy(*keys).agg(F.max("_pos").alias("_pos"), F.max("_all").alias("_all"), F.max("_s").alias("_top"), F.min("_s").alias("_low"))
    zero = ends.select(*keys, F.lit(0.0).alias("_s"), F.col("_pos").alias("_tp"), F.col("_all").alias("_at"), "_pos", "_all").filter("_low >= 0")
    one = ends.filter("_top < 1").select(*keys, F.lit(1.0).alias("_s"), F.lit(0).cast("bigint").alias("_tp"), F.lit(0).cast("bigint").alias("_at"), "_pos", "_all")
    every = c.select(*keys, "_s", "_tp", "_at", "_pos", "_all").unionByName(zero).unionByName(one)
    tp, fp = F.col("_tp"), F.col("_at") - F.col("_tp")
    fn, tn = F.col("_pos") - tp, F.col("_all") - F.col("_pos") - fp
    f1 = (_safe(2 * tp, 2 * tp + fp + fn) + _safe(2 * tn, 2 * tn + fp + fn)) / 2
    return every.withColumn("_f", F.round(f1, 12)).groupBy(*keys).agg(F.max_by("_s", F.struct("_f", -F.col("_s"))).alias("tau"), F.max("_f").alias("macro_f1"))


def prior_threshold(rows: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    """The quantile of the scores at one less the prior (within 1 % and 50 %), within 0.1 and 0.9."""
    prior = rows.groupBy(*keys).agg(F.least(F.greatest(F.avg(y), F.lit(0.01)), F.lit(0.5)).alias("_p"), F.sort_array(F.array(F.lit(0.0))).alias("_x")).drop("_x")
    counts = rows.filter(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    up, whole = Window.partitionBy(*keys).orderBy("_s"), Window.partitionBy(*keys)
    c = counts.withColumns({"_to": F.sum("_n").over(up), "_all": F.sum("_n").over(whole)}).join(prior, list(keys)) if keys else counts.withColumns({"_to": F.sum("_n").over(up), "_all": F.sum("_n").over(whole)}).crossJoin(F.broadcast(prior))
    at = (F.col("_all") - 1) * (1 - F.col("_p"))
    low, high = F.floor(at), F.ceil(at)
    pick = lambda i: F.min(F.when(F.col("_to") > i, F.col("_s")))
    q = c.groupBy(*keys).agg(pick(low).alias("_a"), pick(high).alias("_b"), F.max(at - low).alias("_w"), F.max("_p").alias("prior"))
    return q.select(*keys, "prior", F.least(F.greatest(F.col("_a") + F.col("_w") * (F.col("_b") - F.col("_a")), F.lit(0.1)), F.lit(0.9)).alias("tau"))


def grid_sweep(rows: DataFrame, keys: Sequence[str], y: str, score: str, grid: Sequence[float]) -> DataFrame:
    """The grid's threshold of best F1 of the positive class, the smallest of equals. One pass, counters by threshold."""
    cells = F.array(*[F.struct(F.lit(t).alias("t"), (F.col(score) >= t).alias("hit")) for t in grid])
    c = rows.select(*keys, F.col(y).alias("_y"), F.explode(cells).alias("c")).groupBy(*keys, F.col("c.t").alias("t")).agg(
        F.count_if(F.col("c.hit") & (F.col("_y") == 1)).alias("tp"), F.count_if(F.col("c.hit") & (F.col("_y") == 0)).alias("fp"), F.count_if(~F.col("c.hit") & (F.col("_y") == 1)).alias("fn")
    )
    f1 = F.round(_safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 12)
    return c.withColumn("_f", f1).groupBy(*keys).agg(F.max_by("t", F.struct("_f", -F.col("t"))).alias("tau"), F.max("_f").alias("f1"))


def late_fusion(rows: DataFrame, scores: Sequence[str], taus: Sequence[float] | None = None) -> DataFrame:
    """Adds `fused_mean` (the mean score) and `fused_or` (any score at or above its threshold)."""
    taus = taus or [0.5] * len(scores)
    total = sum((F.col(s) for s in scores[1:]), F.col(scores[0]))
    hit = F.lit(False)
    for s, t in zip(scores, taus, strict=True):
        hit = hit | F.coalesce(F.col(s) >= t, F.lit(False))
    return rows.withColumns({"fused_mean": total / len(scores), "fused_or": hit.cast("int")})


def event_recall(rows: DataFrame, keys: Sequence[str], event: str, pred: str) -> DataFrame:
    """Windows, hits, recall and whether an event was detected at all."""
    hit = F.count_if(F.col(pred) == 1)
    return rows.filter(F.col(event).isNotNull()).groupBy(*keys, event).agg(F.count(F.lit(1)).alias("n_windows"), hit.alias("n_hits"), (hit / F.count(F.lit(1))).alias("recall"), (hit > 0).alias("detected"))


def detection_rate(events: DataFrame, keys: Sequence[str], seed: str) -> DataFrame:
    """Mean detection by seed, then mean and deviation (ddof 1) over seeds."""
    by_seed = events.groupBy(*keys, seed).agg(F.avg(F.col("detected").cast("double")).alias("_r"))
    return by_seed.groupBy(*keys).agg(F.avg("_r").alias("detection_mean"), F.stddev_samp("_r").alias("detection_std"), F.count(F.lit(1)).alias("n_seeds"))


def seed_summary(rows: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(metric).alias(f"{metric}_mean"), F.stddev_samp(metric).alias(f"{metric}_std"), F.count(metric).alias("n"))


def wilcoxon(pairs: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Signed-rank statistic of a - b: zeros dropped, equal distances share ranks; with normal-approximation p.

    Ranks come from counts of distinct distances, so a group of any size is reduced before its window.
    """
    d = F.round(F.col(a) - F.col(b), 12)
    fit = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b)).select(*keys, d.alias("_d"))
    sums = fit.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("_d") > 0).alias("wins"), F.count_if(F.col("_d") == 0).alias("ties"), F.median("_d").alias("median_diff"))
    at = fit.filter("_d <> 0").groupBy(*keys, F.abs("_d").alias("_x")).agg(F.count_if(F.col("_d") > 0).alias("_up"), F.count(F.lit(1)).alias("_n"))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = at.withColumn("_rank", below + (F.col("_n") + 1) / 2)
    w = ranked.groupBy(*keys).agg(
        F.sum(F.col("_rank") * F.col("_up")).alias("w_plus"), F.sum(F.col("_rank") * (F.col("_n") - F.col("_up"))).alias("w_minus"), F.sum("_n").alias("n_used"), F.sum(F.pow("_n", F.lit(3)) - F.col("_n")).alias("_t")
    )
    n = F.col("n_used")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_t") / 48
    z = (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / F.sqrt(var)
    out = sums.join(w, list(keys), "left") if keys else sums.crossJoin(w)
    return out.withColumn("w", F.least("w_plus", "w_minus")).withColumn("p_value", F.when(var > 0, F.least(F.lit(1.0), 2 * normal_cdf(z)))).drop("_t")


def normal_cdf(z: Column) -> Column:
    """The normal distribution function by a rational approximation, good to 7.5e-8."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    # Coefficients of the approximation.
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / F.sqrt(F.lit(2 * 3.141592653589793)) * poly
    return F.when(z < 0, tail).otherwise(1 - tail)


def class_balance(rows: DataFrame, keys: Sequence[str], y: str, event: str) -> DataFrame:
    """Counts of classes and events of each domain, and the sizes of its events."""
    sizes = rows.filter(F.col(event).isNotNull()).groupBy(*keys, event).agg(F.count(F.lit(1)).alias("_n"))
    e = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"), F.min("_n").alias("min_event"), F.max("_n").alias("max_event"), F.avg("_n").alias("mean_event"))
    pos, neg = F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)
    c = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), pos.alias("n_pos"), neg.alias("n_neg"), F.count_if(F.col(y).isNull()).alias("n_uncertain"), F.when(pos > 0, neg / pos).alias("scale_pos_weight"))
    return c.join(e, list(keys), "left")


def latency_summary(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.median(value).alias("median"), F.percentile(value, F.lit(0.95)).alias("p95"), F.count(value).alias("n"))


def time_scoring(score: Callable[[DataFrame], DataFrame], rows: DataFrame, single: int = 30, batched: int = 3) -> DataFrame:
    """How long scoring takes: `kind` ('single' for one row at a time, 'batched' for all rows), `n_rows`, `ms`; a row for
    each of the given numbers of repeats, after one that does not count. For latency_summary."""
    one = rows.limit(1).cache()
    found = []
    for kind, part, times in (("single", one, single), ("batched", rows, batched)):
        n = part.count()
        for i in range(times + 1):
            began = time.perf_counter()
            score(part).write.format("noop").mode("overwrite").save()
            if i:
                found.append((kind, n, (time.perf_counter() - began) * 1000))
    one.unpersist()
    return rows.sparkSession.createDataFrame(found, "kind string, n_rows long, ms double")


def event_pivot(rows: DataFrame, event: str, column: str, names: Sequence[str], value: str) -> DataFrame:
    return rows.groupBy(event).pivot(column, list(names)).agg(F.avg(value))


def balanced_subsample(rows: DataFrame, y: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows of each class as the smaller one has, drawn by a hash of the key.

    The smaller class' size is one number; of the larger class the rows with the smallest hashes are kept:
    the cut is found from counts of hash buckets, and only the bucket it falls in is ordered.
    """

    tagged = rows.filter(F.col(y).isNotNull()).withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    tagged = tagged.withColumn("_b", F.shiftrightunsigned("_h", 48))
    counts = tagged.groupBy(y, "_b").agg(F.count(F.lit(1)).alias("_n"))  # buckets x classes rows
    total = counts.groupBy(y).agg(F.sum("_n").alias("_t")).agg(F.min("_t").alias("_k"))
    up = F.sum("_n").over(Window.partitionBy(y).orderBy("_b"))
    cuts = counts.withColumn("_to", up).withColumn("_from", F.col("_to") - F.col("_n")).crossJoin(F.broadcast(total)).select(F.col(y).alias("_y"), F.col("_b").alias("_bb"), "_from", "_to", "_k")
    met = tagged.join(cuts, (F.col(y) == F.col("_y")) & (F.col("_b") == F.col("_bb"))).filter("_from < _k")
    inside = met.filter("_to <= _k")
    edge = met.filter("_to > _k").withColumn("_r", F.row_number().over(Window.partitionBy(y, "_b").orderBy("_h", key))).filter(F.col("_r") <= F.col("_k") - F.col("_from"))
    return inside.select(*rows.columns).unionByName(edge.select(*rows.columns))


def fold_numbers(rows: DataFrame, y: str, key: str, folds: int, seed: int = 42) -> DataFrame:
    """Adds `fold`: stratified by class, in hash order within buckets of the hash, so no class is sorted in one task."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(256))
    number = F.row_number().over(Window.partitionBy(y, "_b").orderBy(F.xxhash64(F.lit(seed + 1), F.col(key)), key))
    return rows.withColumn("_b", bucket).withColumn("fold", F.pmod(number + F.col("_b"), F.lit(folds)).cast("int")).drop("_b")
