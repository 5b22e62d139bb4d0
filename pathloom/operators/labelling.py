"""Unsupervised labelling: detectors, their weighted vote, thresholds, and diagnostics of labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.stats import correlation

LABELS = ("likely_normal", "uncertain", "likely_anomalous", "highly_anomalous")


def column_stats(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row (a group): n, mean, deviations and quartiles of each column, as c__mean and so on."""
    out = []
    for c in columns:
        q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        out += [F.count(c).alias(f"{c}__n"), F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__pop"), F.stddev_samp(c).alias(f"{c}__samp"), q.alias(f"{c}__q")]
    return rows.groupBy(*keys).agg(*out)


def with_stats(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows beside the statistics of all rows: one row is broadcast."""
    return rows.crossJoin(F.broadcast(column_stats(rows, columns)))


def finite_rows(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.filter(F.forall(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def robust_scale(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - median) / interquartile range, a range of zero counting as one; exact quartiles."""
    s = with_stats(rows, columns)
    scaled = [((F.col(c) - F.get(f"{c}__q", F.lit(1))) / F.when(F.get(f"{c}__q", F.lit(2)) > F.get(f"{c}__q", F.lit(0)), F.get(f"{c}__q", F.lit(2)) - F.get(f"{c}__q", F.lit(0))).otherwise(1.0)).alias(c) for c in columns]
    return s.select(*[c for c in rows.columns if c not in columns], *scaled)


def outlier_score(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds `z_iqr_score`: the mean over columns of (abs z > 3) and (outside 1.5 interquartile ranges), halved."""
    s = with_stats(rows, columns)
    total = F.lit(0.0)
    for c in columns:
        z = F.when(F.col(f"{c}__pop") > 0, F.abs((F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__pop"))).otherwise(0.0)
        q1, q3 = F.get(f"{c}__q", F.lit(0)), F.get(f"{c}__q", F.lit(2))
        outside = (F.col(c) < q1 - 1.5 * (q3 - q1)) | (F.col(c) > q3 + 1.5 * (q3 - q1))
        total = total + F.coalesce((z > 3).cast("double"), F.lit(0.0)) + F.coalesce(outside.cast("double"), F.lit(0.0))
    return s.select(*rows.columns, (total / (2 * len(columns))).alias("z_iqr_score"))


def mad_threshold(rows: DataFrame, score: str, times: float = 3.0) -> DataFrame:
    """One row: median + times * 1.4826 * MAD; the deviation (ddof 0) instead of a MAD of zero, and the 95 %
    quantile if that is zero too."""
    middle = rows.agg(F.median(score).alias("_m"))
    spread = rows.crossJoin(F.broadcast(middle)).agg(
        F.first("_m").alias("median"), F.median(F.abs(F.col(score) - F.col("_m"))).alias("mad"), F.stddev_pop(score).alias("_sd"), F.percentile(score, F.lit(0.95)).alias("_q95")
    )
    limit = F.when(F.col("mad") > 0, F.col("median") + times * 1.4826 * F.col("mad")).when(F.col("_sd") > 0, F.col("median") + times * F.col("_sd")).otherwise(F.col("_q95"))
    return spread.select("median", "mad", limit.alias("threshold"))


def vote_weights(votes: DataFrame, methods: Sequence[str]) -> DataFrame:
    """method, weight: 1 / (1 + mean absolute correlation with the others), over their sum. Methods that
    never vary have none; if no method varies, all have the same."""
    pairs = [(a, b) for a in methods for b in methods if a != b]
    flat = votes.agg(*[F.stddev_pop(F.col(m).cast("double")).alias(m) for m in methods], *[correlation(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    rows = [
        F.struct(
            F.lit(m).alias("method"), F.col(m).alias("sd"),
            F.filter(F.array(*[F.when(F.col(o) > 0, F.abs(f"{m}|{o}")) for o in methods if o != m]), lambda x: x.isNotNull() & ~F.isnan(x)).alias("r"),
        ) for m in methods
    ]
    each = flat.select(F.explode(F.array(*rows)).alias("x")).select("x.*").withColumn("_any", F.max("sd").over(Window.partitionBy(F.lit(0))))  # a row a method
    each = each.filter("sd > 0 or coalesce(_any, 0) = 0")
    mean = F.when(F.size("r") > 0, F.aggregate("r", F.lit(0.0), lambda a, x: a + x) / F.size("r")).otherwise(0.0)
    raw = each.select("method", (1 / (1 + mean)).alias("w"))
    return raw.withColumn("weight", F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(0)))).drop("w")  # a row a method


def vote_thresholds(weights: Column) -> Column:
    """struct(uncertain, likely, high) from an array of weights: the smallest; the sum of the smallest half
    and one (two at least); one less the largest, not below likely (1 with two methods or fewer)."""
    ordered, n = F.array_sort(weights), F.size(weights)
    half = F.greatest(F.ceil((n + 1) / 2), F.lit(2)).cast("int")
    likely = F.aggregate(F.slice(ordered, F.lit(1), half), F.lit(0.0), lambda a, x: a + x)
    high = F.when(n <= 2, F.lit(1.0)).otherwise(F.least(F.greatest(1 - F.array_max(weights), likely), F.lit(1.0)))
    return F.struct(F.array_min(weights).alias("uncertain"), likely.alias("likely"), high.alias("high"))


def consensus(votes: DataFrame, methods: Sequence[str], leave_out: str | None = None) -> DataFrame:
    """Adds `consensus_score` and `label` of the weighted vote (one row of weights is broadcast)."""
    used = [m for m in methods if m != leave_out]
    w = vote_weights(votes, used)
    packed = w.agg(F.map_from_entries(F.collect_list(F.struct("method", "weight"))).alias("_w"))
    packed = packed.withColumn("_t", vote_thresholds(F.map_values("_w")))
    score = F.lit(0.0)
    for m in used:
        score = score + F.coalesce(F.try_element_at("_w", F.lit(m)), F.lit(0.0)) * F.col(m).cast("double")
    s = F.round("consensus_score", 12)
    label = F.when(s >= F.round("_t.high", 12), LABELS[3]).when(s >= F.round("_t.likely", 12), LABELS[2]).when(s >= F.round("_t.uncertain", 12), LABELS[1]).otherwise(LABELS[0])
    return votes.crossJoin(F.broadcast(packed)).withColumn("consensus_score", score).withColumn("label", label).drop("_w", "_t")


def binary_label(label: Column) -> Column:
    return label.isin(LABELS[2], LABELS[3]).cast("int")


def label_churn(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """One row: pairs, and the shares that changed, of four classes and of two."""
    return pairs.agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(before) != F.col(after)).cast("double")).alias("changed_4"), F.avg((binary_label(F.col(before)) != binary_label(F.col(after))).cast("double")).alias("changed_2")
    )


def transition_matrix(pairs: DataFrame, before: str, after: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """A row for each class before, a column for each class after; 0 where there are none."""
    counts = pairs.groupBy(before).pivot(after, list(labels)).agg(F.count(F.lit(1)))
    listed = pairs.sparkSession.createDataFrame([(x,) for x in labels], f"{before} string")
    return F.broadcast(listed).join(counts, before, "left").na.fill(0)


def crosstab_with_margins(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by (a, b), a, b and in all ('All'), and the share of each within its a."""
    sets = rows.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping(a).alias("_ga"), F.grouping(b).alias("_gb"))
    named = sets.select(F.when(F.col("_ga") == 1, "All").otherwise(F.col(a)).alias(a), F.when(F.col("_gb") == 1, "All").otherwise(F.col(b)).alias(b), "n")
    whole = F.max(F.when(F.col(b) == "All", F.col("n"))).over(Window.partitionBy(a))
    return named.withColumn("share", F.col("n") / whole)


def effect_sizes(rows: DataFrame, columns: Sequence[str], flag: Column) -> DataFrame:
    """feature, d: the flagged rows' mean less the others', over the pooled deviation (ddof 1)."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns]))
    long = rows.select(flag.alias("_f"), cells.alias("c")).select("_f", "c.feature", "c.x").filter("_f is not null and x is not null")
    one, two = F.when(F.col("_f"), F.col("x")), F.when(~F.col("_f"), F.col("x"))
    s = long.groupBy("feature").agg(F.count(one).alias("n1"), F.count(two).alias("n0"), F.avg(one).alias("m1"), F.avg(two).alias("m0"), F.var_samp(one).alias("v1"), F.var_samp(two).alias("v0"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / F.nullif(F.col("n1") + F.col("n0") - 2, F.lit(0)))
    return s.select("feature", "n1", "n0", F.when(pooled > 0, (F.col("m1") - F.col("m0")) / pooled).alias("d")).withColumn("direction", F.when(F.col("d") > 0, "higher").when(F.col("d") < 0, "lower").otherwise("equal"))


def deviations(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], during: Column) -> DataFrame:
    """(keys, feature, z): distance of the incident's mean from the padding's over the padding's deviation (ddof 1), to
    three digits; features with fewer than 3 padding values or hardly any variance are left out."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns]))
    long = rows.withColumn("_in", during).select(*keys, "_in", cells.alias("c")).select(*keys, "_in", "c.feature", "c.x").filter("x is not null")
    pad, inc = F.when(~F.col("_in"), F.col("x")), F.when(F.col("_in"), F.col("x"))
    s = long.groupBy(*keys, "feature").agg(F.count(pad).alias("n0"), F.avg(pad).alias("m0"), F.stddev_samp(pad).alias("s0"), F.avg(inc).alias("m1"))
    s = s.filter((F.col("n0") >= 3) & (F.col("s0") >= F.greatest(F.abs("m0") * 1e-4, F.lit(1e-6))) & F.col("m1").isNotNull())
    return s.withColumn("z", F.round(F.abs(F.col("m1") - F.col("m0")) / F.col("s0"), 3))


def visibility(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], during: Column, top: int = 10) -> DataFrame:
    """Whether an incident stands out from its padding: number of features with z >= 2, the list and the mean of
    the highest z, and a verdict.

    visible: at least 3 such features and a mean of the top z >= 0.5; marginal: at least one of them and that mean;
    invisible otherwise. 'no_incident' and 'no_padding' (fewer than 3 rows) are special.
    """
    sizes = rows.withColumn("_in", during).groupBy(*keys).agg(F.count_if("_in").alias("n_during"), F.count_if(~F.col("_in")).alias("n_padding"))
    z = deviations(rows, keys, columns, during)
    ranked = z.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("z"), "feature")))
    listed = F.array_sort(F.collect_list(F.when(F.col("_r") <= top, F.struct("_r", F.concat_ws(":", "feature", F.format_number("z", 3)).alias("t")))))  # `top` of them at most
    got = ranked.groupBy(*keys).agg(F.count_if(F.col("z") >= 2).alias("n_deviant"), F.avg(F.when(F.col("_r") <= top, F.col("z"))).alias("top_mean_z"), F.array_join(F.transform(listed, lambda x: x.t), " ").alias("top_z"))
    out = sizes.join(got, list(keys), "left").na.fill(0, ["n_deviant"]).na.fill(0.0, ["top_mean_z"]).na.fill("", ["top_z"])
    stands_out = F.col("top_mean_z") >= 0.5
    verdict = (
        F.when(F.col("n_during") == 0, "no_incident").when(F.col("n_padding") < 3, "no_padding").when((F.col("n_deviant") >= 3) & stands_out, "visible")
        .when((F.col("n_deviant") >= 1) & stands_out, "marginal").otherwise("invisible")
    )
    return out.withColumn("verdict", verdict)


def corroborated(rows: DataFrame, columns: Sequence[str], label: str, spike: str, low: float = 0.01, high: float = 0.99, least: int = 2) -> DataFrame:
    """Relabels anomalies of a periodic feature that too few other features support: fewer than `least` of
    them outside the normal rows' 1 % to 99 % range, and the spike itself not beyond five times the normal
    maximum. Bounds come from the labels as given, whatever is relabelled."""
    normal = rows.filter(F.col(label) == LABELS[0])
    bounds = normal.agg(*[F.percentile(c, F.array(F.lit(low), F.lit(high))).alias(f"{c}__b") for c in columns], F.max(spike).alias("_most"))
    s = rows.crossJoin(F.broadcast(bounds))
    others = sum((F.coalesce(((F.col(c) < F.get(f"{c}__b", F.lit(0))) | (F.col(c) > F.get(f"{c}__b", F.lit(1)))).cast("int"), F.lit(0)) for c in columns if c != spike), F.lit(0))
    anomalous = F.col(label).isin(LABELS[2], LABELS[3])
    weak = anomalous & (others < least) & ~F.coalesce(F.col(spike) > 5 * F.col("_most"), F.lit(False))
    return s.select(*rows.columns, others.alias("n_outside"), F.when(weak, LABELS[0]).otherwise(F.col(label)).alias("relabelled"))


def subsample_stability(votes: DataFrame, key: str, methods: Sequence[str], rounds: int = 20, share: float = 0.8) -> DataFrame:
    """Each row's most frequent label over subsamples (ties: by text), and how often it had it.

    Subsamples are drawn by a hash of (round, key). Only the weights depend on the sample, so a round is one
    aggregate of `methods` numbers.
    """
    draw = lambda b: F.pmod(F.xxhash64(F.lit(b), F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000)
    parts = []
    for b in range(rounds):
        sample = votes.filter(draw(b))
        parts.append(consensus(sample, methods).select(key, "label"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    counts = every.groupBy(key, "label").agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy(key).agg(F.min_by("label", F.struct(-F.col("_n"), F.col("label"))).alias("modal_label"), F.max("_n").alias("_most"), F.sum("_n").alias("drawn"))
    return best.withColumn("agreement", F.col("_most") / F.col("drawn")).drop("_most")
