"""Filters, column choices, summaries and top-k reports over features, labels and scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.grid import MICRO
from pathloom.operators.labelling import LABELS

# Measures of the graph view and of the statistical view; any other name belongs to neither.
GRAPH_MEASURES = ("n_nodes", "n_edges", "degree", "density", "assortativity", "clustering_global", "diameter", "consensus_score")
STAT_MEASURES = ("announcements", "withdrawals", "total_updates", "ann_rate", "wd_rate", "unique_prefixes_ann", "as_path_avg", "unique_peers")


def label_filter(rows: DataFrame, label: str, mode: str = "all", labels: Sequence[str] = ()) -> DataFrame:
    """all; anomalies (likely and highly anomalous); non_normal (whatever is not likely normal); specific (the given
    labels). Rows without label are kept by `all` alone."""
    if mode == "all":
        return rows
    chosen = {"anomalies": F.col(label).isin(*LABELS[2:]), "non_normal": F.col(label) != LABELS[0], "specific": F.col(label).isin(*labels) if labels else F.lit(False)}
    if mode not in chosen:
        raise ValueError(f"no such mode: {mode}")
    return rows.filter(chosen[mode])


def provenance_filter(rows: DataFrame, provenance: str, mode: str = "both") -> DataFrame:
    """Rows of one provenance ('study' or 'historical'), compared trimmed in lower case, or of both."""
    if mode not in ("study", "historical", "both"):
        raise ValueError(f"no such provenance: {mode}")
    own = F.lower(F.btrim(provenance))
    return rows.filter(own.isin("study", "historical") if mode == "both" else own == mode)


def numeric_columns(rows: DataFrame, metadata: Sequence[str]) -> list[str]:
    """Names of the numeric columns but for those of metadata, whose case does not matter."""
    out = {m.lower() for m in metadata}
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, kind in rows.dtypes if (kind in kinds or kind.startswith("decimal")) and c.lower() not in out]


def ordered_columns(rows: DataFrame, first: Sequence[str]) -> DataFrame:
    """The given columns first, in their order as far as they exist, then all others by name."""
    known = [c for c in first if c in rows.columns]
    return rows.select(*[f"`{c}`" for c in known + sorted(c for c in rows.columns if c not in known)])


def ordered_intersection(lists: Sequence[Sequence[str]]) -> list[str]:
    """What all lists hold, once, in the order of the first."""
    if not lists:
        return []
    rest = [set(x) for x in lists[1:]]
    return [c for c in dict.fromkeys(lists[0]) if all(c in r for r in rest)]


def covered_items(rows: DataFrame, keys: Sequence[str], item: str, snapshot: str, share: float = 0.75) -> DataFrame:
    """Rows whose item is in at least `share` of its group's snapshots (max(1, floor(n * share)) of n).

    Snapshots are counted by distinct (item, snapshot) pairs, combined map-side; rows join the items that
    remain. Rows with a null item are left out.
    """
    pairs = rows.filter(F.col(item).isNotNull()).select(*keys, item, snapshot).distinct()
    n = pairs.select(*keys, snapshot).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    held = pairs.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("_n"))
    fit = (held.join(n, list(keys)) if keys else held.crossJoin(F.broadcast(n))).filter(F.col("_n") >= F.greatest(F.lit(1), F.floor(F.col("_all") * share)))
    return rows.join(fit.select(*keys, item), [*keys, item], "left_semi")


def feature_domain(name: Column, graph: Sequence[str] = GRAPH_MEASURES, stat: Sequence[str] = STAT_MEASURES) -> Column:
    """graph, statistical or other."""
    return F.when(name.isin(*graph), "graph").when(name.isin(*stat), "statistical").otherwise("other")


def pair_domain(a: Column, b: Column, **lists: Sequence[str]) -> Column:
    """The two features' domains in order, joined by a hyphen."""
    return F.array_join(F.array_sort(F.array(feature_domain(a, **lists), feature_domain(b, **lists))), "-")


def log_weight(weight: Column) -> Column:
    """log(1 + weight); null and negative weights count as 0."""
    return F.log1p(F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0)))


def overlapping(rows: DataFrame, intervals: DataFrame, keys: Sequence[str], a: str, b: str, start: str, end: str, bucket_seconds: int = 86_400) -> DataFrame:
    """Pairs of a row's span and an interval of its group that overlap: a < end and b > start; touching does not count.

    Both sides are listed by the buckets they touch and meet there, so no theta join is left; a pair is
    given in the first bucket both touch. Intervals' columns are given as `other_...`. Null ends overlap nothing.
    """
    size = F.lit(bucket_seconds * MICRO)
    number = lambda c: F.floor(F.unix_micros(c) / size).cast("bigint")
    left = rows.filter(F.col(a) <= F.col(b)).withColumn("_bucket", F.explode(F.sequence(number(a), number(b))))
    right = intervals.filter(F.col(start) <= F.col(end)).select(*[F.col(c).alias(f"other_{c}") for c in intervals.columns], F.explode(F.sequence(number(start), number(end))).alias("_at"))
    s, e = F.col(f"other_{start}"), F.col(f"other_{end}")
    on = (F.col("_bucket") == F.col("_at")) & (F.col(a) < e) & (F.col(b) > s) & (F.col("_bucket") == F.greatest(number(a), number(f"other_{start}")))
    for k in keys:
        on = on & (F.col(k) == F.col(f"other_{k}"))
    return left.join(right, on).drop("_bucket", "_at")


def joined_with_suffix(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str = "_graph") -> DataFrame:
    """Left join; columns that both sides have keep their name on the left and get the suffix on the right."""
    named = [F.col(c).alias(f"{c}{suffix}" if c in left.columns and c not in keys else c) for c in right.columns]
    return left.join(right.select(*named), list(keys), "left")


def pair_metadata(pairs: DataFrame, meta: DataFrame, name: str = "feature") -> DataFrame:
    """Pairs (feature_a, feature_b) with the metadata of both, as column_a and column_b."""
    out = pairs
    for side in ("a", "b"):
        own = meta.select(*[F.col(c).alias(f"{name}_{side}" if c == name else f"{c}_{side}") for c in meta.columns])
        out = out.join(own, f"{name}_{side}", "left")
    return out


def described(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, count, mean, std (ddof 1), min, quartiles (exact, interpolated) and max: one aggregation over all columns."""
    parts = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    one = lambda c: F.struct(
        F.lit(c).alias("feature"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(F.col(c).cast("double")).alias("min"),
        F.percentile(F.col(c).cast("double"), parts).alias("q"), F.max(F.col(c).cast("double")).alias("max"),
    )
    flat = rows.agg(*[one(c).alias(f"_{i}") for i, c in enumerate(columns)])
    s = flat.select(F.explode(F.array(*[f"_{i}" for i in range(len(columns))])).alias("s")).select("s.*")
    return s.select("feature", "count", "mean", "std", "min", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q25", "median", "q75"))], "max")


def group_means(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Means of metrics by block or scenario, with the number of rows."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns])


def mention_table(mentions: DataFrame, item: str, by: str, names: Sequence[str]) -> DataFrame:
    """How often each item is named by each method: a row an item, a column a method, 0 where it is not."""
    return mentions.groupBy(item).pivot(by, list(names)).agg(F.count(F.lit(1))).na.fill(0)


def batch_verdict(results: DataFrame, keys: Sequence[str], value: str, ok: Column, spread: float = 0.1) -> DataFrame:
    """Whether the data sets of a batch agree: least and greatest value, whether all and how many are ok, and a verdict:
    consistent (all ok, values within `spread`), varying (all ok), mixed (some ok) or failing."""
    s = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_sets"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.coalesce(F.every(ok), F.lit(False)).alias("all_ok"), F.count_if(ok).alias("n_ok")
    )
    verdict = F.when(F.col("all_ok") & (F.col("greatest") - F.col("least") <= spread), "consistent").when(F.col("all_ok"), "varying").when(F.col("n_ok") > 0, "mixed").otherwise("failing")
    return s.withColumn("verdict", verdict)


def top_rows(rows: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of all, by an order that should end in a key; each task keeps k of its own before the last merge."""
    return rows.orderBy(*order).limit(k)


def top_of_groups(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group with their `rank`; a task keeps k of a group before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def balanced_top(rows: DataFrame, group: str, order: Sequence[Column], k: int, groups: Sequence[str]) -> DataFrame:
    """k rows of the given groups, equally many of each; what a group cannot fill goes to the best of the rest.

    Of each group the best k alone can be chosen, so k * groups rows at most are ordered together.
    """
    quota = max(1, k // max(1, len(groups)))
    few = top_of_groups(rows.filter(F.col(group).isin(*groups)), [group], order, k)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy((F.col("rank") > quota).cast("int"), *order))  # k * groups rows
    return few.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place", "rank")


def best_of_groups(rows: DataFrame, keys: Sequence[str], item: str, value: str) -> DataFrame:
    """The item with the highest mean value of each group (ties: first by name)."""
    means = rows.groupBy(*keys, item).agg(F.avg(value).alias("mean"))
    return means.groupBy(*keys).agg(F.min_by(item, F.struct(-F.round("mean", 12), F.col(item))).alias(item), F.max("mean").alias("mean"))


def renamed(rows: DataFrame, names: Mapping[str, str], leave_out: Sequence[str] = ()) -> DataFrame:
    """Columns under their readable names, some left out."""
    return rows.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in rows.columns if c not in leave_out])


def label_comparison(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """Counts of each (before, after), their share of `before`, and what to do: keep, review or relabel."""
    counts = pairs.groupBy(before, after).agg(F.count(F.lit(1)).alias("n"))
    share = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(before)))  # a row a pair of labels
    advice = F.when(F.col(before).eqNullSafe(F.col(after)), "keep").when(F.col("share") >= 0.5, "relabel").otherwise("review")
    return share.withColumn("advice", advice)
