"""Mixing sources to target shares of tokens by entropy balancing."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.session import cut


@dataclass
class _Dual:
    """The dual of one source's token constraint: its multiplier, bracketed while Newton's steps are taken."""

    target: float
    available: float
    cap: int
    scale: float  # mean tokens of a document, so that multipliers are of order one
    value: float = 0.0
    low: float = -math.inf
    high: float = math.inf
    done: bool = False
    short: bool = False  # the multiplier went up until every document was at its cap, and the target is not reached

    def step(self, reached: float, slope: float, below_cap: int, tolerance: float) -> None:
        miss = reached - self.target
        if miss < 0 and not below_cap:  # the dual has no maximum: the constraint cannot be met
            self.done = self.short = True
            return
        if abs(miss) <= tolerance * max(self.target, 1.0):
            # within the tolerance of the target, but is the target itself within the caps?
            self.done, self.short = True, miss < 0 and self.available * self.cap < self.target
            return
        if miss > 0:
            self.high = min(self.high, self.value)
        else:
            self.low = max(self.low, self.value)
        new = self.value - miss / slope if slope > 0 else math.nan
        if not (self.low < new < self.high):  # outside of the bracket, or no slope: halve or double instead
            if math.isinf(self.low):
                new = self.high * 2 - 1 if self.high <= 0 else -1.0
            elif math.isinf(self.high):
                new = self.low * 2 + 1 if self.low >= 0 else 1.0
            else:
                new = (self.low + self.high) / 2
        if self.high - self.low < 1e-13:
            self.done = True
        self.value = new


def _state(like: DataFrame, duals: dict[str, _Dual]) -> DataFrame:
    """The duals as a table of a row a source."""
    rows = [(s, d.value, d.scale, float(d.cap)) for s, d in sorted(duals.items())]
    return like.sparkSession.createDataFrame(rows, "source string, v double, scale double, cap double")


def _rated(counts: DataFrame, duals: dict[str, _Dual]) -> DataFrame:
    """`rate` of each length of the sources with duals: exp(multiplier * tokens), at most the cap (column `cap`)."""
    exponent = F.col("v") * F.col("tokens") / F.col("scale")
    rate = F.when(exponent >= F.log("cap"), F.col("cap")).otherwise(F.exp(F.least(exponent, F.log("cap"))))
    return counts.join(_state(counts, duals), "source").withColumn("rate", rate)


def _rounded_copies(lengths: pd.DataFrame) -> pd.DataFrame:
    """Copies of all documents of each length of one source, the longest first: what their rates give, more or less by
    what the longer ones are off in tokens, so that the shortest documents settle the error."""
    lengths = lengths.sort_values("tokens", ascending=False, ignore_index=True)
    off, out = 0.0, []
    for tokens, n, rate in zip(lengths["tokens"].tolist(), lengths["n"].tolist(), lengths["rate"].tolist(), strict=True):
        off += n * rate * tokens
        least, most = n * math.floor(rate + 1e-9), n * math.ceil(rate - 1e-9)
        copies = min(max(math.floor(off / tokens + 0.5), least), most)
        off -= copies * tokens
        out.append(copies)
    lengths["copies"] = out
    return lengths[["source", "tokens", "n", "rate", "copies"]]


def mix(
    docs: DataFrame, key: str, source: str, tokens: str, targets: DataFrame, total_tokens: int | None = None,
    tolerance: float = 1e-7, rounds: int = 100, feasible: bool = False, per_task: int = 500_000,
) -> tuple[DataFrame, DataFrame]:
    """Copies of each document, and a report by source.

    docs: key, source, tokens. targets: source, target_share, max_repeats. Sources compare trimmed, in lower
    case. The mixture is as large as all documents together, or total_tokens; with `feasible` it is no larger than
    what lets every source reach its share, so that shares hold where some source is scarce.

    The rates r of a source's documents have greatest entropy under sum(r * tokens) = its target and
    0 <= r <= max_repeats: r = min(max_repeats, exp(multiplier * tokens)). Newton's method on the convex dual
    finds the multipliers; each round is one aggregation over (source, tokens) counts, of which one row a
    source of the targets (a parameter) reaches the driver. If a source cannot reach its target, its dual has no
    maximum: the multiplier rises until all its documents are at the cap, and the source is marked not reachable.

    Rates become copies length by length, the longest documents first; what these are off in tokens is made up
    for by the shorter ones, each document having the whole number of copies below or above its rate. So a
    source misses its tokens by about one short document. Among documents of one length the copies beyond the
    lower number are spread evenly in order of a hash of the key, numbered in parts of about per_task documents.

    Documents of other sources, without source or without tokens get no copies. Null shares count as 0, null
    repeats as 1.

    Gives (key, source, tokens, rate, copies) and (source, target_share, max_repeats, documents,
    available_tokens, target_tokens, reachable, mixed_tokens, reached_share).
    """
    name = F.lower(F.btrim(F.col(source)))
    rows = docs.select(F.col(key).alias(key), name.alias("source"), F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("tokens"))
    listed = (
        targets.select(F.lower(F.btrim("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("cap"))
        .filter("source is not null").groupBy("source").agg(F.sum("share").alias("share"), F.max("cap").alias("cap")).collect()
    )
    counts = cut(rows.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")))
    whole = total_tokens if total_tokens is not None else counts.agg(F.sum(F.col("n") * F.col("tokens"))).first()[0] or 0
    names = docs.sparkSession.createDataFrame([(r.source,) for r in listed], "source string")
    wanted = counts.filter("tokens > 0").join(names, "source", "left_semi")
    stock = {r.source: r for r in wanted.groupBy("source").agg(F.sum(F.col("n") * F.col("tokens")).alias("tokens"), F.sum("n").alias("n")).collect()}
    if feasible:
        most = [(stock[r.source].tokens if r.source in stock else 0) * max(0, int(r.cap)) / r.share for r in listed if r.share > 0]
        whole = min([whole, *most])
    duals: dict[str, _Dual] = {}
    for r in listed:
        have = stock.get(r.source)
        d = duals[r.source] = _Dual(r.share * whole, float(have.tokens) if have else 0.0, max(0, int(r.cap)), have.tokens / have.n if have else 1.0)
        if d.target <= 0 or d.cap == 0 or not d.available:  # nothing wanted or nothing there: no multiplier to find
            d.done, d.short = True, d.target > 0
    solving = {s: d for s, d in duals.items() if not d.done}
    for _ in range(rounds):
        unsolved = {s: d for s, d in solving.items() if not d.done}
        if not unsolved:
            break
        free = F.col("rate") < F.col("cap")
        weight = F.col("n") * F.col("tokens") * F.col("rate")
        sums = _rated(wanted, unsolved).groupBy("source").agg(
            F.sum(weight).alias("reached"),
            F.sum(F.when(free, weight * F.col("tokens") / F.col("scale")).otherwise(0.0)).alias("slope"),
            F.count_if(free).alias("below_cap"),
        )
        for r in sums.collect():
            solving[r.source].step(r.reached, r.slope, r.below_cap, tolerance)

    lengths = _rated(wanted, solving).select("source", "tokens", "n", "rate")
    lengths = lengths.groupBy("source").applyInPandas(_rounded_copies, "source string, tokens bigint, n bigint, rate double, copies bigint")
    lengths = cut(lengths)  # a row for each length of a source
    given = lengths.select(
        F.col("source").alias("_s"), F.col("tokens").alias("_t"), "n", "rate", F.floor(F.col("copies") / F.col("n")).cast("bigint").alias("_base"), F.pmod("copies", "n").alias("_extra")
    )
    placed = rows.join(given, (F.col("source") == F.col("_s")) & (F.col("tokens") == F.col("_t")), "left").na.fill({"rate": 0.0, "_base": 0, "_extra": 0})
    even = placed.filter("_extra = 0").select(key, "source", "tokens", "rate", F.col("_base").alias("copies"))
    # documents of one length are numbered in parts: a part's first number comes from the parts' counts
    parts = max(1, -(-(lengths.agg(F.max("n")).first()[0] or 0) // per_task))
    uneven = placed.filter("_extra > 0").withColumn("_b", F.pmod(F.xxhash64(F.lit("copies"), F.col(key)), F.lit(parts)))
    sizes = uneven.groupBy("source", "tokens", "_b").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy("source", "tokens").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("source", "tokens", "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("source", "tokens", "_b").orderBy(F.xxhash64(F.col(key)), key)) + F.col("_before")
    up_to = lambda i: F.floor(i * F.col("_extra") / F.col("n"))
    numbered = uneven.join(offsets, ["source", "tokens", "_b"]).withColumn("_k", number)
    numbered = numbered.select(key, "source", "tokens", "rate", (F.col("_base") + up_to(F.col("_k")) - up_to(F.col("_k") - 1)).cast("bigint").alias("copies"))
    mixture = even.unionByName(numbered)

    facts = [(s, float(r.share), int(r.cap), int(stock[s].n) if s in stock else 0, int(duals[s].available), duals[s].target, not duals[s].short) for r in listed for s in [r.source]]
    shape = "source string, target_share double, max_repeats int, documents bigint, available_tokens bigint, target_tokens double, reachable boolean"
    known = docs.sparkSession.createDataFrame(facts, shape)
    used = lengths.filter("copies > 0").groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    all_used = used.agg(F.sum("mixed_tokens").alias("_all"))  # one row
    report = known.join(used, "source", "left").crossJoin(F.broadcast(all_used)).withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    return mixture, report.withColumn("reached_share", F.col("mixed_tokens") / F.col("_all")).drop("_all")
