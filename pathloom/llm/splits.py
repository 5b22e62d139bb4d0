"""Splits that keep related records together, balanced by largest differencing."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.components import components
from pathloom.session import cut


def largest_differencing(weights: np.ndarray, bins: int) -> np.ndarray:
    """A bin for each weight, so that the bins' sums are as equal as differencing makes them.

    Each item starts as its own partial solution of `bins` sums. The two solutions with the largest spread
    are combined, the largest sums of one with the smallest of the other, until one is left. `bins` items
    of equal weight have spread zero when put one to a bin, so they are dealt out at once.
    """
    n = len(weights)
    order = np.argsort(-weights, kind="stable")
    out = np.zeros(n, dtype=np.int64)
    ranked = weights[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if n else np.array([], dtype=np.int64)
    ends = np.r_[starts[1:], n].astype(np.int64) if n else starts
    heap: list[tuple] = []
    ticket = 0
    for a, b in zip(starts, ends, strict=True):
        whole = (b - a) // bins * bins
        out[order[a : a + whole]] = np.arange(whole) % bins
        for i in order[a + whole : b]:
            sums = np.zeros(bins)
            sums[0] = weights[i]
            heap.append((-float(weights[i]), ticket, sums, {0: [int(i)]}))
            ticket += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, s, mine = heapq.heappop(heap)
        _, _, t, theirs = heapq.heappop(heap)
        # s is sorted from large to small, t is added from small to large
        joined = s + t[::-1]
        rank = np.argsort(-joined, kind="stable")
        place = np.empty(bins, dtype=np.int64)
        place[rank] = np.arange(bins)
        merged = {int(place[slot]): items for slot, items in mine.items()}
        for slot, items in theirs.items():
            at = int(place[bins - 1 - slot])
            few, many = sorted((items, merged.get(at, [])), key=len)
            many.extend(few)
            merged[at] = many
        sums = joined[rank]
        heapq.heappush(heap, (-float(sums[0] - sums[-1]), ticket, sums, merged))
        ticket += 1
    for slot, items in (heap[0][3] if heap else {}).items():
        out[items] = slot
    return out


def allocate_bins(sums: Sequence[float], shares: dict[str, float]) -> list[str]:
    """A split for each bin, the largest bin first: of the splits with room for it, the one that has the
    greatest part of its target left, so that large components spread over all splits; without room
    anywhere, the one with most room."""
    total = sum(sums)
    room = {name: share * total for name, share in shares.items()}
    out = [""] * len(sums)
    for i in sorted(range(len(sums)), key=lambda i: (-sums[i], i)):
        fits = [s for s in room if room[s] >= sums[i] and shares[s] > 0]
        name = max(fits, key=lambda s: (room[s] / shares[s], shares[s], s)) if fits else max(room, key=lambda s: (room[s], s))
        out[i] = name
        room[name] -= sums[i]
    return out


def balanced_bins(groups: DataFrame, key: str, weight: str, bins: int = 100, per_task: int = 200_000) -> DataFrame:
    """Puts groups into bins of nearly equal weight: `key`, `weight` and `bin`.

    Differencing is done within tasks of about per_task groups, which yields a partial solution of `bins`
    sums for each task. These, tasks times bins numbers, are combined by differencing on the driver, and
    each task's bins are renamed accordingly. Null keys make one group like any other.
    """
    named = groups.select(F.col(key).alias("_key"), F.col(weight).cast("double").alias("_weight"))
    named = cut(named)
    tasks = max(1, -(-named.count() // per_task))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_weight", "_key"], ascending=[False, True], kind="stable", ignore_index=True)
        rows["_slot"] = largest_differencing(rows["_weight"].to_numpy(), bins)
        return rows

    task = F.pmod(F.xxhash64("_key"), F.lit(tasks)).cast("int").alias("_task")
    kind = named.schema["_key"].dataType.simpleString()
    local = named.select("_key", "_weight", task).groupBy("_task").applyInPandas(solve, f"_key {kind}, _weight double, _task int, _slot bigint")
    local = cut(local)
    sums = {(r["_task"], r["_slot"]): r["w"] for r in local.groupBy("_task", "_slot").agg(F.sum("_weight").alias("w")).collect()}
    mapping = combine_solutions(sums, bins)
    # tasks x bins rows, of which Spark itself decides whether they are few enough to be broadcast
    renamed = groups.sparkSession.createDataFrame([(*k, v) for k, v in mapping.items()] or [(-1, -1, -1)], "_task int, _slot bigint, bin int")
    return local.join(renamed, ["_task", "_slot"]).select(F.col("_key").alias(key), F.col("_weight").alias(weight), "bin")


def combine_solutions(sums: dict[tuple[int, int], float], bins: int) -> dict[tuple[int, int], int]:
    """Combines the tasks' solutions, those with the largest spread first."""
    by_task: dict[int, list[tuple[float, int]]] = {}
    for (task, slot), w in sums.items():
        by_task.setdefault(task, []).append((w, slot))
    heap = []
    for n, (task, found) in enumerate(sorted(by_task.items())):
        full = sorted([*found, *[(0.0, s) for s in range(bins) if (task, s) not in sums]], key=lambda x: (-x[0], x[1]))
        heap.append((full[-1][0] - full[0][0], n, [w for w, _ in full], [[(task, s)] for _, s in full]))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, s, mine = heapq.heappop(heap)
        _, _, t, theirs = heapq.heappop(heap)
        joined = sorted(((a + b, m + o) for a, b, m, o in zip(s, t[::-1], mine, theirs[::-1], strict=True)), key=lambda x: -x[0])
        n += 1
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], n, [w for w, _ in joined], [m for _, m in joined]))
    return {k: i for i, members in enumerate(heap[0][3] if heap else []) for k in members}


def split_together(rows: DataFrame, record: str, first: str, second: str, shares: dict[str, float], bins: int = 100, per_task: int = 200_000) -> DataFrame:
    """Every row with `component` and `split_name`: rows that share `first` or `second`, or are linked
    by a chain of such rows, fall in one split; the splits' shares of rows come near the given ones.

    A null `first` or `second` links nothing; a row without either is a component of its own (by
    `record`; copies of it stay together). Shares are taken relative to their sum. An empty table gives
    no rows. Columns of the input named like the two new ones are replaced.

    Components come first, then largest differencing into `bins` nearly equal bins, then whole bins go to
    splits. A component larger than a bin makes its bin that large, and counts so for its split.
    """
    total = sum(shares.values())
    a, b = F.concat(F.lit("a:"), F.col(first).cast("string")), F.concat(F.lit("b:"), F.col(second).cast("string"))
    pairs = rows.select(a.alias("a"), b.alias("b")).filter("a is not null and b is not null").distinct()
    roots = cut(components(pairs))
    # every row hangs on one of its nodes: `first` where it has one, else `second`, else itself
    node = F.coalesce(a, b, F.concat(F.lit("r:"), F.col(record).cast("string")), F.lit("r"))
    # counted by node first: a hot node reaches the join as one row
    counted = rows.groupBy(node.alias("node")).agg(F.count(F.lit(1)).alias("n")).join(roots, "node", "left")
    grouped = counted.select("node", "n", F.coalesce("root", "node").alias("component"))
    binned = cut(balanced_bins(grouped.groupBy("component").agg(F.sum("n").alias("weight")), "component", "weight", bins, per_task))
    sums = {r.bin: r.w for r in binned.groupBy("bin").agg(F.sum("weight").alias("w")).collect()}
    names = allocate_bins([sums.get(i, 0.0) for i in range(bins)], {k: v / total for k, v in shares.items()})
    chosen = F.element_at(F.array(*map(F.lit, names)), F.col("bin") + 1)
    by_node = grouped.join(binned.select("component", chosen.alias("split_name")), "component").select(F.col("node").alias("__node"), "component", "split_name")
    kept = rows.drop("component", "split_name", "__node").withColumn("__node", node)
    return kept.join(by_node, "__node").drop("__node")
