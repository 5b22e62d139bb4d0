"""Filling containers of fixed capacity by best-fit decreasing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.session import cut


class OpenBins:
    """Open bins by remaining capacity: a segment tree over 0..capacity finds the tightest fit in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.filled = bytearray(2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, remaining: int, bin_no: int) -> None:
        self.bins[remaining].append(bin_no)
        node = self.leaves + remaining
        while node and not self.filled[node]:
            self.filled[node] = 1
            node >>= 1

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Remaining capacity and number of the bin with least room of at least `need`; it is taken out."""
        filled, node = self.filled, self.leaves + need
        if not filled[node]:
            while not (node & 1 == 0 and filled[node + 1]):
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.leaves:
                node <<= 1
                if not filled[node]:
                    node += 1
        remaining = node - self.leaves
        bin_no = self.bins[remaining].pop()
        if not self.bins[remaining]:
            filled[node] = 0
            node >>= 1
            while node and not (filled[2 * node] or filled[2 * node + 1]):
                filled[node] = 0
                node >>= 1
        return remaining, bin_no


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """A bin for each size (all from 1 to capacity), largest first; and the number of bins."""
    out = np.empty(len(sizes), dtype=np.int64)
    open_bins, n = OpenBins(capacity), 0
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        found = open_bins.take_tightest(size)
        if found is None:
            remaining, bin_no = capacity, n
            n += 1
        else:
            remaining, bin_no = found
        out[i] = bin_no
        if remaining > size:
            open_bins.put(remaining - size, bin_no)
    return out, n


def pack(items: DataFrame, key: str, size: str, capacity: int, per_task: int = 250_000) -> DataFrame:
    """Puts items into containers: key, `piece_no`, `pieces`, `piece_start`, `piece_size`, `container_id`.

    An item larger than the capacity is cut into full containers of its own and a rest, which is packed
    like any item; all others stay whole. Items of size zero or null need no room: they come out once with
    no container. Copies of a key are items of their own.

    Best-fit decreasing is done within tasks of about per_task items, spread by hash, so that a task's
    memory is bounded; what a task wastes is in its last few containers, some millionths of its room.
    """
    spec = items.select(F.col(key).alias("_key"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_size"))
    spec = cut(spec)
    tasks = max(1, -(-spec.count() // per_task))
    kind = spec.schema["_key"].dataType.simpleString()

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        task = int(rows["_task"].iloc[0])
        rows = rows.sort_values(["_size", "_key"], ascending=[False, True], kind="stable", ignore_index=True)
        sizes = rows["_size"].to_numpy()
        whole, rest = sizes // capacity, sizes % capacity
        whole[(rest == 0) & (whole == 1)] = 0
        rest = sizes - whole * capacity  # an item of exactly the capacity is no large one
        packed = rest > 0
        bins, n = best_fit_decreasing(rest[packed], capacity)
        first = np.concatenate([[0], np.cumsum(whole)])
        at = np.repeat(np.arange(len(sizes)), whole)
        nth = np.arange(len(at)) - first[at]
        pieces = whole + packed
        full = pd.DataFrame({"_key": rows["_key"].to_numpy()[at], "piece_no": nth, "pieces": pieces[at], "piece_start": nth * capacity, "piece_size": capacity, "_bin": n + np.arange(len(at))})
        part = pd.DataFrame({"_key": rows["_key"][packed], "piece_no": whole[packed], "pieces": pieces[packed], "piece_start": (whole * capacity)[packed], "piece_size": rest[packed], "_bin": bins})
        none = pd.DataFrame({"_key": rows["_key"][sizes <= 0], "piece_no": 0, "pieces": 0, "piece_start": 0, "piece_size": 0, "_bin": None})
        out = pd.concat([f for f in (full, part, none) if len(f)], ignore_index=True)
        out["container_id"] = out["_bin"].astype("Int64") + (task << 32)
        return out.drop(columns="_bin")

    spread = spec.withColumn("_task", F.pmod(F.xxhash64("_key"), F.lit(tasks)).cast("int"))
    shape = f"_key {kind}, piece_no bigint, pieces bigint, piece_start bigint, piece_size bigint, container_id bigint"
    return spread.groupBy("_task").applyInPandas(fill, shape).withColumnRenamed("_key", key)


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, items, used size and the share of room used."""
    used = packed.filter("container_id is not null").groupBy("container_id").agg(F.sum("piece_size").alias("used"))
    return used.agg(
        F.count(F.lit(1)).alias("containers"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("used"),
        F.max("used").alias("fullest"),
        (F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("fill"),
    )
