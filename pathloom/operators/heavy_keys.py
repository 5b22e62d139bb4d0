"""Results per key where a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_profile(rows: DataFrame, keys: dict[str, Column], read: Sequence[str], time: Column, item: Column, record: Column) -> DataFrame:
    """Per key: `n` records, `first_ts`, `last_ts` and `n_items` distinct items, with even work; and `records`, of all rows.

    Every step is an algebraic aggregate with map-side combining: each task holds a hash table of partial
    states that spills when full, and only those compact states are shuffled. Distinct items come from an
    aggregation by (key, item) whose hash spreads a hot key over all tasks; what then remains of a hot key
    is one partial row per task.

    Copies of a record (equal `record`) are exact and count once: rows are counted with their copies, and
    what copies add is taken off again. For that each row sends its record and the columns `read`, as they are,
    which the keys are worked out from; only for the few records found more than once that is done again.

    Rows with a null key part are left out, but for `records`. Null times count as records but not for first and
    last; null items are no items.
    """
    picked = rows.select(record.alias("_record"), time.alias("_t"), item.alias("_item"), *[c.alias(k) for k, c in keys.items()])
    # as an aggregate the test for null parts stays here: pushed down it would work out the keys twice
    whole = F.bool_and(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    by_item = picked.groupBy(*keys, "_item").agg(F.count(F.lit(1)).alias("_n"), F.min("_t").alias("_first"), F.max("_t").alias("_last"), whole.alias("_whole"))
    by_key = by_item.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.min("_first").alias("first_ts"), F.max("_last").alias("last_ts"), F.count("_item").alias("n_items"), F.bool_and("_whole").alias("_whole")
    )
    copies = rows.select(record.alias("_record"), *read).repartition("_record").groupBy("_record", *read).agg((F.count(F.lit(1)) - 1).alias("_extra")).filter("_extra > 0")
    again = copies.select("_extra", *[c.alias(f"_k{i}") for i, c in enumerate(keys.values())]).groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.sum("_extra").alias("_extra"))
    same = reduce(and_, [by_key[k].eqNullSafe(again[f"_k{i}"]) for i, k in enumerate(keys)])
    once = by_key.join(again, same, "left").withColumn("n", F.col("n") - F.coalesce("_extra", F.lit(0)))
    # two rows: a count without columns, and the copies, whose shuffle is used once more
    total = rows.agg(F.count(F.lit(1)).alias("_rows")).crossJoin(F.broadcast(copies.agg(F.coalesce(F.sum("_extra"), F.lit(0)).alias("_copies"))))
    total = total.select((F.col("_rows") - F.col("_copies")).alias("records"))
    return once.filter("_whole").select(*keys, "n", "first_ts", "last_ts", "n_items").crossJoin(F.broadcast(total))
