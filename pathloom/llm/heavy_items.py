"""The most frequent values of columns with very many distinct values, by spillable exact counting."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def heavy_items(rows: DataFrame, fields: Mapping[str, Column], record: Column, k: int) -> DataFrame:
    """The k most frequent items of each field: `field`, `item`, `n`, `rank` and `records` (of all rows).

    Counts are exact. Items are counted by an aggregation that combines within each task first and then
    by hash partitions; both keep a hash table that spills to disk when full, so memory does not grow with
    the number of values, and a hot item reaches its partition as one row per task. Each partition keeps
    its own top k, and only those are ordered at the end. Ties are broken by the item's text.

    Copies of a record (equal `record`, all else equal) count once. Null items are no items. An empty
    table gives no rows.
    """
    once = rows.select(record.alias("_record"), *[c.cast("string").alias(f) for f, c in fields.items()]).repartition(F.col("_record")).distinct()
    every = F.struct(F.lit("").alias("field"), F.lit("").alias("item"))
    named = [F.struct(F.lit(f).alias("field"), F.col(f).alias("item")) for f in fields]
    counts = (
        once.select(F.explode(F.array(every, *named)).alias("e"))
        .select("e.field", "e.item")
        .filter("item is not null")
        .groupBy("field", "item")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # row_number with a limit: Spark takes the top k within each partition before the shuffle
    order = Window.partitionBy("field").orderBy(F.desc("n"), "item")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    # at most k rows a field are left, so one task can hold them
    records = F.max(F.when(F.col("field") == "", F.col("n"))).over(Window.partitionBy(F.lit(0)))
    return top.withColumn("records", records).filter("field <> ''").select("field", "item", "n", "rank", "records")


def frequent_items(rows: DataFrame, fields: Mapping[str, Column], record: Column, share: float) -> DataFrame:
    """Every item that at least `share` of all records have; there are 1 / share such items a field at most."""
    return heavy_items(rows, fields, record, int(1 / share) + 1).filter(F.col("n") >= F.col("records") * F.lit(share))
