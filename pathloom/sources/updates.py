"""The update log: one row for each update, with its cleaned path and its window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.paths import clean_path, path_array
from pathloom.operators.grid import floor_time
from pathloom.session import table


def update_log(rows: DataFrame, window_seconds: int = 300, raw: bool = False) -> DataFrame:
    """seq, ts, w, collector, type, peer_ip, peer_as, prefix, origin, next_hop, clean and path (and as_path if raw).

    Copies (equal seq) count once. Missing text is '', which groups like any other value. Rows without
    time belong to no window and are left out.

    Paths are cleaned before the copies go, so that plans which read the log several times (as the
    statistical view does) share one scan, one cleaning and one shuffle.
    """
    text = ["collector", "type", "peer_ip", "peer_as", "prefix", "origin", "next_hop", *(["as_path"] if raw else [])]
    ts = F.col("timestamp").cast("timestamp")
    picked = rows.filter(F.col("timestamp").isNotNull()).select(
        "seq", ts.alias("ts"), floor_time(ts, window_seconds).alias("w"), *[F.coalesce(c, F.lit("")).alias(c) for c in text], clean_path(F.col("as_path")).alias("clean")
    )
    return picked.distinct().withColumn("path", path_array(F.col("clean")))


def read_updates(spark: SparkSession, directory: str, window_seconds: int = 300, raw: bool = False) -> DataFrame:
    return update_log(table(spark, directory, "updates"), window_seconds, raw)
