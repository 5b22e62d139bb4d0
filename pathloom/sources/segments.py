"""Feature tables that are worked out segment by segment and taken up again where a run ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.statview import new_prefixes, stat_view


def _written(spark: SparkSession, path: str, like: str) -> DataFrame:
    """A table of parts, or none of its rows if it is not there yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(like).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], like)


def resume_windows(log: DataFrame, path: str, group: str = "collector", from_segment: str | None = None) -> DataFrame:
    """The statistical view of each window, written by (group, segment) below path/rows, and all of it that is there now.

    log: an update log with `segment`. Segments that are written already are passed over, so that a run that was
    ended goes on, and a log that has grown adds its new segments. What a segment hands on is written beside it
    (path/state): the prefixes of its last window, from which the next one's first window knows what is new. With
    from_segment, segments before it are a warm-up: they are replayed for that state, but none of their windows is
    given out. Parts are overwritten as a whole, so a run that is repeated leaves the same files.
    """
    spark = log.sparkSession
    keys = [group, "w"]
    name = F.date_format("segment", "yyyyMMddHHmm")
    done = _written(spark, f"{path}/done", f"{group} string, part string").distinct()
    todo = log.select(group, name.alias("part")).distinct().join(done, [group, "part"], "left_anti")
    ours = log.withColumn("part", name).join(todo, [group, "part"], "left_semi")

    seen = ours.select(*keys, "part", "prefix", "type")
    last = seen.groupBy(group, "part").agg(F.max("w").alias("w"))
    state = seen.join(last, [group, "part", "w"], "left_semi").select(*keys, "part", "prefix").distinct()
    carried = _written(spark, f"{path}/state", f"{group} string, w timestamp, prefix string, part string")
    # the last window before what is to be done, of each group
    first = ours.groupBy(group).agg(F.min("w").alias("_first"))
    before = carried.join(first, group).filter("w < _first")
    newest = before.groupBy(group).agg(F.max("w").alias("w"))
    known = before.join(newest, keys, "left_semi").select(*keys, "prefix").withColumn("type", F.lit("S"))
    fresh = new_prefixes(seen.select(*keys, "prefix", "type").unionByName(known), keys)

    rows = stat_view(ours, keys).drop("new_prefixes").join(fresh, keys).join(ours.select(*keys, "part").distinct(), keys)
    given = rows if from_segment is None else rows.filter(F.col("part") >= from_segment)
    for table, what in (("rows", given), ("state", state)):
        what.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(group, "part").parquet(f"{path}/{table}")
    # last of all, so that a segment counts as done only when its parts are there; a few rows
    todo.write.mode("append").parquet(f"{path}/done")
    return spark.read.parquet(f"{path}/rows").withColumn("part", F.col("part").cast("string"))
