"""Incremental topology: edge deltas from a keyed state, and windowed counts with a watermark.

A stream needs a bound on what may come late, so both take a watermark. Windowed counts drop what comes later than
it; edge deltas use it to know copies of an update, wherever they lie, and apply each update in order of its time
within its batch. Their state is one path a key, kept by buckets of keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pathloom.functions.paths import clean_path, path_array, path_edges

CHANGES = "collector string, peer_as string, prefix string, seq bigint, ts timestamp, before string, path string"


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None, pattern: str | None = None) -> DataFrame:
    """Update files of a folder as a stream, in order of their appearance; a folder of parts named like a table also fits `pattern`."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def shaped(updates: DataFrame) -> DataFrame:
    text = ["collector", "type", "peer_as", "prefix"]
    return updates.filter("timestamp is not null").select("seq", F.col("timestamp").cast("timestamp").alias("ts"), *[F.coalesce(c, F.lit("")).alias(c) for c in text], clean_path(F.col("as_path")).alias("path"))


def window_counts(updates: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Announcements, withdrawals and updates of each tumbling window. Copies are dropped within the watermark."""
    rows = shaped(updates).withWatermark("ts", late).dropDuplicatesWithinWatermark(["seq"])
    counts = rows.groupBy("collector", F.window("ts", f"{minutes} minutes").alias("win")).agg(
        F.count_if(F.col("type") == "A").alias("announcements"), F.count_if(F.col("type") == "W").alias("withdrawals"), F.count(F.lit(1)).alias("total_updates")
    )
    return counts.select("collector", F.col("win.start").alias("w"), "announcements", "withdrawals", "total_updates")


def edge_deltas(updates: DataFrame, late: str = "1 day", buckets: int = 1024) -> DataFrame:
    """+1 and -1 for each edge whose use by a (collector, peer_as, prefix) begins or ends.

    An announcement of two or more numbers replaces the key's path, a withdrawal removes it, a shorter one
    changes nothing; of a replaced path only the edges that differ are sent. A copy of an update is passed over if it
    comes within `late` of the original, in whatever batch. Keys are kept by hash in `buckets` groups, so that Python is
    called once a bucket and batch, not once a key: it sees the bucket's updates as columns. The state is the paths of a
    bucket's keys, which is written anew where the bucket has updates; edges are taken apart by SQL.
    """
    names = ["collector", "peer_as", "prefix"]

    def advance(_: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(batches), ignore_index=True)
        # lengths keep apart what joins to the same text
        key = rows["collector"].str.len().astype(str) + "," + rows["peer_as"].str.len().astype(str) + "," + rows["collector"] + rows["peer_as"] + rows["prefix"]
        rows = rows.assign(_key=key).sort_values(["_key", "ts", "seq"], ignore_index=True)
        first, last = ~rows["_key"].duplicated(), ~rows["_key"].duplicated(keep="last")
        before = rows["path"].shift(1, fill_value="").where(~first, [held.get(k, "") for k in rows["_key"]])
        held.update(zip(rows.loc[last, "_key"], rows.loc[last, "path"], strict=True))
        held = {k: p for k, p in held.items() if p}  # without a path is as unknown
        state.update((list(held), list(held.values())))
        changed = rows["path"] != before
        if changed.any():
            yield rows.loc[changed, [*names, "seq", "ts"]].assign(before=before[changed], path=rows["path"][changed])

    once = shaped(updates).withWatermark("ts", late).dropDuplicatesWithinWatermark(["seq"])
    effective = once.filter((F.col("type") == "W") | ((F.col("type") == "A") & F.contains("path", F.lit(" "))))
    keyed = effective.select(*names, "seq", "ts", F.when(F.col("type") == "A", F.col("path")).otherwise("").alias("path"), F.pmod(F.xxhash64(*names), F.lit(buckets)).alias("bucket"))
    keyed = keyed.groupBy("bucket")
    changes = keyed.applyInPandasWithState(advance, CHANGES, "keys array<string>, paths array<string>", "append", "NoTimeout")
    edges = lambda c: F.array_distinct(path_edges(path_array(F.col(c))))
    begun, ended = F.array_except(edges("path"), edges("before")), F.array_except(edges("before"), edges("path"))
    signed = lambda es, n: F.transform(es, lambda e: F.struct(e["u"].alias("u"), e["v"].alias("v"), F.lit(n).alias("delta")))
    return changes.select("collector", "peer_as", "prefix", "seq", "ts", F.explode(F.concat(signed(begun, 1), signed(ended, -1))).alias("e")).select("collector", "peer_as", "prefix", "seq", "ts", "e.*")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into a table in memory; for small results and tests."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into parquet files, exactly once: by the file sink's log, or, if the mode is
    complete, by a folder a batch that is overwritten on retry, of which the last holds the result."""
    spark = stream.sparkSession
    if mode == "append":
        schema = stream.schema
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(schema).parquet(path)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    results = spark.read.parquet(path)
    last = results.agg(F.max("batch").alias("batch")).first().batch if mode == "complete" else None
    return results.filter(F.col("batch") == last).drop("batch") if mode == "complete" else results
