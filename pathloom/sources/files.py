"""File enumeration, side files (relationships, memberships) and sinks with keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.operators.relations import both_directions


def update_files(spark: SparkSession, collector: str, start: str, end: str, minutes: int = 5, pattern: str = "updates.{}.gz", closed: bool = False) -> DataFrame:
    """Names and times of the update files of a half-open time range, or of a closed one."""
    times = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"interval {int(minutes)} minutes"))).alias("ts"))
    times = times.filter(F.col("ts") <= F.lit(end).cast("timestamp") if closed else F.col("ts") < F.lit(end).cast("timestamp"))
    stamp = F.date_format("ts", "yyyyMMdd.HHmm")
    name = F.concat(F.lit(pattern.split("{}")[0]), stamp, F.lit(pattern.split("{}")[1]))
    return times.select(F.lit(collector).alias("collector"), F.concat_ws("/", F.lit(collector), F.date_format("ts", "yyyy.MM"), name).alias("path"), "ts")


def snapshot_files(spark: SparkSession, collector: str, start: str, end: str) -> DataFrame:
    """The 8-hourly snapshot files of a time range, its end included."""
    return update_files(spark, collector, start, end, 480, "bview.{}.gz", closed=True)


def nearest_file(files: DataFrame, dates: DataFrame) -> DataFrame:
    """For each date the file (path, file_date) nearest in days; the earlier of equals.

    Dates and files are put in one order; each date takes the last file up to it or the first after it, so nothing is
    paired. The lists are short (a row a file, a row a date) and ordered in one task.
    """
    one = files.groupBy("file_date").agg(F.min("path").alias("path"))
    line = dates.select("date", F.lit(1).alias("_asks"), F.lit(None).cast("struct<d:date,p:string>").alias("_f")).distinct()
    line = line.unionByName(one.select(F.col("file_date").cast("date").alias("date"), F.lit(0).alias("_asks"), F.struct(F.col("file_date").cast("date").alias("d"), F.col("path").alias("p")).alias("_f")))
    w = Window.orderBy("date", "_asks")
    met = line.withColumns({"_a": F.last("_f", True).over(w), "_b": F.first("_f", True).over(w.rowsBetween(0, Window.unboundedFollowing))}).filter("_asks = 1")
    before, after = F.datediff("date", "_a.d"), F.datediff("_b.d", "date")
    return met.select("date", F.when(before.isNull() | (after < before), F.col("_b.p")).otherwise(F.col("_a.p")).alias("path"))


def month_file(files: DataFrame, dates: DataFrame) -> DataFrame:
    """The file of the date's month, else of the month before."""
    first = F.trunc("date", "month")
    this = files.select(F.col("path").alias("_p1"), F.col("file_date").alias("_d1"))
    before = files.select(F.col("path").alias("_p2"), F.col("file_date").alias("_d2"))
    out = dates.join(this, F.col("_d1") == first, "left").join(before, F.col("_d2") == F.add_months(first, -1), "left")
    return out.select("date", F.coalesce("_p1", "_p2").alias("path"))


def newest_file(files: DataFrame, dates: DataFrame, days: int = 30) -> DataFrame:
    """The newest file on or before the date, not older than `days`; null without."""
    met = dates.join(files, (F.col("file_date") <= F.col("date")) & (F.datediff("date", "file_date") <= days), "left")
    return met.groupBy("date").agg(F.max_by("path", "file_date").alias("path"))


def read_relationships(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """as1|as2|rel lines in both directions, and the lists of the comment lines (kind, asn). Bad lines are passed over."""
    lines = spark.read.text(path)
    parts = F.split("value", r"\|")
    rows = lines.filter(~F.col("value").startswith("#")).select(*[F.try_to_number(F.trim(F.get(parts, F.lit(i))), F.lit("S9999999999")).cast("bigint").alias(n) for i, n in enumerate(("as1", "as2", "rel"))]).dropna()
    heads = [("clique", "inferred clique:"), ("ixp", "IXP ASes:")]
    lists = [lines.filter(F.col("value").startswith("#") & F.contains("value", F.lit(h))).select(F.lit(k).alias("kind"), F.explode(F.split(F.trim(F.substring_index("value", h, -1)), r"\s+")).alias("_a")) for k, h in heads]
    meta = lists[0].unionByName(lists[1]).filter(F.col("_a").rlike("^[0-9]{1,10}$")).select("kind", F.col("_a").cast("bigint").alias("asn"))
    return both_directions(rows), meta


def read_memberships(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (asn, ix_id) of a nested JSON dump."""
    shape = "netixlan struct<data:array<struct<asn:bigint,ix_id:bigint>>>"
    rows = spark.read.schema(shape).option("multiLine", True).json(path)
    return rows.select(F.inline("netixlan.data")).dropna().distinct()


def write_snapshots(edges: DataFrame, path: str) -> None:
    """Edges by (pair, stamp) partitions; only the partitions present are overwritten, so a run can be resumed."""
    edges.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pair", "stamp").parquet(path)


def missing_snapshots(wanted: DataFrame, path: str, spark: SparkSession) -> DataFrame:
    """The (pair, stamp) that are not written yet."""
    return wanted.join(spark.read.parquet(path).select("pair", "stamp").distinct(), ["pair", "stamp"], "left_anti")


def read_rows(spark: SparkSession, paths: list[str], kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """Files and folders of one format; missing ones are an error, columns are pruned by the reader."""
    if not paths:
        raise ValueError("no input paths")
    reader = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {}), **options)
    return (reader.schema(schema) if schema else reader).load(sorted(set(paths)))


def payload(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as JSON lines."""
    return rows.select(F.to_json(F.struct(*columns)).alias("value"))


def finite(column: Column) -> Column:
    """A number, or null where it is none or infinite."""
    x = column.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def slug(text: Column) -> Column:
    """Letters and digits, anything else as single underscores."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))
