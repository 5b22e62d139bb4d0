"""Decoded routing dumps as text, one element a line with `|` between its fields, and sinks of small graphs."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of a dump line, in order.
FIELDS = (
    "mrt_type timestamp entry_type peer_ip peer_as prefix as_path origin next_hop local_pref med community atomic_aggregate aggregator"
).split()


def read_dump(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every line of text dumps: the FIELDS, missing ones '', `type` ('A' for an announcement or a table entry, 'W' for a
    withdrawal, null for anything else) and `bad` (no time, no type, no prefix or no peer).

    Lines are split by Spark's own text reader, so columns that are not asked for are not worked out, and compressed
    files are read as they are.
    """
    parts = F.split("value", r"\|")
    field = {n: F.coalesce(F.btrim(F.get(parts, F.lit(i))), F.lit("")) for i, n in enumerate(FIELDS)}
    rows = spark.read.text(path).filter(F.length(F.btrim("value")) > 0).select(*[c.alias(n) for n, c in field.items()])
    seconds = F.col("timestamp").try_cast("double")
    kind = F.when(F.col("entry_type").isin("A", "B"), "A").when(F.col("entry_type") == "W", "W")
    rows = rows.withColumns({"timestamp": F.timestamp_micros((seconds * 1_000_000).cast("bigint")), "type": kind})
    return rows.withColumn("bad", F.col("timestamp").isNull() | F.col("type").isNull() | (F.col("prefix") == "") | (F.col("peer_ip") == ""))


def rib_rows(dump: DataFrame) -> DataFrame:
    """The entries of a table dump: all but withdrawals and bad lines."""
    return dump.filter(~F.col("bad") & (F.col("type") == "A")).drop("bad", "type")


def update_rows(dump: DataFrame) -> DataFrame:
    """The updates of a dump, announcements and withdrawals alone, with preference, discriminator and community."""
    keep = ["timestamp", "type", "peer_ip", "peer_as", "prefix", "as_path", "origin", "next_hop", "local_pref", "med", "community"]
    return dump.filter(~F.col("bad") & F.col("type").isin("A", "W")).select(*keep)


def dump_counts(dump: DataFrame) -> DataFrame:
    """One row: elements, bad lines, withdrawals, distinct prefixes and peers."""
    good = ~F.col("bad")
    return dump.agg(
        F.count(F.lit(1)).alias("n_elements"), F.count_if("bad").alias("n_errors"), F.count_if(good & (F.col("type") == "W")).alias("n_withdrawals"),
        F.count_distinct(F.when(good, F.col("prefix"))).alias("n_prefixes"), F.count_distinct(F.when(good, F.col("peer_ip"))).alias("n_peers"),
    )


def existing_files(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The files and folders that fit the patterns, sorted, on whatever file system Spark knows."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for p in patterns:
        path = jvm.org.apache.hadoop.fs.Path(p)
        found = path.getFileSystem(conf).globStatus(path)
        out += [s.getPath().toString() for s in (found or [])]
    return sorted(set(out))


def discovered_files(spark: SparkSession, patterns: list[str], otherwise: DataFrame) -> DataFrame:
    """`path` of the files there are; if there are none, the generated names of `otherwise` (its column `path`)."""
    found = existing_files(spark, patterns)
    return spark.createDataFrame([(p,) for p in found], "path string") if found else otherwise.select("path")


def first_filled(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first of several folders (or patterns) that holds a file; None if none does."""
    return next((c for c in candidates if existing_files(spark, [c if "*" in c else f"{c}/*"])), None)


def write_rows(rows: DataFrame, path: str, kind: str = "parquet", **options: str) -> None:
    """Rows as CSV (with a header), JSON lines or parquet; what is there is replaced."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"no such format: {kind}")
    rows.write.mode("overwrite").options(**({"header": "true"} if kind == "csv" else {}), **options).format(kind).save(path)


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as GEXF: nodes (asn and any attributes, such as `hop`), edges (u, v, weight).

    Rows come to the driver one part at a time and go straight to the file, in order of their numbers.
    """
    names = [c for c in nodes.columns if c != "asn"]
    with open(path, "w", encoding="utf-8") as out:
        out.write('<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3">\n<graph defaultedgetype="undirected">\n<attributes class="node">\n')
        out.writelines(f'<attribute id="{i}" title={quoteattr(c)} type="string"/>\n' for i, c in enumerate(names))
        out.write("</attributes>\n<nodes>\n")
        for r in nodes.orderBy("asn").toLocalIterator():
            values = "".join(f'<attvalue for="{i}" value={quoteattr(str(r[c]))}/>' for i, c in enumerate(names) if r[c] is not None)
            out.write(f'<node id="{r.asn}" label="{r.asn}"><attvalues>{values}</attvalues></node>\n')
        out.write("</nodes>\n<edges>\n")
        for i, r in enumerate(edges.orderBy("u", "v").toLocalIterator()):
            out.write(f'<edge id="{i}" source="{r.u}" target="{r.v}" weight="{r.weight if r.weight is not None else 1}"/>\n')
        out.write("</edges>\n</graph>\n</gexf>\n")
