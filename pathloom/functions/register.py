"""The functions under names of their own in SQL: temporary SQL functions, and one table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

# Reserved and private AS numbers, as in functions.paths.
SQL_FUNCTIONS = {
    "is_public_as(asn BIGINT) RETURNS BOOLEAN": "asn IS NOT NULL AND NOT (asn IN (0, 23456, 65535, 4294967295) OR asn BETWEEN 64512 AND 65534 OR asn BETWEEN 4200000000 AND 4294967294)",
    "path_hops(clean STRING) RETURNS INT": "CASE WHEN coalesce(clean, '') = '' THEN 0 ELSE size(split(clean, ' ')) END",
    "path_origin(clean STRING) RETURNS STRING": "substring_index(coalesce(clean, ''), ' ', -1)",
    "window_floor(ts TIMESTAMP, seconds INT) RETURNS TIMESTAMP": "timestamp_seconds(floor(unix_micros(ts) / (seconds * 1000000L)) * seconds)",
    "safe_ratio(n DOUBLE, d DOUBLE) RETURNS DOUBLE": "CASE WHEN coalesce(d, 0) = 0 THEN 0 ELSE n / d END",
}


@udtf(returnType="u: bigint, v: bigint")
class PathEdges:
    """The edges of a cleaned path: consecutive numbers, the smaller one first; repeats are kept, self-loops not."""

    def eval(self, clean: str):
        hops = [int(x) for x in (clean or "").split()]
        for a, b in zip(hops, hops[1:]):
            if a != b:
                yield min(a, b), max(a, b)


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to a session's SQL; gives their names."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("path_edges", PathEdges)
    return [h.split("(")[0] for h in SQL_FUNCTIONS] + ["path_edges"]
