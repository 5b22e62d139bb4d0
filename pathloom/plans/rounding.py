"""Doubles rounded alike in both engines: sums of doubles differ in their last bits with the order of rows."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 6


def rounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        df = query(spark, directory)
        return df.select(*[(F.round(F.col(f"`{c}`").cast("double"), DIGITS) + F.lit(0.0)).alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in df.dtypes])

    return run


def rounded_sql(queries: dict[str, str], directory: str) -> dict[str, str]:
    """The same for SQL; sums of integers become BIGINT. Column types come from binding each text to the tables
    of a directory; without DuckDB or the directory the texts stay as they are."""
    try:
        import duckdb
    except ImportError:
        return queries
    if not os.path.isdir(directory):
        return queries
    con, out = duckdb.connect(), {}
    for name in os.listdir(directory):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{directory}/{name}{'/*.parquet' if os.path.isdir(f'{directory}/{name}') else ''}'")
    for name, sql in queries.items():
        sql = sql.strip().rstrip(";")
        columns = con.execute(f"DESCRIBE {sql}").fetchall()
        cells = []
        for column, kind, *_ in columns:
            kind = str(kind).upper()
            quoted = f'"{column}"'
            if kind in ("DOUBLE", "FLOAT") or kind.startswith("DECIMAL"):
                cells.append(f"round({quoted}::DOUBLE, {DIGITS}) + 0.0 AS {quoted}")
            elif kind in ("HUGEINT", "UHUGEINT", "UBIGINT"):
                cells.append(f"{quoted}::BIGINT AS {quoted}")
            else:
                cells.append(quoted)
        out[name] = f"SELECT {', '.join(cells)} FROM ({sql}) AS q"
    con.close()
    return out
