"""Aggregate expressions that Spark has only in a form that fails on constant columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation over the rows where both are known; null if either does not vary."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 1e-12, F.covar_pop(x, y) / spread)
