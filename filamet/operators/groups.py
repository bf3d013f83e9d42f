"""Small helpers shared by grouped operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def agg(df: DataFrame, keys: Sequence[str], *cols: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*cols) if keys else df.agg(*cols)


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table as a scalar subquery; more than one row is an error."""
    value = row.select(F.struct("*").alias("_row")).scalar()
    return df.withColumn("_row", value).select(*df.columns, "_row.*")


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a per-group table; without keys the right side is a single row."""
    return left.join(right, list(keys), how) if keys else attach_row(left, right)


def sd_or_zero(x: Column | str) -> Column:
    """Sample SD, 0 for a single value, null for none."""
    return F.when(F.count(x) > 1, F.stddev_samp(x)).when(F.count(x) == 1, F.lit(0.0))


def list_median(values: Column) -> Column:
    """Exact median of a list that is short by design; null for an empty one."""
    # sorted once for both middle values
    middle = F.transform(F.array(F.array_sort(values)), lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)
    return F.get(middle, F.lit(0))
