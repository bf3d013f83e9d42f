"""User methods over the samples of an image, run block by block and merged level by level."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filamet.operators.ordered import by_size, order_bucket, ordered
from filamet.session import stored

Step = Callable[[pd.DataFrame], pd.DataFrame]

#: partial results that one call of ``combine`` or ``merge`` sees
FAN_IN = 16


def blocks(samples: DataFrame, keys: Sequence[str], rows_per_block: int) -> DataFrame:
    """Rows with ``_block`` and how many ``_copies`` of the row the entry stands for.

    Rows are numbered in the order of all their columns, so blocks are full and depend on the data
    alone.  Groups that one window may hold are numbered whole, a row an entry; in larger ones equal
    rows are one entry with a count, spread over as many blocks as they fill.
    """
    keys, size = list(keys), F.lit(rows_per_block)
    order = [c for c in samples.columns if c not in keys]

    def whole(df: DataFrame) -> DataFrame:
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
        return df.select(*samples.columns, F.floor((number - 1) / size).alias("_block"), F.lit(1).cast("long").alias("_copies"))

    def pieces(df: DataFrame) -> DataFrame:
        folded = df.groupBy(*samples.columns).agg(F.count(F.lit(1)).alias("_m"))
        run = ordered(order_bucket(folded, keys, order), keys, order, sums={"_end": F.col("_m")})
        first = F.col("_end") - F.col("_m")
        spread = run.withColumn("_block", F.explode(F.sequence(F.floor(first / size), F.floor((F.col("_end") - 1) / size))))
        copies = F.least("_end", (F.col("_block") + 1) * size) - F.greatest(first, F.col("_block") * size)
        return spread.select(*samples.columns, "_block", copies.alias("_copies"))

    return by_size(samples, keys, whole, pieces)


def _dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partial rows over all tasks: they are few bytes but a call per group, and without a number adaptive execution may leave them to one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def run_method(
    samples: DataFrame, keys: Sequence[str], partial: Step, merge: Step, partial_schema: str, result_schema: str, *, combine: Step | None = None, rows_per_block: int = 100_000, fan_in: int = FAN_IN,
) -> DataFrame:
    """Apply a user method to each image.

    ``partial`` sees one block of an image's rows and returns a few rows.  ``combine`` turns partial rows
    of up to ``fan_in`` blocks into partial rows again, level by level, and ``merge`` makes the result of
    the last ``fan_in``, so no call sees an image whole, whatever its size.  Both must not depend on how
    blocks are grouped.  Without ``combine``, ``merge`` sees the partial rows of all blocks.
    """
    keys = list(keys)

    def first(p: pd.DataFrame) -> pd.DataFrame:
        rows, copies = p.drop(columns=["_block", "_copies"]), p["_copies"].to_numpy()
        if (copies > 1).any():
            rows = rows.loc[rows.index.repeat(copies)].reset_index(drop=True)
        return partial(rows).assign(_block=p["_block"].iloc[0])

    with_block = f"{partial_schema}, _block long"
    parts = blocks(samples, keys, rows_per_block).groupBy(*keys, "_block").applyInPandas(first, with_block)
    if combine is not None:
        parts = stored(parts, "partials")
        while (parts.agg(F.max("_block")).first()[0] or 0) >= fan_in:

            def level(p: pd.DataFrame) -> pd.DataFrame:
                return combine(p.drop(columns="_block")).assign(_block=p["_block"].iloc[0] // fan_in)

            parts = stored(_dealt(parts.withColumn("_up", F.floor(F.col("_block") / fan_in)), [*keys, "_up"]).groupBy(*keys, "_up").applyInPandas(lambda p: level(p.drop(columns="_up")), with_block), "partials")
    return _dealt(parts.drop("_block"), keys).groupBy(*keys).applyInPandas(merge, result_schema)
