"""Pixel sources: channel import and luma."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filamet.operators.pixels import clip_normalize

EPS = 2.220446049250313e-16  # fixed value: double epsilon


def import_channel(channel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signal clipped between P0.5 and P99.5 and scaled; pixel size from the axis ranges.

    Ranges must be positive and all values finite; a row that breaks this fails the job.
    """
    ok = (F.col("x_range") > 0) & (F.col("y_range") > 0) & ~F.isnan("value") & (F.abs("value") != F.lit(float("inf")))
    checked = channel.withColumn("value", F.when(ok, F.col("value")).otherwise(F.raise_error(F.lit("channel ranges must be positive and values finite"))))
    return clip_normalize(checked, keys, 0.005, 0.995, EPS).withColumns({
        "pixel_size_x": F.col("x_range") / F.col("width"), "pixel_size_y": F.col("y_range") / F.col("height"),
    })
