"""Parity of two results: masks, aligned values, diameters, histograms, fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filamet.operators.distributions import pair_distances
from filamet.operators.groups import sd_or_zero
from filamet.operators.quantiles import exact_quantiles, multi_quantiles

EPS = 2.220446049250313e-16  # fixed value: double epsilon


def mask_counts(left: DataFrame, right: DataFrame, keys: Sequence[str], at: Sequence[str]) -> DataFrame:
    """Foreground counts of two masks given as foreground coordinates."""
    on = [*keys, *at]
    j = left.select(*on, F.lit(1).alias("_l")).join(right.select(*on, F.lit(1).alias("_r")), on, "full_outer")
    return j.groupBy(*keys).agg(F.count("_l").alias("left_n"), F.count("_r").alias("right_n"), F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("intersection"), F.count(F.lit(1)).alias("union"))


def mask_parity(left: DataFrame, right: DataFrame, area: DataFrame, keys: Sequence[str], at: Sequence[str]) -> DataFrame:
    """IoU, Dice, precision, recall and differing pixels; two empty masks agree fully."""
    c = mask_counts(left, right, keys, at)
    full = area.join(c, list(keys), "left").fillna(0, ["left_n", "right_n", "intersection", "union"])
    l, r, i, u = (F.col(k) for k in ("left_n", "right_n", "intersection", "union"))
    return full.select(
        *keys, l, r, i, u, (u - i).alias("different"), F.when(F.col("pixels") > 0, (u - i) / F.col("pixels")).otherwise(0.0).alias("different_fraction"),
        F.when(u > 0, i / u).otherwise(1.0).alias("iou"), F.when(l + r > 0, 2 * i / (l + r)).otherwise(1.0).alias("dice"),
        F.when(r > 0, i / r).when(l == 0, 1.0).otherwise(0.0).alias("precision"), F.when(l > 0, i / l).when(r == 0, 1.0).otherwise(0.0).alias("recall"),
        # the second convention divides by at least one pixel
        (i / F.greatest(u, F.lit(1))).alias("iou_min1"), (2 * i / F.greatest(l + r, F.lit(1))).alias("dice_min1"),
        (i / F.greatest(l, F.lit(1))).alias("overlap_fraction"), (i / F.greatest(l + r - i, F.lit(1))).alias("jaccard"),
    )


def float_parity(left: DataFrame, right: DataFrame, keys: Sequence[str], at: Sequence[str], *, rtol: float = 1e-7, atol: float = 1e-9) -> DataFrame:
    """Aligned differences; positions on one side only mean the shapes differ and nothing else is reported."""
    on = [*keys, *at]
    j = left.select(*on, F.col("value").alias("_a"), F.lit(1).alias("_l")).join(right.select(*on, F.col("value").alias("_b"), F.lit(1).alias("_r")), on, "full_outer")
    nan_a, nan_b = F.isnan("_a"), F.isnan("_b")
    d = F.col("_a") - F.col("_b")
    close = (nan_a & nan_b) | (~nan_a & ~nan_b & (F.abs(d) <= atol + rtol * F.abs("_b")))
    out = j.groupBy(*keys).agg(
        (F.count("_l") == F.count(F.lit(1))).alias("_fl"), (F.count("_r") == F.count(F.lit(1))).alias("_fr"),
        F.max(F.abs(d)).alias("max_abs_difference"), F.avg(F.abs(d)).alias("mean_abs_difference"), F.sqrt(F.avg(d * d)).alias("rmse"),
        F.max(F.abs(d) / F.greatest(F.abs("_a"), F.lit(EPS))).alias("max_relative_difference"), F.bool_and(F.coalesce(close, F.lit(False))).alias("allclose"),
    ).withColumn("shape_equal", F.col("_fl") & F.col("_fr"))
    names = ["max_abs_difference", "mean_abs_difference", "rmse", "max_relative_difference", "allclose"]
    return out.select(*keys, "shape_equal", *[F.when(F.col("shape_equal"), F.col(n)).alias(n) for n in names])


def side_summary(df: DataFrame, keys: Sequence[str], side: str, x: str) -> DataFrame:
    keys = [*keys, side]
    s = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), sd_or_zero(x).alias("std"), F.stddev_pop(x).alias("pop_std"))
    return s.join(exact_quantiles(df, keys, x, [0.05, 0.25, 0.5, 0.75, 0.95], names=["p05", "p25", "p50", "p75", "p95"]), keys)


def diameter_parity(df: DataFrame, keys: Sequence[str], side: str, names: tuple[str, str], x: str, at: str) -> DataFrame:
    """KS, W1, largest aligned difference, and error metrics that need equal lengths.

    With unequal lengths MAE, RMSE and P90 fall back to the difference of the means.
    """
    keys = list(keys)
    a, b = names
    s = side_summary(df, keys, side, x)

    def pick(col: str, which: str) -> Column:
        return F.max(F.when(F.col(side) == which, F.col(col)))

    cols = ("n", "mean", "p50", "pop_std")
    wide = s.groupBy(*keys).agg(*[pick(cn, nm).alias(f"{cn}_{t}") for cn in cols for t, nm in (("a", a), ("b", b))])
    dist = pair_distances(df.withColumn("_one", F.lit(1.0)), keys, side, names, x, "_one", weighted=False).select(*keys, F.col("w1_unweighted").alias("wasserstein"), "ks")
    left = df.where(F.col(side) == a).select(*keys, at, F.col(x).alias("_a"))
    right = df.where(F.col(side) == b).select(*keys, at, F.col(x).alias("_b"))
    pairs = left.join(right, [*keys, at]).withColumn("_d", F.abs(F.col("_a") - F.col("_b")))
    errs = pairs.groupBy(*keys).agg(F.avg("_d").alias("_mae"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("_rmse"), F.max("_d").alias("_max"), F.count(F.lit(1)).alias("_k"))
    p90 = multi_quantiles(pairs, keys, {("r", 0.9): ("_p90", F.col("_d") / F.greatest(F.col("_b"), F.lit(1e-12)))})
    j = wide.join(dist, keys).join(errs, keys, "left").join(p90, keys, "left")
    same = (F.col("n_a") == F.col("n_b")) & (F.col("_k") == F.col("n_a"))
    dm = F.abs(F.col("mean_a") - F.col("mean_b"))
    return j.select(
        *keys, "n_a", "n_b", (F.col("mean_a") - F.col("mean_b")).alias("difference_of_mean"), (F.col("p50_a") - F.col("p50_b")).alias("difference_of_median"),
        (F.col("pop_std_a") - F.col("pop_std_b")).alias("difference_of_std"), "wasserstein", "ks", F.when(same, F.col("_max")).alias("max_aligned_difference"),
        F.when(same, F.col("_mae")).otherwise(dm).alias("mae"), F.when(same, F.col("_rmse")).otherwise(dm).alias("rmse"),
        F.when(same, F.col("_p90")).otherwise(dm / F.greatest(F.col("mean_b"), F.lit(1e-12))).alias("p90_relative"),
    )


def histogram_parity(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Compare ``counts`` and ``edges`` arrays (bounded by the number of bins)."""
    j = left.select(*keys, F.col("counts").alias("_lc"), F.col("edges").alias("_le")).join(right.select(*keys, F.col("counts").alias("_rc"), F.col("edges").alias("_re")), list(keys))

    def gap(a: str, b: str) -> Column:
        return F.when(F.size(a) == F.size(b), F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double"))))

    return j.select(
        *keys, F.size("_lc").cast("long").alias("left_bins"), F.size("_rc").cast("long").alias("right_bins"), (F.col("_lc") == F.col("_rc")).alias("counts_equal"), gap("_lc", "_rc").alias("counts_max_difference"),
        (F.col("_le") == F.col("_re")).alias("edges_equal"), gap("_le", "_re").alias("edges_max_difference"),
    )


def fit_parity(left: Column, right: Column) -> Column:
    d = F.abs(left - right)
    return F.struct(d.alias("absolute"), F.when(left != 0, d / F.abs(left)).alias("relative"))


def error_rollup(df: DataFrame, error: str, ordered_flag: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean error of ordered and disordered cases, median, P90, maximum, share within 10 % and gate."""
    keys = list(keys)
    e = F.col(error)
    base = df.groupBy(*keys).agg(
        F.count(error).alias("cases"), F.avg(F.when(F.col(ordered_flag), e)).alias("mean_ordered"), F.avg(F.when(~F.col(ordered_flag), e)).alias("mean_disordered"),
        F.max(e).alias("max_error"), F.avg((e <= 10.0).cast("double")).alias("within_10"),
    )
    q = exact_quantiles(df, keys, error, [0.5, 0.9], names=["median_error", "p90_error"])
    return base.join(q, keys).withColumn("gate_passed", (F.col("median_error") <= 5.0) & (F.col("p90_error") <= 10.0))
