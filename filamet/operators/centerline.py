"""Ordered operators along centreline runs: arc length, fragments, tangents, weights, slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filamet.operators.ordered import log_bucket, order_bucket, ordered
from filamet.operators.quantiles import exact_quantiles
from filamet.session import cut_lineage


def steps(runs: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, y: str, *, lags: dict[str, str] | None = None) -> DataFrame:
    """Add ``step``, the distance from the sample before (null for the first one).

    The result is stored once, since every operator along a run reads it more than once.
    """
    keys = list(keys)
    lagged = ordered(order_bucket(runs, keys, order), keys, order, lags={"_px": x, "_py": y, **(lags or {})}, keep_bucket=True)
    return cut_lineage(lagged.withColumn("step", F.hypot(F.col(x) - F.col("_px"), F.col(y) - F.col("_py"))).drop("_px", "_py"))


def arc_length(stepped: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add the running length ``s`` along each run to the output of :func:`steps`."""
    return ordered(stepped, keys, order, sums={"s": F.coalesce("step", F.lit(0.0))}, keep_bucket=True)


def median_step(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    m = exact_quantiles(runs, keys, "step", [0.5], names=["median_step"])
    return runs.select(*keys).distinct().join(m, list(keys), "left").withColumn("median_step", F.coalesce("median_step", F.lit(0.0)))


def fragments(runs: DataFrame, keys: Sequence[str], order: Sequence[str], refinable: str, *, gap_factor: float = 2.0, min_points: int = 5) -> DataFrame:
    """Cut runs where a sample is not refinable or the gap to the one before is too wide.

    Needs ``step``, ``__b`` and ``ok_before`` from :func:`steps` with ``lags={"ok_before":
    refinable}``.  The gap counts from the sample before, refinable or not.  Only refinable
    samples are returned, with their fragment number, its size and whether it is too short to
    be smoothed.
    """
    keys = list(keys)
    limits = median_step(runs, keys).select(*keys, (F.col("median_step") * gap_factor).alias("_max"))
    rows = runs.join(limits, keys)
    joined_on = F.coalesce("ok_before", F.lit(False)) & (F.col("_max") > 0) & (F.col("step") <= F.col("_max"))
    starts = (F.col(refinable) & ~joined_on).cast("int")
    numbered = cut_lineage(ordered(rows, keys, order, sums={"fragment": starts}, keep_bucket=True).where(refinable))
    sizes = numbered.groupBy(*keys, "fragment").agg(F.count(F.lit(1)).alias("points"))
    return numbered.join(sizes, [*keys, "fragment"]).withColumn("too_short", F.col("points") < min_points).drop("_max", "ok_before")


def tangents_normals(samples: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, y: str, raw_nx: str, raw_ny: str) -> DataFrame:
    """Central-difference tangents, one-sided at the ends; normals point like the raw normal."""
    run = ordered(samples, keys, order, lags={"_x0": x, "_y0": y}, leads={"_x1": x, "_y1": y}, keep_bucket=True)
    dx = F.coalesce("_x1", x) - F.coalesce("_x0", x)
    dy = F.coalesce("_y1", y) - F.coalesce("_y0", y)
    lone = F.col("_x0").isNull() & F.col("_x1").isNull()
    norm = F.hypot("_dx", "_dy")
    run = run.withColumns({"_dx": dx, "_dy": dy}).withColumns({
        "tangent_x": F.when(~lone & (norm > 0), F.col("_dx") / norm), "tangent_y": F.when(~lone & (norm > 0), F.col("_dy") / norm),
    })
    flip = F.when(-F.col("tangent_y") * F.col(raw_nx) + F.col("tangent_x") * F.col(raw_ny) < 0, -1.0).otherwise(1.0)
    return run.withColumns({"normal_x": -F.col("tangent_y") * flip, "normal_y": F.col("tangent_x") * flip}).drop("_x0", "_y0", "_x1", "_y1", "_dx", "_dy")


def half_neighbour_weights(samples: DataFrame, keys: Sequence[str], order: Sequence[str], s: str = "s") -> DataFrame:
    """Half the distance to the neighbours on either side; a lone sample weighs nothing."""
    run = ordered(samples, keys, order, lags={"_s0": s}, leads={"_s1": s}, keep_bucket=True)
    return run.withColumn("arc_weight", (F.coalesce("_s1", s) - F.coalesce("_s0", s)) / 2).drop("_s0", "_s1")


def samples_in_runs(runs: DataFrame, samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples placed on their run by pixel; run order is kept in ``ord``."""
    s = samples.withColumnsRenamed({"seed_row": "row", "seed_col": "col"})
    return runs.join(s, [*keys, "row", "col"])


def average_ranks(df: DataFrame, keys: Sequence[str], x: str, name: str) -> DataFrame:
    """Average rank per distinct value of a group."""
    keys = list(keys)
    cells = df.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_n")).withColumn("__b", log_bucket(F.col(x)))
    run = ordered(cells, keys, [x], sums={"_c": F.col("_n")})
    return run.select(*keys, x, (F.col("_c") - (F.col("_n") - 1) / 2).alias(name))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation over pairs where both values are finite; null below three pairs."""
    keys = list(keys)
    inf = F.lit(float("inf"))
    ok = F.lit(True)
    for k in (x, y):
        ok = ok & F.col(k).isNotNull() & ~F.isnan(k) & (F.abs(k) != inf)
    pairs = df.where(ok).select(*keys, x, y)
    ranked = pairs.join(average_ranks(pairs, keys, x, "_rx"), [*keys, x]).join(average_ranks(pairs, keys, y, "_ry"), [*keys, y])
    rho = F.when(F.count(F.lit(1)) >= 3, F.corr("_rx", "_ry"))
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(~F.isnan(rho), rho).alias("rho"))


def nematic_order(df: DataFrame, keys: Sequence[str], qx: str, qy: str, w: str, coherence: str) -> DataFrame:
    def mean(k: str) -> Column:
        return F.sum(F.col(w) * F.col(k)) / F.sum(w)

    return df.groupBy(*keys).agg(F.hypot(mean(qx), mean(qy)).alias("nematic_order"), mean(coherence).alias("mean_coherence"))


def sliced_centroids(pixels: DataFrame, keys: Sequence[str], *, n_slices: int = 9, min_span: float = 18.0, min_pixels: int = 40, per_slice: int = 3, min_slices: int = 3) -> DataFrame:
    """Centroids of equal slices of the inner 80 % of a component along its axis, smoothed.

    ``pixels`` carries ``axis_x axis_y center_x center_y``.  Smoothing is Gaussian with sigma 1
    and mirrored ends; at most ``n_slices`` rows per component reach the windows.
    """
    keys = list(keys)
    t = (F.col("col") - F.col("center_x")) * F.col("axis_x") + (F.col("row") - F.col("center_y")) * F.col("axis_y")
    p = pixels.withColumn("_t", t)
    ends = p.groupBy(*keys).agg(F.min("_t").alias("_t0"), F.max("_t").alias("_t1"), F.count(F.lit(1)).alias("_n"))
    ends = ends.where((F.col("_t1") - F.col("_t0") >= min_span) & (F.col("_n") >= min_pixels))
    span = F.col("_t1") - F.col("_t0")
    j = p.join(ends, keys).withColumns({"_a": F.col("_t0") + 0.10 * span, "_z": F.col("_t1") - 0.10 * span})

    def cut(i: Column) -> Column:
        return F.when(i >= n_slices, F.col("_z")).otherwise(F.col("_a") + i * ((F.col("_z") - F.col("_a")) / n_slices))

    guess = F.floor((F.col("_t") - F.col("_a")) / ((F.col("_z") - F.col("_a")) / n_slices))
    j = j.withColumn("_g", guess).withColumn("slice", F.when(F.col("_t") < cut(F.col("_g")), F.col("_g") - 1).when(F.col("_t") >= cut(F.col("_g") + 1), F.col("_g") + 1).otherwise(F.col("_g")))
    c = j.where((F.col("slice") >= 0) & (F.col("slice") < n_slices)).groupBy(*keys, "slice").agg(
        F.avg("col").alias("x"), F.avg("row").alias("y"), F.count(F.lit(1)).alias("_k"), F.max("axis_x").alias("_ax"), F.max("axis_y").alias("_ay")
    ).where(F.col("_k") >= per_slice)
    part = Window.partitionBy(*keys)
    order = part.orderBy("slice")
    c = c.withColumns({"i": F.row_number().over(order) - 1, "n": F.count(F.lit(1)).over(part)}).where(F.col("n") >= min_slices)
    # Gaussian weights, sigma 1, cut at 4 sigma; mirrored positions repeat the end points
    taps = c.withColumn("_o", F.explode(F.sequence(F.lit(-4), F.lit(4))))
    m = F.pmod(F.col("i") + F.col("_o"), 2 * F.col("n"))
    taps = taps.select(*keys, F.when(m < F.col("n"), m).otherwise(2 * F.col("n") - 1 - m).alias("j"), "i", "n", "slice", "_o", "_ax", "_ay")
    src = c.select(*keys, F.col("i").alias("j"), "x", "y")
    w = F.exp(-F.col("_o") * F.col("_o") / 2.0)
    sm = taps.join(src, [*keys, "j"]).groupBy(*keys, "i", "n", "slice", "_ax", "_ay").agg((F.sum(w * F.col("x")) / F.sum(w)).alias("x"), (F.sum(w * F.col("y")) / F.sum(w)).alias("y"))
    line = Window.partitionBy(*keys).orderBy("i")
    dx = F.coalesce(F.lead("x").over(line), F.col("x")) - F.coalesce(F.lag("x").over(line), F.col("x"))
    dy = F.coalesce(F.lead("y").over(line), F.col("y")) - F.coalesce(F.lag("y").over(line), F.col("y"))
    sm = sm.withColumns({"_dx": dx, "_dy": dy})
    norm = F.hypot("_dx", "_dy")
    return sm.select(*keys, F.col("i").cast("int").alias("i"), "x", "y", F.when(norm > 0, F.col("_dx") / norm).otherwise(F.col("_ax")).alias("tangent_x"), F.when(norm > 0, F.col("_dy") / norm).otherwise(F.col("_ay")).alias("tangent_y"))


def diagnostic_rois(images: DataFrame, width: str, height: str, footer_y0: str, *, n_rois: int = 4, size: int = 500, margin: int = 50) -> DataFrame:
    """Up to four footer-safe boxes per image: centre, top left, top right, bottom middle."""
    w = F.col(width).cast("long")
    h = F.coalesce(F.col(footer_y0), F.col(height)).cast("long")
    half_w, half_h = F.floor(w / 2), F.floor(h / 2)

    def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        return F.struct(*[v.cast("long").alias(k) for k, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))])

    third = F.floor(F.least(w, h) / 3)
    zero = F.lit(0).cast("long")
    small = F.array(box(F.greatest(zero, half_w - third), F.greatest(zero, half_h - third), F.least(w, half_w + third), F.least(h, half_h + third)))
    rh = size // 2
    center = box(half_w - rh, half_h - rh, half_w + rh, half_h + rh)
    q = F.least(F.lit(size).cast("long"), F.floor((w - 3 * margin) / 2), F.floor((h - 3 * margin) / 2))
    bottom = h - margin
    more = F.array(
        center, box(F.lit(margin), F.lit(margin), margin + q, margin + q), box(w - margin - q, F.lit(margin), w - margin, margin + q),
        box(half_w - F.floor(q / 2), bottom - q, half_w - F.floor(q / 2) + q, bottom),
    )
    fits = (w >= size + 2 * margin) & (h >= size + 2 * margin)
    boxes = F.when(~fits, small).when(q > 100, F.slice(more, 1, n_rois)).otherwise(F.slice(F.array(center), 1, n_rois))
    return images.select("*", F.posexplode(boxes).alias("roi_ord", "_box")).select(*images.columns, "roi_ord", "_box.*")


def candidate_samples(candidates: DataFrame, keys: Sequence[str], line_length: str, widths: str) -> DataFrame:
    """Sections as samples weighted by centreline length over section count; no length, no samples."""
    n = F.size(widths)
    return candidates.where((n > 0) & (F.col(line_length) > 0)).select(
        *keys, F.explode(F.transform(widths, lambda v: v)).alias("value"), (F.col(line_length) / n).alias("weight")
    )
