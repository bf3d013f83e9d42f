"""Operators on long pixel tables ``(image_id, row, col, value)``."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filamet.operators.components import connected_components
from filamet.operators.distributions import bin_index, edge
from filamet.operators.quantiles import exact_quantiles
from filamet.session import stored


def foreground(value: Column, level: Column | float) -> Column:
    """Strictly above the level."""
    return value > level


def unit_interval(value: Column, low: float, high: float) -> Column:
    """Integer intensities scaled by the full range of their type."""
    return (value - low) / (high - low)


def unit_problem(value: Column) -> Column:
    return F.when((value < 0) | (value > 1), "OUTSIDE_UNIT_INTERVAL")


def quantize(value: Column, levels: int) -> Column:
    """Clip to [0, 1] and round half-even to ``levels`` steps."""
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) * levels, 0) / levels


# ---- intensity ------------------------------------------------------------------------------

def luma(r: Column, g: Column, b: Column) -> Column:
    # fixed values: luma weights
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def gray(df: DataFrame) -> DataFrame:
    """Gray passes through; ``r g b`` becomes luma; any other layout is an error."""
    have = set(df.columns)
    if "value" in have:
        return df
    if {"r", "g", "b"} <= have:
        return df.withColumn("value", luma(F.col("r"), F.col("g"), F.col("b"))).drop("r", "g", "b")
    raise ValueError("pixel table needs 'value' or 'r', 'g' and 'b'")


def contrast(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    base = pixels.groupBy(*keys).agg(F.min("value").alias("min"), F.max("value").alias("max"), F.stddev_pop("value").alias("std"))
    q = exact_quantiles(pixels, keys, "value", [0.02, 0.98], names=["p2", "p98"])
    return base.join(q, keys).withColumn("p2_p98", F.col("p98") - F.col("p2"))


def clip_normalize(pixels: DataFrame, keys: Sequence[str], low: float, high: float, floor: float) -> DataFrame:
    """Scale each image between two of its percentiles and clip to [0, 1]."""
    q = exact_quantiles(pixels, keys, "value", [low, high], names=["_lo", "_hi"])
    v = (F.col("value") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(floor))
    return pixels.join(q, list(keys)).withColumn("norm", F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))).drop("_lo", "_hi")


def polarity(pixels: DataFrame, keys: Sequence[str], value: str, height: str, width: str) -> DataFrame:
    """Bright when the interior is brighter than the one-pixel border."""
    border = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == F.col(height) - 1) | (F.col("col") == F.col(width) - 1)
    m = pixels.groupBy(*keys).agg(F.avg(F.when(~border, F.col(value))).alias("interior"), F.avg(F.when(border, F.col(value))).alias("border"))
    return m.withColumn("is_bright", F.col("interior") > F.col("border"))


NO_PIXELS = 128.0  # fixed value


def otsu(pixels: DataFrame, keys: Sequence[str], value: str, bins: int = 256) -> DataFrame:
    """Otsu threshold per group over equal bins; only bins that hold pixels reach the windows.

    Pixels that are null, NaN or infinite are left out; a group without any other gets NO_PIXELS.
    """
    keys = list(keys)
    groups, v = pixels.select(*keys).distinct(), F.col(value).cast("double")
    pixels = pixels.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    edges = common_range(pixels, keys, value, bins)
    h = pixels.join(edges, keys).groupBy(*keys, bin_index(F.col(value), F.col("lo"), F.col("hi"), F.col("bins")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    lo, hi, nb, i = F.col("lo"), F.col("hi"), F.col("bins"), F.col("bin")
    full = h.join(edges, keys).withColumn("center", (edge(lo, hi, nb, i) + edge(lo, hi, nb, i + 1)) / 2)
    order, whole = Window.partitionBy(*keys).orderBy("bin"), Window.partitionBy(*keys)
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = full.withColumns({
        "_w1": F.sum("n").over(run), "_s1": F.sum(F.col("n") * F.col("center")).over(run), "_next": F.lead("bin").over(order), "_prev": F.lag("bin").over(order),
        "_w": F.sum("n").over(whole), "_s": F.sum(F.col("n") * F.col("center")).over(whole),
    })
    w2 = F.col("_w") - F.col("_w1")
    m1 = F.col("_s1") / F.greatest(F.col("_w1").cast("double"), F.lit(1e-12))
    m2 = (F.col("_s") - F.col("_s1")) / F.greatest(w2.cast("double"), F.lit(1e-12))
    # bins without pixels repeat the value of the bin before them; those below the first have the value 0
    last = F.least(F.coalesce(F.col("_next") - 1, nb - 2), nb - 2)
    span = lambda v, a, z: F.struct(v.alias("v"), a.alias("a"), z.alias("z"))
    below = F.when(F.col("_prev").isNull() & (i > 0), span(F.lit(0.0), F.lit(0), F.least(i - 1, nb - 2)))
    spans = F.array_compact(F.array(below, F.when(i <= last, span(F.col("_w1") * w2 * (m1 - m2) * (m1 - m2), i, last))))
    full = full.withColumn("_spans", spans).withColumn("_best", F.max(F.array_max(F.transform("_spans", lambda p: p["v"]))).over(whole))
    best = full.select(*keys, "_best", F.explode("_spans").alias("_p")).where(F.col("_p.v") >= F.col("_best") - 1e-5)
    size = (F.col("_p.z") - F.col("_p.a") + 1).cast("long")
    pick = best.groupBy(*keys).agg(F.floor(F.sum(size * (F.col("_p.a") + F.col("_p.z"))) / 2 / F.sum(size)).cast("int").alias("_i"))
    found = pick.join(edges, keys).select(*keys, ((edge(lo, hi, nb, F.col("_i")) + edge(lo, hi, nb, F.col("_i") + 1)) / 2).alias("threshold"))
    return groups.join(found, keys, "left").select(*keys, F.coalesce("threshold", F.lit(NO_PIXELS)).alias("threshold"))


def common_range(df: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    e = df.groupBy(*keys).agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"))
    flat = F.col("_mn") == F.col("_mx")
    return e.select(*keys, F.when(flat, F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("lo"), F.when(flat, F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("hi"), F.lit(bins).alias("bins"))


def level_of(value: Column, levels: int) -> Column:
    """Integer level of a value in [0, 1], half-even."""
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) * (levels - 1), 0).cast("long")


def discrete_otsu(pixels: DataFrame, keys: Sequence[str], value: str, levels: int = 256) -> DataFrame:
    """Otsu level on the discrete histogram; exact ties average."""
    keys = list(keys)
    h = pixels.groupBy(*keys, level_of(F.col(value), levels).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy(*keys).orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    h = h.withColumns({
        "_w": F.sum("n").over(run), "_m": F.sum(F.col("n") * F.col("level")).over(run),
        "_tw": F.sum("n").over(whole), "_tm": F.sum(F.col("n") * F.col("level")).over(whole), "_next": F.lead("level").over(Window.partitionBy(*keys).orderBy("level")),
    })
    # levels without pixels repeat the value of the level before them
    gap = F.coalesce(F.col("_next") - 1, F.lit(levels - 1))
    big = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products of two sums leave the range of long
    d = (big("_tm") * big("_w") - big("_m") * big("_tw")).cast("double")
    h = h.withColumn("_v", F.when(F.col("_w") < F.col("_tw"), d * d / (F.col("_w").cast("double") * (F.col("_tw") - F.col("_w")))).otherwise(0.0))
    best = h.withColumn("_best", F.max("_v").over(whole)).where(F.col("_v") == F.col("_best"))
    # the mean over runs of equal levels; all levels tie (also those below the first) when there is no contrast
    span = gap - F.col("level") + 1
    out = best.groupBy(*keys).agg(
        F.sum(span).alias("_k"), F.sum(span * (F.col("level") + gap) / 2).alias("_t"), F.max("_best").alias("_b")
    )
    return out.select(*keys, (F.when(F.col("_b") > 0, F.col("_t") / F.col("_k")).otherwise((levels - 1) / 2) / (levels - 1)).alias("threshold"))


def equalize(pixels: DataFrame, keys: Sequence[str], value: str, *, levels: int = 256, targets: int = 64) -> DataFrame:
    """Map gray levels to ``targets`` levels by the smallest cumulative error, lowest index first."""
    keys = list(keys)
    h = pixels.groupBy(*keys, level_of(F.col(value), levels).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy("level")
    h = h.withColumns({
        "_cum": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_tot": F.sum("n").over(Window.partitionBy(*keys)),
    })
    # half a level's own pixels count, except at the two ends of the scale
    own = F.when((F.col("level") > 0) & (F.col("level") < levels - 1), F.col("n")).otherwise(0)
    share = F.col("_tot") / targets
    # fixed value: square root of the double epsilon; an error below it counts as the largest one
    least = -F.col("_tot") * 1.4901161193847656e-08
    # errors never decrease with the target, so the first one that counts is the smallest; it is next to the guess
    guess = F.floor((F.col("_cum") - own / 2 + least) / share).cast("int")
    near = [F.greatest(F.lit(0), F.least(F.lit(targets - 1), guess + k)) for k in (-1, 0, 1)]
    first = F.coalesce(*[F.when((t + 1) * share - F.col("_cum") + own / 2 >= least, t) for t in near], F.lit(0))
    mapped = h.select(*keys, "level", first.alias("_t"))
    lut = mapped.select(*keys, "level", quantize(F.col("_t") / (targets - 1), levels - 1).alias("equalized"))
    return pixels.withColumn("level", level_of(F.col(value), levels)).join(lut, [*keys, "level"]).drop("level")


# ---- neighbourhoods -------------------------------------------------------------------------

def _mirrored(df: DataFrame, axis: str, size: str, half: int) -> DataFrame:
    """Copies of edge pixels at mirrored positions ``_p``; the edge pixel itself repeats."""
    j, n = F.col(axis), F.col(size)
    reach = F.ceil(F.lit(half) / (2 * n)).cast("long") + 1
    turns = F.sequence(-reach, reach)
    spots = F.concat(F.transform(turns, lambda m: j + 2 * n * m), F.transform(turns, lambda m: -j - 1 + 2 * n * m))
    return df.withColumn("_p", F.explode(F.filter(spots, lambda p: (p >= -half) & (p < n + half))))


def _line_mean(df: DataFrame, keys: Sequence[str], value: str, half: int, name: str) -> DataFrame:
    """Mean of the positions ``_p - half`` to ``_p + half`` of a line that has them all."""
    line = Window.partitionBy(*keys).orderBy("_p")
    v = F.col(value).cast("double")
    finite = F.abs(v) < float("inf")
    # sums up to a position: of finite values, of their number, of the others
    parts = {"_s": F.when(finite, v).otherwise(0.0), "_n": F.when(finite, 1).otherwise(0), "_o": F.when(v.isNotNull() & ~finite, 1).otherwise(0)}
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = df.withColumns({k: F.sum(c).over(upto) for k, c in parts.items()})
    s, n, o = (F.lead(k, half).over(line) - F.coalesce(F.lag(k, half + 1).over(line), F.lit(0)) for k in parts)
    return run.withColumn(name, F.when(o > 0, F.lit(float("nan"))).when(n > 0, s / n)).drop(*parts)


def box_mean(pixels: DataFrame, keys: Sequence[str], value: str, height: str, width: str, size: int = 35) -> DataFrame:
    """Mean over a ``size`` x ``size`` box with mirrored edges, by prefix sums: four look-ups per pixel, two per axis.

    Windows run within one image row or column, so a task holds at most one line of pixels.  Null
    pixels do not count; a box with a NaN or infinite pixel has the mean NaN.
    """
    keys, half = list(keys), size // 2
    across = _line_mean(_mirrored(pixels, "col", width, half), [*keys, "row"], value, half, "_m")
    across = across.where((F.col("_p") >= 0) & (F.col("_p") < F.col(width))).drop("col").withColumnRenamed("_p", "col")
    down = _line_mean(_mirrored(across, "row", height, half), [*keys, "col"], "_m", half, "box_mean")
    return down.where((F.col("_p") >= 0) & (F.col("_p") < F.col(height))).drop("row", "_m").withColumnRenamed("_p", "row")


def local_threshold(pixels: DataFrame, keys: Sequence[str], value: str, height: str, width: str, *, size: int = 35, offset: float = 0.03) -> DataFrame:
    return box_mean(pixels, keys, value, height, width, size).withColumn("foreground", F.col(value) > F.col("box_mean") + offset)


def detect_footer(pixels: DataFrame, keys: Sequence[str], height: str, *, level: float = 240.0, share: float = 0.60) -> DataFrame:
    """Longest band of bright rows in the lower part of an image: ``footer_y0``, ``footer_y1``.

    Pixels fold to one row per image row first; the windows then see at most one entry per row.
    """
    keys = list(keys)
    rows = pixels.groupBy(*keys, "row").agg(F.avg((F.col("value") > level).cast("double")).alias("_f"), F.max(height).alias("_h"))
    lit = rows.where((F.col("_h") >= 100) & (F.col("row") >= F.floor(F.col("_h") * 0.65)) & (F.col("_f") > share))
    order = Window.partitionBy(*keys).orderBy("row")
    starts = F.coalesce((F.col("row") - F.lag("row").over(order) > 3).cast("int"), F.lit(1))
    lit = lit.withColumn("_new", starts).withColumn("_band", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    bands = lit.groupBy(*keys, "_band").agg(F.min("row").alias("_a"), F.max("row").alias("_z"), F.count(F.lit(1)).alias("_k"), F.max("_h").alias("_h"))
    best = bands.groupBy(*keys).agg(
        F.sum("_k").alias("_rows"), F.max("_h").alias("_h"),
        F.max(F.struct((F.col("_z") - F.col("_a")).alias("span"), (-F.col("_a")).alias("na"))).alias("_b"),
    )
    a, span = -F.col("_b.na"), F.col("_b.span")
    found = best.where((F.col("_rows") >= 20) & (span >= 30))
    return found.select(*keys, F.greatest(F.lit(0), a - 4).alias("footer_y0"), F.least(F.col("_h"), a + span + 5).alias("footer_y1"))


# ---- masks and components -------------------------------------------------------------------

def mask_quality(labels: DataFrame, area: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score of a labelled mask; ``area`` holds the pixel count of every group (``pixels``)."""
    keys = list(keys)
    comps = labels.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("_c"))
    s = comps.groupBy(*keys).agg(F.sum("_c").alias("_fg"), F.max("_c").alias("_big"), F.count(F.lit(1)).alias("components"))
    j = area.join(s, keys, "left")
    f = F.coalesce("_fg", F.lit(0)) / F.col("pixels")
    penalty = F.when(F.col("_big") / F.col("_fg") > 0.40, 0.20).otherwise(1.0) * F.when(F.col("components") > 150, 0.30).otherwise(1.0)
    score = F.when((f < 0.01) | (f > 0.60), 0.05).otherwise(F.greatest(F.lit(0.01), (1 - F.abs(f - 0.25) * 2) * penalty))
    return j.select(*keys, F.coalesce("components", F.lit(0)).alias("components"), f.alias("fraction"), score.alias("score"))


#: fixed values: percentile, size and offset of the three masks
MASKS = ["local", "otsu", "percentile"]
MASK_PERCENTILE, MASK_SIZE, MASK_OFFSET = 0.65, 35, 0.03


def candidate_masks(pixels: DataFrame, keys: Sequence[str], value: str, height: str, width: str) -> DataFrame:
    """Foreground pixels (``method``, ``row``, ``col``) of the three thresholds on a normalised image.

    Otsu on 255 levels, the percentile and the local mean; in an image that is not bright the pixels
    below the threshold are the foreground.
    """
    keys = list(keys)
    levels = otsu(pixels.withColumn("_g", F.col(value) * 255.0), keys, "_g").select(*keys, (F.col("threshold") / 255.0).alias("_otsu"))
    levels = levels.join(exact_quantiles(pixels, keys, value, [MASK_PERCENTILE], names=["_percentile"]), keys)
    levels = levels.join(polarity(pixels, keys, value, height, width).select(*keys, F.col("is_bright").alias("_bright")), keys)
    rows = box_mean(pixels, keys, value, height, width, MASK_SIZE).join(levels, keys)
    side = F.when(F.col("_bright"), 1.0).otherwise(-1.0)
    limits = {"local": F.col("box_mean") + side * MASK_OFFSET, "otsu": F.col("_otsu"), "percentile": F.col("_percentile")}
    options = F.array(*[F.struct(F.lit(m).alias("m"), limits[m].alias("t")) for m in MASKS])
    inside = F.when(F.col("_bright"), F.col(value) > F.col("_k.t")).otherwise(F.col(value) < F.col("_k.t"))
    return rows.withColumn("_k", F.explode(options)).where(inside).select(*keys, F.col("_k.m").alias("method"), "row", "col")


def auto_threshold(pixels: DataFrame, keys: Sequence[str], value: str, height: str, width: str) -> DataFrame:
    """The best of the three masks per group: ``method`` and ``score``; on a tie the earlier of MASKS."""
    keys = list(keys)
    area = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("pixels")).withColumn("method", F.explode(F.array(*[F.lit(m) for m in MASKS])))
    # components read the masks twice
    masks = stored(candidate_masks(pixels, keys, value, height, width), "masks")
    labels = connected_components(masks, [*keys, "method"])
    return best_mask(mask_quality(labels, area, [*keys, "method"]), keys, "method", MASKS)


def best_mask(scores: DataFrame, keys: Sequence[str], method: str, order: Sequence[str]) -> DataFrame:
    """Highest score; on a tie the earlier method of ``order``."""
    rank = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(method))
    return scores.groupBy(*keys).agg(F.max(F.struct(F.col("score"), (-rank).alias("o"), F.col(method).alias("m"))).alias("_b")).select(
        *keys, F.col("_b.m").alias(method), F.col("_b.score").alias("score")
    )


def component_shape(pixels: DataFrame, keys: Sequence[str], px: str, py: str) -> DataFrame:
    """Area, centroid, principal axis, elongation and span of each component (in metres / pixels)."""
    keys = list(keys)
    x, y = F.col("col") * F.col(px), F.col("row") * F.col(py)
    s = pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("area_px"), F.avg("col").alias("center_x"), F.avg("row").alias("center_y"),
        F.var_samp(x).alias("_xx"), F.var_samp(y).alias("_yy"), F.covar_samp(x, y).alias("_xy"), F.max(px).alias("_px"), F.max(py).alias("_py"),
    )
    small = F.col("area_px") < 5
    half, diff = (F.col("_xx") + F.col("_yy")) / 2, (F.col("_xx") - F.col("_yy")) / 2
    root = F.sqrt(diff * diff + F.col("_xy") * F.col("_xy"))
    l1 = F.when(small, 1.0).otherwise(half + root)
    l2 = F.when(small, 1.0).otherwise(F.greatest(half - root, F.lit(1e-24)))
    theta = F.when(small, F.lit(np.pi / 2)).otherwise(F.atan2(2 * F.col("_xy"), F.col("_xx") - F.col("_yy")) / 2)
    s = s.withColumns({"elongation": F.sqrt(l1 / l2), "_ux": F.cos(theta) / F.col("_px"), "_uy": F.sin(theta) / F.col("_py")})
    s = s.withColumns({"axis_x": F.col("_ux") / F.hypot("_ux", "_uy"), "axis_y": F.col("_uy") / F.hypot("_ux", "_uy")}).drop("_ux", "_uy", "_xx", "_yy", "_xy", "_px", "_py")
    t = (F.col("col") - F.col("center_x")) * F.col("axis_x") + (F.col("row") - F.col("center_y")) * F.col("axis_y")
    span = pixels.join(s, keys).groupBy(*keys).agg((F.max(t) - F.min(t)).alias("span_px"))
    return s.join(span, keys)


def likely_merged(area: Column, span: Column, elongation: Column, expected_width_px: Column) -> Column:
    return (area / F.greatest(span, F.lit(1.0)) > 2.8 * expected_width_px) | ((area > 450) & (elongation < 2.5))
