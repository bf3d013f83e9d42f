"""Statistics over reviewed measurements: sections, fibers, images, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filamet.operators.groups import agg, join_groups, sd_or_zero
from filamet.operators.ordered import ordered
from filamet.operators.quantiles import exact_quantiles
from filamet.session import cut_lineage

LEVEL_PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]
LEVEL_NAMES = ["p05", "p25", "median", "p75", "p95"]


def level_metrics(df: DataFrame, keys: Sequence[str], x: str, *extra: Column) -> DataFrame:
    """n, mean, SD (0 for one value), min, max, median, IQR, P05 and P95 per group."""
    rows = df.where(F.col(x).isNotNull())
    base = agg(rows, keys, F.count(x).alias("n"), F.avg(x).alias("mean"), sd_or_zero(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"), *extra)
    q = exact_quantiles(rows, keys, x, LEVEL_PROBS, names=LEVEL_NAMES)
    return join_groups(base, q, keys).withColumn("iqr", F.col("p75") - F.col("p25")).drop("p25", "p75")


def usable_sections(df: DataFrame, included: Column, x: str) -> DataFrame:
    """Included rows with a finite, positive value."""
    v = F.col(x)
    return df.where(included & v.isNotNull() & ~F.isnan(v) & (v > 0) & (v != F.lit(float("inf"))))


def section_summary(df: DataFrame, keys: Sequence[str], x: str, fiber: str) -> DataFrame:
    return level_metrics(df, keys, x, F.count_distinct(fiber).alias("n_fibers"))


def fiber_medians(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    return exact_quantiles(df, keys, x, [0.5], names=["fiber_median"])


def fiber_summary(df: DataFrame, keys: Sequence[str], fiber: str, x: str) -> DataFrame:
    """Statistics over fiber medians, so every fiber weighs the same."""
    keys = list(keys)
    sections = agg(df, keys, F.count(x).alias("n_measurements"))
    # the medians feed three aggregates, so they are computed once
    medians = cut_lineage(fiber_medians(df, [*keys, fiber], x))
    return join_groups(level_metrics(medians, keys, "fiber_median"), sections, keys)


def hierarchy(df: DataFrame, project: str, image: str, fiber: str, x: str) -> DataFrame:
    """Section, fiber, image and sample levels in one table with a ``level`` column.

    Fibers without an id share 'UNASSIGNED'.  The image level is the median of all sections of
    an image; the sample level repeats it with the counts of the levels below.
    """
    rows = df.where(F.col(x).isNotNull()).withColumn(
        fiber, F.when(F.col(fiber).isNull() | (F.col(fiber) == ""), "UNASSIGNED").otherwise(F.col(fiber))
    )
    # the medians feed several aggregates, so they are computed once
    per_fiber = cut_lineage(exact_quantiles(rows, [project, image, fiber], x, [0.5], names=["m"]))
    per_image = cut_lineage(exact_quantiles(rows, [project, image], x, [0.5], names=["m"]))
    long = (
        rows.select(project, F.lit("section").alias("level"), F.col(x).alias("m"))
        .unionByName(per_fiber.select(project, F.lit("fiber").alias("level"), "m"))
        .unionByName(per_image.select(project, F.lit("image").alias("level"), "m"))
    )
    levels = level_metrics(long, [project, "level"], "m")
    wide = levels.groupBy(project).agg(*[
        F.max(F.when(F.col("level") == k, F.col("n"))).alias(f"n_{k}s") for k in ("image", "fiber", "section")
    ])
    none = F.lit(None).cast("long")
    flat = levels.withColumns({"n_images": none, "n_fibers": none, "n_sections": none})
    sample = levels.where(F.col("level") == "image").withColumn("level", F.lit("sample")).join(wide, project)
    return flat.unionByName(sample)


def completeness(df: DataFrame, keys: Sequence[str], accepted: Column, target: Column) -> DataFrame:
    """Accepted sections per fiber against the target; a target of 0 or less asks for any."""
    out = df.groupBy(*keys).agg(F.count_if(accepted).alias("accepted"), F.max(target).alias("target"))
    return out.withColumn("complete", F.col("accepted") >= F.when(F.col("target") > 0, F.col("target")).otherwise(1))


def extrema_labels(df: DataFrame, keys: Sequence[str], x: str, ident: str) -> DataFrame:
    """MIN / MED / MAX labels per fiber: all three for one row, no MED for two rows.

    Aggregates instead of ranks, so a fiber of any size needs no sort.  Distances to the median
    that exceed the smallest one by at most 1e-12 of the median tie with it; the smallest value is taken.
    """
    keys = list(keys)
    med = exact_quantiles(df, keys, x, [0.5], names=["_med"])
    order = F.struct(F.col(x), F.col(ident))
    away = F.abs(F.col(x) / F.col("_med") - 1)
    ends = df.join(med, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(order)[ident].alias("_lo"), F.max(order)[ident].alias("_hi"), F.min(away).alias("_d"), F.first("_med").alias("_med"),
    )
    picked = df.join(ends, keys).where(away <= F.col("_d") + 1e-12).groupBy(*keys).agg(
        F.min(order)[ident].alias("_mid"), *[F.first(c).alias(c) for c in ("_n", "_lo", "_hi")],
    )
    labels = F.array(
        F.struct(F.lit(0).alias("o"), F.lit("MIN").alias("label"), F.col("_lo").alias(ident)),
        F.struct(F.lit(1).alias("o"), F.lit("MED").alias("label"), F.when(F.col("_n") != 2, F.col("_mid")).alias(ident)),
        F.struct(F.lit(2).alias("o"), F.lit("MAX").alias("label"), F.col("_hi").alias(ident)),
    )
    return (
        picked.withColumn("_l", F.explode(labels)).where(F.col(f"_l.{ident}").isNotNull())
        .groupBy(*keys, F.col(f"_l.{ident}").alias(ident))
        .agg(F.array_sort(F.collect_list(F.struct("_l.o", "_l.label"))).alias("_s"))
        .select(*keys, ident, F.array_join(F.transform("_s", lambda s: s["label"]), ",").alias("labels"))
    )


def repeatability(df: DataFrame, keys: Sequence[str], original: str, measured: str) -> DataFrame:
    """Intra-operator SD, CV, bias and Bland-Altman limits per study."""
    o, m = F.col(original), F.col(measured)
    d = m - o
    out = df.groupBy(*keys).agg(
        F.count(measured).alias("n_pairs"),
        F.avg((o + m) / 2).alias("mean_value"),
        F.avg(F.abs(d)).alias("mean_abs_diff"),
        F.avg(F.abs(d) / F.greatest(o, F.lit(1e-15))).alias("mean_rel_diff"),
        F.sqrt(F.sum(d * d) / (2 * F.count(measured))).alias("s_intra"),
        F.avg(d).alias("bias"),
        F.stddev_samp(d).alias("sd_diff"),
    )
    enough = F.col("n_pairs") >= 2
    stats = {k: F.when(enough, F.col(k)) for k in ("mean_value", "mean_abs_diff", "mean_rel_diff", "s_intra", "bias", "sd_diff")}
    limits = F.col("n_pairs") >= 5
    return out.withColumns(stats).withColumns({
        "status": F.when(enough, "SUFFICIENT").otherwise("N_INSUFFICIENT"),
        "cv": F.when(enough, F.when(F.col("mean_value") > 0, F.col("s_intra") / F.col("mean_value")).otherwise(0.0)),
        "bland_altman_lower": F.when(limits, F.col("bias") - 1.96 * F.col("sd_diff")),
        "bland_altman_upper": F.when(limits, F.col("bias") + 1.96 * F.col("sd_diff")),
    })


def blind_session(df: DataFrame, ident: str, value: str, seed: int) -> DataFrame:
    """Rows with a value in a seeded order, numbered GRP_001 ... without showing the value's rank."""
    rows = df.where(F.col(value).isNotNull()).withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(ident))))
    rows = rows.withColumn("__b", F.substring("_h", 1, 4))
    out = ordered(rows, [], ["_h", ident, value], number="_n")
    return out.select(
        F.format_string("GRP_%03d", F.col("_n")).alias("reference_group_id"), F.col(ident).alias("record_id"),
        F.col(value).alias("original_value"), F.lit(1).alias("round_number"), F.lit(f"STUDY_{seed:06d}").alias("study_id"),
    )


def classify_by_ranges(medians: DataFrame, x: str, ranges: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Index of the first range (both ends inclusive) that holds the value; null when none does."""
    hit = None
    for i, (_, lo, hi) in enumerate(ranges):
        test = F.col(x).between(lo, hi)
        hit = F.when(test, i) if hit is None else hit.when(test, i)
    return medians.withColumn("group", hit)


def baseline_rows(df: DataFrame, keys: Sequence[str], method: str, x: str, main: dict[str, str], baseline: str) -> DataFrame:
    """n, mean, median, main value and difference from the baseline method's main value.

    ``main`` says per method whether its main value is the mean or the median.
    """
    keys = list(keys)
    from filamet.operators.distributions import mean_and_median

    rows = mean_and_median(df, [*keys, method], x)
    value = None
    for m, kind in main.items():
        value = F.when(F.col(method) == m, F.col(kind)) if value is None else value.when(F.col(method) == m, F.col(kind))
    rows = rows.withColumn("main_value", value)
    base = rows.where(F.col(method) == baseline).select(*keys, F.col("main_value").alias("_base"))
    diff = F.col("main_value") - F.col("_base")
    return rows.join(base, keys, "left").select(
        *keys, method, "n", "mean", "median", "main_value", diff.alias("difference"),
        F.when(F.col("_base") != 0, 100 * diff / F.col("_base")).alias("relative_percent"),
    )
