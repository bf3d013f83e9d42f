"""Report tables built from summaries and method results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filamet import schemas as S
from filamet.operators.groups import attach_row
from filamet.operators.distributions import pair_distances
from filamet.operators.quantiles import exact_quantiles, multi_quantiles, weighted_quantiles
from filamet.session import cut_lineage


def estimator_table(summary: DataFrame, image: str, series: str, labels: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per image and listed estimator; a missing estimator keeps a blank row.

    ``coverage`` is the estimator's share of ``total``, the samples that an image offers, if the summary has it.
    """
    slots = F.array(*[F.struct(F.lit(k).alias(series), F.lit(v).alias("label")) for k, v in labels])
    grid = summary.select(image).distinct().withColumn("_s", F.explode(slots)).select(image, "_s.*")
    return grid.join(summary, [image, series], "left").select(
        image, "label", F.coalesce("n", F.lit(0)).alias("n"), "mean", F.col("p50").alias("median"),
        (F.col("p75") - F.col("p25")).alias("iqr"), "p05", "p95",
        F.when(F.col("n").isNull(), "NOT_RUN").otherwise("COMPLETE").alias("status"),
        (F.col("n") / F.col("total") if "total" in summary.columns else F.lit(None).cast("double")).alias("coverage"),
    )


def union_results(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Results of all methods in a fixed order."""
    out = None
    for i, (method, df) in enumerate(parts):
        part = df.withColumns({"method": F.lit(method), "method_ord": F.lit(i)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def exclusions(results: DataFrame) -> DataFrame:
    """Methods that cannot be compared, with the reason.

    Needs status, estimand and has_common; a method without a common distribution reports that,
    else its status.
    """
    ok = F.col("status").isin(S.COMPARABLE_STATUSES) & F.col("has_common") & (F.col("estimand") == S.COMMON_ESTIMAND)
    reason = F.when(~F.col("has_common"), "NO_COMMON_DISTRIBUTION").otherwise(F.concat(F.lit("STATUS_"), F.col("status")))
    return results.where(~F.coalesce(ok, F.lit(False))).withColumn("reason", reason)


def exclusion_maps(excluded: DataFrame, earlier: DataFrame, image: str) -> DataFrame:
    """Reason map per image; of two reasons for a method the later one wins."""
    rows = earlier.select(image, "method", "reason", F.lit(0).alias("_o")).unionByName(excluded.select(image, "method", "reason", F.lit(1).alias("_o")))
    last = rows.groupBy(image, "method").agg(F.max_by("reason", "_o").alias("reason"))
    # an image has a handful of methods
    return last.groupBy(image).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("method", "reason")))).alias("excluded"))


def status_matrix(results: DataFrame, images: DataFrame, image: str, methods: Sequence[str]) -> DataFrame:
    """image x method statuses; a missing result reads NOT_RUN."""
    wide = results.groupBy(image).pivot("method", list(methods)).agg(F.first("status"))
    return images.select(image).distinct().join(wide, image, "left").fillna("NOT_RUN", list(methods))


def median_matrix(medians: DataFrame, images: DataFrame, image: str, methods: Sequence[str], value: str = "median") -> DataFrame:
    """image x method medians; null where a method has none."""
    wide = medians.groupBy(image).pivot("method", list(methods)).agg(F.first(value))
    return images.select(image).distinct().join(wide, image, "left")


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("method", "status").agg(F.count(F.lit(1)).alias("n"))


def method_summary(samples: DataFrame, image: str, series: str, x: str, coverage: DataFrame | None = None) -> DataFrame:
    """Across images: medians of the per-image unweighted medians, their mean, SD and IQR.

    The image is the unit here; samples are never pooled.
    """
    med = cut_lineage(exact_quantiles(samples, [image, series], x, [0.5], names=["m"]))
    base = med.groupBy(series).agg(F.count(F.lit(1)).alias("images"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"))
    q = exact_quantiles(med, [series], "m", [0.25, 0.5, 0.75], names=["p25", "median", "p75"])
    out = base.join(q, series).withColumn("iqr", F.col("p75") - F.col("p25"))
    if coverage is not None:
        out = out.join(exact_quantiles(coverage, [series], "coverage", [0.5], names=["median_coverage"]), series, "left")
    return out


def agreement_rollup(agreements: DataFrame) -> DataFrame:
    """Per method pair over all images: median W1, median of median differences, counts."""
    q = multi_quantiles(agreements, ["left", "right"], {
        ("w1", 0.5): ("median_w1", F.col("wasserstein_1")), ("md", 0.5): ("median_difference", F.col("median_difference"))})
    n = agreements.groupBy("left", "right").agg(F.count("wasserstein_1").alias("n_w1"), F.count("median_difference").alias("n_difference"))
    return n.join(q, ["left", "right"]).orderBy("left", "right")


def processed_images(results: DataFrame, image: str) -> DataFrame:
    """Images with at least one method that ran, out of all."""
    per = results.groupBy(image).agg(F.bool_or(~F.col("status").isin("NOT_RUN", "FAILED")).alias("_p"))
    return per.agg(F.count_if("_p").alias("processed"), F.count(F.lit(1)).alias("images"))


def median_across_images(stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the median of each per-image figure over the images that have it, and the number of images."""
    q = multi_quantiles(stats, [], {(c, 0.5): (c, F.col(c)) for c in columns})
    return attach_row(stats.agg(F.count(F.lit(1)).alias("images")), q)


def quality_table(stats: DataFrame, flags: str) -> DataFrame:
    return stats.withColumn("notable_flags", F.coalesce(F.nullif(F.array_join(F.slice(flags, 1, 2), ", "), F.lit("")), F.lit("—")))


def refinement_pairs(summary: DataFrame, image: str, estimator: str) -> DataFrame:
    """Raw estimators next to their refined variant (``REFINED_`` in the name), if there is one."""
    raw = summary.where(~F.contains(F.col(estimator), F.lit("REFINED_")))
    ref = summary.where(F.contains(F.col(estimator), F.lit("REFINED_"))).select(
        image, F.replace(F.col(estimator), F.lit("REFINED_"), F.lit("")).alias(estimator), *[F.col(k).alias(f"refined_{k}") for k in ("n", "p50", "p05", "p95")]
    )
    return raw.join(ref, [image, estimator], "left").withColumn("median_change", F.col("refined_p50") - F.col("p50"))


def secondary_pairs(distances: DataFrame, medians: DataFrame, image: str) -> DataFrame:
    """W1 and median difference of each secondary estimator against the others."""
    l = medians.select(image, F.col("method").alias("left"), F.col("median").alias("_l"))
    r = medians.select(image, F.col("method").alias("right"), F.col("median").alias("_r"))
    return distances.join(l, [image, "left"]).join(r, [image, "right"]).withColumn("median_difference", F.col("_l") - F.col("_r")).drop("_l", "_r")


def report_pairs(
    samples: DataFrame, keys: Sequence[str], series: str, x: str, w: str, *, primary: Sequence[tuple[str, str]], internal: Sequence[tuple[str, str]] = (), refinement: Sequence[tuple[str, str]] = (), tie: Sequence[str] = (),
) -> DataFrame:
    """The fixed pairs of the agreement section: ``section``, ``left``, ``right``, ``w1``, ``ks``, ``median_difference``.

    Pairs of methods are weighted; pairs inside one method, raw and refined, are unweighted and have no
    median difference.  A pair with an empty side has no row.
    """
    keys = list(keys)
    sections = [("primary", p) for p in primary] + [("internal", p) for p in internal] + [("refinement", p) for p in refinement]
    names = sorted({n for _, p in sections for n in p})
    rows = samples.where(F.col(series).isin(names))
    d = pair_distances(rows, keys, series, names, x, w, pairs=[p for _, p in sections])
    section = F.coalesce(*[F.when((F.col("left") == a) & (F.col("right") == b), s) for s, (a, b) in sections])
    medians = weighted_quantiles(rows, [*keys, series], x, w, [0.5], tie=tie, names=["_m"], count_first=True)
    sides = [medians.select(*keys, F.col(series).alias(k), F.col("_m").alias(f"_{k}")) for k in ("left", "right")]
    out = d.withColumn("section", section).join(sides[0], [*keys, "left"]).join(sides[1], [*keys, "right"])
    main = F.col("section") == "primary"
    return out.where(F.col("ks").isNotNull()).select(
        *keys, "section", "left", "right", F.when(main, F.col("w1")).otherwise(F.col("w1_unweighted")).alias("w1"), "ks", F.when(main, F.col("_left") - F.col("_right")).alias("median_difference"))


def candidate_rollup(candidates: DataFrame, keys: Sequence[str], flags: str, level: Column) -> DataFrame:
    """Excluded, measurable, high-confidence and to-review candidates per image."""
    bad = F.arrays_overlap(flags, F.array(*[F.lit(f) for f in S.CRITICAL_FLAGS]))
    return candidates.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("components"), F.count_if(bad).alias("excluded"), F.count_if(~bad).alias("measurable"),
        F.count_if(~bad & (level == "Alta")).alias("high_confidence"), F.count_if(~bad & (level != "Alta")).alias("needs_review"),
    )


def exclusion_reasons(candidates: DataFrame, keys: Sequence[str], flags: str) -> DataFrame:
    crit = F.array_distinct(F.array_intersect(F.col(flags), F.array(*[F.lit(f) for f in S.CRITICAL_FLAGS])))
    return candidates.select(*keys, F.explode(crit).alias("reason")).groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))


def review_progress(cells: DataFrame, case: str, *, target: int = 400) -> tuple[DataFrame, DataFrame]:
    """Measured and completed cells per case, and the total with its verdict."""
    per = cells.groupBy(case).agg(F.count_if(F.col("status") == "MEASURED").alias("measured"), F.count_if(F.col("status") != "NOT_REVIEWED").alias("completed"))
    total = per.agg(F.sum("measured").alias("measured"), F.count_if(F.col("completed") > 0).alias("reviewed_images"))
    return per, total.withColumn("reference", F.when(F.col("measured") >= target, "COMPLETE").otherwise("INCOMPLETE"))


def series_medians(values: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    return exact_quantiles(values, keys, x, [0.5], names=["median"])


