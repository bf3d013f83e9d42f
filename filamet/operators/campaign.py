"""Campaign tables: verification, resume, parity assembly, review queue, proposals, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filamet.operators.groups import agg, attach_row, join_groups
from filamet.operators.ordered import order_bucket, ordered


def candidate_vs_manual(candidates: DataFrame, manual: DataFrame, keys: Sequence[str], cand: str, man: str) -> DataFrame:
    """Differences of width and, where ``cx cy`` (candidate) and ``mx my`` (manual) are given, of centres.

    A candidate without a width counts as 0, one without a centre as the origin.
    """
    d = F.abs(F.coalesce(F.col(cand), F.lit(0.0)) - F.col(man))
    j = candidates.join(manual, list(keys)).withColumns({"abs_diff": d, "rel_diff_pct": d / F.greatest(F.col(man), F.lit(1e-12)) * 100})
    if not {"cx", "cy", "mx", "my"} <= set(j.columns):
        return j
    at = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return j.withColumn("center_dist_px", F.hypot(at("cx") - F.col("mx"), at("cy") - F.col("my")))


def verify_sources(registered: DataFrame, inventory: DataFrame, key: str) -> DataFrame:
    """Compare registered hashes (``expected``) with an inventory (``actual``)."""
    j = registered.join(inventory.withColumn("_seen", F.lit(True)), key, "left")
    status = (
        F.when(F.col("_seen").isNull(), "MISSING")
        .when(F.coalesce(F.col("expected"), F.lit("")) == "", "UNVERIFIED")
        .when(F.col("expected") == F.col("actual"), "MATCH")
        .otherwise("MISMATCH")
    )
    return j.withColumn("verification", status).drop("_seen")


def cached_lookup(images: DataFrame, manifest: DataFrame, summaries: DataFrame, *, cache_exists: bool = True, manifest_exists: bool = True) -> DataFrame:
    """Look up cached results by content hash; every image keeps a row with a status and a flag.

    ``images``: sha256, custom_roi; ``manifest``: sha256, case_id; ``summaries``: case_id,
    native_result, has_samples.
    """
    j = images.join(manifest.dropDuplicates(["sha256"]), "sha256", "left").join(summaries.withColumn("_s", F.lit(True)), "case_id", "left")
    flag = (
        F.when(F.col("custom_roi"), "CACHE_ROI_NOT_AVAILABLE")
        .when(F.lit(not cache_exists), "CACHE_NOT_AVAILABLE")
        .when(F.lit(not manifest_exists), "CACHE_MANIFEST_MISSING")
        .when(F.col("case_id").isNull(), "CACHE_NO_MATCHING_IMAGE")
        .when(F.col("_s").isNull(), "CACHE_CASE_INCOMPLETE")
    )
    ok = F.col("cache_flag").isNull()
    return j.withColumn("cache_flag", flag).withColumns({
        "status": F.when(ok, "COMPLETE").otherwise("NOT_RUN"),
        "native_result": F.when(ok, F.col("native_result")),
        "quality_flags": F.when(~ok, F.array("cache_flag")).when(F.col("has_samples"), F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("RAW_DIAMETERS_UNAVAILABLE"), F.lit("COMMON_LENGTH_WEIGHT_UNAVAILABLE"))),
    }).drop("_s")


def pending(inputs: DataFrame, done: DataFrame, key: str, *, force: bool = False) -> DataFrame:
    """Inputs without an output yet; all of them when forced."""
    return inputs if force else inputs.join(done.select(key), key, "left_anti")


def select_cases(cases: DataFrame, *, wanted: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Cases by id or filename in manifest order; a limit of 0 or None keeps all."""
    out = cases
    if wanted:
        out = out.where(F.col("case_id").isin(list(wanted)) | F.col("filename").isin(list(wanted)))
    return out.orderBy("case_ord").limit(limit) if limit else out


def review_queue(cases: DataFrame, results: DataFrame, previous: DataFrame, grid: DataFrame, *, resolution_ok: str = "RESOLUTION_OK") -> DataFrame:
    """One review row per case with differences, reasons and priority; earlier review state stays.

    ``results``: case_id, oracle_center, estimate_center, section_median, resolution, flags;
    ``previous``: case_id, manual_status, review_notes, manual_count; ``grid``: case_id, measured.
    """
    j = cases.join(results, "case_id", "left").join(previous, "case_id", "left").join(grid, "case_id", "left")
    base = F.when(F.col("oracle_center") != 0, F.abs("oracle_center"))
    j = j.withColumns({
        "estimate_diff": 100 * F.abs(F.col("estimate_center") - F.col("oracle_center")) / base,
        "section_diff": 100 * F.abs(F.col("section_median") - F.col("oracle_center")) / base,
        "_fl": F.coalesce(F.col("flags"), F.array().cast("array<string>")),
        "_res": F.coalesce(F.col("resolution"), F.lit("NONE")),
    })
    e, s = F.col("estimate_diff"), F.col("section_diff")
    reasons = F.array_compact(F.array(
        F.when(e.isNull(), "ORACLE_ESTIMATE_RESULT_MISSING").when(e > 5, F.format_string("ORACLE_ESTIMATE_DIVERGENCE_%.1f%%", e)),
        F.when(s.isNull(), "SECTION_RESULT_MISSING").when(s > 30, F.format_string("SECTION_METHOD_DIFFERENCE_%.1f%%", s)),
        F.when(F.col("_res") != resolution_ok, F.col("_res")),
        F.when(F.size("_fl") > 0, "AUTOMATIC_QUALITY_FLAGS_PRESENT"),
    ))
    high = e.isNull() | (e > 5) | s.isNull() | (s > 30) | (F.col("_res") != resolution_ok) | (F.size("_fl") > 0)
    auto = F.when(F.size("_r") > 0, F.concat(F.lit("AUTO: "), F.array_join("_r", "; "))).otherwise("")
    return j.withColumn("_r", reasons).select(
        *cases.columns, "oracle_center", "estimate_center", "section_median", "estimate_diff", "section_diff",
        F.when(e.isNull(), "UNKNOWN").when(e <= 5, "CLOSE").otherwise("DIVERGENT").alias("agreement"),
        F.array_join(F.array_sort(F.array_distinct("_fl")), ";").alias("quality_flags"),
        F.when(high, "HIGH").when((e > 1) | (s > 15), "MEDIUM").otherwise("LOW").alias("priority"),
        F.coalesce("manual_status", F.lit("NOT_MEASURED")).alias("manual_status"),
        F.coalesce("measured", "manual_count", F.lit(0)).cast("long").alias("manual_count"),
        F.coalesce(F.when(F.col("review_notes") != "", F.col("review_notes")), auto).alias("review_notes"),
    )


def next_numbers(existing: DataFrame, ident: str, prefix: str, *, stored: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """One row, or one per ``keys``: the next free number, above the highest used suffix and the stored counter."""
    used = F.regexp_extract(F.col(ident), f"^{prefix}([0-9]+)$", 1)
    top = existing.groupBy(*keys).agg(F.max(F.when(used != "", used.cast("long"))).alias("_top"))
    return top.select(*keys, F.greatest(F.lit(stored).cast("long"), F.coalesce(F.col("_top"), F.lit(0)) + 1).alias("next"))


def assign_ids(new: DataFrame, first: DataFrame, order: Sequence[str], fmt: str, name: str) -> DataFrame:
    """Number new rows in ``order`` from the next free number on; ids are never reused."""
    numbered = ordered(order_bucket(new, [], order), [], list(order), number="_n")
    return attach_row(numbered, first).withColumn(name, F.format_string(fmt, F.col("next") + F.col("_n") - 1)).drop("_n", "next")


def insert_proposals(records: DataFrame, proposals: DataFrame, key: str) -> DataFrame:
    """Append proposals whose id is not present yet."""
    fresh = proposals.join(records.select(key), key, "left_anti")
    return records.unionByName(fresh, allowMissingColumns=True)


def calibration_audit(images: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """``px_m``/``py_m`` null means the image could not be read."""
    ok = F.col("px_m").isNotNull() & F.col("py_m").isNotNull()
    return images.join(results, key, "left").withColumns({
        "pixel_size_x_nm": F.col("px_m") * 1e9, "pixel_size_y_nm": F.col("py_m") * 1e9, "calibrated": ok,
        "isotropic": F.when(ok, F.abs(F.col("px_m") - F.col("py_m")) * 1e9 < 1e-6),
    })


def calibration_summary(audit: DataFrame, keys: Sequence[str]) -> DataFrame:
    s = agg(audit, keys, F.min("pixel_size_x_nm").alias("low_nm"), F.max("pixel_size_x_nm").alias("high_nm"), F.count_if("calibrated").alias("calibrated"), F.count(F.lit(1)).alias("images"))
    kind = F.when(F.col("calibrated") == 0, "unavailable").when(F.col("high_nm") - F.col("low_nm") < 1e-6, "single").otherwise("mixed")
    return s.withColumn("calibration", kind)


def first_divergence(stages: DataFrame, keys: Sequence[str], stage: str, order: str, matched: str, evidence: Sequence[str] = ()) -> DataFrame:
    """First stage in order that does not match, 'MATCHED' if none, with that stage's ``evidence`` columns."""
    bad = F.when(~F.col(matched), F.col(order))
    first = stages.groupBy(*keys).agg(F.min_by(F.struct(F.col(stage).alias("_s"), *evidence), bad).alias("_f"), F.count_if(~F.col(matched)).alias("divergent"))
    return first.select(*keys, F.coalesce("_f._s", F.lit("MATCHED")).alias("first_divergence"), "divergent", *[F.col(f"_f.{e}").alias(e) for e in evidence])


def all_stages(arrays: DataFrame, scalars: DataFrame, keys: Sequence[str], stage: str) -> DataFrame:
    """Hash parity of the array stages together with the two stages judged by numbers."""
    numbers = F.array(*[F.struct(F.lit(s).alias("s"), F.col(m).alias("m"), F.col(d).alias("d")) for s, m, d in (("OTSU", "otsu_matched", "threshold_delta"), ("GAUSSIAN_FIT", "fit_matched", "b1_delta"))])
    rows = scalars.withColumn("_n", F.explode(numbers)).select(*keys, F.col("_n.s").alias(stage), F.col("_n.m").alias("matched"), F.col("_n.d").alias("difference"))
    return arrays.unionByName(rows, allowMissingColumns=True)


def stage_parity(left: DataFrame, right: DataFrame, keys: Sequence[str], stage: str) -> DataFrame:
    """A stage matches when both sides have it and their hashes are equal."""
    on = [*keys, stage]
    both = left.select(*on, *[F.col(k).alias(f"left_{k}") for k in ("sha256", "foreground", "mean")]).join(
        right.select(*on, *[F.col(k).alias(f"right_{k}") for k in ("sha256", "foreground", "mean")]), on, "full_outer"
    )
    return both.withColumn("matched", F.coalesce(F.col("left_sha256") == F.col("right_sha256"), F.lit(False)))


def scalar_parity(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Threshold (within 1e-12), Gaussian centre and width (exact) and histogram arrays."""
    l = left.select(*keys, *[F.col(k).alias(f"l_{k}") for k in ("threshold", "b1", "c1", "counts", "edges")])
    r_ = right.select(*keys, *[F.col(k).alias(f"r_{k}") for k in ("threshold", "b1", "c1", "counts", "edges")])
    j = join_groups(l, r_, keys, "full_outer")

    def delta(k: str) -> Column:
        return F.abs(F.col(f"l_{k}") - F.col(f"r_{k}"))

    return j.select(
        *keys, delta("threshold").alias("threshold_delta"), F.coalesce(delta("threshold") <= 1e-12, F.lit(False)).alias("otsu_matched"),
        delta("b1").alias("b1_delta"), F.when(F.col("l_b1") != 0, 100 * delta("b1") / F.abs("l_b1")).alias("b1_percent"),
        F.coalesce((delta("b1") == 0) & (delta("c1") == 0), F.lit(False)).alias("fit_matched"),
        F.coalesce(F.col("l_counts") == F.col("r_counts"), F.lit(False)).alias("counts_equal"), F.coalesce(F.col("l_edges") == F.col("r_edges"), F.lit(False)).alias("edges_equal"),
    )


def assemble_cases(cases: DataFrame, divergence: DataFrame, details: DataFrame, results: DataFrame) -> DataFrame:
    """Manifest rows with both profiles; a complete detail run overrides the first divergence."""
    d = details.select("case_id", F.when(F.col("status") == "COMPLETE", F.col("first_divergence")).alias("_detail"))
    return (
        cases.join(divergence.withColumnRenamed("first_divergence", "_coarse"), "case_id", "left").join(d, "case_id", "left").join(results, "case_id", "left")
        .withColumn("first_divergence", F.coalesce("_detail", "_coarse")).drop("_detail", "_coarse")
    )


def top_differences(queue: DataFrame, difference: str, n: int = 5) -> DataFrame:
    """Largest differences, missing ones first, then by case."""
    return queue.orderBy(F.desc_nulls_first(difference), "case_id").limit(n)
