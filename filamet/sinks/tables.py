"""Export tables and writers."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filamet import schemas as S
from filamet.functions.records import cell_position, clean_number, primary_unit, primary_value
from filamet.operators.distributions import SUMMARY_NAMES, SUMMARY_PROBS, common_edges, present, weighted_histogram
from filamet.operators.groups import sd_or_zero
from filamet.operators.quantiles import exact_quantiles
from filamet.session import checkpoint_root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def measurement_table(records: DataFrame, project_path: Column) -> DataFrame:
    """The 24 export columns; missing values stay null, which CSV writes as empty."""
    c = F.col
    v = c("values")
    return records.select(
        "measurement_id", "name", "kind", "status", "source",
        F.coalesce(F.when(c("image_id") != "", c("image_id")), project_path).alias("image_id"), "sample_id", "fiber_id", "roi_id",
        primary_value(c("kind"), v).alias("primary_value"), primary_unit(c("kind")).alias("primary_unit"),
        F.array_join("tags", ", ").alias("tags"), "notes", F.array_join("quality_flags", ";").alias("quality_flags"), "created_at", "updated_at",
        v["length_m"].alias("length_m"), F.when(c("kind") == "PROJECTED_WIDTH", v["width_m"]).alias("projected_width_m"),
        v["interior_angle_deg"].alias("angle_deg"), v["area_m2"].alias("area_m2"), v["perimeter_m"].alias("perimeter_m"), v["tortuosity"].alias("tortuosity"),
        F.coalesce(F.when(v["mean_intensity_au"] != 0, v["mean_intensity_au"]), v["mean_intensity"]).alias("mean_intensity"), v["std_intensity_au"].alias("std_intensity"),
    ).select(*S.MEASUREMENT_CSV)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def profile_table(records: DataFrame, keys: Sequence[str], raw: str, smoothed: str, distance: str) -> DataFrame:
    """One row per profile sample; distance falls back to the index, smoothed to raw."""
    rows = records.select(*keys, smoothed, distance, F.posexplode(raw).alias("ord", "raw_intensity"))
    at = F.col("ord") + 1
    return rows.select(
        *keys, "ord", F.coalesce(F.try_element_at(distance, at), F.col("ord").cast("double")).alias("distance_m"), "raw_intensity",
        F.col("raw_intensity").alias("averaged_intensity"), F.coalesce(F.try_element_at(smoothed, at), F.col("raw_intensity")).alias("smoothed_intensity"),
    )


def dataset_summary(statuses: DataFrame, summary: DataFrame, estimators: DataFrame) -> DataFrame:
    """image x method x estimator rows: N, mean, median, IQR, P05, P95; SD and coverage stay null.

    ``statuses``: image_id, method, status; ``estimators``: method, estimator (the fan-out);
    ``summary``: weighted summaries per image_id, method, estimator.
    """
    grid = statuses.join(estimators, "method")
    none = F.lit(None).cast("double")
    return grid.join(summary, ["image_id", "method", "estimator"], "left").select(
        F.col("image_id").alias("image"), "method", "estimator", F.coalesce("n", F.lit(0)).alias("N"), none.alias("coverage"), clean_number(F.col("mean")).alias("mean"),
        clean_number(F.col("p50")).alias("median"), none.alias("std"), clean_number(F.col("p75") - F.col("p25")).alias("IQR"), clean_number(F.col("p05")).alias("P05"), clean_number(F.col("p95")).alias("P95"), "status",
    )


# --- fixed values: diameter columns of the tidy export and their labels ---------------------
FIELD_ESTIMATORS = [
    ("diameter_um", "Raw EDT"), ("edge_diameter_um", "Raw Edge"), ("profile_diameter_um", "Raw Profile"),
    ("refined_edt_um", "Refined EDT"), ("refined_edge_um", "Refined Edge"), ("refined_profile_um", "Refined Profile"),
]


def tidy_measurements(field: DataFrame, others: DataFrame, *, method: str = "Field", refined_method: str = "Ribbon") -> DataFrame:
    """Long table of samples: six diameter columns unpivoted, other methods appended as accepted."""
    c = F.col
    slots = F.array(*[F.struct(F.lit(label).alias("estimator"), F.lit(name.startswith("refined_")).alias("is_refined"), c(name).cast("double").alias("diameter")) for name, label in FIELD_ESTIMATORS])
    rows = field.withColumn("_e", F.explode(slots)).where(c("_e.diameter").isNotNull() & ~F.isnan("_e.diameter") & (F.abs("_e.diameter") != F.lit(float("inf"))))
    ref = c("_e.is_refined")
    long = rows.select(
        "image_id", F.when(ref, refined_method).otherwise(method).alias("method"), c("_e.estimator").alias("estimator"), "sample_id",
        clean_number(c("x_m") * 1e6).alias("x_um"), clean_number(c("y_m") * 1e6).alias("y_um"), clean_number(c("_e.diameter")).alias("diameter_um"), clean_number(c("arc_length_weight_m")).alias("weight_m"),
        F.when(ref, c("refined_edge_accepted")).otherwise(c("edge_accepted")).alias("accepted"), clean_number(c("refine_confidence")).alias("confidence"),
        F.when(ref, c("refined_edge_flags")).otherwise(c("edge_flags")).alias("flags"), F.when(c("refined_mask"), "refined").otherwise("not_refined").alias("refinement_status"),
        F.when(c("segment_id") >= 0, c("segment_id")).alias("segment_id"),
    )
    rest = others.select("image_id", "method", "estimator", "sample_id", clean_number(c("value")).alias("diameter_um"), clean_number(c("weight")).alias("weight_m"), F.lit(True).alias("accepted"))
    return long.unionByName(rest, allowMissingColumns=True)


def manual_grid_table(cells: DataFrame, images: DataFrame) -> DataFrame:
    """25 rows per reviewed image, rows and columns from 1."""
    return images.join(cells, "case_id").select(
        "case_id", "image", (F.col("row") + 1).alias("row"), (F.col("column") + 1).alias("column"), cell_position(F.col("row"), F.col("column")).alias("position"),
        "status", clean_number(F.col("diameter")).alias("diameter_um"), "notes", "timestamp",
    )


def method_documents(results: DataFrame, image: str, method: str, fields: Sequence[str]) -> DataFrame:
    """One row per image with a map method -> result (an image has a handful of methods)."""
    return results.groupBy(image).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(method).alias("key"), F.struct(*fields).alias("value"))))).alias("methods"))


def provenance_rows(images: DataFrame, dataset_id: str, version: str, schema_version: str) -> DataFrame:
    """Version columns on one row per image, so the record scales with the dataset."""
    return images.select(F.lit(dataset_id).alias("dataset_id"), F.lit(version).alias("version"), F.lit(schema_version).alias("cache_schema"), "case_id", "filename", "sha256", "resolution_class")


def store_results(results: DataFrame, path: str, *, partition: str = "image_id") -> str:
    """Replace the stored partitions of the images in ``results`` and leave all others alone."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return path


def flat_metrics(frames: Sequence[DataFrame], nested: str) -> DataFrame:
    """Union of metric tables with the ``nested`` struct spread to ``nested_*`` columns."""
    flat = []
    for f in frames:
        inner = f.schema[nested].dataType.names if nested in f.columns else []
        keep = [k for k in f.columns if k != nested]
        flat.append(f.select(*keep, *[F.col(f"{nested}.{k}").alias(f"{nested}_{k}") for k in inner]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), flat)


def result_payload(summary: DataFrame, status: DataFrame, image: str, method: str) -> DataFrame:
    """Per image and method a struct with status, flags and the weighted summary."""
    dist = F.struct("n", "weight_sum", "mean", F.col("p50").alias("median"), *SUMMARY_NAMES)
    return status.join(summary, [image, method], "left").select(image, method, "status", "quality_flags", F.when(F.col("n").isNotNull(), dist).alias("common_distribution"))


def campaign_block(samples: DataFrame, keys: Sequence[str], x: str, order: Sequence[str], bins: int = 32) -> DataFrame:
    """The campaign form of a payload: unweighted figures, the histogram as arrays and the values' fingerprint.

    One struct per group: n, mean, median, std (of a sample; 0 for one value), five quantiles, counts and
    edges of ``bins`` equal bins, and the fingerprint of the values in ``order``.
    """
    keys = list(keys)
    rows = present(samples, x)
    base = rows.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), sd_or_zero(x).alias("std"))
    q = exact_quantiles(rows, keys, x, SUMMARY_PROBS, names=SUMMARY_NAMES)
    bars = weighted_histogram(rows.withColumn("_one", F.lit(1.0)), keys, [], x, "_one", common_edges(rows, keys, x, bins))
    # a histogram has ``bins`` bars
    hist = bars.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", F.col("n").alias("k"), "left_edge", "right_edge"))).alias("_h"))
    prints = fingerprint(rows.withColumns({"row": F.xxhash64(*order), "col": F.lit(0)}), keys, x).select(*keys, "fingerprint")
    out = base.join(q, keys).join(hist, keys).join(prints, keys)
    edges = F.concat(F.transform("_h", lambda b: b["left_edge"]), F.array(F.element_at("_h", -1)["right_edge"]))
    block = F.struct("n", "mean", F.col("p50").alias("median"), "std", F.array(*SUMMARY_NAMES).alias("quantiles"), F.transform("_h", lambda b: b["k"]).alias("hist_values"), edges.alias("hist_edges"), "fingerprint")
    return out.select(*keys, block.alias("campaign"))


def fingerprint(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Min, max, mean, non-zero count and an order-free content hash of each array.

    The hash combines two order-free folds of position-and-value hashes, so no array is
    collected in one place.  Equality holds within this engine only.
    """
    h = F.xxhash64("row", "col", value)
    return df.groupBy(*keys).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.count_if(F.col(value) != 0).alias("foreground"), F.count(F.lit(1)).alias("n"),
        F.sha2(F.concat_ws("|", F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))), 256).alias("fingerprint"),
    )
