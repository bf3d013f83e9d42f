"""Fixed values, table schemas and small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values: enumerations of the measurement data model -------------------------------
KINDS = [
    "PROJECTED_WIDTH", "DISTANCE", "POLYLINE_LENGTH", "ANGLE",
    "RECTANGLE_AREA", "POLYGON_AREA", "INTENSITY_PROFILE", "DIAMETER_DISTRIBUTION",
]
STATUSES = ["PROPOSED", "ACCEPTED", "MANUALLY_EDITED", "REJECTED", "AMBIGUOUS", "NOT_MEASURABLE"]
INCLUDED_STATUSES = ["ACCEPTED", "MANUALLY_EDITED"]
COMPARABLE_STATUSES = ["COMPLETE", "EXPERIMENTAL_FIELD_MEASURING"]
COMMON_ESTIMAND = "COMMON_LENGTH_WEIGHTED_DIAMETER"
METHOD_STATUSES = [
    "COMPLETE", "NOT_RUN", "UNAVAILABLE", "NOT_MEASURED",
    "EXPERIMENTAL_NOT_YET_MEASURING", "EXPERIMENTAL_FIELD_MEASURING", "FAILED",
]
CELL_STATUSES = ["NOT_REVIEWED", "MEASURED", "NO_VALID_FIBER", "SKIPPED_WITH_REASON"]

# --- fixed values: flags ---------------------------------------------------------------------
ABSTAIN_EDGE_FLAGS = [
    "POSSIBLE_CROSSING", "AMBIGUOUS_LOCAL_WIDTH", "MISSING_POSITIVE_EDGE", "MISSING_NEGATIVE_EDGE",
]
ABSTAIN_PROFILE_FLAGS = [
    "PROFILE_AMBIGUOUS_EDGE", "PROFILE_EDGE_MINUS_NOT_FOUND",
    "PROFILE_EDGE_PLUS_NOT_FOUND", "PROFILE_NONPOSITIVE_WIDTH",
]
LOW_COHERENCE_FLAG = "LOW_ORIENTATION_COHERENCE"
CRITICAL_FLAGS = ["TOO_SMALL", "PROFILE_FAILED", "LOW_ELONGATION", "LIKELY_MERGED"]
PENALTY_FLAGS = ["TOUCHES_ROI_EDGE", "TOUCHES_INVALID_MASK", "WIDTH_TOO_VARIABLE", "WIDTH_ESTIMATORS_DISAGREE"]
DISQUALIFYING_FLAGS = [
    "TOUCHES_ROI_EDGE", "TOUCHES_INVALID_MASK", "TOO_SMALL", "LOW_ELONGATION", "LIKELY_MERGED",
    "WIDTH_TOO_VARIABLE", "WIDTH_ESTIMATORS_DISAGREE", "PROFILE_FAILED",
    "RESOLUTION_MARGINAL", "RESOLUTION_INSUFFICIENT", "CURVED_TRACE_UNSTABLE",
]

# --- fixed values: order of processing stages ------------------------------------------------
STAGE_ORDER = [
    "INPUT", "CROP", "CLAHE", "HISTEQ", "EROSION", "RECONSTRUCTION", "CANNY", "AREA_FILTER",
    "EDGE_THICKEN", "OTSU", "THRESHOLD", "CLOSING", "CLEAN", "FILL", "MAJORITY", "THIN",
    "MEDIAN_LOOP", "THICKEN", "SKELETON", "BRANCHPOINTS", "BRANCH_GUARD", "SPUR",
    "EDGE_DISTANCE_FILTER", "EDT", "DIAMETERS", "HISTOGRAM", "GAUSSIAN_FIT",
]

# --- fixed values: unit factors to metres ----------------------------------------------------
LENGTH_UNITS = {"m": 1.0, "mm": 1e-3, "µm": 1e-6, "um": 1e-6, "nm": 1e-9, "pm": 1e-12}

# --- fixed values: resolution presets --------------------------------------------------------
# name, nm/px from, nm/px to (inclusive), expected width px, min area px, min elongation,
# min width px, sections
RESOLUTION_PRESETS = [
    ("HIGH_MAG_FINE", 0.0, 10.0, 30.0, 80, 2.5, 5.0, 5),
    ("MID_MAG_GENERAL", 10.0, 80.0, 12.0, 40, 2.2, 3.0, 3),
    ("LOW_MAG_NETWORK", 80.0, 1e9, 3.0, 20, 2.0, 1.5, 3),
]
PRESET_SCHEMA = (
    "preset string, nm_from double, nm_to double, expected_width_px double, min_area_px int, "
    "min_elongation double, min_width_px double, sections int"
)

# --- fixed values: protocol presets ----------------------------------------------------------
# id, kind, sections per fiber, min fibers per image, exclude crossings, edges, invalid mask,
# min resolved width px
PROTOCOLS = [
    ("PVDF_3_SECTIONS", "PROJECTED_WIDTH", 3, 10, True, True, True, 2.5),
    ("PVDF_5_SECTIONS", "PROJECTED_WIDTH", 5, 10, True, True, True, 2.5),
    ("GENERAL_MICROSCOPY", "DISTANCE", 0, 0, False, False, True, 1.0),
    ("BLIND_REPEATABILITY", "PROJECTED_WIDTH", 3, 5, True, True, True, 2.5),
    ("SIMPOLY_MANUAL_5X5", "PROJECTED_WIDTH", 1, 10, True, True, True, 2.5),
    ("MANUAL_5X5_REFERENCE", "PROJECTED_WIDTH", 1, 0, True, True, True, 2.5),
]
PROTOCOL_SCHEMA = (
    "protocol_id string, measurement_kind string, sections_per_fiber int, minimum_fibers_per_image int, "
    "exclude_crossings boolean, exclude_image_edges boolean, exclude_invalid_mask boolean, "
    "minimum_resolved_width_px double"
)

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

RECORD = (
    "struct<measurement_id:string,kind:string,name:string,tags:array<string>,notes:string,note:string,"
    "status:string,accepted:boolean,source:string,method:string,image_id:string,sample_id:string,"
    "fiber_id:string,roi_id:string,`group`:int,defect:string,"
    "geometry:struct<p1:array<double>,p2:array<double>,pt_a:array<double>,pt_b:array<double>,"
    "pt_c:array<double>,points:array<array<double>>,bbox:array<int>>,"
    "values:struct<length_m:double,width_m:double,total_length_m:double,tortuosity:double,"
    "interior_angle_deg:double,area_m2:double,perimeter_m:double,mean_intensity_au:double,"
    "mean_intensity:double,std_intensity_au:double,main_reported_value_m:double>,"
    "p1:array<double>,p2:array<double>,width_m:double,quality_flags:array<string>,confidence:double,"
    "created_at:string,updated_at:string>"
)
PROJECT_SCHEMA = (
    "schema_version int, image struct<path:string,image_id:string,source_sha256:string,"
    "calibration:struct<pixel_size_x_m:double,pixel_size_y_m:double,source:string,confidence:double>>, "
    f"records array<{RECORD}>, measurements array<{RECORD}>, "
    "next_record_counter int, next_fiber_counter int, target_sections int, active_fiber_id string, "
    "active_protocol_id string, sample_id string, sample_name string"
)
SESSION_SCHEMA = (
    "study_id string, operator_id string, random_seed int, is_completed boolean, items array<struct<"
    "reference_group_id:string,record_id:string,original_value_m:double,round_number:int,"
    "measured_value_m:double,timestamp:string>>"
)
ORACLE_RUN_SCHEMA = (
    "run_id string, oracle_id string, image_id string, input_sha256 string, local_diameters_px array<double>, "
    "gaussian_center_px double, arithmetic_mean_px double, median_px double, std_px double, status string"
)
DISTRIBUTION = "struct<unit:string,estimand:string,n:bigint,weight_sum:double,mean:double,median:double,p05:double,p25:double,p50:double,p75:double,p95:double>"
PAYLOAD_SCHEMA = (
    "image_id string, results array<struct<method_id:string,method_version:string,status:string,native_result:double,"
    f"native_statistics:map<string,double>,quality_flags:array<string>,common_distribution:{DISTRIBUTION},"
    f"secondary_distributions:map<string,{DISTRIBUTION}>>>, "
    "agreements array<struct<left_method:string,right_method:string,wasserstein_1:double,median_difference:double>>, _corrupt string"
)
CELL = "struct<row:int,column:int,status:string,diameter:double,unit:string,operator:string,notes:string,timestamp:string>"
REVIEW_STORE_SCHEMA = f"dataset_id string, reviews map<string,struct<case_id:string,protocol_id:string,cells:array<{CELL}>>>, status map<string,string>"

# --- fixed values: column order of the measurement CSV ----------------------------------------
MEASUREMENT_CSV = [
    "measurement_id", "name", "kind", "status", "source", "image_id", "sample_id", "fiber_id", "roi_id",
    "primary_value", "primary_unit", "tags", "notes", "quality_flags", "created_at", "updated_at", "length_m",
    "projected_width_m", "angle_deg", "area_m2", "perimeter_m", "tortuosity", "mean_intensity", "std_intensity",
]
# --- fixed values: columns of the dataset inventory -------------------------------------------
INVENTORY_FIELDS = [
    "case_id", "filename", "absolute_path", "sha256", "file_size_bytes", "width_px", "height_px", "channels", "dtype",
    "zeiss_metadata_status", "footer_start_row", "footer_height_px", "pixel_size_x", "pixel_size_y", "physical_unit",
    "magnification", "accelerating_voltage", "working_distance", "detector", "source_reader", "reader_flags",
]


def resolution_presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RESOLUTION_PRESETS, PRESET_SCHEMA)


def protocols(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROTOCOLS, PROTOCOL_SCHEMA)
