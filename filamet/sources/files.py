"""File inventory, manifests, inventory table and metadata maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filamet import schemas as S
from filamet.operators.ordered import order_bucket, ordered
from filamet.session import stored

MANIFEST_SCHEMA = "dataset_id string, cases array<struct<case_id:string,filename:string,absolute_path:string,sha256:string,resolution_class:string>>"


def scan_files(spark: SparkSession, path: str, pattern: str = "*.{tif,tiff,TIF,TIFF}") -> DataFrame:
    """Files of a directory with size and content hash; the content itself is not kept."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return raw.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), "path", F.col("length").alias("file_size_bytes"), F.sha2("content", 256).alias("sha256")
    )


def number_cases(files: DataFrame, *, name: str = "filename", fmt: str = "ZEISS_%03d") -> DataFrame:
    """Case ids by sorted filename.  Only names and hashes are ordered, never file contents."""
    cols = [c for c in files.columns if c != name]
    # ordering reads its rows several times; contents are read and hashed once
    files = stored(files, "files")
    numbered = ordered(order_bucket(files, [], [name, *cols]), [], [name, *cols], number="case_ord")
    return numbered.withColumn("case_id", F.format_string(fmt, "case_ord"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    m = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)
    return m.select("dataset_id", F.posexplode("cases").alias("case_pos", "_c")).select("dataset_id", (F.col("case_pos") + 1).alias("case_ord"), "_c.*")


def manifest_first(manifest: DataFrame | None, files: DataFrame, dataset_dir: str, *, name: str = "filename") -> DataFrame:
    """Manifest cases whose file is present; the plain inventory when none is left."""
    if manifest is not None:
        present = manifest.join(files.select(F.col(name).alias("filename")).distinct(), "filename", "left_semi")
        if not present.isEmpty():
            return present.withColumn("case_id", F.coalesce("case_id", F.format_string("ZEISS_%03d", "case_ord"))).select("dataset_id", "case_id", "filename", "sha256", "resolution_class")
    n = number_cases(files, name=name)
    return n.select(F.lit(f"DATASET_{dataset_dir}").alias("dataset_id"), "case_id", F.col(name).alias("filename"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("resolution_class"))


def inventory_table(images: DataFrame, metadata: str = "metadata") -> DataFrame:
    """The 21-column inventory; missing metadata becomes an empty string."""

    def meta(key: str) -> Column:
        return F.coalesce(F.try_element_at(metadata, F.lit(key)), F.lit(""))

    out = images.withColumns({
        "footer_start_row": F.coalesce("footer_y0", "height_px"), "footer_height_px": F.coalesce(F.col("footer_y1") - F.col("footer_y0"), F.lit(0)),
        "physical_unit": F.lit("m"), "magnification": meta("ap_mag"), "accelerating_voltage": meta("ap_actualkv"), "working_distance": meta("ap_wd"),
        "detector": meta("dp_detector_channel"), "reader_flags": F.when(F.col("footer_y0").isNull(), "FOOTER_NOT_DETECTED").otherwise(""),
        "zeiss_metadata_status": F.when(F.col("source_reader") == "zeiss_cz_sem_tiff", "PRESENT").otherwise("ABSENT"),
    })
    return out.select(*S.INVENTORY_FIELDS, (F.col("pixel_size_x") * 1e6).alias("conversion_um_per_px"))


#: fixed values: columns of the short inventory and the metadata they come from
SHORT_INVENTORY = {
    "magnification": "ap_mag", "field_width": "ap_width", "field_width_unit": "ap_width__unit", "field_height": "ap_height", "field_height_unit": "ap_height__unit",
    "eht_kv": "ap_actualkv", "wd_mm": "ap_wd", "detector": "dp_detector_channel", "date": "ap_date", "time": "ap_time",
}


def short_inventory(images: DataFrame, metadata: str = "metadata", *, expected: int | None = None) -> DataFrame:
    """The 17-column inventory by filename; what is missing is an empty string.

    ``images`` has filename, format_id, width_px, height_px, pixel_size_x (metres, null without
    calibration), a metadata map and the two cross-check columns.  ``expected`` rows are required if given.
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    meta = [text(F.try_element_at(metadata, F.lit(key))).alias(name) for name, key in SHORT_INVENTORY.items()]
    checks = [text(F.col(k)).alias(k) for k in ("width_crosscheck_relative", "height_crosscheck_relative")]
    out = images.select("filename", text(F.col("format_id")).alias("format_id"), "width_px", "height_px", text(F.col("pixel_size_x") * 1e9).alias("pixel_size_nm"), *meta, *checks)
    return out if expected is None else require_count(out, expected, "inventory")


def require_count(df: DataFrame, expected: int, name: str) -> DataFrame:
    """Fail with the row count when a dataset does not have the expected number of rows."""
    n = df.count()
    if n != expected:
        raise ValueError(f"expected exactly {expected} rows of {name}, found {n}")
    return df


def flatten_metadata(tags: Column) -> Column:
    """``map<key, struct<label, value, unit>>`` to flat keys ``key``, ``key__unit``, ``key__label``."""

    def flat(e: Column) -> Column:
        k, v = e["key"], e["value"]
        return F.array_compact(F.array(
            F.struct(k.alias("key"), v["value"].alias("value")),
            F.when(F.coalesce(v["unit"], F.lit("")) != "", F.struct(F.concat(k, F.lit("__unit")).alias("key"), v["unit"].alias("value"))),
            F.when(F.coalesce(v["label"], F.lit("")) != "", F.struct(F.concat(k, F.lit("__label")).alias("key"), v["label"].alias("value"))),
        ))

    named = F.filter(F.map_entries(tags), lambda e: e["key"] != "")
    return F.map_from_entries(F.flatten(F.transform(named, flat)))
