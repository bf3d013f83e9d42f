"""Result caches, campaign payloads, review stores, studies and oracle runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filamet import schemas as S


def current_results(results: DataFrame, schema_version: str) -> DataFrame:
    """Only the given cache schema counts; older caches read as missing."""
    return results.where(F.col("schema_version") == schema_version)


def read_results(spark: SparkSession, path: str, schema_version: str) -> DataFrame:
    return current_results(spark.read.parquet(path), schema_version)


def read_payload_text(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    return spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(path).select(F.input_file_name().alias("path"), "value")


def parse_payloads(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Parse payload texts; an unreadable one keeps its row with status FAILED."""
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    p = df.withColumn("_p", F.from_json(text, S.PAYLOAD_SCHEMA, opts))
    bad = F.col(text).isNull() | F.col("_p").isNull() | F.col("_p._corrupt").isNotNull()
    return p.select(*keep, F.when(bad, "FAILED").otherwise("READ").alias("read_status"), F.when(~bad, F.col("_p")).alias("payload"))


def payload_methods(payloads: DataFrame, methods: Sequence[str], *keep: str) -> DataFrame:
    """One row per payload and known method; entries with other method ids are skipped."""
    rows = payloads.select(*keep, F.explode("payload.results").alias("_r")).select(*keep, "_r.*")
    return rows.where(F.col("method_id").isin(list(methods)))


def parse_review_store(df: DataFrame, text: str, dataset_id: str, *keep: str) -> DataFrame:
    """Cells of every review; a store of another dataset is ignored; 25 cells are required."""
    p = df.select(*keep, F.from_json(text, S.REVIEW_STORE_SCHEMA).alias("_p")).where(F.col("_p.dataset_id") == dataset_id)
    reviews = p.select(*keep, F.explode("_p.reviews").alias("case_id", "_v"))
    checked = reviews.withColumn("_cells", F.when(F.size("_v.cells") == 25, F.col("_v.cells")).otherwise(F.raise_error(F.concat(F.lit("review needs exactly 25 cells: "), "case_id"))))
    cells = checked.select(*keep, "case_id", F.posexplode("_cells").alias("pos", "_c"))
    return cells.select(
        *keep, "case_id", F.coalesce("_c.row", F.floor(F.col("pos") / 5).cast("int")).alias("row"), F.coalesce("_c.column", (F.col("pos") % 5).cast("int")).alias("column"),
        F.coalesce("_c.status", F.lit("NOT_REVIEWED")).alias("status"), F.col("_c.diameter").alias("diameter"), F.coalesce("_c.notes", F.lit("")).alias("notes"), F.col("_c.timestamp").alias("timestamp"),
    )


def parse_sessions(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Repeatability sessions to items, with the documented defaults."""
    p = df.select(*keep, F.from_json(text, S.SESSION_SCHEMA).alias("_p"))
    s = p.select(
        *keep, F.coalesce("_p.study_id", F.lit("STUDY_001")).alias("study_id"), F.coalesce("_p.operator_id", F.lit("OPERATOR_1")).alias("operator_id"),
        F.coalesce("_p.random_seed", F.lit(42)).alias("random_seed"), F.coalesce("_p.is_completed", F.lit(False)).alias("is_completed"), F.explode("_p.items").alias("_i"),
    )
    return s.select(*keep, "study_id", "operator_id", "random_seed", "is_completed", "_i.*").withColumn("round_number", F.coalesce("round_number", F.lit(1)))


def parse_oracle_runs(df: DataFrame, text: str, *keep: str) -> DataFrame:
    p = df.select(*keep, F.from_json(text, S.ORACLE_RUN_SCHEMA).alias("_p")).select(*keep, "_p.*")
    return p.withColumns({
        "run_id": F.coalesce("run_id", F.lit("RUN_001")), "status": F.coalesce("status", F.lit("SUCCESS")),
        "local_diameters_px": F.coalesce("local_diameters_px", F.array().cast("array<double>")),
    })
