"""Project documents (schema versions 1 to 4) to normalised measurement rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filamet import schemas as S
from filamet.functions.records import normalize_source


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.PROJECT_SCHEMA).option("multiLine", True).json(path)


def parse_projects(df: DataFrame, text: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.from_json(text, S.PROJECT_SCHEMA).alias("_p")).select(*keep, "_p.*")


def exploded_records(projects: DataFrame, *keep: str) -> DataFrame:
    """One row per record; the legacy list is used only where the current one is absent."""
    legacy = F.col("records").isNull()
    rows = projects.withColumn("_legacy", legacy).withColumn("_r", F.explode_outer(F.coalesce("records", "measurements")))
    return rows.select(*keep, "_legacy", "_r.*")


def normalize_records(rows: DataFrame, *, engine_name: str | None = None) -> DataFrame:
    """Defaults and lifted fields; unknown kinds, statuses and sources fall back by rule."""
    c = F.col
    accepted = F.coalesce("accepted", F.lit(True))
    by_flag = F.when(accepted, "ACCEPTED").otherwise("REJECTED")
    legacy = F.coalesce("_legacy", F.lit(False)) if "_legacy" in rows.columns else F.lit(False)
    ident = F.coalesce("measurement_id", F.lit("M001"))

    def point(a: Column) -> Column:
        return F.when(a.isNotNull(), F.struct(a[0].alias("x"), a[1].alias("y")))

    width = F.coalesce("values.width_m", "width_m")
    length = F.when(c("values.width_m").isNull() & c("width_m").isNotNull(), c("width_m")).otherwise(c("values.length_m"))
    return rows.withColumns({
        "measurement_id": ident,
        "kind": F.when(~legacy & c("kind").isin(S.KINDS), c("kind")).otherwise("PROJECTED_WIDTH"),
        "status": F.when(~legacy & c("status").isin(S.STATUSES), c("status")).otherwise(by_flag),
        "source": normalize_source(F.when(legacy, c("method")).otherwise(F.coalesce("source", "method")), engine_name),
        "name": F.when(legacy, F.concat(F.lit("Width "), ident)).otherwise(F.coalesce("name", F.concat(F.lit("Measurement "), ident))),
        "fiber_id": F.when(legacy, F.coalesce("fiber_id", F.lit("F001"))).otherwise(c("fiber_id")),
        "defect": F.coalesce("defect", F.lit("None")),
        "notes": F.coalesce("notes", "note", F.lit("")),
        "tags": F.coalesce("tags", F.array().cast("array<string>")),
        "quality_flags": F.coalesce("quality_flags", F.array().cast("array<string>")),
        "p1_point": point(F.coalesce("geometry.p1", "p1")), "p2_point": point(F.coalesce("geometry.p2", "p2")),
        "width_value_m": F.when(legacy, F.coalesce(width, F.lit(0.0))).otherwise(width),
        "length_value_m": F.when(legacy, F.coalesce(width, F.lit(0.0))).otherwise(length),
    })


def counters(projects: DataFrame, *keys: str) -> DataFrame:
    """Next record and fiber numbers: above the highest used suffix and the stored counters."""

    def top(prefix: str, field: str) -> Column:
        hit = F.regexp_extract(F.col(f"_r.{field}"), f"^{prefix}([0-9]+)$", 1)
        return F.coalesce(F.max(F.when(hit != "", hit.cast("int"))), F.lit(0)) + 1

    rows = projects.withColumn("_r", F.explode_outer(F.coalesce("records", "measurements")))
    out = rows.groupBy(*keys).agg(
        F.greatest(F.coalesce(F.max("next_record_counter"), F.lit(0)), top("M", "measurement_id")).alias("next_record_counter"),
        F.greatest(F.coalesce(F.max("next_fiber_counter"), F.lit(0)), top("F", "fiber_id")).alias("next_fiber_counter"),
        F.coalesce(F.max("target_sections"), F.lit(5)).alias("target_sections"),
    )
    return out
