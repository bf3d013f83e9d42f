"""Bind the engine's tables to the driver's parquet tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METHODS = ["A", "N", "R"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted diameter samples: one row per (image, method, sample)."""
    c = F.col
    return table(spark, sf, "lineitem").select(
        c("l_suppkey").alias("image_id"),
        c("l_returnflag").alias("method"),
        F.when(c("l_returnflag") == "A", 0).when(c("l_returnflag") == "N", 1).otherwise(2).cast("long").alias("method_ord"),
        (c("l_extendedprice") / 997).alias("value"),
        c("l_quantity").alias("weight"),
        c("l_orderkey").alias("ord1"), c("l_linenumber").cast("long").alias("ord2"), c("l_partkey").alias("ord3"),
    )


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    """Reviewed measurement records."""
    c = F.col
    li = table(spark, sf, "lineitem")
    key = F.concat_ws("-", *[c(k).cast("string") for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return li.select(
        key.alias("measurement_id"),
        F.when(c("l_linenumber") == 6, "DISTANCE").when(c("l_linenumber") == 7, "POLYLINE_LENGTH").otherwise("PROJECTED_WIDTH").alias("kind"),
        F.when(c("l_returnflag") == "A", F.when(c("l_linenumber") == 1, "MANUALLY_EDITED").otherwise("ACCEPTED"))
        .when(c("l_returnflag") == "N", "PROPOSED").otherwise("REJECTED").alias("status"),
        F.when(c("l_linestatus") == "F", "MANUAL").otherwise("AUTO_ROI_COMPONENT").alias("source"),
        c("l_suppkey").alias("image_id"),
        (c("l_suppkey") % 5).alias("sample_id"),
        F.format_string("F%03d", (c("l_partkey") % 20 + 1).cast("int")).alias("fiber_id"),
        (c("l_extendedprice") * 1e-9).alias("width_m"),
        F.when(c("l_linenumber") % 2 == 0, c("l_extendedprice") * 1e-9).otherwise(0.0).alias("length_m"),
        c("l_quantity").alias("x1"), (c("l_discount") * 100).alias("y1"),
        (c("l_quantity") + c("l_tax") * 100).alias("x2"), (c("l_discount") * 100 + c("l_linenumber")).alias("y2"),
        (c("l_discount") * 10).alias("confidence"),
        ((1 + c("l_suppkey") % 50) * 1e-9).alias("px"), ((1 + c("l_suppkey") % 7) * 1e-9).alias("py"),
        c("l_shipdate").alias("created_at"),
    )


def images(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return table(spark, sf, "part").select(
        c("p_partkey").alias("image_id"), c("p_name").alias("filename"), c("p_brand").alias("resolution_class"),
        ((1 + c("p_size")) * 1e-9).alias("px"), ((1 + c("p_size") % 7) * 1e-9).alias("py"),
        (c("p_size") * 20).cast("long").alias("width_px"), (c("p_size") * 15 + 10).cast("long").alias("height_px"),
        c("p_retailprice").alias("price"),
    )


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """8 x 8 images, one row per pixel."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "v"))
    return e.select(
        "image_id", F.floor(F.col("pos") / 8).cast("long").alias("row"), (F.col("pos") % 8).cast("long").alias("col"),
        F.col("v").cast("double").alias("value"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered run samples: steps along one run per user."""
    c = F.col
    return table(spark, sf, "events").select(
        c("user_id").alias("run_id"), "ts", c("event_id").alias("sample_id"), c("value").alias("step"),
        c("event_type").alias("state"),
    )


CTES = {
    "samples": """
        SELECT l_suppkey AS image_id, l_returnflag AS method,
               CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END::BIGINT AS method_ord,
               l_extendedprice / 997 AS value, l_quantity AS weight,
               l_orderkey AS ord1, l_linenumber::BIGINT AS ord2, l_partkey AS ord3
        FROM lineitem""",
    "measurements": """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS measurement_id,
               CASE l_linenumber WHEN 6 THEN 'DISTANCE' WHEN 7 THEN 'POLYLINE_LENGTH' ELSE 'PROJECTED_WIDTH' END AS kind,
               CASE l_returnflag WHEN 'A' THEN CASE WHEN l_linenumber = 1 THEN 'MANUALLY_EDITED' ELSE 'ACCEPTED' END
                                 WHEN 'N' THEN 'PROPOSED' ELSE 'REJECTED' END AS status,
               CASE l_linestatus WHEN 'F' THEN 'MANUAL' ELSE 'AUTO_ROI_COMPONENT' END AS source,
               l_suppkey AS image_id, l_suppkey % 5 AS sample_id,
               'F' || lpad((l_partkey % 20 + 1)::VARCHAR, 3, '0') AS fiber_id,
               l_extendedprice * 1e-9::DOUBLE AS width_m,
               CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice * 1e-9::DOUBLE ELSE 0.0::DOUBLE END AS length_m,
               l_quantity AS x1, l_discount * 100 AS y1,
               l_quantity + l_tax * 100 AS x2, l_discount * 100 + l_linenumber AS y2,
               l_discount * 10 AS confidence,
               (1 + l_suppkey % 50) * 1e-9::DOUBLE AS px, (1 + l_suppkey % 7) * 1e-9::DOUBLE AS py,
               l_shipdate AS created_at
        FROM lineitem""",
    "images": """
        SELECT p_partkey AS image_id, p_name AS filename, p_brand AS resolution_class,
               (1 + p_size) * 1e-9::DOUBLE AS px, (1 + p_size % 7) * 1e-9::DOUBLE AS py,
               (p_size * 20)::BIGINT AS width_px, (p_size * 15 + 10)::BIGINT AS height_px, p_retailprice AS price
        FROM part""",
    "pixels": """
        SELECT vec_id AS image_id, ((pos - 1) // 8)::BIGINT AS row, ((pos - 1) % 8)::BIGINT AS col,
               embedding[pos]::DOUBLE AS value
        FROM embeddings, unnest(range(1, 65)) AS u(pos)""",
    "runs": """
        SELECT user_id AS run_id, ts, event_id AS sample_id, value AS step, event_type AS state FROM events""",
}
