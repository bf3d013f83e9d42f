"""Queries that write an export and read it back, and the streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from filamet.functions import records as R
from filamet.operators import centerline as L
from filamet.operators import distributions as D
from filamet.plans import bind
from filamet.plans.campaign_queries import CELL_SQL, RESULTS_SQL, method_results, review_events
from filamet.plans.distribution_queries import IM, SUMMARY_SQL, TIE
from filamet.plans.registry import query, r
from filamet.sinks import tables as K
from filamet.streaming import campaign as SC

c = F.col
LIT = F.lit


@query("k01_measurement_csv", """
SELECT measurement_id, kind, status, coalesce(CASE WHEN image_id % 9 > 0 THEN image_id::VARCHAR END, 'project.json') AS image_id, round(CASE WHEN kind IN ('PROJECTED_WIDTH','DISTANCE') THEN coalesce(nullif(length_m, 0), width_m) ELSE 2*width_m END*1e9, 3) AS primary_nm,
  'm' AS primary_unit, 'bead, ' || source AS tags, CASE WHEN sample_id = 0 THEN 'B;A' END AS quality_flags, round(CASE WHEN kind = 'PROJECTED_WIDTH' THEN width_m END*1e9, 3) AS projected_nm FROM measurements""", "measurements")
def k01(spark, sf):
    none = LIT(None).cast("double")
    m = bind.measurements(spark, sf).withColumns({
        "name": F.concat(LIT("Width \"q\", "), c("fiber_id")), "image_id": F.when(c("image_id") % 9 > 0, c("image_id").cast("string")).otherwise(""), "roi_id": LIT(None).cast("string"),
        "tags": F.array(LIT("bead"), c("source")), "notes": LIT(""), "quality_flags": F.when(c("sample_id") == 0, F.array(LIT("B"), LIT("A"))).otherwise(F.array().cast("array<string>")), "updated_at": c("created_at"),
        "values": F.struct("length_m", "width_m", (c("width_m") * 2).alias("total_length_m"), none.alias("interior_angle_deg"), none.alias("area_m2"), none.alias("perimeter_m"), none.alias("tortuosity"), none.alias("mean_intensity_au"), none.alias("mean_intensity"), none.alias("std_intensity_au"), none.alias("main_reported_value_m"))})
    path = K.write_csv(K.measurement_table(m, LIT("project.json")), K.scratch_path(spark, "measurements"))
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select("measurement_id", "kind", "status", "image_id", r(c("primary_value").cast("double") * 1e9, 3).alias("primary_nm"), "primary_unit", "tags", "quality_flags", r(c("projected_width_m").cast("double") * 1e9, 3).alias("projected_nm"))


@query("k02_profile_csv", """
SELECT vec_id, (i-1)::INTEGER AS ord, CASE WHEN vec_id % 2 = 0 THEN (i-1)*2.5 ELSE i-1 END::DOUBLE AS distance_m, round(embedding[i]::DOUBLE, 6) AS raw_intensity, round(CASE WHEN i <= 3 THEN embedding[i]::DOUBLE*2 ELSE embedding[i]::DOUBLE END, 6) AS smoothed_intensity FROM embeddings, (SELECT unnest(range(1, 65)) AS i)""")
def k02(spark, sf):
    e = bind.table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("raw"), F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double") * 2).alias("smooth"),
        F.when(c("vec_id") % 2 == 0, F.transform("embedding", lambda v, i: i * 2.5)).otherwise(F.array().cast("array<double>")).alias("dist"))
    path = K.write_csv(K.profile_table(e, ["vec_id"], "raw", "smooth", "dist"), K.scratch_path(spark, "profiles"))
    back = spark.read.schema("vec_id long, ord int, distance_m double, raw_intensity double, averaged_intensity double, smoothed_intensity double").option("header", True).csv(path)
    return back.select("vec_id", "ord", "distance_m", r("raw_intensity").alias("raw_intensity"), r("smoothed_intensity").alias("smoothed_intensity"))


@query("k03_dataset_summary", SUMMARY_SQL + f""", {RESULTS_SQL},
d(method, estimator, src) AS (VALUES ('A','Raw EDT','A'),('A','Refined EDT','none'),('N','common','N'),('R','Manual','R'))
SELECT r.image_id AS image, r.method, d.estimator, coalesce(m.n, 0)::BIGINT AS "N", NULL::DOUBLE AS coverage, NULL::DOUBLE AS std, round(q.p50, 6) AS median, round(q.p75 - q.p25, 6) AS "IQR", r.status FROM res r JOIN d USING (method)
LEFT JOIN m ON m.image_id = r.image_id AND m.method = d.src LEFT JOIN q ON q.image_id = r.image_id AND q.method = d.src""", "samples")
def k03(spark, sf):
    est = spark.createDataFrame([("A", "Raw EDT"), ("A", "Refined EDT"), ("N", "common"), ("R", "Manual")], "method string, estimator string")
    s = D.weighted_summary(bind.samples(spark, sf), IM, "value", "weight", tie=TIE)
    s = s.withColumn("estimator", F.when(c("method") == "A", "Raw EDT").when(c("method") == "N", "common").otherwise("Manual"))
    path = K.write_csv(K.dataset_summary(method_results(spark, sf).select("image_id", "method", "status"), s, est), K.scratch_path(spark, "summary"))
    schema = "image long, method string, estimator string, N long, coverage double, mean double, median double, std double, IQR double, P05 double, P95 double, status string"
    return spark.read.schema(schema).option("header", True).csv(path).select("image", "method", "estimator", "N", "coverage", "std", r("median").alias("median"), r("IQR").alias("IQR"), "status")


@query("k04_tidy_measurements", """
WITH f AS (SELECT *, row_number() OVER () AS rid, l_extendedprice/1009 AS d FROM lineitem),
u AS (SELECT l_suppkey AS image_id, l_orderkey AS sample_id, unnest([{'e':'Raw EDT','v':d,'f':false},{'e':'Raw Edge','v':CASE WHEN l_linenumber <> 4 THEN d*1.1::DOUBLE END,'f':false},{'e':'Raw Profile','v':NULL,'f':false},{'e':'Refined EDT','v':CASE WHEN l_returnflag = 'A' THEN d*0.9::DOUBLE END,'f':true},{'e':'Refined Edge','v':d*0.95::DOUBLE,'f':true},{'e':'Refined Profile','v':CASE WHEN l_partkey % 2 = 0 THEN d*0.97::DOUBLE END,'f':true}]) AS z,
  l_returnflag <> 'R' AS ea, l_linestatus = 'F' AS ra, l_returnflag = 'A' AS rm, CASE WHEN l_linenumber > 2 THEN l_linenumber END AS seg FROM f),
a AS (SELECT image_id, CASE WHEN z.f THEN 'Ribbon' ELSE 'Field' END AS method, z.e AS estimator, CASE WHEN z.f THEN ra ELSE ea END AS accepted, CASE WHEN rm THEN 'refined' ELSE 'not_refined' END AS rs, seg, round(z.v, 6) AS v FROM u WHERE z.v IS NOT NULL
  UNION ALL SELECT l_suppkey, 'Local', 'common', true, NULL, NULL, round(l_quantity/7, 6) FROM lineitem)
SELECT image_id, method, estimator, count(*) AS n, count(*) FILTER (accepted) AS n_accepted, count(*) FILTER (rs = 'refined') AS n_refined, count(seg) AS n_segment, round(avg(v), 8) AS mean_um FROM a GROUP BY ALL""")
def k04(spark, sf):
    d = c("l_extendedprice") / 1009
    f = bind.table(spark, sf, "lineitem").select(
        c("l_suppkey").alias("image_id"), c("l_orderkey").alias("sample_id"), (c("l_quantity") * 1e-6).alias("x_m"), LIT(1e-6).alias("y_m"), LIT(2e-6).alias("arc_length_weight_m"), d.alias("diameter_um"),
        F.when(c("l_linenumber") != 4, d * 1.1).otherwise(float("nan")).alias("edge_diameter_um"), LIT(float("inf")).alias("profile_diameter_um"), F.when(c("l_returnflag") == "A", d * 0.9).alias("refined_edt_um"),
        (d * 0.95).alias("refined_edge_um"), F.when(c("l_partkey") % 2 == 0, d * 0.97).alias("refined_profile_um"), (c("l_returnflag") != "R").alias("edge_accepted"), (c("l_linestatus") == "F").alias("refined_edge_accepted"),
        LIT("a;b").alias("edge_flags"), LIT("").alias("refined_edge_flags"), (c("l_returnflag") == "A").alias("refined_mask"), F.when(c("l_linenumber") > 2, c("l_linenumber")).otherwise(-1).alias("segment_id"), c("l_discount").alias("refine_confidence"))
    others = bind.table(spark, sf, "lineitem").select(c("l_suppkey").alias("image_id"), LIT("Local").alias("method"), LIT("common").alias("estimator"), c("l_orderkey").alias("sample_id"), (c("l_quantity") / 7).alias("value"), LIT(1.0).alias("weight"))
    path = K.scratch_path(spark, "tidy")
    K.tidy_measurements(f, others).write.parquet(path)
    return spark.read.parquet(path).groupBy("image_id", "method", "estimator").agg(
        F.count(LIT(1)).alias("n"), F.count_if("accepted").alias("n_accepted"), F.count_if(c("refinement_status") == "refined").alias("n_refined"), F.count("segment_id").alias("n_segment"), r(F.avg("diameter_um"), 8).alias("mean_um"))


@query("k05_manual_grid_csv", f"""
WITH {CELL_SQL} SELECT case_id, 'img_' || case_id AS image, (cell // 5 + 1)::INTEGER AS row, (cell % 5 + 1)::INTEGER AS "column", 'R' || (cell // 5 + 1) || 'C' || (cell % 5 + 1) AS position, status, round(CASE WHEN status = 'MEASURED' THEN revisions/7 END, 6) AS diameter_um FROM cells WHERE case_id % 3 > 0""")
def k05(spark, sf):
    st = SC.review_state(review_events(spark, sf), "case_id", "cell", "status", "ts", "event_id")
    cells = st.select("case_id", F.floor(c("cell") / 5).cast("int").alias("row"), (c("cell") % 5).cast("int").alias("column"), "status", F.when(c("status") == "MEASURED", c("revisions") / 7).alias("diameter"), LIT("").alias("notes"), LIT(None).cast("string").alias("timestamp"))
    images = cells.select("case_id").distinct().where(c("case_id") % 3 > 0).withColumn("image", F.concat(LIT("img_"), c("case_id")))
    path = K.write_csv(K.manual_grid_table(cells, images), K.scratch_path(spark, "grid"))
    back = spark.read.schema("case_id long, image string, row int, `column` int, position string, status string, diameter_um double, notes string, timestamp string").option("header", True).csv(path)
    return back.select("case_id", "image", "row", "column", "position", "status", "diameter_um")


@query("k06_method_documents", f"""
WITH {RESULTS_SQL}, q AS (SELECT image_id, method, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.95), 6) AS p95 FROM samples GROUP BY ALL)
SELECT image_id, method, status, q.n, mean, median, p05, p95 FROM res JOIN q USING (image_id, method)""", "samples")
def k06(spark, sf):
    s = bind.samples(spark, sf)
    dist = D.unweighted_summary(s, IM, "value")
    figures = ["mean", "median", "p05", "p95"]
    m = method_results(spark, sf).drop("n").join(dist, IM).select("image_id", "method", "status", "quality_flags", "n", *[r(k).alias(k) for k in figures])
    path = K.write_json(K.method_documents(m, "image_id", "method", ["status", "quality_flags", "n", *figures]), K.scratch_path(spark, "documents"))
    back = spark.read.schema("image_id long, methods map<string, struct<status:string,quality_flags:array<string>,n:bigint,mean:double,median:double,p05:double,p95:double>>").json(path)
    return back.select("image_id", F.explode("methods").alias("method", "d")).select("image_id", "method", "d.status", "d.n", *[f"d.{k}" for k in figures])


@query("k07_provenance", "SELECT 'DS' AS dataset_id, doc_id::VARCHAR AS case_id, sha256(text) AS sha256, lang AS resolution_class FROM documents")
def k07(spark, sf):
    d = bind.table(spark, sf, "documents").select(c("doc_id").cast("string").alias("case_id"), c("source").alias("filename"), F.sha2("text", 256).alias("sha256"), c("lang").alias("resolution_class"))
    path = K.write_json(K.provenance_rows(d, "DS", "1.0", "results-v2"), K.scratch_path(spark, "provenance"))
    return spark.read.schema("dataset_id string, version string, cache_schema string, case_id string, filename string, sha256 string, resolution_class string").json(path).select("dataset_id", "case_id", "sha256", "resolution_class")


@query("k08_cache_store", """
SELECT l_suppkey AS image_id, count(*) AS n, CASE WHEN l_suppkey % 5 = 0 THEN 'new' ELSE 'old' END AS version, round(sum(CASE WHEN l_suppkey % 5 = 0 THEN l_quantity*2 ELSE l_quantity END), 2) AS total FROM lineitem GROUP BY ALL""")
def k08(spark, sf):
    li = bind.table(spark, sf, "lineitem").select(c("l_suppkey").alias("image_id"), c("l_quantity").alias("value"), (c("l_suppkey") % 25).alias("image_group"))
    path = K.scratch_path(spark, "store")
    # partitions are groups of images, so the number of folders stays bounded
    K.store_results(li.withColumn("version", LIT("old")), path, partition="image_group")
    K.store_results(li.where(c("image_group") % 5 == 0).withColumns({"version": LIT("new"), "value": c("value") * 2}), path, partition="image_group")
    return spark.read.parquet(path).groupBy("image_id", "version").agg(F.count(LIT(1)).alias("n"), r(F.sum("value"), 2).alias("total"))


@query("k09_flat_metrics", """
SELECT label, count(*) AS n, NULL::DOUBLE AS w1_raw, round(max(embedding[1])::DOUBLE, 6) AS w1_refined, NULL::VARCHAR AS note FROM embeddings WHERE label % 2 = 0 GROUP BY label
UNION ALL SELECT label, count(*), round(min(embedding[2])::DOUBLE, 6), NULL, 'odd' FROM embeddings WHERE label % 2 = 1 GROUP BY label""")
def k09(spark, sf):
    e = bind.table(spark, sf, "embeddings")
    even = e.where(c("label") % 2 == 0).groupBy("label").agg(F.count(LIT(1)).alias("n"), F.struct(r(F.max(c("embedding")[0]).cast("double")).alias("refined")).alias("w1"))
    odd = e.where(c("label") % 2 == 1).groupBy("label").agg(F.count(LIT(1)).alias("n"), F.struct(r(F.min(c("embedding")[1]).cast("double")).alias("raw")).alias("w1"), LIT("odd").alias("note"))
    path = K.write_csv(K.flat_metrics([even, odd], "w1"), K.scratch_path(spark, "metrics"))
    back = spark.read.option("header", True).csv(path)
    return back.select(c("label").cast("int").alias("label"), c("n").cast("long").alias("n"), c("w1_raw").cast("double").alias("w1_raw"), c("w1_refined").cast("double").alias("w1_refined"), "note")


@query("k10_roi_campaign", """
WITH i AS (SELECT image_id, width_px, height_px, px FROM images), k AS (SELECT *, CASE WHEN width_px < 600 OR height_px < 600 THEN 1 ELSE 4 END AS n FROM i),
b AS (SELECT image_id, px, unnest(range(0, n)) AS o FROM k)
SELECT image_id, o::INTEGER AS roi_ord, CASE WHEN px*1e9 <= 10 THEN 'HIGH_MAG_FINE' WHEN px*1e9 <= 80 THEN 'MID_MAG_GENERAL' ELSE 'LOW_MAG_NETWORK' END AS preset,
  CASE WHEN 3e-7/px < 3.5 OR px*1e9 > 85 THEN 'UNSUITABLE_FOR_AUTOMATIC_WIDTH' WHEN (image_id + o) % 5 = 0 THEN 'NO_CANDIDATES' WHEN image_id % 60 > 40 THEN 'MANUAL_REVIEW_REQUIRED' WHEN (image_id + o) % 3 > 0 THEN 'USABLE' ELSE 'PARTIALLY_USABLE' END AS roi_class FROM b""", "images")
def k10(spark, sf):
    i = bind.images(spark, sf).withColumn("foot", LIT(None).cast("long"))
    rois = L.diagnostic_rois(i, "width_px", "height_px", "foot")
    t = rois.select("image_id", "roi_ord", R.resolution_preset(c("px")).alias("preset"), R.roi_class(R.resolvability(c("px"), LIT(100.0)), (c("image_id") + c("roi_ord")) % 5, c("image_id") % 60, (c("image_id") + c("roi_ord")) % 3).alias("roi_class"))
    path = K.write_csv(t, K.scratch_path(spark, "rois"))
    return spark.read.schema("image_id long, roi_ord int, preset string, roi_class string").option("header", True).csv(path)


@query("k11_result_payload", SUMMARY_SQL + f""", {RESULTS_SQL}
SELECT image_id, method, status, m.n, round(mean, 6) AS mean, round(p50, 6) AS median, round(p95, 6) AS p95 FROM res JOIN m USING (image_id, method) JOIN q USING (image_id, method)""", "samples")
def k11(spark, sf):
    s = D.weighted_summary(bind.samples(spark, sf), IM, "value", "weight", tie=TIE)
    p = K.result_payload(s, method_results(spark, sf).select("image_id", "method", "status", "quality_flags"), "image_id", "method")
    path = K.write_json(p, K.scratch_path(spark, "payload"))
    back = spark.read.schema("image_id long, method string, status string, common_distribution struct<n:bigint,mean:double,median:double,p95:double>").json(path)
    return back.select("image_id", "method", "status", "common_distribution.n", r("common_distribution.mean").alias("mean"), r("common_distribution.median").alias("median"), r("common_distribution.p95").alias("p95"))


@query("k11_campaign_payload", f"""
WITH {RESULTS_SQL}, e AS (SELECT image_id, method, min(value) AS lo, max(value) AS hi FROM samples GROUP BY ALL),
g AS (SELECT image_id, method, value, lo, hi, least(31, greatest(0, floor((value-lo)*(32/(hi-lo)))))::INTEGER AS i FROM samples JOIN e USING (image_id, method)),
j AS (SELECT *, CASE WHEN value < i*((hi-lo)/32)+lo THEN i-1 ELSE i END AS k FROM g),
b AS (SELECT image_id, method, CASE WHEN k < 31 AND value >= (k+1)*((hi-lo)/32)+lo THEN k+1 ELSE k END AS bin, count(*) AS n FROM j GROUP BY ALL),
h AS (SELECT e.image_id, e.method, string_agg(coalesce(b.n, 0)::VARCHAR, ',' ORDER BY s.bin) AS hist FROM e CROSS JOIN (SELECT unnest(range(0, 32)) AS bin) s LEFT JOIN b ON b.image_id = e.image_id AND b.method = e.method AND b.bin = s.bin GROUP BY ALL),
u AS (SELECT image_id, method, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(coalesce(stddev_samp(value), 0), 6) AS std, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.95), 6) AS p95, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM samples GROUP BY ALL)
SELECT image_id, method, status, u.n, mean, median, std, p05, p95, hist, lo AS first_edge, hi AS last_edge FROM res JOIN u USING (image_id, method) JOIN h USING (image_id, method)""", "samples")
def k11_campaign(spark, sf):
    block = K.campaign_block(bind.samples(spark, sf), IM, "value", ["ord1", "ord2", "ord3"])
    p = method_results(spark, sf).select("image_id", "method", "status", "quality_flags").join(block, IM)
    path = K.write_json(p, K.scratch_path(spark, "campaign-payload"))
    figures = "struct<n:bigint,mean:double,median:double,std:double,quantiles:array<double>,hist_values:array<bigint>,hist_edges:array<double>,fingerprint:string>"
    back = spark.read.schema(f"image_id long, method string, status string, campaign {figures}").json(path).select("image_id", "method", "status", "campaign.*")
    return back.select(
        "image_id", "method", "status", "n", *[r(k).alias(k) for k in ("mean", "median", "std")], r(F.element_at("quantiles", 1)).alias("p05"), r(F.element_at("quantiles", 5)).alias("p95"),
        F.array_join("hist_values", ",").alias("hist"), r(F.element_at("hist_edges", 1)).alias("first_edge"), r(F.element_at("hist_edges", -1)).alias("last_edge"))


def _stream(spark, sf, name):
    # a table is one file or a folder of part files; a stream takes a file only as a pattern
    return spark.readStream.schema(bind.table(spark, sf, name).schema).parquet(f"{sf}/{{{name}}}.parquet")


@query("r01_incremental_campaign", """
SELECT doc_id, CASE WHEN n_chars < 200 THEN 'FAILED' ELSE 'COMPLETE' END AS status, CASE WHEN n_chars < 200 THEN 'TOO_FEW_PIXELS' END AS error, CASE WHEN n_chars >= 200 THEN sha256(text) END AS sha256 FROM documents""")
def r01(spark, sf):
    out, ck = K.scratch_path(spark, "ingest"), K.scratch_path(spark, "ingest-ck")
    problem = F.when(c("n_chars") < 200, "TOO_FEW_PIXELS")
    # the second run finds everything seen and adds nothing
    for _ in range(2):
        SC.ingest_new(spark, _stream(spark, sf, "documents"), "doc_id", lambda d: d.select("doc_id", F.sha2("text", 256).alias("sha256")), problem, out, ck)
    return spark.read.option("basePath", out).parquet(out).select("doc_id", "status", "error", "sha256")


@query("r02_review_state", f"WITH {CELL_SQL} SELECT case_id, cell, status, revisions, last_ts::VARCHAR[1:19] AS last_ts FROM cells".replace("last_ts::VARCHAR[1:19]", "substr(last_ts::VARCHAR, 1, 19)"))
def r02(spark, sf):
    out, ck = K.scratch_path(spark, "review"), K.scratch_path(spark, "review-ck")
    status = F.when(c("event_type") == "purchase", "MEASURED").when(c("event_type") == "error", "NO_VALID_FIBER").otherwise("NOT_REVIEWED")
    ev = _stream(spark, sf, "events").select(c("user_id").alias("case_id"), (c("event_id") % 25).alias("cell"), status.alias("status"), "ts", "event_id")
    SC.run_review_state(ev, "case_id", "cell", "status", "ts", "event_id", out, ck)
    s = SC.read_review_state(spark, out)
    return s.select(c("case").cast("long").alias("case_id"), c("cell").cast("long").alias("cell"), "status", "revisions", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss").alias("last_ts"))


