"""Queries over campaign tables: sources, verification, parity, review, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from filamet import schemas as S
from filamet.functions import records as R
from filamet.operators import campaign as C
from filamet.operators import distributions as D
from filamet.operators import fitting, parity, plugins, reports
from filamet.operators.groups import attach_row
from filamet.operators.quantiles import exact_quantiles, weighted_quantiles
from filamet.plans import bind
from filamet.plans.distribution_queries import IM, MEMBERS_SQL, SUMMARY_SQL, TIE, dist_sql, members, wq_sql
from filamet.plans.registry import query, r
from filamet.sources import files, projects, stores

c = F.col
LIT = F.lit


# ---- sources --------------------------------------------------------------------------------

@query("s01_file_inventory", """
WITH f AS (SELECT page_id, 'img_' || lpad((page_id * 7919 % 100003)::VARCHAR, 6, '0') || '.tif' AS filename, sha256(html) AS sha256 FROM pages)
SELECT filename, sha256, 'ZEISS_' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS case_id FROM (SELECT *, row_number() OVER (ORDER BY filename, sha256) AS n FROM f)""")
def s01(spark, sf):
    p = bind.table(spark, sf, "pages")
    f = p.select(F.concat(LIT("img_"), F.lpad((c("page_id") * 7919 % 100003).cast("string"), 6, "0"), LIT(".tif")).alias("filename"), F.sha2("html", 256).alias("sha256"))
    return files.number_cases(f).select("filename", "sha256", "case_id")


@query("s02_manifest_first", """
SELECT 'CAMPAIGN' AS dataset_id, 'CASE_' || m.o_orderkey AS case_id, m.o_orderkey || '.tif' AS filename, sha256(m.o_orderpriority) AS sha256, o_orderstatus AS resolution_class FROM orders m WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3)""")
def s02(spark, sf):
    o = bind.table(spark, sf, "orders")
    manifest = o.select(
        LIT("CAMPAIGN").alias("dataset_id"), c("o_orderkey").alias("case_ord"), F.concat(LIT("CASE_"), c("o_orderkey")).alias("case_id"),
        F.concat(c("o_orderkey"), LIT(".tif")).alias("filename"), F.sha2("o_orderpriority", 256).alias("sha256"), c("o_orderstatus").alias("resolution_class"))
    present = bind.table(spark, sf, "lineitem").where(c("l_linenumber") == 3).select(F.concat(c("l_orderkey"), LIT(".tif")).alias("filename"))
    return files.manifest_first(manifest, present, "images")


@query("s03_inventory_table", """
SELECT 'CASE_' || image_id AS case_id, filename, px AS pixel_size_x, CASE WHEN image_id % 3 = 0 THEN height_px ELSE height_px - 9 END AS footer_start_row, CASE WHEN image_id % 3 = 0 THEN 0 ELSE 9 END::BIGINT AS footer_height_px,
  CASE WHEN image_id % 2 = 0 THEN (image_id*10)::VARCHAR ELSE '' END AS magnification, '' AS detector, CASE WHEN image_id % 3 = 0 THEN 'FOOTER_NOT_DETECTED' ELSE '' END AS reader_flags, CASE WHEN image_id % 5 = 0 THEN 'PRESENT' ELSE 'ABSENT' END AS zeiss_metadata_status,
  round(px*1e6::DOUBLE, 12) AS conversion_um_per_px FROM images""", "images")
def s03(spark, sf):
    has_footer = c("image_id") % 3 != 0
    i = bind.images(spark, sf).withColumns({
        "case_id": F.concat(LIT("CASE_"), c("image_id")), "absolute_path": F.concat(LIT("/data/"), c("filename")), "sha256": F.sha2("filename", 256), "file_size_bytes": LIT(1), "channels": LIT(1), "dtype": LIT("uint8"),
        "footer_y0": F.when(has_footer, c("height_px") - 9), "footer_y1": F.when(has_footer, c("height_px")), "pixel_size_x": c("px"), "pixel_size_y": c("py"),
        "source_reader": F.when(c("image_id") % 5 == 0, "zeiss_cz_sem_tiff").otherwise("tiff"),
        "metadata": F.when(c("image_id") % 2 == 0, F.create_map(LIT("ap_mag"), (c("image_id") * 10).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))})
    return files.inventory_table(i).select("case_id", "filename", "pixel_size_x", "footer_start_row", "footer_height_px", "magnification", "detector", "reader_flags", "zeiss_metadata_status", r("conversion_um_per_px", 12).alias("conversion_um_per_px"))


@query("s03_short_inventory", """
SELECT filename, CASE WHEN image_id % 5 = 0 THEN 'tiff' ELSE '' END AS format_id, width_px, height_px, CASE WHEN image_id % 7 = 0 THEN '' ELSE 'calibrated' END AS pixel_size_nm, CASE WHEN image_id % 2 = 0 THEN (image_id*10)::VARCHAR ELSE '' END AS magnification,
  CASE WHEN image_id % 2 = 0 THEN width_px::VARCHAR ELSE '' END AS field_width, CASE WHEN image_id % 2 = 0 THEN 'um' ELSE '' END AS field_width_unit, '' AS field_height, '' AS field_height_unit, CASE WHEN image_id % 2 = 0 THEN (image_id % 30)::VARCHAR ELSE '' END AS eht_kv, '' AS wd_mm, '' AS detector, '' AS date, '' AS time,
  CASE WHEN image_id % 3 = 0 THEN (image_id % 11)::VARCHAR ELSE '' END AS width_crosscheck_relative, '' AS height_crosscheck_relative FROM images""", "images")
def s03_short(spark, sf):
    i = c("image_id")
    tags = {"ap_mag": (i * 10).cast("string"), "ap_width": c("width_px").cast("string"), "ap_width__unit": LIT("um"), "ap_actualkv": (i % 30).cast("string")}
    some = F.when(i % 2 == 0, F.create_map(*[x for k, v in tags.items() for x in (LIT(k), v)])).otherwise(F.create_map().cast("map<string,string>"))
    t = bind.images(spark, sf).withColumns({
        "metadata": some, "format_id": F.when(i % 5 == 0, "tiff"), "pixel_size_x": F.when(i % 7 != 0, c("px")),
        "width_crosscheck_relative": F.when(i % 3 == 0, i % 11), "height_crosscheck_relative": LIT(None).cast("double")})
    out = files.short_inventory(t, expected=t.count())
    return out.withColumn("pixel_size_nm", F.when(c("pixel_size_nm") != "", "calibrated").otherwise(""))


@query("s04_flatten_metadata", """
WITH k AS (SELECT event_id, props->>'k' AS v, event_type AS t FROM events)
SELECT event_id, 'ap_k' AS key, v AS value FROM k UNION ALL SELECT event_id, 'ap_k__label', 'Label ' || t FROM k WHERE t <> 'error' UNION ALL SELECT event_id, 'ap_k__unit', 'nm' FROM k WHERE t = 'view' OR t = 'click'""")
def s04(spark, sf):
    t = c("event_type")
    tag = F.struct(F.when(t != "error", F.concat(LIT("Label "), t)).alias("label"), F.get_json_object("props", "$.k").alias("value"), F.when(t.isin("view", "click"), "nm").when(t == "signup", "").alias("unit"))
    tags = F.create_map(LIT("ap_k"), tag, LIT(""), tag)
    return bind.table(spark, sf, "events").select("event_id", F.explode(files.flatten_metadata(tags)).alias("key", "value"))


def project_texts(spark, sf):
    """One project document per order: even keys in the current form, odd keys in the legacy form."""
    k = c("o_orderkey")
    mid = F.format_string("M%04d", (k % 50).cast("int"))
    rec = F.struct(
        mid.alias("measurement_id"), F.when(k % 3 == 0, "NOT_A_KIND").otherwise("DISTANCE").alias("kind"), F.when(k % 10 == 0, "unknown").when(k % 10 == 2, "AMBIGUOUS").alias("status"),
        (k % 4 == 0).alias("accepted"), F.when(k % 7 == 0, "SIMPOLY_SOURCE v1").when(k % 7 == 1, "simpoly_controlled").when(k % 7 == 2, "assisted AUTO").when(k % 7 == 3, "auto-roi").when(k % 7 == 4, "csv import").alias("source"),
        F.format_string("F%03d", (k % 9).cast("int")).alias("fiber_id"), F.array((k % 5).cast("double"), LIT(2.0)).alias("p1"), (c("o_totalprice") * 1e-9).alias("width_m"))
    second = rec.withField("measurement_id", LIT("X7")).withField("fiber_id", LIT(None).cast("string")).withField("width_m", LIT(None).cast("double"))
    new = F.struct(LIT(4).alias("schema_version"), F.array(rec, second).alias("records"), F.when(k % 6 == 0, 40).cast("int").alias("next_record_counter"))
    old = F.struct(LIT(1).alias("schema_version"), F.array(F.struct(mid.alias("measurement_id"), (c("o_totalprice") * 1e-9).alias("width_m"), (k % 3 == 0).alias("accepted"), F.when(k % 5 == 0, "Assisted").alias("method"))).alias("measurements"), LIT(3).alias("target_sections"))
    o = bind.table(spark, sf, "orders")
    return o.select("o_orderkey", F.when(k % 2 == 0, F.to_json(new)).otherwise(F.to_json(old)).alias("text"))


@query("s05_project_counters", """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN greatest(CASE WHEN o_orderkey % 6 = 0 THEN 40 ELSE 0 END, o_orderkey % 50 + 1) ELSE o_orderkey % 50 + 1 END::INTEGER AS next_record_counter,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 9 + 1 ELSE 1 END::INTEGER AS next_fiber_counter, CASE WHEN o_orderkey % 2 = 0 THEN 5 ELSE 3 END::INTEGER AS target_sections FROM orders""")
def s05(spark, sf):
    p = projects.parse_projects(project_texts(spark, sf), "text", "o_orderkey")
    k = projects.counters(p, "o_orderkey")
    return k.select("o_orderkey", *[c(n).cast("int").alias(n) for n in ("next_record_counter", "next_fiber_counter", "target_sections")])


@query("s06_record_normaliser", """
WITH o AS (SELECT o_orderkey AS k, round(o_totalprice*1e-9::DOUBLE*1e9, 4) AS w FROM orders),
s AS (SELECT *, CASE WHEN k % 10 = 2 THEN 'AMBIGUOUS' WHEN k % 4 = 0 THEN 'ACCEPTED' ELSE 'REJECTED' END AS st, CASE k % 7 WHEN 0 THEN 'SOURCE_COMPAT' WHEN 1 THEN 'CONTROLLED_INPUT' WHEN 2 THEN 'ASSISTED' WHEN 3 THEN 'AUTO_ROI_COMPONENT' WHEN 4 THEN 'IMPORTED' ELSE 'MANUAL' END AS src FROM o)
SELECT k AS o_orderkey, 'M' || lpad((k % 50)::VARCHAR, 4, '0') AS measurement_id, CASE WHEN k % 3 = 0 THEN 'PROJECTED_WIDTH' ELSE 'DISTANCE' END AS kind, st AS status, src AS source, 'F' || lpad((k % 9)::VARCHAR, 3, '0') AS fiber_id, w AS width_nm, w AS length_nm, (k % 5)::DOUBLE AS p1x FROM s WHERE k % 2 = 0
UNION ALL SELECT k, 'X7', CASE WHEN k % 3 = 0 THEN 'PROJECTED_WIDTH' ELSE 'DISTANCE' END, st, src, NULL, NULL, NULL, (k % 5)::DOUBLE FROM s WHERE k % 2 = 0
UNION ALL SELECT k, 'M' || lpad((k % 50)::VARCHAR, 4, '0'), 'PROJECTED_WIDTH', CASE WHEN k % 3 = 0 THEN 'ACCEPTED' ELSE 'REJECTED' END, CASE WHEN k % 5 = 0 THEN 'ASSISTED' ELSE 'MANUAL' END, 'F001', w, w, NULL FROM s WHERE k % 2 = 1""")
def s06(spark, sf):
    p = projects.parse_projects(project_texts(spark, sf), "text", "o_orderkey")
    n = projects.normalize_records(projects.exploded_records(p, "o_orderkey"))
    return n.select("o_orderkey", "measurement_id", "kind", "status", "source", "fiber_id", r(c("width_value_m") * 1e9, 4).alias("width_nm"), r(c("length_value_m") * 1e9, 4).alias("length_nm"), c("p1_point.x").alias("p1x"))


@query("s07_result_cache", """
SELECT l_suppkey AS image_id, count(*) AS n, round(max(l_quantity), 3) AS top FROM lineitem WHERE l_suppkey % 4 > 0 GROUP BY ALL""")
def s07(spark, sf):
    from filamet.sinks import tables as K
    path = K.scratch_path(spark, "results")
    li = bind.table(spark, sf, "lineitem").select(c("l_suppkey").alias("image_id"), "l_quantity", F.when(c("l_suppkey") % 4 > 0, "results-v2").otherwise("results-v1").alias("schema_version"))
    # partition by a bucket of images: one folder per image would not scale to many images
    li.withColumn("image_bucket", F.pmod(F.xxhash64("image_id"), LIT(16))).write.partitionBy("image_bucket").parquet(path)
    return stores.read_results(spark, path, "results-v2").groupBy("image_id").agg(F.count(LIT(1)).alias("n"), F.max("l_quantity").alias("top"))


@query("s08_campaign_payloads", """
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'FAILED' ELSE 'READ' END AS read_status, CASE WHEN o_orderkey % 11 > 0 THEN 'FIELD' END AS method_id, CASE WHEN o_orderkey % 11 > 0 THEN o_totalprice END AS native_result FROM orders""")
def s08(spark, sf):
    k = c("o_orderkey")
    res = lambda m, v: F.struct(LIT(m).alias("method_id"), LIT("COMPLETE").alias("status"), v.alias("native_result"))
    text = F.when(k % 11 == 0, '{"image_id": "broken", "results": [').otherwise(F.to_json(F.struct(k.cast("string").alias("image_id"), F.array(res("FIELD", c("o_totalprice")), res("NOBODY", LIT(1.0))).alias("results"))))
    p = stores.parse_payloads(bind.table(spark, sf, "orders").withColumn("text", text), "text", "o_orderkey")
    m = stores.payload_methods(p, ["FIELD", "MANUAL"], "o_orderkey")
    return p.select("o_orderkey", "read_status").join(m.select("o_orderkey", "method_id", "native_result"), "o_orderkey", "left")


@query("s09_review_store", """
SELECT o_orderkey, 'case_' || o_custkey AS case_id, (i // 5)::INTEGER AS row, (i % 5)::INTEGER AS "column", CASE WHEN (o_orderkey + i) % 3 = 0 THEN 'MEASURED' ELSE 'NOT_REVIEWED' END AS status, CASE WHEN (o_orderkey + i) % 3 = 0 THEN i + 0.5::DOUBLE END AS diameter
FROM orders, (SELECT unnest(range(0, 25)) AS i) WHERE o_orderstatus = 'F'""")
def s09(spark, sf):
    o = bind.table(spark, sf, "orders")
    cells = F.transform(F.sequence(LIT(0), LIT(24)), lambda i: F.struct(
        F.floor(i / 5).cast("int").alias("row"), (i % 5).alias("column"), F.when((c("o_orderkey") + i) % 3 == 0, "MEASURED").alias("status"), F.when((c("o_orderkey") + i) % 3 == 0, i + 0.5).alias("diameter")))
    case = F.concat(LIT("case_"), c("o_custkey"))
    store = F.struct(F.when(c("o_orderstatus") == "F", "DS").otherwise("OTHER").alias("dataset_id"), F.create_map(case, F.struct(case.alias("case_id"), cells.alias("cells"))).alias("reviews"))
    s = stores.parse_review_store(o.withColumn("text", F.to_json(store)), "text", "DS", "o_orderkey")
    return s.select("o_orderkey", "case_id", "row", "column", "status", "diameter")


@query("s12_study_readers", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'S' || o_custkey ELSE 'STUDY_001' END AS study_id, CASE WHEN o_orderkey % 4 = 0 THEN 7 ELSE 42 END AS random_seed, CASE i WHEN 1 THEN 2 ELSE 1 END AS round_number, o_totalprice * i AS original_value_m, CASE WHEN o_orderkey % 5 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS run_status, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 2 END::BIGINT AS n_diameters
FROM orders, (SELECT unnest([1, 2]) AS i)""")
def s12(spark, sf):
    k = c("o_orderkey")
    item = lambda i, rnd: F.struct(F.concat(LIT("g"), LIT(i)).alias("reference_group_id"), LIT("r").alias("record_id"), (c("o_totalprice") * i).alias("original_value_m"), LIT(rnd).cast("int").alias("round_number"))
    session = F.to_json(F.struct(F.when(k % 3 == 0, F.concat(LIT("S"), c("o_custkey"))).alias("study_id"), F.when(k % 4 == 0, 7).alias("random_seed"), F.array(item(1, 2), item(2, None)).alias("items")))
    run = F.to_json(F.struct(F.when(k % 5 == 0, "FAILED").alias("status"), F.when(k % 5 != 0, F.array(LIT(1.0), LIT(2.0))).alias("local_diameters_px")))
    o = bind.table(spark, sf, "orders").select("o_orderkey", session.alias("session"), run.alias("run"))
    s = stores.parse_sessions(o, "session", "o_orderkey", "run")
    d = stores.parse_oracle_runs(s, "run", "o_orderkey", "study_id", "random_seed", "round_number", "original_value_m")
    return d.select("o_orderkey", "study_id", "random_seed", "round_number", "original_value_m", c("status").alias("run_status"), F.size("local_diameters_px").cast("long").alias("n_diameters"))


# ---- joins of campaign tables ---------------------------------------------------------------

@query("j05_cached_lookup", """
WITH p AS (SELECT page_id, sha256(html) AS h FROM pages), m AS (SELECT h, min(page_id) AS case_id FROM p WHERE page_id % 3 > 0 GROUP BY h)
SELECT p.page_id, CASE WHEN p.page_id % 10 = 9 THEN 'NOT_RUN' WHEN m.case_id IS NULL THEN 'NOT_RUN' WHEN m.case_id % 4 = 0 THEN 'NOT_RUN' ELSE 'COMPLETE' END AS status,
  CASE WHEN p.page_id % 10 = 9 THEN 'CACHE_ROI_NOT_AVAILABLE' WHEN m.case_id IS NULL THEN 'CACHE_NO_MATCHING_IMAGE' WHEN m.case_id % 4 = 0 THEN 'CACHE_CASE_INCOMPLETE' WHEN m.case_id % 2 = 0 THEN '' ELSE 'RAW_DIAMETERS_UNAVAILABLE;COMMON_LENGTH_WEIGHT_UNAVAILABLE' END AS flags,
  CASE WHEN p.page_id % 10 <> 9 AND m.case_id % 4 > 0 THEN m.case_id * 1.5::DOUBLE END AS native_result FROM p LEFT JOIN m ON p.h = m.h""")
def j05(spark, sf):
    p = bind.table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("sha256"))
    manifest = p.where(c("page_id") % 3 > 0).groupBy("sha256").agg(F.min("page_id").alias("case_id"))
    summ = manifest.where(c("case_id") % 4 != 0).select("case_id", (c("case_id") * 1.5).alias("native_result"), (c("case_id") % 2 == 0).alias("has_samples"))
    out = C.cached_lookup(p.withColumn("custom_roi", c("page_id") % 10 == 9), manifest, summ)
    return out.select("page_id", "status", F.array_join("quality_flags", ";").alias("flags"), "native_result")


@query("j06_source_verification", """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'MISSING' WHEN doc_id % 5 = 0 THEN 'UNVERIFIED' WHEN doc_id % 3 = 0 THEN 'MISMATCH' ELSE 'MATCH' END AS verification FROM documents""")
def j06(spark, sf):
    d = bind.table(spark, sf, "documents")
    reg = d.select("doc_id", F.when(c("doc_id") % 5 != 0, F.sha2(F.when(c("doc_id") % 3 == 0, c("lang")).otherwise(c("text")), 256)).alias("expected"))
    inv = d.where(c("doc_id") % 7 != 0).select("doc_id", F.sha2("text", 256).alias("actual"))
    return C.verify_sources(reg, inv, "doc_id").select("doc_id", "verification")


# fixed values: stages with stored arrays, in processing order
ARRAY_STAGES = [s for s in S.STAGE_ORDER if s not in ("INPUT", "OTSU", "GAUSSIAN_FIT")]
STAGE_LIST = "[" + ",".join(f"'{s}'" for s in ARRAY_STAGES) + "]"
ORDER_LIST = "[" + ",".join(f"'{s}'" for s in S.STAGE_ORDER) + "]"


def stage_sides(spark, sf):
    e = bind.table(spark, sf, "embeddings")
    st = e.select(c("vec_id").alias("case_id"), "embedding", F.posexplode(F.array(*[LIT(s) for s in ARRAY_STAGES])).alias("i", "stage"))
    v = F.element_at("embedding", c("i") + 1)
    # products in the column's own precision: an integer literal makes them doubles, and only in ANSI mode
    by = lambda n: v * LIT(n).cast("float")
    base = st.select("case_id", "stage", "i", F.md5(F.floor(by(1000)).cast("string")).alias("sha256"), F.floor(F.abs(by(100))).alias("foreground"), v.cast("double").alias("mean"))
    left = base.where(c("case_id") % 13 != c("i")).drop("i")
    right = base.where(c("case_id") % 17 != c("i")).withColumn("sha256", F.when((c("case_id") + c("i")) % 29 == 0, "other").otherwise(c("sha256"))).drop("i")
    return left, right


STAGES_SQL = f"""
b AS (SELECT vec_id AS case_id, i - 1 AS i, ({STAGE_LIST})[i] AS stage, floor(embedding[i]*1000)::BIGINT AS h, floor(abs(embedding[i]*100))::BIGINT AS fg FROM embeddings, (SELECT unnest(range(1, {len(ARRAY_STAGES) + 1})) AS i)),
m AS (SELECT case_id, stage, i, CASE WHEN case_id % 13 <> i THEN fg END AS lf, CASE WHEN case_id % 17 <> i THEN fg END AS rf, case_id % 13 <> i AND case_id % 17 <> i AND (case_id + i) % 29 <> 0 AS matched FROM b WHERE NOT (case_id % 13 = i AND case_id % 17 = i))"""


@query("j07_stage_parity", f"WITH {STAGES_SQL} SELECT case_id, stage, lf AS left_foreground, rf AS right_foreground, matched FROM m")
def j07(spark, sf):
    left, right = stage_sides(spark, sf)
    return C.stage_parity(left, right, ["case_id"], "stage").select("case_id", "stage", "left_foreground", "right_foreground", "matched")


def scalar_sides(spark, sf):
    e = bind.table(spark, sf, "embeddings")
    d = lambda i: F.element_at("embedding", i).cast("double")
    left = e.select("vec_id", d(1).alias("threshold"), d(2).alias("b1"), d(3).alias("c1"), F.array(LIT(1), LIT(2)).alias("counts"), F.array(LIT(0.0), LIT(1.0), LIT(2.0)).alias("edges"))
    right = left.where(c("vec_id") % 5 > 0).select(
        "vec_id", F.when(c("vec_id") % 3 == 1, c("threshold") + 1e-9).otherwise(c("threshold")).alias("threshold"), F.when(c("vec_id") % 2 == 0, c("b1") + 0.01).otherwise(c("b1")).alias("b1"), "c1", "counts",
        F.when(c("vec_id") % 7 == 0, F.array(LIT(0.0), LIT(1.5), LIT(2.0))).otherwise(c("edges")).alias("edges"))
    return left, right


def divergences(spark, sf):
    left, right = stage_sides(spark, sf)
    numbers = C.scalar_parity(*scalar_sides(spark, sf), ["vec_id"]).withColumnRenamed("vec_id", "case_id")
    p = C.all_stages(C.stage_parity(left, right, ["case_id"], "stage"), numbers, ["case_id"], "stage")
    p = p.withColumn("ord", F.array_position(F.array(*[LIT(s) for s in S.STAGE_ORDER]), c("stage")))
    return C.first_divergence(p, ["case_id"], "stage", "ord", "matched", ["left_foreground", "right_foreground"])


DIV_SQL = STAGES_SQL + f""",
mm AS (SELECT case_id, stage, matched, lf, rf FROM m UNION ALL SELECT vec_id, 'OTSU', vec_id % 5 > 0 AND vec_id % 3 <> 1, NULL, NULL FROM embeddings UNION ALL SELECT vec_id, 'GAUSSIAN_FIT', vec_id % 5 > 0 AND vec_id % 2 = 1, NULL, NULL FROM embeddings),
dw AS (SELECT case_id, arg_min({{'s': stage, 'lf': lf, 'rf': rf}}, list_position({ORDER_LIST}, stage)) FILTER (NOT matched) AS w, count(*) FILTER (NOT matched) AS divergent FROM mm GROUP BY case_id),
dv AS (SELECT case_id, coalesce(w.s, 'MATCHED') AS first_divergence, divergent, w.lf AS left_foreground, w.rf AS right_foreground FROM dw)"""


@query("a25_first_divergence", f"WITH {DIV_SQL} SELECT * FROM dv")
def a25(spark, sf):
    return divergences(spark, sf)


@query("j07_scalar_parity", """
WITH l AS (SELECT vec_id, embedding[1]::DOUBLE AS t, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c1 FROM embeddings)
SELECT vec_id, vec_id % 5 > 0 AND vec_id % 3 <> 1 AS otsu_matched, CASE WHEN vec_id % 5 > 0 THEN round(CASE WHEN vec_id % 2 = 0 THEN 100*0.01/abs(b) ELSE 0 END, 4) END AS b1_percent, vec_id % 2 = 1 AND vec_id % 5 > 0 AS fit_matched, vec_id % 5 > 0 AS counts_equal, vec_id % 5 > 0 AND vec_id % 7 > 0 AS edges_equal FROM l""")
def j07b(spark, sf):
    # a missing right side leaves the threshold unmatched
    left, right = scalar_sides(spark, sf)
    s = C.scalar_parity(left, right, ["vec_id"])
    return s.select("vec_id", "otsu_matched", r("b1_percent", 4).alias("b1_percent"), "fit_matched", "counts_equal", "edges_equal")


@query("j08_case_assembly", f"""
WITH {DIV_SQL} SELECT c.vec_id AS case_id, CASE WHEN vec_id % 6 = 0 THEN 'SKELETON' ELSE dv.first_divergence END AS first_divergence, CASE WHEN vec_id % 4 > 0 THEN embedding[1]::DOUBLE END AS section_median FROM embeddings c LEFT JOIN dv ON dv.case_id = c.vec_id""")
def j08(spark, sf):
    e = bind.table(spark, sf, "embeddings")
    k = c("vec_id")
    details = e.where(k % 3 == 0).select(k.alias("case_id"), F.when(k % 6 == 0, "COMPLETE").otherwise("FAILED").alias("status"), LIT("SKELETON").alias("first_divergence"))
    results = e.where(k % 4 > 0).select(k.alias("case_id"), F.element_at("embedding", 1).cast("double").alias("section_median"))
    return C.assemble_cases(e.select(k.alias("case_id")), divergences(spark, sf), details, results).select("case_id", "first_divergence", "section_median")


def queue(spark, sf):
    cu = bind.table(spark, sf, "customer")
    k, bal = c("c_custkey"), c("c_acctbal")
    res = cu.where(k % 12 > 0).select(
        k.alias("case_id"), F.when(k % 14 != 0, bal).alias("oracle_center"), F.when(k % 10 > 0, bal * (1 + (k % 13 - 6) / 97)).alias("estimate_center"), (bal * (1 + (k % 7 - 3) * 0.073)).alias("section_median"),
        F.when(k % 9 == 2, "RESOLUTION_MARGINAL").otherwise("RESOLUTION_OK").alias("resolution"), F.when(k % 4 == 1, F.array(LIT("Z_FLAG"), LIT("A_FLAG"), LIT("Z_FLAG"))).otherwise(F.array().cast("array<string>")).alias("flags"))
    prev = cu.where(k % 5 == 0).select(k.alias("case_id"), LIT("IN_PROGRESS").alias("manual_status"), F.when(k % 2 == 0, "kept").otherwise("").alias("review_notes"), LIT(3).alias("manual_count"))
    grid = cu.where(k % 6 == 0).select(k.alias("case_id"), (k % 25).alias("measured"))
    return C.review_queue(cu.select(k.alias("case_id"), c("c_name").alias("filename")), res, prev, grid)


QUEUE_SQL = """
q0 AS (SELECT c_custkey AS k, c_name, c_acctbal AS bal, c_custkey % 12 > 0 AS has FROM customer),
q1 AS (SELECT *, CASE WHEN has AND k % 14 <> 0 THEN bal END AS oc, CASE WHEN has AND k % 10 > 0 THEN bal*(1+(k%13-6)/97) END AS ec, CASE WHEN has THEN bal*(1+(k%7-3)*0.073::DOUBLE) END AS sm,
  CASE WHEN NOT has THEN 'NONE' WHEN k % 9 = 2 THEN 'RESOLUTION_MARGINAL' ELSE 'RESOLUTION_OK' END AS res, has AND k % 4 = 1 AS fl FROM q0),
q2 AS (SELECT *, 100*abs(ec-oc)/nullif(abs(oc),0) AS e, 100*abs(sm-oc)/nullif(abs(oc),0) AS s FROM q1),
q3 AS (SELECT *, array_to_string(list_filter([CASE WHEN e IS NULL THEN 'ORACLE_ESTIMATE_RESULT_MISSING' WHEN e > 5 THEN printf('ORACLE_ESTIMATE_DIVERGENCE_%.1f%%', e) END, CASE WHEN s IS NULL THEN 'SECTION_RESULT_MISSING' WHEN s > 30 THEN printf('SECTION_METHOD_DIFFERENCE_%.1f%%', s) END,
  CASE WHEN res <> 'RESOLUTION_OK' THEN res END, CASE WHEN fl THEN 'AUTOMATIC_QUALITY_FLAGS_PRESENT' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM q2),
queue AS (SELECT k AS case_id, c_name AS filename, round(e, 6) AS estimate_diff, round(s, 6) AS section_diff, CASE WHEN e IS NULL THEN 'UNKNOWN' WHEN e <= 5 THEN 'CLOSE' ELSE 'DIVERGENT' END AS agreement, CASE WHEN fl THEN 'A_FLAG;Z_FLAG' ELSE '' END AS quality_flags,
  CASE WHEN e IS NULL OR e > 5 OR s IS NULL OR s > 30 OR res <> 'RESOLUTION_OK' OR fl THEN 'HIGH' WHEN e > 1 OR s > 15 THEN 'MEDIUM' ELSE 'LOW' END AS priority, CASE WHEN k % 5 = 0 THEN 'IN_PROGRESS' ELSE 'NOT_MEASURED' END AS manual_status,
  CASE WHEN k % 6 = 0 THEN k % 25 WHEN k % 5 = 0 THEN 3 ELSE 0 END::BIGINT AS manual_count, CASE WHEN k % 10 = 0 THEN 'kept' WHEN reasons <> '' THEN 'AUTO: ' || reasons ELSE '' END AS review_notes FROM q3)"""


@query("j09_review_queue", f"WITH {QUEUE_SQL} SELECT * FROM queue")
def j09(spark, sf):
    return queue(spark, sf).select("case_id", "filename", r("estimate_diff").alias("estimate_diff"), r("section_diff").alias("section_diff"), "agreement", "quality_flags", "priority", "manual_status", "manual_count", "review_notes")


@query("t01_top_differences", f"WITH {QUEUE_SQL} SELECT case_id, estimate_diff, priority FROM queue ORDER BY estimate_diff DESC NULLS FIRST, case_id LIMIT 5")
def t01(spark, sf):
    q = queue(spark, sf).withColumn("estimate_diff", r("estimate_diff"))
    return C.top_differences(q, "estimate_diff").select("case_id", "estimate_diff", "priority")


@query("t02_selection_limit", "SELECT o_orderkey AS case_id, o_orderdate::VARCHAR AS case_date FROM (SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20)")
def t02(spark, sf):
    o = bind.table(spark, sf, "orders").select(c("o_orderkey").alias("case_id"), F.struct("o_orderdate", "o_orderkey").alias("case_ord"), c("o_orderstatus").alias("filename"), "o_orderdate")
    return C.select_cases(o, limit=20).select("case_id", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("case_date"))


@query("j20_resume_selection", """
SELECT o_orderkey AS case_id, CASE WHEN o_totalprice > 400000 THEN 'FAILED' ELSE 'COMPLETE' END AS status FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)""")
def j20(spark, sf):
    o = bind.table(spark, sf, "orders").select(c("o_orderkey").alias("case_id"), "o_totalprice")
    done = bind.table(spark, sf, "lineitem").where(c("l_linenumber") == 1).select(c("l_orderkey").alias("case_id"))
    return C.pending(o, done, "case_id").select("case_id", F.when(c("o_totalprice") > 400000, "FAILED").otherwise("COMPLETE").alias("status"))


@query("j16_insert_proposals", """
WITH have AS (SELECT 'M' || CASE WHEN o_orderkey < 10000 THEN lpad(o_orderkey::VARCHAR, 4, '0') ELSE o_orderkey::VARCHAR END AS id FROM orders WHERE o_orderkey % 2 = 0), nx AS (SELECT max(o_orderkey) + 1 AS nx FROM orders WHERE o_orderkey % 2 = 0),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) + 3 AS fn FROM embeddings),
p AS (SELECT vec_id, i, row_number() OVER (ORDER BY vec_id, i) - 1 + nx AS num FROM embeddings, (SELECT unnest(range(0, 64)) AS i), nx)
SELECT id AS measurement_id, NULL AS fiber_id, 'ACCEPTED' AS status, NULL::DOUBLE AS width FROM have
UNION ALL SELECT 'M' || CASE WHEN num < 10000 THEN lpad(num::VARCHAR, 4, '0') ELSE num::VARCHAR END, 'F' || CASE WHEN fn < 1000 THEN lpad(fn::VARCHAR, 3, '0') ELSE fn::VARCHAR END, 'PROPOSED', round(embedding[i+1]::DOUBLE, 7) FROM p JOIN f USING (vec_id) JOIN embeddings e USING (vec_id)""")
def j16(spark, sf):
    o = bind.table(spark, sf, "orders")
    records = o.where(c("o_orderkey") % 2 == 0).select(F.format_string("M%04d", c("o_orderkey")).alias("measurement_id"), LIT("ACCEPTED").alias("status"))
    cand = bind.table(spark, sf, "embeddings").select("vec_id", c("embedding").alias("sections"))
    # three fibers exist already
    fibers = spark.range(1).select(LIT(4).cast("long").alias("next"))
    with_fiber = C.assign_ids(cand, fibers, ["vec_id"], "F%03d", "fiber_id")
    sections = with_fiber.select("vec_id", "fiber_id", F.posexplode("sections").alias("i", "width"))
    numbered = C.assign_ids(sections, C.next_numbers(records, "measurement_id", "M"), ["vec_id", "i"], "M%04d", "measurement_id")
    props = numbered.select("measurement_id", "fiber_id", LIT("PROPOSED").alias("status"), r(c("width").cast("double"), 7).alias("width"))
    return C.insert_proposals(records, props, "measurement_id")


@query("w06_next_numbers", "SELECT o_orderstatus, greatest(1, coalesce(max(o_orderkey) FILTER (o_orderkey % 7 > 0), 0) + 1) AS \"next\" FROM orders GROUP BY ALL")
def w06(spark, sf):
    k = c("o_orderkey")
    o = bind.table(spark, sf, "orders")
    ids = o.select("o_orderstatus", F.when(k % 7 == 0, F.concat(LIT("MX"), k)).otherwise(F.format_string("M%04d", k)).alias("measurement_id"))
    return C.next_numbers(ids, "measurement_id", "M", keys=["o_orderstatus"])


@query("j17_calibration_audit", """
WITH a AS (SELECT resolution_class, CASE WHEN image_id % 8 > 0 THEN px END AS px, CASE WHEN image_id % 8 > 0 THEN py END AS py FROM images)
SELECT resolution_class, count(*) AS images, count(px) AS calibrated, count(*) FILTER (abs(px-py)*1e9 < 1e-6) AS isotropic, round(min(px)*1e9, 6) AS low_nm, round(max(px)*1e9, 6) AS high_nm,
  CASE WHEN count(px) = 0 THEN 'unavailable' WHEN (max(px)-min(px))*1e9 < 1e-6 THEN 'single' ELSE 'mixed' END AS calibration FROM a GROUP BY resolution_class""", "images")
def j17(spark, sf):
    ok = c("image_id") % 8 > 0
    i = bind.images(spark, sf).select("image_id", "resolution_class", F.when(ok, c("px")).alias("px_m"), F.when(ok, c("py")).alias("py_m"))
    rois = i.select("image_id", LIT("0,0,10,10").alias("roi"))
    a = C.calibration_audit(i, rois, "image_id")
    s = C.calibration_summary(a, ["resolution_class"])
    iso = a.groupBy("resolution_class").agg(F.count_if("isotropic").alias("isotropic"))
    return s.join(iso, "resolution_class").select("resolution_class", "images", "calibrated", "isotropic", r("low_nm").alias("low_nm"), r("high_nm").alias("high_nm"), "calibration")


# ---- unions, exclusions, roll-ups -----------------------------------------------------------

def method_results(spark, sf):
    s = bind.samples(spark, sf)
    return s.groupBy("image_id", "method", "method_ord").agg(F.count(LIT(1)).alias("n"), F.max("ord3").alias("k")).withColumns({
        "status": F.when(c("k") % 5 == 0, "FAILED").when(c("k") % 5 == 1, "NOT_RUN").when(c("k") % 5 == 2, "EXPERIMENTAL_FIELD_MEASURING").otherwise("COMPLETE"),
        "has_common": c("k") % 3 > 0, "estimand": LIT(S.COMMON_ESTIMAND), "quality_flags": F.when(c("k") % 2 == 0, F.array(LIT("B"), LIT("A"), LIT("C"))).otherwise(F.array(LIT("A")))})


RESULTS_SQL = """
res AS (SELECT *, CASE k % 5 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'NOT_RUN' WHEN 2 THEN 'EXPERIMENTAL_FIELD_MEASURING' ELSE 'COMPLETE' END AS status, k % 3 > 0 AS has_common FROM (SELECT image_id, method, method_ord, count(*) AS n, max(ord3) AS k FROM samples GROUP BY ALL))"""


@query("u01_union_results", f"WITH {RESULTS_SQL} SELECT image_id, CASE method WHEN 'A' THEN 'ESTIMATOR_1' WHEN 'N' THEN 'LOCAL' ELSE 'MANUAL' END AS method, method_ord::INTEGER AS method_ord, n FROM res", "samples")
def u01(spark, sf):
    m = method_results(spark, sf).select("image_id", c("method").alias("m"), "n")
    return reports.union_results([(name, m.where(c("m") == k).drop("m")) for k, name in (("A", "ESTIMATOR_1"), ("N", "LOCAL"), ("R", "MANUAL"))])


EXC_SQL = RESULTS_SQL + ", ex AS (SELECT image_id, method, CASE WHEN NOT has_common THEN 'NO_COMMON_DISTRIBUTION' ELSE 'STATUS_' || status END AS reason FROM res WHERE NOT (has_common AND status IN ('COMPLETE','EXPERIMENTAL_FIELD_MEASURING')))"


@query("u02_exclusions", f"""
WITH {EXC_SQL}, {MEMBERS_SQL}, al AS (SELECT image_id, method, reason, 1 AS o FROM ex UNION ALL SELECT image_id, method, 'EMPTY_OR_INCOMPATIBLE_COMMON_DISTRIBUTION', 0 FROM mb JOIN fm USING (image_id) WHERE unit <> base),
l AS (SELECT image_id, method, arg_max(reason, o) AS reason FROM al GROUP BY ALL)
SELECT image_id, string_agg(method || '=' || reason, ';' ORDER BY method) AS excluded FROM l GROUP BY image_id""", "samples")
def u02(spark, sf):
    m = method_results(spark, sf)
    s = bind.samples(spark, sf)
    earlier = D.consensus_members(members(spark, sf), s, ["image_id"], "method", bind.METHODS, "value").where(~c("included")).select("image_id", "method", "reason")
    x = reports.exclusion_maps(reports.exclusions(m), earlier, "image_id")
    return x.select("image_id", F.array_join(F.transform(F.map_entries("excluded"), lambda e: F.concat(e["key"], LIT("="), e["value"])), ";").alias("excluded"))


@query("u03_flag_sets", """
WITH f AS (SELECT l_orderkey, list_distinct(list([l_returnflag, l_linestatus]).flatten()) AS s, list_distinct(list(l_linestatus)) AS t FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_sort(s), ';') AS all_flags, array_to_string(list_sort(list_intersect(s, ['A','F'])), ';') AS common, array_to_string(list_sort(list_filter(s, lambda x: NOT list_contains(t, x))), ';') AS only_left FROM f""")
def u03(spark, sf):
    li = bind.table(spark, sf, "lineitem")
    # a fixed vocabulary: collect_set holds at most the number of flag names
    f = li.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"))
    u = F.array_union("a", "b")
    return f.select("l_orderkey", F.array_join(F.array_sort(u), ";").alias("all_flags"), F.array_join(F.array_sort(F.array_intersect(u, F.array(LIT("A"), LIT("F")))), ";").alias("common"), F.array_join(F.array_sort(F.array_except(u, c("b"))), ";").alias("only_left"))


@query("t03_ordered_pairs", f"""
WITH {dist_sql()} SELECT l AS "left", r AS "right", count(*) AS images, round(avg(ks), 9) AS mean_ks FROM dd GROUP BY ALL ORDER BY 1, 2""", "samples")
def t03(spark, sf):
    d = D.pair_distances(bind.samples(spark, sf), ["image_id"], "method", bind.METHODS, "value", "weight")
    return d.groupBy("left", "right").agg(F.count(LIT(1)).alias("images"), r(F.avg("ks"), 9).alias("mean_ks")).orderBy("left", "right")


@query("j04_secondary_pairs", f"""
WITH {dist_sql()}, {wq_sql("samples", "image_id, method", "[0.5]::DOUBLE[]")}
SELECT image_id, r AS secondary, l AS against, round(w1, 9) AS w1, round(w1u, 9) AS w1_unweighted, round(ks, 10) AS ks, round(a.v - b.v, 8) AS median_difference FROM dd JOIN wq a USING (image_id) JOIN wq b USING (image_id) WHERE a.method = r AND b.method = l AND r = 'R'""", "samples")
def j04(spark, sf):
    s = bind.samples(spark, sf)
    d = D.pair_distances(s, ["image_id"], "method", bind.METHODS, "value", "weight", pairs=[("R", "A"), ("R", "N")])
    m = weighted_quantiles(s, IM, "value", "weight", [0.5], tie=TIE, names=["median"], count_first=True)
    p = reports.secondary_pairs(d, m, "image_id")
    return p.select("image_id", c("left").alias("secondary"), c("right").alias("against"), r("w1", 9).alias("w1"), r("w1_unweighted", 9).alias("w1_unweighted"), r("ks", 10).alias("ks"), r("median_difference", 8).alias("median_difference"))


# three methods, and estimators of one of them as series of their own
REPORT_SERIES = """series AS (SELECT image_id, method, value, weight FROM samples
  UNION ALL SELECT image_id, CASE WHEN ord2 <= 2 THEN 'RAW_EDGE' WHEN ord2 <= 4 THEN 'RIBBON_EDGE' ELSE 'PROFILE' END, value * (1 + ord2 / 50), weight FROM samples WHERE method = 'R')"""


@query("j04_report_pairs", f"""
WITH {REPORT_SERIES}, {dist_sql("series")}, {wq_sql("samples", "image_id, method", "[0.5]::DOUBLE[]")},
p AS (SELECT *, CASE WHEN l = 'A' AND r IN ('N', 'R') THEN 'primary' WHEN (l, r) IN (('R', 'RAW_EDGE'), ('PROFILE', 'R')) THEN 'internal' WHEN (l, r) = ('RAW_EDGE', 'RIBBON_EDGE') THEN 'refinement' END AS section FROM dd)
SELECT p.image_id, section, CASE WHEN section = 'internal' THEN 'R' ELSE l END AS "left", CASE WHEN section = 'internal' AND l = 'PROFILE' THEN l ELSE r END AS "right", round(CASE section WHEN 'primary' THEN w1 ELSE w1u END, 8) AS w1, round(ks, 10) AS ks,
  round(CASE section WHEN 'primary' THEN a.v - b.v END, 8) AS median_difference FROM p LEFT JOIN wq a ON a.image_id = p.image_id AND a.method = l LEFT JOIN wq b ON b.image_id = p.image_id AND b.method = r WHERE section IS NOT NULL""", "samples")
def j04_report(spark, sf):
    s = bind.samples(spark, sf)
    part = F.when(c("ord2") <= 2, "RAW_EDGE").when(c("ord2") <= 4, "RIBBON_EDGE").otherwise("PROFILE")
    inner = s.where(c("method") == "R").withColumns({"method": part, "value": c("value") * (1 + c("ord2") / 50)})
    p = reports.report_pairs(
        s.unionByName(inner), ["image_id"], "method", "value", "weight", tie=TIE,
        primary=[("A", "N"), ("A", "R")], internal=[("R", "RAW_EDGE"), ("R", "PROFILE")], refinement=[("RAW_EDGE", "RIBBON_EDGE")])
    return p.select("image_id", "section", "left", "right", r("w1", 8).alias("w1"), r("ks", 10).alias("ks"), r("median_difference", 8).alias("median_difference"))


@query("j19_refinement_pairs", SUMMARY_SQL + """
SELECT m.image_id, 'EDGE' AS estimator, m.n, round(q.p50, 9) AS p50, m2.n AS refined_n, round(q2.p50 - q.p50, 8) AS median_change FROM m JOIN q USING (image_id, method) LEFT JOIN m m2 ON m2.image_id = m.image_id AND m2.method = 'N' LEFT JOIN q q2 ON q2.image_id = m.image_id AND q2.method = 'N' WHERE m.method = 'A'
UNION ALL SELECT m.image_id, 'EDT', m.n, round(q.p50, 9), NULL, NULL FROM m JOIN q USING (image_id, method) WHERE m.method = 'R'""", "samples")
def j19(spark, sf):
    s = bind.samples(spark, sf).withColumn("estimator", F.when(c("method") == "A", "EDGE").when(c("method") == "N", "REFINED_EDGE").otherwise("EDT"))
    p = reports.refinement_pairs(D.weighted_summary(s, ["image_id", "estimator"], "value", "weight", tie=TIE), "image_id", "estimator")
    return p.select("image_id", "estimator", "n", r("p50", 9).alias("p50"), "refined_n", r("median_change", 8).alias("median_change"))


@query("a08_candidate_rollup", """
WITH k AS (SELECT image_id, confidence, list_filter([CASE WHEN x1 < 5 THEN 'TOO_SMALL' END, CASE WHEN x1 > 45 THEN 'LIKELY_MERGED' END, CASE WHEN y1 > 8 THEN 'TOUCHES_ROI_EDGE' END], lambda x: x IS NOT NULL) AS f FROM measurements),
l AS (SELECT *, list_has_any(f, ['TOO_SMALL','PROFILE_FAILED','LOW_ELONGATION','LIKELY_MERGED']) AS bad, len(f) = 0 AND confidence >= 0.7 AS high FROM k)
SELECT image_id, count(*) AS components, count(*) FILTER (bad) AS excluded, count(*) FILTER (NOT bad) AS measurable, count(*) FILTER (NOT bad AND high) AS high_confidence, count(*) FILTER (NOT bad AND NOT high) AS needs_review,
  count(*) FILTER (list_contains(f, 'TOO_SMALL')) AS n_too_small, count(*) FILTER (list_contains(f, 'LIKELY_MERGED')) AS n_merged FROM l GROUP BY image_id""", "measurements")
def a08(spark, sf):
    fl = F.array_compact(F.array(F.when(c("x1") < 5, "TOO_SMALL"), F.when(c("x1") > 45, "LIKELY_MERGED"), F.when(c("y1") > 8, "TOUCHES_ROI_EDGE")))
    m = bind.measurements(spark, sf).withColumn("flags", fl)
    roll = reports.candidate_rollup(m, ["image_id"], "flags", R.confidence_level(c("confidence"), c("flags"), LIT("MID_MAG_GENERAL")))
    why = reports.exclusion_reasons(m, ["image_id"], "flags").groupBy("image_id").agg(
        F.sum(F.when(c("reason") == "TOO_SMALL", c("n"))).alias("n_too_small"), F.sum(F.when(c("reason") == "LIKELY_MERGED", c("n"))).alias("n_merged"))
    return roll.join(why, "image_id", "left").fillna(0, ["n_too_small", "n_merged"])


@query("a10_status_matrix", f"""
WITH {RESULTS_SQL} SELECT image_id, coalesce(max(status) FILTER (method = 'A'), 'NOT_RUN') AS "A", coalesce(max(status) FILTER (method = 'N'), 'NOT_RUN') AS "N", coalesce(max(status) FILTER (method = 'R'), 'NOT_RUN') AS "R", coalesce(max(status) FILTER (method = 'X'), 'NOT_RUN') AS "X" FROM res GROUP BY image_id""", "samples")
def a10(spark, sf):
    m = method_results(spark, sf)
    return reports.status_matrix(m, m, "image_id", ["A", "N", "R", "X"])


@query("a10_median_matrix", """
WITH m AS (SELECT image_id, method, quantile_cont(value, 0.5) AS m FROM samples GROUP BY ALL)
SELECT image_id, round(max(m) FILTER (method = 'A'), 8) AS "A", round(max(m) FILTER (method = 'N'), 8) AS "N", round(max(m) FILTER (method = 'R'), 8) AS "R", NULL::DOUBLE AS "X" FROM m GROUP BY image_id""", "samples")
def a10c(spark, sf):
    s = bind.samples(spark, sf)
    m = exact_quantiles(s, ["image_id", "method"], "value", [0.5], names=["median"])
    return reports.median_matrix(m, m, "image_id", ["A", "N", "R", "X"]).select("image_id", *[r(k, 8).alias(k) for k in "ANRX"])


@query("a10_status_counts", f"WITH {RESULTS_SQL} SELECT method, status, count(*) AS n FROM res GROUP BY ALL", "samples")
def a10b(spark, sf):
    return reports.status_counts(method_results(spark, sf))


@query("a11_method_summary", """
WITH m AS (SELECT image_id, method, quantile_cont(value, 0.5) AS m FROM samples GROUP BY ALL)
SELECT method, count(*) AS images, round(quantile_cont(m, 0.5), 8) AS median, round(avg(m), 8) AS mean, round(stddev_pop(m), 8) AS std, round(quantile_cont(m, 0.75) - quantile_cont(m, 0.25), 8) AS iqr,
  (SELECT round(quantile_cont(weight, 0.5), 6) FROM samples s WHERE s.method = m.method) AS median_coverage FROM m GROUP BY method""", "samples")
def a11(spark, sf):
    s = bind.samples(spark, sf)
    m = reports.method_summary(s, "image_id", "method", "value", s.select("method", c("weight").alias("coverage")))
    return m.select("method", "images", *[r(k, 8).alias(k) for k in ("median", "mean", "std", "iqr")], r("median_coverage").alias("median_coverage"))


@query("a12_agreement_rollup", f"""
WITH {dist_sql()}, {wq_sql("samples", "image_id, method", "[0.5]::DOUBLE[]")},
p AS (SELECT l, r, w1, a.v - b.v AS md FROM dd JOIN wq a USING (image_id) JOIN wq b USING (image_id) WHERE a.method = l AND b.method = r)
SELECT l AS "left", r AS "right", count(*) AS n, round(quantile_cont(w1, 0.5), 8) AS median_w1, round(quantile_cont(md, 0.5), 8) AS median_difference FROM p GROUP BY ALL""", "samples")
def a12(spark, sf):
    a = D.agreements(bind.samples(spark, sf), ["image_id"], "method", bind.METHODS, "value", "weight", tie=TIE)
    return reports.agreement_rollup(a).select("left", "right", c("n_w1").alias("n"), r("median_w1", 8).alias("median_w1"), r("median_difference", 8).alias("median_difference"))


@query("a13_processed_images", f"""
WITH {RESULTS_SQL}, p AS (SELECT image_id, bool_or(status NOT IN ('NOT_RUN','FAILED')) AS p FROM res GROUP BY image_id) SELECT count(*) FILTER (p) AS processed, count(*) AS images FROM p""", "samples")
def a13(spark, sf):
    return reports.processed_images(method_results(spark, sf), "image_id")


@query("a13_quality_table", f"WITH {RESULTS_SQL} SELECT image_id, method, CASE WHEN k % 2 = 0 THEN 'B, A' ELSE 'A' END AS notable_flags FROM res", "samples")
def a13b(spark, sf):
    return reports.quality_table(method_results(spark, sf), "quality_flags").select("image_id", "method", "notable_flags")


CELL_SQL = "cells AS (SELECT user_id AS case_id, event_id % 25 AS cell, arg_max(CASE event_type WHEN 'purchase' THEN 'MEASURED' WHEN 'error' THEN 'NO_VALID_FIBER' ELSE 'NOT_REVIEWED' END, (ts, event_id)) AS status, max(ts) AS last_ts, count(*) AS revisions FROM events GROUP BY ALL)"


def review_events(spark, sf):
    status = F.when(c("event_type") == "purchase", "MEASURED").when(c("event_type") == "error", "NO_VALID_FIBER").otherwise("NOT_REVIEWED")
    return bind.table(spark, sf, "events").select(c("user_id").alias("case_id"), (c("event_id") % 25).alias("cell"), status.alias("status"), "ts", "event_id")


@query("a16_review_progress", f"""
WITH {CELL_SQL}, p AS (SELECT case_id, count(*) FILTER (status = 'MEASURED') AS measured, count(*) FILTER (status <> 'NOT_REVIEWED') AS completed FROM cells GROUP BY case_id)
SELECT case_id, measured, completed, (SELECT CASE WHEN sum(measured) >= 400 THEN 'COMPLETE' ELSE 'INCOMPLETE' END FROM p) AS reference FROM p""")
def a16(spark, sf):
    from filamet.streaming.campaign import review_state
    st = review_state(review_events(spark, sf), "case_id", "cell", "status", "ts", "event_id")
    per, total = reports.review_progress(st, "case_id")
    return attach_row(per, total.select("reference"))


@query("a17_array_fingerprint", """
SELECT image_id, round(min(value), 9) AS min, round(max(value), 9) AS max, round(avg(value), 9) AS mean, count(*) FILTER (CASE WHEN row = 0 THEN 0 ELSE value END <> 0) AS foreground, image_id % 4 > 0 AS same_content
FROM (SELECT image_id, row, col, CASE WHEN row = 0 THEN 0 ELSE value END AS value FROM pixels) GROUP BY image_id""", "pixels")
def a17(spark, sf):
    from filamet.sinks.tables import fingerprint
    a = bind.pixels(spark, sf).withColumn("value", F.when(c("row") == 0, 0.0).otherwise(c("value")))
    b = a.withColumn("value", F.when((c("image_id") % 4 == 0) & (c("row") == 5) & (c("col") == 5), c("value") + 1).otherwise(c("value"))).repartition("col")
    fa, fb = fingerprint(a, ["image_id"], "value"), fingerprint(b, ["image_id"], "value").select("image_id", c("fingerprint").alias("fb"))
    return fa.join(fb, "image_id").select("image_id", *[r(k, 9).alias(k) for k in ("min", "max", "mean")], "foreground", (c("fingerprint") == c("fb")).alias("same_content"))


@query("a18_diameter_errors", f"""
WITH p AS (SELECT label AS g, vec_id*64+i AS k, abs(embedding[i])*100 + 1 AS a, CASE WHEN label % 3 > 0 OR i < 64 THEN abs(embedding[i])*100*(1+i/997) + 1 END AS b FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
samples AS (SELECT g AS image_id, 'a' AS method, a::DOUBLE AS value, 1.0::DOUBLE AS weight FROM p UNION ALL SELECT g, 'b', b::DOUBLE, 1.0::DOUBLE FROM p WHERE b IS NOT NULL), {dist_sql()},
k AS (SELECT g, count(a) AS na, count(b) AS nb, avg(a) - avg(b) AS dm, quantile_cont(a::DOUBLE, 0.5) - quantile_cont(b::DOUBLE, 0.5) AS dmed, stddev_pop(a) - stddev_pop(b) AS ds, avg(abs(a-b)) AS mae, sqrt(avg((a-b)*(a-b))) AS rmse, max(abs(a-b)) AS mx, quantile_cont((abs(a-b)/b)::DOUBLE, 0.9) AS p90, avg(b) AS mb FROM p GROUP BY g)
SELECT g AS label, na AS n_a, nb AS n_b, round(dm, 5) AS d_mean, round(dmed, 5) AS d_median, round(ds, 5) AS d_std, round(w1u, 5) AS wasserstein, round(ks, 9) AS ks, round(CASE WHEN na = nb THEN mx END, 4) AS max_aligned, round(CASE WHEN na = nb THEN mae ELSE abs(dm) END, 5) AS mae,
  round(CASE WHEN na = nb THEN rmse ELSE abs(dm) END, 5) AS rmse, round(CASE WHEN na = nb THEN p90 ELSE abs(dm)/mb END, 5) AS p90 FROM k JOIN dd ON dd.image_id = k.g""".replace("embedding[i])*100", "embedding[i]::DOUBLE)*100").replace("i/997", "i/997.0::DOUBLE"))
def a18(spark, sf):
    e = bind.table(spark, sf, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("p", "v"))
    i = c("p") + 1
    v = F.abs(c("v").cast("double")) * 100
    a = e.select("label", (c("vec_id") * 64 + i).alias("pos"), LIT("a").alias("side"), (v + 1).alias("value"))
    b = e.where((c("label") % 3 > 0) | (i < 64)).select("label", (c("vec_id") * 64 + i).alias("pos"), LIT("b").alias("side"), (v * (1 + i / 997.0) + 1).alias("value"))
    d = parity.diameter_parity(a.unionByName(b), ["label"], "side", ("a", "b"), "value", "pos")
    return d.select("label", "n_a", "n_b", r("difference_of_mean", 5).alias("d_mean"), r("difference_of_median", 5).alias("d_median"), r("difference_of_std", 5).alias("d_std"), r("wasserstein", 5).alias("wasserstein"), r("ks", 9).alias("ks"),
                    r("max_aligned_difference", 4).alias("max_aligned"), r("mae", 5).alias("mae"), r("rmse", 5).alias("rmse"), r("p90_relative", 5).alias("p90"))


@query("a19_parity_summaries", """
WITH s AS (SELECT image_id, method, count(*) AS n, round(avg(value), 8) AS mean, round(coalesce(stddev_samp(value), 0), 8) AS std, round(quantile_cont(value, 0.25), 8) AS p25, round(quantile_cont(value, 0.95), 8) AS p95 FROM samples GROUP BY ALL) SELECT * FROM s""", "samples")
def a19(spark, sf):
    s = parity.side_summary(bind.samples(spark, sf), ["image_id"], "method", "value")
    return s.select("image_id", "method", "n", *[r(k, 8).alias(k) for k in ("mean", "std", "p25", "p95")])


@query("a19_histogram_fit_parity", """
WITH l AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x*10)::BIGINT) AS a, embedding[1]::DOUBLE AS f, embedding[64]::DOUBLE AS g FROM embeddings),
m AS (SELECT *, CASE WHEN vec_id % 4 = 0 THEN list_slice(a, 1, 63) WHEN vec_id % 3 = 0 THEN list_transform(a, lambda x, i: CASE WHEN i % 9 = vec_id % 9 THEN x + i ELSE x END) ELSE a END AS b FROM l)
SELECT vec_id, len(a) AS left_bins, len(b) AS right_bins, a = b AS counts_equal, CASE WHEN len(a) = len(b) THEN list_max(list_transform(a, lambda x, i: abs(x - b[i])))::DOUBLE END AS counts_max, round(abs(f - g), 9) AS fit_abs, round(abs(f - g)/abs(f), 5) AS fit_rel FROM m""")
def a19b(spark, sf):
    e = bind.table(spark, sf, "embeddings")
    counts = F.transform("embedding", lambda x: F.floor(x * 10))
    left = e.select("vec_id", counts.alias("counts"), F.array(LIT(0.0)).alias("edges"))
    other = F.when(c("vec_id") % 4 == 0, F.slice(counts, 1, 63)).when(c("vec_id") % 3 == 0, F.transform(counts, lambda x, i: F.when((i + 1) % 9 == c("vec_id") % 9, x + i + 1).otherwise(x))).otherwise(counts)
    h = parity.histogram_parity(left, e.select("vec_id", other.alias("counts"), F.array(LIT(0.0)).alias("edges")), ["vec_id"])
    first, last = (F.element_at("embedding", i).cast("double") for i in (1, 64))
    fit = e.select("vec_id", parity.fit_parity(first, last).alias("f"))
    return h.join(fit, "vec_id").select("vec_id", "left_bins", "right_bins", "counts_equal", c("counts_max_difference").alias("counts_max"), r("f.absolute", 9).alias("fit_abs"), r("f.relative", 5).alias("fit_rel"))


@query("a20_error_rollup", """
WITH e AS (SELECT l_suppkey % 10 AS run, l_linestatus = 'F' AS o, 100*abs(l_discount - l_tax) + l_quantity/37 AS e FROM lineitem)
SELECT run, count(*) AS cases, round(avg(e) FILTER (o), 9) AS mean_ordered, round(avg(e) FILTER (NOT o), 9) AS mean_disordered, round(quantile_cont(e, 0.5), 9) AS median_error, round(quantile_cont(e, 0.9), 9) AS p90_error, round(max(e), 9) AS max_error, round(avg((e <= 10)::INT), 9) AS within_10,
  quantile_cont(e, 0.5) <= 5 AND quantile_cont(e, 0.9) <= 10 AS gate_passed FROM e GROUP BY run""")
def a20(spark, sf):
    e = bind.table(spark, sf, "lineitem").select((c("l_suppkey") % 10).alias("run"), (c("l_linestatus") == "F").alias("o"), (100 * F.abs(c("l_discount") - c("l_tax")) + c("l_quantity") / 37).alias("e"))
    x = parity.error_rollup(e, "e", "o", ["run"])
    return x.select("run", "cases", *[r(k, 9).alias(k) for k in ("mean_ordered", "mean_disordered", "median_error", "p90_error", "max_error", "within_10")], "gate_passed")


@query("a35_gaussian_center")
def a35(spark, sf):
    s = bind.samples(spark, sf).select("image_id", "value").withColumn("one", LIT(1.0))
    h = D.weighted_histogram(s, ["image_id"], [], "value", "one", D.scott_edges(s, ["image_id"], "value").drop("width"))
    h = h.withColumn("center", (c("left_edge") + c("right_edge")) / 2)
    return fitting.fit_histograms(h, ["image_id"]).select("image_id", r("a1", 3).alias("a1"), r("b1", 3).alias("b1"), r("c1", 3).alias("c1"))


@query("x01_method_plugin", """
SELECT image_id, method, count(*) AS n, round(sum(weight*value)/sum(weight), 8) AS weighted_mean, round(max(value), 6) AS top FROM samples GROUP BY ALL""", "samples")
def x01(spark, sf):
    import pandas as pd

    def partial(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"image_id": p.image_id.iloc[0], "method": p.method.iloc[0], "n": len(p), "wx": (p.weight * p.value).sum(), "w": p.weight.sum(), "top": p.value.max()}])

    def combine(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"image_id": p.image_id.iloc[0], "method": p.method.iloc[0], "n": p.n.sum(), "wx": p.wx.sum(), "w": p.w.sum(), "top": p.top.max()}])

    def merge(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"image_id": p.image_id.iloc[0], "method": p.method.iloc[0], "n": p.n.sum(), "weighted_mean": p.wx.sum() / p.w.sum(), "top": p.top.max()}])

    s = bind.samples(spark, sf).select("image_id", "method", "value", "weight")
    out = plugins.run_method(s, ["image_id", "method"], partial, merge, "image_id long, method string, n long, wx double, w double, top double", "image_id long, method string, n long, weighted_mean double, top double", combine=combine, rows_per_block=100)
    return out.select("image_id", "method", "n", r("weighted_mean", 8).alias("weighted_mean"), r("top").alias("top"))


