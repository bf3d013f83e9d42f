"""Row-level queries: record rules, geometry, flags, sample rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from filamet import schemas as S
from filamet.functions import geometry as G
from filamet.functions import records as R
from filamet.functions import samples as P
from filamet.plans import bind
from filamet.plans.registry import query, r

c = F.col


def _p1():
    return G.point(c("x1"), c("y1"))


def _p2():
    return G.point(c("x2"), c("y2"))


def _values():
    none = F.lit(None).cast("double")
    return F.struct(
        c("length_m"), c("width_m"), (c("width_m") * 2).alias("total_length_m"), none.alias("interior_angle_deg"),
        none.alias("area_m2"), none.alias("main_reported_value_m"),
    )


def _primary():
    return R.primary_value(c("kind"), _values())


PRIMARY_SQL = """CASE WHEN kind IN ('PROJECTED_WIDTH','DISTANCE') THEN coalesce(nullif(length_m, 0), width_m)
                      WHEN kind = 'POLYLINE_LENGTH' THEN width_m * 2 END"""


@query("p01_included", """
SELECT image_id, count(*) AS n_included FROM measurements
WHERE status IN ('ACCEPTED','MANUALLY_EDITED') GROUP BY image_id""", "measurements")
def p01(spark, sf):
    return bind.measurements(spark, sf).where(R.is_included(c("status"))).groupBy("image_id").agg(F.count(F.lit(1)).alias("n_included"))


@query("p02_primary_value", f"""
SELECT measurement_id, kind, round({PRIMARY_SQL} * 1e9, 3) AS value_nm, 'm' AS unit FROM measurements""", "measurements")
def p02(spark, sf):
    return bind.measurements(spark, sf).select(
        "measurement_id", "kind", r(_primary() * 1e9, 3).alias("value_nm"), R.primary_unit(c("kind")).alias("unit")
    )


@query("p03_endpoints", """
WITH pts AS (
  SELECT measurement_id, CASE WHEN kind <> 'DISTANCE' THEN x1 END AS ex, x1, y1, x2, y2, kind FROM measurements)
SELECT measurement_id, round(CASE WHEN kind = 'POLYLINE_LENGTH' THEN 0.0 ELSE x1 END, 4) AS ax,
       round(CASE WHEN kind = 'POLYLINE_LENGTH' THEN 0.0 ELSE y2 END, 4) AS by_,
       round(CASE WHEN kind = 'POLYLINE_LENGTH' THEN 0.0 ELSE (x1 + x2) / 2 END, 4) AS cx
FROM pts""", "measurements")
def p03(spark, sf):
    # widths store p1/p2, distances store a point list, polylines store neither here
    explicit = c("kind") == "PROJECTED_WIDTH"
    ends = R.endpoints(
        F.when(explicit, _p1()), F.when(explicit, _p2()), F.when(c("kind") == "DISTANCE", F.array(_p1(), _p1(), _p2())).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
    )
    return bind.measurements(spark, sf).withColumn("e", ends).select(
        "measurement_id", r("e.p1.x", 4).alias("ax"), r("e.p2.y", 4).alias("by_"), r("e.center.x", 4).alias("cx")
    )


@query("p04_search", """
SELECT measurement_id, status FROM measurements
WHERE kind = 'PROJECTED_WIDTH'
  AND contains(lower(concat_ws(' ', measurement_id, 'Width ' || fiber_id, kind, source, status, fiber_id, 'bead ' || sample_id, '')), 'f00')
  AND contains(lower(concat_ws(' ', measurement_id, 'Width ' || fiber_id, kind, source, status, fiber_id, 'bead ' || sample_id, '')), 'manual')""", "measurements")
def p04(spark, sf):
    m = bind.measurements(spark, sf)
    kw = dict(
        measurement_id=c("measurement_id"), name=F.concat(F.lit("Width "), c("fiber_id")), kind=c("kind"), source=c("source"),
        status=c("status"), fiber_id=c("fiber_id"), tags=F.array(F.lit("bead"), c("sample_id").cast("string")), flags=F.array().cast("array<string>"),
    )
    return m.where(R.matches_search("F00", want_kind="PROJECTED_WIDTH", **kw) & R.matches_search("manual", **kw)).select("measurement_id", "status")


@query("p05_sample_filter", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_discount >= 0.04 AND l_tax > 0 AND l_linestatus = 'F'""")
def p05(spark, sf):
    li = bind.table(spark, sf, "lineitem")
    accepted = c("l_linestatus") == "F"
    flags = F.when(c("l_tax") > 0, "HIGH_ASYMMETRY").otherwise(" ")
    return li.where(
        R.sample_passes(c("l_discount"), accepted, flags, min_coherence=0.04, mode="flagged")
        & R.sample_passes(c("l_discount"), accepted, flags, mode="accepted")
    ).select("l_orderkey", "l_linenumber", "l_partkey")


@query("p06_calibrated_width", """
SELECT measurement_id,
  round(CASE WHEN image_id % 7 <> 0 THEN sqrt(pow((x2 - x1) * px, 2) + pow((y2 - y1) * py, 2)) * 1e9 END, 5) AS width_nm,
  CASE WHEN image_id % 7 = 0 THEN 'CALIBRATION_NOT_POSITIVE' END AS problem FROM measurements""", "measurements")
def p06(spark, sf):
    px = F.when(c("image_id") % 7 == 0, 0.0).otherwise(c("px"))
    return bind.measurements(spark, sf).select(
        "measurement_id", r(G.calibrated_width(_p1(), _p2(), px, c("py")) * 1e9, 5).alias("width_nm"), G.width_problem(_p1(), _p2(), px, c("py")).alias("problem")
    )


BEARING_SQL = "(degrees(atan2({dy}, {dx})) + 720.0) % 360.0"


@query("p07_line_geometry", """
SELECT measurement_id, round(sqrt(pow((x2-x1)*px,2)+pow((y2-y1)*py,2))*1e9, 5) AS length_nm,
  round(sqrt(pow(x2-x1,2)+pow(y2-y1,2)), 6) AS length_px, round((x2-x1)*px*1e9, 6) AS dx_nm, round((y2-y1)*py*1e9, 6) AS dy_nm,
  round((degrees(atan2((y2-y1)*py, (x2-x1)*px)) + 720.0) % 360.0, 6) AS orientation_deg,
  round((x1+x2)/2, 6) AS cx, round((y1+y2)/2, 6) AS cy FROM measurements""", "measurements")
def p07(spark, sf):
    return bind.measurements(spark, sf).withColumn("g", G.line_geometry(_p1(), _p2(), c("px"), c("py"))).select(
        "measurement_id", r(c("g.length_m") * 1e9, 5).alias("length_nm"), r("g.length_px").alias("length_px"),
        r(c("g.delta_x_m") * 1e9).alias("dx_nm"), r(c("g.delta_y_m") * 1e9).alias("dy_nm"),
        r("g.orientation_deg").alias("orientation_deg"), r("g.center_x").alias("cx"), r("g.center_y").alias("cy"),
    )


@query("p08_polyline_geometry", """
WITH pts AS (SELECT *, x2 AS x3, y1 AS y3, l.n AS n FROM measurements, (SELECT 4 AS n) l),
len AS (SELECT measurement_id,
  sqrt(pow((x2-x1)*px,2)+pow((y2-y1)*py,2)) AS l1, sqrt(pow((x3-x2)*px,2)+pow((y3-y2)*py,2)) AS l2,
  sqrt(pow((x1-x3)*px,2)+pow((y1-y3)*py,2)) AS l3, kind, x1,x2,x3,y1,y2,y3,px,py FROM pts)
SELECT measurement_id, CASE kind WHEN 'DISTANCE' THEN 3 WHEN 'POLYLINE_LENGTH' THEN 2 ELSE 0 END::BIGINT AS segments,
  round(CASE kind WHEN 'DISTANCE' THEN l1+l2+l3 WHEN 'POLYLINE_LENGTH' THEN l1+l2 ELSE 0 END * 1e9, 5) AS total_nm,
  round(CASE kind WHEN 'POLYLINE_LENGTH' THEN l3 ELSE 0 END * 1e9, 5) AS direct_nm,
  round(CASE WHEN kind = 'POLYLINE_LENGTH' AND l3 > 1e-12 THEN (l1+l2)/l3 END, 6) AS tortuosity
FROM len""", "measurements")
def p08(spark, sf):
    p3 = G.point(c("x2"), c("y1"))
    pts = F.when(c("kind") == "DISTANCE", F.array(_p1(), _p2(), p3, _p1())).when(c("kind") == "POLYLINE_LENGTH", F.array(_p1(), _p2(), p3)).otherwise(F.array(_p1()))
    return bind.measurements(spark, sf).withColumn("g", G.polyline_geometry(pts, c("px"), c("py"))).select(
        "measurement_id", c("g.segment_count").alias("segments"), r(c("g.total_length_m") * 1e9, 5).alias("total_nm"),
        r(c("g.direct_distance_m") * 1e9, 5).alias("direct_nm"), r("g.tortuosity").alias("tortuosity"),
    )


@query("p09_angle_geometry", """
WITH v AS (SELECT measurement_id, (x2-x1)*px AS ux, (y2-y1)*py AS uy, 0.0*px AS vx, (confidence-y1)*py AS vy FROM measurements),
l AS (SELECT *, sqrt(ux*ux+uy*uy) AS lu, sqrt(vx*vx+vy*vy) AS lv FROM v),
a AS (SELECT *, CASE WHEN lu >= 1e-12 AND lv >= 1e-12 THEN degrees(acos(greatest(-1.0, least(1.0, (ux*vx+uy*vy)/(lu*lv))))) END AS i FROM l)
SELECT measurement_id, round(i, 4) AS interior_deg, round(least(i, 180.0 - i), 4) AS acute_deg,
  round(CASE WHEN i IS NOT NULL THEN (degrees(atan2(uy, ux)) + 720.0) % 360.0 END, 5) AS ab_deg FROM a""", "measurements")
def p09(spark, sf):
    g = G.angle_geometry(_p2(), _p1(), G.point(c("x1"), c("confidence")), c("px"), c("py"))
    return bind.measurements(spark, sf).withColumn("g", g).select(
        "measurement_id", r("g.interior_angle_deg", 4).alias("interior_deg"), r("g.acute_angle_deg", 4).alias("acute_deg"), r("g.orientation_ab_deg", 5).alias("ab_deg")
    )


@query("p10_validate_geometry", """
WITH g AS (SELECT measurement_id, x1, y1, x2, y2, sqrt(pow(x2-x1,2)+pow(y2-y1,2)) AS len FROM measurements),
v AS (SELECT measurement_id, CASE WHEN NOT (x1 >= 0 AND x1 < 50 AND y1 >= 0 AND y1 < 14) THEN 'P1_OUTSIDE_IMAGE'
  WHEN NOT (x2 >= 0 AND x2 < 50 AND y2 >= 0 AND y2 < 14) THEN 'P2_OUTSIDE_IMAGE'
  WHEN (y1 BETWEEN 9 AND 10) OR (y2 BETWEEN 9 AND 10) THEN 'ENDS_IN_FOOTER'
  WHEN len <= 0 THEN 'NOT_POSITIVE' WHEN len < 2 THEN 'BELOW_MINIMUM' WHEN len > 8 THEN 'ABOVE_MAXIMUM' END AS reason FROM g)
SELECT measurement_id, reason IS NULL AS valid, reason FROM v""", "measurements")
def p10(spark, sf):
    v = G.validate_segment(_p1(), _p2(), F.lit(50), F.lit(14), F.lit(9.0), F.lit(10.0), 2.0, 8.0)
    return bind.measurements(spark, sf).withColumn("v", v).select("measurement_id", c("v.valid").alias("valid"), c("v.reason").alias("reason"))


@query("p11_resolution_class", """
SELECT measurement_id, round(width_m/1e4/px, 12) AS width_px,
  CASE WHEN width_m/1e4/px >= 5 THEN 'RESOLVED' WHEN width_m/1e4/px >= 2.5 THEN 'MARGINAL' ELSE 'UNRESOLVED' END AS resolution,
  CASE WHEN width_m/1e4/px >= 5 THEN NULL WHEN width_m/1e4/px >= 2.5 THEN 'RESOLUTION_MARGINAL' ELSE 'RESOLUTION_INSUFFICIENT' END AS flag
FROM measurements""", "measurements")
def p11(spark, sf):
    m = bind.measurements(spark, sf).withColumn("g", R.resolution_class(c("width_m") / 1e4, c("px")))
    return m.select("measurement_id", r("g.width_px", 12).alias("width_px"), c("g.status").alias("resolution"), c("g.flag").alias("flag"))


@query("p12_quality_flags", f"""
WITH m AS (SELECT *, {PRIMARY_SQL} / 1e4 AS v FROM measurements),
f AS (SELECT measurement_id, CASE WHEN image_id % 3 = 0 THEN ['MANUAL_REFERENCE','Z_KEPT'] ELSE [] END AS old,
  CASE WHEN image_id % 4 = 0 OR confidence < 0.8 THEN 'CALIBRATION_UNVERIFIED' END AS f1,
  CASE WHEN kind IN ('PROJECTED_WIDTH','DISTANCE') THEN CASE WHEN v/px >= 5 THEN NULL WHEN v/px >= 2.5 THEN 'RESOLUTION_MARGINAL' ELSE 'RESOLUTION_INSUFFICIENT' END END AS f2,
  CASE WHEN x1 <= 5 OR x1 >= 45 OR y1 <= 5 OR y1 >= 55 OR x2 <= 5 OR x2 >= 45 OR y2 <= 5 OR y2 >= 55 THEN 'TOUCHES_IMAGE_EDGE' END AS f3,
  CASE WHEN y1 BETWEEN 9 AND 12 OR y2 BETWEEN 9 AND 12 THEN 'TOUCHES_INVALID_MASK' END AS f4,
  CASE WHEN source = 'AUTO_ROI_COMPONENT' AND status = 'PROPOSED' THEN 'AUTOMATIC_NOT_REVIEWED' END AS f5,
  CASE WHEN source = 'MANUAL' THEN 'MANUAL_REFERENCE' END AS f6 FROM m)
SELECT measurement_id, array_to_string(list_sort(list_distinct(list_filter(list_concat(old, [f1,f2,f3,f4,f5,f6]), lambda x: x IS NOT NULL))), ';') AS flags FROM f""", "measurements")
def p12(spark, sf):
    old = F.when(c("image_id") % 3 == 0, F.array(F.lit("MANUAL_REFERENCE"), F.lit("Z_KEPT"))).otherwise(F.array().cast("array<string>"))
    flags = R.quality_flags(
        old, kind=c("kind"), status=c("status"), source=c("source"), value=_primary() / 1e4, points=F.array(_p1(), _p2()), px=c("px"),
        cal_source=F.when(c("image_id") % 4 == 0, "UNVERIFIED").otherwise("METADATA"), cal_confidence=c("confidence"),
        width_px=F.lit(50), height_px=F.lit(60), footer_y0=F.lit(9.0), footer_y1=F.lit(12.0),
    )
    return bind.measurements(spark, sf).select("measurement_id", F.array_join(flags, ";").alias("flags"))


@query("p13_uncertainty", f"""
WITH m AS (SELECT measurement_id, {PRIMARY_SQL} AS v, px, confidence FROM measurements),
u AS (SELECT measurement_id, CASE WHEN v > 0 AND confidence > 0 THEN v * greatest(0.01, 1 - confidence) END AS cal,
  CASE WHEN v > 0 THEN 0.5 * px / sqrt(3.0) END AS edge, CASE WHEN v > 0 AND confidence > 0.5 THEN 2e-9::DOUBLE END AS rep FROM m)
SELECT measurement_id, round(cal*1e9, 4) AS cal_nm, round(edge*1e9, 5) AS edge_nm,
  round(CASE WHEN edge IS NOT NULL THEN sqrt(coalesce(cal*cal,0)+edge*edge+coalesce(rep*rep,0)) END * 1e9, 4) AS combined_nm,
  CASE WHEN edge IS NULL THEN 'NONE' ELSE 'INDEPENDENT_QUADRATURE' END AS method FROM u""", "measurements")
def p13(spark, sf):
    u = R.uncertainty(_primary(), c("px"), c("confidence"), F.when(c("confidence") > 0.5, 2e-9))
    return bind.measurements(spark, sf).withColumn("u", u).select(
        "measurement_id", r(c("u.calibration_m") * 1e9, 4).alias("cal_nm"), r(c("u.edge_localization_m") * 1e9, 5).alias("edge_nm"),
        r(c("u.combined_standard_m") * 1e9, 4).alias("combined_nm"), c("u.method").alias("method"),
    )


@query("p14_resolution_preset", """
WITH d(preset, expected_width_px, min_area_px) AS (VALUES ('HIGH_MAG_FINE', 30.0::DOUBLE, 80), ('MID_MAG_GENERAL', 12.0::DOUBLE, 40), ('LOW_MAG_NETWORK', 3.0::DOUBLE, 20)),
i AS (SELECT image_id, CASE WHEN px*3e9 <= 10 THEN 'HIGH_MAG_FINE' WHEN px*3e9 <= 80 THEN 'MID_MAG_GENERAL' ELSE 'LOW_MAG_NETWORK' END AS preset FROM images)
SELECT image_id, i.preset, expected_width_px, min_area_px FROM i JOIN d USING (preset)""", "images")
def p14(spark, sf):
    i = bind.images(spark, sf).select("image_id", R.resolution_preset(c("px") * 3).alias("preset"))
    # three rows by definition, so always small enough to broadcast
    return i.join(F.broadcast(S.resolution_presets(spark)), "preset").select("image_id", "preset", "expected_width_px", "min_area_px")


@query("p15_resolvability", """
SELECT image_id, CASE WHEN 3e-7/(px*2) < 3.5 OR px*2e9 > 85 THEN 'RESOLUTION_INSUFFICIENT'
  WHEN 3e-7/(px*2) < 7 OR price/1000 < 1 THEN 'RESOLUTION_MARGINAL' ELSE 'RESOLUTION_OK' END AS resolution FROM images""", "images")
def p15(spark, sf):
    return bind.images(spark, sf).select("image_id", R.resolvability(c("px") * 2, c("price") / 1000).alias("resolution"))


@query("p16_unit_to_metres", """
WITH e AS (SELECT event_id, value, CASE event_type WHEN 'view' THEN 'nm' WHEN 'signup' THEN ' UM ' WHEN 'error' THEN 'parsec' WHEN 'click' THEN 'μm' END AS unit FROM events)
SELECT event_id, round(value * CASE WHEN unit = 'nm' THEN 1e-9::DOUBLE WHEN unit = ' UM ' THEN 1e-6::DOUBLE WHEN unit = 'μm' THEN 1e-6::DOUBLE WHEN unit IS NULL THEN 1.0::DOUBLE END * 1e9, 2) AS nm,
  coalesce(unit, 'm') <> 'parsec' AS known FROM e""")
def p16(spark, sf):
    t = c("event_type")
    unit = F.when(t == "view", "nm").when(t == "signup", " UM ").when(t == "error", "parsec").when(t == "click", "μm")
    e = bind.table(spark, sf, "events").withColumn("unit", unit)
    return e.select("event_id", r(R.to_metres(c("value"), c("unit")) * 1e9, 2).alias("nm"), R.unit_known(c("unit")).alias("known"))


@query("p17_field_cross_check", """
SELECT image_id, round(abs(px*width_px - price*1e-9)/(price*1e-9), 6) AS dev_x, round(abs(py*height_px - price*1e-9)/(price*1e-9), 6) AS dev_y FROM images""", "images")
def p17(spark, sf):
    field = c("price") * 1e-9
    return bind.images(spark, sf).select(
        "image_id", r(F.abs(c("px") * c("width_px") - field) / field).alias("dev_x"), r(F.abs(c("py") * c("height_px") - field) / field).alias("dev_y")
    )


@query("p18_length_text", """
SELECT measurement_id, CASE WHEN v >= 1e-3 THEN printf('%.3f mm', v*1e3) ELSE printf('%.1f nm', v*1e9) END AS text
FROM (SELECT measurement_id, round(width_m*1e9)*1e-9::DOUBLE * CASE WHEN image_id % 2 = 0 THEN 20000.0::DOUBLE ELSE 1.0::DOUBLE END AS v FROM measurements)""", "measurements")
def p18(spark, sf):
    v = F.round(c("width_m") * 1e9) * 1e-9 * F.when(c("image_id") % 2 == 0, 20000.0).otherwise(1.0)
    return bind.measurements(spark, sf).select("measurement_id", R.length_text(v).alias("text"))


@query("p19_normalize_tags", """
WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(lang || ', ' || source || ',' || upper(lang) || ' ,,' || lower(source), ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents)
SELECT doc_id, array_to_string(list_filter(parts, lambda x, i: list_position(list_transform(parts, lambda y: lower(y)), lower(x)) = i), '|') AS tags FROM t""")
def p19(spark, sf):
    d = bind.table(spark, sf, "documents")
    tags = F.array(F.concat_ws(", ", "lang", "source"), F.concat(F.upper("lang"), F.lit(" ,")), F.lit(None).cast("string"), F.lower("source"))
    return d.select("doc_id", F.array_join(R.normalize_tags(tags), "|").alias("tags"))


@query("p20_axis_code", """
SELECT event_id, round(round(cos(2*value), 12), 9) + 0.0 AS qx, round(round(sin(2*value), 12), 9) + 0.0 AS qy FROM events""")
def p20(spark, sf):
    return bind.table(spark, sf, "events").withColumn("q", P.axis_code(c("value"))).select("event_id", r("q.qx", 9).alias("qx"), r("q.qy", 9).alias("qy"))


@query("p21_sample_contract", """
WITH s AS (SELECT image_id, method, CASE WHEN ord3 % 97 = 0 THEN -value ELSE value END AS v, CASE WHEN ord3 % 89 = 0 THEN 'NaN'::DOUBLE ELSE weight END AS w,
  CASE WHEN ord2 = 7 AND ord3 % 5 = 0 THEN '' ELSE 'um' END AS unit FROM samples),
p AS (SELECT *, CASE WHEN v < 0 THEN 'VALUE_INVALID' WHEN isnan(w) THEN 'WEIGHT_INVALID' WHEN unit = '' THEN 'UNIT_MISSING' END AS problem FROM s)
SELECT image_id, method, count(*) AS n, count(problem) AS n_broken, count(*) FILTER (problem = 'WEIGHT_INVALID') AS n_weight,
  bool_or(problem IS NULL AND w > 0) AS has_positive_weight, count(DISTINCT CASE WHEN unit <> '' THEN unit END) <= 1 AS one_unit FROM p GROUP BY ALL""", "samples")
def p21(spark, sf):
    s = bind.samples(spark, sf).select(
        "image_id", "method", F.when(c("ord3") % 97 == 0, -c("value")).otherwise(c("value")).alias("v"),
        F.when(c("ord3") % 89 == 0, float("nan")).otherwise(c("weight")).alias("w"),
        F.when((c("ord2") == 7) & (c("ord3") % 5 == 0), "").otherwise("um").alias("unit"),
    ).withColumn("problem", P.contract_problem(c("v"), c("w"), c("unit")))
    named = F.when(c("unit") != "", c("unit"))
    return s.groupBy("image_id", "method").agg(
        F.count(F.lit(1)).alias("n"), F.count("problem").alias("n_broken"), F.count_if(c("problem") == "WEIGHT_INVALID").alias("n_weight"),
        F.bool_or(c("problem").isNull() & (c("w") > 0)).alias("has_positive_weight"),
        F.coalesce(F.min(named) == F.max(named), F.lit(True)).alias("one_unit"),
    )


@query("p21_result_contract", """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE 'v' || o_orderstatus END AS version, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN o_totalprice/400000 ELSE o_totalprice/100000 END AS conf,
  CASE WHEN o_orderkey % 23 = 0 THEN -1 ELSE o_custkey END::DOUBLE AS runtime, CASE o_orderstatus WHEN 'P' THEN ['um', 'nm'] WHEN 'O' THEN ['um'] ELSE NULL END AS units FROM orders)
SELECT o_orderkey, CASE WHEN version = '' THEN 'REQUIRED_FIELD_MISSING' WHEN conf IS NOT NULL AND NOT (conf >= 0 AND conf <= 1) THEN 'CONFIDENCE_OUT_OF_RANGE' WHEN runtime < 0 THEN 'RUNTIME_NEGATIVE' WHEN list_contains(units, 'nm') THEN 'UNIT_MISMATCH' END AS problem FROM o""")
def p21_result(spark, sf):
    k = c("o_orderkey")
    units = F.when(c("o_orderstatus") == "P", F.array(F.lit("um"), F.lit("nm"))).when(c("o_orderstatus") == "O", F.array(F.lit("um")))
    version = F.when(k % 41 == 0, "").otherwise(F.concat(F.lit("v"), c("o_orderstatus")))
    confidence = F.when(k % 5 == 1, c("o_totalprice") / 400000).when(k % 5 > 0, c("o_totalprice") / 100000)
    runtime = F.when(k % 23 == 0, -1.0).otherwise(c("o_custkey").cast("double"))
    return bind.table(spark, sf, "orders").select("o_orderkey", P.result_problem(version, k, F.lit("um"), confidence, runtime, units).alias("problem"))


@query("p22_capability", """
SELECT conv_id, turn, CASE role WHEN 'user' THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END AS mask_state, 'UNAVAILABLE' AS graph_state, role = 'user' AS supports_mask FROM conversations""")
def p22(spark, sf):
    states = F.create_map(F.when(c("role") == "user", "MASK").otherwise("SKELETON"), F.lit("AVAILABLE"))
    t = bind.table(spark, sf, "conversations").withColumn("m", states)
    return t.select("conv_id", "turn", R.capability(c("m"), "MASK").alias("mask_state"), R.capability(c("m"), "GRAPH").alias("graph_state"), (R.capability(c("m"), "MASK") == "AVAILABLE").alias("supports_mask"))


@query("p23_content_key", """
SELECT image_id, sha256('{"image_sha256":"' || sha256(filename) || '","method_id":"FIELD","parameters":' || CASE WHEN image_id % 3 = 0 THEN 'null' ELSE '"p' || resolution_class || '"' END || ',"roi":[0,0,' || width_px || ',' || height_px || ']}') AS key FROM images""", "images")
def p23(spark, sf):
    return bind.images(spark, sf).select("image_id", R.content_key({
        "image_sha256": F.sha2("filename", 256), "method_id": F.lit("FIELD"), "roi": F.array(F.lit(0).cast("long"), F.lit(0).cast("long"), c("width_px"), c("height_px")),
        "parameters": F.when(c("image_id") % 3 != 0, F.concat(F.lit("p"), c("resolution_class"))),
    }).alias("key"))


@query("p24_review_cell", """
WITH e AS (SELECT user_id, event_id, (event_id % 25) // 5 AS row, event_id % 5 AS col,
  CASE event_type WHEN 'purchase' THEN 'SKIPPED_WITH_REASON' ELSE 'MEASURED' END AS status, CASE WHEN value > 50 THEN ' ' ELSE 'blurred' END AS notes FROM events)
SELECT event_id, 'R' || (row + 1) || 'C' || (col + 1) AS position, CASE WHEN status = 'SKIPPED_WITH_REASON' AND trim(notes) = '' THEN 'REASON_REQUIRED' END AS problem FROM e""")
def p24(spark, sf):
    e = bind.table(spark, sf, "events")
    status = F.when(c("event_type") == "purchase", "SKIPPED_WITH_REASON").otherwise("MEASURED")
    return e.select(
        "event_id", R.cell_position(F.floor(c("event_id") % 25 / 5), c("event_id") % 5).alias("position"),
        R.cell_problem(status, F.when(c("value") > 50, " ").otherwise("blurred")).alias("problem"),
    )


@query("p25_recompute_corrections", f"""
WITH m AS (SELECT image_id, kind, {PRIMARY_SQL} AS old, CASE WHEN sample_id = 0 THEN width_m * (1 + 2e-6) ELSE sqrt(pow((x2-x1)*px,2)+pow((y2-y1)*py,2)) END AS new FROM measurements WHERE kind IN ('PROJECTED_WIDTH','DISTANCE')),
k AS (SELECT image_id, old, new, abs(old-new) > greatest(1e-5*greatest(abs(old),abs(new)), 1e-12) AS changed FROM m)
SELECT image_id, count(*) FILTER (changed) AS corrections, count(*) AS n, round(sum(CASE WHEN changed THEN new ELSE old END)*1e9, 2) AS total_nm FROM k GROUP BY image_id""", "measurements")
def p25(spark, sf):
    m = bind.measurements(spark, sf).where(c("kind").isin(R.WIDTH_KINDS)).withColumns({
        "old": _primary(), "new": F.when(c("sample_id") == 0, c("width_m") * (1 + 2e-6)).otherwise(G.calibrated_width(_p1(), _p2(), c("px"), c("py")))})
    m = m.withColumn("changed", R.differs(c("old"), c("new")))
    return m.groupBy("image_id").agg(
        F.count_if("changed").alias("corrections"), F.count(F.lit(1)).alias("n"), r(F.sum(F.when(c("changed"), c("new")).otherwise(c("old"))) * 1e9, 2).alias("total_nm"))


@query("p26_section_array_stats", """
WITH a AS (SELECT vec_id, list_transform(list_slice(embedding, 1, 32), lambda x: abs(x)::DOUBLE) AS w, list_filter(list_transform(list_slice(embedding, 33, 64), lambda x: CASE WHEN x > 0 THEN x::DOUBLE END), lambda x: x IS NOT NULL) AS d FROM embeddings)
SELECT vec_id, round(list_stddev_pop(w) / list_avg(w), 6) AS cv, round(list_avg(d), 6) AS mean_discrepancy FROM a""")
def p26(spark, sf):
    e = bind.table(spark, sf, "embeddings")
    w = F.transform(F.slice("embedding", 1, 32), lambda x: F.abs(x).cast("double"))
    d = F.transform(F.slice("embedding", 33, 32), lambda x: F.when(x > 0, x.cast("double")))
    return e.select("vec_id", r(R.array_cv(w)).alias("cv"), r(R.array_mean(d)).alias("mean_discrepancy"))


@query("p27_candidate_confidence", """
WITH k AS (SELECT measurement_id, confidence * 8 AS elong, image_id % 5 AS sections, sample_id,
  CASE WHEN x1 < 5 THEN ['TOO_SMALL'] WHEN x1 < 15 THEN ['TOUCHES_ROI_EDGE'] WHEN x1 < 20 THEN ['CURVED_TRACE_USED'] ELSE [] END AS flags FROM measurements),
s AS (SELECT *, CASE WHEN list_contains(flags, 'TOO_SMALL') THEN 0.1 ELSE greatest(0, least(1, (least(1.0, elong/6)*0.4 + sections/5.0*0.4 + 0.2) * CASE WHEN list_contains(flags,'TOUCHES_ROI_EDGE') THEN 0.3 ELSE 1 END)) END::DOUBLE AS score FROM k)
SELECT measurement_id, round(score, 6) AS score, CASE WHEN list_contains(flags,'TOO_SMALL') OR list_contains(flags,'TOUCHES_ROI_EDGE') OR sample_id = 4 THEN 'Baja'
  WHEN round(score, 9) >= 0.7 AND len(flags) = 0 THEN 'Alta' WHEN round(score, 9) >= 0.4 THEN 'Media' ELSE 'Baja' END AS level FROM s""", "measurements")
def p27(spark, sf):
    none = F.array().cast("array<string>")
    flags = F.when(c("x1") < 5, F.array(F.lit("TOO_SMALL"))).when(c("x1") < 15, F.array(F.lit("TOUCHES_ROI_EDGE"))).when(c("x1") < 20, F.array(F.lit("CURVED_TRACE_USED"))).otherwise(none)
    m = bind.measurements(spark, sf).withColumn("flags", flags)
    m = m.withColumn("s", R.candidate_confidence(c("confidence") * 8, c("image_id") % 5, F.lit(5.0), c("flags")))
    preset = F.when(c("sample_id") == 4, "LOW_MAG_NETWORK").otherwise("MID_MAG_GENERAL")
    return m.select("measurement_id", r("s").alias("score"), R.confidence_level(F.round("s", 9), c("flags"), preset).alias("level"))


@query("p28_roi_clamp", """
WITH k AS (SELECT image_id, width_px AS w, CASE WHEN image_id % 2 = 0 THEN height_px - 8 ELSE height_px END AS b, (image_id % 700 - 50) AS x0, (image_id % 500 - 40) AS y0 FROM images),
l AS (SELECT *, greatest(0, least(x0, w-1)) AS cx0, greatest(0, least(y0, b-1)) AS cy0 FROM k)
SELECT image_id, cx0 AS x0, cy0 AS y0, greatest(cx0+1, least(x0+300, w)) AS x1, greatest(cy0+1, least(y0+200, b)) AS y1 FROM l""", "images")
def p28(spark, sf):
    x0, y0 = c("image_id") % 700 - 50, c("image_id") % 500 - 40
    foot = F.when(c("image_id") % 2 == 0, c("height_px") - 8)
    return bind.images(spark, sf).withColumn("b", G.clamp_roi(x0, y0, x0 + 300, y0 + 200, c("width_px"), c("height_px"), foot)).select("image_id", "b.x0", "b.y0", "b.x1", "b.y1")


@query("p29_roi_class", """
SELECT image_id, CASE WHEN px > 4e-8 THEN 'UNSUITABLE_FOR_AUTOMATIC_WIDTH' WHEN image_id % 4 = 0 THEN 'NO_CANDIDATES' WHEN width_px/10 > 40 THEN 'MANUAL_REVIEW_REQUIRED'
  WHEN image_id % 3 > 0 THEN 'USABLE' ELSE 'PARTIALLY_USABLE' END AS roi_class FROM images""", "images")
def p29(spark, sf):
    res = F.when(c("px") > 4e-8, "RESOLUTION_INSUFFICIENT").otherwise("RESOLUTION_OK")
    return bind.images(spark, sf).select("image_id", R.roi_class(res, c("image_id") % 4, c("width_px") / 10, c("image_id") % 3).alias("roi_class"))


def field_samples(spark, sf):
    """Per-sample edge and profile columns built from lineitem."""
    li = bind.table(spark, sf, "lineitem")
    angle = c("l_extendedprice") / 1000
    s = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", c("l_suppkey").alias("image_id"),
        (c("l_quantity") * 1e-6).alias("x_m"), (c("l_partkey") * 1e-8).alias("y_m"), (c("l_discount") * 5).alias("coherence"),
        F.when(c("l_partkey") % 31 == 0, 0.0).otherwise(F.cos(angle)).alias("normal_x"), F.when(c("l_partkey") % 31 == 0, 0.0).otherwise(F.sin(angle)).alias("normal_y"),
        F.when(c("l_partkey") % 13 != 0, (1 + c("l_tax") * 20) * 1e-6).alias("r_minus"), F.when(c("l_partkey") % 17 != 0, (1 + c("l_discount") * 20) * 1e-6).alias("r_plus"),
        (c("l_returnflag") != "R").alias("edge_accepted"), (c("l_linestatus") == "F").alias("profile_accepted"),
        F.when(c("l_partkey") % 11 == 0, "POSSIBLE_CROSSING;AMBIGUOUS_LOCAL_WIDTH").when(c("l_partkey") % 11 == 1, "HIGH_ASYMMETRY").otherwise("").alias("edge_flags"),
        F.when(c("l_partkey") % 7 == 0, "PROFILE_AMBIGUOUS_EDGE").otherwise("").alias("profile_flags"),
        (-1 - c("l_tax") * 10).alias("profile_minus_u_um"), (1 + c("l_discount") * 12).alias("profile_plus_u_um"),
        (c("l_tax") + 0.4).alias("tangent"), (c("l_discount") - 0.01).alias("normal_ok"), (c("l_quantity") / 10 * 1e-6).alias("edt"),
    )
    return s.withColumns({
        "minus_x_m": c("x_m") - c("r_minus") * (c("normal_x") + 0.1), "minus_y_m": c("y_m") - c("r_minus") * c("normal_y"),
        "plus_x_m": c("x_m") + c("r_plus") * (c("normal_x") + 0.4), "plus_y_m": c("y_m") + c("r_plus") * c("normal_y"),
    })


FIELD_SQL = """
WITH f0 AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS image_id, l_quantity*1e-6 AS x_m, l_partkey*1e-8 AS y_m, l_discount*5 AS coherence,
  CASE WHEN l_partkey % 31 = 0 THEN 0.0 ELSE cos(l_extendedprice/1000) END AS nx, CASE WHEN l_partkey % 31 = 0 THEN 0.0 ELSE sin(l_extendedprice/1000) END AS ny,
  CASE WHEN l_partkey % 13 <> 0 THEN (1 + l_tax*20)*1e-6 END AS rm, CASE WHEN l_partkey % 17 <> 0 THEN (1 + l_discount*20)*1e-6 END AS rp,
  l_returnflag <> 'R' AS edge_accepted, l_linestatus = 'F' AS profile_accepted, l_partkey % 11 AS ek, l_partkey % 7 = 0 AS pamb,
  -1 - l_tax*10 AS um, 1 + l_discount*12 AS up, l_tax + 0.4 AS tangent, l_discount - 0.01 AS normal_ok, l_quantity/10*1e-6 AS edt FROM lineitem),
f AS (SELECT *, x_m - rm*(nx+0.1) AS mx, y_m - rm*ny AS my, x_m + rp*(nx+0.4) AS qx, y_m + rp*ny AS qy FROM f0)"""


@query("p30_midpoint_observation", FIELD_SQL + """,
g AS (SELECT *, l_partkey % 31 <> 0 AS okn, coherence < 0.15 AS low, ek = 0 AS abst, sqrt(pow(qx-mx,2)+pow(qy-my,2)) AS mw FROM f),
h AS (SELECT *, okn AND NOT low AND NOT abst AND profile_accepted AND NOT pamb AS pok,
  okn AND NOT low AND NOT abst AND edge_accepted AND mw IS NOT NULL AS mok FROM g),
k AS (SELECT *, CASE WHEN pok THEN 'PROFILE' WHEN mok THEN 'MASK' END AS src,
  CASE WHEN pok THEN (um+up)*0.5e-6*nx WHEN mok THEN (mx+qx)*0.5 - x_m END AS dx, CASE WHEN pok THEN (um+up)*0.5e-6*ny WHEN mok THEN (my+qy)*0.5 - y_m END AS dy,
  CASE WHEN pok THEN (up-um) WHEN mok THEN mw*1e6 END AS w FROM h)
SELECT l_orderkey, l_linenumber, l_partkey, src AS midpoint_source, round(sqrt(dx*dx+dy*dy)*1e6, 5) AS shift_um, round((dx*nx+dy*ny)*1e6, 5) + 0.0 AS signed_um,
  round((dx*ny-dy*nx)*1e6, 5) + 0.0 AS tangential_um, round(w, 5) AS width_um,
  CASE WHEN edge_accepted AND NOT abst AND NOT low THEN greatest(0, least(1, round(coherence, 6))) ELSE 0 END::DOUBLE AS confidence,
  coalesce(abs((dx*ny-dy*nx)*1e6) > 0.5*w, false) AS mismatch FROM k""")
def p30(spark, sf):
    o = P.midpoint_observations(field_samples(spark, sf))
    return o.select(
        "l_orderkey", "l_linenumber", "l_partkey", "midpoint_source", r("shift_um", 5).alias("shift_um"), r("signed_normal_shift_um", 5).alias("signed_um"),
        r("tangential_shift_um", 5).alias("tangential_um"), r("width_um", 5).alias("width_um"), r("refine_confidence").alias("confidence"),
        F.array_contains("midpoint_flags", "MIDPOINT_TANGENTIAL_MISMATCH").alias("mismatch"),
    )


@query("p31_paired_edge_quality", FIELD_SQL + """,
g AS (SELECT *, rm+rp AS d, abs(rp-rm)/(rm+rp) AS asym FROM f),
h AS (SELECT *, list_filter([CASE WHEN rp IS NULL THEN 'MISSING_POSITIVE_EDGE' END, CASE WHEN rm IS NULL THEN 'MISSING_NEGATIVE_EDGE' END, CASE WHEN coherence < 0.15 THEN 'LOW_ORIENTATION_COHERENCE' END,
  CASE WHEN asym > 0.5 THEN 'HIGH_ASYMMETRY' END, CASE WHEN tangent < 0.5 THEN 'EDGE_TANGENT_MISMATCH' END, CASE WHEN normal_ok < 0 THEN 'EDGE_NORMAL_MISMATCH' END,
  CASE WHEN d/edt < 0.5 OR d/edt > 2 THEN 'POSSIBLE_CROSSING' END], lambda x: x IS NOT NULL) AS fl FROM g),
k AS (SELECT *, list_has_any(fl, ['LOW_ORIENTATION_COHERENCE','HIGH_ASYMMETRY','POSSIBLE_CROSSING','EDGE_NORMAL_MISMATCH']) AS amb FROM h)
SELECT l_orderkey, l_linenumber, l_partkey, round(d*1e6, 6) AS diameter_um, round(asym, 6) AS asymmetry, coalesce(d > 0, false) AND NOT amb AS accepted,
  array_to_string(CASE WHEN amb THEN list_append(fl, 'AMBIGUOUS_LOCAL_WIDTH') ELSE fl END, ';') AS flags FROM k""")
def p31(spark, sf):
    q = P.paired_edge_quality(c("r_minus"), c("r_plus"), c("coherence"), c("tangent"), c("normal_ok"), c("edt"))
    return field_samples(spark, sf).withColumn("q", q).select(
        "l_orderkey", "l_linenumber", "l_partkey", r(c("q.diameter") * 1e6).alias("diameter_um"), r("q.asymmetry").alias("asymmetry"),
        c("q.accepted").alias("accepted"), F.array_join("q.flags", ";").alias("flags"))


@query("p32_edge_derived", FIELD_SQL + """
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN rm IS NOT NULL AND rp IS NOT NULL THEN 2*least(rm, rp) END*1e6, 6) AS d_min_um, round(abs(rp-rm)*1e6, 6) AS imbalance_um FROM f""")
def p32(spark, sf):
    d = P.edge_derived(c("r_minus"), c("r_plus"))
    both = c("r_minus").isNotNull() & c("r_plus").isNotNull()
    return field_samples(spark, sf).withColumn("d", d).select(
        "l_orderkey", "l_linenumber", "l_partkey", r(F.when(both, c("d.d_min")) * 1e6).alias("d_min_um"), r(c("d.imbalance") * 1e6).alias("imbalance_um"))


@query("p33_profile_quality", FIELD_SQL + """,
u AS (SELECT *, CASE WHEN l_partkey % 19 = 0 THEN NULL WHEN l_partkey % 23 = 0 THEN 5.0 ELSE um END AS u0 FROM f),
d AS (SELECT *, up - u0 AS d FROM u),
g AS (SELECT *, list_filter([CASE WHEN pamb THEN 'PROFILE_AMBIGUOUS_EDGE' END, CASE WHEN u0 IS NULL THEN 'PROFILE_EDGE_MINUS_NOT_FOUND' END, CASE WHEN NOT coalesce(d > 0, false) THEN 'PROFILE_NONPOSITIVE_WIDTH' END], lambda x: x IS NOT NULL) AS fl FROM d),
k AS (SELECT *, edge_accepted AND coalesce(d > 0, false) AND NOT pamb AS ok FROM g)
SELECT l_orderkey, l_linenumber, l_partkey, round(d, 6) AS diameter_um, round(u0 + rm*1e6, 6) + 0.0 AS minus_shift_um, ok AS accepted,
  array_to_string(CASE WHEN NOT ok AND len(fl) = 0 THEN ['PROFILE_REJECTED_FROM_PAIRED_EDGE'] ELSE fl END, ';') AS flags FROM k""")
def p33(spark, sf):
    u = F.when(c("l_partkey") % 19 == 0, F.lit(None).cast("double")).when(c("l_partkey") % 23 == 0, 5.0).otherwise(c("profile_minus_u_um"))
    q = P.profile_quality(u, c("profile_plus_u_um"), c("r_minus") * 1e6, c("r_plus") * 1e6, c("edge_accepted"), P.split_flags(c("profile_flags")))
    return field_samples(spark, sf).withColumn("q", q).select(
        "l_orderkey", "l_linenumber", "l_partkey", r("q.diameter").alias("diameter_um"), r("q.minus_shift").alias("minus_shift_um"), c("q.accepted").alias("accepted"), F.array_join("q.flags", ";").alias("flags"))


@query("p34_split_flags", """
SELECT page_id, len(p)::BIGINT AS n_parts, p[1] AS first_part FROM (SELECT page_id, list_filter(string_split(html, ';'), lambda x: x <> '') AS p FROM pages)""")
def p34(spark, sf):
    return bind.table(spark, sf, "pages").withColumn("p", P.split_flags(c("html"))).select("page_id", F.size("p").cast("long").alias("n_parts"), F.try_element_at("p", F.lit(1)).alias("first_part"))


@query("p35_number_hygiene", """
SELECT event_id, CASE WHEN event_type = 'error' OR event_type = 'click' THEN NULL ELSE round_even(value/3, 6) END AS clean FROM events""")
def p35(spark, sf):
    x = F.when(c("event_type") == "error", float("nan")).when(c("event_type") == "click", float("inf")).otherwise(c("value") / 3)
    return bind.table(spark, sf, "events").select("event_id", R.clean_number(x).alias("clean"))


@query("p36_axis_disagreement", FIELD_SQL + """
SELECT l_orderkey, l_linenumber, l_partkey, round(degrees(acos(greatest(0.0, least(1.0, abs(nx*cos(0.5*atan2(l_linenumber-3, coherence+0.05)) + ny*sin(0.5*atan2(l_linenumber-3, coherence+0.05))))))), 4) AS axis_deg FROM f""")
def p36(spark, sf):
    a = P.axis_disagreement_deg(c("normal_x"), c("normal_y"), c("coherence") + 0.05, (c("l_linenumber") - 3).cast("double"))
    return field_samples(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", r(a, 4).alias("axis_deg"))


# --- fixed values: report label of each estimator -------------------------------------------
ESTIMATOR_LABELS = [("A", "common", "Raw EDT"), ("N", "common", "Raw Edge"), ("R", "native", "Manual")]


@query("p37_series_names", """
WITH d(method, variant, label) AS (VALUES ('A','common','Raw EDT'),('N','common','Raw Edge'),('R','native','Manual'))
SELECT image_id, label, variant, count(*) AS n FROM samples JOIN d USING (method) GROUP BY ALL""", "samples")
def p37(spark, sf):
    d = spark.createDataFrame(ESTIMATOR_LABELS, "method string, variant string, label string")
    # three rows by definition
    return bind.samples(spark, sf).groupBy("image_id", "method").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(d), "method").select("image_id", "label", "variant", "n")


@query("p37_display_series", """
WITH s AS (SELECT image_id, method, CASE WHEN ord2 <= 2 THEN 'common' WHEN ord2 <= 4 THEN 'native' WHEN ord2 = 5 THEN 'EDGE' ELSE 'PROFILE' END AS variant FROM samples),
d(method, variant, label, pos) AS (VALUES ('A','common','Field EDT',1),('A','EDGE','Field Edge',2),('A','PROFILE','Field Profile',3),('R','native','Manual',4))
SELECT image_id, label, pos::BIGINT AS position, count(*) AS n FROM s JOIN d USING (method, variant) GROUP BY ALL""", "samples")
def p37_display(spark, sf):
    # A has estimators of its own, R is the manual reference, N is an external result that is never shown
    variant = F.when(c("ord2") <= 2, "common").when(c("ord2") <= 4, "native").when(c("ord2") == 5, "EDGE").otherwise("PROFILE")
    s = bind.samples(spark, sf).select("image_id", "method", variant.alias("variant"))
    rules = P.series_rules(spark, [("A", "Field EDT", [("EDGE", "Field Edge"), ("PROFILE", "Field Profile")]), ("R", "Manual", [])], manual="R", skip=["N"])
    return P.display_series(s, rules).groupBy("image_id", "label", "position").agg(F.count(F.lit(1)).alias("n"))


@query("p38_protocol_rules", """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'NOPE' WHEN o_orderkey % 5 = 1 THEN 'DISTANCE' ELSE 'PROJECTED_WIDTH' END AS kind,
  CASE o_orderstatus WHEN 'F' THEN ['ACCEPTED','bogus'] WHEN 'O' THEN ['bogus'] ELSE ['PROPOSED','REJECTED'] END AS st,
  CASE WHEN o_orderkey % 3 = 0 THEN 'PVDF_3_SECTIONS' ELSE 'PVDF_5_SECTIONS' END AS protocol_id FROM orders)
SELECT o_orderkey, CASE WHEN kind = 'NOPE' THEN 'PROJECTED_WIDTH' ELSE kind END AS kind,
  array_to_string(CASE WHEN len(list_filter(st, lambda x: x <> 'bogus')) = 0 THEN ['ACCEPTED','MANUALLY_EDITED'] ELSE list_filter(st, lambda x: x <> 'bogus') END, ',') AS allowed,
  CASE protocol_id WHEN 'PVDF_3_SECTIONS' THEN 3 ELSE 5 END AS sections FROM o""")
def p38(spark, sf):
    k = c("o_orderkey") % 5
    kind = F.when(k == 0, "NOPE").when(k == 1, "DISTANCE").otherwise("PROJECTED_WIDTH")
    st = F.when(c("o_orderstatus") == "F", F.array(F.lit("ACCEPTED"), F.lit("bogus"))).when(c("o_orderstatus") == "O", F.array(F.lit("bogus"))).otherwise(F.array(F.lit("PROPOSED"), F.lit("REJECTED")))
    known = F.filter(st, lambda s: s.isin(S.STATUSES))
    o = bind.table(spark, sf, "orders").select(
        "o_orderkey", F.when(kind.isin(S.KINDS), kind).otherwise("PROJECTED_WIDTH").alias("kind"),
        F.array_join(F.when(F.size(known) == 0, F.array(*[F.lit(s) for s in S.INCLUDED_STATUSES])).otherwise(known), ",").alias("allowed"),
        F.when(c("o_orderkey") % 3 == 0, "PVDF_3_SECTIONS").otherwise("PVDF_5_SECTIONS").alias("protocol_id"))
    p = S.protocols(spark).select("protocol_id", c("sections_per_fiber").alias("sections"))
    return o.join(F.broadcast(p), "protocol_id").drop("protocol_id")


@query("p39_measure_by_kind", """
SELECT measurement_id, CASE kind WHEN 'PROJECTED_WIDTH' THEN 'nm' WHEN 'DISTANCE' THEN 'nm' ELSE 'deg' END AS unit,
  round(CASE WHEN kind = 'POLYLINE_LENGTH' THEN CASE WHEN x2 <> x1 THEN degrees(acos(greatest(-1.0, least(1.0, (x2-x1)*(x2-x1)/(sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1))*abs(x2-x1)))))) END
   ELSE sqrt(pow((x2-x1)*px,2)+pow((y2-y1)*py,2))*1e9 END, 4) AS value,
  NULL::VARCHAR AS problem FROM measurements WHERE kind <> 'DISTANCE'
UNION ALL SELECT measurement_id, NULL, NULL, 'KIND_NOT_MEASURABLE' FROM measurements WHERE kind = 'DISTANCE'""", "measurements")
def p39(spark, sf):
    # distances are recast as whole distributions, which this dispatch rejects; polylines as angles
    m = bind.measurements(spark, sf)
    kind = F.when(c("kind") == "DISTANCE", "DIAMETER_DISTRIBUTION").when(c("kind") == "POLYLINE_LENGTH", "ANGLE").otherwise(c("kind"))
    m = m.withColumn("k", kind)
    line = G.line_geometry(_p1(), _p2(), c("px"), c("py"))["length_m"] * 1e9
    angle = G.angle_geometry(_p2(), _p1(), G.point(c("x2"), c("y1")), F.lit(1.0), F.lit(1.0))["interior_angle_deg"]
    return m.select(
        "measurement_id",
        F.when(c("k") == "PROJECTED_WIDTH", "nm").when(c("k") == "ANGLE", "deg").alias("unit"),
        r(F.when(c("k") == "PROJECTED_WIDTH", line).when(c("k") == "ANGLE", angle), 4).alias("value"),
        F.when(c("k") == "DIAMETER_DISTRIBUTION", "KIND_NOT_MEASURABLE").alias("problem"))


@query("p40_threshold_levels", """
SELECT image_id, row, col, u > 0.5 AS foreground, round(round_even(greatest(0.0, least(1.0, u)) * 255, 0) / 255, 9) AS quantized FROM (SELECT *, (value + 1) / 2 AS u FROM pixels)""", "pixels")
def p40(spark, sf):
    from filamet.operators.pixels import foreground, quantize
    p = bind.pixels(spark, sf).withColumn("u", (c("value") + 1) / 2)
    return p.select("image_id", "row", "col", foreground(c("u"), 0.5).alias("foreground"), r(quantize(c("u"), 255), 9).alias("quantized"))
