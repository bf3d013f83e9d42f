"""Queries along runs and over field samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from filamet.functions import samples as P
from filamet.operators import centerline as L
from filamet.operators import field_stats as FS
from filamet.plans import bind
from filamet.plans.registry import query, r
from filamet.plans.row_rules import FIELD_SQL, field_samples

c = F.col
ORDER = ["ts", "event_id"]

RUN_SQL = """
ev AS (SELECT user_id AS run_id, ts, event_id, value AS x, (props->>'k')::DOUBLE AS y, event_type <> 'error' AS ok FROM events),
st AS (SELECT *, sqrt(pow(x - lag(x) OVER o, 2) + pow(y - lag(y) OVER o, 2)) AS step FROM ev WINDOW o AS (PARTITION BY run_id ORDER BY ts, event_id)),
run AS (SELECT *, sum(coalesce(step, 0)) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM st)"""


def runs(spark, sf):
    e = bind.table(spark, sf, "events").select(
        c("user_id").alias("run_id"), "ts", "event_id", c("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), (c("event_type") != "error").alias("ok"))
    return L.steps(e, ["run_id"], ORDER, "x", "y", lags={"ok_before": "ok"})


@query("w02_arc_length", f"WITH {RUN_SQL} SELECT run_id, event_id, round(s, 7) AS s, round(quantile_cont(step, 0.5) OVER (PARTITION BY run_id), 8) AS median_step FROM run")
def w02(spark, sf):
    st = runs(spark, sf)
    return L.arc_length(st, ["run_id"], ORDER).join(L.median_step(st, ["run_id"]), "run_id").select("run_id", "event_id", r("s", 7).alias("s"), r("median_step", 8).alias("median_step"))


@query("w03_fragments", f"""
WITH {RUN_SQL}, m AS (SELECT run_id, 2*quantile_cont(step, 0.5) AS mx FROM run GROUP BY run_id),
f AS (SELECT run_id, ts, event_id, ok, CASE WHEN ok AND NOT (coalesce(lag(ok) OVER o, false) AND coalesce(step <= mx, false)) THEN 1 ELSE 0 END AS st FROM run JOIN m USING (run_id) WINDOW o AS (PARTITION BY run_id ORDER BY ts, event_id)),
k AS (SELECT *, sum(st) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS fragment FROM f)
SELECT run_id, event_id, fragment::BIGINT AS fragment, count(*) OVER (PARTITION BY run_id, fragment) AS points, count(*) OVER (PARTITION BY run_id, fragment) < 5 AS too_short FROM k WHERE ok""")
def w03(spark, sf):
    f = L.fragments(runs(spark, sf), ["run_id"], ORDER, "ok")
    return f.select("run_id", "event_id", "fragment", "points", "too_short")


@query("w04_tangents_normals", f"""
WITH {RUN_SQL}, d AS (SELECT *, coalesce(lead(x) OVER o, x) - coalesce(lag(x) OVER o, x) AS dx, coalesce(lead(y) OVER o, y) - coalesce(lag(y) OVER o, y) AS dy FROM run WINDOW o AS (PARTITION BY run_id ORDER BY ts, event_id)),
t AS (SELECT *, CASE WHEN dx*dx+dy*dy > 0 THEN dx/sqrt(dx*dx+dy*dy) END AS tx, CASE WHEN dx*dx+dy*dy > 0 THEN dy/sqrt(dx*dx+dy*dy) END AS ty FROM d),
n AS (SELECT *, CASE WHEN -ty*cos(x) + tx*sin(x) < 0 THEN -1 ELSE 1 END AS fl FROM t)
SELECT run_id, event_id, round(tx, 9)+0.0 AS tangent_x, round(ty, 9)+0.0 AS tangent_y, round(-ty*fl, 9)+0.0 AS normal_x, round(tx*fl, 9)+0.0 AS normal_y FROM n""")
def w04(spark, sf):
    a = runs(spark, sf).withColumns({"rnx": F.cos("x"), "rny": F.sin("x")})
    t = L.tangents_normals(a, ["run_id"], ORDER, "x", "y", "rnx", "rny")
    return t.select("run_id", "event_id", *[r(k, 9).alias(k) for k in ("tangent_x", "tangent_y", "normal_x", "normal_y")])


@query("w05_arc_weights", f"""
WITH {RUN_SQL} SELECT run_id, event_id, round((coalesce(lead(s) OVER o, s) - coalesce(lag(s) OVER o, s))/2, 7) AS arc_weight FROM run WINDOW o AS (PARTITION BY run_id ORDER BY ts, event_id)""")
def w05(spark, sf):
    w = L.half_neighbour_weights(L.arc_length(runs(spark, sf), ["run_id"], ORDER), ["run_id"], ORDER)
    return w.select("run_id", "event_id", r("arc_weight", 7).alias("arc_weight"))


@query("j18_samples_in_runs", """
SELECT p.image_id, p.row, p.col, p.row*8 + p.col AS ord, round(q.value, 9) AS coherence FROM pixels p JOIN pixels q ON p.image_id = q.image_id AND p.row = q.row AND p.col = q.col WHERE p.value > 0.05 AND q.value > 0.1""", "pixels")
def j18(spark, sf):
    p = bind.pixels(spark, sf)
    run = p.where(c("value") > 0.05).select("image_id", "row", "col", (c("row") * 8 + c("col")).alias("ord"))
    samples = p.where(c("value") > 0.1).select("image_id", c("row").alias("seed_row"), c("col").alias("seed_col"), r("value", 9).alias("coherence"))
    return L.samples_in_runs(run, samples, ["image_id"])


@query("w08_sliced_centroids", """
WITH p AS (SELECT l_suppkey % 20 AS image_id, l_partkey % 200 AS col, (l_partkey % 200) * 0.3 + l_linenumber AS row FROM lineitem),
s AS (SELECT image_id, count(*) AS n, avg(col) AS cx, avg(row) AS cy, 0.8::DOUBLE AS ax, 0.6::DOUBLE AS ay FROM p GROUP BY image_id),
t AS (SELECT p.*, (col-cx)*ax + (row-cy)*ay AS t FROM p JOIN s USING (image_id)),
e AS (SELECT image_id, min(t) AS t0, max(t) AS t1 FROM t GROUP BY image_id),
k AS (SELECT image_id, i, t0 + 0.1*(t1-t0) AS a, t1 - 0.1*(t1-t0) AS z FROM e, (SELECT unnest(range(0, 9)) AS i)),
b AS (SELECT image_id, i, a + i*((z-a)/9) AS l, CASE WHEN i = 8 THEN z ELSE a + (i+1)*((z-a)/9) END AS u FROM k),
c AS (SELECT b.image_id, i, avg(col) AS x, avg(row) AS y FROM b JOIN t ON t.image_id = b.image_id AND t.t >= l AND t.t < u GROUP BY b.image_id, i),
g AS (SELECT c.image_id, c.i, sum(exp(-o*o/2.0)*q.x)/sum(exp(-o*o/2.0)) AS x, sum(exp(-o*o/2.0)*q.y)/sum(exp(-o*o/2.0)) AS y FROM c, (SELECT unnest(range(-4, 5)) AS o), c q
  WHERE q.image_id = c.image_id AND q.i = CASE WHEN (c.i+o+18) % 18 < 9 THEN (c.i+o+18) % 18 ELSE 17 - (c.i+o+18) % 18 END GROUP BY c.image_id, c.i),
d AS (SELECT *, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy FROM g WINDOW w AS (PARTITION BY image_id ORDER BY i))
SELECT image_id, i::INTEGER AS i, round(x, 8) AS x, round(y, 8) AS y, round(dx/sqrt(dx*dx+dy*dy), 9) AS tangent_x FROM d""")
def w08(spark, sf):
    li = bind.table(spark, sf, "lineitem")
    p = li.select((c("l_suppkey") % 20).alias("image_id"), (c("l_partkey") % 200).alias("col"), ((c("l_partkey") % 200) * 0.3 + c("l_linenumber")).alias("row"))
    mid = p.groupBy("image_id").agg(F.avg("col").alias("center_x"), F.avg("row").alias("center_y")).withColumns({"axis_x": F.lit(0.8), "axis_y": F.lit(0.6)})
    s = L.sliced_centroids(p.join(mid, "image_id"), ["image_id"])
    return s.select("image_id", "i", r("x", 8).alias("x"), r("y", 8).alias("y"), r("tangent_x", 9).alias("tangent_x"))


@query("w09_diagnostic_rois", """
WITH i AS (SELECT image_id, width_px*2 AS w, CASE WHEN image_id % 3 = 0 THEN height_px*2 - 60 ELSE height_px*2 END AS h FROM images),
k AS (SELECT *, floor(w/2.0)::BIGINT AS cx, floor(h/2.0)::BIGINT AS cy, floor(least(w,h)/3.0)::BIGINT AS th, least(500, (w-150)//2, (h-150)//2) AS q FROM i),
b AS (SELECT image_id, CASE WHEN w < 600 OR h < 600 THEN [[greatest(0,cx-th), greatest(0,cy-th), least(w,cx+th), least(h,cy+th)]]
  WHEN q > 100 THEN [[cx-250, cy-250, cx+250, cy+250], [50, 50, 50+q, 50+q], [w-50-q, 50, w-50, 50+q], [cx-q//2, h-50-q, cx-q//2+q, h-50]] ELSE [[cx-250, cy-250, cx+250, cy+250]] END AS bx FROM k)
SELECT image_id, (o-1)::INTEGER AS roi_ord, bx[o][1] AS x0, bx[o][2] AS y0, bx[o][3] AS x1, bx[o][4] AS y1 FROM b, LATERAL (SELECT unnest(range(1, len(bx)+1)) AS o)""", "images")
def w09(spark, sf):
    i = bind.images(spark, sf).select("image_id", (c("width_px") * 2).alias("w"), (c("height_px") * 2).alias("h"), F.when(c("image_id") % 3 == 0, c("height_px") * 2 - 60).alias("foot"))
    return L.diagnostic_rois(i, "w", "h", "foot").select("image_id", "roi_ord", "x0", "y0", "x1", "y1")


@query("a21_nematic_order", FIELD_SQL + """
SELECT image_id, round(sqrt(pow(sum(l_linenumber*nx)/sum(l_linenumber), 2)+pow(sum(l_linenumber*ny)/sum(l_linenumber), 2)), 9) AS nematic_order, round(sum(l_linenumber*coherence)/sum(l_linenumber), 9) AS mean_coherence FROM f GROUP BY image_id""")
def a21(spark, sf):
    n = L.nematic_order(field_samples(spark, sf), ["image_id"], "normal_x", "normal_y", "l_linenumber", "coherence")
    return n.select("image_id", r("nematic_order", 9).alias("nematic_order"), r("mean_coherence", 9).alias("mean_coherence"))


@query("a22_spearman", """
WITH s AS (SELECT image_id, method, value, weight, rank() OVER (PARTITION BY image_id, method ORDER BY value) + (count(*) OVER (PARTITION BY image_id, method, value) - 1)/2.0 AS rx, rank() OVER (PARTITION BY image_id, method ORDER BY weight) + (count(*) OVER (PARTITION BY image_id, method, weight) - 1)/2.0 AS ry FROM samples)
SELECT image_id, method, count(*) AS n, round(corr(rx, ry), 9) AS rho FROM s GROUP BY ALL""", "samples")
def a22(spark, sf):
    s = L.spearman(bind.samples(spark, sf), ["image_id", "method"], "value", "weight")
    return s.select("image_id", "method", "n", r("rho", 9).alias("rho"))


def field_values(spark, sf):
    s = field_samples(spark, sf)
    d = c("r_minus") + c("r_plus")
    return s.withColumns({
        "asymmetry": F.abs(c("r_plus") - c("r_minus")) / d, "imbalance": F.abs(c("r_plus") - c("r_minus")) * 1e6, "edge_minus_edt": (d - c("edt") * 2) * 1e6,
        "edt_um": c("edt") * 2e6, "edge_um": d * 1e6,
    })


FV = FIELD_SQL + ", v AS (SELECT *, abs(rp-rm)/(rm+rp) AS asym, abs(rp-rm)*1e6 AS imb, (rm+rp-edt*2)*1e6 AS eme, edt*2e6 AS edt_um, (rm+rp)*1e6 AS edge_um FROM f)"


@query("a23_field_statistics", FV + """
SELECT image_id, count(*) AS n, count(*) FILTER (edge_accepted) AS edge_n, round(avg(edge_accepted::INT), 9) AS edge_share, round(avg(profile_accepted::INT), 9) AS profile_share, round(avg(asym), 9) AS mean_asymmetry,
  round(quantile_cont(asym, 0.5), 9) AS median_asymmetry, round(quantile_cont(imb, 0.5), 9) AS median_imbalance, round(quantile_cont(imb, 0.9), 9) AS p90_imbalance, round(quantile_cont(eme, 0.5), 8) AS median_edge_minus_edt FROM v GROUP BY image_id""")
def a23(spark, sf):
    s = FS.field_statistics(field_values(spark, sf), ["image_id"])
    return s.select(
        "image_id", c("sample_count").alias("n"), c("edge_accepted_count").alias("edge_n"), r("edge_acceptance_fraction", 9).alias("edge_share"), r("profile_acceptance_fraction", 9).alias("profile_share"),
        r("edge_mean_asymmetry", 9).alias("mean_asymmetry"), r("edge_median_asymmetry", 9).alias("median_asymmetry"), r("median_imbalance", 9).alias("median_imbalance"), r("p90_imbalance", 9).alias("p90_imbalance"),
        r("median_edge_minus_edt", 8).alias("median_edge_minus_edt"))


@query("a13_acceptance_medians", FV + """,
s AS (SELECT image_id, avg(edge_accepted::INT) AS ea, avg(profile_accepted::INT) AS pa, quantile_cont(eme, 0.5) AS eme, quantile_cont(asym, 0.5) AS asym FROM v GROUP BY image_id)
SELECT count(*) AS images, round(quantile_cont(ea, 0.5), 9) AS edge_acceptance, round(quantile_cont(pa, 0.5), 9) AS profile_acceptance, round(quantile_cont(eme, 0.5), 8) AS edge_minus_edt FROM s""")
def a13_medians(spark, sf):
    from filamet.operators.reports import median_across_images
    m = median_across_images(FS.field_statistics(field_values(spark, sf), ["image_id"]), ["edge_acceptance_fraction", "profile_acceptance_fraction", "median_edge_minus_edt"])
    return m.select("images", r("edge_acceptance_fraction", 9).alias("edge_acceptance"), r("profile_acceptance_fraction", 9).alias("profile_acceptance"), r("median_edge_minus_edt", 8).alias("edge_minus_edt"))


@query("a09_flag_frequencies", FIELD_SQL + """,
s AS (SELECT image_id, unnest(CASE ek WHEN 0 THEN ['POSSIBLE_CROSSING','AMBIGUOUS_LOCAL_WIDTH'] WHEN 1 THEN ['HIGH_ASYMMETRY'] ELSE [] END) AS flag FROM f UNION ALL SELECT DISTINCT image_id, 'EXPERIMENTAL' FROM f),
k AS (SELECT image_id, flag, count(*) AS n FROM s GROUP BY ALL)
SELECT image_id, flag, n, round(n / sum(n) OVER (PARTITION BY image_id), 9) AS share FROM k""")
def a09(spark, sf):
    f = field_samples(spark, sf).select("image_id", P.split_flags(c("edge_flags")).alias("fl"))
    extra = f.select("image_id").distinct().withColumn("flag", F.lit("EXPERIMENTAL"))
    return FS.flag_counts(f, ["image_id"], "fl", extra).withColumn("share", r("share", 9))


REFINED_SQL = """
k AS (SELECT l_suppkey AS image_id, l_returnflag <> 'R' AS acc, l_returnflag = 'A' AS ref, l_extendedprice/1009 AS shift, l_quantity AS w, l_extendedprice/2003 AS sm, CASE WHEN l_linenumber > 2 THEN l_partkey % 7 ELSE -1 END AS seg, l_linestatus = 'F' AS e, l_tax AS arc FROM lineitem)"""


@query("a24_refinement_summary", f"""WITH {REFINED_SQL}
SELECT image_id, count(*) FILTER (acc) AS accepted_count, round(count(*) FILTER (ref)/count(*), 9) AS smooth_coverage, count(DISTINCT CASE WHEN seg >= 0 THEN seg END) AS segment_count, round(avg(CASE WHEN ref THEN e::INT END), 9) AS edge_share, round(sum(arc), 6) AS arc_length,
  round(quantile_cont(CASE WHEN acc THEN shift END, 0.5), 9) AS median_shift, round(quantile_cont(CASE WHEN acc THEN shift END, 0.9), 9) AS p90_shift, round(quantile_cont(CASE WHEN acc THEN shift/w END, 0.5), 9) AS median_fraction, round(quantile_cont(CASE WHEN ref THEN sm END, 0.9), 9) AS p90_smooth FROM k GROUP BY image_id""")
def a24(spark, sf):
    s = refined_per_image(spark, sf)
    return s.select("image_id", "accepted_count", r("smooth_coverage", 9).alias("smooth_coverage"), "segment_count", r("edge_acceptance_among_refined", 9).alias("edge_share"), r("arc_length", 6).alias("arc_length"),
                    r("median_shift", 9).alias("median_shift"), r("p90_shift", 9).alias("p90_shift"), r("median_shift_fraction", 9).alias("median_fraction"), r("p90_smooth_shift", 9).alias("p90_smooth"))


def refined_per_image(spark, sf):
    li = bind.table(spark, sf, "lineitem").select(
        c("l_suppkey").alias("image_id"), (c("l_returnflag") != "R").alias("accepted"), (c("l_returnflag") == "A").alias("refined"), (c("l_extendedprice") / 1009).alias("shift"), c("l_quantity").alias("width"),
        (c("l_extendedprice") / 2003).alias("smooth_shift"), F.when(c("l_linenumber") > 2, c("l_partkey") % 7).otherwise(-1).alias("segment_id"), (c("l_linestatus") == "F").alias("edge_accepted"), F.lit(1.0).alias("edge"), c("l_tax").alias("arc_weight"))
    return FS.refinement_summary(li, ["image_id"])


def estimator_columns(spark, sf):
    p = c("l_extendedprice")
    return bind.table(spark, sf, "lineitem").select(
        c("l_suppkey").alias("image_id"), (p / 1009).alias("edt"), (p * (1 + c("l_tax")) / 1009).alias("edge"), (p * (1 - c("l_discount")) / 1009).alias("profile"),
        F.when(c("l_linenumber") != 5, p / 1013).otherwise(float("nan")).alias("redt"), (p * (1 + c("l_tax") / 2) / 1013).alias("redge"), (p * (1 - c("l_discount") / 3) / 1013).alias("rprofile"),
        (c("l_returnflag") != "R").alias("edge_accepted"), (c("l_linestatus") == "F").alias("profile_accepted"), (c("l_returnflag") == "A").alias("redge_accepted"), (c("l_linenumber") > 2).alias("rprofile_accepted"))


EST = """
e AS (SELECT l_suppkey AS image_id, l_extendedprice/1009 AS edt, l_extendedprice*(1+l_tax)/1009 AS edge, l_extendedprice*(1-l_discount)/1009 AS profile, CASE WHEN l_linenumber <> 5 THEN l_extendedprice/1013 END AS redt,
  l_extendedprice*(1+l_tax/2)/1013 AS redge, l_extendedprice*(1-l_discount/3)/1013 AS rprofile, l_returnflag <> 'R' AS ea, l_linestatus = 'F' AS pa, l_returnflag = 'A' AS rea, l_linenumber > 2 AS rpa FROM lineitem),
el AS (SELECT image_id, unnest([{'p':'edt_edge_raw','s':1,'v':CASE WHEN ea THEN edt END},{'p':'edt_edge_raw','s':2,'v':CASE WHEN ea THEN edge END},{'p':'edt_edge_refined','s':1,'v':CASE WHEN rea THEN redt END},{'p':'edt_edge_refined','s':2,'v':CASE WHEN rea THEN redge END},
 {'p':'edt_profile_raw','s':1,'v':CASE WHEN pa THEN edt END},{'p':'edt_profile_raw','s':2,'v':CASE WHEN pa THEN profile END},{'p':'edt_profile_refined','s':1,'v':CASE WHEN rpa THEN redt END},{'p':'edt_profile_refined','s':2,'v':CASE WHEN rpa THEN rprofile END},
 {'p':'edge_raw_vs_refined','s':1,'v':CASE WHEN ea THEN edge END},{'p':'edge_raw_vs_refined','s':2,'v':CASE WHEN rea THEN redge END},{'p':'profile_raw_vs_refined','s':1,'v':CASE WHEN pa THEN profile END},{'p':'profile_raw_vs_refined','s':2,'v':CASE WHEN rpa THEN rprofile END},
 {'p':'edge_profile_refined','s':1,'v':CASE WHEN rea THEN redge END},{'p':'edge_profile_refined','s':2,'v':CASE WHEN rpa THEN rprofile END}]) AS z FROM e),
ez AS (SELECT image_id, z.p AS pair, z.v AS x, count(*) FILTER (z.s = 1) AS n1, count(*) FILTER (z.s = 2) AS n2 FROM el WHERE z.v IS NOT NULL GROUP BY ALL),
ec AS (SELECT image_id, pair, lead(x) OVER k - x AS dx, sum(n1) OVER k / sum(n1) OVER g AS f1, sum(n2) OVER k / sum(n2) OVER g AS f2 FROM ez WINDOW k AS (PARTITION BY image_id, pair ORDER BY x ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY image_id, pair)),
w AS (SELECT image_id, pair, sum(abs(f1-f2)*coalesce(dx, 0)) AS w1 FROM ec GROUP BY ALL)"""


@query("a15_estimator_distances", f"WITH {EST} SELECT image_id, pair, round(w1, 8) AS w1 FROM w")
def a15(spark, sf):
    return FS.estimator_distances(estimator_columns(spark, sf), ["image_id"]).withColumn("w1", r("w1", 8))


@query("a15_estimator_medians", f"""
WITH {EST} SELECT image_id, round(quantile_cont(edt, 0.5), 8) AS edt_raw, round(quantile_cont(redt, 0.5), 8) AS edt_refined, round(quantile_cont(edge, 0.5) FILTER (ea), 8) AS edge_raw, round(quantile_cont(redge, 0.5) FILTER (rea), 8) AS edge_refined,
  round(quantile_cont(profile, 0.5) FILTER (pa), 8) AS profile_raw, round(quantile_cont(rprofile, 0.5) FILTER (rpa), 8) AS profile_refined, round(avg(ea::INT), 9) AS edge_raw_acceptance, round(avg(rea::INT), 9) AS edge_refined_acceptance,
  round(avg(pa::INT), 9) AS profile_raw_acceptance, round(avg(rpa::INT), 9) AS profile_refined_acceptance FROM e GROUP BY image_id""")
def a15_medians(spark, sf):
    m = FS.estimator_medians(estimator_columns(spark, sf), ["image_id"])
    names = ("edt_raw", "edt_refined", "edge_raw", "edge_refined", "profile_raw", "profile_refined")
    return m.select("image_id", *[r(k, 8).alias(k) for k in names], *[r(f"{k}_acceptance", 9).alias(f"{k}_acceptance") for k in names[2:]])


@query("a14_refinement_medians", FV + f""", {REFINED_SQL},
p AS (SELECT image_id, count(*) FILTER (ref)/count(*) AS cov, avg(CASE WHEN ref THEN e::INT END) AS share, quantile_cont(CASE WHEN acc THEN shift END, 0.5) AS ms, quantile_cont(CASE WHEN ref THEN sm END, 0.5) AS sms FROM k GROUP BY image_id),
y AS (SELECT image_id, quantile_cont(asym, 0.5) AS asym FROM v GROUP BY image_id)
SELECT count(*) AS images, round(quantile_cont(ms, 0.5), 9) AS center_shift, round(quantile_cont(sms, 0.5), 9) AS residual_shift, round(quantile_cont(cov, 0.5), 9) AS smooth_coverage, round(quantile_cont(share, 0.5), 9) AS edge_acceptance_refined,
  (SELECT round(quantile_cont(asym, 0.5), 9) FROM y) AS asymmetry FROM p""")
def a14_medians(spark, sf):
    from filamet.operators.groups import attach_row
    from filamet.operators.reports import median_across_images
    m = median_across_images(refined_per_image(spark, sf), ["median_shift", "median_smooth_shift", "smooth_coverage", "edge_acceptance_among_refined"])
    y = median_across_images(FS.field_statistics(field_values(spark, sf), ["image_id"]), ["edge_median_asymmetry"]).select("edge_median_asymmetry")
    return attach_row(m, y).select("images", r("median_shift", 9).alias("center_shift"), r("median_smooth_shift", 9).alias("residual_shift"), r("smooth_coverage", 9).alias("smooth_coverage"),
                                   r("edge_acceptance_among_refined", 9).alias("edge_acceptance_refined"), r("edge_median_asymmetry", 9).alias("asymmetry"))


@query("a14_refinement_effect", f"""
WITH {EST}, a AS (SELECT image_id, max(w1) FILTER (pair = 'edt_edge_raw') AS raw, max(w1) FILTER (pair = 'edt_edge_refined') AS ref FROM w GROUP BY image_id)
SELECT count(*) AS images, count(*) FILTER (ref < raw) AS improved, round(quantile_cont(raw, 0.5), 8) AS median_raw, round(quantile_cont(ref, 0.5), 8) AS median_refined FROM a""")
def a14(spark, sf):
    e = FS.refinement_effect(FS.estimator_distances(estimator_columns(spark, sf), ["image_id"]), "image_id")
    return e.select("images", "improved", r("median_raw", 8).alias("median_raw"), r("median_refined", 8).alias("median_refined"))


@query("a36_candidate_samples", """
WITH k AS (SELECT vec_id, label, list_filter(embedding, lambda x: x > 0 OR label % 2 = 0) AS w, abs(embedding[64])::DOUBLE AS len FROM embeddings),
s AS (SELECT vec_id, unnest(w)::DOUBLE AS v, len/len(w) AS wt FROM k WHERE vec_id % 6 > 0 AND len > 0)
SELECT vec_id, count(*) AS n, round(sum(wt), 9) AS mass, round(sum(v*wt), 9) AS moment FROM s GROUP BY vec_id""")
def a36(spark, sf):
    e = bind.table(spark, sf, "embeddings").select("vec_id", F.transform(F.filter("embedding", lambda v: (v > 0) | (c("label") % 2 == 0)), lambda v: v.cast("double")).alias("w"),
        F.when(c("vec_id") % 6 > 0, F.abs(F.element_at("embedding", 64)).cast("double")).otherwise(0.0).alias("line"))
    s = L.candidate_samples(e, ["vec_id"], "line", "w")
    return s.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), r(F.sum("weight"), 9).alias("mass"), r(F.sum(c("value") * c("weight")), 9).alias("moment"))


@query("a40_truth_error", """
SELECT user_id, event_type AS estimator, round(avg(CASE WHEN event_id % 7 > 0 THEN abs(value - (props->>'k')::DOUBLE) END), 9) AS mae FROM events GROUP BY ALL""")
def a40(spark, sf):
    e = bind.table(spark, sf, "events").withColumns({"truth": F.get_json_object("props", "$.k").cast("double"), "v": F.when(c("event_id") % 7 > 0, c("value")).otherwise(float("nan"))})
    return FS.truth_error(e, ["user_id", "event_type"], "v", "truth").select("user_id", c("event_type").alias("estimator"), r("mae", 9).alias("mae"))


