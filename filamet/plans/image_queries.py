"""Queries over pixel tables: thresholds, components, parity, regions, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from filamet.operators import components as C
from filamet.operators import parity, pixels, spatial
from filamet.operators.quantiles import exact_quantiles
from filamet.plans import bind
from filamet.plans.registry import query, r

c = F.col
IM = ["image_id"]
PX, PY = 2e-9, 3e-9


def px(spark, sf):
    return bind.pixels(spark, sf).withColumns({"height": F.lit(8).cast("long"), "width": F.lit(8).cast("long")})


def mask(spark, sf, above=0.0):
    return bind.pixels(spark, sf).where(c("value") > above)


@query("s10_luma", """
SELECT image_id, row, col, round(0.2126*abs(value) + 0.7152*abs(value)/2 + 0.0722*row, 10) AS value FROM pixels""", "pixels")
def s10(spark, sf):
    rgb = bind.pixels(spark, sf).select("image_id", "row", "col", F.abs("value").alias("r"), (F.abs("value") / 2).alias("g"), c("row").cast("double").alias("b"))
    return pixels.gray(rgb).select("image_id", "row", "col", r("value", 10).alias("value"))


@query("s11_channel_import", """
WITH q AS (SELECT image_id, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM pixels GROUP BY image_id)
SELECT image_id, row, col, round(greatest(0.0, least(1.0, (value-lo)/greatest(hi-lo, 2.220446049250313e-16))), 9) + 0.0 AS signal, round((1 + image_id % 5)/8.0, 6) AS px_um, round((2 + image_id % 3)/8.0, 6) AS py_um FROM pixels JOIN q USING (image_id)""", "pixels")
def s11(spark, sf):
    from filamet.sources.images import import_channel
    ch = px(spark, sf).withColumns({"x_range": 1.0 + c("image_id") % 5, "y_range": 2.0 + c("image_id") % 3})
    i = import_channel(ch, IM)
    return i.select("image_id", "row", "col", r("norm", 9).alias("signal"), r("pixel_size_x", 6).alias("px_um"), r("pixel_size_y", 6).alias("py_um"))


@query("a30_contrast", """
SELECT image_id, round(min(value), 9) AS min, round(max(value), 9) AS max, round(stddev_pop(value), 9) AS std, round(quantile_cont(value, 0.98) - quantile_cont(value, 0.02), 9) AS p2_p98 FROM pixels GROUP BY image_id""", "pixels")
def a30(spark, sf):
    k = pixels.contrast(bind.pixels(spark, sf), IM)
    return k.select("image_id", *[r(n, 9).alias(n) for n in ("min", "max", "std", "p2_p98")])


NORM = """nq AS (SELECT image_id, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM pixels GROUP BY image_id),
norm AS (SELECT image_id, row, col, greatest(0.0, least(1.0, (value-lo)/greatest(hi-lo, 1e-5))) AS v FROM pixels JOIN nq USING (image_id))"""


def normalized(spark, sf):
    return pixels.clip_normalize(px(spark, sf), IM, 0.02, 0.98, 1e-5)


@query("a32_percentile_polarity", f"""
WITH {NORM} SELECT image_id, round(quantile_cont(v, 0.65), 9) AS threshold, round(avg(v) FILTER (row BETWEEN 1 AND 6 AND col BETWEEN 1 AND 6), 9) AS interior,
  round(avg(v) FILTER (NOT (row BETWEEN 1 AND 6 AND col BETWEEN 1 AND 6)), 9) AS border,
  avg(v) FILTER (row BETWEEN 1 AND 6 AND col BETWEEN 1 AND 6) > avg(v) FILTER (NOT (row BETWEEN 1 AND 6 AND col BETWEEN 1 AND 6)) AS is_bright FROM norm GROUP BY image_id""", "pixels")
def a32(spark, sf):
    n = normalized(spark, sf)
    t = exact_quantiles(n, IM, "norm", [0.65], names=["threshold"])
    p = pixels.polarity(n, IM, "norm", "height", "width")
    return t.join(p, IM).select("image_id", r("threshold", 9).alias("threshold"), r("interior", 9).alias("interior"), r("border", 9).alias("border"), "is_bright")


BOX = """WITH y AS (SELECT k, CASE WHEN m < 8 THEN m ELSE 15 - m END AS j FROM (SELECT k, ((k % 16) + 16) % 16 AS m FROM (SELECT unnest(range(-17, 25)) AS k))),
p1 AS (SELECT image_id, row, k, sum(value) OVER (PARTITION BY image_id, row ORDER BY k ROWS UNBOUNDED PRECEDING) AS s FROM {src} JOIN y ON y.j = col),
a AS (SELECT image_id, row, k AS col, (lead(s, 17) OVER w - coalesce(lag(s, 18) OVER w, 0)) / 35 AS v FROM p1 WINDOW w AS (PARTITION BY image_id, row ORDER BY k)),
p2 AS (SELECT image_id, col, k, sum(v) OVER (PARTITION BY image_id, col ORDER BY k ROWS UNBOUNDED PRECEDING) AS s FROM a JOIN y ON y.j = row WHERE col BETWEEN 0 AND 7)
SELECT image_id, col, k AS row, (lead(s, 17) OVER w - coalesce(lag(s, 18) OVER w, 0)) / 35 AS m FROM p2 WINDOW w AS (PARTITION BY image_id, col ORDER BY k)"""

OTSU = """WITH e AS (SELECT image_id, min(value) AS lo, max(value) AS hi FROM {src} GROUP BY image_id),
b AS (SELECT image_id, i AS bin, i*((hi-lo)/256)+lo AS l, CASE WHEN i = 255 THEN hi ELSE (i+1)*((hi-lo)/256)+lo END AS u FROM e, (SELECT unnest(range(0, 256)) AS i)),
g AS (SELECT image_id, value, lo, hi, least(255, greatest(0, floor((value-lo)*(256/(hi-lo)))))::INTEGER AS i FROM {src} JOIN e USING (image_id)),
d AS (SELECT *, CASE WHEN value < i*((hi-lo)/256)+lo THEN i-1 ELSE i END AS j FROM g),
n AS (SELECT image_id, CASE WHEN j < 255 AND value >= (j+1)*((hi-lo)/256)+lo THEN j+1 ELSE j END AS bin, count(*) AS n FROM d GROUP BY ALL),
h AS (SELECT b.image_id, b.bin, (l+u)/2 AS ctr, coalesce(n.n, 0) AS n FROM b LEFT JOIN n ON n.image_id = b.image_id AND n.bin = b.bin),
w AS (SELECT *, sum(n) OVER k AS w1, sum(n*ctr) OVER k AS s1, sum(n) OVER g AS w, sum(n*ctr) OVER g AS s FROM h WINDOW k AS (PARTITION BY image_id ORDER BY bin ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY image_id)),
v AS (SELECT image_id, bin, w1*(w-w1)*pow(s1/greatest(w1, 1e-12) - (s-s1)/greatest(w-w1, 1e-12), 2) AS v FROM w WHERE bin < 255),
m AS (SELECT image_id, floor(avg(bin))::INTEGER AS bin FROM (SELECT *, max(v) OVER (PARTITION BY image_id) AS mv FROM v) WHERE v >= mv - 1e-5 GROUP BY image_id)
SELECT image_id, {threshold} AS threshold FROM m JOIN h USING (image_id, bin)"""


@query("a31_otsu", OTSU.format(src="pixels", threshold="round(ctr, 9)"), "pixels")
def a31(spark, sf):
    return pixels.otsu(bind.pixels(spark, sf), IM, "value").withColumn("threshold", r("threshold", 9))


LV = "lv AS (SELECT image_id, row, col, round_even(greatest(0.0, least(1.0, (value+0.5))) * 255, 0)::BIGINT AS level FROM pixels)"


def unit(spark, sf):
    return bind.pixels(spark, sf).withColumn("u", c("value") + 0.5)


@query("a38_discrete_otsu", f"""
WITH {LV}, h AS (SELECT i.image_id, l.level, count(lv.level) AS n FROM (SELECT DISTINCT image_id FROM lv) i CROSS JOIN (SELECT unnest(range(0,256)) AS level) l LEFT JOIN lv ON lv.image_id = i.image_id AND lv.level = l.level GROUP BY ALL),
w AS (SELECT *, sum(n) OVER k AS w, sum(n*level) OVER k AS m, sum(n) OVER g AS tw, sum(n*level) OVER g AS tm FROM h WINDOW k AS (PARTITION BY image_id ORDER BY level ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY image_id)),
v AS (SELECT image_id, level, CASE WHEN w > 0 AND w < tw THEN ((tm*w - m*tw)::DOUBLE*(tm*w - m*tw)) / (w::DOUBLE*(tw-w)) ELSE 0 END AS v FROM w)
SELECT image_id, round(avg(level)/255, 9) AS threshold FROM (SELECT *, max(v) OVER (PARTITION BY image_id) AS mv FROM v) WHERE v = mv GROUP BY image_id""", "pixels")
def a38(spark, sf):
    return pixels.discrete_otsu(unit(spark, sf), IM, "u").withColumn("threshold", r("threshold", 9))


@query("a39_equalize", f"""
WITH {LV}, h AS (SELECT image_id, level, count(*) AS n FROM lv GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY level ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER (PARTITION BY image_id) AS tot FROM h),
e AS (SELECT image_id, level, t, CASE WHEN err < -tot*1.4901161193847656e-08 THEN tot ELSE err END AS err FROM (SELECT *, (t+1)*(tot/64) - cum + CASE WHEN level > 0 AND level < 255 THEN n ELSE 0 END/2.0 AS err FROM k, (SELECT unnest(range(0,64)) AS t))),
m AS (SELECT image_id, level, t FROM (SELECT *, row_number() OVER (PARTITION BY image_id, level ORDER BY err, t) AS rn FROM e) WHERE rn = 1)
SELECT image_id, row, col, round(round_even(t/63*255, 0)/255, 9) AS equalized FROM lv JOIN m USING (image_id, level)""", "pixels")
def a39(spark, sf):
    e = pixels.equalize(unit(spark, sf), IM, "u")
    return e.select("image_id", "row", "col", r("equalized", 9).alias("equalized"))


COMP = """comp_n AS (SELECT image_id, row, col, row * 2147483648 + col AS id FROM {src}),
comp_r(image_id, id, row, col, label) AS (SELECT image_id, id, row, col, id FROM comp_n
  UNION SELECT n.image_id, n.id, n.row, n.col, p.label FROM comp_r p JOIN comp_n n ON n.image_id = p.image_id AND {near}),
comp AS (SELECT image_id, row, col, min(label) AS component FROM comp_r GROUP BY ALL)"""
NEAR4 = "abs(n.row-p.row) + abs(n.col-p.col) = 1"
NEAR8 = "greatest(abs(n.row-p.row), abs(n.col-p.col)) = 1"


@query("g01_components", "WITH RECURSIVE fg AS (SELECT * FROM pixels WHERE value > 0), " + COMP.format(src="fg", near=NEAR4) + " SELECT * FROM comp", "pixels")
def g01(spark, sf):
    return C.connected_components(mask(spark, sf), IM)


@query("g02_small_components", "WITH RECURSIVE fg AS (SELECT * FROM pixels WHERE value > 0.12), " + COMP.format(src="fg", near=NEAR8) + """
SELECT * FROM comp WHERE (image_id, component) IN (SELECT (image_id, component) FROM comp GROUP BY image_id, component HAVING count(*) >= 4)""", "pixels")
def g02(spark, sf):
    return C.drop_small(C.connected_components(mask(spark, sf, 0.12), IM, eight=True), IM, 4).select("image_id", "row", "col", "component")


@query("g03_degree_junctions", f"""
WITH fg AS (SELECT * FROM pixels WHERE value > 0.09),
d AS (SELECT n.image_id, n.row, n.col, count(p.row) AS degree FROM fg n LEFT JOIN fg p ON n.image_id = p.image_id AND {NEAR8} GROUP BY ALL)
SELECT image_id, row, col, degree FROM d WHERE degree < 3 OR image_id NOT IN (SELECT image_id FROM d WHERE degree < 3)""", "pixels")
def g03(spark, sf):
    return spatial.drop_junctions(mask(spark, sf, 0.09), IM).select("image_id", "row", "col", "degree")


@query("j13_arc_weights", f"""
WITH fg AS (SELECT * FROM pixels WHERE value > 0.15),
s AS (SELECT n.image_id, n.row, n.col, sum(0.5*sqrt(pow((n.col-p.col)*{PX*1e9}, 2)+pow((n.row-p.row)*{PY*1e9}, 2))) AS w FROM fg n LEFT JOIN fg p ON n.image_id = p.image_id AND {NEAR8} GROUP BY ALL)
SELECT image_id, row, col, round(coalesce(w, {min(PX, PY)*1e9}), 9) AS weight_nm FROM s""", "pixels")
def j13(spark, sf):
    m = mask(spark, sf, 0.15).withColumns({"px": F.lit(PX), "py": F.lit(PY)})
    return spatial.arc_weights(m, IM, "px", "py").select("image_id", "row", "col", r(c("weight") * 1e9, 9).alias("weight_nm"))


@query("a33_mask_quality", f"""
WITH RECURSIVE {NORM}, p65 AS (SELECT image_id, quantile_cont(v, 0.65) AS p65, avg(v) FILTER (row BETWEEN 1 AND 6 AND col BETWEEN 1 AND 6) > avg(v) FILTER (NOT (row BETWEEN 1 AND 6 AND col BETWEEN 1 AND 6)) AS bright FROM norm GROUP BY image_id),
ot AS (SELECT image_id, threshold / 255 AS otsu FROM ({OTSU.format(src="(SELECT image_id, v * 255 AS value FROM norm)", threshold="ctr")})),
bx AS ({BOX.format(src="(SELECT image_id, row, col, v AS value FROM norm)")}),
fg0 AS (SELECT image_id*4 + k AS image_id, row, col FROM norm JOIN p65 USING (image_id) JOIN ot USING (image_id) JOIN bx USING (image_id, row, col), (SELECT unnest([0,1,2]) AS k)
  WHERE CASE WHEN bright THEN v > CASE k WHEN 0 THEN m + 0.03 WHEN 1 THEN otsu ELSE p65 END ELSE v < CASE k WHEN 0 THEN m - 0.03 WHEN 1 THEN otsu ELSE p65 END END),
{COMP.format(src="fg0", near=NEAR4)},
k AS (SELECT image_id, component, count(*) AS c FROM comp GROUP BY ALL),
s AS (SELECT image_id, sum(c) AS fg, max(c) AS big, count(*) AS n FROM k GROUP BY image_id),
every AS (SELECT DISTINCT image_id*4 + k AS image_id FROM norm, (SELECT unnest([0,1,2]) AS k)),
q AS (SELECT image_id // 4 AS image_id, image_id % 4 AS k, CASE WHEN fg IS NULL OR fg/64.0 < 0.01 OR fg/64.0 > 0.6 THEN 0.05 ELSE greatest(0.01, (1-2*abs(fg/64.0-0.25))*CASE WHEN big/fg > 0.4 THEN 0.2 ELSE 1 END*CASE WHEN n > 150 THEN 0.3 ELSE 1 END) END::DOUBLE AS score FROM every LEFT JOIN s USING (image_id))
SELECT image_id, CASE k WHEN 0 THEN 'local' WHEN 1 THEN 'otsu' ELSE 'percentile' END AS method, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, k) AS rn FROM q) WHERE rn = 1""", "pixels")
def a33(spark, sf):
    best = pixels.auto_threshold(normalized(spark, sf), IM, "norm", "height", "width")
    return best.select("image_id", "method", r("score", 9).alias("score"))


@query("a34_component_shape", "WITH RECURSIVE fg AS (SELECT * FROM pixels WHERE value > 0), " + COMP.format(src="fg", near=NEAR4) + f""",
s AS (SELECT image_id, component, count(*) AS n, avg(col) AS cx, avg(row) AS cy, var_samp(col*{PX*1e9}) AS xx, var_samp(row*{PY*1e9}) AS yy, covar_samp(col*{PX*1e9}, row*{PY*1e9}) AS xy FROM comp GROUP BY ALL),
e AS (SELECT *, (xx+yy)/2 AS h, sqrt(pow((xx-yy)/2, 2)+xy*xy) AS q FROM s),
k AS (SELECT *, CASE WHEN n < 5 THEN 1.0 ELSE sqrt((h+q)/greatest(h-q, 1e-6)) END AS el FROM e)
SELECT image_id, component, n AS area_px, round(cx, 9) AS cx, round(cy, 9) AS cy, round(el, 6) AS elongation FROM k""", "pixels")
def a34(spark, sf):
    lab = C.connected_components(mask(spark, sf), IM).withColumns({"px": F.lit(PX), "py": F.lit(PY)})
    s = pixels.component_shape(lab, ["image_id", "component"], "px", "py")
    return s.select("image_id", "component", "area_px", r("center_x", 9).alias("cx"), r("center_y", 9).alias("cy"), r("elongation", 6).alias("elongation"))


@query("j10_mask_parity", """
WITH a AS (SELECT image_id, value > 0.02 AS l, value < 0.15 AND value > -0.01 AS r FROM pixels),
k AS (SELECT image_id, count(*) FILTER (l) AS ln, count(*) FILTER (r) AS rn, count(*) FILTER (l AND r) AS i, count(*) FILTER (l OR r) AS u, count(*) AS px FROM a GROUP BY image_id)
SELECT image_id, ln AS left_n, rn AS right_n, i AS intersection, u AS "union", u - i AS different, round((u-i)/px, 9) AS different_fraction, round(CASE WHEN u > 0 THEN i/u ELSE 1 END, 9) AS iou, round(CASE WHEN ln+rn > 0 THEN 2*i/(ln+rn) ELSE 1 END, 9) AS dice,
  round(CASE WHEN rn > 0 THEN i/rn WHEN ln = 0 THEN 1 ELSE 0 END, 9) AS "precision", round(CASE WHEN ln > 0 THEN i/ln WHEN rn = 0 THEN 1 ELSE 0 END, 9) AS recall FROM k""", "pixels")
def j10(spark, sf):
    p = bind.pixels(spark, sf)
    area = p.groupBy("image_id").agg(F.count(F.lit(1)).alias("pixels"))
    m = parity.mask_parity(p.where(c("value") > 0.02), p.where((c("value") < 0.15) & (c("value") > -0.01)), area, IM, ["row", "col"])
    return m.select("image_id", "left_n", "right_n", "intersection", "union", "different", *[r(k, 9).alias(k) for k in ("different_fraction", "iou", "dice", "precision", "recall")])


@query("j11_float_parity", """
WITH p AS (SELECT image_id, value AS a, CASE WHEN image_id % 5 = 0 THEN value WHEN image_id % 5 = 1 AND row = 7 THEN NULL ELSE value + image_id*1e-5 END AS b FROM pixels),
k AS (SELECT image_id, count(b) = count(*) AS ok, max(abs(a-b)) AS mx, avg(abs(a-b)) AS mn, sqrt(avg((a-b)*(a-b))) AS rm, max(abs(a-b)/greatest(abs(a), 2.220446049250313e-16)) AS rel, bool_and(coalesce(abs(a-b) <= 1e-9 + 1e-7*abs(b), false)) AS ac FROM p GROUP BY image_id)
SELECT image_id, ok AS shape_equal, round(CASE WHEN ok THEN mx END, 12) AS max_abs, round(CASE WHEN ok THEN mn END, 12) AS mean_abs, round(CASE WHEN ok THEN rm END, 12) AS rmse, round(CASE WHEN ok THEN rel END, 6) AS max_rel, CASE WHEN ok THEN ac END AS allclose FROM k""", "pixels")
def j11(spark, sf):
    p = bind.pixels(spark, sf)
    right = p.where(~((c("image_id") % 5 == 1) & (c("row") == 7))).withColumn("value", F.when(c("image_id") % 5 == 0, c("value")).otherwise(c("value") + c("image_id") * 1e-5))
    f = parity.float_parity(p, right, IM, ["row", "col"])
    return f.select("image_id", "shape_equal", r("max_abs_difference", 12).alias("max_abs"), r("mean_abs_difference", 12).alias("mean_abs"), r("rmse", 12).alias("rmse"), r("max_relative_difference", 6).alias("max_rel"), "allclose")


@query("j12_symmetric_displacement", """
WITH l AS (SELECT * FROM pixels WHERE value > 0.1), rr AS (SELECT * FROM pixels WHERE value < -0.15),
d AS (SELECT l.image_id, l.row, l.col, 0 AS s, min(sqrt((l.row-rr.row)*(l.row-rr.row) + (l.col-rr.col)*(l.col-rr.col))) AS d FROM l JOIN rr USING (image_id) GROUP BY l.image_id, l.row, l.col
  UNION ALL SELECT rr.image_id, rr.row, rr.col, 1, min(sqrt((l.row-rr.row)*(l.row-rr.row) + (l.col-rr.col)*(l.col-rr.col))) FROM rr JOIN l USING (image_id) GROUP BY rr.image_id, rr.row, rr.col)
SELECT image_id, count(*) AS n, round(quantile_cont(d, 0.5), 9) AS median_displacement, round(quantile_cont(d, 0.95), 9) AS p95_displacement FROM d GROUP BY image_id""", "pixels")
def j12(spark, sf):
    p = bind.pixels(spark, sf)
    d = spatial.symmetric_displacement(p.where(c("value") > 0.1), p.where(c("value") < -0.15), IM)
    q = exact_quantiles(d, IM, "distance", [0.5, 0.95], names=["m", "p"])
    return d.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).join(q, IM).select("image_id", "n", r("m", 9).alias("median_displacement"), r("p", 9).alias("p95_displacement"))


@query("j14_roi_statistics", f"""
WITH m AS (SELECT image_id, 'box' AS roi, row, col, value FROM pixels WHERE col >= 1 AND col < 6 AND row >= 2 AND row < 9
 UNION ALL SELECT image_id, 'triangle', row, col, value FROM pixels WHERE (
   ((row > 0 AND row <= 7 AND col <= 7 AND col <= row*1.0)::INT + (row > 7 AND row <= 7)::INT + (row > 0 AND row <= 7 AND col <= 0)::INT) % 2 = 1)),
v AS (SELECT * FROM m WHERE NOT (row >= 6 AND row < 8 AND image_id % 2 = 0)),
b AS (SELECT v.image_id, v.roi, v.row, v.col, count(n.row) AS k FROM v LEFT JOIN v n ON n.image_id = v.image_id AND n.roi = v.roi AND abs(n.row-v.row)+abs(n.col-v.col) = 1 GROUP BY ALL),
p AS (SELECT image_id, roi, count(*) FILTER (k < 4) AS bn FROM b GROUP BY ALL),
s AS (SELECT image_id, roi, count(*) AS n, avg(col) AS cx, avg(row) AS cy, avg(value) AS mean, stddev_pop(value) AS sd FROM v GROUP BY ALL),
w AS (SELECT image_id, roi, count(*) AS raw FROM m GROUP BY ALL)
SELECT image_id, roi, n AS valid_pixels, round((raw-n)/raw, 9) AS excluded_fraction, round((n*{PX*PY*1e18})::DOUBLE, 6) AS area_nm2, round(bn*sqrt({PX*PX*1e18}+{PY*PY*1e18})/1.414, 6) AS perimeter_nm, round(cx, 9) AS cx, round(cy, 9) AS cy, round(mean, 9) AS mean, round(sd, 9) AS std FROM s JOIN p USING (image_id, roi) JOIN w USING (image_id, roi)""", "pixels")
def j14(spark, sf):
    p = bind.pixels(spark, sf)
    pt = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    none = F.lit(None)
    shapes = F.array(
        F.struct(F.lit("box").alias("roi"), F.lit(1).alias("x0"), F.lit(2).alias("y0"), F.lit(6).alias("x1"), F.lit(9).alias("y1"), none.cast("array<struct<x:double,y:double>>").alias("polygon")),
        F.struct(F.lit("triangle").alias("roi"), none.cast("int").alias("x0"), none.cast("int").alias("y0"), none.cast("int").alias("x1"), none.cast("int").alias("y1"), F.array(pt(0, 0), pt(7, 7), pt(0, 7)).alias("polygon")),
    )
    rois = p.select("image_id").distinct().withColumn("_s", F.explode(shapes)).select("image_id", "_s.*").withColumns({
        "footer_y0": F.when(c("image_id") % 2 == 0, 6), "footer_y1": F.when(c("image_id") % 2 == 0, 8), "px": F.lit(PX), "py": F.lit(PY)})
    s = spatial.roi_statistics(spatial.roi_pixels(p, rois, IM, tile=4), IM, "roi", "px", "py")
    return s.select("image_id", "roi", "valid_pixels", r("excluded_fraction", 9).alias("excluded_fraction"), r(c("area_m2") * 1e18).alias("area_nm2"), r(c("perimeter_m") * 1e9).alias("perimeter_nm"),
                    r("centroid_x", 9).alias("cx"), r("centroid_y", 9).alias("cy"), r("mean", 9).alias("mean"), r("std", 9).alias("std"))


@query("j15_line_profile", """
WITH p AS (SELECT image_id, i AS ord, o, i/5.0 AS t, greatest(0.0, least(7.0, 1 + i/5.0*4 - o*3/5.0)) AS x, greatest(0.0, least(7.0, 2 + i/5.0*3 + o*4/5.0)) AS y FROM (SELECT DISTINCT image_id FROM pixels), (SELECT unnest(range(0, 6)) AS i), (SELECT unnest([-1, 0, 1]) AS o)),
t AS (SELECT p.image_id, ord, sum(value * (1 - abs(x - col)) * (1 - abs(y - row))) / 3 AS v FROM p JOIN pixels q ON q.image_id = p.image_id AND abs(x - col) < 1 AND abs(y - row) < 1 GROUP BY ALL)
SELECT image_id, count(*) AS samples, round(min(v), 9) AS min, round(max(v), 9) AS max, round(avg(v), 9) AS mean FROM t GROUP BY image_id""".replace("i/5.0", "i/4.0").replace("range(0, 6)", "range(0, 5)"), "pixels")
def j15(spark, sf):
    p = px(spark, sf)
    lines = p.select("image_id", "height", "width").distinct().select("*", F.lit("a").alias("line"), F.lit(1.0).alias("x1"), F.lit(2.0).alias("y1"), F.lit(5.0).alias("x2"), F.lit(5.0).alias("y2"))
    s = spatial.line_profile_summary(spatial.line_profile(p, lines, IM, "line", band=3), IM, "line")
    return s.select("image_id", "samples", *[r(k, 9).alias(k) for k in ("min", "max", "mean")])


@query("j21_nearest_boundary", """
WITH h AS (SELECT image_id, row*8+col AS sid, col*1.0 + value AS x, row*1.0 + value/2 AS y, col*1.0 AS cx, row*1.0 AS cy, cos(value*9) AS tx, sin(value*9) AS ty, abs(value) + 0.5 AS radius FROM pixels WHERE value < 0),
k AS (SELECT image_id, col*1.0 AS x, row*1.0 AS y, cos(value*5) AS tx, sin(value*5) AS ty, -sin(value*5) AS nx, cos(value*5) AS ny FROM pixels WHERE value > 0.1),
p AS (SELECT h.*, k.tx AS btx, k.ty AS bty, k.nx AS bnx, k.ny AS bny, row_number() OVER (PARTITION BY h.image_id, sid ORDER BY sqrt((h.x-k.x)*(h.x-k.x)+(h.y-k.y)*(h.y-k.y)), k.tx, k.ty) AS rn FROM h JOIN k USING (image_id))
SELECT image_id, sid, round(abs(btx*tx+bty*ty), 8) AS tangent_alignment, round((bnx*(cx-x)+bny*(cy-y))/radius, 8) + 0.0 AS normal_consistency FROM p WHERE rn = 1""", "pixels")
def j21(spark, sf):
    p = bind.pixels(spark, sf)
    v, col, row = c("value"), c("col").cast("double"), c("row").cast("double")
    hits = p.where(v < 0).select("image_id", (c("row") * 8 + c("col")).alias("sid"), (col + v).alias("x"), (row + v / 2).alias("y"), col.alias("cx"), row.alias("cy"), F.cos(v * 9).alias("tx"), F.sin(v * 9).alias("ty"), (F.abs(v) + 0.5).alias("radius"))
    contour = p.where(v > 0.1).select("image_id", col.alias("x"), row.alias("y"), F.cos(v * 5).alias("tx"), F.sin(v * 5).alias("ty"), (-F.sin(v * 5)).alias("nx"), F.cos(v * 5).alias("ny"))
    b = spatial.nearest_boundary(hits, contour, IM, "sid")
    return b.select("image_id", "sid", r("tangent_alignment", 8).alias("tangent_alignment"), r("normal_consistency", 8).alias("normal_consistency"))


@query("w10_local_threshold", f"""WITH b AS ({BOX.format(src='pixels')})
SELECT image_id, row, col, round(m, 10) AS box_mean, value > m + 0.03 AS foreground FROM b JOIN pixels USING (image_id, row, col)""", "pixels")
def w10(spark, sf):
    t = pixels.local_threshold(px(spark, sf), IM, "value", "height", "width")
    return t.select("image_id", "row", "col", r("box_mean", 10).alias("box_mean"), "foreground")


@query("w07_footer_band", """
WITH p AS (SELECT l_suppkey AS image_id, l_partkey % 300 AS row, CASE WHEN l_partkey % 300 BETWEEN 205 + l_suppkey % 20 AND 230 + l_suppkey % 40 AND l_partkey % 300 % 11 > 0 THEN 250.0 ELSE l_quantity * 5 END AS v FROM lineitem),
r AS (SELECT image_id, row, avg((v > 240)::INT) AS f FROM p GROUP BY ALL),
k AS (SELECT image_id, row, CASE WHEN row - lag(row) OVER (PARTITION BY image_id ORDER BY row) <= 3 THEN 0 ELSE 1 END AS nw FROM r WHERE row >= floor(300*0.65) AND f > 0.6),
b AS (SELECT image_id, row, sum(nw) OVER (PARTITION BY image_id ORDER BY row) AS band FROM k),
g AS (SELECT image_id, band, min(row) AS a, max(row) AS z, count(*) AS n FROM b GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY image_id) AS rows, row_number() OVER (PARTITION BY image_id ORDER BY z-a DESC, a) AS rn FROM g)
SELECT image_id, greatest(0, a-4) AS footer_y0, least(300, z+5) AS footer_y1 FROM t WHERE rn = 1 AND rows >= 20 AND z - a >= 30""")
def w07(spark, sf):
    li = bind.table(spark, sf, "lineitem")
    row = c("l_partkey") % 300
    lit = row.between(205 + c("l_suppkey") % 20, 230 + c("l_suppkey") % 40) & (row % 11 > 0)
    p = li.select(c("l_suppkey").alias("image_id"), row.alias("row"), F.when(lit, 250.0).otherwise(c("l_quantity") * 5).alias("value"), F.lit(300).cast("long").alias("height"))
    return pixels.detect_footer(p, IM, "height")
