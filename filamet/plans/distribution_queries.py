"""Queries over weighted samples: quantiles, histograms, ECDF, distances, consensus, mixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from filamet.operators import distributions as D
from filamet.operators.quantiles import exact_quantiles, weighted_quantiles
from filamet.plans import bind
from filamet.plans.registry import query, r

c = F.col
TIE = ["ord1", "ord2", "ord3", "weight"]
IM = ["image_id", "method"]


def wq_sql(src: str, keys: str, levels: str) -> str:
    """Weighted quantiles by sorting each group: interpolation in the right-cumulative weight."""
    return f"""
    wq_c AS (SELECT {keys}, value AS x, weight AS w,
        sum(weight) OVER (PARTITION BY {keys} ORDER BY value, ord1, ord2, ord3, weight ROWS UNBOUNDED PRECEDING) AS cw,
        sum(weight) OVER (PARTITION BY {keys}) AS tw FROM {src}),
    wq_t AS (SELECT *, q * tw AS t FROM wq_c, (SELECT unnest({levels}) AS q)),
    wq_b AS (SELECT {keys}, q, any_value(t) AS t, max(CASE WHEN cw <= t THEN cw END) AS c0, max(CASE WHEN cw <= t THEN x END) AS x0,
        min(CASE WHEN cw > t THEN cw END) AS c1, min(CASE WHEN cw > t THEN x END) AS x1 FROM wq_t GROUP BY {keys}, q),
    wq AS (SELECT {keys}, q, CASE WHEN c0 IS NULL THEN x1 WHEN c1 IS NULL THEN x0 ELSE x0 + (x1 - x0) * (t - c0) / (c1 - c0) END AS v FROM wq_b)"""


LEVELS = "[0.05, 0.25, 0.5, 0.75, 0.95]::DOUBLE[]"
SUMMARY_SQL = f"""
WITH {wq_sql("samples", "image_id, method", LEVELS)},
q AS (SELECT image_id, method, max(v) FILTER (q = 0.05) AS p05, max(v) FILTER (q = 0.25) AS p25, max(v) FILTER (q = 0.5) AS p50, max(v) FILTER (q = 0.75) AS p75, max(v) FILTER (q = 0.95) AS p95 FROM wq GROUP BY ALL),
m AS (SELECT image_id, method, count(*) AS n, sum(weight) AS weight_sum, sum(weight*value)/sum(weight) AS mean FROM samples GROUP BY ALL),
s AS (SELECT image_id, method, sqrt(sum(weight*(value-mean)*(value-mean))/sum(weight)) AS std FROM samples JOIN m USING (image_id, method) GROUP BY ALL)"""


def rounded_summary(df, *keys):
    return df.select(*keys, "n", r("weight_sum", 3).alias("weight_sum"), *[r(k, 9).alias(k) for k in ("mean", "std", "p05", "p25", "p50", "p75", "p95")])


@query("a06_weighted_summary", SUMMARY_SQL + """
SELECT image_id, method, n, round(weight_sum, 3) AS weight_sum, round(mean, 9) AS mean, round(std, 9) AS std, round(p05, 9) AS p05, round(p25, 9) AS p25,
  round(p50, 9) AS p50, round(p75, 9) AS p75, round(p95, 9) AS p95 FROM m JOIN s USING (image_id, method) JOIN q USING (image_id, method)""", "samples")
def a06(spark, sf):
    return rounded_summary(D.weighted_summary(bind.samples(spark, sf), IM, "value", "weight", tie=TIE), *IM)


@query("d01_weighted_quantile_ties", f"""
WITH s2 AS (SELECT image_id, method, weight AS value, value AS weight, ord1, ord2, ord3 FROM samples),
{wq_sql("s2", "image_id, method", "[0.0, 0.1, 0.5, 0.9, 1.0]::DOUBLE[]")}
SELECT image_id, method, round(max(v) FILTER (q=0.0), 8) AS q0, round(max(v) FILTER (q=0.1), 8) AS q0_1, round(max(v) FILTER (q=0.5), 8) AS q0_5, round(max(v) FILTER (q=0.9), 8) AS q0_9, round(max(v) FILTER (q=1.0), 8) AS q1 FROM wq GROUP BY ALL""", "samples")
def d01(spark, sf):
    s = bind.samples(spark, sf).select("image_id", "method", c("weight").alias("value"), c("value").alias("weight"), "ord1", "ord2", "ord3")
    q = weighted_quantiles(s, IM, "value", "weight", [0.0, 0.1, 0.5, 0.9, 1.0], tie=TIE)
    return q.select(*IM, *[r(k, 8).alias(k) for k in q.columns if k not in IM])


EDGES_SQL = """
e0 AS (SELECT image_id, min(value) AS mn, max(value) AS mx FROM samples GROUP BY image_id),
e AS (SELECT image_id, CASE WHEN flat THEN mn - half ELSE mn END AS lo, CASE WHEN flat THEN mn + half ELSE mx END AS hi, CASE WHEN flat THEN 1 ELSE 32 END AS bins
  FROM (SELECT *, abs(mn-mx) <= 1e-8 + 1e-5*abs(mx) AS flat, greatest(abs(mn)*0.05, 0.5) AS half FROM e0))"""


@query("d02_common_edges", f"WITH {EDGES_SQL} SELECT image_id, bins, round(lo, 9) AS lo, round(hi, 9) AS hi FROM e", "samples")
def d02(spark, sf):
    e = D.common_edges(bind.samples(spark, sf), ["image_id"], "value")
    return e.select("image_id", "bins", r("lo", 9).alias("lo"), r("hi", 9).alias("hi"))


@query("d03_weighted_histogram", f"""
WITH {EDGES_SQL},
b AS (SELECT image_id, bins, i AS bin, i*((hi-lo)/bins)+lo AS l, CASE WHEN i+1 = bins THEN hi ELSE (i+1)*((hi-lo)/bins)+lo END AS u FROM e, LATERAL (SELECT unnest(range(0, bins)) AS i)),
f AS (SELECT DISTINCT image_id, method FROM samples),
t AS (SELECT image_id, method, sum(weight) AS tw FROM samples GROUP BY ALL),
h AS (SELECT s.image_id, s.method, b.bin, sum(weight) AS h, count(*) AS n FROM samples s JOIN b ON s.image_id = b.image_id AND s.value >= b.l AND (s.value < b.u OR b.bin = b.bins - 1) GROUP BY ALL)
SELECT f.image_id, f.method, b.bin::INTEGER AS bin, round(coalesce(h.h, 0), 6) AS h, coalesce(h.n, 0)::BIGINT AS n, round(coalesce(h.h, 0)/(tw*(b.u-b.l)), 12) AS density
FROM f JOIN b USING (image_id) JOIN t USING (image_id, method) LEFT JOIN h ON h.image_id = f.image_id AND h.method = f.method AND h.bin = b.bin""", "samples")
def d03(spark, sf):
    s = bind.samples(spark, sf)
    h = D.weighted_histogram(s, ["image_id"], ["method"], "value", "weight", D.common_edges(s, ["image_id"], "value"))
    return h.select("image_id", "method", "bin", r("h", 6).alias("h"), "n", r("density", 12).alias("density"))


@query("d04_ecdf", """
SELECT image_id, method, ord1, ord2, ord3, round(value, 6) AS value, round(sum(weight) OVER (PARTITION BY image_id, method ORDER BY value, ord1, ord2, ord3, weight ROWS UNBOUNDED PRECEDING) / sum(weight) OVER (PARTITION BY image_id, method), 11) AS ecdf FROM samples""", "samples")
def d04(spark, sf):
    e = D.ecdf(bind.samples(spark, sf), IM, "value", "weight", TIE)
    return e.select("image_id", "method", "ord1", "ord2", "ord3", r("value", 6).alias("value"), r("ecdf", 11).alias("ecdf"))


def dist_sql(src: str = "samples", keys: str = "image_id") -> str:
    return f"""
    dx AS (SELECT {keys}, value AS x, method, sum(weight) AS w, count(*)::DOUBLE AS n FROM {src} GROUP BY {keys}, value, method),
    dp AS (SELECT a.{keys} AS {keys}, a.method AS l, b.method AS r FROM (SELECT DISTINCT {keys}, method FROM {src}) a JOIN (SELECT DISTINCT {keys}, method FROM {src}) b ON a.{keys} = b.{keys} AND a.method < b.method),
    dc AS (SELECT p.{keys}, p.l, p.r, x, sum(CASE WHEN method = p.l THEN w ELSE 0 END) AS lw, sum(CASE WHEN method = p.r THEN w ELSE 0 END) AS rw,
        sum(CASE WHEN method = p.l THEN n ELSE 0 END) AS ln, sum(CASE WHEN method = p.r THEN n ELSE 0 END) AS rn
        FROM dp p JOIN dx ON dx.{keys} = p.{keys} AND dx.method IN (p.l, p.r) GROUP BY ALL),
    dr AS (SELECT {keys}, l, r, x, lead(x) OVER k AS nx,
        sum(lw) OVER k / sum(lw) OVER g AS fl, sum(rw) OVER k / sum(rw) OVER g AS fr, sum(ln) OVER k / sum(ln) OVER g AS gl, sum(rn) OVER k / sum(rn) OVER g AS gr
        FROM dc WINDOW k AS (PARTITION BY {keys}, l, r ORDER BY x ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY {keys}, l, r)),
    dd AS (SELECT {keys}, l, r, sum(abs(fl-fr)*coalesce(nx-x, 0)) AS w1, sum(abs(gl-gr)*coalesce(nx-x, 0)) AS w1u, max(abs(gl-gr)) AS ks FROM dr GROUP BY ALL)"""


@query("d05_wasserstein", f"WITH {dist_sql()} SELECT image_id, l AS \"left\", r AS \"right\", round(w1, 9) AS w1, round(w1u, 9) AS w1_unweighted FROM dd", "samples")
def d05(spark, sf):
    d = D.pair_distances(bind.samples(spark, sf), ["image_id"], "method", bind.METHODS, "value", "weight")
    return d.select("image_id", "left", "right", r("w1", 9).alias("w1"), r("w1_unweighted", 9).alias("w1_unweighted"))


@query("d06_kolmogorov_smirnov", f"""
WITH q AS (SELECT image_id, method, weight AS value, 1.0::DOUBLE AS weight FROM samples), {dist_sql("q")}
SELECT image_id, l AS "left", r AS "right", round(ks, 10) AS ks FROM dd""", "samples")
def d06(spark, sf):
    # quantities: many ties, so both CDFs jump at the same values
    s = bind.samples(spark, sf).select("image_id", "method", c("weight").alias("value"), F.lit(1.0).alias("weight"))
    d = D.pair_distances(s, ["image_id"], "method", bind.METHODS, "value", "weight")
    return d.select("image_id", "left", "right", r("ks", 10).alias("ks"))


@query("j03_method_agreements", f"""
WITH {dist_sql()}, {wq_sql("samples", "image_id, method", "[0.5]::DOUBLE[]")},
m AS (SELECT image_id, method, sum(weight*value)/sum(weight) AS mean FROM samples GROUP BY ALL),
k AS (SELECT image_id, method, mean, v AS med FROM m JOIN wq USING (image_id, method))
SELECT image_id, l AS "left", r AS "right", round(a.mean-b.mean, 8) AS mean_difference, round(a.med-b.med, 8) AS median_difference, round(100*(a.med-b.med)/abs(b.med), 7) AS rel_percent,
  round(w1, 9) AS w1, round(ks, 10) AS ks FROM dd JOIN k a USING (image_id) JOIN k b USING (image_id) WHERE a.method = l AND b.method = r""", "samples")
def j03(spark, sf):
    a = D.agreements(bind.samples(spark, sf), ["image_id"], "method", bind.METHODS, "value", "weight", tie=TIE)
    return a.select("image_id", "left", "right", r("mean_difference", 8).alias("mean_difference"), r("median_difference", 8).alias("median_difference"),
                    r("relative_median_difference_percent", 7).alias("rel_percent"), r("wasserstein_1", 9).alias("w1"), r("ks_statistic", 10).alias("ks"))


MEMBERS_SQL = "mb AS (SELECT DISTINCT image_id, method, CASE WHEN method = 'N' AND image_id % 2 = 0 THEN 'px' ELSE 'um' END AS unit FROM samples), fm AS (SELECT image_id, arg_min(unit, method) AS base FROM mb GROUP BY image_id), cs AS (SELECT s.* FROM samples s JOIN mb USING (image_id, method) JOIN fm USING (image_id) WHERE unit = base)"


def members(spark, sf):
    """Series of each image with unit and estimand; method N of every other image is uncalibrated."""
    s = bind.samples(spark, sf).select("image_id", "method").distinct()
    return s.withColumns({"unit": F.when((c("method") == "N") & (c("image_id") % 2 == 0), "px").otherwise("um"), "estimand": F.lit("DIAMETER")})


@query("d07_consensus", f"""
WITH {MEMBERS_SQL}, {wq_sql("cs", "image_id, method", "list_transform(range(0, 101), lambda i: i/100.0::DOUBLE)")},
c AS (SELECT image_id, round(q*100)::INTEGER AS level, quantile_cont(v, 0.5) AS con, count(*) AS n_methods FROM wq GROUP BY ALL),
d AS (SELECT wq.image_id, round(q*100)::INTEGER AS level, quantile_cont(abs(v-con), 0.5) AS mad FROM wq JOIN c ON wq.image_id = c.image_id AND round(wq.q*100)::INTEGER = c.level GROUP BY wq.image_id, round(q*100)::INTEGER)
SELECT image_id, level, n_methods, round(con, 8) AS consensus, round(mad, 8) AS disagreement_mad FROM c JOIN d USING (image_id, level)""", "samples")
def d07(spark, sf):
    s = bind.samples(spark, sf)
    m = D.consensus_members(members(spark, sf), s, ["image_id"], "method", bind.METHODS, "value").where("included").select("image_id", "method")
    k = D.consensus(s.join(m, ["image_id", "method"]), ["image_id"], "method", "value", "weight", tie=TIE)
    return k.select("image_id", "level", "n_methods", r("consensus", 8).alias("consensus"), r("disagreement_mad", 8).alias("disagreement_mad"))


@query("d08_equal_image_mixture", f"""
WITH t AS (SELECT image_id, method, sum(weight) AS tw FROM samples GROUP BY ALL),
s2 AS (SELECT method, value, s.weight/tw AS weight, ord1, ord2, ord3 FROM samples s JOIN t USING (image_id, method)),
{wq_sql("s2", "method", LEVELS)},
m AS (SELECT method, count(*) AS n, sum(weight*value)/sum(weight) AS mean FROM s2 GROUP BY ALL),
sd AS (SELECT method, sqrt(sum(weight*(value-mean)*(value-mean))/sum(weight)) AS std FROM s2 JOIN m USING (method) GROUP BY ALL)
SELECT method, (SELECT count(*) FROM t WHERE t.method = m.method) AS images, n, round(mean, 8) AS mean, round(std, 8) AS std,
  round((SELECT v FROM wq WHERE wq.method = m.method AND q = 0.5), 6) AS p50, round((SELECT v FROM wq WHERE wq.method = m.method AND q = 0.05), 6) AS p05,
  round((SELECT v FROM wq WHERE wq.method = m.method AND q = 0.95), 6) AS p95,
  round((SELECT v FROM wq WHERE wq.method = m.method AND q = 0.75) - (SELECT v FROM wq WHERE wq.method = m.method AND q = 0.25), 6) AS iqr FROM m JOIN sd USING (method)""", "samples")
def d08(spark, sf):
    m = D.mixture_table(bind.samples(spark, sf), "image_id", "method", "value", "weight", tie=["ord1", "ord2", "ord3"])
    return m.select("method", "images", "n", *[r(k, 8).alias(k) for k in ("mean", "std")], *[r(k, 6).alias(k) for k in ("p50", "p05", "p95", "iqr")])


@query("d09_image_balanced_samples", SUMMARY_SQL + """,
l AS (SELECT image_id, method, unnest([{'k': 'p05', 'v': p05}, {'k': 'p25', 'v': p25}, {'k': 'p50', 'v': p50}, {'k': 'p75', 'v': p75}, {'k': 'p95', 'v': p95}]) AS e FROM q WHERE image_id % 9 <> 0)
SELECT image_id, method, e.k AS level, round(e.v, 8) AS value, 0.2::DOUBLE AS weight FROM l""", "samples")
def d09(spark, sf):
    # a stored summary without P95 stands for an image whose report is incomplete
    q = weighted_quantiles(bind.samples(spark, sf), IM, "value", "weight", D.SUMMARY_PROBS, tie=TIE, names=D.SUMMARY_NAMES)
    q = q.withColumn("p95", F.when(c("image_id") % 9 != 0, c("p95")))
    return D.image_balanced_samples(q, "image_id", "method").withColumn("value", r("value", 8))


@query("d10_scott_bins", """
WITH s AS (SELECT image_id, min(value) AS mn, max(value) AS mx, 3.5*stddev_samp(value)*pow(count(*), -1.0/3.0) AS raw FROM samples GROUP BY image_id),
p AS (SELECT *, pow(10.0, floor(log10(raw))) AS pw FROM s),
w AS (SELECT image_id, mn, mx, list_min(list_transform([1.0,2.0,3.0,5.0,10.0], lambda k: {'d': abs(k*pw-raw), 'v': k*pw})).v AS width FROM p),
e AS (SELECT image_id, width, floor(mn/width) AS f, ceil(mx/width) AS l FROM w),
h AS (SELECT e.image_id, width, least(floor(value/width), l-1) - f AS bin, count(*) AS n FROM samples JOIN e USING (image_id) GROUP BY ALL),
b AS (SELECT image_id, width, f, unnest(range(0, (l-f)::BIGINT)) AS bin FROM e)
SELECT image_id, round(b.width, 6) AS width, b.bin::INTEGER AS bin, round((f+b.bin)*b.width, 6) AS left_edge, coalesce(n, 0)::BIGINT AS n FROM b LEFT JOIN h USING (image_id, bin)""", "samples")
def d10(spark, sf):
    s = bind.samples(spark, sf).select("image_id", "value").withColumn("one", F.lit(1.0))
    e = D.scott_edges(s, ["image_id"], "value")
    h = D.weighted_histogram(s, ["image_id"], [], "value", "one", e.drop("width"))
    return h.join(e.select("image_id", "width"), "image_id").select("image_id", r("width", 6).alias("width"), "bin", r("left_edge", 6).alias("left_edge"), "n")


def positive_widths(spark, sf):
    m = bind.measurements(spark, sf)
    return m.where(c("status").isin("ACCEPTED", "MANUALLY_EDITED") & (c("width_m") > 0)).withColumn("width_um", c("width_m") * 1e6)


@query("d11_measurement_histogram", """
WITH w AS (SELECT image_id, fiber_id, width_m*1e6::DOUBLE AS v FROM measurements WHERE status IN ('ACCEPTED','MANUALLY_EDITED') AND width_m > 0),
f AS (SELECT image_id, quantile_cont(v, 0.5) AS v FROM w GROUP BY image_id, fiber_id),
x AS (SELECT 'section' AS mode, image_id, v FROM w UNION ALL SELECT 'fiber', image_id, v FROM f),
e AS (SELECT mode, image_id, CASE WHEN min(v)=max(v) THEN min(v)-0.5 ELSE min(v) END AS lo, CASE WHEN min(v)=max(v) THEN max(v)+0.5 ELSE max(v) END AS hi FROM x GROUP BY ALL),
b AS (SELECT *, i*((hi-lo)/10)+lo AS l, CASE WHEN i=9 THEN hi ELSE (i+1)*((hi-lo)/10)+lo END AS u FROM e, (SELECT unnest(range(0,10)) AS i))
SELECT b.mode, b.image_id, i::INTEGER AS bin, count(v) AS n, round(b.l, 8) AS left_edge FROM b LEFT JOIN x ON x.mode = b.mode AND x.image_id = b.image_id AND v >= l AND (v < u OR i = 9) GROUP BY ALL""", "measurements")
def d11(spark, sf):
    w = positive_widths(spark, sf)
    fibers = exact_quantiles(w, ["image_id", "fiber_id"], "width_um", [0.5], names=["v"]).select(F.lit("fiber").alias("mode"), "image_id", "v")
    both = w.select(F.lit("section").alias("mode"), "image_id", c("width_um").alias("v")).unionByName(fibers)
    h = D.measurement_histogram(both, ["mode", "image_id"], "v", 10)
    return h.select("mode", "image_id", "bin", "n", r("left_edge", 8).alias("left_edge"))


@query("d12_estimator_table", SUMMARY_SQL + """,
d(method, label) AS (VALUES ('A','Raw EDT'),('N','Raw Edge'),('R','Manual'),('X','Refined Edge')),
i AS (SELECT image_id, count(*) AS total FROM samples GROUP BY image_id)
SELECT i.image_id, label, coalesce(n, 0)::BIGINT AS n, round(mean, 9) AS mean, round(p50, 9) AS median, round(p75-p25, 9) AS iqr, round(p05, 9) AS p05, round(p95, 9) AS p95,
  CASE WHEN n IS NULL THEN 'NOT_RUN' ELSE 'COMPLETE' END AS status, round(n / total, 9) AS coverage FROM i CROSS JOIN d LEFT JOIN m ON m.image_id = i.image_id AND m.method = d.method LEFT JOIN q ON q.image_id = i.image_id AND q.method = d.method""", "samples")
def d12(spark, sf):
    from filamet.operators.reports import estimator_table
    s = bind.samples(spark, sf)
    return estimator_table(
        D.weighted_summary(s, IM, "value", "weight", tie=TIE).join(s.groupBy("image_id").agg(F.count(F.lit(1)).alias("total")), "image_id"), "image_id", "method",
        [("A", "Raw EDT"), ("N", "Raw Edge"), ("R", "Manual"), ("X", "Refined Edge")],
    ).select("image_id", "label", "n", r("mean", 9).alias("mean"), r("median", 9).alias("median"), r("iqr", 9).alias("iqr"), r("p05", 9).alias("p05"), r("p95", 9).alias("p95"), "status", r("coverage", 9).alias("coverage"))


@query("a37_axis_range", f"""
WITH {wq_sql("samples", "image_id, method", "[0.5, 0.95, 0.99]::DOUBLE[]")}
SELECT image_id, round(max(v) FILTER (q = 0.99 AND method <> 'R')*1.12, 8) AS x_max,
  round(max(v) FILTER (q = 0.95 AND method = 'A') / max(v) FILTER (q = 0.5 AND method = 'A'), 8) AS tail_ratio FROM wq GROUP BY image_id""", "samples")
def a37(spark, sf):
    axis, tail = D.range_and_tail(bind.samples(spark, sf), ["image_id"], "method", "value", "weight", exclude=["R"], tie=TIE)
    return axis.join(tail.where(c("method") == "A"), "image_id").select("image_id", r("x_max", 8).alias("x_max"), r("tail_ratio", 8).alias("tail_ratio"))
