"""Queries over reviewed measurements: levels, extrema, classes, repeatability, bootstrap, matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from filamet.functions import records as R
from filamet.operators import bootstrap, kmeans, spatial, stats
from filamet.operators.ordered import order_bucket, ordered
from filamet.operators.quantiles import exact_quantiles
from filamet.plans import bind
from filamet.plans.registry import query, r

c = F.col

USED = "used AS (SELECT *, width_m*1e9::DOUBLE/997 AS v FROM measurements WHERE status IN ('ACCEPTED','MANUALLY_EDITED') AND width_m > 0)"


def used(spark, sf):
    m = bind.measurements(spark, sf)
    return stats.usable_sections(m, R.is_included(c("status")), "width_m").withColumn("v", c("width_m") * 1e9 / 997)


def level_sql(src: str, keys: str, x: str = "v") -> str:
    return f"""SELECT {keys}, count({x}) AS n, round(avg({x}), 8) AS mean, round(coalesce(stddev_samp({x}), 0), 8) AS sd, round(min({x}), 8) AS min, round(max({x}), 8) AS max,
    round(quantile_cont({x}, 0.5), 8) AS median, round(quantile_cont({x}, 0.05), 8) AS p05, round(quantile_cont({x}, 0.95), 8) AS p95,
    round(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25), 8) AS iqr"""


def rounded_levels(df, *keys):
    return df.select(*keys, "n", *[r(k, 8).alias(k) for k in ("mean", "sd", "min", "max", "median", "p05", "p95", "iqr")])


@query("a01_section_statistics", f"WITH {USED} {level_sql('used', 'image_id')}, count(DISTINCT fiber_id) AS n_fibers FROM used GROUP BY image_id", "measurements")
def a01(spark, sf):
    s = stats.section_summary(used(spark, sf), ["image_id"], "v", "fiber_id")
    return rounded_levels(s, "image_id", "n_fibers")


@query("a02_fiber_statistics", f"WITH {USED} {level_sql('used', 'image_id, fiber_id')} FROM used GROUP BY image_id, fiber_id", "measurements")
def a02(spark, sf):
    return rounded_levels(stats.level_metrics(used(spark, sf), ["image_id", "fiber_id"], "v"), "image_id", "fiber_id")


@query("a03_fiber_level_summary", f"""
WITH {USED}, f AS (SELECT image_id, fiber_id, quantile_cont(v, 0.5) AS v, count(*) AS k FROM used GROUP BY ALL)
{level_sql('f', 'image_id')}, sum(k)::BIGINT AS n_measurements FROM f GROUP BY image_id""", "measurements")
def a03(spark, sf):
    return rounded_levels(stats.fiber_summary(used(spark, sf), ["image_id"], "fiber_id", "v"), "image_id", "n_measurements")


@query("a04_hierarchy", f"""
WITH u AS (SELECT sample_id, image_id, CASE WHEN fiber_id = 'F001' THEN 'UNASSIGNED' ELSE fiber_id END AS fiber_id, width_m*1e9::DOUBLE/997 AS v FROM measurements WHERE status IN ('ACCEPTED','MANUALLY_EDITED') AND kind = 'PROJECTED_WIDTH'),
l AS (SELECT sample_id, 'section' AS level, v FROM u UNION ALL SELECT sample_id, 'fiber', quantile_cont(v, 0.5) FROM u GROUP BY sample_id, image_id, fiber_id
  UNION ALL SELECT sample_id, 'image', quantile_cont(v, 0.5) FROM u GROUP BY sample_id, image_id),
k AS (SELECT sample_id, count(DISTINCT image_id) AS n_images, count(DISTINCT image_id || '/' || fiber_id) AS n_fibers, count(*) AS n_sections FROM u GROUP BY sample_id),
m AS ({level_sql('l', 'sample_id, level')} FROM l GROUP BY sample_id, level)
SELECT *, NULL::BIGINT AS n_images, NULL::BIGINT AS n_fibers, NULL::BIGINT AS n_sections FROM m
UNION ALL SELECT m.* REPLACE ('sample' AS level), n_images, n_fibers, n_sections FROM m JOIN k USING (sample_id) WHERE level = 'image'""", "measurements")
def a04(spark, sf):
    m = bind.measurements(spark, sf).where(R.is_included(c("status")) & (c("kind") == "PROJECTED_WIDTH"))
    m = m.select("sample_id", "image_id", F.when(c("fiber_id") != "F001", c("fiber_id")).alias("fiber_id"), (c("width_m") * 1e9 / 997).alias("v"))
    return rounded_levels(stats.hierarchy(m, "sample_id", "image_id", "fiber_id", "v"), "sample_id", "level", "n_images", "n_fibers", "n_sections")


@query("a05_completeness", """
WITH a AS (SELECT image_id, fiber_id, count(*) FILTER (status IN ('ACCEPTED','MANUALLY_EDITED')) AS accepted, max(CASE WHEN image_id % 3 = 0 THEN 0 ELSE 12 END) AS target FROM measurements WHERE kind = 'PROJECTED_WIDTH' GROUP BY ALL)
SELECT image_id, fiber_id, accepted, target, accepted >= CASE WHEN target > 0 THEN target ELSE 1 END AS complete FROM a""", "measurements")
def a05(spark, sf):
    m = bind.measurements(spark, sf).where(c("kind") == "PROJECTED_WIDTH")
    return stats.completeness(m, ["image_id", "fiber_id"], R.is_included(c("status")), F.when(c("image_id") % 3 == 0, 0).otherwise(12))


@query("w01_extrema_labels", f"""
WITH {USED}, m AS (SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY image_id, fiber_id) AS med, count(*) OVER (PARTITION BY image_id, fiber_id) AS n FROM used),
d AS (SELECT *, abs(v/med-1) AS away, min(abs(v/med-1)) OVER (PARTITION BY image_id, fiber_id) AS least FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id, fiber_id ORDER BY v, measurement_id) AS lo, row_number() OVER (PARTITION BY image_id, fiber_id ORDER BY v DESC, measurement_id DESC) AS hi,
  row_number() OVER (PARTITION BY image_id, fiber_id ORDER BY away > least + 1e-12::DOUBLE, v, measurement_id) AS mid FROM d)
SELECT image_id, fiber_id, measurement_id, concat_ws(',', CASE WHEN lo = 1 THEN 'MIN' END, CASE WHEN mid = 1 AND n <> 2 THEN 'MED' END, CASE WHEN hi = 1 THEN 'MAX' END) AS labels
FROM k WHERE lo = 1 OR hi = 1 OR (mid = 1 AND n <> 2)""", "measurements")
def w01(spark, sf):
    return stats.extrema_labels(used(spark, sf), ["image_id", "fiber_id"], "v", "measurement_id")


def repeatability_items(spark, sf):
    o = bind.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", (c("o_totalprice") / 1009).alias("price"))
    # consecutive orders of a customer are the two rounds of one item
    order = ["o_orderdate", "o_orderkey"]
    run = ordered(order_bucket(o, ["o_custkey"], order), ["o_custkey"], order, lags={"original": "price"})
    return run.where(c("original").isNotNull()).select(
        (c("o_custkey") % 400).alias("study_id"), "original", F.when(c("o_orderstatus") != "P", c("price")).alias("measured"))


@query("a07_repeatability", """
WITH o AS (SELECT o_custkey % 400 AS study_id, lag(o_totalprice/1009) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS original, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice/1009 END AS measured FROM orders),
i AS (SELECT *, measured - original AS d FROM o WHERE original IS NOT NULL),
a AS (SELECT study_id, count(d) AS n_pairs, avg((original+measured)/2) AS mv, avg(abs(d)) AS mad, avg(abs(d)/greatest(original, 1e-15)) AS mrd, sqrt(sum(d*d)/(2*count(d))) AS si, avg(d) AS bias, stddev_samp(d) AS sd FROM i GROUP BY study_id)
SELECT study_id, n_pairs, CASE WHEN n_pairs >= 2 THEN 'SUFFICIENT' ELSE 'N_INSUFFICIENT' END AS status, round(CASE WHEN n_pairs>=2 THEN mad END, 7) AS mad, round(CASE WHEN n_pairs>=2 THEN mrd END, 9) AS mrd,
  round(CASE WHEN n_pairs>=2 THEN si END, 7) AS s_intra, round(CASE WHEN n_pairs>=2 THEN si/mv END, 9) AS cv, round(CASE WHEN n_pairs>=2 THEN bias END, 7) AS bias,
  round(CASE WHEN n_pairs>=5 THEN bias-1.96*sd END, 7) AS lower, round(CASE WHEN n_pairs>=5 THEN bias+1.96*sd END, 7) AS upper FROM a""")
def a07(spark, sf):
    s = stats.repeatability(repeatability_items(spark, sf), ["study_id"], "original", "measured")
    return s.select("study_id", "n_pairs", "status", r("mean_abs_diff", 7).alias("mad"), r("mean_rel_diff", 9).alias("mrd"), r("s_intra", 7).alias("s_intra"), r("cv", 9).alias("cv"),
                    r("bias", 7).alias("bias"), r("bland_altman_lower", 7).alias("lower"), r("bland_altman_upper", 7).alias("upper"))


@query("a27_blind_session", """
WITH o AS (SELECT o_orderkey::VARCHAR AS record_id, o_totalprice AS original_value FROM orders WHERE o_orderstatus <> 'P')
SELECT 'GRP_' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS reference_group_id, record_id, original_value, 1 AS round_number, 'STUDY_000042' AS study_id
FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || record_id), record_id) AS n FROM o)""")
def a27(spark, sf):
    o = bind.table(spark, sf, "orders").select(c("o_orderkey").cast("string").alias("record_id"), F.when(c("o_orderstatus") != "P", c("o_totalprice")).alias("value"))
    return stats.blind_session(o, "record_id", "value", 42)


def medians(spark, sf):
    return exact_quantiles(used(spark, sf), ["image_id", "fiber_id"], "v", [0.5], names=["median_um"])


# Lloyd steps for all k side by side until nothing changes; then the least BIC, the smaller k on a tie
@query("a28_cluster_fibers", f"""
WITH RECURSIVE {USED}, f AS (SELECT image_id, fiber_id, quantile_cont(v, 0.5) AS m FROM used GROUP BY ALL), d AS (SELECT image_id, fiber_id, m, ln(m) AS x FROM f WHERE m > 0),
t AS (SELECT count(*) AS n FROM d), ks AS (SELECT unnest(range(1, least(4, n) + 1)) AS k FROM t),
q AS (SELECT quantile_cont(x, 0.5) AS h, [quantile_cont(x, 0.3333333333333333), quantile_cont(x, 0.6666666666666666)] AS c2, [quantile_cont(x, 0.25), quantile_cont(x, 0.5), quantile_cont(x, 0.75)] AS c3, [quantile_cont(x, 0.2), quantile_cont(x, 0.4), quantile_cont(x, 0.6), quantile_cont(x, 0.8)] AS c4 FROM d),
s0 AS (SELECT k, CASE k WHEN 1 THEN [h] WHEN 2 THEN c2 WHEN 3 THEN c3 ELSE c4 END AS cs FROM ks, q),
st(k, cs, old, step) AS (SELECT k, cs, NULL::DOUBLE[], 0 FROM s0
  UNION ALL SELECT k, list(coalesce(c, cs[j]) ORDER BY j), cs, step + 1 FROM (
    SELECT k, cs, step, j, avg(x) FILTER (lab = j) AS c FROM (
      SELECT st.k, cs, step, x, unnest(range(1, st.k + 1)) AS j, list_position(list_transform(cs, lambda c: abs(x - c)), list_min(list_transform(cs, lambda c: abs(x - c)))) AS lab FROM st, d WHERE step < 100 AND (old IS NULL OR old <> cs)) z
      GROUP BY k, cs, step, j) y GROUP BY k, cs, step),
fin AS (SELECT k, list_sort(arg_max(cs, step)) AS cs FROM st GROUP BY k),
bic AS (SELECT k, cs, n * ln(greatest(rss / n, 1e-12)) + 2 * k * ln(greatest(n, 2)) + 1.5 * k AS b FROM (SELECT k, cs, sum(list_min(list_transform(cs, lambda c: pow(x - c, 2)))) AS rss FROM fin, d GROUP BY k, cs), t),
best AS (SELECT cs FROM bic ORDER BY b, k LIMIT 1)
SELECT image_id, fiber_id, round(m, 6) AS median_um, (list_position(list_transform(cs, lambda c: abs(x - c)), list_min(list_transform(cs, lambda c: abs(x - c)))) - 1)::INTEGER AS "group" FROM d, best""", "measurements")
def a28(spark, sf):
    g = kmeans.cluster_log_medians(medians(spark, sf), "median_um")
    return g.select("image_id", "fiber_id", r("median_um", 6).alias("median_um"), "group")


@query("a29_range_classes", f"""
WITH {USED}, f AS (SELECT image_id, fiber_id, quantile_cont(v, 0.5) AS m FROM used GROUP BY ALL)
SELECT image_id, fiber_id, CASE WHEN m BETWEEN 0 AND 40 THEN 0 WHEN m BETWEEN 40 AND 55 THEN 1 WHEN m BETWEEN 60 AND 70 THEN 2 END AS "group" FROM f""", "measurements")
def a29(spark, sf):
    g = stats.classify_by_ranges(medians(spark, sf), "median_um", [("thin", 0.0, 40.0), ("mid", 40.0, 55.0), ("thick", 60.0, 70.0)])
    return g.select("image_id", "fiber_id", "group")


REPLICATES = 1000


@query("a26_hierarchical_bootstrap", f"""
WITH {USED},
sec AS (SELECT image_id AS img, fiber_id AS fib, v, row_number() OVER (PARTITION BY image_id, fiber_id ORDER BY v, measurement_id) AS s, count(*) OVER (PARTITION BY image_id, fiber_id) AS n_sec FROM used),
fib AS (SELECT img, fib, any_value(n_sec) AS n_sec, row_number() OVER (PARTITION BY img ORDER BY fib) AS f, count(*) OVER (PARTITION BY img) AS n_fib FROM sec GROUP BY img, fib),
im AS (SELECT img, any_value(n_fib) AS n_fib, row_number() OVER (ORDER BY img) AS i, count(*) OVER () AS n_img FROM fib GROUP BY img),
p1 AS (SELECT rr AS r, i AS si, ('0x' || substr(md5(concat_ws('|', 42, rr, i)), 1, 8))::BIGINT % n_img + 1 AS i FROM im, range(1, {REPLICATES + 1}) t(rr)),
p2 AS (SELECT r, si, img, n_fib, sf FROM p1 JOIN im USING (i), LATERAL (SELECT unnest(range(1, n_fib + 1)) AS sf)),
p3 AS (SELECT r, si, sf, img, ('0x' || substr(md5(concat_ws('|', 42, r, si, sf)), 1, 8))::BIGINT % n_fib + 1 AS f FROM p2),
p4 AS (SELECT r, si, sf, img, fib, n_sec, ss FROM p3 JOIN fib USING (img, f), LATERAL (SELECT unnest(range(1, n_sec + 1)) AS ss)),
p5 AS (SELECT r, si, sf, img, fib, ('0x' || substr(md5(concat_ws('|', 42, r, si, sf, ss)), 1, 8))::BIGINT % n_sec + 1 AS s FROM p4),
m AS (SELECT r, si, sf, quantile_cont(v, 0.5) AS m FROM p5 JOIN sec USING (img, fib, s) GROUP BY ALL),
b AS (SELECT r, quantile_cont(m, 0.5) AS m FROM m GROUP BY r)
SELECT round(avg(m), 7) AS bootstrap_mean, round(quantile_cont(m, 0.025), 7) AS ci_lower, round(quantile_cont(m, 0.975), 7) AS ci_upper, count(*) AS replicates FROM b""", "measurements")
def a26(spark, sf):
    b = bootstrap.hierarchical_bootstrap(used(spark, sf), "image_id", "fiber_id", "v", "measurement_id", replicates=REPLICATES, seed=42)
    return b.select(r("bootstrap_mean", 7).alias("bootstrap_mean"), r("ci_lower", 7).alias("ci_lower"), r("ci_upper", 7).alias("ci_upper"), "replicates")


def centred(spark, sf):
    m = bind.measurements(spark, sf)
    return m.select("image_id", "measurement_id", "source", "status", F.round((c("x1") + c("x2")) / 2, 1).alias("x"), F.round((c("y1") + c("y2")) / 2, 1).alias("y"), (c("width_m") * 1e6).alias("value"))


@query("j01_nearest_reference", """
WITH m AS (SELECT image_id, measurement_id, source, status, round((x1+x2)/2, 1) AS x, round((y1+y2)/2, 1) AS y, width_m*1e6::DOUBLE AS v FROM measurements),
a AS (SELECT *, row_number() OVER () AS rid FROM m WHERE contains(source, 'AUTO')), b AS (SELECT * FROM m WHERE source = 'MANUAL' AND status IN ('ACCEPTED','MANUALLY_EDITED')),
p AS (SELECT a.image_id, a.rid, a.measurement_id AS auto_id, b.measurement_id AS manual_id, a.v AS av, b.v AS mv, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d FROM a JOIN b USING (image_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, manual_id, mv) AS rn FROM p)
SELECT image_id, auto_id, manual_id, round(abs(av-mv), 8) AS abs_diff, round(abs(av-mv)/greatest(mv, 1e-15), 8) AS rel_diff, round(d, 6) AS distance FROM k WHERE rn = 1 AND d <= 150""", "measurements")
def j01(spark, sf):
    m = centred(spark, sf)
    auto = m.where(F.contains(c("source"), F.lit("AUTO")))
    manual = m.where((c("source") == "MANUAL") & R.is_included(c("status")))
    p = spatial.pair_nearest_reference(auto, manual, ["image_id"])
    return p.select("image_id", "auto_id", "manual_id", r("absolute_difference", 8).alias("abs_diff"), r("relative_difference", 8).alias("rel_diff"), r("center_distance_px").alias("distance"))


@query("j02_candidate_vs_manual", """
SELECT a.o_orderkey AS pair_id, round(a.o_totalprice/1009, 8) AS candidate_um, round(l.l_extendedprice/1009, 8) AS manual_um, round(abs(a.o_totalprice-l.l_extendedprice)/1009, 8) AS abs_diff_um,
  round(abs(a.o_totalprice-l.l_extendedprice)/l.l_extendedprice*100, 8) AS rel_diff_pct,
  round(sqrt(pow(CASE WHEN a.o_orderkey % 5 > 0 THEN a.o_custkey ELSE 0 END - l.l_partkey, 2) + pow(CASE WHEN a.o_orderkey % 5 > 0 THEN a.o_orderkey % 977 ELSE 0 END - l.l_suppkey, 2)), 8) AS center_dist_px, l.l_linenumber FROM orders a JOIN lineitem l ON a.o_orderkey = l.l_orderkey WHERE l.l_returnflag = 'A'""")
def j02(spark, sf):
    from filamet.operators.campaign import candidate_vs_manual
    cand = bind.table(spark, sf, "orders").select(c("o_orderkey").alias("pair_id"), (c("o_totalprice") / 1009).alias("candidate"), *[F.when(c("o_orderkey") % 5 > 0, v.cast("double")).alias(n) for n, v in (("cx", c("o_custkey")), ("cy", c("o_orderkey") % 977))])
    man = bind.table(spark, sf, "lineitem").where(c("l_returnflag") == "A").select(c("l_orderkey").alias("pair_id"), "l_linenumber", (c("l_extendedprice") / 1009).alias("manual"), c("l_partkey").cast("double").alias("mx"), c("l_suppkey").cast("double").alias("my"))
    d = candidate_vs_manual(cand, man, ["pair_id"], "candidate", "manual")
    return d.select("pair_id", r("candidate", 8).alias("candidate_um"), r("manual", 8).alias("manual_um"), r("abs_diff", 8).alias("abs_diff_um"), r("rel_diff_pct", 8).alias("rel_diff_pct"), r("center_dist_px", 8).alias("center_dist_px"), "l_linenumber")


@query("j22_baseline_comparison", """
WITH s AS (SELECT image_id, method, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS median FROM samples GROUP BY ALL),
m AS (SELECT *, CASE WHEN method = 'R' THEN mean ELSE median END AS main FROM s), b AS (SELECT image_id, main AS base FROM m WHERE method = 'A')
SELECT image_id, method, n, round(mean, 8) AS mean, round(median, 8) AS median, round(main-base, 8) AS difference, round(100*(main-base)/base, 8) AS rel_percent FROM m LEFT JOIN b USING (image_id)""", "samples")
def j22(spark, sf):
    b = stats.baseline_rows(bind.samples(spark, sf), ["image_id"], "method", "value", {"A": "median", "N": "median", "R": "mean"}, "A")
    return b.select("image_id", "method", "n", r("mean", 8).alias("mean"), r("median", 8).alias("median"), r("difference", 8).alias("difference"), r("relative_percent", 8).alias("rel_percent"))
