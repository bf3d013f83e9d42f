"""Known small cases with hand-checked results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from filamet import schemas as S
from filamet.functions import geometry as G
from filamet.functions import records as R
from filamet.functions import samples as P
from filamet.operators import campaign as C
from filamet.operators import distributions as D
from filamet.operators import parity, reports, spatial, stats
from filamet.operators.centerline import spearman
from filamet.operators.kmeans import cluster_log_medians

NM = 1e-9


def pt(x, y):
    return G.point(F.lit(float(x)), F.lit(float(y)))


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


def test_weighted_summary(spark):
    df = spark.createDataFrame([("m", 1.0, 9.0), ("m", 10.0, 1.0)], "k string, x double, w double")
    row = D.weighted_summary(df, ["k"], "x", "w").first()
    assert row["mean"] == pytest.approx(1.9)
    assert row["p50"] == pytest.approx(1.0)
    assert row["p95"] == pytest.approx(5.5)
    assert row["std"] == pytest.approx(2.7)


def test_agreement_and_consensus(spark):
    rows = [("i", "a", v, 1.0) for v in (1.0, 2.0, 3.0)] + [("i", "b", v, 1.0) for v in (2.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "img string, m string, x double, w double")
    a = D.agreements(df, ["img"], "m", ["a", "b"], "x", "w").first()
    assert a.wasserstein_1 == pytest.approx(1.0)
    assert a.ks_statistic == pytest.approx(1 / 3)
    assert a.median_difference == pytest.approx(-1.0)
    e = D.common_edges(df, ["img"], "x", 4).first()
    assert (e.lo, e.hi, e.bins) == (1.0, 4.0, 4)
    c = D.consensus(df, ["img"], "m", "x", "w", 5)
    assert c.count() == 5 and {r.n_methods for r in c.collect()} == {2}


def test_degenerate_edges(spark):
    df = spark.createDataFrame([("i", 20.0), ("i", 20.0)], "img string, x double")
    e = D.common_edges(df, ["img"], "x").first()
    assert (e.lo, e.hi, e.bins) == (19.0, 21.0, 1)


@pytest.mark.parametrize("bins", [7, 10, 32, 49])
def test_histogram_matches_numpy(spark, bins):
    rng = np.random.default_rng(bins)
    x = rng.integers(1, 51, 5000).astype(float)
    df = spark.createDataFrame([(float(v), 1.0) for v in x], "x double, w double").withColumn("k", F.lit(1))
    e = D.common_edges(df, ["k"], "x", bins)
    got = [r.n for r in D.weighted_histogram(df, ["k"], [], "x", "w", e).orderBy("bin").collect()]
    assert got == np.histogram(x, bins=bins)[0].tolist()


def test_nice_bins(spark):
    df = spark.createDataFrame([(1, float(v)) for v in np.linspace(-3, 8, 10_000)], "k int, x double")
    e = D.scott_edges(df, ["k"], "x").first()
    assert (e.lo, e.hi, e.bins, e.width) == (-3.0, 8.0, 22, 0.5)


def test_equal_image_mixture(spark):
    a = spark.range(100).select(F.lit(1).alias("img"), F.lit(1.0).alias("x"))
    b = spark.range(10_000).select(F.lit(2).alias("img"), F.lit(3.0).alias("x"))
    df = a.unionByName(b).withColumns({"m": F.lit("m"), "w": F.lit(1.0)})
    mass = D.mixture(df, "img", "m", "x", "w").groupBy("img").agg(F.sum("mix_weight").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in mass)
    row = D.mixture_table(df, "img", "m", "x", "w").first()
    assert 1.0 <= row.p50 < 2.0 and row["mean"] == pytest.approx(2.0) and row.images == 2


def test_exclusion_reason(spark):
    df = spark.createDataFrame([("i", "a", "COMPLETE", S.COMMON_ESTIMAND, True), ("i", "b", "COMPLETE", None, False), ("i", "c", "FAILED", S.COMMON_ESTIMAND, True)], "image_id string, method string, status string, estimand string, has_common boolean")
    got = {r.method: r.reason for r in reports.exclusions(df).collect()}
    assert got == {"b": "NO_COMMON_DISTRIBUTION", "c": "STATUS_FAILED"}


def test_content_key(spark):
    key = lambda roi: R.content_key({"sha": F.lit("x"), "roi": F.lit(roi), "parameters": F.lit(None).cast("string")})
    row = one(spark, a=key("0,0"), b=key("0,0"), c=key("0,1"))
    assert row.a == row.b != row.c


def test_equal_fiber_weight(spark):
    df = spark.createDataFrame([("F001", 1.0)] * 10 + [("F002", 3.0)], "f string, x double").withColumn("k", F.lit(1))
    fiber = stats.fiber_summary(df, ["k"], "f", "x").first()
    section = stats.section_summary(df, ["k"], "x", "f").first()
    assert fiber["mean"] == pytest.approx(2.0) and fiber.n_measurements == 11
    assert section["mean"] < 1.5 and section.n == 11 and section.n_fibers == 2


def test_single_value_has_zero_sd(spark):
    df = spark.createDataFrame([(1, 2.0)], "k int, x double")
    row = stats.level_metrics(df, ["k"], "x").first()
    assert row.sd == 0.0 and row.iqr == 0.0


def test_extrema(spark):
    rows = [("a", "1", 1.0), ("a", "2", 2.0), ("a", "3", 3.0), ("b", "4", 1.0), ("c", "5", 1.0), ("c", "6", 2.0)]
    df = spark.createDataFrame(rows, "f string, id string, x double")
    got = {r.id: r.labels for r in stats.extrema_labels(df, ["f"], "x", "id").collect()}
    assert got == {"1": "MIN", "2": "MED", "3": "MAX", "4": "MIN,MED,MAX", "5": "MIN", "6": "MAX"}


def test_ranges_inclusive(spark):
    df = spark.createDataFrame([(0.5,), (2.0,), (1.0,), (9.0,)], "x double")
    got = [r.group for r in stats.classify_by_ranges(df, "x", [("a", 0, 1), ("b", 1, 3)]).collect()]
    assert got == [0, 1, 0, None]


def test_two_groups_of_fibers(spark):
    df = spark.createDataFrame([("F001", 1.1), ("F002", 4.1), ("F003", 1.0), ("F004", 4.0)], "f string, m double")
    got = {r.f: r.group for r in cluster_log_medians(df, "m", k=2).collect()}
    assert got == {"F001": 0, "F003": 0, "F002": 1, "F004": 1}


def _kmeans_reference(values, max_k=4):
    """Plain NumPy: quantile start, Lloyd steps, BIC choice."""
    best = None
    for k in range(1, min(max_k, len(values)) + 1):
        centers = np.quantile(values, np.linspace(0, 1, k + 2)[1:-1]) if k > 1 else np.array([values.mean()])
        for _ in range(100):
            lab = np.argmin(np.abs(values[:, None] - centers), axis=1)
            new = np.array([values[lab == i].mean() if (lab == i).any() else centers[i] for i in range(k)])
            if np.allclose(new, centers, rtol=0, atol=0):
                break
            centers = new
        centers = np.sort(centers)
        lab = np.argmin(np.abs(values[:, None] - centers), axis=1)
        bic = len(values) * math.log(max(((values - centers[lab]) ** 2).sum() / len(values), 1e-12)) + 2 * k * math.log(max(len(values), 2)) + 1.5 * k
        if best is None or bic < best[0]:
            best = (bic, lab)
    return best[1]


def test_cluster_count_by_bic(spark):
    rng = np.random.default_rng(3)
    x = np.exp(np.concatenate([rng.normal(0, 0.05, 60), rng.normal(1, 0.05, 40), rng.normal(2.2, 0.05, 30)]))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, m double")
    got = [r.group for r in cluster_log_medians(df, "m").orderBy("i").collect()]
    assert got == _kmeans_reference(np.log(x)).tolist()


@pytest.mark.parametrize("nm,status", [(60, "RESOLVED"), (35, "MARGINAL"), (15, "UNRESOLVED")])
def test_resolution(spark, nm, status):
    row = one(spark, r=R.resolution_class(F.lit(nm * NM), F.lit(10 * NM)))
    assert row.r.status == status and row.r.width_px == pytest.approx(nm / 10)


def test_uncertainty(spark):
    u = one(spark, u=R.uncertainty(F.lit(10 * NM), F.lit(NM), F.lit(0.95))).u
    assert u.combined_standard_m == pytest.approx(math.hypot(10 * NM * 0.05, 0.5 * NM / math.sqrt(3)))
    assert one(spark, u=R.uncertainty(F.lit(0.0), F.lit(NM), F.lit(0.95))).u.method == "NONE"


def test_repeatability(spark):
    df = spark.createDataFrame([(1, 1.0, None), (1, 2.0, None), (2, 1.0, 1.1), (2, 2.0, 1.9)], "s int, o double, m double")
    got = {r.s: r for r in stats.repeatability(df, ["s"], "o", "m").collect()}
    assert got[1].status == "N_INSUFFICIENT" and got[1].cv is None
    assert got[2].status == "SUFFICIENT" and got[2].bland_altman_lower is None
    assert got[2].s_intra == pytest.approx(math.sqrt(0.02 / 4))


def test_nearest_reference(spark):
    auto = spark.createDataFrame([("i", "A", 10.0, 0.0, 20.0), ("i", "Z", 900.0, 0.0, 20.0)], "img string, measurement_id string, x double, y double, value double")
    man = spark.createDataFrame([("i", "B", 11.0, 0.0, 22.0), ("i", "C", 400.0, 3.0, 50.0)], auto.schema)
    rows = spatial.pair_nearest_reference(auto, man, ["img"]).collect()
    assert [(r.auto_id, r.manual_id, r.absolute_difference) for r in rows] == [("A", "B", 2.0)]


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    q = [(int(g), float(x), float(y)) for g, (x, y) in zip(rng.integers(0, 2, 200), rng.random((200, 2)) * 100)]
    # one dense cluster and a few far points
    refs = [(int(g), float(x), float(y), i) for i, (g, (x, y)) in enumerate(zip(rng.integers(0, 2, 150), rng.random((150, 2)) * 2 + 40))] + [(0, 99.0, 99.0, 900), (1, 0.0, 99.0, 901)]
    got = spatial.nearest(spark.createDataFrame(q, "g int, x double, y double"), spark.createDataFrame(refs, "g int, x double, y double, o int"), ["g"], order=["o"], payload=["o"]).collect()
    assert len(got) == 200
    for r in got:
        want = min((math.dist((r.x, r.y), (x, y)), o) for g, x, y, o in refs if g == r.g)
        assert (r.distance, r.o) == (pytest.approx(want[0]), want[1])


def test_legacy_record(spark):
    from filamet.sources import projects
    text = '{"measurements": [{"measurement_id": "M001", "width_m": 1e-6, "method": "ASSISTED two-click", "p1": [0, 0], "p2": [3, 4]}], "schema_version": 1}'
    p = projects.parse_projects(spark.createDataFrame([("k", text)], "k string, t string"), "t", "k")
    r = projects.normalize_records(projects.exploded_records(p, "k")).first()
    assert (r.kind, r.status, r.source, r.fiber_id) == ("PROJECTED_WIDTH", "ACCEPTED", "ASSISTED", "F001")
    c = projects.counters(p, "k").first()
    assert (c.target_sections, c.next_record_counter, c.next_fiber_counter) == (5, 2, 1)


def test_source_rules(spark):
    cases = {"x SIMPOLY_SOURCE": "SOURCE_COMPAT", "simpoly_controlled": "CONTROLLED_INPUT", "assisted": "ASSISTED", "auto": "AUTO_ROI_COMPONENT", "Imported": "IMPORTED", "?": "MANUAL", "ours": "OURS"}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", R.normalize_source(F.col("s"), "ours").alias("n"))
    assert {r.s: r.n for r in df.collect()} == cases


def test_tags(spark):
    t = F.array(*[F.lit(x) for x in (" control ", "bead", "CONTROL", "zona-central, alta-mag ", "")])
    assert one(spark, t=R.normalize_tags(t)).t == ["control", "bead", "zona-central", "alta-mag"]


def test_line_polyline_angle(spark):
    row = one(
        spark, a=G.line_geometry(pt(0, 0), pt(3, 4), F.lit(NM), F.lit(NM)), b=G.line_geometry(pt(0, 0), pt(3, 4), F.lit(2 * NM), F.lit(NM)),
        c=G.polyline_geometry(F.array(pt(0, 0), pt(0, 10), pt(10, 10)), F.lit(NM), F.lit(NM)), d=G.polyline_geometry(F.array(pt(1, 1), pt(1, 1)), F.lit(NM), F.lit(NM)),
        e=G.angle_geometry(pt(1, 0), pt(0, 0), pt(0, 1), F.lit(1.0), F.lit(1.0)), f=G.angle_geometry(pt(0, 0), pt(0, 0), pt(0, 1), F.lit(1.0), F.lit(1.0)),
    )
    assert row.a.length_m == pytest.approx(5 * NM) and row.b.length_m == pytest.approx(math.sqrt(52) * NM)
    assert row.c.total_length_m == pytest.approx(20 * NM) and row.d.tortuosity is None
    assert row.e.interior_angle_deg == pytest.approx(90.0) and row.f.interior_angle_deg is None


def test_polyline_tortuosity_in_metres(spark):
    row = one(spark, c=G.polyline_geometry(F.array(pt(0, 0), pt(0, 10), pt(10, 10)), F.lit(1e-3), F.lit(1e-3)))
    assert row.c.tortuosity == pytest.approx(20 / math.hypot(10, 10))


def test_roi(spark):
    px = spark.range(10_000).select(F.lit(1).alias("img"), F.floor(F.col("id") / 100).alias("row"), (F.col("id") % 100).alias("col"))
    px = px.withColumn("value", F.when(F.col("row").between(20, 59) & F.col("col").between(20, 59), 200.0).otherwise(10.0))
    poly = [(20.0, 20.0), (60.0, 20.0), (60.0, 60.0), (20.0, 60.0)]
    schema = "img int, roi string, x0 int, y0 int, x1 int, y1 int, polygon array<struct<x:double,y:double>>, footer_y0 int, footer_y1 int, px double, py double"
    rois = spark.createDataFrame([(1, "box", 20, 20, 60, 60, None, None, None, 1.0, 1.0), (1, "poly", None, None, None, None, poly, None, None, 1.0, 1.0), (1, "foot", 0, 70, 100, 100, None, 80, 100, 1.0, 1.0)], schema)
    got = {r.roi: r for r in spatial.roi_statistics(spatial.roi_pixels(px, rois, ["img"], tile=16), ["img"], "roi", "px", "py").collect()}
    assert got["box"].valid_pixels == 1600 and got["box"]["mean"] == 200.0
    assert got["box"].perimeter_m == pytest.approx(156 * math.sqrt(2) / 1.414)
    assert got["poly"].valid_pixels > 1400 and got["foot"].excluded_pixels == 2000


def test_inclusion(spark):
    df = spark.createDataFrame([(s,) for s in S.STATUSES], "s string")
    assert {r.s for r in df.where(R.is_included(F.col("s"))).collect()} == {"ACCEPTED", "MANUALLY_EDITED"}


def test_mask_parity(spark):
    left = spark.createDataFrame([(1, 0, 0), (1, 1, 0)], "img int, row int, col int")
    right = spark.createDataFrame([(1, 0, 0), (1, 0, 1)], left.schema)
    area = spark.createDataFrame([(1, 4), (2, 4)], "img int, pixels long")
    got = {r.img: r for r in parity.mask_parity(left, right, area, ["img"], ["row", "col"]).collect()}
    assert got[1].different == 2 and got[1].dice == 0.5
    assert got[2].iou == 1.0 and got[2].iou_min1 == 0.0


def test_float_parity_rmse(spark):
    left = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.0), (1, 2, 1.0), (1, 3, 0.0)], "img int, i int, value double")
    right = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0), (1, 2, 0.0), (1, 3, 0.0)], left.schema)
    r = parity.float_parity(left, right, ["img"], ["i"]).first()
    assert r.rmse == pytest.approx(math.sqrt(0.5)) and not r.allclose


def test_diameter_parity(spark):
    df = spark.createDataFrame([(1, "a", 0, 1.0), (1, "a", 1, 2.0), (1, "b", 0, 1.0), (1, "b", 1, 3.0)], "g int, side string, i int, x double")
    r = parity.diameter_parity(df, ["g"], "side", ("a", "b"), "x", "i").first()
    assert r.wasserstein == pytest.approx(0.5) and r.max_aligned_difference == 1.0


def test_first_divergence(spark):
    df = spark.createDataFrame([(1, "CROP", 1, True), (1, "CLAHE", 2, False), (1, "EDT", 23, False), (2, "CROP", 1, True)], "c int, s string, o int, m boolean")
    got = {r.c: r.first_divergence for r in C.first_divergence(df, ["c"], "s", "o", "m").collect()}
    assert got == {1: "CLAHE", 2: "MATCHED"}


def test_review_queue_without_results(spark):
    cases = spark.createDataFrame([(f"C{i:02d}",) for i in range(16)], "case_id string")
    res = spark.createDataFrame([], "case_id string, oracle_center double, estimate_center double, section_median double, resolution string, flags array<string>")
    prev = spark.createDataFrame([], "case_id string, manual_status string, review_notes string, manual_count int")
    grid = spark.createDataFrame([], "case_id string, measured int")
    rows = C.review_queue(cases, res, prev, grid).collect()
    assert len(rows) == 16 and {r.manual_status for r in rows} == {"NOT_MEASURED"} and {r.priority for r in rows} == {"HIGH"}


def test_strict_threshold(spark):
    from filamet.operators.pixels import foreground
    df = spark.createDataFrame([(0.4,), (0.5,), (0.6,)], "v double").where(foreground(F.col("v"), 0.5))
    assert [r.v for r in df.collect()] == [0.6]


def test_spearman_needs_three_pairs(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, float("nan")), (1, 3.0, 5.0), (2, 1.0, 9.0), (2, 2.0, 4.0), (2, 3.0, 1.0)], "g int, x double, y double")
    got = {r.g: r.rho for r in spearman(df, ["g"], "x", "y").collect()}
    assert got[1] is None and got[2] == pytest.approx(-1.0)


def test_midpoint_prefers_profile_and_abstains(spark):
    base = dict(x_m=0.0, y_m=0.0, coherence=0.9, normal_x=2.0, normal_y=0.0, minus_x_m=-1e-6, minus_y_m=0.0, plus_x_m=3e-6, plus_y_m=0.0, edge_accepted=True, edge_flags="", profile_minus_u_um=-1.0, profile_plus_u_um=2.0, profile_accepted=True, profile_flags="")
    rows = [base, {**base, "profile_flags": "PROFILE_AMBIGUOUS_EDGE"}, {**base, "edge_flags": "POSSIBLE_CROSSING"}, {**base, "coherence": 0.1}]
    df = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], ["i", *base])
    got = P.midpoint_observations(df).orderBy("i").collect()
    assert [g.midpoint_source for g in got] == ["PROFILE", "MASK", None, None]
    assert got[0].shift_um == pytest.approx(0.5) and got[1].shift_um == pytest.approx(1.0)
    assert "POSSIBLE_CROSSING" in got[2].midpoint_flags and got[3].refine_confidence == 0.0


def test_unknown_unit_gives_null(spark):
    df = spark.createDataFrame([(1.0, "µm"), (1.0, " NM "), (1.0, None), (1.0, "parsec")], "v double, u string")
    got = df.select(R.to_metres(F.col("v"), F.col("u")).alias("m"), R.unit_known(F.col("u")).alias("k")).collect()
    assert [r.m for r in got] == [1e-6, 1e-9, 1.0, None] and [r.k for r in got] == [True, True, True, False]
