"""Row-level rules over per-sample field measurements (edges, profiles, midpoints)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filamet import schemas as S
from filamet.functions.geometry import finite
from filamet.functions.records import any_of


def axis_code(theta: Column) -> Column:
    """Axis as a doubled angle, so theta and theta + pi agree."""
    return F.struct(F.round(F.cos(2 * theta), 12).alias("qx"), F.round(F.sin(2 * theta), 12).alias("qy"))


def split_flags(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda f: f != "")


def contract_problem(value: Column, weight: Column, unit: Column) -> Column:
    """First broken rule of a weighted sample; null when fine."""
    return (
        F.when(~finite(value) | (value < 0), "VALUE_INVALID")
        .when(~finite(weight) | (weight < 0), "WEIGHT_INVALID")
        .when(F.coalesce(F.trim(unit), F.lit("")) == "", "UNIT_MISSING")
    )


def series_rules(spark: SparkSession, methods: Sequence[tuple[str, str, Sequence[tuple[str, str]]]], *, manual: str, skip: Sequence[str]) -> DataFrame:
    """Which distribution of a method is shown under which label, in which place.

    ``methods`` lists method, label and its secondary estimators with their labels.  A method shows its
    common distribution, the manual reference its native one; methods to ``skip`` show nothing.
    """
    rows = []
    for method, label, secondary in methods:
        if method not in skip:
            rows.append((method, "native" if method == manual else "common", label))
            rows += [(method, name, text) for name, text in secondary]
    return spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], "method string, variant string, label string, position long")


def display_series(distributions: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of the distributions that are shown, with ``label`` and ``position``; others have no series."""
    # the rules are a short list
    return distributions.join(F.broadcast(rules), ["method", "variant"])


def result_problem(version: Column, image: Column, unit: Column, confidence: Column, runtime: Column, distribution_units: Column) -> Column:
    """First broken rule of a method's result; null when fine.  ``distribution_units`` lists the units of its distributions."""
    blank = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""
    return (
        F.when(blank(version) | blank(image) | blank(unit), "REQUIRED_FIELD_MISSING")
        # no confidence and no runtime are fine; NaN is not within any range
        .when(confidence.isNotNull() & ~F.coalesce((confidence >= 0) & (confidence <= 1), F.lit(False)), "CONFIDENCE_OUT_OF_RANGE")
        .when(runtime < 0, "RUNTIME_NEGATIVE")
        .when(F.exists(F.coalesce(distribution_units, F.array().cast("array<string>")), lambda u: ~u.eqNullSafe(unit)), "UNIT_MISMATCH")
    )


def paired_edge_quality(
    r_minus: Column, r_plus: Column, coherence: Column, tangent: Column, normal: Column, edt: Column,
    *, low_coherence: float = 0.15, high_asymmetry: float = 0.5, min_tangent: float = 0.5,
) -> Column:
    """Diameter, asymmetry, acceptance and flags of a pair of edge hits (null = no hit)."""
    d = r_minus + r_plus
    asym = F.when(d != 0, F.abs(r_plus - r_minus) / d)
    ratio = F.when(edt > 0, d / edt)
    flags = F.array_compact(F.array(
        F.when(r_plus.isNull(), "MISSING_POSITIVE_EDGE"),
        F.when(r_minus.isNull(), "MISSING_NEGATIVE_EDGE"),
        F.when(coherence < low_coherence, S.LOW_COHERENCE_FLAG),
        F.when(asym > high_asymmetry, "HIGH_ASYMMETRY"),
        F.when(tangent < min_tangent, "EDGE_TANGENT_MISMATCH"),
        F.when(normal < 0, "EDGE_NORMAL_MISMATCH"),
        F.when((ratio < 0.5) | (ratio > 2.0), "POSSIBLE_CROSSING"),
    ))
    ambiguous = any_of(flags, [S.LOW_COHERENCE_FLAG, "HIGH_ASYMMETRY", "POSSIBLE_CROSSING", "EDGE_NORMAL_MISMATCH"])
    all_flags = F.when(ambiguous, F.array_append(flags, F.lit("AMBIGUOUS_LOCAL_WIDTH"))).otherwise(flags)
    return F.struct(
        d.alias("diameter"), asym.alias("asymmetry"),
        (F.coalesce(d > 0, F.lit(False)) & ~ambiguous).alias("accepted"),
        all_flags.alias("flags"),
    )


def edge_derived(r_minus: Column, r_plus: Column) -> Column:
    return F.struct((F.least(r_minus, r_plus) * 2).alias("d_min"), F.abs(r_plus - r_minus).alias("imbalance"))


def profile_quality(u_minus: Column, u_plus: Column, r_minus: Column, r_plus: Column, paired_accepted: Column, flags: Column) -> Column:
    """Width, edge shifts and acceptance of profile edges (null = edge not found)."""
    d = u_plus - u_minus
    positive = F.coalesce(d > 0, F.lit(False))
    found = F.concat(flags, F.array_compact(F.array(
        F.when(u_minus.isNull(), "PROFILE_EDGE_MINUS_NOT_FOUND"),
        F.when(u_plus.isNull(), "PROFILE_EDGE_PLUS_NOT_FOUND"),
        F.when(~positive, "PROFILE_NONPOSITIVE_WIDTH"),
    )))
    ok = paired_accepted & positive & ~F.array_contains(found, "PROFILE_AMBIGUOUS_EDGE")
    final = F.when(~ok & (F.size(found) == 0), F.array(F.lit("PROFILE_REJECTED_FROM_PAIRED_EDGE"))).otherwise(found)
    return F.struct(
        d.alias("diameter"), (u_minus + r_minus).alias("minus_shift"), (u_plus - r_plus).alias("plus_shift"),
        ((r_plus - r_minus) / 2).alias("center_shift"), ok.alias("accepted"), final.alias("flags"),
    )


def axis_disagreement_deg(tx: Column, ty: Column, qx: Column, qy: Column) -> Column:
    theta = F.atan2(qy, qx) * 0.5
    dot = F.abs(tx * F.cos(theta) + ty * F.sin(theta))
    return F.degrees(F.acos(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot))))


def midpoint_observations(df: DataFrame, *, min_coherence: float = 0.15, mismatch: float = 0.5) -> DataFrame:
    """Add the preferred midpoint of each sample and how far it lies from the sample.

    Input columns: x_m y_m coherence normal_x normal_y minus_x_m minus_y_m plus_x_m plus_y_m
    edge_accepted edge_flags profile_minus_u_um profile_plus_u_um profile_accepted profile_flags.
    The mask midpoint is the middle of two accepted edges; the profile midpoint lies on the
    normal.  A profile midpoint is preferred to a mask midpoint; crossings, missing edges,
    ambiguity and low coherence leave none.
    """
    c = F.col
    norm = F.hypot("normal_x", "normal_y")
    ok_normal = finite(norm) & (norm > 0)
    edge_flags, prof_flags = split_flags(c("edge_flags")), split_flags(c("profile_flags"))
    staged = df.withColumns({
        "_nx": F.when(ok_normal, c("normal_x") / norm),
        "_ny": F.when(ok_normal, c("normal_y") / norm),
        "_ok": ok_normal,
        "_low": (c("coherence") < min_coherence) | F.array_contains(edge_flags, S.LOW_COHERENCE_FLAG),
        "_abstain": any_of(edge_flags, S.ABSTAIN_EDGE_FLAGS),
        "_fm": finite(c("minus_x_m"), c("minus_y_m")),
        "_fp": finite(c("plus_x_m"), c("plus_y_m")),
        "_um": c("profile_minus_u_um") * 1e-6,
        "_up": c("profile_plus_u_um") * 1e-6,
    })
    usable = c("_ok") & ~c("_low") & ~c("_abstain")
    mask_width = F.hypot(c("plus_x_m") - c("minus_x_m"), c("plus_y_m") - c("minus_y_m"))
    prof_try = usable & c("profile_accepted") & ~any_of(prof_flags, S.ABSTAIN_PROFILE_FLAGS) & finite(c("_um"), c("_up"))
    staged = staged.withColumns({
        "_mask_try": usable & c("edge_accepted") & c("_fm") & c("_fp"),
        "_mask_w": mask_width,
        "_prof_try": prof_try,
        "_prof_w": F.abs(c("_up") - c("_um")),
    })
    mask_ok = c("_mask_try") & (c("_mask_w") > 0)
    prof_ok = c("_prof_try") & (c("_prof_w") > 0)
    along = (c("_um") + c("_up")) * 0.5
    staged = staged.withColumns({
        "_src": F.when(prof_ok, "PROFILE").when(mask_ok, "MASK"),
        "_dx": F.when(prof_ok, along * c("_nx")).when(mask_ok, (c("minus_x_m") + c("plus_x_m")) * 0.5 - c("x_m")),
        "_dy": F.when(prof_ok, along * c("_ny")).when(mask_ok, (c("minus_y_m") + c("plus_y_m")) * 0.5 - c("y_m")),
        "_w": F.when(prof_ok, c("_prof_w")).when(mask_ok, c("_mask_w")),
    })
    tangential = (c("_dx") * c("_ny") - c("_dy") * c("_nx")) * 1e6
    kept_prof_flags = F.when(c("_ok") & ~c("_low") & ~c("_abstain") & ~c("_prof_try"), F.array_sort(F.array_distinct(prof_flags))).otherwise(F.array().cast("array<string>"))
    hit_abstain = F.array_sort(F.array_intersect(edge_flags, F.array(*[F.lit(f) for f in S.ABSTAIN_EDGE_FLAGS])))
    flags = F.array_distinct(F.concat(
        F.array_compact(F.array(
            F.when(~c("_ok"), "MIDPOINT_INVALID_NORMAL"),
            F.when(c("_low"), S.LOW_COHERENCE_FLAG),
            F.when(~c("_fm"), "MISSING_NEGATIVE_EDGE"),
            F.when(~c("_fp"), "MISSING_POSITIVE_EDGE"),
            F.when((c("_mask_try") & (c("_mask_w") <= 0)) | (c("_prof_try") & (c("_prof_w") <= 0)), "MIDPOINT_ZERO_WIDTH"),
        )),
        kept_prof_flags,
        hit_abstain,
        F.array_compact(F.array(F.when(F.abs(tangential) > mismatch * c("_w") * 1e6, "MIDPOINT_TANGENTIAL_MISMATCH"))),
    ))
    paired = c("edge_accepted") & ~c("_abstain") & ~c("_low")
    return staged.select(
        *df.columns,
        c("_src").alias("midpoint_source"),
        (c("x_m") + c("_dx")).alias("midpoint_x_m"),
        (c("y_m") + c("_dy")).alias("midpoint_y_m"),
        (F.hypot("_dx", "_dy") * 1e6).alias("shift_um"),
        ((c("_dx") * c("_nx") + c("_dy") * c("_ny")) * 1e6).alias("signed_normal_shift_um"),
        tangential.alias("tangential_shift_um"),
        (c("_w") * 1e6).alias("width_um"),
        F.when(paired, F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("coherence")))).otherwise(0.0).alias("refine_confidence"),
        c("_src").isNotNull().alias("midpoint_accepted"),
        flags.alias("midpoint_flags"),
    )
