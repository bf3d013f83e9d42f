"""Row-level rules over measurement records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from filamet import schemas as S

WIDTH_KINDS = ["PROJECTED_WIDTH", "DISTANCE"]


def is_included(status: Column) -> Column:
    """Only accepted or manually edited records enter statistics."""
    return status.isin(S.INCLUDED_STATUSES)


def primary_value(kind: Column, values: Column) -> Column:
    """The one number a record stands for.  A zero length falls through to the width."""
    zero_free = F.when(values["length_m"] != 0, values["length_m"])
    return (
        F.when(kind.isin(WIDTH_KINDS), F.coalesce(zero_free, values["width_m"]))
        .when(kind == "POLYLINE_LENGTH", values["total_length_m"])
        .when(kind == "ANGLE", values["interior_angle_deg"])
        .when(kind.isin("RECTANGLE_AREA", "POLYGON_AREA"), values["area_m2"])
        .when(kind == "INTENSITY_PROFILE", values["length_m"])
        .when(kind == "DIAMETER_DISTRIBUTION", values["main_reported_value_m"])
    )


def primary_unit(kind: Column) -> Column:
    return (
        F.when(kind == "ANGLE", "deg")
        .when(kind.isin("RECTANGLE_AREA", "POLYGON_AREA"), "m²")
        .when(kind.isin(S.KINDS), "m")
        .otherwise("")
    )


def endpoints(p1: Column, p2: Column, points: Column, stored_center: Column | None = None) -> Column:
    """p1, p2 and centre: explicit points, else the ends of ``points``, else the origin."""
    origin = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    a = F.coalesce(p1, F.try_element_at(points, F.lit(1)), origin)
    b = F.coalesce(p2, F.when(F.size(points) > 1, F.try_element_at(points, F.lit(-1))), origin)
    mid = F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))
    c = mid if stored_center is None else F.coalesce(stored_center, mid)
    return F.struct(a.alias("p1"), b.alias("p2"), c.alias("center"))


def matches_search(
    text: str, *, measurement_id: Column, name: Column, kind: Column, source: Column, status: Column,
    fiber_id: Column, tags: Column, flags: Column, want_kind: str | None = None, want_status: str | None = None,
) -> Column:
    hay = F.lower(F.concat_ws(
        " ", measurement_id, name, kind, source, status, F.coalesce(fiber_id, F.lit("")),
        F.array_join(tags, " "), F.array_join(flags, " "),
    ))
    cond = F.contains(hay, F.lit(text.strip().lower())) if text else F.lit(True)
    if want_kind:
        cond = cond & (kind == want_kind)
    if want_status:
        cond = cond & (status == want_status)
    return cond


def sample_passes(coherence: Column, accepted: Column, flags: Column, *, min_coherence: float = 0.0, mode: str = "all") -> Column:
    cond = F.lit(True)
    if min_coherence > 0:
        cond = coherence.isNotNull() & ~F.isnan(coherence) & (coherence >= min_coherence)
    if mode == "accepted":
        cond = cond & accepted
    elif mode == "rejected":
        cond = cond & ~accepted
    elif mode == "flagged":
        cond = cond & (F.trim(F.coalesce(flags, F.lit(""))) != "")
    return cond


def resolution_class(width_m: Column, px: Column, resolved: float = 5.0, marginal: float = 2.5) -> Column:
    equiv = F.when(px > 0, width_m / px).otherwise(0.0)
    status = F.when(equiv >= resolved, "RESOLVED").when(equiv >= marginal, "MARGINAL").otherwise("UNRESOLVED")
    flag = F.when(equiv >= resolved, F.lit(None).cast("string")).when(equiv >= marginal, "RESOLUTION_MARGINAL").otherwise("RESOLUTION_INSUFFICIENT")
    return F.struct(status.alias("status"), equiv.alias("width_px"), flag.alias("flag"))


def _set_of(*flags: Column) -> Column:
    return F.array_compact(F.array(*flags))


def quality_flags(
    existing: Column, *, kind: Column, status: Column, source: Column, value: Column, points: Column,
    px: Column, cal_source: Column, cal_confidence: Column, width_px: Column, height_px: Column,
    footer_y0: Column, footer_y1: Column, margin: float = 5.0,
) -> Column:
    """Existing flags together with the derived ones, sorted and unique."""
    near = F.exists(points, lambda p: (p["x"] <= margin) | (p["x"] >= width_px - margin) | (p["y"] <= margin) | (p["y"] >= height_px - margin))
    low = F.exists(points, lambda p: F.coalesce(p["y"].between(footer_y0, footer_y1), F.lit(False)))
    derived = _set_of(
        F.when((cal_source == "UNVERIFIED") | (cal_confidence < 0.8), "CALIBRATION_UNVERIFIED"),
        F.when(value.isNotNull() & kind.isin(WIDTH_KINDS), resolution_class(value, px)["flag"]),
        F.when(near, "TOUCHES_IMAGE_EDGE"),
        F.when(low, "TOUCHES_INVALID_MASK"),
        F.when((source == "AUTO_ROI_COMPONENT") & (status == "PROPOSED"), "AUTOMATIC_NOT_REVIEWED"),
        F.when(source == "MANUAL", "MANUAL_REFERENCE"),
    )
    return F.array_sort(F.array_union(existing, derived))


def uncertainty(value: Column, px: Column, confidence: Column, repeatability: Column | None = None) -> Column:
    """Independent components and their quadrature sum; nothing for a value that is not positive."""
    ok = value.isNotNull() & (value > 0)
    u_cal = F.when(ok & (confidence > 0), value * F.greatest(F.lit(0.01), 1 - confidence))
    u_edge = F.when(ok, px * 0.5 / F.sqrt(F.lit(3.0)))
    u_rep = F.when(ok, repeatability) if repeatability is not None else F.lit(None).cast("double")
    square = reduce(lambda a, b: a + b, [F.coalesce(u * u, F.lit(0.0)) for u in (u_cal, u_edge, u_rep)])
    return F.struct(
        u_cal.alias("calibration_m"), u_edge.alias("edge_localization_m"), u_rep.alias("repeatability_m"),
        F.when(ok, F.sqrt(square)).alias("combined_standard_m"),
        F.when(ok, "INDEPENDENT_QUADRATURE").otherwise("NONE").alias("method"),
    )


def resolution_preset(px: Column) -> Column:
    """Name of the preset for a pixel size in metres."""
    nm = px * 1e9
    expr = None
    for name, _, upto, *_ in S.RESOLUTION_PRESETS[:-1]:
        expr = F.when(nm <= upto, name) if expr is None else expr.when(nm <= upto, name)
    return expr.otherwise(S.RESOLUTION_PRESETS[-1][0])


def resolvability(px: Column, max_gradient: Column, expected_width_m: float = 300e-9) -> Column:
    expected = F.lit(expected_width_m) / px
    return (
        F.when((expected < 3.5) | (px * 1e9 > 85.0), "RESOLUTION_INSUFFICIENT")
        .when((expected < 7.0) | (max_gradient < 1.0), "RESOLUTION_MARGINAL")
        .otherwise("RESOLUTION_OK")
    )


def to_metres(value: Column, unit: Column) -> Column:
    """Length in metres; a unit that is not known gives null (see :func:`unit_known`)."""
    return value * F.try_element_at(_unit_map(), _unit_key(unit))


def unit_known(unit: Column) -> Column:
    return F.map_contains_key(_unit_map(), _unit_key(unit))


def _unit_key(unit: Column) -> Column:
    key = F.coalesce(F.when(unit != "", unit), F.lit("m"))
    return F.replace(F.lower(F.trim(key)), F.lit("μ"), F.lit("µ"))


def _unit_map() -> Column:
    return F.create_map(*[F.lit(v) for kv in S.LENGTH_UNITS.items() for v in kv])


def length_text(value_m: Column) -> Column:
    return F.when(value_m >= 1e-3, F.format_string("%.3f mm", value_m * 1e3)).otherwise(F.format_string("%.1f nm", value_m * 1e9))


def normalize_tags(tags: Column) -> Column:
    """Split on commas, trim, drop blanks, keep the first spelling of each tag."""
    parts = F.filter(
        F.flatten(F.transform(F.array_compact(tags), lambda t: F.transform(F.split(t, ","), lambda p: F.trim(p)))),
        lambda t: t != "",
    )
    folded = F.transform(parts, lambda p: F.lower(p))
    return F.filter(parts, lambda t, i: F.array_position(folded, F.lower(t)) == i + 1)


def capability(states: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(states, F.lit(name)), F.lit("UNAVAILABLE"))


def content_key(fields: dict[str, Column]) -> Column:
    """SHA-256 of the key-sorted JSON of the inputs; nulls are part of the key."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def cell_problem(status: Column, notes: Column) -> Column:
    return F.when((status == "SKIPPED_WITH_REASON") & (F.trim(F.coalesce(notes, F.lit(""))) == ""), "REASON_REQUIRED")


def cell_position(row: Column, col: Column) -> Column:
    """Grid position text from 0-based row and column."""
    return F.format_string("R%dC%d", (row + 1).cast("int"), (col + 1).cast("int"))


def differs(old: Column, new: Column, rel: float = 1e-5, abs_tol: float = 1e-12) -> Column:
    """True where two values are not close (relative or absolute)."""
    old = F.coalesce(old, F.lit(0.0))
    return F.abs(old - new) > F.greatest(F.lit(rel) * F.greatest(F.abs(old), F.abs(new)), F.lit(abs_tol))


def array_mean(a: Column) -> Column:
    a = F.array_compact(a)
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a))


def array_cv(a: Column) -> Column:
    """Population SD over mean; null for an empty array, 0 where the mean is not positive."""
    m = array_mean(a)
    sq = F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.size(a)
    return F.when(F.size(a) > 0, F.when(m > 0, F.sqrt(sq) / m).otherwise(0.0))


def any_of(flags: Column, names: Sequence[str]) -> Column:
    return F.arrays_overlap(flags, F.array(*[F.lit(n) for n in names]))


def candidate_confidence(elongation: Column, sections: Column, target: Column, flags: Column) -> Column:
    hopeless = any_of(flags, ["TOO_SMALL", "PROFILE_FAILED", "LIKELY_MERGED"])
    penalty = F.when(any_of(flags, S.PENALTY_FLAGS), 0.3).otherwise(1.0)
    score = (F.least(F.lit(1.0), elongation / 6.0) * 0.4 + sections / target * 0.4 + 0.2) * penalty
    return F.when(hopeless, 0.10).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def confidence_level(score: Column, flags: Column, preset: Column) -> Column:
    return (
        F.when(any_of(flags, S.DISQUALIFYING_FLAGS) | (preset == "LOW_MAG_NETWORK"), "Baja")
        .when((score >= 0.70) & (F.size(flags) == 0), "Alta")
        .when(score >= 0.40, "Media")
        .otherwise("Baja")
    )


def roi_class(resolution: Column, measurable: Column, components: Column, high: Column) -> Column:
    return (
        F.when(resolution == "RESOLUTION_INSUFFICIENT", "UNSUITABLE_FOR_AUTOMATIC_WIDTH")
        .when(measurable == 0, "NO_CANDIDATES")
        .when(components > 40, "MANUAL_REVIEW_REQUIRED")
        .when(high > 0, "USABLE")
        .otherwise("PARTIALLY_USABLE")
    )


def clean_number(x: Column, digits: int = 6) -> Column:
    """Non-finite becomes null; half-even rounding."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(~bad, F.bround(x, digits))


def normalize_source(source: Column, engine_name: str | None = None) -> Column:
    """Map free source text to one of the known sources, first matching rule wins."""
    up = F.upper(F.coalesce(source, F.lit("MANUAL")))

    def has(*words: str) -> Column:
        return reduce(or_, [F.contains(up, F.lit(w)) for w in words])

    rule = F.when(has("SOURCE_COMPAT", "SIMPOLY_SOURCE"), "SOURCE_COMPAT").when(
        has("CONTROLLED_INPUT", "SIMPOLY_CONTROLLED"), "CONTROLLED_INPUT"
    )
    if engine_name:
        rule = rule.when(up == engine_name.upper(), engine_name.upper())
    return (
        rule.when(has("ASSISTED"), "ASSISTED")
        .when(has("AUTO"), "AUTO_ROI_COMPONENT")
        .when(has("IMPORT"), "IMPORTED")
        .otherwise("MANUAL")
    )
