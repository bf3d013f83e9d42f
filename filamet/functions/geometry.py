"""Geometry of measurements as column expressions (calibrated, anisotropic pixels)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def finite(*cols: Column) -> Column:
    """Not null, not NaN and not infinite."""
    out = F.lit(True)
    for c in cols:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return out


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def segment_length(a: Column, b: Column, px: Column, py: Column) -> Column:
    return F.hypot((b["x"] - a["x"]) * px, (b["y"] - a["y"]) * py)


def bearing(dx: Column, dy: Column) -> Column:
    """Direction of a vector in degrees, 0 <= angle < 360."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))


def calibrated_width(p1: Column, p2: Column, px: Column, py: Column) -> Column:
    """Width in metres; null where an input is not usable (see :func:`width_problem`)."""
    return F.when(width_problem(p1, p2, px, py).isNull(), segment_length(p1, p2, px, py))


def width_problem(p1: Column, p2: Column, px: Column, py: Column) -> Column:
    return (
        F.when(~finite(p1["x"], p1["y"], p2["x"], p2["y"]), "COORDINATE_NOT_FINITE")
        .when(~finite(px, py) | (px <= 0) | (py <= 0), "CALIBRATION_NOT_POSITIVE")
    )


def line_geometry(p1: Column, p2: Column, px: Column, py: Column) -> Column:
    dx, dy = p2["x"] - p1["x"], p2["y"] - p1["y"]
    return F.struct(
        F.hypot(dx * px, dy * py).alias("length_m"),
        F.hypot(dx, dy).alias("length_px"),
        (dx * px).alias("delta_x_m"),
        (dy * py).alias("delta_y_m"),
        bearing(dx * px, dy * py).alias("orientation_deg"),
        ((p1["x"] + p2["x"]) / 2).alias("center_x"),
        ((p1["y"] + p2["y"]) / 2).alias("center_y"),
    )


def polyline_geometry(points: Column, px: Column, py: Column) -> Column:
    n = F.size(points)
    legs = F.zip_with(
        F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: segment_length(a, b, px, py),
    )
    total = F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(legs, F.lit(0.0), lambda acc, v: acc + v))
    head, tail = F.element_at(points, 1), F.element_at(points, -1)
    direct = F.when(n < 2, F.lit(0.0)).otherwise(segment_length(head, tail, px, py))
    turn = F.when(n < 2, F.lit(0.0)).otherwise(bearing((tail["x"] - head["x"]) * px, (tail["y"] - head["y"]) * py))
    return F.struct(
        F.greatest(n - 1, F.lit(0)).cast("long").alias("segment_count"),
        total.alias("total_length_m"),
        direct.alias("direct_distance_m"),
        F.when(direct > TINY, total / direct).alias("tortuosity"),
        turn.alias("global_orientation_deg"),
    )


def angle_geometry(a: Column, b: Column, c: Column, px: Column, py: Column) -> Column:
    """Angle at ``b`` between the arms to ``a`` and ``c``, in physical space."""
    ux, uy = (a["x"] - b["x"]) * px, (a["y"] - b["y"]) * py
    vx, vy = (c["x"] - b["x"]) * px, (c["y"] - b["y"]) * py
    lu, lv = F.hypot(ux, uy), F.hypot(vx, vy)
    ok = (lu >= TINY) & (lv >= TINY)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / (lu * lv)))
    interior = F.degrees(F.acos(cosine))
    return F.struct(
        F.when(ok, interior).alias("interior_angle_deg"),
        F.when(ok, F.least(interior, F.lit(180.0) - interior)).alias("acute_angle_deg"),
        F.when(ok, bearing(ux, uy)).alias("orientation_ab_deg"),
        F.when(ok, bearing(vx, vy)).alias("orientation_bc_deg"),
    )


def validate_segment(
    p1: Column, p2: Column, width_px: Column, height_px: Column,
    footer_y0: Column, footer_y1: Column, min_length_px: float = 2.0, max_length_px: float | None = None,
) -> Column:
    """First failed rule as a reason code; null reason means valid."""

    def inside(p: Column) -> Column:
        return (p["x"] >= 0) & (p["x"] < width_px) & (p["y"] >= 0) & (p["y"] < height_px)

    def in_footer(p: Column) -> Column:
        return F.coalesce(p["y"].between(footer_y0, footer_y1), F.lit(False))

    length = F.hypot(p2["x"] - p1["x"], p2["y"] - p1["y"])
    reason = (
        F.when(~finite(p1["x"], p1["y"]), "P1_NOT_FINITE")
        .when(~finite(p2["x"], p2["y"]), "P2_NOT_FINITE")
        .when(~inside(p1), "P1_OUTSIDE_IMAGE")
        .when(~inside(p2), "P2_OUTSIDE_IMAGE")
        .when(in_footer(p1) | in_footer(p2), "ENDS_IN_FOOTER")
        .when(length <= 0, "NOT_POSITIVE")
        .when(length < min_length_px, "BELOW_MINIMUM")
    )
    if max_length_px is not None:
        reason = reason.when(length > max_length_px, "ABOVE_MAXIMUM")
    return F.struct(reason.isNull().alias("valid"), reason.alias("reason"))


def clamp_roi(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, footer_y0: Column) -> Column:
    """Clamp a box to the image above the footer, keeping at least one pixel."""
    bottom = F.coalesce(footer_y0, height)
    cx0 = F.greatest(F.lit(0), F.least(x0, width - 1))
    cy0 = F.greatest(F.lit(0), F.least(y0, bottom - 1))
    return F.struct(
        cx0.alias("x0"), cy0.alias("y0"),
        F.greatest(cx0 + 1, F.least(x1, width)).alias("x1"),
        F.greatest(cy0 + 1, F.least(y1, bottom)).alias("y1"),
    )


def point_in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Even-odd test with half-open edges: an edge counts for ``min(y) < y <= max(y)``."""
    n = F.size(polygon)
    edges = F.zip_with(
        polygon,
        F.concat(F.slice(polygon, F.lit(2), n - 1), F.slice(polygon, F.lit(1), F.lit(1))),
        lambda p, q: F.struct(p.alias("p"), q.alias("q")),
    )

    def crossed(e: Column) -> Column:
        p, q = e["p"], e["q"]
        at = F.when(p["y"] != q["y"], (y - p["y"]) * (q["x"] - p["x"]) / (q["y"] - p["y"]) + p["x"]).otherwise(p["x"])
        return (
            (y > F.least(p["y"], q["y"]))
            & (y <= F.greatest(p["y"], q["y"]))
            & (x <= F.greatest(p["x"], q["x"]))
            & ((p["x"] == q["x"]) | (x <= at))
        )

    return (F.size(F.filter(edges, crossed)) % 2) == 1
