"""Nearest-point joins and region joins on a grid."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filamet.functions.geometry import point_in_polygon
from filamet.operators.ordered import large_groups
from filamet.session import stored

#: places that a leaf may hold, and cells per side of the grid that splits a larger node
CROWD = 64
FAN = 8
ROOT = 1
MAX_DEPTH = 9  # a path keeps FAN * FAN numbers per level in a long
#: references and locations of a group that are compared at once, without a tree
FEW_REFS = 1000
FEW_LOCATIONS = 4000


def nearest(
    queries: DataFrame, refs: DataFrame, keys: Sequence[str], *, order: Sequence[str], payload: Sequence[str], radius: float | None = None,
) -> DataFrame:
    """For every query location the nearest reference of its group (columns ``x``, ``y``).

    Locations are distinct; of references at one place the first in ``order`` stays, and ``order`` also
    breaks ties of distance.  A group of up to FEW_REFS references and FEW_LOCATIONS rows is one row of
    two lists that are compared whole; the references of larger ones form a tree of cells.
    Locations and references with a null, NaN or infinite coordinate have no distance: they are
    left out, as are locations of groups without references and those with none within ``radius``.
    Returns one row per distinct location.
    """
    keys, order, payload = list(keys), list(order), list(payload)
    refs, queries = _located(refs), _located(queries)
    rank = F.struct(*order, *[p for p in payload if p not in order])
    crowded = [large_groups(df, keys, n) for df, n in ((refs, FEW_REFS), (queries, FEW_LOCATIONS))]
    crowded = [g for g in crowded if g is not None]
    if not crowded:
        found = _nearest_few(queries, refs, keys, rank)
    else:
        large = crowded[0] if len(crowded) == 1 else crowded[0].unionByName(crowded[1]).distinct()
        few = _nearest_few(*(df.join(large, keys, "left_anti") for df in (queries, refs)), keys, rank)
        found = few.unionByName(_nearest_many(*(df.join(large, keys, "left_semi") for df in (queries, refs)), keys, rank, radius))
    within = F.lit(True) if radius is None else F.col("_b.d") <= float(radius)
    return found.where(within).select(*keys, "x", "y", F.col("_b.d").alias("distance"), *[F.col(f"_b._ref.{p}").alias(p) for p in payload])


def nearest_of(x: pd.Series, y: pd.Series, rx: pd.Series, ry: pd.Series) -> pd.DataFrame:
    """For every row, the distance ``d`` of each location to its nearest reference and that one's index ``i``, the lowest on a tie."""
    distances, indices = [], []
    for a, b, c, e in zip(x, y, rx, ry):
        d = np.empty(len(a))
        i = np.empty(len(a), dtype=np.int32)
        with np.errstate(over="ignore"):
            for k in range(0, len(a), 256):
                dx, dy = a[k : k + 256, None] - c, b[k : k + 256, None] - e
                all_d = np.sqrt(dx * dx + dy * dy)
                i[k : k + 256] = all_d.argmin(axis=1)
                d[k : k + 256] = all_d.min(axis=1)
        distances.append(d)
        indices.append(i)
    return pd.DataFrame({"d": distances, "i": indices})


def _nearest_few(queries: DataFrame, refs: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """Groups that fit in a row: their references in order and their locations as lists, compared in one call."""
    real = lambda c: (F.col(c).cast("double") + 0.0).alias(c)  # noqa: E731  -0.0 is 0.0
    q = queries.groupBy(*keys).agg(F.collect_set(F.struct(real("x"), real("y"))).alias("_q"))
    r = refs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(rank.alias("_ref"), real("x"), real("y")))).alias("_r"))
    near = F.pandas_udf(nearest_of, "d array<double>, i array<int>")("_q.x", "_q.y", "_r.x", "_r.y")
    hits = q.join(r, keys).withColumn("_h", near)
    best = F.transform(F.arrays_zip("_q", "_h.d", "_h.i"), lambda h: F.struct(h["_q"]["x"].alias("x"), h["_q"]["y"].alias("y"), F.struct(h["d"].alias("d"), F.get("_r", h["i"])["_ref"].alias("_ref")).alias("_b")))
    return hits.select(*keys, F.explode(best).alias("_e")).select(*keys, "_e.*")


def _nearest_many(queries: DataFrame, refs: DataFrame, keys: list[str], rank: Column, radius: float | None) -> DataFrame:
    """Groups of any size, over a tree of cells (``cell_tree``).

    A location first descends to the leaf that lies nearest on every level; the best reference there
    bounds its distance.  Then it descends again into the nodes that lie within the bound, of which
    there are few wherever it stands: none but those that could hold the answer.
    """
    places = stored(refs.groupBy(*keys, F.col("x").alias("rx"), F.col("y").alias("ry")).agg(F.min(rank).alias("_ref")), "places")
    inner, leaves, depth = cell_tree(places, keys)
    here = queries.select(*keys, "x", "y").distinct()
    first = stored(_bounds(here, inner, leaves, depth, keys), "bounds")
    if radius is not None:
        first = first.withColumn("_bound", F.least("_bound", F.lit(float(radius))))
    return _candidates(first, inner, depth, keys).join(leaves, [*keys, "_path"]).groupBy(*keys, "x", "y").agg(F.min(_best()).alias("_b"))


def _best() -> Column:
    return F.array_min(F.transform("_places", lambda p: F.struct(_distance(p).alias("d"), p["_ref"].alias("_ref"))))


def _bounds(here: DataFrame, inner: DataFrame, leaves: DataFrame, depth: int, keys: list[str]) -> DataFrame:
    """Distance to the best place in the leaf that is reached through the nearest node of every level."""
    at = here.withColumn("_path", F.lit(ROOT).cast("long"))
    for _ in range(depth):
        close = F.array_min(F.transform("_children", lambda n: F.struct(_gap(n).alias("d"), n["_path"].alias("p"))))["p"]
        at = at.join(inner, [*keys, "_path"], "left").select(*keys, "x", "y", F.coalesce(close, "_path").alias("_path"))
    return at.join(leaves, [*keys, "_path"]).select(*keys, "x", "y", _best()["d"].alias("_bound"))


def _candidates(first: DataFrame, inner: DataFrame, depth: int, keys: list[str]) -> DataFrame:
    """Every location with the leaves that lie within its bound."""
    at = first.withColumn("_path", F.lit(ROOT).cast("long"))
    for _ in range(depth):
        near = F.transform(F.filter("_children", lambda n: _gap(n) <= F.col("_bound")), lambda n: n["_path"])
        at = at.join(inner, [*keys, "_path"], "left").select(*keys, "x", "y", "_bound", F.explode(F.coalesce(near, F.array("_path"))).alias("_path"))
    return at


def _distance(p: Column) -> Column:
    dx, dy = F.col("x") - p["rx"], F.col("y") - p["ry"]
    return F.sqrt(dx * dx + dy * dy)


def _gap(n: Column) -> Column:
    """Distance to a box; never more than the distance to a place in it, also as rounded numbers."""
    dx = F.greatest(n["_x0"] - F.col("x"), F.lit(0.0), F.col("x") - n["_x1"])
    dy = F.greatest(n["_y0"] - F.col("y"), F.lit(0.0), F.col("y") - n["_y1"])
    return F.sqrt(dx * dx + dy * dy)


def cell_tree(places: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, int]:
    """Tree of cells over distinct places (``rx``, ``ry``, ``_ref``) of each group.

    A node with more than CROWD places is split by a grid of FAN x FAN cells over the box that its
    places fill, so a dense spot far from everything else takes one level and not many.  One pass per
    level over the places that are not in a leaf yet.  Returns the inner nodes (``_path`` and
    ``_children`` with path and box, FAN * FAN at most), the leaves (``_path``, ``_places``) and the
    number of levels.  Only places that stay crowded to MAX_DEPTH share a larger leaf.
    """
    keys = list(keys)
    box = [F.min("rx").alias("_x0"), F.max("rx").alias("_x1"), F.min("ry").alias("_y0"), F.max("ry").alias("_y1")]
    rows = places.withColumn("_path", F.lit(ROOT).cast("long"))
    inner = leaves = None
    for depth in range(MAX_DEPTH + 1):
        nodes = stored(rows.groupBy(*keys, "_path").agg(F.count(F.lit(1)).alias("_n"), *box), "cells")
        if depth:
            up = nodes.select(*keys, F.floor(F.col("_path") / FAN**2).cast("long").alias("_up"), F.struct("_path", "_x0", "_x1", "_y0", "_y1").alias("_c"))
            level = up.groupBy(*keys, F.col("_up").alias("_path")).agg(F.collect_list("_c").alias("_children"))
            inner = level if inner is None else inner.unionByName(level)
        full = nodes.where((F.col("_n") > CROWD) & F.lit(depth < MAX_DEPTH))
        small = rows.join(nodes.where((F.col("_n") <= CROWD) | F.lit(depth == MAX_DEPTH)).select(*keys, "_path"), [*keys, "_path"], "left_semi")
        small = small.groupBy(*keys, "_path").agg(F.collect_list(F.struct("rx", "ry", "_ref")).alias("_places"))
        leaves = small if leaves is None else leaves.unionByName(small)
        if full.isEmpty():
            break
        cell = _cell("rx", "_x0", "_x1") * FAN + _cell("ry", "_y0", "_y1")
        rows = stored(rows.join(full, [*keys, "_path"]).select(*keys, "rx", "ry", "_ref", (F.col("_path") * FAN**2 + cell).alias("_path")), "places")
    if inner is None:
        inner = nodes.select(*keys, "_path", F.array().cast("array<struct<_path:bigint,_x0:double,_x1:double,_y0:double,_y1:double>>").alias("_children")).limit(0)
    return stored(inner, "nodes") if depth else inner, stored(leaves, "leaves"), depth


def _cell(v: str, lo: str, hi: str) -> Column:
    """Cell of a value within its box; halves are taken first so that no difference overflows."""
    share = (F.col(v) / 2 - F.col(lo) / 2) / (F.col(hi) / 2 - F.col(lo) / 2)
    return F.when(F.col(hi) > F.col(lo), F.least(F.lit(FAN - 1), F.floor(share * FAN))).otherwise(0).cast("long")


def _located(df: DataFrame) -> DataFrame:
    """Rows whose coordinates are finite numbers."""
    ok = F.lit(True)
    for c in ("x", "y"):
        v = F.col(c).cast("double")
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return df.where(ok)


def neighbours(df: DataFrame, keys: Sequence[str], offsets: Sequence[tuple[int, int]]) -> DataFrame:
    """Every pixel joined to its present neighbours: adds ``nrow``, ``ncol``, ``dr``, ``dc``."""
    keys = list(keys)
    shifts = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets])
    probes = df.select(*keys, "row", "col").withColumn("_o", F.explode(shifts)).select(
        *keys, "row", "col", F.col("_o.dr").alias("dr"), F.col("_o.dc").alias("dc"),
        (F.col("row") + F.col("_o.dr")).alias("nrow"), (F.col("col") + F.col("_o.dc")).alias("ncol"),
    )
    there = df.select(*keys, F.col("row").alias("nrow"), F.col("col").alias("ncol"))
    return probes.join(there, [*keys, "nrow", "ncol"])


EIGHT = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
FOUR = [(-1, 0), (0, -1), (0, 1), (1, 0)]


def arc_weights(mask: DataFrame, keys: Sequence[str], px: str, py: str) -> DataFrame:
    """Half the calibrated length of every edge to a present neighbour; lone pixels get min(px, py)."""
    keys = list(keys)
    half = 0.5 * F.hypot(F.col("dc") * F.col(px), F.col("dr") * F.col(py))
    scale = mask.select(*keys, "row", "col", px, py)
    joined = neighbours(mask, keys, EIGHT).join(scale, [*keys, "row", "col"])
    sums = joined.groupBy(*keys, "row", "col").agg(F.sum(half).alias("_s"))
    return scale.join(sums, [*keys, "row", "col"], "left").select(
        *keys, "row", "col", F.coalesce(F.when(F.col("_s") != 0, F.col("_s")), F.least(px, py)).alias("weight")
    )


def degree(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    d = neighbours(mask, keys, EIGHT).groupBy(*keys, "row", "col").agg(F.count(F.lit(1)).alias("degree"))
    return mask.join(d, [*keys, "row", "col"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def drop_junctions(mask: DataFrame, keys: Sequence[str], limit: int = 3) -> DataFrame:
    """Drop pixels with ``limit`` or more neighbours; keep an image whole if nothing would remain."""
    d = degree(mask, keys)
    remains = d.groupBy(*keys).agg(F.bool_or(F.col("degree") < limit).alias("_some"))
    return d.join(remains, list(keys)).where((F.col("degree") < limit) | ~F.col("_some")).drop("_some")


def roi_pixels(pixels: DataFrame, rois: DataFrame, keys: Sequence[str], *, tile: int = 256) -> DataFrame:
    """Pixels inside each ROI (half-open ``x0 y0 x1 y1`` box or ``polygon``) by a tile join.

    Footer rows are kept but marked in ``excluded``.
    """
    keys = list(keys)
    poly = F.col("polygon").isNotNull()
    lo_x = F.when(poly, F.floor(F.array_min(F.transform("polygon", lambda p: p["x"])))).otherwise(F.col("x0")).cast("long")
    lo_y = F.when(poly, F.floor(F.array_min(F.transform("polygon", lambda p: p["y"])))).otherwise(F.col("y0")).cast("long")
    hi_x = F.when(poly, F.ceil(F.array_max(F.transform("polygon", lambda p: p["x"]))) + 1).otherwise(F.col("x1")).cast("long")
    hi_y = F.when(poly, F.ceil(F.array_max(F.transform("polygon", lambda p: p["y"]))) + 1).otherwise(F.col("y1")).cast("long")
    boxed = rois.withColumns({"_lx": lo_x, "_ly": lo_y, "_hx": hi_x, "_hy": hi_y}).where((F.col("_lx") < F.col("_hx")) & (F.col("_ly") < F.col("_hy")))
    tiled = boxed.withColumn("_tx", F.explode(F.sequence(F.floor(F.col("_lx") / tile), F.floor((F.col("_hx") - 1) / tile)))).withColumn(
        "_ty", F.explode(F.sequence(F.floor(F.col("_ly") / tile), F.floor((F.col("_hy") - 1) / tile)))
    )
    cells = pixels.withColumns({"_tx": F.floor(F.col("col") / tile), "_ty": F.floor(F.col("row") / tile)})
    inside_box = (F.col("col") >= F.col("_lx")) & (F.col("col") < F.col("_hx")) & (F.col("row") >= F.col("_ly")) & (F.col("row") < F.col("_hy"))
    hit = cells.join(tiled, [*keys, "_tx", "_ty"]).where(inside_box)
    hit = hit.where(~poly | point_in_polygon(F.col("col").cast("double"), F.col("row").cast("double"), F.col("polygon")))
    excluded = F.coalesce((F.col("row") >= F.col("footer_y0")) & (F.col("row") < F.col("footer_y1")), F.lit(False))
    return hit.withColumn("excluded", excluded).drop("_tx", "_ty", "_lx", "_ly", "_hx", "_hy")


def roi_statistics(inside: DataFrame, keys: Sequence[str], roi: str, px: str, py: str) -> DataFrame:
    """Area, centroid, intensity, excluded share and boundary-pixel perimeter of each ROI."""
    keys = [*keys, roi]
    valid = inside.where(~F.col("excluded"))
    counts = inside.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("raw"), F.count_if(~F.col("excluded")).alias("valid"), F.max(px).alias("_px"), F.max(py).alias("_py"),
        *[f(F.when(~F.col("excluded"), F.col(src).cast("double"))).alias(n) for f, src, n in (
            (F.avg, "col", "centroid_x"), (F.avg, "row", "centroid_y"), (F.avg, "value", "mean"), (F.stddev_pop, "value", "std"), (F.min, "value", "min"), (F.max, "value", "max"))],
    )
    interior = neighbours(valid, keys, FOUR).groupBy(*keys, "row", "col").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") == 4)
    inner = interior.groupBy(*keys).agg(F.count(F.lit(1)).alias("_inner"))
    out = counts.join(inner, keys, "left")
    boundary = F.col("valid") - F.coalesce("_inner", F.lit(0))
    return out.select(
        *keys, F.col("valid").alias("valid_pixels"), (F.col("raw") - F.col("valid")).alias("excluded_pixels"),
        ((F.col("raw") - F.col("valid")) / F.greatest(F.col("raw"), F.lit(1))).alias("excluded_fraction"),
        (F.col("valid") * F.col("_px") * F.col("_py")).alias("area_m2"),
        (boundary * F.sqrt(F.col("_px") * F.col("_px") + F.col("_py") * F.col("_py")) / 1.414).alias("perimeter_m"),
        *[F.coalesce(F.col(k), F.lit(0.0)).alias(k) for k in ("centroid_x", "centroid_y", "mean", "std", "min", "max")],
    )


def line_profile(pixels: DataFrame, lines: DataFrame, keys: Sequence[str], line: str, *, band: int = 1) -> DataFrame:
    """Bilinear samples along ``x1 y1 x2 y2``, averaged over a perpendicular band.

    Positions outside the image use the nearest edge pixel.  ``lines`` carries ``width`` and
    ``height``.  Returns one row per sample: ``ord``, ``t`` and ``value``.
    """
    keys = list(keys)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    offs = list(range(-(band // 2), band // 2 + 1)) if band > 1 else [0]
    pts = (
        lines.withColumn("_len", F.hypot(dx, dy)).where(F.col("_len") >= 1e-6)
        .withColumn("_n", F.greatest(F.lit(2), F.rint("_len").cast("int")))
        .withColumn("ord", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("t", F.col("ord") / (F.col("_n") - 1))
        .withColumn("_off", F.explode(F.array(*[F.lit(o) for o in offs])))
    )
    x = F.col("x1") + F.col("t") * dx - F.col("_off") * dy / F.col("_len")
    y = F.col("y1") + F.col("t") * dy + F.col("_off") * dx / F.col("_len")
    pts = pts.withColumns({
        "_x": F.greatest(F.lit(0.0), F.least(F.col("width") - 1.0, x)), "_y": F.greatest(F.lit(0.0), F.least(F.col("height") - 1.0, y)),
    }).withColumns({"_fx": F.floor("_x"), "_fy": F.floor("_y")})
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    wx = F.when(F.col("_k.a") == 1, F.col("_x") - F.col("_fx")).otherwise(1 - (F.col("_x") - F.col("_fx")))
    wy = F.when(F.col("_k.b") == 1, F.col("_y") - F.col("_fy")).otherwise(1 - (F.col("_y") - F.col("_fy")))
    taps = pts.withColumn("_k", F.explode(corners)).withColumn("_w", wx * wy).where(F.col("_w") > 0).select(
        *keys, line, "ord", "t", "_w", (F.col("_fx") + F.col("_k.a")).alias("col"), (F.col("_fy") + F.col("_k.b")).alias("row")
    )
    return taps.join(pixels.select(*keys, "row", "col", "value"), [*keys, "row", "col"]).groupBy(*keys, line, "ord", "t").agg(
        (F.sum(F.col("_w") * F.col("value")) / len(offs)).alias("value")
    )


def line_profile_summary(profile: DataFrame, keys: Sequence[str], line: str) -> DataFrame:
    return profile.groupBy(*keys, line).agg(F.count(F.lit(1)).alias("samples"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))


def nearest_boundary(hits: DataFrame, contour: DataFrame, keys: Sequence[str], ident: str) -> DataFrame:
    """Tangent alignment and inward consistency of edge hits with the nearest contour point.

    ``hits``: ``x y`` of the hit, ``cx cy`` of the centre, ``tx ty`` of its tangent, ``radius``;
    ``contour``: ``x y tx ty nx ny``.  The smaller value over the two sides of a sample counts.
    """
    keys = list(keys)
    near = nearest(hits, contour, keys, order=["tx", "ty"], payload=["tx", "ty", "nx", "ny"])
    near = near.select(*keys, "x", "y", *[F.col(c).alias(f"b_{c}") for c in ("tx", "ty", "nx", "ny")])
    j = hits.join(near, [*keys, "x", "y"])
    align = F.abs(F.col("b_tx") * F.col("tx") + F.col("b_ty") * F.col("ty"))
    inward = (F.col("b_nx") * (F.col("cx") - F.col("x")) + F.col("b_ny") * (F.col("cy") - F.col("y"))) / F.col("radius")
    return j.groupBy(*keys, ident).agg(F.min(align).alias("tangent_alignment"), F.min(inward).alias("normal_consistency"))


def pair_nearest_reference(auto: DataFrame, manual: DataFrame, keys: Sequence[str], *, radius: float = 150.0) -> DataFrame:
    """Automatic records paired with the nearest reviewed record of the same image within ``radius``."""
    keys = list(keys)
    m = manual.select(*keys, "x", "y", F.col("measurement_id").alias("manual_id"), F.col("value").alias("manual_value"))
    near = nearest(auto, m, keys, order=["manual_id"], payload=["manual_id", "manual_value"], radius=radius)
    diff = F.abs(F.col("value") - F.col("manual_value"))
    return auto.join(near, [*keys, "x", "y"]).select(
        *keys, F.col("measurement_id").alias("auto_id"), "manual_id", F.col("value").alias("auto_value"), "manual_value",
        diff.alias("absolute_difference"), (diff / F.greatest(F.col("manual_value"), F.lit(1e-15))).alias("relative_difference"),
        F.col("distance").alias("center_distance_px"),
    )


def symmetric_displacement(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distance of every pixel of either mask to the nearest pixel of the other one."""
    keys = list(keys)

    def one_way(a: DataFrame, b: DataFrame) -> DataFrame:
        q = a.select(*keys, F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
        ref = b.select(*keys, F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), F.lit(0).alias("o"))
        return nearest(q, ref, keys, order=["o"], payload=["o"]).select(*keys, "distance")

    return one_way(left, right).unionByName(one_way(right, left))

