"""Expressions over a pose: an array of points, one for each node of its skeleton."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_x(p: Column) -> Column:
    return p["x"].isNotNull()


def seen(p: Column) -> Column:
    """Visible with a known x."""
    return F.coalesce(p["visible"], F.lit(False)) & has_x(p)


def n_visible(points) -> Column:
    """Visible points, whether or not their place is known."""
    return F.size(F.filter(_col(points), lambda p: F.coalesce(p["visible"], F.lit(False))))


def is_empty(points) -> Column:
    return ~F.exists(_col(points), seen)


def get_point(points, node: int | str | Column, nodes: Column | None = None) -> Column:
    """Point of a node by index (from 0) or, with the skeleton's ``nodes``, by name; NULL if there is none."""
    if isinstance(node, int):
        return F.get(_col(points), node)
    at = F.array_position(nodes, F.lit(node) if isinstance(node, str) else node)
    return F.when(at > 0, F.get(_col(points), (at - 1).cast("int")))


def masked(points, with_score: bool = False) -> Column:
    """[x, y(, score)] of each point, NULL where it is invisible."""

    def row(p: Column) -> Column:
        shown = F.coalesce(p["visible"], F.lit(False))
        cells = [F.when(shown, p[c]) for c in ("x", "y")]
        return F.array(*cells, *([F.when(shown, p["score"])] if with_score else []))

    return F.transform(_col(points), row)


def centroid(points) -> Column:
    """Mean place of the visible points with a known x; NULL if there are none."""
    shown = F.filter(_col(points), seen)
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).alias("n"))
    add = lambda s, p: F.struct((s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y"), (s["n"] + 1).alias("n"))
    return F.when(F.size(shown) > 0, F.aggregate(shown, zero, add, lambda s: F.struct((s["x"] / s["n"]).alias("x"), (s["y"] / s["n"]).alias("y"))))


def bounding_box(points) -> Column:
    """min_x, min_y, max_x, max_y of the visible points; an axis on which one of them is unknown is NULL."""
    shown = F.filter(_col(points), lambda p: F.coalesce(p["visible"], F.lit(False)))

    def ends(axis: str) -> list[Column]:
        whole = ~F.exists(shown, lambda p: p[axis].isNull())
        values = F.transform(shown, lambda p: p[axis])
        return [F.when(whole, F.array_min(values)).alias(f"min_{axis}"), F.when(whole, F.array_max(values)).alias(f"max_{axis}")]

    out = ends("x") + ends("y")
    return F.struct(out[0], out[2], out[1], out[3])


def box_center(points) -> Column:
    box = bounding_box(points)
    return F.struct(((box["min_x"] + box["max_x"]) / 2).alias("x"), ((box["min_y"] + box["max_y"]) / 2).alias("y"))


def center(points, method: str, nodes: Column | None = None) -> Column:
    """Centroid by ``center_of_mass``, ``bbox_center`` or ``anchor:<node>``; an error if nothing is visible."""
    if method == "center_of_mass":
        c = centroid(points)
    elif method == "bbox_center":
        c = box_center(points)
    elif method.startswith("anchor:"):
        p = get_point(points, method.removeprefix("anchor:"), nodes)
        c = F.when(seen(p), F.struct(p["x"].alias("x"), p["y"].alias("y")))
    else:
        raise ValueError(f"unknown method: {method}")
    return F.coalesce(c, F.raise_error(F.lit("no visible point")).cast("struct<x:double,y:double>"))


def shift(points, dx, dy) -> Column:
    """Points moved by (dx, dy)."""
    dx, dy = (d if isinstance(d, Column) else F.lit(float(d)) for d in (dx, dy))
    return F.transform(_col(points), lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y"), p["visible"].alias("visible"), p["complete"].alias("complete"), p["score"].alias("score")))


def crop(points, x1, y1) -> Column:
    """From source to crop coordinates; the crop begins at (x1, y1)."""
    return shift(points, -_lit(x1), -_lit(y1))


def uncrop(points, x1, y1) -> Column:
    return shift(points, _lit(x1), _lit(y1))


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def same_pose(a, b, tolerance: float | None = None) -> Column:
    """All points alike: exactly, or within ``tolerance`` by distance; unknown places must be unknown in both."""
    a, b = _col(a), _col(b)

    def alike(p: Column, q: Column) -> Column:
        if tolerance is None:
            return p["x"].eqNullSafe(q["x"]) & p["y"].eqNullSafe(q["y"])
        known = p["x"].isNotNull() & q["x"].isNotNull()
        near = F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2)) <= tolerance
        return F.when(known, near).otherwise(p["x"].isNull() & q["x"].isNull())

    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, alike), lambda v: F.coalesce(v, F.lit(False)))


def pose_key(points) -> Column:
    """Equal for identical poses; NULL without a known point. For equi-joins, to be verified with same_pose()."""
    p = _col(points)
    return F.when(F.exists(p, has_x), F.xxhash64(F.transform(p, lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two min/max boxes; 0 where they don't overlap, NULL where one is unknown."""
    w = F.least(a["max_x"], b["max_x"]) - F.greatest(a["min_x"], b["min_x"])
    h = F.least(a["max_y"], b["max_y"]) - F.greatest(a["min_y"], b["min_y"])
    area = lambda r: (r["max_x"] - r["min_x"]) * (r["max_y"] - r["min_y"])
    both = (w > 0) & (h > 0)
    known = a["min_x"].isNotNull() & b["min_x"].isNotNull() & a["min_y"].isNotNull() & b["min_y"].isNotNull()
    return F.when(known, F.when(both, w * h / (area(a) + area(b) - w * h)).otherwise(0.0))


def nearness(a, b) -> Column:
    """1 / (1 + mean distance) over the nodes that are known in both; 0 if there are none."""
    d = F.filter(F.zip_with(_col(a), _col(b), lambda p, q: F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2))), lambda v: v.isNotNull())
    return F.when(F.size(d) > 0, 1 / (1 + F.aggregate(d, F.lit(0.0), lambda s, v: s + v) / F.size(d))).otherwise(0.0)


def remap(points, from_nodes: Column, to_nodes: Column) -> Column:
    """The pose on another skeleton by node name; a node that it lacks is unknown and invisible."""
    p = _col(points)
    nothing = F.struct(F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(False).alias("visible"), F.lit(False).alias("complete"), F.lit(None).cast("double").alias("score"))
    return F.transform(to_nodes, lambda n: F.coalesce(F.when(F.array_position(from_nodes, n) > 0, F.get(p, (F.array_position(from_nodes, n) - 1).cast("int"))), nothing))


def empty_points(count: Column | int) -> Column:
    nothing = "named_struct('x', cast(null as double), 'y', cast(null as double), 'visible', false, 'complete', false, 'score', cast(null as double))"
    return F.array_repeat(F.expr(nothing), count)


def from_rows(rows, predicted: bool = False) -> Column:
    """Points from arrays: [x, y(, visible, complete)], or [x, y, score(, visible, complete)]; visible unless x is unknown."""

    def point(r: Column) -> Column:
        known = lambda v: F.when(~F.isnan(v), v)
        first = 3 if predicted else 2
        x, y = known(F.get(r, 0)), known(F.get(r, 1))
        return F.struct(
            x.alias("x"), y.alias("y"), F.coalesce(F.get(r, first) != 0, x.isNotNull()).alias("visible"), F.coalesce(F.get(r, first + 1) != 0, F.lit(False)).alias("complete"), (F.get(r, 2) if predicted else F.lit(None).cast("double")).alias("score")
        )

    return F.transform(_col(rows), point)


def from_map(values: Column, nodes: Column) -> Column:
    """Points from a map of node name to [x, y, ...]; nodes that it lacks are unknown."""
    return from_rows(F.transform(nodes, lambda n: F.coalesce(F.try_element_at(values, n), F.array(F.lit(float("nan")), F.lit(float("nan"))))))


def known_3d(points) -> Column:
    """Rows of a 3D pose without an unknown coordinate."""
    return F.size(F.filter(_col(points), lambda p: p["x"].isNotNull() & p["y"].isNotNull() & p["z"].isNotNull()))
