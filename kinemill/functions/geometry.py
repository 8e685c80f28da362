"""Expressions over boxes and polygons. A ring is an array of [x, y]; a polygon an array of rings, holes after the first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def xyxy(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The box with its corners in order."""
    return F.struct(F.least(x1, x2).alias("min_x"), F.least(y1, y2).alias("min_y"), F.greatest(x1, x2).alias("max_x"), F.greatest(y1, y2).alias("max_y"))


def xywh(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    b = xyxy(x1, y1, x2, y2)
    return F.struct(b["min_x"].alias("x"), b["min_y"].alias("y"), (b["max_x"] - b["min_x"]).alias("w"), (b["max_y"] - b["min_y"]).alias("h"))


def box_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.abs(x2 - x1) * F.abs(y2 - y1)


def corners(x1: Column, y1: Column, x2: Column, y2: Column, angle: Column) -> Column:
    """The four corners, turned by ``angle`` (radians) about the centre."""
    cx, cy, c, s = (x1 + x2) / 2, (y1 + y2) / 2, F.cos(angle), F.sin(angle)
    turn = lambda x, y: F.array(cx + (x - cx) * c - (y - cy) * s, cy + (x - cx) * s + (y - cy) * c)
    return F.array(turn(x1, y1), turn(x2, y1), turn(x2, y2), turn(x1, y2))


def ring_bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def box_ring(x1: Column, y1: Column, x2: Column, y2: Column, angle: Column | None = None) -> Column:
    """The box as a closed ring."""
    c = corners(x1, y1, x2, y2, F.lit(0.0) if angle is None else angle)
    return F.concat(c, F.array(c[0]))


def signed_area(ring: Column) -> Column:
    """Shoelace area of a closed ring; the sign tells the winding."""
    n = F.size(ring)
    pairs = F.zip_with(F.slice(ring, 1, F.greatest(n - 1, F.lit(0))), F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a[0] * b[1] - b[0] * a[1])
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v) / 2


def polygon_area(rings: Column) -> Column:
    """Area of the outer ring without those of the holes."""
    areas = F.transform(rings, lambda r: F.abs(signed_area(r)))
    return F.abs(2 * F.coalesce(F.get(areas, 0), F.lit(0.0)) - F.aggregate(areas, F.lit(0.0), lambda s, v: s + v))


def polygon_bounds(rings: Column) -> Column:
    return ring_bounds(F.flatten(rings))


def bounds_center(bounds: Column) -> Column:
    return F.struct(((bounds["min_x"] + bounds["max_x"]) / 2).alias("x"), ((bounds["min_y"] + bounds["max_y"]) / 2).alias("y"))


def is_box(rings: Column, eps: float = 1e-10) -> Column:
    """One closed ring of five points whose sides are parallel to the axes."""
    ring = F.get(rings, 0)
    near = lambda a, b: F.abs(a - b) < eps
    level = [near(F.get(ring, i)[0], F.get(ring, i + 1)[0]) | near(F.get(ring, i)[1], F.get(ring, i + 1)[1]) for i in range(4)]
    closed = near(F.get(ring, 0)[0], F.get(ring, 4)[0]) & near(F.get(ring, 0)[1], F.get(ring, 4)[1])
    return (F.size(rings) == 1) & (F.size(ring) == 5) & F.coalesce(closed & reduce(lambda a, b: a & b, level), F.lit(False))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: whether (x, y) lies within a closed ring."""
    n = F.size(ring)

    def crosses(a: Column, b: Column) -> Column:
        spans = (a[1] > y) != (b[1] > y)
        return F.when(spans & (x < (b[0] - a[0]) * (y - a[1]) / F.nullif(b[1] - a[1], F.lit(0.0)) + a[0]), 1).otherwise(0)

    hits = F.zip_with(F.slice(ring, 1, F.greatest(n - 1, F.lit(0))), F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), crosses)
    return F.aggregate(hits, F.lit(0), lambda s, v: s + v) % 2 == 1


def polygon_geojson(rings: Column) -> Column:
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")))


def rodrigues(rvec: Column) -> Column:
    """3 x 3 rotation matrix (rows) of a rotation vector."""
    a, b, c = (F.get(rvec, i) for i in range(3))
    t = F.sqrt(a * a + b * b + c * c)
    still = t < 1e-12
    x, y, z = (F.when(still, 0.0).otherwise(v / F.when(still, 1.0).otherwise(t)) for v in (a, b, c))
    co, si = F.cos(t), F.sin(t)
    v = 1 - co
    return F.array(F.array(co + x * x * v, x * y * v - z * si, x * z * v + y * si), F.array(y * x * v + z * si, co + y * y * v, y * z * v - x * si), F.array(z * x * v - y * si, z * y * v + x * si, co + z * z * v))


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Corners of a box given by its least corner and size."""
    return F.struct(x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))


_RING = "array<array<array<double>>>"


def parts_of(geometry: Column) -> Column:
    """The parts (GeoJSON texts) of a MultiPolygon or GeometryCollection; any other geometry is its own only part."""
    kind = F.get_json_object(geometry, "$.type")
    polygons = F.from_json(F.get_json_object(geometry, "$.coordinates"), f"array<{_RING}>")
    each = F.transform(polygons, lambda rings: F.concat(F.lit('{"type":"Polygon","coordinates":'), F.to_json(rings), F.lit("}")))
    inner = F.from_json(F.get_json_object(geometry, "$.geometries"), "array<string>")
    return F.when(kind == "MultiPolygon", each).when(kind == "GeometryCollection", inner).otherwise(F.array(geometry))


def rings_of(geometry: Column) -> Column:
    """Rings of a Polygon's GeoJSON text; NULL for other geometries."""
    return F.when(F.get_json_object(geometry, "$.type") == "Polygon", F.from_json(F.get_json_object(geometry, "$.coordinates"), _RING))
