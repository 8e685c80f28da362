"""Raster and binary geometry, in numpy behind Arrow UDFs: WKB, scan conversion, contours, run-length strings, pixels."""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StringType

_TYPES = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiPolygon": 6, "GeometryCollection": 7}


def to_wkb(geometry: dict) -> bytes:
    """Little-endian WKB of a GeoJSON geometry."""
    kind = geometry["type"]
    if kind not in _TYPES:
        raise ValueError(f"unsupported geometry: {kind}")
    head = struct.pack("<BI", 1, _TYPES[kind])
    flat = lambda pts: b"".join(struct.pack("<2d", *p[:2]) for p in pts)
    counted = lambda items: struct.pack("<I", len(items)) + b"".join(items)
    if kind == "GeometryCollection":
        return head + counted([to_wkb(g) for g in geometry["geometries"]])
    c = geometry["coordinates"]
    if kind == "Point":
        return head + flat([c])
    if kind == "LineString":
        return head + struct.pack("<I", len(c)) + flat(c)
    if kind == "Polygon":
        return head + counted([struct.pack("<I", len(r)) + flat(r) for r in c])
    return head + counted([to_wkb({"type": kind.removeprefix("Multi"), "coordinates": x}) for x in c])


def from_wkb(data: bytes) -> dict:
    geometry, end = _read_wkb(data, 0)
    if end != len(data):
        raise ValueError("bytes are left after the geometry")
    return geometry


def _read_wkb(data: bytes, at: int) -> tuple[dict, int]:
    order = "<" if data[at] == 1 else ">"
    kind = {v: k for k, v in _TYPES.items()}[struct.unpack_from(order + "I", data, at + 1)[0]]
    at += 5

    def count() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", data, at - 4)[0]

    def points(n: int) -> list[list[float]]:
        nonlocal at
        v = struct.unpack_from(f"{order}{2 * n}d", data, at)
        at += 16 * n
        return [list(v[i : i + 2]) for i in range(0, 2 * n, 2)]

    if kind == "Point":
        return {"type": kind, "coordinates": points(1)[0]}, at
    if kind == "LineString":
        return {"type": kind, "coordinates": points(count())}, at
    if kind == "Polygon":
        return {"type": kind, "coordinates": [points(count()) for _ in range(count())]}, at
    parts = []
    for _ in range(count()):
        part, at = _read_wkb(data, at)
        parts.append(part)
    if kind == "GeometryCollection":
        return {"type": kind, "geometries": parts}, at
    return {"type": kind, "coordinates": [p["coordinates"] for p in parts]}, at


def rasterize(geometry: dict, height: int, width: int) -> np.ndarray:
    """Scan conversion at pixel centres of rows; from floor to ceil of the crossings; holes cleared."""
    kind, out = geometry["type"], np.zeros((height, width), np.uint8)
    if kind == "Polygon":
        for k, ring in enumerate(geometry["coordinates"]):
            _fill(out, np.asarray(ring, float), int(k == 0))
    elif kind == "MultiPolygon":
        for rings in geometry["coordinates"]:
            out |= rasterize({"type": "Polygon", "coordinates": rings}, height, width)
    elif kind == "GeometryCollection":
        for part in geometry["geometries"]:
            out |= rasterize(part, height, width)
    return out


def _fill(out: np.ndarray, ring: np.ndarray, value: int) -> None:
    height, width = out.shape
    if len(ring) < 3:
        return
    a, b = ring[:-1], ring[1:]
    low, high = np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1])
    for y in range(max(0, int(np.floor(ring[:, 1].min()))), min(height - 1, int(np.floor(ring[:, 1].max()))) + 1):
        on = (low <= y + 0.5) & (y + 0.5 < high)
        t = (y + 0.5 - a[on, 1]) / (b[on, 1] - a[on, 1])
        x = np.sort(a[on, 0] + t * (b[on, 0] - a[on, 0]))
        for lo, hi in zip(x[::2], x[1::2], strict=False):
            out[y, max(0, int(np.floor(lo))) : max(0, min(width, int(np.ceil(hi))))] = value


def contours(mask: np.ndarray) -> list[list[list[int]]]:
    """Closed rings along pixel corners; regions that touch at a corner stay apart; straight runs have no inner point."""
    pad = np.pad(mask.astype(bool), 1)
    steps: dict[tuple[int, int], list[tuple[int, int]]] = {}
    # foreground lies to the right of each step: top edges go right, right edges down, and so on
    for dy, dx, start, end in ((-1, 0, (0, 0), (1, 0)), (0, 1, (1, 0), (1, 1)), (1, 0, (1, 1), (0, 1)), (0, -1, (0, 1), (0, 0))):
        beside = np.roll(pad, (-dy, -dx), (0, 1))
        for r, c in zip(*np.nonzero(pad & ~beside), strict=True):
            x, y = int(c) - 1, int(r) - 1
            steps.setdefault((x + start[0], y + start[1]), []).append((x + end[0], y + end[1]))
    rings = []
    for begin in sorted(steps, key=lambda p: (p[1], p[0])):
        while steps.get(begin):
            ring, here, before = [], begin, None
            while True:
                ways = steps[here]
                if before is not None and len(ways) > 1:
                    dx, dy = here[0] - before[0], here[1] - before[1]
                    ways.sort(key=lambda w: dx * (w[1] - here[1]) - dy * (w[0] - here[0]))
                ahead = ways.pop()
                ring.append(here)
                if ahead == begin:
                    break
                before, here = here, ahead
            corner = lambda p, q, s: (q[0] - p[0]) * (s[1] - p[1]) != (q[1] - p[1]) * (s[0] - p[0])
            kept = [q for k, q in enumerate(ring) if corner(ring[k - 1], q, ring[(k + 1) % len(ring)])]
            rings.append([list(q) for q in kept + kept[:1]])
    return rings


def _area(ring: list) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def _inside(point: list, ring: list) -> bool:
    x, y = point
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:], strict=False)) % 2 == 1


def polygons(rings: list) -> list[list]:
    """[outer, holes...] each: the largest ring's winding is outer; a hole belongs to the smallest outer around it."""
    if not rings:
        return []
    areas = [_area(r) for r in rings]
    sign = np.sign(max(areas, key=abs)) or 1
    outer = [[r] for r, a in zip(rings, areas, strict=True) if np.sign(a) == sign]
    for ring, area in zip(rings, areas, strict=True):
        if np.sign(area) != sign:
            around = [p for p in outer if _inside(ring[0], p[0])]
            if around:
                min(around, key=lambda p: abs(_area(p[0]))).append(ring)
    return outer


def coco_counts(text: str) -> list[int]:
    """Run lengths of a compressed COCO string: groups of five bits, signed; differences from two before after the third."""
    out, at = [], 0
    while at < len(text):
        value = shift = 0
        while True:
            c = ord(text[at]) - 48
            value |= (c & 31) << shift
            at, shift = at + 1, shift + 5
            if not c & 32:
                break
        if c & 16:
            value -= 1 << shift
        out.append(value + (out[-2] if len(out) > 2 else 0))
    return out


def coco_mask(counts: list[int] | str, height: int, width: int) -> np.ndarray:
    """Rows of a COCO mask; its runs go down the columns."""
    runs = coco_counts(counts) if isinstance(counts, str) else list(counts)
    flat = np.repeat(np.arange(len(runs)) % 2, runs)[: height * width]
    return np.pad(flat, (0, height * width - len(flat))).reshape(width, height).T.astype(np.uint8)


def rle(mask: np.ndarray) -> list[int]:
    """Runs in row order, background first."""
    flat = mask.ravel().astype(bool)
    if not len(flat):
        return []
    cuts = np.flatnonzero(np.diff(np.concatenate(([False], flat)).astype(np.int8))).tolist()
    return np.diff([0, *cuts, len(flat)]).tolist()


def crop(frame: np.ndarray, x1: int, y1: int, x2: int, y2: int, fill: int = 0) -> np.ndarray:
    """The part [x1, x2) x [y1, y2) of a frame; what lies outside it is filled."""
    out = np.full((y2 - y1, x2 - x1, *frame.shape[2:]), fill, frame.dtype)
    a, b, c, d = max(0, y1), min(frame.shape[0], y2), max(0, x1), min(frame.shape[1], x2)
    if a < b and c < d:
        out[a - y1 : b - y1, c - x1 : d - x1] = frame[a:b, c:d]
    return out


def gray(frame: np.ndarray) -> np.ndarray:
    """Luma of BT.601, 0 to 1."""
    f = frame.astype(float)
    return (f[..., 0] if f.ndim == 2 or f.shape[2] < 3 else f[..., :3] @ np.array([0.299, 0.587, 0.114])) / 255


def difference(a: np.ndarray, b: np.ndarray) -> float:
    """Mean absolute difference of two frames in gray; infinite if their sizes differ."""
    x, y = gray(a), gray(b)
    return float(np.abs(x - y).mean()) if x.shape == y.shape else float("inf")


def overlay(frame: np.ndarray, mask: np.ndarray, color: tuple[int, int, int], alpha: float) -> np.ndarray:
    """The colour over the frame where the mask is set: trunc(below * (1 - a) + above * a)."""
    out = frame.copy()
    on = mask.astype(bool)
    out[on] = np.clip(np.trunc(frame[on] * (1 - alpha) + np.array(color) * alpha), 0, 255).astype(frame.dtype)
    return out


@F.pandas_udf(BinaryType())
def wkb_of_geojson(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else to_wkb(json.loads(t)))


@F.pandas_udf(StringType())
def geojson_of_wkb(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else json.dumps(from_wkb(bytes(b)), separators=(",", ":")))


@F.pandas_udf(ArrayType(LongType()))
def rle_of_geojson(text: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else rle(rasterize(json.loads(t), int(h), int(w))) for t, h, w in zip(text, height, width, strict=True)])


@F.pandas_udf(StringType())
def geojson_of_rle(runs: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """Polygon or MultiPolygon of a mask; NULL for an empty one."""

    def one(r, h: int, w: int) -> str | None:
        if r is None:
            return None
        flat = np.repeat(np.arange(len(r)) % 2, np.asarray(r, int))
        found = polygons(contours(flat.reshape(h, w)))
        if not found:
            return None
        return json.dumps({"type": "Polygon", "coordinates": found[0]} if len(found) == 1 else {"type": "MultiPolygon", "coordinates": found}, separators=(",", ":"))

    return pd.Series([one(r, int(h), int(w)) for r, h, w in zip(runs, height, width, strict=True)], dtype=object)


@F.pandas_udf(ArrayType(LongType()))
def rle_of_coco(counts: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else rle(coco_mask(c, int(h), int(w))) for c, h, w in zip(counts, height, width, strict=True)])


# ---- Whole batches of polygons: a polygon is an array of rings, a ring an array of [x, y] --------------------------

#: Pixels that are spelt out at once.
_PIXELS = 4_000_000
_RINGS = ArrayType(ArrayType(ArrayType(DoubleType())))
_POLYGONS = pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _nth(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each list."""
    return np.arange(lengths.sum()) - np.repeat(_starts(lengths), lengths)


def _nested(lengths: np.ndarray, values: pa.Array, null: np.ndarray | None = None) -> pa.Array:
    offsets = pa.array(np.concatenate(([0], np.cumsum(lengths)))).cast(pa.int32())
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array(null) if null is not None and null.any() else None)


def _pairs(xy: np.ndarray) -> pa.Array:
    return _nested(np.full(len(xy), 2), pa.array(np.ascontiguousarray(xy, float).ravel()))


def _points(rings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Points of each ring, and all points; what a point has beyond x and y is left out."""
    points = rings.flatten()
    n, values = _lengths(points), points.flatten().to_numpy(zero_copy_only=False)
    if (n == 2).all():
        return _lengths(rings), values.reshape(-1, 2)
    if (n < 2).any():
        raise ValueError("a point has no x and y")
    return _lengths(rings), values[_starts(n)[:, None] + np.arange(2)]


def _spans(counts: np.ndarray, xy: np.ndarray, height: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``_fill`` fills of each ring: (ring, start, end) in the row order of its mask."""
    if not np.isfinite(xy).all():
        raise ValueError("a coordinate is unknown or infinite")
    ring = np.repeat(np.arange(len(counts)), counts)
    edge = np.flatnonzero((ring[1:] == ring[:-1]) & (counts[ring[1:]] >= 3)) if len(ring) else np.zeros(0, np.int64)
    own, (ax, ay), (bx, by) = ring[edge], xy[edge].T, xy[edge + 1].T

    def line(v: np.ndarray) -> np.ndarray:
        """The first whose centre isn't below ``v``, within the mask."""
        y = np.ceil(v - 0.5)
        y -= y - 0.5 >= v
        y += y + 0.5 < v
        return np.clip(y, 0, height[own]).astype(np.int64)

    first = line(np.minimum(ay, by))
    n = np.maximum(line(np.maximum(ay, by)) - first, 0)
    k = np.repeat(np.arange(len(edge)), n)
    y = first[k] + _nth(n)
    x = ax[k] + (y + 0.5 - ay[k]) / (by[k] - ay[k]) * (bx[k] - ax[k])
    key = own[k] * (int(height.max(initial=0)) + 1) + y
    order = np.argsort(key, kind="stable")
    key, x, y, own = key[order], x[order], y[order], own[k][order]
    if len(key) % 2 == 0 and (key[::2] == key[1::2]).all() and (key[2::2] != key[1:-1:2]).all():  # two on each line
        x = np.column_stack((np.minimum(x[::2], x[1::2]), np.maximum(x[::2], x[1::2]))).ravel()
    else:
        x = x[np.lexsort((x, key))]
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    at = np.arange(len(key))
    even = (at - np.maximum.accumulate(np.where(new, at, 0))) % 2 == 0
    i = np.flatnonzero(even[:-1] & ~new[1:])
    own, y = own[i], y[i]
    lo, hi = np.clip(np.floor(x[i]), 0, width[own]).astype(np.int64), np.clip(np.ceil(x[i + 1]), 0, width[own]).astype(np.int64)
    has = lo < hi
    own, line0 = own[has], (y * width[own])[has]
    return own, line0 + lo[has], line0 + hi[has]


def _covered(start: np.ndarray, end: np.ndarray, hole_start: np.ndarray, hole_end: np.ndarray) -> np.ndarray:
    """Where the union of ranges without the holes' union begins and ends, in turns."""
    at = np.concatenate((np.column_stack((start, end)).ravel(), np.column_stack((hole_start, hole_end)).ravel()))
    n, one = 2 * len(start), np.where(np.arange(len(at)) % 2 == 0, 1, -1)
    order = np.argsort(at, kind="stable")
    at, one = at[order], one[order]
    on = np.cumsum(np.where(order < n, one, 0)) > 0
    if len(hole_start):
        on &= np.cumsum(np.where(order >= n, one, 0)) == 0
    last = np.concatenate((at[1:] != at[:-1], [True])) if len(at) else np.zeros(0, bool)
    at, on = at[last], on[last]
    return at[on != np.concatenate(([False], on[:-1]))] if len(at) else at


def _rle_of(n_rings: np.ndarray, rings: pa.Array, mask_of: np.ndarray, height: np.ndarray, width: np.ndarray, null: np.ndarray) -> pa.Array:
    """``rle(rasterize(...))`` of each mask; mask_of: of each polygon, ascending."""
    area, polygon, hole = height * width, np.repeat(np.arange(len(n_rings)), n_rings), _nth(n_rings) > 0
    # a place between the masks keeps them apart
    base, own_base = _starts(area + 1), _starts(area[mask_of] + 1)
    ring, start, end = _spans(*_points(rings), height[mask_of[polygon]], width[mask_of[polygon]])
    shift, h = own_base[polygon[ring]], hole[ring]
    edges = _covered((start + shift)[~h], (end + shift)[~h], (start + shift)[h], (end + shift)[h])
    owner = np.searchsorted(own_base, edges, "right") - 1
    edges, owner = edges - own_base[owner], mask_of[owner]
    if len(mask_of) and (np.diff(mask_of) == 0).any():
        edges += base[owner]
        edges = _covered(edges[::2], edges[1::2], edges[:0], edges[:0])
        owner = np.searchsorted(base, edges, "right") - 1
        edges -= base[owner]
    inner = edges < area[owner]
    edges, owner = edges[inner], owner[inner]
    n = np.bincount(owner, minlength=len(area))
    first = _starts(n + 2)
    cuts = np.zeros(len(edges) + 2 * len(area), np.int64)
    cuts[first + n + 1] = area
    cuts[first[owner] + 1 + _nth(n)] = edges
    kept = np.ones(max(0, len(cuts) - 1), bool)
    kept[first[1:] - 1] = False
    kept[first[area == 0]] = False
    return _nested(np.where(area > 0, n + 1, 0), pa.array(np.diff(cuts)[kept]), null)


def _sizes(height: pa.Array, width: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return tuple(pc.fill_null(v, 0).to_numpy(zero_copy_only=False).astype(np.int64) for v in (height, width))


@F.arrow_udf(BinaryType())
def wkb_of_rings(polygons: pa.Array) -> pa.Array:
    """Little-endian WKB of a polygon, as ``to_wkb`` gives it."""
    rings = polygons.flatten()
    n_rings, (counts, xy) = _lengths(polygons), _points(rings)
    sizes = 4 + 16 * counts
    polygon = np.repeat(np.arange(len(n_rings)), n_rings)
    ends = 9 * (np.arange(len(n_rings)) + 1) + np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(n_rings)]
    begins = np.concatenate(([0], ends[:-1]))
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    bytes_of = lambda v, kind: np.ascontiguousarray(v, kind).view(np.uint8).reshape(len(v), -1)
    out[begins[:, None] + np.arange(5)] = np.frombuffer(struct.pack("<BI", 1, 3), np.uint8)
    out[begins[:, None] + np.arange(5, 9)] = bytes_of(n_rings, "<u4")
    heads = _starts(sizes) + 9 * (polygon + 1)
    out[heads[:, None] + np.arange(4)] = bytes_of(counts, "<u4")
    out[(np.repeat(heads + 4, counts) + 16 * _nth(counts))[:, None] + np.arange(16)] = bytes_of(xy, "<f8")
    offsets = pa.array(np.concatenate(([0], ends))).cast(pa.int32())
    made = pa.Array.from_buffers(pa.binary(), len(n_rings), [None, offsets.buffers()[1], pa.py_buffer(out)])
    return pc.if_else(polygons.is_valid(), made, pa.scalar(None, pa.binary())) if polygons.null_count else made


@F.arrow_udf(_RINGS)
def rings_of_wkb(data: pa.Array) -> pa.Array:
    """Rings of a polygon's WKB in either byte order; NULL for other geometries."""
    data = data if data.offset == 0 else pa.concat_arrays([data])
    offsets = np.frombuffer(data.buffers()[1], np.int32)[: len(data) + 1].astype(np.int64)
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)
    begin, end = offsets[:-1], offsets[1:]
    there = data.is_valid().to_numpy(zero_copy_only=False)
    little = np.ones(len(data), bool)

    def numbers(at: np.ndarray, kind: str, low: np.ndarray) -> np.ndarray:
        cells = raw[at[:, None] + np.arange(int(kind[-1]))].view(f"<{kind}").ravel()
        return np.where(low, cells, cells.byteswap())

    def fits(last: np.ndarray, row: np.ndarray) -> None:
        if (last > end[row]).any():
            raise ValueError("a geometry ends too early")

    rows = np.flatnonzero(there)
    fits(begin[rows] + 5, rows)
    little[rows] = raw[begin[rows]] == 1
    there[rows] = numbers(begin[rows] + 1, "u4", little[rows]) == 3
    rows = np.flatnonzero(there)
    fits(begin[rows] + 9, rows)
    n_rings = np.zeros(len(data), np.int64)
    n_rings[rows] = numbers(begin[rows] + 5, "u4", little[rows])
    at, found, k = begin + 9, [], 0
    while len(rows := rows[n_rings[rows] > k]):
        fits(at[rows] + 4, rows)
        n = numbers(at[rows], "u4", little[rows]).astype(np.int64)
        found.append((rows, at[rows] + 4, n))
        at[rows] += 4 + 16 * n
        fits(at[rows], rows)
        k += 1
    if (at[there] != end[there]).any():
        raise ValueError("bytes are left after the geometry")
    row, place, n = (np.concatenate(c) for c in zip(*found, strict=True)) if found else np.zeros((3, 0), np.int64)
    order = np.argsort(row, kind="stable")
    row, place, n = row[order], place[order], n[order]
    places = np.repeat(place, 2 * n) + 8 * _nth(2 * n)
    values = numbers(places, "f8", np.repeat(little[row], 2 * n))
    return _nested(n_rings, _nested(n, _pairs(values.reshape(-1, 2))), ~there)


@F.arrow_udf(ArrayType(LongType()))
def rle_of_rings(polygons: pa.Array, height: pa.Array, width: pa.Array) -> pa.Array:
    """A polygon scan-converted to runs, as ``rasterize`` does."""
    return _rle_of(_lengths(polygons), polygons.flatten(), np.arange(len(polygons)), *_sizes(height, width), polygons.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(ArrayType(LongType()))
def rle_of_polygons(masks: pa.Array, height: pa.Array, width: pa.Array) -> pa.Array:
    """Several polygons scan-converted to the runs of one mask."""
    polygons = masks.flatten()
    mask_of = np.repeat(np.arange(len(masks)), _lengths(masks))
    return _rle_of(_lengths(polygons), polygons.flatten(), mask_of, *_sizes(height, width), masks.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(DoubleType())
def area_of_polygons(masks: pa.Array) -> pa.Array:
    """Sum of the polygons' areas, each as ``geometry.polygon_area`` gives it."""
    polygons = masks.flatten()
    n_rings, (counts, xy) = _lengths(polygons), _points(polygons.flatten())
    ring, polygon = np.repeat(np.arange(len(counts)), counts), np.repeat(np.arange(len(n_rings)), n_rings)
    i = np.flatnonzero(ring[1:] == ring[:-1])
    areas = np.abs(np.bincount(ring[i], xy[i, 0] * xy[i + 1, 1] - xy[i + 1, 0] * xy[i, 1], len(counts)) / 2)
    outer = np.zeros(len(n_rings))
    outer[n_rings > 0] = areas[_starts(n_rings)[n_rings > 0]]
    own = np.abs(2 * outer - np.bincount(polygon, areas, len(n_rings)))
    return pa.array(np.bincount(np.repeat(np.arange(len(masks)), _lengths(masks)), own, len(masks)), mask=masks.is_null().to_numpy(zero_copy_only=False))


def _traced(pixels: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Polygons of masks (mask, row, column). Those of one ring are traced together, the rest one by one."""
    m, h, w = pixels.shape
    pad = np.zeros((m, h + 2, w + 2), np.uint8)
    pad[:, 1:-1, 1:-1] = pixels
    odd = (pad[:, :-1, :-1] ^ pad[:, :-1, 1:] ^ pad[:, 1:, :-1] ^ pad[:, 1:, 1:]).astype(bool)
    touch = ((pad[:, :-1, :-1] == pad[:, 1:, 1:]) & (pad[:, :-1, 1:] == pad[:, 1:, :-1]) & (pad[:, :-1, :-1] != pad[:, :-1, 1:])).any((1, 2))
    mask, y, x = np.nonzero(odd)
    # corners of a line lie at the ends of its edges in turns, and so do those of a column
    at = np.arange(len(mask))
    across = at ^ 1
    down = np.empty_like(at)
    by_column = np.lexsort((y, x, mask))
    down[by_column] = by_column[at ^ 1]
    n = np.bincount(mask, minlength=m)
    first, full = _starts(n), np.flatnonzero((n > 0) & ~touch)
    ring = np.full(len(mask), -1)
    one = np.zeros(m, bool)
    rows, here, k = full, first[full], 0
    while len(rows):
        ring[first[rows] + k] = here
        here = across[here] if k % 2 == 0 else down[here]
        k += 1
        back = here == first[rows]
        one[rows[back]] = n[rows[back]] == k
        rows, here = rows[~back], here[~back]
    own = np.flatnonzero(one)
    counts = n[own] + 1
    corner = ring[np.repeat(first[own], counts) + _nth(counts) % np.repeat(n[own], counts)]
    made = _nested(np.ones(len(own), int), _nested(np.ones(len(own), int), _nested(counts, _pairs(np.column_stack((x[corner], y[corner]))))))
    rest = np.flatnonzero((n > 0) & ~one | touch)
    others = pa.array([polygons(contours(pixels[k])) for k in rest], made.type)
    place = np.full(m, -1)
    place[own], place[rest] = np.arange(len(own)), len(own) + np.arange(len(rest))
    return pa.concat_arrays([made, others]), place


@F.arrow_udf(ArrayType(_RINGS))
def polygons_of_rle(runs: pa.Array, height: pa.Array, width: pa.Array) -> pa.Array:
    """Polygons of a mask, as ``polygons(contours(...))``; NULL for an empty one."""
    (h, w), there = _sizes(height, width), runs.is_valid().to_numpy(zero_copy_only=False)
    n, values = _lengths(runs), runs.flatten().to_numpy(zero_copy_only=False)
    first, bits = _starts(n), _nth(n) % 2
    if (np.bincount(np.repeat(np.arange(len(n)), n), values, len(n))[there] != (h * w)[there]).any():
        raise ValueError("runs don't fill their mask")
    made, place, count = [], np.full(len(n), -1), 0
    for size in set(zip(h[there].tolist(), w[there].tolist(), strict=True)):
        rows = np.flatnonzero(there & (h == size[0]) & (w == size[1]))
        step = max(1, _PIXELS // max(1, size[0] * size[1]))
        for part in (rows[k : k + step] for k in range(0, len(rows), step)):
            at = np.repeat(first[part], n[part]) + _nth(n[part])
            found, own = _traced(np.repeat(bits[at], values[at]).reshape(len(part), *size).astype(np.uint8))
            place[part] = np.where(own < 0, -1, own + count)
            made.append(found)
            count += len(found)
    if not made:
        return pa.nulls(len(n), _POLYGONS)
    return pa.concat_arrays(made).take(pa.array(place, mask=place < 0))
