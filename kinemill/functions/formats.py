"""Expressions for the text of annotation formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INT, _FLOAT = r"^[+-]?\d+$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: A label line of a class and four or five numbers, each as in _FLOAT.
BOX_LINE = r"^[+-]?\d+(?:\s+[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?){4,5}$"


def round_half_up(x: Column) -> Column:
    """floor(x + 0.5), also for negative numbers."""
    return F.floor(x + 0.5)


def strict_int(s: Column) -> Column:
    return F.when(s.rlike(_INT), s.try_cast("bigint"))


def strict_float(s: Column) -> Column:
    return F.when(s.rlike(_FLOAT), s.try_cast("double"))


def six(x: Column) -> Column:
    """Six decimals, ties away from zero."""
    return x.cast("double").try_cast("decimal(24,6)").cast("string")


def yolo_kind(tokens: Column) -> Column:
    """detection (5 values), detection_conf (6), segmentation (an odd number above 6 that isn't 5 + 3k), pose."""
    n = F.size(tokens)
    return F.when(n < 5, F.lit(None)).when(n == 5, "detection").when(n == 6, "detection_conf").when((n - 5) % 3 == 0, "pose").when(n % 2 == 1, "segmentation").otherwise("pose")


def yolo_box(numbers: Column, width: Column, height: Column) -> Column:
    """Pixel box of a line's numbers (after the class); NULL if one of them is."""
    v = [F.get(numbers, F.lit(i)) for i in range(4)]
    x, y, w, h = v[0] * width, v[1] * height, v[2] * width, v[3] * height
    return F.when((x + y + w + h).isNotNull(), F.struct((x - w / 2).alias("x1"), (y - h / 2).alias("y1"), (x + w / 2).alias("x2"), (y + h / 2).alias("y2")))


def yolo_points(tokens: Column, numbers: Column, width: Column, height: Column) -> Column:
    """Keypoints of a pose line; those of visibility 0 are unknown."""

    def point(i: Column) -> Column:
        x, y, v = F.get(numbers, 4 + 3 * i), F.get(numbers, 5 + 3 * i), strict_int(F.get(tokens, 7 + 3 * i))
        return F.struct(F.when(v > 0, x * width).alias("x"), F.when(v > 0, y * height).alias("y"), (v > 0).alias("visible"), F.lit(False).alias("complete"), F.lit(None).cast("double").alias("score"))

    n = ((F.size(tokens) - 5) / 3).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), point))


def yolo_detection_line(class_id: Column, x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, score: Column | None = None) -> Column:
    cells = [class_id.cast("string"), six((x1 + x2) / 2 / width), six((y1 + y2) / 2 / height), six((x2 - x1) / width), six((y2 - y1) / height)]
    return F.concat_ws(" ", *cells, *([six(score)] if score is not None else []))


def yolo_pose_line(class_id: Column, points: Column, width: Column, height: Column, padding: float = 10.0) -> Column:
    """Box of the visible points, padded and clipped, then every point; NULL if none is visible."""
    shown = F.filter(points, lambda p: F.coalesce(p["visible"], F.lit(False)) & p["x"].isNotNull())
    lo = lambda a: F.greatest(F.lit(0.0), F.array_min(F.transform(shown, lambda p: p[a])) - padding)
    hi = lambda a, m: F.least(m.cast("double"), F.array_max(F.transform(shown, lambda p: p[a])) + padding)
    cell = lambda p: F.when(F.coalesce(p["visible"], F.lit(False)) & p["x"].isNotNull(), F.concat_ws(" ", six(p["x"] / width), six(p["y"] / height), F.lit("2"))).otherwise(F.lit("0.000000 0.000000 0"))
    head = yolo_detection_line(class_id, lo("x"), lo("y"), hi("x", width), hi("y", height), width, height)
    return F.when(F.size(shown) > 0, F.concat_ws(" ", head, F.array_join(F.transform(points, cell), " ")))


def coco_points(keypoints: Column) -> Column:
    """Flat (x, y, v) triples; v = 0 is unknown."""

    def point(i: Column) -> Column:
        v = F.get(keypoints, 3 * i + 2)
        return F.struct(F.when(v > 0, F.get(keypoints, 3 * i)).alias("x"), F.when(v > 0, F.get(keypoints, 3 * i + 1)).alias("y"), (v > 0).alias("visible"), F.lit(False).alias("complete"), F.lit(None).cast("double").alias("score"))

    n = F.floor(F.size(keypoints) / 3).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), point)).otherwise(F.array().cast("array<struct<x:double,y:double,visible:boolean,complete:boolean,score:double>>"))


def coco_edges(skeleton: Column, n_nodes: Column) -> Column:
    """Edges by index from 0; those out of range go."""
    both = F.transform(skeleton, lambda e: F.struct((F.get(e, 0) - 1).cast("int").alias("src"), (F.get(e, 1) - 1).cast("int").alias("dst")))
    return F.filter(both, lambda e: e["src"].between(0, n_nodes - 1) & e["dst"].between(0, n_nodes - 1))


def trailing_number(name: Column) -> Column:
    """The last number in a file's stem."""
    stem = F.regexp_replace(F.element_at(F.split(name, r"[/\\]"), -1), r"\.[^.]*$", "")
    return F.try_element_at(F.regexp_extract_all(stem, F.lit(r"(\d+)"), 1), F.lit(-1)).try_cast("bigint")


def dlc_crop(text: Column) -> Column:
    """``x1, x2, y1, y2`` as [x1, y1, x2, y2]; NULL if it isn't four numbers, is inverted, or begins at (0, 0)."""
    cells = F.transform(F.split(text, ","), lambda c: F.trim(c).try_cast("double").cast("bigint"))
    x1, x2, y1, y2 = (F.get(cells, i) for i in range(4))
    return F.when((F.size(cells) == 4) & (x2 > x1) & (y2 > y1) & ~((x1 == 0) & (y1 == 0)), F.array(x1, y1, x2, y2))


def video_number(path: Column) -> Column:
    """N of ``videoN/video``."""
    return F.nullif(F.regexp_extract(path, r"^/?video(\d+)(?:/|$)", 1), F.lit("")).try_cast("bigint")


def centroid_source(text: Column) -> Column:
    """camelCase to snake_case."""
    return F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1_$2"))


def frame_count(declared: Column, shape_frames: Column, frame_numbers: Column) -> Column:
    """The declared count (else the shape's), or more if frame numbers go beyond it; NULL if not above 0."""
    n = F.greatest(F.coalesce(declared, shape_frames), F.array_max(frame_numbers) + 1)
    return F.when(n > 0, n)


def seq_seconds(seconds: Column, milliseconds: Column, microseconds: Column) -> Column:
    return seconds + milliseconds / 1000 + microseconds / 1_000_000


def half_even(x: Column) -> Column:
    """The nearest whole number, ties to the even one."""
    return F.bround(x, 0).cast("bigint")


def csv_cell(text: Column) -> Column:
    """A cell of a CSV line: quoted if it holds a comma, a quote or a line end."""
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(text, F.lit("")))


def stem(path: Column) -> Column:
    """A file's name without folders and its last ending."""
    return F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"(?<=.)\.[^.]*$", "")


def status_text(status: Column) -> Column:
    """What an HTTP status means to the reader of a message."""
    return F.when(status.isin(401, 403), "access denied").when(status == 404, "not found").when(status == 429, "too many requests").when(status >= 500, "server error").otherwise(F.concat(F.lit("status "), status.cast("string")))


def yolo_polygon_line(class_id: Column, ring: Column, width: Column, height: Column) -> Column:
    """A segmentation line: the corners of a closed outer ring without the closing one."""
    open_ = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.concat_ws(" ", F.coalesce(class_id, F.lit(0)).cast("string"), F.array_join(F.flatten(F.transform(open_, lambda c: F.array(six(c[0] / width), six(c[1] / height)))), " "))


def segmentation_rings(segmentation: Column) -> Column:
    """Closed rings of a COCO polygon list; those of fewer than three corners go."""
    corner = lambda flat, i: F.array(F.get(flat, 2 * i), F.get(flat, 2 * i + 1))
    n = lambda flat: F.floor(F.size(flat) / 2).cast("int")
    kept = F.filter(segmentation, lambda flat: n(flat) >= 3)
    ring = lambda flat: F.transform(F.sequence(F.lit(0), n(flat) - 1), lambda i: corner(flat, i))
    return F.transform(kept, lambda flat: F.concat(ring(flat), F.array(corner(flat, F.lit(0)))))


def segmentation_geojson(segmentation: Column) -> Column:
    """One geometry of all rings of a COCO polygon list; NULL if none is left."""
    rings = segmentation_rings(segmentation)
    one = F.concat(F.lit('{"type":"Polygon","coordinates":['), F.to_json(F.get(rings, F.lit(0))), F.lit("]}"))
    many = F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), F.to_json(F.transform(rings, lambda r: F.array(r))), F.lit("}"))
    return F.when(F.size(rings) == 1, one).when(F.size(rings) > 1, many)


def static_object(name: Column, coords: Column) -> Column:
    """geometry and category of a static object: a point or several; corners are an arena, others an anchor."""
    one = F.concat(F.lit('{"type":"Point","coordinates":'), F.to_json(F.get(coords, F.lit(0))), F.lit("}"))
    many = F.concat(F.lit('{"type":"MultiPoint","coordinates":'), F.to_json(coords), F.lit("}"))
    return F.struct(F.when(F.size(coords) == 1, one).otherwise(many).alias("geometry"), F.when(name == "corners", "arena").otherwise("anchor").alias("category"))
