"""Hand-made cases of single operators."""

from __future__ import annotations

import json
from itertools import islice

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinemill.functions import colors, masks, paths
from kinemill.functions import points as P
from kinemill.functions import raster as R
from kinemill.operators import matching, merge, select, windows

POINTS = "points array<struct<x:double,y:double,visible:boolean,complete:boolean,score:double>>"


def pose(*xy):
    return [(None if p is None else float(p[0]), None if p is None else float(p[1]), p is not None, False, None) for p in xy]


def instances(spark, rows):
    return spark.createDataFrame([(f, i, i, u, t, 0.0, pose(*p)) for f, i, u, t, p in rows], f"f long, instance_id long, ord int, is_predicted boolean, track_id long, tracking_score double, {POINTS}")


def test_iou_of_boxes(spark):
    a = instances(spark, [(0, 1, False, None, [(0, 0), (10, 10)])])
    b = instances(spark, [(0, 2, False, None, [(5, 5), (15, 15)]), (0, 3, False, None, [(20, 20), (30, 30)]), (0, 4, False, None, [(0, 0), (10, 10)])])
    got = {r["b_instance_id"]: r["score"] for r in matching.instance_matches(a, b, ["f"], matching.InstanceMatcher("iou", 0.0)).collect()}
    assert got == {2: pytest.approx(25 / 175), 4: 1.0}


def test_spatial_match_needs_the_same_gaps(spark):
    a = instances(spark, [(0, 1, False, None, [(0, 0), None])])
    b = instances(spark, [(0, 2, False, None, [(3, 4), None]), (0, 3, False, None, [(0, 0), (1, 1)]), (0, 4, False, None, [(6, 0), None])])
    got = [(r["b_instance_id"], r["score"]) for r in matching.instance_matches(a, b, ["f"]).collect()]
    assert got == [(2, pytest.approx(1 / 6))]


def test_auto_merge_decides_by_kind_and_drops_second_matches(spark):
    at = [(0, 0), (1, 1)]
    far = [(500, 500), (600, 600)]
    base = instances(spark, [(0, 1, False, None, at), (1, 2, True, None, at), (2, 3, True, None, far)])
    other = instances(spark, [(0, 11, False, None, at), (0, 12, True, None, at), (1, 13, True, None, at), (1, 14, False, None, at), (2, 15, True, None, at)])
    merged, conflicts = merge.merge_instances(base, other, ["f"])
    assert sorted((r["f"], r["step"], r["instance_id"]) for r in merged.collect()) == [(0, 0, 1), (1, 1, 13), (2, 1, 15), (2, 2, 3)]
    assert sorted((r["b_instance_id"], r["resolution"]) for r in conflicts.collect()) == [(11, "kept_original"), (12, "kept_user")]


def test_keep_original_is_idempotent(spark):
    base = instances(spark, [(0, 1, False, None, [(0, 0)]), (0, 2, True, 5, [(1, 1)])])
    merged, _ = merge.merge_instances(base, base, ["f"], "keep_original")
    assert sorted(r["instance_id"] for r in merged.collect()) == [1, 2]


def test_no_cartesian_product_in_matching(spark):
    a = instances(spark, [(0, 1, False, None, [(0, 0)])])
    plan = merge.merge_instances(a, a, ["f"])[0]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_greedy_prefers_links(spark):
    m = spark.createDataFrame([(0, 0, 0, float("inf")), (0, 0, 1, 0.9), (0, 1, 0, 0.8), (0, 1, 1, 0.5)], "f long, a_ord int, b_ord int, score double")
    assert sorted((r["a_ord"], r["b_ord"]) for r in matching.greedy(m, ["f"]).collect()) == [(0, 0), (1, 1)]


def test_box_is_unknown_where_a_visible_point_is(spark):
    df = spark.createDataFrame([([(1.0, 2.0, True, False, None), (None, 5.0, True, False, None)],)], POINTS)
    assert tuple(df.select(P.bounding_box("points").alias("b")).select("b.*").first()) == (None, 2.0, None, 5.0)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=20), min_size=1, max_size=10))
def test_runs_round_trip(spark, rows):
    df = spark.createDataFrame([(r,) for r in rows], "b array<int>")
    for b, rle, back, area in df.select("b", masks.encode(F.col("b")), masks.decode(masks.encode(F.col("b"))), masks.area(masks.encode(F.col("b")))).collect():
        assert back == b and area == sum(b) and rle == R.rle(np.array(b, int))


def test_wkb_round_trip():
    square = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 0.0]]
    for g in ({"type": "Point", "coordinates": [1.5, 2.0]}, {"type": "LineString", "coordinates": square}, {"type": "Polygon", "coordinates": [square, square]}, {"type": "MultiPoint", "coordinates": square}, {"type": "MultiPolygon", "coordinates": [[square]]}):
        assert R.from_wkb(R.to_wkb(g)) == g
        assert R.from_wkb(R.to_wkb({"type": "GeometryCollection", "geometries": [g, g]}))["geometries"] == [g, g]
    assert len(R.to_wkb({"type": "Point", "coordinates": [0, 0]})) == 21


def test_contours_keep_diagonal_pixels_apart_and_find_holes():
    ring = np.ones((5, 5), int)
    ring[2, 2] = 0
    [poly] = R.polygons(R.contours(ring))
    assert len(poly) == 2 and abs(R._area(poly[0])) == 25 and abs(R._area(poly[1])) == 1
    assert len(R.polygons(R.contours(np.eye(2, dtype=int)))) == 2
    rng = np.random.default_rng(0)
    for _ in range(20):
        m = (rng.random((7, 9)) < 0.5).astype(np.uint8)
        found = R.polygons(R.contours(m))
        assert sum(abs(R._area(p[0])) - sum(abs(R._area(h)) for h in p[1:]) for p in found) == m.sum()


def test_coco_run_lengths():
    assert R.coco_mask([1, 2, 3], 2, 3).tolist() == [[0, 1, 0], [1, 0, 0]]
    assert R.coco_counts("03") == [0, 3]


def test_paths(spark):
    rows = [
        ("/home/u/code/proj/2026/raw/i.jpg", "L:/code/proj/2026", ["/home/u/code/proj/2026/raw/i.jpg", "L:/code/proj/2026/raw/i.jpg"]), ("a/./b.png", "/x", ["a/b.png", "/x/a/b.png", "/x/b.png"]),
        ("\\\\srv\\share\\a.mp4", "/d", ["//srv/share/a.mp4", "/d/srv/share/a.mp4", "/d/share/a.mp4", "/d/a.mp4"]), ("C:\\p\\q\\p\\v.mp4", "/m/p", ["C:/p/q/p/v.mp4", "/m/p/v.mp4", "/m/p/p/q/p/v.mp4"]),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "p string, f string").withColumn("i", F.monotonically_increasing_id())
    got = [r[0] for r in df.orderBy("i").select(paths.candidates(F.col("p"), F.col("f"))).collect()]
    assert [g[: len(w)] for g, (_, _, w) in zip(got, rows, strict=True)] == [w for _, _, w in rows] and all(len(g) == len(set(g)) for g in got)
    swap = paths.prefix_swap(F.lit("/a/b/1.png"), F.lit("D:/x/b/1.png"))
    assert spark.range(1).select(*(paths.apply_swap(F.lit(p), swap) for p in ("/a/b/2.png", "/c/b/2.png", "/a/3.png", "a/b"))).first() == ("D:/x/b/2.png", "/c/b/2.png", "D:/x/3.png", "a/b")


def test_one_video_of_a_path(spark):
    v = spark.createDataFrame([(1, "/a/x.mp4"), (2, "/b/x.mp4"), (3, "C:\\c\\y.mp4")], "video_id long, path string")
    assert [r["video_id"] for r in paths.unique_videos(v, "/a//x.mp4").collect()] == [1]
    assert [r["video_id"] for r in paths.unique_videos(v, "/q/y.mp4").collect()] == [3] and paths.unique_videos(v, "z").count() == 0
    with pytest.raises(ValueError):
        paths.unique_videos(v, "x.mp4")


def test_colors(spark):
    df = spark.createDataFrame([("Red",), ("#0af",), ("#102030",), ("rgb(1, 2,3)",), ("standard[8]",), ("what",)], "c string")
    assert [r[0] for r in df.select(colors.resolve(F.col("c"))).collect()] == [[255, 0, 0], [0, 170, 255], [16, 32, 48], [1, 2, 3], [217, 83, 25], None]


def test_split_sizes_and_numbers():
    assert select.split_sizes(10, 0.8) == (8, 2) and select.split_sizes(3, 0.1) == (1, 2) and select.split_sizes(1, 0.5) == (1, 1) and select.split_sizes(0, 0.5) == (0, 0)
    assert all(0 <= v < 1 for v in islice(select.random_numbers(), 100)) and list(islice(select.random_numbers(1), 3)) == list(islice(select.random_numbers(1), 3))


def test_missing_frame_is_an_error(spark):
    frames = spark.createDataFrame([(1, 0, 5, False)], "frame_id long, video_id long, frame_idx long, is_negative boolean")
    request = spark.createDataFrame([(0, 0, 6)], "pos long, video_id long, frame_idx long")
    with pytest.raises(Exception, match="no frame"):
        select.extract(frames, request).collect()


def test_trail_gaps(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 1.0), ("a", 2, None, None), ("a", 3, 4.0, 4.0)], "k string, frame_idx long, x double, y double")
    got = windows.trails(df, 2, ["k"], with_path=True).select("frame_idx", "n_points", windows.aligned(F.col("path"), F.col("frame_idx"), 2).alias("a")).collect()
    assert {r["frame_idx"]: r["n_points"] for r in got} == {0: 1, 2: 1, 3: 1}
    assert [p and p["x"] for p in next(r["a"] for r in got if r["frame_idx"] == 3)] == [None, None, 4.0]


def test_geojson_udf(spark):
    g = json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [3, 0], [3, 2], [0, 2], [0, 0]]]})
    [row] = spark.createDataFrame([(g,)], "g string").select(R.rle_of_geojson("g", F.lit(4), F.lit(5)).alias("r")).select(masks.area(F.col("r")), masks.bounds(F.col("r"), F.lit(5))).collect()
    assert row[0] == 6 and tuple(row[1]) == (0, 0, 3, 2)


def test_random_numbers_by_index_are_the_drawn_ones(spark):
    from itertools import islice

    from pyspark.sql import functions as F

    from kinemill.functions import arrays
    from kinemill.operators import select

    for seed in (0x9E3779B9, 0, 7, 0xFFFFFFFF):
        got = [r[0] for r in spark.range(0, 500, 1, 1).select(arrays.random_number(F.col("id"), seed)).collect()]
        assert got == list(islice(select.random_numbers(seed), 500))
