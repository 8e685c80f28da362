"""Recordings on hand-made cells."""

from __future__ import annotations

import pytest

from kinemill.sources import recordings as R

NAN = float("nan")
CELLS = "frame_idx long, slot long, node_idx int, x double, y double, confidence double"


def test_pose_file_versions(spark):
    cells = spark.createDataFrame([(0, 0, 0, 1.0, 2.0, 0.5), (0, 0, 1, 3.0, 4.0, 0.0), (0, 1, 0, 5.0, 6.0, 0.25), (0, 1, 1, 7.0, 8.0, 0.75), (1, 0, 0, 1.0, 1.0, NAN), (1, 1, 0, 9.0, 9.0, None)], CELLS)
    slots = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 4, 1), (1, 0, 4, 2), (1, 1, 5, 2)], "frame_idx long, slot long, pose_id long, n_instances long")
    got = lambda v: [(r.frame_idx, r.slot, r.track, r.score, [(p.x, p.visible) for p in r.points]) for r in R.pose_file_instances(cells, 2, v, slots).collect()]
    first = (0, 0, "1", 0.5, [(1.0, True), (None, False)])
    assert got(2) == [first]
    assert got(3) == [(0, 0, "0", *first[3:])]
    assert got(5) == [(0, 1, "4", 0.5, [(5.0, True), (7.0, True)])]
    with pytest.raises(ValueError, match="slots"):
        R.pose_file_instances(cells, 2, 4)
    assert R.pose_file_instances(cells.limit(0), 2, 5, slots).count() == 0


def test_series_share_a_timeline(spark):
    schema = "track string, node_idx int, i long, x double, y double, confidence double, timestamp double, start double"
    rows = [("a", 0, 0, 1.0, 1.0, 0.5, 1.0, None), ("a", 1, 0, 2.0, 2.0, None, 60.0, None), ("b", 0, 0, 1.0, 1.0, None, 0.0, None), ("b", 0, 1, 2.0, 2.0, None, 0.3, None), (None, 0, 0, 4.0, 4.0, None, None, 7.0), (None, 0, 1, NAN, 4.0, None, None, 7.0)]
    got = {(r.track, r.frame_idx): [p.x for p in r.points] for r in R.series_instances(spark.createDataFrame(rows, schema), 2).collect()}
    assert got == {("a", 1): [1.0, None], ("a", 60): [None, 2.0], ("b", 0): [1.0, None], ("b", 1): [2.0, None], (None, 7): [4.0, None]}


def test_tensor_needs_one_coordinate(spark):
    cells = spark.createDataFrame([(0, 0, 0, NAN, 2.0, 0.5), (0, 1, 0, NAN, NAN, 0.5), (1, 0, 0, None, None, 0.1)], "frame_idx long, track_idx long, node_idx int, x double, y double, score double")
    scores = spark.createDataFrame([(0, 0, NAN, NAN)], "frame_idx long, track_idx long, score double, tracking_score double")
    got = R.tensor_instances(cells, scores, 1).collect()
    assert [(r.frame_idx, r.track_idx, r.score, r.tracking_score, r.points[0].x, r.points[0].y, r.points[0].visible) for r in got] == [(0, 0, 0.0, None, None, 2.0, False)]


def test_default_skeleton_is_whole():
    assert len(R.MOUSE_NODES) == 12 and len(R.MOUSE_EDGES) == 11
    assert {i for e in R.MOUSE_EDGES for i in e} == set(range(12))
    assert all(R.MOUSE_NODES[a].replace("LEFT", "RIGHT") == R.MOUSE_NODES[b] for a, b in R.MOUSE_SYMMETRIES)
