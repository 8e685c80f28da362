"""Recordings whose arrays arrive as long tables of cells: pose files with slots, series of samples, dense tensors.

The files themselves are HDF5; any columnar copy of their arrays gives these tables. A missing number may be NULL or NaN.
Every function groups by the instance's own key, so a long recording is as many groups as it has instances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators.windows import time_to_frame

# The default skeleton of pose files.
MOUSE_NODES = ["NOSE", "LEFT_EAR", "RIGHT_EAR", "BASE_NECK", "LEFT_FRONT_PAW", "RIGHT_FRONT_PAW", "CENTER_SPINE", "LEFT_REAR_PAW", "RIGHT_REAR_PAW", "BASE_TAIL", "MID_TAIL", "TIP_TAIL"]
MOUSE_EDGES = [(3, 0), (3, 6), (6, 9), (9, 10), (10, 11), (0, 1), (0, 2), (6, 4), (6, 5), (9, 7), (9, 8)]
MOUSE_SYMMETRIES = [(1, 2), (4, 5), (7, 8)]


def known(c: str) -> Column:
    """Neither NULL nor NaN."""
    return F.col(c).isNotNull() & ~F.isnan(c)


def _number(c: str) -> Column:
    return F.when(known(c), F.col(c))


def _points(n_nodes: int, score: str, order: str | None = None) -> Column:
    """The points of a group's cells by node_idx, the last in ``order`` of each node; nodes without a cell are unknown."""
    cell = F.struct(*([F.col(order).alias("at")] if order else []), _number("x").alias("x"), _number("y").alias("y"), _number(score).alias("score"))
    made = []
    for k in range(n_nodes):
        c = F.max(F.when(F.col("node_idx") == k, cell))
        made.append(F.struct(c["x"].alias("x"), c["y"].alias("y"), F.coalesce(c["x"].isNotNull(), F.lit(False)).alias("visible"), F.lit(False).alias("complete"), c["score"].alias("score")))
    return F.array(*made)


def pose_file_instances(cells: DataFrame, n_nodes: int, version: int = 2, slots: DataFrame | None = None) -> DataFrame:
    """frame_idx, slot, track, score, points of a pose file's cells (frame_idx, slot, node_idx, x, y, confidence).

    A point counts where its confidence is above 0; an instance without one is left out, and its score is the mean of
    those confidences. ``slots`` (frame_idx, slot, pose_id, n_instances) is needed from version 3 on: version 3 has
    ``n_instances`` slots a frame, later ones use the slots whose pose_id is above 0. Version 2 has one animal, track 1.
    """
    if version > 2 and slots is None:
        raise ValueError(f"version {version} needs the table of slots")
    own = cells.where(known("confidence") & (F.col("confidence") > 0)).groupBy("frame_idx", "slot").agg(F.avg("confidence").alias("score"), _points(n_nodes, "confidence").alias("points"))
    if version == 2:
        return own.where("slot = 0").select("frame_idx", "slot", F.lit("1").alias("track"), "score", "points")
    used = slots.where("slot < n_instances" if version == 3 else "pose_id > 0")
    return own.join(used, ["frame_idx", "slot"]).select("frame_idx", "slot", F.col("pose_id").cast("string").alias("track"), "score", "points")


def series_instances(samples: DataFrame, n_nodes: int) -> DataFrame:
    """track, frame_idx, points of series of samples (track, node_idx, i, x, y, confidence, timestamp, start).

    All series of a track share one timeline, the union of their sample times: the rounded times if none fall together,
    else their ranks. An instance needs a known x. Of two samples of a node at one time the later one stays. NULL is a track
    of its own. A track's different times are ranked in one task: one row a frame of the recording.
    """
    at = samples.withColumn("__time", A.sample_time(_number("timestamp"), F.col("start"), F.col("i")))
    at = at.withColumn("__key", F.struct("track"))  # a struct is never NULL, so that rows without a track meet
    times = time_to_frame(at.select("__key", "__time").distinct(), "__key", "__time")
    own = at.join(times, ["__key", "__time"]).groupBy("__key", "frame_idx").agg(_points(n_nodes, "confidence", "i").alias("points"))
    return own.where(F.exists("points", lambda p: p["x"].isNotNull())).select(F.col("__key.track").alias("track"), "frame_idx", "points")


def tensor_instances(cells: DataFrame, scores: DataFrame, n_nodes: int) -> DataFrame:
    """frame_idx, track_idx, score, tracking_score, points of an analysis tensor's cells (frame_idx, track_idx, node_idx, x, y, score).

    An instance needs one known coordinate. ``scores`` (frame_idx, track_idx, score, tracking_score) may lack rows: an
    unknown score is 0, an unknown tracking score NULL.
    """
    own = cells.where(known("x") | known("y")).groupBy("frame_idx", "track_idx").agg(_points(n_nodes, "score").alias("points"))
    both = own.join(scores, ["frame_idx", "track_idx"], "left")
    return both.select("frame_idx", "track_idx", F.coalesce(_number("score"), F.lit(0.0)).alias("score"), _number("tracking_score").alias("tracking_score"), "points")


def annotation_points(locations: Column, visibility: Column | None, n_nodes: int) -> Column:
    """Points of an annotation's flat locations; what is missing is unknown. Without visibility a point with x is visible."""

    def point(k: Column) -> Column:
        x, y = F.get(locations, 2 * k), F.get(locations, 2 * k + 1)
        x, y = F.when(~F.isnan(x), x), F.when(~F.isnan(y), y)
        seen = x.isNotNull() if visibility is None else F.coalesce(F.get(visibility, k) != 0, F.lit(False))
        return F.struct(x.alias("x"), y.alias("y"), seen.alias("visible"), F.lit(False).alias("complete"), F.lit(None).cast("double").alias("score"))

    return F.transform(F.sequence(F.lit(0), F.lit(n_nodes - 1)), point)
