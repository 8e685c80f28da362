"""Recording sessions: cameras, the videos that they took, and groups of instances over cameras.

The columnar tables refer to each other by row ranges: a frame group to instance groups (``ig_start``, ``ig_end``), these
to members (``member_start``, ``member_end``) and to rows of 3D points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(parents: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """A row for each number of a parent's range, as ``name``; an empty range has none."""
    has = parents.where(F.col(end) > F.col(start))
    return has.withColumn(name, F.explode(F.sequence(F.col(start), F.col(end) - 1)))


def instance_groups(frame_groups: DataFrame, groups: DataFrame, points: DataFrame, predicted_points: DataFrame) -> DataFrame:
    """Instance groups (session_id, frame_idx, group_id, identity_idx, score, points_3d) of the columnar tables.

    ``groups``, ``points`` and ``predicted_points`` have ``row``; a NaN score is NULL, as is a NaN coordinate.
    """
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    own = spread(frame_groups, "ig_start", "ig_end", "row").select("session_id", "frame_idx", "row").join(groups.drop("session_id"), "row")
    made = lambda p, score: p.select("row", F.struct(known("x").alias("x"), known("y").alias("y"), known("z").alias("z"), score.alias("score")).alias("p"))
    rows = spread(own.where("pts3d_start >= 0").select(F.col("row").alias("group_id"), "pts3d_start", "pts3d_end", "pts3d_predicted"), "pts3d_start", "pts3d_end", "row")
    user = rows.where("pts3d_predicted = 0").join(made(points, F.lit(None).cast("double")), "row")
    predicted = rows.where("pts3d_predicted = 1").join(made(predicted_points, F.col("score")), "row")
    placed = user.unionByName(predicted).groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "p"))), lambda s: s["p"]).alias("points_3d"))
    out = own.select("session_id", "frame_idx", F.col("row").alias("group_id"), F.when(F.col("identity_idx") >= 0, F.col("identity_idx")).alias("identity_idx"), known("score").alias("score"))
    return out.join(placed, "group_id", "left")


def members(groups: DataFrame, member_rows: DataFrame, cameras: DataFrame) -> DataFrame:
    """(group_id, camera_id, frame_ref, ord): members of each group; those of a camera that isn't there go, of several of a camera the last stays."""
    own = spread(groups.select(F.col("row").alias("group_id"), "session_id", "member_start", "member_end"), "member_start", "member_end", "row")
    known = own.join(member_rows, "row").join(cameras.select("session_id", F.col("ord").alias("camera"), "camera_id"), ["session_id", "camera"])
    return known.groupBy("group_id", "camera_id").agg(F.max_by(F.struct("lf", "inst"), "row").alias("m")).select("group_id", "camera_id", F.col("m.lf").alias("frame_ref"), F.col("m.inst").alias("ord"))


def resolve_members(member_rows: DataFrame, frames: DataFrame, instances: DataFrame) -> DataFrame:
    """members with frame_id and instance_id: a frame by its place in the file, an instance by its place in the frame; NULL if not there."""
    found = member_rows.join(frames.select(F.col("row").alias("frame_ref"), "frame_id"), "frame_ref", "left")
    return found.join(instances.select("frame_id", "ord", "instance_id"), ["frame_id", "ord"], "left")


def videos_of_cameras(cameras: DataFrame, mapping: DataFrame) -> DataFrame:
    """(session_id, camera_id, video_id): a camera and a video have one another once; of several rows the last counts."""
    last = mapping.groupBy("session_id", "camera_id").agg(F.max_by("video_id", "row").alias("video_id"), F.max("row").alias("row"))
    once = last.groupBy("session_id", "video_id").agg(F.max_by("camera_id", "row").alias("camera_id"))
    return once.join(cameras.select("session_id", "camera_id"), ["session_id", "camera_id"]).select("session_id", "camera_id", "video_id")


def camera_key(record: Column) -> Column:
    """The camera that a session record names: its key, else its name, else its number."""
    return F.coalesce(record["key"], record["name"], record["camera"].cast("string"))
