"""Reductions of poses to matrices, counts and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def long_points(instances: DataFrame) -> DataFrame:
    """One row a point: node_idx, x, y, visible, complete, point_score."""
    return instances.select("*", F.posexplode("points").alias("node_idx", "p")).select(*[c for c in instances.columns if c != "points"], "node_idx", "p.x", "p.y", "p.visible", "p.complete", F.col("p.score").alias("point_score"))


def slot_by_track(instances: DataFrame) -> DataFrame:
    """One instance for each (frame, track): the last user instance, else the last prediction."""
    w = Window.partitionBy("frame_id", "track_id").orderBy("is_predicted", F.col("ord").desc())
    return instances.where("track_id is not null").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def slot_untracked(instances: DataFrame) -> DataFrame:
    """Instances with ``slot``: users first, then the predictions that no user comes from or shares a track with."""
    users = instances.where("not is_predicted")
    linked = users.where("from_predicted is not null").select(F.col("from_predicted").alias("instance_id"))
    same = users.where("track_id is not null").select("frame_id", "track_id").distinct()
    rest = instances.where("is_predicted").join(linked, "instance_id", "left_anti").join(same, ["frame_id", "track_id"], "left_anti")
    both = users.unionByName(rest)
    return both.withColumn("slot", (F.row_number().over(Window.partitionBy("frame_id").orderBy("is_predicted", "ord")) - 1).cast("bigint"))


def occupancy(instances: DataFrame, frames: DataFrame, least: float = 0.0) -> DataFrame:
    """Frames and share of frames in which each track of each video appears; only tracks with that share at least."""
    total = frames.groupBy("video_id").agg(F.countDistinct("frame_idx").alias("n_frames"))
    placed = instances.where("track_id is not null").join(frames.select("frame_id", "video_id", "frame_idx"), "frame_id")
    per = placed.groupBy("video_id", "track_id").agg(F.countDistinct("frame_idx").alias("n_present"))
    return per.join(total, "video_id").withColumn("share", F.col("n_present") / F.col("n_frames")).where(F.col("share") >= least)


def dense_tensor(instances: DataFrame, frames: DataFrame, tracks: DataFrame, n_nodes: int, n_frames: DataFrame) -> DataFrame:
    """Every (video, frame, track, node) cell of the domain with x and y, NULL where there is none.

    The domain is spelt out by generators (``n_frames`` has video_id and n_frames); tracks are a dimension table. A
    later instance in the same slot wins.
    """
    w = Window.partitionBy("frame_id", "track_id").orderBy(F.col("ord").desc())
    last = instances.where("track_id is not null").withColumn("__n", F.row_number().over(w)).where("__n = 1")
    cells = last.join(frames.select("frame_id", "video_id", "frame_idx"), "frame_id").select("video_id", "frame_idx", "track_id", "points")
    own = tracks.groupBy("video_id").agg(F.collect_set("track_id").alias("__tracks"))
    domain = n_frames.join(own, "video_id").select("video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_frames") - 1)).alias("frame_idx"), "__tracks").select("video_id", "frame_idx", F.explode("__tracks").alias("track_id"))
    joined = domain.join(cells, ["video_id", "frame_idx", "track_id"], "left")
    return joined.select("video_id", "frame_idx", "track_id", F.explode(F.sequence(F.lit(0), F.lit(n_nodes - 1))).alias("node_idx"), "points").withColumn("p", F.get("points", F.col("node_idx"))).select("video_id", "frame_idx", "track_id", F.col("node_idx").cast("bigint").alias("node_idx"), "p.x", "p.y")


def analysis_rows(instances: DataFrame, frames: DataFrame, least: float = 0.0) -> DataFrame:
    """Long analysis matrices: point places and scores, instance and tracking scores of each (frame, track, node)."""
    kept = occupancy(instances, frames, least).select("video_id", "track_id")
    own = slot_by_track(instances).join(frames.select("frame_id", "video_id", "frame_idx"), "frame_id").join(kept, ["video_id", "track_id"], "left_semi")
    return long_points(own).select("video_id", "frame_idx", "track_id", "node_idx", "x", "y", "point_score", F.col("score").alias("instance_score"), "tracking_score")


def max_instances(instances: DataFrame, frames: DataFrame) -> DataFrame:
    """Of each video: the most user or predicted instances in one frame."""
    per = instances.join(frames.select("frame_id", "video_id"), "frame_id").groupBy("video_id", "frame_id").agg(F.count_if("is_predicted").alias("p"), F.count_if(F.expr("not is_predicted")).alias("u"))
    return per.groupBy("video_id").agg(F.max(F.greatest("p", "u")).alias("max_instances"))


def class_ids(rows: DataFrame, category: str = "category") -> DataFrame:
    """Distinct categories in order with ids from 0."""
    names = rows.where(F.col(category).isNotNull() & (F.col(category) != "")).select(F.col(category).alias("name")).distinct()
    return names.withColumn("class_id", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("name")) - 1).cast("bigint"))


def label_bounds(pixels: DataFrame, width: str) -> DataFrame:
    """Boxes of each label of label images given as rows (label_image_id, data): one pass over the pixels."""
    cells = pixels.select("label_image_id", F.col(width).alias("__w"), F.posexplode("data").alias("__i", "label_id")).where("label_id > 0")
    row, col = F.floor(F.col("__i") / F.col("__w")), F.col("__i") % F.col("__w")
    return cells.groupBy("label_image_id", "label_id").agg(F.min(col).alias("x1"), F.min(row).alias("y1"), (F.max(col) + 1).alias("x2"), (F.max(row) + 1).alias("y2"), F.count("*").alias("area"))


def csv_rows(instances: DataFrame, frames: DataFrame, nodes: list[str], pad_to: DataFrame | None = None) -> DataFrame:
    """Wide rows of the analysis CSV: node columns in order; ``pad_to`` (video_id, n_frames) adds the empty frames."""
    own = instances.join(frames.select("frame_id", "video_id", "frame_idx"), "frame_id")
    cells = [c for i, n in sorted(enumerate(nodes), key=lambda x: x[1]) for c in (F.when(F.col("is_predicted"), F.get("points", F.lit(i))["score"]).alias(f"{n}.score"), F.get("points", F.lit(i))["x"].alias(f"{n}.x"), F.get("points", F.lit(i))["y"].alias(f"{n}.y"))]
    out = own.select("video_id", "track_id", "frame_idx", F.when(F.col("is_predicted"), F.col("score")).alias("instance.score"), *cells)
    if pad_to is None:
        return out
    every = pad_to.select("video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_frames") - 1)).alias("frame_idx"))
    return out.unionByName(every.join(frames.select("video_id", "frame_idx").distinct(), ["video_id", "frame_idx"], "left_anti"), allowMissingColumns=True)
