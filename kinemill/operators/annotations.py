"""Annotations of frames: their places, merging, links to instances and owners, and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import masks as M
from .matching import greedy, link_pairs, near_pairs

KINDS = {"centroids": "centroid_id", "bboxes": "bbox_id", "masks": "mask_id", "rois": "roi_id", "label_images": "label_image_id"}


def _xy(x: Column, y: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))


def place(kind: str, rings: Column | None = None) -> Column:
    """x and y of an annotation of a kind, from its table's columns; NULL for an empty mask or a region without area.

    A region's place needs its ``rings`` (outer ring first).
    """
    if kind == "centroids":
        return _xy(F.col("x"), F.col("y"))
    if kind == "bboxes":  # turning a box about its centre leaves the centre
        return _xy((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2)
    if kind == "masks":
        box = M.to_image(M.bounds(F.col("rle"), F.col("width")), F.col("scale"), F.col("offset"))
        return F.when(M.area(F.col("rle")) > 0, _xy((box["min_x"] + box["max_x"]) / 2, (box["min_y"] + box["max_y"]) / 2))
    if kind == "rois":
        mid = G.bounds_center(G.polygon_bounds(rings))
        return F.when(G.polygon_area(rings) > 0, _xy(mid["x"], mid["y"]))
    if kind == "label_images":
        part = lambda c, i, d: F.coalesce(F.get(F.col(c), i), F.lit(d))
        return _xy(F.col("width") / 2 / part("scale", 0, 1.0) + part("offset", 0, 0.0), F.col("height") / 2 / part("scale", 1, 1.0) + part("offset", 1, 0.0))
    raise ValueError(f"unknown kind: {kind}")


def merge_annotations(base: DataFrame, other: DataFrame, keys: list[str], id_col: str, strategy: str = "keep_both", threshold: float = 5.0, per_object_tracks: bool = False) -> DataFrame:
    """One kind's annotations of the frames (``keys``) that both datasets have, with ``source`` and ``step``.

    Both sides have ``ord``, ``is_predicted``, ``track_id``, ``tracking_score``, ``from_predicted``, ``x``, ``y``; ids differ
    between the sides. Annotations of a frame stand by (step, ord). ``per_object_tracks`` (label images) leaves tracks alone.
    """
    rows = lambda d, source, step: d.withColumn("source", F.lit(source)).withColumn("step", F.lit(step))
    mine, theirs = rows(base, "self", 0), rows(other, "other", 1)
    if strategy == "keep_original":
        return mine
    if strategy == "keep_new":
        return theirs
    if strategy == "replace_predictions":
        return mine.where("not is_predicted").unionByName(theirs.where("is_predicted"))
    if strategy == "keep_both":
        return mine.unionByName(theirs.join(base.select(*keys, id_col), [*keys, id_col], "left_anti").select(*theirs.columns))
    near = near_pairs(base.select(*keys, id_col, "ord", "x", "y", "track_id", "tracking_score"), other.select(*keys, id_col, "ord", "x", "y", "track_id", "tracking_score"), keys, threshold)
    if strategy == "update_tracks":
        if per_object_tracks:
            return mine
        best = near.groupBy(*keys, F.col(f"a_{id_col}").alias(id_col)).agg(F.min_by(F.struct("b_track_id", "b_tracking_score"), F.struct(-F.col("score"), F.col("b_ord"))).alias("__new"))
        hit = F.col("__new").isNotNull()
        out = mine.join(best, [*keys, id_col], "left")
        return out.withColumn("track_id", F.when(hit, F.col("__new.b_track_id")).otherwise(F.col("track_id"))).withColumn("tracking_score", F.when(hit, F.col("__new.b_tracking_score")).otherwise(F.col("tracking_score"))).select(*mine.columns)
    if strategy != "auto":
        raise ValueError(f"unknown strategy: {strategy}")
    linked = link_pairs(base.select(*keys, id_col, "ord", "from_predicted"), other.select(*keys, id_col, "ord", "from_predicted"), keys, id_col)
    pairs = greedy(linked.select(*keys, "a_ord", "b_ord", "score").unionByName(near.select(*keys, "a_ord", "b_ord", "score")).groupBy(*keys, "a_ord", "b_ord").agg(F.max("score").alias("score")), keys)
    met_a = pairs.select(*keys, F.col("a_ord").alias("ord"), F.lit(True).alias("__met"))
    own = base.select(*keys, F.col("ord").alias("a_ord"), F.col("is_predicted").alias("__a_predicted"))
    met_b = pairs.join(own, [*keys, "a_ord"]).select(*keys, F.col("b_ord").alias("ord"), "__a_predicted")
    # what meets a user annotation gives way to it; what meets a prediction takes its place
    added = theirs.join(met_b, [*keys, "ord"], "left").where(F.coalesce("__a_predicted", F.lit(True))).select(*theirs.columns)
    rest = rows(base.where("is_predicted"), "self", 2).join(met_a, [*keys, "ord"], "left_anti").select(*mine.columns)
    return mine.where("not is_predicted").unionByName(added).unionByName(rest)


def unused_predicted_masks(masks: DataFrame, keys: list[str], threshold: float = 5.0) -> DataFrame:
    """Predicted masks that no user mask of their frame comes from or lies within ``threshold`` of (``x``, ``y``)."""
    predicted, user = masks.where("is_predicted"), masks.where("not is_predicted")
    sources = user.where("from_predicted is not null").select(*keys, F.col("from_predicted").alias("mask_id"))
    left = predicted.join(sources, [*keys, "mask_id"], "left_anti")
    near = near_pairs(left.select(*keys, "mask_id", "x", "y"), user.select(*keys, "mask_id", "x", "y"), keys, threshold)
    return left.join(near.select(F.col("a_mask_id").alias("mask_id")).distinct(), "mask_id", "left_anti")


def resolve_instances(annotations: DataFrame, instances: DataFrame, ref: str = "instance_ref") -> DataFrame:
    """``instance_id`` by an index into all instances; an index that isn't there (or is negative) gives NULL."""
    ids = instances.select(F.col("row").alias(ref), "instance_id")
    return annotations.drop("instance_id").join(ids, ref, "left").drop(ref)


#: Owner types of the link tables. Fixed values.
OWNERS = {"instances": 0, "centroids": 1, "bboxes": 2, "masks": 3, "rois": 4}


def link_owners(table: DataFrame, links: DataFrame, kind: str, id_col: str, values: list[str]) -> DataFrame:
    """A kind's table with the values of a link table (owner_type, owner_id, …); of several links the last row counts."""
    own = links.where(F.col("owner_type") == OWNERS[kind])
    last = own.groupBy(F.col("owner_id").alias(id_col)).agg(*(F.max_by(v, "row").alias(v) for v in values))
    return table.drop(*values).join(last, id_col, "left")


def with_identity(links: DataFrame, identities: DataFrame) -> DataFrame:
    """``identity_idx`` resolved to name and colour; ``out_of_range`` tells an index that no identity has."""
    known = identities.select(F.col("ord").alias("identity_idx"), "identity_id", F.col("name").alias("identity_name"), F.col("color").alias("identity_color"))
    out = links.join(known, "identity_idx", "left")
    return out.withColumn("out_of_range", F.col("identity_idx").isNotNull() & (F.col("identity_idx") >= 0) & F.col("identity_id").isNull())


def negative_frames(frames: DataFrame) -> DataFrame:
    return frames.where("is_negative")


def static_rois(rois: DataFrame, static: bool = True) -> DataFrame:
    return rois.where(F.col("is_static") == static)


def predicted_only(table: DataFrame, predicted: bool = True) -> DataFrame:
    return table.where(F.col("is_predicted") == predicted)


def remap(table: DataFrame, videos: DataFrame, tracks: DataFrame) -> DataFrame:
    """video_id and track_id by the maps (video_id, new_video) and (track_id, new_track); those without an entry stay."""
    out = table.join(videos, "video_id", "left").join(tracks, "track_id", "left")
    return out.withColumn("video_id", F.coalesce("new_video", "video_id")).withColumn("track_id", F.coalesce("new_track", "track_id")).select(*table.columns)


def from_centroid(x: Column, y: Column, score: Column | None = None) -> Column:
    """The one-node pose of a centroid; its skeleton has the single node ``centroid``."""
    return F.array(F.struct(x.alias("x"), y.alias("y"), (x.isNotNull() & y.isNotNull()).alias("visible"), F.lit(False).alias("complete"), (F.lit(None) if score is None else score).cast("double").alias("score")))


def confidence_score(points: Column) -> Column:
    """Mean of the positive point scores; NULL if there is none."""
    own = F.filter(F.transform(points, lambda p: p["score"]), lambda s: s > 0)
    return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda a, s: a + s) / F.size(own))


def user_mask(masks: DataFrame) -> DataFrame:
    """Predicted masks as user masks that tell where they come from."""
    return masks.where("is_predicted").withColumn("from_predicted", F.col("mask_id")).withColumn("is_predicted", F.lit(False)).withColumn("score", F.lit(None).cast("double"))


def peak_instances(instances: DataFrame, keys: list[str]) -> DataFrame:
    """The most instances that a frame has, 1 at least: the size of a palette."""
    per = instances.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.greatest(F.coalesce(F.max("n"), F.lit(1)), F.lit(1)).alias("peak"))


def tracks_in_order(instances: DataFrame, order: list[str]) -> DataFrame:
    """(track_id, ord): tracks in the order in which they first appear."""
    first = instances.where("track_id is not null").groupBy("track_id").agg(F.min(F.struct(*order)).alias("__first"))
    return first.select("track_id", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__first")) - 1).cast("bigint").alias("ord"))  # one row a track
