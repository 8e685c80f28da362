"""Dataset maintenance: registration, dedup, cleaning, removal and replacement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import skeletons as S
from . import select


def dedup_skeletons(skeletons: DataFrame) -> DataFrame:
    """(skeleton_id, canonical_id): the first of the skeletons with the same nodes in order, edges and symmetries."""
    key = S.structure_key(F.col("nodes"), F.col("edges"), F.col("symmetries"), ordered=True)
    return skeletons.withColumn("__k", key).withColumn("canonical_id", F.min("skeleton_id").over(Window.partitionBy("__k"))).select("skeleton_id", "canonical_id")


def register(dimension: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """The dimension, and the rows of ``used`` that it lacks."""
    return dimension.unionByName(used.dropDuplicates([key]).join(dimension, key, "left_anti"), allowMissingColumns=True)


def clean_frames(frames: DataFrame, kinds: list[DataFrame], empty_instances: bool = False) -> DataFrame:
    """Frames that are negative or hold anything; with ``empty_instances``, poses without a visible point don't count."""
    parts = [(select.nonempty(k) if empty_instances and "points" in k.columns else k).select("frame_id") for k in kinds]
    held = reduce(DataFrame.unionByName, parts).distinct().withColumn("__held", F.lit(True))
    return frames.join(held, "frame_id", "left").where(F.col("is_negative") | F.col("__held").isNotNull()).drop("__held")


def used(dimension: DataFrame, id_col: str, tables: list[DataFrame]) -> DataFrame:
    """Rows of a dimension that any of the tables refers to."""
    refs = reduce(DataFrame.unionByName, [t.select(id_col) for t in tables])
    return dimension.join(refs, id_col, "left_semi")


def remove_videos(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables with a video_id without the videos ``gone``; rows without a video stay. Frames' rows follow them."""
    out = dict(tables)
    for name, t in tables.items():
        if "video_id" in t.columns:
            out[name] = t.join(gone.select("video_id"), "video_id", "left_anti")
    for name, t in tables.items():
        if "frame_id" in t.columns and "video_id" not in t.columns:
            out[name] = t.join(out["frames"].select("frame_id"), "frame_id", "left_semi")
    return out


def replace_videos(table: DataFrame, new_ids: DataFrame) -> DataFrame:
    """table with video ids by the map (video_id, new_id); others stay."""
    return table.join(new_ids, "video_id", "left").withColumn("video_id", F.coalesce("new_id", "video_id")).drop("new_id")


def relink(instances: DataFrame, ids: DataFrame) -> DataFrame:
    """instances copied to the ids of the map (old_id, new_id), with from_predicted led to the copies."""
    own = instances.join(ids.select(F.col("old_id").alias("instance_id"), F.col("new_id").alias("__own")), "instance_id")
    led = own.join(ids.select(F.col("old_id").alias("from_predicted"), F.col("new_id").alias("__from")), "from_predicted", "left")
    return led.withColumn("instance_id", F.col("__own")).withColumn("from_predicted", F.col("__from")).drop("__own", "__from")


def resolve_from_predicted(instances: DataFrame, within_frame: bool = False) -> DataFrame:
    """instances whose from_predicted is NULL unless it is a prediction (of the same frame, if ``within_frame``)."""
    target = instances.select(F.col("instance_id").alias("from_predicted"), F.col("is_predicted").alias("__p"), F.col("frame_id").alias("__f"))
    ok = F.col("__p") & ((F.col("__f") == F.col("frame_id")) if within_frame else F.lit(True))
    return instances.join(target, "from_predicted", "left").withColumn("from_predicted", F.when(ok, F.col("from_predicted"))).drop("__p", "__f").select(*instances.columns)


def append_new(base: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """base, and the rows of ``more`` whose keys it lacks."""
    return base.unionByName(more.join(base, keys, "left_anti"))


def overlay(base: DataFrame, explicit: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, those of ``explicit`` in place of base's with the same keys."""
    return explicit.unionByName(base.join(explicit, keys, "left_anti"))


def merge_image_lists(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, filenames): a's image lists, each with the images of b's list whose basename it lacks."""
    base = lambda c: F.transform(c, lambda p: F.element_at(F.split(p, r"[/\\]"), -1))
    both = a.select("id", F.col("filenames").alias("fa")).join(b.select("id", F.col("filenames").alias("fb")), "id", "left")
    new = F.filter(F.coalesce("fb", F.array().cast("array<string>")), lambda p: ~F.array_contains(base(F.col("fa")), F.element_at(F.split(p, r"[/\\]"), -1)))
    return both.select("id", F.concat("fa", new).alias("filenames"))
