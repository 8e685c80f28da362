"""Label images as tables of pixels and objects: masks of them, images of masks, and numbers for the labels.

``pixels`` are rows (label_image_id, pos, label) of the foreground; ``objects`` are rows (label_image_id, label_id, …).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pixels_of(images: DataFrame) -> DataFrame:
    """Foreground pixels of images that hold their labels in ``data``."""
    spread = images.select("label_image_id", F.posexplode("data").alias("pos", "label"))
    return spread.where("label > 0")


def runs_of(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Runs (start, length) of consecutive positions of each key, by the difference of position and rank."""
    w = Window.partitionBy(*keys).orderBy("pos")
    island = pixels.withColumn("__g", F.col("pos") - F.row_number().over(w))
    return island.groupBy(*keys, "__g").agg(F.min("pos").cast("bigint").alias("start"), F.count("*").alias("length")).drop("__g")


def to_masks(images: DataFrame, objects: DataFrame) -> DataFrame:
    """A mask for each label of each image: its run lengths, and what the objects table knows of it.

    Run lengths begin with background and end with it unless the last pixel is foreground.
    """
    runs = runs_of(pixels_of(images), ["label_image_id", "label"])
    own = runs.groupBy("label_image_id", F.col("label").alias("label_id")).agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("r"))
    size = images.select("label_image_id", "height", "width", "scale", "offset", "is_predicted", F.col("score").alias("image_score"))
    out = own.join(size, "label_image_id").join(objects, ["label_image_id", "label_id"], "left")
    end = lambda i: F.get(F.col("r"), i)["start"] + F.get(F.col("r"), i)["length"]
    gaps = F.transform("r", lambda x, i: F.array(x["start"] - F.when(i > 0, end(i - 1)).otherwise(0), x["length"]))
    rest = F.col("height") * F.col("width") - end(F.size("r") - 1)
    rle = F.concat(F.flatten(gaps), F.when(rest > 0, F.array(rest.cast("bigint"))).otherwise(F.array().cast("array<bigint>")))
    return out.withColumn("rle", rle).withColumn("score", F.when(F.col("is_predicted"), F.coalesce("score", "image_score"))).drop("r", "image_score")


def from_masks(masks: DataFrame, group: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pixels, objects, images) of the masks of each ``group``, numbered from 1 in their order; later masks lie on top.

    Masks of a group must agree in shape, scale and offset; a group of which they don't raises an error.
    """
    w = Window.partitionBy(group).orderBy("ord")
    numbered = masks.withColumn("label_id", F.row_number().over(w))
    same = F.countDistinct("height", "width", F.to_json(F.struct("scale", "offset")))
    images = numbered.groupBy(group).agg(F.first("height").alias("height"), F.first("width").alias("width"), F.first("scale").alias("scale"), F.first("offset").alias("offset"), same.alias("__n"))
    wrong = F.raise_error(F.concat(F.lit("masks of "), F.col(group).cast("string"), F.lit(" differ in shape, scale or offset"))).cast("int")
    images = images.withColumn("height", F.when(F.col("__n") > 1, wrong).otherwise(F.col("height"))).drop("__n")
    ends = F.transform("rle", lambda n, i: F.aggregate(F.slice("rle", 1, i + 1), F.lit(0).cast("bigint"), lambda s, v: s + v))
    spans = F.filter(F.zip_with("rle", ends, lambda n, e: F.struct((e - n).alias("start"), e.alias("end"))), lambda r, i: (i % 2 == 1) & (r["end"] > r["start"]))
    each = numbered.select(group, "label_id", F.explode(spans).alias("r")).select(group, "label_id", F.explode(F.sequence(F.col("r.start"), F.col("r.end") - 1)).alias("pos"))
    pixels = each.groupBy(group, "pos").agg(F.max("label_id").alias("label"))
    return pixels, numbered.drop("rle", "height", "width", "scale", "offset"), images


def page_ids(stack: DataFrame, group: str, image: str) -> DataFrame:
    """(group, page, label_id, is_single): pages of a stack of which each has one positive label, all of them different."""
    per = stack.groupBy(group, image).agg(F.min("label").alias("label_id"), F.countDistinct("label").alias("n"))
    whole = per.groupBy(group).agg((F.max("n") == 1).alias("one"), (F.countDistinct("label_id") == F.count("*")).alias("unique"))
    return per.join(whole, group).select(group, image, "label_id", (F.col("one") & F.col("unique")).alias("is_single"))


def image_summary(objects: DataFrame) -> DataFrame:
    """n_objects, categories and tracks of each image."""
    return objects.groupBy("label_image_id").agg(F.count("*").alias("n_objects"), F.array_sort(F.collect_set("category")).alias("categories"), F.array_sort(F.collect_set("track_id")).alias("tracks"))


def normalize(objects: DataFrame, by: str = "track") -> DataFrame:
    """objects with ``new_id``: numbers from 1 in the order in which tracks (or categories) first appear by (image ``ord``, label_id).

    By track, each object without one gets a number of its own after all tracks, in the same order. By category, no
    category counts as "" and ``kept`` tells the object whose metadata stays: the first of its number in the image.
    """
    key = F.col("track_id") if by == "track" else F.coalesce("category", F.lit(""))
    order = F.struct("ord", "label_id")
    rows = objects.withColumn("__k", key)
    named = rows.where("__k is not null").groupBy("__k").agg(F.min(order).alias("__o"))
    ids = named.select("__k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__o")).cast("bigint").alias("__id"))  # one row a distinct name
    out = rows.join(ids, "__k", "left")
    if by != "track":
        first = F.row_number().over(Window.partitionBy("label_image_id", "__id").orderBy("label_id"))
        return out.withColumn("new_id", F.col("__id")).withColumn("kept", first == 1).drop("__k", "__id")
    from .windows import global_rank

    lone = rows.where("__k is null").withColumn("__at", F.col("ord") * 1.0)
    n = named.count()
    numbered = global_rank(lone, "__at", ["label_id"], "__r").select("label_image_id", "label_id", (F.col("__r") + n + 1).alias("__lone"))
    out = out.join(numbered, ["label_image_id", "label_id"], "left")
    return out.withColumn("new_id", F.coalesce("__id", "__lone")).withColumn("kept", F.lit(True)).drop("__k", "__id", "__lone")


def relabel(pixels: DataFrame, numbered: DataFrame) -> DataFrame:
    """Pixels with their new labels; those whose label no object has become background and go."""
    ids = numbered.select("label_image_id", F.col("label_id").alias("label"), "new_id")
    return pixels.join(ids, ["label_image_id", "label"]).select("label_image_id", "pos", F.col("new_id").alias("label"))


def resample(pos: Column, width: Column, new_width: Column, height: Column, new_height: Column) -> Column:
    """Where in the old image the pixel ``pos`` of the new one is taken from (nearest neighbour)."""
    return (F.floor(F.floor(pos / new_width) * height / new_height) * width + F.floor(F.pmod(pos, new_width) * width / new_width)).cast("bigint")
