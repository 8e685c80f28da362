"""Videos against each other: by files, provenance, poses; whole match reports and diagnostics.

A video row has ``filenames``, ``dataset``, ``crop``, and the ids of its source and original. Existence of files is a
table of paths that exist (``path``); a path that it lacks doesn't exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import points as P
from .matching import InstanceMatcher, instance_matches, skeleton_classes


def clean_files(filenames: Column) -> Column:
    return F.transform(filenames, paths.sanitize)


def same_file(a: Column, b: Column) -> Column:
    """Two video structs name one file: equal lists in order; and equal datasets, if both are known."""
    sequences = a["is_sequence"] == b["is_sequence"]
    agree = a["dataset"].isNull() | b["dataset"].isNull() | (a["dataset"] == b["dataset"])
    return F.coalesce(sequences & (clean_files(a["filenames"]) == clean_files(b["filenames"])) & agree, F.lit(False))


def root_parts(filenames: Column) -> Column:
    """Path parts of a video; of an image list, of its first image."""
    return paths.parts(paths.sanitize(F.get(filenames, F.lit(0))))


def existing(videos: DataFrame, files: DataFrame) -> DataFrame:
    """(video_id, exists): all files of a video are there; an empty list counts as there."""
    each = videos.select("video_id", F.explode_outer(clean_files(F.col("filenames"))).alias("path"))
    known = files.select(paths.sanitize(F.col("path")).alias("path"), F.lit(True).alias("__there")).distinct()
    return each.join(known, "path", "left").groupBy("video_id").agg(F.bool_and(F.col("path").isNull() | F.coalesce("__there", F.lit(False))).alias("exists"))


def roots(videos: DataFrame) -> DataFrame:
    """(video_id, root_id, has_provenance): the original, else the source, else the video; chains go two steps up."""
    up = videos.select("video_id", F.coalesce("original_video_id", "source_video_id").alias("up"))
    above = up.select(F.col("video_id").alias("up"), F.col("up").alias("upper"))
    out = up.join(above, "up", "left")
    return out.select("video_id", F.coalesce("upper", "up", "video_id").alias("root_id"), F.col("up").isNotNull().alias("has_provenance"))


def _rooted(videos: DataFrame, side: str) -> DataFrame:
    files = videos.select(F.col("video_id").alias("root_id"), F.struct("filenames", "is_sequence", "dataset").alias("root"))
    own = videos.select("video_id", "crop").join(roots(videos), "video_id").join(files, "root_id", "left")
    return own.select(*(F.col(c).alias(f"{side}_{c}") for c in ("video_id", "crop", "root_id", "has_provenance", "root")))


def file_relations(incoming: DataFrame, base: DataFrame, pairs: DataFrame, files_in: DataFrame, files_base: DataFrame) -> DataFrame:
    """Of given pairs (in_id, base_id): ``same_file`` (same root file and crop) and ``conflict``.

    A conflict is provenance on both sides with different root files, of which at least one exists.
    """
    a = _rooted(incoming, "a").join(existing(incoming, files_in).select(F.col("video_id").alias("a_root_id"), F.col("exists").alias("a_exists")), "a_root_id", "left")
    b = _rooted(base, "b").join(existing(base, files_base).select(F.col("video_id").alias("b_root_id"), F.col("exists").alias("b_exists")), "b_root_id", "left")
    both = pairs.join(a, pairs["in_id"] == a["a_video_id"]).join(b, pairs["base_id"] == b["b_video_id"])
    one = same_file(F.col("a_root"), F.col("b_root"))
    there = F.coalesce("a_exists", F.lit(False)) | F.coalesce("b_exists", F.lit(False))
    return both.select("in_id", "base_id", (one & F.col("a_crop").eqNullSafe(F.col("b_crop"))).alias("same_file"), (F.col("a_has_provenance") & F.col("b_has_provenance") & ~one & there).alias("conflict"))


def compared_instances(instances: DataFrame, predictions: str | bool = "auto") -> DataFrame:
    """Instances that take part in a comparison by poses: ``auto`` takes predictions only of videos without user instances."""
    if predictions != "auto":
        return instances if predictions else instances.where("not is_predicted")
    users = instances.groupBy("video_id").agg(F.bool_or(~F.col("is_predicted")).alias("__user"))
    return instances.join(users, "video_id").where(~F.col("is_predicted") | ~F.col("__user")).drop("__user")


def pose_matches(incoming: DataFrame, base: DataFrame, pairs: DataFrame, frames: int = 3, predictions: str | bool = "auto") -> DataFrame:
    """Of given pairs (in_id, base_id): n_common, n_sampled, n_equal frames, and whether the poses tell that they match.

    Frames that both have are sampled evenly, 2 * ``frames`` at most; ``frames`` of them, or all common ones if fewer,
    must hold an identical pose. Poses meet by their hash, frames by index; no pair of instances is formed otherwise.
    """
    rows = lambda d, side: compared_instances(d, predictions).select(F.col("video_id").alias(f"{side}_id"), "frame_idx", P.pose_key("points").alias("pose"))
    a, b = rows(incoming, "in"), rows(base, "base")
    common = pairs.join(a.select("in_id", "frame_idx").distinct(), "in_id").join(b.select("base_id", "frame_idx").distinct(), ["base_id", "frame_idx"])
    w = Window.partitionBy("in_id", "base_id")
    k = 2 * frames
    at = common.withColumn("__r", F.row_number().over(w.orderBy("frame_idx")) - 1).withColumn("__n", F.count("*").over(w))
    first = F.ceil(F.col("__r") * k / F.col("__n"))
    sampled = at.where((F.col("__n") <= k) | ((first < k) & (F.floor(first * F.col("__n") / k) == F.col("__r"))))
    equal = sampled.join(a.where("pose is not null").distinct(), ["in_id", "frame_idx"]).join(b.where("pose is not null").distinct(), ["base_id", "frame_idx", "pose"]).select("in_id", "base_id", "frame_idx").distinct()
    per = sampled.groupBy("in_id", "base_id").agg(F.max("__n").alias("n_common"), F.count("*").alias("n_sampled"))
    hits = equal.groupBy("in_id", "base_id").agg(F.count("*").alias("n_equal"))
    out = pairs.join(per, ["in_id", "base_id"], "left").join(hits, ["in_id", "base_id"], "left").fillna(0, ["n_common", "n_sampled", "n_equal"])
    return out.withColumn("is_match", (F.col("n_common") > 0) & (F.col("n_equal") >= F.least(F.lit(frames), F.col("n_common"))))


def has_user_instances(videos: DataFrame, instances: DataFrame) -> DataFrame:
    per = instances.groupBy("video_id").agg(F.bool_or(~F.col("is_predicted")).alias("has_user"))
    return videos.select("video_id").join(per, "video_id", "left").select("video_id", F.coalesce("has_user", F.lit(False)).alias("has_user"))


def match_report(tracks: tuple[DataFrame, DataFrame], skeletons: tuple[DataFrame, DataFrame], videos: DataFrame, track_method: str = "identity", skeleton_method: str = "structure") -> DataFrame:
    """A dry run of a merge: (kind, other_id, self_id) of every video, track and skeleton of ``other``; self_id is NULL if none matches.

    The first match wins. ``videos`` is what video_map() gives; each pair of tables is (base, other).
    """
    name = "name" if track_method == "name" else "track_uid"
    first = tracks[0].where(F.col(name).isNotNull()).groupBy(name).agg(F.min("track_id").alias("self_id"))
    by_track = tracks[1].join(first, name, "left").select(F.lit("track").alias("kind"), F.col("track_id").alias("other_id"), "self_id")
    (_, mine), (theirs, _) = (skeleton_classes(s, skeleton_method) for s in skeletons)
    by_skeleton = theirs.drop("class_id").join(mine.select("key", F.col("class_id").alias("self_id")), "key", "left").select(F.lit("skeleton").alias("kind"), F.col("skeleton_id").alias("other_id"), "self_id")
    by_video = videos.select(F.lit("video").alias("kind"), F.col("video_id").alias("other_id"), F.col("base_id").alias("self_id"))
    return by_video.unionByName(by_track).unionByName(by_skeleton)


def report_counts(report: DataFrame) -> DataFrame:
    """n, n_matched and n_unmatched of each kind."""
    return report.groupBy("kind").agg(F.count("*").alias("n"), F.count("self_id").alias("n_matched"), F.count_if(F.col("self_id").isNull()).alias("n_unmatched"))


def diverging_tracks(base: DataFrame, other: DataFrame, name_pairs: DataFrame, keys: list[str], matcher: InstanceMatcher) -> DataFrame:
    """Tracks that a merge by name puts together though they never match: (self_track, other_track, n_shared).

    ``name_pairs`` has (self_track, other_track). A pair is told if both have instances in a frame, and no instance of the
    one matches the other's in any such frame.
    """
    if matcher.method == "identity":
        raise ValueError("a match by identity tells nothing of places")
    mine = base.join(name_pairs.select(F.col("self_track").alias("track_id"), "self_track", "other_track"), "track_id")
    theirs = other.join(name_pairs.select(F.col("other_track").alias("track_id"), "self_track", "other_track"), "track_id")
    on = [*keys, "self_track", "other_track"]
    shared = mine.select(*on).distinct().join(theirs.select(*on).distinct(), on).groupBy("self_track", "other_track").agg(F.count("*").alias("n_shared"))
    cols = [*on, "instance_id", "ord", "track_id", "is_predicted", "tracking_score", "points"]
    matched = instance_matches(mine.select(*cols), theirs.select(*cols), on, matcher).select("self_track", "other_track").distinct()
    return shared.join(matched, ["self_track", "other_track"], "left_anti")


def common_frame_numbers(a: Column, b: Column) -> Column:
    """Embedded frame numbers that both have; an empty or unknown list has none."""
    return F.array_sort(F.array_intersect(F.coalesce(a, F.array().cast("array<bigint>")), F.coalesce(b, F.array().cast("array<bigint>"))))


def embedded_frames(declared: Column, frame_map: Column) -> Column:
    """Frame numbers of an embedded video: the declared ones, else the keys of its frame map; NULL if there are none."""
    own = F.coalesce(declared, F.array_sort(F.map_keys(frame_map)))
    return F.when(F.size(own) > 0, own)
