"""The JSON tables of the native format (tracks, suggestions, videos, sessions), read from and written to text rows.

Each row has ``ord`` and ``value``; fixed-width text may end in blanks or zero characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VIDEO = "struct<filename:string,filenames:array<string>,backend:struct<filename:string,filenames:array<string>,dataset:string,format:string,shape:array<int>,fps:double,channel_order:string>,source_video:string>"
_SUGGESTION = "struct<video:string,frame_idx:bigint,frameIdx:bigint,group:string>"
_CAMERA = "struct<name:string,rotation:array<double>,translation:array<double>,matrix:array<array<double>>,distortions:array<double>,size:array<double>>"
_SESSION = f"struct<calibration:map<string,string>,camcorder_to_video_idx_map:map<string,string>,fg_start:bigint,fg_end:bigint,metadata:string>"
#: What stands before a track's name in its row. Fixed value.
SPAWNED_ON = 0


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, "[\\x00\\s]+$", "")


def tracks(rows: DataFrame) -> DataFrame:
    """(track_id, name, ord): a list's second value, an object's name, or the text itself."""
    text = trimmed(F.col("value"))
    listed = F.from_json(text, "array<string>")
    plain = F.when(text.rlike('^".*"$'), F.get(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), 0)).otherwise(text)
    name = F.when(text.startswith("["), F.coalesce(F.get(listed, 1), F.get(listed, 0))).when(text.startswith("{"), F.get_json_object(text, "$.name")).otherwise(plain)
    return rows.select(F.col("ord").alias("track_id"), name.alias("name"), "ord")


def suggestions(rows: DataFrame) -> DataFrame:
    """(video_id, frame_idx, grp, metadata, ord)"""
    text = trimmed(F.col("value"))
    s = rows.select("ord", text.alias("metadata"), F.from_json(text, _SUGGESTION).alias("s"))
    return s.select(F.coalesce(F.col("s.video").try_cast("bigint"), F.lit(0)).alias("video_id"), F.coalesce("s.frame_idx", "s.frameIdx", F.lit(0)).alias("frame_idx"), F.coalesce("s.group", F.lit("default")).alias("grp"), "metadata", "ord")


def videos(rows: DataFrame, labels_path: str = "embedded") -> DataFrame:
    """The videos table, with ``embedded``: a video named ``.`` lies in the labels file itself."""
    v = rows.where(F.col("value").isNotNull() & (trimmed(F.col("value")) != "")).select("ord", F.from_json(trimmed(F.col("value")), _VIDEO).alias("v")).select("ord", "v.*")
    listed = F.coalesce("backend.filenames", "filenames")
    one = F.coalesce("backend.filename", "filename")
    inside = one == "."
    files = F.when(listed.isNotNull(), listed).when(inside, F.array(F.lit(labels_path))).otherwise(F.array(one))
    size = lambda i: F.get(F.col("backend.shape"), i)
    return v.select(
        F.col("ord").cast("bigint").alias("video_id"), files.alias("filenames"), listed.isNotNull().alias("is_sequence"), size(0).cast("bigint").alias("n_frames"), size(1).alias("height"), size(2).alias("width"), size(3).alias("channels"), F.col("backend.fps").alias("fps"),
        F.col("backend.format").alias("backend"), F.col("backend.dataset").alias("dataset"), F.coalesce(inside, F.lit(False)).alias("embedded"), F.col("source_video").alias("source_json"),
    )


def cameras(rows: DataFrame) -> DataFrame:
    """(session_id, camera_id, key, name, rvec, tvec, matrix, distortions, size): cameras of each session by their place in the text."""
    s = rows.select(F.col("ord").alias("session_id"), F.from_json(trimmed(F.col("value")), _SESSION).alias("s"))
    each = s.select("session_id", F.posexplode(F.filter(F.map_entries("s.calibration"), lambda e: e["key"] != "metadata")).alias("camera_id", "e"))
    c = each.select("session_id", F.col("camera_id").cast("bigint"), F.col("e.key").alias("key"), F.from_json("e.value", _CAMERA).alias("c"))
    zero = F.array(*[F.lit(0.0)] * 3)
    size = F.when(F.size("c.size") == 2, F.transform("c.size", lambda v: v.cast("int")))
    return c.select("session_id", "camera_id", "key", F.coalesce("c.name", "key").alias("name"), F.coalesce("c.rotation", zero).alias("rvec"), F.coalesce("c.translation", zero).alias("tvec"), F.col("c.matrix").alias("matrix"), F.col("c.distortions").alias("distortions"), size.alias("size"))


def session_videos(rows: DataFrame) -> DataFrame:
    """(session_id, key, video_id) of each camera that has a video."""
    s = rows.select(F.col("ord").alias("session_id"), F.from_json(trimmed(F.col("value")), _SESSION).alias("s"))
    return s.select("session_id", F.explode("s.camcorder_to_video_idx_map").alias("key", "v")).select("session_id", "key", F.col("v").try_cast("bigint").alias("video_id"))


def session_ranges(rows: DataFrame) -> DataFrame:
    """(session_id, fg_start, fg_end): the frame groups of sessions whose groups are columnar."""
    s = rows.select(F.col("ord").alias("session_id"), F.from_json(trimmed(F.col("value")), _SESSION).alias("s"))
    return s.where("s.fg_start is not null").select("session_id", "s.fg_start", "s.fg_end")


_QUOTED = "array<string>"


def quoted(text: Column) -> Column:
    """A JSON string."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def tracks_json(tracks_: DataFrame) -> DataFrame:
    return tracks_.select("ord", F.concat(F.lit(f"[{SPAWNED_ON},"), quoted(F.col("name")), F.lit("]")).alias("value"))


def suggestions_json(suggestions_: DataFrame) -> DataFrame:
    fields = F.struct(F.col("video_id").cast("string").alias("video"), "frame_idx", F.coalesce("grp", F.lit("default")).alias("group"))
    return suggestions_.select("ord", F.to_json(fields).alias("value"))


def video_signatures(videos_: DataFrame) -> DataFrame:
    """(video_id, signature): file names, shape and whether it is embedded, as text to compare."""
    shape = F.array("n_frames", F.col("height").cast("bigint"), F.col("width").cast("bigint"), F.col("channels").cast("bigint"))
    known = F.when(~F.exists(shape, lambda v: v.isNull()), F.array_join(shape.cast("array<string>"), ","))
    text = F.concat_ws("|", F.to_json("filenames"), F.coalesce(known, F.lit("null")), F.col("embedded").cast("string"))
    return videos_.select("video_id", text.alias("signature"))
