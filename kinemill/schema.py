"""Fixed schemas of the dataset's tables.

A missing coordinate is NULL. Lists that have an order carry ``ord``. Ids are surrogate keys within one dataset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

POINT = "struct<x:double,y:double,visible:boolean,complete:boolean,score:double>"
POINTS = f"array<{POINT}>"
_COMMON = "track_id bigint, tracking_score double, instance_id bigint, category string, name string, source string, score double, identity_id bigint, identity_score double, category_score double"
_OWNED = "frame_id bigint, video_id bigint, ord int, is_predicted boolean"

TABLES: dict[str, str] = {
    "videos": "video_id bigint, filenames array<string>, is_sequence boolean, n_frames bigint, height int, width int, channels int, fps double, backend string, dataset string, crop array<int>, grayscale boolean, source_video_id bigint, original_video_id bigint, metadata string",
    "skeletons": "skeleton_id bigint, name string, nodes array<string>, edges array<struct<src:int,dst:int>>, symmetries array<struct<a:int,b:int>>",
    "tracks": "track_id bigint, name string, track_uid string, ord bigint",
    "identities": "identity_id bigint, name string, color string, metadata string",
    "frames": "frame_id bigint, video_id bigint, frame_idx bigint, is_negative boolean",
    "instances": f"instance_id bigint, frame_id bigint, ord int, is_predicted boolean, skeleton_id bigint, track_id bigint, from_predicted bigint, score double, tracking_score double, identity_id bigint, identity_score double, category string, category_score double, points {POINTS}",
    "centroids": f"centroid_id bigint, {_OWNED}, x double, y double, z double, {_COMMON}",
    "bboxes": f"bbox_id bigint, {_OWNED}, x1 double, y1 double, x2 double, y2 double, angle double, {_COMMON}",
    "masks": f"mask_id bigint, {_OWNED}, rle array<bigint>, height int, width int, scale array<double>, offset array<double>, from_predicted bigint, {_COMMON}",
    "label_images": f"label_image_id bigint, {_OWNED}, height int, width int, data array<int>, scale array<double>, offset array<double>, source string, score double",
    "label_image_objects": "label_image_id bigint, label_id int, track_id bigint, category string, name string, instance_id bigint, score double",
    "rois": f"roi_id bigint, {_OWNED}, is_static boolean, geometry string, {_COMMON}",
    "suggestions": "video_id bigint, frame_idx bigint, grp string, metadata string, ord bigint",
    "cameras": "session_id bigint, camera_id bigint, name string, rvec array<double>, tvec array<double>, matrix array<array<double>>, distortions array<double>, size array<int>",
    "session_videos": "session_id bigint, camera_id bigint, video_id bigint",
    "instance_groups": "session_id bigint, frame_idx bigint, group_id bigint, identity_id bigint, score double, points_3d array<struct<x:double,y:double,z:double,score:double>>",
    "instance_group_members": "group_id bigint, camera_id bigint, frame_id bigint, ord int",
    "embeddings": "owner_type int, owner_id bigint, kind string, vector array<double>",
}


def struct_of(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], struct_of(table))


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order and type; a column that is absent is NULL."""
    from pyspark.sql import functions as F

    return df.select(*((df[f.name] if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct_of(table)))
