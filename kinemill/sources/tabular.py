"""Text formats that Spark reads line by line: YOLO labels, tracking spots, keypoint CSV, GeoJSON, COCO."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formats as T

# ---- YOLO ------------------------------------------------------------------------------------------------


def yolo_lines(lines: DataFrame, width: Column, height: Column, n_keypoints: int, names: dict[int, str] | None = None) -> DataFrame:
    """Annotations of label lines (``value``): kind, class_id, category, box, polygon, points, score, is_predicted.

    Comments and lines that can't be read are left out. Names of classes default to "".
    """
    text = F.trim("value", F.lit(" \t\r\n"))
    # split and read once: a generator's output is never merged into the many expressions that use it
    rows = lines.withColumn("__text", F.explode(F.array(text))).where(~F.col("__text").startswith("#") & (F.col("__text") != ""))
    rows = rows.withColumn("t", F.explode(F.array(F.split("__text", r"\s+"))))
    t, n = F.col("t"), F.size("t")
    # nearly all lines are boxes: one pattern for the whole line, then plain casts; the others number by number
    few = F.array(*[F.get(t, F.lit(i)).try_cast("double") for i in range(1, 6)])
    rows = rows.withColumn("__v", F.explode(F.array(F.when(n <= 6, few).otherwise(F.transform(F.slice(t, F.lit(2), n), T.strict_float)))))
    v, kind, class_id = F.col("__v"), T.yolo_kind(t), t[0].try_cast("bigint")
    whole = F.when(n <= 6, F.col("__text").rlike(T.BOX_LINE)).otherwise(~F.exists(v, lambda x: x.isNull()) & ((kind != "pose") | (n == 5 + 3 * n_keypoints)))
    names_map = F.create_map(*[F.lit(x) for k, v in (names or {-1: ""}).items() for x in (k, v)])
    corner = lambda i: F.array(F.get(v, 2 * i) * width, F.get(v, 1 + 2 * i) * height)
    polygon = F.transform(F.sequence(F.lit(0), ((n - 3) / 2).cast("int")), corner)
    points = T.yolo_points(t, v, width, height)
    return rows.where(whole & class_id.isNotNull() & kind.isNotNull()).select(
        *[c for c in lines.columns if c != "value"], kind.alias("kind"), class_id.alias("class_id"), F.coalesce(F.try_element_at(names_map, class_id.try_cast("int")), F.lit("")).alias("category"),
        F.when(n <= 6, T.yolo_box(v, width, height)).alias("box"), F.when(kind == "segmentation", polygon).alias("polygon"), F.when(kind == "pose", points).alias("points"),
        F.when(n == 6, F.get(v, F.lit(4))).alias("score"), (n == 6).alias("is_predicted"),
    )


def read_yolo(spark: SparkSession, root: str, width: int, height: int, n_keypoints: int, names: dict[int, str] | None = None) -> DataFrame:
    """All label files under ``root`` with their split (the folder above ``labels``) and image name."""
    lines = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").text(root).withColumn("path", F.input_file_name())
    parts = F.split("path", "/")
    lines = lines.withColumn("split", F.element_at(parts, -3)).withColumn("image", F.regexp_replace(F.element_at(parts, -1), r"\.txt$", ""))
    return yolo_lines(lines, F.lit(width), F.lit(height), n_keypoints, names)


def write_yolo(lines: DataFrame, path: str, names: dict[int, str] | None = None) -> int:
    """``lines`` (split, image, line) as ``split/labels/image.txt`` under ``path``, a folder that driver and executors mount; the number of files.

    A task writes whole files under other names and renames them, so one that runs again leaves the same files.
    """
    import os
    import uuid

    import pyarrow as pa

    per = lines.groupBy("split", "image").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"))

    def run(batches):
        for batch in batches:
            for split, image, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folder = os.path.join(path, split, "labels")
                os.makedirs(folder, exist_ok=True)
                new = os.path.join(folder, f".{uuid.uuid4().hex}")
                with open(new, "w", encoding="utf-8") as f:
                    f.write(text + "\n" if text else "")
                os.replace(new, os.path.join(folder, f"{image}.txt"))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    n = per.select("split", "image", "text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
    if names is not None:
        with open(os.path.join(path, "data.yaml"), "w", encoding="utf-8") as f:
            f.write(data_yaml([r["split"] for r in lines.select("split").distinct().orderBy("split").collect()], names))
    return n


def data_yaml(splits: list[str], names: dict[int, str], skeleton: tuple[list[str], list[tuple[int, int]]] | None = None, task: str = "pose") -> str:
    """The dataset's description: class names, splits, and for poses the keypoints and edges of a skeleton."""
    out = ["path: .", "names:", *(f"  {k}: {quoted_yaml(v)}" for k, v in sorted(names.items()))]
    if task != "pose":
        out.append(f"task: {task}")
    elif skeleton is not None:
        nodes, edges = skeleton
        out += [f"kpt_shape: [{len(nodes)}, 3]", f"flip_idx: [{', '.join(map(str, range(len(nodes))))}]", f"skeleton: [{', '.join(f'[{a}, {b}]' for a, b in edges)}]", f"node_names: [{', '.join(map(quoted_yaml, nodes))}]"]
    return "\n".join([*out, *(f"{s}: {s}/images" for s in splits)]) + "\n"


def quoted_yaml(text: str) -> str:
    import json

    return json.dumps(text, ensure_ascii=False)


# ---- Tracking spots --------------------------------------------------------------------------------------

_SPOT_HEAD = 4


def is_spots(header: str) -> bool:
    return header.startswith("LABEL,ID,TRACK_ID")


def _after_header(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV rows after four header lines; the lines are told by their place within the file."""
    names = [c.split()[0] for c in schema.split(", ")]
    raw = spark.read.csv(path, schema=", ".join(f"{n} string" for n in names))
    # the header lines hold names, not numbers, in the second column
    return raw.where(F.col(names[1]).try_cast("double").isNotNull() | (F.col(names[1]) == "")).select(*(F.col(n).try_cast(c.split()[1]).alias(n) for n, c in zip(names, schema.split(", "), strict=True)))


# Columns of the formats.
SPOTS = "label string, id bigint, track_id bigint, quality double, x double, y double, z double, t double, frame bigint, radius double, visibility int"
EDGES = "label string, track_id bigint, source_id bigint, target_id bigint, link_cost double, speed double, displacement double"


def read_spots(spark: SparkSession, path: str, edges: str | None = None) -> DataFrame:
    """Centroids of a spots table: z = 0 is unknown; the tracking score is the cost of the link into the spot."""
    spots = _after_header(spark, path, SPOTS)
    out = spots.select(F.col("label").alias("name"), F.col("id").alias("spot_id"), "track_id", F.col("quality").alias("score"), "x", "y", F.when(F.col("z") != 0, F.col("z")).alias("z"), F.col("frame").alias("frame_idx"))
    if edges is None:
        return out.withColumn("tracking_score", F.lit(None).cast("double"))
    links = _after_header(spark, edges, EDGES).withColumn("__at", F.monotonically_increasing_id())
    last = links.groupBy(F.col("target_id").alias("spot_id")).agg(F.max_by("link_cost", "__at").alias("tracking_score"))
    return out.join(last, "spot_id", "left")


# ---- Keypoint CSV with several header rows ---------------------------------------------------------------


def read_keypoint_csv(spark: SparkSession, path: str) -> DataFrame:
    """Long points (path, image, individual, node, x, y) of CSVs with 3 or 4 header rows and 1 or 3 index columns.

    Each file's header is joined to its rows by file and column. An image without any point has one row of NULLs.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("path"))
    cells = lines.where(F.trim("value") != "").select("path", F.split("value", ",", -1).alias("c"))
    heads = ["scorer", "individuals", "bodyparts", "coords"]
    head = cells.where(F.col("c")[0].isin(heads)).select("path", F.col("c")[0].alias("row"), F.posexplode("c").alias("i", "v"))
    columns = head.groupBy("path", "i").pivot("row", heads).agg(F.first("v")).where(F.col("coords").isin("x", "y"))
    first = columns.groupBy("path").agg(F.min("i").alias("__first"))
    rows = cells.where(~F.col("c")[0].isin(heads)).join(first, "path")
    image = F.array_join(F.slice("c", 1, F.col("__first")), "/")
    long = rows.select("path", image.alias("image"), F.posexplode("c").alias("i", "v")).join(columns, ["path", "i"])
    value = F.col("v").try_cast("double")
    return long.groupBy("path", "image", F.col("individuals").alias("individual"), F.col("bodyparts").alias("node")).agg(F.max(F.when(F.col("coords") == "x", value)).alias("x"), F.max(F.when(F.col("coords") == "y", value)).alias("y"))


def keypoint_frames(points: DataFrame) -> DataFrame:
    """(path, image, frame_idx): images of a file in the order of their trailing number, then name."""
    w = Window.partitionBy("path").orderBy(T.trailing_number(F.col("image")), "image")
    return points.select("path", "image").distinct().withColumn("frame_idx", (F.row_number().over(w) - 1).cast("bigint"))


# ---- GeoJSON ---------------------------------------------------------------------------------------------

_FEATURE = "struct<type:string,geometry:string,properties:map<string,string>>"


def read_geojson(texts: DataFrame, column: str = "value") -> DataFrame:
    """One row a feature: geom_type, geometry (JSON) and properties, of a FeatureCollection or a single Feature."""
    parsed = F.from_json(column, f"struct<type:string,features:array<{_FEATURE}>,geometry:string,properties:map<string,string>>")
    single = F.array(F.struct(F.col("p.type").alias("type"), F.col("p.geometry").alias("geometry"), F.col("p.properties").alias("properties")))
    rows = texts.withColumn("p", parsed).withColumn("f", F.explode(F.when(F.col("p.type") == "FeatureCollection", F.col("p.features")).otherwise(single)))
    return rows.select(*[c for c in texts.columns if c != column], F.get_json_object("f.geometry", "$.type").alias("geom_type"), F.col("f.geometry").alias("geometry"), F.col("f.properties").alias("properties"))


def to_geojson(rois: DataFrame, properties: list[str]) -> DataFrame:
    """rois with ``feature``: their geometry and the given columns as a GeoJSON Feature."""
    props = F.to_json(F.struct(*properties))
    return rois.withColumn("feature", F.concat(F.lit('{"type":"Feature","geometry":'), F.col("geometry"), F.lit(',"properties":'), props, F.lit("}")))


# ---- COCO ------------------------------------------------------------------------------------------------

COCO = """images array<struct<id:bigint,width:int,height:int,file_name:string>>,
annotations array<struct<id:bigint,image_id:bigint,category_id:int,area:double,bbox:array<double>,iscrowd:int,keypoints:array<double>,num_keypoints:int,score:double,segmentation:string,track_id:bigint,object_id:bigint>>,
categories array<struct<id:int,name:string,keypoints:array<string>,skeleton:array<array<int>>>>"""


def read_coco(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """skeletons, videos (one a size), frames, instances and bboxes of COCO files (one JSON document each)."""
    doc = spark.read.schema(COCO).option("multiLine", "true").json(path).withColumn("path", F.input_file_name())
    return coco_tables(doc)


def coco_tables(doc: DataFrame) -> dict[str, DataFrame]:
    images = doc.select("path", F.posexplode("images").alias("pos", "i")).select("path", "pos", "i.*")
    w = Window.partitionBy("path", "height", "width").orderBy("pos")
    images = images.withColumn("frame_idx", (F.row_number().over(w) - 1).cast("bigint"))
    size = Window.partitionBy("path").orderBy("__first")
    videos = images.groupBy("path", "height", "width").agg(F.min("pos").alias("__first"), F.count("*").alias("n_frames")).withColumn("video_id", (F.row_number().over(size) - 1).cast("bigint")).drop("__first")
    frames = images.join(videos.drop("n_frames"), ["path", "height", "width"]).select("path", F.col("id").alias("frame_id"), "video_id", "frame_idx", "file_name")
    cats = doc.select("path", F.explode("categories").alias("c")).select("path", F.col("c.id").alias("category_id"), F.col("c.name").alias("category"), F.col("c.keypoints").alias("nodes"), T.coco_edges(F.col("c.skeleton"), F.size("c.keypoints")).alias("edges"))
    notes = doc.select("path", F.explode("annotations").alias("a")).select("path", "a.*").join(cats, ["path", "category_id"]).withColumnRenamed("image_id", "frame_id")
    posed = F.size(F.coalesce("keypoints", F.array().cast("array<double>"))) > 0
    common = ["path", "id", "frame_id", "category", "score", F.col("score").isNotNull().alias("is_predicted"), F.coalesce("track_id", "object_id").alias("track_id")]
    instances = notes.where(posed).select(*common, T.coco_points(F.col("keypoints")).alias("points"))
    box = F.col("bbox")
    boxes = notes.where(~posed & (F.size("bbox") == 4)).select(*common, box[0].alias("x1"), box[1].alias("y1"), (box[0] + box[2]).alias("x2"), (box[1] + box[3]).alias("y2"))
    return {"skeletons": cats, "videos": videos, "frames": frames, "instances": instances, "bboxes": boxes}


# ---- Nested dictionaries ---------------------------------------------------------------------------------


def to_dicts(frames: DataFrame, instances: DataFrame) -> DataFrame:
    """(frame_id, json): a frame with its instances, in order, as one JSON object."""
    own = instances.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("ord", "instance_id", "is_predicted", "track_id", "score", "points"))).alias("instances"))
    both = frames.join(own, "frame_id", "left")
    return both.select("frame_id", F.to_json(F.struct("video_id", "frame_idx", "is_negative", F.coalesce("instances", F.array().cast(own.schema["instances"].dataType)).alias("instances"))).alias("json"))


DICT = "struct<video_id:bigint,frame_idx:bigint,is_negative:boolean,instances:array<struct<ord:int,instance_id:bigint,is_predicted:boolean,track_id:bigint,score:double,points:array<struct<x:double,y:double,visible:boolean,complete:boolean,score:double>>>>>"


def from_dicts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """frames and instances of to_dicts(); a text that isn't such an object is an error."""
    parsed = rows.select("frame_id", F.from_json("json", DICT, {"mode": "FAILFAST"}).alias("d"))
    frames = parsed.select("frame_id", "d.video_id", "d.frame_idx", "d.is_negative")
    return frames, parsed.select("frame_id", F.explode("d.instances").alias("i")).select("frame_id", "i.*")


def from_tensor(cells: DataFrame, nodes: int) -> DataFrame:
    """Instances of dense cells (frame_idx, track_id, node_idx, x, y); a track without any known point is left out."""
    known = cells.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    point = lambda k: F.max(F.when(F.col("node_idx") == k, F.struct("x", "y")))
    nothing = F.lit(None).cast("double")
    made = [F.struct(point(k)["x"].alias("x"), point(k)["y"].alias("y"), point(k).isNotNull().alias("visible"), F.lit(False).alias("complete"), nothing.alias("score")) for k in range(nodes)]
    return known.groupBy("frame_idx", "track_id").agg(F.array(*made).alias("points"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
