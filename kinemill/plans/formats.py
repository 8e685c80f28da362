"""Queries of annotation formats: text is made from the driver's tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats as T
from ..operators import aggregates
from ..sources import tabular
from . import pose_view as V
from .poses import big, r6
from .registry import query


def _box_line():
    return T.yolo_detection_line(F.col("ord"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(640), F.lit(480), F.when(F.col("is_predicted"), 0.5))


@query(f"WITH {V.BOXES}, n AS (SELECT bbox_id, ord, is_predicted, i, unnest([1, 2, 3, 4]) AS k, unnest([(x1 + x2) / 2 / 640, (y1 + y2) / 2 / 480, (x2 - x1) / 640, (y2 - y1) / 480]) AS v FROM (SELECT *, row_number() OVER () AS i FROM bx)) SELECT bbox_id, ord || ' ' || string_agg(printf('%.6f', CAST(round(CAST(v AS DECIMAL(18, 12)), 6) AS DOUBLE)), ' ' ORDER BY k) || CASE WHEN is_predicted THEN ' 0.500000' ELSE '' END AS line FROM n GROUP BY bbox_id, ord, is_predicted, i")
def f23_yolo_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.boxes(spark, sf_dir).select("bbox_id", _box_line().alias("line"))


@query(f"WITH {V.BOXES} SELECT bbox_id, CASE WHEN is_predicted THEN 'detection_conf' ELSE 'detection' END AS kind, ord AS class_id, CASE WHEN ord = 1 THEN 'mouse' ELSE '' END AS category, round(x1, 2) AS x1, round(y2, 2) AS y2, CASE WHEN is_predicted THEN 0.5 END AS score FROM bx")
def s36_yolo_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = V.boxes(spark, sf_dir).select("bbox_id", _box_line().alias("value"))
    bad = lines.limit(0).unionByName(spark.createDataFrame([(-1, "# comment"), (-2, "0 0.5 x 0.1 0.1"), (-3, "1 2"), (-4, "")], "bbox_id long, value string"))
    out = tabular.yolo_lines(lines.unionByName(bad), F.lit(640), F.lit(480), 5, {1: "mouse"})
    return out.select("bbox_id", "kind", "class_id", "category", F.round("box.x1", 2).alias("x1"), F.round("box.y2", 2).alias("y2"), "score")


@query(f"""WITH {V.sql()}, b AS (SELECT frame_idx, user_id, greatest(0, min_x - 10) AS a, greatest(0, min_y - 10) AS b, least(1000.0, max_x + 10) AS c, least(1000.0, max_y + 10) AS d FROM inst WHERE n_vis > 0), n AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS node)
SELECT b.frame_idx, b.user_id, printf('0 %.6f %.6f %.6f %.6f ', (a + c) / 2 / 1000, (b + d) / 2 / 1000, (c - a) / 1000, (d - b) / 1000) || string_agg(CASE WHEN vis THEN printf('%.6f %.6f 2', x / 1000, y / 1000) ELSE '0.000000 0.000000 0' END, ' ' ORDER BY n.node) AS line FROM b CROSS JOIN n LEFT JOIN pts ON pts.frame_idx = b.frame_idx AND pts.user_id = b.user_id AND pts.node = n.node GROUP BY b.frame_idx, b.user_id, a, b, c, d""")
def s37_yolo_pose_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.instances(spark, sf_dir).select("frame_idx", F.col("track_id").alias("user_id"), T.yolo_pose_line(F.lit(0), F.col("points"), F.lit(1000), F.lit(1000)).alias("line"))
    return out.where("line is not null")


@query("SELECT p_brand AS name, row_number() OVER (ORDER BY p_brand) - 1 AS class_id FROM (SELECT DISTINCT p_brand FROM part)")
def a16_class_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.class_ids(V.table(spark, sf_dir, "part"), "p_brand")


_COCO_SQL = """img AS (SELECT p_partkey, p_partkey % 7 AS doc, p_size % 3 AS sz, row_number() OVER (PARTITION BY p_partkey % 7 ORDER BY p_partkey) - 1 AS pos FROM part)"""


@query(f"WITH {_COCO_SQL}, v AS (SELECT doc, sz, row_number() OVER (PARTITION BY doc ORDER BY min(pos)) - 1 AS video_id FROM img GROUP BY 1, 2) SELECT p_partkey AS frame_id, video_id, row_number() OVER (PARTITION BY doc, sz ORDER BY pos) - 1 AS frame_idx FROM img JOIN v USING (doc, sz)")
def s34_coco_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COCO documents made from parts: images of one size are one video, in the order of the file."""
    image = F.struct(F.col("p_partkey").alias("id"), ((F.col("p_size") % 3 + 1) * 100).alias("width"), F.lit(384).alias("height"), F.concat(F.lit("img_"), F.col("p_partkey"), F.lit(".png")).alias("file_name"))
    docs = V.table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 7).cast("string").alias("path")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(image)).alias("images"))).alias("json"))
    doc = docs.select("path", F.from_json("json", f"struct<{tabular.COCO.replace(chr(10), '').replace(' array', ':array')}>").alias("d")).select("path", "d.*")
    out = tabular.coco_tables(doc)["frames"]
    return out.select("frame_id", "video_id", "frame_idx")


@query("WITH k AS (SELECT p_partkey AS id, p_size AS s FROM part) SELECT id, n AS node_idx, CASE WHEN (id + n) % 3 > 0 THEN CAST(s + n AS DOUBLE) END AS x, (id + n) % 3 > 0 AS visible FROM k, (SELECT unnest([0, 1, 2]) AS n)")
def f21_coco_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.flatten(F.transform(F.array(*map(F.lit, range(3))), lambda n: F.array((F.col("p_size") + n).cast("double"), F.lit(1.0), ((F.col("p_partkey") + n) % 3).cast("double"))))
    out = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.posexplode(T.coco_points(k)).alias("node_idx", "p"))
    return out.select("id", big(F.col("node_idx"), "node_idx"), "p.x", "p.visible")


@query(f"WITH {V.sql()} SELECT instance_id, frame_id, is_predicted, n FROM inst")
def s43_dict_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with their instances to JSON objects and back."""
    frames, inst = V.frames(spark, sf_dir), V.instances(spark, sf_dir).drop("video_id", "frame_idx")
    _, back = tabular.from_dicts(tabular.to_dicts(frames, inst))
    return back.select("instance_id", "frame_id", "is_predicted", big(F.size(F.filter("points", lambda p: p["x"].isNotNull())), "n"))


@query(f"WITH {V.sql()} SELECT frame_idx, user_id AS track_id, n AS n_points FROM inst")
def s44_from_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = aggregates.long_points(V.instances(spark, sf_dir))
    out = tabular.from_tensor(cells, len(V.NODES))
    return out.select("frame_idx", "track_id", big(F.size(F.filter("points", lambda p: p["visible"])), "n_points"))


@query(f"WITH {V.BOXES} SELECT bbox_id, 'Polygon' AS geom_type, category, round(x1, 6) AS x0 FROM bx")
def s41_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes to a feature collection for each frame and back."""
    from ..functions import geometry as G

    ring = G.box_ring(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    rois = V.boxes(spark, sf_dir).withColumn("geometry", G.polygon_geojson(F.array(ring)))
    features = tabular.to_geojson(rois, ["bbox_id", "category"])
    texts = features.groupBy("frame_id").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("feature"), ","), F.lit("]}")).alias("value"))
    out = tabular.read_geojson(texts)
    return out.select(F.col("properties")["bbox_id"].cast("bigint").alias("bbox_id"), "geom_type", F.col("properties")["category"].alias("category"), r6(F.get_json_object("geometry", "$.coordinates[0][0][0]").cast("double"), "x0"))


@query("SELECT page_id, page_id AS number, CASE WHEN page_id % 5 = 0 THEN NULL ELSE 10 + page_id END AS x2, page_id AS video FROM pages")
def f31_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame numbers in names, crop texts and video groups."""
    n = F.col("page_id").cast("string")
    name = F.concat(F.lit("dir9/img_7_"), n, F.lit(".png"))
    crop = F.when(F.col("page_id") % 5 == 0, F.lit("0, 5, 0, 5")).otherwise(F.concat(F.lit("3, "), (F.col("page_id") + 10).cast("string"), F.lit(", 4, 8")))
    return V.table(spark, sf_dir, "pages").select("page_id", T.trailing_number(name).alias("number"), T.dlc_crop(crop)[2].alias("x2"), T.video_number(F.concat(F.lit("video"), n, F.lit("/video"))).alias("video"))


@query("SELECT s_suppkey, floor(s_acctbal + 0.5) AS half_up, printf('%.6f', s_acctbal / 7) AS six FROM supplier")
def f23_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "supplier").select("s_suppkey", T.round_half_up(F.col("s_acctbal")).cast("double").alias("half_up"), T.six(F.col("s_acctbal") / 7).alias("six"))
