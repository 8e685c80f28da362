"""Queries of annotations, label images, sessions, JSON tables, videos and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import formats as T
from ..functions import geometry as G
from ..functions import masks as M
from ..operators import annotations, label_images, matching, select, sessions, videos
from ..sources import documents
from . import pose_view as V
from .linkage import BOTH, FRAME, MATCHES, OVERLAP, _sides
from .poses import CTE, big, r6
from .registry import query

# ---- Annotations: boxes of a frame, numbered; even numbers are one dataset, odd ones the other --------------

NUMBERED = f"WITH {'{r}'}{V.BOXES}, c AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY bbox_id, instance_id, track_id, x1, y1) - 1 AS k, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM bx), a AS (SELECT * FROM c WHERE k % 2 = 0), b AS (SELECT * FROM c WHERE k % 2 = 1), m AS (SELECT a.frame_id, a.k AS ao, b.k AS bo, b.track_id AS bt, 1 / (1 + sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS score FROM a JOIN b ON a.frame_id = b.frame_id WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 20)"
PLAIN = NUMBERED.format(r="")
GREEDY = NUMBERED.format(r="RECURSIVE ") + """, r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, ao, bo) AS n FROM m), g AS (SELECT frame_id, n, [ao] AS ua, [bo] AS ub, ao, bo, true AS hit FROM r WHERE n = 1
UNION ALL SELECT r.frame_id, r.n, CASE WHEN list_contains(ua, r.ao) OR list_contains(ub, r.bo) THEN ua ELSE list_append(ua, r.ao) END, CASE WHEN list_contains(ua, r.ao) OR list_contains(ub, r.bo) THEN ub ELSE list_append(ub, r.bo) END, r.ao, r.bo, NOT (list_contains(ua, r.ao) OR list_contains(ub, r.bo)) FROM g JOIN r ON r.frame_id = g.frame_id AND r.n = g.n + 1),
h AS (SELECT g.frame_id, g.ao, g.bo, a.is_predicted AS ap FROM g JOIN a ON a.frame_id = g.frame_id AND a.k = g.ao WHERE hit)"""


def _annotations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from ..operators.windows import positional_rank

    box = V.boxes(spark, sf_dir).withColumn("at", annotations.place("bboxes")).withColumn("x", F.col("at.x")).withColumn("y", F.col("at.y"))
    n = positional_rank(box, ["frame_id"], ["bbox_id", "instance_id", "track_id", "x1", "y1"], "ord")
    n = n.select("frame_id", (F.col("frame_id") * 100 + F.col("ord")).alias("id"), "ord", "is_predicted", "track_id", F.col("angle").alias("tracking_score"), F.lit(None).cast("bigint").alias("from_predicted"), "x", "y")
    return n.where("ord % 2 = 0"), n.where("ord % 2 = 1")


def _merged(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    a, b = _annotations(spark, sf_dir)
    out = annotations.merge_annotations(a, b, ["frame_id"], "id", strategy, 20.0)
    return out.select("frame_id", "ord", "source", big(F.col("step"), "step"), "track_id")


@query(f"""{GREEDY} SELECT frame_id, k AS ord, 'self' AS source, 0 AS step, track_id FROM a WHERE NOT is_predicted UNION ALL SELECT b.frame_id, b.k, 'other', 1, b.track_id FROM b LEFT JOIN h ON h.frame_id = b.frame_id AND h.bo = b.k WHERE coalesce(h.ap, true)
UNION ALL SELECT a.frame_id, a.k, 'self', 2, a.track_id FROM a LEFT JOIN h ON h.frame_id = a.frame_id AND h.ao = a.k WHERE a.is_predicted AND h.ao IS NULL""")
def m03_annotations_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "auto")


@query(f"{PLAIN} SELECT frame_id, k AS ord, 'self' AS source, 0 AS step, track_id FROM a UNION ALL SELECT frame_id, k, 'other', 1, track_id FROM b")
def m03_annotations_keep_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "keep_both")


@query(f"{PLAIN} SELECT frame_id, k AS ord, 'self' AS source, 0 AS step, track_id FROM a WHERE NOT is_predicted UNION ALL SELECT frame_id, k, 'other', 1, track_id FROM b WHERE is_predicted")
def m03_annotations_replace_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "replace_predictions")


@query(f"{PLAIN}, t AS (SELECT frame_id, ao, bt FROM m QUALIFY row_number() OVER (PARTITION BY frame_id, ao ORDER BY score DESC, bo) = 1) SELECT a.frame_id, k AS ord, 'self' AS source, 0 AS step, CASE WHEN t.ao IS NULL THEN track_id ELSE bt END AS track_id FROM a LEFT JOIN t ON t.frame_id = a.frame_id AND t.ao = a.k")
def m03_annotations_update_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "update_tracks")


@query(f"""{PLAIN}, u AS (SELECT *, CASE WHEN k % 3 = 0 THEN k + 1 END AS f FROM c WHERE NOT is_predicted) SELECT c.frame_id * 100 + k AS mask_id FROM c WHERE is_predicted AND NOT EXISTS (SELECT 1 FROM u WHERE u.frame_id = c.frame_id AND u.f = c.k)
AND NOT EXISTS (SELECT 1 FROM u WHERE u.frame_id = c.frame_id AND sqrt(pow(u.x - c.x, 2) + pow(u.y - c.y, 2)) <= 5)""")
def j16_unused_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _annotations(spark, sf_dir)
    m = a.unionByName(b).withColumn("mask_id", F.col("id")).withColumn("from_predicted", F.when(~F.col("is_predicted") & (F.col("ord") % 3 == 0), F.col("id") + 1))
    return annotations.unused_predicted_masks(m, ["frame_id"]).select("mask_id")


@query(f"WITH {V.BOXES} SELECT 'box' AS kind, bbox_id AS id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM bx UNION ALL SELECT 'image', p_partkey, (p_size + 10) / 2 / 2.0 + 3, p_size / 2 / 1.0 + 4 FROM part UNION ALL SELECT 'mask', p_partkey, (p_partkey % 7 + p_size / 2) / 2.0 + 3, 0.5 + 4 FROM part")
def x01_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of boxes, of label images, and of masks of one row with one run."""
    two = F.array(F.lit(2.0), F.lit(1.0)).alias("scale"), F.array(F.lit(3.0), F.lit(4.0)).alias("offset")
    at = lambda d, kind, id_, p: d.withColumn("at", p).select(F.lit(kind).alias("kind"), F.col(id_).alias("id"), "at.x", "at.y")
    part = V.table(spark, sf_dir, "part")
    images = part.select("p_partkey", (F.col("p_size") + 10).alias("width"), F.col("p_size").alias("height"), *two)
    lead = F.col("p_partkey") % 7
    rows = part.select("p_partkey", F.lit(1000).alias("width"), F.array(lead, F.col("p_size").cast("bigint"), 1000 - lead - F.col("p_size")).alias("rle"), *two)
    return at(V.boxes(spark, sf_dir), "box", "bbox_id", annotations.place("bboxes")).unionByName(at(images, "image", "p_partkey", annotations.place("label_images"))).unionByName(at(rows, "mask", "p_partkey", annotations.place("masks")))


@query(f"{CTE} SELECT instance_id, round((SELECT avg(s) FROM pts p WHERE p.frame_idx = i.frame_idx AND p.user_id = i.user_id AND s > 0), 6) AS score FROM inst i")
def a14_confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.instances(spark, sf_dir).select("instance_id", r6(annotations.confidence_score(F.col("points")), "score"))


@query(f"{CTE} SELECT max(n) AS peak FROM (SELECT count(*) AS n FROM inst GROUP BY frame_id)")
def a15_peak_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.peak_instances(V.instances(spark, sf_dir), ["frame_id"]).select(big(F.col("peak"), "peak"))


@query("SELECT user_id AS track_id, row_number() OVER (ORDER BY min(event_id)) - 1 AS ord FROM events GROUP BY 1")
def u11_tracks_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.tracks_in_order(V.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("track_id")), ["event_id"])


@query("SELECT o_orderkey AS annotation_id, CASE WHEN o_custkey % 4 > 0 THEN s_suppkey END AS instance_id FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey AND o_custkey % 4 > 0")
def j05_instance_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations that name an instance by its row; some name none, some one that isn't there."""
    rows = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("annotation_id"), F.when(F.col("o_custkey") % 4 > 0, F.col("o_custkey")).otherwise(-1).alias("instance_ref"), F.lit(None).cast("bigint").alias("instance_id"))
    inst = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row"), F.col("s_suppkey").alias("instance_id"))
    return annotations.resolve_instances(rows, inst).select("annotation_id", "instance_id")


@query("WITH l AS (SELECT user_id AS id, arg_max(event_type, event_id) AS category FROM events WHERE event_id % 5 = 2 GROUP BY 1) SELECT s_suppkey AS bbox_id, category FROM supplier LEFT JOIN l ON id = s_suppkey")
def j06_owner_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = V.table(spark, sf_dir, "events").select((F.col("event_id") % 5).cast("int").alias("owner_type"), F.col("user_id").alias("owner_id"), F.col("event_id").alias("row"), F.col("event_type").alias("category"))
    boxes = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("bbox_id"))
    return annotations.link_owners(boxes, links, "bboxes", "bbox_id", ["category"]).select("bbox_id", "category")


@query("SELECT s_suppkey AS id, r_name AS identity_name, n >= 0 AND r_name IS NULL AS out_of_range FROM (SELECT s_suppkey, s_suppkey % 9 - 1 AS n FROM supplier) LEFT JOIN region ON r_regionkey = n")
def x17_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = V.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("ord"), F.col("r_regionkey").alias("identity_id"), F.col("r_name").alias("name"), F.lit("").alias("color"))
    links = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 9 - 1).alias("identity_idx"))
    return annotations.with_identity(links, who).select("id", "identity_name", "out_of_range")


@query("SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey % 3 AS video_id, CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey + 1000 ELSE l_suppkey END AS track_id FROM lineitem")
def m10_annotation_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = V.boxes(spark, sf_dir).select(F.col("bbox_id").alias("id"), (F.col("video_id") + 50).alias("video_id"), "track_id")
    vmap = spark.range(3).select((F.col("id") + 50).alias("video_id"), F.col("id").alias("new_video"))
    tmap = V.table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("track_id"), (F.col("s_suppkey") + 1000).alias("new_track"))
    return annotations.remap(box, vmap, tmap)


@query(f"{CTE} SELECT 'negative' AS view, count(DISTINCT frame_id) AS n FROM inst WHERE frame_idx % 7 = 3 UNION ALL SELECT 'predicted', count(*) FROM inst WHERE is_predicted UNION ALL SELECT 'user', count(*) FROM inst WHERE NOT is_predicted UNION ALL SELECT 'static', count(*) FROM part WHERE p_size > 25 UNION ALL SELECT 'temporal', count(*) FROM part WHERE p_size <= 25")
def p09_p11_p12_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    inst, rois = V.instances(spark, sf_dir), V.table(spark, sf_dir, "part").select((F.col("p_size") > 25).alias("is_static"))
    parts = {"negative": annotations.negative_frames(V.frames(spark, sf_dir)), "predicted": annotations.predicted_only(inst), "user": annotations.predicted_only(inst, False), "static": annotations.static_rois(rois), "temporal": annotations.static_rois(rois, False)}
    from ..sources.tabular import union_all

    return union_all([d.agg(F.count("*").alias("n")).select(F.lit(k).alias("view"), "n") for k, d in parts.items()])


# ---- Label images ------------------------------------------------------------------------------------------

_IMAGES = "px AS (SELECT l_suppkey AS img, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS pos, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 0 END AS label FROM lineitem)"


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's line items as an image of one column."""
    label = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(0)
    per = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("label_image_id")).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", label.alias("v")))).alias("d"))
    return per.select("label_image_id", F.transform("d", lambda s: s["v"]).alias("data"), F.size("d").alias("height"), F.lit(1).alias("width"), F.lit(None).cast("array<double>").alias("scale"), F.lit(None).cast("array<double>").alias("offset"), (F.col("label_image_id") % 2 == 0).alias("is_predicted"), F.lit(0.5).alias("score"))


@query(f"""WITH {_IMAGES}, f AS (SELECT *, pos - row_number() OVER (PARTITION BY img, label ORDER BY pos) AS g FROM px WHERE label > 0), t AS (SELECT img, count(*) AS total FROM px GROUP BY 1)
SELECT img AS label_image_id, label AS label_id, count(*) AS area, count(DISTINCT g) AS n_runs, min(pos) AS lead, any_value(total) AS total, CASE WHEN img % 2 = 0 THEN CASE WHEN label = 1 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END END AS score, CASE WHEN label = 1 THEN 'one' END AS category FROM f JOIN t USING (img) GROUP BY img, label""")
def f18_label_image_to_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _images(spark, sf_dir)
    known = images.select("label_image_id", F.lit(1).alias("label_id"), F.lit("one").alias("category"), F.lit(0.9).alias("score"))
    out = label_images.to_masks(images, known)
    total = F.aggregate("rle", F.lit(0).cast("bigint"), lambda s, n: s + n)
    return out.select("label_image_id", big(F.col("label_id"), "label_id"), M.area(F.col("rle")).alias("area"), big(F.floor(F.size("rle") / 2), "n_runs"), F.col("rle")[0].alias("lead"), total.alias("total"), "score", "category")


_MASKS = "mk AS (SELECT p_partkey, p_partkey // 4 AS grp, row_number() OVER (PARTITION BY p_partkey // 4 ORDER BY p_partkey) AS label, p_size AS a, p_partkey % 5 + 1 AS n FROM part)"


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 5 + 1
    size = F.col("p_size").cast("bigint")
    return V.table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 4).alias("grp"), F.col("p_partkey").alias("ord"), F.array(size, n, 100 - size - n).alias("rle"), F.lit(1).alias("height"), F.lit(100).alias("width"), F.array(F.lit(1.0), F.lit(1.0)).alias("scale"), F.array(F.lit(0.0), F.lit(0.0)).alias("offset"), F.col("p_brand").alias("category"))


@query(f"WITH {_MASKS}, p AS (SELECT grp, a + i AS pos, max(label) AS label FROM mk, unnest(generate_series(0, 5)) AS s(i) WHERE i < n GROUP BY 1, 2) SELECT grp, pos, label FROM p")
def f18_masks_to_label_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels, _, _ = label_images.from_masks(_masks(spark, sf_dir), "grp")
    return pixels.select("grp", "pos", big(F.col("label"), "label"))


_OBJECTS = "ob AS (SELECT l_orderkey AS img, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS label, CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey END AS track, CASE WHEN l_partkey % 6 > 0 THEN l_returnflag || l_linestatus END AS category FROM lineitem)"


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.windows import positional_rank

    n = positional_rank(V.table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "label_id")
    return n.select(F.col("l_orderkey").alias("label_image_id"), F.col("l_orderkey").alias("ord"), (F.col("label_id") + 1).alias("label_id"), F.when(F.col("l_suppkey") % 5 > 0, F.col("l_suppkey")).alias("track_id"), F.when(F.col("l_partkey") % 6 > 0, F.concat("l_returnflag", "l_linestatus")).alias("category"))


@query(f"""WITH {_OBJECTS}, t AS (SELECT track, row_number() OVER (ORDER BY min((img, label))) AS id FROM ob WHERE track IS NOT NULL GROUP BY 1), l AS (SELECT img, label, row_number() OVER (ORDER BY img, label) AS r FROM ob WHERE track IS NULL)
SELECT ob.img AS label_image_id, ob.label AS label_id, coalesce(t.id, l.r + (SELECT count(*) FROM t)) AS new_id FROM ob LEFT JOIN t USING (track) LEFT JOIN l ON l.img = ob.img AND l.label = ob.label""")
def m13_normalize_by_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_images.normalize(_objects(spark, sf_dir)).select("label_image_id", "label_id", "new_id")


@query(f"""WITH {_OBJECTS}, t AS (SELECT coalesce(category, '') AS c, row_number() OVER (ORDER BY min((img, label))) AS id FROM ob GROUP BY 1)
SELECT img AS label_image_id, label AS label_id, id AS new_id, row_number() OVER (PARTITION BY img, id ORDER BY label) = 1 AS kept FROM ob JOIN t ON t.c = coalesce(category, '')""")
def w07b_normalize_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_images.normalize(_objects(spark, sf_dir), "category").select("label_image_id", "label_id", "new_id", "kept")


@query(f"WITH {_OBJECTS} SELECT img AS label_image_id, count(*) AS n_objects, coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') AS categories, count(DISTINCT track) AS n_tracks FROM ob GROUP BY 1")
def a18_image_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = label_images.image_summary(_objects(spark, sf_dir))
    return out.select("label_image_id", "n_objects", F.array_join("categories", ",").alias("categories"), big(F.size("tracks"), "n_tracks"))


@query("""WITH s AS (SELECT o_custkey AS stack, o_orderkey AS page, o_orderkey % 11 + CASE WHEN o_orderkey % 13 = 0 THEN i ELSE 0 END AS label FROM orders, (SELECT unnest([0, 1]) AS i)), p AS (SELECT stack, page, min(label) AS label_id, count(DISTINCT label) AS n FROM s GROUP BY 1, 2)
SELECT stack, page, label_id, max(n) OVER (PARTITION BY stack) = 1 AND (SELECT count(DISTINCT q.label_id) = count(*) FROM p q WHERE q.stack = p.stack) AS is_single FROM p""")
def a17_page_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stack"), key.alias("page"), F.explode(F.array(key % 11, key % 11 + F.when(key % 13 == 0, 1).otherwise(0))).alias("label"))
    return label_images.page_ids(rows, "stack", "page")


# ---- Sessions ----------------------------------------------------------------------------------------------

_GROUPS = "g AS (SELECT o_custkey AS cust, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS row FROM orders)"


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as instance groups in one running order, their customers as frame groups."""
    from ..operators.windows import global_rank

    g = global_rank(V.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], "row")
    fg = g.groupBy("o_custkey").agg(F.min("row").alias("ig_start"), (F.max("row") + 1).alias("ig_end")).select((F.col("o_custkey") % 3).alias("session_id"), F.col("o_custkey").alias("frame_idx"), "ig_start", "ig_end")
    row = F.col("row")
    groups = g.select("row", (F.col("o_custkey") % 3).alias("session_id"), (row * 2).alias("member_start"), (row * 2 + 2).alias("member_end"), (row % 5 - 1).alias("identity_idx"), F.when(row % 3 == 0, F.lit(float("nan"))).otherwise(row / 10).alias("score"), F.when(row % 2 == 0, row * 2).otherwise(-1).alias("pts3d_start"), (row * 2 + 2).alias("pts3d_end"), F.when(row % 4 == 0, 1).otherwise(0).alias("pts3d_predicted"))
    return fg, groups


@query(f"""WITH {_GROUPS} SELECT cust % 3 AS session_id, cust AS frame_idx, row AS group_id, CASE WHEN row % 5 > 0 THEN row % 5 - 1 END AS identity_idx, CASE WHEN row % 3 > 0 THEN round(row / 10, 6) END AS score,
CASE WHEN row % 2 = 0 THEN 2 ELSE 0 END AS n_points, CASE WHEN row % 2 = 0 THEN CAST(row * 4 + 1 AS DOUBLE) END AS sum_x, CASE WHEN row % 4 = 0 THEN CAST(row * 8 + 2 AS DOUBLE) END AS sum_score FROM g""")
def s09_session_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    fg, groups = _groups(spark, sf_dir)
    rows = groups.select(F.explode(F.array(F.col("row") * 2, F.col("row") * 2 + 1)).alias("row"))
    points = rows.select("row", F.col("row").cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(float("nan")).alias("z"), (F.col("row") * 2.0).alias("score"))
    out = sessions.instance_groups(fg, groups, points.drop("score"), points)
    p = F.col("points_3d")
    total = lambda c: F.when(F.get(p, 0)[c].isNotNull(), F.aggregate(p, F.lit(0.0), lambda s, v: s + v[c]))
    return out.select("session_id", "frame_idx", "group_id", "identity_idx", r6(F.col("score"), "score"), big(F.when(p.isNull(), 0).otherwise(F.size(p)), "n_points"), total("x").alias("sum_x"), total("score").alias("sum_score"))


@query(f"""WITH {_GROUPS}, m AS (SELECT row AS group_id, cust % 3 AS session_id, row * 2 + i AS m FROM g, (SELECT unnest([0, 1]) AS i)) SELECT group_id, m % 3 AS camera_id, (m // 2) % 7 AS frame_id, CASE WHEN (m // 2) % 7 < 5 AND m % 2 = 0 THEN (m // 2) % 7 * 10 END AS instance_id FROM m WHERE m % 3 < 2""")
def j07_session_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of groups: one of three cameras isn't there, some frames hold no such instance."""
    _, groups = _groups(spark, sf_dir)
    rows = groups.select(F.explode(F.array(F.col("row") * 2, F.col("row") * 2 + 1)).alias("row")).select("row", (F.col("row") % 3).alias("camera"), (F.floor(F.col("row") / 2) % 7).alias("lf"), (F.col("row") % 2).alias("inst"))
    cameras = spark.range(6).select((F.col("id") % 3).alias("session_id"), F.floor(F.col("id") / 3).alias("ord"), F.floor(F.col("id") / 3).alias("camera_id"))
    frames = spark.range(7).select(F.col("id").alias("row"), F.col("id").alias("frame_id"))
    inst = spark.range(5).select(F.col("id").alias("frame_id"), F.lit(0).cast("bigint").alias("ord"), (F.col("id") * 10).alias("instance_id"))
    found = sessions.resolve_members(sessions.members(groups, rows, cameras), frames, inst)
    return found.select("group_id", "camera_id", "frame_id", "instance_id")


@query("""WITH s AS (SELECT s_suppkey % 4 AS session_id, s_nationkey AS camera_id, s_suppkey % 7 AS video_id, s_suppkey AS row FROM supplier), l AS (SELECT session_id, camera_id, arg_max(video_id, row) AS video_id, max(row) AS row FROM s GROUP BY 1, 2) SELECT session_id, video_id, arg_max(camera_id, row) AS camera_id FROM l GROUP BY 1, 2""")
def m15_camera_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 4).alias("session_id"), F.col("s_nationkey").cast("bigint").alias("camera_id"), (F.col("s_suppkey") % 7).alias("video_id"), F.col("s_suppkey").alias("row"))
    return sessions.videos_of_cameras(rows.select("session_id", "camera_id").distinct(), rows)


# ---- JSON tables -------------------------------------------------------------------------------------------


@query("SELECT s_suppkey AS track_id, CASE s_suppkey % 4 WHEN 3 THEN CAST(s_suppkey AS VARCHAR) ELSE s_name END AS name FROM supplier")
def s08_tracks_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = documents.quoted(F.col("s_name"))
    kind = F.col("s_suppkey") % 4
    text = F.when(kind == 0, F.concat(F.lit("[0, "), name, F.lit("]   "))).when(kind == 1, F.concat(F.lit('{"name": '), name, F.lit("}"))).when(kind == 2, name).otherwise(F.col("s_suppkey").cast("string"))
    return documents.tracks(V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), text.alias("value"))).select("track_id", "name")


@query("SELECT o_orderkey AS ord, o_orderkey % 3 AS video_id, o_custkey AS frame_idx, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'default' END AS grp FROM orders")
def s08b_suggestions_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 3).alias("video_id"), F.col("o_custkey").alias("frame_idx"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("grp"))
    return documents.suggestions(documents.suggestions_json(rows)).drop("metadata")


@query("""SELECT s_suppkey AS video_id, CASE s_suppkey % 3 WHEN 0 THEN 'embedded' WHEN 1 THEN '/v/' || s_suppkey || '.mp4' ELSE 'a.png' END AS first_file, s_suppkey % 3 = 2 AS is_sequence, CASE WHEN s_suppkey % 3 < 2 THEN s_suppkey END AS n_frames, CASE WHEN s_suppkey % 3 < 2 THEN 480 END AS height, CASE WHEN s_suppkey % 3 < 2 THEN 640 END AS width,
CASE WHEN s_suppkey % 3 < 2 THEN 30.0::DOUBLE END AS fps, s_suppkey % 3 = 0 AS embedded, CASE s_suppkey % 3 WHEN 0 THEN '["embedded"]|' || s_suppkey || ',480,640,1|true' WHEN 1 THEN '["/v/' || s_suppkey || '.mp4"]|' || s_suppkey || ',480,640,1|false' ELSE '["a.png","b.png"]|null|false' END AS signature FROM supplier""")
def s08c_videos_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    shape = F.concat(F.lit(', "shape": ['), key.cast("string"), F.lit(', 480, 640, 1], "fps": 30.0}}'))
    text = F.when(key % 3 == 0, F.concat(F.lit('{"backend": {"filename": ".", "dataset": "video0/video"'), shape)).when(key % 3 == 1, F.concat(F.lit('{"filename": "/v/'), key.cast("string"), F.lit('.mp4", "backend": {"format": "mp4"'), shape)).otherwise(F.lit('{"backend": {"filenames": ["a.png", "b.png"]}}'))
    out = documents.videos(V.table(spark, sf_dir, "supplier").select(key.alias("ord"), text.alias("value")))
    signed = out.join(documents.video_signatures(out), "video_id")
    return signed.select("video_id", F.col("filenames")[0].alias("first_file"), "is_sequence", "n_frames", "height", "width", "fps", "embedded", "signature")


@query("""SELECT s_suppkey AS session_id, c AS camera_id, 'cam' || c AS key, CASE WHEN c = 0 THEN s_name ELSE 'cam1' END AS name, CASE WHEN c = 0 THEN CAST(s_suppkey AS DOUBLE) ELSE 0.0 END AS r0, CASE WHEN c = 0 THEN 640 END AS width, CASE WHEN c = 0 THEN s_suppkey % 5 END AS video_id, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS fg_start FROM supplier, (SELECT unnest([0, 1]) AS c)""")
def s08d_sessions_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    text = F.concat(
        F.lit('{"calibration": {"cam0": {"name": '), documents.quoted(F.col("s_name")), F.lit(', "rotation": ['), key, F.lit(', 0, 0], "size": [640, 480]}, "cam1": {}, "metadata": {"a": 1}}, "camcorder_to_video_idx_map": {"cam0": "'), (F.col("s_suppkey") % 5).cast("string"), F.lit('"}'),
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(', "fg_start": '), key, F.lit(', "fg_end": 9'))).otherwise(""), F.lit("}"),
    )
    rows = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), text.alias("value"))
    out = documents.cameras(rows).join(documents.session_videos(rows), ["session_id", "key"], "left").join(documents.session_ranges(rows), "session_id", "left")
    return out.select("session_id", "camera_id", "key", "name", F.col("rvec")[0].alias("r0"), F.col("size")[0].alias("width"), "video_id", "fg_start")


# ---- Videos and tracks ---------------------------------------------------------------------------------------

_CHAINS = "v AS (SELECT s_suppkey AS id, s_nationkey AS n, CASE WHEN s_suppkey % 10 > 0 THEN s_suppkey - s_suppkey % 10 END AS up, CASE WHEN s_suppkey % 4 > 1 THEN 1 ELSE 0 END AS crop FROM supplier), t AS (SELECT v.*, coalesce(r.n, v.n) AS rn FROM v LEFT JOIN v r ON r.id = v.up)"


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    none = F.lit(None).cast("bigint")
    return V.table(spark, sf_dir, "supplier").select(key.alias("video_id"), F.array(F.concat(F.lit("/d//f"), F.col("s_nationkey").cast("string"))).alias("filenames"), F.lit(False).alias("is_sequence"), F.lit(None).cast("string").alias("dataset"), F.when(key % 4 > 1, F.array(F.lit(1))).alias("crop"), none.alias("original_video_id"), F.when(key % 10 > 0, key - key % 10).alias("source_video_id"))


@query(f"""WITH {_CHAINS} SELECT a.id AS in_id, b.id AS base_id, a.rn = b.rn AND a.crop = b.crop AS same_file, a.up IS NOT NULL AND b.up IS NOT NULL AND a.rn <> b.rn AND (a.rn < 12 OR b.rn < 12) AS conflict FROM t a JOIN t b ON b.id = a.id + 9 WHERE (a.up IS NULL OR a.up IN (SELECT id FROM v)) AND (b.up IS NULL OR b.up IN (SELECT id FROM v))""")
def j13g_file_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of videos with the files that they come from, of which some exist."""
    v = _chains(spark, sf_dir)
    known = v.select(F.col("video_id").alias("source_video_id"))
    v = v.join(known, "source_video_id", "left_semi").unionByName(v.where("source_video_id is null"))
    pairs = v.select(F.col("video_id").alias("in_id")).join(v.select((F.col("video_id") - 9).alias("in_id"), F.col("video_id").alias("base_id")), "in_id")
    files = spark.range(12).select(F.concat(F.lit("/d/f"), F.col("id").cast("string")).alias("path"))
    return videos.file_relations(v, v, pairs, files, files)


@query(f"""{CTE}, f AS (SELECT DISTINCT video_id, frame_idx FROM inst WHERE NOT is_predicted), r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 AS r, count(*) OVER (PARTITION BY video_id) AS n FROM f), s AS (SELECT * FROM r WHERE n <= 6 OR r IN (0, n // 6, 2 * n // 6, 3 * n // 6, 4 * n // 6, 5 * n // 6))
SELECT video_id AS in_id, video_id AS base_id, any_value(n) AS n_common, count(*) AS n_sampled, count(*) FILTER (frame_idx % 4 = 1) AS n_equal, count(*) FILTER (frame_idx % 4 = 1) >= least(3, any_value(n)) AS is_match FROM s GROUP BY video_id""")
def j13c_pose_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same videos, of which three frames in four have other poses: moved by half a unit of y, whose values are whole, so that none meets another instance's pose."""
    base = V.instances(spark, sf_dir)
    moved = F.transform("points", lambda p: F.struct((p["x"] + 1).alias("x"), (p["y"] + 0.5).alias("y"), p["visible"].alias("visible"), p["complete"].alias("complete"), p["score"].alias("score")))
    incoming = base.withColumn("points", F.when(F.col("frame_idx") % 4 == 1, F.col("points")).otherwise(moved))
    pairs = spark.range(3).select(F.col("id").alias("in_id"), F.col("id").alias("base_id"))
    return videos.pose_matches(incoming, base, pairs)


@query(f"{CTE} SELECT video_id, bool_or(NOT is_predicted) AS has_user FROM inst GROUP BY 1")
def x06_has_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return videos.has_user_instances(spark.range(3).withColumnRenamed("id", "video_id"), V.instances(spark, sf_dir))


@query(f"{BOTH}, {MATCHES} SELECT a.user_id AS self_track, a.user_id AS other_track, count(*) AS n_shared FROM inst_a a JOIN inst_b b USING (video_id, frame_idx, user_id) WHERE a.user_id NOT IN (SELECT ao FROM m WHERE ao = bo) GROUP BY 1, 2")
def j19_diverging_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    names = a.select("track_id").distinct().select(F.col("track_id").alias("self_track"), F.col("track_id").alias("other_track"))
    return videos.diverging_tracks(a, b, names, FRAME, OVERLAP)


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = V.table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("track_id"), F.col("c_nationkey").cast("string").alias("name"))
    supp = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("track_id"), F.col("s_nationkey").cast("string").alias("name"))
    v = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("video_id"), F.col("s_nationkey").alias("height"), F.lit(7).alias("width"), F.lit(1).alias("channels"))
    found = matching.video_map(v.where("video_id % 2 = 1"), v.where("video_id % 2 = 0 and height < 9"), "shape")
    sk = V.skeletons(spark, sf_dir)
    return videos.match_report((cust, supp), (sk.where("skeleton_id % 2 = 0"), sk.where("skeleton_id % 2 = 1")), found, "name")


@query(f"""WITH {V.sql()}, {V.SKELETONS}
SELECT 'track' AS kind, s_suppkey AS other_id, min(c_custkey) AS self_id FROM supplier LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 12) ON c_nationkey = s_nationkey GROUP BY 2 UNION ALL SELECT 'video', b.s_suppkey, min(a.s_suppkey) FROM supplier b LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 2 = 0 AND s_nationkey < 9) a USING (s_nationkey) WHERE b.s_suppkey % 2 = 1 GROUP BY 2
UNION ALL SELECT 'skeleton', o.skeleton_id, min(s.skeleton_id) FROM sk o LEFT JOIN (SELECT * FROM sk WHERE skeleton_id % 2 = 0) s USING (nodes) WHERE o.skeleton_id % 2 = 1 GROUP BY 2""")
def j21_match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)


@query("""WITH r AS (SELECT s_suppkey AS i, min(c_custkey) AS m FROM supplier LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 12) ON c_nationkey = s_nationkey GROUP BY 1) SELECT 'track' AS kind, count(*) AS n, count(m) AS n_matched, count(*) - count(m) AS n_unmatched FROM r""")
def a07_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return videos.report_counts(_report(spark, sf_dir).where("kind = 'track'"))


# ---- Splits, arrays, texts -----------------------------------------------------------------------------------


@query("""WITH t AS (SELECT count(*) AS n FROM orders), a AS (SELECT n, greatest(CAST(trunc(n * 0.6) AS BIGINT), 1) AS train FROM t), b AS (SELECT *, greatest(CAST(trunc((n - train) * (0.2 * n / (n - train))) AS BIGINT), 1) AS test FROM a)
SELECT 'train' AS split, train AS n FROM b UNION ALL SELECT 'test', test FROM b UNION ALL SELECT 'val', n - train - test FROM b""")
def t04_three_way_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = select.three_way_split(V.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return out.groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT event_id AS i, event_id // 210 % 2 * 0 + ((event_id % 210) % 7) * 30 + ((event_id % 210) // 35) * 5 + ((event_id % 210) // 7) % 5 AS j FROM events")
def f29_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in an array of 6 x 5 x 7 whose last axis comes first."""
    ev = V.table(spark, sf_dir, "events").select(F.col("event_id").alias("i"))
    shape: list[Column] = [F.lit(6), F.lit(5), F.lit(7)]
    return ev.select("i", big(A.transposed_index(F.col("i") % 210, shape, [2, 0, 1]), "j"))


@query("SELECT event_id AS id, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS track, CASE WHEN event_id % 3 = 0 THEN value ELSE 5.0 + event_id END AS t FROM events")
def f30_nwb_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    name = F.when(e.isin("click", "view"), F.concat(F.lit("track="), e)).when(e == "error", "track=untracked").when(e == "signup", "track=").otherwise(e)
    return V.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), A.nwb_track(name).alias("track"), A.sample_time(F.when(F.col("event_id") % 3 == 0, F.col("value")), F.lit(5.0), F.col("event_id")).alias("t"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'padded' WHEN 1 THEN 'vlen' WHEN 2 THEN 'concat' ELSE 'ambiguous1d' END AS layout, CASE WHEN p_partkey % 2 = 0 THEN substr('ffd8' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '0000', 1, 4) ELSE regexp_replace('ffd8' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '0000', '(00)+$', '') END AS row FROM part""")
def x28_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    shape = F.when(k % 4 == 0, F.array(F.lit(3), F.lit(9))).otherwise(F.array(F.lit(3)))
    frames = F.when(k % 4 == 1, 3).when(k % 4 == 2, 5).otherwise(0)
    row = F.concat(F.lit("ffd8"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("0000"))
    return V.table(spark, sf_dir, "part").select(k.alias("id"), A.layout(shape, frames).alias("layout"), A.trim_padding(row, F.when(k % 2 == 0, 2)).alias("row"))


@query("SELECT event_id AS id, unnest(list_filter([event_id % 50 + s * d for d in [1, 2, 3, -1, -2]], lambda f: f >= 0 AND f < 50)) AS frame FROM (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN -1 ELSE 1 END AS s FROM events)")
def w10_prefetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("event_id") % 50
    last = F.when(F.col("user_id") % 2 == 0, at + 5).otherwise(at)
    return V.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.explode(A.prefetch(last, at, F.lit(50), 3, 2)).alias("frame"))


@query("SELECT o_orderkey AS id, list_aggregate(list_sort(list_intersect([o_orderkey % 3, o_orderkey % 5, 7], [o_custkey % 3, 7])), 'string_agg', ',') AS common FROM orders")
def u10_common_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    both = videos.common_frame_numbers(F.array(o % 3, o % 5, F.lit(7)), F.array(c % 3, F.lit(7)))
    return V.table(spark, sf_dir, "orders").select(o.alias("id"), F.array_join(both, ",").alias("common"))


@query(f"WITH {V.BOXES} SELECT bbox_id AS id, CASE WHEN track_id % 2 = 0 THEN ord || ' ' || printf('%.6f %.6f %.6f %.6f %.6f %.6f', 0.1, 0.2, 0.3, 0.2, 0.3, 0.4) ELSE ord || ' 0.200000 0.300000 0.200000 0.200000' END AS line, track_id % 2 = 1 AS is_box FROM bx WHERE track_id % 3 > 0 UNION ALL SELECT bbox_id, '0 ' || printf('%.6f %.6f %.6f %.6f %.6f %.6f', 0.1, 0.2, 0.3, 0.2, 0.3, 0.4), false FROM bx WHERE track_id % 3 = 0")
def s37c_roi_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as YOLO lines: a triangle, a box, a collection of a triangle and a point."""
    triangle, box = "[[[10,20],[30,20],[30,40],[10,20]]]", "[[[10,20],[30,20],[30,40],[10,40],[10,20]]]"
    t = F.col("track_id")
    polygon = lambda ring: f'{{"type":"Polygon","coordinates":{ring}}}'
    many = f'{{"type":"GeometryCollection","geometries":[{polygon(triangle)},{{"type":"Point","coordinates":[1,2]}}]}}'
    geometry = F.when(t % 3 == 0, many).when(t % 2 == 0, polygon(triangle)).otherwise(polygon(box))
    rows = V.boxes(spark, sf_dir).select("bbox_id", F.when(t % 3 > 0, F.col("ord")).alias("class_id"), F.explode(G.parts_of(geometry)).alias("g")).withColumn("rings", G.rings_of(F.col("g"))).where("rings is not null")
    b = G.polygon_bounds(F.col("rings"))
    boxed = T.yolo_detection_line(F.coalesce("class_id", F.lit(0)), b["min_x"], b["min_y"], b["max_x"], b["max_y"], F.lit(100), F.lit(100))
    return rows.select(F.col("bbox_id").alias("id"), F.when(G.is_box(F.col("rings")), boxed).otherwise(T.yolo_polygon_line(F.col("class_id"), F.col("rings")[0], F.lit(100), F.lit(100))).alias("line"), G.is_box(F.col("rings")).alias("is_box"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 'Polygon' ELSE 'MultiPolygon' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 3 END AS n_rings, CASE WHEN p_partkey % 3 > 0 THEN round(p_size * p_size / 2, 6) END AS area FROM part")
def f22c_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COCO polygons: one ring, two rings, or only rings of two corners."""
    s = F.col("p_size").cast("double")
    zero = F.lit(0.0)
    ring, line = F.array(zero, zero, s, zero, s, s), F.array(zero, zero, s, s)
    k = F.col("p_partkey") % 3
    seg = F.when(k == 0, F.array(line)).when(k == 1, F.array(ring, line)).otherwise(F.array(ring, ring))
    rings = T.segmentation_rings(seg)
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.get_json_object(T.segmentation_geojson(seg), "$.type").alias("kind"), big(F.size(rings), "n_rings"), F.when(F.size(rings) > 0, F.round(G.polygon_area(F.slice(rings, 1, 1)), 6)).alias("area"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'MultiPoint' ELSE 'Point' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'arena' ELSE 'anchor' END AS category, CASE WHEN p_partkey % 2 = 0 THEN '"a""' || p_size || ',"' ELSE CAST(p_size AS VARCHAR) END AS cell, CASE p_partkey % 5 WHEN 0 THEN 'access denied' WHEN 1 THEN 'not found' WHEN 2 THEN 'too many requests' WHEN 3 THEN 'server error' ELSE 'status 418' END AS message,
CAST(CASE WHEN p_size % 2 = 0 THEN p_size ELSE p_size + 1 END AS BIGINT) AS even, 'v' || p_size AS stem FROM part""")
def x19_small_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static objects, CSV cells, messages, rounding and stems."""
    k, s = F.col("p_partkey"), F.col("p_size")
    xy = F.array(s.cast("double"), F.lit(1.0))
    made = T.static_object(F.when(k % 3 == 0, "corners").otherwise("lixit"), F.when(s % 2 == 0, F.array(xy, xy)).otherwise(F.array(xy)))
    cell = F.when(k % 2 == 0, F.concat(F.lit('a"'), s.cast("string"), F.lit(","))).otherwise(s.cast("string"))
    status = F.element_at(F.array(*map(F.lit, (403, 404, 429, 503, 418))), (k % 5 + 1).cast("int"))
    path = F.concat(F.lit("/a.b\\c/v"), s.cast("string"), F.lit(".mp4"))
    return V.table(spark, sf_dir, "part").select(k.alias("id"), F.get_json_object(made["geometry"], "$.type").alias("kind"), made["category"].alias("category"), T.csv_cell(cell).alias("cell"), T.status_text(status).alias("message"), T.half_even(s + 0.5).alias("even"), T.stem(path).alias("stem"))


@query(f"{CTE} SELECT instance_id, round(cx, 6) AS x, round(cy, 6) AS y, n_vis > 0 AS visible FROM inst")
def f36_centroid_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import points as P

    at = V.instances(spark, sf_dir).withColumn("c", P.centroid("points"))
    pose = at.select("instance_id", annotations.from_centroid(F.col("c.x"), F.col("c.y"))[0].alias("p"))
    return pose.select("instance_id", r6(F.col("p.x"), "x"), r6(F.col("p.y"), "y"), F.col("p.visible").alias("visible"))
