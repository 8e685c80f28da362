"""Queries of matching and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import points as P
from ..functions import skeletons as S
from ..operators import matching, merge
from . import pose_view as V
from .poses import big, r6
from .registry import query

BOTH = f"WITH {V.sql('event_id % 2 = 0', '_a')}, {V.sql('event_id % 2 = 1', '_b')}"
FRAME = ["video_id", "frame_idx"]
#: IoU of two poses' boxes in SQL.
IOU = """CASE WHEN least(a.max_x, b.max_x) > greatest(a.min_x, b.min_x) AND least(a.max_y, b.max_y) > greatest(a.min_y, b.min_y) THEN (least(a.max_x, b.max_x) - greatest(a.min_x, b.min_x)) * (least(a.max_y, b.max_y) - greatest(a.min_y, b.min_y))
 / ((a.max_x - a.min_x) * (a.max_y - a.min_y) + (b.max_x - b.min_x) * (b.max_y - b.min_y) - (least(a.max_x, b.max_x) - greatest(a.min_x, b.min_x)) * (least(a.max_y, b.max_y) - greatest(a.min_y, b.min_y))) ELSE 0 END"""
MATCHES = f"""m AS (SELECT a.video_id, a.frame_idx, a.instance_id AS ai, b.instance_id AS bi, a.user_id AS ao, b.user_id AS bo, a.is_predicted AS ap, b.is_predicted AS bp, b.tracking_score AS bt, {IOU} AS score FROM inst_a a JOIN inst_b b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx WHERE {IOU} >= 0.3 AND a.min_x IS NOT NULL AND b.min_x IS NOT NULL)"""
BEST = "best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY video_id, frame_idx, bi ORDER BY score DESC, ao) = 1)"
OVERLAP = matching.InstanceMatcher("iou", 0.3)


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # Even events are one dataset, odd ones the other.
    odd = F.col("event_id") % 2 == 1
    return V.instances(spark, sf_dir, ~odd), V.instances(spark, sf_dir, odd)


@query(f"{BOTH}, {MATCHES} SELECT video_id, frame_idx, ai AS self_id, bi AS other_id, round(score, 6) AS score FROM m")
def j11_iou_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    out = matching.instance_matches(a, b, FRAME, OVERLAP)
    return out.select(*FRAME, F.col("a_instance_id").alias("self_id"), F.col("b_instance_id").alias("other_id"), r6(F.col("score"), "score"))


@query(f"""{BOTH}, n AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS node), i AS (SELECT a.video_id, a.frame_idx, a.user_id, a.instance_id AS self_id, b.instance_id AS other_id FROM inst_a a JOIN inst_b b USING (frame_idx, user_id)),
p AS (SELECT i.*, n.node, pa.x AS ax, pa.y AS ay, pb.x AS bx, pb.y AS by_ FROM i, n LEFT JOIN pts_a pa ON pa.frame_idx = i.frame_idx AND pa.user_id = i.user_id AND pa.node = n.node LEFT JOIN pts_b pb ON pb.frame_idx = i.frame_idx AND pb.user_id = i.user_id AND pb.node = n.node)
SELECT self_id, other_id, round(coalesce(1 / (1 + avg(sqrt(pow(ax - bx, 2) + pow(ay - by_, 2)))), 0), 6) AS score, bool_and(CASE WHEN ax IS NULL OR bx IS NULL THEN ax IS NULL AND bx IS NULL ELSE sqrt(pow(ax - bx, 2) + pow(ay - by_, 2)) <= 400 END) AS same_pose FROM p GROUP BY 1, 2""")
def j11_spatial_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    out = matching.instance_matches(a, b, FRAME, matching.IDENTITY)
    return out.select(F.col("a_instance_id").alias("self_id"), F.col("b_instance_id").alias("other_id"), r6(P.nearness("a_points", "b_points"), "score"), P.same_pose("a_points", "b_points", 400.0).alias("same_pose"))


@query(f"""WITH {V.BOXES}, c AS (SELECT bbox_id, frame_id, ord, is_predicted, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM bx)
SELECT a.bbox_id AS self_id, b.bbox_id AS other_id, round(1 / (1 + sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) AS score FROM c a JOIN c b ON a.frame_id = b.frame_id AND NOT a.is_predicted AND b.is_predicted WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 5""")
def j14_annotation_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = V.boxes(spark, sf_dir).select("bbox_id", "frame_id", "ord", "is_predicted", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    out = matching.near_pairs(box.where("not is_predicted"), box.where("is_predicted"), ["frame_id"], 5.0)
    return out.select(F.col("a_bbox_id").alias("self_id"), F.col("b_bbox_id").alias("other_id"), r6(F.col("score"), "score"))


@query(f"""WITH RECURSIVE {V.BOXES}, c AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY bbox_id, instance_id, track_id, x1, y1) AS k, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM bx), m AS (SELECT a.frame_id, a.k AS ao, b.k AS bo, 1 / (1 + sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS score FROM c a JOIN c b ON a.frame_id = b.frame_id AND NOT a.is_predicted AND b.is_predicted WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 20),
r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, ao, bo) AS n FROM m), g AS (SELECT frame_id, n, [ao] AS ua, [bo] AS ub, ao, bo, true AS hit FROM r WHERE n = 1
UNION ALL SELECT r.frame_id, r.n, CASE WHEN list_contains(ua, r.ao) OR list_contains(ub, r.bo) THEN ua ELSE list_append(ua, r.ao) END, CASE WHEN list_contains(ua, r.ao) OR list_contains(ub, r.bo) THEN ub ELSE list_append(ub, r.bo) END, r.ao, r.bo, NOT (list_contains(ua, r.ao) OR list_contains(ub, r.bo)) FROM g JOIN r ON r.frame_id = g.frame_id AND r.n = g.n + 1)
SELECT frame_id, ao AS self_ord, bo AS other_ord FROM g WHERE hit""")
def t07_greedy_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = V.boxes(spark, sf_dir).withColumn("x", (F.col("x1") + F.col("x2")) / 2).withColumn("y", (F.col("y1") + F.col("y2")) / 2)
    from ..operators.windows import positional_rank

    numbered = positional_rank(box, ["frame_id"], ["bbox_id", "instance_id", "track_id", "x1", "y1"], "ord").withColumn("ord", F.col("ord") + 1).select("frame_id", "ord", "is_predicted", "x", "y")
    pairs = matching.near_pairs(numbered.where("not is_predicted"), numbered.where("is_predicted"), ["frame_id"], 20.0)
    return matching.greedy(pairs, ["frame_id"]).select("frame_id", F.col("a_ord").alias("self_ord"), F.col("b_ord").alias("other_ord"))


@query("""WITH i AS (SELECT event_id, user_id % 3 AS v, CAST(ts AS DATE) AS d, user_id % 2 = 1 AS p, CASE WHEN event_type = 'view' AND user_id % 5 <> 0 THEN user_id END AS t, CASE WHEN user_id % 2 = 0 AND event_id > 0 THEN event_id - 1 END AS f FROM events), k AS (SELECT v, d, bool_or(t IS NOT NULL) AS tracked FROM i GROUP BY 1, 2)
SELECT event_id AS instance_id FROM i JOIN k USING (v, d) WHERE p AND CASE WHEN tracked THEN t IS NULL ELSE event_id NOT IN (SELECT f FROM i WHERE f IS NOT NULL) END""")
def j15_unused_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, event = F.col("user_id"), F.col("event_id")
    inst = V.events(spark, sf_dir).select(
        event.alias("instance_id"), (F.col("frame_idx") * 10 + user % 3).alias("frame_id"), (user % 2 == 1).alias("is_predicted"), F.when((F.col("event_type") == "view") & (user % 5 != 0), user).alias("track_id"), F.when((user % 2 == 0) & (event > 0), event - 1).alias("from_predicted")
    )
    return matching.unused_predictions(inst).select("instance_id")


@query("""WITH p AS (SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.value = b.value AND a.event_type = b.event_type AND a.event_id % 2 = 0 AND b.event_id % 2 = 1) SELECT a AS self_id, b AS other_id FROM p""")
def j22_identical_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = V.events(spark, sf_dir).select(F.col("event_id").alias("instance_id"), "user_id", "event_type", F.array(F.struct(F.col("value").alias("x"), F.col("value").alias("y"), F.lit(True).alias("visible"))).alias("points"))
    out = matching.identical_poses(ev.where("instance_id % 2 = 0"), ev.where("instance_id % 2 = 1"), ["user_id", "event_type"])
    return out.select(F.col("a_instance_id").alias("self_id"), F.col("b_instance_id").alias("other_id"))


def _classes(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    """All skeletons with their class (a row with skeleton_id), and the pairs of classes (a row with other_id)."""
    members, classes = matching.skeleton_classes(V.skeletons(spark, sf_dir), method)
    pairs = matching.class_pairs(classes, classes, method, 0.5)
    sim = S.similarity(F.col("a_nodes"), F.col("b_nodes"))
    none = F.lit(None)
    own = members.select("class_id", "skeleton_id", none.cast("bigint").alias("other_id"), none.cast("bigint").alias("n_common"), none.cast("double").alias("jaccard"), none.cast("double").alias("dice"))
    return own.unionByName(pairs.select(F.col("a_class_id").alias("class_id"), none.cast("bigint").alias("skeleton_id"), F.col("b_class_id").alias("other_id"), big(sim["n_common"], "n_common"), r6(sim["jaccard"], "jaccard"), r6(sim["dice"], "dice")))


def _classes_sql(where: str) -> str:
    common = "len(list_intersect(a.nodes, b.nodes))"
    return f"""WITH {V.sql()}, {V.SKELETONS}, c AS (SELECT nodes, min(skeleton_id) AS class_id FROM sk GROUP BY 1) SELECT class_id, skeleton_id, NULL AS other_id, NULL AS n_common, NULL AS jaccard, NULL AS dice FROM sk JOIN c USING (nodes)
UNION ALL SELECT a.class_id, NULL, b.class_id, {common}, round({common} / len(list_distinct(list_concat(a.nodes, b.nodes))), 6), round(2 * {common} / (len(a.nodes) + len(b.nodes)), 6) FROM c a, c b WHERE {where.format(common=common)}"""


@query(_classes_sql("{common} / len(list_distinct(list_concat(a.nodes, b.nodes))) >= 0.5"))
def j09_skeleton_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(spark, sf_dir, "overlap")


@query(_classes_sql("{common} = len(a.nodes)"))
def j09_skeleton_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(spark, sf_dir, "subset")


@query(_classes_sql("a.nodes = b.nodes"))
def j10_skeleton_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(spark, sf_dir, "structure")


@query("""WITH b AS (SELECT c_nationkey AS name, min(c_custkey) AS base_id FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey < 12 GROUP BY 1), i AS (SELECT s_suppkey AS track_id, s_nationkey AS name, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS canon FROM supplier)
SELECT track_id, coalesce(base_id, canon) AS base_id, base_id IS NULL AS is_new FROM i LEFT JOIN b USING (name)""")
def j12_track_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = V.table(spark, sf_dir, "customer").where("c_custkey % 2 = 0 and c_nationkey < 12").select(F.col("c_custkey").alias("track_id"), F.col("c_nationkey").alias("name"), F.col("c_custkey").alias("ord"))
    incoming = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("track_id"), F.col("s_nationkey").alias("name"))
    return matching.track_map(incoming, base, "name").select("track_id", "base_id", "is_new")


@query("""WITH u AS (SELECT page_id, list_filter(string_split(regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^[a-z]+://', ''), '/'), lambda s: s <> '') AS p FROM pages), s AS (SELECT page_id, d AS depth, list_aggregate(p[len(p) - d + 1:], 'string_agg', '/') AS suffix FROM u, unnest(generate_series(1, len(p))) AS g(d)),
c AS (SELECT depth, suffix, count(*) AS n, min(page_id) AS cand_id FROM s WHERE page_id % 2 = 0 GROUP BY 1, 2 HAVING count(*) = 1), h AS (SELECT s.page_id, s.depth, c.cand_id FROM s JOIN c USING (depth, suffix) WHERE s.page_id % 2 = 1)
SELECT page_id AS in_id, min(depth) AS depth, arg_min(cand_id, depth) AS cand_id FROM h GROUP BY 1""")
def j13_leaf_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://", "")
    p = V.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), bare.alias("path"))
    out = matching.leaf_matches(p.where("id % 2 = 1"), p.where("id % 2 = 0"))
    return out.select("in_id", big(F.col("depth"), "depth"), "cand_id")


@query("""SELECT b.s_suppkey AS video_id, min(a.s_suppkey) AS base_id FROM supplier b LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) a ON a.s_nationkey = b.s_nationkey WHERE b.s_suppkey % 2 = 1 GROUP BY 1""")
def j13_video_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("video_id"), F.col("s_nationkey").alias("height"), F.lit(7).alias("width"), F.lit(1).alias("channels"))
    return matching.video_map(v.where("video_id % 2 = 1"), v.where("video_id % 2 = 0"), "shape").select("video_id", "base_id")


@query("""WITH v AS (SELECT page_id, page_id // 2 AS pair, CASE WHEN page_id % 2 = 0 THEN '/data/' ELSE 'D:\\mnt\\' END AS root FROM pages)
SELECT b.page_id AS video_id, CASE WHEN b.page_id % 4 = 1 THEN a.page_id END AS base_id, CASE WHEN b.page_id % 4 = 1 THEN 'leaf' END AS stage FROM v b JOIN v a ON a.pair = b.pair AND a.page_id % 2 = 0 WHERE b.page_id % 2 = 1""")
def j13_video_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of videos under different roots; of every second pair the heights differ, so it can't match."""
    pair = F.floor(F.col("page_id") / 2).cast("string")
    name = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/data/s"), pair, F.lit("/v.mp4"))).otherwise(F.concat(F.lit("D:\\mnt\\s"), pair, F.lit("\\v.mp4")))
    v = V.table(spark, sf_dir, "pages").select(F.col("page_id").alias("video_id"), F.array(name).alias("filenames"), F.lit(10).alias("n_frames"), F.when(F.col("page_id") % 4 == 3, 9).otherwise(8).alias("height"), F.lit(8).alias("width"), F.lit(None).cast("array<int>").alias("crop"))
    return matching.video_map(v.where("video_id % 2 = 1"), v.where("video_id % 2 = 0"))


@query("""SELECT page_id, CASE WHEN p LIKE '%/de/%' THEN 1 ELSE 2 END AS pos, CASE WHEN p LIKE '%/de/%' THEN p ELSE 'L:/proj/' || regexp_extract(p, '[^/]+$') END AS candidate FROM (SELECT page_id, '/data' || regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '^[a-z]+://[^/]*(/.*?)/?$', 1) AS p FROM pages)""")
def j23_first_existing_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates against a listing of files: German pages lie where they say, all others in one folder."""
    stored = V.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/data"), F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://[^/]*(/.*?)/?$", 1)).alias("p"))
    there = stored.select(F.when(F.col("p").contains("/de/"), F.col("p")).otherwise(F.concat(F.lit("L:/proj/"), paths.basename(F.col("p")))).alias("candidate")).distinct()
    tries = stored.select("page_id", F.posexplode(F.array(F.col("p"), F.concat(F.lit("L:/proj/"), paths.basename(F.col("p"))))).alias("pos", "candidate"))
    hit = tries.join(there, "candidate", "left_semi").groupBy("page_id").agg(F.min("pos").alias("pos"), F.min_by("candidate", "pos").alias("candidate"))
    return hit.select("page_id", big(F.col("pos") + 1, "pos"), "candidate")


_COLS = "video_id, frame_idx, instance_id, 'self' AS source"


def _merged(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    out, _ = merge.merge_instances(a, b, FRAME, strategy, OVERLAP)
    return out.select(*FRAME, "instance_id", "source", big(F.col("step"), "step"))


@query(f"""{BOTH}, {MATCHES}, {BEST}, t AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx, ai ORDER BY bo) AS turn FROM best)
SELECT video_id, frame_idx, instance_id, 'self' AS source, 0 AS step FROM inst_a WHERE NOT is_predicted UNION ALL SELECT b.video_id, b.frame_idx, b.instance_id, 'other', 1 FROM inst_b b LEFT JOIN t ON t.bi = b.instance_id WHERE t.bi IS NULL OR (t.ap AND t.turn = 1)
UNION ALL SELECT video_id, frame_idx, instance_id, 'self', 2 FROM inst_a WHERE is_predicted AND instance_id NOT IN (SELECT ai FROM best)""")
def m01_merge_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "auto")


@query(f"{BOTH}, {MATCHES}, {BEST} SELECT video_id, frame_idx, ai AS self_id, bi AS other_id, CASE WHEN bp THEN 'kept_user' ELSE 'kept_original' END AS resolution FROM best WHERE NOT ap")
def m11_merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    _, conflicts = merge.merge_instances(a, b, FRAME, "auto", OVERLAP)
    return conflicts.select(*FRAME, F.col("a_instance_id").alias("self_id"), F.col("b_instance_id").alias("other_id"), "resolution")


@query(f"{BOTH} SELECT {_COLS}, 0 AS step FROM inst_a")
def m02_merge_keep_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "keep_original")


@query(f"{BOTH} SELECT video_id, frame_idx, instance_id, 'other' AS source, 1 AS step FROM inst_b")
def m02_merge_keep_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "keep_new")


@query(f"{BOTH} SELECT {_COLS}, 0 AS step FROM inst_a UNION ALL SELECT video_id, frame_idx, instance_id, 'other', 1 FROM inst_b")
def m02_merge_keep_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "keep_both")


@query(f"{BOTH} SELECT {_COLS}, 0 AS step FROM inst_a WHERE NOT is_predicted UNION ALL SELECT video_id, frame_idx, instance_id, 'other', 1 FROM inst_b WHERE is_predicted")
def m02_merge_replace_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "replace_predictions")


@query(f"""{BOTH}, {MATCHES}, last AS (SELECT ai, arg_max(bo, bo) AS t, arg_max(bt, bo) AS s FROM m GROUP BY 1)
SELECT video_id, frame_idx, instance_id, CASE WHEN ai IS NULL THEN user_id ELSE t END AS track_id, CASE WHEN ai IS NULL THEN tracking_score ELSE s END AS tracking_score FROM inst_a LEFT JOIN last ON ai = instance_id""")
def m02_merge_update_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    out, _ = merge.merge_instances(a, b, FRAME, "update_tracks", OVERLAP)
    return out.select(*FRAME, "instance_id", "track_id", "tracking_score")


@query("""WITH a AS (SELECT o_custkey AS v, o_orderkey // 4 AS f, bool_or(o_orderstatus = 'P') AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2), b AS (SELECT o_custkey AS v, o_orderkey // 4 AS f, bool_or(o_orderstatus = 'P') AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2)
SELECT v AS video_id, f AS frame_idx, a.n IS NOT NULL AS in_base, b.n IS NOT NULL AS in_other, (coalesce(a.n, false) OR coalesce(b.n, false)) AS negative FROM a FULL JOIN b USING (v, f)""")
def p22_merged_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("video_id"), F.floor(F.col("o_orderkey") / 4).cast("bigint").alias("frame_idx"), (F.col("o_orderstatus") == "P").alias("is_negative"))
    out = merge.merge_frames(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"))
    none = F.lit(False)
    return out.select("video_id", "frame_idx", "in_base", "in_other", merge.negative_after(F.coalesce("base_negative", none), F.coalesce("other_negative", none), none).alias("negative"))


@query("""WITH b AS (SELECT DISTINCT conv_id % 3 AS v, turn AS f FROM conversations WHERE conv_id % 2 = 0), o AS (SELECT DISTINCT conv_id % 3 AS v, turn AS f FROM conversations WHERE conv_id % 2 = 1)
SELECT v AS video_id, f AS frame_idx, 'base' AS grp FROM b UNION ALL SELECT v, f, 'default' FROM o WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.v = o.v AND b.f = o.f)""")
def u08_suggestion_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") % 3).alias("video_id"), F.col("turn").alias("frame_idx"))
    base = c.where("conv_id % 2 = 0").select("video_id", "frame_idx").distinct().select("*", F.lit("base").alias("grp"), F.lit("{}").alias("metadata"), F.lit(0).cast("bigint").alias("ord"))
    other = c.where("conv_id % 2 = 1").select("video_id", "frame_idx", F.col("conv_id").alias("ord"))
    return merge.merge_suggestions(base, other).select("video_id", "frame_idx", "grp")
