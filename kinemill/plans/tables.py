"""Queries of dataset maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import skeletons as S
from ..operators import lifecycle
from . import pose_view as V
from .registry import query


@query("SELECT o_orderkey AS frame_id, o_orderkey % 3 AS video_id FROM orders WHERE o_orderstatus = 'P' OR o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def m04_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.clean_frames(V.box_frames(spark, sf_dir), [V.boxes(spark, sf_dir)]).select("frame_id", "video_id")


@query("SELECT s_suppkey AS track_id, s_name AS name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_linestatus <> 'F' AND l_returnflag = 'R')")
def m05_used_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks that are left once predictions and other categories are gone."""
    tracks = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("track_id"), F.col("s_name").alias("name"))
    return lifecycle.used(tracks, "track_id", [V.boxes(spark, sf_dir).where("not is_predicted and category = 'R'")])


@query("SELECT n_nationkey AS frame_id, CASE n_regionkey WHEN 1 THEN 101 WHEN 3 THEN 103 ELSE n_regionkey END AS video_id FROM nation")
def m07_replace_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("frame_id"), F.col("n_regionkey").cast("bigint").alias("video_id"))
    new = V.table(spark, sf_dir, "region").where("r_regionkey in (1, 3)").select(F.col("r_regionkey").cast("bigint").alias("video_id"), (F.col("r_regionkey") + 100).cast("bigint").alias("new_id"))
    return lifecycle.replace_videos(rows, new).select("frame_id", "video_id")


@query("SELECT l_orderkey AS frame_id, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 2) GROUP BY 1")
def j18_remove_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.createDataFrame([(2,)], "video_id long")
    kept = lifecycle.remove_videos({"frames": V.box_frames(spark, sf_dir), "bboxes": V.boxes(spark, sf_dir).drop("video_id")}, gone)
    return kept["bboxes"].groupBy("frame_id").agg(F.count("*").alias("n"))


@query(f"WITH {V.sql()}, {V.SKELETONS} SELECT skeleton_id, min(skeleton_id) OVER (PARTITION BY nodes) AS canonical_id FROM sk")
def u05_dedup_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.dedup_skeletons(V.skeletons(spark, sf_dir))


@query("SELECT c_custkey AS track_id, c_name AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT min(c_custkey), c_name FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0 GROUP BY 2")
def u01_register_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("track_id"), F.col("c_name").alias("name"))
    return lifecycle.register(t.where("track_id % 2 = 0"), t.where("track_id % 3 = 0"), "name")


@query("SELECT o_orderkey AS frame_id, o_orderstatus AS status FROM orders WHERE o_orderkey % 5 < 3")
def s24_append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping parts of a table: rows whose key is there already are skipped."""
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_id"), F.col("o_orderstatus").alias("status"))
    return lifecycle.append_new(o.where("frame_id % 5 < 2"), o.where("frame_id % 5 in (1, 2)"), ["frame_id"])


@query("SELECT o_orderkey AS frame_id, CASE WHEN o_orderkey % 5 IN (1, 2) THEN 'new' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 5 < 3")
def s24_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_id"), F.col("o_orderstatus").alias("status"))
    return lifecycle.overlay(o.where("frame_id % 5 < 2"), o.where("frame_id % 5 in (1, 2)").withColumn("status", F.lit("new")), ["frame_id"])


@query("SELECT event_id AS instance_id, CASE WHEN event_id % 7 <> 0 AND event_id > 2 AND (event_id - 2) % 2 = 1 THEN event_id - 2 END AS from_predicted FROM events")
def j04_from_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    inst = V.events(spark, sf_dir).select(e.alias("instance_id"), e.alias("frame_id"), (e % 2 == 1).alias("is_predicted"), F.when((e % 7 != 0) & (e > 2), e - 2).alias("from_predicted"))
    return lifecycle.resolve_from_predicted(inst).select("instance_id", "from_predicted")


@query("SELECT event_id + 1000000 AS instance_id, CASE WHEN event_id % 5 = 1 AND event_id > 1 THEN event_id + 999999 END AS from_predicted FROM events")
def m09_relink(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    inst = V.events(spark, sf_dir).select(e.alias("instance_id"), F.when((e % 5 == 1) & (e > 1), e - 1).alias("from_predicted"))
    return lifecycle.relink(inst, inst.select(F.col("instance_id").alias("old_id"), (F.col("instance_id") + 1000000).alias("new_id"))).select("instance_id", "from_predicted")


@query("WITH a AS (SELECT s_nationkey AS id, list(DISTINCT s_suppkey % 10) AS f FROM supplier GROUP BY 1), b AS (SELECT c_nationkey AS id, list(DISTINCT c_custkey % 13) AS f FROM customer GROUP BY 1) SELECT a.id, len(list_distinct(list_concat(a.f, coalesce(b.f, [])))) AS n FROM a LEFT JOIN b USING (id)")
def u09_merge_image_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image lists joined by basename: folders don't count."""
    a = V.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("bigint").alias("id")).agg(F.collect_set(F.concat(F.lit("/a/"), (F.col("s_suppkey") % 10).cast("string"))).alias("filenames"))
    b = V.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("id")).agg(F.collect_set(F.concat(F.lit("C:\\b\\"), (F.col("c_custkey") % 13).cast("string"))).alias("filenames"))
    return lifecycle.merge_image_lists(a, b).select("id", F.size("filenames").cast("bigint").alias("n"))


@query(f"WITH {V.sql()}, {V.SKELETONS} SELECT count(DISTINCT nodes) AS n_signatures FROM sk")
def a22_skeleton_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    sk = V.skeletons(spark, sf_dir)
    return sk.agg(F.countDistinct(S.signature(F.col("nodes"), F.col("edges"), F.col("symmetries"), F.lit(None).cast("string"))).alias("n_signatures"))
