"""A pose dataset over the driver's tables: the same rows in Spark and, as common table expressions, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = ["click", "error", "purchase", "signup", "view"]
N_VIDEOS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros() -> Column:
    """Microseconds of ``ts`` since 1970, whatever the session's time zone."""
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type", "ts", day.alias("frame_idx"), F.get_json_object("props", "$.k").cast("double").alias("k"))


def instances(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    """One pose for each user and day: a node is an event type, its place the last event of that type."""
    ev = events(spark, sf_dir)
    ev = ev if where is None else ev.where(where)
    own = []
    for n in NODES:
        at = F.when(F.col("event_type") == n, F.col("event_id"))
        k = F.max_by("k", at) / 100
        own.append(F.struct(F.max_by("value", at).alias("x"), (F.max(at) % 1000).cast("double").alias("y"), F.coalesce(k >= 0.2, F.lit(False)).alias("visible"), F.lit(False).alias("complete"), k.alias("score")))
    per = ev.groupBy("frame_idx", "user_id").agg(F.array(*own).alias("points"))
    user = F.col("user_id")
    return per.select(
        (F.col("frame_idx") * 100000 + user).alias("instance_id"), (F.col("frame_idx") * 10 + user % N_VIDEOS).alias("frame_id"), (user % N_VIDEOS).alias("video_id"), "frame_idx", user.cast("int").alias("ord"), (user % 2 == 1).alias("is_predicted"),
        F.lit(0).cast("bigint").alias("skeleton_id"), user.alias("track_id"), F.lit(None).cast("bigint").alias("from_predicted"), (user / 1000).alias("score"), (F.col("frame_idx") / 10).alias("tracking_score"), "points",
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).select(F.col("frame_idx"), (F.col("user_id") % N_VIDEOS).alias("video_id")).distinct()
    return ev.select((F.col("frame_idx") * 10 + F.col("video_id")).alias("frame_id"), "video_id", "frame_idx", (F.col("frame_idx") % 7 == 3).alias("is_negative"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes; an order is a frame."""
    q, d, n, t = (F.col(c) for c in ("l_quantity", "l_discount", "l_linenumber", "l_tax"))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + n).alias("bbox_id"), F.col("l_orderkey").alias("frame_id"), (F.col("l_orderkey") % N_VIDEOS).alias("video_id"), n.alias("ord"), (F.col("l_linestatus") == "F").alias("is_predicted"), q.alias("x1"), (d * 100).alias("y1"), (q + n * 10).alias("x2"), (d * 100 + t * 100 + 5).alias("y2"),
        (n / 10).alias("angle"), F.col("l_returnflag").alias("category"), F.col("l_suppkey").alias("track_id"), F.col("l_partkey").alias("instance_id"),
    )


def box_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_id"), (F.col("o_orderkey") % N_VIDEOS).alias("video_id"), F.col("o_orderkey").alias("frame_idx"), (F.col("o_orderstatus") == "P").alias("is_negative"))


def skeletons(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    """The event types of each user and week as a skeleton; each node is linked to the next."""
    ev = events(spark, sf_dir)
    ev = ev if where is None else ev.where(where)
    per = ev.groupBy("user_id", F.floor(F.col("frame_idx") / 7).cast("bigint").alias("week")).agg(F.array_sort(F.collect_set("event_type")).alias("nodes"))
    n = F.size("nodes")
    edges = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(i.alias("src"), (i + 1).alias("dst")))).otherwise(F.array().cast("array<struct<src:int,dst:int>>"))
    return per.select((F.col("user_id") * 10 + F.col("week")).alias("skeleton_id"), "nodes", edges.alias("edges"), F.array().cast("array<struct<a:int,b:int>>").alias("symmetries"))


def sql(where: str = "true", name: str = "") -> str:
    """ev, pts (one row a point) and inst (one row a pose), with ``name`` after each."""
    return f"""
ev{name} AS (SELECT event_id, user_id, value, event_type, ts, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS frame_idx, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
pts{name} AS (SELECT frame_idx, user_id, event_type AS node, arg_max(value, event_id) AS x, CAST(max(event_id) % 1000 AS DOUBLE) AS y, arg_max(k, event_id) / 100 AS s, arg_max(k, event_id) / 100 >= 0.2 AS vis FROM ev{name} WHERE {where} GROUP BY 1, 2, 3),
inst{name} AS (SELECT frame_idx, user_id, user_id % 3 AS video_id, frame_idx * 10 + user_id % 3 AS frame_id, frame_idx * 100000 + user_id AS instance_id, user_id % 2 = 1 AS is_predicted, user_id / 1000 AS score, frame_idx / 10 AS tracking_score,
  min(x) FILTER (vis) AS min_x, max(x) FILTER (vis) AS max_x, min(y) FILTER (vis) AS min_y, max(y) FILTER (vis) AS max_y, avg(x) FILTER (vis) AS cx, avg(y) FILTER (vis) AS cy, count(*) FILTER (vis) AS n_vis, count(*) AS n
  FROM pts{name} GROUP BY frame_idx, user_id)"""


BOXES = """
bx AS (SELECT l_orderkey * 10 + l_linenumber AS bbox_id, l_orderkey AS frame_id, l_orderkey % 3 AS video_id, l_linenumber AS ord, l_linestatus = 'F' AS is_predicted, l_quantity AS x1, l_discount * 100 AS y1, l_quantity + l_linenumber * 10 AS x2, l_discount * 100 + l_tax * 100 + 5 AS y2,
  l_linenumber / 10 AS angle, l_returnflag AS category, l_suppkey AS track_id, l_partkey AS instance_id FROM lineitem)"""

SKELETONS = """
sk AS (SELECT user_id * 10 + frame_idx // 7 AS skeleton_id, list_sort(list(DISTINCT event_type)) AS nodes FROM ev GROUP BY user_id, frame_idx // 7)"""
