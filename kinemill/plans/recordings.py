"""Queries of recordings: cells, samples and tensors are made from the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import recordings as R
from . import pose_view as V
from .poses import big, r6
from .registry import query

_SLOTS = """WITH e AS (SELECT event_id, event_id // 4 AS frame_idx, event_id % 4 AS slot, user_id % 5 - 1 AS pose_id, event_id // 4 % 5 AS n_instances, value FROM events),
c AS (SELECT *, value * 2 - n AS x, value + n AS y, CASE WHEN event_id % 11 = 0 THEN 0 ELSE (event_id % 7 + n * 2) % 4 / 10 END AS s FROM e, (SELECT unnest([0, 1, 2]) AS n)),
i AS (SELECT frame_idx, slot, pose_id, n_instances, round(avg(s), 6) AS score, count(*) AS n_points, round(sum(x), 6) AS sum_x, round(sum(y), 6) AS sum_y FROM c WHERE s > 0 GROUP BY ALL)
SELECT f.frame_idx, slot, track, score, n_points, sum_x, sum_y FROM (SELECT DISTINCT frame_idx FROM e) f LEFT JOIN (SELECT *, {track} AS track FROM i WHERE {used}) u ON u.frame_idx = f.frame_idx"""


def _slots(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """Four events are a frame, each a slot of three nodes; frames without an instance stay."""
    k = F.col("event_id")
    e = V.table(spark, sf_dir, "events").select(k, F.floor(k / 4).alias("frame_idx"), (k % 4).alias("slot"), (F.col("user_id") % 5 - 1).alias("pose_id"), "value")
    slots = e.select("frame_idx", "slot", "pose_id", (F.col("frame_idx") % 5).alias("n_instances"))
    n = F.col("node_idx")
    nodes = e.select("event_id", "frame_idx", "slot", "value", F.explode(F.array(*map(F.lit, range(3)))).alias("node_idx"))
    cells = nodes.select("frame_idx", "slot", "node_idx", (F.col("value") * 2 - n).alias("x"), (F.col("value") + n).alias("y"), F.when(k % 11 == 0, 0.0).otherwise((k % 7 + n * 2) % 4 / 10).alias("confidence"))
    out = R.pose_file_instances(cells, 3, version, slots)
    return e.select("frame_idx").distinct().join(out, "frame_idx", "left").select("frame_idx", "slot", "track", r6(F.col("score"), "score"), *_sums())


def _sums() -> list:
    p = F.col("points")
    total = lambda c: r6(F.aggregate(F.filter(p, lambda q: q[c].isNotNull()), F.lit(0.0), lambda a, q: a + q[c]), f"sum_{c}")
    return [big(F.when(p.isNotNull(), F.size(F.filter(p, lambda q: q["x"].isNotNull()))), "n_points"), total("x"), total("y")]


@query(_SLOTS.format(track="'1'", used="slot = 0"))
def s39_pose_file_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(spark, sf_dir, 2)


@query(_SLOTS.format(track="CAST(pose_id AS VARCHAR)", used="slot < n_instances"))
def s39_pose_file_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(spark, sf_dir, 3)


@query(_SLOTS.format(track="CAST(pose_id AS VARCHAR)", used="pose_id > 0"))
def s39_pose_file_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(spark, sf_dir, 5)


@query("""WITH s AS (SELECT user_id, event_type AS node, event_id, CASE WHEN event_id % 6 > 0 THEN value END AS x, event_id % 1000 AS y, CASE WHEN user_id % 2 = 0 THEN event_id // 4 * 2 + 5.0 ELSE epoch_us(ts) / 3600000000 END AS t FROM events),
d AS (SELECT DISTINCT user_id, t FROM s), f AS (SELECT user_id, count(DISTINCT floor(t + 0.5)) = count(DISTINCT t) AS free FROM d GROUP BY 1),
l AS (SELECT user_id, t, CAST(CASE WHEN free THEN floor(t + 0.5) ELSE dense_rank() OVER (PARTITION BY user_id ORDER BY t) - 1 END AS BIGINT) AS frame_idx FROM d JOIN f USING (user_id)),
p AS (SELECT s.user_id, frame_idx, node, x, y FROM s JOIN l ON l.user_id = s.user_id AND l.t = s.t QUALIFY row_number() OVER (PARTITION BY s.user_id, frame_idx, node ORDER BY event_id DESC) = 1)
SELECT CAST(user_id AS VARCHAR) AS track, frame_idx, count(x) AS n_points, round(sum(x), 6) AS sum_x, round(sum(y), 6) AS sum_y FROM p GROUP BY ALL HAVING count(x) > 0""")
def s32_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user is a track and each event type a series; the times of even users start at 5, those of odd ones are hours."""
    k, even = F.col("event_id"), F.col("user_id") % 2 == 0
    e = V.table(spark, sf_dir, "events")
    node = F.array_position(F.array(*map(F.lit, V.NODES)), F.col("event_type")).cast("int") - 1
    i = F.when(even, F.floor(k / 4) * 2).otherwise(k)  # the samples of an even user have no stamp
    samples = e.select(F.col("user_id").cast("string").alias("track"), node.alias("node_idx"), i.alias("i"), k.alias("event_id"), F.when(k % 6 > 0, F.col("value")).otherwise(F.lit(float("nan"))).alias("x"), (k % 1000).cast("double").alias("y"), F.lit(None).cast("double").alias("confidence"), F.when(~even, V.micros() / 3_600_000_000).alias("timestamp"), F.lit(5.0).alias("start"))
    last = samples.groupBy("track", "node_idx", "i").agg(F.max_by(F.struct("x", "y", "confidence", "timestamp", "start"), "event_id").alias("s")).select("track", "node_idx", "i", "s.*")
    return R.series_instances(last, len(V.NODES)).select("track", "frame_idx", *_sums())


@query("""WITH e AS (SELECT event_id, event_id // 6 AS frame_idx, event_id // 3 % 2 AS track_idx, CASE WHEN event_id // 3 % 5 > 0 AND event_id % 5 > 1 THEN value END AS x, CASE WHEN event_id // 3 % 5 > 0 AND event_id % 5 > 0 THEN value + 1 END AS y FROM events)
SELECT frame_idx, track_idx, CASE WHEN frame_idx % 2 = 0 THEN 0.0 ELSE frame_idx % 10 / 10 END AS score, CASE WHEN frame_idx % 3 > 0 THEN track_idx + 0.5 END AS tracking_score, count(x) AS n_points, coalesce(round(sum(x), 6), 0.0) AS sum_x, coalesce(round(sum(y), 6), 0.0) AS sum_y FROM e GROUP BY frame_idx, track_idx HAVING count(x) + count(y) > 0""")
def s28_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six events are a frame of two tracks with three nodes; some coordinates, tracks and scores are unknown."""
    k, nan = F.col("event_id"), F.lit(float("nan"))
    slot = F.floor(k / 3)
    e = V.table(spark, sf_dir, "events").select(F.floor(k / 6).alias("frame_idx"), (slot % 2).alias("track_idx"), (k % 3).alias("node_idx"), F.when((slot % 5 > 0) & (k % 5 > 1), F.col("value")).otherwise(nan).alias("x"), F.when((slot % 5 > 0) & (k % 5 > 0), F.col("value") + 1).otherwise(nan).alias("y"), (k % 10 / 10).alias("score"))
    f = F.col("frame_idx")
    scores = e.select("frame_idx", "track_idx").distinct().where("frame_idx % 6 > 0").select("frame_idx", "track_idx", F.when(f % 2 == 0, nan).otherwise(f % 10 / 10).alias("score"), F.when(f % 3 > 0, F.col("track_idx") + 0.5).otherwise(nan).alias("tracking_score"))
    return R.tensor_instances(e, scores, 3).select("frame_idx", "track_idx", "score", "tracking_score", *_sums())


@query("SELECT p_partkey AS id, n AS node_idx, CASE WHEN n < 2 AND (p_partkey + n) % 3 > 0 THEN CAST(p_size + n AS DOUBLE) END AS x, CASE WHEN n < 2 THEN CAST(p_size AS DOUBLE) END AS y, n < 2 AND (p_partkey + n) % 3 > 0 AS inferred, n < 1 AND p_partkey % 2 = 1 AS told FROM part, (SELECT unnest([0, 1, 2]) AS n)")
def x24_annotation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of three nodes whose locations hold two, and whose visibility holds one."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    x = [F.when((k + n) % 3 > 0, size + n).otherwise(F.lit(float("nan"))) for n in range(2)]
    flat = F.array(x[0], size, x[1], size)
    both = F.arrays_zip(R.annotation_points(flat, None, 3).alias("a"), R.annotation_points(flat, F.array(k % 2), 3).alias("b"))
    out = V.table(spark, sf_dir, "part").select(k.alias("id"), F.posexplode(both).alias("node_idx", "p"))
    return out.select("id", big(F.col("node_idx"), "node_idx"), "p.a.x", "p.a.y", F.col("p.a.visible").alias("inferred"), F.col("p.b.visible").alias("told"))
