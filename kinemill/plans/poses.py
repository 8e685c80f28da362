"""Queries of selections, reductions and windows over poses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import points as P
from ..operators import aggregates, select, windows
from . import pose_view as V
from .registry import query

CTE = f"WITH {V.sql()}"


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def big(c, name: str):
    return c.cast("bigint").alias(name)


@query("SELECT user_id % 3 AS video_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS frame_idx, max(event_id) AS frame_id FROM events GROUP BY 1, 2")
def p01_find_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = V.events(spark, sf_dir).select(F.col("event_id").alias("frame_id"), (F.col("user_id") % 3).alias("video_id"), "frame_idx")
    return select.last_frames(ev)


@query("SELECT event_id AS frame_id, user_id % 3 AS video_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS frame_idx FROM events WHERE user_id % 3 = 1 AND date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) = 5 QUALIFY row_number() OVER (ORDER BY event_id DESC) = 1")
def p02_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = V.events(spark, sf_dir).select(F.col("event_id").alias("frame_id"), (F.col("user_id") % 3).alias("video_id"), "frame_idx")
    return select.find(ev, 1, 5)


@query(f"WITH {V.BOXES} SELECT bbox_id, frame_id, category, track_id FROM bx SEMI JOIN orders ON o_orderkey = frame_id AND o_orderkey % 3 = 1 WHERE category = 'R' AND NOT is_predicted")
def p05_get_bboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.annotations(V.boxes(spark, sf_dir), V.box_frames(spark, sf_dir), video_id=1, category="R", predicted=False).select("bbox_id", "frame_id", "category", "track_id")


@query("SELECT DISTINCT l_orderkey AS label_image_id FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = 'A') AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey = 5)")
def p07_get_label_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("label_image_id"), F.col("l_returnflag").alias("category"), F.col("l_suppkey").alias("track_id"))
    return select.label_images(objects.select("label_image_id").distinct(), objects, category="A", track_id=5)


@query(f"""{CTE}, kinds AS (SELECT frame_id, frame_idx, 0 AS k, 'centroid' AS kind, user_id AS ord FROM inst WHERE user_id = 4 AND n_vis > 0 UNION ALL SELECT frame_id, frame_idx, 1, 'bbox', user_id FROM inst WHERE user_id = 4 AND n_vis > 0 UNION ALL SELECT frame_id, frame_idx, 2, 'instance', user_id FROM inst WHERE user_id = 4)
SELECT frame_id, frame_idx, kind, ord, row_number() OVER (ORDER BY frame_idx, frame_id, k, ord) AS rank FROM kinds WHERE frame_id % 10 = 1""")
def p08_track_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    inst = V.instances(spark, sf_dir)
    shown = select.nonempty(inst)
    return select.track_annotations(V.frames(spark, sf_dir), {"centroid": shown, "bbox": shown, "instance": inst}, 1, 4).select("frame_id", "frame_idx", "kind", "ord", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT o_orderkey AS frame_id, (o_orderstatus = 'P' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus <> 'F')) AS is_user_labeled FROM orders")
def p13_user_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.user_labeled(V.box_frames(spark, sf_dir), [V.boxes(spark, sf_dir)]).select("frame_id", "is_user_labeled")


@query(f"{CTE} SELECT instance_id, n_vis AS n_visible FROM inst WHERE n_vis > 0")
def p14_nonempty_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.nonempty(V.instances(spark, sf_dir)).select("instance_id", big(P.n_visible("points"), "n_visible"))


@query(f"{CTE} SELECT inst.instance_id, pts.x AS by_name, pts.x AS by_index, pts.s AS score FROM inst LEFT JOIN pts ON pts.frame_idx = inst.frame_idx AND pts.user_id = inst.user_id AND pts.node = 'purchase'")
def p16_get_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = F.array(*map(F.lit, V.NODES))
    by_name, by_index = P.get_point("points", "purchase", nodes), P.get_point("points", 2)
    return V.instances(spark, sf_dir).select("instance_id", by_name["x"].alias("by_name"), by_index["x"].alias("by_index"), by_index["score"].alias("score"))


@query(f"{CTE} SELECT inst.instance_id, pts.node, CASE WHEN vis THEN x END AS x, CASE WHEN vis THEN y END AS y, CASE WHEN vis THEN s END AS score FROM inst JOIN pts USING (frame_idx, user_id)")
def p17_masked_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.instances(spark, sf_dir).select("instance_id", F.arrays_zip(F.array(*map(F.lit, V.NODES)).alias("node"), P.masked("points", True).alias("m"), F.col("points").alias("p")).alias("z"))
    return rows.select("instance_id", F.explode("z").alias("z")).where("z.p.x is not null").select("instance_id", "z.node", F.col("z.m")[0].alias("x"), F.col("z.m")[1].alias("y"), F.col("z.m")[2].alias("score"))


@query(f"{CTE} SELECT video_id, is_predicted, count(*) AS n FROM inst WHERE NOT is_predicted GROUP BY ALL")
def p18_without_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.without_predictions(V.instances(spark, sf_dir)).groupBy("video_id", "is_predicted").agg(F.count("*").alias("n"))


@query(f"{CTE} SELECT instance_id, round(cx, 6) AS cx, round(cy, 6) AS cy FROM inst")
def a01_instance_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.centroid("points")
    return V.instances(spark, sf_dir).select("instance_id", r6(c["x"], "cx"), r6(c["y"], "cy"))


@query(f"{CTE} SELECT instance_id, min_x, min_y, max_x, max_y FROM inst")
def a02_instance_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.instances(spark, sf_dir).select("instance_id", P.bounding_box("points").alias("b")).select("instance_id", "b.min_x", "b.min_y", "b.max_x", "b.max_y")


@query(f"{CTE} SELECT instance_id, round(cx, 6) AS mass_x, round((min_x + max_x) / 2, 6) AS box_x, round((min_y + max_y) / 2, 6) AS box_y FROM inst WHERE n_vis > 0")
def a03_centroid_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = select.nonempty(V.instances(spark, sf_dir))
    mass, box = P.center("points", "center_of_mass"), P.center("points", "bbox_center")
    return shown.select("instance_id", r6(mass["x"], "mass_x"), r6(box["x"], "box_x"), r6(box["y"], "box_y"))


@query(f"{CTE} SELECT video_id, max(greatest(u, p)) AS max_instances FROM (SELECT video_id, frame_id, count(*) FILTER (is_predicted) AS p, count(*) FILTER (NOT is_predicted) AS u FROM inst GROUP BY ALL) GROUP BY video_id")
def a08_max_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.max_instances(V.instances(spark, sf_dir).drop("video_id", "frame_idx"), V.frames(spark, sf_dir))


@query(f"{CTE}, total AS (SELECT video_id, count(DISTINCT frame_idx) AS t FROM inst GROUP BY 1) SELECT video_id, user_id AS track_id, count(DISTINCT frame_idx) AS n_present, any_value(t) AS n_frames, round(count(DISTINCT frame_idx) / any_value(t), 6) AS share FROM inst JOIN total USING (video_id) GROUP BY video_id, user_id HAVING count(DISTINCT frame_idx) / any_value(t) >= 0.5")
def a10_track_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.occupancy(V.instances(spark, sf_dir).drop("video_id", "frame_idx"), V.frames(spark, sf_dir), 0.5)
    return out.select("video_id", "track_id", "n_present", "n_frames", r6(F.col("share"), "share"))


@query(f"""{CTE}, total AS (SELECT video_id, count(DISTINCT frame_idx) AS t FROM inst GROUP BY 1), kept AS (SELECT user_id FROM inst JOIN total USING (video_id) GROUP BY video_id, user_id HAVING count(DISTINCT frame_idx) / any_value(t) >= 0.9)
SELECT video_id, inst.frame_idx, inst.user_id AS track_id, node, x, y, s AS point_score, score AS instance_score, tracking_score FROM inst JOIN pts ON pts.frame_idx = inst.frame_idx AND pts.user_id = inst.user_id WHERE inst.user_id IN (SELECT user_id FROM kept)""")
def a10_analysis_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aggregates.analysis_rows(V.instances(spark, sf_dir).drop("video_id", "frame_idx"), V.frames(spark, sf_dir), 0.9).where("x is not null")
    return rows.select("video_id", "frame_idx", "track_id", F.get(F.array(*map(F.lit, V.NODES)), F.col("node_idx")).alias("node"), "x", "y", "point_score", "instance_score", "tracking_score")


@query(f"{CTE} SELECT instance_id, row_number() OVER (PARTITION BY frame_id ORDER BY is_predicted, user_id) - 1 AS slot FROM inst")
def a11_untracked_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.slot_untracked(V.instances(spark, sf_dir).withColumn("track_id", F.lit(None).cast("bigint"))).select("instance_id", "slot")


@query(f"""{CTE}, tr AS (SELECT DISTINCT video_id, user_id FROM inst), dom AS (SELECT video_id, f.frame_idx, user_id, node FROM tr, (SELECT unnest(generate_series(0, 29)) AS frame_idx) f, (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS node) n)
SELECT video_id, frame_idx, user_id AS track_id, node, x, y FROM dom LEFT JOIN pts USING (frame_idx, user_id, node)""")
def a12_dense_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    inst, frames = V.instances(spark, sf_dir), V.frames(spark, sf_dir)
    tracks = inst.select("video_id", "track_id").distinct()
    sizes = tracks.select("video_id").distinct().withColumn("n_frames", F.lit(30).cast("bigint"))
    out = aggregates.dense_tensor(inst.drop("video_id", "frame_idx"), frames, tracks, len(V.NODES), sizes)
    return out.select("video_id", "frame_idx", "track_id", F.get(F.array(*map(F.lit, V.NODES)), F.col("node_idx").cast("int")).alias("node"), "x", "y")


@query("""WITH t AS (SELECT user_id, epoch_us(ts) / 1000000 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events), d AS (SELECT user_id, s - lag(s) OVER (PARTITION BY user_id ORDER BY s) AS d FROM t WHERE n <= 100), m AS (SELECT user_id, median(d) AS m FROM d WHERE d IS NOT NULL GROUP BY 1)
SELECT u.user_id, round(CASE WHEN r >= 1 THEN r ELSE 25.0 END, 6) AS fps FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, 1 / avg(d) AS r FROM d JOIN m USING (user_id) WHERE abs(d - m) < 1000 GROUP BY 1) USING (user_id)""")
def a13_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamps = V.table(spark, sf_dir, "events").select("user_id", (V.micros() / 1_000_000).alias("s"))
    return windows.frames_per_second(stamps, "user_id", "s", F.lit(25.0), tolerance=1000.0).select("user_id", r6(F.col("fps"), "fps"))


@query(f"""{CTE}, c AS (SELECT video_id, user_id, frame_idx, cx, cy FROM inst WHERE n_vis > 0)
SELECT a.user_id AS track_id, a.frame_idx, count(b.cx) AS n_points, round(sum(b.cx), 4) AS sum_x, round(sum(b.cy), 4) AS sum_y FROM inst a JOIN c b ON a.user_id = b.user_id AND b.frame_idx BETWEEN a.frame_idx - 5 AND a.frame_idx GROUP BY 1, 2""")
def w01_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.centroid("points")
    places = V.instances(spark, sf_dir).select("video_id", "track_id", "frame_idx", c["x"].alias("x"), c["y"].alias("y"))
    return windows.trails(places, 5, ["video_id", "track_id"]).select("track_id", "frame_idx", "n_points", F.round("sum_x", 4).alias("sum_x"), F.round("sum_y", 4).alias("sum_y"))


@query(f"""{CTE}, p AS (SELECT user_id, frame_idx, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY user_id) - 1 AS n FROM pts WHERE node = 'view' WINDOW w AS (PARTITION BY user_id ORDER BY frame_idx))
SELECT user_id AS track_id, frame_idx, x, y, x2, y2, round(greatest((k + 1) / n, 0.05), 6) AS alpha FROM p WHERE k < n""")
def w03_trail_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.get_point("points", 4)
    places = V.instances(spark, sf_dir).select("track_id", "frame_idx", p["x"].alias("x"), p["y"].alias("y")).where("x is not null")
    return windows.segments(places, ["track_id"]).select("track_id", "frame_idx", "x", "y", "x2", "y2", r6(F.col("alpha"), "alpha"))


@query(f"{CTE} SELECT instance_id, CAST(sum(n) OVER (ORDER BY instance_id ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS point_start, CAST(sum(n) OVER (ORDER BY instance_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS point_end FROM inst")
def w04_running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.instances(spark, sf_dir).select("instance_id", F.size(F.filter("points", P.has_x)).alias("n"))
    return windows.running_offsets(rows, "instance_id", "n", 16).select("instance_id", F.col("start").alias("point_start"), F.col("end").alias("point_end"))


@query("""SELECT s_nationkey AS nation, row_number() OVER (ORDER BY min(s_suppkey)) AS label_id FROM supplier GROUP BY 1""")
def w07_first_appearance_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.first_appearance_ids(V.table(spark, sf_dir, "supplier"), "s_nationkey", ["s_suppkey"])
    return out.select(big(F.col("s_nationkey"), "nation"), big(F.col("label_id"), "label_id"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'R' AS INT) AS bit, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i FROM lineitem), c AS (SELECT *, CAST(bit <> coalesce(lag(bit) OVER (PARTITION BY l_orderkey ORDER BY i), 0) AS INT) AS ch FROM b), r AS (SELECT *, sum(ch) OVER (PARTITION BY l_orderkey ORDER BY i) AS run FROM c)
SELECT l_orderkey AS mask_id, CAST(run AS BIGINT) AS run, min(i) AS start, count(*) AS length FROM r GROUP BY 1, 2""")
def w08_rle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mask_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("place"), (F.col("l_returnflag") == "R").cast("int").alias("bit"))
    return windows.runs(bits, ["mask_id"], "place", "bit").select("mask_id", big(F.col("run"), "run"), "start", "length")


@query("""SELECT o_custkey AS video_id, o_orderkey AS frame_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS frame_idx FROM orders""")
def w11_positional_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.positional_rank(V.table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return out.select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("frame_id"), "frame_idx")


@query("""WITH t AS (SELECT DISTINCT user_id, epoch_us(ts) / 3600000000 AS h FROM events), f AS (SELECT user_id, count(DISTINCT floor(h + 0.5)) = count(DISTINCT h) AS free FROM t GROUP BY 1)
SELECT user_id, round(h, 6) AS h, CAST(CASE WHEN free THEN floor(h + 0.5) ELSE dense_rank() OVER (PARTITION BY user_id ORDER BY h) - 1 END AS BIGINT) AS frame_idx FROM t JOIN f USING (user_id)""")
def j20_time_to_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = V.table(spark, sf_dir, "events").select("user_id", (V.micros() / 3_600_000_000).alias("h")).distinct()
    return windows.time_to_frame(times, "user_id", "h").select("user_id", r6(F.col("h"), "h"), "frame_idx")


@query(f"""{CTE}, a AS (SELECT video_id, user_id AS track_id, frame_idx, CASE WHEN is_predicted THEN score END AS "instance.score", max(x) FILTER (node = 'click') AS "click.x", max(y) FILTER (node = 'click') AS "click.y", max(s) FILTER (node = 'click' AND is_predicted) AS "click.score", max(x) FILTER (node = 'view') AS "view.x", max(s) FILTER (node = 'view' AND is_predicted) AS "view.score" FROM inst JOIN pts USING (frame_idx, user_id) GROUP BY ALL)
SELECT * FROM a UNION ALL SELECT v, NULL, f, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT unnest([0, 1, 2]) AS v), (SELECT unnest(generate_series(0, 34)) AS f) WHERE NOT EXISTS (SELECT 1 FROM inst WHERE inst.video_id = v AND inst.frame_idx = f)""")
def s42_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = V.frames(spark, sf_dir)
    sizes = spark.range(3).select(F.col("id").alias("video_id"), F.lit(35).cast("bigint").alias("n_frames"))
    out = aggregates.csv_rows(V.instances(spark, sf_dir).drop("video_id", "frame_idx"), frames, V.NODES, sizes)
    return out.select("video_id", "track_id", "frame_idx", "`instance.score`", "`click.x`", "`click.y`", "`click.score`", "`view.x`", "`view.score`")


@query("""WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey FROM n WHERE n <= 4 OR r IN (0, n // 4, 2 * n // 4, 3 * n // 4)""")
def t05_even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.even_sample(V.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 4)


@query("SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS pos, o_orderkey % 3 AS video_id, o_orderkey AS frame_idx, o_orderkey AS frame_id FROM orders")
def t01_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a request, in the order of its price."""
    orders = V.table(spark, sf_dir, "orders").select("o_orderkey", (-F.col("o_totalprice")).alias("lead"))
    request = windows.global_rank(orders, "lead", ["o_orderkey"], "pos").select("pos", (F.col("o_orderkey") % 3).alias("video_id"), F.col("o_orderkey").alias("frame_idx"))
    return select.extract(V.box_frames(spark, sf_dir), request).select("pos", "video_id", "frame_idx", "frame_id")


@query("SELECT count(*) AS n, CAST(trunc(count(*) * 0.8) AS BIGINT) AS n_first, count(*) - CAST(trunc(count(*) * 0.8) AS BIGINT) AS n_second, CAST(0 AS BIGINT) AS n_both FROM orders")
def t03_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = select.split(V.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.8)
    return out.agg(F.count("*").alias("n"), F.count_if("in_first").alias("n_first"), F.count_if("in_second").alias("n_second"), F.count_if(F.col("in_first") & F.col("in_second")).alias("n_both"))


@query("SELECT n_nationkey AS id, row_number() OVER (ORDER BY coalesce(r_regionkey, 0), n_nationkey) AS rank FROM nation LEFT JOIN region ON r_regionkey = n_regionkey")
def t02_source_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("name"), F.col("n_nationkey").alias("ord"))
    source = V.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("name"), F.col("r_regionkey").alias("ord"))
    return select.by_source_order(rows, source).select(big(F.col("n_nationkey"), "id"), big(F.col("rank"), "rank"))
