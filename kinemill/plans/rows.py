"""Queries of expressions and joins on single rows: numbers, texts, colours, masks, geometries, paths, poses of a video."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import colors as C
from ..functions import formats as T
from ..functions import geometry as G
from ..functions import masks as M
from ..functions import paths
from ..functions import points as P
from ..functions import skeletons as S
from ..operators import annotations, matching, videos
from . import pose_view as V
from .poses import CTE, big, r6
from .registry import query

# ---- Numbers and texts --------------------------------------------------------------------------------------


@query("SELECT s_suppkey, CAST(round_even(s_suppkey / 2, 0) AS BIGINT) AS whole, CAST(round_even(-s_suppkey / 2, 0) AS BIGINT) AS minus FROM supplier")
def f23e_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.col("s_suppkey") / 2
    return V.table(spark, sf_dir, "supplier").select("s_suppkey", T.half_even(half).alias("whole"), T.half_even(-half).alias("minus"))


@query("""WITH c AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text || ', "' || role || '"' ELSE text || chr(10) || role END AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN contains(t, ',') OR contains(t, '"') OR contains(t, chr(10)) OR contains(t, chr(13)) THEN '"' || replace(t, '"', '""') || '"' ELSE coalesce(t, '') END AS cell FROM c""")
def f32_csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, text, role = (F.col(c) for c in ("turn", "text", "role"))
    t = F.when(turn % 3 == 0, text).when(turn % 3 == 1, F.concat(text, F.lit(', "'), role, F.lit('"'))).otherwise(F.concat(text, F.lit("\n"), role))
    return V.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.csv_cell(t).alias("cell"))


@query("""WITH s AS (SELECT o_orderkey AS i, CAST((2654435769 + CAST(o_orderkey + 1 AS HUGEINT) * 1831565813) % 4294967296 AS BIGINT) AS u FROM orders),
a AS (SELECT i, CAST(CAST(xor(u, u >> 15) AS HUGEINT) * CAST(u | 1 AS HUGEINT) % 4294967296 AS BIGINT) AS t FROM s),
b AS (SELECT i, xor(t, CAST((t + CAST(xor(t, t >> 7) AS HUGEINT) * CAST(t | 61 AS HUGEINT)) % 4294967296 AS BIGINT)) AS t FROM a)
SELECT i, xor(t, t >> 14) / 4294967296.0::DOUBLE AS number FROM b""")
def t03b_random_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number of the seeded splits' generator for each order, by the order's key."""
    return V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), A.random_number(F.col("o_orderkey")).alias("number"))


@query("SELECT p_partkey, [0, 217, 237, 126, 119, 77, 162][p_partkey % 7 + 1] AS red, [114, 83, 177, 47, 172, 190, 20][p_partkey % 7 + 1] AS green, [189, 25, 32, 142, 48, 238, 47][p_partkey % 7 + 1] AS blue, CASE WHEN p_size % 3 = 0 THEN 'track' WHEN p_size > 1 THEN 'instance' ELSE 'node' END AS scheme FROM part")
def f27b_palette_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = C.cycle(F.col("p_partkey"))
    return V.table(spark, sf_dir, "part").select("p_partkey", *(F.get(rgb, F.lit(i)).alias(c) for i, c in enumerate(("red", "green", "blue"))), C.scheme(F.col("p_size") % 3 == 0, F.col("p_size")).alias("scheme"))


@query("SELECT p_partkey, CAST(greatest(0, least(255, floor(p_size * 5 * (1 - p_partkey % 11 / 10) + 255 * (p_partkey % 11 / 10)))) AS BIGINT) AS value FROM part")
def f28_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.col("p_partkey") % 11 / 10
    return V.table(spark, sf_dir, "part").select("p_partkey", big(C.blend(F.col("p_size") * 5, F.lit(255), share), "value"))


@query("""WITH p AS (SELECT p_partkey, 396 + p_size * 4 AS status, p_size % 10 AS attempt FROM part) SELECT p_partkey, CASE WHEN status IN (401, 403) THEN 'access denied' WHEN status = 404 THEN 'not found' WHEN status = 429 THEN 'too many requests' WHEN status >= 500 THEN 'server error' ELSE 'status ' || status END AS message,
status IN (429, 500, 502, 503, 504) AS again, CAST(least(200 * pow(2, attempt), 30000) AS BIGINT) AS wait_ms, least(attempt * 1000 * 5, 30000) AS header_ms FROM p""")
def r08_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an HTTP status says, whether a request is repeated, and after which time."""
    p = V.table(spark, sf_dir, "part").select("p_partkey", (396 + F.col("p_size") * 4).alias("status"), (F.col("p_size") % 10).alias("attempt"))
    return p.select("p_partkey", T.status_text(F.col("status")).alias("message"), paths.retryable(F.col("status")).alias("again"), paths.backoff_ms(F.col("attempt")).alias("wait_ms"), paths.retry_after_ms((F.col("attempt") * 5).cast("string")).alias("header_ms"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END, coalesce(CASE WHEN o_custkey % 2 = 0 THEN o_custkey END, 0) + o_orderkey) AS t, o_custkey + o_orderkey % 1000 / 1000 + o_custkey % 1000 / 1000000 AS stamp FROM orders")
def f30b_sample_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of samples, and recording stamps of seconds, milliseconds and microseconds."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    t = A.sample_time(F.when(o % 3 > 0, F.col("o_totalprice").cast("double")), F.when(c % 2 == 0, c.cast("double")), o)
    return V.table(spark, sf_dir, "orders").select("o_orderkey", t.alias("t"), T.seq_seconds(c, o % 1000, c % 1000).alias("stamp"))


@query("""WITH o AS (SELECT o_custkey AS id, list(o_orderkey) AS keys FROM orders GROUP BY 1), n AS (SELECT id, CASE WHEN id % 3 = 0 THEN id % 50 WHEN id % 3 = 1 THEN id % 20 END AS d, list_max(keys) + 1 AS m FROM o) SELECT id, CASE WHEN greatest(coalesce(d, 7), m) > 0 THEN greatest(coalesce(d, 7), m) END AS n_frames FROM n""")
def f39_frame_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list("o_orderkey").alias("keys"))
    declared = F.when(F.col("id") % 3 == 0, F.col("id") % 50).when(F.col("id") % 3 == 1, F.col("id") % 20)
    return o.select("id", T.frame_count(declared, F.lit(7).cast("bigint"), F.col("keys")).alias("n_frames"))


@query("""WITH o AS (SELECT o_custkey AS id, list_sort(list(o_orderkey)) AS keys FROM orders GROUP BY 1) SELECT id, unnest(CASE WHEN id % 2 = 0 THEN keys ELSE [k * 2 for k in keys] END) AS frame FROM o""")
def x09_embedded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared frame numbers of every second video; of the others, the keys of the frame map."""
    keys = F.array_sort(F.collect_list("o_orderkey"))
    o = V.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(keys.alias("keys"))
    twice = F.transform("keys", lambda k: k * 2)
    declared = F.when(F.col("id") % 2 == 0, F.col("keys"))
    return o.select("id", F.explode(videos.embedded_frames(declared, F.map_from_arrays(twice, "keys"))).alias("frame"))


@query("WITH p AS (SELECT page_id, lower(hex(url)) || repeat('00', page_id % 4) AS raw, page_id % 90 AS n FROM pages) SELECT page_id, CASE WHEN page_id % 2 = 0 AND n <= length(raw) / 2 THEN left(raw, CAST(n * 2 AS INT)) ELSE regexp_replace(raw, '(?:00)+$', '') END AS cut FROM p")
def x28b_trimmed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    raw = F.concat(F.lower(F.hex(F.encode("url", "UTF-8"))), F.repeat(F.lit("00"), (n % 4).cast("int")))
    return V.table(spark, sf_dir, "pages").select("page_id", A.trim_padding(raw, F.when(n % 2 == 0, n % 90)).alias("cut"))


@query("SELECT page_id, ['centroid', 'bounding_box_center', 'anchor_node'][page_id % 3 + 1] AS source FROM pages")
def f26_centroid_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("centroid", "boundingBoxCenter", "anchorNode")))
    return V.table(spark, sf_dir, "pages").select("page_id", T.centroid_source(F.get(names, (F.col("page_id") % 3).cast("int"))).alias("source"))


# ---- Geometries and masks -----------------------------------------------------------------------------------


@query(f"WITH {V.BOXES} SELECT frame_id, round((x2 - x1) * (y2 - y1), 6) AS area, round(x1, 6) AS min_x, round(y2, 6) AS max_y FROM bx")
def f10_exploded_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of each frame as one MultiPolygon, a feature for each part."""
    ring = G.box_ring(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    many = V.boxes(spark, sf_dir).groupBy("frame_id").agg(F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.collect_list(F.array(ring)).alias("coordinates"))).alias("geometry"))
    rings = many.select("frame_id", F.explode(G.parts_of(F.col("geometry"))).alias("part")).withColumn("rings", G.rings_of(F.col("part")))
    at = G.polygon_bounds(F.col("rings"))
    return rings.select("frame_id", r6(G.polygon_area(F.col("rings")), "area"), r6(at["min_x"], "min_x"), r6(at["max_y"], "max_y"))


_PIXELS = "SELECT l_orderkey AS id, list(l_linenumber % 4 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS data FROM lineitem GROUP BY 1"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(place)), lambda s: (s["l_linenumber"] % 4).cast("int")).alias("data"))


@query(f"WITH d AS ({_PIXELS}), e AS (SELECT id, data, unnest(generate_series(0, 7)) AS pos FROM d) SELECT id, pos, data[CAST(floor(pos % 4 * len(data) / 4) AS INT) + 1] AS v FROM e")
def f15b_resampled_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of one row as masks of two rows of four pixels."""
    n = F.size("data")
    out = _pixels(spark, sf_dir).select("id", F.posexplode(M.resize(F.col("data"), F.lit(1), n, F.lit(2), F.lit(4))).alias("pos", "v"))
    return out.select("id", big(F.col("pos"), "pos"), big(F.col("v"), "v"))


@query(f"WITH d AS ({_PIXELS}), e AS (SELECT id, unnest(data) AS v, unnest(generate_series(0, len(data) - 1)) AS pos FROM d) SELECT id, pos, CAST(v IN (1, 3) AS INT) AS bit FROM e")
def p21_label_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of two labels of each label image."""
    out = _pixels(spark, sf_dir).select("id", F.posexplode(M.label_mask(F.col("data"), F.array(F.lit(1), F.lit(3)))).alias("pos", "bit"))
    return out.select("id", big(F.col("pos"), "pos"), big(F.col("bit"), "bit"))


@query("SELECT p_partkey AS mask_id, round(p_partkey % 7 / 2 + 3, 6) AS min_x, round((p_partkey % 7 + p_size) / 2 + 3, 6) AS max_x, 4.0 AS min_y, 5.0 AS max_y, p_partkey AS from_predicted, false AS is_predicted FROM part WHERE p_partkey % 2 = 1")
def f17_mask_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in image space of predicted masks made user masks; a mask is one run of its first row."""
    lead = F.col("p_partkey") % 7
    rows = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mask_id"), (F.col("p_partkey") % 2 == 1).alias("is_predicted"), F.array(lead, F.col("p_size").cast("bigint"), 1000 - lead - F.col("p_size")).alias("rle"))
    at = M.to_image(M.bounds(F.col("rle"), F.lit(1000)), F.array(F.lit(2.0), F.lit(1.0)), F.array(F.lit(3.0), F.lit(4.0)))
    own = annotations.user_mask(rows).withColumn("at", at)
    return own.select("mask_id", *(r6(F.col(f"at.{c}"), c) for c in ("min_x", "max_x", "min_y", "max_y")), "from_predicted", "is_predicted")


@query(f"WITH {V.BOXES} SELECT bbox_id, x1 <= 20 AND 20 < x2 AND y1 <= 8 AND 8 < y2 AS inside FROM bx")
def f16c_point_in_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a place is within each box; of the edges, the left and the upper one are."""
    ring = G.box_ring(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    return V.boxes(spark, sf_dir).select("bbox_id", G.contains(ring, F.lit(20.0), F.lit(8.0)).alias("inside"))


@query("WITH p AS (SELECT p_partkey, [[p_size % 5, p_partkey % 5], [1, 2], [3, p_size % 4 + 1]] AS e FROM part), u AS (SELECT p_partkey, unnest(e) AS e FROM p) SELECT p_partkey, e[1] - 1 AS src, e[2] - 1 AS dst FROM u WHERE e[1] BETWEEN 1 AND 3 AND e[2] BETWEEN 1 AND 3")
def x20_category_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a category of three nodes; those out of range go."""
    pair = lambda a, b: F.array(a.cast("int"), b.cast("int"))
    e = F.array(pair(F.col("p_size") % 5, F.col("p_partkey") % 5), pair(F.lit(1), F.lit(2)), pair(F.lit(3), F.col("p_size") % 4 + 1))
    out = V.table(spark, sf_dir, "part").select("p_partkey", F.explode(T.coco_edges(e, F.lit(3))).alias("e"))
    return out.select("p_partkey", big(F.col("e.src"), "src"), big(F.col("e.dst"), "dst"))


# ---- Skeletons, poses and videos ----------------------------------------------------------------------------


@query(f"WITH {V.sql()}, {V.SKELETONS} SELECT a.skeleton_id, len(list_intersect(a.nodes, b.nodes)) AS n_common, len(a.nodes) - len(list_intersect(a.nodes, b.nodes)) AS self_only, len(b.nodes) - len(list_intersect(a.nodes, b.nodes)) AS other_only, a.nodes = b.nodes AS same, list_has_all(a.nodes, b.nodes) AS holds FROM sk a JOIN sk b ON b.skeleton_id = a.skeleton_id + 1")
def u07_node_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node names of each skeleton against the next one's: shared, lone, equal, and whether it holds the other's."""
    sk = V.skeletons(spark, sf_dir)
    two = sk.select("skeleton_id", F.col("nodes").alias("a")).join(sk.select((F.col("skeleton_id") - 1).alias("skeleton_id"), F.col("nodes").alias("b")), "skeleton_id")
    a, b = F.col("a"), F.col("b")
    sim = S.similarity(a, b)
    holds = S.matches(b, a, "subset")
    return two.select("skeleton_id", *(big(sim[c], c) for c in ("n_common", "self_only", "other_only")), (holds & S.matches(a, b, "subset")).alias("same"), holds.alias("holds"))


@query(f"WITH {V.sql()}, {V.SKELETONS}, f AS (SELECT nodes, min(skeleton_id) AS b FROM sk WHERE skeleton_id % 3 = 0 GROUP BY 1), c AS (SELECT nodes, min(skeleton_id) AS k FROM sk WHERE skeleton_id % 3 > 0 GROUP BY 1) SELECT skeleton_id, coalesce(b, k + 1000000) AS new_skeleton, b IS NULL AND k = skeleton_id AS is_new FROM sk JOIN c USING (nodes) LEFT JOIN f USING (nodes) WHERE skeleton_id % 3 > 0")
def u04_register_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    sk = V.skeletons(spark, sf_dir)
    return matching.skeleton_map(sk.where("skeleton_id % 3 > 0"), sk.where("skeleton_id % 3 = 0"), 1_000_000).select("skeleton_id", "new_skeleton", "is_new")


@query(f"{CTE}, i AS (SELECT *, is_predicted OR video_id = 1 AS p FROM inst) SELECT instance_id, video_id, frame_idx FROM i WHERE NOT p OR video_id NOT IN (SELECT video_id FROM i WHERE NOT p)")
def x07_compared_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances that a comparison takes: predictions only of the video that has nothing else."""
    inst = V.instances(spark, sf_dir).withColumn("is_predicted", F.col("is_predicted") | (F.col("video_id") == 1))
    return videos.compared_instances(inst).select("instance_id", "video_id", "frame_idx")


@query("SELECT DISTINCT a.user_id, a.event_type FROM events a JOIN events b ON a.user_id = b.user_id AND a.value = b.value AND a.event_type = b.event_type AND a.event_id % 2 = 0 AND b.event_id % 2 = 1")
def x08_frames_with_identical_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct(F.col("value").alias("x"), F.col("value").alias("y"), F.lit(True).alias("visible"))
    ev = V.events(spark, sf_dir).select(F.col("event_id").alias("instance_id"), "user_id", "event_type", F.array(at).alias("points"))
    return matching.identical_poses(ev.where("instance_id % 2 = 0"), ev.where("instance_id % 2 = 1"), ["user_id", "event_type"]).select("user_id", "event_type").distinct()


@query("SELECT page_id // 3 AS video_id, bool_and(page_id % 7 <> 0) AS \"exists\", 4 AS n_parts FROM pages GROUP BY 1")
def x04_existing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image lists of three files, of which every seventh is missing; and the number of parts of the first one's path, of which the root is one."""
    name = F.concat(F.lit("/d//s\\"), F.col("page_id").cast("string"), F.lit(".png"))
    pages = V.table(spark, sf_dir, "pages").select("page_id", name.alias("path"))
    v = pages.groupBy(F.floor(F.col("page_id") / 3).cast("bigint").alias("video_id")).agg(F.collect_list("path").alias("filenames"))
    there = videos.existing(v, pages.where("page_id % 7 <> 0").select("path"))
    return there.join(v, "video_id").select("video_id", "exists", big(F.size(videos.root_parts(F.col("filenames"))), "n_parts"))


@query("SELECT page_id AS folder_id, CASE WHEN page_id % 2 = 0 THEN page_id END AS video_id FROM pages")
def x22c_source_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of labelled frames with the video of the same stem, if there is one."""
    n = F.col("page_id").cast("string")
    pages = V.table(spark, sf_dir, "pages")
    folders = pages.select(F.col("page_id").alias("folder_id"), T.stem(F.concat(F.lit("p/labeled-data/cam."), n)).alias("own"), F.concat(F.lit("cam."), n).alias("stem"))
    shown = pages.where("page_id % 2 = 0").select(F.col("page_id").alias("video_id"), T.stem(F.concat(F.lit("D:\\v\\cam."), n, F.lit(".mp4"))).alias("stem"))
    return folders.join(shown, "stem", "left").select("folder_id", "video_id")


@query("WITH d AS (SELECT p_partkey, unnest([0, 1, 2]) AS node FROM part) SELECT p_partkey, node, CASE WHEN (p_partkey + node) % 4 > 0 THEN p_partkey + node END AS x, (p_partkey + node) % 4 > 0 AS visible FROM d")
def x12_rows_to_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two numbers as points; what has no place isn't visible."""
    k = F.col("p_partkey")
    row = lambda i: F.array(F.when((k + i) % 4 > 0, (k + i).cast("double")), F.lit(1.0))
    out = V.table(spark, sf_dir, "part").select("p_partkey", F.posexplode(P.from_rows(F.array(*(row(i) for i in range(3))), False)).alias("node", "p"))
    return out.select("p_partkey", big(F.col("node"), "node"), "p.x", F.col("p.visible").alias("visible"))
