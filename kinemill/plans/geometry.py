"""Queries of boxes, polygons, masks, paths, URLs and colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colors, masks, paths
from ..functions import geometry as G
from ..functions import points as P
from ..functions import raster as R
from ..operators import aggregates
from . import pose_view as V
from .poses import big, r6
from .registry import query

XY = ("x1", "y1", "x2", "y2")


def _xy():
    return [F.col(c) for c in XY]


@query(f"""WITH {V.BOXES} SELECT bbox_id, round(x2 - x1, 6) AS w, round(y2 - y1, 6) AS h, round(abs(x2 - x1) * abs(y2 - y1), 6) AS area, round((x1 + x2) / 2 + (x1 - (x1 + x2) / 2) * cos(angle) - (y1 - (y1 + y2) / 2) * sin(angle), 5) AS cx0, round((y1 + y2) / 2 + (x1 - (x1 + x2) / 2) * sin(angle) + (y1 - (y1 + y2) / 2) * cos(angle), 5) AS cy0,
round((x1 + x2) / 2 + abs((x2 - x1) / 2 * cos(angle)) + abs((y2 - y1) / 2 * sin(angle)), 5) AS aabb_max_x FROM bx""")
def f04_bbox_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.boxes(spark, sf_dir).withColumn("c", G.corners(*_xy(), F.col("angle"))).withColumn("b", G.xywh(*_xy()))
    return b.select("bbox_id", r6(F.col("b.w"), "w"), r6(F.col("b.h"), "h"), r6(G.box_area(*_xy()), "area"), F.round(F.col("c")[0][0], 5).alias("cx0"), F.round(F.col("c")[0][1], 5).alias("cy0"), F.round(G.ring_bounds(F.col("c"))["max_x"], 5).alias("aabb_max_x"))


@query(f"""WITH {V.BOXES} SELECT bbox_id, round((x2 - x1) * (y2 - y1), 6) AS area, round((x2 - x1) * (y2 - y1) * 0.75, 6) AS holed_area, round((x1 + x2) / 2, 6) AS cx, true AS is_box, true AS inside FROM bx""")
def f06_polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, bounds centre, box test and containment of boxes as polygons, with and without a hole of half the size."""
    x1, y1, x2, y2 = _xy()
    ring = G.box_ring(x1, y1, x2, y2)
    hole = G.box_ring(x1 + (x2 - x1) / 4, y1 + (y2 - y1) / 4, x2 - (x2 - x1) / 4, y2 - (y2 - y1) / 4)
    b = V.boxes(spark, sf_dir).withColumn("r", F.array(ring)).withColumn("h", F.array(ring, hole))
    center = G.bounds_center(G.polygon_bounds(F.col("r")))
    return b.select("bbox_id", r6(G.polygon_area(F.col("r")), "area"), r6(G.polygon_area(F.col("h")), "holed_area"), r6(center["x"], "cx"), G.is_box(F.col("r")).alias("is_box"), G.contains(F.col("r")[0], (x1 + x2) / 2, (y1 + y2) / 2).alias("inside"))


@query(f"WITH {V.sql()} SELECT inst.instance_id, node, round(x - 10.5, 6) AS cropped_x, round(y - 20.25, 6) AS cropped_y, round(x, 6) AS back_x FROM inst JOIN pts USING (frame_idx, user_id)")
def f19_crop_uncrop(spark: SparkSession, sf_dir: str) -> DataFrame:
    inst = V.instances(spark, sf_dir).withColumn("c", P.crop("points", 10.5, 20.25)).withColumn("b", P.uncrop("c", 10.5, 20.25))
    z = inst.select("instance_id", F.explode(F.arrays_zip(F.array(*map(F.lit, V.NODES)).alias("node"), "c", "b")).alias("z")).where("z.c.x is not null")
    return z.select("instance_id", "z.node", r6(F.col("z.c.x"), "cropped_x"), r6(F.col("z.c.y"), "cropped_y"), r6(F.col("z.b.x"), "back_x"))


@query(f"WITH {V.sql()}, n AS (SELECT unnest(['view', 'nose', 'click']) AS node, unnest([0, 1, 2]) AS pos) SELECT inst.instance_id, n.pos, pts.x, coalesce(pts.vis, false) AS visible FROM inst, n LEFT JOIN pts ON pts.frame_idx = inst.frame_idx AND pts.user_id = inst.user_id AND pts.node = n.node")
def f34_remap_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.remap("points", F.array(*map(F.lit, V.NODES)), F.array(F.lit("view"), F.lit("nose"), F.lit("click")))
    return V.instances(spark, sf_dir).select("instance_id", F.posexplode(out).alias("pos", "p")).select("instance_id", big(F.col("pos"), "pos"), "p.x", "p.visible")


_BITS = "bits AS (SELECT l_orderkey AS mask_id, list(CAST(l_returnflag = 'R' AS INT) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS b FROM lineitem GROUP BY 1)"


@query(f"WITH {_BITS} SELECT mask_id, len(b) AS n, list_sum(b) AS area, list_sum(b) = 0 AS empty FROM bits")
def f14_rle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded to runs and back; area from the runs alone."""
    b = _bits(spark, sf_dir).withColumn("rle", masks.encode(F.col("b")))
    back = masks.decode(F.col("rle"))
    return b.select("mask_id", big(F.when(back == F.col("b"), F.size(back)), "n"), big(masks.area(F.col("rle")), "area"), masks.bounds(F.col("rle"), F.lit(4)).isNull().alias("empty"))


def _bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("bit"))
    per = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("mask_id")).agg(F.array_sort(F.collect_list(place)).alias("z"))
    return per.select("mask_id", F.transform("z", lambda s: s["bit"]).alias("b"))


@query(f"WITH {_BITS}, p AS (SELECT mask_id, unnest(b) AS v, unnest(generate_series(0, len(b) - 1)) AS i FROM bits) SELECT mask_id, min(i % 2) AS x, min(i // 2) AS y, max(i % 2) - min(i % 2) + 1 AS w, max(i // 2) - min(i // 2) + 1 AS h FROM p WHERE v = 1 GROUP BY 1")
def a06_mask_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _bits(spark, sf_dir).select("mask_id", masks.bounds(masks.encode(F.col("b")), F.lit(2)).alias("b")).where("b is not null")
    return out.select("mask_id", "b.x", "b.y", "b.w", "b.h")


@query("""WITH d AS (SELECT l_orderkey AS label_image_id, list(l_linenumber % 4 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS data FROM lineitem GROUP BY 1), p AS (SELECT label_image_id, unnest(data) AS label_id, unnest(generate_series(0, len(data) - 1)) AS i FROM d)
SELECT label_image_id, label_id, min(i % 3) AS x1, min(i // 3) AS y1, max(i % 3) + 1 AS x2, max(i // 3) + 1 AS y2, count(*) AS area FROM p WHERE label_id > 0 GROUP BY 1, 2""")
def a04_label_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    d = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("label_image_id")).agg(F.transform(F.array_sort(F.collect_list(place)), lambda s: s["l_linenumber"] % 4).alias("data"))
    out = aggregates.label_bounds(d.withColumn("width", F.lit(3)), "width")
    return out.select("label_image_id", *(big(F.col(c), c) for c in ("label_id", "x1", "y1", "x2", "y2", "area")))


@query("WITH d AS (SELECT l_orderkey AS label_image_id, list_sort(list_distinct(list(l_linenumber % 4))) AS ids FROM lineitem GROUP BY 1) SELECT * FROM (SELECT label_image_id, unnest(ids) AS label_id FROM d) WHERE label_id > 0")
def a05_label_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("label_image_id")).agg(F.collect_list(F.col("l_linenumber") % 4).alias("data"))
    return d.select("label_image_id", F.explode(masks.label_ids(F.col("data"))).alias("label_id")).select("label_image_id", big(F.col("label_id"), "label_id"))


@query(f"""WITH {V.BOXES} SELECT bbox_id, 93 AS wkb_bytes, CAST(greatest(0, least(64, ceil(x2)) - floor(x1)) * greatest(0, (SELECT count(*) FROM range(0, 64) t(y) WHERE y1 <= y + 0.5 AND y + 0.5 < y2)) AS BIGINT) AS area FROM bx""")
def f12_wkb_and_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as polygons through WKB and back, then scan-converted to a 64 x 64 mask."""
    b = V.boxes(spark, sf_dir).select("bbox_id", R.wkb_of_rings(F.array(G.box_ring(*_xy()))).alias("w"))
    b = b.withColumn("r", R.rle_of_rings(R.rings_of_wkb("w"), F.lit(64), F.lit(64)))
    return b.select("bbox_id", big(F.length("w"), "wkb_bytes"), masks.area(F.col("r")).alias("area"))


@query("SELECT l_orderkey * 10 + l_linenumber AS mask_id, CAST(floor(l_quantity / 5 + 1) * (l_linenumber + 1) AS DOUBLE) AS area, true AS same FROM lineitem")
def f16_mask_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangular masks traced to polygons: their area, and the mask that scan conversion gives back."""
    w, h = F.floor(F.col("l_quantity") / 5 + 1), F.col("l_linenumber") + 1
    ring = F.array(G.box_ring(F.lit(2.0), F.lit(1.0), w + 2.0, h + 1.0))
    m = V.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mask_id"), R.rle_of_rings(ring, F.lit(12), F.lit(16)).alias("r"))
    m = m.withColumn("g", R.polygons_of_rle("r", F.lit(12), F.lit(16)))
    return m.select("mask_id", R.area_of_polygons("g").alias("area"), (R.rle_of_polygons("g", F.lit(12), F.lit(16)) == F.col("r")).alias("same"))


_SAN = "CASE WHEN regexp_matches(p, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN p ELSE regexp_replace(regexp_replace(replace(p, '\\', '/'), '/{2,}', '/', 'g'), '(.)/$', '\\1') END"


@query(f"WITH t AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN replace(url, '/', '\\') ELSE regexp_replace(url, '^[a-z]+:', '') || '/' END AS p FROM pages) SELECT page_id, {_SAN} AS clean, regexp_extract({_SAN}, '[^/]*$') AS base, len(list_filter(string_split({_SAN}, '/'), lambda s: s <> '')) AS n_parts FROM t")
def f24_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    p = F.when(F.col("page_id") % 3 == 0, url).when(F.col("page_id") % 3 == 1, F.replace(url, F.lit("/"), F.lit("\\"))).otherwise(F.concat(F.regexp_replace(url, "^[a-z]+:", ""), F.lit("/")))
    t = V.table(spark, sf_dir, "pages").select("page_id", paths.sanitize(p).alias("clean"))
    return t.select("page_id", "clean", paths.basename(F.col("clean")).alias("base"), big(F.size(F.filter(F.split("clean", "/"), lambda s: s != "")), "n_parts"))


@query("SELECT page_id, regexp_replace(url, '^([a-z]+://)', '\\1***:***@') || CASE WHEN contains(url, '#') THEN '' ELSE CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'token=%2A%2A%2A&k=1' END AS safe, true AS is_url FROM pages")
def f25_redact_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs with user information and a token added, then redacted."""
    url = F.col("url")
    more = F.when(url.contains("#"), "").otherwise(F.concat(F.when(url.contains("?"), "&").otherwise("?"), F.lit("token=s3cr3t&k=1")))
    secret = F.concat(F.regexp_replace(url, "^([a-z]+://)", "$1me:pw@"), more)
    return V.table(spark, sf_dir, "pages").select("page_id", paths.redact(secret).alias("safe"), paths.is_url(secret).alias("is_url"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'id' || page_id WHEN 1 THEN 'f' || page_id END AS file_id FROM pages")
def f25_drive_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://drive.google.com/open?id=id"), n)).when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://drive.google.com/file/d/f"), n, F.lit("/view"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("https://drive.google.com/drive/folders/"), n)).otherwise(F.col("url"))
    return V.table(spark, sf_dir, "pages").select("page_id", paths.drive_id(url).alias("file_id"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN (p_partkey * 7) % 256 WHEN 1 THEN ((p_partkey % 16) * 17) WHEN 2 THEN [255, 0, 255, 128][(p_partkey // 4) % 4 + 1] ELSE p_partkey % 200 END AS r, CASE p_partkey % 4 WHEN 2 THEN [0, 255, 165, 128][(p_partkey // 4) % 4 + 1] ELSE 10 + CASE p_partkey % 4 WHEN 1 THEN 160 ELSE 0 END END AS g FROM part""")
def f27_color_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    two = lambda v: F.lpad(F.lower(F.hex(v)), 2, "0")
    names = F.array(*map(F.lit, ("red", "Green", " orange ", "gray")))
    c = F.when(k % 4 == 0, F.concat(F.lit("#"), two(k * 7 % 256), F.lit("0a"), F.lit("ff"))).when(k % 4 == 1, F.concat(F.lit("#"), F.lower(F.hex(k % 16)), F.lit("a0"))).when(k % 4 == 2, F.get(names, (F.floor(k / 4) % 4).cast("int"))).otherwise(F.concat(F.lit("rgb( "), (k % 200).cast("string"), F.lit(", 10 ,3)")))
    out = V.table(spark, sf_dir, "part").select("p_partkey", colors.resolve(c).alias("c"))
    return out.select("p_partkey", big(F.col("c")[0], "r"), big(F.col("c")[1], "g"))


@query("SELECT s_suppkey, round(cos(sqrt(x * x + 0.01 + 0.04)) + x * x / (x * x + 0.05) * (1 - cos(sqrt(x * x + 0.05))), 6) AS m00 FROM (SELECT s_suppkey, s_acctbal / 10000 AS x FROM supplier)")
def f20_rodrigues(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = G.rodrigues(F.array(F.col("s_acctbal") / 10000, F.lit(0.1), F.lit(0.2)))
    return V.table(spark, sf_dir, "supplier").select("s_suppkey", r6(m[0][0], "m00"))


@query("SELECT vec_id, 64 AS dim FROM embeddings")
def f38_embedding_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "embeddings").select("vec_id", big(F.size("embedding"), "dim"))
