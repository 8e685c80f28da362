"""Record linkage: skeletons, tracks, videos, instances and annotations.

A matcher is a gate and a score over the columns ``a_*`` and ``b_*``; pairs always meet by an equality (frame, name,
key or grid cell), never by a cross join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import points as P
from ..functions import skeletons as S


@dataclass(frozen=True)
class InstanceMatcher:
    """``spatial`` (every point within the threshold, in pixels), ``iou`` (at least the threshold), ``identity``."""

    method: str = "spatial"
    threshold: float = 5.0

    def gate(self) -> Column:
        a, b = F.col("a_points"), F.col("b_points")
        if self.method == "spatial":
            return P.same_pose(a, b, self.threshold)
        if self.method == "identity":
            return F.coalesce(F.col("a_track_id") == F.col("b_track_id"), F.lit(False))
        if self.method == "iou":
            a, b = F.col("a_box"), F.col("b_box")
            # plain comparisons first: boxes that don't overlap are most pairs
            apart = (a["min_x"] >= b["max_x"]) | (b["min_x"] >= a["max_x"]) | (a["min_y"] >= b["max_y"]) | (b["min_y"] >= a["max_y"])
            return F.coalesce(~apart & (P.iou(a, b) >= self.threshold), F.lit(False))
        raise ValueError(f"unknown method: {self.method}")

    def score(self) -> Column:
        a, b = F.col("a_points"), F.col("b_points")
        if self.method == "spatial":
            return P.nearness(a, b)
        if self.method == "iou":
            return F.coalesce(P.iou(F.col("a_box"), F.col("b_box")), F.lit(0.0))
        return F.lit(1.0)


SPATIAL = InstanceMatcher("spatial", 5.0)
IOU = InstanceMatcher("iou", 0.5)
IDENTITY = InstanceMatcher("identity", 5.0)


def _sided(df: DataFrame, side: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, *(F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in keys))


def instance_matches(a: DataFrame, b: DataFrame, keys: list[str], matcher: InstanceMatcher = SPATIAL) -> DataFrame:
    """All matching pairs of each frame (``keys``) with ``score``; not one to one.

    By identity the track is part of the join key, so a frame with many instances has no more pairs than matches. By
    overlap each instance's box is made once, before it meets others.
    """
    if matcher.method == "iou":
        a, b = (t.withColumn("box", P.bounding_box("points")) for t in (a, b))
    left, right = _sided(a, "a", keys), _sided(b, "b", keys)
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    if matcher.method == "identity":
        on.append(F.col("a_track_id") == F.col("b_track_id"))
    pairs = left.alias("l").join(right.alias("r"), on).select(*(F.col(f"l.{k}").alias(k) for k in keys), *(c for c in left.columns + right.columns if c not in keys))
    return pairs.where(matcher.gate()).withColumn("score", matcher.score())


def best_for_other(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Each incoming instance's best match: highest score, then the first."""
    w = Window.partitionBy(*keys, "b_instance_id").orderBy(F.col("score").desc(), "a_ord")
    return matches.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def identical_poses(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of identical poses in each frame: joined on a hash of the pose, then compared."""
    left, right = (_sided(t.withColumn("pose_key", P.pose_key("points")).where("pose_key is not null"), s, keys) for t, s in ((a, "a"), (b, "b")))
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [F.col("a_pose_key") == F.col("b_pose_key")]
    return left.alias("l").join(right.alias("r"), on).where(P.same_pose("a_points", "b_points")).select(*(F.col(f"l.{k}").alias(k) for k in keys), "a_instance_id", "b_instance_id")


def near_pairs(a: DataFrame, b: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Pairs of annotations (``x``, ``y``) within ``threshold`` of each other, with score 1 / (1 + distance).

    Both sides fall into grid cells as wide as the threshold; one side also looks into the eight cells around.
    """
    cell = lambda c: F.floor(F.col(c) / threshold)
    left = _sided(a.where("x is not null and y is not null").withColumn("cx", cell("x")).withColumn("cy", cell("y")), "a", keys)
    around = b.where("x is not null and y is not null").withColumn("cx", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: cell("x") + d))).withColumn("cy", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: cell("y") + d)))
    right = _sided(around, "b", keys)
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [F.col("a_cx") == F.col("b_cx"), F.col("a_cy") == F.col("b_cy")]
    d = F.sqrt(F.pow(F.col("a_x") - F.col("b_x"), 2) + F.pow(F.col("a_y") - F.col("b_y"), 2))
    out = left.alias("l").join(right.alias("r"), on).withColumn("distance", d).where(F.col("distance") <= threshold)
    return out.select(*(F.col(f"l.{k}").alias(k) for k in keys), *(c for c in left.columns + right.columns if c not in keys and c[2:] not in ("cx", "cy")), "distance", (1 / (1 + F.col("distance"))).alias("score"))


def link_pairs(a: DataFrame, b: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Pairs of which one was made from the other (``from_predicted``), in both directions; their score is infinite."""
    l, r = _sided(a, "a", keys).alias("l"), _sided(b, "b", keys).alias("r")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    pick = lambda d: d.select(*(F.col(f"l.{k}").alias(k) for k in keys), f"a_{id_col}", f"b_{id_col}", "a_ord", "b_ord", F.lit(float("inf")).alias("score"))
    return pick(l.join(r, [*on, F.col("a_from_predicted") == F.col(f"b_{id_col}")])).unionByName(pick(l.join(r, [*on, F.col("b_from_predicted") == F.col(f"a_{id_col}")])))


def greedy(matches: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one matches of each frame by descending score; ties by a_ord, then b_ord.

    Frames stream through a task in the order of their matches; it holds the ones taken of one frame.
    """
    cols = matches.select(*keys, "a_ord", "b_ord", "score")
    dealt = cols.repartition(*keys).sortWithinPartitions(*keys, F.col("score").desc(), "a_ord", "b_ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame, used_a, used_b = object(), set(), set()
        for batch in batches:
            keep = []
            for *own, a, b in zip(*(batch.column(c).to_pylist() for c in (*keys, "a_ord", "b_ord")), strict=True):
                if own != frame:
                    frame, used_a, used_b = own, set(), set()
                free = a not in used_a and b not in used_b
                if free:
                    used_a.add(a)
                    used_b.add(b)
                keep.append(free)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return dealt.mapInArrow(run, cols.schema)


def unused_predictions(instances: DataFrame, key: str = "frame_id") -> DataFrame:
    """Predictions that nothing uses: in a frame with any track, those without a track; else those that none comes from."""
    tracked = instances.where("track_id is not null").select(key).distinct().withColumn("__tracked", F.lit(True))
    sources = instances.where("from_predicted is not null").select(F.col("from_predicted").alias("instance_id")).distinct().withColumn("__source", F.lit(True))
    out = instances.where("is_predicted").join(tracked, key, "left").join(sources, "instance_id", "left")
    return out.where(F.when(F.col("__tracked"), F.col("track_id").isNull()).otherwise(F.col("__source").isNull())).drop("__tracked", "__source")


def skeleton_classes(skeletons: DataFrame, method: str = "structure") -> tuple[DataFrame, DataFrame]:
    """(members, classes): ``skeletons`` with ``class_id``, and one row (key, class_id, nodes) a class.

    Skeletons that ``method`` cannot tell apart are one class (the same key, or the same set of names), called by its
    least skeleton_id.
    """
    nodes = F.col("nodes")
    by_key = method in ("exact", "structure")
    key = S.structure_key(nodes, F.col("edges"), F.col("symmetries"), ordered=method == "exact") if by_key else F.to_json(F.array_sort(F.array_distinct(nodes)))
    keyed = skeletons.withColumn("key", key)
    classes = keyed.groupBy("key").agg(F.min("skeleton_id").alias("class_id"), F.min_by("nodes", "skeleton_id").alias("nodes"))
    return keyed.join(classes.select("key", "class_id"), "key"), classes


def class_pairs(a: DataFrame, b: DataFrame, method: str = "structure", least: float = 0.5) -> DataFrame:
    """Pairs of classes (a_class_id, b_class_id, a_nodes, b_nodes). Names meet through a shared node, so disjoint classes never meet.

    A skeleton without nodes is a subset of every one; an overlap of 0 or less, which every pair has, is an error.
    """
    if method == "overlap" and least <= 0:
        raise ValueError("every pair overlaps by that much")
    left, right = _sided(a, "a", []), _sided(b, "b", [])
    if method in ("exact", "structure"):
        return left.join(right, F.col("a_key") == F.col("b_key")).drop("a_key", "b_key")
    shared = left.withColumn("__n", F.explode("a_nodes")).join(right.withColumn("__m", F.explode("b_nodes")), F.col("__n") == F.col("__m"))
    met = shared.select("a_class_id", "b_class_id", "a_nodes", "b_nodes").distinct()
    met = met.where(S.matches(F.col("a_nodes"), F.col("b_nodes"), method, least))
    if method == "subset":  # of classes by names, one at most has none
        empty = left.where(F.size("a_nodes") == 0).select(F.lit(1).alias("__k"), "a_class_id", "a_nodes")
        met = met.unionByName(empty.join(right.withColumn("__k", F.lit(1)), "__k").select("a_class_id", "b_class_id", "a_nodes", "b_nodes"))
    return met


def skeleton_matches(a: DataFrame, b: DataFrame, method: str = "structure", least: float = 0.5) -> DataFrame:
    """Pairs of skeletons: the pairs of their classes, spelt out. ``class_pairs`` and the members say the same in fewer rows."""
    (left, a_classes), (right, b_classes) = skeleton_classes(a, method), skeleton_classes(b, method)
    met = class_pairs(a_classes, b_classes, method, least).select("a_class_id", "b_class_id")
    return met.join(_sided(left, "a", []), "a_class_id").join(_sided(right, "b", []), "b_class_id")


def first_match(incoming: DataFrame, base: DataFrame, on: str, id_col: str, ord_: str) -> DataFrame:
    """incoming with ``base_id``: the first row of base with the same ``on``, or NULL."""
    first = base.groupBy(on).agg(F.min_by(id_col, ord_).alias("base_id"))
    return incoming.join(first, on, "left")


def track_map(incoming: DataFrame, base: DataFrame, method: str = "identity") -> DataFrame:
    """(track_id, base_id, is_new): by ``name`` or by ``identity``; unmatched names that repeat fall together.

    A track without a name (or identity) matches none and stays a track of its own.
    """
    on = "name" if method == "name" else "track_uid"
    found = first_match(incoming, base.where(F.col(on).isNotNull()), on, "track_id", "ord")
    canon = incoming.where(F.col(on).isNotNull()).groupBy(on).agg(F.min("track_id").alias("__canon"))
    out = found.join(canon, on, "left")
    return out.select("track_id", on, F.coalesce("base_id", "__canon", "track_id").alias("base_id"), F.col("base_id").isNull().alias("is_new"))


def skeleton_map(incoming: DataFrame, base: DataFrame, offset: int) -> DataFrame:
    """(skeleton_id, new_skeleton): the first skeleton of the same structure, else the id after ``offset``; equal new ones fall together."""
    key = S.structure_key(F.col("nodes"), F.col("edges"), F.col("symmetries"))
    first = base.select("skeleton_id", key.alias("key")).groupBy("key").agg(F.min("skeleton_id").alias("base_id"))
    own = incoming.select("skeleton_id", key.alias("key"))
    canon = own.groupBy("key").agg(F.min("skeleton_id").alias("canon"))
    return own.join(canon, "key").join(first, "key", "left").select("skeleton_id", F.coalesce("base_id", F.col("canon") + offset).alias("new_skeleton"), (F.col("base_id").isNull() & (F.col("canon") == F.col("skeleton_id"))).alias("is_new"))


def leaf_matches(incoming: DataFrame, candidates: DataFrame) -> DataFrame:
    """(in_id, cand_id, depth): the only candidate that shares the trailing path segments, at the least such depth.

    Both have ``id`` and ``path``. Suffixes join by equality, so n paths of d segments are n * d rows.
    """
    spread = lambda d, name: d.select(F.col("id").alias(name), F.explode(paths.leaf_suffixes(F.col("path"))).alias("s")).select(name, "s.depth", "s.suffix")
    each = spread(candidates, "cand_id").groupBy("depth", "suffix").agg(F.count("*").alias("n"), F.min("cand_id").alias("cand_id")).where("n = 1")
    hits = spread(incoming, "in_id").join(each.drop("n"), ["depth", "suffix"])
    return hits.groupBy("in_id").agg(F.min("depth").alias("depth"), F.min_by("cand_id", "depth").alias("cand_id"))


#: Keys by which videos meet. A NULL key meets none, but for those in NULLABLE; a sequence has one key for each of its files.
VIDEO_KEYS: dict[str, Callable[[], dict[str, Column]]] = {
    "path": lambda: {"path": paths.sanitize(F.get("filenames", F.lit(0)))},
    "basename": lambda: {"name": paths.basename(F.get("filenames", F.lit(0)))},
    "content": lambda: {k: F.col(k) for k in ("n_frames", "height", "width", "channels", "backend")},
    "shape": lambda: {k: F.col(k) for k in ("height", "width", "channels")},
    "image_dedup": lambda: {"name": F.explode(F.when(F.col("is_sequence"), F.array_distinct(F.transform("filenames", paths.basename))))},
}
NULLABLE = {"content": {"n_frames", "channels", "backend"}}


def video_map(incoming: DataFrame, base: DataFrame, method: str = "auto") -> DataFrame:
    """(video_id, base_id, stage) of every incoming video; base_id is NULL if none matches. video_id is a key of each side.

    Videos meet by equality on the method's key, of which base has one row with its least id; no pairs are formed.
    ``auto``: candidates whose known shape differs, or which are another crop of the same file, are out; then the
    same file, the same path, the only candidate with the same trailing segments, in that order; ties by base id.
    """
    if method == "auto":
        return _cascade(incoming, base)
    keys, nullable = VIDEO_KEYS[method](), NULLABLE.get(method, set())
    keyed = lambda d: d.select("video_id", *(c.alias(f"k_{k}") for k, c in keys.items())).dropna(subset=[f"k_{k}" for k in keys if k not in nullable])
    first = keyed(base).groupBy(*(f"k_{k}" for k in keys)).agg(F.min("video_id").alias("base_id"))
    l, r = keyed(incoming).alias("l"), first.alias("r")
    on = [F.col(f"l.k_{k}").eqNullSafe(F.col(f"r.k_{k}")) if k in nullable else F.col(f"l.k_{k}") == F.col(f"r.k_{k}") for k in keys]
    hit = l.join(r, on).groupBy("video_id").agg(F.min("base_id").alias("base_id"))
    return incoming.select("video_id").join(hit, "video_id", "left").withColumn("stage", F.when(F.col("base_id").isNotNull(), method))


#: What viable candidates agree on, as far as it is known.
_SHAPE = ("n_frames", "height", "width")


def _by_shape(videos: DataFrame, side: str) -> DataFrame:
    """videos, once for each ``shape`` key: one of an incoming video's keys is among a base video's if their shapes may agree, else none.

    A base video's part is ``n`` if unknown, else its value and ``*``; an incoming one's is ``n``, and its value or, if
    unknown, ``*``. So candidates are counted by equality though a shape may be unknown.
    """
    for c in _SHAPE:
        known = F.col(c).cast("string")
        parts = F.when(known.isNull(), F.array(F.lit("n"))).otherwise(F.array(F.lit("*"), known)) if side == "a" else F.array(F.lit("n"), F.coalesce(known, F.lit("*")))
        videos = videos.withColumn(f"__{c}", F.explode(parts))
    return videos.withColumn("shape", F.concat_ws("|", *(f"__{c}" for c in _SHAPE))).drop(*(f"__{c}" for c in _SHAPE))


def _cascade(incoming: DataFrame, base: DataFrame) -> DataFrame:
    """``auto``, without pairs: candidates are counted for each key, and where one is left the xor of their ids is its id."""
    path = paths.sanitize(F.get("filenames", F.lit(0)))
    plain = lambda d, s: _by_shape(d.select("video_id", *_SHAPE, path.alias("path"), F.to_json(F.struct("crop")).alias("crop")), s).drop(*_SHAPE)
    spread = lambda d: d.withColumn("__s", F.explode(paths.leaf_suffixes(F.col("path")))).select("video_id", "shape", "__s.depth", "__s.suffix")
    left, right = plain(incoming, "b"), plain(base, "a")
    n, x = F.count("*").alias("n"), F.bit_xor("video_id").alias("x")

    def met(rows: DataFrame, others: DataFrame, keys: list[str], out: list[str]) -> DataFrame:
        per = others.groupBy(*keys, "shape").agg(n, x, F.min("video_id").alias("least"))
        return rows.join(per, [*keys, "shape"]).groupBy(*out).agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.min("least").alias("least"))

    there = met(left, right, ["path"], ["video_id"])
    whole = met(left, right, ["path", "crop"], ["video_id"]).select("video_id", F.col("n").alias("own_n"), F.col("x").alias("own_x"), F.col("least").alias("same"))
    # same file, another crop
    other_crop = there.join(whole, "video_id", "left").select("video_id", "same", (F.col("n") - F.coalesce("own_n", F.lit(0))).alias("out_n"), F.col("x").bitwiseXOR(F.coalesce("own_x", F.lit(0))).alias("out_x"))
    by_depth = met(spread(left), spread(right), ["depth", "suffix"], ["video_id", "depth"]).join(other_crop.drop("same"), "video_id", "left")
    alone = by_depth.where(F.col("n") - F.coalesce("out_n", F.lit(0)) == 1).select("video_id", "depth", F.col("x").bitwiseXOR(F.coalesce("out_x", F.lit(0))).alias("a"))
    leaf = alone.groupBy("video_id").agg(F.min_by("a", "depth").alias("leaf"))
    out = incoming.select("video_id").join(other_crop.select("video_id", "same"), "video_id", "left").join(leaf, "video_id", "left")
    return out.select("video_id", F.coalesce("same", "leaf").alias("base_id"), F.when(F.col("same").isNotNull(), "path").when(F.col("leaf").isNotNull(), "leaf").alias("stage"))
