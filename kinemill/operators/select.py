"""Lookups, filters, sampling and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import points as P


def last_frames(frames: DataFrame) -> DataFrame:
    """One frame for each (video, index): the last one wins."""
    w = Window.partitionBy("video_id", "frame_idx").orderBy(F.col("frame_id").desc())
    return frames.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def find(frames: DataFrame, video_id: int | None = None, frame_idx: int | None = None) -> DataFrame:
    """Frames of a video, of an index, or (with both) the one frame that a lookup gives."""
    out = frames
    if video_id is not None:
        out = out.where(F.col("video_id") == video_id)
    if frame_idx is not None:
        out = out.where(F.col("frame_idx") == frame_idx)
    return last_frames(out) if video_id is not None and frame_idx is not None else out


def annotations(table: DataFrame, frames: DataFrame | None = None, *, video_id: int | None = None, frame_idx: int | None = None, category: str | None = None, track_id: int | None = None, instance_id: int | None = None, predicted: bool | None = None) -> DataFrame:
    """Rows of an annotation table by all the given filters; static rows only if neither video nor frame is given."""
    given: list[Column] = []
    out = table
    if video_id is not None or frame_idx is not None:
        if "is_static" in table.columns:
            out = out.where("not is_static")
        chosen = find(frames, video_id, frame_idx).select("frame_id")
        out = out.join(chosen, "frame_id", "left_semi")
    for name, value in (("category", category), ("track_id", track_id), ("instance_id", instance_id), ("is_predicted", predicted)):
        if value is not None:
            given.append(F.col(name) == value)
    return out.where(reduce(lambda a, b: a & b, given)) if given else out


def label_images(images: DataFrame, objects: DataFrame, *, category: str | None = None, track_id: int | None = None) -> DataFrame:
    """Label images of which any object has the category and any the track."""
    out = images
    for name, value in (("category", category), ("track_id", track_id)):
        if value is not None:
            out = out.join(objects.where(F.col(name) == value).select("label_image_id"), "label_image_id", "left_semi")
    return out


def track_annotations(frames: DataFrame, kinds: dict[str, DataFrame], video_id: int, track_id: int) -> DataFrame:
    """Every annotation of a track, with ``rank``: by frame index, frame, kind (in the given order), place in the frame."""
    own = frames.where(F.col("video_id") == video_id).select("frame_id", "frame_idx")
    parts = [t.where(F.col("track_id") == track_id).select("frame_id", F.lit(k).alias("kind_no"), F.lit(name).alias("kind"), F.col("ord").cast("bigint").alias("ord")) for k, (name, t) in enumerate(kinds.items())]
    rows = reduce(DataFrame.unionByName, parts).join(own, "frame_id")
    # one track of one video: its annotations are few enough for one sort
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("frame_idx", "frame_id", "kind_no", "ord"))).drop("kind_no")


def user_labeled(frames: DataFrame, kinds: list[DataFrame]) -> DataFrame:
    """frames with ``is_user_labeled``: negative, or with anything that isn't predicted."""
    own = reduce(DataFrame.unionByName, [k.where("not is_predicted").select("frame_id") for k in kinds]).distinct().withColumn("__own", F.lit(True))
    return frames.join(own, "frame_id", "left").withColumn("is_user_labeled", F.col("is_negative") | F.coalesce("__own", F.lit(False))).drop("__own")


def nonempty(instances: DataFrame) -> DataFrame:
    return instances.where(~P.is_empty("points"))


def without_predictions(table: DataFrame) -> DataFrame:
    return table.where("not is_predicted")


def extract(frames: DataFrame, request: DataFrame, strict: bool = True) -> DataFrame:
    """Frames by a list (pos, video_id, frame_idx), with ``pos``; an error for a pair that isn't there, if ``strict``."""
    out = request.join(last_frames(frames), ["video_id", "frame_idx"], "left")
    if strict:
        miss = F.raise_error(F.concat(F.lit("no frame "), F.col("frame_idx"), F.lit(" of video "), F.col("video_id"))).cast("bigint")
        return out.withColumn("frame_id", F.coalesce("frame_id", miss))
    return out.where("frame_id is not null")


def even_sample(rows: DataFrame, group: list[str], order: str, k: int) -> DataFrame:
    """At most ``k`` rows of each group, evenly spaced: those at trunc(i * n / k)."""
    w = Window.partitionBy(*group)
    at = rows.withColumn("__r", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count("*").over(w))
    # row r is taken if some i has trunc(i * n / k) = r
    first = F.ceil(F.col("__r") * k / F.col("__n"))
    hit = (first < k) & (F.floor(first * F.col("__n") / k) == F.col("__r"))
    return at.where((F.col("__n") <= k) | hit).drop("__r", "__n")


def split_sizes(n: int, part: float | int) -> tuple[int, int]:
    """Rows of a split and of the rest: a fraction (at least one row) or a number; a single row goes to both."""
    if n <= 1:
        return n, n
    first = max(int(n * part), 1) if isinstance(part, float) else min(int(part), n)
    return first, n - first


def random_numbers(seed: int = 0x9E3779B9):
    """The 32-bit generator of the seeded splits: numbers in [0, 1). Its constants are fixed values."""
    state, mask = seed & 0xFFFFFFFF, 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & mask
        t = state
        t = ((t ^ (t >> 15)) * (t | 1)) & mask
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & mask)) & mask
        yield ((t ^ (t >> 14)) & mask) / 4294967296


def drawn(n: int, k: int, seed: int = 0x9E3779B9) -> list[int]:
    """k different numbers below n in the order in which the seeded splits draw them; memory grows with k, not n."""
    at: dict[int, int] = {}  # numbers that lie elsewhere than at their own place
    out = []
    for i, r in zip(range(min(k, n)), random_numbers(seed), strict=False):
        j = i + int(r * (n - i))
        out.append(at.get(j, j))
        at[j] = at.get(i, i)
    return out


def split(rows: DataFrame, key: str, part: float | int, seed: int = 7) -> DataFrame:
    """rows with ``in_first`` and ``in_second``: exact sizes, drawn by a seeded hash of the key.

    The hash is uniform, so the last one of the first part lies near a known value: rows well below it are in, rows well
    above are out, and only the few between are ranked.
    """
    first, _ = split_sizes(n := rows.count(), part)
    if n <= 1:
        return rows.withColumn("in_first", F.lit(True)).withColumn("in_second", F.lit(True))
    marked = rows.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed)))
    middle, slack = first / n * 2.0**64 - 2.0**63, 8 * n**0.5 / n * 2.0**64
    lo, hi = (max(-(2**63), min(2**63 - 1, int(v))) for v in (middle - slack, middle + slack))
    below, near = marked.agg(F.count_if(F.col("__h") < lo), F.count_if(F.col("__h").between(lo, hi))).first()
    if not below <= first <= below + near:  # many rows share a key
        lo, hi, below = -(2**63), 2**63 - 1, 0
    between = marked.where(F.col("__h").between(lo, hi))
    ranked = between.withColumn("in_first", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__h", key)) <= first - below)
    rest = marked.where(~F.col("__h").between(lo, hi)).withColumn("in_first", F.col("__h") < lo)
    return rest.unionByName(ranked).drop("__h").withColumn("in_second", ~F.col("in_first"))


def drawn_split(rows: DataFrame, key: str, part: float | int, seed: int = 0x9E3779B9) -> DataFrame:
    """rows with ``in_first`` and ``in_second`` by the generator of the seeded splits over the rows in the order of ``key``.

    The draw is one after another, so the drawn numbers pass through the driver; ``split`` has no such bound.
    """
    from .windows import global_rank

    first, _ = split_sizes(n := rows.count(), part)
    if n <= 1:
        return rows.withColumn("in_first", F.lit(True)).withColumn("in_second", F.lit(True))
    chosen = rows.sparkSession.createDataFrame([(i,) for i in drawn(n, first, seed)], "__pos long").withColumn("in_first", F.lit(True))
    out = global_rank(rows, key, [], "__pos").join(chosen, "__pos", "left").drop("__pos")
    return out.withColumn("in_first", F.coalesce("in_first", F.lit(False))).withColumn("in_second", ~F.col("in_first"))


def three_way_sizes(total: int, train: float, val: float, test: float) -> dict[str, int]:
    """Sizes of train, test and val: each a fraction of what is left that makes its share of the whole."""
    n_train, rest = split_sizes(total, train)
    n_test, rest = split_sizes(rest, test * total / max(1, rest)) if test * total / max(1, rest) < 1 else (min(int(test * total / max(1, rest)), rest), rest - min(int(test * total / max(1, rest)), rest))
    share = val * total / max(1, rest)
    n_val = rest if share == 1.0 else split_sizes(rest, share if share < 1 else int(share))[0]
    return {"train": n_train, "val": n_val, "test": n_test}


def three_way_split(rows: DataFrame, key: str, train: float = 0.6, val: float = 0.2, test: float = 0.2, seed: int = 7) -> DataFrame:
    """rows with ``split``: train, test, val, or NULL for those that no part takes."""
    n = three_way_sizes(rows.count(), train, val, test)
    one = split(rows, key, n["train"], seed)
    rest = one.where("not in_first").drop("in_first", "in_second")
    two = split(rest, key, n["test"], seed + 1)
    left = split(two.where("not in_first").drop("in_first", "in_second"), key, n["val"], seed + 2)
    parts = [(one, "train"), (two, "test"), (left, "val")]
    named = [d.where("in_first").drop("in_first", "in_second").withColumn("split", F.lit(name)) for d, name in parts]
    unused = left.where("not in_first").drop("in_first", "in_second").withColumn("split", F.lit(None).cast("string"))
    return reduce(DataFrame.unionByName, [*named, unused])


def by_source_order(rows: DataFrame, source: DataFrame, name: str = "name", ord_: str = "ord") -> DataFrame:
    """rows with ``rank``: in the order in which ``source`` has their names, those that it lacks as if first; stable."""
    first = source.groupBy(name).agg(F.min(ord_).alias("__s"))
    return rows.join(first, name, "left").withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.coalesce("__s", F.lit(0)), ord_))).drop("__s")
