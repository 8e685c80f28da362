"""Window operators: trails, running offsets, runs, ranks."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def trails(positions: DataFrame, length: int, key: list[str], with_path: bool = False) -> DataFrame:
    """Motion trails: for every row (key, frame_idx, x, y) the known places within ``length`` frames before it.

    n_points counts them; sum_x and sum_y add them up; ``with_path`` adds [frame_idx, x, y] of each. Windows of
    which no place is known are dropped. A frame without a row is a gap.
    """
    w = Window.partitionBy(*key).orderBy("frame_idx").rangeBetween(-length, 0)
    known = F.col("x").isNotNull() | F.col("y").isNotNull()
    out = positions.withColumn("n_points", F.sum(known.cast("bigint")).over(w)).withColumn("sum_x", F.sum("x").over(w)).withColumn("sum_y", F.sum("y").over(w))
    if with_path:
        out = out.withColumn("path", F.collect_list(F.when(known, F.struct("frame_idx", "x", "y"))).over(w))
    return out.where("n_points > 0")


def aligned(path: Column, frame_idx: Column, length: int) -> Column:
    """A trail's path with a place for every frame of the window; NULL in the gaps."""
    at = F.map_from_entries(F.transform(path, lambda p: F.struct(p["frame_idx"], F.struct(p["x"].alias("x"), p["y"].alias("y")))))
    return F.transform(F.sequence(frame_idx - length, frame_idx), lambda f: F.try_element_at(at, f))


def segments(points: DataFrame, key: list[str]) -> DataFrame:
    """Line segments of trails with their alpha; segments with an unknown end are left out."""
    w = Window.partitionBy(*key).orderBy("frame_idx")
    n = F.count("*").over(Window.partitionBy(*key)) - 1
    out = points.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w)).withColumn("k", F.row_number().over(w) - 1).withColumn("n", n)
    out = out.where("k < n").withColumn("alpha", F.greatest((F.col("k") + 1) / F.col("n"), F.lit(0.05)))
    return out.where("x is not null and y is not null and x2 is not null and y2 is not null")


def _ranged(rows: DataFrame, order: str, size: Column, buckets: int | None) -> DataFrame:
    """rows with ``__b``, the number of their range of ``order``, and ``__base``, the sum of ``size`` over the ranges before.

    About as many rows in each range; as many ranges as there are shuffle partitions, 64 at least. The ranges' sums come
    to the driver (one row a range) and go back as literals: joined on, they are a self-join on an expression over a
    lambda, for which Spark can plan a filter by a column that its input lacks.
    """
    buckets = buckets or max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted({*rows.select(F.col(order).cast("double").alias("v")).approxQuantile("v", [k / buckets for k in range(1, buckets)], 1 / (8 * buckets))}) if buckets > 1 else []
    # cuts in groups: a row is compared with the first cut of each, and with the cuts of its own
    step = max(1, math.isqrt(len(cuts)))
    groups = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    v = F.col(order).cast("double")
    doubles = lambda values: F.array(*map(F.lit, values)).cast("array<double>")
    below = lambda grid: F.size(F.filter(grid, lambda c: c <= v))
    group = below(doubles([g[0] for g in groups])) - 1
    own = F.get(F.array(*map(doubles, groups)), group) if groups else doubles([])
    ranged = rows.withColumn("__b", F.when(group >= 0, group * step + below(own)).otherwise(0))
    sums = ranged.groupBy("__b").agg(F.sum(size).alias("__t"))
    totals = {r["__b"]: r["__t"] or 0 for r in sums.collect()}
    bases = F.array(*map(F.lit, accumulate((totals.get(b, 0) for b in range(len(cuts))), initial=0)))
    return ranged.withColumn("__base", F.get(bases.cast(ArrayType(sums.schema["__t"].dataType)), F.col("__b")))


def global_rank(rows: DataFrame, order: str, ties: list[str], name: str = "pos", buckets: int | None = None) -> DataFrame:
    """rows numbered from 0 over the whole table in ascending ``order``, then ``ties``, in two phases as ``running_offsets``."""
    rank = F.row_number().over(Window.partitionBy("__b").orderBy(order, *ties))
    return _ranged(rows, order, F.lit(1), buckets).withColumn(name, (F.col("__base") + rank - 1).cast("bigint")).drop("__b", "__base")


def running_offsets(rows: DataFrame, order: str, size: str, buckets: int | None = None) -> DataFrame:
    """rows with ``start`` and ``end``: running sums of ``size`` in ascending ``order`` over the whole table.

    Two phases, so that no task gets the whole table: sums within ranges of ``order``, then the ranges' totals (one
    row a range) added on.
    """
    w = Window.partitionBy("__b").orderBy(order)
    end = F.col("__base") + F.sum(size).over(w)
    return _ranged(rows, order, F.col(size), buckets).withColumn("end", end.cast("bigint")).withColumn("start", (F.col("end") - F.col(size)).cast("bigint")).drop("__b", "__base")


def runs(rows: DataFrame, group: list[str], order: str, bit: str) -> DataFrame:
    """Run-length runs of a flag in each group: run number (0 is background, even if empty), start and length."""
    w = Window.partitionBy(*group).orderBy(order)
    at = rows.withColumn("__i", F.row_number().over(w) - 1).withColumn("__c", (F.col(bit) != F.coalesce(F.lag(bit).over(w), F.lit(0))).cast("bigint"))
    at = at.withColumn("run", F.sum("__c").over(w))
    return at.groupBy(*group, "run").agg(F.min("__i").cast("bigint").alias("start"), F.count("*").alias("length"))


def first_appearance_ids(objects: DataFrame, name: str, order: list[str]) -> DataFrame:
    """(name, label_id) in the order in which names first appear; ``label_images.normalize`` also numbers objects without one."""
    named = objects.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(F.struct(*order)).alias("__o"))
    w = Window.partitionBy(F.lit(0)).orderBy("__o")  # one row a distinct name
    return named.withColumn("label_id", F.row_number().over(w)).drop("__o")


def positional_rank(rows: DataFrame, group: list[str], order: list[Column | str], name: str = "frame_idx") -> DataFrame:
    """Rows of each group numbered from 0."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).cast("bigint"))


def time_to_frame(times: DataFrame, group: str, time: str) -> DataFrame:
    """frame_idx of each time: the rounded time if that is without collisions in the group, else its rank."""
    rounded = F.floor(F.col(time) + 0.5).cast("bigint")
    per = times.groupBy(group).agg((F.countDistinct(rounded) == F.countDistinct(time)).alias("__free"))
    rank = F.dense_rank().over(Window.partitionBy(group).orderBy(time)) - 1
    return times.withColumn("__r", rank).join(per, group).withColumn("frame_idx", F.when(F.col("__free"), rounded).otherwise(F.col("__r").cast("bigint"))).drop("__r", "__free")


def frames_per_second(stamps: DataFrame, group: str, time: str, header: Column, first: int = 100, tolerance: float = 0.005) -> DataFrame:
    """1 / mean of the deltas near the median, over each group's first timestamps; the header's rate if below 1."""
    w = Window.partitionBy(group).orderBy(time)
    early = stamps.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= first)
    deltas = early.withColumn("__d", F.col(time) - F.lag(time).over(w)).where("__d is not null")
    mid = deltas.groupBy(group).agg(F.median("__d").alias("__m"))
    kept = deltas.join(mid, group).where(F.abs(F.col("__d") - F.col("__m")) < tolerance)
    rate = kept.groupBy(group).agg((1 / F.avg("__d")).alias("__rate"))
    return stamps.select(group).distinct().join(rate, group, "left").select(group, F.when(F.col("__rate") >= 1, F.col("__rate")).otherwise(header).alias("fps"))
