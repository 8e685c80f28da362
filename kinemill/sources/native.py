"""The label tables of the native format (frames, instances, points, pred_points, negative_frames), and the dataset.

In the files, an instance refers to its points by a range of row numbers, and a frame to its instances. Assembly spells
the ranges out and joins by equality; flattening mints running ids in two phases. Parquet is the native store: a
folder a table. HDF5 files are read by the ``slp`` data source where h5py is installed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .. import schema
from ..functions import geometry
from ..operators import aggregates, annotations, lifecycle, matching, merge, select
from ..operators.windows import global_rank, running_offsets

LABELS: dict[str, str] = {
    "frames": "frame_id bigint, video bigint, frame_idx bigint, instance_id_start bigint, instance_id_end bigint",
    "instances": "instance_id bigint, instance_type int, frame_id bigint, skeleton bigint, track bigint, from_predicted bigint, score double, point_id_start bigint, point_id_end bigint, tracking_score double",
    "points": "row bigint, x double, y double, visible boolean, complete boolean",
    "pred_points": "row bigint, x double, y double, visible boolean, complete boolean, score double",
    "negative_frames": "video_id bigint, frame_idx bigint",
}


_SESSIONS = ("cameras", "session_videos", "instance_groups", "instance_group_members")


@dataclass(frozen=True)
class PoseDataset:
    """Named tables; those that are missing are empty."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in schema.TABLES:
            raise AttributeError(name)
        return self.tables[name] if name in self.tables else schema.empty(self.spark, name)

    def with_tables(self, **changed: DataFrame) -> PoseDataset:
        return PoseDataset(self.spark, self.tables | changed)

    def find(self, video_id: int | None = None, frame_idx: int | None = None) -> DataFrame:
        return select.find(self.frames, video_id, frame_idx)

    def clean(self, empty_instances: bool = False) -> PoseDataset:
        """Without frames that hold nothing, and without tracks, skeletons and videos that nothing refers to."""
        frames = lifecycle.clean_frames(self.frames, [self.instances, self.centroids, self.bboxes, self.masks, self.label_images, self.rois], empty_instances)
        instances = self.instances.join(frames, "frame_id", "left_semi")
        owners = [instances, self.centroids, self.bboxes, self.masks, self.rois]
        return self.with_tables(frames=frames, instances=instances, tracks=lifecycle.used(self.tracks, "track_id", owners), skeletons=lifecycle.used(self.skeletons, "skeleton_id", [instances]), videos=lifecycle.used(self.videos, "video_id", [frames]))

    def remove_predictions(self) -> PoseDataset:
        owned = {n: select.without_predictions(t) for n, t in self.tables.items() if "is_predicted" in t.columns}
        return self.with_tables(**owned).clean()

    def remove_videos(self, gone: DataFrame) -> PoseDataset:
        return PoseDataset(self.spark, lifecycle.remove_videos(self.tables, gone))

    def extract(self, request: DataFrame) -> PoseDataset:
        """The frames of a list (pos, video_id, frame_idx) with all that they hold, and the suggestions of their videos."""
        chosen = select.extract(self.frames, request).select("frame_id")
        cut = {n: t.join(chosen, "frame_id", "left_semi") for n, t in self.tables.items() if "frame_id" in t.columns}
        out = self.with_tables(**cut)
        return out.with_tables(suggestions=self.suggestions.join(out.frames, "video_id", "left_semi"))

    def numpy(self, n_nodes: int, n_frames: DataFrame) -> DataFrame:
        tracks = self.instances.join(self.frames, "frame_id").where("track_id is not null").select("video_id", "track_id").distinct()
        return aggregates.dense_tensor(self.instances, self.frames, tracks, n_nodes, n_frames)

    def merge(self, other: PoseDataset, strategy: str = "auto", matcher: matching.InstanceMatcher = matching.SPATIAL, video_method: str = "auto", track_method: str = "identity") -> tuple[PoseDataset, DataFrame]:
        """The merged dataset and the conflicts.

        Videos, tracks and skeletons of ``other`` are mapped (new ones get ids after base's), then the frames that both
        have are merged, instances and each kind of annotation by the strategy; all else is taken over with new ids.
        Dimension maps are small and AQE broadcasts them by their size.
        """
        top = lambda d, c: d.agg(F.coalesce(F.max(c), F.lit(-1))).first()[0] + 1
        videos, tracks = matching.video_map(other.videos, self.videos, video_method), matching.track_map(other.tracks, self.tracks, track_method)
        v0, t0, s0 = top(self.videos, "video_id"), top(self.tracks, "track_id"), top(self.skeletons, "skeleton_id")
        f0, i0, p0 = top(self.frames, "frame_id"), top(self.instances, "instance_id"), top(self.identities, "identity_id")
        # every table needs these; what is lost of them is made again
        videos, tracks, skeletons = (d.persist() for d in (videos, tracks, matching.skeleton_map(other.skeletons, self.skeletons, s0)))
        vmap = videos.select("video_id", F.coalesce("base_id", F.col("video_id") + v0).alias("new_video"))
        tmap = tracks.select("track_id", F.when(F.col("is_new"), F.col("base_id") + t0).otherwise(F.col("base_id")).alias("new_track"))
        key = ["video_id", "frame_idx"]
        frames = other.frames.join(vmap, "video_id").withColumn("video_id", F.col("new_video")).withColumn("frame_id", F.col("frame_id") + f0).drop("new_video")
        all_frames = self.frames.unionByName(frames.join(self.frames, key, "left_anti").select(*self.frames.columns))
        ids = select.last_frames(all_frames).select("frame_id", *key).persist()
        shared = self.frames.join(frames, key, "left_semi").select(*key).distinct().persist()

        def moved(t: DataFrame, id_col: str, offset: int) -> DataFrame:
            """Rows of other with the ids of the merged dataset, and their frame's key."""
            up = {id_col: offset, "instance_id": i0, "from_predicted": offset, "identity_id": p0, "frame_id": f0}
            t = t.select(*((F.col(c) + up[c]).alias(c) if c in up else F.col(c) for c in t.columns if c not in key))
            if "track_id" in t.columns:
                t = t.join(tmap, "track_id", "left").withColumn("track_id", F.col("new_track")).drop("new_track")
            if "skeleton_id" in t.columns:
                t = t.join(skeletons.select("skeleton_id", "new_skeleton"), "skeleton_id", "left").withColumn("skeleton_id", F.coalesce("new_skeleton", "skeleton_id")).drop("new_skeleton")
            return t.join(frames.select("frame_id", *key), "frame_id")

        def placed(t: DataFrame) -> DataFrame:
            """With the frame of the merged dataset; what a later step added stands behind."""
            last = F.max("ord").over(Window.partitionBy(*key)) + 1
            return t.drop("frame_id").join(ids, key).withColumn("ord", (F.col("ord") + F.col("step") * last).cast("int"))

        mine = self.instances.join(self.frames.select("frame_id", *key), "frame_id")
        theirs = moved(other.instances, "instance_id", i0).select(*mine.columns)
        merged, conflicts = merge.merge_instances(mine.join(shared, key, "left_semi"), theirs.join(shared, key, "left_semi"), key, strategy, matcher)
        alone = lambda t, source: t.join(shared, key, "left_anti").withColumn("source", F.lit(source)).withColumn("step", F.lit(0))
        changed = {"frames": all_frames, "instances": schema.conform(placed(merged.unionByName(alone(mine, "self")).unionByName(alone(theirs, "other"))), "instances")}
        for kind, id_col in annotations.KINDS.items():
            if kind not in self.tables and kind not in other.tables:
                continue
            own, more = self._annotated(kind), other._annotated(kind)
            offset = top(own, id_col)
            a = own.drop("video_id").join(self.frames.select("frame_id", *key), "frame_id")
            b = moved(more, id_col, offset).select(*a.columns)
            both = annotations.merge_annotations(a.join(shared, key, "left_semi"), b.join(shared, key, "left_semi"), key, id_col, strategy, matcher.threshold if matcher.method == "spatial" else 5.0, kind == "label_images")
            out = schema.conform(placed(both.unionByName(alone(a, "self")).unionByName(alone(b, "other"))), kind)
            if kind == "rois":  # static regions belong to a video, not to a frame
                still = other.rois.where("is_static").join(vmap, "video_id").withColumn("video_id", F.col("new_video")).withColumn("roi_id", F.col("roi_id") + offset)
                out = out.unionByName(self.rois.where("is_static")).unionByName(schema.conform(still, "rois"))
            if kind == "label_images":
                objects = other.label_image_objects.withColumn("label_image_id", F.col("label_image_id") + offset).withColumn("instance_id", F.col("instance_id") + i0).join(tmap, "track_id", "left").withColumn("track_id", F.col("new_track")).drop("new_track")
                changed["label_image_objects"] = self.label_image_objects.unionByName(schema.conform(objects, "label_image_objects")).join(out.select("label_image_id"), "label_image_id", "left_semi")
            changed[kind] = out
        new_tracks = other.tracks.join(tracks.where("is_new and track_id = base_id").select("track_id"), "track_id", "left_semi").withColumn("track_id", F.col("track_id") + t0)
        new_videos = other.videos.join(videos.where("base_id is null").select("video_id"), "video_id", "left_semi").withColumn("video_id", F.col("video_id") + v0)
        new_skeletons = other.skeletons.join(skeletons.where("is_new").select("skeleton_id"), "skeleton_id", "left_semi").withColumn("skeleton_id", F.col("skeleton_id") + s0)
        changed |= {n: t.unionByName(m, allowMissingColumns=True) for n, t, m in (("tracks", self.tracks, new_tracks), ("videos", self.videos, new_videos), ("skeletons", self.skeletons, new_skeletons))}
        changed["identities"] = self.identities.unionByName(other.identities.withColumn("identity_id", F.col("identity_id") + p0))
        changed["suggestions"] = merge.merge_suggestions(self.suggestions, other.suggestions.join(vmap, "video_id").withColumn("video_id", F.col("new_video")).drop("new_video"))
        if any(n in other.tables for n in _SESSIONS):
            c0, g0 = top(self.cameras, "session_id"), top(self.instance_groups, "group_id")
            frame_of = frames.join(ids.withColumnRenamed("frame_id", "__frame"), key).select("frame_id", "__frame")
            up = {"session_id": c0, "group_id": g0, "identity_id": p0, "frame_id": f0}
            for name in _SESSIONS:
                t = getattr(other, name)
                t = t.select(*((F.col(c) + up[c]).alias(c) if c in up else F.col(c) for c in t.columns))
                if name == "session_videos":
                    t = t.join(vmap, "video_id").withColumn("video_id", F.col("new_video"))
                if name == "instance_group_members":
                    t = t.join(frame_of, "frame_id").withColumn("frame_id", F.col("__frame"))
                changed[name] = getattr(self, name).unionByName(schema.conform(t, name))
        return self.with_tables(**changed), conflicts

    def _annotated(self, kind: str) -> DataFrame:
        """Annotations of frames with the place (x, y) at which they meet others."""
        t = getattr(self, kind)
        if kind == "rois":
            t = t.where("not coalesce(is_static, false)")
        for c in ("track_id", "tracking_score", "from_predicted"):
            if c not in t.columns:
                t = t.withColumn(c, F.lit(None).cast("double" if c == "tracking_score" else "bigint"))
        if kind == "centroids":
            return t
        at = annotations.place(kind, geometry.rings_of(F.col("geometry")) if kind == "rois" else None)
        return t.withColumn("__at", at).withColumn("x", F.col("__at.x")).withColumn("y", F.col("__at.y")).drop("__at")

    def save(self, path: str, mode: str = "errorifexists") -> None:
        for name, t in self.tables.items():
            schema.conform(t, name).write.mode(mode).parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, names: list[str]) -> PoseDataset:
        return cls(spark, {n: spark.read.schema(schema.struct_of(n)).parquet(f"{path}/{n}") for n in names})

    def summary(self) -> DataFrame:
        """(table, rows) without reading points: counts come from the files' footers."""
        parts = [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, t in self.tables.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def save_set(datasets: dict[str, PoseDataset], path: str) -> None:
    """Many datasets in one store, a partition each."""
    for name, d in datasets.items():
        d.save(f"{path}/dataset_name={name}", "overwrite")


def assemble(labels: dict[str, DataFrame], format_id: float = 2.8, n_skeletons: int = 1) -> tuple[DataFrame, DataFrame]:
    """(frames, instances) of the label tables.

    Before format 1.1 coordinates are half a pixel too high, before 1.2 there is no tracking score; -1 is NULL; a
    skeleton that isn't there is the first.
    """
    half = 0.5 if format_id < 1.1 else 0.0
    inst = labels["instances"]
    missing = lambda c: F.when(F.col(c) >= 0, F.col(c))
    rows = inst.where("point_id_end > point_id_start").select("instance_id", "instance_type", F.posexplode(F.sequence("point_id_start", F.col("point_id_end") - 1)).alias("node_idx", "row"))
    known = lambda c: F.when(~F.isnan(c), F.col(c) - half)
    made = lambda p: p.select("row", F.struct(known("x").alias("x"), known("y").alias("y"), "visible", "complete", (F.col("score") if "score" in p.columns else F.lit(None).cast("double")).alias("score")).alias("p"))
    user = rows.where("instance_type = 0").join(made(labels["points"]), "row")
    predicted = rows.where("instance_type = 1").join(made(labels["pred_points"]), "row")
    points = user.unionByName(predicted).groupBy("instance_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_idx", "p"))), lambda s: s["p"]).alias("points"))
    score = F.lit(0.0) if format_id < 1.2 else F.coalesce(F.when(~F.isnan("tracking_score"), F.col("tracking_score")), F.lit(0.0))
    spread = labels["frames"].where("instance_id_end > instance_id_start").select(F.col("frame_id").alias("__frame"), F.posexplode(F.sequence("instance_id_start", F.col("instance_id_end") - 1)).alias("ord", "instance_id"))
    out = inst.drop("frame_id").join(spread, "instance_id").withColumnRenamed("__frame", "frame_id").join(points, "instance_id", "left")
    skeleton = F.when(F.col("skeleton").between(0, n_skeletons - 1), F.col("skeleton")).otherwise(0)
    out = out.select("instance_id", "frame_id", "ord", (F.col("instance_type") == 1).alias("is_predicted"), skeleton.alias("skeleton_id"), missing("track").alias("track_id"), missing("from_predicted").alias("from_predicted"), F.when(F.col("instance_type") == 1, F.col("score")).alias("score"), score.alias("tracking_score"), "points")
    negative = labels["negative_frames"].select(F.col("video_id").alias("video"), "frame_idx", F.lit(True).alias("__n")).distinct()
    frames = labels["frames"].join(negative, ["video", "frame_idx"], "left").select("frame_id", F.col("video").alias("video_id"), "frame_idx", F.coalesce("__n", F.lit(False)).alias("is_negative"))
    return frames, schema.conform(lifecycle.resolve_from_predicted(out), "instances")


def flatten(frames: DataFrame, instances: DataFrame) -> dict[str, DataFrame]:
    """The label tables with running ids: frames by id, instances by (frame, ord), points by (instance, node)."""
    numbered = global_rank(instances, "frame_id", ["ord", "instance_id"], "new_id")
    kinds = []
    for predicted in (False, True):
        part = numbered.where(F.col("is_predicted") == predicted).withColumn("__n", F.size(F.coalesce("points", F.array().cast(schema.POINTS))))
        kinds.append(running_offsets(part, "new_id", "__n").withColumnsRenamed({"start": "point_id_start", "end": "point_id_end"}))
    both = kinds[0].unionByName(kinds[1])
    links = numbered.select(F.col("instance_id").alias("from_predicted"), F.col("new_id").alias("__from"))
    per = frames.join(numbered.groupBy("frame_id").agg(F.min("new_id").alias("a"), (F.max("new_id") + 1).alias("b")), "frame_id", "left")
    minus = lambda c: F.coalesce(c, F.lit(-1).cast("bigint"))
    rows = both.join(links, "from_predicted", "left").select(
        F.col("new_id").alias("instance_id"), F.col("is_predicted").cast("int").alias("instance_type"), "frame_id", F.col("skeleton_id").alias("skeleton"), minus(F.col("track_id")).alias("track"), minus(F.col("__from")).alias("from_predicted"), F.coalesce("score", F.lit(0.0)).alias("score"), "point_id_start", "point_id_end",
        F.coalesce("tracking_score", F.lit(0.0)).alias("tracking_score"),
    )
    point = lambda k: k.select((F.col("point_id_start") + F.col("i")).alias("row"), F.coalesce("p.x", F.lit(float("nan"))).alias("x"), F.coalesce("p.y", F.lit(float("nan"))).alias("y"), "p.visible", "p.complete", "p.score")
    spread = [point(k.select("point_id_start", F.posexplode("points").alias("i", "p"))) for k in kinds]
    return {
        "frames": per.select("frame_id", F.col("video_id").alias("video"), "frame_idx", F.coalesce("a", F.lit(0)).cast("bigint").alias("instance_id_start"), F.coalesce("b", F.lit(0)).cast("bigint").alias("instance_id_end")),
        "instances": rows, "points": spread[0].drop("score"), "pred_points": spread[1], "negative_frames": frames.where("is_negative").select("video_id", "frame_idx"),
    }


def format_version(dataset: PoseDataset) -> Column | float:
    """The lowest version that holds the content: 1.2 for poses, 1.5 with annotations, 2.8 with session groups."""
    has = lambda t: not t.isEmpty()
    if has(dataset.instance_groups):
        return 2.8
    return 1.5 if any(has(t) for t in (dataset.rois, dataset.masks, dataset.bboxes, dataset.centroids, dataset.label_images)) else 1.2


class _Rows(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class SlpReader(DataSourceReader):
    """Ranges of rows of one compound table."""

    def __init__(self, options: dict[str, str], fields: list[str]):
        self.path, self.table, self.fields, self.step = options["path"], options.get("table", "frames"), fields, int(options.get("rows", 500_000))

    def _open(self):
        try:
            import h5py
        except ImportError as e:
            raise ImportError("reading HDF5 label files needs the package h5py; Parquet stores don't") from e
        return h5py.File(self.path, "r")

    def partitions(self) -> list[InputPartition]:
        with self._open() as f:
            n = len(f[self.table])
        return [_Rows(lo, min(lo + self.step, n)) for lo in range(0, n, self.step)] or [_Rows(0, 0)]

    def read(self, partition: _Rows):
        with self._open() as f:
            rows = f[self.table][partition.lo : partition.hi]
        yield self.batch(rows, partition.lo)

    def batch(self, rows, first: int):
        """An Arrow batch of a structured array; a field that the file lacks is NULL."""
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(StructType.fromDDL(LABELS[self.table]))
        column = lambda f: pa.array(np.arange(first, first + len(rows))) if f.name == "row" else pa.array(np.ascontiguousarray(rows[f.name])) if f.name in rows.dtype.names else pa.nulls(len(rows))
        return pa.RecordBatch.from_arrays([column(f).cast(f.type) for f in kinds], schema=kinds)


class SlpDataSource(DataSource):
    """``spark.read.format("slp").option("table", "instances").load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "slp"

    def schema(self) -> str:
        return LABELS[self.options.get("table", "frames")]

    def reader(self, schema) -> SlpReader:
        return SlpReader(dict(self.options), schema.fieldNames())
