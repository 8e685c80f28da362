"""Readers, the dataset container and the incremental loader."""

from __future__ import annotations

import json
import struct

import pytest
from pyspark.sql import functions as F

from kinemill import schema
from kinemill.operators import matching
from kinemill.plans import pose_view as V
from kinemill.sources import native, small, tabular
from kinemill.streaming.incremental import load_frames

DATA = "/root/testdata/sf0.001"


def dataset(spark, where=None):
    inst = V.instances(spark, DATA, where)
    tracks = inst.select("track_id").distinct().select("track_id", F.concat(F.lit("t"), "track_id").alias("name"), F.concat(F.lit("u"), "track_id").alias("track_uid"), F.col("track_id").alias("ord"))
    videos = spark.range(3).select(F.col("id").alias("video_id"), F.array(F.concat(F.lit("/v/s"), "id", F.lit(".mp4"))).alias("filenames"), F.lit(False).alias("is_sequence"))
    tables = {"frames": V.frames(spark, DATA), "instances": inst.drop("video_id", "frame_idx"), "tracks": tracks, "videos": videos}
    return native.PoseDataset(spark, {n: schema.conform(t, n) for n, t in tables.items()})


def test_flatten_and_assemble(spark):
    d = dataset(spark)
    labels = native.flatten(d.frames, d.instances)
    inst = labels["instances"].orderBy("instance_id").collect()
    assert [r["instance_id"] for r in inst] == list(range(len(inst)))
    for kind in (0, 1):  # spans are contiguous
        own = [r for r in inst if r["instance_type"] == kind]
        assert all(a["point_id_end"] == b["point_id_start"] for a, b in zip(own, own[1:], strict=False)) and own[0]["point_id_start"] == 0
    frames, back = native.assemble(labels)
    # user points have no score in the files
    point = lambda p, predicted: (p["x"], p["y"], p["visible"], predicted and p["score"])
    key = lambda t: sorted((r["frame_id"], r["track_id"], r["is_predicted"], str([point(p, r["is_predicted"]) for p in r["points"]])) for r in t.select("frame_id", "track_id", "is_predicted", "points").collect())
    assert key(back) == key(d.instances) and frames.where("is_negative").count() == d.frames.where("is_negative").count()


def test_dataset_lifecycle(spark, tmp_path):
    d = dataset(spark)
    assert d.remove_predictions().instances.where("is_predicted").count() == 0
    gone = spark.createDataFrame([(1,)], "video_id long")
    assert d.remove_videos(gone).instances.join(d.frames, "frame_id").where("video_id = 1").count() == 0
    d.save(str(tmp_path / "d"))
    back = native.PoseDataset.load(spark, str(tmp_path / "d"), list(d.tables))
    assert {r["table"]: r["rows"] for r in back.summary().collect()}["instances"] == d.instances.count()
    assert native.format_version(d) == 1.2


def test_dataset_merge(spark):
    odd = F.col("event_id") % 2 == 1
    a, b = dataset(spark, ~odd), dataset(spark, odd)
    out, _ = a.merge(b, "keep_both", matching.IDENTITY, track_method="name")
    assert out.instances.count() == a.instances.count() + b.instances.count() and out.videos.count() == 3
    assert out.frames.count() == a.frames.unionByName(b.frames).select("video_id", "frame_idx").distinct().count()
    kept, _ = a.merge(b, "keep_original", track_method="name")
    shared = b.frames.join(a.frames, ["video_id", "frame_idx"], "left_anti").select("frame_id")
    assert kept.instances.count() == a.instances.count() + b.instances.join(shared, "frame_id", "left_semi").count()


def test_hdf5_needs_its_package(spark):
    reader = native.SlpReader({"path": "x.slp", "table": "frames"}, ["frame_id"])
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="h5py"):
            reader.partitions()
    assert native.SlpDataSource.name() == "slp"


def test_skeleton_round_trip():
    s = small.Skeleton(["nose", "ear_l", "ear_r", "tail"], [(0, 1), (0, 2), (0, 3)], [(1, 2)], "mouse")
    assert small.skeleton_from_json(small.skeleton_to_json(s)) == s
    assert small.skeletons_from_dict(small.skeletons_to_dict([s])) == [s]


def test_skeleton_with_nodes_spelt_out_each_time():
    node = lambda n: {"py/object": "x.Node", "py/state": {"py/tuple": [n, 1.0]}}
    kind = {"py/reduce": [{"py/type": "x.EdgeType"}, {"py/tuple": [1]}]}
    links = [{"edge_insert_idx": 1, "source": node("b"), "target": node("c"), "type": kind}, {"edge_insert_idx": 0, "source": node("a"), "target": node("b"), "type": {"py/id": 1}}]
    s = small.skeleton_from_json({"graph": {"name": "s"}, "links": links, "nodes": [{"id": node(n)} for n in "abc"]})
    assert s == small.Skeleton(["a", "b", "c"], [(0, 1), (1, 2)], [], "s")


def test_keypoint_csv(spark, tmp_path):
    rows = ["scorer,,,S,S,S,S", "individuals,,,one,one,two,two", "bodyparts,,,A,A,A,A", "coords,,,x,y,x,y", "data,video,i2.png,0,1,2,3", "data,video,i10.png,,,4,5", "data,video,i1.png,,,,"]
    (tmp_path / "k.csv").write_text("\n".join(rows) + "\n")
    got = tabular.read_keypoint_csv(spark, str(tmp_path / "k.csv"))
    assert {(r["image"].split("/")[-1], r["individual"]): (r["x"], r["y"]) for r in got.collect()} == {("i2.png", "one"): (0, 1), ("i2.png", "two"): (2, 3), ("i10.png", "one"): (None, None), ("i10.png", "two"): (4, 5), ("i1.png", "one"): (None, None), ("i1.png", "two"): (None, None)}
    assert [r["image"].split("/")[-1] for r in tabular.keypoint_frames(got).orderBy("frame_idx").collect()] == ["i1.png", "i2.png", "i10.png"]


def test_coco_and_yolo_files(spark, tmp_path):
    image = lambda i, h: {"id": i, "width": 8, "height": h, "file_name": f"{i}.png"}
    note = lambda i, c, **k: {"id": i, "image_id": i, "category_id": c, **k}
    doc = {
        "images": [image(1, 8), image(2, 9), image(3, 8)], "annotations": [note(1, 1, keypoints=[1, 2, 2, 0, 0, 0]), note(2, 2, bbox=[1, 2, 3, 4], score=0.5), note(3, 1, keypoints=[5, 6, 1, 7, 8, 2])],
        "categories": [{"id": 1, "name": "mouse", "keypoints": ["a", "b"], "skeleton": [[1, 2], [1, 9]]}, {"id": 2, "name": "fly", "keypoints": []}],
    }
    (tmp_path / "a.json").write_text(json.dumps(doc))
    t = tabular.read_coco(spark, str(tmp_path / "a.json"))
    assert {(r["frame_id"], r["video_id"], r["frame_idx"]) for r in t["frames"].collect()} == {(1, 0, 0), (2, 1, 0), (3, 0, 1)}
    assert {r["frame_id"]: [p["x"] for p in r["points"]] for r in t["instances"].collect()} == {1: [1.0, None], 3: [5.0, 7.0]}
    [box] = t["bboxes"].collect()
    assert (box["x2"], box["y2"], box["is_predicted"], box["category"]) == (4.0, 6.0, True, "fly")
    assert {r["category"]: len(r["edges"] or []) for r in t["skeletons"].collect()} == {"mouse": 1, "fly": 0}
    for split, name, text in (("train", "i1", "# note\n0 0.5 0.5 0.2 0.2 0.1 0.1 2 0 0 0\n"), ("val", "i2", "1 0.5 0.5 0.2 0.2\nbad line here now ok\n")):
        (tmp_path / split / "labels").mkdir(parents=True)
        (tmp_path / split / "labels" / f"{name}.txt").write_text(text)
    y = {(r["split"], r["image"]): r for r in tabular.read_yolo(spark, str(tmp_path), 100, 10, 2, {1: "fly"}).collect()}
    assert set(y) == {("train", "i1"), ("val", "i2")}
    assert [p["x"] for p in y["train", "i1"]["points"]] == [10.0, None] and y["val", "i2"]["category"] == "fly" and y["val", "i2"]["box"]["x1"] == 40.0


def test_spots(spark, tmp_path):
    head = "LABEL,ID,TRACK_ID,QUALITY,POSITION_X,POSITION_Y,POSITION_Z,POSITION_T,FRAME,RADIUS,VISIBILITY\n"
    (tmp_path / "s.csv").write_text(head * 4 + "a,1,0,0.5,1.0,2.0,0.0,0,0,1,1\nb,2,0,0.7,3.0,4.0,5.0,1,1,1,1\n")
    (tmp_path / "e.csv").write_text("LABEL,TRACK_ID,SPOT_SOURCE_ID,SPOT_TARGET_ID,LINK_COST,SPEED,DISPLACEMENT\n" * 4 + "e,0,1,2,0.25,1,1\n")
    got = {r["name"]: (r["x"], r["z"], r["tracking_score"]) for r in tabular.read_spots(spark, str(tmp_path / "s.csv"), str(tmp_path / "e.csv")).collect()}
    assert got == {"a": (1.0, None, None), "b": (3.0, 5.0, 0.25)} and tabular.is_spots(head)


def test_single_geojson_feature(spark):
    one = json.dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"k": "v"}})
    [r] = tabular.read_geojson(spark.createDataFrame([(one,)], "value string")).collect()
    assert r["geom_type"] == "Point" and r["properties"] == {"k": "v"}


def test_recordings_and_pictures():
    raw = bytearray(1024 + 2 * 20)
    struct.pack_into("<I", raw, 0, 0xFEED)
    struct.pack_into("<iI", raw, 28, 5, 1024)
    struct.pack_into("<9I", raw, 548, 4, 3, 8, 8, 12, 100, 2, 0, 20)
    struct.pack_into("<d", raw, 584, 30.0)
    struct.pack_into("<IHH", raw, 1024 + 12, 7, 250, 500)
    h = small.SeqHeader.of(bytes(raw))
    assert (h.width, h.height, h.n_frames, h.fps) == (4, 3, 2, 30.0) and list(small.seq_timestamps(bytes(raw), h)) == [7.2505, 0.0]
    assert small.picture_size(b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">2I", 33, 44)) == (44, 33) and small.picture_size(b"?") == (480, 640)
    assert small.embedded_offsets([3, 4]) == [(0, 3), (3, 7)] and small.tiff_axes("ImageJ=1\nframes=4\nslices=2", 8) == {"frames": 4, "slices": 2, "channels": 1}


def test_incremental_loader(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, "a"), (0, 2, "b")], "video_id long, frame_idx long, v string")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (df, df.withColumn("frame_idx", F.col("frame_idx") + 1)):
        part.write.mode("append").parquet(src)
        load_frames(spark, src, out, str(tmp_path / "cp"), df.schema).awaitTermination()
    assert sorted(r["frame_idx"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
