"""Merging of whole datasets, splits, writers, projects and label images."""

from __future__ import annotations

import pickle
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinemill import schema
from kinemill.functions import arrays
from kinemill.operators import annotations, label_images, matching, select
from kinemill.sources import documents, native, projects, tabular


def table(spark, name, *rows):
    """Rows given as dicts of some columns."""
    kind = schema.struct_of(name)
    return spark.createDataFrame([tuple(r.get(f.name) for f in kind) for r in rows], kind)


def small_dataset(spark, x, track, node):
    point = [(float(x), 1.0, True, False, None)]
    owned = {"frame_id": 0, "ord": 0, "is_predicted": False, "track_id": 0}
    return native.PoseDataset(
        spark,
        {
            "videos": table(spark, "videos", {"video_id": 0, "filenames": ["/v/a.mp4"], "is_sequence": False}), "tracks": table(spark, "tracks", {"track_id": 0, "name": track, "track_uid": track, "ord": 0}),
            "skeletons": table(spark, "skeletons", {"skeleton_id": 0, "name": "s", "nodes": [node], "edges": [], "symmetries": []}), "identities": table(spark, "identities", {"identity_id": 0, "name": track}),
            "frames": table(spark, "frames", {"frame_id": 0, "video_id": 0, "frame_idx": 5, "is_negative": False}, {"frame_id": 1, "video_id": 0, "frame_idx": int(x), "is_negative": False}),
            "instances": table(spark, "instances", owned | {"instance_id": 0, "skeleton_id": 0, "points": point}), "centroids": table(spark, "centroids", owned | {"centroid_id": 0, "x": float(x), "y": 1.0}),
            "bboxes": table(spark, "bboxes", owned | {"bbox_id": 0, "x1": 0.0, "y1": 0.0, "x2": 4.0, "y2": 2.0, "is_predicted": True}, owned | {"bbox_id": 1, "frame_id": 1, "x1": 0.0, "y1": 0.0, "x2": 4.0, "y2": 2.0}),
            "masks": table(spark, "masks", owned | {"mask_id": 0, "rle": [1, 2], "height": 1, "width": 3}), "rois": table(spark, "rois", owned | {"roi_id": 0, "is_static": False, "geometry": '{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,0]]]}'}, {"roi_id": 1, "video_id": 0, "is_static": True, "geometry": "{}"}),
            "label_images": table(spark, "label_images", owned | {"label_image_id": 0, "height": 2, "width": 2, "data": [0, 1, 1, 0]}), "label_image_objects": table(spark, "label_image_objects", {"label_image_id": 0, "label_id": 1, "track_id": 0}),
            "cameras": table(spark, "cameras", {"session_id": 0, "camera_id": 0, "name": "c"}), "session_videos": table(spark, "session_videos", {"session_id": 0, "camera_id": 0, "video_id": 0}),
            "instance_groups": table(spark, "instance_groups", {"session_id": 0, "frame_idx": 5, "group_id": 0, "identity_id": 0}), "instance_group_members": table(spark, "instance_group_members", {"group_id": 0, "camera_id": 0, "frame_id": 0, "ord": 0}),
        },
    )


def test_merge_keeps_every_table(spark):
    a, b = small_dataset(spark, 100, "t", "head"), small_dataset(spark, 200, "u", "tail")
    out, _ = a.merge(b, "keep_both")
    kept = {name: getattr(out, name).collect() for name in ("instances", "bboxes", "rois", "label_image_objects", "instance_group_members")}
    assert {(r["instance_id"], r["skeleton_id"], r["track_id"], r["frame_id"], r["ord"]) for r in kept["instances"]} == {(0, 0, 0, 0, 0), (1, 1, 1, 0, 1)}
    assert {(r["bbox_id"], r["frame_id"]) for r in kept["bboxes"]} == {(0, 0), (1, 1), (2, 0), (3, 3)}
    assert {(r["group_id"], r["frame_id"]) for r in kept["instance_group_members"]} == {(0, 0), (1, 0)}
    assert len(kept["rois"]) == 4 and {r["video_id"] for r in kept["rois"] if r["is_static"]} == {0} and {r["label_image_id"] for r in kept["label_image_objects"]} == {0, 1}
    assert set(out.tables) == set(a.tables) | {"suggestions"}
    assert a.merge(b)[0].masks.count() == 1  # equal user masks are one


def test_provenance_comes_before_places(spark):
    cols = "frame_id long, id long, ord int, is_predicted boolean, track_id long, tracking_score double, from_predicted long, x double, y double"
    base = spark.createDataFrame([(0, 1, 0, True, None, 0.0, None, 0.0, 0.0), (0, 2, 1, True, None, 0.0, None, 1.0, 0.0)], cols)
    other = spark.createDataFrame([(0, 11, 0, False, None, 0.0, 2, 0.0, 0.0)], cols)
    out = annotations.merge_annotations(base, other, ["frame_id"], "id", "auto")
    assert {r["id"] for r in out.collect()} == {1, 11}
    with pytest.raises(ValueError):
        annotations.merge_annotations(base, other, ["frame_id"], "id", "what")


def test_tracks_without_a_name_stay_apart(spark):
    inc = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a"), (5, "b")], "track_id long, name string")
    base = spark.createDataFrame([(9, None, 0), (8, "b", 1)], "track_id long, name string, ord long")
    got = {r["track_id"]: (r["base_id"], r["is_new"]) for r in matching.track_map(inc, base, "name").collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, True), 4: (3, True), 5: (8, False)}


def test_skeletons_without_nodes(spark):
    sk = spark.createDataFrame([(0, [], [], []), (1, ["a"], [], []), (2, ["a", "b"], [], [])], "skeleton_id long, nodes array<string>, edges array<struct<src:int,dst:int>>, symmetries array<struct<a:int,b:int>>")
    got = {(r["a_skeleton_id"], r["b_skeleton_id"]) for r in matching.skeleton_matches(sk, sk, "subset").collect()}
    assert got == {(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)}
    with pytest.raises(ValueError):
        matching.skeleton_matches(sk, sk, "overlap", 0.0)


def test_draws_equal_a_shuffled_pool(spark):
    for n, k, seed in ((1, 1, 3), (7, 3, 5), (50, 50, 9), (200, 120, 0x9E3779B9)):
        pool, out = list(range(n)), []
        for i, r in zip(range(k), select.random_numbers(seed), strict=False):
            j = i + int(r * (n - i))
            pool[i], pool[j] = pool[j], pool[i]
            out.append(pool[i])
        assert select.drawn(n, k, seed) == out
    rows = spark.range(40).select((F.col("id") * 3).alias("k"))
    got = select.drawn_split(rows, "k", 0.3, 5)
    assert {r["k"] for r in got.where("in_first").collect()} == {3 * i for i in select.drawn(40, 12, 5)}


def test_split_sizes_hold_for_repeated_keys(spark):
    for rows in (spark.range(5000).select(F.col("id").alias("k")), spark.range(1000).select((F.col("id") % 3).alias("k"))):
        for part in (0.3, 17):
            out = select.split(rows, "k", part)
            n = rows.count()
            want = int(n * part) if isinstance(part, float) else part
            assert out.count() == n and out.where("in_first").count() == want == n - out.where("in_second").count()
    parts = Counter(r["split"] for r in select.three_way_split(spark.range(101).withColumnRenamed("id", "k"), "k", 0.5, 0.25, 0.25).collect())
    assert parts["train"] == 50 and parts["test"] == 25 and sum(parts.values()) == 101


def test_yolo_writer_and_reader_agree(spark, tmp_path):
    lines = spark.createDataFrame([("train", "i1", "0 0.500000 0.500000 0.250000 0.250000"), ("train", "i1", "1 0.100000 0.100000 0.100000 0.100000"), ("val", "i2", "1 0.5 0.5 0.1 0.1")], "split string, image string, line string")
    assert tabular.write_yolo(lines, str(tmp_path), {0: "mouse", 1: "fly"}) == 2
    assert (tmp_path / "train" / "labels" / "i1.txt").read_text().count("\n") == 2
    got = tabular.read_yolo(spark, str(tmp_path), 100, 100, 0, {0: "mouse", 1: "fly"})
    assert sorted((r["split"], r["image"], r["category"]) for r in got.collect()) == [("train", "i1", "fly"), ("train", "i1", "mouse"), ("val", "i2", "fly")]
    config = projects.read_yaml((tmp_path / "data.yaml").read_text())
    assert projects.class_names(config) == {0: "mouse", 1: "fly"} and config["train"] == "train/images"
    pose = projects.read_yaml(tabular.data_yaml(["train"], {0: "m"}, (["a", "b"], [(0, 1)])))
    assert projects.yolo_skeleton(pose) == (["a", "b"], [(0, 1)])


def test_project(spark, tmp_path):
    for folder in ("v1", "v2"):
        (tmp_path / "labeled-data" / folder).mkdir(parents=True)
        (tmp_path / "labeled-data" / folder / "CollectedData_me.csv").write_text("scorer,me,me,me,me\nbodyparts,A,A,B,B\ncoords,x,y,x,y\nimg2.png,1,2,,\nimg10.png,3,4,5,6\n")
    (tmp_path / "labeled-data" / "v1" / "CollectedData_you.csv").write_text("scorer,you,you\nbodyparts,A,A\ncoords,x,y\nimg1.png,1,2\n")
    (tmp_path / "config.yaml").write_text("scorer: me\nvideo_sets:\n  C:\\vids\\v1.mp4:\n  /data/v2.avi:\nbodyparts:\n- A\n- B\nskeleton:\n- [A, B]\n- [B, C]\n")
    config = projects.read_yaml((tmp_path / "config.yaml").read_text())
    assert projects.is_project(config) and projects.find_config(str(tmp_path / "labeled-data" / "v1")) == str(tmp_path / "config.yaml")
    assert projects.node_names(config) == ["A", "B"] and projects.edges(config) == [(0, 1)]
    out = projects.read_project(spark, str(tmp_path), config)
    assert sorted((r["folder"], r["image"], r["frame_idx"]) for r in out["frames"].collect()) == [("v1", "img10.png", 1), ("v1", "img2.png", 0), ("v2", "img10.png", 1), ("v2", "img2.png", 0)]
    assert {r["folder"]: r["path"] for r in out["videos"].collect()} == {"v1": "C:\\vids\\v1.mp4", "v2": "/data/v2.avi"}
    train, test = projects.read_split(pickle.dumps(["x", np.array([0, 3, -1]), [1], 0.5]))
    got = {(r["folder"], r["image"]): r["split"] for r in projects.split_frames(spark, out["frames"], train, test).collect()}
    assert got == {("v1", "img10.png"): "train", ("v1", "img2.png"): "test", ("v2", "img10.png"): None, ("v2", "img2.png"): "train"}
    assert {r["folder"] for r in projects.misordered(out["frames"]).collect()} == {"v1", "v2"}
    with pytest.raises(pickle.UnpicklingError):
        projects.read_split(pickle.dumps([0, print, []]))


def test_label_images_of_masks(spark):
    cols = "g long, ord int, rle array<bigint>, height int, width int, scale array<double>, offset array<double>, category string"
    one = spark.createDataFrame([(0, 0, [0, 3, 1], 2, 2, None, None, "a"), (0, 1, [2, 2], 2, 2, None, None, "b")], cols)
    pixels, objects, images = label_images.from_masks(one, "g")
    assert {(r["pos"], r["label"]) for r in pixels.collect()} == {(0, 1), (1, 1), (2, 2), (3, 2)} and {(r["label_id"], r["category"]) for r in objects.collect()} == {(1, "a"), (2, "b")} and images.count() == 1
    with pytest.raises(Exception, match="differ in shape"):
        label_images.from_masks(one.withColumn("height", F.col("ord") + 2), "g")[2].collect()
    known = spark.createDataFrame([(0, 5, 2), (0, 7, 3)], "label_image_id long, label_id int, new_id long")
    data = spark.createDataFrame([(0, 0, 5), (0, 1, 6), (0, 2, 7)], "label_image_id long, pos long, label int")
    assert {(r["pos"], r["label"]) for r in label_images.relabel(data, known).collect()} == {(0, 2), (2, 3)}


def test_axes_and_transposes(spark):
    standard, matlab = (arrays.stored_axes(arrays.axis_order(p)) for p in ("standard", None))
    axes = arrays.permutation(standard, matlab)
    shape = [2, 3, 4, 5]
    want = np.arange(120).reshape(shape).transpose(axes).ravel()
    index = arrays.transposed_index(F.col("id"), [F.lit(n) for n in shape], axes)
    got = {r["j"]: r["id"] for r in spark.range(120).select("id", index.alias("j")).collect()}
    assert [got[j] for j in range(120)] == want.tolist()
    assert arrays.guess_axes("frame, track, node, xy", None) == "standard" and arrays.guess_axes(None, False) == "standard" and arrays.guess_axes(None, None) == "matlab" and arrays.guess_axes("xy,node,track,frame", None) == "custom"
    for bad in ({"preset": "standard", "places": {"frame": 0}}, {"places": {"frame": 0}}, {"preset": "what"}):
        with pytest.raises(ValueError):
            arrays.axis_order(**bad)


def test_arrow_batches_of_a_table():
    raw = np.array([(0, 2, 7, 0, 3), (1, 2, 9, 3, 3)], [("frame_id", "u8"), ("video", "u4"), ("frame_idx", "u8"), ("instance_id_start", "u8"), ("instance_id_end", "u8")])
    batch = native.SlpReader({"path": "x"}, []).batch(raw, 0)
    assert batch.to_pydict() == {"frame_id": [0, 1], "video": [2, 2], "frame_idx": [7, 9], "instance_id_start": [0, 3], "instance_id_end": [3, 3]}


def test_json_tables_take_odd_rows(spark):
    rows = spark.createDataFrame([(0, '{"video": 2}'), (1, '{"video": "1", "frameIdx": 4, "group": "g"}\x00\x00')], "ord long, value string")
    assert [(r["video_id"], r["frame_idx"], r["grp"]) for r in documents.suggestions(rows).orderBy("ord").collect()] == [(2, 0, "default"), (1, 4, "g")]
    none = spark.createDataFrame([(0, None), (1, "  ")], "ord long, value string")
    assert documents.videos(none).count() == 0
