"""Matchers, pixels and tensors over larger whole tables give what SQL or brute force gives."""

from __future__ import annotations

import random

import duckdb
import pytest
from test_oracle import TABLES, rows

from kinemill.operators import matching
from kinemill.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", "a12_dense_tensor f12_wkb_and_raster f16_mask_contours j09_skeleton_overlap j09_skeleton_subset j10_skeleton_structure j13_video_cascade s41_geojson t01_extract".split())
def test_whole_tables(name, spark, duck):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_classes_spelt_out_are_all_pairs(spark):
    rng = random.Random(6)
    own = {k: sorted(rng.sample("abcde", rng.randrange(1, 6))) for k in range(150, 350)}
    sk = spark.createDataFrame([(k, v, [], []) for k, v in own.items()], "skeleton_id long, nodes array<string>, edges array<struct<src:int,dst:int>>, symmetries array<struct<a:int,b:int>>")
    brute = {"overlap": lambda a, b: len(a & b) >= 0.5 * len(a | b), "subset": lambda a, b: a <= b, "structure": lambda a, b: a == b}
    for method, holds in brute.items():
        want = {(i, j) for i, a in own.items() for j, b in own.items() if holds(set(a), set(b))}
        members, classes = matching.skeleton_classes(sk, method)
        of = {r["skeleton_id"]: r["class_id"] for r in members.collect()}
        pairs = {(r["a_class_id"], r["b_class_id"]) for r in matching.class_pairs(classes, classes, method).collect()}
        assert classes.count() <= 31 and {(i, j) for i in own for j in own if (of[i], of[j]) in pairs} == want
        spelt = [(r["a_skeleton_id"], r["b_skeleton_id"]) for r in matching.skeleton_matches(sk, sk, method).collect()]
        assert len(spelt) == len(want) and set(spelt) == want


def test_cascade_equals_pairwise(spark):
    rng = random.Random(9)
    one = lambda k: (k, [rng.choice(["/d/", "C:\\m\\", "/d/e/"]) + rng.choice("ab") + "/" + rng.choice(["v.mp4", "w.mp4"])] if rng.random() < 0.95 else [], rng.choice([None, 10, 11]), rng.choice([None, 8, 9]), rng.choice([None, 8]), rng.choice([None, None, [1, 2]]))
    a, b = [one(k) for k in range(25)], [one(k) for k in range(1000, 1060)]
    parts = lambda v: [p for p in v[1][0].replace("\\", "/").split("/") if p] if v[1] else []
    want = {}
    for v in b:
        viable = [u for u in a if all(p is None or q is None or p == q for p, q in zip(u[2:5], v[2:5], strict=True)) and not (u[1] == v[1] != [] and u[5] != v[5])]
        same = [u[0] for u in viable if u[1] == v[1] != []]
        leaf = [c[0] for d in range(1, len(parts(v)) + 1) if len(c := [u[0] for u in viable if len(parts(u)) >= d and parts(u)[-d:] == parts(v)[-d:]]) == 1]
        want[v[0]] = (min(same), "path") if same else (leaf[0], "leaf") if leaf else (None, None)
    kinds = "video_id long, filenames array<string>, n_frames int, height int, width int, crop array<int>"
    got = {r["video_id"]: (r["base_id"], r["stage"]) for r in matching.video_map(spark.createDataFrame(b, kinds), spark.createDataFrame(a, kinds)).collect()}
    assert got == want and {s for _, s in got.values()} == {"path", "leaf", None}


def test_video_methods_equal_pairwise_and_plan_no_cross_join(spark, capsys):
    rng = random.Random(3)
    some = lambda *v: rng.choice([None, *v])
    one = lambda k: (k, rng.choice([None, [], [rng.choice(["/d/a.png", "C:\\\\m\\\\a.png", "/e/b.png"]), rng.choice(["/x/c.png", "/y/b.png"])]]), some(8, 9), some(8, 9), some(8), some(1, 3), some("x", "y"), some(True, False))
    a, b = [one(k) for k in range(40)], [one(k) for k in range(1000, 1080)]
    norm = lambda p: p.replace("\\", "/").replace("//", "/")
    head = lambda v: norm(v[1][0]) if v[1] else None
    names = lambda v: {norm(p).split("/")[-1] for p in v[1] or []}
    known = lambda p, q: p is not None and p == q
    brute = {
        "path": lambda u, v: known(head(u), head(v)), "basename": lambda u, v: bool(head(u) and head(v)) and head(u).split("/")[-1] == head(v).split("/")[-1],
        "content": lambda u, v: u[2] == v[2] and known(u[3], v[3]) and known(u[4], v[4]) and u[5:7] == v[5:7], "shape": lambda u, v: all(map(known, u[3:6], v[3:6])),
        "image_dedup": lambda u, v: bool(u[7] and v[7] and names(u) & names(v)),
    }
    kinds = "video_id long, filenames array<string>, n_frames int, height int, width int, channels int, backend string, is_sequence boolean"
    base, incoming = spark.createDataFrame(a, kinds), spark.createDataFrame(b, kinds)
    for method, holds in brute.items():
        out = matching.video_map(incoming, base, method)
        assert {r["video_id"]: r["base_id"] for r in out.collect()} == {v[0]: min((u[0] for u in a if holds(u, v)), default=None) for v in b}, method
        out.explain()
        assert not {"NestedLoop", "Cartesian"} & {w for w in ("NestedLoop", "Cartesian") if w in capsys.readouterr().out}


def test_more_than_100000_base_videos(spark):
    v = spark.range(200_002).selectExpr("id AS video_id", "id div 2 AS height", "7 AS width", "1 AS channels")
    out = matching.video_map(v.where("video_id % 2 = 1"), v.where("video_id % 2 = 0"), "shape")
    assert out.where("base_id = video_id - 1").count() == out.count() == 100_001
