"""Whole batches of polygons and masks give what one at a time gives, and faster."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinemill.functions import geometry as G
from kinemill.functions import raster as R

RINGS = pa.list_(pa.list_(pa.list_(pa.float64())))


def ring(rng) -> list:
    """0 to 9 points, most in the mask, on its lines or centres; closed or not."""
    n = rng.randrange(9)
    points = [[float(rng.choice([rng.uniform(-5, 20), rng.randrange(-4, 20), rng.randrange(-4, 20) + 0.5])) for _ in range(2)] for _ in range(n)]
    return points + points[:1] if rng.random() < 0.9 else points


def some(rng, make, n: int) -> list:
    return [None if rng.random() < 0.05 else make() for _ in range(n)]


def polygons(rng, n: int) -> list:
    return some(rng, lambda: [ring(rng) for _ in range(rng.randrange(4))], n)


def sides(rng, n: int) -> tuple[list, list]:
    return [rng.choice([0, 1, 7, 12, 16]) for _ in range(n)], [rng.choice([0, 1, 5, 9, 16]) for _ in range(n)]


def test_wkb_of_batches():
    own = polygons(random.Random(1), 800)
    a = pa.array(own, RINGS)
    w = R.wkb_of_rings.func(a)
    assert w.to_pylist() == [None if p is None else R.to_wkb({"type": "Polygon", "coordinates": p}) for p in own]
    assert R.rings_of_wkb.func(w).to_pylist() == own
    assert R.rings_of_wkb.func(R.wkb_of_rings.func(a.slice(7, 90))).to_pylist() == own[7:97] == R.rings_of_wkb.func(w.slice(7, 90)).to_pylist()
    big = bytes.fromhex("00 00000003 00000001 00000001 3ff0000000000000 4000000000000000")
    little = R.to_wkb({"type": "Polygon", "coordinates": [[[3.0, 4.0], [5.0, 6.0]], []]})
    assert R.rings_of_wkb.func(pa.array([big, None, R.to_wkb({"type": "Point", "coordinates": [1.0, 2.0]}), little])).to_pylist() == [[[[1.0, 2.0]]], None, None, [[[3.0, 4.0], [5.0, 6.0]], []]]
    for bad in (little[:-1], little + b"\0", little[:7], b"\1"):
        with pytest.raises(ValueError):
            R.rings_of_wkb.func(pa.array([little, bad]))


def test_runs_of_batches():
    rng = random.Random(2)
    own, (h, w) = polygons(rng, 1500), sides(rng, 1500)
    one = lambda kind, p, *size: None if p is None else R.rle(R.rasterize({"type": kind, "coordinates": p}, *size))
    assert R.rle_of_rings.func(pa.array(own, RINGS), pa.array(h), pa.array(w)).to_pylist() == [one("Polygon", *v) for v in zip(own, h, w, strict=True)]
    with pytest.raises(ValueError):
        R.rle_of_rings.func(pa.array([[[[0.0, 0.0], [1.0, float("nan")], [2.0, 2.0], [0.0, 0.0]]]], RINGS), pa.array([4]), pa.array([4]))


def test_batches_are_much_faster():
    rng = random.Random(3)
    own = [[[[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]] for x, y, w, h in ([float(rng.randrange(1, 30)) for _ in range(4)] for _ in range(3000))]
    a, size = pa.array(own, RINGS), pa.array([64] * len(own))
    began = time.process_time()
    want = [R.rle(R.rasterize(R.from_wkb(R.to_wkb({"type": "Polygon", "coordinates": p})), 64, 64)) for p in own]
    plain = time.process_time() - began
    began = time.process_time()
    got = R.rle_of_rings.func(R.rings_of_wkb.func(R.wkb_of_rings.func(a)), size, size)
    assert time.process_time() - began < plain / 5
    assert got.to_pylist() == want


def test_runs_of_several_polygons():
    rng = random.Random(4)
    own, (h, w) = some(rng, lambda: [p for p in polygons(rng, rng.randrange(4)) if p is not None], 1000), sides(rng, 1000)
    want = [None if p is None else R.rle(R.rasterize({"type": "MultiPolygon", "coordinates": p}, *size)) for p, *size in zip(own, h, w, strict=True)]
    assert R.rle_of_polygons.func(pa.array(own, pa.list_(RINGS)), pa.array(h), pa.array(w)).to_pylist() == want


@pytest.mark.parametrize("pixels", [500, 4_000_000])
def test_contours_of_batches(pixels, monkeypatch):
    """Masks of noise (holes, corners that touch, several regions) and of rectangles, in parts of few and many."""
    monkeypatch.setattr(R, "_PIXELS", pixels)
    rng = random.Random(5)
    masks = []
    for _ in range(1500):
        h, w = rng.choice([(1, 1), (3, 4), (6, 5), (12, 16), (0, 3)])
        m = (np.random.default_rng(rng.randrange(10**9)).random((h, w)) < rng.random()).astype(np.uint8)
        if rng.random() < 0.5:
            m[:] = 0
            y, x = sorted(rng.choices(range(h + 1), k=2)), sorted(rng.choices(range(w + 1), k=2))
            m[y[0] : y[1], x[0] : x[1]] = 1
        masks.append(m)
    runs = [None if k % 50 == 7 else R.rle(m) for k, m in enumerate(masks)]
    want = [None if r is None else R.polygons(R.contours(m)) or None for r, m in zip(runs, masks, strict=True)]
    got = R.polygons_of_rle.func(pa.array(runs, pa.list_(pa.int64())), pa.array([m.shape[0] for m in masks]), pa.array([m.shape[1] for m in masks]))
    assert got.to_pylist() == want and sum(len(v) > 1 for v in want if v) > 100 and sum(len(v) == 1 == len(v[0]) for v in want if v) > 400
    with pytest.raises(ValueError):
        R.polygons_of_rle.func(pa.array([[1, 2]]), pa.array([2]), pa.array([2]))


def test_contours_of_batches_are_much_faster():
    rng = random.Random(6)
    runs = [[17, *[w, 16 - w] * (h - 1), w, 192 - 17 - 16 * (h - 1) - w] for w, h in ((rng.randrange(1, 12), rng.randrange(2, 9)) for _ in range(3000))]
    a, sizes = pa.array(runs, pa.list_(pa.int64())), (pa.array([12] * len(runs)), pa.array([16] * len(runs)))
    began = time.process_time()
    want = [R.polygons(R.contours(np.repeat(np.arange(len(r)) % 2, r).reshape(12, 16))) for r in runs]
    plain = time.process_time() - began
    began = time.process_time()
    got = R.polygons_of_rle.func(a, *sizes)
    assert time.process_time() - began < plain / 5
    assert got.to_pylist() == want


def test_areas_of_several_polygons(spark):
    rng = random.Random(7)
    own = [(k, v) for k, v in enumerate(some(rng, lambda: [p for p in polygons(rng, rng.randrange(4)) if p is not None], 300))]
    d = spark.createDataFrame(own, "id int, g array<array<array<array<double>>>>")
    got = d.select(R.area_of_polygons("g").alias("a"), F.aggregate("g", F.lit(0.0), lambda s, rings: s + G.polygon_area(rings)).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and sum(r["a"] is None for r in got) > 5
