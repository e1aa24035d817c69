"""Operators of statistics.py and regions.py against plain loops, and on odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import regions as G
from tessera.operators import statistics as S
from tessera.streaming import windows as W


def test_running_sums(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), F.lit("x").alias("other"))
    got = S.running_sums(df, "k", ["v"], descending=True).orderBy(F.desc("k")).collect()
    assert [r["run_v"] for r in got] == np.cumsum([k % 7 for k in range(999, -1, -1)]).tolist()
    assert {r["all_v"] for r in got} == {sum(k % 7 for k in range(1000))}
    assert S.running_sums(df.limit(0), "k", ["v"]).count() == 0


def test_moments_and_axes(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(200, 3)) * [3, 1, 0.2]
    df = spark.createDataFrame([(i % 2, r.tolist()) for i, r in enumerate(data)] + [(None, [1.0, 2.0, 3.0]), (0, None)], "g int, v array<double>")
    got = {(r["g"], r["i"], r["j"]): r["cov"] for r in S.covariances(df, "g", "v", 3).collect()}
    for g in (0, 1):
        assert np.allclose([[got[g, i, j] for j in range(3)] for i in range(3)], np.cov(data[g::2].T))
    values, axes = S.principal_axes(df.where("g is not null"), "v", 3, 2)
    want, vectors = np.linalg.eigh(np.cov(data.T))
    assert np.allclose(values, want[::-1][:2]) and np.allclose(abs(axes @ vectors[:, ::-1])[:, :2], np.eye(2), atol=1e-8)


@pytest.mark.parametrize("tile", [4, 5, 32])
def test_connected_regions(spark, tile):
    rng = np.random.default_rng(3)
    on = rng.random((12, 12, 12)) < 0.33
    left, want = {tuple(map(int, p)) for p in np.argwhere(on)}, {}
    while left:
        stack, own = [left.pop()], []
        while stack:
            p = stack.pop()
            own.append(p)
            for axis in range(3):
                for step in (1, -1):
                    q = tuple(c + step * (k == axis) for k, c in enumerate(p))
                    if q in left:
                        left.remove(q)
                        stack.append(q)
        for p in own:
            want[p] = min(a * 144 + b * 12 + c for a, b, c in own)
    df = spark.createDataFrame([(7, *map(int, p)) for p in np.argwhere(on)], "vol_id int, x int, y int, z int")
    assert {(r.x, r.y, r.z): r.region for r in G.connected_regions(df, (12, 12, 12), tile=tile).collect()} == want
    assert G.connected_regions(df.limit(0), (12, 12, 12), tile=tile).count() == 0


def test_greedy_boxes(spark):
    rng = np.random.default_rng(5)
    boxes = [(i, *map(float, lo), *map(float, lo + wide), float(s)) for i, (lo, wide, s) in enumerate(zip(rng.integers(0, 60, (150, 2)), rng.integers(4, 20, (150, 2)), rng.integers(0, 9, 150)))]

    def iou(a, b):
        w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
        both = max(w, 0) * max(h, 0)
        return both / ((a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - both)

    kept: list = []
    for b in sorted(boxes, key=lambda b: (-b[5], b[0])):
        if all(iou(b, k) <= 0.2 for k in kept):
            kept.append(b)
    df = spark.createDataFrame(boxes, "id int, x1 double, y1 double, x2 double, y2 double, score double")
    pairs = G.box_pairs(df, 0.2, 16.0)
    assert {(r.a, r.b) for r in pairs.collect()} == {(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and iou(a, b) > 0.2}
    assert sorted(r.id for r in G.keep_greedily(df, pairs).collect()) == sorted(k[0] for k in kept)
    assert G.keep_greedily(df.limit(0), pairs.limit(0)).count() == 0


def test_cover(spark):
    sets = {"a": {1, 2, 3, 4}, "b": {3, 4, 5}, "c": {1, 2}, "d": {9}}
    members = spark.createDataFrame([(c, i) for c, s in sets.items() for i in s] * 2, "cluster string, id int")
    scores = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0), ("d", 0.5)], "cluster string, score double")
    assert G.cover(members, scores, 0.7) == ["a", "b", "d"]


@pytest.mark.parametrize("option", [1, 2])
def test_diffusion_is_the_same_in_tiles(spark, option):
    v = np.random.default_rng(2).normal(size=(9, 8, 7))
    want = v.copy()
    for _ in range(3):
        change = np.zeros_like(want)
        for p in np.ndindex(want.shape):
            for axis in range(3):
                for step in (1, -1):
                    q = tuple(c + step * (k == axis) for k, c in enumerate(p))
                    if 0 <= q[axis] < want.shape[axis]:
                        d = want[q] - want[p]
                        change[p] += d * (np.exp(-((d / 2) ** 2)) if option == 1 else 1 / (1 + (d / 2) ** 2))
        want = want + 0.1 * change
    df = spark.createDataFrame([(0, *map(int, p), float(v[p])) for p in np.ndindex(v.shape)], "vol_id int, x int, y int, z int, val double")
    for r in G.diffuse(df, v.shape, 3, 2.0, 0.1, option=option, tile=4).collect():
        assert abs(r.val - want[r.x, r.y, r.z]) < 1e-12


def test_accept_once(spark):
    df = spark.sql("select * from values (1, 'a'), (1, 'b'), (2, 'c') as t(task, result)")
    assert W.accept_once(df, "task").count() == 2
