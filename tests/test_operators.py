"""Operators on volumes and points small enough to check by hand or by brute force."""

import math
import random

import numpy as np
import pytest

from tessera.functions import volume as K
from tessera.operators import records as R
from tessera.operators import voxel as V
from tessera.sources import mrc


def table(spark, v):
    rows = [(0, *map(int, i), float(v[i])) for i in np.ndindex(v.shape)]
    return spark.createDataFrame(rows, "vol_id int, x int, y int, z int, val double")


def dense(df, shape, column="val"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.x, r.y, r.z] = r[column]
    return out


def test_tiles_do_not_change_a_smooth(spark):
    v = np.random.default_rng(1).random((9, 7, 8))
    whole, tiled = (dense(V.smooth(table(spark, v), v.shape, 0.6, tile=t), v.shape) for t in (32, 3))
    assert np.allclose(whole, tiled)
    assert math.isclose(whole.sum(), v.sum(), rel_tol=1e-9)


def test_impulse_and_constant(spark):
    v = np.zeros((7, 7, 7))
    v[3, 3, 3] = 1
    w = V.gauss_weights(0.5)
    got = dense(V.smooth(table(spark, v), v.shape, 0.5), v.shape)
    assert np.allclose(got[1:6, 3, 3], w * w[2] ** 2)
    peaks = V.extrema(table(spark, v), v.shape).collect()
    assert [(p.x, p.y, p.z) for p in peaks] == [(3, 3, 3)]
    flat = dense(V.dog(table(spark, np.full((5, 5, 5), 2.0)), (5, 5, 5), 1.0), (5, 5, 5))
    assert np.allclose(flat, 0)


def test_two_blobs(spark):
    i = np.indices((16, 16, 16))
    v = sum(np.exp(-sum((a - c) ** 2 for a in i) / 8) for c in (4, 11))
    peaks = V.extrema(V.dog(table(spark, v), v.shape, 2.0, 2.2), v.shape).orderBy("val", ascending=False).collect()
    assert {(p.x, p.y, p.z) for p in peaks[:2]} == {(4, 4, 4), (11, 11, 11)}
    assert abs(peaks[0].val - 0.04699) < 1e-4


def test_ramp_gradient(spark):
    v = np.repeat(np.arange(4.0), 9).reshape(4, 3, 3)
    d = dense(V.gradient(table(spark, v), v.shape), v.shape, "dx")
    assert (d[:3] == 1).all() and (d[3] == 0).all()


def test_eigenvalues(spark):
    a = np.random.default_rng(4).standard_normal((3, 3))
    a = a + a.T
    df = spark.createDataFrame([tuple(float(a[i]) for i in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)))], "a double, b double, c double, d double, e double, f double")
    got = df.select(*V.eigenvalues(df.a, df.b, df.c, df.d, df.e, df.f)).first()
    assert np.allclose(list(got), np.linalg.eigvalsh(a)[::-1])


def test_suppression_is_the_greedy_loop(spark):
    r = random.Random(2)
    points = list({(r.randrange(12), r.randrange(12), r.randrange(12)): r.randrange(9) for _ in range(150)}.items())
    df = spark.createDataFrame([(0, *p, float(v)) for p, v in points], "vol_id int, x int, y int, z int, val double")
    kept = []
    for p, v in sorted(points, key=lambda t: (-t[1], *t[0])):
        if all(math.dist(p, q) >= 2.5 for q in kept):
            kept.append(p)
    assert {(p.x, p.y, p.z) for p in V.suppress(df, 2.5).collect()} == set(kept)
    line = spark.createDataFrame([(0, i, 0, 0, 3.0 - i) for i in range(3)], "vol_id int, x int, y int, z int, val double")
    assert {p.x for p in V.suppress(line, 1.5).collect()} == {0, 2}


def test_best_template_refuses_many(spark):
    t = spark.range(5).selectExpr("id as template_id")
    with pytest.raises(ValueError):
        R.best_template(spark.range(1), t, t.template_id * 1.0, most_templates=4)


def test_kernels():
    v = np.random.default_rng(3).random((6, 6, 6))
    assert np.allclose(K.rotate(v, np.eye(3)), v)
    assert np.allclose(K.rotate(v, K.rotation_zyz(math.pi / 2, 0, 0)).sum(), v.sum())
    assert np.allclose(K.band_pass(v, np.ones(12)), v)
    assert np.allclose(K.shell_correlation(v, v), 1)


def test_map_volumes_keeps_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, [float(i) for i in range(8)], "a"), (2, None, None)], "id int, v array<float>, label string")
    got = K.map_volumes(df, "v", (2, 2, 2), lambda v: v + 1).orderBy("id").collect()
    assert got[0].v == [float(i) + 1 for i in range(8)] and got[1].v is None


def test_mrc_round_trip(spark, tmp_path):
    v = np.random.default_rng(5).random((3, 4, 5)).astype(np.float32)
    (tmp_path / "a.mrc").write_bytes(mrc.to_bytes(v, 2.0))
    h = mrc.read_headers(spark, f"file://{tmp_path}").first()
    assert (h.nx, h.ny, h.nz, h.mode, h.spacing) == (3, 4, 5, 2, 2.0)
    assert np.allclose(dense(mrc.read_voxels(spark, f"file://{tmp_path}"), v.shape), v)
    with pytest.raises(ValueError):
        mrc.parse_header(b"short")
