"""Level sets over cubes against one whole volume."""

import numpy as np
import pytest

from tessera.functions.lines import implicit_step, nearest_squares
from tessera.operators import levelset, segmentation

SCHEMA = "vol_id string, x int, y int, z int, val double"


def bubbles(shape, seed=1):
    r = np.random.default_rng(seed)
    g = np.indices(shape)
    v = sum(np.exp(-sum((a - c) ** 2 for a, c in zip(g, r.random(3) * (np.array(shape) - 1))) / 6) for _ in range(3))
    return v + 0.05 * r.standard_normal(shape)


def rows_of(vol, v):
    return [(vol, *map(int, p), float(v[tuple(p)])) for p in np.ndindex(v.shape)]


def test_lines():
    r = np.random.default_rng(0)
    f = np.where(r.random((12, 3, 2)) < 0.2, 0.0, 1e4)
    i = np.arange(12)
    assert np.allclose(nearest_squares(f), (f[None] + ((i[:, None] - i) ** 2)[:, :, None, None]).min(1))
    for n in (1, 2, 9):
        d, t = r.standard_normal((n, 2, 3)), 0.7
        a = np.diag(np.full(n, 1 + 2 * t)) - t * (np.eye(n, k=1) + np.eye(n, k=-1))
        a[0, 0] -= t
        a[-1, -1] -= t
        assert np.allclose(implicit_step(d, t), np.tensordot(np.linalg.inv(a), d, 1))


@pytest.mark.parametrize("tile", [3, 4, 16])
def test_cubes_give_the_level_set_of_the_whole(spark, tile):
    shape = (10, 9, 7)
    volumes = {"a": bubbles(shape), "b": -bubbles(shape, 5), "flat": np.full(shape, 3.0)}
    df = spark.createDataFrame([r for n, v in volumes.items() for r in rows_of(n, v)], SCHEMA)
    got = {}
    for r in levelset.level_set(df, shape, tile=tile).collect():
        got.setdefault(r.vol_id, np.full(shape, np.nan))[r.x, r.y, r.z] = r.phi
    assert set(got) == {"a", "b"}
    for n, phi in got.items():
        want = segmentation.two_phase(volumes[n])
        assert np.allclose(phi, want, atol=1e-8) and (phi >= 0).any() and (phi < 0).any()


def test_segments_are_bright_components(spark):
    shape = (12, 8, 8)
    g = np.indices(shape)
    ball = lambda c, r: sum((a - b) ** 2 for a, b in zip(g, c)) <= r * r
    v = 1.0 * ball((3, 4, 4), 2.5) + 1.0 * ball((9, 4, 4), 1.2)
    df = spark.createDataFrame(rows_of("v", v), SCHEMA)
    out = levelset.segments(df, shape, tile=5, smooth=0.05).collect()
    parts = {}
    for r in out:
        parts.setdefault(r.region, set()).add((r.x, r.y, r.z))
        assert r.phi > 0
    assert sorted(len(p) for p in parts.values())[-1] > 30 and any((3, 4, 4) in p for p in parts.values())
    large = levelset.segments(df, shape, tile=5, smooth=0.05, least=30).collect()
    assert {r.region for r in large} == {k for k, p in parts.items() if len(p) >= 30}


def test_missing_voxels_are_zero_and_empty_tables(spark):
    shape = (5, 5, 5)
    v = np.zeros(shape)
    v[1:3, 1:4, 2:4] = 2.0
    df = spark.createDataFrame([r for r in rows_of("v", v) if r[4]], SCHEMA)
    got = {(r.x, r.y, r.z): r.phi for r in levelset.level_set(df, shape, tile=2).collect()}
    want = segmentation.two_phase(v)
    assert len(got) == 125 and all(np.isclose(p, want[k]) for k, p in got.items())
    assert levelset.level_set(df.limit(0), shape).count() == 0
