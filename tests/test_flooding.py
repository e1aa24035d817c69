"""Flooding tile by tile against one queue over the whole volume."""

import numpy as np
import pytest

from tessera.operators import flooding, segmentation


def smooth(shape, seed, levels=None):
    r = np.random.default_rng(seed)
    v = r.random(shape)
    for axis in range(3):
        v = v + np.roll(v, 1, axis) + np.roll(v, 2, axis)
    return np.floor(v / v.max() * levels) if levels else v


def rows_of(vol, v, seeds):
    return [(vol, *map(int, p), float(v[tuple(p)]), int(seeds[tuple(p)])) for p in np.ndindex(v.shape)]


SCHEMA = "vol_id string, x int, y int, z int, val double, seed long"


def whole(v, seeds):
    """The untiled flood: segmentation.flood's single queue."""
    out = segmentation.flood(v, seeds)
    return {tuple(map(int, p)): int(out[tuple(p)]) for p in np.argwhere(out != 0)}


def found(df, shape, **kw):
    out = {}
    for r in flooding.watershed(df, shape, **kw).collect():
        out.setdefault(r.vol_id, {})[r.x, r.y, r.z] = r.label
    return out


@pytest.mark.parametrize("tile", [3, 5, 32])
def test_tiles_give_the_untiled_flood(spark, tile):
    shape = (9, 8, 7)
    rows, want = [], {}
    for name, levels in (("a", None), ("b", 3), ("c", 1)):
        v = smooth(shape, len(name) + (levels or 0), levels)
        seeds = np.zeros(shape, np.int64)
        r = np.random.default_rng(levels or 9)
        for k in range(1, 5):
            seeds[tuple(r.integers(0, shape))] = k
        if name == "a":
            v[3, :, :4] = np.nan  # a wall that the flood must go around
        rows += rows_of(name, v, seeds)
        want[name] = whole(v, seeds)
    assert found(spark.createDataFrame(rows, SCHEMA), shape, tile=tile) == want


def test_a_long_way_through_many_tiles(spark):
    """A winding ridge between walls: the label reaches its end tile by tile, over rising and falling values."""
    shape = (12, 12, 1)
    v = np.full(shape, np.nan)
    way = [(x, y) for x in range(0, 12, 2) for y in (range(12) if x % 4 == 0 else range(11, -1, -1))]
    for i, (x, y) in enumerate(way):
        v[x, y, 0] = 10 + 5 * np.sin(i / 3.0) + i / 100
    for x in range(1, 11, 2):
        v[x, 11 if x % 4 == 1 else 0, 0] = 3.0
    seeds = np.zeros(shape, np.int64)
    seeds[0, 0, 0], seeds[10, 0, 0] = 1, 2
    want = whole(v, seeds)
    assert len(set(want.values())) >= 2
    assert found(spark.createDataFrame(rows_of("w", v, seeds), SCHEMA), shape, tile=3) == {"w": want}


def test_missing_voxels_and_empty_tables(spark):
    rows = [("v", 0, 0, 0, 1.0, 1), ("v", 0, 0, 1, None, 0), ("v", 0, 1, 1, 2.0, None), ("v", 5, 5, 5, 9.0, 0), ("u", 1, 1, 1, 1.0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df, (6, 6, 6), tile=2) == {"v": {(0, 0, 0): 1, (0, 1, 1): 1}}
    assert found(df.limit(0), (6, 6, 6)) == {}


def test_a_region_behind_conflicts_is_not_fed_by_its_own_label(spark):
    """Noise with many seeds: conflicts wall regions in, whose tiles would pass a label back and forth."""
    shape = (9, 9, 6)
    r = np.random.default_rng(11)
    v = r.random(shape)
    seeds = np.zeros(shape, np.int64)
    for k in range(1, 13):
        seeds[tuple(r.integers(0, shape))] = k
    want = whole(v, seeds)
    assert min(want.values()) == -1
    assert found(spark.createDataFrame(rows_of("n", v, seeds), SCHEMA), shape, tile=5) == {"n": want}
