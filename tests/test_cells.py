"""Voronoi cells against known bodies, draws and their own sum."""

import numpy as np
import pytest

from tessera.operators import cells as C


def test_volumes_of_known_bodies():
    for d in (1, 2, 3, 4):
        a, b = np.concatenate((np.eye(d), -np.eye(d))), np.full(2 * d, 0.5)
        assert np.isclose(C.volume(a, b), 1)
        assert np.isclose(C.volume(np.concatenate((a, a, np.ones((1, d)))), np.concatenate((b, 2 * b, [10.0]))), 1)  # repeated and far planes
        simplex = np.concatenate((-np.eye(d), np.ones((1, d))))
        assert np.isclose(C.volume(simplex, np.array([0.0] * d + [1.0])), 1 / np.prod(range(1, d + 1)))
    assert C.volume(np.array([[1.0], [-1.0]]), np.array([1.0, -2.0])) == 0
    assert len(C.corners(np.concatenate((np.eye(3), -np.eye(3))), np.ones(6))) == 8


def test_cells_of_a_grid_are_alike():
    at = np.array(list(np.ndindex(3, 3, 3)), float) + 0.5
    for i in (0, 13, 26):
        size, far = C.cell(at[i], np.delete(at, i, 0), np.zeros(3), np.full(3, 3.0))
        assert np.isclose(size, 1) and np.isclose(far, np.sqrt(0.75))


@pytest.mark.parametrize("d,neighbours", [(2, 4), (3, 24)])
def test_cells_fill_the_box(spark, d, neighbours):
    r = np.random.default_rng(d)
    axes = ["x", "y", "z"][:d]
    at = r.random((60, d)) * [4, 2, 3][:d]
    at[:20] *= 0.1  # a crowd, and far neighbours for the others
    at[7] = at[3]
    rows = [(i, *map(float, p)) for i, p in enumerate(at)] + [(90, *[None] * d), (None, *[1.0] * d), (91, *[float("nan")] * d)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{a} double" for a in axes))
    high = [4.0, 2.0, 3.0][:d]
    got = {x.id: x.weight for x in C.voronoi_cells(df, "id", axes, [0.0] * d, high, neighbours=neighbours).collect()}
    assert set(got) == set(range(60)) and np.isclose(sum(got.values()), 1) and np.isclose(got[3], got[7])
    draws = r.random((40000, d)) * high
    best = ((draws[:, None] - at) ** 2).sum(2).argmin(1)
    share = np.bincount(best, minlength=60) / len(draws)
    share[[3, 7]] = share[[3, 7]].sum() / 2
    assert max(abs(got[i] - share[i]) for i in range(60)) < 0.01


def test_small_tables(spark):
    schema = "id int, x double"
    assert C.voronoi_cells(spark.createDataFrame([], schema), "id", ["x"], [0.0], [1.0]).count() == 0
    assert C.voronoi_cells(spark.createDataFrame([(1, 0.2)], schema), "id", ["x"], [0.0], [1.0]).first().weight == 1
    got = {r.id: r.weight for r in C.voronoi_cells(spark.createDataFrame([(1, 0.2), (2, 0.4), (3, 5.0)], schema), "id", ["x"], [0.0], [1.0]).collect()}
    assert np.isclose(got[1], 0.3) and np.isclose(got[2], 0.7) and got[3] == 0
    with pytest.raises(ValueError):
        C.voronoi_cells(spark.createDataFrame([], schema), "id", ["x"] * 5, [0.0] * 5, [1.0] * 5)


def test_many_neighbours_take_little_memory():
    """A cell among 150 others is that of the few that cut it, and takes no table of all triples of planes."""
    import tracemalloc

    at = np.random.default_rng(5).random((151, 3))
    tracemalloc.start()
    size, far = C.cell(at[0], at[1:], np.zeros(3), np.ones(3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    draws = np.random.default_rng(6).random((200000, 3))
    mine = ((draws - at[0]) ** 2).sum(1) <= np.min([((draws - o) ** 2).sum(1) for o in at[1:]], axis=0)
    assert abs(mine.mean() - size) < 4 * np.sqrt(size / len(draws)) and np.linalg.norm(draws[mine] - at[0], axis=1).max() <= far
