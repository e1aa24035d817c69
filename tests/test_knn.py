"""The nearest-neighbour join over pivots against all pairs."""

import numpy as np
import pytest

from tessera.operators import knn

SCHEMA = "id long, v array<float>"


def plain(rows, k):
    rows = [(i, np.array(v, float)) for i, v in rows]
    x = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    out = {}
    for n, (i, v) in enumerate(rows):
        d = ((x - v) ** 2).sum(1)
        order = [j for j in np.lexsort((ids, d)) if j != n][:k]
        out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def found(df, k):
    out = {}
    for r in sorted(knn.nearest(df, "id", "v", k).collect(), key=lambda r: (r.id, r["rank"])):
        out.setdefault(r.id, []).append((r.other, r.distance2))
        assert r["rank"] == len(out[r.id])
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for i, rows in want.items():
        assert [o for o, _ in got[i]] == [o for o, _ in rows] and np.allclose([d for _, d in got[i]], [d for _, d in rows])


def clouds(seed=1, n=400, size=6):
    """Clusters far apart, a scattered rest, a hot vector and repeated ones; integer parts make ties."""
    r = np.random.default_rng(seed)
    x = r.integers(-3, 4, (n, size)) + 100 * r.integers(0, 5, (n, 1))
    x[: n // 3] = x[0]
    x[-40:] = r.integers(-500, 500, (40, size))
    return [(int(i), [float(e) for e in v]) for i, v in zip(r.permutation(n), x)]


@pytest.mark.parametrize("block,pivot_bytes", [(2048, 4 << 20), (16, 4 << 20), (50, 100)])
def test_equal_to_all_pairs(spark, monkeypatch, block, pivot_bytes):
    monkeypatch.setattr(knn, "BLOCK", block)
    monkeypatch.setattr(knn, "PIVOT_BYTES", pivot_bytes)
    rows = clouds()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for k in (1, 5):
        same(found(df, k), plain(rows, k))


def test_small_and_odd_tables(spark):
    rows = [(1, [0.0, 1.0]), (2, [0.0, -1.0]), (3, [-0.0, 1.0])]
    odd = [(4, None), (None, [1.0, 1.0]), (5, [float("nan"), 0.0]), (6, [1.0]), (7, [None, 1.0]), (8, [float("inf"), 0.0]), (9, [])]
    same(found(spark.createDataFrame(rows + odd, SCHEMA), 5), plain(rows, 5))
    assert found(spark.createDataFrame(rows[:1], SCHEMA), 3) == {}
    assert found(spark.createDataFrame([], SCHEMA), 3) == {}


def test_a_query_meets_few_cells(spark, monkeypatch):
    """Far clusters: the triangle inequality keeps copies of queries out of the other clusters' cells."""
    copies = []
    blocks = knn._blocks
    monkeypatch.setattr(knn, "_blocks", lambda rows, parts, size: copies.append(rows.count()) or blocks(rows, parts, size))
    r = np.random.default_rng(3)
    rows = [(i, (r.standard_normal(4) + 1000 * (i % 8)).tolist()) for i in range(800)]
    found(spark.createDataFrame(rows, SCHEMA), 3)
    held, own, sent = copies
    assert held == own == 800 and sent < 800 * 28 / 4


@pytest.mark.parametrize("shard_bytes", [32 << 20, 1 << 15])
def test_a_query_goes_once_to_a_shard(spark, monkeypatch, shard_bytes):
    """Vectors without structure, whose bounds exclude no cell: copies are as many as shards, not as cells."""
    monkeypatch.setattr(knn, "SHARD_BYTES", shard_bytes)
    copies = []
    tiles = knn._tiles

    def counted(*a):
        left, right = tiles(*a)
        copies.append(left.selectExpr("sum(length(ids) / 8)").first()[0])
        return left, right

    monkeypatch.setattr(knn, "_tiles", counted)
    v = np.random.default_rng(4).standard_normal((500, 24))
    rows = [(i, [float(np.float32(e)) if i % 2 else float(e) for e in x]) for i, x in enumerate(v / np.linalg.norm(v, axis=1)[:, None])]
    got = found(spark.createDataFrame(rows, "id long, v array<double>"), 5)
    same(got, plain(rows, 5))
    assert copies[0] <= 500 * -(-500 * 24 * 8 // shard_bytes)
