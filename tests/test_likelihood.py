"""Maximum-likelihood averages against a plain version, planted poses and classes."""

import numpy as np
import pytest

from tessera.functions import rotation as K
from tessera.functions.spectra import frequencies
from tessera.operators import likelihood as L

TURNS = K.angle_grid(np.pi / 2)
SHAPE = (5, 5, 5)
SCHEMA = "id long, v array<double>, m array<double>"


def blob(seed):
    r = np.random.default_rng(seed)
    g = np.indices(SHAPE)
    return sum(r.uniform(0.6, 1.6) * np.exp(-sum((a - c) ** 2 for a, c in zip(g, r.random(3) * 4)) / 1.2) for _ in range(3))


def records(seed, n, kinds, turns, noise, shifts=1, wedge=False):
    r = np.random.default_rng(seed)
    out, truth = [], []
    for i in range(n):
        k, t = int(r.integers(len(kinds))), int(r.integers(len(turns)))
        q = r.integers(-shifts, shifts + 1, 3)
        v = np.roll(K.rotate(kinds[k], K.inverse(turns[t], (0, 0, 0))[0]), q, (0, 1, 2)) + noise * r.standard_normal(SHAPE)
        m = np.ones(SHAPE)
        if wedge and i % 2:
            m[:, :, [0, 4]] = 0
        out.append((i, v.ravel().tolist(), m.ravel().tolist()))
        truth.append((k, t, q))
    return out, truth


def plain_total(model, turns, v, m):
    """The log total of one record over class, turn and translation, place by place."""
    size = v.size
    mask = np.fft.ifftshift(m)
    x = np.fft.fftn(v) * mask
    terms = []
    for k in range(len(model.a)):
        for t in turns:
            b = K.rotate(model.a[k], K.inverse(t, (0, 0, 0))[0])
            for q in np.ndindex(v.shape):
                e = (np.abs(np.fft.fftn(np.roll(b, q, (0, 1, 2))) * mask - x) ** 2).sum() / size
                far = sum(f[q] ** 2 for f in frequencies(v.shape))
                terms.append(-e / (2 * model.sigma2) - far / (2 * model.xi**2) + np.log(model.alpha[k]))
    return np.logaddexp.reduce(terms), max(terms)


@pytest.mark.parametrize("part", [64, 2])
def test_totals_are_sums_over_all_places(spark, monkeypatch, part):
    monkeypatch.setattr(L, "PART", part)
    rows, _ = records(1, 4, [blob(1), blob(2)], TURNS[:5], 0.1, wedge=True)
    model = L.Model(np.array([blob(3), blob(4)]), np.array([0.3, 0.7]), 0.05, 1.5)
    found = {r.id: r for r in L._expected(L._usable(spark.createDataFrame(rows, SCHEMA), "id", SHAPE), "id", SHAPE, TURNS[:5], model).collect()}
    for i, v, m in rows:
        total, top = plain_total(model, TURNS[:5], np.array(v).reshape(SHAPE), np.array(m).reshape(SHAPE))
        assert np.isclose(found[i].total, total) and np.isclose(found[i].top, top)


@pytest.mark.parametrize("wedge", [False, True])
def test_likelihood_never_falls(spark, wedge):
    kinds = [blob(1), blob(7)]
    rows, _ = records(3, 40, kinds, TURNS[:6], 0.15, wedge=wedge)
    model, history, _ = L.averages(spark.createDataFrame(rows, SCHEMA), "id", SHAPE, TURNS[:6], 2, rounds=8, tolerance=0.0)
    assert len(history) > 3 and all(b >= a - 1e-6 * abs(a) for a, b in zip(history, history[1:]))
    assert np.isclose(model.alpha.sum(), 1) and history[-1] > history[0]


def test_planted_classes_and_poses(spark):
    kinds = [blob(1), blob(7)]
    turns = TURNS[:8]
    rows, truth = records(5, 60, kinds, turns, 0.05)
    seeds = np.array([K.rotate(k, turns[3]) + 0.05 for k in kinds])  # a start that is turned as a whole
    start = L.Model(seeds, np.array([0.5, 0.5]), 0.05, 2.0)
    model, _, found = L.averages(spark.createDataFrame(rows, SCHEMA), "id", SHAPE, TURNS, 2, rounds=10, model=start)
    found = {r.id: r for r in found.collect()}
    right = 0
    for (i, v, _), (k, _, _) in zip(rows, truth):
        r = found[i]
        right += r.k == k
        v = np.array(v).reshape(SHAPE)
        # the pose turns the record onto its class's average
        moved = np.roll(K.rotate(v, r.angle), np.rint(r["loc"]).astype(int), (0, 1, 2))
        same = np.corrcoef(moved.ravel(), model.a[r.k].ravel())[0, 1]
        assert same > 0.9
        assert r.share > 0.3
    assert right == 60
    assert model.sigma2 < 0.01 and abs(model.alpha[0] - np.mean([k == 0 for k, _, _ in truth])) < 0.05
    for k in range(2):
        best = max(np.corrcoef(np.roll(K.rotate(model.a[k], t), q, (0, 1, 2)).ravel(), kinds[k].ravel())[0, 1] for t in TURNS for q in [(0, 0, 0)])
        assert best > 0.95


def test_odd_rows_and_empty_tables(spark):
    rows, _ = records(2, 3, [blob(1)], TURNS[:1], 0.1)
    odd = [(10, None, None), (11, [1.0], [1.0]), (12, [float("nan")] * 125, [1.0] * 125), (13, rows[0][1], None)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    _, history, found = L.averages(df, "id", SHAPE, TURNS[:2], 1, rounds=2)
    assert history and {r.id for r in found.collect()} == {0, 1, 2}
    model, history, found = L.averages(df.limit(0), "id", SHAPE, TURNS[:2], 2)
    assert history == [] and found.count() == 0 and not model.a.any()
    with pytest.raises(ValueError):
        L.start(df, "id", (300, 300, 300), 64)
