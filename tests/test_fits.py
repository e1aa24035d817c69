"""Weighted component fits and local polynomials against plain numpy."""

import numpy as np
import pytest

from tessera.functions.lines import local_polynomial, smooth_rows
from tessera.operators import fitting as T
from tessera.operators import records as R


def test_local_polynomials():
    # the published weights of five and seven places
    assert np.allclose(local_polynomial(5, 2) * 35, [-3, 12, 17, 12, -3])
    assert np.allclose(local_polynomial(7, 3) * 21, [-2, 3, 6, 7, 6, 3, -2])
    assert np.allclose(local_polynomial(5, 2, 1) * 10, [-2, -1, 0, 1, 2])
    x = np.arange(20.0)
    cubic = 1 + x - 0.3 * x**2 + 0.01 * x**3
    assert np.allclose(smooth_rows(cubic, 7)[3:-3], cubic[3:-3])
    assert np.allclose(smooth_rows(cubic, 7, 3, 1)[3:-3], (1 - 0.6 * x + 0.03 * x**2)[3:-3])
    with pytest.raises(ValueError):
        local_polynomial(3, 3)


def test_smoothing_of_a_column(spark):
    r = np.random.default_rng(1)
    v = r.standard_normal((5, 12))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(9, None), (10, [])], "id int, v array<double>")
    got = {x.id: x.s for x in df.select("id", R.local_polynomials("v", 12, 5, 2).alias("s")).collect()}
    want = smooth_rows(v, 5, 2)
    assert all(np.allclose(got[i], want[i]) for i in range(5)) and got[9] == got[10] == [0.0] * 12


def plain_fit(x, w, axes):
    d = np.empty_like(x)
    for i in range(len(x)):
        c = np.linalg.lstsq(np.sqrt(w[i])[:, None] * axes.T, np.sqrt(w[i]) * x[i], rcond=None)[0]
        d[i] = x[i] - c @ axes
    seen = w > 0
    chi2 = (w * d * d).sum()
    return chi2, chi2 / (seen.sum() - axes.size - len(axes) * len(x)), 1 - d[seen].var() / x[seen].var()


def test_fit_with_missing_values(spark):
    r = np.random.default_rng(2)
    g = np.linspace(0, 1, 16)
    true = np.linalg.qr(np.stack((np.sin(3 * g), np.cos(5 * g)), 1))[0].T
    x = r.standard_normal((120, 2)) * [3, 1] @ true + 0.02 * r.standard_normal((120, 16))
    w = r.choice([0.0, 0.5, 1.0, 2.0], x.shape)
    x[w == 0] = 1e3  # what has no weight may hold anything
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, w)] + [([1.0], [1.0]), (None, None)], "v array<double>, w array<double>")
    for smooth in (0, 5):
        axes = T.weighted_components(df, "v", "w", 16, 2, rounds=30, smooth=smooth)
        assert np.allclose(axes @ axes.T, np.eye(2))
        if not smooth:
            assert np.allclose(axes.T @ axes, true.T @ true, atol=0.05)
        fit = T.component_fit(df, "v", "w", axes)
        assert np.allclose([fit["chi2"], fit["reduced"], fit["r2"]], plain_fit(x, w, axes), rtol=1e-6)
        assert fit["rows"] == 120 and fit["values"] == (w > 0).sum()
    assert all(np.isnan(v) for v in T.component_fit(df.limit(0), "v", "w", axes).values())


def test_smoothed_axes_are_smoother(spark):
    r = np.random.default_rng(4)
    g = np.linspace(0, 1, 24)
    axis = np.sin(3 * g) / np.linalg.norm(np.sin(3 * g))
    x = r.standard_normal((40, 1)) * axis + 0.5 * r.standard_normal((40, 24))
    df = spark.createDataFrame([(a.tolist(), [1.0] * 24) for a in x], "v array<double>, w array<double>")
    rough, fine = (T.weighted_components(df, "v", "w", 24, 1, smooth=s)[0] for s in (0, 9))
    bend = lambda a: np.abs(np.diff(a[5:-5], 2)).sum()
    assert bend(fine) < bend(rough) / 2
