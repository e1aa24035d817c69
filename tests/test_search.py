"""The combined search over turns and translations against planted poses and grids."""

import numpy as np
import pytest

from tessera.functions import harmonics as H
from tessera.functions import rotation as K
from tessera.functions import turns
from tessera.operators import alignment as A

N = 14


def blob(seed):
    r = np.random.default_rng(seed)
    g = np.indices((N, N, N)).reshape(3, -1).T - (N - 1) / 2
    v = sum(r.uniform(0.5, 1.5) * np.exp(-((g - r.uniform(-3.5, 3.5, 3)) ** 2).sum(1) / 4) for _ in range(6))
    return v.reshape(N, N, N)


def wedge(tilt=60):
    k = np.indices((N, N, N)) - N // 2
    return (np.abs(k[2]) <= np.abs(k[0]) * np.tan(np.radians(tilt)) + 1e-9).astype(float)


def record(v, angle, loc, mask):
    """What the pose turns onto v, as a tilt series under the mask shows it."""
    w = K.rotate(v, *K.inverse(angle, loc))
    return np.fft.ifftn(np.fft.fftn(w) * np.fft.ifftshift(mask)).real


def test_correlations_are_sums_over_wigner_matrices():
    r = np.random.default_rng(4)
    most, radii = 3, np.array([1.0, 2.0, 3.0])
    count = (most + 1) ** 2
    a, b = (r.standard_normal((2, 3, count)) + 1j * r.standard_normal((2, 3, count)) for _ in range(2))
    a[1] = b[1]
    cube = turns.correlations(a, b, radii, most)
    names = [(n, m) for n in range(most + 1) for m in range(-n, n + 1)]
    n = 2 * most + 2
    for at in ((0, 0, 0), (1, 5, 2), (7, 3, 6)):
        xi, eta, omega = 2 * np.pi * np.array(at) / n
        zyz = (xi - np.pi / 2, eta - np.pi, omega - np.pi / 2)
        for i in range(2):
            want = H.rotational_correlation([dict(zip(names, x)) for x in a[i]], [dict(zip(names, x)) for x in b[i]], radii, most, [zyz])[0]
            assert np.isclose(cube[(i, *at)], want)


def test_shells_are_those_of_a_plain_transform():
    v = blob(1)
    most = 4
    theta, _, phi = H.angles(most)
    got = turns.shells(v[None], (6, 6, 6), np.array([2.0]), most)[0, 0]
    t, f = np.meshgrid(theta, phi, indexing="ij")
    at = np.stack((np.sin(t) * np.cos(f), np.sin(t) * np.sin(f), np.cos(t)), -1).reshape(-1, 3) * 2 + 6
    want = H.forward(K.sample(v[None], at, order=1)[0].reshape(t.shape), most)
    assert np.allclose(got, [want[n, m] for n in range(most + 1) for m in range(-n, n + 1)])


@pytest.mark.parametrize("seed", range(5))
def test_planted_poses_are_found(seed):
    r = np.random.default_rng(100 + seed)
    v, ones = blob(seed), np.ones((N, N, N))
    angle = (r.uniform(0, 6.28), np.arccos(r.uniform(-1, 1)), r.uniform(0, 6.28))
    loc = r.integers(-2, 3, 3).astype(float)
    for mask in (ones, wedge()):
        w = record(v, angle, loc, mask)
        score, found, shift, err = A.search(v, ones, w, mask)
        ((truth, *_),) = A.align(v, ones, w[None], mask[None], [angle])
        assert err is None and score > truth - 0.02
        assert np.abs(shift).max() < N / 2 and K.difference(found, found) < 1e-9


def test_no_worse_than_a_grid():
    v, mask = blob(7), wedge()
    w = record(v, (0.7, 1.1, 2.0), (1.0, 0.0, -1.0), mask)
    grid = K.angle_grid(np.pi / 5)
    ((best, *_),) = A.align(v, np.ones_like(v), w[None], mask[None], grid)
    assert A.search(v, np.ones_like(v), w, mask, refine=8)[0] >= best - 1e-6


def test_without_signal():
    v = blob(3)
    score, angle, loc, err = A.search(v, np.ones_like(v), v, np.zeros_like(v))
    assert np.isnan(score) and err and not angle.any() and not loc.any()
    assert A.search(np.zeros_like(v), np.ones_like(v), v, np.ones_like(v))[3]


def test_records_meet_their_own_templates(spark):
    ones = [1.0] * N**3
    vs = [blob(1), blob(2)]
    schema = "template_id int, v array<double>, m array<double>"
    templates = spark.createDataFrame([(i, v.ravel().tolist(), ones) for i, v in enumerate(vs)], schema)
    angle = K.angle_grid(np.pi / 2)[5]
    rows = [(i, i % 2, K.rotate(vs[i % 2], K.inverse(angle, (0, 0, 0))[0]).ravel().tolist(), ones) for i in range(4)]
    rows += [(10, 1, [float("nan")] * N**3, ones), (11, 5, ones, ones), (12, 0, None, ones), (13, None, ones, ones)]
    records = spark.createDataFrame(rows, "id long, " + schema)
    for found in (A.search_own(records, templates, "id", (N, N, N), most=4, peaks=6, refine=2), A.align_own(records, templates, "id", (N, N, N), [angle])):
        got = {r.id: r for r in found.collect()}
        assert set(got) == {0, 1, 2, 3, 10} and got[10].err and np.isnan(got[10].score)
        assert all(got[i].template_id == i % 2 and got[i].err is None and got[i].score > 0.95 for i in range(4))
    assert A.search_own(records.limit(0), templates, "id", (N, N, N)).count() == 0
