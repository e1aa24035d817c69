"""Alignment, averaging, fits, segmentation and selection against plain numpy."""

import itertools

import numpy as np
import pytest

from tessera.functions import rotation as K
from tessera.functions import spectra as X
from tessera.operators import alignment as A
from tessera.operators import fitting as T
from tessera.operators import segmentation as Z
from tessera.operators import selection as N

TURNS = K.angle_grid(np.pi / 2)
SHAPE = (6, 6, 6)


def blob(shape=SHAPE, seed=1):
    r = np.random.default_rng(seed)
    g = np.indices(shape)
    return sum(r.random() * np.exp(-sum((a - c) ** 2 for a, c in zip(g, r.random(3) * (np.array(shape) - 1))) / 2) for _ in range(4))


def test_turns():
    v = np.random.default_rng(0).random((5, 5, 5))
    assert len(TURNS) == 24
    turned = {K.rotate(v, a).round(9).tobytes() for a in TURNS}
    every = set()
    for axes in itertools.permutations(range(3)):
        for flips in itertools.product((1, -1), repeat=3):
            if np.linalg.det(np.eye(3)[list(axes)] * np.array(flips)) > 0:
                every.add(np.transpose(v, axes)[tuple(slice(None, None, f) for f in flips)].round(9).tobytes())
    assert turned == every
    assert np.allclose(K.sample(K.spline_coefficients(v[None]), np.indices(v.shape).reshape(3, -1).T * 1.0), v.ravel())
    assert np.allclose(K.rotate(np.full((4, 4, 4), 2.0), (0.3, 0.5, 0.1)), 2)
    assert K.rotate(v, (0, 0, 0), (2, 0, 0), pad="zero")[0, 0, 0] == 0 and np.allclose(K.rotate(v, (0, 0, 0), (2, 0, 0))[2:], v[:-2])
    assert K.rotate(v, (0.2, 0.4, 0.1), shape=(7, 7, 7)).shape == (7, 7, 7)


def test_spline_is_exact_on_smooth_waves():
    x = np.cos(np.pi * np.arange(33) / 32 * 2)  # even about both ends: the mirrored signal is smooth
    v = x[:, None, None] * np.ones((1, 5, 5))
    at = np.stack((np.linspace(0, 32, 101), np.full(101, 2.0), np.full(101, 2.0)), 1)
    got = K.sample(K.spline_coefficients(v[None]), at)[0]
    assert np.abs(got - np.cos(np.pi * at[:, 0] / 32 * 2)).max() < 1e-4
    linear = K.sample(v[None], at, order=1)[0]
    assert np.allclose(linear, np.interp(at[:, 0], np.arange(33), x))


def test_angles_and_inverse():
    r = np.random.default_rng(2)
    for angle in [*r.random((20, 3)) * [6.2, 3.1, 6.2], (0.4, 0, 0.3), (0.4, np.pi, 0.3)]:
        rm = K.matrix(angle)
        assert np.allclose(K.matrix(K.angles_of(rm)), rm)
        back, loc = K.inverse(angle, (1.0, -2.0, 0.5))
        assert np.allclose(K.matrix(back), rm.T) and np.allclose(K.difference(angle, K.angles_of(rm)), 0)


def test_alignment_finds_the_pose():
    v, ones = blob(), np.ones(SHAPE)
    for angle in TURNS[::5]:
        record = np.roll(K.rotate(v, angle), (1, -2, 0), (0, 1, 2))
        ((score, found, loc, err),) = A.align(record, ones, v[None], ones[None], TURNS)
        assert score > 1 - 1e-6 and err is None and np.allclose(loc, (1, -2, 0)) and K.difference(found, angle) < 1e-6
    ((score, _, _, err),) = A.align(v, ones, v[None], 0 * ones[None], TURNS)
    assert np.isnan(score) and err


def test_constrained_maximum_is_that_of_all_shifts():
    r = np.random.default_rng(3)
    v1, v2 = r.random((2, 4, 4, 4))
    mask = (np.abs(np.indices((4, 4, 4))[2] - 2) <= 1).astype(float)
    (score,), (loc,) = A.constrained_maxima(v1, mask, v2[None], np.ones((1, 4, 4, 4)), (0, 0, 0))
    f1, f2 = (np.fft.fftn(v) * np.fft.ifftshift(mask) for v in (v1, v2))
    f1[0, 0, 0] = f2[0, 0, 0] = 0
    a, b = (np.fft.ifftn(f).real for f in (f1, f2))
    every = {s: (a * np.roll(b, s, (0, 1, 2))).sum() / np.sqrt((a**2).sum() * (b**2).sum()) for s in np.ndindex(4, 4, 4)}
    best = max(every, key=every.get)
    assert np.isclose(score, every[best]) and tuple(int(x) % 4 for x in loc) == best


def _records(spark, volumes, poses=None):
    ones = [1.0] * volumes[0].size
    rows = [(i, v.ravel().tolist(), ones, *(poses[i] if poses else ([0.0] * 3, [0.0] * 3))) for i, v in enumerate(volumes)]
    return spark.createDataFrame(rows, "id int, v array<double>, m array<double>, angle array<double>, loc array<double>")


def test_averages_and_passes(spark):
    odd = (5, 5, 5)  # no frequency of these turns out of the mask
    v = blob(odd)
    poses = [(list(map(float, a)), [0.0, 0.0, 0.0]) for a in TURNS[:6]]
    noisy = [K.rotate(v, K.inverse(a, l)[0]) for a, l in poses]
    out = A.averages(_records(spark, noisy, poses).selectExpr("0 as g", "v", "m", "angle", "loc"), "g", odd).first()
    assert out.n == 6 and np.allclose(out.v, v.ravel()) and np.allclose(out.m, 1)
    v = blob()
    found, average = A.iterate_average(_records(spark, [v, K.rotate(v, TURNS[4]), v, v]), "id", SHAPE, TURNS, passes=2)
    assert all(r.score > 0.99 for r in found.collect()) and average.first().n == 4
    bad = _records(spark, [v, np.full(SHAPE, np.nan)])
    rows = {r.id: r for r in A.align_all(bad, spark.createDataFrame([(0, v.ravel().tolist(), [1.0] * v.size)], "template_id int, v array<double>, m array<double>"), "id", SHAPE, TURNS[:2]).collect()}
    assert rows[0].err is None and np.isnan(rows[1].score) and rows[1].err
    assert A.align_all(bad.limit(0), spark.createDataFrame([], "template_id int, v array<double>, m array<double>"), "id", SHAPE, TURNS[:2]).count() == 0


def test_classes_are_told_apart(spark):
    r = np.random.default_rng(5)
    kinds = [blob(seed=1), blob(seed=9)]
    volumes = [kinds[i % 2] + r.standard_normal(SHAPE) * 0.02 for i in range(12)]
    poses, means = A.iterate_classify(_records(spark, volumes), "id", SHAPE, TURNS[:1], 2, passes=1)
    of = {x.id: x.cluster for x in poses.collect()}
    assert len({of[i] for i in range(0, 12, 2)}) == 1 and len(set(of.values())) == 2 and means.count() == 2
    patterns = A.pursue(_records(spark, volumes), "id", SHAPE, TURNS[:1], 2, most=2).collect()
    assert sum(p.n for p in patterns) == 12 and len(patterns) == 2


def test_candidate_angles():
    score = np.zeros((8, 8, 8))
    score[1, 2, 3], score[5, 6, 1], score[0, 0, 0], score[7, 7, 7] = 3, 2, 1, 1.5
    found = A.candidate_angles(score + 1e-6 * np.random.default_rng(1).random(score.shape), 3)
    assert np.allclose(found[0], (np.pi / 4 - np.pi / 2, np.pi / 2 - np.pi, 3 * np.pi / 4 - np.pi / 2))
    assert not any(np.allclose(a, (-np.pi / 2, -np.pi, -np.pi / 2)) for a in found)  # beaten across the edge


def test_smoothing():
    x = np.arange(6)
    a, c = A.zero_mean_gaussian(x, 0.8 * np.exp(-(x**2) / (2 * 1.7**2)))
    assert np.isclose(a, 0.8, atol=1e-4) and np.isclose(c, 1.7, atol=1e-4)
    v = blob()
    assert np.allclose(A.smoothed(v, np.zeros(4)), v) and np.allclose(A.smoothed(v, np.ones(12)), v)
    assert np.allclose(A.smoothed(v, np.array([1.0])), v.mean())
    assert A.smoothed(v, np.array([1, 0.5, 0.1]), "gaussian").std() < v.std()


# fits


def test_mixture(spark):
    r = np.random.default_rng(1)
    x = np.concatenate((r.standard_normal((200, 2)) * 0.3, r.standard_normal((100, 2)) * 0.2 + [4, 1]))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(3)
    fit = T.best_mixture(df, "v", 2, [1, 2, 3])
    assert fit["k"] == 2 and np.allclose(sorted(fit["weights"]), (1 / 3, 2 / 3), atol=0.02)
    one = fit["all"][1]
    mean, cov = x.mean(0), np.cov(x.T, bias=True) + 1e-6 * np.eye(2)
    logs = -0.5 * (np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean) + np.linalg.slogdet(cov)[1] + 2 * np.log(2 * np.pi))
    assert np.isclose(one, 5 * np.log(300) - 2 * logs.sum(), rtol=1e-4)


def test_components(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((300, 5)) * [3, 2, 1, 0.5, 0.1]
    df = spark.createDataFrame([(v.tolist(), [1.0] * 5) for v in x], "v array<double>, w array<double>")
    axes = T.weighted_components(df, "v", "w", 5, 2)
    want = np.linalg.svd(x)[2][:2]
    assert np.allclose(axes.T @ axes, want.T @ want, atol=1e-3)
    places, values, _ = T.covariance_filtered_components(df, "v", 5, 5, 2)
    assert list(places) == [0, 1, 2, 3, 4] and np.allclose(values, np.linalg.eigvalsh(np.cov(x.T))[::-1][:2])
    assert len(T.covariance_filtered_components(df, "v", 5, 3, 1)[0]) == 2


def test_robust_split():
    r = np.random.default_rng(3)
    low = np.outer(r.standard_normal(20), r.standard_normal(30))
    sparse = np.where(r.random((20, 30)) < 0.05, 10.0, 0)
    a, b = T.robust_split(low + sparse)
    assert np.abs(a - low).max() < 1e-2 and np.abs(b - sparse).max() < 1e-2


# segmentation


def test_flood():
    v = np.zeros((7, 1, 1))
    v[:, 0, 0] = [5, 4, 3, 1, 2, 4, 5]
    seeds = np.zeros(v.shape)
    seeds[0], seeds[6] = 1, 2
    assert Z.flood(v, seeds).ravel().tolist() == [1, 1, 1, -1, 2, 2, 2]
    assert (Z.flood(v, seeds, most_each=2).ravel() > 0).sum() == 4 and (Z.flood(v, seeds, most=3).ravel() > 0).sum() == 3
    v[3] = np.nan
    assert Z.flood(v, seeds).ravel().tolist() == [1, 1, 1, 0, 2, 2, 2]
    r = np.random.default_rng(1)
    w = r.random((5, 5, 5))
    s = np.zeros(w.shape)
    s[0, 0, 0] = 3
    assert (Z.flood(w, s) == 3).all()


def test_level_set(spark):
    mask = np.zeros((8, 8, 8), bool)
    mask[2:6, 2:6, 2:6] = True
    d = Z.signed_distance(mask)
    brute = [[np.sqrt(((np.argwhere(mask != mask[p]) - p) ** 2).sum(1).min()) * (1 if mask[p] else -1)] for p in np.ndindex(mask.shape)]
    assert np.allclose(d.ravel(), np.ravel(brute))
    phi = Z.two_phase(mask + np.random.default_rng(1).standard_normal(mask.shape) * 0.1)
    assert ((phi >= 0) == mask).mean() > 0.95 and Z.two_phase(np.ones((3, 3, 3))) is None
    rows = spark.createDataFrame([(1, mask.ravel().astype(float).tolist()), (2, [1.0] * 512), (3, None)], "id int, v array<double>")
    out = {r.id: r.phi for r in Z.level_sets(rows, "v", (8, 8, 8)).collect()}
    assert set(out) == {1, 2} and np.isnan(out[2]).all()
    assert (Z.template_guided(np.arange(512.0).reshape(8, 8, 8), mask.astype(float))[0] == 255.5).all()
    _, _, turned = Z.pose_normalised(mask.astype(float))
    assert turned.shape == mask.shape and abs(turned.sum() - mask.sum()) < 0.2 * mask.sum()


def test_smallest_sphere(spark):
    r = np.random.default_rng(4)
    rows = []
    for g in range(6):
        p = r.random((r.integers(1, 14), 3)) * 10
        rows += [(g, *map(float, x)) for x in p]
    out = {x.g: x for x in Z.smallest_spheres(spark.createDataFrame(rows, "g int, x double, y double, z double"), "g").collect()}
    for g in range(6):
        p = np.array([x[1:] for x in rows if x[0] == g])
        best = np.inf
        for k in range(1, min(len(p), 4) + 1):
            for own in itertools.combinations(range(len(p)), k):
                q = p[list(own)]
                d = q[1:] - q[0]
                c = q[0] + (np.linalg.lstsq(2 * d @ d.T, (d**2).sum(1), rcond=None)[0] @ d if k > 1 else 0)
                radius = np.linalg.norm(p - c, axis=1).max()
                best = min(best, radius)
        assert np.isclose(out[g].radius, best, atol=1e-6)


def test_sphere_by_consensus():
    r = np.random.default_rng(5)
    u = r.standard_normal((60, 3))
    p = np.concatenate(([1, 2, 3] + 4 * u / np.linalg.norm(u, axis=1)[:, None], r.random((20, 3)) * 12))
    centre, radius, near = Z.sphere_by_consensus(p, 0.05)
    assert np.allclose(centre, [1, 2, 3], atol=0.05) and abs(radius - 4) < 0.05 and near[:60].all()
    assert np.isnan(Z.sphere_by_consensus(p[:3], 0.1)[1])


# selection


def test_sets_come_and_go():
    v = np.random.default_rng(6).standard_normal((9, 4, 4, 4))
    own, other = N.SpectralSet(v), N.SpectralSet(v)
    own.take(range(9))
    own.remove(3)
    own.remove(3)
    other.take([i for i in range(9) if i != 3])
    assert np.isclose(own.score(), other.score()) and N.SpectralSet(v).score() == 0


def test_searches_choose_the_alike():
    r = np.random.default_rng(7)
    v = np.concatenate((blob((4, 4, 4)) + r.standard_normal((8, 4, 4, 4)) * 0.02, r.standard_normal((8, 4, 4, 4))))
    own = N.SpectralSet(v)
    own.take(range(16))
    for search in (lambda x: N.annealed(x, restarts=2), N.evolved, N.matched):
        members, score = search(v)
        check = N.SpectralSet(v)
        check.take(members)
        assert np.isclose(check.score(), score) and score > own.score() and sum(m < 8 for m in members) >= len(members) * 0.7


def test_packing_and_scenes():
    size = np.linspace(1, 2, 12)
    x, losses = N.packed_balls(size, 12.0)
    d = np.linalg.norm(x[:, None] - x, axis=-1) + np.eye(12) * 99
    assert losses[-1] < 1e-6 and (d > size[:, None] + size - 1e-2).all() and losses[0] > losses[-1]
    scene = N.assembled((6, 6, 6), [(np.ones((3, 3, 3)), (1, 1, 1)), (np.ones((3, 3, 3)), (5, 5, 5)), (np.ones((3, 3, 3)), (90, 0, 0))])
    assert scene.sum() == 27 + 8
    v = blob()
    assert N.degraded(v, 0.1).std() > N.degraded(v, 10.0).std() and (N.degraded(v, 1.0) == N.degraded(v, 1.0)).all()


def test_gabor_bank(spark):
    bank = Z.gabor_bank(1.0, 3.0, 0.0, 0.5)
    v = np.random.default_rng(1).random((6, 6, 6))
    rows = Z.gabor_responses(spark.createDataFrame([(1, v.ravel().tolist())], "id int, v array<double>"), "id", "v", (6, 6, 6), bank[:2]).collect()
    k, reach = bank[1], bank[1].shape[0] // 2
    plain = sum(k[o] * np.roll(v, np.array(o) - reach, (0, 1, 2)) for o in np.ndindex(k.shape))
    assert len(bank) == 12 and np.isclose({r["filter"]: r.response for r in rows}[1], np.abs(plain).mean())


def test_spectra_leave_bad_rows_out(spark):
    rows = spark.createDataFrame([(1, [1.0] * 8), (2, None), (3, [1.0]), (4, [None] * 8)], "id int, v array<double>")
    assert [r.id for r in X.spectrum(rows, "v", (2, 2, 2)).collect()] == [1]
    assert X.spectrum(rows.limit(0), "v", (2, 2, 2)).count() == 0


@pytest.mark.parametrize("method", range(4))
def test_spectral_snr_by_loops(spark, method):
    v = np.random.default_rng(8).standard_normal((5, 4, 4, 4))
    df = spark.createDataFrame([(0, x.ravel().tolist()) for x in v], "g int, v array<double>")
    got = {r.r: r.ssnr for r in X.shell_snr(X.spectral_sums(df, ["g"], "v", (4, 4, 4)), ["g"], (4, 4, 4), method=method).collect()}
    f, n = np.fft.fftn(v, axes=(1, 2, 3)), 5
    mean, var = f.mean(0), (np.abs(f - f.mean(0)) ** 2).sum(0) / (n - 1)
    for r in range(3):
        m = np.abs(X.radii((4, 4, 4)) - r) <= 1
        if method < 3:
            want = (np.abs(mean[m]) ** 2).sum() / (var[m] / n).sum()
        else:
            own = f[:, m].ravel()
            want = n * np.abs(own.mean()) ** 2 / ((np.abs(own - own.mean()) ** 2).sum() / (len(own) - 1))
        assert np.isclose(got[r], want)


def test_harmonics():
    from tessera.functions import harmonics as H

    x = np.linspace(-1, 1, 7)
    assert np.allclose(H.legendre(x, 3), [np.ones(7), x, (3 * x**2 - 1) / 2, (5 * x**3 - 3 * x) / 2])
    r = np.random.default_rng(1)
    a = {(n, m): complex(*r.standard_normal(2)) for n in range(5) for m in range(-n, n + 1)}
    back = H.forward(H.reverse(a, 4), 4)
    assert all(np.isclose(back[k], a[k]) for k in a)
    for n in range(4):
        d = H.wigner_d(n, 0.7)
        assert np.allclose(d @ d.T, np.eye(2 * n + 1)) and np.allclose(d @ H.wigner_d(n, 0.4), H.wigner_d(n, 1.1))
    assert np.allclose(H.wigner_d(1, 0.7)[1, 1], np.cos(0.7)) and np.allclose(H.wigner_d(2, 0), np.eye(5))


def test_rotational_correlation_is_that_of_turned_functions():
    from tessera.functions import harmonics as H

    most = 3
    theta, weights, phi = H.angles(most)
    u = np.stack((np.sin(theta)[:, None] * np.cos(phi), np.sin(theta)[:, None] * np.sin(phi), np.cos(theta)[:, None] * np.ones(len(phi))), -1)
    f = lambda p: p[..., 0] * p[..., 2] + 0.5 * p[..., 1] ** 3 - p[..., 0]
    g = lambda p: p[..., 1] * p[..., 2] - 0.3 * p[..., 0] ** 2 + p[..., 2]
    a, b = H.forward(f(u), most), H.forward(g(u), most)
    turns = [(0.0, 0.0, 0.0), (0.4, 0.9, -0.3), (2.0, 1.1, 0.7)]
    got = H.rotational_correlation([a, a], [b, b], np.array([1.0, 2.0]), most, turns)
    for score, (al, be, ga) in zip(got, turns):
        rz = lambda t: np.array([[np.cos(t), -np.sin(t), 0], [np.sin(t), np.cos(t), 0], [0, 0, 1]])
        ry = np.array([[np.cos(be), 0, np.sin(be)], [0, 1, 0], [-np.sin(be), 0, np.cos(be)]])
        turned = g(u @ (rz(al) @ ry @ rz(ga)))
        want = (weights[:, None] * f(u) * turned).sum() * 2 * np.pi / len(phi) * (0.5 * 1 + 0.5 * 4)
        assert np.isclose(score, want)


def _noise(n, seed=8):
    r = np.random.default_rng(seed)
    return r.random((n, *SHAPE)), (r.random((n, *SHAPE)) > 0.2).astype(float)


def test_searches_are_made_together(monkeypatch):
    """Many volumes take as many rounds of transforms as one, and find what each finds alone."""
    v, m = _noise(7)
    options = {"most": 3, "peaks": 4, "finalists": 2, "refine": 2}
    alone = [A.search(v[0], m[0], x, y, **options) for x, y in zip(v, m)]
    rounds, maxima = [], A._maxima
    monkeypatch.setattr(A, "_maxima", lambda *a: rounds.append(1) or maxima(*a))
    for one, other in zip(A.search_each(v[0], m[0], v, m, **options), alone):
        assert np.isclose(one[0], other[0]) and np.allclose(one[1], other[1]) and (one[2] == other[2]).all()
        s, l = A.constrained_maxima(v[0], m[0], v[:1], m[:1], alone[0][1])
    assert len(rounds) <= 3 + len(alone) and np.isclose(s[0], alone[0][0]) and (l[0] == alone[0][2]).all()


def test_a_turn_serves_all_templates(monkeypatch):
    v, m = _noise(5)
    known = list(zip(v[:3], m[:3]))
    alone = [A.align(*k, v, m, TURNS[:4]) for k in known]
    turned, rotate = [], K.rotate_many
    monkeypatch.setattr(K, "rotate_many", lambda *a, **b: turned.append(1) or rotate(*a, **b))
    for one, other in zip(A.align_each(known, v, m, TURNS[:4]), alone):
        assert all(a[0] == b[0] and (a[1] == b[1]).all() and (a[2] == b[2]).all() for a, b in zip(one, other))
    assert len(turned) == 4


def test_rows_of_one_pose_are_turned_together():
    angle, loc = np.array([TURNS[i % 2] for i in range(50)], float), np.array([[i % 3, 0, 0] for i in range(50)], float)
    found = list(A._alike(angle, loc, 64))
    assert len(found) == 6 and sorted(np.concatenate([rows for rows, _, _ in found])) == list(range(50))
    assert all((angle[rows] == a).all() and (loc[rows] == l).all() for rows, a, l in found)


def _asked(monkeypatch, name, query, spark, answer):
    """What a query hands to an operator of alignment, defaults included."""
    import inspect

    from tessera.plans import models as Q

    operator, seen = getattr(A, name), {}

    def spy(*given, **options):
        bound = inspect.signature(operator).bind(*given, **options)
        bound.apply_defaults()
        seen.update(bound.arguments)
        return answer

    monkeypatch.setattr(A, name, spy)
    getattr(Q, query)(spark, "/root/testdata/sf0.001")
    return seen


def test_classification_tries_all_turns_in_several_passes(spark, monkeypatch):
    poses = spark.createDataFrame([(0, 1.0)], "cluster int, score double")
    seen = _asked(monkeypatch, "iterate_classify", "iterative_classify", spark, (poses, None))
    assert len(seen["angles"]) == 24 and seen["passes"] >= 3
    assert seen["records"].count() == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()


def test_pursuit_tries_all_turns_until_passes_add_nothing(spark, monkeypatch):
    found = spark.createDataFrame([(0, 0, 1, 1.0)], "pass int, cluster int, n long, fsc double")
    seen = _asked(monkeypatch, "pursue", "pattern_pursuit", spark, found)
    assert len(seen["angles"]) == 24 and seen["most"] >= 10
    assert seen["records"].count() == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
