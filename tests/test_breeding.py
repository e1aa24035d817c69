"""Genetic selection over the records against spectral sums of the chosen sets."""

import numpy as np

from tessera.operators import breeding as B
from tessera.operators.selection import SpectralSet

SHAPE = (4, 4, 4)
SCHEMA = "id long, label string, v array<double>"


def records(seed=1, n=30):
    """Two groups: in each, half of the records show one volume, the others are noise."""
    r = np.random.default_rng(seed)
    out = []
    for g in ("a", "b"):
        true = r.standard_normal(SHAPE)
        for i in range(n):
            v = true + 0.3 * r.standard_normal(SHAPE) if i % 2 else 2.0 * r.standard_normal(SHAPE)
            out.append((len(out), g, v.ravel().tolist()))
    return out


def score_of(rows, ids):
    if not ids:
        return 0.0
    own = SpectralSet(np.array([v for i, _, v in rows if i in ids]).reshape(-1, *SHAPE))
    own.take(range(len(ids)))
    return own.score()


def test_fitness_is_the_sets_score(spark):
    rows = records()
    r = np.random.default_rng(2)
    bits = {i: [bool(x) for x in r.random(5) < 0.4] + [False] for i, _, _ in rows}
    df = spark.createDataFrame([(g, v, bits[i]) for i, g, v in rows], "label string, v array<double>, bits array<boolean>").repartition(3)
    got = {(x.label, x.individual): (x.n, x.score) for x in B.fitness(df, "label", SHAPE, 6).collect()}
    assert len(got) == 12
    for (g, k), (n, score) in got.items():
        ids = {i for i, label, _ in rows if label == g and bits[i][k]}
        assert n == len(ids) and np.isclose(score, score_of(rows, ids))


def test_every_group_finds_a_good_set(spark):
    rows = records()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    few = {}
    for generations in (0, 8):
        found = {}
        for x in B.evolve(df, "label", "id", "v", SHAPE, population=12, generations=generations, seed=3).collect():
            found.setdefault(x.label, (set(), x.score))[0].add(x.id)
        assert set(found) == {"a", "b"}
        for g, (ids, score) in found.items():
            assert np.isclose(score, score_of(rows, ids), atol=1e-8)
            assert score >= few.get(g, 0.0)
            few[g] = score
    for g in "ab":
        ids = found[g][0]
        assert np.mean([i % 2 for i in ids]) > 0.6


def test_odd_rows_and_empty_tables(spark):
    rows = records(n=3)[:3] + [(10, None, [0.0] * 64), (11, "c", None), (12, "c", [1.0]), (13, "c", [float("nan")] * 64), (14, "d", [1.0] * 64)]
    out = B.evolve(spark.createDataFrame(rows, SCHEMA), "label", "id", "v", SHAPE, population=6, generations=1).collect()
    assert {x.label for x in out} <= {"a"} and {x.id for x in out} <= {0, 1, 2}
    assert B.evolve(spark.createDataFrame([], SCHEMA), "label", "id", "v", SHAPE, population=4, generations=2).count() == 0
