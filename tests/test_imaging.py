"""Operators of imaging.py against numpy and on odd rows."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import imaging as I
from tessera.plans import catalog


def _table(spark, v):
    return spark.createDataFrame([(0, *map(int, p), float(v[p])) for p in np.ndindex(v.shape) if v[p]], "vol_id int, x int, y int, z int, val double")


def test_masked_correlation(spark):
    v = np.random.default_rng(3).integers(0, 3, (6, 5, 4)).astype(float)
    template = {(0, 0, 0): 3.0, (1, 0, 0): 1.0, (0, -1, 0): 0.5, (0, 0, 1): 0.0}
    look = lambda a, o: np.roll(a, [-c for c in o], (0, 1, 2))
    mean = sum(look(v, o) for o in template) / 4
    std = np.sqrt(np.maximum(sum(look(v, o) ** 2 for o in template) / 4 - mean**2, 0))
    z = np.where(std > 0, (v - mean) / np.where(std > 0, std, 1), v - mean)
    w = np.array(list(template.values()))
    want = sum(look(z, o) * (k - w.mean()) / w.std() for o, k in template.items())
    got = np.zeros(v.shape)
    for r in I.masked_correlation(_table(spark, v), v.shape, template).collect():
        got[r.x, r.y, r.z] = r.cor
    assert np.allclose(got, want)
    assert I.masked_correlation(_table(spark, v).limit(0), v.shape, template).count() == 0


def test_surface_strength(spark):
    v = np.random.default_rng(5).normal(size=(5, 4, 6))
    ahead = lambda a, k: np.take(a, np.minimum(np.arange(a.shape[k]) + 1, a.shape[k] - 1), k) - a
    h = np.array([[ahead(ahead(v, i), j) for j in range(3)] for i in range(3)]).transpose(2, 3, 4, 0, 1)
    e = np.linalg.eigvalsh((h + h.swapaxes(-1, -2)) / 2)
    for r in I.surface_strength(_table(spark, v), v.shape).collect():
        e0, e1, e2 = sorted(e[r.x, r.y, r.z], key=abs, reverse=True)
        if r.x < 3 and r.y < 2 and r.z < 4 and abs(abs(e0) - abs(e1)) > 1e-6:
            assert abs(r.strength - ((abs(e0) - abs(e1 * e2) ** 0.5) ** 2 if e0 < 0 else 0)) < 1e-8


def test_distortion_index(spark):
    rng = np.random.default_rng(7)
    data, label = rng.normal(size=(90, 3)) * [2, 1, 1], np.arange(90) % 3
    data += label[:, None]
    df = spark.createDataFrame([(int(k), r.tolist()) for k, r in zip(label, data)] + [(9, [0.0, 0.0, 1.0]), (None, None)], "g int, v array<double>")
    own = [data[label == k] for k in range(3)]
    mean, inv = [a.mean(0) for a in own], [np.linalg.inv(np.cov(a.T) + 1e-6 * np.eye(3)) for a in own]
    far = lambda x, k: (x - mean[k]) @ inv[k] @ (x - mean[k])
    t = [np.mean([far(x, k) for x in own[k]]) for k in range(3)]
    want = np.mean([max((t[i] + t[j]) / (far(mean[j], i) + far(mean[i], j)) for j in range(3) if j != i) for i in range(3)])
    assert abs(I.distortion_index(df, "g", "v", 3) - want) < 1e-9
    assert np.isnan(I.distortion_index(df.limit(0), "g", "v", 3))


def test_prototypes_in_blocks(spark):
    rng = np.random.default_rng(11)
    df = spark.createDataFrame([(i, i % 7, rng.normal(size=4).tolist()) for i in range(60)] + [(99, 1, None)], "id int, label int, v array<double>")
    protos = I.prototypes(df, "label", "v", 4)
    one, many = (I.nearest_prototype(df, protos, "id", "label", "v", most=m).orderBy("id").collect() for m in (100, 3))
    assert len(one) == 60 and [(r.id, r.label, round(r.distance, 9)) for r in one] == [(r.id, r.label, round(r.distance, 9)) for r in many]


def test_angles_and_trials(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0], 5, 10), ([1.0, 1.0], [2.0, 2.0], 10, 10), ([0.0, 0.0], [1.0, 0.0], 0, 10)], "a array<double>, b array<double>, i int, n int")
    got = df.select(I.angle_between(F.col("a"), F.col("b")), I.ransac_trials(F.col("i"), F.col("n"), 2, 0.99)).collect()
    assert abs(got[0][0] - np.pi / 2) < 1e-12 and got[1][0] < 1e-7 and got[2][0] is None
    assert [r[1] for r in got] == [17, 1, None]


def test_every_row_has_a_nearest_prototype(spark, tmp_path):
    rng = np.random.default_rng(13)
    rows = [(i, rng.normal(size=64).astype("float32").tolist(), 5 if i % 2 else 4) for i in range(20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: (r.label, r.distance) for r in catalog.queries()["prototype_nearest"](spark, str(tmp_path)).collect()}
    mean = {k: np.mean([v for _, v, g in rows if g == k], axis=0) for k in (4, 5)}
    far = {i: {k: float(((np.array(v) - m) ** 2).sum()) for k, m in mean.items()} for i, v, _ in rows}
    assert set(got) == set(range(20))
    for i, d in far.items():
        assert got[i][0] == min(d, key=d.get) and abs(got[i][1] - min(d.values())) < 1e-4
