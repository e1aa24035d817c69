"""Distance joins and greedy choices against plain loops, and on empty tables."""

import numpy as np

from tessera.operators import pairs as P
from tessera.operators import records as R
from tessera.operators import regions as G
from tessera.operators import statistics as S

AXES = ["x", "y", "z"]


def points(spark, n, seed=1):
    r = np.random.default_rng(seed)
    rows = [(i, *map(int, p), float(v)) for i, (p, v) in enumerate(zip(r.integers(0, 20, (n, 3)), r.integers(0, 9, n)))]
    return rows, spark.createDataFrame(rows, "id int, x int, y int, z int, val double")


def test_greedy_choices(spark):
    rows, df = points(spark, 120)
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a[1:4], b[1:4]))
    kept = []
    for a in rows:
        if all(far(a, b) > 25 for b in kept):
            kept.append(a)
    got = P.greedy(df, "id", [], AXES, 5.0, P.euclid(AXES, 5.0, strict=False))
    assert {r.id for r in got.collect()} == {a[0] for a in kept}
    kept = []
    for a in sorted(rows, key=lambda a: (-a[4], a[0])):
        if not any(all(q - 4 <= p < q + 4 for p, q in zip(a[1:4], b[1:4])) for b in kept):
            kept.append(a)
    got = P.greedy(df, "id", [(-df.val).alias("v")], AXES, 4.0, P.cuboid(AXES, 4))
    assert {r.id for r in got.collect()} == {a[0] for a in kept}
    alone = {a[0] for a in rows if all(a is b or far(a, b) > 9 for b in rows)}
    assert {r.id for r in P.isolated(df, "id", AXES, 3.0).collect()} == alone


def test_set_distances(spark):
    rows, df = points(spark, 50, 3)
    sides = df.selectExpr("id % 2 as side", "x", "y")
    got = {(r.side, r.x, r.y): r.distance for r in P.set_distances(sides, "side", ["x", "y"]).collect()}
    for a in rows:
        want = min(np.hypot(a[1] - b[1], a[2] - b[2]) for b in rows if (a[0] - b[0]) % 2)
        assert np.isclose(got[a[0] % 2, a[1], a[2]], want)


def test_matching_takes_each_truth_once(spark):
    boxes = "image string, id long, x1 int, y1 int, x2 int, y2 int"
    sides = [f"cast({c} as double) as {c}" for c in ("x1", "y1", "x2", "y2")]
    found = [("a", 1, 0, 0, 10, 10, 0.9), ("a", 2, 0, 0, 10, 9, 0.8), ("a", 3, 50, 50, 60, 60, 0.7), ("b", 4, 0, 0, 1, 1, 0.5)]
    found = spark.createDataFrame(found, boxes + ", prob double").selectExpr("image", "id", *sides, "prob")
    truth = spark.createDataFrame([("a", 7, 0, 0, 10, 10), ("a", 8, 1, 1, 10, 10)], boxes).selectExpr("image", "id", *sides)
    got = sorted(map(tuple, P.matched(found, truth, "image").collect()))
    assert got == [("a", 1, 7), ("a", 2, 8)]
    assert P.matched(found.limit(0), truth, "image").count() == 0


def test_assignment_of_boxes_of_any_size(spark):
    r = np.random.default_rng(6)
    corner = r.integers(0, 60, (60, 2)).astype(float)
    size = np.where(r.random((60, 1)) < 0.2, 200.0, r.integers(5, 20, (60, 2)))
    rows = [(i, *map(float, (*c, *(c + s)))) for i, (c, s) in enumerate(zip(corner, size))]
    schema = "id long, x1 double, y1 double, x2 double, y2 double"
    rois, truths = rows[:30], rows[30:]
    got = {x.id: (x.truth, x.iou) for x in P.assigned(spark.createDataFrame(rois, schema), spark.createDataFrame(truths, schema), 10.0).collect()}
    want = {}
    for i, x1, y1, x2, y2 in rois:
        best = (0.0, 0)
        for t, u1, v1, u2, v2 in truths:
            inner = max(0.0, min(x2, u2) - max(x1, u1)) * max(0.0, min(y2, v2) - max(y1, v1))
            best = max(best, (inner / ((x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) - inner), -t))
        if best[0] >= 0.1:
            want[i] = -best[1], best[0]
    assert got.keys() == want.keys() and all(got[i][0] == t and np.isclose(got[i][1], v) for i, (t, v) in want.items())


def test_empty_tables(spark):
    _, df = points(spark, 3)
    none = df.limit(0)
    assert P.greedy(none, "id", [], AXES, 5.0, P.euclid(AXES, 5.0, strict=True)).count() == 0
    assert P.isolated(none, "id", AXES, 5.0).count() == 0
    assert P.set_distances(none.selectExpr("id as side", "x", "y"), "side", ["x", "y"]).count() == 0
    assert P.common_frames(spark.createDataFrame([], "a int, b int, s double"), "a", "b", "s") == []
    pairs = spark.createDataFrame([(0.5, True), (1.5, False)], "d double, same boolean")
    rates = {r.threshold: (r.tpr, r.fpr, r.acc) for r in S.accuracy_by_threshold(pairs, "d", "same", [0.0, 1.0, 2.0]).collect()}
    assert rates == {0.0: (0.0, 0.0, 0.5), 1.0: (1.0, 0.0, 1.0), 2.0: (1.0, 1.0, 0.5)}


def test_choices_among_many_close_points_list_no_pairs(spark, monkeypatch):
    # 6000 points on 8 x 8 x 8 places: 18 million close pairs, of which none may be listed
    r = np.random.default_rng(7)
    rows = [(i, *map(int, p), float(v)) for i, (p, v) in enumerate(zip(r.integers(0, 8, (6000, 3)), r.integers(0, 9, 6000)))]
    df = spark.createDataFrame(rows + [(9000, None, 1, 1, 5.0), (9001, 300, 1, 1, 5.0)], "id int, x int, y int, z int, val double")
    monkeypatch.setattr(P, "close_pairs", None)
    kept = []
    for a in sorted(rows, key=lambda a: (-a[4], a[0])):
        if not any(all(q - 3 <= p < q + 3 for p, q in zip(a[1:4], b[1:4])) for b in kept):
            kept.append(a)
    got = P.greedy(df, "id", [(-df.val).alias("v")], AXES, 3.0, P.cuboid(AXES, 3))
    assert {x.id for x in got.collect()} == {a[0] for a in kept} | {9000, 9001}
    assert {x.id for x in P.isolated(df, "id", AXES, 3.0).collect()} == {9000, 9001}
    # a pair across the half-open side ends in one direction only
    two = spark.createDataFrame([(1, 3, 0, 0), (2, 0, 0, 0), (3, 6, 0, 0)], "id int, x int, y int, z int")
    assert {x.id for x in P.greedy(two, "id", [], AXES, 3.0, P.cuboid(AXES, 3)).collect()} == {1, 3}


def test_exploded_cells_are_not_broadcast(spark):
    _, df = points(spark, 200)
    plan = P.isolated(df, "id", AXES, 3.0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_overlapping_spheres_of_many_sizes(spark):
    r = np.random.default_rng(8)
    rows = [(i, *map(float, r.integers(-9, 30, 3)), float(v)) for i, v in enumerate(2.0 ** r.integers(-12, 4, 300))] + [(300, 1.0, 1.0, 1.0, 0.0), (301, 1.0, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, x double, y double, z double, r double")
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a[1:4], b[1:4]))
    out = R.overlapping_spheres(df)
    got = sorted(map(tuple, out.collect()))
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and far(a, b) < (a[4] + b[4]) ** 2)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert R.overlapping_spheres(df.limit(0)).count() == 0


def test_boxes_of_all_shapes_meet_once(spark):
    r = np.random.default_rng(9)
    corner = r.integers(-30, 60, (160, 2)).astype(float)
    size = 2.0 ** r.integers(-2, 7, (160, 2)) * r.uniform(0.7, 1.4, (160, 2))
    rows = [(i, *map(float, (*c, *(c + s))), float(i % 7)) for i, (c, s) in enumerate(zip(corner, size))]
    rows += [(200 + i, *row[1:]) for i, row in enumerate(rows[:9])] + [(300, 5.0, 5.0, 5.0, 9.0, 3.0)]
    df = spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double, score double")

    def iou(a, b):
        both = max(min(a[3], b[3]) - max(a[1], b[1]), 0) * max(min(a[4], b[4]) - max(a[2], b[2]), 0)
        return both / ((a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - both)

    for least in (0.0, 0.1, 0.5):
        got = sorted((x.a, x.b) for x in G.box_pairs(df, least, 8.0).collect())
        assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and iou(a, b) > least)
        kept = []
        for b in sorted(rows, key=lambda b: (-b[5], b[0])):
            if all(iou(b, k) <= least for k in kept):
                kept.append(b)
        assert sorted(x.id for x in G.suppressed(df, least, 8.0).collect()) == sorted(k[0] for k in kept)
    assert "BroadcastHashJoin" not in G.box_pairs(df, 0.5, 8.0)._jdf.queryExecution().executedPlan().toString()
    assert G.suppressed(df.limit(0), 0.5, 8.0).count() == 0


def test_tilt_ranges_multiply_no_rows(spark):
    from conftest import SF
    from tessera.plans import pairs as Q

    out = Q.best_tilt(spark, SF)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey").distinct().count()


def test_filament_links_score_pairs_where_they_meet(spark, monkeypatch):
    monkeypatch.setattr(P, "close_pairs", None)
    rows = [(1, 0.0, 0.0, 0.0, 0.5), (2, 3.0, 0.0, 0.0, 0.9), (3, 3.0, 0.0, 0.0, 0.8), (4, 30.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, x double, y double, z double, corr double").selectExpr("*", "1.0d as ux", "0.0d as uy", "0.0d as uz")
    got = {r.id: (r.next, r.similarity) for r in P.filament_links(df, reach=16.0, cone=1.0, sigmas=(1.0, 2.0, 20.0), least=0.01).collect()}
    # 2 and 3 stand at one place: no step, angle 0
    assert got.keys() == {1, 2, 3} and got[2] == (3, 0.8) and got[3] == (2, 0.9)
    assert got[1][0] == 2 and np.isclose(got[1][1], 0.9 * np.exp(-9 / 400))


def test_filament_links_copy_packs_not_points(spark, monkeypatch):
    monkeypatch.setattr(P, "_met", None)  # it copied each point to all small cells around
    r = np.random.default_rng(3)
    n = 5500  # more than a window holds in one cell, and some in cells around; many at one place
    at = np.where(r.random((n, 1)) < 0.85, r.integers(1, 15, (n, 3)), r.integers(-20, 36, (n, 3))).astype(float)
    u = r.standard_normal((n, 3))
    u[:20], corr = 0, r.integers(1, 40, n) / 40
    rows = [(i, *at[i].tolist(), float(corr[i]) if i % 50 else None, *u[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, corr double, ux double, uy double, uz double")
    sigmas = (1.0, 2.0, 20.0)
    got = {x.id: (x.next, x.similarity) for x in P.filament_links(df, reach=16.0, cone=1.0, sigmas=sigmas, least=0.01).collect()}
    known = np.where(np.arange(n) % 50 == 0, -np.inf, corr)
    size, want = np.linalg.norm(u, axis=1), {}
    for i in range(n):
        with np.errstate(all="ignore"):
            step = at - at[i]
            d = np.sqrt((step**2).sum(1))
            b, g = (np.arccos(np.nan_to_num(np.clip(c, -1, 1), nan=1.0)) for c in ((step @ u[i]) / (d * size[i]), (step * u).sum(1) / (d * size)))
            s = np.round(known * np.exp(-((b - g) ** 2)) * np.exp(-((b + g) ** 2) / 4) * np.exp(-d * d / 400), 9)
        s[(d > 16) | (b > 1.0) | (np.arange(n) == i)] = -1
        if s.max() > 0.01:
            want[i] = (int(s.argmax()), s.max())
    assert got.keys() == want.keys()
    assert all(np.isclose(got[i][1], want[i][1], atol=2e-9, rtol=0) for i in want)
    assert sum(got[i][0] != want[i][0] for i in want) <= 2  # the last digit of a tie


def test_box_pairs_copy_packs_not_boxes(spark, monkeypatch):
    monkeypatch.setattr(G, "boxes_met", None)  # it copied each box to all cells around
    r = np.random.default_rng(4)
    n = 2500  # several packs in a cell, classes of sizes that differ along both axes, places below 0
    low, size = r.integers(-40, 60, (n, 2)), 2 ** r.integers(0, 5, (n, 2)) + r.integers(0, 9, (n, 2))
    low[:1200], size[:1200] = low[:1200] // 20, 8
    v = np.concatenate((low, low + size), 1).astype(float)
    df = spark.createDataFrame([(i, *b) for i, b in enumerate(v.tolist())], "id long, x1 double, y1 double, x2 double, y2 double")
    got = {(x.a, x.b): x.iou for x in G.box_pairs(df, 0.3, 8.0, 6).collect()}
    inner = np.prod([np.maximum(np.minimum.outer(v[:, k + 2], v[:, k + 2]) - np.maximum.outer(v[:, k], v[:, k]), 0) for k in (0, 1)], axis=0)
    area = np.prod(size, axis=1).astype(float)
    share = inner / (np.add.outer(area, area) - inner)
    a, b = np.nonzero(np.triu(share > 0.3, 1))
    assert got == {(i, j): np.floor(share[i, j] * 1e6 + 0.5) / 1e6 for i, j in zip(a.tolist(), b.tolist())}
