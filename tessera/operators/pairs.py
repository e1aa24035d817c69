"""Pairs of records: triangle and distance joins, greedy choices among close points, matching of boxes.

Distance joins hash points to a grid, so that a point meets its neighbours only. Greedy choices run in rounds:
a point with no better undecided one nearby is settled, which gives the sequential loop's result without one task
that sees all points. They never list all close pairs: only the best point of each small cell meets the others, so a
point meets as many as there are cells around it, however many points these hold. Tables that explode into cells are
joined by sorting, since Spark's estimates don't know how many rows they become.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import drop, settle


def upper_pairs(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Pairs (a, b) of rows with key a < key b; the columns come as <c>_a and <c>_b. df is a checked few rows."""
    left = df.select(F.col(key).alias("a"), *(F.col(c).alias(f"{c}_a") for c in columns))
    right = df.select(F.col(key).alias("b"), *(F.col(c).alias(f"{c}_b") for c in columns))
    return left.join(right, F.col("a") < F.col("b"))


def mirrored(pairs: DataFrame, signed: list[str]) -> DataFrame:
    """The pairs and their mirror images (b, a), whose signed columns are negated."""
    other = pairs.withColumns({"a": F.col("b"), "b": F.col("a"), **{c: -F.col(c) for c in signed}})
    return pairs.unionByName(other.select(pairs.columns))


def _celled(points: DataFrame, axes: list[str], cell: float) -> DataFrame:
    return points.withColumns({f"_c{a}": F.floor(F.col(a) / cell) for a in axes})


def close_pairs(points: DataFrame, key: str, axes: list[str], reach: float, close: Callable[[str, str], Column], *, group: list[str] = []) -> DataFrame:  # noqa: B006
    """(group..., key, other): ordered pairs of different points for which close(left prefix, right prefix) holds.

    close must imply that no coordinate differs by more than reach.
    """
    left = _celled(points.select(*group, key, *axes), axes, reach)
    right = left.select(*group, F.col(key).alias("_o"), *(F.col(a).alias(f"_o_{a}") for a in axes), *(F.col(f"_c{a}").alias(f"_d{a}") for a in axes))
    for a in axes:
        right = right.withColumn(f"_c{a}", F.explode(F.sequence(F.col(f"_d{a}") - 1, F.col(f"_d{a}") + 1)))
    both = left.join(right, [*group, *(f"_c{a}" for a in axes)]).where(F.col(key) != F.col("_o"))
    return both.where(close("", "_o_")).select(*group, key, F.col("_o").alias("other"))


def euclid(axes: list[str], distance: float, *, strict: bool) -> Callable[[str, str], Column]:
    def close(a: str, b: str) -> Column:
        square = sum((F.col(a + x) - F.col(b + x)) * (F.col(a + x) - F.col(b + x)) for x in axes)
        return square < distance * distance if strict else square <= distance * distance

    return close


def cuboid(axes: list[str], reach: int) -> Callable[[str, str], Column]:
    """The point lies in [p - reach, p + reach) of the better point p along every axis."""

    def close(a: str, b: str) -> Column:
        inside = [(F.col(a + x) >= F.col(b + x) - reach) & (F.col(a + x) < F.col(b + x) + reach) for x in axes]
        out = inside[0]
        for c in inside[1:]:
            out = out & c
        return out

    return close


def _small_cells(points: DataFrame, axes: list[str], reach: float) -> tuple[DataFrame, float]:
    """The points whose coordinates are finite with their cells _c<axis>, so small that a cell's points lie within reach
    of one another; and the cells' width."""
    # less by a millionth: rounding must not set points of one cell further apart than reach
    width = reach / len(axes) ** 0.5 * (1 - 1e-6)
    return _celled(points.where(_finite(axes)), axes, width), width


def _finite(axes: list[str]) -> Column:
    out = F.lit(True)
    for a in axes:
        out = out & F.coalesce(F.abs(F.col(a).cast("double")) < float("inf"), F.lit(False))
    return out


def _met(few: DataFrame, many: DataFrame, key: str, axes: list[str], reach: float, width: float, close: Column, group: list[str], extra: list[str]) -> DataFrame:
    """few's rows (_o_ columns) with the close ones of many that have another key; many has its cells of that width."""
    wide = few.select(*group, *(F.col(c).alias(f"_o_{c}") for c in (key, *axes, *extra)))
    for a in axes:
        ends = [F.floor((F.col(f"_o_{a}") + r) / width) for r in (-reach * (1 + 1e-9), reach * (1 + 1e-9))]
        wide = wide.withColumn(f"_c{a}", F.explode(F.sequence(*ends)))
    both = many.join(wide.hint("merge"), [*group, *(f"_c{a}" for a in axes)])
    return both.where((F.col(key) != F.col(f"_o_{key}")) & close)


def isolated(points: DataFrame, key: str, axes: list[str], distance: float) -> DataFrame:
    """Points that have no other within distance (inclusive): both of a close pair go.

    Points that share a small cell go at once; those alone in theirs, one a cell, are held against all around them.
    """
    dealt, width = _small_cells(points.select(key, *axes), axes, distance)
    cells = [f"_c{a}" for a in axes]
    held = dealt.groupBy(*cells).agg(F.min(key).alias("_low"), F.max(key).alias("_high"), F.first(F.struct(*axes)).alias("_p"))
    crowded = held.where("_low <> _high").select(*cells)
    alone = settle(held.where("_low = _high").select(F.col("_low").alias(key), *(F.col(f"_p.{a}").alias(a) for a in axes)))
    near = _met(alone, dealt, key, axes, distance, width, euclid(axes, distance, strict=False)("", "_o_"), [], []).select(F.col(f"_o_{key}").alias(key))
    gone = dealt.join(crowded.hint("merge"), cells, "left_semi").select(key).unionByName(near)
    return points.join(gone.distinct().hint("merge"), key, "left_anti").select(points.columns)


def best_first(rows: DataFrame, ids: list[str], rank: str, cells: list[str], met: Callable[[DataFrame, DataFrame, bool], DataFrame]) -> DataFrame:
    """(ids...): rows kept by the loop over rank that drops a row close to one kept before.

    met(few, many, first) gives the pairs of few's rows with many's of which the second is close to the first, few's being
    the first ones or the second: the columns of many, and few's ids and rank as _o_<c>.
    Each round takes the best undecided row of every cell; those that no better undecided row is close to are kept, and
    all rows close to them dropped. A cell should hold rows that are close to one another: then few of them are ever
    compared, and the work grows with the rows, not with the pairs.
    """
    left, kept = settle(rows), None
    while True:
        best = settle(left.groupBy(*cells).agg(F.min_by(F.struct(*left.columns), rank).alias("_b")).select("_b.*"))
        if not best.limit(1).count():
            break
        others = [F.col(f"_o_{c}").alias(c) for c in ids]
        blocked = met(best, left, False).where(F.col(rank) < F.col(f"_o_{rank}")).select(*others).distinct()
        won = settle(best.join(blocked.hint("merge"), ids, "left_anti"))
        gone = met(won, left, True).where(F.col(rank) > F.col(f"_o_{rank}")).select(*ids).unionByName(won.select(*ids)).distinct()
        after = settle(left.join(gone.hint("merge"), ids, "left_anti"))
        drop(left, best)
        left, kept = after, won.select(*ids) if kept is None else kept.unionByName(won.select(*ids))
    return left.select(*ids) if kept is None else kept


def greedy(points: DataFrame, key: str, order: list[Column], axes: list[str], reach: float, close: Callable[[str, str], Column], *, group: list[str] = []) -> DataFrame:  # noqa: B006
    """Points kept by the loop over the order that drops a point close to one kept before; key is the row's id."""
    ids = [*group, key]
    dealt, width = _small_cells(points.withColumn("_r", F.struct(*order, F.col(key))).select(*ids, *axes, "_r"), axes, reach)
    met = lambda few, many, first: _met(few, many, key, axes, reach, width, close("", "_o_") if first else close("_o_", ""), group, ["_r"]).withColumns({f"_o_{g}": F.col(g) for g in group})
    kept = best_first(dealt, ids, "_r", [*group, *(f"_c{a}" for a in axes)], met)
    kept = kept.unionByName(points.where(~_finite(axes)).select(*ids))  # close to nothing
    return points.join(kept.hint("merge"), ids, "left_semi").select(points.columns)


#: Below this IoU boxes are dealt to all cells that they touch: sizes may differ too much for classes.
_LEAST_IOU = 1 / 64
_SIDES = ["x1", "y1", "x2", "y2"]


def boxes_met(left: DataFrame, right: DataFrame, least: float, cell: float) -> DataFrame:
    """Pairs of left's boxes (x1, y1, x2, y2, ...) with right's, whose columns come as _o_<c>: each at most once, and all
    whose IoU reaches least (> 0).

    Such boxes' sides differ by 1 / least at most, and their centres lie near one another: the wider box (ties: left's)
    looks for centres around its own in a grid that is as fine as its class of sizes, by halves and doubles of cell; the
    narrower one stands in one cell of each class that it may meet.
    """
    whole = lambda df: df.where("x2 > x1 and y2 > y1")
    size = {"x": F.col("x2") - F.col("x1"), "y": F.col("y2") - F.col("y1")}
    level = lambda a: F.ceil(F.log2(size[a] / cell)).cast("int")
    steps = int(np.ceil(-np.log2(least) - 1e-9))
    grid = lambda a: F.pow(F.lit(2.0), F.col(f"_k{a}")) * cell * (1 - least if least < 0.9 else 0.1)
    renamed = lambda df: df.select(*([c for c in df.columns if c[:2] in ("_k", "_c")]), *(F.col(c).alias(f"_o_{c}") for c in df.columns if c[:2] not in ("_k", "_c")))
    keys = ["_kx", "_ky", "_cx", "_cy"]

    def looking(df: DataFrame) -> DataFrame:
        out = whole(df).withColumns({"_kx": level("x"), "_ky": level("y")})
        # along x the other box is no wider; along y it may be higher
        for a, reach in (("x", 1 - least), ("y", max(1 - least, 0.5 / least - 0.5))):
            middle = (F.col(f"{a}1") + F.col(f"{a}2")) / 2
            ends = [F.floor((middle + k * (reach + 1e-6) * size[a]) / grid(a)) for k in (-1, 1)]
            out = out.withColumn(f"_c{a}", F.explode(F.sequence(*ends)))
        return out

    def standing(df: DataFrame) -> DataFrame:
        out = whole(df).withColumn("_kx", F.explode(F.sequence(level("x"), level("x") + steps)))
        out = out.withColumn("_ky", F.explode(F.sequence(level("y") - steps, level("y") + steps)))
        return out.withColumns({f"_c{a}": F.floor((F.col(f"{a}1") + F.col(f"{a}2")) / 2 / grid(a)) for a in "xy"})

    wider = F.col("x2") - F.col("x1") >= F.col("_o_x2") - F.col("_o_x1")
    one = looking(left).join(renamed(standing(right)).hint("merge"), keys).where(wider)
    two = standing(left).join(renamed(looking(right)).hint("merge"), keys).where(~wider)
    return one.drop(*keys).unionByName(two.drop(*keys))


def boxes_touching(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """As boxes_met, all pairs that overlap at all: boxes stand in every cell they touch, and two count where their overlap begins."""

    def celled(boxes: DataFrame) -> DataFrame:
        for axis in "xy":
            first, last = (F.floor(F.col(f"{axis}{i}") / cell) for i in (1, 2))
            boxes = boxes.withColumn(f"_c{axis}", F.explode(F.sequence(first, F.greatest(first, last))))
        return boxes

    other = celled(right).select("_cx", "_cy", *(F.col(c).alias(f"_o_{c}") for c in right.columns))
    both = celled(left).join(other.hint("merge"), ["_cx", "_cy"])
    for a in "xy":
        both = both.where(F.floor(F.greatest(f"{a}1", f"_o_{a}1") / cell) == F.col(f"_c{a}"))
    return both.drop("_cx", "_cy")


def assigned(rois: DataFrame, truths: DataFrame, cell: float, *, least: float = 0.1, most: float = 0.5) -> DataFrame:
    """(id, truth, iou, is_object): each region's best truth box by IoU; under `least` a region goes, from `most` it is an object.

    Boxes are (id, x1, y1, x2, y2) of any size. Regions look for truths of a great IoU first, which lie close by; only those
    without one look further: what meets a smaller IoU can't be better.
    """
    left = settle(rois.select("id", *_SIDES))
    right = truths.select("id", *_SIDES)
    width = F.greatest(F.lit(0.0), F.least("x2", "_o_x2") - F.greatest("x1", "_o_x1"))
    height = F.greatest(F.lit(0.0), F.least("y2", "_o_y2") - F.greatest("y1", "_o_y1"))
    inner = width * height
    union = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) + (F.col("_o_x2") - F.col("_o_x1")) * (F.col("_o_y2") - F.col("_o_y1")) - inner
    out = None
    for level in [*(v for v in (0.8, 0.6, 0.4, 0.2) if v > least), least]:
        met = boxes_met(left, right, level, cell) if level >= _LEAST_IOU else boxes_touching(left, right, cell)
        both = met.where(inner > 0).select("id", F.col("_o_id").alias("truth"), (inner / union).alias("iou")).where(F.col("iou") >= level)
        best = both.groupBy("id").agg(F.max(F.struct("iou", (-F.col("truth")).alias("t"))).alias("best"))
        best = settle(best.select("id", (-F.col("best.t")).alias("truth"), F.col("best.iou").alias("iou")))
        out = best if out is None else out.unionByName(best)
        if level > least:
            left = settle(left.join(best.select("id").hint("merge"), "id", "left_anti"))
    return out.withColumn("is_object", F.col("iou") >= most)


def matched(predictions: DataFrame, truths: DataFrame, group: str, *, least: float = 0.5) -> DataFrame:
    """(group, id, truth): greedy one-to-one matches of predictions, best first, with the free truth of the greatest IoU.

    Both tables are (group, id, x1, y1, x2, y2), predictions with prob; a group (an image's class) is one task's work.
    """

    def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
        p, t = a.sort_by([("prob", "descending"), ("id", "ascending")]).to_pylist(), b.sort_by("id").to_pylist()
        box = np.array([[r[c] for c in ("x1", "y1", "x2", "y2")] for r in t], float).reshape(-1, 4)
        free = np.ones(len(t), bool)
        found = []
        for r in p:
            w = np.minimum(box[:, 2], r["x2"]) - np.maximum(box[:, 0], r["x1"])
            h = np.minimum(box[:, 3], r["y2"]) - np.maximum(box[:, 1], r["y1"])
            inner = np.maximum(w, 0) * np.maximum(h, 0)
            union = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1]) + (r["x2"] - r["x1"]) * (r["y2"] - r["y1"]) - inner
            iou = np.where(free, inner / union, -1.0)
            if len(iou) and iou.max() >= least:
                best = int(iou.argmax())
                free[best] = False
                found.append((r[group], r["id"], t[best]["id"]))
        return pa.table([pa.array([f[k] for f in found], s) for k, s in enumerate((kind_pa, pa.int64(), pa.int64()))], [group, "id", "truth"])

    kind = predictions.schema[group].dataType.simpleString()
    kind_pa = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[kind]
    left = predictions.select(group, F.col("id").cast("long"), "x1", "y1", "x2", "y2", "prob")
    right = truths.select(group, F.col("id").cast("long"), "x1", "y1", "x2", "y2")
    return left.groupBy(group).cogroup(right.groupBy(group)).applyInArrow(run, f"{group} {kind}, id long, truth long")


def rotation_matrix(phi: Column, theta: Column, psi: Column) -> list[Column]:
    """The nine entries, row by row, of the rotation by ZYZ Euler angles."""
    c1, c2, c3 = F.cos(phi), F.cos(theta), F.cos(psi)
    s1, s2, s3 = F.sin(phi), F.sin(theta), F.sin(psi)
    return [c1 * c2 * c3 - s1 * s3, -c1 * c2 * s3 - s1 * c3, c1 * s2, s1 * c2 * c3 + c1 * s3, -s1 * c2 * s3 + c1 * c3, s1 * s2, -s2 * c3, s2 * s3, c2]


def rigid_distance(r1: Column, r2: Column, t1: Column, t2: Column, weight: float) -> Column:
    """Squared Frobenius distance of two rotations (arrays of 9), and weight times that of two shifts (arrays of 3)."""
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return square(r1, r2) + weight * square(t1, t2)


def set_distances(points: DataFrame, side: str, axes: list[str]) -> DataFrame:
    """(side, axes..., distance): each point's distance to the nearest one of the other side.

    Points look for partners in their grid cell's neighbourhood first; those that find none, or none nearer than the
    cell's width, look again with cells twice as wide, until all have one: no pair of far points is made.
    """
    rows = points.select(side, *axes).distinct().withColumn("_k", F.struct(side, *axes))
    ends = rows.agg(*[F.min(a) for a in axes], *[F.max(a) for a in axes], F.count("*")).first()
    n = len(axes)
    spans = [float(b - a) if a is not None else 0.0 for a, b in zip(ends[:n], ends[n : 2 * n])]
    width = max(max(spans, default=0.0) / max(int(ends[2 * n]), 1) ** (1 / n), 1e-9) * 2
    left, out = settle(rows), None
    while left.limit(1).count():
        whole = width > 2 * max(spans, default=0.0)
        own = left.select(side, "_k", *axes, *(F.floor(F.col(a) / width).alias(f"_c{a}") for a in axes))
        other = rows.select(F.col(side).alias("_s"), *(F.col(a).alias(f"_o{a}") for a in axes), *(F.floor(F.col(a) / width).alias(f"_d{a}") for a in axes))
        for a in axes:
            other = other.withColumn(f"_c{a}", F.explode(F.sequence(F.col(f"_d{a}") - 1, F.col(f"_d{a}") + 1)))
        square = sum((F.col(a) - F.col(f"_o{a}")) * (F.col(a) - F.col(f"_o{a}")) for a in axes)
        met = own.join(other, [f"_c{a}" for a in axes]).where(F.col(side) != F.col("_s")).groupBy("_k").agg(F.min(square).alias("_q"))
        found = settle(met if whole else met.where(F.col("_q") <= width * width))
        out = found if out is None else out.unionByName(found)
        left = settle(left.join(found, "_k", "left_anti"))
        if whole:
            break
        width *= 2
    if out is None:
        return rows.select(side, *axes, F.lit(None).cast("double").alias("distance"))
    return out.select("_k.*", F.sqrt("_q").alias("distance"))


def voronoi_weights(poses: DataFrame, draws: DataFrame, key: str, count: int, *, most: int = 4096) -> DataFrame:
    """(key, weight): the share of draws (i, p) that are nearest to each pose (key, at), ties to the smaller key."""
    if poses.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} poses")
    square = F.aggregate(F.zip_with("p", "at", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    near = draws.join(F.broadcast(poses), F.lit(True)).groupBy("i").agg(F.min(F.struct(square.alias("d"), key)).alias("b"))
    counts = near.groupBy(F.col(f"b.{key}").alias(key)).agg(F.count("*").alias("_n"))
    return poses.select(key).join(counts, key, "left").select(key, (F.coalesce("_n", F.lit(0)) / count).alias("weight"))


def filament_links(points: DataFrame, *, reach: float, cone: float, sigmas: tuple[float, float, float], least: float) -> DataFrame:
    """(id, next, similarity): each point's most similar one ahead, if the similarity exceeds `least`; ties to the smaller id.

    points: (id, x, y, z, corr, ux, uy, uz) with the direction of each. Ahead means within `reach` and at most `cone`
    from the point's direction. With beta and gamma the angles of the step with both directions, the similarity is the
    other's corr times Gaussians of beta - gamma, beta + gamma and the step's length, of the three sigmas.
    """
    from . import links

    return links.filament_links(points, reach=reach, cone=cone, sigmas=sigmas, least=least)


def common_frames(alignments: DataFrame, first: str, second: str, score: str, *, most: int = 10_000) -> list[tuple]:
    """Frames that greedy pairing makes of clusters: pairs, best first, join the frames of their two clusters; the earlier
    frame's first cluster leads. Returns (cluster, leader) of every cluster; the driver holds at most `most` pairs."""
    rows = alignments.select(first, second, score).orderBy(F.desc(score), first, second).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} pairs")
    leader: dict = {}
    for a, b, _ in rows:
        leader.setdefault(a, a)
        leader.setdefault(b, b)
        if leader[a] != leader[b]:
            keep, gone = leader[a], leader[b]
            leader = {c: keep if x == gone else x for c, x in leader.items()}
    return sorted(leader.items())


def redundant_clusters(scores: DataFrame, *, level: float = 0.05) -> DataFrame:
    """(a, b, n, w, z): pairs of clusters whose members match the other's average no worse than their own.

    scores: (record, cluster, template, score), a member's score against every average. A member of cluster a gives the
    difference of its scores against a and b; the signed ranks' sum, by its normal approximation, tells whether a is
    specific against b. Pairs that are not (one-sided at `level`) are returned.
    """
    from statistics import NormalDist

    own = scores.where("template = cluster").select("record", F.col("cluster").alias("a"), F.col("score").alias("_s"))
    other = scores.where("template <> cluster").select("record", F.col("template").alias("b"), F.col("score").alias("_t"))
    d = own.join(other, "record").select("a", "b", (F.col("_s") - F.col("_t")).alias("d")).where("d <> 0")
    w = Window.partitionBy("a", "b").orderBy(F.abs("d"))  # a pair of clusters' members
    ties = Window.partitionBy("a", "b", F.abs("d"))
    ranked = d.withColumn("r", F.rank().over(w) + (F.count("*").over(ties) - 1) / 2)
    s = ranked.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w"))
    n = F.col("n")
    z = (F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return s.withColumn("z", z).where(F.col("z") < NormalDist().inv_cdf(1 - level))
