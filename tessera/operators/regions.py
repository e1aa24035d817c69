"""Regions of volumes and greedy choices among boxes, points and clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import settle
from .pairs import _LEAST_IOU, best_first, boxes_met, boxes_touching
from .voxel import AXES, Shape, stencil


def connected_regions(mask: DataFrame, shape: Shape, *, tile: int = 32) -> DataFrame:
    """(vol_id, x, y, z, region): voxels that touch by a face share a region, the least x * ny * nz + y * nz + z in it.

    Tiles are labelled on their own; only pairs of labels that meet at tile faces are linked, over rounds of
    least-label exchange on those pairs.
    """
    ny, nz = shape[1], shape[2]
    dealt = mask.select("vol_id", *AXES, *(F.floor(F.col(a) / tile).alias(f"t{a}") for a in AXES))
    kind = mask.schema["vol_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        at = [table.column(a).to_numpy().astype(np.int64) for a in AXES]
        own = [p % tile for p in at]
        block = np.full((tile + 2,) * 3, np.iinfo(np.int64).max)
        inside = tuple(p + 1 for p in own)
        block[inside] = at[0] * ny * nz + at[1] * nz + at[2]
        on = block != np.iinfo(np.int64).max
        while True:
            least = block.copy()
            for axis in range(3):
                for step in (1, -1):
                    np.minimum(least, np.roll(block, step, axis), out=least)
            least[~on] = np.iinfo(np.int64).max
            if (least == block).all():
                break
            block = least
        return pa.Table.from_arrays([table.column("vol_id"), *(pa.array(p.astype(np.int32)) for p in at), pa.array(block[inside])], ["vol_id", *AXES, "local"])

    local = settle(dealt.groupBy("vol_id", "tx", "ty", "tz").applyInArrow(run, f"vol_id {kind}, x int, y int, z int, local long"))
    links = None
    for a in AXES:
        edge = local.where(F.col(a) % tile == tile - 1).withColumn(a, F.col(a) + 1).withColumnRenamed("local", "a")
        met = edge.join(local.where(F.col(a) % tile == 0).withColumnRenamed("local", "b"), ["vol_id", *AXES]).select("vol_id", "a", "b")
        links = met if links is None else links.unionByName(met)
    both = settle(links.distinct().select("vol_id", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l")).select("vol_id", "l.a", "l.b"))
    roots = settle(both.select("vol_id", F.col("a").alias("local")).distinct().withColumn("region", F.col("local")))
    while True:
        near = both.join(roots.select("vol_id", F.col("local").alias("b"), "region"), ["vol_id", "b"]).groupBy("vol_id", F.col("a").alias("local")).agg(F.min("region").alias("near"))
        low = roots.join(near, ["vol_id", "local"]).select("vol_id", "local", F.col("region").alias("was"), F.least("region", "near").alias("low"))
        # a label's own label stands in for it: paths halve each round
        jump = roots.select("vol_id", F.col("local").alias("low"), F.col("region").alias("far"))
        after = settle(low.join(jump, ["vol_id", "low"], "left").select("vol_id", "local", "was", F.least("low", F.coalesce("far", "low")).alias("region")))
        roots = after.drop("was")
        if not after.where("region <> was").limit(1).count():
            break
    return local.join(roots, ["vol_id", "local"], "left").select("vol_id", *AXES, F.coalesce("region", "local").alias("region"))


def diffuse(voxels: DataFrame, shape: Shape, rounds: int, kappa: float, gamma: float, *, option: int = 1, **kw) -> DataFrame:
    """Anisotropic diffusion: `rounds` steps against differences to the six neighbours, damped by exp(-(d/kappa)**2)
    (option 1) or 1/(1 + (d/kappa)**2) (option 2). The halo is as wide as the rounds reach."""

    def kernel(v: np.ndarray) -> dict[str, np.ndarray]:
        v = v.copy()
        for _ in range(rounds):
            change = np.zeros_like(v)
            for axis in range(3):
                d = np.diff(v, axis=axis)
                flow = d * (np.exp(-((d / kappa) ** 2)) if option == 1 else 1 / (1 + (d / kappa) ** 2))
                lead, lag = [(0, 0)] * 3, [(0, 0)] * 3
                lead[axis], lag[axis] = (0, 1), (1, 0)
                change += np.pad(flow, lead) - np.pad(flow, lag)
            v += gamma * change
        return {"val": v[(slice(rounds, -rounds),) * 3]}

    return stencil(voxels, shape, rounds, kernel, ["val"], **kw)


def balls(shape: Shape, points: DataFrame, radius: float) -> DataFrame:
    """(vol_id, x, y, z) of the voxels within radius of a point: each point makes its own ball's voxels."""
    r = int(np.ceil(radius))
    out = points.select("vol_id", *(F.col(a).alias(f"p{a}") for a in AXES))
    for a, n in zip(AXES, shape):
        out = out.withColumn(a, F.explode(F.sequence(F.greatest(F.col(f"p{a}") - r, F.lit(0)), F.least(F.col(f"p{a}") + r, F.lit(n - 1)))))
    square = sum((F.col(a) - F.col(f"p{a}")) * (F.col(a) - F.col(f"p{a}")) for a in AXES)
    return out.where(square <= radius * radius).select("vol_id", *AXES).distinct()


def subvolumes(voxels: DataFrame, shape: Shape, peaks: DataFrame, size: int) -> DataFrame:
    """(vol_id, peak, data): cubes of `size` about the peaks (peak, x, y, z); those that leave the volume are dropped.

    Each peak names its cells and meets the voxels by an equi-join. Voxels that are not in the table are 0.
    """
    half = size // 2
    inside = F.lit(True)
    for a, n in zip(AXES, shape):
        inside = inside & (F.col(a) - half >= 0) & (F.col(a) - half + size <= n)
    cells = peaks.where(inside).select("vol_id", "peak", F.explode(F.sequence(F.lit(0), F.lit(size**3 - 1))).alias("pos"), *AXES)
    parts = (F.floor(F.col("pos") / (size * size)), F.floor(F.col("pos") / size) % size, F.col("pos") % size)
    cells = cells.select("vol_id", "peak", "pos", *((F.col(a) - half + p).cast("int").alias(a) for a, p in zip(AXES, parts)))
    found = cells.join(voxels.select("vol_id", *AXES, "val"), ["vol_id", *AXES], "left")
    return found.groupBy("vol_id", "peak").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("val", F.lit(0.0)).alias("val")))), lambda c: c["val"]).alias("data"))


def iou(x1: Column, y1: Column, x2: Column, y2: Column, u1: Column, v1: Column, u2: Column, v2: Column) -> Column:
    both = F.greatest(F.least(x2, u2) - F.greatest(x1, u1), F.lit(0.0)) * F.greatest(F.least(y2, v2) - F.greatest(y1, v1), F.lit(0.0))
    return F.try_divide(both, (x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) - both)


def _overlaps(left: DataFrame, right: DataFrame, least: float, cell: float) -> DataFrame:
    """Pairs of boxes (x1, y1, x2, y2, ...) of left and right (as _o_<c>) with their iou, which exceeds least."""
    met = boxes_met(left, right, least, cell) if least >= _LEAST_IOU else boxes_touching(left, right, cell)
    sides = ("x1", "y1", "x2", "y2")
    return met.withColumn("iou", iou(*(F.col(c) for c in sides), *(F.col(f"_o_{c}") for c in sides))).where(F.col("iou") > least)


def box_pairs(boxes: DataFrame, least: float, cell: float, places: int | None = None) -> DataFrame:
    """(a, b, iou), a < b: boxes (id, x1, y1, x2, y2) whose overlap over union exceeds least; iou to places, if given.

    cell is the boxes' usual size; see overlaps.box_pairs, and pairs.boxes_met for the smallest least.
    """
    from . import overlaps
    from .pairs import _LEAST_IOU

    if least >= _LEAST_IOU:
        return overlaps.box_pairs(boxes, least, cell, places)
    at = boxes.select("id", "x1", "y1", "x2", "y2")
    # of a pair met in both orders one is taken
    iou = F.col("iou") if places is None else F.round("iou", places)
    return _overlaps(at, at, least, cell).where(F.col("id") < F.col("_o_id")).select(F.col("id").alias("a"), F.col("_o_id").alias("b"), iou.alias("iou"))


def suppressed(boxes: DataFrame, least: float, cell: float) -> DataFrame:
    """(id): what the loop over boxes (id, x1, y1, x2, y2, score), best first, ties to the smaller id, keeps when a box goes
    whose overlap over union with one kept before exceeds least. The pairs are never listed; see pairs.best_first."""
    sides = ("x1", "y1", "x2", "y2")
    real = F.coalesce((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.lit(False))
    rows = boxes.where(real).select("id", *sides, F.struct((-F.col("score")).alias("s"), "id").alias("_r"))
    # boxes of a cell have sides within this ratio and corners as near: two of them overlap by more than least
    ratio = max((2 * least / (1 + least)) ** -0.2, 1 + 1e-3) if least > 0 else 2.0
    for a in "xy":
        level = F.floor(F.log(F.col(f"{a}2") - F.col(f"{a}1")) / float(np.log(ratio)))
        rows = rows.withColumn(f"_l{a}", level).withColumn(f"_b{a}", F.floor(F.col(f"{a}1") / (F.pow(F.lit(ratio), level) * (1 - 1 / ratio))))
    kept = best_first(rows, ["id"], "_r", ["_lx", "_ly", "_bx", "_by"], lambda few, many, _: _overlaps(many, few.select("id", *sides, "_r"), least, cell).where(F.col("id") != F.col("_o_id")).select(*many.columns, "_o_id", "_o__r"))
    return kept.unionByName(boxes.where(~real).select("id"))


def keep_greedily(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id): what a greedy loop over items (id, score), best first, ties to the smaller id, keeps when each kept item
    ends the ones it is paired with. Rounds: an item with no better undecided partner is kept."""
    key = F.struct((-F.col("score")).alias("s"), "id")
    keyed = items.select("id", key.alias("key"))
    both = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.a", "p.b")
    won = settle(both.join(keyed.select(F.col("id").alias("a"), F.col("key").alias("ka")), "a").join(keyed.select(F.col("id").alias("b"), F.col("key").alias("kb")), "b").where("ka < kb").select("a", "b").distinct())
    kept, left = None, settle(items.select("id"))
    while left.limit(1).count():
        lose = won.select(F.col("b").alias("id")).distinct()
        best = settle(left.join(lose, "id", "left_anti"))
        kept = best if kept is None else kept.unionByName(best)
        gone = settle(won.join(best.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct())
        left = settle(left.join(best, "id", "left_anti").join(gone, "id", "left_anti"))
        won = settle(won.join(left.withColumnRenamed("id", "a"), "a", "left_semi").join(left.withColumnRenamed("id", "b"), "b", "left_semi"))
    return items.select("id").limit(0) if kept is None else kept


def cover(members: DataFrame, scores: DataFrame, share: float, *, most: int = 10_000) -> list:
    """Clusters taken best first (scores: cluster, score), each if at most `share` of its members (cluster, id) is covered.

    The driver holds the order of at most `most` clusters; members stay in tables, one pass a cluster.
    """
    order = [r[0] for r in scores.orderBy(F.desc("score"), "cluster").limit(most + 1).collect()]
    if len(order) > most:
        raise ValueError(f"more than {most} clusters")
    members = settle(members.select("cluster", "id").distinct())
    taken: list = []
    for c in order:
        own = members.where(F.col("cluster") == c)
        covered = own.join(members.where(F.col("cluster").isin(taken)).select("id").distinct(), "id", "left_semi").count() if taken else 0
        size = own.count()
        if size and covered / size <= share:
            taken.append(c)
    return taken


def lloyd(points: DataFrame, centres: list[list[float]], rounds: int, key: str, column: str) -> tuple[DataFrame, list[list[float]]]:
    """(key, cluster) after `rounds` of k-means from the given centres, and the centres. Ties go to the smaller cluster.

    Centres are literals of the plan: k * size doubles; a cluster left empty keeps its centre.
    """
    from .records import array_mean, square_distance

    def assigned(now: list[list[float]]) -> DataFrame:
        at = F.array(*[F.struct(square_distance(F.col(column), F.array(*[F.lit(float(x)) for x in c])).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(now)])
        return points.withColumn("cluster", F.array_min(at)["k"])

    for _ in range(rounds):
        for row in array_mean(assigned(centres), "cluster", column, len(centres[0])).collect():  # k rows
            centres[row["cluster"]] = list(row["mean"])
    return assigned(centres).select(key, "cluster"), centres


def slic(voxels: DataFrame, step: int, compactness: float, *, rounds: int = 10) -> DataFrame:
    """(centre, x, y, z, val): supervoxel centres after some rounds from seeds on a grid of step.

    A voxel goes to the nearest centre no farther than step along any axis, by the squared distance over step squared
    plus that of values over compactness squared; centres move to their voxels' means. Centres are hashed to a grid.
    """
    from ..plans.iterate import settle

    at = voxels.select("x", "y", "z", "val")
    mean = [F.avg(c).alias(f"c{c}") for c in ("x", "y", "z", "val")]
    number = F.floor(F.col("x") / step) * 100 + F.floor(F.col("y") / step) * 10 + F.floor(F.col("z") / step)
    centres = at.groupBy(number.cast("int").alias("centre")).agg(*mean)
    cells = at.withColumns({f"g{a}": F.floor(F.col(a) / step) for a in "xyz"})
    for _ in range(rounds):
        wide = settle(centres)
        for a in "xyz":
            cell = F.floor(F.col(f"c{a}") / step)
            wide = wide.withColumn(f"g{a}", F.explode(F.sequence(cell - 1, cell + 1)))
        near = cells.join(wide, ["gx", "gy", "gz"])
        for a in "xyz":
            near = near.where(F.abs(F.col(a) - F.col(f"c{a}")) <= step)
        apart = sum((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in "xyz") / (step * step)
        apart = F.round(apart + (F.col("val") - F.col("cval")) * (F.col("val") - F.col("cval")) / (compactness * compactness), 9)
        own = near.groupBy("x", "y", "z", "val").agg(F.min(F.struct(apart.alias("d"), "centre")).alias("b"))
        centres = own.groupBy(F.col("b.centre").alias("centre")).agg(*mean)
    return centres.select("centre", *(F.col(f"c{c}").alias(c) for c in ("x", "y", "z", "val")))


def normalized_cut(edges: DataFrame) -> DataFrame:
    """(part, share): of edges (s, t, w) between parts, what crosses a part's border of all weight at its nodes."""
    ends = edges.select(F.col("s").alias("part"), "w", (F.col("s") != F.col("t")).alias("x")).unionAll(edges.select("t", "w", F.col("s") != F.col("t")))
    return ends.groupBy("part").agg((F.sum(F.when(F.col("x"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("share")).withColumn("part", F.col("part").cast("int"))
