"""Voxel tables (vol_id, x, y, z, val): tiles with halos, stencils, extrema, geometry.

A stencil deals the voxels to tiles, each with a halo as wide as the kernel reaches, runs one numpy kernel
a tile and returns the tile's own voxels only: one shuffle, and no task holds more than a tile with its halo,
however large the volume. Voxels that are not in the table are 0.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Shape = tuple[int, int, int]
AXES = ("x", "y", "z")


def tile_bases(shape: Shape, step: int, overlap: int, spark) -> DataFrame:
    """(i0, i1, i2, x0, x1, y0, y1, z0, z1): tiles every `step` voxels that reach `overlap` further, cut at the edge."""
    counts = [max(1, -(-(n - overlap) // step)) for n in shape]
    out = spark.range(int(np.prod(counts))).select((F.col("id") / (counts[1] * counts[2])).cast("int").alias("i0"), ((F.col("id") / counts[2]).cast("long") % counts[1]).cast("int").alias("i1"), (F.col("id") % counts[2]).cast("int").alias("i2"))
    for k, (a, n) in enumerate(zip(AXES, shape)):
        out = out.withColumn(f"{a}0", F.col(f"i{k}") * step).withColumn(f"{a}1", F.least(F.col(f"i{k}") * step + step + overlap, F.lit(n)))
    return out


def stencil(voxels: DataFrame, shape: Shape, halo: int, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], outputs: list[str], *, tile: int = 32, edge: str = "symmetric", rounded: int | None = None) -> DataFrame:
    """(vol_id, x, y, z, outputs...) for every voxel of the grid.

    kernel gets a tile with its halo, filled at the volume's edge by numpy's pad mode `edge`, and returns
    arrays of the tile's own shape.
    """
    counts = [-(-n // tile) for n in shape]

    def tiles_of(axis: str, n: int, count: int) -> Column:
        c = F.col(axis)
        first = F.greatest(F.floor((c - halo) / tile), F.lit(0))
        last = F.least(F.floor((c + halo) / tile), F.lit(count - 1))
        return F.sequence(first.cast("int"), last.cast("int"))

    dealt = voxels.select("vol_id", *AXES, F.col("val").cast("double"))
    for k, (a, n, count) in enumerate(zip(AXES, shape, counts)):
        dealt = dealt.withColumn(f"t{k}", F.explode(tiles_of(a, n, count)))
    # every tile of every volume is there, also where it holds no voxel
    every = voxels.select("vol_id").distinct()
    for k, count in enumerate(counts):
        every = every.withColumn(f"t{k}", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    dealt = dealt.unionByName(every, allowMissingColumns=True)

    def run(table: pa.Table) -> pa.Table:
        t = [table.column(f"t{k}")[0].as_py() for k in range(3)]
        low = [max(i * tile - halo, 0) for i in t]
        high = [min((i + 1) * tile + halo, n) for i, n in zip(t, shape)]
        block = np.zeros([b - a for a, b in zip(low, high)])
        own = table.filter(table.column("x").is_valid())
        at = [own.column(a).to_numpy().astype(np.int64) - o for a, o in zip(AXES, low)]
        block[tuple(at)] = own.column("val").to_numpy()
        pads = [(halo - (i * tile - a), halo - (b - min((i + 1) * tile, n))) for i, a, b, n in zip(t, low, high, shape)]
        found = kernel(np.pad(block, pads, mode=edge) if halo else block)
        size = next(iter(found.values())).shape
        places = np.indices(size).reshape(3, -1)
        columns = [pa.array([table.column("vol_id")[0].as_py()] * places.shape[1], table.schema.field("vol_id").type)]
        columns += [pa.array((p + i * tile).astype(np.int32)) for p, i in zip(places, t)]
        columns += [pa.array(np.round(found[o].ravel().astype(float), rounded) + 0.0 if rounded is not None else found[o].ravel().astype(float)) for o in outputs]
        return pa.Table.from_arrays(columns, ["vol_id", *AXES, *outputs])

    kind = voxels.schema["vol_id"].dataType.simpleString()
    return dealt.groupBy("vol_id", "t0", "t1", "t2").applyInArrow(run, f"vol_id {kind}, x int, y int, z int, " + ", ".join(f"{o} double" for o in outputs))


def gauss_weights(sigma: float, truncate: float = 4.0) -> np.ndarray:
    radius = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return w / w.sum()


def _convolve(block: np.ndarray, weights: np.ndarray) -> np.ndarray:
    for axis in range(3):
        n = block.shape[axis] - len(weights) + 1
        block = sum(w * np.take(block, range(i, i + n), axis) for i, w in enumerate(weights))
    return block


def _inner(block: np.ndarray, by: int) -> np.ndarray:
    return block[by : block.shape[0] - by, by : block.shape[1] - by, by : block.shape[2] - by] if by else block


def _dog(block: np.ndarray, halo: int, s1: float, s2: float) -> np.ndarray:
    a, b = gauss_weights(s1), gauss_weights(s2)
    return _convolve(_inner(block, halo - len(a) // 2), a) - _convolve(_inner(block, halo - len(b) // 2), b)


def smooth(voxels: DataFrame, shape: Shape, sigma: float, **kw) -> DataFrame:
    w = gauss_weights(sigma)
    return stencil(voxels, shape, len(w) // 2, lambda b: {"val": _convolve(b, w)}, ["val"], **kw)


def dog(voxels: DataFrame, shape: Shape, s1: float, s2: float | None = None, **kw) -> DataFrame:
    """Gaussian smooth of s1 less that of s2 (1.1 * s1 if not given)."""
    s2 = 1.1 * s1 if s2 is None else s2
    halo = max(len(gauss_weights(s1)), len(gauss_weights(s2))) // 2
    return stencil(voxels, shape, halo, lambda b: {"val": _dog(b, halo, s1, s2)}, ["val"], **kw)


#: The 18 neighbours that differ in at most two coordinates.
NEIGHBOURS = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if 0 < abs(i) + abs(j) + abs(k) < 3]


def _around(block: np.ndarray, pick) -> np.ndarray:
    inner = _inner(block, 1)
    out = None
    for i, j, k in NEIGHBOURS:
        part = block[1 + i : 1 + i + inner.shape[0], 1 + j : 1 + j + inner.shape[1], 1 + k : 1 + k + inner.shape[2]]
        out = part if out is None else pick(out, part)
    return out


def extrema(voxels: DataFrame, shape: Shape, *, maxima: bool = True, **kw) -> DataFrame:
    """Voxels that no neighbour exceeds (or falls below), without the plateau of the volume's least (greatest) value.

    Ties all stay. Background is the volume's own extreme: voxels that the table leaves out are 0.
    """
    pick = np.maximum if maxima else np.minimum

    def kernel(block: np.ndarray) -> dict[str, np.ndarray]:
        own, best = _inner(block, 1), _around(block, pick)
        return {"val": own, "is_peak": (own >= best) if maxima else (own <= best)}

    size = int(np.prod(shape))
    edge = F.min("val") if maxima else F.max("val")
    zero = F.least if maxima else F.greatest
    ground = voxels.groupBy("vol_id").agg(edge.cast("double").alias("_e"), F.count("*").alias("_n"))
    ground = ground.select("vol_id", F.when(F.col("_n") < size, zero("_e", F.lit(0.0))).otherwise(F.col("_e")).alias("_e"))
    ground = ground.withColumn("_e", F.round("_e", kw["rounded"])) if kw.get("rounded") is not None else ground
    found = stencil(voxels, shape, 1, kernel, ["val", "is_peak"], **kw).where("is_peak = 1").drop("is_peak")
    apart = (F.col("val") > F.col("_e")) if maxima else (F.col("val") < F.col("_e"))
    return found.join(ground, "vol_id").where(apart).drop("_e")


def above_threshold(peaks: DataFrame, t: float) -> DataFrame:
    """Peaks of at least m + t (M - m) / 20, m and M being the least and the greatest of their volume's peaks."""
    ends = peaks.groupBy("vol_id").agg(F.min("val").alias("_least"), F.max("val").alias("_most"))
    return peaks.join(ends, "vol_id").where(F.col("val") >= F.col("_least") + t * (F.col("_most") - F.col("_least")) / 20).drop("_least", "_most")


def pick(voxels: DataFrame, shape: Shape, s1: float, s2: float, *, t: float, distance: float, pick_num: int | None = None, rounded: int | None = None) -> DataFrame:
    """Particle picking: difference of Gaussians, its local maxima over the threshold, the best of close ones.

    The DoG is written once: its maxima are looked for in one pass. pick_num keeps that many best peaks of each volume.
    """
    from ..plans.iterate import settle

    found = above_threshold(extrema(settle(dog(voxels, shape, s1, s2, rounded=rounded)), shape), t)
    kept = suppress(found, distance)
    if pick_num is None:
        return kept
    w = Window.partitionBy("vol_id").orderBy(F.desc("val"), *AXES)
    return kept.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= pick_num).drop("_i")


def gradient(voxels: DataFrame, shape: Shape, **kw) -> DataFrame:
    """Forward differences, 0 in the last plane of each axis, and their squared magnitude."""

    def kernel(block: np.ndarray) -> dict[str, np.ndarray]:
        own = _inner(block, 1)
        d = [np.roll(block, -1, a)[1:-1, 1:-1, 1:-1] - own for a in range(3)]
        return {"dx": d[0], "dy": d[1], "dz": d[2], "mag": d[0] ** 2 + d[1] ** 2 + d[2] ** 2}

    return stencil(voxels, shape, 1, kernel, ["dx", "dy", "dz", "mag"], edge="edge", **kw)


def dilate(voxels: DataFrame, shape: Shape, **kw) -> DataFrame:
    """Greatest value of the voxel and its 18 neighbours."""
    return stencil(voxels, shape, 1, lambda b: {"val": np.maximum(_inner(b, 1), _around(b, np.maximum))}, ["val"], edge="edge", **kw)


def eigenvalues(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> list[Column]:
    """Closed-form eigenvalues of symmetric 3 x 3 matrices, as columns, largest first."""
    q = (xx + yy + zz) / 3
    p2 = ((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6
    p = F.sqrt(p2)
    a, b, c = (xx - q) / p, (yy - q) / p, (zz - q) / p
    d, e, f = xy / p, xz / p, yz / p
    half = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3
    first = q + 2 * p * F.cos(angle)
    last = q + 2 * p * F.cos(angle + 2 * np.pi / 3)
    return [F.when(p2 == 0, q).otherwise(v) for v in (first, 3 * q - first - last, last)]


def by_magnitude(values: list[Column]) -> Column:
    """The values as an array, the greatest by size first; of equal sizes the greater first."""
    size = lambda c: F.round(F.abs(c), 6)
    order = lambda a, b: F.when(size(a) > size(b), -1).when(size(a) < size(b), 1).when(a > b, -1).when(a < b, 1).otherwise(0)
    return F.array_sort(F.array(*values), order)


def hessian(voxels: DataFrame, shape: Shape, **kw) -> DataFrame:
    """Second forward differences xx, yy, zz, xy, xz, yz."""

    def kernel(block: np.ndarray) -> dict[str, np.ndarray]:
        step = lambda v, a: np.roll(v, -1, a) - v
        d = [step(block, a) for a in range(3)]
        return {x + y: _inner(step(d[AXES.index(x)], AXES.index(y)), 2) for x, y in ("xx", "yy", "zz", "xy", "xz", "yz")}

    return stencil(voxels, shape, 2, kernel, ["xx", "yy", "zz", "xy", "xz", "yz"], edge="edge", **kw)


def roll(voxels: DataFrame, shape: Shape, shift: Shape) -> DataFrame:
    return voxels.select("vol_id", *(F.pmod(F.col(a) + s, F.lit(n)).cast("int").alias(a) for a, s, n in zip(AXES, shift, shape)), "val")


def crop(voxels: DataFrame, low: Shape, high: Shape) -> DataFrame:
    """The voxels of [low, high), counted from low; the ranges reach a parquet scan as filters."""
    inside = [(F.col(a) >= lo) & (F.col(a) < hi) for a, lo, hi in zip(AXES, low, high)]
    return voxels.where(inside[0] & inside[1] & inside[2]).select("vol_id", *((F.col(a) - lo).cast("int").alias(a) for a, lo in zip(AXES, low)), "val")


def grid(spark, shape: Shape) -> DataFrame:
    """(x, y, z) of every voxel."""
    rest, per = F.col("id"), shape[1] * shape[2]
    return spark.range(int(np.prod(shape))).select(F.floor(rest / per).cast("int").alias("x"), (F.floor(rest / shape[2]) % shape[1]).cast("int").alias("y"), (rest % shape[2]).cast("int").alias("z"))


def boundary_mask(spark, shape: Shape) -> DataFrame:
    """1 in the outermost planes, 0 inside."""
    edge = F.lit(False)
    for a, n in zip(AXES, shape):
        edge = edge | F.col(a).isin(0, n - 1)
    return grid(spark, shape).select(*AXES, edge.cast("int").alias("val"))


def dog_kernel(spark, size: int, s1: float, s2: float) -> DataFrame:
    """Difference of two Gaussians about the middle of a cube, each of sum 1."""
    r = sum((F.col(a) - size // 2) * (F.col(a) - size // 2) for a in AXES).cast("double")
    at = grid(spark, (size, size, size)).select(*AXES, *(F.exp(-r / (2 * s * s)).alias(n) for s, n in ((s1, "_a"), (s2, "_b"))))
    total = at.agg(F.sum("_a").alias("_ta"), F.sum("_b").alias("_tb"))
    return at.join(F.broadcast(total), F.lit(True)).select(*AXES, (F.col("_a") / F.col("_ta") - F.col("_b") / F.col("_tb")).alias("val"))


def gaussian_sum(spark, size: int, bumps: list[tuple]) -> DataFrame:
    """Sum of ellipsoidal Gaussians (x, y, z from the middle, three widths over the size, turn about z)."""
    p, q, s = (F.col(a) - size / 2 for a in AXES)
    value = F.lit(0.0)
    for x, y, z, a, b, c, turn in bumps:
        cos, sin = float(np.cos(turn)), float(np.sin(turn))
        u, v, w = cos * p + sin * q - x, -sin * p + cos * q - y, s - z
        value = value + F.exp(-(u * u / (size * a) + v * v / (size * b) + w * w / (size * c)))
    return grid(spark, (size, size, size)).select(*AXES, value.alias("val"))


BOX = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]


def dilate_periodic(voxels: DataFrame, shape: Shape, width: int) -> DataFrame:
    """Greatest value in a cube of an odd width, the volume wrapping around: a maximum along each axis in turn.

    Each voxel is sent to the places it reaches and combined before the shuffle. Voxels left out of the table are 0,
    and so are negative maxima beside them: the table must be whole where values are negative.
    """
    reach = width // 2
    out = voxels.select("vol_id", *AXES, "val")
    for a, n in zip(AXES, shape):
        rest = [c for c in AXES if c != a]
        sent = out.withColumn("_o", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
        sent = sent.select("vol_id", *rest, F.pmod(F.col(a) + F.col("_o"), F.lit(n)).cast("int").alias(a), "val")
        out = sent.groupBy("vol_id", *AXES).agg(F.max("val").alias("val"))
    every = grid(voxels.sparkSession, shape).join(voxels.select("vol_id").distinct(), F.lit(True))
    return every.join(out, ["vol_id", *AXES], "left").fillna(0.0, "val").select("vol_id", *AXES, "val")


def segment_boundary(labels: DataFrame, shape: Shape, **kw) -> DataFrame:
    """Voxels (val is the label) that have another label among their 26 neighbours."""

    def kernel(block: np.ndarray) -> dict[str, np.ndarray]:
        own = _inner(block, 1)
        other = np.zeros(own.shape, bool)
        for i, j, k in BOX:
            other |= block[1 + i : 1 + i + own.shape[0], 1 + j : 1 + j + own.shape[1], 1 + k : 1 + k + own.shape[2]] != own
        return {"val": own, "edge": other}

    return stencil(labels, shape, 1, kernel, ["val", "edge"], edge="edge", **kw).where("edge = 1").drop("edge")


def distance_transform(mask: DataFrame, shape: Shape) -> DataFrame:
    """(vol_id, x, y, z, val): Euclidean distance of every voxel of the mask (val > 0) to the nearest one outside of it.

    One axis after the other, by lines: the least of f(j) + (i - j)^2 over a line is exact for the square of the
    distance. A task holds one line's group at a time. A mask without an outside has infinite distances.
    """
    every = grid(mask.sparkSession, shape).join(mask.select("vol_id").distinct(), F.lit(True))
    known = every.join(mask.select("vol_id", *AXES, "val"), ["vol_id", *AXES], "left")
    out = known.select("vol_id", *AXES, F.when(F.col("val") > 0, float("inf")).otherwise(0.0).alias("val"))

    def along(a: str, n: int):
        def run(table: pa.Table) -> pa.Table:
            f = np.full(n, np.inf)
            f[table.column(a).to_numpy()] = table.column("val").to_numpy()
            i = np.arange(n)
            best = (f + (i[:, None] - i) ** 2).min(1)
            same = {c: pa.array([table.column(c)[0].as_py()] * n, table.schema.field(c).type) for c in ("vol_id", *AXES)}
            return pa.table([pa.array(i.astype(np.int32)) if c == a else same[c] for c in ("vol_id", *AXES)] + [pa.array(best)], ["vol_id", *AXES, "val"])

        return run

    kind = mask.schema["vol_id"].dataType.simpleString()
    for a, n in zip(AXES, shape):
        lines = out.groupBy("vol_id", *(c for c in AXES if c != a))
        out = lines.applyInArrow(along(a, n), f"vol_id {kind}, x int, y int, z int, val double")
    return out.withColumn("val", F.sqrt("val"))


def tiles_padded(voxels: DataFrame, shape: Shape, size: int) -> DataFrame:
    """(vol_id, x0, y0, z0, total, filled, padded): tiles that don't overlap, their sums and how much lies outside."""
    at = [F.floor(F.col(a) / size).alias(f"i{a}") for a in AXES]
    every = grid(voxels.sparkSession, tuple(-(-n // size) for n in shape)).select(*(F.col(a).alias(f"i{a}") for a in AXES))
    every = every.join(voxels.select("vol_id").distinct(), F.lit(True))
    sums = voxels.groupBy("vol_id", *at).agg(F.sum("val").alias("total"))
    filled = F.lit(1).cast("long")
    for a, n in zip(AXES, shape):
        filled = filled * (F.least((F.col(f"i{a}") + 1) * size, F.lit(n)) - F.col(f"i{a}") * size)
    both = every.join(sums, ["vol_id", "ix", "iy", "iz"], "left").fillna(0.0, "total").withColumn("filled", filled)
    return both.select("vol_id", *((F.col(f"i{a}") * size).cast("int").alias(f"{a}0") for a in AXES), "total", "filled", (F.lit(size**3) - F.col("filled")).alias("padded"))


def split_patches(voxels: DataFrame, width: int, height: int) -> DataFrame:
    """(vol_id, row, col, z, i, j, val): slices cut into patches."""
    cut = lambda a, n, i, j: (F.floor(F.col(a) / n).cast("int").alias(i), (F.col(a) % n).cast("int").alias(j))
    (row, i), (col, j) = cut("x", width, "row", "i"), cut("y", height, "col", "j")
    return voxels.select("vol_id", row, col, "z", i, j, "val")


def stitch_patches(patches: DataFrame, width: int, height: int) -> DataFrame:
    at = lambda a, n, i: (F.col(a) * n + F.col(i)).cast("int")
    return patches.select("vol_id", at("row", width, "i").alias("x"), at("col", height, "j").alias("y"), "z", "val")


def add_templates(voxels: DataFrame, centres: DataFrame, template: dict[tuple, float], shape: Shape, *, replace: bool = False) -> DataFrame:
    """The map with a template added around every centre, or put in its place (the centre of the greatest value wins).

    What falls outside of the volume is cut. Voxels of 0 are left out.
    """
    arms = F.array(*[F.struct(*[F.lit(c).alias(f"d{a}") for a, c in zip(AXES, o)], F.lit(float(w)).alias("w")) for o, w in template.items()])
    sent = centres.select("vol_id", *(F.col(a).alias(f"c{a}") for a in AXES), F.col("val").alias("_v"), F.explode(arms).alias("_o"))
    sent = sent.select("vol_id", *((F.col(f"c{a}") + F.col(f"_o.d{a}")).alias(a) for a in AXES), F.col("_o.w").alias("_w"), F.struct("_v", "cx", "cy", "cz").alias("_k"))
    for a, n in zip(AXES, shape):
        sent = sent.where((F.col(a) >= 0) & (F.col(a) < n))
    new = sent.groupBy("vol_id", *AXES).agg((F.max_by("_w", "_k") if replace else F.sum("_w")).alias("_w"))
    both = voxels.select("vol_id", *AXES, "val").join(new, ["vol_id", *AXES], "full")
    value = F.coalesce("_w", "val") if replace else F.coalesce("val", F.lit(0.0)) + F.coalesce("_w", F.lit(0.0))
    return both.select("vol_id", *AXES, value.alias("val")).where("val <> 0")


def sphere_mask(spark, shape: Shape, centre: tuple[float, float, float], radius: float, sigma: float = 0.0) -> DataFrame:
    """1 within the radius, a Gaussian edge of sigma beyond it (0 where that is 0)."""
    n = int(np.prod(shape))
    grid = spark.range(n).select((F.col("id") / (shape[1] * shape[2])).cast("int").alias("x"), ((F.col("id") / shape[2]).cast("long") % shape[1]).cast("int").alias("y"), (F.col("id") % shape[2]).cast("int").alias("z"))
    r = F.sqrt(sum((F.col(a) - c) * (F.col(a) - c) for a, c in zip(AXES, centre)))
    edge = F.exp(-((r - radius) / sigma) * ((r - radius) / sigma)) if sigma else F.lit(0.0)
    return grid.select(*AXES, F.round(F.when(r <= radius, 1.0).otherwise(edge), 6).alias("val"))


def suppress(peaks: DataFrame, distance: float) -> DataFrame:
    """Greedy keep-best: a peak goes if a better kept peak of its volume lies closer than distance.

    The order is (val desc, x, y, z); see pairs.greedy for the rounds.
    """
    from .pairs import euclid, greedy

    place = F.concat_ws("_", *AXES)
    ranked = peaks.withColumn("_at", place)
    kept = greedy(ranked, "_at", [(-F.col("val")).alias("v"), *AXES], list(AXES), max(distance, 1e-9), euclid(list(AXES), distance, strict=True), group=["vol_id"])
    return kept.drop("_at")
