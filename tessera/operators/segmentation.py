"""Segmentation kernels on one volume, and their use on array columns: flooding from seeds, level sets, surfaces, spheres.

A volume here is a record's cut-out (an array column), one Arrow row; flooding.py and levelset.py work on whole tomograms.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lines import implicit_step
from ..functions.spectra import Shape, map_volumes

_BOX = np.array([o for o in np.ndindex(3, 3, 3) if o != (1, 1, 1)]) - 1


def flood(v: np.ndarray, seeds: np.ndarray, *, most: int | None = None, most_each: int | None = None, conflict: int = -1) -> np.ndarray:
    """Labels grown from positive seeds over 26 neighbours, brightest voxels first (ties: first in C order).

    A voxel that two labels reach is a conflict and grows no further. `most` bounds the labelled voxels of the volume
    and `most_each` those of a label, as the operator's size limits; voxels that aren't finite are left out.
    """
    shape = np.array(v.shape)
    out = seeds.astype(np.int64).copy()
    waiting: list = []
    queued = np.zeros(v.shape, bool)
    sizes = {int(k): int(n) for k, n in zip(*np.unique(out[out > 0], return_counts=True))}
    total = sum(sizes.values())

    def around(at) -> list[tuple]:
        near = np.asarray(at) + _BOX
        return [tuple(p) for p in near[((near >= 0) & (near < shape)).all(1)]]

    def wait(at) -> None:
        for p in around(at):
            if out[p] == 0 and not queued[p] and np.isfinite(v[p]):
                queued[p] = True
                heapq.heappush(waiting, (-v[p], p))

    for at in np.argwhere(out > 0):
        wait(tuple(at))
    while waiting:
        _, at = heapq.heappop(waiting)
        labels = {int(out[p]) for p in around(at) if out[p] > 0}
        if len(labels) > 1:
            out[at] = conflict
            continue
        label = labels.pop()
        if most_each is not None and sizes[label] >= most_each:
            continue
        if most is not None and total >= most:
            break
        out[at] = label
        sizes[label] += 1
        total += 1
        wait(at)
    return out


def signed_distance(inside: np.ndarray) -> np.ndarray:
    """Distance to the nearest voxel of the other side, positive inside; a volume of one side has distances of its size."""

    def to(mask: np.ndarray) -> np.ndarray:
        f = np.where(mask, 0.0, float(sum(n * n for n in mask.shape)))
        for axis, n in enumerate(mask.shape):
            i = np.arange(n)
            f = np.moveaxis((np.moveaxis(f, axis, 0)[None] + ((i[:, None] - i) ** 2).reshape(n, n, *[1] * (mask.ndim - 1))).min(1), 0, axis)
        return np.sqrt(f)

    return np.where(inside, to(~inside), -to(inside))


def _implicit_smooth(u: np.ndarray, t: float) -> np.ndarray:
    """One additive-splitting step of the heat equation: the mean of implicit steps of 3 t along each axis, edges mirrored."""
    out = np.zeros_like(u)
    for axis in range(u.ndim):
        out += np.moveaxis(implicit_step(np.moveaxis(u, axis, 0), u.ndim * t), 0, axis)
    return out / u.ndim


def two_phase(v: np.ndarray, start: np.ndarray | None = None, *, smooth: float = 0.2, image: float = 1.0, rounds: int = 20) -> np.ndarray | None:
    """A level set (positive inside) that splits the volume into two mean values: each round moves it by how much nearer a
    voxel is to the inner mean, makes it a distance again and smooths it. Ends when no voxel changes sides; None where one
    side is empty. Starts from the voxels above the mean."""
    scale = v.std() or 1.0
    w = (v - v.mean()) / scale
    u = signed_distance(w > 0) if start is None else start.astype(float)
    for _ in range(rounds):
        inside = u >= 0
        if inside.all() or not inside.any():
            return None
        low, high = w[~inside].mean(), w[inside].mean()
        moved = signed_distance(u >= 0) + image * ((w - low) ** 2 - (w - high) ** 2)
        u = _implicit_smooth(signed_distance(moved >= 0), smooth)
        if ((u >= 0) == inside).all():
            break
    return u


def template_guided(v: np.ndarray, template: np.ndarray, *, cutoff: float = 0.0) -> np.ndarray:
    """v where the template's segment is, its own mean elsewhere; the segment is the template's level set over the cutoff."""
    phi = two_phase(template)
    return v if phi is None else np.where(phi >= cutoff, v, v.mean())


def level_sets(df: DataFrame, column: str, shape: Shape, **kw) -> DataFrame:
    """df with phi, the level set of every volume; rows without two phases have an array of NaN."""

    def kernel(v: np.ndarray) -> dict[str, np.ndarray]:
        found = [two_phase(x, **kw) for x in v]
        return {"phi": np.array([np.full(shape, np.nan) if f is None else f for f in found])}

    return map_volumes(df, [column], shape, kernel, ["phi"])


def watersheds(df: DataFrame, column: str, seeds: str, shape: Shape, **kw) -> DataFrame:
    """df with labels grown from the seeds of every volume."""

    def kernel(v: np.ndarray, s: np.ndarray) -> dict[str, np.ndarray]:
        return {"labels": np.array([flood(a, b, **kw) for a, b in zip(v, s)])}

    return map_volumes(df, [column, seeds], shape, kernel, ["labels"])


def pose_normalised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, axes, turned): centre of mass of the positive part, its principal axes, and the volume turned onto them."""
    from ..functions.rotation import angles_of, rotate

    w = np.maximum(v, 0)
    places = np.indices(v.shape).reshape(3, -1).T
    weight = w.ravel() / max(w.sum(), 1e-300)
    centre = weight @ places
    off = places - centre
    values, axes = np.linalg.eigh((off * weight[:, None]).T @ off)
    axes = axes[:, ::-1]
    axes[:, 2] *= np.sign(np.linalg.det(axes)) or 1.0
    rm = axes.T
    return centre, axes, rotate(v, angles_of(rm), -((centre - (np.array(v.shape) - 1) / 2) @ rm.T))


# spheres


def least_squares_sphere(points: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and radius of the sphere of the least algebraic error through points."""
    a = np.concatenate((2 * points, np.ones((len(points), 1))), 1)
    x = np.linalg.lstsq(a, (points**2).sum(1), rcond=None)[0]
    return x[:3], float(np.sqrt(max(x[3] + x[:3] @ x[:3], 0)))


def sphere_by_consensus(points: np.ndarray, tolerance: float, *, probability: float = 0.99, most_trials: int = 200, seed: int = 0) -> tuple[np.ndarray, float, np.ndarray]:
    """(centre, radius, inliers): spheres through four drawn points; that of the most inliers is fitted to them all.

    Trials end when that many draws have four inliers once at the probability."""
    r = np.random.default_rng(seed)
    best, trials, needed = np.zeros(len(points), bool), 0, most_trials
    while trials < min(needed, most_trials) and len(points) >= 4:
        trials += 1
        centre, radius = least_squares_sphere(points[r.choice(len(points), 4, replace=False)])
        near = np.abs(np.linalg.norm(points - centre, axis=1) - radius) <= tolerance
        if near.sum() > best.sum():
            best = near
            missed = 1 - near.mean() ** 4
            needed = 1 if missed <= 0 else np.ceil(np.log(1 - probability) / np.log(missed)) if missed < 1 else most_trials
    if best.sum() < 4:
        return np.full(3, np.nan), float("nan"), best
    return *least_squares_sphere(points[best]), best


def smallest_sphere(points: np.ndarray, *, seed: int = 0) -> tuple[np.ndarray, float]:
    """The exact smallest ball that holds all points: points are taken in a drawn order, and one that lies outside of the
    ball so far stands on the border of the ball of those before it (at most four do)."""
    p = np.unique(points.astype(float), axis=0)
    p = p[np.random.default_rng(seed).permutation(len(p))]

    def through(border: list[np.ndarray]) -> tuple[np.ndarray, float]:
        if not border:
            return np.zeros(3), -1.0
        base = border[0]
        if len(border) == 1:
            return base, 0.0
        d = np.array(border[1:]) - base
        t = np.linalg.lstsq(2 * d @ d.T, (d**2).sum(1), rcond=None)[0] @ d
        return base + t, float(np.linalg.norm(t))

    def ball(n: int, border: list[np.ndarray]) -> tuple[np.ndarray, float]:
        centre, radius = through(border)
        if len(border) == 4:
            return centre, radius
        for i in range(n):
            if np.linalg.norm(p[i] - centre) > radius + 1e-9 * max(1.0, radius):
                centre, radius = ball(i, [*border, p[i]])
        return centre, radius

    return ball(len(p), [])


def smallest_spheres(points: DataFrame, group: str) -> DataFrame:
    """(group, x, y, z, radius): the smallest ball of each group's points (group, x, y, z).

    Only points of a group's hull can be on the border. Before a group comes together, each task keeps of its points
    those on the border of their own smallest ball's outer shell: the farthest along 26 directions. Their ball is grown
    by the points that lie outside of it, found by a join, until none does; a round adds the farthest ones alone.
    """
    from ..plans.iterate import settle

    kind = points.schema[group].dataType.simpleString()
    axes = ("x", "y", "z")
    own = settle(points.select(group, *(F.col(a).cast("double") for a in axes)).distinct())
    corners = [F.max_by(F.struct(*axes), sum(F.col(a) * c for a, c in zip(axes, o)) if o else F.lit(0)) for o in (_BOX.tolist())]
    extreme = own.groupBy(group).agg(F.array_distinct(F.array(*corners)).alias("p"))
    chosen = settle(extreme.select(group, F.explode("p").alias("p")).select(group, "p.*"))

    def run(table: pa.Table) -> pa.Table:
        centre, radius = smallest_sphere(np.stack([table.column(a).to_numpy() for a in axes], 1))
        return pa.table([table.column(group).slice(0, 1), *(pa.array([float(c)]) for c in (*centre, radius))], [group, *axes, "radius"])

    while True:
        balls = settle(chosen.groupBy(group).applyInArrow(run, f"{group} {kind}, x double, y double, z double, radius double"))
        named = balls.select(group, *(F.col(a).alias(f"_{a}") for a in axes), "radius")
        apart = F.sqrt(sum((F.col(a) - F.col(f"_{a}")) * (F.col(a) - F.col(f"_{a}")) for a in axes))
        outside = own.join(named, group).withColumn("_d", apart).where(F.col("_d") > F.col("radius") + 1e-7 * F.greatest(F.lit(1.0), F.col("radius")))
        more = settle(outside.groupBy(group).agg(F.max_by(F.struct(*axes), F.struct("_d", *axes)).alias("p")).select(group, "p.*"))
        if not more.limit(1).count():
            return balls
        chosen = settle(chosen.unionByName(more).distinct())


def spheres_by_consensus(points: DataFrame, group: str, tolerance: float) -> DataFrame:
    """(group, x, y, z, radius, inliers, points) of each group's points (group, x, y, z); a group is one surface's points."""
    kind = points.schema[group].dataType.simpleString()
    axes = ("x", "y", "z")

    def run(table: pa.Table) -> pa.Table:
        p = np.stack([table.column(a).to_numpy() for a in axes], 1)
        p = p[np.lexsort(p.T[::-1])]
        centre, radius, near = sphere_by_consensus(p, tolerance)
        return pa.table([table.column(group).slice(0, 1), *(pa.array([float(c)]) for c in (*centre, radius)), pa.array([int(near.sum())]), pa.array([len(p)])], [group, *axes, "radius", "inliers", "points"])

    rows = points.select(group, *(F.col(a).cast("double") for a in axes))
    return rows.groupBy(group).applyInArrow(run, f"{group} {kind}, x double, y double, z double, radius double, inliers long, points long")


def gabor_bank(sigma: float, wavelength: float, psi: float, gamma: float, *, turns: int = 12) -> list[np.ndarray]:
    """Kernels of a Gaussian times a cosine wave, for directions over the half sphere."""
    reach = max(1, int(np.ceil(2 * sigma)))
    x = np.stack(np.meshgrid(*[np.arange(-reach, reach + 1)] * 3, indexing="ij"), -1)
    out = []
    for k in range(turns):
        z = (k + 0.5) / turns  # evenly spread directions of the upper half sphere
        a = k * np.pi * (3 - np.sqrt(5))
        u = np.array([np.sqrt(1 - z * z) * np.cos(a), np.sqrt(1 - z * z) * np.sin(a), z])
        along = x @ u
        across = (x**2).sum(-1) - along**2
        out.append(np.exp(-(along**2 + gamma**2 * across) / (2 * sigma**2)) * np.cos(2 * np.pi * along / wavelength + psi))
    return out


def gabor_responses(df: DataFrame, key: str, column: str, shape: Shape, bank: list[np.ndarray]) -> DataFrame:
    """(key, filter, response): mean absolute response of each volume to each kernel, edges periodic."""
    spectra = []
    for kernel in bank:
        whole = np.zeros(shape)
        r = kernel.shape[0] // 2
        for at in np.ndindex(kernel.shape):
            whole[tuple((np.array(at) - r) % shape)] += kernel[at]
        spectra.append(np.fft.fftn(whole))

    def run(v: np.ndarray) -> dict[str, np.ndarray]:
        f = np.fft.fftn(v, axes=(1, 2, 3))
        return {"_r": np.array([np.abs(np.fft.ifftn(f * s, axes=(1, 2, 3)).real).mean((1, 2, 3)) for s in spectra]).T}

    return map_volumes(df.select(key, column), [column], shape, run, ["_r"]).select(key, F.posexplode("_r").alias("filter", "response"))

