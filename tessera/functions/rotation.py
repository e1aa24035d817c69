"""Rotations of volumes: ZYZ angles, cubic-spline interpolation, paddings, and angle grids. numpy only."""

from __future__ import annotations

import numpy as np


def matrix(angle) -> np.ndarray:
    """Rotation by ZYZ Euler angles, transposed: rows are the axes of the turned frame."""
    from .volume import rotation_zyz

    return rotation_zyz(*angle)


def angles_of(rm: np.ndarray) -> np.ndarray:
    """ZYZ angles of a matrix; where theta is 0 or pi, psi is 0."""
    r = rm.T
    theta = np.arccos(np.clip(r[2, 2], -1, 1))
    if np.sin(theta) < 1e-9:
        return np.array([np.arctan2(r[1, 0] * np.sign(r[2, 2]), r[0, 0] * np.sign(r[2, 2])), theta, 0.0])
    return np.array([np.arctan2(r[1, 2], r[0, 2]), theta, np.arctan2(r[2, 1], -r[2, 0])])


def inverse(angle, loc) -> tuple[np.ndarray, np.ndarray]:
    """The pose that undoes turning by angle and then moving by loc."""
    rm = matrix(angle)
    return angles_of(rm.T), -rm @ np.asarray(loc, float)


def difference(a, b) -> float:
    """Frobenius distance of the turn from b to a from no turn."""
    return float(np.linalg.norm(np.eye(3) - matrix(a) @ matrix(b).T))


def distinct(angles, cutoff: float = 0.01, most: int | None = None) -> list:
    """Angles in their order, without those whose turn one before makes already (within the cutoff); the first `most`, if given."""
    kept: list = []
    held = np.empty((0, 3, 3))
    for a in angles:
        if len(kept) == most:
            break
        m = matrix(a)
        if (np.linalg.norm(np.eye(3) - m @ held.transpose(0, 2, 1), axis=(1, 2)) >= cutoff).all():
            kept.append(a)
            held = np.concatenate((held, m[None]))
    return kept


def angle_grid(step: float) -> list[tuple[float, float, float]]:
    """ZYZ angles step apart (radians), each turn once."""
    n, m = int(round(2 * np.pi / step)), int(round(np.pi / step))
    return distinct([(i * step, j * step, k * step) for j in range(m + 1) for i in range(n) for k in range(n)])


def spline_coefficients(v: np.ndarray) -> np.ndarray:
    """Cubic B-spline coefficients of volumes (rows, x, y, z), mirrored at their edges: a forward and a backward recursion
    along each axis."""
    z = np.sqrt(3.0) - 2
    c = v.astype(float)
    for axis in (1, 2, 3):
        c = np.moveaxis(c, axis, 0).copy()
        n = len(c)
        if n > 1:
            # the exact start of the recursion over the mirrored signal of period 2 n - 2
            k = np.arange(2 * n - 2)
            mirrored = np.where(k < n, k, 2 * n - 2 - k)
            c[0] = np.tensordot(z**k, c[mirrored], 1) / (1 - z ** (2 * n - 2))
            for i in range(1, n):
                c[i] += z * c[i - 1]
            c[-1] = z / (z * z - 1) * (c[-1] + z * c[-2])
            for i in range(n - 2, -1, -1):
                c[i] = z * (c[i + 1] - c[i])
            c *= 6
        c = np.moveaxis(c, 0, axis)
    return c


def _weights(t: np.ndarray) -> list[np.ndarray]:
    u, t2 = 1 - t, t * t
    t3 = t2 * t
    return [u * u * u / 6, (4 - 6 * t2 + 3 * t3) / 6, (1 + 3 * t + 3 * t2 - 3 * t3) / 6, t3 / 6]


def sample(v: np.ndarray, at: np.ndarray, *, order: int = 3, fill: np.ndarray | float = 0.0) -> np.ndarray:
    """Values (rows, points) of volumes (rows, x, y, z) at the same places (points, 3) of each; fill outside of them.

    order 0 is the nearest voxel's value, 1 linear, 3 a cubic spline whose coefficients v holds."""
    n = np.array(v.shape[1:])
    inside = ((at >= -1e-9) & (at <= n - 1 + 1e-9)).all(1)
    out = np.broadcast_to(np.reshape(fill, (-1, 1)), (len(v), len(at))).astype(float)
    p = np.clip(at[inside], 0, n - 1)
    flat = v.reshape(len(v), -1)
    place_of = lambda q: (q[:, 0] * n[1] + q[:, 1]) * n[2] + q[:, 2]
    if order == 0:
        out[:, inside] = flat[:, place_of(np.floor(p + 0.5).astype(int).clip(0, n - 1))]
        return out
    low = np.minimum(np.floor(p).astype(int), np.maximum(n - 2, 0))
    t = p - low
    offsets, weights = ((0, 1), [[1 - x, x] for x in t.T]) if order == 1 else ((-1, 0, 1, 2), [_weights(x) for x in t.T])
    period = np.maximum(2 * n - 2, 1)
    total = np.zeros((len(v), len(p)))
    for corner in np.ndindex(*(len(offsets),) * 3):
        w = weights[0][corner[0]] * weights[1][corner[1]] * weights[2][corner[2]]
        if not w.any():
            continue
        place = np.abs(low + [offsets[c] for c in corner]) % period
        total += w * flat[:, place_of(np.where(place >= n, period - place, place))]
    out[:, inside] = total
    return out


def sample_each(v: np.ndarray, at: np.ndarray, *, order: int = 3, fill: np.ndarray | float = 0.0) -> np.ndarray:
    """sample() where each volume has places of its own: at (rows, points, 3); order 1 or 3."""
    n = np.array(v.shape[1:])
    inside = ((at >= -1e-9) & (at <= n - 1 + 1e-9)).all(2)
    p = np.clip(at[inside], 0, n - 1)
    low = np.minimum(np.floor(p).astype(int), np.maximum(n - 2, 0))
    t = p - low
    offsets = (0, 1) if order == 1 else (-1, 0, 1, 2)
    weights, places = [], []
    for axis, (size, stride) in enumerate(zip(n, (n[1] * n[2], n[2], 1))):
        x = t[:, axis]
        weights.append([1 - x, x] if order == 1 else _weights(x))
        period = max(2 * size - 2, 1)
        own = [np.abs(low[:, axis] + o) % period for o in offsets]
        places.append([np.where(q >= size, period - q, q) * stride for q in own])
    flat, first = v.ravel(), np.nonzero(inside)[0] * int(n.prod())
    total = np.zeros(len(p))
    for i in range(len(offsets)):
        for j in range(len(offsets)):
            w, place = weights[0][i] * weights[1][j], first + places[0][i] + places[1][j]
            for k in range(len(offsets)):
                total += w * weights[2][k] * flat.take(place + places[2][k])
    out = np.broadcast_to(np.reshape(fill, (-1, 1)), inside.shape).astype(float)
    out[inside] = total
    return out


def _places(shape, angle, loc, centre, target) -> np.ndarray:
    at = (np.indices(shape).reshape(3, -1).T - target - np.asarray(loc, float)) @ matrix(angle) + centre
    return np.where(np.abs(at - np.rint(at)) < 1e-9, np.rint(at), at)


def _places_each(shape, matrices: np.ndarray, centre) -> np.ndarray:
    at = (np.indices(shape).reshape(3, -1).T - centre) @ matrices + centre
    return np.where(np.abs(at - np.rint(at)) < 1e-9, np.rint(at), at)


def rotate_each(coefficients: np.ndarray, matrices: np.ndarray, fill: np.ndarray) -> np.ndarray:
    """Volumes of the same shape, given by their spline coefficients (rows, x, y, z), each turned by its own matrix."""
    shape = coefficients.shape[1:]
    return sample_each(coefficients, _places_each(shape, matrices, (np.array(shape) - 1) / 2), fill=fill).reshape(coefficients.shape)


def rotate_masks_each(m: np.ndarray, matrices: np.ndarray) -> np.ndarray:
    """rotate_masks() where each mask has a matrix of its own."""
    shape = m.shape[1:]
    return np.clip(sample_each(m.astype(float), _places_each(shape, matrices, np.array(shape) // 2), order=1), 0, 1).reshape(m.shape)


def rotate_many(v: np.ndarray, angle, loc=(0.0, 0.0, 0.0), *, fill=None, coefficients: np.ndarray | None = None, order: int = 3, shape=None) -> np.ndarray:
    """Volumes (rows, x, y, z) turned about their centres (n - 1) / 2 by the same ZYZ angles and moved by loc.

    fill is a value or one a row (the volumes' means where it is None); coefficients are those of v, if they are there."""
    shape = v.shape[1:] if shape is None else shape
    fill = v.mean((1, 2, 3)) if fill is None else fill
    source = v if order < 3 else spline_coefficients(v) if coefficients is None else coefficients
    at = _places(shape, angle, loc, (np.array(v.shape[1:]) - 1) / 2, (np.array(shape) - 1) / 2)
    return sample(source, at, order=order, fill=fill).reshape(len(v), *shape)


def rotate(v: np.ndarray, angle, loc=(0.0, 0.0, 0.0), *, pad: str | float = "mean", order: int = 3, shape=None) -> np.ndarray:
    """One volume turned about its centre and moved by loc, into a volume of `shape` with the same centre.

    pad fills what comes from outside: "mean", "zero" or a value."""
    fill = {"mean": float(v.mean()), "zero": 0.0}[pad] if isinstance(pad, str) else float(pad)
    return rotate_many(v[None], angle, loc, fill=fill, order=order, shape=shape)[0]


def rotate_masks(m: np.ndarray, angle) -> np.ndarray:
    """Masks (rows, x, y, z) over centred frequencies turned about floor(n / 2); 0 outside."""
    c = np.array(m.shape[1:]) // 2
    return np.clip(sample(m.astype(float), _places(m.shape[1:], angle, (0, 0, 0), c, c), order=1), 0, 1).reshape(m.shape)


def rotate_mask(m: np.ndarray, angle) -> np.ndarray:
    return rotate_masks(m[None], angle)[0]
