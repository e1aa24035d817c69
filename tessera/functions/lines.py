"""Kernels along the first axis of arrays: distances to marked places and implicit smoothing. numpy only."""

from __future__ import annotations

import numpy as np


def nearest_squares(f: np.ndarray) -> np.ndarray:
    """min over j of f[j] + (i - j)^2 for every i: one axis of a squared distance transform.

    Shifts end where their square alone exceeds all that is found."""
    out = f.copy()
    n = len(f)
    for s in range(1, n):
        if s * s > out.max():
            break
        np.minimum(out[s:], f[:-s] + s * s, out=out[s:])
        np.minimum(out[:-s], f[s:] + s * s, out=out[:-s])
    return out


def implicit_step(d: np.ndarray, t: float) -> np.ndarray:
    """u with u - t * (second difference of u) = d and mirrored ends: a tridiagonal solve of every line at once."""
    n = len(d)
    if n == 1 or t == 0:
        return d.copy()
    # forward elimination, then substitution from the end; the matrix has -t beside its diagonal
    upper = np.empty(n)
    out = np.empty_like(d, dtype=float)
    diagonal = 1 + t
    upper[0], out[0] = -t / diagonal, d[0] / diagonal
    for i in range(1, n):
        diagonal = 1 + (t if i == n - 1 else 2 * t) + t * upper[i - 1]
        upper[i] = -t / diagonal
        out[i] = (d[i] + t * out[i - 1]) / diagonal
    for i in range(n - 2, -1, -1):
        out[i] -= upper[i] * out[i + 1]
    return out


def local_polynomial(width: int, degree: int = 3, derivative: int = 0) -> np.ndarray:
    """Weights of width // 2 neighbours to each side: their least-squares polynomial's value, or derivative, in the middle.

    The derivative is that of the polynomial's coefficient: the first one is the slope, the second half of the curvature."""
    half = width // 2
    if not 0 <= derivative <= degree or 2 * half < degree:
        raise ValueError(f"{2 * half + 1} places do not fix the derivative {derivative} of a polynomial of degree {degree}")
    x = np.arange(-half, half + 1, dtype=float)[:, None] ** np.arange(degree + 1)
    return np.linalg.pinv(x)[derivative]


def smooth_rows(v: np.ndarray, width: int, degree: int = 3, derivative: int = 0) -> np.ndarray:
    """Rows filtered by local polynomials; beyond a row's ends there is 0."""
    c = local_polynomial(width, degree, derivative)
    half = len(c) // 2
    padded = np.pad(v, [(0, 0)] * (v.ndim - 1) + [(half, half)])
    return sum(w * padded[..., i : i + v.shape[-1]] for i, w in enumerate(c))
