"""Correlation of two volumes over all turns at once, by spherical harmonics and one Fourier sum. numpy only.

A turn R_z(xi) R_y(pi/2) R_z(eta) R_y(pi/2) R_z(omega) has fixed matrices in the middle, so that the correlation of two
functions on spheres is a trigonometric sum over its three angles: all of them come from one inverse transform.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from . import harmonics as H
from . import rotation as K


@lru_cache(maxsize=8)
def _basis(most: int) -> tuple[np.ndarray, np.ndarray]:
    """(directions of the grid, matrix that turns values there into coefficients, (l, m) by rows)."""
    theta, weights, phi = H.angles(most)
    t, f = (a.ravel() for a in np.meshgrid(theta, phi, indexing="ij"))
    places = np.stack((np.sin(t) * np.cos(f), np.sin(t) * np.sin(f), np.cos(t)), 1)
    area = np.repeat(weights, len(phi)) * 2 * np.pi / len(phi)
    p = H.associated(np.cos(t), most)
    rows = [area * p[n, abs(m)] * ((-1) ** m if m < 0 else 1) * np.exp(-1j * m * f) for n in range(most + 1) for m in range(-n, n + 1)]
    return places, np.array(rows)


@lru_cache(maxsize=8)
def _middle(most: int) -> list[np.ndarray]:
    return [H.wigner_d(n, np.pi / 2) for n in range(most + 1)]


def shells(v: np.ndarray, centre, radii: np.ndarray, most: int) -> np.ndarray:
    """Coefficients (rows, shells, (l, m)) of volumes (rows, x, y, z) on spheres about the centre; 0 outside of the volumes."""
    places, basis = _basis(most)
    at = (radii[:, None, None] * places + np.asarray(centre, float)).reshape(-1, 3)
    return K.sample(v, at, order=1, fill=0.0).reshape(len(v), len(radii), -1) @ basis.T


def correlations(a: np.ndarray, b: np.ndarray, radii: np.ndarray, most: int) -> np.ndarray:
    """Cubes (rows, N, N, N), N = 2 most + 2, of the correlation of a with b under the turn of each three angles 2 pi i / N.

    a, b: coefficients of shells(). The integral over the radii takes r^2 and the trapezoid rule."""
    step = np.convolve(np.diff(radii), [0.5, 0.5]) if len(radii) > 1 else np.ones(1)
    weight = radii**2 * step
    n = 2 * most + 2
    sums = np.zeros((max(len(a), len(b)), n, n, n), complex)
    first = 0
    for degree, w in enumerate(_middle(most)):
        own = slice(first, first + 2 * degree + 1)
        inner = np.einsum("rsm,rsn,s->rmn", a[:, :, own], b[:, :, own].conj(), weight)
        m = np.arange(-degree, degree + 1) % n
        sums[:, m[:, None, None], m[None, :, None], m[None, None, :]] += w[None, :, :, None] * w[None, None, :, :] * inner[:, :, None, :]
        first += 2 * degree + 1
    return np.fft.ifftn(sums, axes=(1, 2, 3)).real * n**3


def constrained(v1: np.ndarray, m1: np.ndarray, v2: np.ndarray, m2: np.ndarray, most: int) -> np.ndarray:
    """Cubes of scores of all turns of volumes v2 (rows, x, y, z) against v1, each alike or one volume: the spectra's absolute
    values without the means, under both masks (centred), correlated and divided by their norms under the other's turned mask. The angles are those that turn v2 in rotation.rotate."""
    axes = (1, 2, 3)
    centre = np.array(v1.shape[1:]) // 2
    radii = np.arange(1.0, max(2, min(v1.shape[1:]) // 2))

    def expanded(v: np.ndarray, m: np.ndarray) -> list[np.ndarray]:
        f = np.fft.fftn(v, axes=axes)
        f[:, 0, 0, 0] = 0
        size = np.fft.fftshift(np.abs(f), axes=axes)
        return [shells(u, centre, radii, most) for u in (size * m, size * size * m, m)]

    (x, xx, mx), (y, yy, my) = expanded(v1, m1), expanded(v2, m2)
    over = correlations(my, xx, radii, most), correlations(yy, mx, radii, most)
    under = np.maximum(over[0], 0) * np.maximum(over[1], 0)
    floor = 1e-12 * under.max((1, 2, 3), keepdims=True)
    return np.where(under > floor, correlations(y, x, radii, most) / np.sqrt(np.maximum(under, 1e-300)), 0.0)
