"""Legendre functions, spherical harmonic transforms on a grid of angles, and small rotation matrices. numpy only."""

from __future__ import annotations

from math import factorial

import numpy as np


def legendre(x: np.ndarray, most: int) -> np.ndarray:
    """P_l(x) for l = 0 .. most, one row a degree, by the three-term recurrence."""
    x = np.asarray(x, float)
    out = [np.ones_like(x), x]
    for n in range(1, most):
        out.append(((2 * n + 1) * x * out[n] - n * out[n - 1]) / (n + 1))
    return np.array(out[: most + 1])


def associated(x: np.ndarray, most: int) -> dict[tuple[int, int], np.ndarray]:
    """Normalised associated Legendre functions (l, m >= 0): their squares integrate to 1 / (2 pi) over x."""
    x = np.asarray(x, float)
    s = np.sqrt(np.maximum(1 - x * x, 0))
    out = {(0, 0): np.full(x.shape, np.sqrt(1 / (4 * np.pi)))}
    for m in range(most + 1):
        if m:
            out[m, m] = -np.sqrt((2 * m + 1) / (2 * m)) * s * out[m - 1, m - 1]
        if m < most:
            out[m + 1, m] = np.sqrt(2 * m + 3) * x * out[m, m]
        for n in range(m + 2, most + 1):
            a = np.sqrt((4 * n * n - 1) / (n * n - m * m))
            b = np.sqrt(((n - 1) ** 2 - m * m) / (4 * (n - 1) ** 2 - 1))
            out[n, m] = a * (x * out[n - 1, m] - b * out[n - 2, m])
    return out


def angles(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(polar angles, their weights, azimuths) of a grid on which transforms up to degree `most` are exact."""
    nodes, weights = np.polynomial.legendre.leggauss(most + 1)
    return np.arccos(nodes), weights, 2 * np.pi * np.arange(2 * most + 2) / (2 * most + 2)


def forward(f: np.ndarray, most: int) -> dict[tuple[int, int], complex]:
    """Coefficients (l, m) of a function on the grid of angles(most), (polar, azimuth)."""
    theta, weights, phi = angles(most)
    p = associated(np.cos(theta), most)
    rows = np.fft.fft(f, axis=1) * (2 * np.pi / len(phi))  # by m
    out = {}
    for n in range(most + 1):
        for m in range(-n, n + 1):
            own = p[n, abs(m)] * ((-1) ** m if m < 0 else 1)
            out[n, m] = complex((weights * own * rows[:, m % len(phi)]).sum())
    return out


def reverse(a: dict[tuple[int, int], complex], most: int) -> np.ndarray:
    """The function on the grid of angles(most) that coefficients stand for."""
    theta, _, phi = angles(most)
    p = associated(np.cos(theta), most)
    out = np.zeros((len(theta), len(phi)), complex)
    for (n, m), c in a.items():
        own = p[n, abs(m)] * ((-1) ** m if m < 0 else 1)
        out += c * own[:, None] * np.exp(1j * m * phi)
    return out


def wigner_d(degree: int, beta: float) -> np.ndarray:
    """The real matrix of a turn by beta about y on the harmonics of one degree; rows and columns are m = -l .. l."""
    c, s = np.cos(beta / 2), np.sin(beta / 2)
    out = np.zeros((2 * degree + 1, 2 * degree + 1))
    for i, a in enumerate(range(-degree, degree + 1)):
        for j, b in enumerate(range(-degree, degree + 1)):
            size = np.sqrt(float(factorial(degree + a) * factorial(degree - a) * factorial(degree + b) * factorial(degree - b)))
            for k in range(max(0, b - a), min(degree + b, degree - a) + 1):
                under = factorial(degree + b - k) * factorial(k) * factorial(a - b + k) * factorial(degree - a - k)
                out[i, j] += (-1) ** (a - b + k) * size / under * c ** (2 * degree + b - a - 2 * k) * s ** (a - b + 2 * k)
    return out


def rotational_correlation(a: list[dict], b: list[dict], radii: np.ndarray, most: int, angles_zyz) -> np.ndarray:
    """Correlation of two shells of functions under each turn of the second: sums over degrees of a * conj(D b), weighted by
    r^2 and the trapezoid rule over the radii. a, b: coefficients by shell."""
    step = np.gradient(radii) if len(radii) > 1 else np.ones(1)
    if len(radii) > 1:
        step = np.convolve(np.diff(radii), [0.5, 0.5])
    inner = {n: np.zeros((2 * n + 1, 2 * n + 1), complex) for n in range(most + 1)}
    for r, w, x, y in zip(radii, step, a, b):
        for n in inner:
            u, v = (np.array([c.get((n, m), 0) for m in range(-n, n + 1)]) for c in (x, y))
            inner[n] += r * r * w * np.outer(u, v.conj())
    out = []
    for alpha, beta, gamma in angles_zyz:
        total = 0.0
        for n, i in inner.items():
            m = np.arange(-n, n + 1)
            d = np.exp(-1j * m * alpha)[:, None] * wigner_d(n, beta) * np.exp(-1j * m * gamma)
            total += (i * d.conj()).sum().real
        out.append(total)
    return np.array(out)
