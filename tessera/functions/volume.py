"""numpy kernels on dense volumes, and their use on ARRAY<FLOAT> columns by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def rotation_zyz(phi: float, theta: float, psi: float) -> np.ndarray:
    """(Rz(phi) Ry(theta) Rz(psi)) transposed."""

    def z(a):
        return np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])

    y = np.array([[np.cos(theta), 0, np.sin(theta)], [0, 1, 0], [-np.sin(theta), 0, np.cos(theta)]])
    return (z(phi) @ y @ z(psi)).T


def rotate(v: np.ndarray, rm: np.ndarray, loc=(0.0, 0.0, 0.0)) -> np.ndarray:
    """v rotated about (n - 1) / 2 and then moved by loc, trilinear; what comes from outside is v's mean."""
    n = np.array(v.shape)
    c = (n - 1) / 2
    at = (np.indices(v.shape).reshape(3, -1).T - c - np.asarray(loc)) @ rm + c
    low = np.floor(at + 1e-9).astype(int)
    part = at - low
    out = np.zeros(len(at))
    inside = np.ones(len(at), bool)
    for corner in np.ndindex(2, 2, 2):
        w = np.prod(np.where(np.array(corner) == 1, part, 1 - part), axis=1)
        place = low + corner
        ok = ((place >= 0) & (place < n)).all(1)
        inside &= ok | (np.abs(w) < 1e-9)
        out += w * v[tuple(np.clip(place, 0, n - 1).T)]
    return np.where(inside, out, v.mean()).reshape(v.shape)


def radius(shape) -> np.ndarray:
    """Distance from the FFT centre floor(n / 2)."""
    return np.sqrt(sum((i - n // 2) ** 2 for i, n in zip(np.indices(shape), shape)))


def band_pass(v: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """v with each frequency scaled by the curve at its rounded radius, 0 beyond the curve."""
    r = np.rint(radius(v.shape)).astype(int)
    gain = np.where(r < len(curve), np.asarray(curve)[np.minimum(r, len(curve) - 1)], 0)
    return np.fft.ifftn(np.fft.ifftshift(np.fft.fftshift(np.fft.fftn(v)) * gain)).real


def shell_correlation(a: np.ndarray, b: np.ndarray, width: float = 1.0) -> np.ndarray:
    """Fourier shell correlation for radii 0 to n / 2; shells overlap: |radius - r| <= width."""
    fa, fb = (np.fft.fftshift(np.fft.fftn(x)) for x in (a, b))
    r = radius(a.shape)
    out = []
    for k in range(min(a.shape) // 2):
        m = np.abs(r - k) <= width
        out.append((fa[m] * fb[m].conj()).real.sum() / max(np.sqrt((abs(fa[m]) ** 2).sum() * (abs(fb[m]) ** 2).sum()), 1e-300))
    return np.array(out)


def map_volumes(df: DataFrame, column: str, shape: tuple[int, int, int], kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """df with the volumes in `column` (C order) replaced by kernel's; other columns pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(column)
            new = [None if x is None else kernel(np.array(x, float).reshape(shape)).ravel().tolist() for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(new, batch.schema.field(i).type) if i == at else batch.column(i) for i in range(batch.num_columns)], batch.schema.names)

    return df.mapInArrow(run, df.schema)
