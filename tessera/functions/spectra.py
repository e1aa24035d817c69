"""Fourier operators on array columns that hold volumes in C order, by Arrow batches without Python lists.

Spectra are uncentred, as np.fft.fftn has them: place k of an axis of n stands for the frequency k, or k - n from n / 2 on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

Shape = tuple[int, int, int]


def usable(column: str, size: int) -> Column:
    """The array is there, has the size and no null in it."""
    return F.col(column).isNotNull() & (F.size(column) == size) & ~F.exists(column, lambda x: x.isNull())


def map_volumes(df: DataFrame, columns: list[str], shape: Shape, kernel: Callable[..., dict[str, np.ndarray]], outputs: list[str]) -> DataFrame:
    """df with output arrays: kernel gets each column's volumes (rows, *shape) and gives (rows, ...) by output.

    Rows whose volumes are null, of another size or hold null are left out.
    """
    size = int(np.prod(shape))
    ok = usable(columns[0], size)
    for c in columns[1:]:
        ok = ok & usable(c, size)
    rest = [c for c in df.columns if c not in outputs]
    schema = df.select(*rest).schema
    for o in outputs:
        schema = schema.add(o, ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            names = batch.schema.names
            cubes = [batch.column(names.index(c)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, *shape) for c in columns]
            made = kernel(*cubes)
            arrays = []
            for o in outputs:
                v = np.ascontiguousarray(made[o].reshape(len(batch), -1), float)
                ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * v.shape[1])
                arrays.append(pa.ListArray.from_arrays(ends, pa.array(v.ravel())))
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in rest), *arrays], [*rest, *outputs])

    return df.where(ok).select(*rest).mapInArrow(run, schema)


_AXES = (1, 2, 3)


def _fft(v: np.ndarray) -> np.ndarray:
    return np.fft.fftn(v, axes=_AXES)


def _real(f: np.ndarray) -> np.ndarray:
    return np.fft.ifftn(f, axes=_AXES).real


def frequencies(shape: Shape) -> list[np.ndarray]:
    """Signed frequencies of every place of an uncentred spectrum, by axis."""
    return [np.where(i < -(-n // 2), i, i - n) for i, n in zip(np.indices(shape), shape)]


def radii(shape: Shape) -> np.ndarray:
    return np.sqrt(sum(f**2 for f in frequencies(shape)))


def spectrum(df: DataFrame, column: str, shape: Shape) -> DataFrame:
    """df with re and im."""

    def kernel(v):
        f = _fft(v)
        return {"re": f.real, "im": f.imag}

    return map_volumes(df, [column], shape, kernel, ["re", "im"])


def filtered(df: DataFrame, column: str, shape: Shape, gain: np.ndarray, out: str) -> DataFrame:
    """df with the volume whose spectrum is multiplied by gain (an uncentred grid)."""
    return map_volumes(df, [column], shape, lambda v: {out: _real(_fft(v) * gain)}, [out])


def band_gain(shape: Shape, low: float, high: float, smooth: float | None = None) -> np.ndarray:
    """Gain of a band-pass: 1 where the squared radius lies in [low, high], or between balls of radius low and high whose
    edges fall off as a Gaussian of smooth."""
    r = radii(shape)
    if smooth is None:
        return ((r**2 <= high) & (r**2 >= low)).astype(float)
    ball = lambda radius: np.where(r <= radius, 1.0, np.exp(-(((r - radius) / smooth) ** 2)))
    return ball(high) - (ball(low) if low > 0 else 0)


def correlated(df: DataFrame, column: str, template: str, shape: Shape, out: str, *, pearson: bool = False) -> DataFrame:
    """df with the circular correlation of column with template, whose centre is at floor(n / 2); pearson: over the
    size and both standard deviations."""

    def kernel(v, t):
        c = _real(_fft(v) * np.conj(_fft(np.fft.ifftshift(t, axes=_AXES))))
        if pearson:
            c /= v[0].size * (v.std(axis=_AXES) * t.std(axis=_AXES))[:, None, None, None]
        return {out: c}

    return map_volumes(df, [column, template], shape, kernel, [out])


def shell_correlations(df: DataFrame, a: str, b: str, shape: Shape, out: str, *, width: float = 1.0) -> DataFrame:
    """df with the Fourier shell correlation of two columns at radii 0, 1, ... below n / 2; shells overlap."""
    r = radii(shape).ravel()
    masks = np.array([np.abs(r - k) <= width for k in range(min(shape) // 2)], float).T

    def kernel(v, w):
        f, g = _fft(v).reshape(len(v), -1), _fft(w).reshape(len(w), -1)
        power = lambda x: (np.abs(x) ** 2) @ masks
        return {out: (f * g.conj()).real @ masks / np.sqrt(power(f) * power(g))}

    return map_volumes(df, [a, b], shape, kernel, [out])


def imputed(df: DataFrame, column: str, template: str, mask: np.ndarray, shape: Shape, out: str) -> DataFrame:
    """df with the volume whose spectrum outside the mask (an uncentred grid) is the template's."""
    return map_volumes(df, [column, template], shape, lambda v, t: {out: _real(np.where(mask > 0, _fft(v), _fft(t)))}, [out])


def spectral_sums(df: DataFrame, groups: list[str], column: str, shape: Shape, *, mask: str | None = None) -> DataFrame:
    """(groups..., pos, n, re, im, sq): sums of the mask, of the masked spectra and of their squares at every place."""
    f = spectrum(df, column, shape)
    weight = F.col(mask) if mask else F.array_repeat(F.lit(1.0), int(np.prod(shape)))
    at = f.select(*groups, F.posexplode(F.arrays_zip("re", "im", weight.alias("m"))).alias("pos", "s")).select(*groups, "pos", "s.*")
    re, im, m = F.col("re"), F.col("im"), F.col("m")
    return at.groupBy(*groups, "pos").agg(F.sum("m").alias("n"), F.sum(re * m).alias("re"), F.sum(im * m).alias("im"), F.sum((re * re + im * im) * m).alias("sq"))


def radius_of(pos: Column, shape: Shape) -> Column:
    parts = [F.floor(pos / (shape[1] * shape[2])), F.floor(pos / shape[2]) % shape[1], pos % shape[2]]
    return F.sqrt(sum(F.pow(F.when(p < -(-n // 2), p).otherwise(p - n), F.lit(2.0)) for p, n in zip(parts, shape)))


def shell_snr(sums: DataFrame, groups: list[str], shape: Shape, *, method: int = 0, width: float = 1.0, least: float = 2.0) -> DataFrame:
    """(groups..., r, ssnr, fsc) of spectral_sums' rows: four ways to weigh a shell's signal against its variance.

    0: |mean|^2 over variance of the mean; 1: weighted by the masks; 2: by the greatest mask; 3: one mean a shell.
    Places with a mask below `least` don't count; a shell without variance has 0; fsc = s / (2 + s).
    """
    n = F.col("n")
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (n * n)
    most = sums.groupBy(*groups).agg(F.max("n").alias("most"))
    at = sums.where(n >= least).withColumn("a", power).withColumn("v", (F.col("sq") - n * F.col("a")) / (n - 1)).withColumn("rad", radius_of(F.col("pos"), shape))
    at = at.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(min(shape) // 2)))).where(F.abs(F.col("rad") - F.col("r")) <= width)
    total = at.groupBy(*groups, "r").agg(*[F.sum(e).alias(c) for c, e in (("a", F.col("a")), ("v", F.col("v")), ("vn", F.col("v") / n), ("na", n * F.col("a")), ("n", n), ("re", F.col("re")), ("im", F.col("im")), ("sq", F.col("sq")))])
    total = total.join(most, groups)
    whole = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("n") * F.col("n"))
    spread = (F.col("sq") - F.col("n") * whole) / (F.col("n") - 1)
    s = [
        F.when(F.col("v") > 0, F.col("a") / F.col("vn")).otherwise(0.0),
        F.when(F.col("v") > 0, F.col("na") / F.col("v")).otherwise(0.0),
        F.when(F.col("v") > 0, F.col("most") * F.col("a") / F.col("v")).otherwise(0.0),
        F.when(spread > 0, F.col("most") * whole / spread).otherwise(0.0),
    ][method]
    return total.select(*groups, "r", s.alias("ssnr")).withColumn("fsc", F.col("ssnr") / (2 + F.col("ssnr")))


def prefix_sums(df: DataFrame, group: str, order: list[Column], column: str, shape: Shape) -> DataFrame:
    """(group, len, pos, n, re, im, sq): spectral sums of the first len rows of each group, for every len."""
    ranked = df.withColumn("len", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    f = spectrum(ranked.select(group, "len", column), column, shape)
    at = f.select(group, "len", F.posexplode(F.arrays_zip("re", "im")).alias("pos", "s")).select(group, "len", "pos", "s.re", "s.im")
    run = Window.partitionBy(group, "pos").orderBy("len")
    square = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    sums = {"n": F.col("len").cast("double"), "re": F.sum("re").over(run), "im": F.sum("im").over(run), "sq": F.sum(square).over(run)}
    return at.select(group, "len", "pos", *(c.alias(name) for name, c in sums.items()))


def without_each(df: DataFrame, group: str, key: str, column: str, shape: Shape) -> DataFrame:
    """(group, key, pos, n, re, im, sq): the group's sums less one row's own, for each row: a set's sums take rows in and out."""
    sums = spectral_sums(df, [group], column, shape).withColumnsRenamed({c: f"all_{c}" for c in ("n", "re", "im", "sq")})
    f = spectrum(df.select(group, key, column), column, shape)
    at = f.select(group, key, F.posexplode(F.arrays_zip("re", "im")).alias("pos", "s")).select(group, key, "pos", "s.re", "s.im")
    own = at.withColumn("sq", F.col("re") * F.col("re") + F.col("im") * F.col("im")).withColumn("n", F.lit(1.0))
    return own.join(sums, [group, "pos"]).select(group, key, "pos", *((F.col(f"all_{c}") - F.col(c)).alias(c) for c in ("n", "re", "im", "sq")))


def masked_average(sums: DataFrame, groups: list[str], shape: Shape, *, least: float = 1.0) -> DataFrame:
    """(groups..., average): the volume whose spectrum is sum over mask where the mask reaches `least`, else 0."""
    size = int(np.prod(shape))
    at = sums.select(*groups, F.struct("pos", *(F.when(F.col("n") >= least, F.col(c) / F.col("n")).otherwise(0.0).alias(c) for c in ("re", "im"))).alias("s"))
    rows = at.groupBy(*groups).agg(F.array_sort(F.collect_list("s")).alias("s"))  # one row a place of the spectrum
    rows = rows.select(*groups, F.transform("s", lambda x: x["re"]).alias("re"), F.transform("s", lambda x: x["im"]).alias("im")).where(F.size("re") == size)
    return map_volumes(rows, ["re", "im"], shape, lambda a, b: {"average": _real(a + 1j * b)}, ["average"]).drop("re", "im")
