"""Image formation, periodic stencils in DataFrame operations, nearest prototypes and cluster distortion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import statistics as S
from . import voxel as V

#: Prototypes that one broadcast row may hold; more are dealt out in blocks.
MOST_PROTOTYPES = 4096


def grid(spark, shape: V.Shape) -> DataFrame:
    """(x, y, z) of every voxel."""
    i = F.col("id")
    return spark.range(int(np.prod(shape))).select(F.floor(i / (shape[1] * shape[2])).cast("int").alias("x"), (F.floor(i / shape[2]) % shape[1]).cast("int").alias("y"), (i % shape[2]).cast("int").alias("z"))


def contrast_transfer(spark, shape: V.Shape, defocus_um: float, *, pixel_nm: float = 0.72, voltage_kv: float = 300.0, cs_mm: float = 2.0, sigma: float | None = None) -> DataFrame:
    """(x, y, z, ctf, amplitude): the transfer function over frequencies, 0 at the middle of the grid, with a Gaussian envelope of sigma Nyquist.

    The wavelength is that of relativistic electrons; a negative defocus is underfocus.
    """
    volts = voltage_kv * 1e3
    wave = float(np.sqrt(150.4 / (volts * (1 + volts / 1022000.0)))) * 1e-10
    nyquist = 1 / (2e-9 * pixel_nm)
    g = grid(spark, shape)
    r2 = sum(F.pow(F.col(a) * (nyquist / (n / 2)) - nyquist, 2) for a, n in zip(V.AXES, shape))
    phase = (np.pi / 2) * (cs_mm * 1e-3 * wave**3 * F.col("_r2") * F.col("_r2") - 2e-6 * defocus_um * wave * F.col("_r2"))
    envelope = F.exp(-F.col("_r2") / (sigma * nyquist) ** 2) if sigma is not None else F.lit(1.0)
    return g.withColumn("_r2", r2).select("x", "y", "z", (F.sin(phase) * envelope).alias("ctf"), (F.cos(phase) * envelope).alias("amplitude"))


def periodic_sums(voxels: DataFrame, shape: V.Shape, offsets: list[V.Shape], sums: dict[str, tuple[Column, list[float]]]) -> DataFrame:
    """(vol_id, x, y, z, sums...): at each voxel, per sum, its column over the voxels at the offsets times the weights, the volume wrapping around.

    Voxels that no row reaches sum to 0 and are left out. Each row goes to one place an offset and is combined
    before the shuffle: for templates of a few voxels. Wider kernels go through voxel.stencil().
    """
    names = list(sums)
    arms = F.array(*[F.struct(*[F.lit(int(c)).alias(f"d{a}") for a, c in zip(V.AXES, o)], *[F.lit(float(sums[n][1][k])).alias(f"w_{n}") for n in names]) for k, o in enumerate(offsets)])
    sent = voxels.select("vol_id", *V.AXES, *[c.alias(f"v_{n}") for n, (c, _) in sums.items()]).withColumn("_o", F.explode(arms))
    at = sent.select("vol_id", *[F.pmod(F.col(a) - F.col(f"_o.d{a}"), F.lit(n)).cast("int").alias(a) for a, n in zip(V.AXES, shape)], *[(F.col(f"v_{n}") * F.col(f"_o.w_{n}")).alias(n) for n in names])
    return at.groupBy("vol_id", *V.AXES).agg(*[F.sum(n).alias(n) for n in names])


def masked_correlation(voxels: DataFrame, shape: V.Shape, template: dict[V.Shape, float]) -> DataFrame:
    """(vol_id, x, y, z, cor): the template, standardised over its own voxels, against the volume standardised by
    the mean and deviation of the voxels under the template at each place. Places without a row have 0."""
    offsets = list(template)
    weights = np.array([template[o] for o in offsets], float)
    if weights.std() == 0:
        raise ValueError("a constant template has no correlation")
    weights = (weights - weights.mean()) / weights.std()
    ones = [1.0 / len(offsets)] * len(offsets)
    v = F.col("val").cast("double")
    local = periodic_sums(voxels, shape, offsets, {"m": (v, ones), "s": (v * v, ones)})
    spread = F.greatest(F.col("s") - F.col("m") * F.col("m"), F.lit(0.0))
    centred = F.coalesce("val", F.lit(0.0)) - F.col("m")
    # a voxel that no arm reaches keeps its value: its own mean and deviation are 0
    full = local.join(voxels.select("vol_id", *V.AXES, v.alias("val")), ["vol_id", *V.AXES], "full").fillna(0.0, ["m", "s"])
    scaled = full.select("vol_id", *V.AXES, F.when(spread > 0, centred / F.sqrt(spread)).otherwise(centred).alias("val"))
    return periodic_sums(scaled, shape, offsets, {"cor": (F.col("val"), weights.tolist())})


def neighbour_products(voxels: DataFrame, shape: V.Shape) -> DataFrame:
    """(vol_id, x, y, z, dx, dy, dz, product): each voxel times each of its 26 neighbours, the volume wrapping around; products of 0 are left out."""
    own = voxels.where("val <> 0").select("vol_id", *V.AXES, "val")
    arms = F.array(*[F.struct(*[F.lit(c - 1).alias(f"d{a}") for a, c in zip(V.AXES, o)]) for o in np.ndindex(3, 3, 3) if o != (1, 1, 1)])
    sent = own.withColumn("_o", F.explode(arms)).select("vol_id", *[F.pmod(F.col(a) + F.col(f"_o.d{a}"), F.lit(n)).cast("int").alias(a) for a, n in zip(V.AXES, shape)], F.col("val").alias("_v"), "_o.*")
    return sent.join(own, ["vol_id", *V.AXES]).select("vol_id", *V.AXES, "dx", "dy", "dz", (F.col("val") * F.col("_v")).alias("product"))


def surface_strength(voxels: DataFrame, shape: V.Shape) -> DataFrame:
    """(vol_id, x, y, z, strength): (|e0| - sqrt|e1 e2|)**2 where the greatest eigenvalue by size, e0, is negative; else 0."""
    h = V.hessian(voxels, shape)
    e = V.eigenvalues(*(F.col(c) for c in ("xx", "yy", "zz", "xy", "xz", "yz")))
    at = h.select("vol_id", *V.AXES, V.by_magnitude(e).alias("_e"))
    strength = F.pow(F.abs(F.col("_e")[0]) - F.sqrt(F.abs(F.col("_e")[1] * F.col("_e")[2])), 2)
    return at.select("vol_id", *V.AXES, F.when(F.col("_e")[0] < 0, strength).otherwise(0.0).alias("strength"))


def prototypes(df: DataFrame, label: str, column: str, size: int) -> DataFrame:
    """(label, centre): the mean of each class's arrays."""
    m = S.moments(df, label, column, size)
    return m.select(label, F.transform("sums", lambda s: s / F.col("n")).alias("centre"))


def nearest_prototype(queries: DataFrame, protos: DataFrame, key: str, label: str, column: str, *, most: int = MOST_PROTOTYPES) -> DataFrame:
    """(key, label, distance): the nearest prototype by squared distance, ties to the smaller label. key is unique.

    Up to `most` prototypes travel as one broadcast row; more are dealt to blocks, which each query meets in turn.
    """
    blocks = max(1, -(-2 * protos.count() // most) if protos.count() > most else 1)
    # collect_list holds one block of prototypes
    rows = protos.groupBy(F.pmod(F.xxhash64(label), F.lit(blocks)).cast("int").alias("_b")).agg(F.collect_list(F.struct(F.col(label).alias("label"), "centre")).alias("_p"))
    own = queries.where(F.col(column).isNotNull()).select(key, F.col(column).alias("_v"))
    near = F.array_min(F.transform("_p", lambda p: F.struct(F.aggregate(F.zip_with("_v", p["centre"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d).alias("distance"), p["label"].alias("label"))))
    if blocks == 1:
        best = own.join(F.broadcast(rows), F.lit(True)).select(key, near.alias("_n"))
    else:
        best = own.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(rows, "_b").select(key, near.alias("_n")).groupBy(key).agg(F.min("_n").alias("_n"))
    return best.select(key, F.col("_n.label").alias(label), F.col("_n.distance").alias("distance"))


def bounding_spheres(points: DataFrame, group: str) -> DataFrame:
    """(group, n, cx, cy, cz, radius): centre of mass and the farthest point's distance."""
    centres = points.groupBy(group).agg(F.count("*").alias("n"), *[F.avg(a).alias(f"c{a}") for a in V.AXES])
    far = F.sqrt(sum(F.pow(F.col(a) - F.col(f"c{a}"), 2) for a in V.AXES))
    return points.join(centres, group).groupBy(group, "n", *[f"c{a}" for a in V.AXES]).agg(F.max(far).alias("radius"))


def merged_tiles(voxels: DataFrame, shape: V.Shape, step: int, overlap: int, score: Column) -> DataFrame:
    """(vol_id, x, y, z, score): scores of every tile that holds a voxel, summed; score may use i0, i1, i2."""
    at = voxels.select("vol_id", *V.AXES, "val")
    for k, (a, n) in enumerate(zip(V.AXES, shape)):
        count = max(1, -(-(n - overlap) // step))
        first = F.greatest(F.floor((F.col(a) - step - overlap) / step) + 1, F.lit(0)).cast("int")
        last = F.least(F.floor(F.col(a) / step), F.lit(count - 1)).cast("int")
        at = at.withColumn(f"i{k}", F.explode(F.sequence(first, last)))
    return at.groupBy("vol_id", *V.AXES).agg(F.sum(score).alias("score"))


def angle_between(a: Column, b: Column) -> Column:
    """Radians between two arrays; null where one of them has no length."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    cosine = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(cosine.isNotNull(), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def ransac_trials(inliers: Column, samples: Column, least: int, probability: float) -> Column:
    """Trials that draw `least` inliers alone at least once with the probability; null where no number is enough."""
    tiny = float(np.finfo(float).eps)
    missed = F.greatest(F.lit(tiny), 1 - F.pow(inliers / samples, F.lit(float(least))))
    return F.when((inliers > 0) & (missed < 1), F.ceil(float(np.log(max(tiny, 1 - probability))) / F.log(missed)))


def distortion_index(df: DataFrame, group: str, column: str, size: int, *, ridge: float = 1e-6, most: int = 10_000) -> float:
    """Davies-Bouldin index in the metric of each cluster's covariance: the mean over clusters of the greatest
    (T_i + T_j) / (D_ij + D_ji). Clusters of one row have no covariance and are left out; nan below two clusters.

    The driver gets size + size**2 sums a cluster, for at most `most` clusters.
    """
    rows = S.moments(df, group, column, size).where("n > 1").orderBy(group).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} clusters")
    if len(rows) < 2:
        return float("nan")
    means = np.array([np.array(r["sums"]) / r["n"] for r in rows])
    spread, inverse = [], []
    for r, m in zip(rows, means):
        scatter = np.array(r["products"]).reshape(size, size) - r["n"] * np.outer(m, m)
        inverse.append(np.linalg.inv(scatter / (r["n"] - 1) + ridge * np.eye(size)))
        spread.append(np.trace(inverse[-1] @ scatter) / r["n"])
    apart = np.array([np.einsum("ij,jk,ik->i", means - m, p, means - m) for m, p in zip(means, inverse)])
    both = apart + apart.T
    np.fill_diagonal(both, np.inf)
    return float(((np.array(spread)[:, None] + np.array(spread)) / both).max(0).mean())


def _places(pos: Column, shape: V.Shape) -> list[Column]:
    return [F.floor(pos / (shape[1] * shape[2])).cast("int"), (F.floor(pos / shape[2]) % shape[1]).cast("int"), (pos % shape[2]).cast("int")]


def resized(df: DataFrame, key: str, column: str, shape: V.Shape, new: V.Shape, *, fill: float = 0.0) -> DataFrame:
    """(key, x, y, z, val): volumes in the middle of larger ones, or their middles; sizes differ by even numbers."""
    if any((a - b) % 2 for a, b in zip(shape, new)):
        raise ValueError("the sizes differ by odd numbers: centres would fall between voxels")
    grid = df.select(key, column, F.explode(F.sequence(F.lit(0), F.lit(int(np.prod(new)) - 1))).alias("_p"))
    at = [p + (n - m) // 2 for p, n, m in zip(_places(F.col("_p"), new), shape, new)]
    inside = (at[0] >= 0) & (at[0] < shape[0])
    for p, n in zip(at[1:], shape[1:]):
        inside = inside & (p >= 0) & (p < n)
    value = F.get(column, (at[0] * shape[1] + at[1]) * shape[2] + at[2]).cast("double")
    return grid.select(key, *(c.alias(a) for c, a in zip(_places(F.col("_p"), new), V.AXES)), F.when(inside, value).otherwise(F.lit(fill)).alias("val"))


def montage(df: DataFrame, key: str, column: str, shape: V.Shape) -> DataFrame:
    """(key, i, j, val): z slices in rows of ceil(sqrt(n)), one empty line apart, values from 0 to 1 (as they are if all agree)."""
    side = int(np.ceil(np.sqrt(shape[2])))
    wide = df.select(key, F.array_min(column).cast("double").alias("_a"), F.array_max(column).cast("double").alias("_b"), F.posexplode(column).alias("_p", "_v"))
    x, y, z = _places(F.col("_p"), shape)
    v = F.col("_v").cast("double")
    scaled = F.when(F.col("_b") > F.col("_a"), (v - F.col("_a")) / (F.col("_b") - F.col("_a"))).otherwise(v)
    return wide.select(key, (F.floor(z / side) * (shape[0] + 1) + x).cast("int").alias("i"), (z % side * (shape[1] + 1) + y).cast("int").alias("j"), scaled.alias("val"))


def region_shapes(points: DataFrame, group: str, x: str, y: str, *, least: int = 3, roundish: float = 0.5, linear: float = 0.3) -> DataFrame:
    """(group, l1, l2, roundish, linear): eigenvalues of the coordinates' covariance, the greater first, and what their ratio says."""
    c = points.groupBy(group).agg(F.count("*").alias("_n"), F.var_samp(x).alias("_a"), F.var_samp(y).alias("_b"), F.covar_samp(x, y).alias("_c")).where(F.col("_n") >= least)
    half, off = (F.col("_a") + F.col("_b")) / 2, F.sqrt(F.pow(F.col("_a") - F.col("_b"), 2) / 4 + F.col("_c") * F.col("_c"))
    e = c.select(group, (half + off).alias("l1"), (half - off).alias("l2"))
    ratio = F.col("l2") / F.col("l1")
    return e.select(group, "l1", "l2", ((F.col("l1") > 0) & (ratio >= roundish)).alias("roundish"), ((F.col("l1") > 0) & (ratio <= linear)).alias("linear"))
