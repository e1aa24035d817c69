"""Queries of Fourier operators on 4 x 4 x 4 cubes (`embeddings`), and SQL that computes the transforms by joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import spectra as X
from ..operators import records as R
from .base import register, table

QUERIES, SQL, _query = register()
SHAPE = (4, 4, 4)


def _cubes(spark, d):
    return table(spark, d, "embeddings")


def _with_mean(spark, d):
    """Each cube beside its class's mean."""
    e = _cubes(spark, d).select("vec_id", "label", "embedding")
    means = R.array_mean(e, "label", "embedding", 64).select("label", F.col("mean").alias("template"))
    return e.join(means, "label")


_E = "e AS (SELECT vec_id, label, (i - 1)::INT AS pos, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) p(i))"
_SIGNED = lambda c: f"(CASE WHEN {c} >= 2 THEN {c} - 4 ELSE {c} END)"
_K = f"k AS (SELECT k::INT AS k, {_SIGNED('k // 16')} AS fx, {_SIGNED('(k // 4 % 4)')} AS fy, {_SIGNED('k % 4')} AS fz, sqrt(fx*fx + fy*fy + fz*fz) AS rad FROM range(64) a(k))"
_W = """w AS (SELECT k::INT AS k, p::INT AS pos, [1.0, 0.0, -1.0, 0.0][m + 1]::DOUBLE AS c, [0.0, -1.0, 0.0, 1.0][m + 1]::DOUBLE AS s
 FROM (SELECT k, p, ((k // 16) * (p // 16) + (k // 4 % 4) * (p // 4 % 4) + (k % 4) * (p % 4)) % 4 AS m FROM range(64) a(k), range(64) b(p)))"""
_F = "f AS (SELECT vec_id, label, k, sum(v * c) AS re, sum(v * s) AS im FROM e JOIN w USING (pos) GROUP BY ALL)"
_G = "g AS (SELECT label, k, avg(re) AS re, avg(im) AS im FROM f GROUP BY ALL)"
_BASE = f"{_E}, {_K}, {_W}, {_F}"
_SHELL = "r AS (SELECT r::INT AS r FROM range(3) t(r))"


def _inverse(source: str, keys: str) -> str:
    """Real part of the inverse transform of source(keys, k, re, im), by pos."""
    return f"SELECT {keys}, pos, sum(re * c + im * s) / 64 AS v FROM {source} JOIN w USING (k) GROUP BY ALL"


def _exploded(df, keys, column, places=5, name="val"):
    return df.select(*keys, F.posexplode(column).alias("pos", name)).withColumn(name, F.round(name, places) + 0.0)


@_query(f"WITH {_BASE} SELECT vec_id, k AS pos, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM f")
def fourier_cube(spark, d):
    f = X.spectrum(_cubes(spark, d).select("vec_id", "embedding"), "embedding", SHAPE)
    at = f.select("vec_id", F.posexplode(F.arrays_zip("re", "im")).alias("pos", "s"))
    return at.select("vec_id", "pos", *((F.round(f"s.{c}", 4) + 0.0).alias(c) for c in ("re", "im")))


@_query(f"""WITH {_BASE}, {_G}, {_SHELL} SELECT vec_id, r AS pos, round(sum(f.re * g.re + f.im * g.im) / sqrt(sum(f.re**2 + f.im**2) * sum(g.re**2 + g.im**2)), 5) + 0.0 AS fsc
 FROM f JOIN g USING (label, k) JOIN k USING (k) JOIN r ON abs(rad - r) <= 1 AND r < 2 GROUP BY ALL""")
def fsc_to_average(spark, d):
    """Fourier shell correlation of each cube with its class's mean."""
    out = X.shell_correlations(_with_mean(spark, d), "embedding", "template", SHAPE, "fsc")
    return _exploded(out, ["vec_id"], "fsc", name="fsc")


_CORR = f"""WITH {_E}, m AS (SELECT label, pos, avg(v) AS t FROM e GROUP BY ALL),
 c AS (SELECT e.vec_id, s.s::INT AS pos, sum(t * e.v) AS val FROM range(64) s(s) CROSS JOIN m JOIN e ON e.label = m.label AND
  e.pos = (((m.pos // 16) + 2 + s.s // 16) % 4) * 16 + (((m.pos // 4 % 4) + 2 + s.s // 4 % 4) % 4) * 4 + ((m.pos % 4) + 2 + s.s % 4) % 4 GROUP BY ALL)"""


@_query(f"{_CORR} SELECT vec_id, pos, round(val, 4) + 0.0 AS val FROM c")
def fft_convolve(spark, d):
    """Circular correlation of each cube with its class's mean."""
    return _exploded(X.correlated(_with_mean(spark, d), "embedding", "template", SHAPE, "val"), ["vec_id"], "val", 4)


@_query(f"""{_CORR}, s AS (SELECT vec_id, any_value(label) AS label, stddev_pop(v) AS s FROM e GROUP BY vec_id), u AS (SELECT label, stddev_pop(t) AS u FROM m GROUP BY label)
 SELECT vec_id, pos, round(val / 64 / (s * u), 5) + 0.0 AS val FROM c JOIN s USING (vec_id) JOIN u USING (label)""")
def pearson_map(spark, d):
    return _exploded(X.correlated(_with_mean(spark, d), "embedding", "template", SHAPE, "val", pearson=True), ["vec_id"], "val")


def _gain_sql(gain: str) -> str:
    return f"WITH {_BASE}, h AS (SELECT vec_id, k, re * ({gain}) AS re, im * ({gain}) AS im FROM f JOIN k USING (k)), o AS ({_inverse('h', 'vec_id')}) SELECT vec_id, pos, round(v, 5) + 0.0 AS val FROM o"


@_query(_gain_sql("CASE WHEN rad**2 <= 4 AND rad**2 >= 1 THEN 1.0 ELSE 0.0 END"))
def band_pass(spark, d):
    out = X.filtered(_cubes(spark, d).select("vec_id", "embedding"), "embedding", SHAPE, X.band_gain(SHAPE, 1, 4), "val")
    return _exploded(out, ["vec_id"], "val")


_BALL = lambda r: f"CASE WHEN rad <= {r} THEN 1.0 ELSE exp(-((rad - {r}) / 0.8) * ((rad - {r}) / 0.8)) END"


@_query(_gain_sql(f"({_BALL(2.0)}) - ({_BALL(1.0)})"))
def band_pass_soft(spark, d):
    out = X.filtered(_cubes(spark, d).select("vec_id", "embedding"), "embedding", SHAPE, X.band_gain(SHAPE, 1.0, 2.0, 0.8), "val")
    return _exploded(out, ["vec_id"], "val")


@_query(_gain_sql("[1.0, 0.7, 0.4, 0.1][rint(rad)::INT + 1]".replace("rint", "round_even").replace("round_even(rad)", "round_even(rad, 0)")))
def radial_curve(spark, d):
    """Spectra times a curve at their rounded radius."""
    gain = np.array([1.0, 0.7, 0.4, 0.1])[np.rint(X.radii(SHAPE)).astype(int)]
    return _exploded(X.filtered(_cubes(spark, d).select("vec_id", "embedding"), "embedding", SHAPE, gain, "val"), ["vec_id"], "val")


@_query(_gain_sql("sin(0.7 * rad * rad - 0.05 * rad * rad * rad * rad) * exp(-rad * rad / 9)"))
def ctf_applied(spark, d):
    """Cubes seen through a contrast transfer function of the radius."""
    r = X.radii(SHAPE)
    gain = np.sin(0.7 * r * r - 0.05 * r * r * r * r) * np.exp(-r * r / 9)
    return _exploded(X.filtered(_cubes(spark, d).select("vec_id", "embedding"), "embedding", SHAPE, gain, "val"), ["vec_id"], "val")


@_query(f"""WITH {_BASE}, {_G}, h AS (SELECT vec_id, k, CASE WHEN abs(fz) <= abs(fx) THEN f.re ELSE g.re END AS re, CASE WHEN abs(fz) <= abs(fx) THEN f.im ELSE g.im END AS im
 FROM f JOIN g USING (label, k) JOIN k USING (k)), o AS ({_inverse('h', 'vec_id')}) SELECT vec_id, pos, round(v, 5) + 0.0 AS val FROM o""")
def impute_wedge(spark, d):
    """Cubes whose missing wedge is filled from their class's mean."""
    fx, _, fz = X.frequencies(SHAPE)
    out = X.imputed(_with_mean(spark, d), "embedding", "template", np.abs(fz) <= np.abs(fx), SHAPE, "val")
    return _exploded(out, ["vec_id"], "val")


_MASK = "(CASE WHEN vec_id % 2 = 0 THEN abs(fz) <= abs(fx) ELSE abs(fz) <= abs(fy) END)"


def _masked(spark, d):
    fx, fy, fz = X.frequencies(SHAPE)
    masks = [F.array(*[F.lit(float(v)) for v in (np.abs(fz) <= np.abs(other)).ravel()]) for other in (fx, fy)]
    return _cubes(spark, d).withColumn("mask", F.when(F.col("vec_id") % 2 == 0, masks[0]).otherwise(masks[1]))


_SUMS = f"""s AS (SELECT label, k, sum({_MASK}::INT)::DOUBLE AS n, sum(CASE WHEN {_MASK} THEN re ELSE 0 END) AS re, sum(CASE WHEN {_MASK} THEN im ELSE 0 END) AS im,
 sum(CASE WHEN {_MASK} THEN re * re + im * im ELSE 0 END) AS sq FROM f JOIN k USING (k) GROUP BY ALL)"""


@_query(f"""WITH {_BASE}, {_SUMS}, h AS (SELECT label, k, CASE WHEN n >= 1 THEN re / n ELSE 0 END AS re, CASE WHEN n >= 1 THEN im / n ELSE 0 END AS im FROM s), o AS ({_inverse('h', 'label')})
 SELECT label, pos, round(v, 5) + 0.0 AS val FROM o""")
def fourier_average(spark, d):
    """Class averages of masked spectra, each place over the masks that cover it."""
    sums = X.spectral_sums(_masked(spark, d), ["label"], "embedding", SHAPE, mask="mask")
    return _exploded(X.masked_average(sums, ["label"], SHAPE), ["label"], "average")


@_query(f"""WITH {_BASE}, {_SUMS}, {_SHELL}, a AS (SELECT *, (re*re + im*im) / (n*n) AS a, (sq - (re*re + im*im) / n) / (n - 1) AS v, max(n) OVER (PARTITION BY label) AS most FROM s WHERE n >= 2),
 t AS (SELECT label, r, max(most) AS most, sum(a) AS a, sum(v) AS v, sum(v / n) AS vn, sum(n * a) AS na, sum(n) AS n, sum(re) AS re, sum(im) AS im, sum(sq) AS sq
  FROM a JOIN k USING (k) JOIN r ON abs(rad - r) <= 1 GROUP BY ALL),
 u AS (SELECT *, (re*re + im*im) / (n*n) AS w FROM t),
 m AS (SELECT label, r, 0 AS method, CASE WHEN v > 0 THEN a / vn ELSE 0 END AS s FROM u UNION ALL SELECT label, r, 1, CASE WHEN v > 0 THEN na / v ELSE 0 END FROM u
  UNION ALL SELECT label, r, 2, CASE WHEN v > 0 THEN most * a / v ELSE 0 END FROM u
  UNION ALL SELECT label, r, 3, CASE WHEN (sq - n * w) / (n - 1) > 0 THEN most * w / ((sq - n * w) / (n - 1)) ELSE 0 END FROM u)
 SELECT label, r, method::INT AS method, round(s, 5) AS ssnr, round(s / (2 + s), 6) AS fsc FROM m""")
def ssnr_methods(spark, d):
    """Spectral SNR of each class by all four methods, under missing wedges."""
    sums = X.spectral_sums(_masked(spark, d), ["label"], "embedding", SHAPE, mask="mask")
    out = None
    for method in range(4):
        one = X.shell_snr(sums, ["label"], SHAPE, method=method).select("label", "r", F.lit(method).alias("method"), F.round("ssnr", 5).alias("ssnr"), F.round("fsc", 6).alias("fsc"))
        out = one if out is None else out.unionByName(one)
    return out


_PREFIX = f"""WITH {_BASE}, {_SHELL}, o AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1]::DOUBLE DESC, vec_id) AS len FROM embeddings),
 p AS (SELECT label, len, k, len::DOUBLE AS n, sum(re) OVER w AS re, sum(im) OVER w AS im, sum(re*re + im*im) OVER w AS sq FROM f JOIN o USING (vec_id) WINDOW w AS (PARTITION BY label, k ORDER BY len)),
 a AS (SELECT label, len, k, n, (re*re + im*im) / (n*n) AS a, (sq - (re*re + im*im) / n) / (n - 1) AS v FROM p WHERE n >= 2),
 t AS (SELECT label, len, r, CASE WHEN sum(v) > 0 THEN sum(a) / sum(v / n) ELSE 0 END AS s FROM a JOIN k USING (k) JOIN r ON abs(rad - r) <= 1 GROUP BY ALL),
 q AS (SELECT label, len, sum(s / (2 + s)) AS fsc FROM t GROUP BY ALL)"""


def _prefixes(spark, d):
    e = _cubes(spark, d).select("label", "vec_id", "embedding")
    sums = X.prefix_sums(e, "label", [F.desc(F.col("embedding")[0].cast("double")), F.col("vec_id")], "embedding", SHAPE)
    return X.shell_snr(sums, ["label", "len"], SHAPE).groupBy("label", "len").agg(F.sum("fsc").alias("fsc"))


@_query(f"{_PREFIX} SELECT label, len::INT AS len, round(fsc, 6) AS fsc FROM q")
def fsc_by_prefix(spark, d):
    """Sum of the FSC of every prefix of a class's records in the order of their score."""
    return _prefixes(spark, d).select("label", "len", F.round("fsc", 6).alias("fsc"))


@_query(f"{_PREFIX} SELECT label, len::INT AS len, round(fsc, 6) AS fsc FROM q WHERE len <= 30 QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(fsc, 9) DESC, len) = 1")
def cluster_by_best_prefix(spark, d):
    """The prefix of at most 30 records with the greatest sum of the FSC."""
    p = _prefixes(spark, d).where("len <= 30").groupBy("label").agg(F.max(F.struct(F.round("fsc", 9).alias("f"), (-F.col("len")).alias("l"))).alias("b"))
    return p.select("label", (-F.col("b.l")).alias("len"), F.round("b.f", 6).alias("fsc"))


@_query(f"""WITH {_BASE}, {_SHELL}, c AS (SELECT label, k, count(*)::DOUBLE AS n, sum(re) AS re, sum(im) AS im, sum(re*re + im*im) AS sq FROM f GROUP BY ALL),
 p AS (SELECT f.vec_id, k, c.n - 1 AS n, c.re - f.re AS re, c.im - f.im AS im, c.sq - f.re*f.re - f.im*f.im AS sq FROM f JOIN c USING (label, k)),
 a AS (SELECT vec_id, k, n, (re*re + im*im) / (n*n) AS a, (sq - (re*re + im*im) / n) / (n - 1) AS v FROM p WHERE n >= 2),
 t AS (SELECT vec_id, r, CASE WHEN sum(v) > 0 THEN sum(a) / sum(v / n) ELSE 0 END AS s FROM a JOIN k USING (k) JOIN r ON abs(rad - r) <= 1 GROUP BY ALL)
 SELECT vec_id, round(sum(s / (2 + s)), 6) AS fsc FROM t GROUP BY vec_id""")
def fsc_without_each(spark, d):
    """What the sum of a class's FSC is without each of its records."""
    left = X.without_each(_cubes(spark, d).select("label", "vec_id", "embedding"), "label", "vec_id", "embedding", SHAPE)
    return X.shell_snr(left, ["label", "vec_id"], SHAPE).groupBy("vec_id").agg(F.round(F.sum("fsc"), 6).alias("fsc"))


@_query(f"""WITH {_E}, o AS (SELECT i::INT AS i, j::INT AS j, l::INT AS l FROM range(-1, 2) a(i), range(-1, 2) b(j), range(-1, 2) c(l) WHERE i <> 0 OR j <> 0 OR l <> 0),
 p AS (SELECT a.pos, i, j, l, avg(a.v * b.v) - avg(a.v) * avg(b.v) AS cov FROM e a CROSS JOIN o JOIN e b ON b.vec_id = a.vec_id AND
  b.pos = ((a.pos // 16 + i + 4) % 4) * 16 + ((a.pos // 4 % 4 + j + 4) % 4) * 4 + (a.pos % 4 + l + 4) % 4 GROUP BY ALL)
 SELECT pos, round(avg(cov), 6) + 0.0 AS cov FROM p GROUP BY pos""")
def neighbour_covariance(spark, d):
    """Mean covariance of every voxel with its 26 neighbours, the cube wrapping around."""
    from ..operators.statistics import moments

    m = moments(_cubes(spark, d).withColumn("g", F.lit(0)), "g", "embedding", 64)
    places = np.indices(SHAPE).reshape(3, -1).T
    pairs = []
    for p, at in enumerate(places):
        for o in np.ndindex(3, 3, 3):
            if o != (1, 1, 1):
                q = (at + np.array(o) - 1) % 4
                pairs.append((p, int(q[0] * 16 + q[1] * 4 + q[2])))
    near = spark.createDataFrame(pairs, "pos int, other int")
    s, n = F.col("sums"), F.col("n")
    cov = F.get("products", F.col("pos") * 64 + F.col("other")) / n - F.get(s, F.col("pos")) / n * F.get(s, F.col("other")) / n
    return near.join(F.broadcast(m), F.lit(True)).groupBy("pos").agg((F.round(F.avg(cov), 6) + 0.0).alias("cov"))


# grids and views


@_query(f"WITH {_E} SELECT vec_id, x::INT AS x, y::INT AS y, z::INT AS z, coalesce(v, 0.0) AS val FROM embeddings CROSS JOIN range(6) a(x) CROSS JOIN range(6) b(y) CROSS JOIN range(6) c(z) LEFT JOIN e ON e.vec_id = embeddings.vec_id AND x BETWEEN 1 AND 4 AND y BETWEEN 1 AND 4 AND z BETWEEN 1 AND 4 AND e.pos = (x - 1) * 16 + (y - 1) * 4 + z - 1".replace("SELECT vec_id, x", "SELECT embeddings.vec_id, x"))
def resize_center(spark, d):
    """Cubes in the middle of 6 x 6 x 6 ones."""
    from ..operators.imaging import resized

    return resized(_cubes(spark, d).select("vec_id", "embedding"), "vec_id", "embedding", SHAPE, (6, 6, 6))


@_query(f"""WITH {_E}, n AS (SELECT vec_id, min(v) AS a, max(v) AS b FROM e GROUP BY vec_id)
 SELECT vec_id, ((pos % 4 // 2) * 5 + pos // 16)::INT AS i, ((pos % 4 % 2) * 5 + pos // 4 % 4)::INT AS j, round((v - a) / (b - a), 6) AS val FROM e JOIN n USING (vec_id)""")
def slice_montage(spark, d):
    """The z slices of each cube side by side, a line between them, grey values from 0 to 1."""
    from ..operators.imaging import montage

    return montage(_cubes(spark, d).select("vec_id", "embedding"), "vec_id", "embedding", SHAPE).withColumn("val", F.round("val", 6))
