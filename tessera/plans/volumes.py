"""Queries of the picking chain, masks, tiles, regions and fits over the tomogram, cubes and points, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import imaging as I
from ..operators import pairs as P
from ..operators import regions as G
from ..operators import voxel as V
from .analysis import _GRID, SHAPE, _full, _tomogram
from .base import POINTS, points, register, table, uniform, uniform_sql
from .pairs import greedy_sql

QUERIES, SQL, _query = register()
_NX, _NY, _NZ = SHAPE


# masks and kernels


@_query("SELECT x::INT AS x, y::INT AS y, z::INT AS z, (x IN (0, 5) OR y IN (0, 6) OR z IN (0, 7))::INT AS val FROM range(6) a(x), range(7) b(y), range(8) c(z)")
def boundary_mask(spark, d):
    return V.boundary_mask(spark, (6, 7, 8))


@_query("SELECT x::INT AS x, y::INT AS y, z::INT AS z, (x - 4)::INT AS dx, (y - 4)::INT AS dy, (z - 5)::INT AS dz, (x-4)*(x-4) + (y-4)*(y-4) + (z-5)*(z-5) AS square, round(sqrt((x-4)*(x-4) + (y-4)*(y-4) + (z-5)*(z-5)), 6) AS distance FROM range(9) a(x), range(8) b(y), range(10) c(z)")
def grid_distance(spark, d):
    """Displacement from the FFT's centre, floor(n / 2), its square and its length."""
    g = V.grid(spark, (9, 8, 10))
    own = [(F.col(a) - n // 2).cast("int") for a, n in zip(V.AXES, (9, 8, 10))]
    square = sum(c * c for c in own)
    return g.select(*V.AXES, *(c.alias(f"d{a}") for c, a in zip(own, V.AXES)), square.cast("long").alias("square"), F.round(F.sqrt(square), 6).alias("distance"))


_BELL = lambda s: f"exp(-r / (2 * {s} * {s})) / sum(exp(-r / (2 * {s} * {s}))) OVER ()"


@_query(f"WITH g AS (SELECT x::INT AS x, y::INT AS y, z::INT AS z, ((x-4)*(x-4) + (y-4)*(y-4) + (z-4)*(z-4))::DOUBLE AS r FROM range(9) a(x), range(9) b(y), range(9) c(z)) SELECT x, y, z, round({_BELL(1.0)} - {_BELL(1.6)}, 9) + 0.0 AS val FROM g")
def dog_kernel(spark, d):
    """Difference of two normalised Gaussians on a grid."""
    return V.dog_kernel(spark, 9, 1.0, 1.6).withColumn("val", F.round("val", 9) + 0.0)


_N = 16
_TOY = [(_N / 4, 0, 0, 1.2, 0.4, 0.4, 0.0), (0, _N / 4, 0, 0.4, 1.2, 0.4, 0.0), (0, 0, _N / 4, 0.4, 0.4, 1.2, 0.0), (_N / 4, 0, 0, 1.2, 0.4, 0.4, math.pi / 4)]


def _toy_sql() -> str:
    parts = []
    for x, y, z, a, b, c, turn in _TOY:
        u = f"(({math.cos(turn)!r}) * p + ({math.sin(turn)!r}) * q - {x})"
        v = f"(({-math.sin(turn)!r}) * p + ({math.cos(turn)!r}) * q - {y})"
        parts.append(f"exp(-({u}*{u} / {_N * a} + {v}*{v} / {_N * b} + (s - {z})*(s - {z}) / {_N * c}))")
    return f"SELECT x::INT AS x, y::INT AS y, z::INT AS z, round({' + '.join(parts)}, 6) AS val FROM (SELECT *, x - {_N / 2}::DOUBLE AS p, y - {_N / 2}::DOUBLE AS q, z - {_N / 2}::DOUBLE AS s FROM range({_N}) a(x), range({_N}) b(y), range({_N}) c(z))"


@_query(_toy_sql())
def toy_model(spark, d):
    """Four ellipsoidal Gaussians, the fourth the first one turned by 45 degrees about z."""
    return V.gaussian_sum(spark, _N, _TOY).withColumn("val", F.round("val", 6))


# the picking chain


def _chain_sql(out: str) -> str:
    from .catalog import _BOX, _smooth_sql

    dog = f"{_GRID}, {_smooth_sql('a', 'vol', 2.0)}, {_smooth_sql('b', 'vol', 2.2)}, dog AS (SELECT a.x, a.y, a.z, round(a.val - b.val, 9) AS val FROM a JOIN b USING (x, y, z))"
    found = f"found AS MATERIALIZED (SELECT * FROM dog v WHERE val > (SELECT min(val) FROM dog) AND NOT EXISTS (SELECT 1 FROM dog m WHERE {_BOX} AND m.val > v.val))"
    cut = "cut AS (SELECT * FROM found WHERE val >= (SELECT min(val) + 3.0 * (max(val) - min(val)) / 20 FROM found))"
    rank = "SELECT row_number() OVER (ORDER BY val DESC, x, y, z) AS i, row_number() OVER (ORDER BY val DESC, x, y, z) AS id, x, y, z, val FROM cut"
    return f"WITH RECURSIVE {dog}, {found}, {cut}, {greedy_sql(rank, '(k.x - r.x)**2 + (k.y - r.y)**2 + (k.z - r.z)**2 < 4')} {out}"


def picks(spark, d):
    """DoG, local maxima, those over m + t (M - m) / 20, and of close ones the best: the whole chain."""
    return V.pick(_tomogram(spark, d), SHAPE, 2.0, 2.2, t=3.0, distance=2.0, rounded=9)


QUERIES["picking_chain"] = lambda spark, d: picks(spark, d).select("x", "y", "z", F.round("val", 6).alias("val"))
SQL["picking_chain"] = _chain_sql("SELECT x, y, z, round(val, 6) AS val FROM ranked JOIN kept USING (id)")


@_query(f"WITH {_GRID}, p AS (SELECT * FROM vol WHERE val >= 0.9 * (SELECT max(val) FROM vol)) SELECT x, y, z, val, greatest(x - 2, 0)::INT AS x0, least(x + 2, {_NX - 1})::INT AS x1 FROM p")
def saliency_cutouts(spark, d):
    """Places of at least 0.9 times the greatest value, with their cut-outs' bounds along x."""
    t = _tomogram(spark, d)
    top = t.agg((0.9 * F.max("val")).alias("cut"))
    over = t.join(F.broadcast(top), F.col("val") >= F.col("cut"))
    return over.select("x", "y", "z", "val", F.greatest(F.col("x") - 2, F.lit(0)).alias("x0"), F.least(F.col("x") + 2, F.lit(_NX - 1)).alias("x1"))


# stencils


_LEAD = "coalesce(lead(val) OVER (PARTITION BY {p} ORDER BY {o}) - val, 0)"
_DIFF = f"d AS (SELECT x, y, z, {_LEAD.format(p='y, z', o='x')} AS dx, {_LEAD.format(p='x, z', o='y')} AS dy, {_LEAD.format(p='x, y', o='z')} AS dz FROM vol), n AS (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS m FROM d)"


@_query(f"WITH {_GRID}, {_DIFF} SELECT x, y, z, round(CASE WHEN m > 0 THEN dx / m ELSE 0 END, 6) + 0.0 AS nx, round(CASE WHEN m > 0 THEN dy / m ELSE 0 END, 6) + 0.0 AS ny, round(CASE WHEN m > 0 THEN dz / m ELSE 0 END, 6) + 0.0 AS nz, round(CASE WHEN m > 0 THEN (dx*dx + dy*dy + dz*dz) / m ELSE 0 END, 6) AS along FROM n")
def gradient_normal(spark, d):
    """Unit gradients, and the derivative along them."""
    g = V.gradient(_tomogram(spark, d), SHAPE)
    m = F.sqrt("mag")
    unit = [F.when(m > 0, F.col(c) / m).otherwise(0.0) for c in ("dx", "dy", "dz")]
    along = sum(F.col(c) * u for c, u in zip(("dx", "dy", "dz"), unit))
    return g.select(*V.AXES, *((F.round(u, 6) + 0.0).alias(f"n{a}") for u, a in zip(unit, V.AXES)), F.round(along, 6).alias("along"))


@_query(f"WITH {_GRID} SELECT v.x, v.y, v.z, max(m.val) AS val FROM vol v CROSS JOIN range(-2, 3) a(i) CROSS JOIN range(-2, 3) b(j) CROSS JOIN range(-2, 3) c(k) JOIN vol m ON m.x = (v.x + i + {_NX}) % {_NX} AND m.y = (v.y + j + {_NY}) % {_NY} AND m.z = (v.z + k + {_NZ}) % {_NZ} GROUP BY v.x, v.y, v.z")
def dilate_periodic(spark, d):
    """Greatest value in a cube of five voxels a side, the volume wrapping around."""
    return V.dilate_periodic(_tomogram(spark, d), SHAPE, 5).drop("vol_id")


_LABELS = "lab AS (SELECT x, y, z, least(val, 2)::INT AS lab FROM vol)"


@_query(f"WITH {_GRID}, {_LABELS} SELECT x, y, z, lab FROM lab v WHERE EXISTS (SELECT 1 FROM lab m WHERE abs(m.x - v.x) <= 1 AND abs(m.y - v.y) <= 1 AND abs(m.z - v.z) <= 1 AND m.lab <> v.lab)")
def segment_boundary(spark, d):
    """Voxels with another label among their 26 neighbours."""
    lab = _tomogram(spark, d).withColumn("val", F.least("val", F.lit(2.0)))
    return V.segment_boundary(lab, SHAPE).select(*V.AXES, F.col("val").cast("int").alias("lab"))


@_query(f"WITH {_GRID}, f AS (SELECT * FROM vol WHERE val >= 2), b AS (SELECT x, y, z FROM vol WHERE val < 2) SELECT f.x, f.y, f.z, round(sqrt(min((f.x-b.x)**2 + (f.y-b.y)**2 + (f.z-b.z)**2)), 6) AS distance FROM f, b GROUP BY f.x, f.y, f.z")
def distance_transform(spark, d):
    """Distance of every voxel of at least 2 to the nearest one below."""
    return V.distance_transform(_tomogram(spark, d).withColumn("val", (F.col("val") >= 2).cast("double")), SHAPE).where("val > 0").select(*V.AXES, F.round("val", 6).alias("distance"))


# tiles, patches, slabs


@_query(f"WITH {_GRID}, t AS (SELECT x, y, z, val, x // 8 AS i0, y // 8 AS i1, z // 8 AS i2 FROM vol) SELECT (i0 * 8)::INT AS x0, (i1 * 8)::INT AS y0, (i2 * 8)::INT AS z0, sum(val) AS total, count(*) AS filled, 512 - count(*) AS padded FROM t GROUP BY ALL")
def tiles_padded(spark, d):
    """Tiles of eight voxels a side that don't overlap; what lies beyond the volume is zero."""
    return V.tiles_padded(_tomogram(spark, d), SHAPE, 8).select("x0", "y0", "z0", "total", "filled", "padded")


@_query(f"""WITH {_GRID}, p AS (SELECT x, y, z, val FROM vol WHERE val >= 4), t AS (SELECT x // 8 AS i, y // 8 AS j, z // 8 AS k, avg((val >= 2)::INT) AS fraction FROM vol GROUP BY ALL),
 n AS (SELECT x // 8 AS i, y // 8 AS j, z // 8 AS k, count(*) AS picks FROM p GROUP BY ALL)
 SELECT 'tomo-subtomo-' || k || '_' || j || '_' || i AS subtomogram_name, round(fraction, 6) AS positive_fraction, coalesce(picks, 0) AS picks, 'tomo' AS tomogram_name FROM t LEFT JOIN n USING (i, j, k)""")
def train_tiles(spark, d):
    """Tiles for training by name, with their share of particle voxels and number of coordinates; the name gives the tomogram."""
    f = _full(spark, d)
    at = [F.floor(F.col(a) / 8).alias(i) for a, i in zip(V.AXES, "ijk")]
    t = f.groupBy(*at).agg(F.avg((F.col("val") >= 2).cast("int")).alias("fraction"), F.count(F.when(F.col("val") >= 4, 1)).alias("picks"))
    name = F.concat(F.lit("tomo-subtomo-"), F.concat_ws("_", "k", "j", "i"))
    return t.select(name.alias("subtomogram_name"), F.round("fraction", 6).alias("positive_fraction"), "picks", F.split_part(name, F.lit("-"), F.lit(1)).alias("tomogram_name"))


@_query(f"""WITH {_GRID}, t AS (SELECT i, greatest(i * 8, 0) AS low, least(i * 8 + 12, {_NX}) AS high FROM range({-(-(_NX - 4) // 8)}) r(i)), p AS (SELECT * FROM vol WHERE val >= 4)
 SELECT i::INT AS tile, x, y, z, val FROM p JOIN t ON x >= low AND x < high""")
def union_tiles(spark, d):
    """Peaks of all tiles along x, those in overlaps as often as tiles hold them."""
    t = _tomogram(spark, d).where("val >= 4")
    first = F.greatest(F.floor((F.col("x") - 12) / 8) + 1, F.lit(0))
    last = F.least(F.floor(F.col("x") / 8), F.lit(-(-(_NX - 4) // 8) - 1))
    return t.select(F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("tile"), *V.AXES, "val")


@_query(f"WITH {_GRID} SELECT (x // 16)::INT AS row, (y // 12)::INT AS col, z, (x % 16)::INT AS i, (y % 12)::INT AS j, val FROM vol WHERE val <> 0")
def patch_split(spark, d):
    """Slices in patches of 16 x 12."""
    return V.split_patches(_tomogram(spark, d), 16, 12).drop("vol_id")


@_query(f"WITH {_GRID} SELECT x, y, z, val FROM vol WHERE val <> 0")
def patch_stitch(spark, d):
    """Patches put together again."""
    return V.stitch_patches(V.split_patches(_tomogram(spark, d), 16, 12), 16, 12).drop("vol_id")


@_query(f"WITH {_GRID} SELECT x, y, (z // 4)::INT AS slab, sum(val) / 4 AS val FROM vol GROUP BY ALL HAVING sum(val) > 0")
def slab_slices(spark, d):
    """Mean slices of slabs of four."""
    t = _tomogram(spark, d)
    return t.groupBy("x", "y", F.floor(F.col("z") / 4).cast("int").alias("slab")).agg((F.sum("val") / 4).alias("val"))


@_query(f"WITH {_GRID} SELECT x, y, z, val FROM vol WHERE abs((x - 15) * 0.6 + (y - 12) * 0.64 + (z - 8) * 0.48) <= 0.5 AND val <> 0")
def plane_slice(spark, d):
    """Voxels within half a voxel of a slanted plane through the middle."""
    off = F.abs((F.col("x") - 15) * 0.6 + (F.col("y") - 12) * 0.64 + (F.col("z") - 8) * 0.48)
    return _tomogram(spark, d).where(off <= 0.5).select(*V.AXES, "val")


_PASTE = "o AS (SELECT i::INT AS i, j::INT AS j, k::INT AS k, (4 - abs(i) - abs(j) - abs(k))::DOUBLE AS w FROM range(-1, 2) a(i), range(-1, 2) b(j), range(-1, 2) c(k))"


@_query(f"""WITH {_GRID}, {_PASTE}, p AS (SELECT x, y, z FROM vol WHERE val >= 4), a AS (SELECT p.x + i AS x, p.y + j AS y, p.z + k AS z, sum(w) AS w FROM p, o GROUP BY ALL)
 SELECT x, y, z, val + coalesce(w, 0) AS val FROM vol LEFT JOIN a USING (x, y, z) WHERE val + coalesce(w, 0) <> 0""")
def add_to_map(spark, d):
    """A 3 x 3 x 3 template added at every peak; what falls outside is cut."""
    t = _tomogram(spark, d)
    return V.add_templates(t, t.where("val >= 4"), {o: 4.0 - sum(map(abs, o)) for o in V.BOX}, SHAPE).select(*V.AXES, "val")


@_query(f"""WITH {_GRID}, {_PASTE}, p AS (SELECT x, y, z, val FROM vol WHERE val >= 4),
 a AS (SELECT p.x + i AS x, p.y + j AS y, p.z + k AS z, arg_max(w, (val, p.x, p.y, p.z)) AS w FROM p, o GROUP BY ALL)
 SELECT x, y, z, coalesce(w, val) AS val FROM vol LEFT JOIN a USING (x, y, z) WHERE coalesce(w, val) <> 0""")
def paste_to_map(spark, d):
    """The template put in place of the voxels around every peak; the greatest peak wins."""
    t = _tomogram(spark, d)
    return V.add_templates(t, t.where("val >= 4"), {o: 4.0 - sum(map(abs, o)) for o in V.BOX}, SHAPE, replace=True).select(*V.AXES, "val")


@_query(f"WITH {_GRID} SELECT (x // 6)::INT AS i, (y // 6)::INT AS j, (z // 4)::INT AS k, round(avg(val), 6) AS mean FROM vol GROUP BY ALL")
def supervoxel_mean(spark, d):
    at = [F.floor(F.col(a) / n).cast("int").alias(i) for a, i, n in zip(V.AXES, "ijk", (6, 6, 4))]
    return _full(spark, d).groupBy(*at).agg(F.round(F.avg("val"), 6).alias("mean"))


def _slic_sql() -> str:
    seeds = "c0 AS (SELECT (x // 8) * 100 + (y // 8) * 10 + z // 8 AS c, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, avg(val) AS cv FROM vol GROUP BY ALL)"
    steps = []
    for k in range(2):
        near = f"SELECT x, y, z, val, c FROM vol JOIN c{k} ON abs(x - cx) <= 8 AND abs(y - cy) <= 8 AND abs(z - cz) <= 8 QUALIFY row_number() OVER (PARTITION BY x, y, z ORDER BY round(((x-cx)**2 + (y-cy)**2 + (z-cz)**2) / 64 + (val - cv)**2 / 4, 9), c) = 1"
        steps.append(f"a{k} AS ({near}), c{k + 1} AS (SELECT c, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, avg(val) AS cv FROM a{k} GROUP BY c)")
    return f"WITH {_GRID}, {seeds}, {', '.join(steps)} SELECT c::INT AS centre, round(cx, 6) AS x, round(cy, 6) AS y, round(cz, 6) AS z, round(cv, 6) AS val FROM c2"


@_query(_slic_sql())
def slic(spark, d):
    """Two rounds of supervoxels: each voxel to the nearest centre within reach, centres to their voxels' means."""
    c = G.slic(_full(spark, d), 8, 2.0, rounds=2)
    return c.select("centre", *(F.round(a, 6).alias(a) for a in (*V.AXES, "val")))


# matrices, shapes, distances, weights


@_query("""WITH m AS (SELECT label AS i, p AS j, avg(embedding[p]::DOUBLE) AS v FROM embeddings, range(1, 65) t(p) GROUP BY ALL), c AS (SELECT j, sum(v) AS s FROM m GROUP BY j)
 SELECT round(sqrt((SELECT sum(v * v) FROM m)), 6) AS frobenius, round((SELECT max(s) FROM c), 6) AS l1""")
def matrix_norms(spark, d):
    """Frobenius norm of the matrix of class means, and its greatest column sum, signs kept."""
    from ..operators.records import array_mean

    m = array_mean(table(spark, d, "embeddings"), "label", "embedding", 64).select("label", F.posexplode("mean").alias("j", "v"))
    columns = m.groupBy("j").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    return columns.agg(F.round(F.sqrt(F.sum("q")), 6).alias("frobenius"), F.round(F.max("s"), 6).alias("l1"))


_SHAPE2 = "c AS (SELECT p_brand, count(*) AS n, var_samp(p_partkey * 37 % 97) AS a, var_samp(p_partkey * 101 % 89) AS b, covar_samp(p_partkey * 37 % 97, p_partkey * 101 % 89) AS c FROM part GROUP BY 1), e AS (SELECT p_brand, n, (a + b) / 2 + sqrt((a - b)**2 / 4 + c * c) AS l1, (a + b) / 2 - sqrt((a - b)**2 / 4 + c * c) AS l2 FROM c WHERE n >= 3)"


@_query(f"WITH {_SHAPE2} SELECT p_brand, round(l1, 5) AS l1, round(l2, 5) AS l2, l1 > 0 AND l2 / l1 >= 0.5 AS roundish, l1 > 0 AND l2 / l1 <= 0.3 AS linear FROM e")
def region_shape(spark, d):
    """Eigenvalues of a region's coordinates, and whether it is round or stretched."""
    p = table(spark, d, "part").select("p_brand", (F.col("p_partkey") * 37 % 97).alias("x"), (F.col("p_partkey") * 101 % 89).alias("y"))
    s = I.region_shapes(p, "p_brand", "x", "y")
    return s.select("p_brand", F.round("l1", 5).alias("l1"), F.round("l2", 5).alias("l2"), "roundish", "linear")


@_query("""WITH a AS (SELECT p_partkey * 37 % 97 AS x, p_partkey * 101 % 89 AS y, p_partkey % 2 AS side FROM part),
 d AS (SELECT u.x, u.y, u.side, sqrt(min((u.x - v.x)**2 + (u.y - v.y)**2)) AS d FROM a u JOIN a v ON u.side <> v.side GROUP BY u.x, u.y, u.side)
 SELECT round(quantile_cont(d, 0.95), 6) AS hd95, round(max(d), 6) AS hausdorff FROM d""")
def hausdorff95(spark, d):
    """The 95th percentile, and the maximum, of the distances from each set's points to the other set."""
    p = table(spark, d, "part").select((F.col("p_partkey") * 37 % 97).alias("x"), (F.col("p_partkey") * 101 % 89).alias("y"), (F.col("p_partkey") % 2).alias("side"))
    both = P.set_distances(p, "side", ["x", "y"])
    return both.agg(F.round(F.percentile("distance", F.lit(0.95)), 6).alias("hd95"), F.round(F.max("distance"), 6).alias("hausdorff"))


_PAIRED = "p AS (SELECT a.vec_id, a.label = b.label AS same, list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE)**2)) AS dist FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 10)"


@_query(f"""WITH {_PAIRED}, t AS (SELECT k, k * 0.1 AS threshold FROM range(0, 41) r(k)),
 s AS (SELECT threshold, count(*) FILTER (dist < threshold AND same) AS tp, count(*) FILTER (dist < threshold AND NOT same) AS fp, count(*) FILTER (same) AS p, count(*) FILTER (NOT same) AS n FROM p, t GROUP BY threshold)
 SELECT round(threshold, 6) AS threshold, CASE WHEN p = 0 THEN 0 ELSE round(tp / p, 6) END AS tpr, CASE WHEN n = 0 THEN 0 ELSE round(fp / n, 6) END AS fpr, round((tp + n - fp) / (p + n), 6) AS acc FROM s""")
def accuracy_at_thresholds(spark, d):
    """True and false accept rates and accuracy of distances under every threshold."""
    from ..operators.statistics import accuracy_by_threshold

    out = accuracy_by_threshold(_pair_distances(spark, d), "dist", "same", [k * 0.1 for k in range(41)])
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


def _pair_distances(spark, d):
    from ..operators.records import square_distance

    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    other = e.select((F.col("vec_id") - 10).alias("vec_id"), F.col("label").alias("l2"), F.col("embedding").alias("e2"))
    return e.join(other, "vec_id").select("vec_id", (F.col("label") == F.col("l2")).alias("same"), square_distance(F.col("embedding"), F.col("e2")).alias("dist"))


@_query(f"""WITH {_PAIRED}, f AS (SELECT *, (vec_id % 5)::INT AS fold FROM p), t AS (SELECT k, k * 0.1 AS threshold FROM range(0, 41) r(k)), g AS (SELECT DISTINCT fold AS held FROM f),
 r AS (SELECT held, threshold, count(*) FILTER (dist < threshold AND NOT same) / count(*) FILTER (NOT same) AS far FROM f, t, g WHERE fold <> held GROUP BY held, threshold),
 hi AS (SELECT held, arg_min(threshold, threshold) AS t1, arg_min(far, threshold) AS f1 FROM r WHERE far >= 0.1 GROUP BY held),
 lo AS (SELECT r.held, max(threshold) AS t0, arg_max(far, threshold) AS f0 FROM r JOIN hi USING (held) WHERE threshold < t1 GROUP BY r.held),
 c AS (SELECT held, coalesce(CASE WHEN f1 > f0 THEN t0 + (t1 - t0) * (0.1 - f0) / (f1 - f0) ELSE t1 END, t1, 0) AS threshold FROM g LEFT JOIN hi USING (held) LEFT JOIN lo USING (held))
 SELECT held AS fold, round(threshold, 6) AS threshold, round(count(*) FILTER (dist < threshold AND same) / count(*) FILTER (same), 6) AS val, round(count(*) FILTER (dist < threshold AND NOT same) / count(*) FILTER (NOT same), 6) AS far
 FROM f JOIN c ON fold = held GROUP BY held, threshold""")
def val_at_far(spark, d):
    """By fold: the threshold at a false accept rate of 0.1 on the other folds, between two of a list, and both rates on the fold."""
    from ..operators.statistics import validation_at

    pairs = _pair_distances(spark, d).withColumn("fold", (F.col("vec_id") % 5).cast("int"))
    out = validation_at(pairs, "dist", "same", "fold", [k * 0.1 for k in range(41)], 0.1)
    return out.select("fold", *(F.round(c, 6).alias(c) for c in ("threshold", "val", "far")))


@_query("""WITH e AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label % 2 AS s, b.label % 2 AS t, exp(-abs(a.embedding[1]::DOUBLE - b.embedding[1]::DOUBLE)) AS w FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 3),
 u AS (SELECT s AS part, w, s <> t AS crossing FROM e UNION ALL SELECT t, w, s <> t FROM e) SELECT part::INT AS part, round(sum(w) FILTER (crossing) / sum(w), 6) AS share FROM u GROUP BY part""")
def normalized_cut(spark, d):
    """By part: what it cuts of its nodes' degrees; the loss is the sum."""
    v = table(spark, d, "embeddings").select("vec_id", (F.col("label") % 2).alias("part"), F.col("embedding")[0].cast("double").alias("v"))
    other = v.select(F.col("vec_id").alias("b"), F.col("part").alias("t"), F.col("v").alias("u"))
    steps = v.withColumn("b", F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 3))).join(other, "b")
    return G.normalized_cut(steps.select(F.col("part").alias("s"), "t", F.exp(-F.abs(F.col("v") - F.col("u"))).alias("w"))).select("part", F.round("share", 6).alias("share"))


@_query(f"WITH {POINTS} SELECT id, round((x - 3) / 1.5, 6) AS vx, round((y + 2) / 1.5, 6) AS vy, round((z - 10) / 1.5, 6) AS vz, round((x - 3) / 1.5 * 1.5 + 3, 6) AS x FROM pts")
def vertex_transform(spark, d):
    """Surface vertices as voxel coordinates, and one axis back again."""
    p = points(spark, d)
    low = {"x": 3.0, "y": -2.0, "z": 10.0}
    at = p.select("id", *(((F.col(a) - low[a]) / 1.5).alias(f"v{a}") for a in V.AXES))
    return at.select("id", *(F.round(f"v{a}", 6).alias(f"v{a}") for a in V.AXES), F.round(F.col("vx") * 1.5 + 3, 6).alias("x"))


_DRAWS = 2000


@_query(f"""WITH n AS (SELECT n_nationkey AS id, n_nationkey * 0.25 AS phi, n_nationkey * 0.11 AS theta, n_regionkey * 1.0 AS x FROM nation),
 s AS (SELECT i, {uniform_sql('i', 'a')} * 6.0 AS phi, {uniform_sql('i', 'b')} * 2.64 AS theta, {uniform_sql('i', 'c')} * 4.0 AS x FROM range({_DRAWS}) t(i)),
 b AS (SELECT i, id FROM s, n QUALIFY row_number() OVER (PARTITION BY i ORDER BY (s.phi - n.phi)**2 + (s.theta - n.theta)**2 + (s.x - n.x)**2, id) = 1)
 SELECT n.id, round(count(b.i) / {_DRAWS}, 6) AS weight FROM n LEFT JOIN b USING (id) GROUP BY n.id""")
def voronoi_weights(spark, d):
    """Share of drawn poses that are nearest to each pose."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.array(F.col("n_nationkey") * 0.25, F.col("n_nationkey") * 0.11, F.col("n_regionkey") * 1.0).alias("at"))
    i = F.col("id")
    draws = spark.range(_DRAWS).select(i.alias("i"), F.array(uniform(i, "a") * 6.0, uniform(i, "b") * 2.64, uniform(i, "c") * 4.0).alias("p"))
    return P.voronoi_weights(n, draws, "id", _DRAWS).withColumn("weight", F.round("weight", 6))


@_query(f"""WITH w AS (SELECT n_nationkey AS id, sum(n_regionkey + 1) OVER (ORDER BY n_nationkey) / sum(n_regionkey + 1) OVER () AS top, (sum(n_regionkey + 1) OVER (ORDER BY n_nationkey) - n_regionkey - 1) / sum(n_regionkey + 1) OVER () AS low FROM nation),
 s AS (SELECT i, {uniform_sql('i', 'draw')} AS u FROM range(500) t(i)) SELECT id, count(i) AS n FROM w LEFT JOIN s ON u >= low AND u < top GROUP BY id""")
def multinomial_mixture(spark, d):
    """500 draws from the shares of a mixture."""
    w = Window.orderBy("n_nationkey")  # a mixture's few kinds
    n = table(spark, d, "nation").select("n_nationkey", (F.col("n_regionkey") + 1).alias("s"))
    cut = n.select(F.col("n_nationkey").alias("id"), F.sum("s").over(w).alias("top"), "s", F.sum("s").over(Window.partitionBy()).alias("all"))
    cut = cut.select("id", (F.col("top") / F.col("all")).alias("top"), ((F.col("top") - F.col("s")) / F.col("all")).alias("low"))
    draws = spark.range(500).select(uniform(F.col("id"), "draw").alias("u"))
    return cut.join(F.broadcast(draws), (F.col("u") >= F.col("low")) & (F.col("u") < F.col("top")), "left").groupBy("id").agg(F.count("u").alias("n"))


# expectation and maximisation on vectors


_EM = """e AS (SELECT vec_id, p, embedding[p]::DOUBLE AS v FROM embeddings, range(1, 65) t(p)), a AS (SELECT label AS k, p, avg(embedding[p]::DOUBLE) AS m FROM embeddings, range(1, 65) t(p) GROUP BY ALL),
 al AS (SELECT label AS k, count(*) / (SELECT count(*) FROM embeddings) AS alpha FROM embeddings GROUP BY label),
 d AS (SELECT vec_id, k, sum((v - m) * (v - m)) AS d FROM e JOIN a USING (p) GROUP BY ALL),
 l AS (SELECT vec_id, k, d, -d / (2 * 0.02) + ln(alpha) AS l FROM d JOIN al USING (k)),
 r AS (SELECT vec_id, k, d, l, exp(l - max(l) OVER (PARTITION BY vec_id)) / sum(exp(l - (SELECT max(l) FROM l m WHERE m.vec_id = l.vec_id))) OVER (PARTITION BY vec_id) AS r FROM l)"""


@_query(f"WITH {_EM} SELECT vec_id, k, round(l, 4) AS log_likelihood, round(r, 6) AS responsibility FROM r")
def em_expectation(spark, d):
    """Log-likelihood of every vector under every class, prior included, and the responsibilities."""
    r = _responsibilities(spark, d)
    return r.select("vec_id", "k", F.round("l", 4).alias("log_likelihood"), F.round("r", 6).alias("responsibility"))


def _responsibilities(spark, d):
    from ..operators.fitting import responsibilities
    from ..operators.records import array_mean

    e = table(spark, d, "embeddings")
    means = array_mean(e, "label", "embedding", 64)
    total = e.count()
    models = means.select(F.col("label").alias("k"), F.col("mean").alias("m"), (F.col("n") / total).alias("alpha"))
    return responsibilities(e.select("vec_id", F.col("embedding").cast("array<double>").alias("v")), models, "vec_id", 0.02)


@_query(f"""WITH {_EM}, n AS (SELECT count(*) AS n FROM embeddings) SELECT k, round(sum(r) / any_value(n), 6) AS alpha, round(sum(r * d) / sum(r) / 64, 7) AS sigma2,
 round((SELECT sum(q.r * v) / sum(q.r) FROM r q JOIN e USING (vec_id) WHERE p = 1 AND q.k = r.k), 6) AS first FROM r, n GROUP BY k""")
def em_maximisation(spark, d):
    """New shares, variances and means (the first component) of the classes."""
    from ..operators.fitting import maximised

    m = maximised(_responsibilities(spark, d), "vec_id", 64)
    return m.select("k", F.round("alpha", 6).alias("alpha"), F.round("sigma2", 7).alias("sigma2"), F.round(F.col("m")[0], 6).alias("first"))


# queues of tasks


@_query("SELECT o_orderstatus AS status, count(*) AS tasks, count(DISTINCT o_custkey) AS projects, min(o_orderkey) AS oldest FROM orders GROUP BY 1")
def queue_stats(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("tasks"), F.count_distinct("o_custkey").alias("projects"), F.min("o_orderkey").alias("oldest"))


@_query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate < TIMESTAMP '1996-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def resubmit_undone(spark, d):
    """Tasks begun long ago that no result has come for."""
    o = table(spark, d, "orders").where("o_orderstatus <> 'F' and o_orderdate < timestamp_ntz '1996-01-01 00:00:00'").select("o_orderkey")
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(done, "o_orderkey", "left_anti")


@_query("SELECT event_id % 500 AS task, min(event_id) AS result FROM events GROUP BY 1")
def accept_once(spark, d):
    """The first result of a task counts, later ones are ignored."""
    return table(spark, d, "events").groupBy((F.col("event_id") % 500).alias("task")).agg(F.min("event_id").alias("result"))


@_query("""WITH w AS (SELECT c_custkey AS key, c_acctbal AS value, 0 AS turn FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 1 FROM supplier),
 l AS (SELECT key, value FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY turn DESC) = 1) SELECT key, value FROM l WHERE key % 7 <> 0""")
def key_value_store(spark, d):
    """A store's rows after two rounds of writes and a deletion: the last write of a key counts."""
    from ..sources.store import deleted, upserted

    first = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    second = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("value"))
    both = upserted(first, second, "key")
    return deleted(both, both.where("key % 7 = 0").select("key"), "key")


# filaments, frames, clusters


_DIRECTED = f"""q AS (SELECT p_partkey AS id, (p_partkey * 37 % 97)::DOUBLE AS x, (p_partkey * 101 % 89)::DOUBLE AS y, (p_partkey * 53 % 83)::DOUBLE AS z, p_size / 50.0 AS corr,
 cos(6.0 * {uniform_sql('p_partkey', 'u')}) AS ux, sin(6.0 * {uniform_sql('p_partkey', 'u')}) AS uy, 0.5::DOUBLE AS uz FROM part)"""
_ANGLE = lambda v: f"acos(greatest(-1.0, least(1.0, ((b.x-a.x)*{v}.ux + (b.y-a.y)*{v}.uy + (b.z-a.z)*{v}.uz) / (d * sqrt({v}.ux*{v}.ux + {v}.uy*{v}.uy + {v}.uz*{v}.uz)))))"


@_query(f"""WITH {_DIRECTED}, e AS (SELECT a.id, b.id AS next, b.corr, d, {_ANGLE('a')} AS beta, {_ANGLE('b')} AS gamma
  FROM (SELECT *, 1 AS one FROM q) a JOIN q b ON a.id <> b.id CROSS JOIN LATERAL (SELECT sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) AS d) WHERE d <= 16),
 s AS (SELECT id, next, round(corr * exp(-((beta-gamma)*(beta-gamma)) / 1.0) * exp(-((beta+gamma)*(beta+gamma)) / 4.0) * exp(-d*d / 400.0), 9) AS s FROM e WHERE beta <= 1.0)
 SELECT id, next, round(s, 6) AS similarity FROM s WHERE s > 0.01 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, next) = 1""")
def filament_links(spark, d):
    """Each point's most similar one ahead of its direction."""
    u = uniform(F.col("p_partkey"), "u") * 6.0
    k = F.col("p_partkey")
    at = [(k * a % m).cast("double").alias(c) for c, a, m in (("x", 37, 97), ("y", 101, 89), ("z", 53, 83))]
    p = table(spark, d, "part").select(k.alias("id"), *at, (F.col("p_size") / 50.0).alias("corr"), F.cos(u).alias("ux"), F.sin(u).alias("uy"), F.lit(0.5).alias("uz"))
    out = P.filament_links(p, reach=16.0, cone=1.0, sigmas=(1.0, 2.0, 20.0), least=0.01)
    return out.select("id", "next", F.round("similarity", 6).alias("similarity"))


_MEANS = "m AS (SELECT label, p, avg(embedding[p]::DOUBLE) AS m FROM embeddings, range(1, 65) t(p) GROUP BY ALL)"
_SCORES = f"{_MEANS}, s AS (SELECT vec_id AS record, e.label AS cluster, m.label AS template, round(sum(embedding[p]::DOUBLE * m), 9) AS score FROM embeddings e, m GROUP BY ALL)"


@_query(f"""WITH {_SCORES}, d AS (SELECT a.cluster AS a, b.template AS b, a.score - b.score AS d FROM s a JOIN s b ON a.record = b.record AND a.template = a.cluster AND b.template <> b.cluster WHERE a.score <> b.score),
 r AS (SELECT a, b, d, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2 AS r FROM d),
 w AS (SELECT a, b, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w FROM r GROUP BY ALL), z AS (SELECT *, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24) AS z FROM w)
 SELECT a, b, n, round(w, 3) AS w, round(z, 5) AS z FROM z WHERE z < 1.6448536269514722""")
def redundant_clusters(spark, d):
    """Pairs of classes whose members match the other's mean no worse than their own."""
    from ..operators.records import array_mean, dot

    e = table(spark, d, "embeddings")
    means = array_mean(e, "label", "embedding", 64).select(F.col("label").alias("template"), "mean")
    scores = e.join(F.broadcast(means), F.lit(True)).select(F.col("vec_id").alias("record"), F.col("label").alias("cluster"), "template", F.round(dot(F.col("embedding"), F.col("mean")), 9).alias("score"))
    return P.redundant_clusters(scores).select("a", "b", "n", F.round("w", 3).alias("w"), F.round("z", 5).alias("z"))


@_query(f"""WITH RECURSIVE {_MEANS}, s AS (SELECT a.label AS a, b.label AS b, round(sum(a.m * b.m), 6) AS score FROM m a JOIN m b ON a.p = b.p AND a.label < b.label GROUP BY ALL),
 c AS (SELECT a, b, row_number() OVER (ORDER BY score DESC, a, b) AS i FROM s WHERE score > 0),
 l AS (SELECT DISTINCT a AS x FROM c UNION SELECT b FROM c), start AS (SELECT map(list(x ORDER BY x), list(x ORDER BY x)) AS f FROM l),
 w AS (SELECT 0::BIGINT AS i, f FROM start UNION ALL
  SELECT c.i, map_from_entries(list_transform(map_entries(w.f), lambda e: struct_pack(k := e.key, v := CASE WHEN e.value = w.f[c.b] THEN w.f[c.a] ELSE e.value END))) FROM w JOIN c ON c.i = w.i + 1)
 SELECT unnest(map_keys(f)) AS cluster, unnest(map_values(f)) AS leader FROM w WHERE i = (SELECT max(i) FROM c)""")
def common_frames(spark, d):
    """Frames of the classes that pairs of a positive score join, best first."""
    from ..operators.records import array_mean, dot

    means = array_mean(table(spark, d, "embeddings"), "label", "embedding", 64)
    pairs = P.upper_pairs(means, "label", ["mean"]).select("a", "b", F.round(dot(F.col("mean_a"), F.col("mean_b")), 6).alias("score")).where("score > 0")
    return spark.createDataFrame(P.common_frames(pairs, "a", "b", "score"), "cluster int, leader int")


@_query("""WITH x AS (SELECT k, k / 10.0::DOUBLE - 1 AS x FROM range(21) t(k)) SELECT k, 0 AS degree, 1.0 AS p FROM x UNION ALL SELECT k, 1, round(x, 9) + 0.0 FROM x UNION ALL SELECT k, 2, round((3*x*x - 1) / 2, 9) + 0.0 FROM x
 UNION ALL SELECT k, 3, round((5*x*x*x - 3*x) / 2, 9) + 0.0 FROM x UNION ALL SELECT k, 4, round((35*x*x*x*x - 30*x*x + 3) / 8, 9) + 0.0 FROM x""")
def legendre_table(spark, d):
    """Legendre polynomials up to the fourth degree on a grid."""
    from ..functions.harmonics import legendre

    x = [k / 10.0 - 1 for k in range(21)]
    rows = [(k, n, round(float(v), 9) + 0.0) for n, row in enumerate(legendre(x, 4)) for k, v in enumerate(row)]
    return spark.createDataFrame(rows, "k long, degree int, p double")


@_query(f"""WITH {_GRID}, t AS (SELECT max(val) AS m FROM vol) SELECT x, y, z, m AS val FROM vol, t WHERE (y = {_NY // 2} AND z = {_NZ // 2} AND x >= {_NX // 2}) OR (x = {_NX // 2} AND z = {_NZ // 2} AND y >= {_NY // 2})
 OR (x = {_NX // 2 + _NX // 4} AND z = {_NZ // 2} AND y >= {_NY // 2 - _NY // 4} AND y < {_NY // 2 + _NY // 4})""")
def highlight_axes(spark, d):
    """The voxels that mark the positive x and y axes, at the greatest value."""
    t = _full(spark, d)
    top = t.agg(F.max("val").alias("m"))
    x, y, z = (F.col(a) for a in "xyz")
    mid = z == _NZ // 2
    marks = ((y == _NY // 2) & mid & (x >= _NX // 2)) | ((x == _NX // 2) & mid & (y >= _NY // 2))
    bar = (x == _NX // 2 + _NX // 4) & mid & (y >= _NY // 2 - _NY // 4) & (y < _NY // 2 + _NY // 4)
    return t.where(marks | bar).join(F.broadcast(top), F.lit(True)).select("x", "y", "z", F.col("m").alias("val"))
