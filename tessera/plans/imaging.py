"""Queries of image formation, local correlation, prototypes and point groups, and SQL with the same results."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import imaging as I
from . import analysis
from .analysis import _GRID, SHAPE, _table, _tomogram

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_WAVE = "sqrt(150.4 / (300000.0 * (1 + 300000.0 / 1022000.0))) * 1e-10"
_CTF = f"""WITH k AS (SELECT {_WAVE} AS l, 1 / (2e-9 * 0.72) AS q),
r AS (SELECT x::INT AS x, y::INT AS y, z::INT AS z, l, q, (x*(q/8)-q)*(x*(q/8)-q) + (y*(q/8)-q)*(y*(q/8)-q) + (z*(q/8)-q)*(z*(q/8)-q) AS r2
      FROM k, range(16) a(x), range(16) b(y), range(16) c(z)),
p AS (SELECT x, y, z, pi() / 2 * (2e-3 * l*l*l * r2*r2 + 1.2e-5 * l * r2) AS phase, exp(-r2 / (0.4*0.4*q*q)) AS e FROM r)
SELECT x, y, z, round(sin(phase) * e, 6) + 0.0::DOUBLE AS ctf, round(cos(phase) * e, 6) + 0.0::DOUBLE AS amplitude FROM p"""


@_query(_CTF)
def ctf_grid(spark, d):
    c = I.contrast_transfer(spark, (16, 16, 16), -6.0, sigma=0.4)
    return c.select("x", "y", "z", (F.round("ctf", 6) + 0.0).alias("ctf"), (F.round("amplitude", 6) + 0.0).alias("amplitude"))


#: A template of seven voxels: a bright middle and one heavier arm.
TEMPLATE = {(0, 0, 0): 4.0, (1, 0, 0): 2.0, (-1, 0, 0): 1.0, (0, 1, 0): 1.0, (0, -1, 0): 1.0, (0, 0, 1): 1.0, (0, 0, -1): 0.5}
_MEAN = sum(TEMPLATE.values()) / len(TEMPLATE)
_STD = math.sqrt(sum((v - _MEAN) ** 2 for v in TEMPLATE.values()) / len(TEMPLATE))
_ARMS = "o(i, j, k, w) AS (VALUES " + ", ".join(f"({i}, {j}, {k}, {(v - _MEAN) / _STD!r}::DOUBLE)" for (i, j, k), v in TEMPLATE.items()) + ")"
_AT = f"m.x = (v.x + i + {SHAPE[0]}) % {SHAPE[0]} AND m.y = (v.y + j + {SHAPE[1]}) % {SHAPE[1]} AND m.z = (v.z + k + {SHAPE[2]}) % {SHAPE[2]}"


@_query(f"""WITH {_GRID}, {_ARMS}, l AS (SELECT v.x, v.y, v.z, any_value(v.val) AS val, sum(m.val / 7) AS mean, sum(m.val * m.val / 7) AS sq FROM vol v CROSS JOIN o JOIN vol m ON {_AT} GROUP BY ALL),
s AS (SELECT x, y, z, CASE WHEN sq - mean * mean > 0 THEN (val - mean) / sqrt(sq - mean * mean) ELSE val - mean END AS val FROM l),
c AS (SELECT v.x, v.y, v.z, round(sum(m.val * w), 4) AS cor FROM vol v CROSS JOIN o JOIN s m ON {_AT} GROUP BY ALL) SELECT * FROM c WHERE cor <> 0""")
def masked_correlation(spark, d):
    c = I.masked_correlation(_tomogram(spark, d), SHAPE, TEMPLATE)
    return c.select("x", "y", "z", F.round("cor", 4).alias("cor")).where("cor <> 0")


@_query(f"WITH {_GRID}, o AS (SELECT i::INT AS i, j::INT AS j, k::INT AS k FROM range(-1, 2) a(i), range(-1, 2) b(j), range(-1, 2) c(k) WHERE i <> 0 OR j <> 0 OR k <> 0) SELECT m.x, m.y, m.z, i AS dx, j AS dy, k AS dz, v.val * m.val AS product FROM vol v CROSS JOIN o JOIN vol m ON {_AT} WHERE v.val * m.val <> 0")
def neighbor_product(spark, d):
    return I.neighbour_products(_tomogram(spark, d), SHAPE).drop("vol_id")


@_query()
def surface_strength(spark, d):
    return I.surface_strength(_tomogram(spark, d), SHAPE).select("x", "y", "z", (F.round("strength", 3) + 0.0).alias("strength"))


@_query("""WITH e AS (SELECT vec_id, label, pos, embedding[pos]::DOUBLE AS v FROM embeddings, range(1, 65) p(pos)), c AS (SELECT label, pos, avg(v) AS c FROM e GROUP BY ALL),
d AS (SELECT vec_id, c.label, sum((v - c) * (v - c)) AS distance FROM e JOIN c USING (pos) GROUP BY vec_id, c.label)
SELECT vec_id, label, round(distance, 5) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, label) = 1""")
def prototype_nearest(spark, d):
    """Class means of all rows as prototypes, all rows as queries."""
    e = _table(spark, d, "embeddings")
    n = I.nearest_prototype(e, I.prototypes(e, "label", "embedding", 64), "vec_id", "label", "embedding")
    return n.select("vec_id", "label", F.round("distance", 5).alias("distance"))


_POINTS = "q AS (SELECT p_brand, p_partkey * 37 % 211 AS x, p_partkey * 101 % 223 AS y, p_partkey * 53 % 227 AS z FROM part)"


@_query(f"WITH {_POINTS}, c AS (SELECT *, count(*) OVER w AS n, avg(x) OVER w AS cx, avg(y) OVER w AS cy, avg(z) OVER w AS cz FROM q WINDOW w AS (PARTITION BY p_brand)) SELECT p_brand, n, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, round(max(sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz))), 6) AS radius FROM c GROUP BY p_brand, n, cx, cy, cz")
def bounding_sphere(spark, d):
    k = F.col("p_partkey")
    s = I.bounding_spheres(_table(spark, d, "part").select("p_brand", (k * 37 % 211).alias("x"), (k * 101 % 223).alias("y"), (k * 53 % 227).alias("z")), "p_brand")
    return s.select("p_brand", "n", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "cz", "radius")])


def _axis(name: str, n: int) -> str:
    return f"t{name} AS (SELECT i::INT AS i{name}, i * 8 AS low{name}, least(i * 8 + 12, {n}) AS high{name} FROM range({max(1, -(-(n - 4) // 8))}) r(i))"


@_query(f"WITH {_GRID}, {', '.join(_axis(a, n) for a, n in zip('xyz', SHAPE))} SELECT x, y, z, sum(val * (1 + ix + iy + iz)) AS score FROM vol JOIN tx ON x >= lowx AND x < highx JOIN ty ON y >= lowy AND y < highy JOIN tz ON z >= lowz AND z < highz WHERE val <> 0 GROUP BY ALL")
def merge_scores(spark, d):
    return I.merged_tiles(_tomogram(spark, d), SHAPE, 8, 4, F.col("val") * (1 + F.col("i0") + F.col("i1") + F.col("i2"))).drop("vol_id")


@_query("WITH e AS (SELECT vec_id, embedding[1:3]::DOUBLE[] AS a, embedding[4:6]::DOUBLE[] AS b FROM embeddings) SELECT vec_id, round(acos(greatest(-1.0, least(1.0, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))))), 6) AS angle FROM e")
def vector_angle(spark, d):
    e = F.col("embedding")
    return _table(spark, d, "embeddings").select("vec_id", F.round(I.angle_between(F.slice(e, 1, 3), F.slice(e, 4, 3)), 6).alias("angle"))


@_query("SELECT p_brand, CASE WHEN i > 0 AND m < 1 THEN ceil(ln(1 - 0.99::DOUBLE) / ln(m))::BIGINT END AS trials FROM (SELECT p_brand, count(*) FILTER (p_size < 20) AS i, greatest(2.220446049250313e-16, 1 - pow(count(*) FILTER (p_size < 20) / count(*), 4.0::DOUBLE)) AS m FROM part GROUP BY p_brand)")
def ransac_trials(spark, d):
    by = _table(spark, d, "part").groupBy("p_brand").agg(F.sum((F.col("p_size") < 20).cast("long")).alias("i"), F.count("*").alias("n"))
    return by.select("p_brand", I.ransac_trials(F.col("i"), F.col("n"), 4, 0.99).alias("trials"))


@_query()
def distortion_index(spark, d):
    return spark.createDataFrame([(round(I.distortion_index(_table(spark, d, "embeddings"), "label", "embedding", 64, ridge=1e-2), 6),)], "ddbi double")


def queries() -> dict:
    return {**analysis.QUERIES, **QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**analysis.SQL, **SQL}
