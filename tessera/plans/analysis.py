"""Queries of scores, agreement measures, spectra, regions, boxes and records, and SQL with the same results.

Carriers are those of catalog.py; boxes and spheres come from `part`, probabilities from lengths of labelled documents.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import records as R
from ..operators import regions as G
from ..operators import statistics as S
from ..operators import voxel as V

SHAPE = (31, 24, 16)


def _table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _tomogram(spark, d: str) -> DataFrame:
    from .catalog import tomogram

    return tomogram(spark, d)


def _full(spark, d: str) -> DataFrame:
    """The tomogram with its zeros."""
    n = SHAPE[0] * SHAPE[1] * SHAPE[2]
    grid = spark.range(n).select(F.floor(F.col("id") / (SHAPE[1] * SHAPE[2])).cast("int").alias("x"), (F.floor(F.col("id") / SHAPE[2]) % SHAPE[1]).cast("int").alias("y"), (F.col("id") % SHAPE[2]).cast("int").alias("z"))
    return grid.join(_tomogram(spark, d).drop("vol_id"), ["x", "y", "z"], "left").fillna(0.0, "val")


def _labelled(spark, d: str) -> DataFrame:
    """Documents' quality with a made-up probability of it, by length."""
    docs = _table(spark, d, "documents").select("doc_id", "n_chars")
    return _table(spark, d, "labels").join(docs, "doc_id").withColumn("p", F.col("n_chars") / (F.col("n_chars") + 1000))


def _boxes(spark, d: str) -> DataFrame:
    p = _table(spark, d, "part")
    x, y = (F.col("p_partkey") * 37 % 997).cast("double"), (F.col("p_partkey") * 101 % 991).cast("double")
    return p.select(F.col("p_partkey").alias("id"), x.alias("x1"), y.alias("y1"), (x + F.col("p_size") + 5).alias("x2"), (y + F.col("p_size") + 5).alias("y2"), F.col("p_retailprice").alias("score"))


_GRID = f"""
sparse AS (SELECT day(ts) - 1 AS x, hour(ts) AS y, (user_id % 16)::INT AS z, count(*)::DOUBLE AS val FROM events GROUP BY ALL),
vol AS (SELECT x::INT AS x, y::INT AS y, z::INT AS z, coalesce(val, 0)::DOUBLE AS val
        FROM range({SHAPE[0]}) a(x) CROSS JOIN range({SHAPE[1]}) b(y) CROSS JOIN range({SHAPE[2]}) c(z) LEFT JOIN sparse USING (x, y, z))"""
_LABELLED = "l AS (SELECT doc_id, quality, n_chars, n_chars / (n_chars + 1000)::DOUBLE AS p FROM labels JOIN documents USING (doc_id))"
_BOXES = "b AS (SELECT p_partkey AS id, (p_partkey * 37 % 997)::DOUBLE AS x1, (p_partkey * 101 % 991)::DOUBLE AS y1, x1 + p_size + 5 AS x2, y1 + p_size + 5 AS y2, p_retailprice AS score FROM part)"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# scores and agreement


@_query(f"WITH {_LABELLED}, r AS (SELECT p, sum(quality) AS q, count(*) AS n FROM l GROUP BY p), w AS (SELECT q, sum(q) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS k, sum(q) OVER () AS t FROM r) SELECT round(sum(tp / k * q / t), 6) AS auprc FROM w")
def auprc(spark, d):
    return S.average_precision(_labelled(spark, d), "p", "quality").select(F.round("auprc", 6).alias("auprc"))


@_query(f"WITH {_LABELLED}, s AS (SELECT sum(p * quality) / sum(p) AS precision, sum(p * quality) / sum(quality) AS recall, sum(p * (1 - quality)) / sum(1 - quality) AS fpr FROM l) SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM s")
def soft_scores(spark, d):
    s = S.soft_scores(_labelled(spark, d), F.col("p"), F.col("quality"))
    return s.select(*(F.round(c, 6).alias(c) for c in s.columns))


@_query("WITH m AS (SELECT o_orderpriority, o_totalprice > 100000 AS a, year(o_orderdate) > 1994 AS b FROM orders), s AS (SELECT o_orderpriority, count(*) FILTER (a AND b) AS i, count(*) FILTER (a) AS a, count(*) FILTER (b) AS b FROM m GROUP BY 1) SELECT o_orderpriority, round(2 * i / (a + b), 6) AS dice, round(i / (a + b - i), 6) AS iou FROM s")
def dice_iou(spark, d):
    o = S.overlap(_table(spark, d, "orders"), "o_orderpriority", F.col("o_totalprice") > 100000, F.year("o_orderdate") > 1994)
    return o.select("o_orderpriority", F.round("dice", 6).alias("dice"), F.round("iou", 6).alias("iou"))


@_query("WITH v AS (SELECT o_orderstatus = 'F' AS one, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS r FROM orders) SELECT count(*) FILTER (one) AS n1, count(*) FILTER (NOT one) AS n2, sum(r) FILTER (one) - count(*) FILTER (one) * (count(*) FILTER (one) + 1) / 2 AS u FROM v")
def mann_whitney(spark, d):
    return S.mann_whitney(_table(spark, d, "orders"), "o_totalprice", F.col("o_orderstatus") == "F")


@_query("WITH v AS (SELECT embedding[1]::DOUBLE - embedding[2]::DOUBLE AS d FROM embeddings), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM v WHERE d <> 0) SELECT count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (d < 0), 0)::DOUBLE AS w_minus FROM r")
def wilcoxon(spark, d):
    e = _table(spark, d, "embeddings")
    return S.wilcoxon(e, F.col("embedding")[0].cast("double") - F.col("embedding")[1].cast("double"))


@_query("SELECT o_orderkey, round(sum(o_totalprice - m) OVER (ORDER BY o_orderkey) / sum(o_totalprice - m) OVER (), 6) AS share FROM (SELECT o_orderkey, o_totalprice, min(o_totalprice) OVER () AS m FROM orders)")
def roulette_ecdf(spark, d):
    return S.cumulative_share(_table(spark, d, "orders"), "o_orderkey", "o_totalprice").select("o_orderkey", F.round("share", 6).alias("share"))


@_query("WITH d AS (SELECT a.l_returnflag, a.l_quantity AS u, a.l_extendedprice / 1000 AS v FROM lineitem a) SELECT l_returnflag, round(avg((u - v) * (u - v)), 6) AS mse, round(sum((u - v) * (u - v)) / sum(u * u), 6) AS nmse, round(10 * log10(max(u) * max(u) / avg((u - v) * (u - v))), 6) AS psnr FROM d GROUP BY 1")
def image_errors(spark, d):
    t = _table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("u"), (F.col("l_extendedprice") / 1000).alias("v"))
    square = (F.col("u") - F.col("v")) * (F.col("u") - F.col("v"))
    return t.groupBy("l_returnflag").agg(F.round(F.avg(square), 6).alias("mse"), F.round(F.sum(square) / F.sum(F.col("u") * F.col("u")), 6).alias("nmse"), F.round(10 * F.log10(F.max("u") * F.max("u") / F.avg(square)), 6).alias("psnr"))


@_query("SELECT label, round(avg((sqrt(dd) <= 4)::INT), 6) AS pck, round(avg(sqrt(dd)), 6) AS mean_dist FROM (SELECT label, list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - m[i]) * (embedding[i]::DOUBLE - m[i]))) AS dd FROM embeddings JOIN (SELECT label, list(a ORDER BY pos) AS m FROM (SELECT label, pos, avg(embedding[pos]::DOUBLE) AS a FROM embeddings, range(1, 65) p(pos) GROUP BY ALL) GROUP BY label) USING (label)) GROUP BY label")
def landmark_pck(spark, d):
    """Distance of every embedding to its class mean: share within 4, and mean."""
    e = _table(spark, d, "embeddings")
    at = e.join(F.broadcast(R.array_mean(e, "label", "embedding", 64).select("label", "mean")), "label").withColumn("dist", F.sqrt(R.square_distance(F.col("embedding"), F.col("mean"))))
    return at.groupBy("label").agg(F.round(F.avg((F.col("dist") <= 4).cast("int")), 6).alias("pck"), F.round(F.avg("dist"), 6).alias("mean_dist"))


# moments and spectra


@_query("WITH e AS (SELECT vec_id, label, pos, embedding[pos + 1]::DOUBLE AS v FROM embeddings, range(64) p(pos) WHERE label IN (0, 1)), c AS (SELECT a.label, a.pos AS i, b.pos AS j, covar_samp(a.v, b.v) AS c FROM e a JOIN e b USING (vec_id) GROUP BY a.label, a.pos, b.pos) SELECT round(sqrt(sum((x.c - y.c) * (x.c - y.c))) / 4 / 64 / 64, 8) AS coral FROM c x JOIN c y USING (i, j) WHERE x.label = 0 AND y.label = 1")
def coral(spark, d):
    return S.coral(_table(spark, d, "embeddings"), "label", 0, 1, "embedding", 64).select(F.round("coral", 8).alias("coral"))


@_query("SELECT l_returnflag, round(2 * r / (1 - r), 6) AS snr FROM (SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1)")
def empirical_snr(spark, d):
    r = _table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.corr("l_quantity", "l_extendedprice").alias("r"))
    return r.select("l_returnflag", F.round(F.try_divide(2 * F.col("r"), 1 - F.col("r")), 6).alias("snr"))


_DFT = """WITH pos AS (SELECT p, p // 16 AS x, p // 4 % 4 AS y, p % 4 AS z FROM range(64) t(p)),
 e AS (SELECT vec_id, label, p, embedding[p + 1]::DOUBLE AS v FROM embeddings, range(64) t(p)),
 w AS (SELECT k.p AS k, s.p AS p, cos(-2 * pi() * ((k.x - 2) * s.x + (k.y - 2) * s.y + (k.z - 2) * s.z) / 4) AS c, sin(-2 * pi() * ((k.x - 2) * s.x + (k.y - 2) * s.y + (k.z - 2) * s.z) / 4) AS s, sqrt((k.x - 2) ** 2 + (k.y - 2) ** 2 + (k.z - 2) ** 2) AS rad FROM pos k, pos s),
 f AS (SELECT vec_id, label, k, rad, sum(v * c) AS re, sum(v * s) AS im FROM e JOIN w USING (p) GROUP BY ALL),
 g AS (SELECT label, k, rad, count(*) AS n, avg(re) ** 2 + avg(im) ** 2 AS a, (sum(re * re + im * im) - count(*) * (avg(re) ** 2 + avg(im) ** 2)) / (count(*) - 1) AS v FROM f GROUP BY ALL HAVING count(*) >= 2),
 h AS (SELECT label, r::INT AS r, CASE WHEN sum(v) > 0 THEN sum(a) / sum(v / n) ELSE 0 END AS s FROM g, range(3) t(r) WHERE abs(rad - r) <= 1.0 GROUP BY ALL)
 SELECT label, r, round(s, 5) AS ssnr, round(s / (2 + s), 5) AS fsc FROM h"""


@_query(_DFT)
def spectral_snr(spark, d):
    s = S.spectral_snr(_table(spark, d, "embeddings"), "label", "embedding", (4, 4, 4))
    return s.select("label", "r", F.round("ssnr", 5).alias("ssnr"), F.round("fsc", 5).alias("fsc"))


@_query()
def principal_variances(spark, d):
    values, _ = S.principal_axes(_table(spark, d, "embeddings"), "embedding", 64, 8)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "axis int, variance double")


_SMOOTHED = [0.05, 0.25, 0.4, 0.25, 0.05]


@_query("WITH e AS (SELECT label, embedding[1]::DOUBLE AS v, (row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) - 1)::INT AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings), w(o, w) AS (VALUES (-2, 0.05::DOUBLE), (-1, 0.25::DOUBLE), (0, 0.4::DOUBLE), (1, 0.25::DOUBLE), (2, 0.05::DOUBLE)) SELECT a.label, a.i AS rank, round(sum(b.v * w), 6) AS v FROM e a CROSS JOIN w JOIN e b ON b.label = a.label AND b.i = CASE WHEN a.i + o < 0 THEN -(a.i + o) - 1 WHEN a.i + o >= a.n THEN 2 * a.n - 1 - a.i - o ELSE a.i + o END GROUP BY a.label, a.i")
def rank_smooth(spark, d):
    e = _table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("v"))
    return S.smooth_by_rank(e, "label", [F.desc("v"), F.asc("vec_id")], "v", _SMOOTHED).select("label", "rank", F.round("v", 6).alias("v"))


# volumes


@_query("WITH RECURSIVE v AS (SELECT (day(ts) - 1)::INT AS x, hour(ts)::INT AS y, (user_id % 16)::INT AS z FROM events GROUP BY ALL HAVING count(*) >= 3), m AS (SELECT *, (x * 384 + y * 16 + z)::BIGINT AS id FROM v WHERE x < 30), r(x, y, z, id) AS (SELECT x, y, z, id FROM m UNION SELECT m.x, m.y, m.z, r.id FROM r JOIN m ON abs(r.x - m.x) + abs(r.y - m.y) + abs(r.z - m.z) = 1) SELECT x, y, z, min(id) AS region FROM r GROUP BY x, y, z")
def connected_regions(spark, d):
    return G.connected_regions(_tomogram(spark, d).where("val >= 3"), SHAPE, tile=8).drop("vol_id")


@_query("WITH RECURSIVE v AS (SELECT (day(ts) - 1)::INT AS x, hour(ts)::INT AS y, (user_id % 16)::INT AS z FROM events GROUP BY ALL HAVING count(*) >= 3), m AS (SELECT *, (x * 384 + y * 16 + z)::BIGINT AS id FROM v WHERE x < 30), r(x, y, z, id) AS (SELECT x, y, z, id FROM m UNION SELECT m.x, m.y, m.z, r.id FROM r JOIN m ON abs(r.x - m.x) + abs(r.y - m.y) + abs(r.z - m.z) = 1), g AS (SELECT x, y, z, min(id) AS region FROM r GROUP BY x, y, z) SELECT region, count(*) AS n FROM g GROUP BY region ORDER BY n DESC, region LIMIT 1")
def largest_region(spark, d):
    g = G.connected_regions(_tomogram(spark, d).where("val >= 3"), SHAPE, tile=8)
    return g.groupBy("region").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "region").limit(1)


def _diffusion_sql() -> str:
    last, out = "vol", []
    for k in range(2):
        lead = ", ".join(f"coalesce(lead(val) OVER (PARTITION BY {p} ORDER BY {a}) - val, 0) AS d{a}" for a, p in (("x", "y, z"), ("y", "x, z"), ("z", "x, y")))
        flow = ", ".join(f"d{a} * exp(-(d{a} / 3) * (d{a} / 3)) AS f{a}" for a in "xyz")
        lag = " + ".join(f"f{a} - coalesce(lag(f{a}) OVER (PARTITION BY {p} ORDER BY {a}), 0)" for a, p in (("x", "y, z"), ("y", "x, z"), ("z", "x, y")))
        out += [f"d{k} AS (SELECT *, {lead} FROM {last})", f"f{k} AS (SELECT *, {flow} FROM d{k})", f"s{k} AS (SELECT x, y, z, val + 0.1::DOUBLE * ({lag}) AS val FROM f{k})"]
        last = f"s{k}"
    return f"WITH {_GRID}, {', '.join(out)} SELECT x, y, z, round(val, 6) + 0.0::DOUBLE AS val FROM {last}"


@_query(_diffusion_sql())
def diffuse(spark, d):
    return G.diffuse(_tomogram(spark, d), SHAPE, 2, 3.0, 0.1, rounded=6).drop("vol_id")


@_query(f"WITH {_GRID}, p AS (SELECT * FROM vol WHERE val >= 4) SELECT DISTINCT v.x, v.y, v.z FROM vol v JOIN p ON (v.x-p.x)*(v.x-p.x) + (v.y-p.y)*(v.y-p.y) + (v.z-p.z)*(v.z-p.z) <= 4")
def particles_mask(spark, d):
    return G.balls(SHAPE, _tomogram(spark, d).where("val >= 4"), 2.0).drop("vol_id")


@_query(f"WITH {_GRID}, m AS (SELECT x // 10 AS i, y // 8 AS j, z // 8 AS k, (val >= 2)::INT AS t FROM vol) SELECT i::INT AS i, j::INT AS j, k::INT AS k, round(avg(t), 8) AS positive FROM m GROUP BY ALL")
def positive_fraction(spark, d):
    cells = (F.floor(F.col(a) / n).cast("int").alias(i) for a, n, i in zip("xyz", (10, 8, 8), "ijk"))
    return _full(spark, d).groupBy(*cells).agg(F.round(F.avg((F.col("val") >= 2).cast("int")), 8).alias("positive"))


@_query(f"WITH {_GRID}, p AS (SELECT x * 384 + y * 16 + z AS peak, x, y, z FROM vol WHERE val >= 4 AND x >= 2 AND x <= {SHAPE[0] - 2} AND y >= 2 AND y <= 22 AND z >= 2 AND z <= 14) SELECT peak::BIGINT AS peak, (o.x * 16 + o.y * 4 + o.z)::INT AS pos, v.val FROM p, (SELECT a AS x, b AS y, c AS z FROM range(4) q(a), range(4) r(b), range(4) s(c)) o JOIN vol v ON v.x = p.x - 2 + o.x AND v.y = p.y - 2 + o.y AND v.z = p.z - 2 + o.z")
def peaks_to_subvolumes(spark, d):
    t = _tomogram(spark, d)
    peaks = t.where("val >= 4").select("vol_id", (F.col("x") * 384 + F.col("y") * 16 + F.col("z")).cast("long").alias("peak"), "x", "y", "z")
    return G.subvolumes(t, SHAPE, peaks, 4).select("peak", F.posexplode("data").alias("pos", "val"))


@_query(f"WITH {_GRID} SELECT round(sum(x * val) / sum(val), 6) AS x, round(sum(y * val) / sum(val), 6) AS y, round(sum(z * val) / sum(val), 6) AS z FROM vol")
def center_of_mass(spark, d):
    return _tomogram(spark, d).agg(*(F.round(F.sum(F.col(a) * F.col("val")) / F.sum("val"), 6).alias(a) for a in "xyz"))


_AXES_SQL = f"""WITH {_GRID}, c AS (SELECT sum(x * val) / sum(val) AS x, sum(y * val) / sum(val) AS y, sum(z * val) / sum(val) AS z FROM vol),
 m AS (SELECT sum(val * (v.x - c.x) ** 2) AS xx, sum(val * (v.y - c.y) ** 2) AS yy, sum(val * (v.z - c.z) ** 2) AS zz, sum(val * (v.x - c.x) * (v.y - c.y)) AS xy, sum(val * (v.x - c.x) * (v.z - c.z)) AS xz, sum(val * (v.y - c.y) * (v.z - c.z)) AS yz FROM vol v, c)
 SELECT round(xx, 4) AS xx, round(yy, 4) AS yy, round(zz, 4) AS zz, round(xy, 4) AS xy, round(xz, 4) AS xz, round(yz, 4) AS yz FROM m"""


@_query(_AXES_SQL)
def pose_scatter(spark, d):
    """Scatter of the mass about its centre, whose eigenvectors are the pose's axes."""
    t = _tomogram(spark, d)
    c = t.agg(*((F.sum(F.col(a) * F.col("val")) / F.sum("val")).alias(f"c{a}") for a in "xyz"))
    u = {a: F.col(a) - F.col(f"c{a}") for a in "xyz"}
    return t.join(F.broadcast(c), F.lit(True)).agg(*(F.round(F.sum(F.col("val") * u[p[0]] * u[p[1]]), 4).alias(p) for p in ("xx", "yy", "zz", "xy", "xz", "yz")))


@_query(f"WITH {_GRID}, m AS (SELECT x, y, sum(val) AS v FROM vol GROUP BY x, y), s AS (SELECT i, j, stddev_pop(v) AS s FROM m, range(14) a(i), range(11) b(j) WHERE x BETWEEN 2 * i AND 2 * i + 3 AND y BETWEEN 2 * j AND 2 * j + 3 GROUP BY i, j) SELECT round(stddev_pop(s), 6) AS diversity FROM s")
def diversity_score(spark, d):
    """Spread of the spreads of overlapping 4 x 4 patches of the image summed over z."""
    image = _full(spark, d).groupBy("x", "y").agg(F.sum("val").alias("v"))
    for a, i, n in (("x", "i", 14), ("y", "j", 11)):
        first, last = F.greatest(F.ceil((F.col(a) - 3) / 2), F.lit(0)), F.least(F.floor(F.col(a) / 2), F.lit(n - 1))
        image = image.where(first <= last).withColumn(i, F.explode(F.sequence(first, last)))
    return image.groupBy("i", "j").agg(F.stddev_pop("v").alias("s")).agg(F.round(F.stddev_pop("s"), 6).alias("diversity"))


@_query(f"WITH {_GRID}, s AS (SELECT min(val) AS lo, (max(val) - min(val)) / 6 AS w FROM vol) SELECT (x // 10)::INT AS region, least(floor((val - lo) / w), 5)::INT AS bin, count(*) AS n FROM vol, s GROUP BY ALL")
def density_histogram(spark, d):
    t = _full(spark, d)
    s = t.agg(F.min("val").alias("lo"), ((F.max("val") - F.min("val")) / 6).alias("w"))
    return t.join(F.broadcast(s), F.lit(True)).groupBy(F.floor(F.col("x") / 10).cast("int").alias("region"), F.least(F.floor((F.col("val") - F.col("lo")) / F.col("w")), F.lit(5)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@_query("WITH r AS (SELECT vec_id, avg((embedding[p]::DOUBLE > 0.1)::INT) AS r FROM embeddings, range(1, 65) t(p) GROUP BY vec_id) SELECT vec_id, (p - 1)::INT AS pos, round(CASE WHEN r < 0.45 THEN 1 - embedding[p]::DOUBLE ELSE embedding[p]::DOUBLE END, 6) AS val FROM embeddings JOIN r USING (vec_id), range(1, 65) t(p)")
def conditional_invert(spark, d):
    e = _table(spark, d, "embeddings").withColumn("e", F.transform("embedding", lambda x: x.cast("double")))
    bright = F.size(F.filter("e", lambda x: x > 0.1)) / F.size("e")
    out = F.when(bright < 0.45, F.transform("e", lambda x: 1 - x)).otherwise(F.col("e"))
    return e.select("vec_id", F.posexplode(F.transform(out, lambda x: F.round(x, 6))).alias("pos", "val"))


def _wedge(x0: str, x1: str, angle: float) -> str:
    t = f"CAST({math.tan(math.radians(angle))!r} AS DOUBLE) * {x1}"
    return f"(({x0} >= {t} AND {x0} >= -{t}) OR ({x0} <= -{t} AND {x0} <= {t}))"


@_query(f"SELECT x::INT AS x, y::INT AS y, z::INT AS z FROM range(32) a(x), range(32) b(y), range(32) c(z) WHERE {_wedge('(x - 16)', '(z - 16)', 30.0)}")
def wedge_mask(spark, d):
    """Voxels of a 32-cube outside a missing wedge of 30 degrees about the y axis."""
    grid = spark.range(32**3).select(F.floor(F.col("id") / 1024).cast("int").alias("x"), (F.floor(F.col("id") / 32) % 32).cast("int").alias("y"), (F.col("id") % 32).cast("int").alias("z"))
    return grid.where(_wedge("(x - 16)", "(z - 16)", 30.0))


# boxes, points and clusters


@_query(f"WITH {_BOXES}, p AS (SELECT a.id AS a, c.id AS b, greatest(least(a.x2, c.x2) - greatest(a.x1, c.x1), 0) * greatest(least(a.y2, c.y2) - greatest(a.y1, c.y1), 0) AS i, (a.x2-a.x1)*(a.y2-a.y1) + (c.x2-c.x1)*(c.y2-c.y1) AS s FROM b a JOIN b c ON a.id < c.id AND a.x1 < c.x2 AND c.x1 < a.x2 AND a.y1 < c.y2 AND c.y1 < a.y2) SELECT a, b, round(i / (s - i), 6) AS iou FROM p WHERE i / (s - i) > 0.3")
def box_iou(spark, d):
    return G.box_pairs(_boxes(spark, d), 0.3, 55.0, 6)


def _greedy_boxes() -> str:
    from .pairs import greedy_sql

    inner = "greatest(0, least(k.x2, r.x2) - greatest(k.x1, r.x1)) * greatest(0, least(k.y2, r.y2) - greatest(k.y1, r.y1))"
    areas = "(k.x2 - k.x1) * (k.y2 - k.y1) + (r.x2 - r.x1) * (r.y2 - r.y1)"
    rank = "SELECT row_number() OVER (ORDER BY score DESC, id) AS i, id, x1, y1, x2, y2 FROM b"
    return f"WITH RECURSIVE {_BOXES}, " + greedy_sql(rank, f"{inner} / ({areas} - {inner}) > 0.3", "x1, y1, x2, y2") + " SELECT id FROM kept"


@_query(_greedy_boxes())
def box_suppression(spark, d):
    return G.suppressed(_boxes(spark, d), 0.3, 55.0)


def _lloyd_sql(rounds: int) -> str:
    dist = "list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - m[i]) * (embedding[i]::DOUBLE - m[i])))"
    out = ["c0 AS (SELECT label AS k, list_transform(embedding, lambda x: x::DOUBLE) AS m FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1)"]
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, embedding, k FROM (SELECT vec_id, embedding, k, {dist} AS dd FROM embeddings, c{r}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dd, k) = 1)")
        if r < rounds:
            out.append(f"n{r} AS (SELECT k, list(v ORDER BY p) AS m FROM (SELECT k, p, avg(embedding[p]::DOUBLE) AS v FROM a{r}, range(1, 65) t(p) GROUP BY ALL) GROUP BY k), c{r + 1} AS (SELECT k, coalesce(n{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN n{r} USING (k))")
    return f"WITH {', '.join(out)} SELECT vec_id, k::INT AS cluster FROM a{rounds}"


@_query(_lloyd_sql(2))
def kmeans(spark, d):
    e = _table(spark, d, "embeddings")
    seeds = R.first_of(e.select("label", "vec_id", "embedding"), "label", "vec_id").orderBy("label").collect()  # one row a class
    return G.lloyd(e, [[float(x) for x in r["embedding"]] for r in seeds], 2, "vec_id", "embedding")[0]


@_query("WITH c AS (SELECT label AS k, list(v ORDER BY p) AS m FROM (SELECT label, p, avg(embedding[p]::DOUBLE) AS v FROM embeddings, range(1, 65) t(p) GROUP BY ALL) GROUP BY label), l AS (SELECT vec_id, k, -list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - m[i]) * (embedding[i]::DOUBLE - m[i]))) / 2 AS l FROM embeddings, c), e AS (SELECT vec_id, k, exp(l - max(l) OVER (PARTITION BY vec_id)) AS e FROM l) SELECT vec_id, k AS label, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS p FROM e")
def mixture_responsibilities(spark, d):
    """Each cube's share of every class under unit-variance Gaussians, by log-sum-exp within the row."""
    e = _table(spark, d, "embeddings")
    means = R.array_mean(e, "label", "embedding", 64).agg(F.array_sort(F.collect_list(F.struct("label", "mean"))).alias("means"))  # one row a class
    at = e.select("vec_id", "embedding").join(F.broadcast(means), F.lit(True)).withColumn("l", F.transform("means", lambda m: -R.square_distance(F.col("embedding"), m["mean"]) / 2))
    at = at.withColumn("e", F.transform("l", lambda x: F.exp(x - F.array_max("l")))).withColumn("s", F.aggregate("e", F.lit(0.0), lambda s, x: s + x))
    pairs = F.transform("means", lambda m, i: F.struct(m["label"].alias("label"), F.round(F.get("e", i) / F.col("s"), 6).alias("p")))
    return at.select("vec_id", F.explode(pairs).alias("r")).select("vec_id", "r.label", "r.p")


@_query("""WITH RECURSIVE m AS (SELECT DISTINCT o_orderpriority AS cluster, o_custkey AS id FROM orders),
 o AS (SELECT o_orderpriority AS cluster, row_number() OVER (ORDER BY avg(o_totalprice) DESC, o_orderpriority) AS i FROM orders GROUP BY 1),
 l AS (SELECT cluster, i, list(id) AS ids FROM m JOIN o USING (cluster) GROUP BY ALL),
 w AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS seen, NULL::VARCHAR AS cluster, 0::BIGINT AS taken UNION ALL
  SELECT l.i, CASE WHEN ok THEN list_distinct(list_concat(seen, ids)) ELSE seen END, CASE WHEN ok THEN l.cluster END, taken + ok::BIGINT
  FROM (SELECT w.*, l.cluster AS name, l.i AS j, len(list_intersect(ids, seen)) / len(ids) <= 0.9 AS ok FROM w JOIN l ON l.i = w.i + 1) w JOIN l ON l.i = j)
 SELECT (taken - 1)::INT AS place, cluster FROM w WHERE cluster IS NOT NULL""")
def cluster_cover(spark, d):
    """Order priorities taken by their mean price, each if at most 0.9 of its customers are covered."""
    o = _table(spark, d, "orders").select(F.col("o_orderpriority").alias("cluster"), F.col("o_custkey").alias("id"), "o_totalprice")
    taken = G.cover(o, o.groupBy("cluster").agg(F.avg("o_totalprice").alias("score")), 0.9)
    return spark.createDataFrame([(i, c) for i, c in enumerate(taken)], "place int, cluster string")


# records


@_query("SELECT label, count(*) AS n, list(vec_id ORDER BY vec_id)[1] AS first_id FROM embeddings WHERE label >= 1 GROUP BY label")
def labels_to_clusters(spark, d):
    return _table(spark, d, "embeddings").where("label >= 1").groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))


@_query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 1")
def biggest_value(spark, d):
    return _table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(1)


@_query("SELECT p_partkey FROM part WHERE p_size >= (SELECT min(p_size) FROM (SELECT DISTINCT p_size FROM part ORDER BY p_size DESC LIMIT 5))")
def nth_largest_cut(spark, d):
    p = _table(spark, d, "part")
    cut = p.select("p_size").distinct().orderBy(F.desc("p_size")).limit(5).agg(F.min("p_size").alias("cut"))
    return p.join(F.broadcast(cut), F.col("p_size") >= F.col("cut")).select("p_partkey")


@_query("SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 4) AS centred FROM orders")
def group_centring(spark, d):
    o = _table(spark, d, "orders")
    m = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m"))
    return o.join(m, "o_orderpriority").select("o_orderkey", F.round(F.col("o_totalprice") - F.col("m"), 4).alias("centred"))


@_query("SELECT p_partkey, coalesce(greatest(floor(7 / nullif(p_size % 11, 0)), 2), 2)::INT AS sigma FROM part")
def default_sigma(spark, d):
    return _table(spark, d, "part").select("p_partkey", F.coalesce(F.greatest(F.floor(F.try_divide(F.lit(7), F.col("p_size") % 11)), F.lit(2)), F.lit(2)).cast("int").alias("sigma"))


@_query("SELECT x::INT AS x, y::INT AS y, max(val) AS val, arg_max(z, (val, -z))::INT AS z FROM (SELECT (day(ts) - 1) AS x, hour(ts) AS y, user_id % 16 AS z, count(*)::DOUBLE AS val FROM events WHERE day(ts) <= 30 GROUP BY ALL) GROUP BY x, y")
def scan_best(spark, d):
    """Each cell's best score over the third axis and where it is: the running maximum of a scan over rotations."""
    best = _tomogram(spark, d).groupBy("x", "y").agg(F.max(F.struct("val", (-F.col("z")).alias("z"))).alias("b"))
    return best.select("x", "y", F.col("b.val").alias("val"), (-F.col("b.z")).cast("int").alias("z"))


@_query("WITH c AS (SELECT o_orderpriority AS g, o_custkey AS id FROM orders GROUP BY ALL), n AS (SELECT g, count(*) AS n FROM c GROUP BY g) SELECT a.g AS a, b.g AS b, round(count(*) / n.n, 6) AS ratio FROM c a JOIN c b ON a.id = b.id AND a.g < b.g JOIN n ON n.g = a.g GROUP BY a.g, b.g, n.n")
def intersection_ratio(spark, d):
    """Share of each priority's customers that another has. A customer has few priorities: sets meet by customer."""
    c = _table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_custkey").alias("id")).distinct()
    sets = c.groupBy("id").agg(F.sort_array(F.collect_set("g")).alias("gs"))
    pairs = sets.select(F.explode("gs").alias("a"), "gs").select("a", F.explode("gs").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))
    return pairs.join(c.groupBy(F.col("g").alias("a")).agg(F.count("*").alias("n")), "a").select("a", "b", F.round(F.col("k") / F.col("n"), 6).alias("ratio"))


@_query(f"WITH {_LABELLED} SELECT doc_id, round(-(p * ln(p) + (1 - p) * ln(1 - p)), 6) AS entropy FROM l WHERE p > 0 AND p < 1 ORDER BY -(p * ln(p) + (1 - p) * ln(1 - p)) DESC, doc_id LIMIT 20")
def active_entropy(spark, d):
    """The 20 least certain labelled documents."""
    p = F.col("p")
    e = _labelled(spark, d).where("p > 0 and p < 1").withColumn("entropy", -(p * F.log(p) + (1 - p) * F.log(1 - p)))
    return e.orderBy(F.desc("entropy"), "doc_id").limit(20).select("doc_id", F.round("entropy", 6).alias("entropy"))


@_query("WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM s GROUP BY user_id, s")
def contact_sessions(spark, d):
    """Stretches of a user's events that no gap of 12 hours parts: the batch form of streaming.windows.sessions()."""
    from ..streaming.windows import sessions

    s = sessions(_table(spark, d, "events"), gap="12 hours")
    return s.select("user_id", F.col("session.start").cast("timestamp_ntz").alias("first_ts"), "n")
