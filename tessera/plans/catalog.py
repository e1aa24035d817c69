"""The engine's queries over the supplied tables, and SQL with the same results.

Carriers: `events` counted on a day x hour x user grid is one volume; an embedding is a 4 x 4 x 4 cube;
`part` gives spheres; `orders` and `lineitem` give records; `labels` and `embeddings.label` give classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import records as R
from ..operators import statistics as S
from ..operators import voxel as V
from . import imaging, pairs, spectra
from .pairs import greedy_sql

SHAPE = (31, 24, 16)
S1, S2 = 1.0, 1.6


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tomogram(spark, d: str) -> DataFrame:
    """Event counts by day of the month, hour and user_id % 16, as the voxels of volume 0."""
    e = table(spark, d, "events")
    cells = e.select((F.dayofmonth("ts") - 1).alias("x"), F.hour("ts").alias("y"), (F.col("user_id") % 16).cast("int").alias("z"))
    return cells.groupBy("x", "y", "z").agg(F.count("*").cast("double").alias("val")).select(F.lit(0).alias("vol_id"), "x", "y", "z", "val")


_GRID = f"""
sparse AS (SELECT day(ts) - 1 AS x, hour(ts) AS y, (user_id % 16)::INT AS z, count(*)::DOUBLE AS val FROM events GROUP BY ALL),
vol AS (SELECT x::INT AS x, y::INT AS y, z::INT AS z, coalesce(val, 0)::DOUBLE AS val
        FROM range({SHAPE[0]}) a(x) CROSS JOIN range({SHAPE[1]}) b(y) CROSS JOIN range({SHAPE[2]}) c(z) LEFT JOIN sparse USING (x, y, z))"""


def _smooth_sql(name: str, source: str, sigma: float) -> str:
    weights = V.gauss_weights(sigma)
    r = len(weights) // 2
    out = [f"{name}_w(o, w) AS (VALUES " + ", ".join(f"({i - r}, {w!r}::DOUBLE)" for i, w in enumerate(weights.tolist())) + ")"]
    last = source
    for k, (a, n) in enumerate(zip("xyz", SHAPE)):
        others = [b for b in "xyz" if b != a]
        at = f"CASE WHEN g.i + o < 0 THEN -(g.i + o) - 1 WHEN g.i + o >= {n} THEN {2 * n - 1} - (g.i + o) ELSE g.i + o END"
        new = f"{name}_{k}"
        out.append(f"{new} AS (SELECT g.i::INT AS {a}, v.{others[0]}, v.{others[1]}, sum(w * val) AS val FROM range({n}) g(i) CROSS JOIN {name}_w JOIN {last} v ON v.{a} = {at} GROUP BY ALL)")
        last = new
    return ", ".join(out) + f", {name} AS (SELECT * FROM {last})"


_BOX = "abs(m.x - v.x) <= 1 AND abs(m.y - v.y) <= 1 AND abs(m.z - v.z) <= 1 AND abs(m.x - v.x) + abs(m.y - v.y) + abs(m.z - v.z) BETWEEN 1 AND 2"


def pick_dog_peaks(spark, d):
    """DoG and its local maxima by 18 neighbours, those over m + t (M - m) / 20, best first."""
    peaks = V.extrema(V.dog(tomogram(spark, d), SHAPE, S1, S2, rounded=9), SHAPE)
    ranked = V.above_threshold(peaks, 3.0).select("x", "y", "z", F.round("val", 6).alias("val"))
    return ranked.orderBy(F.desc("val"), "x", "y", "z")


_DOG = f"{_GRID}, {_smooth_sql('a', 'vol', S1)}, {_smooth_sql('b', 'vol', S2)}, dog AS (SELECT a.x, a.y, a.z, round(a.val - b.val, 9) AS val FROM a JOIN b USING (x, y, z))"
_FOUND = f"found AS (SELECT * FROM dog v WHERE val > (SELECT min(val) FROM dog) AND NOT EXISTS (SELECT 1 FROM dog m WHERE {_BOX} AND m.val > v.val))"
PICK_SQL = f"WITH {_DOG}, {_FOUND} SELECT x, y, z, round(val, 6) AS val FROM found WHERE val >= (SELECT min(val) + 3.0 * (max(val) - min(val)) / 20 FROM found) ORDER BY val DESC, x, y, z"


def smooth_gaussian(spark, d):
    return V.smooth(tomogram(spark, d), SHAPE, S1, rounded=6).drop("vol_id")


def dog(spark, d):
    return V.dog(tomogram(spark, d), SHAPE, S1, S2, rounded=6).drop("vol_id")


def local_maxima(spark, d):
    return V.extrema(tomogram(spark, d), SHAPE).drop("vol_id")


def local_minima(spark, d):
    return V.extrema(tomogram(spark, d), SHAPE, maxima=False).drop("vol_id")


def gradient_mag(spark, d):
    return V.gradient(tomogram(spark, d), SHAPE).drop("vol_id")


def dilate(spark, d):
    return V.dilate(tomogram(spark, d), SHAPE).drop("vol_id")


def hessian_eigen(spark, d):
    """Eigenvalues, the greatest by size first, and the greatest entry of all Hessians by size."""
    h = V.hessian(tomogram(spark, d), SHAPE)
    names = ("xx", "yy", "zz", "xy", "xz", "yz")
    e = V.by_magnitude(V.eigenvalues(*(F.col(c) for c in names)))
    most = h.agg(F.max(F.greatest(*[F.abs(F.col(c)) for c in names])).alias("most"))
    at = h.select("x", "y", "z", e.alias("e")).join(F.broadcast(most), F.lit(True))
    return at.select("x", "y", "z", *((F.round(F.col("e")[i], 4) + 0.0).alias(f"e{i}") for i in range(3)), "most")


def _second(a: str, b: str) -> str:
    """d/db of d/da with the edge repeated, as one expression over the clamped grid."""
    at = lambda **s: "(SELECT val FROM vol m WHERE " + " AND ".join(f"m.{c} = least(v.{c} + {s.get(c, 0)}, {n - 1})" for c, n in zip("xyz", SHAPE)) + ")"
    if a == b:
        return f"({at(**{a: 2})} - 2 * {at(**{a: 1})} + {at()})"
    return f"({at(**{a: 1, b: 1})} - {at(**{a: 1})} - {at(**{b: 1})} + {at()})"


_TURN = "acos(greatest(-1.0, least(1.0, (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2))) / 3"
_HESSIAN = f"""h AS (SELECT x, y, z, {_second('x', 'x')} AS xx, {_second('y', 'y')} AS yy, {_second('z', 'z')} AS zz,
 {_second('x', 'y')} AS xy, {_second('x', 'z')} AS xz, {_second('y', 'z')} AS yz FROM vol v),
 q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM h),
 p AS (SELECT *, sqrt(((xx-q)*(xx-q) + (yy-q)*(yy-q) + (zz-q)*(zz-q) + 2 * (xy*xy + xz*xz + yz*yz)) / 6) AS p FROM q),
 n AS (SELECT *, (xx-q)/p AS a, (yy-q)/p AS b, (zz-q)/p AS c, xy/p AS d, xz/p AS e, yz/p AS f FROM p),
 t AS (SELECT x, y, z, p, q, CASE WHEN p = 0 THEN 0 ELSE {_TURN} END AS t FROM n),
 v3 AS (SELECT x, y, z, CASE WHEN p = 0 THEN q ELSE q + 2*p*cos(t) END AS u, CASE WHEN p = 0 THEN q ELSE q + 2*p*cos(t + 2*pi()/3) END AS w, q FROM t),
 l AS (SELECT x, y, z, list_sort([(round(abs(g), 6), g) for g in [u, 3*q - u - w, w]], 'DESC') AS l FROM v3),
 eig AS (SELECT x, y, z, l[1][2] AS e0, l[2][2] AS e1, l[3][2] AS e2 FROM l)"""
HESSIAN_SQL = f"""WITH {_GRID}, {_HESSIAN} SELECT x, y, z, round(e0, 4) + 0.0 AS e0, round(e1, 4) + 0.0 AS e1, round(e2, 4) + 0.0 AS e2,
 (SELECT max(greatest(abs(xx), abs(yy), abs(zz), abs(xy), abs(xz), abs(yz))) FROM h) AS most FROM eig"""
SURFACE_SQL = f"WITH {_GRID}, {_HESSIAN} SELECT x, y, z, round(CASE WHEN e0 < 0 THEN pow(abs(e0) - sqrt(abs(e1 * e2)), 2) ELSE 0 END, 3) + 0.0 AS strength FROM eig"


def roll(spark, d):
    return V.roll(tomogram(spark, d), SHAPE, (3, -5, 20)).drop("vol_id")


def crop_range(spark, d):
    return V.crop(tomogram(spark, d), (5, 6, 2), (20, 18, 12)).drop("vol_id")


def tile_bases(spark, d):
    return V.tile_bases((210, 150, 90), 60, 30, spark)


TILE_SQL = """SELECT i0::INT AS i0, i1::INT AS i1, i2::INT AS i2, (i0 * 60)::INT AS x0, least(i0 * 60 + 90, 210)::INT AS x1, (i1 * 60)::INT AS y0, least(i1 * 60 + 90, 150)::INT AS y1,
 (i2 * 60)::INT AS z0, least(i2 * 60 + 90, 90)::INT AS z1 FROM range(3) a(i0), range(2) b(i1), range(1) c(i2)"""


def sphere_mask(spark, d):
    return V.sphere_mask(spark, (16, 16, 16), (7.5, 7.5, 7.5), 5.0, 1.5)


SPHERE_SQL = """SELECT x::INT AS x, y::INT AS y, z::INT AS z, round(CASE WHEN r <= 5 THEN 1.0 ELSE exp(-((r - 5) / 1.5) * ((r - 5) / 1.5)) END, 6) AS val
 FROM (SELECT *, sqrt((x - 7.5)*(x - 7.5) + (y - 7.5)*(y - 7.5) + (z - 7.5)*(z - 7.5)) AS r FROM range(16) a(x), range(16) b(y), range(16) c(z))"""


def suppress_peaks(spark, d):
    return V.suppress(V.extrema(tomogram(spark, d), SHAPE), 3.0).drop("vol_id")


def cluster_average(spark, d):
    e = R.array_mean(table(spark, d, "embeddings"), "label", "embedding", 64)
    return e.select("label", "n", F.posexplode("mean").alias("pos", "mean")).select("label", F.col("n").cast("long").alias("n"), "pos", F.round("mean", 5).alias("mean"))


CLUSTER_SQL = "SELECT label, count(*) AS n, pos::INT AS pos, round(avg(embedding[pos + 1]::DOUBLE), 5) AS mean FROM embeddings, range(64) p(pos) GROUP BY label, pos"


def align_best(spark, d):
    """Each cube's best class template (the first of each class) by dot product, ties to the later template."""
    e = table(spark, d, "embeddings")
    t = R.first_of(e.select("label", "vec_id", "embedding"), "label", "vec_id").select(F.col("label").alias("template_id"), F.col("embedding").alias("template"))
    out = R.best_template(e.select("vec_id", "embedding"), t, F.round(R.dot(F.col("embedding"), F.col("template")), 5))
    return out.select("vec_id", "template_id", "score")


ALIGN_SQL = """WITH t AS (SELECT label AS template_id, embedding AS template FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
 s AS (SELECT vec_id, template_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * template[i]::DOUBLE)), 5) AS score FROM embeddings, t)
 SELECT vec_id, template_id, score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, template_id DESC) = 1"""


def align_above(spark, d):
    """The first of the best templates of a score over 0.2, or template -1."""
    e = table(spark, d, "embeddings")
    t = R.first_of(e.select("label", "vec_id", "embedding"), "label", "vec_id").select(F.col("label").alias("template_id"), F.col("embedding").alias("template"))
    out = R.best_above(e.select("vec_id", "embedding"), t, F.round(R.dot(F.col("embedding"), F.col("template")), 5), 0.2, -1)
    return out.select("vec_id", "template_id", "score")


ABOVE_SQL = ALIGN_SQL.split(" SELECT vec_id, template_id, score FROM s QUALIFY")[0] + """, b AS (SELECT vec_id, template_id, score FROM s WHERE score > 0.2 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, template_id) = 1)
 SELECT vec_id, coalesce(template_id, -1)::INT AS template_id, score FROM embeddings LEFT JOIN b USING (vec_id)"""


def zscore_clip(spark, d):
    o = table(spark, d, "orders")
    return R.zscore(o, ["o_orderpriority"], "o_totalprice", "z", 1.5).select("o_orderkey", F.round("z", 6).alias("z"))


def minmax_stretch(spark, d):
    return R.stretch(table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice", "v").select("o_orderkey", F.round("v", 8).alias("v"))


def size_min_having(spark, d):
    return R.keep_sized(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 12)


def resume_anti(spark, d):
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


def select_semi(spark, d):
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


def dedup_first(spark, d):
    return R.first_of(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey")


def topk_ties(spark, d):
    return R.top_with_ties(table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity"), ["l_returnflag"], F.desc("l_quantity"), 3).select("l_returnflag", "l_orderkey", "l_linenumber", "rank")


def dense_relabel(spark, d):
    return R.dense_relabel(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand").select("p_partkey", "p_brand", "new_label")


def union_offset(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    top = e.agg(F.max("label").alias("top"))
    second = table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), F.col("quality").alias("label")).crossJoin(F.broadcast(top)).select("vec_id", (F.col("label") + F.col("top") + 1).alias("label"))
    return e.unionAll(second)


def contingency(spark, d):
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


def pr_fbeta(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    out = R.precision_recall(rows, F.col("n_chars") > 1500, F.col("quality") == 1, 2.0)
    return out.select("tp", "fp", "fn", *(F.round(c, 8).alias(c) for c in ("precision", "recall", "f_beta")))


def roc_points(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return S.roc(rows, "n_chars", "quality").select("n_chars", F.round("tpr", 8).alias("tpr"), F.round("fpr", 8).alias("fpr"))


def sphere_overlap(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 37 % 211).cast("double").alias("x"), (F.col("p_partkey") * 101 % 223).cast("double").alias("y"), (F.col("p_partkey") * 53 % 227).cast("double").alias("z"), (F.col("p_size") / 10).alias("r"))
    return R.overlapping_spheres(p)


def pearson_groups(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("r"), F.count("*").alias("n"))


def neighbor_cov(spark, d):
    """Covariance of every cube voxel with its next one along z, over all cubes, and its mean over the volume."""
    e = table(spark, d, "embeddings")
    pairs = [(i, i + 1) for i in range(64) if i % 4 < 3]
    c = F.col("embedding")
    one = e.agg(*[F.covar_pop(c[i].cast("double"), c[j].cast("double")).alias(f"c{i}") for i, j in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.col(f"c{i}").alias("cov")) for i, _ in pairs])).alias("s")).select("s.pos", F.round("s.cov", 6).alias("cov"))


def prefix_best(spark, d):
    """Running mean price of each customer's orders by date, and the longest prefix that has the greatest one."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    run = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    p = o.select("o_custkey", F.count("*").over(run).alias("len"), F.round(F.avg("o_totalprice").over(run), 4).alias("mean"))
    return p.groupBy("o_custkey").agg(F.max(F.struct("mean", "len")).alias("b")).select("o_custkey", F.col("b.len").alias("len"), F.col("b.mean").alias("mean"))


def events_tumbling(spark, d):
    """Counts and sums of events by hour and type: the batch form of streaming.windows.tumbling()."""
    from ..streaming.windows import tumbling

    return tumbling(table(spark, d, "events")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


_JOINED = "labels JOIN documents USING (doc_id)"
SQL = {
    "pick_dog_peaks": PICK_SQL,
    "smooth_gaussian": f"WITH {_GRID}, {_smooth_sql('a', 'vol', S1)} SELECT x, y, z, round(val, 6) + 0.0::DOUBLE AS val FROM a",
    "dog": f"WITH {_GRID}, {_smooth_sql('a', 'vol', S1)}, {_smooth_sql('b', 'vol', S2)} SELECT a.x, a.y, a.z, round(a.val - b.val, 6) + 0.0::DOUBLE AS val FROM a JOIN b USING (x, y, z)",
    "local_maxima": f"WITH {_GRID} SELECT x, y, z, val FROM vol v WHERE val > (SELECT min(val) FROM vol) AND NOT EXISTS (SELECT 1 FROM vol m WHERE {_BOX} AND m.val > v.val)",
    "local_minima": f"WITH {_GRID} SELECT x, y, z, val FROM vol v WHERE val < (SELECT max(val) FROM vol) AND NOT EXISTS (SELECT 1 FROM vol m WHERE {_BOX} AND m.val < v.val)",
    "gradient_mag": f"WITH {_GRID}, g AS (SELECT x, y, z, coalesce(lead(val) OVER (PARTITION BY y, z ORDER BY x) - val, 0) AS dx, coalesce(lead(val) OVER (PARTITION BY x, z ORDER BY y) - val, 0) AS dy, coalesce(lead(val) OVER (PARTITION BY x, y ORDER BY z) - val, 0) AS dz FROM vol) SELECT *, dx*dx + dy*dy + dz*dz AS mag FROM g",
    "dilate": f"WITH {_GRID} SELECT v.x, v.y, v.z, greatest(v.val, max(m.val)) AS val FROM vol v JOIN vol m ON {_BOX} GROUP BY v.x, v.y, v.z, v.val",
    "hessian_eigen": HESSIAN_SQL,
    "roll": f"WITH {_GRID} SELECT ((x + 3) % 31)::INT AS x, ((y + 19) % 24)::INT AS y, ((z + 4) % 16)::INT AS z, val FROM vol WHERE val <> 0",
    "crop_range": f"WITH {_GRID} SELECT x - 5 AS x, y - 6 AS y, z - 2 AS z, val FROM vol WHERE val <> 0 AND x BETWEEN 5 AND 19 AND y BETWEEN 6 AND 17 AND z BETWEEN 2 AND 11",
    "tile_bases": TILE_SQL,
    "sphere_mask": SPHERE_SQL,
    "cluster_average": CLUSTER_SQL,
    "align_best": ALIGN_SQL,
    "align_above": ABOVE_SQL,
    "zscore_clip": "SELECT o_orderkey, round(CASE WHEN s = 0 THEN 0.0 ELSE greatest(-1.5, least(1.5, (o_totalprice - m) / s)) END, 6) AS z FROM (SELECT *, avg(o_totalprice) OVER w AS m, stddev_pop(o_totalprice) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_orderpriority))",
    "minmax_stretch": "SELECT o_orderkey, round(CASE WHEN a = b THEN 0.0 ELSE (o_totalprice - a) / (b - a) END, 8) AS v FROM (SELECT *, min(o_totalprice) OVER w AS a, max(o_totalprice) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_orderstatus))",
    "size_min_having": "SELECT o_orderkey, o_custkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) >= 12",
    "resume_anti": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)",
    "select_semi": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)",
    "dedup_first": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1",
    "topk_ties": "SELECT l_returnflag, l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC)::INT AS rank FROM lineitem QUALIFY rank <= 3",
    "dense_relabel": "SELECT p_partkey, p_brand, new_label FROM part JOIN (SELECT p_brand, (row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1)::INT AS new_label FROM part GROUP BY p_brand) USING (p_brand)",
    "union_offset": "SELECT vec_id, label FROM embeddings UNION ALL SELECT doc_id, (quality + 1 + (SELECT max(label) FROM embeddings))::INT FROM labels",
    "contingency": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL",
    "pr_fbeta": f"SELECT tp, fp, fn, round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall, round(5.0::DOUBLE * tp / (5 * tp + 4 * fn + fp), 8) AS f_beta FROM (SELECT count(*) FILTER (n_chars > 1500 AND quality = 1) AS tp, count(*) FILTER (n_chars > 1500 AND quality <> 1) AS fp, count(*) FILTER (n_chars <= 1500 AND quality = 1) AS fn FROM {_JOINED})",
    "roc_points": f"SELECT n_chars, round(sum(p) OVER w / sum(p) OVER (), 8) AS tpr, round(sum(n - p) OVER w / sum(n - p) OVER (), 8) AS fpr FROM (SELECT n_chars, sum(quality)::DOUBLE AS p, count(*)::DOUBLE AS n FROM {_JOINED} GROUP BY n_chars) WINDOW w AS (ORDER BY n_chars DESC)",
    "sphere_overlap": "WITH p AS (SELECT p_partkey AS id, p_partkey * 37 % 211 AS x, p_partkey * 101 % 223 AS y, p_partkey * 53 % 227 AS z, p_size / 10.0::DOUBLE AS r FROM part) SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id < b.id AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) < (a.r + b.r) * (a.r + b.r)",
    "pearson_groups": "SELECT l_returnflag, l_linestatus, round(corr(l_quantity, l_extendedprice), 8) AS r, count(*) AS n FROM lineitem GROUP BY ALL",
    "neighbor_cov": "SELECT pos::INT AS pos, round(covar_pop(embedding[pos + 1]::DOUBLE, embedding[pos + 2]::DOUBLE), 6) AS cov FROM embeddings, range(64) p(pos) WHERE pos % 4 < 3 GROUP BY pos",
    "prefix_best": "SELECT o_custkey, len, mean FROM (SELECT o_custkey, count(*) OVER w AS len, round(avg(o_totalprice) OVER w, 4) AS mean FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY mean DESC, len DESC) = 1",
    "suppress_peaks": f"WITH RECURSIVE {_GRID}, top AS (SELECT x, y, z, val FROM vol v WHERE val > (SELECT min(val) FROM vol) AND NOT EXISTS (SELECT 1 FROM vol m WHERE {_BOX} AND m.val > v.val)), "
    + greedy_sql("SELECT row_number() OVER (ORDER BY val DESC, x, y, z) AS i, row_number() OVER (ORDER BY val DESC, x, y, z) AS id, x, y, z, val FROM top", "(k.x - r.x)**2 + (k.y - r.y)**2 + (k.z - r.z)**2 < 9")
    + " SELECT x, y, z, val FROM ranked JOIN kept USING (id)",
    "surface_strength": SURFACE_SQL,
    "events_tumbling": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
_QUERIES = (pick_dog_peaks, smooth_gaussian, dog, local_maxima, local_minima, gradient_mag, dilate, hessian_eigen, roll, crop_range, tile_bases, sphere_mask, suppress_peaks, cluster_average, align_best, align_above, zscore_clip, minmax_stretch, size_min_having, resume_anti, select_semi, dedup_first, topk_ties, dense_relabel, union_offset, contingency, pr_fbeta, roc_points, sphere_overlap, pearson_groups, neighbor_cov, prefix_best, events_tumbling)


def _modules() -> tuple:
    from . import models, sources, streams, tiled, volumes  # they stand on this module

    return imaging, pairs, spectra, volumes, models, sources, tiled, streams


def queries() -> dict:
    out = {f.__name__: f for f in _QUERIES} | imaging.queries()
    for module in _modules()[1:]:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {**SQL, **imaging.oracle_sql()}
    for module in _modules()[1:]:
        out |= module.SQL
    return out
