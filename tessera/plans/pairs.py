"""Queries of pairs, greedy choices, samples, grids and orders, and SQL with the same results.

Carriers: `part` gives points and boxes, `embeddings` vectors, `orders` and `lineitem` records, `events` a tomogram.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import knn as N
from ..operators import pairs as P
from ..operators import records as R
from .base import POINTS, points, register, table, uniform, uniform_sql

QUERIES, SQL, _query = register()
_AXES = ["x", "y", "z"]
_CLASSES = "cls AS (SELECT label, pos, avg(embedding[pos + 1]::DOUBLE) AS m FROM embeddings, range(64) p(pos) GROUP BY ALL)"


def greedy_sql(ranked: str, close: str, fields: str = "x, y, z") -> str:
    """CTEs ending in kept(id): the loop over ranked(i from 1, id, fields) that drops a row close to a kept one, k."""
    names = [f.strip() for f in fields.split(",")]
    pack = "struct_pack(" + ", ".join(f"{n} := r.{n}::DOUBLE" for n in names) + ")"
    free = f"len(list_filter(w.kept, lambda k: {close})) = 0"
    kind = ", ".join(f"{n} DOUBLE" for n in names)
    return f"""ranked AS ({ranked}),
walk AS (SELECT 0::BIGINT AS i, []::STRUCT({kind})[] AS kept, NULL::BIGINT AS id UNION ALL
         SELECT r.i, CASE WHEN {free} THEN list_append(w.kept, {pack}) ELSE w.kept END, CASE WHEN {free} THEN r.id END
         FROM walk w JOIN ranked r ON r.i = w.i + 1),
kept AS (SELECT id FROM walk WHERE id IS NOT NULL)"""


# pairs


@_query(f"""WITH {_CLASSES}, s AS (SELECT a.label AS a, b.label AS b, round(sum(a.m * b.m), 5) AS score, round(sum(a.m - b.m), 5) AS shift
 FROM cls a JOIN cls b ON a.pos = b.pos AND a.label < b.label GROUP BY ALL)
 SELECT a, b, score, shift + 0.0 AS shift FROM s UNION ALL SELECT b, a, score, -shift + 0.0 FROM s""")
def pairwise_upper(spark, d):
    """Class means against each other once, and the mirror images with the inverse shift."""
    means = R.array_mean(table(spark, d, "embeddings"), "label", "embedding", 64)
    pairs = P.upper_pairs(means, "label", ["mean"])
    total = F.aggregate("mean_a", F.lit(0.0), lambda s, x: s + x) - F.aggregate("mean_b", F.lit(0.0), lambda s, x: s + x)
    pairs = pairs.select("a", "b", F.round(R.dot(F.col("mean_a"), F.col("mean_b")), 5).alias("score"), F.round(total, 5).alias("shift"))
    return P.mirrored(pairs, ["shift"]).withColumn("shift", F.col("shift") + 0.0)


@_query("SELECT l_orderkey, l_linenumber, p_name, p_size FROM lineitem JOIN part ON p_partkey = l_partkey")
def record_images(spark, d):
    """Records with the image row that their key names."""
    images = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(images, "l_partkey").drop("l_partkey")


@_query("SELECT doc_id, coalesce(quality, -1)::INT AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def lookup_default(spark, d):
    """Every record with its looked-up value, or the default."""
    docs = table(spark, d, "documents").select("doc_id")
    return docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).cast("int").alias("quality"))


@_query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_pool(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@_query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS other,
 list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id)
 SELECT vec_id, rank::INT AS rank, other, round(d, 6) AS distance2 FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS rank FROM p) WHERE rank <= 5""")
def knn(spark, d):
    return N.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", 5).withColumn("distance2", F.round("distance2", 6))


@_query(f"""WITH {_CLASSES}, n AS (SELECT label, sqrt(sum(m * m)) AS n FROM cls GROUP BY label),
 q AS (SELECT label, list(m / n ORDER BY pos) AS q FROM cls JOIN n USING (label) GROUP BY label),
 e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
 f AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e),
 coarse AS (SELECT label, vec_id, q, v, round(list_sum(list_transform(range(1, 33), lambda i: (q[2*i-1] + q[2*i]) * (v[2*i-1] + v[2*i]))), 6) AS c FROM q, f),
 kept AS (SELECT * FROM coarse WHERE c >= 0),
 fine AS (SELECT label, vec_id, round(list_sum(list_transform(range(1, 65), lambda i: q[i] * v[i])), 6) AS score FROM kept)
 SELECT label, vec_id, score FROM fine QUALIFY rank() OVER (PARTITION BY label ORDER BY score DESC) <= 10""")
def cosine_topk(spark, d):
    """Class means as queries: coarse match on sums of neighbouring components, then the cosine of what is not opposed; the 10 best with ties."""
    e = table(spark, d, "embeddings")
    unit = lambda c: F.transform(c, lambda x: x.cast("double") / F.sqrt(R.dot(F.col(c), F.col(c))))
    queries = R.array_mean(e, "label", "embedding", 64).select("label", unit("mean").alias("q"))
    features = e.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).select("vec_id", unit("v").alias("v"))
    if queries.limit(4097).count() > 4096:
        raise ValueError("more than 4096 queries")
    both = features.join(F.broadcast(queries), F.lit(True))
    halves = lambda c: F.transform(F.sequence(F.lit(1), F.lit(63), F.lit(2)), lambda i: F.element_at(c, i) + F.element_at(c, i + 1))
    coarse = both.where(F.round(R.dot(halves(F.col("q")), halves(F.col("v"))), 6) >= 0)
    fine = coarse.select("label", "vec_id", F.round(R.dot(F.col("q"), F.col("v")), 6).alias("score"))
    return R.top_with_ties(fine, ["label"], F.desc("score"), 10).drop("rank")


@_query("""WITH p AS (SELECT n_nationkey AS id, n_nationkey * 0.25 AS phi, n_nationkey * 0.11 AS theta, n_nationkey * 0.19 AS psi, [n_nationkey, n_regionkey, 1]::DOUBLE[] AS t FROM nation),
 t AS (SELECT id, t, [cos(phi)*cos(theta)*cos(psi) - sin(phi)*sin(psi), -cos(phi)*cos(theta)*sin(psi) - sin(phi)*cos(psi), cos(phi)*sin(theta),
  sin(phi)*cos(theta)*cos(psi) + cos(phi)*sin(psi), -sin(phi)*cos(theta)*sin(psi) + cos(phi)*cos(psi), sin(phi)*sin(theta), -sin(theta)*cos(psi), sin(theta)*sin(psi), cos(theta)] AS r FROM p)
 SELECT a.id AS a, b.id AS b, round(list_sum(list_transform(list_zip(a.r, b.r), lambda x: (x[1]-x[2])*(x[1]-x[2]))) + 0.5 * list_sum(list_transform(list_zip(a.t, b.t), lambda x: (x[1]-x[2])*(x[1]-x[2]))), 6) AS distance
 FROM t a JOIN t b ON a.id < b.id""")
def rigid_distance(spark, d):
    """Squared distances of poses: Frobenius of the rotations, and half that of the shifts."""
    n = table(spark, d, "nation")
    key = F.col("n_nationkey")
    r = F.array(*P.rotation_matrix(key * 0.25, key * 0.11, key * 0.19))
    t = F.array(key.cast("double"), F.col("n_regionkey").cast("double"), F.lit(1.0))
    pairs = P.upper_pairs(n.select(key.alias("id"), r.alias("r"), t.alias("t")), "id", ["r", "t"])
    return pairs.select("a", "b", F.round(P.rigid_distance(F.col("r_a"), F.col("r_b"), F.col("t_a"), F.col("t_b"), 0.5), 6).alias("distance"))


@_query(f"WITH {POINTS} SELECT id, x, y, z FROM pts p WHERE NOT EXISTS (SELECT 1 FROM pts q WHERE q.id <> p.id AND (p.x-q.x)**2 + (p.y-q.y)**2 + (p.z-q.z)**2 <= 49)")
def close_pairs_dropped(spark, d):
    """Points with no other within 7: both of a close pair go."""
    return P.isolated(points(spark, d).drop("val"), "id", _AXES, 7.0)


_NEAR = "(k.x - r.x)**2 + (k.y - r.y)**2 + (k.z - r.z)**2"


@_query("WITH RECURSIVE " + POINTS + ", " + greedy_sql("SELECT row_number() OVER (ORDER BY id) AS i, id, x, y, z FROM pts", _NEAR + " <= 100") + " SELECT id, x, y, z FROM pts JOIN kept USING (id)")
def unique_points(spark, d):
    """In the order of id, points within 10 of one kept before go."""
    p = points(spark, d).drop("val")
    return P.greedy(p, "id", [], _AXES, 10.0, P.euclid(_AXES, 10.0, strict=False))


_BOX = "r.x >= k.x - 6 AND r.x < k.x + 6 AND r.y >= k.y - 6 AND r.y < k.y + 6 AND r.z >= k.z - 6 AND r.z < k.z + 6"


@_query("WITH RECURSIVE " + POINTS + ", " + greedy_sql("SELECT row_number() OVER (ORDER BY val DESC, id) AS i, id, x, y, z FROM pts", _BOX) + """
 SELECT 'tomo' AS tomogram_name, x AS x_coord, y AS y_coord, z AS z_coord, val AS score FROM pts JOIN kept USING (id)""")
def nms3d(spark, d):
    """Best first, a point masks the half-open cuboid around it; the table of picks."""
    p = points(spark, d)
    kept = P.greedy(p, "id", [(-F.col("val")).alias("v")], _AXES, 6.0, P.cuboid(_AXES, 6))
    return kept.select(F.lit("tomo").alias("tomogram_name"), *(F.col(a).alias(f"{a}_coord") for a in _AXES), F.col("val").alias("score"))


def _boxes(spark, d: str) -> DataFrame:
    p = table(spark, d, "part")
    x, y = (F.col("p_partkey") * 37 % 997).cast("double"), (F.col("p_partkey") * 101 % 991).cast("double")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("image"), x.alias("x1"), y.alias("y1"), (x + F.col("p_size") + 20).alias("x2"), (y + F.col("p_size") + 20).alias("y2"), (F.col("p_retailprice") / 3000).alias("prob"), (F.col("p_partkey") % 2).alias("side"))


_BOXES = "b AS (SELECT p_partkey AS id, p_brand AS image, (p_partkey * 37 % 997)::DOUBLE AS x1, (p_partkey * 101 % 991)::DOUBLE AS y1, x1 + p_size + 20 AS x2, y1 + p_size + 20 AS y2, p_retailprice / 3000 AS prob, p_partkey % 2 AS side FROM part)"
_IOU = "greatest(0, least(r.x2, t.x2) - greatest(r.x1, t.x1)) * greatest(0, least(r.y2, t.y2) - greatest(r.y1, t.y1))"
_AREAS = "(r.x2 - r.x1) * (r.y2 - r.y1) + (t.x2 - t.x1) * (t.y2 - t.y1)"


@_query(f"""WITH {_BOXES}, o AS (SELECT r.id, t.id AS truth, {_IOU} AS i, {_AREAS} AS s FROM b r JOIN b t ON r.side = 0 AND t.side = 1),
 v AS (SELECT id, truth, i / (s - i) AS iou FROM o)
 SELECT id, truth, round(iou, 6) AS iou, iou >= 0.5 AS is_object FROM v WHERE iou >= 0.1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY iou DESC, truth) = 1""")
def roi_assign(spark, d):
    """Even boxes as regions, odd ones as truth."""
    b = _boxes(spark, d)
    return P.assigned(b.where("side = 0"), b.where("side = 1"), 100.0).withColumn("iou", F.round("iou", 6))


@_query(f"""WITH RECURSIVE {_BOXES}, o AS (SELECT r.image, r.id, r.prob, t.id AS truth, {_IOU} AS i, {_AREAS} AS s FROM b r JOIN b t ON r.side = 0 AND t.side = 1 AND r.image = t.image),
 c AS (SELECT image, id, prob, truth, i / (s - i) AS iou FROM o WHERE i / (s - i) >= 0.05),
 q AS (SELECT *, dense_rank() OVER (PARTITION BY image ORDER BY prob DESC, id) AS n FROM c),
 walk AS (SELECT DISTINCT image, 0::BIGINT AS n, []::BIGINT[] AS used, NULL::BIGINT AS id, NULL::BIGINT AS truth FROM q UNION ALL
  SELECT w.image, w.n + 1, CASE WHEN f.truth IS NULL THEN w.used ELSE list_append(w.used, f.truth) END, f.id, f.truth
  FROM walk w JOIN (SELECT DISTINCT image, n FROM q) s ON s.image = w.image AND s.n = w.n + 1
  LEFT JOIN LATERAL (SELECT id, truth FROM q WHERE q.image = w.image AND q.n = w.n + 1 AND NOT list_contains(w.used, q.truth) ORDER BY iou DESC, truth LIMIT 1) f ON true)
 SELECT image, id, truth FROM walk WHERE truth IS NOT NULL""")
def match_truth(spark, d):
    """Greedy one-to-one matches within an image at an IoU of 0.05."""
    b = _boxes(spark, d)
    return P.matched(b.where("side = 0"), b.where("side = 1"), "image", least=0.05)


@_query(f"WITH {POINTS} SELECT id, x, y, 'truth' AS kind FROM pts WHERE z BETWEEN 20 AND 24 AND id % 2 = 0 UNION ALL SELECT id, x, y, 'found' FROM pts WHERE z BETWEEN 20 AND 24 AND id % 2 = 1")
def coordinate_overlay(spark, d):
    """Coordinates of two origins on one slab."""
    p = points(spark, d).where(F.col("z").between(20, 24))
    kind = lambda rest, name: p.where(F.col("id") % 2 == rest).select("id", "x", "y", F.lit(name).alias("kind"))
    return kind(0, "truth").unionByName(kind(1, "found"))


# filters and record functions


@_query("SELECT l_partkey, l_quantity, l_tax FROM lineitem WHERE l_suppkey = 3")
def keyed_points(spark, d):
    """Three columns of the rows under one foreign key."""
    return table(spark, d, "lineitem").where("l_suppkey = 3").select("l_partkey", "l_quantity", "l_tax")


@_query("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey::VARCHAR || 'sample'), o_orderkey LIMIT 100")
def random_sample(spark, d):
    """100 rows without replacement, in the order of a hash of the key: the same on every run."""
    return table(spark, d, "orders").select("o_orderkey").orderBy(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit("sample")).cast("binary")), "o_orderkey").limit(100)


@_query("SELECT c_custkey, split_part(c_name, '#', 1) AS kind, split_part(c_name, '#', 2) AS number FROM customer")
def split_fields(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.split_part("c_name", F.lit("#"), F.lit(1)).alias("kind"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("number"))


@_query(f"WITH {POINTS} SELECT id, z, y AS row, x AS col FROM pts")
def parse_names(spark, d):
    """z, row and column out of file names such as 12_3_40.png."""
    named = points(spark, d).select("id", F.concat_ws("_", "z", "y", "x").alias("s")).select("id", F.concat("s", F.lit(".png")).alias("name"))
    return named.select("id", *(F.regexp_extract("name", r"^(\d+)_(\d+)_(\d+)\.png$", i).cast("int").alias(c) for i, c in ((1, "z"), (2, "row"), (3, "col"))))


@_query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE round(p_retailprice / (p_size % 5) / 10, 6) END AS spacing FROM part")
def voxel_spacing(spark, d):
    """Length over the number of voxels, in nanometres; null without voxels."""
    return table(spark, d, "part").select("p_partkey", F.round(F.try_divide(F.col("p_retailprice"), F.col("p_size") % 5) / 10, 6).alias("spacing"))


@_query("SELECT event_id, coalesce(v, 0.0) AS x, coalesce(v, 0.0) AS y, coalesce(v, 0.0) AS z FROM (SELECT event_id, CASE WHEN value > 50 THEN value END AS v FROM events)")
def default_fill(spark, d):
    """Shifts where there are any, else zeros."""
    v = F.col("value")
    loc = F.coalesce(F.when(v > 50, F.array(v, v, v)), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    return table(spark, d, "events").select("event_id", loc.alias("loc")).select("event_id", *(F.col("loc")[i].alias(a) for i, a in enumerate(_AXES)))


_TURN = [("phi", 2 * math.pi), ("theta", math.pi), ("psi", 2 * math.pi)]


@_query("SELECT o_orderkey, " + ", ".join(f"round({uniform_sql('o_orderkey', n)} * {m!r}::DOUBLE, 9) AS {n}" for n, m in _TURN) + " FROM orders")
def randomise_orientation(spark, d):
    """Angles that a record's key fixes, so that a lost task draws the same ones again."""
    return table(spark, d, "orders").select("o_orderkey", *(F.round(uniform(F.col("o_orderkey"), n) * m, 9).alias(n) for n, m in _TURN))


@_query("SELECT count(DISTINCT label) AS labels, count(DISTINCT embedding) AS vectors FROM embeddings")
def count_distinct(spark, d):
    return table(spark, d, "embeddings").agg(F.count_distinct("label").alias("labels"), F.count_distinct("embedding").alias("vectors"))


# grids, chunks and splits


@_query("SELECT (a * 30)::INT AS phi, (b * 30)::INT AS theta, (c * 30)::INT AS psi FROM range(12) t(a), range(12) u(b), range(12) v(c)")
def rotation_grid(spark, d):
    """All Euler angles in steps of 30 degrees."""
    n = 12
    at = lambda k: (F.floor(F.col("id") / n**k) % n * (360 // n)).cast("int")
    return spark.range(n**3).select(at(2).alias("phi"), at(1).alias("theta"), at(0).alias("psi"))


@_query("SELECT p_partkey, spacing::DOUBLE AS spacing, resolution::DOUBLE AS resolution FROM part, (VALUES (2.0), (4.0), (8.0)) s(spacing), (VALUES (20.0), (40.0)) r(resolution)")
def parameter_grid(spark, d):
    """Each structure at every spacing and resolution."""
    p = table(spark, d, "part").select("p_partkey", F.explode(F.array(*map(F.lit, (2.0, 4.0, 8.0)))).alias("spacing"))
    return p.select("*", F.explode(F.array(F.lit(20.0), F.lit(40.0))).alias("resolution"))


@_query("SELECT o_orderkey, (o_orderkey // 64)::BIGINT AS chunk, (o_orderkey % 64)::INT AS place FROM orders")
def chunks(spark, d):
    """Records in chunks of 64 by their running number."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.floor(k / 64).alias("chunk"), (k % 64).cast("int").alias("place"))


_SHARE = uniform_sql("doc_id", "split")


@_query(f"SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS part FROM (SELECT doc_id, {_SHARE} AS u FROM documents)")
def split_lists(spark, d):
    """Train, validation and test shares of 80, 10 and 10 per cent, by a hash of the key."""
    u = uniform(F.col("doc_id"), "split")
    return table(spark, d, "documents").select("doc_id", F.when(u < 0.8, "train").when(u < 0.9, "val").otherwise("test").alias("part"))


@_query("""WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR || 'episode'), vec_id) AS n FROM embeddings)
 SELECT label, vec_id, CASE WHEN n <= 3 THEN 'support' ELSE 'query' END AS role FROM r WHERE n <= 8""")
def episodes(spark, d):
    """A few-shot episode: of each class three support records and five queries, drawn by a hash of the key."""
    e = table(spark, d, "embeddings").select("label", "vec_id")
    w = Window.partitionBy("label").orderBy(F.md5(F.concat(F.col("vec_id").cast("string"), F.lit("episode")).cast("binary")), "vec_id")
    drawn = e.withColumn("n", F.row_number().over(w)).where("n <= 8")
    return drawn.select("label", "vec_id", F.when(F.col("n") <= 3, "support").otherwise("query").alias("role"))


@_query("""WITH p AS (SELECT a.label AS label, a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
  row_number() OVER (PARTITION BY a.label, a.label = b.label ORDER BY md5(a.vec_id::VARCHAR || '-' || b.vec_id::VARCHAR), a.vec_id, b.vec_id) AS n
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND b.vec_id <= a.vec_id + 40) SELECT label, a, b, same FROM p WHERE n <= 4""")
def paired_groups(spark, d):
    """Pairs of records, four of one class and four of two, for each class."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    near = e.select(F.col("vec_id").alias("b"), F.col("label").alias("other"), F.explode(F.sequence(F.floor(F.col("vec_id") / 40) - 1, F.floor(F.col("vec_id") / 40))).alias("cell"))
    both = e.withColumn("cell", F.floor(F.col("vec_id") / 40)).join(near, "cell").where((F.col("vec_id") < F.col("b")) & (F.col("b") <= F.col("vec_id") + 40))
    both = both.select("label", F.col("vec_id").alias("a"), "b", (F.col("label") == F.col("other")).alias("same"))
    w = Window.partitionBy("label", "same").orderBy(F.md5(F.concat_ws("-", "a", "b").cast("binary")), "a", "b")
    return both.withColumn("n", F.row_number().over(w)).where("n <= 4").drop("n")


# orders


@_query("SELECT id, x, y, z, (row_number() OVER (ORDER BY id) - 1)::BIGINT AS place FROM (SELECT p_partkey AS id, (p_partkey * 37 % 97)::INT AS x, (p_partkey * 101 % 89)::INT AS y, (p_partkey * 53 % 83)::INT AS z FROM part)")
def sort_by_id(spark, d):
    """Points with their places in the order of id, by sums over ranges of it."""
    from ..operators.statistics import running_sums

    p = points(spark, d).drop("val").withColumn("one", F.lit(1))
    return running_sums(p, "id", ["one"]).select("id", *_AXES, (F.col("run_one") - 1).alias("place"))


@_query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey ORDER BY total DESC, o_custkey")
def clusters_by_sum(spark, d):
    """Clusters by falling sums of their scores."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy(F.desc("total"), "o_custkey")


@_query("""SELECT l_orderkey, l_linenumber, l_extendedprice AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber)::INT AS place FROM lineitem""")
def alignments_sorted(spark, d):
    """A record's alignments by falling score."""
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("score"), F.row_number().over(w).alias("place"))


@_query("""WITH u AS (SELECT o_orderkey AS id, o_totalprice AS score FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 < 2)
 SELECT DISTINCT id, score FROM u ORDER BY score DESC, id LIMIT 500""")
def population_ordered(spark, d):
    """Two generations as one, each individual once: the 500 best."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    both = o.where("id % 3 > 0").unionByName(o.where("id % 3 < 2")).distinct()
    return both.orderBy(F.desc("score"), "id").limit(500)


@_query("SELECT o_custkey, arg_min(o_orderkey, (o_orderpriority, o_orderkey)) AS task FROM orders GROUP BY o_custkey")
def next_tasks(spark, d):
    """Each queue's next task: the lowest priority number, then the oldest."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderpriority", "o_orderkey")).alias("task"))


@_query("""WITH c AS (SELECT pos::INT AS pos, round(covar_pop(embedding[pos + 1]::DOUBLE, embedding[pos + 2]::DOUBLE), 9) AS cov FROM embeddings, range(63) p(pos) GROUP BY pos)
 SELECT pos, round(cov, 6) AS cov FROM c WHERE cov > (SELECT cov FROM c ORDER BY cov DESC LIMIT 1 OFFSET 9)""")
def feature_cutoff(spark, d):
    """Features whose covariance exceeds the 10th largest one."""
    e = F.col("embedding")
    one = table(spark, d, "embeddings").agg(*[F.round(F.covar_pop(e[i].cast("double"), e[i + 1].cast("double")), 9).alias(f"c{i}") for i in range(63)])
    c = one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.col(f"c{i}").alias("cov")) for i in range(63)])).alias("s")).select("s.*")
    cut = c.orderBy(F.desc("cov")).limit(10).agg(F.min("cov").alias("cut"))
    return c.join(F.broadcast(cut), F.col("cov") > F.col("cut")).select("pos", F.round("cov", 6).alias("cov"))


@_query("SELECT n_nationkey, a::INT AS axis FROM nation, range(3) t(a) WHERE a <> n_nationkey % 3")
def axis_difference(spark, d):
    """The axes that are not the tilt axis."""
    return table(spark, d, "nation").select("n_nationkey", F.explode(F.array_except(F.array(F.lit(0), F.lit(1), F.lit(2)), F.array(F.col("n_nationkey") % 3))).alias("axis"))


_TILTS = "t AS (SELECT lo::INT AS lo, hi::INT AS hi FROM range(-90, 1, 15) a(lo), range(0, 91, 15) b(hi) WHERE lo < hi)"


@_query(f"""WITH {_TILTS}, e AS (SELECT o_custkey, o_orderkey % 180 - 90 AS angle, o_totalprice AS v FROM orders),
 s AS (SELECT o_custkey, lo, hi, round(sum(CASE WHEN angle BETWEEN lo AND hi THEN v ELSE -v END), 4) AS score FROM e, t GROUP BY ALL)
 SELECT o_custkey, lo, hi, score FROM s QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, lo DESC, hi DESC) = 1""")
def best_tilt(spark, d):
    """The tilt range that holds most of a volume's energy and least of the rest: every range against every angle."""
    o = table(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 180 - 90).alias("angle"), F.col("o_totalprice").alias("v"))
    # a sum for each range, in one pass: no row is multiplied
    ranges = [(lo, hi) for lo in range(-90, 1, 15) for hi in range(0, 91, 15) if lo < hi]
    sums = o.groupBy("o_custkey").agg(*(F.sum(F.when(F.col("angle").between(lo, hi), F.col("v")).otherwise(-F.col("v"))).alias(f"s{i}") for i, (lo, hi) in enumerate(ranges)))
    best = sums.select("o_custkey", F.array_max(F.array(*(F.struct(F.round(f"s{i}", 4).alias("score"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, (lo, hi) in enumerate(ranges)))).alias("b"))
    return best.select("o_custkey", "b.lo", "b.hi", "b.score")
