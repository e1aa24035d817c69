"""Record algebra and statistics: filters, joins, dedup, top-k, relabelling, group averages, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_sized(df: DataFrame, group: str, least: int) -> DataFrame:
    """Rows of groups of at least `least` rows: grouped counts (combined before the shuffle) and a semi join."""
    return df.join(df.groupBy(group).count().where(F.col("count") >= least), group, "left_semi")


def first_of(df: DataFrame, key: str, *order) -> DataFrame:
    """One row a key, the first in the order given; rows travel as one aggregate buffer, not as a window."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("best"))
    return best.select(key, "best.*").select(df.columns)


def top_with_ties(df: DataFrame, group: list[str], score, k: int) -> DataFrame:
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*group).orderBy(score))).where(F.col("rank") <= k)


def dense_relabel(df: DataFrame, label: str, out: str = "new_label") -> DataFrame:
    """Labels numbered from 0 by falling size, then by label: sums over ranges of the grouped counts."""
    from .statistics import running_sums

    sizes = df.groupBy(label).count().select(label, F.struct((-F.col("count")).alias("n"), F.col(label).alias("l")).alias("_o"), F.lit(1).alias("_one"))
    numbers = running_sums(sizes, "_o", ["_one"]).select(label, (F.col("run__one") - 1).cast("int").alias(out))
    return df.join(numbers, label)


def zscore(df: DataFrame, group: list[str], column: str, out: str, limit: float | None = None) -> DataFrame:
    stats = df.groupBy(*group).agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    z = F.when(F.col("_s") == 0, 0.0).otherwise((F.col(column) - F.col("_m")) / F.col("_s"))
    z = z if limit is None else F.greatest(F.lit(-limit), F.least(F.lit(limit), z))
    return df.join(stats, group).withColumn(out, z).drop("_m", "_s")


def stretch(df: DataFrame, group: list[str], column: str, out: str) -> DataFrame:
    """Values mapped to 0..1 between the group's least and greatest."""
    stats = df.groupBy(*group).agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    return df.join(stats, group).withColumn(out, F.when(F.col("_b") == F.col("_a"), 0.0).otherwise((F.col(column) - F.col("_a")) / (F.col("_b") - F.col("_a")))).drop("_a", "_b")


def array_mean(df: DataFrame, group: str, column: str, size: int) -> DataFrame:
    """Element-wise mean of an array column by group: one aggregate an element, no explode."""
    sums = df.groupBy(group).agg(*[F.avg(F.col(column)[i].cast("double")).alias(f"e{i}") for i in range(size)], F.count("*").alias("n"))
    return sums.select(group, "n", F.array(*[f"e{i}" for i in range(size)]).alias("mean"))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def square_distance(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def _scored(records: DataFrame, templates: DataFrame, score, most_templates: int) -> DataFrame:
    if templates.limit(most_templates + 1).count() > most_templates:
        raise ValueError(f"more than {most_templates} templates")
    keyed = records.withColumn("_row", F.monotonically_increasing_id())
    return keyed.join(F.broadcast(templates), F.lit(True)).withColumn("score", score)


def best_template(records: DataFrame, templates: DataFrame, score, *, most_templates: int = 4096) -> DataFrame:
    """Each record's best template: (record columns, template_id, score); of equal scores the later template wins.

    The templates are a checked few: more than most_templates are refused. Pairs without a score (NaN) don't count.
    """
    pairs = _scored(records, templates, score, most_templates).where(~F.isnan("score"))
    best = pairs.groupBy("_row", *records.columns).agg(F.max(F.struct("score", "template_id")).alias("best"))
    return best.select(*records.columns, F.col("best.template_id").alias("template_id"), F.col("best.score").alias("score"))


def best_above(records: DataFrame, templates: DataFrame, score, floor: float, default: int, *, most_templates: int = 4096) -> DataFrame:
    """Each record's first template of the greatest score above the floor; where there is none, the default and no score."""
    pairs = _scored(records, templates, score, most_templates)
    real = F.when(~F.isnan("score") & (F.col("score") > floor), F.struct("score", (-F.col("template_id")).alias("t")))
    best = pairs.groupBy("_row", *records.columns).agg(F.max(real).alias("best"))
    return best.select(*records.columns, F.coalesce(-F.col("best.t"), F.lit(default)).alias("template_id"), F.col("best.score").alias("score"))


def precision_recall(df: DataFrame, predicted, truth, beta: float = 1.0) -> DataFrame:
    tp, fp, fn = (F.sum(F.when(c, 1).otherwise(0)) for c in (predicted & truth, predicted & ~truth, ~predicted & truth))
    one = df.agg(tp.cast("long").alias("tp"), fp.cast("long").alias("fp"), fn.cast("long").alias("fn"))
    b = beta * beta
    return one.select("tp", "fp", "fn", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("recall"), ((1 + b) * F.col("tp") / ((1 + b) * F.col("tp") + b * F.col("fn") + F.col("fp"))).alias("f_beta"))


def overlapping_spheres(points: DataFrame) -> DataFrame:
    """Pairs (a < b) of spheres (id, x, y, z, r) that overlap.

    Radii fall in classes by halves, each with a grid of its own. The larger of two (ties: the greater id) looks in its
    class's grid as far as twice its radius; the smaller one stands in one cell of every grid from its own class up.
    """
    most = max(float(points.agg(F.max("r")).first()[0] or 0.0), 1e-9)
    level = F.when(F.col("r") > 0, F.greatest(F.ceil(F.log2(F.col("r") / most)), F.lit(-8))).otherwise(F.lit(-8))
    at = points.where("r is not null").select("id", "x", "y", "z", "r").withColumn("level", F.least(level, F.lit(0)).cast("int"))
    width = F.pow(F.lit(2.0), F.col("level")) * most
    large = at.select("level", width.alias("_w"), *(F.col(c).alias(f"{c}2") for c in ("id", "x", "y", "z", "r")))
    for c in "xyz":
        ends = [F.floor((F.col(f"{c}2") + k * F.abs("r2") * (2 + 1e-9)) / F.col("_w")) for k in (-1, 1)]
        large = large.withColumn(f"c{c}", F.explode(F.sequence(*ends)))
    small = at.withColumn("level", F.explode(F.sequence("level", F.lit(0)))).select("*", *(F.floor(F.col(c) / width).alias(f"c{c}") for c in "xyz"))
    square = sum((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in "xyz")
    # explosions outgrow what Spark estimates of them: joined by sorting, not by broadcast
    met = small.join(large.drop("_w").hint("merge"), ["level", "cx", "cy", "cz"]).where((F.col("id") != F.col("id2")) & ((F.col("r") < F.col("r2")) | ((F.col("r") == F.col("r2")) & (F.col("id") < F.col("id2")))))
    return met.where(square < (F.col("r") + F.col("r2")) * (F.col("r") + F.col("r2"))).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))


def local_polynomials(column: str, size: int, width: int, degree: int = 3, derivative: int = 0) -> Column:
    """An array of `size` filtered by least-squares polynomials over `width` places; beyond its ends there is 0."""
    from ..functions.lines import local_polynomial

    weights = local_polynomial(width, degree, derivative)
    half = len(weights) // 2

    def at(i: Column) -> Column:
        # get() gives null outside of the array, also before its start
        return sum(F.lit(float(w)) * F.coalesce(F.get(F.col(column), (i + o - half).cast("int")).cast("double"), F.lit(0.0)) for o, w in enumerate(weights))

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at)
