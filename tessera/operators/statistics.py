"""Statistics of groups, scores and volumes: ordered sums, ranks, moments, spectra, agreement measures.

Sums in the order of a column never pass through one task: rows are dealt by ranges of the column, summed
within them, and the totals of the ranges before (one row a range) are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import settle


def running_sums(df: DataFrame, order: str, columns: list[str], *, descending: bool = False) -> DataFrame:
    """Adds run_<c> and all_<c>: sums of c over the rows up to this one in the order, and over all. order has no ties."""
    at = F.desc(order) if descending else F.asc(order)
    dealt = settle(df.repartitionByRange(at).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in columns], *[F.sum(f"_t_{c}").over(every).alias(f"all_{c}") for c in columns])
    run = Window.partitionBy("_range").orderBy(at)
    out = dealt.select("*", *[F.sum(c).over(run).alias(f"_r_{c}") for c in columns]).join(F.broadcast(offsets), "_range")
    return out.select(*df.columns, *[(F.col(f"_r_{c}") + F.col(f"_b_{c}")).alias(f"run_{c}") for c in columns], *[f"all_{c}" for c in columns])


def roc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """(score, tpr, fpr) at every distinct score."""
    by = df.groupBy(score).agg(F.sum(truth).cast("long").alias("_pos"), (F.count("*") - F.sum(truth)).cast("long").alias("_neg"))
    return running_sums(by, score, ["_pos", "_neg"], descending=True).select(score, F.try_divide("run__pos", "all__pos").alias("tpr"), F.try_divide("run__neg", "all__neg").alias("fpr"))


def average_precision(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Area under precision against recall: each distinct score's precision, weighted by the recall it adds."""
    by = df.groupBy(score).agg(F.sum(truth).cast("long").alias("_pos"), F.count("*").alias("_all"))
    return running_sums(by, score, ["_pos", "_all"], descending=True).agg(F.sum(F.col("run__pos") / F.col("run__all") * F.try_divide("_pos", "all__pos")).alias("auprc"))


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, n, rank): every distinct value with the mean of its rows' ranks, from 1."""
    by = df.groupBy(value).agg(F.count("*").alias("n"))
    return running_sums(by, value, ["n"]).select(value, "n", (F.col("run_n") - (F.col("n") - 1) / 2).alias("rank"))


def mann_whitney(df: DataFrame, value: str, first: Column) -> DataFrame:
    """(n1, n2, u): U of the rows where first holds against the others."""
    by = df.groupBy(value).agg(F.sum(first.cast("long")).alias("n1"), F.count("*").alias("n"))
    ranks = running_sums(by, value, ["n"]).withColumn("rank", F.col("run_n") - (F.col("n") - 1) / 2)
    one = ranks.agg(F.sum("n1").alias("n1"), (F.sum("n") - F.sum("n1")).alias("n2"), F.sum(F.col("n1") * F.col("rank")).alias("r1"))
    return one.select("n1", "n2", (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u"))


def wilcoxon(df: DataFrame, difference: Column) -> DataFrame:
    """(n, w_plus, w_minus) of the differences that are not 0."""
    d = df.select(difference.alias("d")).where("d <> 0")
    by = d.groupBy(F.abs("d").alias("a")).agg(F.sum((F.col("d") > 0).cast("long")).alias("up"), F.count("*").alias("n"))
    ranks = running_sums(by, "a", ["n"]).withColumn("rank", F.col("run_n") - (F.col("n") - 1) / 2)
    return ranks.agg(F.sum("n").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("w_plus"), F.sum((F.col("n") - F.col("up")) * F.col("rank")).alias("w_minus"))


def cumulative_share(df: DataFrame, key: str, score: str) -> DataFrame:
    """(key, share): the distribution by which a roulette picks rows, in the order of key; the least score has no share."""
    low = df.agg(F.min(score).alias("_low"))
    above = df.join(F.broadcast(low), F.lit(True)).select(key, (F.col(score) - F.col("_low")).alias("_s"))
    return running_sums(above, key, ["_s"]).select(key, (F.col("run__s") / F.col("all__s")).alias("share"))


def soft_scores(df: DataFrame, p: Column, truth: Column) -> DataFrame:
    """Precision, recall, false-positive rate and F1 of probabilities, none thresholded."""
    s = df.agg(F.sum(p * truth).alias("tp"), F.sum(p).alias("p"), F.sum(truth).alias("t"), F.sum(p * (1 - truth)).alias("fp"), F.sum(1 - truth).alias("f"))
    s = s.select((F.col("tp") / F.col("p")).alias("precision"), (F.col("tp") / F.col("t")).alias("recall"), (F.col("fp") / F.col("f")).alias("fpr"))
    return s.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))


def overlap(df: DataFrame, group: str, a: Column, b: Column) -> DataFrame:
    """(group, dice, iou) of two masks."""
    n = [F.sum(c.cast("long")) for c in (a & b, a, b)]
    s = df.groupBy(group).agg(n[0].alias("i"), n[1].alias("a"), n[2].alias("b"))
    return s.select(group, F.try_divide(2 * F.col("i"), F.col("a") + F.col("b")).alias("dice"), F.try_divide(F.col("i"), F.col("a") + F.col("b") - F.col("i")).alias("iou"))


def smooth_by_rank(df: DataFrame, group: str, order: list[Column], value: str, weights: list[float]) -> DataFrame:
    """(group, rank from 0, value): values in their order, convolved with symmetric weights, ends reflected.

    Each row gives its weighted share to the ranks within reach; a group shorter than the reach is reflected once only.
    """
    r = len(weights) // 2
    w = Window.partitionBy(group).orderBy(*order)
    counts = df.groupBy(group).agg(F.count("*").alias("_n"))
    at = df.select(group, F.col(value).alias("_v"), (F.row_number().over(w) - 1).alias("_i")).join(counts, group)
    table = F.array(*[F.lit(float(x)) for x in weights])
    at = at.select(group, "_v", "_n", F.explode(F.array("_i", -F.col("_i") - 1, 2 * F.col("_n") - 1 - F.col("_i"))).alias("_s")).where(F.col("_s").between(-r, F.col("_n") + r - 1))
    at = at.select(group, "_v", "_n", "_s", F.explode(F.sequence(F.lit(-r), F.lit(r))).alias("_o")).withColumn("rank", (F.col("_s") - F.col("_o")).cast("int")).where("rank >= 0 and rank < _n")
    return at.groupBy(group, "rank").agg(F.sum(F.col("_v") * F.element_at(table, F.col("_o") + r + 1)).alias(value))


def moments(df: DataFrame, group: str, column: str, size: int) -> DataFrame:
    """(group, n, sums, products): sums of an array column's elements and of their products by pairs (size * size).

    One row an Arrow batch and group goes to the shuffle, whatever the number of rows.
    """
    kind = df.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
            where = keys.dictionary_encode()
            codes = where.indices.to_numpy()
            rows = [values[codes == k] for k in range(len(where.dictionary))]
            yield pa.RecordBatch.from_arrays([where.dictionary, pa.array([len(r) for r in rows], pa.int64()), pa.array([r.sum(0).tolist() for r in rows], pa.list_(pa.float64())), pa.array([(r.T @ r).ravel().tolist() for r in rows], pa.list_(pa.float64()))], [group, "n", "sums", "products"])

    valid = df.select(group, column).where(F.col(group).isNotNull() & (F.size(column) == size) & ~F.exists(column, lambda x: x.isNull()))
    parts = valid.mapInArrow(run, f"{group} {kind}, n long, sums array<double>, products array<double>")
    wide = parts.select(group, "n", F.posexplode(F.concat("sums", "products")).alias("pos", "v")).groupBy(group, "pos").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    ordered = wide.groupBy(group).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("all"))  # size + size**2 rows a group
    return ordered.select(group, "n", F.slice("all", 1, size).alias("sums"), F.slice("all", size + 1, size * size).alias("products"))


def covariances(df: DataFrame, group: str, column: str, size: int) -> DataFrame:
    """(group, i, j, cov): sample covariances of an array column's elements."""
    m = moments(df, group, column, size)
    cov = F.transform("products", lambda p, k: (p - F.get("sums", F.floor(k / size).cast("int")) * F.get("sums", k % size) / F.col("n")) / (F.col("n") - 1))
    return m.select(group, F.posexplode(cov).alias("pos", "cov")).select(group, F.floor(F.col("pos") / size).cast("int").alias("i"), (F.col("pos") % size).alias("j"), "cov")


def coral(df: DataFrame, group: str, a, b, column: str, size: int) -> DataFrame:
    """Frobenius distance of two groups' covariances over 4 * size**2."""
    c = covariances(df.where(F.col(group).isin(a, b)), group, column, size)
    return c.groupBy("i", "j").agg(F.sum(F.when(F.col(group) == a, F.col("cov")).otherwise(-F.col("cov"))).alias("d")).agg((F.sqrt(F.sum(F.col("d") * F.col("d"))) / 4 / size / size).alias("coral"))


def principal_axes(df: DataFrame, column: str, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest variances and their axes (k, size). The driver gets size * size sums."""
    row = moments(df.withColumn("_g", F.lit(0)), "_g", column, size).first()
    n, sums = row["n"], np.array(row["sums"])
    values, vectors = np.linalg.eigh((np.array(row["products"]).reshape(size, size) - np.outer(sums, sums) / n) / (n - 1))
    return values[::-1][:k], vectors[:, ::-1][:, :k].T


def spectral_snr(df: DataFrame, group: str, column: str, shape: tuple[int, int, int], *, width: float = 1.0) -> DataFrame:
    """(group, r, ssnr, fsc): per overlapping shell |sum|**2 of the mean spectrum over its variance; fsc = s / (2 + s).

    Sums of the spectra and of their squares are made a batch; only those, size values a group, are exchanged.
    """
    size = int(np.prod(shape))
    kind = df.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.column(0).dictionary_encode()
            codes = where.indices.to_numpy()
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, *shape)
            f = np.fft.fftshift(np.fft.fftn(v, axes=(1, 2, 3)), axes=(1, 2, 3)).reshape(-1, size)
            for k, key in enumerate(where.dictionary):
                own = f[codes == k]
                total = own.sum(0)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * size, batch.schema.field(0).type), pa.array(np.arange(size, dtype=np.int32)), pa.array(np.full(size, len(own), np.int64)), pa.array(total.real), pa.array(total.imag), pa.array((np.abs(own) ** 2).sum(0))], [group, "pos", "n", "re", "im", "sq"])

    valid = df.select(group, column).where(F.col(group).isNotNull() & (F.size(column) == size) & ~F.exists(column, lambda x: x.isNull()))
    sums = valid.mapInArrow(run, f"{group} {kind}, pos int, n long, re double, im double, sq double").groupBy(group, "pos").agg(*[F.sum(c).alias(c) for c in ("n", "re", "im", "sq")]).where("n >= 2")
    x, y, z = (F.floor(F.col("pos") / (shape[1] * shape[2])), F.floor(F.col("pos") / shape[2]) % shape[1], F.col("pos") % shape[2])
    radius = F.sqrt(sum((c - n // 2) * (c - n // 2) for c, n in zip((x, y, z), shape)))
    mean = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("n") * F.col("n"))
    at = sums.select(group, "n", mean.alias("a"), ((F.col("sq") - F.col("n") * mean) / (F.col("n") - 1)).alias("v"), radius.alias("rad"))
    at = at.select("*", F.explode(F.sequence(F.lit(0), F.lit(min(shape) // 2))).alias("r")).where(F.abs(F.col("rad") - F.col("r")) <= width)
    s = F.when(F.sum("v") > 0, F.sum("a") / F.sum(F.col("v") / F.col("n"))).otherwise(0.0)
    return at.groupBy(group, "r").agg(s.alias("ssnr")).withColumn("fsc", F.col("ssnr") / (2 + F.col("ssnr")))


def accuracy_by_threshold(df: DataFrame, distance: str, same: str, thresholds: list[float]) -> DataFrame:
    """(threshold, tpr, fpr, acc) of the rule that a pair below the threshold is the same; rates of nothing are 0.

    Pairs are counted by the first threshold above them, which are few rows, before those are summed.
    """
    rows = _counts_by_threshold(df, [], distance, same, thresholds)
    tpr = F.when(F.col("p") == 0, 0.0).otherwise(F.col("tp") / F.col("p"))
    fpr = F.when(F.col("n") == 0, 0.0).otherwise(F.col("fp") / F.col("n"))
    return rows.select("threshold", tpr.alias("tpr"), fpr.alias("fpr"), ((F.col("tp") + F.col("n") - F.col("fp")) / (F.col("p") + F.col("n"))).alias("acc"))


def _counts_by_threshold(df: DataFrame, groups: list[str], distance: str, same: str, thresholds: list[float]) -> DataFrame:
    """(groups..., threshold, tp, fp, p, n): pairs below every threshold, and all, by whether they are the same."""
    table = F.array(*[F.lit(float(t)) for t in thresholds])
    first = F.size(F.filter(table, lambda t: t <= F.col(distance)))  # how many thresholds don't accept the pair
    by = df.groupBy(*groups, first.alias("_f")).agg(F.sum(F.col(same).cast("long")).alias("_p"), F.sum((~F.col(same)).cast("long")).alias("_n"))
    wide = by.select(*groups, "_f", "_p", "_n", F.posexplode(table).alias("_i", "threshold"))
    below = F.col("_f") <= F.col("_i")
    return wide.groupBy(*groups, "threshold").agg(F.sum(F.when(below, F.col("_p")).otherwise(0)).alias("tp"), F.sum(F.when(below, F.col("_n")).otherwise(0)).alias("fp"), F.sum("_p").alias("p"), F.sum("_n").alias("n"))


def validation_at(df: DataFrame, distance: str, same: str, fold: str, thresholds: list[float], target: float) -> DataFrame:
    """(fold, threshold, val, far): the threshold at a false accept rate of target on the other folds, between two of the
    list (0 where none reaches it), and the true and false accept rates that it has on the fold."""
    counts = _counts_by_threshold(df, [fold], distance, same, thresholds)
    every = counts.groupBy("threshold").agg(F.sum("fp").alias("_fp"), F.sum("n").alias("_n"))
    rest = counts.join(every, "threshold").select(fold, "threshold", ((F.col("_fp") - F.col("fp")) / (F.col("_n") - F.col("n"))).alias("far"))
    high = rest.where(F.col("far") >= target).groupBy(fold).agg(F.min(F.struct("threshold", "far")).alias("h"))
    low = rest.join(high, fold).where(F.col("threshold") < F.col("h.threshold")).groupBy(fold).agg(F.max(F.struct("threshold", "far")).alias("l"))
    between = F.col("l.threshold") + (F.col("h.threshold") - F.col("l.threshold")) * (target - F.col("l.far")) / (F.col("h.far") - F.col("l.far"))
    cut = rest.select(fold).distinct().join(high, fold, "left").join(low, fold, "left")
    cut = cut.select(fold, F.coalesce(F.when(F.col("h.far") > F.col("l.far"), between).otherwise(F.col("h.threshold")), F.col("h.threshold"), F.lit(0.0)).alias("threshold"))
    accepted = df.join(cut, fold).withColumn("_a", F.col(distance) < F.col("threshold"))
    share = lambda keep: F.sum((F.col("_a") & keep).cast("long")) / F.sum(keep.cast("long"))
    return accepted.groupBy(fold, "threshold").agg(share(F.col(same)).alias("val"), share(~F.col(same)).alias("far"))
