"""Genetic choice of subsets, group by group, with the population spread over the records.

A record carries one bit an individual: whether it is a member of it. A generation's fitness is one product of these bits
with the records' spectra in the executors, added up over tasks; parents, places of crossing and survivors are a small
table, one row a group; children's bits come from their parents' bits in the record's own row. No volume and no set of
members reaches the driver, and a group may hold any share of all records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spectra import Shape, radii, usable
from ..plans.iterate import drop, settle

#: Bytes of sums that a task holds before it sends them.
_HELD = 64 << 20


def _uniform(*of: Column) -> Column:
    """A number in [0, 1) that the values fix."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 30)) / float(1 << 30)


def shell_score(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, shape: Shape) -> np.ndarray:
    """Scores of sets by their numbers, spectral sums and sums of squares (rows, places): sums over the shells of the FSC that
    the ratio of signal and noise gives; 0 below two members."""
    r = radii(shape).ravel()
    shells = np.array([np.abs(r - k) <= 1 for k in range(min(shape) // 2 + 1)], float).T
    several = np.maximum(n, 2)[:, None]
    mean = np.abs(sums / several) ** 2
    signal, noise = mean @ shells, (np.maximum(squares - several * mean, 0) / (several - 1) / several) @ shells
    s = np.where(noise > 0, signal / np.where(noise > 0, noise, 1), 0)
    return np.where(n >= 2, (s / (2 + s)).sum(1), 0.0)


def fitness(rows: DataFrame, group: str, shape: Shape, population: int) -> DataFrame:
    """(group, individual, n, score) of every individual of rows (group, v, bits)."""
    size = int(np.prod(shape))
    kind = rows.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        kind_pa = None

        def flush() -> Iterator[pa.RecordBatch]:
            for g, (n, s, q) in sums.items():
                who = np.repeat(np.arange(population, dtype=np.int32), size)
                columns = [pa.array([g] * len(who), kind_pa), pa.array(who), pa.array(np.tile(np.arange(size, dtype=np.int32), population))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.repeat(n, size)), *(pa.array(np.ascontiguousarray(x).ravel()) for x in (s.real, s.imag, q))], ["g", "i", "pos", "n", "re", "im", "sq"])
            sums.clear()

        for batch in batches:
            kind_pa = batch.schema.field(0).type
            f = np.fft.fftn(batch.column(1).flatten().to_numpy().reshape(-1, *shape), axes=(1, 2, 3)).reshape(len(batch), -1)
            bits = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), population).astype(float)
            names = batch.column(0).to_pylist()
            for g in dict.fromkeys(names):
                own = np.array([x == g for x in names])
                n, s, q = sums.get(g) or (np.zeros(population, np.int64), np.zeros((population, size), complex), np.zeros((population, size)))
                sums[g] = n + bits[own].sum(0).astype(np.int64), s + bits[own].T @ f[own], q + bits[own].T @ np.abs(f[own]) ** 2
                if len(sums) * population * size * 24 > _HELD:
                    yield from flush()
        yield from flush()

    def scored(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("pos").to_numpy())
        re, im, sq = (table.column(c).to_numpy()[order] for c in ("re", "im", "sq"))
        n = int(table.column("n")[0].as_py())
        return table.select(["g", "i"]).slice(0, 1).append_column("n", pa.array([n])).append_column("score", pa.array(shell_score(np.array([n]), (re + 1j * im)[None], sq[None], shape)))

    parts = rows.select(group, "v", "bits").mapInArrow(run, f"g {kind}, i int, pos int, n long, re double, im double, sq double")
    whole = parts.groupBy("g", "i", "pos").agg(*(F.sum(c).alias(c) for c in ("n", "re", "im", "sq")))
    return whole.groupBy("g", "i").applyInArrow(scored, f"g {kind}, i int, n long, score double").withColumnRenamed("g", group).withColumnRenamed("i", "individual")


def _scores(found: DataFrame, group: str, least: int) -> DataFrame:
    """(group, scores): one row a group, in the individuals' order; below `least` members the score is -1."""
    score = F.when(F.col("n") >= least, F.round("score", 9)).otherwise(-1.0)
    ordered = found.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("individual", score.alias("s")))).alias("_s"))  # one an individual
    return ordered.select(group, F.transform("_s", lambda x: x["s"]).alias("scores"))


def evolve(records: DataFrame, group: str, key: str, column: str, shape: Shape, *, population: int = 24, generations: int = 30, patience: int = 8, mutation: float = 0.02, least: int = 2, seed: int = 1) -> DataFrame:
    """(group, key, score): the members of each group's best set, and its score, the sum of its Fourier shell correlations.

    Parents are drawn by their score above the least; two cross at a place of the records' order by hash, bits flip with
    the chance `mutation`, and the best of parents and children live on, of equal ones the older. Ends when no group's best has
    risen for `patience` generations, or after `generations`. Records whose volume is null, of another size or holds null
    or a value that is not finite take no part, nor do those without a group; a group that never has `least` members in a
    set has no rows. Keys are distinct.
    """
    size = int(np.prod(shape))
    rows = records.select(F.col(group).alias("_g"), F.col(key).alias("_k"), F.col(column).cast("array<double>").alias("v")).where(F.col("_g").isNotNull() & F.col("_k").isNotNull() & usable("v", size))
    rows = settle(rows.where(~F.exists("v", lambda e: F.isnan(e) | (F.abs(e) == float("inf")))))
    each = F.sequence(F.lit(0), F.lit(population - 1))
    bits = settle(rows.select("_g", "_k", F.transform(each, lambda i: _uniform(F.col("_k"), i, F.lit(seed)) < 0.5).alias("bits")))

    def measured(which: DataFrame) -> DataFrame:
        return settle(_scores(fitness(rows.join(which.select("_k", "bits"), "_k"), "_g", shape, population), "_g", least))

    state = settle(measured(bits).withColumns({"best": F.array_max("scores"), "since": F.lit(0)}))
    for generation in range(generations):
        if not state.where(F.col("since") < patience).limit(1).count():
            break
        now = F.lit(seed * 1000003 + generation + 1)
        weight = F.transform("scores", lambda s: s - F.array_min("scores") + 1e-12)
        plan = state.withColumn("_w", weight).withColumn("_sum", F.aggregate("_w", F.lit(0.0), lambda a, x: a + x))
        ends = F.transform(each, lambda i: F.aggregate(F.slice("_w", F.lit(1), i + 1), F.lit(0.0), lambda a, x: a + x) / F.col("_sum"))
        plan = plan.withColumn("_ends", ends)

        def parent(which: int) -> Column:
            drawn = lambda c: _uniform(F.col("_g"), c, now, F.lit(which))  # noqa: E731, B023
            return F.transform(each, lambda c: F.least(F.size(F.filter("_ends", lambda e: e <= drawn(c))), F.lit(population - 1)))

        plan = plan.select("_g", parent(1).alias("_a"), parent(2).alias("_b"), F.transform(each, lambda c: _uniform(F.col("_g"), c, now, F.lit(3))).alias("_cut"))  # noqa: B023
        place = _uniform(F.col("_k"), F.lit(seed))

        def child(c: Column) -> Column:
            inherited = F.when(place < F.get("_cut", c), F.get("bits", F.get("_a", c))).otherwise(F.get("bits", F.get("_b", c)))  # noqa: B023
            return inherited != (_uniform(F.col("_k"), c, now, F.lit(4)) < mutation)  # noqa: B023

        children = settle(bits.join(plan, "_g").select("_g", "_k", F.transform(each, child).alias("bits")))
        born = measured(children)
        every = F.concat("scores", "_new")
        order = F.slice(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(2 * population - 1)), lambda i: F.struct((-F.get(every, i)).alias("s"), i.alias("i")))), 1, population)
        chosen = state.join(born.withColumnRenamed("scores", "_new"), "_g").withColumn("_order", order)
        chosen = chosen.select("_g", F.transform("_order", lambda x: -x["s"]).alias("scores"), F.transform("_order", lambda x: x["i"]).alias("_live"), "best", "since")
        chosen = settle(chosen.withColumn("_top", F.array_max("scores")).select("_g", "scores", "_live", F.greatest("best", "_top").alias("best"), F.when(F.col("_top") > F.col("best"), 0).otherwise(F.col("since") + 1).alias("since")))
        both = bits.join(children.select("_k", F.col("bits").alias("_more")), "_k").join(chosen.select("_g", "_live"), "_g")
        following = settle(both.select("_g", "_k", F.transform("_live", lambda i: F.get(F.concat("bits", "_more"), i)).alias("bits")))
        drop(bits, children, state, born)
        bits, state = following, settle(chosen.drop("_live"))
        drop(chosen)
    top = state.select("_g", F.array_max("scores").alias("score"), (F.array_position("scores", F.array_max("scores")) - 1).cast("int").alias("_i")).where(F.col("score") >= 0)
    out = bits.join(top, "_g").where(F.get("bits", F.col("_i")))
    return out.select(F.col("_g").alias(group), F.col("_k").alias(key), "score")
