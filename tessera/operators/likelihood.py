"""Maximum-likelihood averaging: classes under all poses, each record a mixture over class, turn and translation.

A record's spectrum X is a class's volume A, turned and moved, plus noise of variance sigma2 where the record's mask
measures. Turns come from a list; translations are all cyclic ones, at once, by one inverse transform a turn; a Gaussian
of width xi makes long ones unlikely. A round is two passes over (record, part of the turns): the first gives the sum of
the likelihoods of a part, combined to each record's total by a log-sum-exp over the parts; the second adds what each
record gives to each class. Within a task the records' shares are added before they are turned back, so that a turn costs
one rotation a class and batch and not one a record; a task sends one sum of a class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rotation as K
from ..functions.spectra import Shape, frequencies, usable
from ..plans.iterate import drop, settle

#: Most bytes of all classes' volumes, which every task holds.
MODEL_BYTES = 64 << 20
#: Turns of a part: what one row of work is.
PART = 64
_LEAST = 1e-6


@dataclass
class Model:
    """Classes' volumes a (k, x, y, z) and shares alpha, the noise's variance and the width of the translations."""

    a: np.ndarray
    alpha: np.ndarray
    sigma2: float
    xi: float
    log_likelihood: float = -np.inf


def _spectra(batch: pa.RecordBatch, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(masked spectra, uncentred masks), scaled so that squared sums are those of the volumes."""
    v, m = (batch.column(c).flatten().to_numpy().reshape(-1, *shape) for c in ("v", "m"))
    mask = np.fft.ifftshift(np.clip(m, 0, 1), axes=(1, 2, 3))
    return np.fft.fftn(v, axes=(1, 2, 3)) / np.sqrt(np.prod(shape)) * mask, mask


def _terms(x: np.ndarray, mask: np.ndarray, model: Model, k: int, back) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihoods, squared errors) (rows, translations) of records under class k and one turn; back is the turn's inverse."""
    shape = x.shape[1:]
    size = np.prod(shape)
    b = np.fft.fftn(K.rotate(model.a[k], back)) / np.sqrt(size)
    both = np.fft.ifftn(x * mask * b.conj(), axes=(1, 2, 3)).real * size  # the record is b moved by the place
    own = (np.abs(x) ** 2).sum((1, 2, 3)) + (mask**2 * np.abs(b) ** 2).sum((1, 2, 3))
    error = np.maximum(own[:, None] - 2 * both.reshape(len(x), -1), 0.0)
    far = sum(f.astype(float) ** 2 for f in frequencies(shape)).ravel()
    return -error / (2 * model.sigma2) - far / (2 * model.xi**2) + np.log(max(model.alpha[k], 1e-300)), error


def _prior(shape: Shape, xi: float, turns: int) -> float:
    """Log of what the weights of all turns and translations add up to."""
    far = sum(f.astype(float) ** 2 for f in frequencies(shape))
    return float(np.log(np.exp(-far / (2 * xi**2)).sum() * turns))


def _parts(records: DataFrame, turns: int) -> DataFrame:
    """Every record once for each part of the turns."""
    count = -(-turns // PART)
    return records.withColumn("_part", F.explode(F.array(*[F.lit(i) for i in range(count)])))


def _usable(records: DataFrame, key: str, shape: Shape) -> DataFrame:
    size = int(np.prod(shape))
    rows = records.select(key, F.col("v").cast("array<double>"), F.col("m").cast("array<double>")).where(usable("v", size) & usable("m", size))
    return rows.where(~F.exists("v", lambda e: F.isnan(e) | (F.abs(e) == float("inf"))) & ~F.exists("m", lambda e: F.isnan(e)))


def _expected(rows: DataFrame, key: str, shape: Shape, turns: list, model: Model) -> DataFrame:
    """(key, total, k, turn, place, top): each record's log total over class, turn and translation, and its likeliest one."""
    kind = rows.schema[key].dataType.simpleString()
    backs = [K.inverse(t, (0, 0, 0))[0] for t in turns]
    sent = rows.sparkSession.sparkContext.broadcast((model, backs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, backs = sent.value
        for batch in batches:
            x, mask = _spectra(batch, shape)
            part = batch.column("_part").to_numpy()
            n = len(batch)
            most, total = np.full(n, -np.inf), np.zeros(n)
            best = np.zeros((n, 3), np.int64)
            for t, back in enumerate(backs):
                own = np.flatnonzero(part == t // PART)
                for k in range(len(model.a) if len(own) else 0):
                    ln, _ = _terms(x[own], mask[own], model, k, back)
                    place = np.round(ln, 9).argmax(1)
                    top = ln[np.arange(len(own)), place]
                    new = np.maximum(most[own], top)
                    total[own] = total[own] * np.exp(most[own] - new) + np.exp(ln - new[:, None]).sum(1)
                    better = top > most[own] + 1e-9
                    best[own[better]] = np.stack((np.full(better.sum(), k), np.full(better.sum(), t), place[better]), 1)
                    most[own] = new
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(most), pa.array(total), *(pa.array(best[:, i]) for i in range(3))], [key, "most", "sum", "k", "turn", "place"])

    found = _parts(rows, len(turns)).mapInArrow(run, f"{key} {kind}, most double, sum double, k long, turn long, place long")
    # one row a part: the greatest first, then the sum of all under it
    g = found.groupBy(key).agg(F.max(F.struct("most", -F.col("k"), -F.col("turn"), "k", "turn", "place")).alias("b"), F.collect_list(F.struct("most", "sum")).alias("_p"))
    total = F.aggregate("_p", F.lit(0.0), lambda s, p: s + p["sum"] * F.exp(p["most"] - F.col("b.most")))
    return g.select(key, (F.col("b.most") + F.log(total)).alias("total"), "b.k", "b.turn", "b.place", F.col("b.most").alias("top"))


def _maximised(rows: DataFrame, totals: DataFrame, key: str, shape: Shape, turns: list, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """(weighted volumes' spectra, weights by frequency, shares, squared error, squared translations) summed over all records."""
    size = int(np.prod(shape))
    backs = [K.inverse(t, (0, 0, 0))[0] for t in turns]
    sent = rows.sparkSession.sparkContext.broadcast((model, turns, backs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, turns, backs = sent.value
        count = len(model.a)
        far = sum(f.astype(float) ** 2 for f in frequencies(shape)).ravel()
        sums, weights = np.zeros((count, *shape)), np.zeros((count, *shape))
        share, error, moved = np.zeros(count), np.zeros(count), np.zeros(count)
        for batch in batches:
            x, mask = _spectra(batch, shape)
            part, total = batch.column("_part").to_numpy(), batch.column("total").to_numpy()
            for t, back in enumerate(backs):
                own = np.flatnonzero(part == t // PART)
                for k in range(count if len(own) else 0):
                    ln, squares = _terms(x[own], mask[own], model, k, back)
                    r = np.exp(ln - total[own, None])
                    share[k] += r.sum()
                    error[k] += (r * squares).sum()
                    moved[k] += (r * far).sum()
                    phases = np.fft.fftn(r.reshape(-1, *shape), axes=(1, 2, 3)).conj()  # moves the records back
                    flat = (x[own] * mask[own] * phases).sum(0)
                    sums[k] += K.rotate(np.fft.ifftn(flat).real * np.sqrt(size), turns[t], pad="zero")
                    centred = np.fft.fftshift((mask[own] ** 2 * r.sum(1)[:, None, None, None]).sum(0))
                    whole = max(centred.max(), 1e-300)
                    weights[k] += K.rotate_mask(centred / whole, turns[t]) * whole
        for k in range(count):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, k)), pa.array(np.arange(size)), pa.array(sums[k].ravel()), pa.array(weights[k].ravel()), *(pa.array(np.where(np.arange(size) == 0, v[k], 0.0)) for v in (share, error, moved))], ["k", "pos", "s", "w", "share", "error", "moved"])

    joined = _parts(rows.join(totals.select(key, "total"), key), len(turns)).select(key, "v", "m", "total", "_part")
    parts = joined.mapInArrow(run, "k long, pos long, s double, w double, share double, error double, moved double")
    got = parts.groupBy("k", "pos").agg(*(F.sum(c).alias(c) for c in ("s", "w", "share", "error", "moved"))).toPandas()  # as large as the model
    sums, weights = np.zeros((len(model.a), size)), np.zeros((len(model.a), size))
    sums[got.k, got.pos], weights[got.k, got.pos] = got.s, got.w
    share = got.groupby("k").share.sum().reindex(range(len(model.a)), fill_value=0.0).to_numpy()
    return sums.reshape(-1, *shape), np.fft.ifftshift(weights.reshape(-1, *shape), axes=(1, 2, 3)), share, float(got.error.sum()), float(got.moved.sum())


def start(records: DataFrame, key: str, shape: Shape, classes: int) -> Model:
    """A model of the records dealt to the classes by their keys' hashes: means of what the masks measure."""
    size = int(np.prod(shape))
    if classes * size * 8 > MODEL_BYTES:
        raise ValueError(f"the classes' volumes exceed {MODEL_BYTES} bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, squares, seen = np.zeros((classes, size)), np.zeros(classes), 0.0, 0.0
        for batch in batches:
            x, mask = _spectra(batch, shape)
            v = np.fft.ifftn(x, axes=(1, 2, 3)).real * np.sqrt(size)
            np.add.at(sums, batch.column("k").to_numpy(), v.reshape(len(v), -1))
            np.add.at(n, batch.column("k").to_numpy(), 1)
            squares += float((np.abs(x) ** 2).sum())
            seen += float(mask.sum())
        for k in range(classes):
            one = np.arange(size) == 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, k)), pa.array(np.arange(size)), pa.array(sums[k]), *(pa.array(np.where(one & (k == 0 or c == 0), v, 0.0)) for c, v in enumerate((n[k], squares, seen)))], ["k", "pos", "s", "n", "squares", "seen"])

    rows = _usable(records, key, shape).withColumn("k", F.pmod(F.xxhash64(key), F.lit(classes)).cast("int"))
    got = rows.mapInArrow(run, "k long, pos long, s double, n double, squares double, seen double").groupBy("k", "pos").agg(*(F.sum(c).alias(c) for c in ("s", "n", "squares", "seen"))).toPandas()
    a = np.zeros((classes, size))
    n = got.groupby("k").n.sum().reindex(range(classes), fill_value=0.0).to_numpy()
    a[got.k, got.pos] = got.s
    a /= np.maximum(n, 1)[:, None]
    sigma2 = max(float(got.squares.sum()) / max(float(got.seen.sum()), 1.0), _LEAST)
    return Model(a.reshape(-1, *shape), np.full(classes, 1 / classes), sigma2, float(max(shape)))


def averages(records: DataFrame, key: str, shape: Shape, turns: list, classes: int, *, rounds: int = 20, tolerance: float = 1e-4, model: Model | None = None) -> tuple[Model, list[float], DataFrame]:
    """(model, log-likelihood by round, predictions) of records (key, v, m), m their masks over centred frequencies.

    Ends when the log-likelihood gains less than `tolerance` a record. Predictions (key, k, angle, loc, share): the
    likeliest class and the pose that turns the record onto it, as rotation.rotate takes it. Records whose volume or mask is
    null, of another size or not finite take no part; without any, the log-likelihoods are empty.
    """
    rows = settle(_usable(records, key, shape))
    size = int(np.prod(shape))
    n = rows.count()
    model = start(rows, key, shape, classes) if model is None else model
    seen = float(rows.select(F.sum(F.aggregate("m", F.lit(0.0), lambda s, e: s + F.least(F.greatest(e, F.lit(0.0)), F.lit(1.0))))).first()[0] or 0.0)
    history: list[float] = []
    for _ in range(rounds if n else 0):
        totals = settle(_expected(rows, key, shape, turns, model))
        likelihood = float(totals.select(F.sum("total")).first()[0]) - n * _prior(shape, model.xi, len(turns)) - seen / 2 * np.log(2 * np.pi * model.sigma2)
        model.log_likelihood = likelihood
        history.append(likelihood)
        if len(history) > 1 and history[-1] - history[-2] < tolerance * n:
            drop(totals)
            break
        sums, weights, share, error, moved = _maximised(rows, totals, key, shape, turns, model)
        drop(totals)
        old = np.fft.fftn(model.a, axes=(1, 2, 3))
        new = np.fft.fftn(sums, axes=(1, 2, 3))
        # frequencies that no record of the class measures keep what they were
        spectrum = np.where(weights > _LEAST * max(1.0, n / classes), new / np.maximum(weights, 1e-300), old)
        model = Model(np.fft.ifftn(spectrum, axes=(1, 2, 3)).real, share / max(share.sum(), 1e-300), max(error / max(seen, 1.0), _LEAST), max(np.sqrt(moved / (3 * n)), 1e-2))
    last = _expected(rows, key, shape, turns, model)
    angle = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in t]) for t in turns]), (F.col("turn") + 1).cast("int"))
    matrix = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in K.matrix(t).ravel()]) for t in turns]), (F.col("turn") + 1).cast("int"))
    steps = [shape[1] * shape[2], shape[2], 1]
    q = [F.floor(F.col("place") / s) % m for s, m in zip(steps, shape)]
    q = [F.when(c < -(-m // 2), c).otherwise(c - m) for c, m in zip(q, shape)]
    # rotate() moves after it turns: the translation is taken back in the class's frame
    loc = [F.round(-sum(q[i] * F.element_at(matrix, 3 * j + i + 1) for i in range(3)), 9) + 0.0 for j in range(3)]
    return model, history, last.select(key, F.col("k").cast("int"), angle.alias("angle"), F.array(*loc).alias("loc"), F.exp(F.col("top") - F.col("total")).alias("share"))
