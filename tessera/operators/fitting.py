"""Models fitted to vectors: mixtures by expectation and maximisation, weighted principal components, robust splits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lines import smooth_rows
from .statistics import moments

#: Most models that travel to every record at once.
MOST_MODELS = 4096


def responsibilities(records: DataFrame, models: DataFrame, key: str, sigma2: float) -> DataFrame:
    """(key, v, k, d, l, r): squared distance, log-likelihood with the prior, and share of every model (k, m, alpha) for
    every record (key, v): exp(l - max) / sum by record."""
    if models.limit(MOST_MODELS + 1).count() > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models")
    apart = F.aggregate(F.zip_with("v", "m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    pairs = records.join(F.broadcast(models), F.lit(True)).select(key, "v", "k", apart.alias("d"), "alpha")
    pairs = pairs.withColumn("l", -F.col("d") / (2 * sigma2) + F.log("alpha"))
    w = Window.partitionBy(key)  # a record's few models
    top = pairs.withColumn("_e", F.exp(F.col("l") - F.max("l").over(w)))
    return top.withColumn("r", F.col("_e") / F.sum("_e").over(w)).drop("_e", "alpha")


def maximised(shares: DataFrame, key: str, size: int) -> DataFrame:
    """(k, alpha, sigma2, m): new shares, variances and means of the models from all records' responsibilities."""
    total = shares.groupBy(key).agg(F.lit(1)).count()
    sums = [F.sum(F.col("r") * F.col("v")[i]).alias(f"s{i}") for i in range(size)]
    m = shares.groupBy("k").agg(F.sum("r").alias("_r"), F.sum(F.col("r") * F.col("d")).alias("_d"), *sums)
    mean = F.array(*[F.col(f"s{i}") / F.col("_r") for i in range(size)])
    return m.select("k", (F.col("_r") / total).alias("alpha"), (F.col("_d") / F.col("_r") / size).alias("sigma2"), mean.alias("m"))


def mixture(df: DataFrame, column: str, size: int, k: int, *, rounds: int = 50, ridge: float = 1e-6, seed: int = 1, starts: int = 5) -> dict:
    """A Gaussian mixture of k full covariances by EM: weights, means, covariances, log-likelihood and BIC.

    Each round is one pass with partial sums a batch (k * size^2 numbers a task) and a small solve on the driver. It
    starts from k rows of the smallest hash and ends when the log-likelihood gains less than 1e-3 a row; of `starts`
    such fits the likeliest is taken.
    """
    if starts > 1:
        fits = [mixture(df, column, size, k, rounds=rounds, ridge=ridge, seed=seed + i, starts=1) for i in range(starts if k > 1 else 1)]
        return max(fits, key=lambda f: f["log_likelihood"])
    import pyarrow as pa

    rows = df.select(F.col(column).cast("array<double>").alias("v")).where((F.size(column) == size) & ~F.exists(column, lambda x: x.isNull()))
    start = [r.v for r in rows.distinct().orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(k).collect()]
    whole = moments(rows.withColumn("_g", F.lit(0)), "_g", "v", size).first()
    n = whole["n"]
    mean = np.array(whole["sums"]) / n
    spread = np.array(whole["products"]).reshape(size, size) / n - np.outer(mean, mean) + ridge * np.eye(size)
    weights, means, covs = np.full(len(start), 1 / len(start)), np.array(start), np.array([spread] * len(start))
    old = -np.inf
    for _ in range(rounds):
        inverse = np.linalg.inv(covs)
        base = np.log(weights) - 0.5 * (size * np.log(2 * np.pi) + np.linalg.slogdet(covs)[1])

        def run(batches, means=means, inverse=inverse, base=base):
            total = None
            for batch in batches:
                x = batch.column(0).flatten().to_numpy().reshape(-1, size)
                apart = x[:, None] - means
                logs = base - 0.5 * np.einsum("nki,kij,nkj->nk", apart, inverse, apart)
                top = logs.max(1, keepdims=True)
                odds = np.exp(logs - top)
                all_ = odds.sum(1, keepdims=True)
                r = odds / all_
                parts = np.concatenate(([(top + np.log(all_)).sum()], r.sum(0), (r.T @ x).ravel(), np.einsum("nk,ni,nj->kij", r, x, x).ravel()))
                total = parts if total is None else total + parts
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "s"])

        found = rows.mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
        s = np.array([r.s for r in found])
        m = len(weights)
        score, mass = s[0], np.maximum(s[1 : 1 + m], 1e-12)
        means = s[1 + m : 1 + m + m * size].reshape(m, size) / mass[:, None]
        second = s[1 + m + m * size :].reshape(m, size, size) / mass[:, None, None]
        covs = second - np.einsum("ki,kj->kij", means, means) + ridge * np.eye(size)
        weights = mass / mass.sum()
        if score - old < 1e-3 * n:
            break
        old = score
    free = m * (1 + size + size * (size + 1) / 2) - 1
    return {"weights": weights, "means": means, "covariances": covs, "log_likelihood": float(score), "bic": float(free * np.log(n) - 2 * score)}


def best_mixture(df: DataFrame, column: str, size: int, candidates: list[int], **kw) -> dict:
    """The mixture of the least BIC, with every candidate's BIC under "all"."""
    fits = {k: mixture(df, column, size, k, **kw) for k in candidates}
    best = min(fits, key=lambda k: (fits[k]["bic"], k))
    return {"k": best, **fits[best], "all": {k: f["bic"] for k, f in fits.items()}}


def weighted_components(df: DataFrame, column: str, weights: str, size: int, k: int, *, rounds: int = 25, seed: int = 1, smooth: int = 0) -> np.ndarray:
    """(k, size): axes of a weighted principal component analysis by expectation and maximisation; with `smooth`, each pass
    filters them by local cubic polynomials of that width.

    Rows solve for their coefficients under the current axes and weights; the axes solve element by element for the sums
    over rows of weight * coefficient products. A pass sends size * (k^2 + k) sums a task.
    """
    import pyarrow as pa

    rows = df.select(F.col(column).cast("array<double>").alias("v"), F.col(weights).cast("array<double>").alias("w")).where((F.size(column) == size) & (F.size(weights) == size))
    axes = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, k)))[0].T
    for _ in range(rounds):

        def run(batches, axes=axes):
            left, right = np.zeros((size, k, k)), np.zeros((size, k))
            for batch in batches:
                x, w = (batch.column(i).flatten().to_numpy().reshape(-1, size) for i in (0, 1))
                inner = np.einsum("nj,aj,bj->nab", w, axes, axes) + 1e-12 * np.eye(k)
                c = np.linalg.solve(inner, np.einsum("nj,aj,nj->na", w, axes, x)[:, :, None])[:, :, 0]
                left += np.einsum("nj,na,nb->jab", w, c, c)
                right += np.einsum("nj,na,nj->ja", w, c, x)
            both = np.concatenate((left.ravel(), right.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both), dtype=np.int32)), pa.array(both)], ["i", "s"])

        s = np.array([r.s for r in rows.mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()])
        left, right = s[: size * k * k].reshape(size, k, k), s[size * k * k :].reshape(size, k)
        new = np.linalg.solve(left + 1e-12 * np.eye(k), right[:, :, None])[:, :, 0].T
        axes = np.linalg.qr((smooth_rows(new, smooth) if smooth else new).T)[0].T
    return axes


def component_fit(df: DataFrame, column: str, weights: str, axes: np.ndarray) -> dict[str, float]:
    """How well axes (k, size) model rows under their weights: chi2, the weighted squared residuals; reduced, those by degree
    of freedom; r2, the share of the variance of what has a weight that the model takes; rows and values, their numbers.

    One pass with seven sums a batch. Rows of another size or with nulls take no part; without rows all is NaN."""
    import pyarrow as pa

    k, size = axes.shape

    def run(batches):
        for batch in batches:
            x, w = (batch.column(i).flatten().to_numpy().reshape(-1, size) for i in (0, 1))
            inner = np.einsum("nj,aj,bj->nab", w, axes, axes) + 1e-12 * np.eye(k)
            c = np.linalg.solve(inner, np.einsum("nj,aj,nj->na", w, axes, x)[:, :, None])[:, :, 0]
            d = x - c @ axes
            seen = w > 0
            sums = [float((w * d * d).sum()), float(seen.sum()), float(len(x)), *(float(p) for y in (d[seen], x[seen]) for p in (y.sum(), (y * y).sum()))]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in sums], list("abcdefg"))

    sized = (F.size(column) == size) & (F.size(weights) == size)
    rows = df.select(F.col(column).cast("array<double>").alias("v"), F.col(weights).cast("array<double>").alias("w")).where(sized)
    rows = rows.where(~F.exists("v", lambda e: e.isNull()) & ~F.exists("w", lambda e: e.isNull()))
    s = rows.mapInArrow(run, ", ".join(f"{c} double" for c in "abcdefg")).agg(*(F.sum(c).alias(c) for c in "abcdefg")).first()
    if s.a is None or not s.b:
        return {n: float("nan") for n in ("chi2", "reduced", "r2", "rows", "values")}
    spread = [(q - m * m / s.b) / s.b for m, q in ((s.d, s.e), (s.f, s.g))]
    free = s.b - k * size - k * s.c
    return {"chi2": s.a, "reduced": s.a / free if free > 0 else float("nan"), "r2": 1 - spread[0] / spread[1] if spread[1] > 0 else float("nan"), "rows": s.c, "values": s.b}


def covariance_filtered_components(df: DataFrame, column: str, size: int, features: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, variances, axes): principal components of the elements whose mean covariance with all others exceeds the
    features-th largest one."""
    m = moments(df.withColumn("_g", F.lit(0)), "_g", column, size).first()
    n, s = m["n"], np.array(m["sums"])
    cov = (np.array(m["products"]).reshape(size, size) - np.outer(s, s) / n) / (n - 1)
    mean = (cov.sum(1) - np.diag(cov)) / (size - 1)
    places = np.flatnonzero(mean > np.sort(mean)[::-1][min(features, size) - 1]) if features < size else np.arange(size)
    values, vectors = np.linalg.eigh(cov[np.ix_(places, places)])
    return places, values[::-1][:k], vectors[:, ::-1][:, :k].T


def robust_split(matrix: np.ndarray, *, rounds: int = 500, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """(low, sparse): a matrix as a sum of one of low rank and a sparse one, by alternating directions.

    Singular values and entries are shrunk in turn; the matrix is a small one (features by regions).
    """
    size = np.abs(matrix).sum()
    mu = matrix.size / (4 * size) if size else 1.0
    weight = 1 / np.sqrt(max(matrix.shape))
    shrink = lambda x, t: np.sign(x) * np.maximum(np.abs(x) - t, 0)
    low, sparse, dual = (np.zeros_like(matrix, float) for _ in range(3))
    for _ in range(rounds):
        u, s, v = np.linalg.svd(matrix - sparse + dual / mu, full_matrices=False)
        low = (u * shrink(s, 1 / mu)) @ v
        sparse = shrink(matrix - low + dual / mu, weight / mu)
        rest = matrix - low - sparse
        dual = dual + mu * rest
        if np.linalg.norm(rest) <= tolerance * max(np.linalg.norm(matrix), 1e-300):
            break
    return low, sparse
