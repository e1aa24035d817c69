"""Approximate nearest neighbours from randomly rotated one-bit codes.

Vectors are centred, scaled to length one, rotated at random and kept as packed sign bits with two correction
scalars. A query is rotated too and rounded to LEVELS steps, whose bit planes meet the packed signs by AND and
population count: that estimates the inner product. The estimate's error bound gives a lower bound of the
distance, and only vectors whose lower bound beats the k-th exact distance found so far are reranked on the
original vectors, in double precision.

Defined results: vectors that are null, zero, of another length than the first usable one's, or hold
null or non-finite components take no part, as rows without an id; ties go to the smaller id; a query
never finds its own id; with fewer than k candidates all are returned; an empty table gives no rows.
Repeated ids are separate candidates, each named by its id; queries that agree in id and vector are one, those
that agree in the id alone have a list each under that id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, settle

#: Bytes of query vectors broadcast at once, and vectors in the centre's sample.
QUERY_BYTES = 8 << 20
CENTRE_SAMPLE = 4096
#: Bits of a query's rounded components.
PLANES = 4
LEVELS = (1 << PLANES) - 1
#: Standard errors that the bound allows for.
BOUND = 3.5
_CODES = "vec_id long, vec binary, code binary, norm double, fit double"


@dataclass
class Rotation:
    matrix: np.ndarray  # dim x dim, orthogonal
    centre: np.ndarray

    @classmethod
    def of(cls, centre: np.ndarray, seed: int = 7) -> Rotation:
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(centre), len(centre))))
        return cls(q * np.sign(np.diag(r)), centre)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed sign bits, distance to the centre, and the inner product of code and vector."""
        rest = x - self.centre
        norm = np.sqrt((rest**2).sum(1))
        turned = (rest / np.maximum(norm, 1e-300)[:, None]) @ self.matrix
        fit = np.abs(turned).sum(1) / np.sqrt(x.shape[1])
        return np.packbits(turned > 0, axis=1), norm, fit


def _usable(dim: int | None):
    e = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    return ok if dim is None else ok & (F.size(e) == dim)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def build_index(vectors: DataFrame) -> tuple[DataFrame, Rotation | None]:
    """Codes of every usable row of (vec_id, embedding); the centre is the mean of a bounded sample."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sample = rows.where(_usable(None)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(CENTRE_SAMPLE).collect()
    if not sample:
        return vectors.sparkSession.createDataFrame([], _CODES), None
    dim = len(sample[0].embedding)
    turn = Rotation.of(np.mean([r.embedding for r in sample if len(r.embedding) == dim], 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"), dim)
            code, norm, fit = turn.encode(x)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(fit)], ["vec_id", "vec", "code", "norm", "fit"])

    return rows.where(_usable(dim)).mapInArrow(run, _CODES), turn


def _words(code: np.ndarray) -> np.ndarray:
    """Packed bits, rows of bytes, as rows of 64-bit words."""
    wide = np.zeros((len(code), -(-code.shape[1] // 8) * 8), np.uint8)
    wide[:, : code.shape[1]] = code
    return wide.view(np.uint64)


class Searcher:
    """The k nearest of the blocks of codes that it is shown, for a block of queries."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, turn: Rotation, k: int):
        self.q_ids, self.q, self.turn, self.k = q_ids, q, turn, k
        dim = q.shape[1]
        rest = q - turn.centre
        self.norm = np.sqrt((rest**2).sum(1))
        turned = (rest / np.maximum(self.norm, 1e-300)[:, None]) @ turn.matrix
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / LEVELS, 1e-12)
        steps = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = [_words(np.packbits(steps >> j & 1, axis=1)) for j in range(PLANES)]
        self.sum = self.low * dim + self.step * steps.sum(1, dtype=np.int64)
        self.near = np.full((len(q), k), np.inf)
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)
        self.place = np.full((len(q), k), -1)  # in the codes shown last; -1 for those before

    def see(self, ids: np.ndarray, vec: np.ndarray, code: np.ndarray, norm: np.ndarray, fit: np.ndarray) -> None:
        """The estimate of <v, q> is <code, q> / fit; its error is at most BOUND standard errors of code and rounding."""
        if not len(ids):
            return
        dim = vec.shape[1]
        self.place[:] = -1
        words = _words(code)
        bits = np.bitwise_count(words).sum(1, dtype=np.int64)
        safe = np.maximum(fit, 1e-9)
        for a in range(0, len(self.q), 256):
            own = slice(a, min(a + 256, len(self.q)))
            hit = np.zeros((own.stop - a, len(ids)), np.int32)
            for j, plane in enumerate(self.planes):
                for w in range(words.shape[1]):
                    hit += np.bitwise_count(plane[own, w, None] & words[:, w]).astype(np.int32) << j
            step = self.step[own, None]
            dot = (2 * (self.low[own, None] * bits + step * hit) - self.sum[own, None]) / (np.sqrt(dim) * safe)
            slack = BOUND * (np.sqrt(np.maximum(1 - safe**2, 0) / max(dim - 1, 1)) + step / np.sqrt(12)) / safe + 1e-5
            scale = 2 * norm * self.norm[own, None]
            square = norm**2 + self.norm[own, None] ** 2
            same = self.q_ids[own, None] == ids
            limit = self.near[own, -1]
            if np.isinf(limit).any():
                # no k-th distance yet: the k best guesses give one
                guess = np.where(same, np.inf, square - scale * dot)
                m = min(self.k, len(ids))
                first = np.argpartition(guess, m - 1, axis=1)[:, :m]
                real = np.isfinite(np.take_along_axis(guess, first, 1))
                self._merge(a + np.nonzero(real)[0], first[real], ids, vec)
                limit = self.near[own, -1]
            low = square - scale * np.minimum(dot + slack, 1)
            row, column = np.nonzero((low <= (limit * (1 + 1e-9))[:, None] ** 2) & ~same)
            self._merge(a + row, column, ids, vec)

    def _merge(self, row: np.ndarray, column: np.ndarray, ids: np.ndarray, vec: np.ndarray) -> None:
        """Candidate pairs by their exact distance among the nearest so far; pairs that are there already stay once."""
        for a in range(0, len(row), 1 << 15):
            r, c = row[a : a + (1 << 15)], column[a : a + (1 << 15)]
            d = np.sqrt(((vec[c] - self.q[r]) ** 2).sum(1))
            keep = d <= self.near[r, -1]
            r, c, d = r[keep], c[keep], d[keep]
            some = np.unique(r)
            if not len(some):
                continue
            rows = np.concatenate((np.repeat(some, self.k), r))
            far = np.concatenate((self.near[some].ravel(), d))
            names = np.concatenate((self.ids[some].ravel(), ids[c]))
            place = np.concatenate((self.place[some].ravel(), c))
            order = np.lexsort((place, names, far, rows))
            rows, far, names, place = rows[order], far[order], names[order], place[order]
            again = np.zeros(len(rows), bool)
            again[1:] = (rows[1:] == rows[:-1]) & (names[1:] == names[:-1]) & (place[1:] == place[:-1]) & (place[1:] >= 0)
            rows, far, names, place = rows[~again], far[~again], names[~again], place[~again]
            nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
            top = nth < self.k
            at = rows[top], nth[top]
            self.near[at], self.ids[at], self.place[at] = far[top], names[top], place[top]


def search(index: DataFrame, turn: Rotation, queries: DataFrame, *, k: int = 10) -> DataFrame:
    """The k nearest rows of index for each row of queries (also of index); queries go in blocks of bounded bytes.

    A block of queries is broadcast and meets all codes in one pass; a task sends k rows a query at most. Where
    there are several blocks, each one's result is written before the next is sent, and its broadcast released.
    """
    spark = index.sparkSession
    dim = len(turn.centre)
    blocks = max(1, -(-queries.count() * 5 * 8 * dim // (4 * QUERY_BYTES)))
    found = []
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks)) == b).select("vec_id", "vec").distinct().collect()
        if not own:
            continue
        own.sort(key=lambda r: (r.vec_id, r.vec))
        sent = spark.sparkContext.broadcast((np.array([r.vec_id for r in own], np.int64), np.array([np.frombuffer(r.vec) for r in own])))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q_ids, q = sent.value
            nearest = Searcher(q_ids, q, turn, k)
            for batch in batches:
                for at in range(0, len(batch), 2048):
                    part = batch.slice(at, 2048)
                    vec = np.frombuffer(b"".join(part.column("vec").to_pylist())).reshape(-1, dim)
                    code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(vec), -1)
                    nearest.see(part.column("vec_id").to_numpy(), vec, code, part.column("norm").to_numpy(), part.column("fit").to_numpy())
            real = np.isfinite(nearest.near)
            row = np.nonzero(real)[0]
            yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(q_ids[row]), pa.array(nearest.ids[real]), pa.array(nearest.near[real])], ["query", "query_id", "vec_id", "score"])

        rows = index.mapInArrow(run, "query int, query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("score", "vec_id"))
        rows = rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:
            rows = settle(rows)
            sent.unpersist()
        found.append(rows)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def op6_rabitq_neighbours(spark, sf_dir: str) -> DataFrame:
    index, turn = build_index(read(spark, sf_dir, "embeddings"))
    if turn is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = settle(index)
    return search(index, turn, index.where("vec_id % 100 = 0"), k=10)
