"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad from byte-class shares, word repetition and length of itself and
of its two neighbours; the length-weighted forward-backward marginals of "good" are averaged into the
document's score, which a one-dimensional logistic curve then calibrates.

Defined results: a null or empty text is one empty line and gets a score as any other; rows are
scored one by one, so repeated ids, ties and further columns change nothing; an empty table gives
no rows; without labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import fold, narrow, read

#: Most distinct labelled rows that a fit takes, those of the smallest xxhash64(doc_id), and the most characters and
#: lines that one of them may have: 47 kB of features a row reach the driver at most.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_LINES = 3000, 65_536, 256
THRESHOLD = 0.3

_CLASSES = np.zeros(256, np.uint8)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", ".,;:?'\"-()", "!", "|", "#%&$*@^~=+<>[]{}\\/_`"), 1):
    _CLASSES[[ord(c) for c in _chars]] = _k
_CLASSES[128:] = 9
_N_CLASSES = 10
_BASE = 4 * (_N_CLASSES - 1) + 8
N_FEATURES = 3 * _BASE + 3


def base_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line, the lines' bytes, and each row's line offsets."""
    breaks = np.flatnonzero(data == 10)
    per_row = np.searchsorted(breaks, offsets)
    n_lines = np.diff(per_row) + 1
    line_at = np.concatenate(([0], np.cumsum(n_lines)))
    starts = np.empty(line_at[-1], np.int64)
    ends = np.empty(line_at[-1], np.int64)
    head = np.zeros(line_at[-1], bool)
    head[line_at[:-1]] = True
    tail = np.zeros(line_at[-1], bool)
    tail[line_at[1:] - 1] = True
    starts[head], starts[~head] = offsets[:-1], breaks + 1
    ends[tail], ends[~tail] = offsets[1:], breaks
    size = (ends - starts).astype(np.float64)
    kinds = _CLASSES[data]
    shares = []
    for k in range(1, _N_CLASSES):
        sums = np.concatenate(([0], np.cumsum(kinds == k)))
        shares.append((sums[ends] - sums[starts]) / np.maximum(size, 1))
    lowered = T.LOWER[data]
    ws, we, _ = T.word_spans(lowered, np.concatenate((starts, offsets[-1:])), T.SPACED)
    words = T.span_hashes(lowered, ws, we)
    word_at = np.searchsorted(ws, np.concatenate((starts, offsets[-1:])))
    n_words = np.diff(word_at).astype(np.float64)
    again = np.zeros(len(words), np.int64)
    for lag in (1, 2):
        again[lag:] |= words[lag:] == words[:-lag]
    sums = np.concatenate(([0], np.cumsum(again)))
    repeat = (sums[word_at[1:]] - sums[word_at[:-1]]) / np.maximum(n_words, 1)
    cols = []
    for s in shares:
        cols += [s, s > 0.01, s > 0.05, s > 0.25]
    cols += [repeat, repeat > 0.05, repeat > 0.2, np.log1p(size) / 10, np.log1p(n_words) / 7, size / np.maximum(n_words, 1) / 20, n_words < 5, n_words == 0]
    return np.stack(cols, 1).astype(np.float32), size, line_at


def features(base: np.ndarray, line_at: np.ndarray) -> np.ndarray:
    """A line's own features, its neighbours' (zero beyond the text), and whether those exist."""
    n = len(base)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[line_at[:-1]] = True
    last[line_at[1:] - 1] = True
    before = np.where(first[:, None], 0, np.roll(base, 1, 0)) if n else base
    after = np.where(last[:, None], 0, np.roll(base, -1, 0)) if n else base
    return np.concatenate((base, before, after, first[:, None], last[:, None], np.ones((n, 1))), 1).astype(np.float32)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def forward_backward(unary: np.ndarray, line_at: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginal of "good" of each line, expected transitions, and the sum of log partition functions.

    unary: each line's score for "good" against "bad". Chains of similar length go together.
    """
    good = np.zeros(len(unary))
    pairs = np.zeros((2, 2))
    total = 0.0
    lengths = np.diff(line_at)
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        top = at + 1
        while top < len(order) and top - at < 512 and lengths[order[top]] <= max(8, 1.25 * lengths[order[at]]):
            top += 1
        rows, at = order[at:top], top
        size, steps = lengths[rows], int(lengths[rows].max())
        live = np.arange(steps)[None, :] < size[:, None]
        index = np.minimum(line_at[rows][:, None] + np.arange(steps), len(unary) - 1)
        u = np.zeros((len(rows), steps, 2))
        u[:, :, 1] = np.where(live, unary[index], 0)
        alpha = np.empty_like(u)
        beta = np.zeros_like(u)
        alpha[:, 0] = start + u[:, 0]
        for t in range(1, steps):
            new = _log_sum(alpha[:, t - 1, :, None] + trans, 1) + u[:, t]
            alpha[:, t] = np.where(live[:, t, None], new, alpha[:, t - 1])
        for t in range(steps - 2, -1, -1):
            new = _log_sum(trans + (u[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(live[:, t + 1, None], new, 0)
        log_z = _log_sum(alpha[:, -1], 1)
        total += float(log_z.sum())
        marginal = np.exp(alpha + beta - log_z[:, None, None])
        good[index[live]] = marginal[:, :, 1][live]
        for t in range(1, steps):
            both = alpha[:, t - 1, :, None] + trans + (u[:, t] + beta[:, t])[:, None, :] - log_z[:, None, None]
            pairs += np.exp(both)[live[:, t]].sum(0)
    return good, pairs, total


@dataclass
class LineCRF:
    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def untrained(cls) -> LineCRF:
        return cls(np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros(2), 0.0, 0.0)

    def doc_means(self, base: np.ndarray, size: np.ndarray, line_at: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of "good" of each row's lines."""
        good, _, _ = forward_backward(features(base, line_at) @ self.weights, line_at, self.trans, self.start)
        weight = size + 1
        return np.add.reduceat(good * weight, line_at[:-1]) / np.add.reduceat(weight, line_at[:-1])

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.slope == 0:
            return np.full(len(offsets) - 1, 0.5)
        mean = self.doc_means(*base_features(data, offsets))
        return 1 / (1 + np.exp(-(self.slope * _logit(mean) + self.shift)))

    @classmethod
    def fit(cls, docs: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray, steps: int = 80) -> LineCRF:
        """Adam on the regularised log-likelihood; each line carries its document's label, each document the same weight."""
        if not len(docs) or len(set(labels.tolist())) < 2:
            return cls.untrained()
        line_at = np.concatenate(([0], np.cumsum([len(x) for x in docs])))
        base = np.concatenate(docs)
        x = features(base, line_at).astype(np.float64)
        y = np.repeat(labels, np.diff(line_at)).astype(np.float64)
        model = cls.untrained()
        seen = np.zeros((2, 2))
        inner = np.ones(len(y), bool)
        inner[line_at[:-1]] = False
        for k in (0, 1):
            seen[k, k] = ((y == k) & inner).sum()
        begin = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
        theta = np.zeros(N_FEATURES + 6)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            model.weights, model.trans, model.start = theta[:N_FEATURES], theta[N_FEATURES : N_FEATURES + 4].reshape(2, 2), theta[N_FEATURES + 4 :]
            good, pairs, _ = forward_backward(x @ model.weights, line_at, model.trans, model.start)
            first = good[line_at[:-1]]
            grad = np.concatenate((x.T @ (y - good), (seen - pairs).ravel(), begin - np.array([(1 - first).sum(), first.sum()]))) / len(docs) - 1e-3 * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        model.weights, model.trans, model.start = theta[:N_FEATURES].copy(), theta[N_FEATURES : N_FEATURES + 4].reshape(2, 2).copy(), theta[N_FEATURES + 4 :].copy()
        z = _logit(model.doc_means(base, np.concatenate(sizes), line_at))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * z + b)))
            w = p * (1 - p) + 1e-9
            hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            da, db = np.linalg.solve(hess, np.array([((labels - p) * z).sum() - 1e-3 * a, (labels - p).sum() - 1e-3 * b]))
            a, b = a + float(np.clip(da, -1, 1)), b + float(np.clip(db, -1, 1))
        model.slope, model.shift = max(a, 0.05), b
        return model


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(docs: DataFrame, labels: DataFrame, *, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, sample_lines: int = SAMPLE_LINES) -> LineCRF:
    """A model of labels.quality from at most sample_docs distinct labelled rows; only (doc_id, text) of docs is read.

    An id with several labels counts with the smallest. Rows longer than the bounds are scored, but not learned from.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    # twice as many ids as rows are asked for, as some have no row or a long one: each bound holds whatever the tables
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample_docs)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.where((F.length("text") <= sample_chars) & (F.length("text") - F.length(F.replace("text", F.lit("\n"))) < sample_lines))
    rows = rows.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "quality", F.xxhash64("doc_id").alias("order"), F.xxhash64("text").alias("mark"))
    key = ["order", "doc_id", "mark"]
    chosen = rows.select(key).distinct().orderBy(key).limit(sample_docs)
    rows = rows.join(F.broadcast(chosen), key).dropDuplicates(key).select("doc_id", "text", "quality")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in T.slices(batch.column("text")):
                base, size, line_at = base_features(data, offsets)
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality").cast(pa.int32()), pa.array([base[a:b].tobytes() for a, b in zip(line_at[:-1], line_at[1:])], pa.binary()), pa.array([size[a:b].tobytes() for a, b in zip(line_at[:-1], line_at[1:])], pa.binary())], ["doc_id", "quality", "base", "size"])

    found = sorted(rows.mapInArrow(extract, "doc_id long, quality int, base binary, size binary").collect(), key=lambda r: (r.doc_id, r.base))
    return LineCRF.fit([np.frombuffer(r.base, np.float32).reshape(-1, _BASE) for r in found], [np.frombuffer(r.size) for r in found], np.array([r.quality for r in found], float))


def score(docs: DataFrame, model: LineCRF, *, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row of docs, from its whole text alone."""
    narrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.scores(data, offsets) for _, _, data, offsets in T.slices(batch.column("text"))]
            s = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: LineCRF, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score at least threshold."""
    narrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.scores(data, offsets) >= threshold for _, _, data, offsets in T.slices(batch.column(batch.schema.names.index("text")))]
            yield batch.filter(pa.array(np.concatenate(parts) if parts else np.empty(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(fold("doc_id", 5) != 0)


def op10_quality_crf(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, training_labels(read(spark, sf_dir, "labels")))
    out = score(docs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
