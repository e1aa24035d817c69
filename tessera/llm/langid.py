"""Language identification by string kernels.

The kernel of two texts is the cosine of their presence vectors over all byte n-grams of one to four
(a blended spectrum, hashed to DIM places). A bounded sample of labelled texts gives Nyström landmarks
and the one-versus-rest kernel ridge regression in the landmarks' feature space; a batch of texts is
then scored by two matrix products. Whole texts are read, never prefixes.

Defined results: a null text or one without a letter is `und` with score 0; with no learnable row
every text is; rows are scored one by one, so repeated ids, ties and further columns change nothing;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import fold, narrow, read

DIM = 8192
GRAMS = (1, 2, 3, 4)
#: Most distinct rows that a fit takes, those of the smallest xxhash64 of doc_id, and landmarks among them.
SAMPLE_DOCS = 3000
LANDMARKS = 192
RIDGE = 1e-3
SHARPNESS = 6.0

# ASCII letters in lower case and all other bytes stay; the rest is one blank.
_FOLD = T.LOWER.copy()
_FOLD[:128][~np.isin(T.LOWER[:128], np.arange(97, 123))] = 32


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """0/1 matrix: which hashed n-grams each row's text holds."""
    n = len(offsets) - 1
    seen = np.zeros(n * DIM, np.uint8)
    if len(data):
        folded = _FOLD[data].astype(np.uint32)
        left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
        place = np.repeat(np.arange(n, dtype=np.int64) * DIM, np.diff(offsets))
        code = np.zeros(len(data), np.uint32)
        for k in range(1, max(GRAMS) + 1):
            code[: len(data) - k + 1] = code[: len(data) - k + 1] * np.uint32(0x01000193) + (folded[k - 1 :] + np.uint32(k))
            if k in GRAMS:
                ok = left >= k
                slot = ((code * np.uint32(0x9E3779B1)) >> np.uint32(19)).astype(np.int64)
                seen[(place + slot)[ok]] = 1
    return seen.reshape(n, DIM)


def has_letter(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False).astype(bool)


@dataclass
class KernelLanguageModel:
    names: list[str]
    landmarks: np.ndarray  # landmarks x DIM, rows of length one
    weights: np.ndarray  # (landmarks + 1) x languages

    @classmethod
    def fit(cls, seen: np.ndarray, langs: list[str], *, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelLanguageModel:
        """Landmarks are taken in turn from each language; weights solve the ridge problem for targets of +1 and -1."""
        names = sorted(set(langs))
        if not names:
            return cls([], np.zeros((0, DIM), np.float32), np.zeros((1, 0), np.float32))
        rows = seen.astype(np.float32)
        rows /= np.maximum(np.sqrt(rows.sum(1, keepdims=True)), 1)
        by = [[i for i, x in enumerate(langs) if x == name] for name in names]
        chosen = [own[turn] for turn in range(max(map(len, by))) for own in by if turn < len(own)][:landmarks]
        marks = rows[chosen]
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        good = values > 1e-6 * max(values.max(), 1e-9)
        whiten = vectors[:, good] / np.sqrt(values[good])
        phi = np.concatenate(((rows @ marks.T).astype(np.float64) @ whiten, np.ones((len(rows), 1))), 1)
        target = np.where(np.array(langs)[:, None] == np.array(names), 1.0, -1.0)
        solved = np.linalg.solve(phi.T @ phi + ridge * len(rows) * np.eye(phi.shape[1]), phi.T @ target)
        return cls(names, marks, np.concatenate((whiten @ solved[:-1], solved[-1:])).astype(np.float32))

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its share of the softmax of all margins."""
        best, share = [], []
        for a in range(0, len(offsets) - 1, 256):
            b = min(a + 256, len(offsets) - 1)
            rows = presence(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            norm = np.sqrt(np.maximum(rows.sum(1, dtype=np.int64), 1)).astype(np.float32)
            kernel = (rows.astype(np.float32) @ self.landmarks.T) / norm[:, None]
            margin = (kernel @ self.weights[:-1] + self.weights[-1]).astype(np.float64)
            odds = np.exp(SHARPNESS * (margin - margin.max(1, keepdims=True)))
            best.append(margin.argmax(1))
            share.append((odds.max(1) / odds.sum(1)))
        return np.concatenate(best), np.concatenate(share)


def fit(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS) -> KernelLanguageModel:
    """A model from at most sample_docs distinct rows of docs with an id, a text and a language; a kilobyte of each reaches the driver."""
    rows = docs.where("doc_id is not null and lang is not null and text is not null").select(F.col("doc_id").cast("long"), "lang", "text", F.xxhash64("doc_id").alias("order"), F.xxhash64("lang", "text").alias("mark"))
    key = ["order", "doc_id", "mark"]
    chosen = rows.select(key).distinct().orderBy(key).limit(sample_docs)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in T.slices(batch.column("text")):
                part = batch.slice(first, last - first)
                bits = np.packbits(presence(data, offsets), axis=1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array([x.tobytes() for x in bits], pa.binary())], ["doc_id", "lang", "bits"])

    found = rows.join(F.broadcast(chosen), key).dropDuplicates(key).select("doc_id", "lang", "text").mapInArrow(extract, "doc_id long, lang string, bits binary").collect()
    found.sort(key=lambda r: (r.doc_id, r.lang, r.bits))
    seen = np.unpackbits(np.array([np.frombuffer(r.bits, np.uint8) for r in found], np.uint8).reshape(len(found), DIM // 8), axis=1)
    return KernelLanguageModel.fit(seen, [r.lang for r in found])


def identify(docs: DataFrame, model: KernelLanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs."""
    narrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            known = has_letter(column) & bool(model.names)
            pred = np.full(len(column), "und", object)
            score = np.zeros(len(column))
            if model.names:
                for first, last, data, offsets in T.slices(column):
                    best, share = model.predict(data, offsets)
                    ok = known[first:last]
                    pred[first:last][ok] = np.array(model.names, object)[best[ok]]
                    score[first:last][ok] = share[ok]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", 3) != 1))
    return identify(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
