"""Benchmark decontamination with an FM-index per shard of the corpus.

A shard is a slice of about 2 MB of an Arrow batch of documents, or one longer document. Its words become symbols of the test phrases' vocabulary; what
stands between runs of such words cannot be part of a phrase and is one separator, and runs shorter than
the shortest phrase are left out. Every window of ten consecutive item words (an item of fewer is one
window) is searched backwards, its occurrences are located, and their spans merged.

The phrases are broadcast in blocks of at most BLOCK_BYTES of item text each, which every shard meets in turn.

Defined results: null texts have no words; an item without words has no window; items that share an
item_id are one item, and a null item_id counts as hit text but is not listed; rows of documents are
judged one by one, so repeated ids change nothing; further columns pass; empty tables give no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import narrow, read
from .fm_index import FMIndex

WINDOW = 10
BLOCK_BYTES = 24 << 20


@dataclass
class Phrases:
    vocabulary: np.ndarray  # sorted word hashes; symbol = place + 1
    patterns: np.ndarray  # windows x WINDOW, padded with 0
    lengths: np.ndarray
    owner_at: np.ndarray  # offsets into owners of each window
    owners: np.ndarray  # item numbers
    items: list  # item_id by number

    @classmethod
    def of(cls, rows: list[tuple], window: int = WINDOW) -> Phrases:
        items = sorted({r[0] for r in rows if r[0] is not None})
        number = {x: i for i, x in enumerate(items)}
        windows: dict[tuple, set] = {}
        for item, text in rows:
            data = T.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            starts, ends, _ = T.word_spans(data, np.array([0, len(data)]), T.ALNUM)
            words = T.span_hashes(data, starts, ends).tolist()
            for i in range(max(1, len(words) - window + 1) if words else 0):
                windows.setdefault(tuple(words[i : i + window]), set()).update(() if item is None else (number[item],))
        vocabulary = np.array(sorted({w for key in windows for w in key}), np.uint64)
        patterns = np.zeros((len(windows), window), np.int64)
        for i, key in enumerate(windows):
            patterns[i, : len(key)] = np.searchsorted(vocabulary, np.array(key, np.uint64)) + 1
        owners = [sorted(x) for x in windows.values()]
        return cls(vocabulary, patterns, np.array([len(k) for k in windows], np.int64), np.concatenate(([0], np.cumsum([len(x) for x in owners]))).astype(np.int64), np.array([y for x in owners for y in x], np.int64), items)

    def hits(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """+1/-1 marks of covered words, and (row, item number) pairs; at: row offsets into words."""
        marks = np.zeros(len(words) + 1, np.int64)
        none = np.empty(0, np.int64)
        if not len(self.lengths) or not len(words):
            return marks, none, none
        place = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        symbols = np.where(self.vocabulary[place] == words, place + 1, 0)
        known = symbols > 0
        begins, edge = known.copy(), np.zeros(len(words) + 1, bool)
        edge[at] = True
        begins[1:] &= ~known[:-1] | edge[1:-1]
        ends = known.copy()
        ends[:-1] &= ~known[1:] | edge[1:-1]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        long = last - first >= self.lengths.min()
        first, size = first[long], (last - first)[long]
        if not len(first):
            return marks, none, none
        where = T.ranges(first, size + 1)  # each run and one place for its separator
        is_gap = np.zeros(len(where), bool)
        is_gap[np.cumsum(size + 1) - 1] = True
        index = FMIndex(np.where(is_gap, 0, symbols[np.minimum(where, len(words) - 1)]), len(self.vocabulary))
        low, high = index.search(self.patterns, self.lengths)
        found = np.flatnonzero(high > low)
        window = np.repeat(found, (high - low)[found])
        start = where[index.locate(T.ranges(low[found], (high - low)[found]))]
        np.add.at(marks, start, 1)
        np.add.at(marks, start + self.lengths[window], -1)
        row = np.searchsorted(at, start, "right") - 1
        both = np.unique(row * len(self.lengths) + window)
        row, window = both // len(self.lengths), both % len(self.lengths)
        count = np.diff(self.owner_at)[window]
        pairs = np.unique(np.repeat(row, count) * max(len(self.items), 1) + self.owners[T.ranges(self.owner_at[window], count)])
        return marks, pairs // max(len(self.items), 1), pairs % max(len(self.items), 1)


def _blocks(benchmark: DataFrame, window: int) -> list:
    """The phrases, broadcast in blocks of a checked size."""
    spark = benchmark.sparkSession
    size = benchmark.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-2 * size // BLOCK_BYTES) if size > BLOCK_BYTES else 1)
    out = []
    for b in range(n):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).select("item_id", "text").collect()
        out.append(spark.sparkContext.broadcast(Phrases.of([tuple(r) for r in rows], window)))
    return out


def _shards(column: pa.Array, blocks: list):
    """(first row, last row, bytes, offsets, word starts, word ends, row offsets of words, covered words, item ids by row)."""
    for first, last, data, offsets in T.slices(column):
        starts, ends, at = T.word_spans(data, offsets, T.ALNUM)
        words = T.span_hashes(T.LOWER[data], starts, ends)
        covered = np.zeros(len(words), bool)
        items: dict[int, set] = {}
        for block in blocks:
            phrases = block.value
            marks, row, item = phrases.hits(words, at)
            covered |= np.cumsum(marks)[:-1] > 0
            for r, i in zip(row.tolist(), item.tolist()):
                items.setdefault(r, set()).add(phrases.items[i])
        yield first, last, data, offsets, starts, ends, at, covered, items


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of every row of docs."""
    narrow(docs.sparkSession)
    blocks = _blocks(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, _, _, _, _, at, covered, items in _shards(batch.column("text"), blocks):
                sums = np.concatenate(([0], np.cumsum(covered)))
                listed = [sorted(items.get(r, ())) for r in range(last - first)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(np.diff(at)), pa.array(sums[at[1:]] - sums[at[:-1]]), pa.array([hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in listed]), pa.array([len(x) for x in listed], pa.int64()), pa.array([list(map(str, x)) for x in listed], pa.list_(pa.string()))], ["doc_id", "n_words", "n_hit", "items_sha256", "n_items", "items"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_hit long, items_sha256 string, n_items long, items array<string>")


def remove(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """docs with every covered run of words cut from text, from its first word's to its last word's byte.

    n_chars, if there, is set anew for rows that change; rows left without a word are dropped.
    """
    narrow(docs.sparkSession)
    blocks = _blocks(benchmark, window)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            column = batch.column(names.index("text"))
            keep = np.ones(len(batch), bool)
            new: dict[int, str] = {}
            for first, last, data, offsets, starts, ends, at, covered, _ in _shards(column, blocks):
                if not covered.any():
                    continue
                sums = np.concatenate(([0], np.cumsum(covered)))
                hit = sums[at[1:]] - sums[at[:-1]]
                for r in np.flatnonzero(hit):
                    own = np.flatnonzero(covered[at[r] : at[r + 1]]) + at[r]
                    breaks = np.flatnonzero(np.diff(own) > 1)
                    heads, tails = own[np.concatenate(([0], breaks + 1))], own[np.concatenate((breaks, [len(own) - 1]))]
                    rest, place = [], offsets[r]
                    for a, b in zip(starts[heads], ends[tails]):
                        rest.append(data[place:a].tobytes())
                        place = b
                    rest.append(data[place : offsets[r + 1]].tobytes())
                    new[first + int(r)] = b"".join(rest).decode()
                    keep[first + r] = hit[r] < at[r + 1] - at[r]
            if new:
                columns = {"text": [new.get(i, x) for i, x in enumerate(column.to_pylist())]}
                if "n_chars" in names:
                    columns["n_chars"] = [len(new[i]) if i in new else x for i, x in enumerate(batch.column(names.index("n_chars")).to_pylist())]
                batch = pa.RecordBatch.from_arrays([pa.array(columns[n], batch.schema.field(i).type) if n in columns else batch.column(i) for i, n in enumerate(names)], names)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)


def op7_fm_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))
