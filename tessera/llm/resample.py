"""Importance resampling towards a target table: hashed word-run weights, noise by id, an exact draw without replacement.

Two passes over the texts: one counts the features of both tables by bucket, the other scores each document with the
array of the buckets' gains. The eligible documents of each partition become sorted runs, cut at common bounds into
ranges of scores. Ranges are merged from their runs' blocks with a tournament tree each; blocks come ordered by their
first rows out of Spark's sort, so a task holds the blocks that overlap and never a range or a run. Ranges past the draw
are not merged, and the merge of the last one stops at the exact count.

Defined results: a null text has no words; a null doc_id is drawn by the noise of an empty id, and last among equal
scores; rows that agree in doc_id and score take neighbouring ranks, by fewer features and then smaller weight, and equal rows
are interchangeable; a document is scored whole, whatever its length; further columns are not read, whatever their
names; an empty target leaves gains that fall with the corpus counts; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import narrow, read, settle

BUCKETS = 10000
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
RUN_ROWS = 1 << 19
BLOCK_ROWS = 1 << 12
RANGE_ROWS = 1 << 18
MOST_RANGES = 4096

_ROW = "doc_id long, n_features long, weight long, score long"
_END = (math.inf,)


# features and weights


def bucket_runs(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all word runs, row offsets among them, words of each row) of texts in UTF-8."""
    data = T.LOWER[data]
    starts, ends, at = T.word_spans(data, offsets, T.ALNUM)
    words = np.diff(at)
    inside = data[T.ALNUM[data]]
    bounds = np.concatenate(([0], np.cumsum(ends - starts)))
    one = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(inside if len(inside) else np.zeros(1, np.uint8))]).dictionary_encode()
    known = np.array([crc32(w) % buckets for w in one.dictionary.to_pylist()], np.int64)
    found = [known[one.indices.to_numpy()] if len(starts) else np.empty(0, np.int64)]
    rows = [np.repeat(np.arange(len(words)), words)]
    if longest > 1:
        raw = inside.tobytes()
        own = [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for k in range(2, longest + 1):
            first = np.flatnonzero(np.arange(len(own)) + k <= at[rows[0] + 1])
            found.append(np.array([crc32(b" ".join(own[i : i + k])) % buckets for i in first.tolist()], np.int64))
            rows.append(rows[0][first])
    if longest > 1:
        row = np.concatenate(rows)
        order = np.argsort(row, kind="stable")
        return np.concatenate(found)[order], np.searchsorted(row[order], np.arange(len(words) + 1)), words
    return found[0], at, words


def count_buckets(docs: DataFrame, *, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences by bucket over the whole table; what reaches the driver has one number a bucket."""
    narrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in T.slices(batch.column("text")):
                total += np.bincount(bucket_runs(data, offsets, longest, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    size = len(source)
    s_all, t_all = int(source.sum()) + size, int(target.sum()) + size
    return np.array([math.floor(1000 * math.log((float(t + 1) * float(s_all)) / (float(s + 1) * float(t_all)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: str = SEED) -> int:
    """Thousandths of a Gumbel variate, from the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, *, longest: int = 1, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, n_words) of every row."""
    narrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, last, data, offsets in T.slices(batch.column("text")):
                found, at, words = bucket_runs(data, offsets, longest, len(gain))
                sums = np.concatenate(([0], np.cumsum(gain[found])))
                weight = sums[at[1:]] - sums[at[:-1]]
                own = ids.slice(first, last - first)
                score = weight + np.array([noise(i, seed) for i in own.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([own, pa.array(np.diff(at)), pa.array(weight), pa.array(score), pa.array(words)], ["doc_id", "n_features", "weight", "score", "n_words"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ROW + ", n_words long")


# runs


def _sorted_runs(rows: DataFrame, cuts: list[int], run_rows: int, block_rows: int) -> DataFrame:
    """Blocks (range, best score, n, rows) of sorted runs; a range ends before each of the falling cuts."""
    bounds = np.array([-c for c in cuts], np.int64)
    where = np.dtype([("score", "<i8"), ("doc_id", "<i8"), ("null", "<i8"), ("n_features", "<i8"), ("weight", "<i8")])

    def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        out = np.zeros(len(table), where)
        for c in ("score", "n_features", "weight"):
            out[c] = table.column(c).to_numpy()
        out["null"] = table.column("doc_id").is_null().to_numpy()
        out["doc_id"] = table.column("doc_id").fill_null(0).to_numpy()
        out = out[np.lexsort((out["weight"], out["n_features"], out["doc_id"], out["null"], -out["score"]))]
        part = np.searchsorted(bounds, -out["score"], "right")
        edges = np.flatnonzero(np.diff(part)) + 1
        blocks = []
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(out)]):
            for i in range(a, b, block_rows):
                own = out[i : min(i + block_rows, b)]
                blocks.append((int(part[i]), int(own["score"][0]), len(own), own.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in blocks], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["range", "top", "n", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= run_rows:
                yield from emit(held)
                held, size = [], 0
        if size:
            yield from emit(held)

    return rows.select("doc_id", "n_features", "weight", "score").mapInArrow(run, "range int, top long, n long, rows binary")


def _entries(raw: bytes) -> list[tuple]:
    """The rows of a block as keys that sort best first."""
    values = np.frombuffer(raw, np.int64).reshape(-1, 5)
    return [(-s, null, i, f, w) for s, i, null, f, w in values.tolist()]


class Tournament:
    """A winner tree over open runs; a change of one run's head replays its path to the root alone."""

    def __init__(self, size: int = 2):
        self.size = size
        self.heads: list[tuple] = [_END] * size
        self.tree = [0] * (2 * size)
        self._rebuild()

    def _rebuild(self) -> None:
        self.tree = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            self._play(node)

    def _play(self, node: int) -> None:
        a, b = self.tree[2 * node], self.tree[2 * node + 1]
        self.tree[node] = a if self.heads[a] <= self.heads[b] else b

    def grow(self) -> None:
        self.heads += [_END] * self.size
        self.size *= 2
        self._rebuild()

    def set(self, run: int, head: tuple) -> None:
        self.heads[run] = head
        node = (run + self.size) // 2
        while node:
            self._play(node)
            node //= 2

    def best(self) -> int:
        return self.tree[1]

    def challenger(self) -> tuple:
        """The best head of all runs but the winner's: it lost to the winner somewhere on its path."""
        node, out = self.best() + self.size, _END
        while node > 1:
            out = min(out, self.heads[self.tree[node ^ 1]])
            node //= 2
        return out


def merge_blocks(blocks: Iterator[list[tuple]], most: int) -> Iterator[tuple[list[tuple], bool]]:
    """(rows, True) for sorted stretches of the sorted blocks' rows in order, until there are `most` of them; then (rows, False)
    for all others, in no order.

    Blocks come by rising first scores, open when a row of theirs may be next and close when they are used up.
    """
    tree = Tournament()
    free, open_at, rows = [0, 1], {}, {}
    given = 0

    def until(limit) -> Iterator[list[tuple]]:
        """What precedes every row of the blocks not yet open: they have no better score than limit."""
        while given < most:
            run = tree.best()
            head = tree.heads[run]
            if head == _END or (limit is not None and head[0] >= limit):
                return
            own, at = rows[run], open_at[run]
            end = bisect.bisect_right(own, tree.challenger(), at)
            if limit is not None:
                end = min(end, bisect.bisect_left(own, (limit,), at))
            yield own[at : max(end, at + 1)]
            at = max(end, at + 1)
            if at < len(own):
                open_at[run] = at
                tree.set(run, own[at])
            else:
                del rows[run], open_at[run]
                free.append(run)
                tree.set(run, _END)

    def ranked(stretches: Iterator[list[tuple]]) -> Iterator[tuple[list[tuple], bool]]:
        nonlocal given
        for stretch in stretches:
            taken = min(len(stretch), most - given)
            given += taken
            yield stretch[:taken], True
            if taken < len(stretch):
                yield stretch[taken:], False

    for block in blocks:
        if given < most:
            yield from ranked(until(block[0][0]))
        if given >= most:
            yield block, False
            continue
        if not free:
            free += range(tree.size, 2 * tree.size)
            tree.grow()
        run = free.pop()
        rows[run], open_at[run] = block, 0
        tree.set(run, block[0])
    yield from ranked(until(None))
    for run, own in rows.items():
        yield own[open_at[run] :], False


def _out(rows: list[tuple], first_rank: int | None) -> pa.RecordBatch:
    ranks = pa.nulls(len(rows), pa.int64()) if first_rank is None else pa.array(range(first_rank, first_rank + len(rows)), pa.int64())
    columns = [[None if r[1] else r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows], [-r[0] for r in rows]]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), ranks], ["doc_id", "n_features", "weight", "score", "rank"])


def draw(scored: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS, run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Every row of scored, a table, with its rank: 1 to floor(percent * N / 100) by falling score among N rows with enough words."""
    eligible = scored.where(F.col("n_words") >= least_words)
    n = eligible.count()
    total = percent * n // 100
    ranges = min(max(n // range_rows, 1), MOST_RANGES)
    cuts: list[int] = []
    if ranges > 1:
        shares = [1 - i / ranges for i in range(1, ranges)]
        cuts = sorted(set(eligible.select(F.percentile_approx("score", shares, 10 * ranges)).first()[0]), reverse=True)
    runs = settle(_sorted_runs(eligible, cuts, run_rows, block_rows))
    bases, base = {}, 0
    for r in runs.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect():  # one row a range, 4096 at most
        bases[r.range] = base
        base += r.n
    reached = [r for r, b in bases.items() if b < total]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        for part, group in itertools.groupby(rows, lambda r: r["range"]):
            rank = bases[part] + 1
            for found, drawn in merge_blocks((_entries(r["rows"]) for r in group), total - bases[part]):
                if found:
                    yield _out(found, rank if drawn else None)
                    rank += len(found) if drawn else 0

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("rows").to_pylist():
                yield _out(_entries(raw), None)

    last = max(reached, default=-1)
    schema = _ROW + ", rank long"
    merged = runs.where(F.col("range") <= last).repartition(max(len(reached), 1), "range").sortWithinPartitions("range", F.desc("top")).mapInArrow(merge, schema)
    rest = runs.where(F.col("range") > last).mapInArrow(unpack, schema)
    short = scored.where(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return merged.unionByName(rest).unionByName(short)


def resample(docs: DataFrame, target: DataFrame, *, longest: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document, for a draw that looks like the target's texts."""
    gain = gains(count_buckets(docs, longest=longest, buckets=buckets), count_buckets(target, longest=longest, buckets=buckets))
    return draw(settle(weigh(docs, gain, longest=longest, seed=seed)), percent=percent, least_words=least_words)


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl),
words AS (
  SELECT own, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM (SELECT true AS own, doc_id, text FROM documents UNION ALL SELECT false, NULL, text FROM benchmark)),
distinct_words AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM words),
bucket AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
                               lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b
  FROM distinct_words, steps),
counts AS (SELECT b, count(*) FILTER (WHERE own) AS s, count(*) FILTER (WHERE NOT own) AS t FROM words JOIN bucket USING (word) GROUP BY b),
sums AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counts),
gain AS (SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS g FROM counts, sums),
own AS (SELECT doc_id, count(*) AS n_features, sum(g)::BIGINT AS weight FROM words JOIN bucket USING (word) JOIN gain USING (b) WHERE own GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN own ON own.doc_id = d.doc_id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored s LEFT JOIN ranked r ON r.doc_id = s.doc_id
"""
