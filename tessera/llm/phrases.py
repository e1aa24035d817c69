"""Phrase collocation mining on vertical positional inverted lists.

The texts are dealt into shards of some megabytes, cut between pieces only. A shard's index holds, for each of its
phrases, the ordered list of its positions; a list's length is the phrase's exact number of occurrences there. A frequent
phrase grows by one word where the merged lists show an occurrence of a phrase of the same length at the next position:
that one ends in the adjacent word, and is itself frequent, without which the longer one could not be. Lengths are summed
over all shards, phrases below the least number go with their lists, and the next length follows.

Words, and phrases as (phrase, next word), are told apart by their own values; hashes only deal them to buckets. What
travels is packed: a row holds what one shard, or one task's shards together, have for one bucket. A bucket's first
pass adds the lengths and keeps the frequent phrases, its second pass streams the lists by them back to their shards.
The number of buckets follows the number of words, so that a bucket's phrases stay few; nothing is broadcast.

Defined results: a null text is an empty one, a null lang is `und`; pieces and words never cross texts, rows or
languages; every row counts, repeated ones and those without an id too; a text of any length is cut between its pieces,
so that only a single piece must fit a task; columns other than text and lang are not read; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .common import drop, narrow, read, settle

LEAST = 30
LONGEST = 4
TOP = 2000
WITHIN = 80
SHARD_BYTES = 4 << 20
#: Words (occurrences) a bucket, and phrases that a task adds up before it sends them.
BUCKET_WORDS = 1 << 19
HELD = 1 << 19

_ENDS = np.zeros(256, bool)  # what ends a piece
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD = ~_ENDS
_WORD[[0x20, 0x09]] = False
_SQUEEZE, _EXPAND = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
_INDEX = "shard long, ids binary, lasts binary, sizes binary, gaps binary"
_INDEX_TYPE = pa.schema([("shard", pa.int64()), *((c, pa.binary()) for c in ("ids", "lasts", "sizes", "gaps"))])
#: Counts by bucket, and lists by bucket after the bucket's frequent phrases (kind 0).
_COUNTED = {True: "bucket int, words array<string>, n binary", False: "bucket int, a binary, b binary, n binary"}
_LISTED = {True: "bucket int, kind int, shard long, words array<string>, sizes binary, gaps binary", False: "bucket int, kind int, shard long, a binary, b binary, sizes binary, gaps binary"}


# shards and their words


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(bytes, offsets of the texts, languages of the texts) of runs of about limit bytes; long texts are cut between pieces."""
    parts: list[np.ndarray] = []
    langs: list = []
    held = 0

    def flush():
        nonlocal parts, langs, held
        out = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts]))), pa.array(langs, pa.string())
        parts, langs, held = [], [], 0
        return out

    for batch in batches:
        data, offsets = T.buffers(batch.column("text"))
        for lang, a, b in zip(batch.column("lang").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            cuts = [b]
            if b - a > limit:
                ends = np.flatnonzero(_ENDS[data[a:b]]) + a + 1
                # the first end of a piece after each multiple of limit
                cuts = sorted({int(c) for c in ends[np.searchsorted(ends, np.arange(a + limit, b, limit)).clip(max=len(ends) - 1)]} | {b}) if len(ends) else [b]
            for cut in cuts:
                if cut > a:
                    parts.append(data[a:cut].copy())
                    langs.append(lang)
                    held += cut - a
                a = cut
                if held >= limit:
                    yield flush()
    if held:
        yield flush()


def _lists(data: np.ndarray, offsets: np.ndarray, langs: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words as language, line feed, word; sizes of their lists; positions list by list) of a shard; positions skip one
    between pieces."""
    data = T.LOWER[data]
    starts, ends, at = T.word_spans(data, offsets, _WORD)
    n = len(starts)
    if not n:
        return pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.int64)
    breaks = np.flatnonzero(_ENDS[data])
    apart = np.zeros(n, np.int64)
    apart[1:] = np.searchsorted(breaks, starts[1:]) > np.searchsorted(breaks, ends[:-1])
    apart[at[1:-1][(at[1:-1] > 0) & (at[1:-1] < n)]] = 1
    position = np.arange(n) + np.cumsum(apart)
    inside = np.concatenate([data[_WORD[data]], np.empty(0, np.uint8)])
    bounds = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(bounds), pa.py_buffer(inside)]).dictionary_encode()
    names = langs.dictionary_encode()
    key = np.repeat(names.indices.to_numpy().astype(np.int64), np.diff(at)) * len(words.dictionary) + words.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    distinct, sizes = np.unique(key, return_counts=True)
    lang = names.dictionary.take(pa.array(distinct // len(words.dictionary)))
    word = words.dictionary.take(pa.array(distinct % len(words.dictionary))).cast(pa.string())
    return pc.binary_join_element_wise(lang, word, "\n"), sizes, position[order]


def _to_gaps(positions: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each list as its first position and the steps from there."""
    out = np.diff(positions, prepend=0)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    out[first] = positions[first]
    return out.astype(np.int32)


def _from_gaps(gaps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    sums = np.cumsum(gaps, dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    before = np.where(first > 0, sums[np.maximum(first - 1, 0)], 0)
    return sums - np.repeat(before, sizes)



# buckets


def _planes(x: np.ndarray) -> bytes:
    """Integers byte by byte, all of their lowest bytes first, so that like ones stand together, and compressed."""
    x = np.ascontiguousarray(x)
    return _SQUEEZE.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _from_planes(raw: bytes, kind) -> np.ndarray:
    plain = np.frombuffer(_EXPAND.decompress(raw), np.uint8)
    return np.ascontiguousarray(plain.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _word_buckets(words: pa.Array, buckets: int) -> np.ndarray:
    data, offsets = T.buffers(words)
    own = data[offsets[0] : offsets[-1]] if len(words) else data[:0]
    ends = offsets - offsets[0] if len(words) else offsets
    return (T.span_hashes(own, ends[:-1], ends[1:]) % np.uint64(buckets)).astype(np.int64)


def _pair_buckets(a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    return (T.mix(T.mix(a.astype(np.uint64)) + b.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rows of it in their order)."""
    order = np.argsort(bucket, kind="stable")
    names, firsts = np.unique(bucket[order], return_index=True)
    for name, rows in zip(names.tolist(), np.split(order, firsts[1:])):
        yield name, rows


def _added(keys: tuple, n: np.ndarray) -> tuple[tuple, np.ndarray]:
    """Distinct keys with their sums: (words,), or (a, b) in order."""
    if len(keys) == 1:
        found = pa.table([keys[0], pa.array(n)], ["w", "n"]).group_by("w").aggregate([("n", "sum")]).combine_chunks()
        words = found.column("w")
        return (words.chunk(0) if words.num_chunks else pa.array([], pa.string()),), found.column("n_sum").to_numpy()
    a, b = keys
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    return (a[first], b[first]), np.add.reduceat(n, first) if len(first) else n


def _joined(parts: list) -> object:
    return pa.concat_arrays(parts) if isinstance(parts[0], pa.Array) else np.concatenate(parts)


class _Sums:
    """Counts that are added up when they are many."""

    def __init__(self):
        self.keys: list[tuple] = []
        self.n: list[np.ndarray] = []
        self.size = self.least = 0

    def add(self, keys: tuple, n: np.ndarray) -> None:
        self.keys.append(keys)
        self.n.append(n)
        self.size += len(n)
        if self.size > 2 * max(self.least, HELD):
            keys, n = self.whole()
            self.keys, self.n, self.size, self.least = [keys], [n], len(n), len(n)

    def whole(self) -> tuple[tuple, np.ndarray]:
        return _added(tuple(_joined(list(k)) for k in zip(*self.keys)), np.concatenate(self.n))


def _binaries(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, types[t]) for n, t in (c.split(" ") for c in schema.split(", "))])


def _counts(source: DataFrame, entries, buckets: int, *, words: bool) -> DataFrame:
    """Counts by bucket of what entries(batches) yields as (shard, keys, sizes, positions), added up over a task's shards."""
    schema = _arrow(_COUNTED[words])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()

        def flush() -> Iterator[pa.RecordBatch]:
            if not sums.size:
                return
            keys, n = sums.whole()
            for bucket, rows in _split(_word_buckets(keys[0], buckets) if words else _pair_buckets(*keys, buckets)):
                own = [keys[0].take(pa.array(rows)).to_pylist()] if words else [_planes(np.diff(keys[0][rows], prepend=0)), _planes(keys[1][rows])]
                yield _binaries([(bucket, *own, _planes(n[rows]))], schema)

        for _, keys, sizes, _ in entries(batches):
            sums.add(keys, sizes)
            if sums.least > HELD:
                yield from flush()
                sums = _Sums()
        yield from flush()

    return source.mapInArrow(run, _COUNTED[words])


def _read_counts(batches: Iterator[pa.RecordBatch], words: bool) -> Iterator[tuple[int, tuple, np.ndarray]]:
    for batch in batches:
        for i in range(len(batch)):
            n = _from_planes(batch.column("n")[i].as_buffer().to_pybytes(), np.int64)
            if words:
                keys = (batch.column("words")[i].values,)
            else:
                keys = tuple(_from_planes(batch.column(c)[i].as_buffer().to_pybytes(), np.int64) for c in ("a", "b"))
                keys = (np.cumsum(keys[0]), keys[1])
            yield batch.column("bucket")[i].as_py(), keys, n


def _frequent(counts: DataFrame, least: int, *, words: bool) -> DataFrame:
    """The frequent words or pairs of each bucket as one row of it, in an order that gives them their ids: bucket << 32 and
    their place. With words, also all occurrences by language."""
    name = _COUNTED[words] + (", langs array<string>, totals binary" if words else "")
    schema = _arrow(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in itertools.groupby(_read_counts(batches, words), lambda r: r[0]):
            sums = _Sums()
            for _, keys, n in rows:
                sums.add(keys, n)
            keys, n = sums.whole()
            keep = np.flatnonzero(n >= least)
            if words:
                lang = pc.list_element(pc.split_pattern(keys[0], "\n", max_splits=1, reverse=True), 0)
                total = pa.table([lang, pa.array(n)], ["l", "n"]).group_by("l").aggregate([("n", "sum")])
                own = (keys[0].take(pa.array(keep)).to_pylist(), _planes(n[keep]), total.column("l").to_pylist(), _planes(total.column("n_sum").to_numpy()))
            else:
                own = (_planes(np.diff(keys[0][keep], prepend=0)), _planes(keys[1][keep]), _planes(n[keep]))
            yield _binaries([(bucket, *own)], schema)

    return settle(counts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, name))


def _rows(frequent: DataFrame, *, words: bool) -> DataFrame:
    """Frequent words (id, lang, phrase, n), or pairs (id, a, b, n), a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, keys, n in _read_counts(batches, words):
            if words:
                parts = pc.split_pattern(keys[0], "\n", max_splits=1, reverse=True)
                own = [pc.list_element(parts, 0), pc.list_element(parts, 1)] if len(n) else [keys[0], keys[0]]
            else:
                own = [pa.array(k) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array((bucket << 32) + np.arange(len(n))), *own, pa.array(n)], ["id", *(("lang", "phrase") if words else ("a", "b")), "n"])

    columns = [c.split(" ")[0] for c in _COUNTED[words].split(", ")]
    return frequent.select(*columns).mapInArrow(run, "id long, lang string, phrase string, n long" if words else "id long, a long, b long, n long")


def _index(source: DataFrame, entries, frequent: DataFrame, buckets: int, *, words: bool) -> DataFrame:
    """(shard, ids, lasts, sizes, gaps): a row a shard with the lists of its frequent words or pairs, end to end.

    The lists go to their buckets, where they follow the bucket's frequent ones, and what is left goes back to the shards."""
    schema = _arrow(_LISTED[words])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, sizes, positions in entries(batches):
            gaps = _to_gaps(positions, sizes)
            firsts = np.cumsum(sizes) - sizes
            for bucket, rows in _split(_word_buckets(keys[0], buckets) if words else _pair_buckets(*keys, buckets)):
                own = [keys[0].take(pa.array(rows)).to_pylist()] if words else [_planes(np.diff(keys[0][rows], prepend=0)), _planes(keys[1][rows])]
                yield _binaries([(bucket, 1, shard, *own, _planes(sizes[rows].astype(np.int32)), _planes(gaps[T.ranges(firsts[rows], sizes[rows])]))], schema)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = ()
        for batch in batches:
            for i in range(len(batch)):
                bucket = batch.column("bucket")[i].as_py()
                if words:
                    keys: tuple = (batch.column("words")[i].values,)
                else:
                    keys = tuple(_from_planes(batch.column(c)[i].as_buffer().to_pybytes(), np.int64) for c in ("a", "b"))
                    keys = (np.cumsum(keys[0]), keys[1])
                if batch.column("kind")[i].as_py() == 0:
                    known = (bucket, keys if words else _lookup(*keys))
                    continue
                if not known or known[0] != bucket:
                    continue
                place = pc.index_in(keys[0], value_set=known[1][0]).fill_null(-1).to_numpy() if words else _found(known[1], *keys)
                has = place >= 0
                if not has.any():
                    continue
                sizes = _from_planes(batch.column("sizes")[i].as_buffer().to_pybytes(), np.int32)
                gaps = _from_planes(batch.column("gaps")[i].as_buffer().to_pybytes(), np.int32)
                ids = (bucket << 32) + place[has].astype(np.int64)
                yield _binaries([(batch.column("shard")[i].as_py(), ids.tobytes(), (ids if words else keys[1][has]).tobytes(), sizes[has].tobytes(), gaps[np.repeat(has, sizes)].tobytes())], _INDEX_TYPE)

    def pack(found: pa.Table) -> pa.Table:
        return pa.table({"shard": found.column("shard").slice(0, 1), **{c: pa.array([b"".join(found.column(c).to_pylist())]) for c in ("ids", "lasts", "sizes", "gaps")}}, schema=_INDEX_TYPE)

    names = [c.split(" ")[0] for c in _LISTED[words].split(", ")]
    marks = frequent.withColumns({"kind": F.lit(0), "shard": F.lit(None).cast("long"), "sizes": F.lit(None).cast("binary"), "gaps": F.lit(None).cast("binary")}).select(names)
    both = marks.unionByName(source.mapInArrow(deal, _LISTED[words]))
    left = both.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(keep, _INDEX)
    return settle(left.groupBy("shard").applyInArrow(pack, _INDEX))


def _lookup(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct a, distinct b, sorted numbers of the pairs) of pairs in order."""
    first, second = np.unique(a), np.unique(b)
    return first, second, np.searchsorted(first, a) * len(second) + np.searchsorted(second, b)


def _found(known: tuple[np.ndarray, np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The places of pairs among the known ones, -1 where they are not."""
    first, second, numbers = known
    if not len(numbers):
        return np.full(len(a), -1)
    i, j = np.searchsorted(first, a).clip(max=len(first) - 1), np.searchsorted(second, b).clip(max=len(second) - 1)
    number = i * len(second) + j
    place = np.searchsorted(numbers, number).clip(max=len(numbers) - 1)
    return np.where((first[i] == a) & (second[j] == b) & (numbers[place] == number), place, -1)


# words and their extension


def _words(shard_bytes: int):
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        base = TaskContext.get().partitionId() << 32
        for number, (data, offsets, langs) in enumerate(_shards(batches, shard_bytes)):
            words, sizes, positions = _lists(data, offsets, langs)
            if len(words):
                yield base + number, (words,), sizes, positions

    return entries


def _longer(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each shard's phrases with the adjacent word: the merged lists' neighbours one position apart."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, lasts = (np.frombuffer(row[c], np.int64) for c in ("ids", "lasts"))
            sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
            positions = _from_gaps(np.frombuffer(row["gaps"], np.int32), sizes)
            owner = np.repeat(np.arange(len(ids)), sizes)
            merged = np.argsort(positions, kind="stable")  # one phrase at most begins at a position
            positions, owner = positions[merged], owner[merged]
            meet = np.flatnonzero(np.diff(positions) == 1)
            if not len(meet):
                continue
            first, a = np.unique(ids, return_inverse=True)
            words, last = np.unique(lasts, return_inverse=True)
            key = a[owner[meet]] * len(words) + last[owner[meet + 1]]
            order = np.argsort(key, kind="stable")
            distinct, n = np.unique(key, return_counts=True)
            yield row["shard"], (first[distinct // len(words)], words[distinct % len(words)]), n, positions[meet][order]


def frequent_phrases(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, n) of all phrases of 1 to `longest` words that occur `least` times, and (lang, n) of all words."""
    narrow(docs.sparkSession)
    texts = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).where("text is not null")
    bytes_ = texts.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = int(max(16, bytes_ // 6 // BUCKET_WORDS))
    entries = _words(shard_bytes)
    frequent = _frequent(_counts(texts, entries, buckets, words=True), least, words=True)
    index = _index(texts, entries, frequent.select("bucket", "words"), buckets, words=True)
    totals = settle(_totals(frequent))
    words = settle(_rows(frequent, words=True))
    drop(frequent)
    found = [words]
    word_of = words.select(F.col("id").alias("b"), F.col("phrase").alias("word"))
    for size in range(2, longest + 1):
        frequent = _frequent(_counts(index, _longer, buckets, words=False), least, words=False)
        before = found[-1].select(F.col("id").alias("a"), "lang", "phrase")
        named = _rows(frequent, words=False).join(before, "a").join(word_of, "b")
        found.append(settle(named.select("id", "lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), "n")))
        if size < longest:
            following = _index(index, _longer, frequent.select("bucket", "a", "b"), buckets, words=False)
            drop(index)
            index = following
        drop(frequent)
    drop(index)
    out = found[0].select("lang", F.lit(1).alias("size"), "phrase", "n")
    for size, table in enumerate(found[1:], 2):
        out = out.unionByName(table.select("lang", F.lit(size).alias("size"), "phrase", "n"))
    return out, totals


def _totals(frequent: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, raw in zip(batch.column("langs"), batch.column("totals")):
                yield pa.RecordBatch.from_arrays([langs.values, pa.array(_from_planes(raw.as_buffer().to_pybytes(), np.int64))], ["lang", "n"])

    return frequent.select("langs", "totals").mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


# scores


def _exact(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(19,0)")


def collocations(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, top: int = TOP, within: int = WITHIN, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases, by their lowest-scoring cut."""
    phrases, totals = frequent_phrases(docs, least=least, longest=longest, shard_bytes=shard_bytes)
    candidates = phrases.where("size > 1").withColumnRenamed("n", "a")
    words = F.split("phrase", " ")

    def part(first: Column, length: Column) -> Column:
        return F.array_join(F.slice(words, first, length), " ")

    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), part(F.lit(1), k).alias("left"), part(k + 1, F.col("size") - k).alias("right")))
    cuts = candidates.select("lang", "phrase", "size", "a", F.inline(cuts))
    side = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    value = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    worst = cuts.groupBy("lang", "phrase").agg(F.first("size").alias("size"), F.first("a").alias("a"), F.min(F.struct(value.alias("score"), "k", "l", "r")).alias("cut"))
    # the phrases inside each candidate, and the most frequent candidate around each
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: part(i, m))))
    around = candidates.where("size > 2").select("lang", "a", F.explode(F.array_distinct(spans)).alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = worst.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_exact("longer") * 100 < _exact("a") * within))
    kept = kept.select("lang", "phrase", *(F.col(c).cast("long").alias(c.removeprefix("cut.")) for c in ("a", "cut.l", "cut.r", "cut.score")))
    # a language's rows first by parts of it, so that no task ranks a whole language
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(1024)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", F.col("n").cast("long"), "score")


def op11_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents").select("text", "lang"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, row_number() OVER () AS piece, part
  FROM (SELECT lang, doc_id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part
        FROM documents WHERE text IS NOT NULL)),
words AS (
  SELECT lang, piece, unnest(w) AS word, generate_subscripts(w, 1) AS pos
  FROM (SELECT lang, piece, regexp_extract_all(part, '[^\x20\x09]+') AS w FROM pieces)),
runs AS (
  SELECT lang, word AS w1, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3, lead(word, 3) OVER p AS w4
  FROM words WINDOW p AS (PARTITION BY piece ORDER BY pos)),
f AS (
  SELECT lang, [w1] AS p, count(*)::HUGEINT AS n FROM runs GROUP BY ALL
  UNION ALL SELECT lang, [w1, w2], count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM runs WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT * FROM f WHERE len(p) > 1),
cuts AS (
  SELECT c.lang, c.p, c.n AS a, k, l.n AS l, r.n AS r, 2000000 * c.n // (l.n + r.n) AS score
  FROM c, (VALUES (1), (2), (3)) v(k)
  JOIN f l ON l.lang = c.lang AND l.p = c.p[1:k] JOIN f r ON r.lang = c.lang AND r.p = c.p[k + 1:len(c.p)]
  WHERE k < len(c.p)),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (
  SELECT c.lang, c.p[i:i + m - 1] AS p, max(c.n) AS longer
  FROM c, (VALUES (2), (3)) v(m), (VALUES (1), (2), (3)) s(i)
  WHERE m < len(c.p) AND i + m - 1 <= len(c.p) GROUP BY ALL),
kept AS (
  SELECT w.* FROM worst w LEFT JOIN inside i ON i.lang = w.lang AND i.p = w.p
  WHERE i.longer IS NULL OR 100 * i.longer < 80 * w.a),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank,
         array_to_string(p, ' ') AS phrase, a, l, r, score FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, t.n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN (SELECT lang, count(*) AS n FROM words GROUP BY lang) t USING (lang) WHERE rank <= 2000
"""
