"""Removal of byte strings that repeat across documents, by depth-limited suffix sorting.

A byte goes if a string of LENGTH bytes over it also starts in a document with a smaller doc_id. Equal strings
are equal groups of suffixes that are sorted by most-significant-digit radix passes, a few bytes a pass, only
as deep as LENGTH bytes.

Not all suffixes need sorting. Each string names one anchor, the smallest hash of the GRAM-byte grams in it, so
equal strings name equal anchors; a string whose anchor no other text holds is unique. Anchors are exchanged in
packed blocks, where a task names an anchor that several of its texts hold only twice, then the runs of strings
under shared anchors are cut out and reduced to the distinct ones, each with its smallest doc_id. Distinct runs
are brought together anchor by anchor and sorted. An anchor with more runs than a task holds at once is split: its
runs are cut by the next smallest hashes of each string (4, then 16, then the whole string), for which equal
strings agree too, and the pieces are sorted in the same way. What the sort finds for a run goes back to the texts
that hold it by one join.

Equal texts are one class, known by a 64-bit hash, and only its smallest doc_id's text is compared: every byte of
the others goes, if there are LENGTH of them.

Defined results: a null text is empty; texts shorter than LENGTH keep all; a null doc_id counts as larger than
every other; rows that agree in doc_id and text get the same result and do not remove each other; further columns
change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import drop, narrow, read, settle

LENGTH, GRAM = 50, 20
#: Bytes of runs that a task gathers before it sorts; an anchor with more of them is split.
BATCH = 4 << 20
#: How many of a string's smallest gram hashes name its group, by round of splitting; 0 is the string itself.
FINER = (4, 16, 0)
_LAST = (1 << 63) - 1


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings under one anchor: anchor (48 bits), row, first start and number of strings."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    low = T.gram_hashes(data, gram) >> np.uint64(16)
    width, reach = length - gram + 1, 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    low = low.astype(np.int64)
    ok = np.zeros(len(data) + 1, np.int32)
    sizes = np.diff(offsets)
    some = np.flatnonzero(sizes >= length)
    np.add.at(ok, offsets[some], 1)
    np.add.at(ok, offsets[some] + sizes[some] - length + 1, -1)
    valid = np.cumsum(ok)[: len(low)] > 0
    head = valid.copy()
    head[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
    head[offsets[some]] = True
    start = np.flatnonzero(head)
    row = np.searchsorted(offsets, start, "right") - 1
    after = np.append(start[1:], len(low))
    stop = np.minimum(after, offsets[row + 1] - length + 1)
    return low[start], row, start, stop - start


def equal_groups(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes (their indices) that share their first length bytes and their group with others, and their new groups.

    group ascends from 0 without gaps. Each pass sorts by group and as many further bytes as fit with it into one
    64-bit key; groups whose next bytes are all the same stay as they are, and suffixes alone in theirs drop out.
    """
    wide = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    words = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | wide[k : k + len(words)]
    index, depth = np.arange(len(at)), 0
    while depth < length and len(index):
        step = min((64 - int(group[-1]).bit_length()) // 8, length - depth, 8)
        digit = words[at[index] + depth] >> np.uint64(64 - 8 * step)
        key = digit if step == 8 else group.astype(np.uint64) << np.uint64(8 * step) | digit
        mixed = np.zeros(int(group[-1]) + 1, bool)
        mixed[group[1:][(group[1:] == group[:-1]) & (key[1:] != key[:-1])]] = True
        part = np.flatnonzero(mixed[group])
        order = part[np.argsort(key[part])]
        index[part], key[part] = index[order], key[order]
        new = np.ones(len(index), bool)
        new[1:] = key[1:] != key[:-1]
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        index, group = index[several], np.cumsum(new[several]) - 1
        depth += step
    return index, group


def _packed(mark: np.ndarray, cls: np.ndarray, bucket: np.ndarray) -> list[tuple[int, bytes]]:
    """(bucket, block) of the pairs: a block has its classes, how many anchors each holds, and the anchors' 6 bytes."""
    order = np.lexsort((mark, cls, bucket))
    mark, cls, bucket = mark[order], cls[order], bucket[order]
    names, first = np.unique(bucket, return_index=True)
    out = []
    for b, lo, hi in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(bucket)]):
        c, m = cls[lo:hi], mark[lo:hi]
        head = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        counts = np.diff(np.append(head, len(c))).astype(np.uint32)
        low = np.ascontiguousarray(m.view(np.uint8).reshape(-1, 8)[:, :6])
        out.append((b, np.uint32(len(head)).tobytes() + c[head].tobytes() + counts.tobytes() + low.tobytes()))
    return out


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(block, np.uint32, 1)[0])
    counts = np.frombuffer(block, np.uint32, n, 4 + 8 * n)
    wide = np.zeros((int(counts.sum()), 8), np.uint8)
    wide[:, :6] = np.frombuffer(block, np.uint8, offset=4 + 12 * n).reshape(-1, 6)
    return np.repeat(np.frombuffer(block[4 : 4 + 8 * n], np.int64), counts), wide.view("<i8").ravel()


def _anchors(texts: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """(bucket, block): packed distinct anchors of each text class, once a task.

    Pairs whose anchor at least two of the task's classes hold are settled here: they go to buckets from `buckets`
    on, dealt by class, and only two of them are sent to the anchor's own bucket, so that a bucket gets at most two
    pairs of an anchor from each task, however many texts hold it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        marks, classes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for batch in batches:
            own = batch.column("cls").to_numpy()
            for first, last, data, offsets in T.slices(batch.column("text")):
                anchor, row, _, _ = anchor_runs(data, offsets, length, gram)
                fresh = np.array([not (c in seen or seen.add(c)) for c in own[first:last].tolist()], bool)
                keep = fresh[row]
                mark, cls = anchor[keep], own[first:last][row[keep]]
                order = np.lexsort((mark, cls))
                mark, cls = mark[order], cls[order]
                new = np.ones(len(mark), bool)
                new[1:] = (mark[1:] != mark[:-1]) | (cls[1:] != cls[:-1])
                marks.append(mark[new])
                classes.append(cls[new])
            if sum(map(len, marks)) > 1 << 20:
                yield from done(marks, classes)
                marks, classes = marks[:1], classes[:1]
        yield from done(marks, classes)

    def done(marks: list[np.ndarray], classes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        mark, cls = np.concatenate(marks), np.concatenate(classes)
        order = np.lexsort((cls, mark))
        mark, cls = mark[order], cls[order]
        head = np.ones(len(mark), bool)
        head[1:] = mark[1:] != mark[:-1]
        group = np.cumsum(head) - 1
        nth = np.arange(len(mark)) - np.flatnonzero(head)[group]
        several = np.bincount(group)[group] > 1 if len(group) else head
        sent, known = nth < 2, several & (nth > 1)
        rows = _packed(mark[sent], cls[sent], mark[sent] % buckets) + _packed(mark[known], cls[known], buckets + (T.mix(cls[known].view(np.uint64)) % np.uint64(buckets)).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "block"])

    return texts.mapInArrow(run, "bucket int, block binary")


def _shared(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(cls, anchor) of the anchors that at least two classes hold; a bucket at a time, for they come sorted."""

    def pairs(cls: np.ndarray, mark: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(cls), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(cls[a : a + 100_000]), pa.array(mark[a : a + 100_000])], ["cls", "anchor"])

    def done(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        both = [_unpacked(block) for block in blocks]
        cls, mark = (np.concatenate([x[k] for x in both]) for k in (0, 1))
        order = np.lexsort((cls, mark))
        cls, mark = cls[order], mark[order]
        new = np.ones(len(mark), bool)
        new[1:] = (mark[1:] != mark[:-1]) | (cls[1:] != cls[:-1])
        cls, mark = cls[new], mark[new]
        same = mark[1:] == mark[:-1]
        keep = np.append(False, same) | np.append(same, False)
        yield from pairs(cls[keep], mark[keep])

    current, blocks = None, []
    for batch in batches:
        for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist()):
            if bucket >= buckets:
                yield from pairs(*_unpacked(block))
                continue
            if bucket != current and blocks:
                yield from done(blocks)
                blocks = []
            current = bucket
            blocks.append(block)
    if blocks:
        yield from done(blocks)


def _marked(lists: pa.Array, first: int, last: int) -> np.ndarray:
    """The lists' anchors of rows first to last - 1, each with its row from 0 in the high bits."""
    lists = lists.slice(first, last - first)
    return lists.value_parent_indices().to_numpy() << 48 | lists.flatten().to_numpy()


def _segments(held: DataFrame, length: int, gram: int) -> DataFrame:
    """(cls, doc, anchor, start, bytes): runs of strings under shared anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in T.slices(batch.column("text")):
                anchor, row, start, count = anchor_runs(data, offsets, length, gram)
                keep = np.flatnonzero(np.isin(row << 48 | anchor, _marked(batch.column("anchors"), first, last)))
                for a in range(0, len(keep), 50_000):
                    part = keep[a : a + 50_000]
                    owner = pa.array(first + row[part])
                    strings = _cut_out(data, start[part], count[part] - 1 + length)
                    yield pa.RecordBatch.from_arrays([batch.column("cls").take(owner), batch.column("doc").take(owner), pa.array(anchor[part]), pa.array(start[part] - offsets[row[part]]), strings], ["cls", "doc", "anchor", "start", "bytes"])

    return held.mapInArrow(run, "cls long, doc long, anchor long, start long, bytes binary")


def _cut_out(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data[T.ranges(start, size)])])


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and each row's offset."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def finer_keys(data: np.ndarray, at: np.ndarray, length: int, gram: int, many: int) -> np.ndarray:
    """Of each string data[at : at + length], a hash of its `many` smallest gram hashes, or of itself where many is 0."""
    if not many:
        return T.gram_hashes(data, length)[at].view(np.int64)
    hashes, width = T.gram_hashes(data, gram), length - gram + 1
    out = np.zeros(len(at), np.uint64)
    for a in range(0, len(at), 50_000):
        least = np.sort(hashes[at[a : a + 50_000, None] + np.arange(width)], 1)[:, :many]
        for k in range(least.shape[1]):
            out[a : a + 50_000] = T.mix(out[a : a + 50_000] + least[:, k])
    return out.view(np.int64)


def _finer(pieces: DataFrame, length: int, gram: int, many: int) -> DataFrame:
    """(a, b, doc, at, key, bytes): the pieces cut where the finer key of their strings changes, at the place at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for top in range(0, len(whole), 10_000):
                batch = whole.slice(top, 10_000)
                data, offsets = _bytes_of(batch.column("bytes"))
                count = np.diff(offsets) - length + 1
                at, row = T.ranges(offsets[:-1], count), np.repeat(np.arange(len(count)), count)
                keys = finer_keys(data, at, length, gram, many)
                head = np.ones(len(at), bool)
                head[1:] = (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])
                first = np.flatnonzero(head)
                size = np.diff(np.append(first, len(at))) - 1 + length
                own = pa.array(row[first])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in ("a", "b", "doc")), pa.array(at[first] - offsets[row[first]]), pa.array(keys[first]), _cut_out(data, at[first], size)], ["a", "b", "doc", "at", "key", "bytes"])

    return pieces.select("a", "b", "doc", "bytes").mapInArrow(run, "a long, b long, doc long, at long, key long, bytes binary")


def _least_docs(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings of the table's runs: their run, place in it, run's doc, and the smallest doc with an equal string under the key."""
    doc, key = (table.column(c).to_numpy() for c in ("doc", "key"))
    data, offsets = _bytes_of(table.column("bytes").combine_chunks())
    count = np.diff(offsets) - length + 1
    at = T.ranges(offsets[:-1], count)
    run = np.repeat(np.arange(len(count)), count)
    own = doc[run]
    least = own.copy()
    rank = np.cumsum(np.append(False, key[1:] != key[:-1]))
    index, group = equal_groups(data, at, rank[run], length)
    if len(index):
        best = np.full(group[-1] + 1, _LAST)
        np.minimum.at(best, group, own[index])
        least[index] = best[group]
    return run, at - offsets[run], own, least


def _true_runs(gone: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the stretches of gone within equal values of run."""
    head, tail = gone.copy(), gone.copy()
    head[1:] &= ~gone[:-1] | (run[1:] != run[:-1])
    tail[:-1] &= ~gone[1:] | (run[1:] != run[:-1])
    return np.flatnonzero(head), np.flatnonzero(tail)


def _sorted_spans(length: int):
    """For pieces that come sorted by key: (a, b, doc, spans), what of the piece is in a smaller text.

    Whole keys are taken together, about BATCH bytes at once. Pieces of one text that lose nothing are left out.
    """

    def work(table: pa.Table) -> pa.RecordBatch:
        run, place, own, least = _least_docs(table, length)
        first, last = _true_runs(least < own, run)
        edges = np.searchsorted(run[first], np.arange(len(table) + 1))
        spans = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.StructArray.from_arrays([pa.array(place[first]), pa.array(place[last] + length)], ["start", "stop"]))
        found = pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in ("a", "b", "doc")), spans], ["a", "b", "doc", "spans"])
        return found.filter(pa.array((np.diff(edges) > 0) | (table.column("texts").to_numpy() > 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            own.append(batch)
            held += batch.nbytes
            if held > BATCH:
                whole = pa.Table.from_batches(own).combine_chunks()
                marks = whole.column("key").to_numpy()
                cut = int(np.searchsorted(marks, marks[-1]))
                if cut:
                    yield work(whole.slice(0, cut).combine_chunks())
                own = whole.slice(cut).combine_chunks().to_batches()
                held = sum(x.nbytes for x in own) if cut else 0
        if sum(map(len, own)):
            yield work(pa.Table.from_batches(own).combine_chunks())

    return run


def _distinct(pieces: DataFrame) -> DataFrame:
    """(a, b, key, bytes, doc, texts): each (key, bytes) of the pieces once, named by two hashes, with its smallest doc."""
    one = settle(pieces.groupBy("key", "bytes").agg(F.min("doc").alias("doc"), F.count("*").alias("texts")))
    out = one.select(*_name(), "key", "bytes", "doc", "texts")
    out._tessera_path = one._tessera_path
    return out


def _name() -> list:
    return [F.xxhash64("key", "bytes").alias("a"), F.xxhash64("bytes", "key").alias("b")]


def _back(pieces: DataFrame, found: DataFrame, at: str) -> DataFrame:
    """The spans of found (a, b, doc, spans) for all pieces (x, y, doc, size, at) that they name, counted from at.

    A piece of a text beside the one of the smallest doc is lost as a whole.
    """
    found = found.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("doc").alias("least"), "spans")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("stop")))
    spans = F.when(F.col("doc") > F.col("least"), whole).otherwise(F.col("spans"))
    moved = F.transform(spans, lambda s: F.struct((s["start"] + F.col(at)).alias("start"), (s["stop"] + F.col(at)).alias("stop")))
    return pieces.join(found, ["x", "y"]).withColumn("spans", moved).where(F.size("spans") > 0)


def _resolved(pieces: DataFrame, length: int, gram: int, most: int, finer: tuple[int, ...]) -> DataFrame:
    """(a, b, doc, spans) of the distinct pieces that several texts hold or that lose bytes to a smaller text.

    Those under keys of more than `most` bytes are cut by the next of `finer`, and what then agrees is one piece.
    """
    crowded = pieces.groupBy("key").agg(F.sum(F.octet_length("bytes")).alias("size")).where(F.col("size") > most).select("key")
    some = bool(finer) and crowded.limit(1).count() > 0
    ready = pieces.join(crowded, "key", "left_anti") if some else pieces
    found = ready.select("key", "a", "b", "doc", "texts", "bytes").repartition("key").sortWithinPartitions("key")
    found = found.mapInArrow(_sorted_spans(length), "a long, b long, doc long, spans array<struct<start:long,stop:long>>")
    if not some:
        return found
    rest = pieces.join(crowded, "key", "left_semi")
    cut = settle(_finer(rest, length, gram, finer[0]))
    inner = _resolved(_distinct(cut.select("key", "bytes", "doc")), length, gram, most, finer[1:])
    names = [c.alias(n) for c, n in zip(_name(), "xy")]
    back = _back(cut.select("a", "b", "doc", "at", F.octet_length("bytes").alias("size"), *names), inner, "at")
    back = back.groupBy("a", "b").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    lost = rest.select("a", "b", "doc", "texts").join(back, ["a", "b"], "left").where("texts > 1 or spans is not null")
    return found.unionByName(lost.select("a", "b", "doc", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans")))


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, most: int = BATCH, finer: tuple[int, ...] = FINER) -> DataFrame:
    """(cls, doc, spans): the smallest id of each text class, and what goes from that one's text."""
    spark = docs.sparkSession
    narrow(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), "text").where(F.octet_length("text") >= length).withColumn("cls", F.xxhash64("text"))
    classes = settle(docs.groupBy("cls").agg(F.min("doc_id").alias("doc")))
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = _anchors(docs.select("cls", "text"), buckets, length, gram)
    shared = settle(blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: _shared(batches, buckets), "cls long, anchor long"))
    lists = shared.groupBy("cls").agg(F.collect_set("anchor").alias("anchors")).join(classes, "cls").withColumnRenamed("cls", "list_cls")
    held = docs.join(lists, (F.col("doc_id") == F.col("doc")) & (F.col("cls") == F.col("list_cls"))).select("cls", "doc", "text", "anchors")
    segments = settle(_segments(held, length, gram))
    drop(shared)
    runs = _distinct(segments.select(F.col("anchor").alias("key"), "bytes", "doc"))
    # written before the join, so that the sort's shuffle and the runs are gone by then
    found = settle(_resolved(runs, length, gram, most, finer))
    drop(runs)
    names = [c.alias(n) for c, n in zip(_name(), "xy")]
    back = _back(segments.withColumnRenamed("anchor", "key").select("cls", "start", "doc", F.octet_length("bytes").alias("size"), *names), found, "start")
    spans = back.groupBy("cls").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    out = settle(classes.join(spans, "cls", "left"))
    drop(segments, found)
    return out


def cut(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, most: int = BATCH, finer: tuple[int, ...] = FINER) -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans) of every row of docs."""
    marks = repeated_spans(docs, length=length, gram=gram, most=most, finer=finer).withColumnRenamed("cls", "mark_cls")
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("cls")).join(marks, F.col("cls") == F.col("mark_cls"), "left")
    rows = rows.select("doc_id", "text", F.coalesce(F.coalesce("doc_id", F.lit(_LAST)) > F.col("doc"), F.lit(False)).alias("copy"), F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, copy, starts, stops in zip(batch.column("text"), batch.column("copy").to_pylist(), batch.column("starts"), batch.column("stops")):
                raw = (text.as_py() or "").encode()
                if copy:
                    out.append((b"", len(raw), len(raw), 1))
                elif not starts.is_valid:
                    out.append((raw, len(raw), 0, 0))
                else:
                    a, b = (np.array(x.as_py(), np.int64) for x in (starts, stops))
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    head = np.append(True, a[1:] > b[:-1])  # spans that touch are one
                    first, last = a[head], b[np.append(np.flatnonzero(head)[1:] - 1, len(b) - 1)]
                    ends = np.append(first, len(raw))
                    kept = b"".join(raw[i:j] for i, j in zip([0, *last.tolist()], ends.tolist()))
                    out.append((kept, len(raw), len(raw) - len(kept), len(first)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in out], pa.binary()), *(pa.array([x[k] for x in out], pa.int64()) for k in (1, 2, 3)), pa.array([hashlib.sha256(x[0]).hexdigest() for x in out], pa.string())], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return cut(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
