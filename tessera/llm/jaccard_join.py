"""N-gram Jaccard join of documents by rare-first prefix filtering, and the groups that its links make.

A document is the set of its distinct k-word shingles, hashed to 64 bits. Documents of equal sets are one
class. Shingles are ordered rare first, by a count sketch of fixed width over the whole corpus, and a class
is posted under the shingles of its prefix only: two sets that reach the threshold share one there. Within
a shingle's postings the length and positional filters and the suffix filter (the sizes of both sets' parts
in fixed ranges of the hash space) bound the overlap. What passes is verified once, on the sets.

Only the groups are wanted, so links within a group that is known already are not looked for. First, a shingle's
postings are put in an order in which alike sets are near (by one of four minima of the set's hashes, another for
another shingle) and cut into runs of at most BLOCK; in a run each class meets the few nearest before it, by the
suffix filter's bound. That is linear, however many postings a shingle has. What is verified makes groups. Then all candidates that lie in different
groups still are verified too; shingles whose postings are of one group by now, as those of large groups of near
copies are, take no part. No link between groups is lost. A shingle that many classes of several groups post is dealt
out in pairs of blocks. `linked_pairs` verifies every candidate, and gives all links between classes.

Defined results: null texts and texts without words have an empty set and link with nothing; component_id
is the smallest doc_id that links reach; a null doc_id joins its group without naming it (and has a null
component_id where no member has an id); repeated rows are of one class; further columns change nothing;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import drop, narrow, packed, read, settle, unpacked
from .components import connected

SHINGLE, PERCENT = 4, 85
#: Places of the count sketch (fixed, so that its broadcast is 4 MB at any size) and of the suffix filter.
SKETCH_BITS = 20
RANGES = 128
#: Candidates that a class meets under a shingle at first, those that the suffix filter puts nearest.
NEAREST = 3
#: Minima of a set's hashes that its postings are ordered by.
MINIMA = 4
#: Bytes of postings that a task gathers before it pairs them.
BATCH = 8 << 20
#: Places of the filter that picks the sets to verify (fixed: 8 MB).
FILTER_BITS = 26
#: Postings of one shingle that meet in one task; more are dealt out in pairs of blocks.
BLOCK = 1024
_CHUNK = 1 << 14
_PAIRS = 1 << 20
_BYTES = 6  # of each hash that verification compares


def set_rows(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of each set: its size, its class (a hash of the whole set), and its sizes in the ranges of the hash space, after them
    the MINIMA least values of its hashes mixed in so many ways."""
    sizes = np.diff(at)
    full = np.flatnonzero(sizes)
    classes = np.zeros(len(sizes), np.uint64)
    if len(full):
        classes[full] = T.mix(np.add.reduceat(T.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), at[full]) + sizes[full].astype(np.uint64))
    row = np.repeat(np.arange(len(sizes)), sizes)
    parts = np.bincount(row * RANGES + (hashes >> np.uint64(57)).astype(np.int64), minlength=len(sizes) * RANGES).reshape(-1, RANGES)
    least = np.zeros((len(sizes), MINIMA), np.uint64)
    if len(full):
        for k in range(MINIMA):
            least[full, k] = np.minimum.reduceat(T.mix(hashes + np.uint64(0x632BE59BD9B4E019 * (k + 1) & (1 << 64) - 1)), at[full])
    both = np.concatenate((np.minimum(parts, 255).astype(np.uint8), least.view(np.uint8).reshape(len(sizes), -1)), 1)
    return sizes, classes.view(np.int64), [x.tobytes() for x in both]


def _describe(docs: DataFrame, k: int) -> DataFrame:
    """kind 0: (id, n, cls, ranges, mark) of each row, mark a hash of the text itself; kind 1: a chunk of the task's sketch counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["kind", "id", "n", "cls", "data", "mark"]
        for batch in batches:
            for first, last, data, offsets in T.slices(batch.column("text")):
                hashes, at = T.shingle_sets(data, offsets, k)
                counts += np.bincount((hashes & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=len(counts))
                sizes, classes, parts = set_rows(hashes, at)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sizes), np.int32)), batch.column("doc_id").slice(first, last - first), pa.array(sizes), pa.array(classes), pa.array(parts, pa.binary()), batch.column("mark").slice(first, last - first)], names)
        chunks = np.flatnonzero(counts.reshape(-1, _CHUNK).any(1))
        low = np.minimum(counts, 2**31 - 1).astype(np.int32).reshape(-1, _CHUNK)
        zero = pa.array(np.zeros(len(chunks), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(chunks), np.int32)), pa.array(chunks), zero, zero, pa.array([low[c].tobytes() for c in chunks], pa.binary()), zero], names)

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark")).mapInArrow(run, "kind int, id long, n long, cls long, data binary, mark long")


def _sketch(described: DataFrame) -> np.ndarray:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column("id").to_pylist(), batch.column("data").to_pylist()):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(data, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in sums.values()], pa.binary())], ["id", "data"])

    counts = np.zeros((1 << SKETCH_BITS) // _CHUNK * _CHUNK, np.int32).reshape(-1, _CHUNK)
    parts = described.where("kind = 1").select("id", "data").repartition(16, "id").mapInArrow(add, "id long, data binary")
    for r in parts.collect():  # the whole sketch: 4 MB, whatever the corpus
        counts[r.id] = np.frombuffer(r.data, np.int32)
    return counts.ravel()


def _postings(docs: DataFrame, counts: np.ndarray, k: int, percent: int) -> DataFrame:
    """(token, cls, n, pos, hot) of the prefix of each class, once a task; hot: the sketch can't rule out many postings."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, mask, seen = sent.value, np.uint64((1 << SKETCH_BITS) - 1), set()
        for batch in batches:
            for _, _, data, offsets in T.slices(batch.column("text")):
                hashes, at = T.shingle_sets(data, offsets, k)
                sizes, classes, _ = set_rows(hashes, at)
                often = counts[(hashes & mask).astype(np.int64)]
                tokens, owners, places = [], [], []
                for row in np.flatnonzero(sizes):
                    cls = int(classes[row])
                    if cls in seen:
                        continue
                    seen.add(cls)
                    a, n = at[row], int(sizes[row])
                    order = a + np.lexsort((hashes[a : a + n], often[a : a + n]))[: n - -(-percent * n // 100) + 1]
                    tokens.append(order)
                    owners.append(np.full(len(order), row))
                    places.append(np.arange(len(order), dtype=np.int32))
                if tokens:
                    order, owner = np.concatenate(tokens), np.concatenate(owners)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[order].view(np.int64)), pa.array(classes[owner]), pa.array(sizes[owner].astype(np.int32)), pa.array(np.concatenate(places)), pa.array(often[order] > BLOCK)], ["token", "cls", "n", "pos", "hot"])

    return docs.select("text").mapInArrow(run, "token long, cls long, n int, pos int, hot boolean")


def _gathered(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    own = list(batches)
    return pa.Table.from_batches(own).combine_chunks() if own else None


def _groups(table: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of names[0], names[1], ..., each class once a group of names[0] and names[1]; starts of the groups;
    group of each row."""
    columns = [table.column(c).to_numpy() for c in names]
    order = np.lexsort((table.column("cls").to_numpy(), *columns[::-1]))
    first, second, cls = columns[0][order], columns[1][order], table.column("cls").to_numpy()[order]
    head = np.ones(len(order), bool)
    head[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    keep = head.copy()
    keep[1:] |= cls[1:] != cls[:-1]
    group = np.cumsum(head)[keep] - 1
    order = order[keep]
    return order, np.searchsorted(group, np.arange(group[-1] + 1 if len(group) else 0)), group


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of shingles with at least two classes; a task's part of all shingles but the very frequent ones."""
    if (table := _gathered(batches)) is not None and len(table):
        order, start, group = _groups(table.append_column("part", pa.array(np.zeros(len(table), np.int8))), ["token", "part"])
        sizes = np.diff(np.append(start, len(order)))
        for batch in table.take(pa.array(order[sizes[group] > 1])).to_batches(max_chunksize=20_000):
            yield batch


def _apart(table: pa.Table, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Of pairs of rows, the least distance by the suffix filter over the most allowed; above 1 where a filter stops them."""
    n, pos = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "pos"))
    both = n[x] + n[y]
    need = -(-percent * both // (100 + percent))
    ok = np.flatnonzero((100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (np.minimum(n[x] - pos[x], n[y] - pos[y]) >= need))
    parts = np.frombuffer(b"".join(table.column("data").to_pylist()), np.uint8).reshape(len(table), -1)[:, :RANGES]
    out = np.full(len(x), np.inf)
    for a in range(0, len(ok), 65536):
        i = ok[a : a + 65536]
        far, most = np.abs(parts[x[i]].astype(np.int16) - parts[y[i]]).sum(1), (both - 2 * need)[i]
        out[i] = np.where(far <= most, far / np.maximum(most, 1), np.inf)
    return out


def _gathering(work, names: list[str] | None):
    """Runs work on about BATCH bytes of rows at once; names: only on whole groups of these columns, which come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            own.append(batch)
            held += batch.nbytes
            if held > BATCH:
                whole = pa.Table.from_batches(own).combine_chunks()
                cut = len(whole)
                if names:
                    same = np.ones(cut, bool)
                    for c in names:
                        column = whole.column(c).to_numpy()
                        same &= column == column[-1]
                    cut = int(np.flatnonzero(same)[0])
                if cut:
                    yield from work(whole.slice(0, cut).combine_chunks())
                own = whole.slice(cut).combine_chunks().to_batches()
                held = sum(x.nbytes for x in own) if cut else 0
        if sum(map(len, own)):
            yield from work(pa.Table.from_batches(own).combine_chunks())

    return run


def _near(percent: int):
    """Pairs (x, y) of classes: each with the NEAREST ones, by the suffix filter, of those before it among BLOCK postings
    that follow one another. Postings come in their order; where the rows gathered end, a run of them does too."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        token, cls = table.column("token").to_numpy(), table.column("cls").to_numpy()
        # a class that several tasks posted stands in several rows, one after another
        once = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])))
        table, token = table.take(pa.array(once)).combine_chunks(), token[once]
        place = np.arange(len(token))
        start = np.maximum.accumulate(np.where(np.append(True, token[1:] != token[:-1]), place, 0))
        before = (place - start) % BLOCK
        sums = np.concatenate(([0], np.cumsum(before)))
        row = 0
        while row < len(token):
            top = max(row + 1, int(np.searchsorted(sums, sums[row] + _PAIRS, "right")) - 1)
            y = np.repeat(np.arange(row, top), before[row:top])
            x = T.ranges(np.arange(row, top) - before[row:top], before[row:top])
            row = top
            apart = _apart(table, x, y, percent) if len(x) else np.empty(0)
            ok = np.flatnonzero(apart <= 1)
            x, y, apart = x[ok], y[ok], apart[ok]
            order = np.lexsort((x, apart, y))
            x, y = x[order], y[order]
            first = np.arange(len(y)) - np.searchsorted(y, y) < NEAREST
            yield _pairs(table, x[first], y[first])

    return _gathering(work, None)


def _across(percent: int):
    """Pairs (x, y) of classes of different roots that pass the filters, for postings that come sorted by (token, part).

    In a group the rows stand by root, so that only pairs of different roots are made, a bounded number at a time.
    """

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        order, start, group = _groups(table, ["token", "part", "root"])
        root = table.column("root").to_numpy()[order]
        head = np.ones(len(order), bool)
        head[1:] = (group[1:] != group[:-1]) | (root[1:] != root[:-1])
        own = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))  # where the row's root begins
        before = own - start[group]
        sums = np.concatenate(([0], np.cumsum(before)))
        row = 0
        while row < len(order):
            top = max(row + 1, int(np.searchsorted(sums, sums[row] + _PAIRS, "right")) - 1)
            y = order[np.repeat(np.arange(row, top), before[row:top])]
            x = order[T.ranges(start[group[row:top]], before[row:top])]
            row = top
            ok = _apart(table, x, y, percent) <= 1 if len(x) else np.zeros(0, bool)
            yield _pairs(table, x[ok], y[ok])

    return _gathering(work, ["token", "part"])


def _pairs(table: pa.Table, first: np.ndarray, second: np.ndarray) -> pa.RecordBatch:
    cls = table.column("cls").to_numpy()
    x, y = np.minimum(cls[first], cls[second]), np.maximum(cls[first], cls[second])
    both = np.unique(np.stack((x, y), 1), axis=0) if len(first) else np.empty((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["x", "y"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("sx"), batch.column("sy")):
                a, b = (np.frombuffer(s.as_buffer(), np.uint8).reshape(-1, _BYTES) for s in (a, b))
                wide = np.zeros((len(a) + len(b), 8), np.uint8)
                wide[: len(a), :_BYTES], wide[len(a) :, :_BYTES] = a, b
                merged = np.sort(wide.view("<u8").ravel())
                same = int((merged[1:] == merged[:-1]).sum())
                good.append(100 * same >= percent * (len(merged) - same))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], ["x", "y"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("cls").alias("x"), F.col("hashes").alias("sx"))
    right = sets.select(F.col("cls").alias("y"), F.col("hashes").alias("sy"))
    # a class that several tasks met has as many equal sets, and its links repeat
    return pairs.join(left, "x").join(right, "y").select("x", "y", "sx", "sy").mapInArrow(run, "x long, y long").distinct()


def _sets(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(cls, hashes) of the classes in pairs, and of a few others that a filter of fixed size can't tell from them."""
    slots = 1 << FILTER_BITS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.unique(np.concatenate([_slots(batch.column("cls").to_numpy()) for batch in batches] or [np.empty(0, np.int64)]))
        yield pa.RecordBatch.from_arrays([pa.array(found)], ["slot"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            for chunk in np.unique(slot >> 20):
                own.setdefault(int(chunk), np.zeros(1 << 20, bool))[slot[slot >> 20 == chunk] & ((1 << 20) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([np.packbits(x).tobytes() for x in own.values()], pa.binary())], ["chunk", "bits"])

    marked = pairs.select(F.col("x").alias("cls")).unionAll(pairs.select("y")).mapInArrow(mark, "slot long").groupBy((F.col("slot") / (1 << 20)).cast("long").alias("chunk"), "slot").count()
    bits = np.zeros((slots >> 20, 1 << 17), np.uint8)
    for r in marked.select("chunk", "slot").repartition("chunk").mapInArrow(fill, "chunk long, bits binary").collect():  # 8 MB at any size
        bits[r.chunk] = np.frombuffer(r.bits, np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bits.ravel())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = sent.value, set()
        for batch in batches:
            for _, _, data, offsets in T.slices(batch.column("text")):
                hashes, at = T.shingle_sets(data, offsets, k)
                sizes, classes, _ = set_rows(hashes, at)
                slot = _slots(classes).reshape(2, -1)
                held = (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).all(0) & (sizes > 0)
                rows = [r for r in np.flatnonzero(held).tolist() if not (int(classes[r]) in seen or seen.add(int(classes[r])))]
                low = np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :_BYTES])
                yield pa.RecordBatch.from_arrays([pa.array(classes[rows]), pa.array([low[at[r] : at[r + 1]].tobytes() for r in rows], pa.binary())], ["cls", "hashes"])

    return docs.select("text").mapInArrow(build, "cls long, hashes binary")


def _slots(classes: np.ndarray) -> np.ndarray:
    spread = T.mix(classes.view(np.uint64))
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return np.concatenate((spread & mask, spread >> np.uint64(32) & mask)).astype(np.int64)


def _index(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, postings): (doc_id, n, cls, data, mark) of every row, and (token, cls, n, pos) of shared shingles."""
    described = settle(_describe(docs, k))
    rows = described.where("kind = 0").select(F.col("id").alias("doc_id"), "n", "cls", "data", "mark")
    first = settle(_postings(docs, _sketch(described), k, percent))
    keep = ["token", "cls", "n", "pos"]
    often = first.where("hot").groupBy("token").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select("token", F.lit(True).alias("many"))
    suspects = first.where("hot").join(often, "token", "left")
    # postings of a shingle of very many stay where they are: it is shared
    rest = first.where("not hot").select(keep).unionAll(suspects.where("many is null").select(keep))
    shared = rest.repartition("token").mapInArrow(_shared, "token long, cls long, n int, pos int")
    postings = settle(shared.unionByName(suspects.where("many").select(keep)))
    drop(first)
    return rows, postings


def _candidates(postings: DataFrame, ranges: DataFrame, groups: DataFrame | None, percent: int) -> DataFrame:
    """(x, y) of all candidates of different groups (v, root); without groups, of all."""
    if groups is None:
        rooted = postings.withColumn("root", F.col("cls"))
    else:
        rooted = postings.join(groups.select(F.col("v").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    open_ = rooted.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("m")).where("a < b")
    blocks = F.when(F.col("m") > BLOCK, F.expr(f"cast(ceil(m / {BLOCK}) as int)")).otherwise(1)
    left = rooted.join(open_.select("token", blocks.alias("blocks")), "token")
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("long")
    dealt = left.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    dealt = dealt.withColumn("part", F.greatest("own", "other") * (1 << 31) + F.least("own", "other"))
    dealt = dealt.select("token", "part", "cls", "n", "pos", "root").join(ranges, "cls")
    dealt = dealt.repartition("token", "part").sortWithinPartitions("token", "part")
    return dealt.mapInArrow(_across(percent), "x long, y long").distinct()


def linked_pairs(docs: DataFrame, *, k: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(members, links): (doc_id, n_shingles, cls) of every row, and every link (x, y) between two classes, x < y.

    All candidates are verified, within groups too: in a group of many unlike near copies that is their square.
    """
    narrow(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows, postings = _index(docs, k, percent)
    ranges = rows.where("n > 0").groupBy("cls").agg(F.first("data").alias("data"))
    pairs = settle(_candidates(postings, ranges, None, percent))
    links = _verified(pairs, settle(_sets(docs, pairs, k)), percent)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "cls"), links


def link_groups(docs: DataFrame, *, k: int = SHINGLE, percent: int = PERCENT, marked: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text, ...); marked: and mark, the xxhash64 of its text."""
    narrow(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows, postings = _index(docs, k, percent)
    ranges = rows.where("n > 0").groupBy("cls").agg(F.first("data").alias("data"))

    own = F.substring("data", F.lit(RANGES + 1) + 8 * F.pmod("token", F.lit(MINIMA)).cast("int"), F.lit(8))
    ordered = postings.join(ranges, "cls").withColumn("least", own)
    ordered = ordered.repartitionByRange("token", "least", "n", "cls").sortWithinPartitions("token", "least", "n", "cls")
    pairs = settle(ordered.select("token", "cls", "n", "pos", "data").mapInArrow(_near(percent), "x long, y long").distinct())
    sets = settle(_sets(docs, pairs, k))
    links = settle(_verified(pairs, sets, percent))
    drop(sets)
    groups = connected(links)

    more = settle(_candidates(postings, ranges, groups, percent).join(pairs, ["x", "y"], "left_anti"))
    drop(postings)
    sets = settle(_sets(docs, more, k))
    links = links.unionAll(settle(_verified(more, sets, percent)))
    drop(sets)
    groups = connected(links)

    classes = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least")).join(groups.select(F.col("v").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    names = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.select("cls", "root").join(names, "root").select("cls", "component_id")
    return rows.join(named, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *["mark"] * marked)


def keep_one(docs: DataFrame, *, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id, once where it is repeated; rows without an id or without
    words stay, however often they come."""
    lost = link_groups(docs, k=k, percent=percent, marked=True).where("component_id <> doc_id").select(F.col("doc_id").alias("_lost"), F.col("mark").alias("_mark")).distinct()
    # by the text too: another text under the same id may be the only one of its group
    kept = packed(docs, "doc_id", "text").join(lost, (F.col("doc_id") == F.col("_lost")) & (F.xxhash64("text") == F.col("_mark")), "left_anti")
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").limit(1).count()
    if again:
        alone = F.col("doc_id").isNull() | F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
        kept = kept.withColumns({"_same": F.xxhash64("text"), "_alone": F.when(alone, F.monotonically_increasing_id()).otherwise(-1)}).dropDuplicates(["doc_id", "_same", "_alone"])
    return unpacked(kept, docs.columns, "doc_id", "text")


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return link_groups(read(spark, sf_dir, "documents"))
