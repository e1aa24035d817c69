"""Exact nearest-neighbour join over pivots.

Every vector goes to the cell of its nearest pivot. A query first meets its own cell, which bounds the distance of its
k-th neighbour; the triangle inequality then names the other cells that may hold a nearer one. Cells lie in shards of
SHARD_BYTES, and a query is copied once to each shard that has such a cell, however many of them it has: where bounds
exclude little, as between vectors without structure, copies grow with the shards and not with the cells. Within a cell,
candidates whose distance to the pivot differs from the query's by more than the bound are passed over; the rest are
screened by products, and those within the bound measured by differences. Pivots and shards change the work and never the
result.

Equal vectors are one query, and only the k + 1 smallest keys of them are candidates: no more can be among anyone's
nearest, so a vector that a third of all rows share costs no more than any other. What is broadcast is the pivots with
their cells' radii, PIVOT_BYTES at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import drop, settle

#: Bytes of pivots, which every task holds.
PIVOT_BYTES = 4 << 20
#: Rows of a block of queries or candidates.
BLOCK = 2048
#: Bytes of the candidates' vectors in a shard, and twice those of the queries that meet one in a group.
SHARD_BYTES = 32 << 20
#: Numbers that a task computes at once.
_AT_ONCE = 1 << 21
_PACKED = "cell int, b int, ids binary, near binary, bound binary, v binary"
_SLACK = 1 + 1e-9  # bounds and distances are rounded differently


def _pivots(rows: DataFrame, n: int, size: int) -> np.ndarray:
    """About the square root of n of the vectors, by the order of their hashed keys, as far as PIVOT_BYTES hold."""
    count = int(max(1, min(np.sqrt(n), PIVOT_BYTES // (8 * size))))
    share = min(1.0, 4 * count / n)
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    found = some.select("v").limit(count).collect()
    return np.unique(np.array([r.v for r in found] or [r.v for r in rows.select("v").limit(1).collect()], float), axis=0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances (rows of a, rows of b), by differences, a bounded part at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, _AT_ONCE // max(b.size, 1))
    for i in range(0, len(a), step):
        out[i : i + step] = ((a[i : i + step, None] - b) ** 2).sum(2)
    return out


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _packed(v: np.ndarray) -> bytes:
    """A block's vectors, in single precision where that holds them."""
    with np.errstate(over="ignore"):
        short = v.astype(np.float32)
    return np.ascontiguousarray(short if (short == v).all() else v).tobytes()


def _unpacked(v: bytes, n: int, size: int) -> np.ndarray:
    return np.frombuffer(v, np.float32 if len(v) == 4 * n * size else float).astype(float).reshape(n, size)


def _celled(rows: DataFrame, pivots: np.ndarray, size: int) -> DataFrame:
    """(id, v, cell, near): each row's nearest pivot and its distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                d = _distances(_vectors(part.column("v"), size), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array(cell.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(d)), cell]))], ["id", "v", "cell", "near"])

    return rows.select("id", "v").mapInArrow(run, "id long, v array<double>, cell int, near double")


def _blocks(rows: DataFrame, parts: DataFrame, size: int) -> DataFrame:
    """Rows (id, v, cell, near, bound) as blocks of about BLOCK rows of one cell, by distance from the pivot.

    parts: (cell, n). A cell's rows are cut by hash before they meet, so that no task holds a whole cell."""

    def pack(key: tuple, found: pa.Table) -> pa.Table:
        found = found.combine_chunks()
        order = np.argsort(found.column("near").to_numpy(), kind="stable")
        values = {n: [found.column(c).to_numpy()[order].tobytes()] for n, c in (("ids", "id"), ("near", "near"), ("bound", "bound"))}
        return pa.table({"cell": found.column("cell").slice(0, 1), "b": pa.array([key[1].as_py()], pa.int32()), **values, "v": [_packed(_vectors(found.column("v").chunk(0), size)[order])]})

    dealt = rows.join(parts, "cell").withColumn("_b", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)))
    return dealt.groupBy("cell", "_b").applyInArrow(pack, _PACKED)


def _met(queries: DataFrame, candidates: DataFrame, k: int, size: int) -> DataFrame:
    """(id, other, distance2): of each pair of blocks of a cell, each query's k nearest within its bound."""

    def unpack(row: dict, side: str):
        ids, near, bound = (np.frombuffer(row[side + c], t) for c, t in (("ids", np.int64), ("near", float), ("bound", float)))
        return ids, near, bound, _unpacked(row[side + "v"], len(ids), size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q_near, bound, q = unpack(row, "q_")
                ids, near, _, x = unpack(row, "c_")
                step = max(1, _AT_ONCE // max(len(ids) * size, 1))
                for at in range(0, len(q_ids), step):
                    own = slice(at, at + step)
                    reach = bound[own] * _SLACK + 1e-12
                    first = int(np.searchsorted(near, (q_near[own] - reach).min(), "left"))
                    last = int(np.searchsorted(near, (q_near[own] + reach).max(), "right"))
                    if first == last:
                        continue
                    d = ((q[own, None] - x[first:last]) ** 2).sum(2)
                    names = np.broadcast_to(ids[first:last], d.shape)
                    top = np.lexsort((names, d))[:, :k]
                    d, names = np.take_along_axis(d, top, 1), np.take_along_axis(names, top, 1)
                    real = d <= (reach * reach)[:, None]
                    who = np.nonzero(real)[0]
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[own][who]), pa.array(names[real]), pa.array(d[real])], ["id", "other", "distance2"])

    side = lambda t, p: t.select("cell", *(F.col(c).alias(p + c) for c in ("ids", "near", "bound", "v")))
    return side(queries, "q_").join(side(candidates, "c_"), "cell").mapInArrow(run, "id long, other long, distance2 double")


def _kept(who: np.ndarray, names: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least of each `who`, by (who, distance, name)."""
    order = np.lexsort((names, d, who))
    own = who[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    return order[np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)])) < k]


def _nearer(q: np.ndarray, reach: np.ndarray, own: int, blocks: list[tuple], pivots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in q, other, distance2): of queries of the cell `own`, the k nearest within reach among blocks (cell, ids, near, v)
    of other cells. What is found narrows the reach."""
    size = q.shape[1]
    cells = np.unique([b[0] for b in blocks])
    away = dict(zip(cells.tolist(), np.sqrt(_distances(q, pivots[cells])).T))
    near_own = np.sqrt(((q - pivots[own]) ** 2).sum(1))
    reach = reach.copy()
    who, names, dist = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for cell, ids, near, x in blocks:
        if cell == own:
            continue
        d = away[cell]
        apart = np.sqrt(((pivots[cell] - pivots[own]) ** 2).sum())
        may = np.flatnonzero((d - near[-1] <= reach) & (near[0] - d <= reach) & ((d * d - near_own * near_own) / (2 * apart) * (1 - 1e-9) <= reach))
        step = max(1, _AT_ONCE // max(len(ids), 1))
        for at in range(0, len(may), step):
            some = may[at : at + step]
            first = int(np.searchsorted(near, (d[some] - reach[some]).min(), "left"))
            last = int(np.searchsorted(near, (d[some] + reach[some]).max(), "right"))
            if first == last:
                continue
            # about the pivot, products lose least; what they lose is granted, and the rest measured by differences
            a, b = q[some] - pivots[cell], x[first:last] - pivots[cell]
            a2, b2 = (a * a).sum(1), (b * b).sum(1)
            granted = 8 * (size + 4) * np.finfo(float).eps * (a2.max() + b2.max())
            close = a @ b.T
            close *= -2
            close += b2
            row, place = np.nonzero(~(close > (reach[some] ** 2 - a2 + granted)[:, None]))
            for i in range(0, len(row), max(1, _AT_ONCE // size)):
                r, p = some[row[i : i + max(1, _AT_ONCE // size)]], first + place[i : i + max(1, _AT_ONCE // size)]
                exact = ((q[r] - x[p]) ** 2).sum(1)
                real = exact <= reach[r] ** 2
                who, names, dist = np.r_[who, r[real]], np.r_[names, ids[p[real]]], np.r_[dist, exact[real]]
            if len(who) > 4 * k * len(q):
                top = _kept(who, names, dist, k)
                who, names, dist = who[top], names[top], dist[top]
                full = np.flatnonzero(np.bincount(who, minlength=len(q)) >= k)
                last_of = np.searchsorted(who, full, "right") - 1
                reach[full] = np.minimum(reach[full], np.sqrt(dist[last_of]) * _SLACK + 1e-12)
    top = _kept(who, names, dist, k) if len(who) else slice(0)
    return who[top], names[top], dist[top]


def _tiles(queries: DataFrame, candidates: DataFrame, shape: list, pivots: np.ndarray, size: int) -> tuple[DataFrame, DataFrame]:
    """(g, cell, ids, bound, v) of queries and (g, cell, ids, near, v) of candidates that meet in the groups g.

    queries, candidates: blocks; shape: rows (cell, n, least, most), one a pivot. A group is a tile of queries and a shard, each
    of a bounded size: queries go to the shards with cells that they may need, candidates to all tiles."""
    # cells near each other follow one another
    known = sorted(shape, key=lambda r: r.cell)
    cells = np.array([r.cell for r in known])
    total = sum(r.n for r in known)
    rows = max(1, SHARD_BYTES // (8 * size))
    lead = pivots[: max(1, -(-total // rows))]
    order = np.lexsort((cells, _distances(pivots[cells], lead).argmin(1)))
    n = np.array([known[i].n for i in order], np.int64)
    parts = -(-n // BLOCK)
    start = np.cumsum(n) - n
    tiles = max(2 * queries.sparkSession.sparkContext.defaultParallelism, -(-2 * total // rows))
    place = {int(cells[i]): (int(at), int(m), int(p)) for i, at, m, p in zip(order, start, n, parts)}
    reached = {c: (at // rows, (at * p + m * (p - 1)) // (p * rows)) for c, (at, m, p) in place.items()}
    shards = 1 + max(last for _, last in reached.values())
    least, most = (np.full(len(pivots), x) for x in (np.inf, -np.inf))
    for r in known:
        least[r.cell], most[r.cell] = r.least, r.most

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                ids, near, bound = (np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("near", float), ("bound", float)))
                v, own = _unpacked(row["v"], len(ids), size), row["cell"]
                first, m, p = place[own]
                tile = (first * p + m * row["b"]) * tiles // (p * total)
                apart = np.sqrt(((pivots - pivots[own]) ** 2).sum(1))
                hit = np.zeros((shards, len(ids)), bool)
                for some in range(0, len(ids), 256):
                    part = slice(some, some + 256)
                    d = np.sqrt(_distances(v[part], pivots))
                    limit = (bound[part] * _SLACK + 1e-12)[:, None]
                    # no nearer than the cell's ring, nor than the plane between both pivots
                    with np.errstate(divide="ignore", invalid="ignore"):
                        plane = np.nan_to_num((d * d - (near[part] ** 2)[:, None]) / (2 * apart), nan=0.0, posinf=0.0, neginf=0.0)
                    may = (d - most <= limit) & (least - d <= limit) & (plane * (1 - 1e-9) <= limit) & np.isfinite(least)
                    may[:, own] = False
                    for c in np.flatnonzero(may.any(0)):
                        one, other = reached[int(c)]
                        hit[one : other + 1, part] |= may[:, c]
                for s in np.flatnonzero(hit.any(1)):
                    to = hit[s]
                    yield pa.RecordBatch.from_pylist([{"g": int(s) * tiles + tile, "cell": own, "ids": ids[to].tobytes(), "bound": bound[to].tobytes(), "v": _packed(v[to])}], kind)

    kind = pa.schema([("g", pa.int32()), ("cell", pa.int32()), ("ids", pa.binary()), ("bound", pa.binary()), ("v", pa.binary())])

    spark = queries.sparkSession
    at = F.broadcast(spark.createDataFrame([(c, *p) for c, p in place.items()], "cell int, _at long, _n long, _p long"))
    shard = F.expr(f"cast((_at * _p + _n * b) div (_p * {rows}) as int)")
    groups = 2 * shards * tiles
    left = queries.mapInArrow(dealt, "g int, cell int, ids binary, bound binary, v binary").repartition(groups, "g")
    right = candidates.join(at, "cell").select(F.explode(F.sequence(shard * tiles, shard * tiles + tiles - 1)).alias("g"), "cell", "ids", "near", "v").repartition(groups, "g")
    return left, right


def _further(left: DataFrame, right: DataFrame, pivots: np.ndarray, k: int, size: int) -> DataFrame:
    """(id, other, distance2): of the groups of _tiles(), each query's k nearest within its bound in other cells than its own."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks = []
        for row in right.to_pylist() if len(left) else ():
            ids = np.frombuffer(row["ids"], np.int64)
            blocks.append((row["cell"], ids, np.frombuffer(row["near"], float), _unpacked(row["v"], len(ids), size)))
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for row in left.to_pylist() if blocks else ():
            ids, bound = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["bound"], float)
            v, step = _unpacked(row["v"], len(ids), size), max(1, _AT_ONCE // (4 * k))
            for some in (slice(at, at + step) for at in range(0, len(ids), step)):
                who, names, d = _nearer(v[some], bound[some] * _SLACK + 1e-12, row["cell"], blocks, pivots, k)
                out.append((ids[some][who], names, d))
        return pa.table(dict(zip(("id", "other", "distance2"), (np.concatenate(x) for x in zip(*out)))))

    return left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(meet, "id long, other long, distance2 double")


def _least(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy("distance2", "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(points: DataFrame, key: str, column: str, k: int, *, of: DataFrame | None = None) -> DataFrame:
    """(key, rank, other, distance2): each row's k nearest other rows by squared Euclidean distance, ties to the smaller key.

    Rows whose key or vector is null, whose vector has an element that is null or not finite, or another length than the
    longest take no part. Keys are distinct; with fewer than k others, a row has all of them. With `of`, only the rows whose
    key it holds are asked for, among all.
    """
    spark = points.sparkSession
    rows = points.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    # 0.0 and -0.0 are one value, as their distance is
    rows = rows.where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))).withColumn("v", F.transform("v", lambda e: e + 0.0))
    size = rows.agg(F.max(F.size("v"))).first()[0]
    if size is None:
        return spark.createDataFrame([], f"{key} long, rank int, other long, distance2 double")
    rows = settle(rows.where(F.size("v") == size))
    # equal vectors: one query, and as candidates the k + 1 smallest keys
    same = Window.partitionBy("v").orderBy("id")
    held = settle(rows.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1))
    pivots = _pivots(held.where("_n = 1"), max(held.where("_n = 1").count(), 1), size)
    cells = settle(_celled(held, pivots, size).join(held.select("id", "_n"), "id"))
    shape = settle(cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("least"), F.max("near").alias("most")))
    candidates = settle(_blocks(cells.withColumn("bound", F.lit(0.0)), shape.select("cell", "n"), size))
    queries = cells.where("_n = 1").drop("_n")
    asking = rows if of is None else rows.join(of.select(F.col(key).cast("long").alias("id")), "id", "left_semi")
    if of is not None:
        queries = queries.join(asking.select("v").distinct(), "v", "left_semi").select(*queries.columns)
    parts = shape.select("cell", "n")
    own = settle(_least(_met(_blocks(queries.withColumn("bound", F.lit(float("inf"))), parts, size), candidates, k + 1, size), k + 1))
    bound = own.where(F.col("rank") == k + 1).select("id", F.sqrt("distance2").alias("bound"))
    limited = queries.join(bound, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    asked = settle(_blocks(limited.select("id", "v", "cell", "near", "bound"), parts, size))
    further = _further(*_tiles(asked, candidates, shape.collect(), pivots, size), pivots, k + 1, size)  # one row of shape a pivot
    lists = _least(own.drop("rank").unionByName(further), k + 1).select("id", "other", "distance2")
    lists = settle(lists.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("distance2", "other"))).alias("_all")))  # k + 1 each
    # every row takes its vector's list without itself
    named = asking.join(held.where("_n = 1").select("v", F.col("id").alias("_q")), "v").select(F.col("id").alias(key), "_q")
    mine = named.join(lists.withColumnRenamed("id", "_q"), "_q")
    others = F.slice(F.filter("_all", lambda e: e["other"] != F.col(key)), 1, k)
    out = settle(mine.select(key, F.posexplode(others).alias("_at", "_e")).select(key, (F.col("_at") + 1).alias("rank"), F.col("_e.other").alias("other"), F.col("_e.distance2").alias("distance2")))
    drop(rows, held, cells, shape, candidates, own, asked, lists)
    return out
