"""Seeded flooding of whole volumes, tile by tile, with the result of one priority queue over all voxels.

The queue takes the brightest waiting voxel first (of equal ones, the first in C order). Its order needs no queue to be
known: a voxel's arrival is the falling list of bottlenecks on its way from the seeds, that is the arrival of the
earliest labelled neighbour, cut behind the last bottleneck that is darker than the voxel, and the voxel itself. Lists are
compared element by element. A tile can therefore be flooded on its own from the arrivals and labels of the layer
around it. Tiles exchange their borders, and those whose surroundings changed flood anew, until none does: each round
settles at least the earliest arrivals that were still open, and what is settled stays. A label that nothing but a
neighbour's own label supports would wander between tiles for good; its way meets its darkest voxel twice, and ends there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import drop, settle
from .voxel import AXES, Shape

_STEPS = [s for s in np.ndindex(3, 3, 3) if s != (1, 1, 1)]
_TILE = ["vol_id", "t0", "t1", "t2"]


def flood_tile(val: np.ndarray, seeds: np.ndarray, numbers: np.ndarray, known: dict[int, tuple[int, tuple]], *, conflict: int = -1) -> tuple[np.ndarray, dict[int, tuple]]:
    """(labels, arrivals by place) of a block whose outer two layers are not its own: the inner one is the surroundings,
    the outer one is empty.

    val is NaN where no voxel may be labelled, numbers is each voxel's place in the order of equal values, and known has
    (label, arrival) of places in the surroundings; places are those of the raveled block.
    """
    own = np.zeros(val.shape, bool)
    own[2:-2, 2:-2, 2:-2] = True
    steps = [int(np.ravel_multi_index(s, val.shape)) - int(np.ravel_multi_index((1, 1, 1), val.shape)) for s in _STEPS]
    waits = (own & np.isfinite(val) & (seeds <= 0)).ravel().tolist()
    labels = np.where(own, np.maximum(seeds, 0), 0).ravel().tolist()
    ranks = list(zip((-val).ravel().tolist(), numbers.ravel().tolist()))
    arrivals: dict[int, tuple] = {}
    queue = [(arrival, place, label) for place, (label, arrival) in known.items()]
    heapq.heapify(queue)

    def spread(place: int, arrival: tuple) -> None:
        for s in steps:
            p = place + s
            if waits[p]:
                n = len(arrival)
                while n and arrival[n - 1] < ranks[p]:
                    n -= 1
                if n and arrival[n - 1] == ranks[p]:
                    continue  # this way has been here before: two tiles that only have the label from each other
                waits[p] = False
                heapq.heappush(queue, ((*arrival[:n], ranks[p]), p, 0))

    for place in np.flatnonzero(labels).tolist():
        arrivals[place] = ()
        spread(place, ())
    while queue:
        arrival, place, label = heapq.heappop(queue)
        if not label:
            arrivals[place] = arrival
            near = {labels[place + s] for s in steps if labels[place + s] > 0}
            label = near.pop() if len(near) == 1 else conflict
        labels[place] = label
        if label > 0:
            spread(place, arrival)
    return np.array(labels).reshape(val.shape), arrivals


def _packed(voxels: DataFrame, tile: int) -> DataFrame:
    """(vol_id, t0, t1, t2, val, seed): a row a tile, with its values (NaN where there is no voxel) and seeds."""
    kind = voxels.schema["vol_id"].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        at = tuple(table.column(a).to_numpy().astype(np.int64) % tile for a in AXES)
        val, seed = np.full((tile,) * 3, np.nan), np.zeros((tile,) * 3, np.int64)
        val[at] = table.column("val").fill_null(float("nan")).to_numpy()
        seed[at] = table.column("seed").fill_null(0).to_numpy()
        return table.select(_TILE).slice(0, 1).append_column("val", pa.array([val.tobytes()])).append_column("seed", pa.array([seed.tobytes()]))

    dealt = voxels.select("vol_id", *AXES, F.col("val").cast("double"), F.col("seed").cast("long"), *(F.floor(F.col(a) / tile).cast("int").alias(f"t{k}") for k, a in enumerate(AXES)))
    return dealt.groupBy(*_TILE).applyInArrow(pack, f"vol_id {kind}, t0 int, t1 int, t2 int, val binary, seed binary")


def _flooded(row: dict, shape: Shape, tile: int, conflict: int) -> tuple[np.ndarray, dict, np.ndarray]:
    """(labels, arrivals, numbers) of a tile's padded block, under what its neighbours sent."""
    t = [row[f"t{k}"] for k in range(3)]
    side = tile + 4
    val, seed = np.full((side,) * 3, np.nan), np.zeros((side,) * 3, np.int64)
    val[2:-2, 2:-2, 2:-2] = np.frombuffer(row["val"]).reshape((tile,) * 3)
    seed[2:-2, 2:-2, 2:-2] = np.frombuffer(row["seed"], np.int64).reshape((tile,) * 3)
    x, y, z = (np.arange(side) + i * tile - 2 for i in t)
    numbers = (x[:, None, None] * shape[1] + y[None, :, None]) * shape[2] + z[None, None, :]
    known = {}
    for sent in row["sent"] or ():
        for number, label, arrival in zip(sent["numbers"], sent["labels"], sent["arrivals"]):
            at = np.array([number // (shape[1] * shape[2]), number // shape[2] % shape[1], number % shape[2]]) - np.array(t) * tile + 2
            known[int(np.ravel_multi_index(at, val.shape))] = label, tuple(zip(arrival[::2], map(int, arrival[1::2])))
    labels, arrivals = flood_tile(val, seed, numbers, known, conflict=conflict)
    return labels, arrivals, numbers


def _borders(rows: DataFrame, shape: Shape, tile: int, conflict: int) -> DataFrame:
    """What each tile sends to each of its 26 neighbours: (vol_id, t0, t1, t2 of the receiver, f0, f1, f2 of the sender,
    numbers, labels, arrivals) of the labelled voxels that touch it."""
    kind = rows.schema["vol_id"].dataType.simpleString()
    counts = [-(-n // tile) for n in shape]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                labels, arrivals, numbers = _flooded(row, shape, tile, conflict)
                out = []
                for step in _STEPS:
                    to = [row[f"t{k}"] + step[k] - 1 for k in range(3)]
                    if any(not 0 <= a < n for a, n in zip(to, counts)):
                        continue
                    layer = tuple({0: slice(2, 3), 1: slice(2, -2), 2: slice(-3, -2)}[s] for s in step)
                    places = np.arange(labels.size).reshape(labels.shape)[layer].ravel()
                    places = [p for p in places[labels.ravel()[places] != 0].tolist()]
                    flat, names = labels.ravel(), numbers.ravel()
                    out.append((*to, [int(names[p]) for p in places], [int(flat[p]) for p in places], [[float(x) for pair in arrivals[p] for x in pair] for p in places]))
                columns = list(zip(*out)) if out else [[]] * 6
                types = [pa.int32()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.list_(pa.float64()))]
                same = [pa.array([row[c]] * len(out), batch.schema.field(c).type) for c in _TILE]
                yield pa.RecordBatch.from_arrays([same[0], *(pa.array(c, k) for c, k in zip(columns[:3], types)), *same[1:], *(pa.array(c, k) for c, k in zip(columns[3:], types[3:]))], [*_TILE, "f0", "f1", "f2", "numbers", "labels", "arrivals"])

    return rows.mapInArrow(run, f"vol_id {kind}, t0 int, t1 int, t2 int, f0 int, f1 int, f2 int, numbers array<long>, labels array<long>, arrivals array<array<double>>")


def _with_borders(tiles: DataFrame, borders: DataFrame, how: str) -> DataFrame:
    sent = borders.where(F.size("numbers") > 0).groupBy(*_TILE).agg(F.collect_list(F.struct("numbers", "labels", "arrivals")).alias("sent"))  # 26 at most
    return tiles.join(sent, _TILE, how)


def watershed(voxels: DataFrame, shape: Shape, *, tile: int = 32, conflict: int = -1) -> DataFrame:
    """(vol_id, x, y, z, label) of the labelled voxels of (vol_id, x, y, z, val, seed), grown over 26 neighbours.

    Seeds are voxels with a positive seed. A voxel that two labels reach at once is a conflict, labelled so, and grows no
    further; voxels that no label reaches, or whose value is null or not finite, have no row.
    """
    tiles = settle(_packed(voxels, tile))
    none = F.lit(None).cast("array<struct<numbers:array<bigint>,labels:array<bigint>,arrivals:array<array<double>>>>")
    borders = settle(_borders(tiles.withColumn("sent", none), shape, tile, conflict))
    changed = settle(borders.where(F.size("numbers") > 0).select(*_TILE).distinct())
    way = [*_TILE, "f0", "f1", "f2"]
    while changed.limit(1).count():
        again = tiles.join(changed, _TILE, "left_semi")
        new = settle(_borders(_with_borders(again, borders, "left"), shape, tile, conflict))
        old = borders.select(*way, *(F.col(c).alias(f"_{c}") for c in ("numbers", "labels", "arrivals")))
        same = F.lit(True)
        for c in ("numbers", "labels", "arrivals"):
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        following = settle(new.join(old, way).where(~same).select(*_TILE).distinct())
        both = settle(borders.join(new.select(*way), way, "left_anti").unionByName(new))
        drop(borders, new, changed)
        borders, changed = both, following
    kind = voxels.schema["vol_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                labels = _flooded(row, shape, tile, conflict)[0][2:-2, 2:-2, 2:-2]
                at = np.nonzero(labels)
                columns = [pa.array((p + row[f"t{k}"] * tile).astype(np.int32)) for k, p in enumerate(at)]
                yield pa.RecordBatch.from_arrays([pa.array([row["vol_id"]] * len(at[0]), batch.schema.field("vol_id").type), *columns, pa.array(labels[at])], ["vol_id", *AXES, "label"])

    return _with_borders(tiles, borders, "left").mapInArrow(run, f"vol_id {kind}, x int, y int, z int, label long")
