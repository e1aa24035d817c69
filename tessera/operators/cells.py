"""Exact volumes of Voronoi cells in a box, a cell a row.

A cell is what lies nearer to its point than to any other: an intersection of half spaces, those of its near neighbours.
Its volume is the recursion over faces: a body's volume is the sum over its faces of the face's own volume times its distance
from the point, by the number of dimensions, and a face is a body of one dimension less. Neighbours come from the exact
nearest-neighbour join, as many as the cell's farthest corner asks for: a point farther away than twice that cuts nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import drop, settle
from .knn import nearest

#: Planes that are added to a body at once, and numbers that are computed at once.
_PLANES, _AT_ONCE = 8, 1 << 20


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Half spaces a x <= b with normals of length one, the tightest of each direction; None where they leave nothing."""
    size = np.linalg.norm(a, axis=1)
    flat = size < 1e-12
    if (b[flat] < -1e-12).any():
        return None
    a, b = a[~flat] / size[~flat, None], b[~flat] / size[~flat]
    order = np.lexsort((b, *np.round(a, 9).T))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (np.round(a[1:], 9) != np.round(a[:-1], 9)).any(1)
    return a[new], b[new]


def volume(a: np.ndarray, b: np.ndarray) -> float:
    """The volume of a bounded body a x <= b."""
    own = _distinct(a, b)
    if own is None:
        return 0.0
    a, b = own
    d = a.shape[1]
    if d == 1:
        return max(0.0, float(b[a[:, 0] > 0].min() + b[a[:, 0] < 0].min()))
    if d == 2:
        # all edges at once: the interval that the other lines leave of each
        along, right = a[:, ::-1] * [-1, 1] @ a.T, b - b[:, None] * (a @ a.T)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = right / along
        last, first = np.where(along > 1e-12, at, np.inf).min(1), np.where(along < -1e-12, at, -np.inf).max(1)
        empty = ((np.abs(along) <= 1e-12) & (right < -1e-12)).any(1)
        return float((b * np.where(empty, 0.0, np.maximum(last - first, 0.0))).sum() / 2)
    total = 0.0
    for i in range(len(a)):
        j = int(np.abs(a[i]).argmax())
        others = np.arange(len(a)) != i
        share = a[others, j] / a[i, j]
        face = np.delete(a[others] - share[:, None] * a[i], j, 1)
        total += b[i] / abs(a[i, j]) * volume(face, b[others] - share * b[i])
    return total / d


def corners(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The corners of a body a x <= b of few dimensions: where as many planes meet as there are, within all others."""
    d = a.shape[1]
    all_sets, ends = combinations(range(len(a)), d), [np.empty((0, d))]
    while sets := list(islice(all_sets, max(1, _AT_ONCE // len(a)))):
        sets = np.array(sets)
        sets = sets[np.abs(np.linalg.det(a[sets])) > 1e-12]
        found = np.linalg.solve(a[sets], b[sets][:, :, None])[:, :, 0]
        ends.append(found[(found @ a.T <= b + 1e-9 * (1 + np.abs(b))).all(1)])
    return np.concatenate(ends)


def cell(point: np.ndarray, others: np.ndarray, low: np.ndarray, high: np.ndarray, known: float = np.inf) -> tuple[float, float]:
    """(volume, distance of the farthest corner) of a point's cell in the box, about the point; without the volume (NaN) where
    others farther than `known`, which are not given, may cut it."""
    d = len(point)
    steps = others - point
    a = np.concatenate((np.eye(d), -np.eye(d), steps))
    b = np.concatenate((high - point, point - low, (steps**2).sum(1) / 2))
    own = _distinct(a, b)
    if own is None or not (own[1] > -np.inf).all():
        return 0.0, 0.0
    # from the box and the nearest planes on, those that cut a corner join and those that touch none leave
    a, b = own
    slack = 1e-9 * (1 + np.abs(b))
    order = np.argsort(b, kind="stable")
    needed = np.abs(a).max(1) > 1 - 1e-9
    needed[order[:_PLANES]] = True
    while True:
        ends = corners(a[needed], b[needed])
        if not len(ends):
            return 0.0, 0.0
        reach = np.max([(part @ a.T).max(0) for part in np.array_split(ends, -(-len(ends) * len(a) // _AT_ONCE))], axis=0)
        needed &= reach >= b - slack  # what touches no corner cuts nothing
        cut = order[(reach > b + slack)[order] & ~needed[order]]
        if not len(cut):
            break
        needed[cut[:_PLANES]] = True
    far = float(np.linalg.norm(ends, axis=1).max())
    return volume(a[needed], b[needed]) if known >= 2 * far else float("nan"), far


def voronoi_cells(points: DataFrame, key: str, axes: list[str], low: list[float], high: list[float], *, neighbours: int = 24) -> DataFrame:
    """(key, weight): the share of the box [low, high] that each point's cell has; points at one place share theirs alike.

    Up to four axes. Points with a null, or outside of the box, may have parts of it too, as far as they are nearest; rows
    without a key or with a coordinate that is null or not finite take no part.
    """
    if not 1 <= len(axes) <= 4:
        raise ValueError("cells have one to four dimensions")
    ends = np.array(low, float), np.array(high, float)
    whole = float(np.prod(ends[1] - ends[0]))
    place = F.array(*[F.col(a).cast("double") + 0.0 for a in axes])
    rows = points.select(F.col(key).alias("_k"), place.alias("v")).where(F.col("_k").isNotNull() & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    rows = settle(rows)
    places = settle(rows.groupBy("v").agg(F.min("_k").alias("_p"), F.count("*").alias("_n")))
    total = places.count()
    numbered = settle(places.select(F.monotonically_increasing_id().alias("_i"), "v", "_n"))
    drop(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(len(batch)):
                r = batch.slice(i, 1)
                point, others = r.column("v").flatten().to_numpy(), r.column("_near").flatten().to_numpy().reshape(-1, len(axes))
                whole_set = len(others) >= r.column("_all")[0].as_py()
                known = np.inf if whole_set else np.linalg.norm(others - point, axis=1).max(initial=0.0)
                size, far = cell(point, others, *ends, known)
                out.append((size, known >= 2 * far))
            yield pa.RecordBatch.from_arrays([batch.column("_i"), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.bool_())], ["_i", "size", "exact"])

    done, k = None, min(neighbours, max(total - 1, 1))
    left = numbered
    while True:
        near = nearest(numbered, "_i", "v", k, of=None if left is numbered else left.select("_i"))
        at = near.join(numbered.select(F.col("_i").alias("other"), F.col("v").alias("_o")), "other").groupBy("_i").agg(F.collect_list("_o").alias("_near"))  # k each
        cells = left.join(at, "_i", "left").select("_i", "v", F.coalesce(F.flatten("_near"), F.array().cast("array<double>")).alias("_near"), F.lit(total - 1).alias("_all"))
        found = settle(cells.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "_i long, size double, exact boolean"))
        own = found.where("exact").select("_i", "size")
        done = own if done is None else done.unionByName(own)
        more = found.where("not exact").select("_i")
        if k >= total - 1 or not more.limit(1).count():
            break
        left = settle(numbered.join(more, "_i", "left_semi"))
        k = min(2 * k, total - 1)
    of = rows.join(numbered, "v").join(done, "_i")
    return of.select(F.col("_k").alias(key), (F.col("size") / F.col("_n") / whole).alias("weight"))
