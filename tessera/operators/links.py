"""Filament links: each point's best one ahead among all within reach, from packs of points that lie together.

Points of a cell stand in packs with their box and greatest corr, and know their best within a window of packs from the
start. A pack goes only to the cells around its own, and meets only packs that could still hold a better one: neither
pairs nor copies of single points are ever shuffled, and the denser the points, the nearer a search ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import settle

AXES = ("x", "y", "z")
#: Points of a pack, and of a window whose points meet at once.
_PACK, _WINDOW = 512, 4096


class _Similarity:
    """The similarity of pairs of points (rows of x, y, z, ux, uy, uz, corr), and what bounds it from above."""

    def __init__(self, reach: float, cone: float, sigmas: tuple[float, float, float], least: float):
        self.reach, self.cone, self.sigmas, self.least = reach, cone, sigmas, least
        a, b = 1 / sigmas[0] ** 2, 1 / sigmas[1] ** 2
        # whatever gamma is, the two Gaussians of both angles are at most exp(-bend * beta^2)
        self.bend = 4 * a * b / (a + b) if a > b else a + b

    def floor(self, best: np.ndarray) -> np.ndarray:
        """The logarithm below which nothing can be a point's best; NaN counts as the greatest."""
        best = np.where(np.isnan(best), np.inf, np.maximum(best, self.least))
        return np.log(np.maximum(best - 2e-9, 1e-300)) if self.least > 0 else np.full(len(best), -np.inf)

    def top(self, corr: np.ndarray) -> np.ndarray:
        """The logarithm that no similarity to points of that corr exceeds."""
        if not self.least > 0:
            return np.full(len(corr), np.inf)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(np.isnan(corr), np.inf, np.log(np.maximum(corr, 0)))

    def _near(self, p: np.ndarray, o: np.ndarray) -> np.ndarray:
        """Squared distances of p's points from o's box, a little less."""
        gap = np.maximum(np.maximum(o[:, :3].min(0) - p[:, :3], p[:, :3] - o[:, :3].max(0)), 0)
        return (gap * gap).sum(1) * (1 - 1e-9)

    def best(self, ids: np.ndarray, p: np.ndarray, best: np.ndarray, other_ids: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of p, similarity, id): of each of p's rows, the best of o that may exceed best; ties to the smaller id."""
        rows, floor = np.arange(len(p)), self.floor(best)
        with np.errstate(all="ignore"):
            # first each point against the others' box: few are left to meet one by one
            for _ in range(2):
                if not len(p) or not len(o):
                    break
                near = self._near(o, p)
                far = (near <= self.reach**2) & (self.top(o[:, 6]) - near / self.sigmas[2] ** 2 >= floor.min() - 1e-9)
                other_ids, o = other_ids[far], o[far]
                if not len(o):
                    break
                near = self._near(p, o)
                far = (near <= self.reach**2) & (self.top(o[:, 6]).max() - near / self.sigmas[2] ** 2 >= floor - 1e-9)
                rows, ids, p, floor = rows[far], ids[far], p[far], floor[far]
            if not len(p) or not len(o):
                return rows[:0], np.empty(0), other_ids[:0]
            step = [o[None, :, i] - p[:, i, None] for i in range(3)]
            square = step[0] * step[0] + step[1] * step[1] + step[2] * step[2]
            bound = self.top(o[:, 6]) - square / self.sigmas[2] ** 2
            size = np.sqrt(p[:, 3] * p[:, 3] + p[:, 4] * p[:, 4] + p[:, 5] * p[:, 5])
            way = p[:, 3:6] / size[:, None]
            cosine = (step[0] * way[:, 0, None] + step[1] * way[:, 1, None] + step[2] * way[:, 2, None]) / np.sqrt(square)
            # beta^2 is 2 (1 - cos beta) at least; where there is no angle it is 0
            bound -= np.nan_to_num(np.maximum(2 * self.bend * (1 - cosine), 0), nan=0.0)
            may = (square <= self.reach**2) & (bound >= floor[:, None] - 1e-9) & ~(cosine < np.cos(min(self.cone, np.pi)) - 1e-9)
            i, j = np.nonzero(may)
            other = ids[i] != other_ids[j]
            i, j = i[other], j[other]
            way = [o[j, k] - p[i, k] for k in range(3)]
            length = np.sqrt(way[0] * way[0] + way[1] * way[1] + way[2] * way[2])

            def angle(u: np.ndarray) -> np.ndarray:
                size = np.sqrt(u[:, 0] * u[:, 0] + u[:, 1] * u[:, 1] + u[:, 2] * u[:, 2])
                cosine = (way[0] * u[:, 0] + way[1] * u[:, 1] + way[2] * u[:, 2]) / (length * size)
                return np.arccos(np.where(np.isnan(cosine), 1.0, np.clip(cosine, -1, 1)))

            beta, gamma = angle(p[i, 3:6]), angle(o[j, 3:6])
            bell = lambda v, s: np.exp(-(v * v) / (s * s))
            value = o[j, 6] * bell(beta - gamma, self.sigmas[0]) * bell(beta + gamma, self.sigmas[1]) * bell(length, self.sigmas[2])
            value = np.where(np.abs(value) < 4e6, np.round(value, 9), value)
            keep = (beta <= self.cone) & ((value > self.least) | np.isnan(value))
            i, value, name = i[keep], value[keep], other_ids[j[keep]]
        order = np.lexsort((-name, value, i))  # NaN comes last
        last = order[np.flatnonzero(np.append(i[order][1:] != i[order][:-1], True))] if len(i) else order
        return rows[i[last]], value[last], name[last]


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *(r.size for r in rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([r.ravel() for r in rows]), kind))


def filament_links(points: DataFrame, *, reach: float, cone: float, sigmas: tuple[float, float, float], least: float) -> DataFrame:
    """See pairs.filament_links."""
    from .pairs import _finite

    known = _Similarity(reach, cone, sigmas, least)
    kind = points.schema["id"].dataType.simpleString()
    width = reach * (1 + 1e-9)
    cells = [f"_c{a}" for a in AXES]
    number = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in ("ux", "uy", "uz")]
    rows = points.where(_finite(list(AXES)) & F.col("id").isNotNull()).select(
        *(F.floor(F.col(a) / width).alias(c) for a, c in zip(AXES, cells)), "id", F.array(*(F.col(a).cast("double") for a in AXES), *number, F.coalesce(F.col("corr").cast("double"), F.lit(float("-inf")))).alias("v"))
    half, quarter = ([F.floor(F.col("v")[i] * k / width) for i in range(3)] for k in (2, 4))
    sides = [f"{e}{a}" for e in ("lo", "hi") for a in AXES]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        window = TaskContext.get().partitionId() << 32
        for cell, ids, v in _windows(batches):
            window += 1
            best, other = np.full(len(ids), known.least), np.zeros(len(ids), ids.dtype)
            has = np.zeros(len(ids), bool)
            parts = range(0, len(ids), _PACK)
            for a in parts:
                for b in parts:
                    p, o = slice(a, a + _PACK), slice(b, b + _PACK)
                    i, s, name = known.best(ids[p], v[p], best[p], ids[o], v[o])
                    i = i + a
                    now = np.where(np.isnan(best[i]), np.inf, best[i])
                    better = ~has[i] | (np.isnan(s) & ~np.isnan(best[i])) | (s > now) | (((s == best[i]) | (np.isnan(s) & np.isnan(best[i]))) & (name < other[i]))
                    i, s, name = i[better], s[better], name[better]
                    best[i], other[i], has[i] = s, name, True
            cuts = [slice(a, a + _PACK) for a in parts]
            low, high = ([f(v[c, :3], axis=0) for c in cuts] for f in (np.min, np.max))
            tops = [float(known.top(v[c, 6]).max()) for c in cuts]
            floors = [float(known.floor(best[c]).min()) for c in cuts]
            columns = [pa.array([cell[k]] * len(cuts), pa.int64()) for k in range(3)]
            columns += [pa.array([window] * len(cuts), pa.int64()), _lists([ids[c] for c in cuts], id_kind), _lists([v[c] for c in cuts], pa.float64()), _lists([best[c] for c in cuts], pa.float64())]
            columns += [_lists([other[c] for c in cuts], id_kind), _lists([has[c] for c in cuts], pa.bool_())]
            columns += [pa.array([e[k] for e in ends]) for ends in (low, high) for k in range(3)] + [pa.array(tops), pa.array(floors)]
            yield pa.RecordBatch.from_arrays(columns, [*cells, "_w", "ids", "v", "best", "other", "has", *sides, "top", "floor"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in range(len(batch)):
                ids, v, best, o_ids, o = (batch.column(k)[r].values.to_numpy() for k in range(5))
                i, s, name = known.best(ids, v.reshape(-1, 7), best, o_ids, o.reshape(-1, 7))
                found.append((ids[i], s, name))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]), t) for k, t in enumerate((id_kind, pa.float64(), id_kind))], ["id", "s", "o"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_kind = to_arrow_type(points.schema["id"].dataType)
    # a cell's points come one after another, those near one another together
    sorted_rows = rows.repartition(*cells).sortWithinPartitions(*cells, *half, *quarter)
    schema = ", ".join([*(f"{c} long" for c in cells), f"_w long, ids array<{kind}>, v array<double>, best array<double>, other array<{kind}>, has array<boolean>", *(f"{c} double" for c in (*sides, "top", "floor"))])
    packs = settle(sorted_rows.mapInArrow(pack, schema))
    wide = packs.select(*cells, F.col("_w").alias("_ow"), F.col("ids").alias("o_ids"), F.col("v").alias("o_v"), F.col("top").alias("o_top"), *(F.col(c).alias(f"o_{c}") for c in sides))
    for a, c in zip(AXES, cells):
        wide = wide.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
        # no further than to cells that a point within reach may stand in
        wide = wide.where((F.col(c) * width <= F.col(f"o_hi{a}") + width) & ((F.col(c) + 1) * width >= F.col(f"o_lo{a}") - width))
    gaps = [F.greatest(F.lit(0.0), F.col(f"o_lo{a}") - F.col(f"hi{a}"), F.col(f"lo{a}") - F.col(f"o_hi{a}")) for a in AXES]
    square = sum(g * g for g in gaps)
    both = wide.hint("merge").join(packs.drop("other", "has"), cells).where((F.col("_w") != F.col("_ow")) & (square <= width * width) & (F.col("o_top") - square / sigmas[2] ** 2 >= F.col("floor") - 1e-9))
    met = both.select("ids", "v", "best", "o_ids", "o_v").mapInArrow(meet, f"id {kind}, s double, o {kind}")
    first = packs.select(F.explode(F.arrays_zip("ids", "best", "other", "has")).alias("r")).where("r.has").select(F.col("r.ids").alias("id"), F.col("r.best").alias("s"), F.col("r.other").alias("o"))
    best = first.unionByName(met).groupBy("id").agg(F.max(F.struct("s", (-F.col("o")).alias("o"))).alias("b"))
    return best.select("id", (-F.col("b.o")).alias("next"), F.col("b.s").alias("similarity"))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """(cell, ids, points) of the sorted rows, cut where the cell ends and after a window's rows."""
    cell, held, count = None, [], 0

    def cut() -> tuple[tuple, np.ndarray, np.ndarray]:
        return cell, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])

    for batch in batches:
        if not len(batch):
            continue
        at = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
        ids, v = batch.column(3).to_numpy(), batch.column(4).flatten().to_numpy().reshape(-1, 7)
        starts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)]
        for a, b in zip(starts, starts[1:]):
            own = tuple(at[a].tolist())
            if held and own != cell:
                yield cut()
                held, count = [], 0
            cell = own
            while a < b:
                end = min(b, a + _WINDOW - count)
                held.append((ids[a:end], v[a:end]))
                count += end - a
                a = end
                if count == _WINDOW:
                    yield cut()
                    held, count = [], 0
    if held:
        yield cut()
