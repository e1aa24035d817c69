"""Overlapping boxes from packs of boxes of like size that lie together: all pairs are found, a pack of pairs at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.iterate import settle

_SIDES = ("x1", "y1", "x2", "y2")
#: Boxes of a pack.
_PACK = 512
#: Classes of sizes that are listed; where there are more, packs are copied for all that might be.
_CLASSES = 4096


def _overlap(p: np.ndarray, o: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of p, rows of o, iou) of the boxes whose overlap over union exceeds least (> 0)."""
    inside = lambda a, b: np.flatnonzero((a[:, 0] < b[:, 2].max()) & (a[:, 2] > b[:, 0].min()) & (a[:, 1] < b[:, 3].max()) & (a[:, 3] > b[:, 1].min()))
    rows = inside(p, o)
    others = inside(o, p[rows]) if len(rows) else rows[:0]
    if not len(others):
        return rows[:0], others, np.empty(0)
    p, o = p[rows], o[others]
    width = np.minimum(p[:, None, 2], o[None, :, 2]) - np.maximum(p[:, None, 0], o[None, :, 0])
    height = np.minimum(p[:, None, 3], o[None, :, 3]) - np.maximum(p[:, None, 1], o[None, :, 1])
    area, other = ((b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]) for b in (p, o))
    both = np.maximum(width, 0) * np.maximum(height, 0)
    share = both / (area[:, None] + other[None] - both)
    i, j = np.nonzero(share > least)
    return rows[i], others[j], share[i, j]


def box_pairs(boxes: DataFrame, least: float, cell: float, places: int | None = None) -> DataFrame:
    """See regions.box_pairs; least is more than 0, and iou is rounded to places, if given.

    A class of boxes has sides of up to 2^k * cell along each axis and a grid of that width, which holds those of smaller
    classes whole. Boxes of two classes meet in the greater grid, in the cells of their centres or next to one another.
    """
    kind, id_kind = boxes.schema["id"].dataType.simpleString(), to_arrow_type(boxes.schema["id"].dataType)
    steps = int(np.ceil(-np.log2(least) - 1e-9))
    width = lambda k: F.pow(F.lit(2.0), k) * cell
    real = F.col("id").isNotNull() & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    for c in _SIDES:
        real = real & (F.abs(F.col(c).cast("double")) < float("inf"))
    # a little up: rounding must not give a box a class that is narrower than itself
    rows = boxes.where(real).select("id", *(F.col(c).cast("double") for c in _SIDES)).withColumns({f"_k{a}": F.ceil(F.log2((F.col(f"{a}2") - F.col(f"{a}1")) / cell) + 1e-9).cast("int") for a in "xy"})
    rows = rows.withColumns({f"_m{a}": F.col(f"{a}1") / 2 + F.col(f"{a}2") / 2 for a in "xy"})
    rows = rows.withColumns({f"_c{a}": F.floor(F.col(f"_m{a}") / width(F.col(f"_k{a}"))) for a in "xy"})
    keys = ["_kx", "_ky", "_cx", "_cy"]
    fine = [F.floor(F.col(f"_m{a}") * n / width(F.col(f"_k{a}"))) for n in (2, 4, 8) for a in "xy"]
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, *fine).select(*keys, "id", F.array(*_SIDES).alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            at = np.stack([batch.column(k).to_numpy() for k in range(4)], 1)
            ids, v = batch.column(4), batch.column(5).flatten().to_numpy().reshape(-1, 4)
            starts = np.array([0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1), len(at)])
            cuts = np.concatenate([np.arange(a, b, _PACK) for a, b in zip(starts[:-1], starts[1:])])
            ends = np.append(cuts, len(at))
            keyed = [pa.array(at[cuts, k], batch.schema.field(k).type) for k in range(4)]
            lists = [pa.ListArray.from_arrays(pa.array(ends * n, pa.int32()), x) for n, x in ((1, ids), (4, pa.array(v.ravel())))]
            bounds = [pa.array(f.reduceat(v[:, k], cuts)) for k, f in enumerate((np.minimum, np.minimum, np.maximum, np.maximum))]
            yield pa.RecordBatch.from_arrays([*keyed, *lists, *bounds], [*keys, "ids", "v", *_SIDES])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            twice = batch.column(4).to_pylist()
            for r in range(len(batch)):
                ids, v, o_ids, o = (batch.column(k)[r].values.to_numpy() for k in range(4))
                i, j, share = _overlap(v.reshape(-1, 4), o.reshape(-1, 4), least)
                a, b = ids[i], o_ids[j]
                keep = a < b if twice[r] else a != b
                a, b, share = a[keep], b[keep], share[keep]
                if places is not None:
                    share = np.floor(share * 10.0**places + 0.5) / 10.0**places
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), id_kind), pa.array(np.maximum(a, b), id_kind), pa.array(share)], ["a", "b", "iou"])

    packs = settle(placed.mapInArrow(pack, f"_kx int, _ky int, _cx long, _cy long, ids array<{kind}>, v array<double>, x1 double, y1 double, x2 double, y2 double"))
    # classes that meet: one along x is no less than the other's (of equal ones each pair is met in both orders)
    code = lambda x, y: F.col(x) * 8192 + F.col(y)
    classes = [r.c for r in packs.select(code("_kx", "_ky").alias("c")).distinct().limit(_CLASSES + 1).collect()]

    def coupled(df: DataFrame, x: str, y: str, first: int, last: int) -> DataFrame:
        """df for each class x, y that its own may meet, of those that there are."""
        own = {"_jx": "_kx", "_jy": "_ky", "_kx": "_jx", "_ky": "_jy"}
        df = df.withColumn(x, F.explode(F.sequence(F.col(own[x]) + first, F.col(own[x]) + last))).withColumn(y, F.explode(F.sequence(F.col(own[y]) - steps, F.col(own[y]) + steps)))
        df = df.where(code(x, y).isin(classes)) if len(classes) <= _CLASSES else df
        return df.withColumns({"_wx": F.col("_kx"), "_wy": F.greatest("_ky", "_jy")})

    shift = lambda a, k: F.floor(F.col(f"_c{a}") / F.pow(F.lit(2.0), F.col(f"_w{a}") - F.col(k)))
    names = ["_kx", "_ky", "_jx", "_jy"]
    left = coupled(packs, "_jx", "_jy", -steps, 0).withColumns({"_gx": shift("x", "_kx"), "_gy": shift("y", "_ky")}).select(*names, "_gx", "_gy", "ids", "v", *_SIDES)
    right = coupled(packs.withColumnsRenamed({"_kx": "_jx", "_ky": "_jy"}), "_kx", "_ky", 0, steps)
    for a in "xy":
        at = shift(a, f"_j{a}")
        right = right.withColumn(f"_g{a}", F.explode(F.sequence(at - 1, at + 1)))
        wide = width(F.col(f"_w{a}"))
        # no further than to cells where a box that it touches may have its centre
        right = right.where((F.col(f"_g{a}") * wide <= F.col(f"{a}2") + wide * 0.51) & ((F.col(f"_g{a}") + 1) * wide >= F.col(f"{a}1") - wide * 0.51))
    right = right.select(*names, "_gx", "_gy", F.col("ids").alias("o_ids"), F.col("v").alias("o_v"), *(F.col(c).alias(f"o_{c}") for c in _SIDES))
    both = left.join(right.hint("merge"), [*names, "_gx", "_gy"])
    for a in "xy":
        both = both.where((F.col(f"{a}1") < F.col(f"o_{a}2")) & (F.col(f"o_{a}1") < F.col(f"{a}2")))
    return both.select("ids", "v", "o_ids", "o_v", (F.col("_kx") == F.col("_jx")).alias("twice")).mapInArrow(meet, f"a {kind}, b {kind}, iou double")
