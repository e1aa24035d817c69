"""Two-phase level sets of whole volumes: means by one aggregate a round, all else along lines.

A volume is a table of small cubes. What runs along an axis (one axis of a distance transform, one tridiagonal solve of
the additive splitting) gathers the cubes of a bundle of lines, works on it and cuts it again; the next axis is one shuffle
away. A task holds a bundle, tile * tile lines over the volume's length, and never a volume.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lines import implicit_step, nearest_squares
from ..plans.iterate import drop, settle
from .regions import connected_regions
from .voxel import AXES, Shape

_CUBE = ["vol_id", "t0", "t1", "t2"]


def cubes(voxels: DataFrame, shape: Shape, *, tile: int = 16) -> DataFrame:
    """(vol_id, t0, t1, t2, w): the voxels (vol_id, x, y, z, val) as cubes, cut at the volume's end; missing voxels are 0."""
    kind = voxels.schema["vol_id"].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        t = [table.column(f"t{k}")[0].as_py() for k in range(3)]
        own = table.filter(table.column("x").is_valid())
        block = np.zeros([min(tile, n - i * tile) for i, n in zip(t, shape)])
        block[tuple(own.column(a).to_numpy().astype(np.int64) - i * tile for a, i in zip(AXES, t))] = own.column("val").fill_null(0.0).to_numpy()
        return table.select(_CUBE).slice(0, 1).append_column("w", pa.array([block.tobytes()]))

    dealt = voxels.select("vol_id", *AXES, F.col("val").cast("double"), *(F.floor(F.col(a) / tile).cast("int").alias(f"t{k}") for k, a in enumerate(AXES)))
    every = voxels.select("vol_id").distinct()
    for k, n in enumerate(shape):
        every = every.withColumn(f"t{k}", F.explode(F.sequence(F.lit(0), F.lit(-(-n // tile) - 1))))
    dealt = dealt.unionByName(every, allowMissingColumns=True)
    return dealt.groupBy(*_CUBE).applyInArrow(pack, f"vol_id {kind}, t0 int, t1 int, t2 int, w binary")


def along(table: DataFrame, axis: int, shape: Shape, tile: int, kernel: Callable[..., dict[str, np.ndarray]], outputs: list[str], reads: list[str]) -> DataFrame:
    """The cubes with new fields: kernel gets the fields `reads` of a bundle of lines, the axis first, and the bundle's own
    scalars by name, and gives the outputs in the same form."""
    kind = table.schema["vol_id"].dataType.simpleString()
    scalars = [f.name for f in table.schema.fields if f.name not in _CUBE and f.dataType.simpleString() != "binary"]
    other = [k for k in range(3) if k != axis]

    def run(found: pa.Table) -> pa.Table:
        found = found.sort_by(f"t{axis}").combine_chunks()
        t = [found.column(f"t{k}").to_pylist() for k in range(3)]
        sizes = [[min(tile, shape[k] - t[k][i] * tile) for k in range(3)] for i in range(len(found))]
        whole = {c: np.moveaxis(np.concatenate([np.frombuffer(b.as_buffer()).reshape(s) for b, s in zip(found.column(c), sizes)], axis), axis, 0) for c in reads}
        made = kernel(**whole, **{c: found.column(c)[0].as_py() for c in scalars})
        ends = np.cumsum([s[axis] for s in sizes])[:-1]
        out = found.select([*_CUBE, *scalars])
        for c in outputs:
            parts = np.split(made[c], ends) if c in made else None
            column = pa.array([np.ascontiguousarray(np.moveaxis(p, 0, axis)).tobytes() for p in parts]) if parts is not None else found.column(c)
            out = out.append_column(c, column)
        return out

    schema = f"vol_id {kind}, t0 int, t1 int, t2 int" + "".join(f", {c} {table.schema[c].dataType.simpleString()}" for c in scalars) + "".join(f", {c} binary" for c in outputs)
    return table.select(*_CUBE, *scalars, *dict.fromkeys([*reads, *(c for c in outputs if c in table.columns)])).groupBy("vol_id", *(f"t{k}" for k in other)).applyInArrow(run, schema)


def _sums(table: DataFrame) -> DataFrame:
    """(vol_id, n_in, s_in, n_out, s_out, moved): of the voxels inside (phi >= 0) and outside, and how many changed sides."""

    def run(batches):
        for batch in batches:
            rows = []
            for w, phi, was in zip(*(batch.column(c) for c in ("w", "phi", "was"))):
                w, phi, was = (np.frombuffer(x.as_buffer()) for x in (w, phi, was))
                inside = phi >= 0
                rows.append((int(inside.sum()), float(w[inside].sum()), int((~inside).sum()), float(w[~inside].sum()), int((inside != (was >= 0)).sum())))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("vol_id"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64())))], ["vol_id", "n_in", "s_in", "n_out", "s_out", "moved"])

    kind = table.schema["vol_id"].dataType.simpleString()
    parts = table.select("vol_id", "w", "phi", "was").mapInArrow(run, f"vol_id {kind}, n_in long, s_in double, n_out long, s_out double, moved long")
    return parts.groupBy("vol_id").agg(*(F.sum(c).alias(c) for c in ("n_in", "s_in", "n_out", "s_out", "moved")))


def _far(shape: Shape) -> float:
    return float(sum(n * n for n in shape))


def level_set(voxels: DataFrame, shape: Shape, *, smooth: float = 0.2, image: float = 1.0, rounds: int = 20, tile: int = 16) -> DataFrame:
    """(vol_id, x, y, z, phi): the level set, positive inside, that splits each volume (vol_id, x, y, z, val) into two means.

    It starts from the voxels above the mean. Each round moves it by how much nearer a voxel is to the inner mean than to
    the outer one, makes it a distance again, and smooths it by one additive-splitting step: the mean of an implicit step
    along each axis. A volume ends when no voxel changes sides; one that loses a side has no rows. Missing voxels are 0.
    """
    far = _far(shape)
    size = float(np.prod(shape))
    own = settle(cubes(voxels, shape, tile=tile))
    scale = voxels.groupBy("vol_id").agg((F.sum(F.col("val").cast("double")) / size).alias("_m"), (F.sum(F.col("val").cast("double") * F.col("val")) / size).alias("_q"))
    scale = scale.select("vol_id", F.coalesce("_m", F.lit(0.0)).alias("mean"), F.sqrt(F.greatest(F.coalesce(F.col("_q") - F.col("_m") * F.col("_m"), F.lit(0.0)), F.lit(0.0))).alias("spread"))

    def start(w, mean, spread):
        w = (w - mean) / (spread or 1.0)
        return {"w": w, "phi": np.where(w > 0, 1.0, -1.0), "was": np.where(w > 0, -1.0, 1.0)}

    state = settle(along(own.join(scale, "vol_id"), 0, shape, tile, start, ["w", "phi", "was"], ["w"]).select(*_CUBE, "w", "phi", "was"))
    drop(own)
    ended = None
    for _ in range(rounds):
        sums = settle(_sums(state))
        done = sums.where("moved = 0").select("vol_id")
        finished = settle(state.join(done, "vol_id", "left_semi"))
        ended = finished if ended is None else ended.unionByName(finished)
        going = sums.where("moved > 0 and n_in > 0 and n_out > 0").select("vol_id", (F.col("s_in") / F.col("n_in")).alias("high"), (F.col("s_out") / F.col("n_out")).alias("low"))
        if not going.limit(1).count():
            state = settle(state.limit(0))
            break
        following = settle(_round(state.join(going, "vol_id"), shape, tile, far, smooth, image))
        drop(state)
        state = following
    sides = _sums(state).where("n_in > 0 and n_out > 0").select("vol_id")
    last = state.join(sides, "vol_id", "left_semi")
    out = last if ended is None else ended.unionByName(last)
    return _voxels(out, shape, tile)


def _round(table: DataFrame, shape: Shape, tile: int, far: float, smooth: float, image: float) -> DataFrame:
    def marks(inside: np.ndarray) -> dict[str, np.ndarray]:
        return {"a": np.where(inside, 0.0, far), "b": np.where(inside, far, 0.0)}

    def both(a, b):
        return {"a": nearest_squares(a), "b": nearest_squares(b)}

    def distance(a, b):  # a: squares to the inside, b: to the outside
        return np.where(a == 0, np.sqrt(b), -np.sqrt(a))

    def first(w, phi, high, low):
        return {"was": phi, **both(**marks(phi >= 0))}

    def second(a, b, high, low):
        return both(a, b)

    def third(w, a, b, high, low):
        moved = distance(**both(a, b)) + image * ((w - low) ** 2 - (w - high) ** 2)
        return both(**marks(moved >= 0))

    def fifth(a, b, high, low):
        d = distance(**both(a, b))
        return {"d": d, "phi": implicit_step(d, 3 * smooth)}

    def sixth(d, phi, high, low):
        return {"phi": phi + implicit_step(d, 3 * smooth)}

    def seventh(d, phi, high, low):
        return {"phi": (phi + implicit_step(d, 3 * smooth)) / 3}

    # the second distance goes back along the axes, so that each end of the way needs no shuffle of its own
    steps = [
        (0, first, ["w", "was", "a", "b"], ["w", "phi"]),
        (1, second, ["w", "was", "a", "b"], ["a", "b"]),
        (2, third, ["w", "was", "a", "b"], ["w", "a", "b"]),
        (1, second, ["w", "was", "a", "b"], ["a", "b"]),
        (0, fifth, ["w", "was", "d", "phi"], ["a", "b"]),
        (1, sixth, ["w", "was", "d", "phi"], ["d", "phi"]),
        (2, seventh, ["w", "was", "phi"], ["d", "phi"]),
    ]
    for axis, kernel, outputs, reads in steps:
        table = along(table, axis, shape, tile, kernel, outputs, reads)
    return table.select(*_CUBE, "w", "phi", "was")


def _voxels(table: DataFrame, shape: Shape, tile: int) -> DataFrame:
    kind = table.schema["vol_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                t = [batch.column(f"t{k}")[i].as_py() for k in range(3)]
                size = [min(tile, n - k * tile) for n, k in zip(shape, t)]
                at = np.indices(size).reshape(3, -1)
                phi = np.frombuffer(batch.column("phi")[i].as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(phi), batch.schema.field(0).type), *(pa.array((p + k * tile).astype(np.int32)) for p, k in zip(at, t)), pa.array(phi)], ["vol_id", *AXES, "phi"])

    return table.select(*_CUBE, "phi").mapInArrow(run, f"vol_id {kind}, x int, y int, z int, phi double")


def segments(voxels: DataFrame, shape: Shape, *, least: int = 1, tile: int = 16, **kw) -> DataFrame:
    """(vol_id, x, y, z, phi, region): the inside of each volume's level set, its brighter side, by connected components of
    at least `least` voxels."""
    phi = settle(level_set(voxels, shape, tile=tile, **kw))
    both = phi.join(voxels.select("vol_id", *AXES, F.col("val").cast("double")), ["vol_id", *AXES], "left").withColumn("val", F.coalesce("val", F.lit(0.0)))
    means = both.groupBy("vol_id").agg(F.avg(F.when(F.col("phi") > 0, F.col("val"))).alias("_i"), F.avg(F.when(F.col("phi") < 0, F.col("val"))).alias("_o"))
    phi = phi.join(means, "vol_id").withColumn("phi", F.when(F.col("_i") < F.col("_o"), -F.col("phi")).otherwise(F.col("phi"))).drop("_i", "_o")
    inside = settle(phi.where("phi > 0"))
    regions = connected_regions(inside.withColumn("val", F.lit(1.0)), shape, tile=2 * tile)
    large = regions.groupBy("vol_id", "region").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return inside.join(regions.join(large, ["vol_id", "region"], "left_semi"), ["vol_id", *AXES])
