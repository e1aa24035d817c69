"""MRC volumes as Spark tables: headers and voxels by ranges of bytes, crops that read their planes only, and a sink.

Spark lists the files; tasks read the ranges they need through pyarrow's file systems (local, HDFS, S3, GCS). A file is
cut into slabs of planes, so that neither its size nor a row's bounds it, and a failed read is the task's to repeat.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER_BYTES = 1024
# Numpy types of the format's voxel modes.
MODES = {0: "i1", 1: "i2", 2: "f4", 6: "u2", 12: "f2"}
_FIELDS = ["nx", "ny", "nz", "mode", "nxstart", "nystart", "nzstart", "mx", "my", "mz"]
#: Voxels of a slab, the work of one row.
SLAB_VOXELS = 1 << 22
_HEADER = "path string, length long, nx int, ny int, nz int, mode int, spacing double, amin double, amax double, amean double, skip int, big boolean"


def parse_header(raw: bytes) -> dict:
    """The size, mode, cell and statistics of a header of either byte order (the one whose mode makes sense)."""
    if len(raw) < HEADER_BYTES:
        raise ValueError("an MRC header has 1024 bytes")
    order = "<" if 0 <= struct.unpack_from("<i", raw, 12)[0] < 128 else ">"
    out = dict(zip(_FIELDS, struct.unpack_from(f"{order}10i", raw, 0)))
    out |= dict(zip(["xlen", "ylen", "zlen", "alpha", "beta", "gamma"], struct.unpack_from(f"{order}6f", raw, 40)))
    out |= dict(zip(["mapc", "mapr", "maps"], struct.unpack_from(f"{order}3i", raw, 64)))
    out |= dict(zip(["amin", "amax", "amean"], struct.unpack_from(f"{order}3f", raw, 76)))
    out["ispg"], out["nsymbt"] = struct.unpack_from(f"{order}2i", raw, 88)
    out["order"] = order
    if out["mode"] not in MODES:
        raise ValueError(f"MRC mode {out['mode']} is not supported")
    return out


def _opened(path: str):
    system, place = pafs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Every file's header: path, length, size, mode, spacing, statistics. 1024 bytes of a file are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                with _opened(name) as f:
                    h = parse_header(f.read(HEADER_BYTES))
                rows.append({**h, "path": name, "length": length, "spacing": h["xlen"] / h["nx"] if h["nx"] else None, "skip": HEADER_BYTES + h["nsymbt"], "big": h["order"] == ">"})
            names = [c.split()[0] for c in _HEADER.split(", ")]
            kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[c.split()[1]]) for n, c in zip(names, _HEADER.split(", "))], names)

    files = spark.read.format("binaryFile").load(path).select("path", "length")  # no content is read for these
    return files.mapInArrow(run, _HEADER)


def read_voxels(spark: SparkSession, path: str, *, low: tuple[int, int, int] | None = None, high: tuple[int, int, int] | None = None, strict: bool = False) -> DataFrame:
    """(vol_id, x, y, z, val) of every file's voxels in [low, high); only the planes of the crop are read.

    The file's order has x fastest. strict: a file that isn't three-dimensional, or whose length isn't its header's, is
    an error; else what the file holds is read.
    """
    h = read_headers(spark, path)
    low = (0, 0, 0) if low is None else low
    bounds = [F.lit(2**31 - 1)] * 3 if high is None else [F.lit(x) for x in high]
    step = F.greatest(F.lit(1), F.floor(F.lit(SLAB_VOXELS) / (F.col("nx") * F.col("ny")))).cast("int")
    first, last = F.lit(low[2]), F.least(F.col("nz"), bounds[2])
    slabs = h.withColumn("last", last).withColumn("step", step).where((first < F.col("last")) & (F.col("nx") > 0) & (F.col("ny") > 0))
    slabs = slabs.withColumn("z0", F.explode(F.sequence(first, F.col("last") - 1, F.col("step")))).withColumn("z1", F.least(F.col("z0") + F.col("step"), F.col("last")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                kind = np.dtype((">" if r["big"] else "<") + MODES[r["mode"]])
                plane = r["nx"] * r["ny"]
                if strict and (r["nz"] < 2 or r["length"] != r["skip"] + plane * r["nz"] * kind.itemsize):
                    raise ValueError(f"{r['path']} is not a whole three-dimensional volume")
                x0, x1 = low[0], min(r["nx"], r["x1"])
                y0, y1 = low[1], min(r["ny"], r["y1"])
                with _opened(r["path"]) as f:
                    for z in range(r["z0"], r["z1"]):
                        raw = f.read_at(plane * kind.itemsize, r["skip"] + z * plane * kind.itemsize)
                        v = np.frombuffer(raw, kind, min(plane, len(raw) // kind.itemsize))
                        v = np.concatenate((v, np.zeros(plane - len(v), kind))).reshape(r["ny"], r["nx"])[y0:y1, x0:x1].astype(np.float32).ravel()
                        y, x = (np.ascontiguousarray(a.ravel().astype(np.int32)) for a in np.mgrid[y0 : max(y1, y0), x0 : max(x1, x0)])
                        yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(v), pa.string()), pa.array(x), pa.array(y), pa.array(np.full(len(v), z, np.int32)), pa.array(v)], ["vol_id", "x", "y", "z", "val"])

    slabs = slabs.select("path", "length", "nx", "ny", "nz", "mode", "skip", "big", "z0", "z1", bounds[0].alias("x1"), bounds[1].alias("y1"))
    return slabs.repartition("path", "z0").mapInArrow(run, "vol_id string, x int, y int, z int, val float")


def to_bytes(volume: np.ndarray, spacing: float = 1.0, *, mode: int = 2, big: bool = False) -> bytes:
    """An MRC file of volume[x, y, z]."""
    nx, ny, nz = volume.shape
    order = ">" if big else "<"
    head = bytearray(HEADER_BYTES)
    struct.pack_into(f"{order}10i", head, 0, nx, ny, nz, mode, 0, 0, 0, nx, ny, nz)
    struct.pack_into(f"{order}6f", head, 40, nx * spacing, ny * spacing, nz * spacing, 90, 90, 90)
    struct.pack_into(f"{order}3i3f2i", head, 64, 1, 2, 3, volume.min(), volume.max(), volume.mean(), 1, 0)
    head[208:216] = b"MAP " + (b"\x11\x11\0\0" if big else b"\x44\x44\0\0")
    return bytes(head) + np.ascontiguousarray(volume.transpose(2, 1, 0)).astype(order + MODES[mode]).tobytes()


def write_volumes(volumes: DataFrame, folder: str, *, shape: tuple[int, int, int], spacing: float = 1.0, overwrite: bool = True) -> DataFrame:
    """(path, length): each row (name, data) as a file of the folder (a URI that tasks can write to); lazy, as any table.

    Files are written beside their place and moved there, so that a repeated task leaves whole files; without overwrite
    those that are there stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            out = []
            for name, data in zip(batch.column("name").to_pylist(), batch.column("data")):
                place = f"{base}/{name}.mrc"
                raw = to_bytes(np.asarray(data.values.to_numpy(zero_copy_only=False), float).reshape(shape), spacing)
                if overwrite or system.get_file_info(place).type == pafs.FileType.NotFound:
                    with system.open_output_stream(place + ".part") as f:
                        f.write(raw)
                    system.move(place + ".part", place)
                out.append((f"{folder.rstrip('/')}/{name}.mrc", len(raw)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64())], ["path", "length"])

    return volumes.select(F.col("name").cast("string"), F.col("data").cast("array<float>")).mapInArrow(run, "path string, length long")
