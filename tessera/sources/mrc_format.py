"""MRC files as a Spark data source: spark.read.format("mrc").load(folder) and df.write.format("mrc").save(folder).

A read gives (path, x, y, z, val), a partition a slab of planes. With the option pushFilters, comparisons of x, y and z
with constants are taken by the source: files and planes outside of them have no partition, and of the planes that are
read only the rows in between. A write takes (name, data) with the option shape ("nx,ny,nz", and spacing if wanted). Tasks write to a folder of the job
beside the files' places; the commit moves whole files there, and an abort, or a job that never commits, leaves none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D

from .mrc import HEADER_BYTES, MODES, SLAB_VOXELS, parse_header, to_bytes

SCHEMA = "path string, x int, y int, z int, val float"
_ENDINGS = (".mrc", ".map", ".rec", ".st")
_JOBS = "_temporary-"
_FAR = 2**31 - 1


@dataclass
class Slab(D.InputPartition):
    """The planes z0 to z1 - 1 of a file, and of these [x0, x1) and [y0, y1)."""

    path: str
    nx: int
    ny: int
    kind: str
    skip: int
    x0: int
    x1: int
    y0: int
    y1: int
    z0: int
    z1: int


def _files(path: str) -> list[str]:
    """The folder's files by name, or the file itself; what begins with a dot, and what jobs have not committed, is none."""
    system, base = pafs.FileSystem.from_uri(path)
    info = system.get_file_info(base)
    if info.type == pafs.FileType.File:
        return [base]
    found = system.get_file_info(pafs.FileSelector(base, recursive=True))
    return sorted(f.path for f in found if f.is_file and f.base_name.lower().endswith(_ENDINGS) and not f.base_name.startswith(".") and _JOBS not in f.path[len(base) :])


class MrcReader(D.DataSourceReader):
    def __init__(self, path: str, slab_voxels: int):
        self.path = path
        self.slab_voxels = slab_voxels
        self.low = {"x": 0, "y": 0, "z": 0}
        self.high = {"x": _FAR, "y": _FAR, "z": _FAR}

    def _slabs(self, system: pafs.FileSystem, path: str) -> list[Slab]:
        with system.open_input_file(path) as f:
            h = parse_header(f.read_at(min(HEADER_BYTES, f.size()), 0))
        ends = {a: (max(self.low[a], 0), min(self.high[a], h[f"n{a}"])) for a in "xyz"}
        if any(a >= b for a, b in ends.values()):
            return []
        step = max(1, self.slab_voxels // (h["nx"] * h["ny"]))
        (x0, x1), (y0, y1), (z0, z1) = (ends[a] for a in "xyz")
        kind = (">" if h["order"] == ">" else "<") + MODES[h["mode"]]
        return [Slab(path, h["nx"], h["ny"], kind, HEADER_BYTES + h["nsymbt"], x0, x1, y0, y1, z, min(z + step, z1)) for z in range(z0, z1, step)]

    def partitions(self) -> list[D.InputPartition]:
        system, _ = pafs.FileSystem.from_uri(self.path)
        with ThreadPoolExecutor(32) as pool:  # 1024 bytes a file
            found = [s for slabs in pool.map(lambda p: self._slabs(system, p), _files(self.path)) for s in slabs]
        return found or [Slab("", 0, 0, "<f4", 0, 0, 0, 0, 0, 0, 0)]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        p = partition
        if p.z0 == p.z1:
            return
        system, _ = pafs.FileSystem.from_uri(self.path)
        kind = np.dtype(p.kind)
        y, x = (a.ravel().astype(np.int32) for a in np.mgrid[p.y0 : p.y1, p.x0 : p.x1])
        with system.open_input_file(p.path) as f:
            for z in range(p.z0, p.z1):
                rows = f.read_at((p.y1 - p.y0) * p.nx * kind.itemsize, p.skip + (z * p.ny + p.y0) * p.nx * kind.itemsize)
                if len(rows) < (p.y1 - p.y0) * p.nx * kind.itemsize:
                    raise ValueError(f"{p.path} ends before its plane {z}")
                v = np.frombuffer(rows, kind).reshape(-1, p.nx)[:, p.x0 : p.x1].astype(np.float32).ravel()
                yield pa.RecordBatch.from_arrays([pa.array([p.path] * len(v), pa.string()), pa.array(x), pa.array(y), pa.array(np.full(len(v), z, np.int32)), pa.array(v)], ["path", "x", "y", "z", "val"])


class MrcFilteredReader(MrcReader):
    """Takes the filters that Spark hands to it."""

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            axis = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            if axis not in self.low or not (isinstance(value, int) or isinstance(f, (D.In, D.IsNotNull))):
                yield f
            elif isinstance(f, D.EqualTo):
                self._within(axis, value, value)
            elif isinstance(f, D.GreaterThanOrEqual):
                self._within(axis, value, _FAR)
            elif isinstance(f, D.GreaterThan):
                self._within(axis, value + 1, _FAR)
            elif isinstance(f, D.LessThanOrEqual):
                self._within(axis, 0, value)
            elif isinstance(f, D.LessThan):
                self._within(axis, 0, value - 1)
            elif isinstance(f, D.In):
                known = [v for v in f.value if v is not None]
                self._within(axis, min(known, default=1), max(known, default=0))
                yield f  # the values in between are Spark's to drop
            elif not isinstance(f, D.IsNotNull):
                yield f

    def _within(self, axis: str, first: int, last: int) -> None:
        self.low[axis] = max(self.low[axis], first)
        self.high[axis] = min(self.high[axis], last + 1 if last < _FAR else _FAR)


@dataclass
class Written(D.WriterCommitMessage):
    files: list[tuple[str, str]]


class MrcWriter(D.DataSourceArrowWriter):
    def __init__(self, path: str, shape: tuple[int, int, int], spacing: float, overwrite: bool):
        self.path = path
        self.shape = shape
        self.spacing = spacing
        self.overwrite = overwrite
        self.job = f"{_JOBS}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = pafs.FileSystem.from_uri(self.path)
        own = f"{base}/{self.job}/{uuid.uuid4().hex}"  # another attempt of the task has another
        system.create_dir(own, recursive=True)
        files = []
        for batch in iterator:
            for name, data in zip(batch.column("name").to_pylist(), batch.column("data")):
                if name is None or not data.is_valid or len(data.values) != int(np.prod(self.shape)) or data.values.null_count:
                    raise ValueError(f"{name} is not a named volume of the shape {self.shape}")
                with system.open_output_stream(f"{own}/{name}.mrc") as f:
                    f.write(to_bytes(data.values.to_numpy().astype(float).reshape(self.shape), self.spacing))
                files.append((f"{own}/{name}.mrc", f"{base}/{name}.mrc"))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = pafs.FileSystem.from_uri(self.path)
        if self.overwrite:
            for path in _files(self.path):
                system.delete_file(path)
        for message in messages:
            for source, target in message.files if message else ():
                system.move(source, target)
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        system, base = pafs.FileSystem.from_uri(self.path)
        if system.get_file_info(f"{base}/{self.job}").type == pafs.FileType.Directory:
            system.delete_dir(f"{base}/{self.job}")


class MrcSource(D.DataSource):
    """The format "mrc"."""

    @classmethod
    def name(cls) -> str:
        return "mrc"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ValueError("the format mrc needs one path")
        return path if ":" in path.split("/")[0] else f"file://{path}"

    def reader(self, schema) -> MrcReader:
        kind = MrcFilteredReader if self.options.get("pushFilters", "false").lower() == "true" else MrcReader
        return kind(self._path(), int(self.options.get("slabVoxels", SLAB_VOXELS)))

    def writer(self, schema, overwrite: bool) -> MrcWriter:
        shape = tuple(int(n) for n in self.options.get("shape", "").split(",") if n.strip())
        if len(shape) != 3:
            raise ValueError('the option shape names three sizes, as "64,64,32"')
        return MrcWriter(self._path(), shape, float(self.options.get("spacing", 1.0)), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session.

    With the option pushFilters a read takes its filters. Spark 4.1 keeps the partitions of a filtered read with the
    loaded table, and a later read of the same DataFrame without a filter takes them again: load anew for each such read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MrcSource)
