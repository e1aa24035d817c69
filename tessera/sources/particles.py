"""Text and binary formats of particles: STAR tables, atom coordinates, point lists, EM volumes.

Files are read whole by tasks, one row a file: they are tables of particles and single maps, not corpora.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the EM format: the code in byte 3 of the header, and the type it stands for.
EM_TYPES = {1: "i1", 2: "i2", 4: "i4", 5: "f4", 9: "f8"}
EM_HEADER = 512


def parse_star(text: str) -> dict[str, tuple[list[str], list[list[str]]]]:
    """Blocks by name (what follows data_): the headers without _ and the rows. Comments and empty lines don't count."""
    blocks: dict[str, tuple[list[str], list[list[str]]]] = {}
    headers: list[str] = []
    rows: list[list[str]] = []
    looped = False
    for line in text.splitlines():
        words = line.split("#")[0].split() if line.lstrip().startswith(("_", "#")) else line.split()
        if not words:
            continue
        if words[0].startswith("data_"):
            headers, rows, looped = [], [], False
            blocks[words[0][5:]] = (headers, rows)
        elif words[0] == "loop_":
            looped = True
        elif words[0].startswith("_"):
            headers.append(words[0][1:])
            if not looped and len(words) > 1:  # one value of a block without a loop
                if not rows:
                    rows.append([])
                rows[0].append(words[1])
        elif headers:
            rows.append(words)
    return blocks


def read_star(spark: SparkSession, path: str, *, block: str | None = None) -> DataFrame:
    """(path, block, row, fields): every row of the files' tables as a map of its columns; short rows lack the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                for key, (headers, rows) in parse_star(raw.as_py().decode()).items():
                    if rows and (block is None or key == block):
                        fields = pa.array([list(zip(headers, r)) for r in rows], pa.map_(pa.string(), pa.string()))
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([key] * len(rows)), pa.array(range(len(rows)), pa.int32()), fields], ["path", "block", "row", "fields"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, block string, row int, fields map<string,string>")


def star_text(df: DataFrame, order: list[str], *, block: str = "") -> DataFrame:
    """(value): the lines of one table's file, for one partition's text sink; rows come in the given order."""
    names = df.columns
    head = ["", f"data_{block}", "", "loop_", *(f"_{c} #{i + 1}" for i, c in enumerate(names))]
    lines = df.select(*(F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(order)), F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in names)).alias("value"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)))
    top = df.sparkSession.createDataFrame([(i, line) for i, line in enumerate(head)], "place int, value string")
    both = top.select("place", *(F.lit(None).alias(f"o{i}") for i in range(len(order))), "value").unionByName(lines.select(F.lit(len(head)).alias("place"), *(f"o{i}" for i in range(len(order))), "value"))
    return both.orderBy("place", *(f"o{i}" for i in range(len(order)))).select("value")


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    """(path, serial, name, x, y, z) of the ATOM and HETATM lines of PDB files, by their fixed columns."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").where(F.substring("value", 1, 6).isin("ATOM  ", "HETATM"))
    part = lambda a, b: F.trim(F.substring("value", a, b - a + 1))
    return t.select("path", part(7, 11).try_cast("int").alias("serial"), part(13, 16).alias("name"), *(part(a, a + 7).try_cast("double").alias(c) for c, a in (("x", 31), ("y", 39), ("z", 47))))


def bounding_spheres(atoms: DataFrame, key: str = "path") -> DataFrame:
    """(key, x, y, z, r): the atoms' mean point and the greatest distance from it."""
    centre = atoms.groupBy(key).agg(*(F.avg(c).alias(f"c{c}") for c in "xyz"))
    square = sum((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "xyz")
    return atoms.join(centre, key).groupBy(key).agg(*(F.first(f"c{c}").alias(c) for c in "xyz"), F.sqrt(F.max(square)).alias("r"))


def point_text(points: DataFrame) -> DataFrame:
    """(value): lines of object, contour and coordinates for a point file, one contour a point, in the order of (z, y, x)."""
    at = points.select("x", "y", "z").orderBy("z", "y", "x")
    return at.select(F.format_string("1\t1\t%s\t%s\t%s", *(F.col(c).cast("string") for c in "xyz")).alias("value"))


def parse_em(raw: bytes) -> np.ndarray:
    """The volume (x, y, z) of an EM file."""
    order = "<" if raw[0] == 6 else ">"
    nx, ny, nz = np.frombuffer(raw, order + "i4", 3, 4)
    if raw[3] not in EM_TYPES:
        raise ValueError(f"EM type {raw[3]}")
    return np.frombuffer(raw, order + EM_TYPES[raw[3]], int(nx) * int(ny) * int(nz), EM_HEADER).reshape((nx, ny, nz), order="F").astype(np.float32)


def em_bytes(volume: np.ndarray) -> bytes:
    head = np.zeros(EM_HEADER, np.uint8)
    head[0], head[3] = 6, 5
    head[4:16] = np.array(volume.shape, "<i4").view(np.uint8)
    return head.tobytes() + np.asarray(volume, "<f4").tobytes(order="F")


def read_em(spark: SparkSession, path: str, *, rows: int = 100_000) -> DataFrame:
    """(path, x, y, z, val) of EM files' voxels, at most `rows` an Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                v = parse_em(raw.as_py())
                flat = v.ravel()
                for a in range(0, len(flat), rows):
                    at = np.unravel_index(np.arange(a, min(a + rows, len(flat))), v.shape)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at[0])), *(pa.array(p.astype(np.int32)) for p in at), pa.array(flat[a : a + rows].astype(float))], ["path", "x", "y", "z", "val"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, x int, y int, z int, val double")
