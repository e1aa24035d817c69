"""Small formats beside volumes: coordinate tables, records, arrays, images, boxes, surfaces.

Tables go through Spark's own sources; binary formats are made and parsed by tasks, a row a file.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COORDINATES = "tomogram_name string, x_coord int, y_coord int, z_coord int, score double"


def write_coordinates(points: DataFrame, path: str) -> None:
    points.write.mode("overwrite").option("header", True).csv(path)


def read_coordinates(spark: SparkSession, path: str, schema: str = COORDINATES) -> DataFrame:
    """Coordinates of a tomogram, with the schema given: no pass to guess it."""
    return spark.read.option("header", True).schema(schema).csv(path)


def write_records(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def array_bytes(v: np.ndarray) -> bytes:
    """An .npy file's bytes."""
    out = io.BytesIO()
    np.save(out, v, allow_pickle=False)
    return out.getvalue()


def parse_array(raw: bytes) -> np.ndarray:
    """The array of an .npy file; pickled objects are refused."""
    return np.load(io.BytesIO(raw), allow_pickle=False)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, shape, data) of .npy files, data in C order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_array(raw.as_py()) for raw in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([list(v.shape) for v in found], pa.list_(pa.int32())), pa.array([v.ravel().astype(float) for v in found], pa.list_(pa.float64()))], ["path", "shape", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, shape array<int>, data array<double>")


def image_bytes(image: np.ndarray, *, normalise: bool = True) -> bytes:
    """A grey PNG file of a matrix; normalise: from its least value to its greatest, else values from 0 to 255 as they are.

    A matrix of one value is black; values that aren't finite are black."""
    v = np.nan_to_num(image.astype(float), nan=np.nan, posinf=np.nan, neginf=np.nan)
    low, high = (np.nanmin(v), np.nanmax(v)) if np.isfinite(v).any() else (0.0, 0.0)
    if normalise:
        v = (v - low) / (high - low) * 255 if high > low else np.zeros_like(v)
    grey = np.clip(np.rint(np.nan_to_num(v)), 0, 255).astype(np.uint8)
    rows = np.concatenate((np.zeros((len(grey), 1), np.uint8), grey), 1).tobytes()  # each row begins with its filter, none

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(image, class, difficult, x1, y1, x2, y2): the objects of annotation files in XML, by Spark's XML source."""
    box = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    schema = f"filename string, object array<struct<name:string,difficult:int,bndbox:{box}>>"
    rows = spark.read.format("xml").option("rowTag", "annotation").schema(schema).load(path)
    at = rows.select(F.col("filename").alias("image"), F.explode("object").alias("o"))
    sides = [F.col(f"o.bndbox.{c}").alias(n) for c, n in (("xmin", "x1"), ("ymin", "y1"), ("xmax", "x2"), ("ymax", "y2"))]
    return at.select("image", F.col("o.name").alias("class"), (F.coalesce("o.difficult", F.lit(0)) == 1).alias("difficult"), *sides)


def parse_surface(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, triangles from 0) of an ASCII surface file: the lines after "Vertices n", and after each "Triangles n"."""
    lines = iter(text.splitlines())
    vertices: list = []
    triangles: list = []
    for line in lines:
        words = line.split()
        if len(words) == 2 and words[0] in ("Vertices", "Triangles") and words[1].isdigit():
            into = vertices if words[0] == "Vertices" else triangles
            for _ in range(int(words[1])):
                into.append([float(x) for x in next(lines).split()[:3]])
    return np.array(vertices, float).reshape(-1, 3), np.array(triangles, int).reshape(-1, 3) - 1


def surface_text(vertices: np.ndarray, triangles: np.ndarray) -> str:
    """An ASCII surface file of one patch."""
    body = ["# HyperSurface 0.1 ASCII", f"Vertices {len(vertices)}", *(" ".join(f"{x:.6f}" for x in v) for v in vertices)]
    body += ["NBranchingPoints 0", "NVerticesOnCurves 0", "BoundaryCurves 0", "Patches 1", "{", "BranchingPoints 0", f"Triangles {len(triangles)}"]
    return "\n".join([*body, *(" ".join(str(i + 1) for i in t) for t in triangles), "}", ""])


def read_surfaces(spark: SparkSession, path: str) -> DataFrame:
    """(path, vertex, x, y, z) of surface files' vertices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                v, _ = parse_surface(raw.as_py().decode())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(v), pa.string()), pa.array(np.arange(len(v), dtype=np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in v.T)], ["path", "vertex", "x", "y", "z"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, vertex int, x double, y double, z double")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """(path, length): each row (name, content) as a file of the folder, written beside its place and moved there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        system, base = pafs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for name, raw in zip(batch.column("name").to_pylist(), batch.column("content")):
                with system.open_output_stream(f"{base}/{name}.part") as f:
                    f.write(raw.as_py())
                system.move(f"{base}/{name}.part", f"{base}/{name}")
            paths = [f"{folder.rstrip('/')}/{n}" for n in batch.column("name").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([len(r.as_py()) for r in batch.column("content")], pa.int64())], ["path", "length"])

    return files.select("name", "content").mapInArrow(run, "path string, length long")
