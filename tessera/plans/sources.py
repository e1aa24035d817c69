"""Queries that write files of each format to the shared folder and read them again, and a run of a stream."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..operators import records as R
from ..sources import formats, mrc, mrc_format, particles
from ..streaming import windows
from .base import POINTS, points, register, table
from .iterate import shared_dir

QUERIES, SQL, _query = register()
SHAPE = (4, 4, 4)


def _place(spark, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def _maps(spark, d) -> str:
    """Class means written as MRC files; the folder's path."""
    folder = _place(spark, "mrc")
    means = R.array_mean(table(spark, d, "embeddings"), "label", "embedding", 64)
    mrc.write_volumes(means.select(F.concat(F.lit("class"), "label").alias("name"), F.col("mean").alias("data")), folder, shape=SHAPE, spacing=1.5).count()
    return folder


def _label(column: str):
    return F.regexp_extract(column, r"class(\d+)\.[a-z]+$", 1).cast("int").alias("label")


_MEANS = "m AS (SELECT label, (i - 1)::INT AS pos, avg(embedding[i]::DOUBLE)::FLOAT AS v FROM embeddings, range(1, 65) p(i) GROUP BY ALL)"


@_query("SELECT DISTINCT label, 4::INT AS nx, 4::INT AS ny, 4::INT AS nz, 2::INT AS mode, 1.5::DOUBLE AS spacing FROM embeddings")
def mrc_headers(spark, d):
    """Headers of written maps, the files' data unread."""
    h = mrc.read_headers(spark, _maps(spark, d))
    return h.select(_label("path"), "nx", "ny", "nz", "mode", "spacing")


@_query(f"WITH {_MEANS} SELECT label, (pos // 16)::INT AS x, (pos // 4 % 4)::INT AS y, (pos % 4)::INT AS z, round(v::DOUBLE, 5) + 0.0 AS val FROM m")
def mrc_round_trip(spark, d):
    """All voxels of written maps."""
    v = mrc.read_voxels(spark, _maps(spark, d), strict=True)
    return v.select(_label("vol_id"), "x", "y", "z", (F.round(F.col("val").cast("double"), 5) + 0.0).alias("val"))


@_query(f"WITH {_MEANS} SELECT label, (pos // 16)::INT AS x, (pos // 4 % 4)::INT AS y, (pos % 4)::INT AS z, round(v::DOUBLE, 5) + 0.0 AS val FROM m WHERE pos // 16 BETWEEN 1 AND 2 AND pos // 4 % 4 < 3 AND pos % 4 >= 2")
def mrc_crop(spark, d):
    """A crop of written maps; planes outside of it are not read."""
    v = mrc.read_voxels(spark, _maps(spark, d), low=(1, 0, 2), high=(3, 3, 4))
    return v.select(_label("vol_id"), "x", "y", "z", (F.round(F.col("val").cast("double"), 5) + 0.0).alias("val"))


@_query(f"WITH {_MEANS} SELECT label, (pos // 16)::INT AS x, (pos // 4 % 4)::INT AS y, (pos % 4)::INT AS z, round(v::DOUBLE, 5) + 0.0 AS val FROM m WHERE pos // 16 BETWEEN 1 AND 2 AND pos // 4 % 4 < 3 AND pos % 4 >= 2")
def mrc_format_crop(spark, d):
    """Maps written and read through the data source; the filter leaves partitions of its planes only."""
    mrc_format.register(spark)
    folder = _place(spark, "maps")
    folder = folder if ":" in folder.split("/")[0] else f"file://{folder}"
    means = R.array_mean(table(spark, d, "embeddings"), "label", "embedding", 64)
    named = means.select(F.concat(F.lit("class"), "label").alias("name"), F.col("mean").cast("array<float>").alias("data"))
    named.write.format("mrc").option("shape", "4,4,4").option("spacing", "1.5").mode("append").save(folder)
    v = spark.read.format("mrc").option("pushFilters", "true").load(folder).where("x between 1 and 2 and y < 3 and z >= 2")
    return v.select(_label("path"), "x", "y", "z", (F.round(F.col("val").cast("double"), 5) + 0.0).alias("val"))


@_query(f"WITH {POINTS} SELECT 'tomo' AS tomogram_name, x AS x_coord, y AS y_coord, z AS z_coord, val AS score FROM pts")
def csv_coordinates(spark, d):
    path = _place(spark, "csv")
    p = points(spark, d).select(F.lit("tomo").alias("tomogram_name"), *(F.col(a).alias(f"{a}_coord") for a in "xyz"), F.col("val").alias("score"))
    formats.write_coordinates(p, path)
    return formats.read_coordinates(spark, path)


@_query(f"WITH {POINTS} SELECT id, x, y, z FROM pts")
def json_records(spark, d):
    """Records with a nested place, written as lines of JSON and read again."""
    path = _place(spark, "json")
    formats.write_records(points(spark, d).select("id", F.struct("x", "y", "z").alias("loc")), path)
    return formats.read_records(spark, path, "id long, loc struct<x:int,y:int,z:int>").select("id", "loc.x", "loc.y", "loc.z")


@_query(f"WITH {_MEANS} SELECT label, pos, round(v::DOUBLE, 5) + 0.0 AS val FROM m")
def npy_arrays(spark, d):
    """Class means as .npy files and back."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def packed(v):
        return v.map(lambda x: formats.array_bytes(np.asarray(x, np.float32).reshape(SHAPE)))

    folder = _place(spark, "npy")
    means = R.array_mean(table(spark, d, "embeddings"), "label", "embedding", 64)
    formats.write_files(means.select(F.concat(F.lit("class"), "label", F.lit(".npy")).alias("name"), packed("mean").alias("content")), folder).count()
    rows = formats.read_arrays(spark, folder)
    return rows.select(_label("path"), F.posexplode("data").alias("pos", "val")).withColumn("val", F.round("val", 5) + 0.0)


@_query("SELECT n_nationkey AS key, n_name AS name FROM nation")
def star_table(spark, d):
    """A table as a STAR file and back."""
    path = _place(spark, "star")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("rlnKey"), F.regexp_replace("n_name", " ", "~").alias("rlnName"))
    particles.star_text(n, ["rlnKey"], block="particles").coalesce(1).write.text(path)
    rows = particles.read_star(spark, f"{path}/part-*", block="particles")
    return rows.select(F.col("fields")["rlnKey"].cast("int").alias("key"), F.regexp_replace(F.col("fields")["rlnName"], "~", " ").alias("name"))


@_query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_stream(spark, d):
    """events as a stream that runs until all of it is read: the windows of events_tumbling."""
    events = table(spark, d, "events")
    reader = spark.readStream.schema(events.schema)
    # a stream reads folders: the table's own, or the one that its single file stands in
    first = spark.read.format("binaryFile").load(f"{d}/events.parquet").select("path").first()
    single = first is not None and first.path.endswith("/events.parquet")
    source = reader.option("pathGlobFilter", "events.parquet").parquet(d) if single else reader.parquet(f"{d}/events.parquet")
    out, state = _place(spark, "windows"), _place(spark, "state")

    def shaped(rows):
        return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))

    def keep(batch, number) -> None:
        shaped(batch).write.mode("overwrite").parquet(out)

    shaped(windows.tumbling(events.limit(0))).write.parquet(out)  # a stream without rows has no batch
    run = windows.tumbling(source).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out)
