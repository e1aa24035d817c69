"""The MRC data source: pruned partitions, crops, and writes that leave whole files or none."""

import os

import numpy as np
import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from tessera.sources import mrc, mrc_format

SHAPE = (6, 5, 8)


@pytest.fixture(scope="module")
def volumes():
    r = np.random.default_rng(1)
    return {f"v{i}": r.standard_normal(SHAPE).astype(np.float32) for i in range(3)}


@pytest.fixture
def folder(spark, tmp_path, volumes):
    mrc_format.register(spark)
    df = spark.createDataFrame([(n, v.ravel().tolist()) for n, v in volumes.items()], "name string, data array<float>").repartition(2)
    df.write.format("mrc").option("shape", ",".join(map(str, SHAPE))).option("spacing", "2.5").mode("append").save(f"file://{tmp_path}/maps")
    return f"file://{tmp_path}/maps"


def voxels(df):
    return {(os.path.basename(r.path)[:-4], r.x, r.y, r.z): r.val for r in df.collect()}


def test_what_is_written_is_read(spark, folder, volumes):
    base = folder.removeprefix("file://")
    assert sorted(os.listdir(base)) == ["v0.mrc", "v1.mrc", "v2.mrc"]
    with open(f"{base}/v1.mrc", "rb") as f:
        h = mrc.parse_header(f.read(1024))
    assert (h["nx"], h["ny"], h["nz"], h["xlen"]) == (6, 5, 8, 15.0)
    got = voxels(spark.read.format("mrc").load(folder))
    assert got == {(n, *map(int, p)): float(v[p]) for n, v in volumes.items() for p in np.ndindex(v.shape)}
    one = voxels(spark.read.format("mrc").load(f"{base}/v1.mrc"))
    assert one == {k: v for k, v in got.items() if k[0] == "v1"}


def test_filters_prune_planes_and_rows(spark, folder, volumes):
    load = lambda: spark.read.format("mrc").option("slabVoxels", "30").option("pushFilters", "true").load(folder)
    crop = load().where((F.col("z") >= 2) & (F.col("z") < 4) & (F.col("y") == 3) & (F.col("x") > 1) & (F.col("val") < 9))
    assert voxels(crop) == {(n, x, 3, z): float(v[x, 3, z]) for n, v in volumes.items() for x in range(2, 6) for z in (2, 3)}
    assert crop.rdd.getNumPartitions() == 6 and load().rdd.getNumPartitions() == 24  # a plane each
    some = load().where(F.col("z").isin(1, 5))
    assert {k[3] for k in voxels(some)} == {1, 5} and some.rdd.getNumPartitions() == 15
    assert voxels(load().where("z > 100")) == {}
    assert voxels(load().where("z < 0 or x = 2").where("z = 1 and y = 0")) == {(n, 2, 0, 1): float(v[2, 0, 1]) for n, v in volumes.items()}
    whole = spark.read.format("mrc").load(folder)  # without pushed filters one DataFrame serves many reads
    assert len(voxels(whole.where("z = 1"))) == 90 and len(voxels(whole)) == 720


def test_filters_that_the_source_takes():
    reader = mrc_format.MrcFilteredReader("file:///none", 1)
    left = list(reader.pushFilters([D.EqualTo(("path",), "a"), D.GreaterThan(("x",), 3), D.LessThanOrEqual(("x",), 9), D.In(("y",), (2, None, 7)), D.Not(D.EqualTo(("z",), 1)), D.IsNotNull(("z",))]))
    assert [type(f) for f in left] == [D.EqualTo, D.In, D.Not]
    assert (reader.low, reader.high) == ({"x": 4, "y": 2, "z": 0}, {"x": 10, "y": 8, "z": 2**31 - 1})


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    mrc_format.register(spark)
    folder = f"{tmp_path}/failed"
    rows = [("a", [1.0] * 8), ("b", [1.0] * 8), ("c", [1.0] * 7)]
    df = spark.createDataFrame(rows, "name string, data array<float>").repartition(3)
    with pytest.raises(Exception):  # noqa: B017
        df.write.format("mrc").option("shape", "2,2,2").mode("append").save(folder)
    assert not os.path.exists(folder) or os.listdir(folder) == []


def test_parts_of_a_lost_job_are_not_read(spark, tmp_path, volumes):
    mrc_format.register(spark)
    folder = f"{tmp_path}/lost"
    writer = mrc_format.MrcWriter(f"file://{folder}", (2, 2, 2), 1.0, False)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["p"]), pa.array([[1.0] * 8], pa.list_(pa.float32()))], ["name", "data"])
    message = writer.write(iter([batch]))
    assert voxels(spark.read.format("mrc").load(folder)) == {}
    writer.commit([message, None])
    assert os.listdir(folder) == ["p.mrc"] and len(voxels(spark.read.format("mrc").load(folder))) == 8
    other = mrc_format.MrcWriter(f"file://{folder}", (2, 2, 2), 1.0, True)
    other.write(iter([batch]))
    other.abort([])
    assert os.listdir(folder) == ["p.mrc"]
    other.commit([other.write(iter([batch.set_column(0, "name", pa.array(["q"]))]))])
    assert os.listdir(folder) == ["q.mrc"]  # overwritten as a whole


def test_cut_files_and_wrong_options(spark, folder, tmp_path):
    base = folder.removeprefix("file://")
    with open(f"{base}/v0.mrc", "r+b") as f:
        f.truncate(1024 + 6 * 5 * 4 * 2)
    load = lambda: spark.read.format("mrc").option("slabVoxels", "30").option("pushFilters", "true").load(folder)
    assert len(voxels(load().where("z < 2"))) == 3 * 60
    with pytest.raises(Exception, match="ends before"):
        load().collect()
    with pytest.raises(Exception, match="shape"):
        spark.createDataFrame([("a", [1.0])], "name string, data array<float>").write.format("mrc").mode("append").save(f"{tmp_path}/x")
