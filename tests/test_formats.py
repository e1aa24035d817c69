"""Files of every format, written and read again, and streams."""

import struct
import zlib

import numpy as np
import pytest

from tessera.plans import iterate
from tessera.sources import formats, mrc, store
from tessera.streaming import windows


def dense(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.x, r.y, r.z] = r.val
    return out


@pytest.mark.parametrize("mode, big", [(0, False), (1, True), (2, True), (6, False), (12, False)])
def test_mrc_modes_and_byte_orders(spark, tmp_path, mode, big, monkeypatch):
    v = np.random.default_rng(1).integers(0, 100, (3, 4, 5)).astype(float)
    (tmp_path / "a.mrc").write_bytes(mrc.to_bytes(v, 2.0, mode=mode, big=big))
    monkeypatch.setattr(mrc, "SLAB_VOXELS", 24)
    h = mrc.read_headers(spark, f"file://{tmp_path}").first()
    assert (h.nx, h.ny, h.nz, h.mode, h.spacing, h.big) == (3, 4, 5, mode, 2.0, big)
    assert (dense(mrc.read_voxels(spark, f"file://{tmp_path}", strict=True), v.shape) == v).all()
    crop = mrc.read_voxels(spark, f"file://{tmp_path}", low=(1, 0, 2), high=(3, 2, 99)).collect()
    assert {(r.x, r.y, r.z): r.val for r in crop} == {p: v[p] for p in np.ndindex(v.shape) if p[0] >= 1 and p[1] < 2 and p[2] >= 2}


def test_mrc_short_files(spark, tmp_path):
    raw = mrc.to_bytes(np.ones((2, 2, 3)))
    (tmp_path / "a.mrc").write_bytes(raw[:-8])
    assert dense(mrc.read_voxels(spark, f"file://{tmp_path}"), (2, 2, 3)).sum() == 10
    with pytest.raises(Exception, match="not a whole"):
        mrc.read_voxels(spark, f"file://{tmp_path}", strict=True).count()


def test_mrc_sink_keeps_files(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    one = spark.createDataFrame([("a", [1.0] * 8)], "name string, data array<double>")
    assert [r.length for r in mrc.write_volumes(one, folder, shape=(2, 2, 2)).collect()] == [1024 + 32]
    mrc.write_volumes(one.selectExpr("name", "transform(data, x -> 5d) as data"), folder, shape=(2, 2, 2), overwrite=False).count()
    assert dense(mrc.read_voxels(spark, folder), (2, 2, 2)).sum() == 8
    mrc.write_volumes(one.selectExpr("name", "transform(data, x -> 5d) as data"), folder, shape=(2, 2, 2)).count()
    assert dense(mrc.read_voxels(spark, folder), (2, 2, 2)).sum() == 40


def test_png():
    raw = formats.image_bytes(np.array([[0.0, 1.0, 2.0], [np.nan, 2.0, 4.0]]))
    assert raw[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", raw[16:24]) == (3, 2)
    size = struct.unpack(">I", raw[33:37])[0]
    assert list(zlib.decompress(raw[41 : 41 + size])) == [0, 0, 64, 128, 0, 0, 128, 255]
    assert formats.image_bytes(np.zeros((1, 1)))[:4] == b"\x89PNG"


def test_arrays_refuse_objects():
    v = np.arange(6.0).reshape(2, 3)
    assert (formats.parse_array(formats.array_bytes(v)) == v).all()
    with pytest.raises(ValueError):
        formats.array_bytes(np.array([{}], object))


def test_boxes(spark, tmp_path):
    obj = "<object><name>{}</name>{}<bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>{}</ymax></bndbox></object>"
    body = obj.format("cell", "<difficult>1</difficult>", 9) + obj.format("ring", "", 4.5)
    (tmp_path / "a.xml").write_text(f"<annotation><filename>a.png</filename>{body}</annotation>")
    rows = formats.read_boxes(spark, str(tmp_path)).orderBy("class").collect()
    assert [tuple(r) for r in rows] == [("a.png", "cell", True, 1, 2, 3, 9), ("a.png", "ring", False, 1, 2, 3, 4.5)]


def test_surfaces(spark, tmp_path):
    v, t = np.array([[0, 0, 0.5], [1, 0, 0], [0, 1, 0], [0, 0, 1]]), np.array([[0, 1, 2], [1, 2, 3]])
    (tmp_path / "a.surf").write_text(formats.surface_text(v, t))
    a, b = formats.parse_surface((tmp_path / "a.surf").read_text())
    assert np.allclose(a, v) and (b == t).all()
    assert formats.read_surfaces(spark, str(tmp_path)).count() == 4


def test_store_and_cache(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    both = store.upserted(t, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), "k")
    assert sorted(map(tuple, both.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(r.k for r in store.deleted(both, t.select("k"), "k").collect()) == [3]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x\ny\n")
    loads = []
    cache = store.FileCache(spark, f"file://{tmp_path}/kept")
    load = lambda p: loads.append(p) or spark.read.text(p)
    for _ in range(2):
        assert cache.get(f"{tmp_path}/in", load).count() == 2
    (tmp_path / "in" / "a.txt").write_text("x\ny\nz\n")
    assert cache.get(f"{tmp_path}/in", load).count() == 3 and len(loads) == 2


def test_loops_end_or_say_so(spark):
    start = spark.createDataFrame([(1,)], "n int")
    step = lambda df, i: df.selectExpr("n + 1 as n")
    done = lambda a, b: b.first().n == 4
    assert iterate.iterate(start, step, done).first().n == 4
    with pytest.raises(RuntimeError):
        iterate.iterate(start, step, done, most=2)


def _stream(spark, tmp_path, batches, query, mode):
    """What a stream over files gives, a file a batch."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(batches):
        schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(folder))
    out = []
    run = query(source).writeStream.outputMode(mode).foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    return out


def _at(hour, minute=0):
    import datetime

    return datetime.datetime(2024, 1, 1, hour, minute)


def test_windows_of_a_stream_drop_what_is_late(spark, tmp_path):
    # what is late is judged by the watermark of the batch before the last
    batches = [[(1, _at(0, 5), 1, "a", 1.0)], [(2, _at(6), 1, "a", 1.0)], [(9, _at(7), 1, "a", 1.0)], [(3, _at(0, 10), 1, "a", 1.0), (4, _at(12), 1, "a", 1.0)], [(5, _at(20), 1, "a", 1.0)]]
    rows = _stream(spark, tmp_path, batches, windows.tumbling, "append")
    closed = {r.window.start.hour: r.n for r in rows}
    assert closed[0] == 1 and closed[6] == 1 and 20 not in closed


def test_first_results_of_a_stream(spark, tmp_path):
    batches = [[(1, _at(0), 7, "a", 1.0)], [(2, _at(0, 5), 7, "a", 2.0), (3, _at(0, 6), 8, "a", 3.0)]]
    rows = _stream(spark, tmp_path, batches, lambda s: windows.accept_once(s, "user_id"), "append")
    assert sorted((r.user_id, r.value) for r in rows) == [(7, 1.0), (8, 3.0)]
