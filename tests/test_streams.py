"""Stateful streams in micro-batches against the batch over all rows, with late rows, timeouts and idle keys."""

import random
import time
from datetime import datetime, timedelta

import numpy as np

from tessera.plans import streams
from tessera.streaming import state

T0 = datetime(2024, 1, 1)
SCHEMA = "worker string, ts timestamp, note string"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def spans(rows, watermark, gap=30):
    """Spans of (worker, minutes), those whose timeout the watermark (minutes) has passed."""
    out = set()
    for w in {w for w, _ in rows if w}:
        times = sorted(m for v, m in rows if v == w and m is not None)
        first, n = times[0], 0
        for a, b in zip(times, [*times[1:], None]):
            n += 1
            if b is None or b - a > gap:
                if a + gap < watermark:
                    out.add((w, at(first), at(a), n))
                first, n = b, 0
    return out


def run(spark, slices, **kw):
    frames = [spark.createDataFrame([(w, None if m is None else at(m), "x") for w, m in s], SCHEMA) for s in slices]
    with state.keyed_state(spark):
        out = streams.drained(state.contact_spans(streams.replayed(spark, frames), "worker", "ts", **kw)).collect()
    return {(r.worker, r["first"], r["last"], r.n) for r in out}


def test_three_batches_equal_the_whole(spark):
    r = random.Random(2)
    rows = [(r.choice("abcdef"), r.uniform(0, 1500)) for _ in range(150)] + [("a", 700.0)] * 3
    rows.sort(key=lambda x: x[1])
    # rows out of order by less than the two hours that the watermark waits
    mixed = sorted(rows, key=lambda x: x[1] + r.uniform(-50, 50))
    slices = [mixed[:50], mixed[50:100], mixed[100:]]
    got = run(spark, slices)
    assert got == spans(rows, max(m for _, m in rows) - 120) and len(got) > 20


def test_a_gap_of_exactly_the_timeout_is_no_gap(spark):
    got = run(spark, [[("a", 0), ("a", 30), ("b", 0), ("b", 30.001)], [("z", 600)], [("z", 900)]])
    assert got == {("a", at(0), at(30), 2), ("b", at(0), at(0), 1), ("b", at(30.001), at(30.001), 1), ("z", at(600), at(600), 1)}


def test_rows_behind_the_watermark_and_without_key_or_time_are_left_out(spark):
    slices = [[("a", 0), (None, 5), ("b", None)], [("z", 1000)], [("z", 1100)], [("a", 10), ("z", 1200)]]
    assert run(spark, slices) == {("a", at(0), at(0), 1), ("z", at(1000), at(1000), 1)}


def test_growing_means_by_batches(spark):
    schema = "label int, v array<double>"
    slices = [[(1, [1.0, 2.0]), (2, [0.0, 4.0]), (None, [9.0, 9.0]), (1, [None, 1.0]), (1, [1.0])], [(1, [3.0, 4.0])], [(1, [5.0, 0.0]), (3, [1.0, 1.0])]]
    frames = [spark.createDataFrame(s, schema) for s in slices]
    with state.keyed_state(spark):
        out = streams.drained(state.growing_means(streams.replayed(spark, frames), "label", "v", 2)).collect()
    assert not any(r.ended for r in out)
    assert sorted((r.label, r.n, tuple(r.sums)) for r in out) == [(1, 1, (1.0, 2.0)), (1, 2, (4.0, 6.0)), (1, 3, (9.0, 6.0)), (2, 1, (0.0, 4.0)), (3, 1, (1.0, 1.0))]


def test_an_idle_key_is_given_up_and_begins_anew(spark, tmp_path):
    schema = "label int, v array<double>"
    folder = f"{tmp_path}/in"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    put([(1, [1.0]), (2, [5.0])])
    with state.keyed_state(spark):
        stream = spark.readStream.schema(schema).parquet(folder)
        grown = state.growing_means(stream, "label", "v", 1, idle=timedelta(seconds=2))
        query = grown.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="500 milliseconds").start()
        try:
            read = lambda: [(r.label, r.n, r.sums[0], r.ended) for r in spark.read.schema(grown.schema).parquet(f"{tmp_path}/out").collect()]
            end = time.time() + 60
            while time.time() < end and sum(e for *_, e in (read() if (tmp_path / "out" / "_spark_metadata").exists() else [])) < 2:
                time.sleep(0.5)
            put([(1, [7.0])])
            while time.time() < end and (1, 1, 7.0, False) not in read():
                time.sleep(0.5)
        finally:
            query.stop()
    got = read()
    assert {(1, 1, 1.0, True), (2, 1, 5.0, True), (1, 1, 7.0, False)} <= set(got)


def test_thirds_hold_every_row(spark):
    df = spark.createDataFrame([(i,) for i in range(10)] + [(None,)], "x int")
    parts = streams._thirds(df, "x")
    assert sorted(str(r.x) for p in parts for r in p.collect()) == sorted(str(r.x) for r in df.collect())
    assert [p.count() for p in streams._thirds(df.limit(0), "x")] == [0, 0, 0]
    assert np.all([p.count() > 0 for p in parts])


def test_spans_need_no_python_for_each_key(spark):
    # a gap a microsecond above the timeout parts two spans, and the plan keeps them in Spark's own state
    near = at(0) + timedelta(minutes=30, microseconds=1)
    frames = [spark.createDataFrame([("a", at(0), "x"), ("a", near, "x")], SCHEMA), spark.createDataFrame([("z", at(600), "x")], SCHEMA)]
    with state.keyed_state(spark):
        found = state.contact_spans(streams.replayed(spark, frames), "worker", "ts")
        got = {(r.worker, r["first"], r["last"], r.n) for r in streams.drained(found).collect()}
    assert got == {("a", at(0), at(0), 1), ("a", near, near, 1)}
    assert "TransformWithState" not in found._jdf.queryExecution().analyzed().toString()
