"""Stateful stream operators with timers: spans of contact that end by timeout, and models that grow with their records.

Both give in append mode what a batch over all rows gives that are not too late; the models keep one small state a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which timers need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def contact_spans(rows: DataFrame, key: str, time: str, *, timeout: timedelta = timedelta(minutes=30), late: str = "2 hours") -> DataFrame:
    """(key, first, last, n) of a stream: spans of contact without a gap above `timeout`, given once each, when the watermark
    (`late` behind the newest row) has passed the timeout after their last contact. A row that lies so far behind the
    watermark that its own timeout has passed is too late and left out, as are those without a key or time; one less late
    joins its span while that is open, and is a span of its own else.

    The spans are session windows: their state and timeouts are Spark's, without a call to Python for each key."""
    source = rows.select(F.col(key).alias("key"), F.col(time).cast("timestamp").alias("ts")).where("key is not null and ts is not null")
    gap = f"{int(timeout / timedelta(microseconds=1))} microseconds"
    # a row exactly `timeout` later still belongs to the span: it is given a millisecond after that
    found = source.withWatermark("ts", f"{late} 1 millisecond").groupBy("key", F.session_window("ts", gap)).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return found.select(F.col("key").alias(key), "first", "last", "n")


class _Growing(StatefulProcessor):
    """Count and sums of a key's vectors; each batch gives the model so far, and an idle key its last one."""

    def __init__(self, size: int, idle: int | None):
        self.size = size
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.model = handle.getValueState("model", "n long, sums array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, sums = self._now()
        block: list = []
        for r in rows:
            block.append(r.v)
            if len(block) == 1024:
                n, sums, block = n + len(block), sums + np.array(block, float).sum(0), []
        if block:
            n, sums = n + len(block), sums + np.array(block, float).sum(0)
        self.model.update((n, sums.tolist()))
        if self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield Row(key=key[0], n=n, sums=sums.tolist(), ended=False)

    def _now(self) -> tuple[int, np.ndarray]:
        if not self.model.exists():
            return 0, np.zeros(self.size)
        n, sums = self.model.get()
        return n, np.array(sums, float)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, sums = self._now()
        self.model.clear()
        yield Row(key=key[0], n=n, sums=sums.tolist(), ended=True)

    def close(self) -> None:
        pass


def growing_means(rows: DataFrame, key: str, column: str, size: int, *, idle: timedelta | None = None) -> DataFrame:
    """(key, n, sums, ended) of a stream: each key's vectors added up so far, once for every batch that has some of them.

    A key without any for `idle` of processing time gives its last model as ended, and begins anew with its next vector; such
    a stream looks for idle keys until it is stopped, where one without `idle` can end with its source. Rows whose key is null, or whose vector is null, of another size or holds null, take no part."""
    ok = F.col("key").isNotNull() & F.col("v").isNotNull() & (F.size("v") == size) & ~F.exists("v", lambda e: e.isNull())
    source = rows.select(F.col(key).cast("string").alias("key"), F.col(column).cast("array<double>").alias("v")).where(ok)
    kept = _Growing(size, None if idle is None else int(idle / timedelta(milliseconds=1)))
    found = source.groupBy("key").transformWithState(kept, "key string, n long, sums array<double>, ended boolean", "append", "None" if idle is None else "ProcessingTime")
    return found.select(F.col("key").cast(rows.schema[key].dataType).alias(key), "n", "sums", "ended")
