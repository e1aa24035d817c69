"""Driver loops over DataFrames: each pass is written to the shared folder and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def drop(*tables: DataFrame) -> None:
    """Removes what settle() wrote for tables that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table._tessera_path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: the cluster's own cleaning takes it
            return


def settle(df: DataFrame) -> DataFrame:
    """Writes df under the shared folder and reads it again, which cuts its lineage; removed when the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pass-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], done: Callable[[DataFrame, DataFrame], bool], *, most: int = 20) -> DataFrame:
    """step() again and again until done(before, after); RuntimeError where `most` passes don't get there."""
    state = settle(state)
    for number in range(most):
        after = settle(step(state, number))
        if done(state, after):
            drop(state)
            return after
        drop(state)
        state = after
    raise RuntimeError(f"not done after {most} passes")
