"""Tables in the shared folder, splits by a hash of the id, and readers of the inputs."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where spark.checkpoint.dir is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended: then the cluster's own cleaning takes it
        pass


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        _drop(spark, path)


def settle(df: DataFrame, *, partition_by: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again, which cuts its lineage; removed when the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    del writer
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner drop the shuffle files of what is written now
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables that settle() wrote and that nothing reads any more."""
    for table in tables:
        _drop(table.sparkSession, table._tessera_path)


def narrow(spark: SparkSession) -> None:
    """Keeps Arrow batches to Python small in bytes, whatever the texts' length."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)),):
        try:
            spark.conf.set(key, value)
        except Exception:  # not in this Spark version: the record limit alone holds
            pass


def packed(df: DataFrame, *keep: str) -> DataFrame:
    """The columns of keep, and all others in one struct _row, so that no name of theirs can clash with one of ours."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in keep]
    return df.select(*keep, F.struct(*rest or [F.lit(None).cast("int").alias("none")]).alias("_row"))


def unpacked(df: DataFrame, columns: list[str], *kept: str, **new: Column) -> DataFrame:
    """The columns of a packed table that kept the named ones, with those of new in their place, or after them."""
    names = [*columns, *(name for name in new if name not in columns)]
    # named in a step of their own: an alias in the same step would hide the column of that name
    out = [(new[c] if c in new else F.col(c) if c in kept else F.col("_row").getField(c)).alias(f"_out{i}") for i, c in enumerate(names)]
    return df.select(*out).toDF(*names)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts
