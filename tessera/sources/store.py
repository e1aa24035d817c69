"""Keyed tables: writes of which the last counts, deletions, and a cache of files by their time and size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(table: DataFrame, writes: DataFrame, key: str) -> DataFrame:
    """The table after the writes: rows of a key that is written go."""
    return table.join(writes.select(key).distinct(), key, "left_anti").select(table.columns).unionByName(writes.select(table.columns))


def deleted(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti").select(table.columns)


class FileCache:
    """Tables made of files, written under the shared folder, made again when a file's time or size changes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def get(self, path: str, load) -> DataFrame:
        """load(path) as a table, or what was kept of it: the name holds path, time and size of every file."""
        files = self.spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
        mark = files.agg(F.sum(F.xxhash64("path", "modificationTime", "length") % 1_000_003).alias("s"), F.count("*").alias("n")).first()
        kept = f"{self.folder}/cache-{abs(hash_text(path))}-{mark.n}-{mark.s or 0}"
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(kept + "/_SUCCESS")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            load(path).write.mode("overwrite").parquet(kept)
        return self.spark.read.parquet(kept)


def hash_text(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())
