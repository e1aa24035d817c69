"""Streams with state and timers over the supplied tables, in several micro-batches, with the SQL of their whole result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import state
from .base import register, table
from .iterate import shared_dir

QUERIES, SQL, _query = register()
#: Rows of a source's file.
_FILE_ROWS = 1 << 20


def replayed(spark: SparkSession, slices: list[DataFrame]) -> DataFrame:
    """A stream that takes the slices one after another, each as one micro-batch."""
    folder = f"{shared_dir(spark)}/slices-{uuid.uuid4().hex}"
    files = max(1, *(-(-s.count() // _FILE_ROWS) for s in slices))
    for s in slices:  # the source takes files by their time: a slice's are written together
        s.repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(slices[0].schema).option("maxFilesPerTrigger", files).parquet(folder)


def drained(stream: DataFrame) -> DataFrame:
    """All that a stream in append mode gives until its source has no more."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _thirds(df: DataFrame, column: str) -> list[DataFrame]:
    """df in three slices of equal span of a number."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return [df, df, df]
    ends = [low + (high - low) * i / 3 for i in (1, 2)]
    c = F.col(column)
    return [df.where(c < ends[0]), df.where((c >= ends[0]) & (c < ends[1])), df.where((c >= ends[1]) | c.isNull())]


@_query("""WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
 s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
 SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k
 HAVING max(ts) + INTERVAL 30 MINUTE + INTERVAL 1 MILLISECOND <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def contact_timeouts(spark, d):
    """Users' spans of contact that ended by a 30-minute timeout, from a stream with timers in three micro-batches."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    slices = [s.drop("_at") for s in _thirds(e.withColumn("_at", F.unix_micros("ts")), "_at")]
    with state.keyed_state(spark):
        out = drained(state.contact_spans(replayed(spark, slices), "user_id", "ts"))
    return out.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


@_query("SELECT label, count(*) AS n, pos::INT AS pos, round(avg(embedding[pos + 1]::DOUBLE), 5) + 0.0 AS mean FROM embeddings, range(64) p(pos) GROUP BY label, pos")
def growing_class_means(spark, d):
    """Class means as a stream's state has them after three micro-batches: the last model of each class."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    slices = [s.drop("vec_id") for s in _thirds(e, "vec_id")]
    with state.keyed_state(spark):
        out = drained(state.growing_means(replayed(spark, slices), "label", "embedding", 64))
    last = out.groupBy("label").agg(F.max_by("sums", "n").alias("sums"), F.max("n").alias("n"))
    return last.select("label", "n", F.posexplode("sums").alias("pos", "sum")).select("label", "n", "pos", (F.round(F.col("sum") / F.col("n"), 5) + 0.0).alias("mean"))
