"""What modules of queries share: table readers, carriers, and a register of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def register() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """(queries, sql, query): query(sql) registers the function that it decorates under its name."""
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None):
        def keep(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return keep

    return queries, sql, query


def points(spark, d: str) -> DataFrame:
    """`part` as points: id, x, y, z on a scrambled integer grid, and a value."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), *((F.col("p_partkey") * a % m).cast("int").alias(c) for c, a, m in (("x", 37, 97), ("y", 101, 89), ("z", 53, 83))), F.col("p_retailprice").alias("val"))


POINTS = "pts AS (SELECT p_partkey AS id, (p_partkey * 37 % 97)::INT AS x, (p_partkey * 101 % 89)::INT AS y, (p_partkey * 53 % 83)::INT AS z, p_retailprice AS val FROM part)"


def uniform(key, name: str):
    """A number in [0, 1) that a key and a name fix, from the first 32 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(name)).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def uniform_sql(key: str, name: str) -> str:
    return f"(('0x' || substr(md5({key}::VARCHAR || '{name}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
