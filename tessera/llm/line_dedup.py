"""Line dedup: overlapping windows of three consecutive lines, each kept at its first occurrence only.

Windows are hashed, those that occur more than once anywhere are found by one grouped minimum, and the
positions that later occurrences cover are merged and cut. First means the smallest (doc_id, position);
a null doc_id comes last. A text of fewer lines than a window has none and stays.

Defined results: a null text stays null and counts no line; rows that agree in doc_id and text are one
occurrence and get the same result; every other column passes unchanged, whatever its name, but for
n_chars, which `dedup` sets to the new length where it is asked to, and for columns named as one of the three
that it adds, which they replace; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, read, unpacked

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def later_windows(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """(_id, _hash, _starts): the start positions of repeated windows that are not the first, of each text."""
    texts = docs.where("text is not null").select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), _lines(F.col("text")).alias("l"))
    texts = texts.where(F.size("l") >= window)
    keys = F.transform(F.sequence(F.lit(1), F.size("l") - (window - 1)), lambda i: F.struct(F.xxhash64(F.slice("l", i, window)).alias("a"), F.xxhash64(F.lit(1), F.slice("l", i, window)).alias("b")))
    rows = texts.select("_id", "_hash", F.posexplode(keys).alias("_pos", "w")).select("_id", "_hash", "_pos", "w.a", "w.b")
    place = F.struct(F.coalesce("_id", F.lit((1 << 63) - 1)).alias("o"), "_hash", "_pos")
    firsts = rows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "b", "first")
    return rows.join(firsts, ["a", "b"]).where(place != F.col("first")).groupBy("_id", "_hash").agg(F.collect_set("_pos").alias("_starts"))


def dedup(docs: DataFrame, *, window: int = WINDOW, set_n_chars: bool = False) -> DataFrame:
    """docs with the repeated lines cut from text, and _n_lines, _n_removed, _n_spans.

    A text all of whose lines go is empty.
    """
    marks = later_windows(docs, window=window).withColumnRenamed("_id", "_mark_id").withColumnRenamed("_hash", "_mark_hash")
    own = packed(docs, "doc_id", "text")
    joined = own.join(marks, F.col("doc_id").eqNullSafe(F.col("_mark_id")) & (F.xxhash64("text") == F.col("_mark_hash")), "left")
    lines = _lines(F.col("text"))
    covered = F.flatten(F.transform("_starts", lambda s: F.sequence(s, s + (window - 1))))
    cut = joined.withColumn("_cut", F.when(F.col("_starts").isNotNull(), F.array_sort(F.array_distinct(covered))))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_cut")), lambda i: F.element_at(lines, i + 1))
    gaps = F.size(F.filter(F.sequence(F.lit(2), F.size("_cut")), lambda i: F.element_at("_cut", i) > F.element_at("_cut", i - 1) + 1))
    same = F.col("_cut").isNull()
    cut = cut.withColumn("_new", F.when(same, F.col("text")).otherwise(F.array_join(kept, "\n")))
    new = {
        "text": F.col("_new"),
        "_n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)),
        "_n_removed": F.when(same, 0).otherwise(F.size("_cut")),
        "_n_spans": F.when(same, 0).otherwise(gaps + 1),
    }
    if set_n_chars:
        new["n_chars"] = F.when(same, F.col("_row").getField("n_chars")).otherwise(F.length("_new")).cast(docs.schema["n_chars"].dataType)
    return unpacked(cut, docs.columns, "doc_id", **new)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").cast("long").alias("n_lines"), F.col("_n_removed").cast("long").alias("n_removed"), F.col("_n_spans").cast("long").alias("n_spans"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = """
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL),
windows AS (
  SELECT doc_id, pos, line AS l1,
         lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, pos) AS nth
  FROM windows WHERE l2 IS NOT NULL AND l3 IS NOT NULL),
later AS (SELECT doc_id, pos FROM ranked WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, (VALUES (0), (1), (2)) AS v(k)),
spans AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE prev IS NULL OR prev < pos - 1) AS n_spans
  FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM gone) GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text
  FROM lines l WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND g.pos = l.pos) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
       coalesce(s.n_removed, 0) AS n_removed, coalesce(s.n_spans, 0) AS n_spans,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN spans s ON s.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
