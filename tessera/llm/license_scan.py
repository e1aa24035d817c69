"""License scans in DataFrame operations only.

Every line of a file is compared with license templates by the cosine of sparse TF-IDF vectors, document
frequencies being counted over all files; a file without a line at the threshold inherits from the licence
file in its nearest ancestor directory, found by joins on directory paths.

Words are runs of a-z and 0-9 in lower case. Words that no template holds weigh by their own document
frequency too, which a join on the word finds for the lines that are scored. A line can reach the threshold
for a template only if it holds one of the template's heavier words (the others' share of its norm is below
the threshold), so lines without any such anchor are not scored: that loses nothing.

Defined results: null texts have no line and inherit only; a null path has no directory and inherits from
nothing; ties go to the higher cosine, then the licence's name; rows that agree in path and text get the
same result; further columns pass, whatever their name, but for those named license, cosine or license_via, which
the result replaces; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, read, unpacked

# Wording of licence notices as their publishers state it.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
]
THRESHOLD = 0.6
# File names that hold a directory's licence.
LICENSE_FILES = ["LICENSE", "LICENSE.txt", "LICENSE.md", "LICENCE", "COPYING", "COPYING.txt"]


def template_counts(templates=TEMPLATES) -> list[dict[str, int]]:
    out = []
    for _, text in templates:
        counts: dict[str, int] = {}
        for word in re.findall("[a-z0-9]+", text.lower()):
            counts[word] = counts.get(word, 0) + 1
        out.append(counts)
    return out


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def scan(files: DataFrame, *, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files (path, text, ...) with license, cosine and license_via: header, file, inherited or none."""
    spark = files.sparkSession
    counts = template_counts(templates)
    vocabulary = sorted({w for c in counts for w in c})
    held = F.array(*[F.lit(w) for w in vocabulary])
    total = F.count("text").alias("n")
    n = files.agg(total).first().n
    found = files.select(F.explode(F.array_intersect(_words(F.col("text")), held)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    df = {r.word: r.df for r in found.collect()}  # one row a template word at most
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    norms = [math.sqrt(sum((k * idf[w]) ** 2 for w, k in c.items())) for c in counts]
    anchors = set()
    for c, norm in zip(counts, norms):
        rest = 0.0
        for w in sorted(c, key=lambda w: (c[w] * idf[w], w)):
            rest += (c[w] * idf[w]) ** 2
            if math.sqrt(rest) / norm >= threshold * (1 - 1e-9):
                anchors.add(w)
    weights = spark.createDataFrame([(w, idf[w], [c.get(w, 0) * idf[w] / norm for c, norm in zip(counts, norms)]) for w in vocabulary], "word string, idf double, parts array<double>")

    key = ["path", "_hash"]
    # the hash comes first, so that no line carries the whole text
    lines = files.where("text is not null").select("path", F.xxhash64("text").alias("_hash"), F.split("text", "\n", -1).alias("l"))
    lines = lines.select("path", "_hash", F.posexplode("l").alias("_line", "l"))
    lines = lines.withColumn("w", _words(F.col("l"))).where(F.arrays_overlap("w", F.array(*[F.lit(w) for w in sorted(anchors)])))
    tf = lines.select(*key, "_line", F.explode("w").alias("word")).groupBy(*key, "_line", "word").agg(F.count("*").alias("tf"))
    # rows that agree in path and text have counted each word as often as there are such rows: the cosine is the same
    tf = tf.join(F.broadcast(weights), "word", "left")
    # the templates' words, often hot, have their weight already and stay out of the join
    other = tf.where("idf is null")
    often = files.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("word")).join(other.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("_df"))
    other = other.drop("idf").join(often, "word").withColumn("idf", F.log(F.lit(1.0 + n) / (1 + F.col("_df"))) + 1)
    tf = tf.where("idf is not null").unionByName(other.select(tf.columns))
    tf = tf.withColumn("x", F.col("tf") * F.col("idf"))
    dots = [F.sum(F.coalesce(F.col("x") * F.col("parts")[i], F.lit(0.0))).alias(f"d{i}") for i in range(len(templates))]
    scored = tf.groupBy(*key, "_line").agg(F.sum(F.col("x") * F.col("x")).alias("sq"), *dots)
    best = F.greatest(*[F.struct(F.round(F.col(f"d{i}") / F.sqrt("sq"), 6).alias("cosine"), F.lit(name).alias("license")) for i, (name, _) in enumerate(templates)])
    own = scored.select(*key, best.alias("best")).where(F.col("best.cosine") >= threshold).groupBy(*key).agg(F.max("best").alias("own"))

    name = F.element_at(F.split("path", "/", -1), -1)
    columns = files.columns
    files = packed(files, "path", "text").withColumn("_hash", F.xxhash64("text")).withColumn("_dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit("")))
    own = own.select(F.col("path").alias("_own_path"), F.col("_hash").alias("_own_hash"), "own")
    known = files.join(own, F.col("path").eqNullSafe(F.col("_own_path")) & (F.col("_hash") == F.col("_own_hash")), "left").drop("_own_path", "_own_hash")

    granted = own.where(F.element_at(F.split("_own_path", "/", -1), -1).isin(LICENSE_FILES))
    granted = granted.withColumn("_at", F.when(F.col("_own_path").contains("/"), F.regexp_replace("_own_path", "/[^/]*$", "")).otherwise("")).groupBy("_at").agg(F.max("own").alias("grant"))
    dirs = files.where("_dir is not null").select("_dir").distinct()
    steps = F.split("_dir", "/", -1)
    up = dirs.select("_dir", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/")))).alias("_at")).distinct()
    nearest = up.join(granted, "_at").groupBy("_dir").agg(F.max(F.struct(F.length("_at").alias("depth"), F.col("grant"))).alias("near"))
    nearest = nearest.select(F.col("_dir").alias("_near_dir"), F.col("near.grant").alias("grant"))
    out = known.join(nearest, F.col("_dir") == F.col("_near_dir"), "left")
    via = F.when(F.col("own").isNotNull(), F.when(name.isin(LICENSE_FILES), "file").otherwise("header")).when(F.col("grant").isNotNull(), "inherited").otherwise("none")
    picked = F.coalesce("own", "grant")
    return unpacked(out, columns, "path", "text", license=picked["license"], cosine=picked["cosine"], license_via=via)


def as_files(docs: DataFrame) -> DataFrame:
    """documents laid out as a tree: source/thousands/hundreds/file; every 50th is a licence file, every 1000th one directory higher."""
    up = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.expr("cast(doc_id div 1000 as string)"))
    deep = F.concat_ws("/", up, F.expr("cast(doc_id div 100 % 10 as string)"))
    path = F.when(F.expr("doc_id % 1000 = 0"), F.concat(up, F.lit("/LICENSE"))).when(F.expr("doc_id % 50 = 0"), F.concat(deep, F.lit("/LICENSE"))).otherwise(F.concat(deep, F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), path).alias("path"))


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(as_files(read(spark, sf_dir, "documents"))).select("doc_id", "path", "license", "cosine", "license_via")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x) for x in r) + ")" for r in rows)


OP3_SQL = f"""
WITH files AS (
  SELECT doc_id, text, CASE WHEN doc_id % 1000 = 0 THEN up || '/LICENSE' WHEN doc_id % 50 = 0 THEN up || '/' || (doc_id // 100 % 10) || '/LICENSE'
         ELSE up || '/' || (doc_id // 100 % 10) || '/doc_' || doc_id || '.txt' END AS path
  FROM (SELECT doc_id, text, coalesce(source, 'unknown') || '/' || (doc_id // 1000) AS up FROM documents)),
names(t, license) AS (VALUES {_values([(i, n) for i, (n, _) in enumerate(TEMPLATES)])}),
counts(t, word, k) AS (VALUES {_values([(i, w, k) for i, c in enumerate(template_counts()) for w, k in c.items()])}),
lines AS (SELECT doc_id, path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM files WHERE text IS NOT NULL),
words AS (SELECT doc_id, path, pos, unnest(string_split_regex(lower(line), '[^a-z0-9]+')) AS word FROM lines),
tf AS (SELECT doc_id, path, pos, word, count(*) AS tf FROM words WHERE word <> '' GROUP BY ALL),
total AS (SELECT count(text) AS n FROM files),
idf AS (SELECT v.word, ln((1 + n) / (1 + coalesce(df, 0))::DOUBLE) + 1 AS idf FROM (SELECT word FROM counts UNION SELECT word FROM tf) v CROSS JOIN total
        LEFT JOIN (SELECT word, count(DISTINCT doc_id) AS df FROM tf GROUP BY word) d ON d.word = v.word),
template AS (SELECT t, word, k * idf / sqrt(sum((k * idf) * (k * idf)) OVER (PARTITION BY t)) AS part FROM counts JOIN idf USING (word)),
x AS (SELECT tf.*, tf * idf AS x FROM tf JOIN idf USING (word)),
norm AS (SELECT doc_id, path, pos, sum(x * x) AS sq FROM x GROUP BY ALL),
dot AS (SELECT doc_id, path, pos, t, sum(x * part) AS d FROM x JOIN template USING (word) GROUP BY ALL),
best AS (SELECT doc_id, path, round(d / sqrt(sq), 6) AS cosine, license FROM dot JOIN norm USING (doc_id, path, pos) JOIN names USING (t)),
own AS (SELECT doc_id, path, cosine, license FROM best WHERE cosine >= {THRESHOLD}
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license DESC) = 1),
split AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir FROM files),
granted AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, cosine, license FROM own WHERE path LIKE '%/LICENSE'
        QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, license DESC) = 1),
near AS (SELECT s.doc_id, g.cosine, g.license FROM split s JOIN granted g ON s.dir = g.dir OR starts_with(s.dir, g.dir || '/')
        QUALIFY row_number() OVER (PARTITION BY s.doc_id ORDER BY length(g.dir) DESC) = 1)
SELECT f.doc_id, f.path, coalesce(o.license, n.license) AS license, coalesce(o.cosine, n.cosine) AS cosine,
       CASE WHEN o.license IS NOT NULL THEN CASE WHEN f.path LIKE '%/LICENSE' THEN 'file' ELSE 'header' END
            WHEN n.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS license_via
FROM files f LEFT JOIN own o USING (doc_id) LEFT JOIN near n USING (doc_id)
"""
