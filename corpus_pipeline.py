"""The corpus pipeline: documents through five stages, each written and read again as the next one's input.

Defined results, for every stage: a null doc_id is kept and counts as no id; a null text is an empty one, and stays null;
texts of any length are worked on whole; repeated rows are judged alike; all but the last stage give the columns that
they get, whatever their names, and change none but text and n_chars; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, jaccard_join, line_dedup, packing, quality_crf
from tessera.llm.common import read, settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; without labels to learn from it rejects none."""
    model = quality_crf.fit(docs, quality_crf.training_labels(read(spark, sf_dir, "labels")))
    return quality_crf.keep_good(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated three-line windows; those that lose every line go, those that were empty stay."""
    out = line_dedup.dedup(docs, set_n_chars=True)
    return out.where("_n_removed = 0 or text <> ''").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: five words and a similarity of 0.8; op1's own figures are its
    contract's. A repeated row stays once; rows without an id or without words stay, each of them."""
    return jaccard_join.keep_one(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's phrases; those that consist of them go, those without words stay."""
    return decontam.remove(docs, read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, packed into sequences; every row has one at least, an empty text its end token."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("packing", best_fit_packing),
]

#: The classifier, the join's groups, the index and the packing are not SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
