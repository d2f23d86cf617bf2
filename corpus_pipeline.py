"""The training-corpus pipeline over ``documents``.

Stages take ``(spark, docs, sf_dir)`` and return a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import decontaminate, language_id, packing, quality_classifier, simhash
from wordloom.llm.common import table, written
from wordloom.llm.queries import BYTE_BPE, END_ID, SIMHASH_BITS, SIMHASH_WORDS

#: language ID rejects ``und`` and languages less likely than this
MIN_LANGUAGE_SCORE = 0.35

#: no SQL expresses trained models, XXH64 fingerprints or a tokenizer; tested against brute force
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, model)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.train(docs), MIN_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: the one with the least id, null ids
    last, of equal ids the first. Rows are numbered and written first, so that
    repeated or null ids are told apart; only the numbers that go are joined."""
    row = "row_number"
    while row in docs.columns:
        row += "_"
    numbered = written(spark, docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = written(spark, simhash.near_duplicates(numbered, id_col=row, words=SIMHASH_WORDS, max_bits=SIMHASH_BITS)
                    .select(F.col(row).alias("member"), "component_id"), "components")
    ids = numbered.select(F.col(row).alias("number"), F.col("doc_id").alias("id"))
    first = found.join(ids, F.col("member") == F.col("number")).groupBy("component_id").agg(
        F.min_by("member", F.struct(F.col("id").isNull(), "id", "member")).alias("stays"))
    gone = found.join(first, "component_id").where(F.col("member") != F.col("stays")).select(F.col("member").alias(row))
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(BYTE_BPE), END_ID)


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
