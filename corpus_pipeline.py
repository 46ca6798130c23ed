"""Corpus pipeline: language, quality, near duplicates, secrets, packing.

``run`` passes ``documents`` through STAGES; each stage works on all that the
one before kept, and its result is written as Parquet into the shared
checkpoint folder and read again.  All stages but the last return the columns
of ``documents``.

1. language: texts without a letter, or torn between languages, go.
2. quality: texts that fail the base rules or the likelihood ratio go; the
   trusted target is what ``labels`` calls good.
3. near duplicates: one document of each group (word 5-grams, Jaccard 0.8 or
   more, linked directly or through others) stays, the smallest doc_id.
4. secrets: found spans are replaced in the text, also encoded ones.
5. packing: token pieces in sequences (see tremor.llm.packing).

Null texts and texts without words go with stage 1.  An empty table passes
through.  The result follows from the tables alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tremor.llm import jaccard_join, language, packing, quality, secret_scan
from tremor.llm.common import narrow_batches
from tremor.session import checkpoint_dir
from tremor.sources.tables import load_table

LEAST_LANGUAGE_SCORE = 0.3
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    narrow_batches(spark)           # holds for the later stages too
    return language.keep_identified(docs, language.fit(docs), LEAST_LANGUAGE_SCORE)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ratio = quality.quality_ratio(docs, load_table(spark, sf_dir, "labels"))
    return quality.judge(docs, ratio, keep_columns=True)


def drop_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_duplicates(docs, SHINGLE_WORDS, SIMILARITY_PERCENT, 100)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("language_id", identify_language), ("quality_rules", keep_quality), ("jaccard_join", drop_duplicates),
          ("secret_scan", redact_secrets), ("packing", pack)]

#: the language machines and the likelihood ratio have no SQL form; tests hold
#: the stages against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
