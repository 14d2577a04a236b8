"""A corpus pipeline of five of the operators: each stage works on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its caller writes that as Parquet and reads it again as
the next stage's docs. All but the last return the columns of ``documents``.

Cases: a null or empty text is scored, fingerprinted and encoded as an empty one and has nothing to decontaminate or to
replace, so its document stays if the classifier lets it; a document that loses all its words to decontamination goes;
documents of any length are taken whole; of documents that link, repeated texts among them, the smallest id stays, and of
its rows one; empty tables give empty results; without labels the classifier rejects nothing that it can't tell. Columns
other than those of ``documents`` are passed on by all stages but the last, which returns those it names.
"""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from piperack.llm import bpe, decontamination, pii, quality, simhash

def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, fitted on the labels, doesn't reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages of the benchmark; what has no other words goes."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates for personal data; n_chars follows the text."""
    return pii.pseudonymise(docs, pii.session_key(spark)).withColumn("n_chars", pii.length_after("text", "n_chars")).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids and the digests of ids and decoded bytes, read back from the ids."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digest(bpe.round_trip(docs, path, pattern), keep=("lang", "source", "n_chars", "ids"))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("byte-level BPE", encoding_stage),
]

#: SQL can't express the classifier or the encoder; tests hold the stages against plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared checkpoint folder, or a temporary one where none is set."""
    from piperack.llm.shared import shared_folder

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
