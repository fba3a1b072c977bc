"""The corpus pipeline: documents through the stages in order."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusforge.llm import decontamination, near_copies, packing, suffix_dedup, toxicity
from corpusforge.session import shared_dir
from corpusforge.sources.tables import read_table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from all labels and the texts of the given documents."""
    return toxicity.reject_toxic(docs, toxicity.train(read_table(spark, sf_dir, "labels"), docs))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (80 % of 5-word shingles, verified) the document of the least doc_id stays."""
    return near_copies.deduplicate(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that stand twice are cut out of the texts; every document stays."""
    return suffix_dedup.remove_repeats(docs, length=200, figures=False)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("suffix_dedup", suffix_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
# No SQL can express the fingerprints, the classifier or the tokens; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each result is written as Parquet and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
