"""Registered queries of the corpus-building operators."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm import best_fit_packing, decontamination, language, licenses, line_rules, packing, phrases, quality_grades, simhash, spelling, suffix_dedup, toxicity, wavelet
from corpusforge.llm.folds import fold
from corpusforge.session import materialize, shared_dir
from corpusforge.sources.tables import read_table

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontamination(spark: SparkSession, d: str) -> DataFrame:
    found = decontamination.contaminated(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"))
    return found.select("doc_id", "item_id", "containment", "n_found", "n_shingles")


@query
def op2_packing(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op3_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, d, "documents")).select("doc_id", "fingerprint", "component_id")


@query
def op4_quality_grades(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    model = quality_grades.train(labels.filter(fold(F.col("doc_id"), 5) != 0), docs)
    graded = quality_grades.grade(docs, model)
    return graded.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "expected_grade", "predicted_grade", "top_probability")


@query
def op5_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    model = toxicity.train(labels.filter(fold(F.col("doc_id"), 5) != 0), docs)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@query
def op6_licenses(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan(read_table(spark, d, "documents"))


@query
def op7_language(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    model = language.train(docs.filter(fold(F.col("doc_id"), 3) != 1))
    found = language.identify(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


@query
def op8_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, d, "documents"), shorter=200)


@query
def op9_line_rules(spark: SparkSession, d: str) -> DataFrame:
    return line_rules.quality_rules(read_table(spark, d, "documents"))


@query
def op10_token_files(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    shards = materialize(wavelet.write_tokens(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), 0), "token-shards")
    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = wavelet.read_tokens(spark, folder).join(wavelet.token_places(shards), "file")
    return rows.select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


@query
def op11_phrases(spark: SparkSession, d: str) -> DataFrame:
    return phrases.top_collocations(read_table(spark, d, "documents"))


@query
def op12_spelling(spark: SparkSession, d: str) -> DataFrame:
    return spelling.variants(materialize(spelling.typed_words(read_table(spark, d, "documents")), "words"))


@query
def op13_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    packed = best_fit_packing.pack_whole(read_table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"), 0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
