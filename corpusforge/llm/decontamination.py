"""Benchmark decontamination: find short test items inside long documents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.session import materialize

SHINGLE = 5
# A sketch of at most so many rows (hash and item) is broadcast; that is under 100 MB in memory.
BROADCAST_ROWS = 2_000_000


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _runs(column: str, n: int) -> Column:
    runs = F.transform(F.sequence(F.lit(1), F.size(column) - n + 1), lambda i: F.xxhash64(F.slice(F.col(column), i, F.lit(n))))
    return F.when(F.size(column) >= n, runs).otherwise(F.array().cast("array<bigint>"))


def shingles(column: str, sizes: list[int]) -> Column:
    """Distinct 64-bit hashes of all runs of neighbouring words of these sizes."""
    if not sizes:
        return F.array().cast("array<bigint>")
    return F.array_distinct(F.concat(*(_runs(column, n) for n in sizes)))


def _spread(rows: DataFrame, table: DataFrame, rows_in_table: int) -> DataFrame:
    return rows.join(F.broadcast(table) if rows_in_table <= BROADCAST_ROWS else table, "shingle")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of a document and a benchmark item it contains: doc_id, item_id, containment and counts.

    Containment is the share of the item's distinct 5-word shingles found in the document; an item of
    fewer words is one shingle of its length. Items are partitioned by their number of shingles
    (powers of two). In a partition whose largest size is u, an item's MinHash sketch is its
    floor((1 - threshold) * u) + 1 smallest shingle hashes (all, if it has fewer). A document that
    holds the share `threshold` of the shingles misses fewer than the sketch has, so it
    shares at least one with it: retrieval loses nothing, however long the document. Candidates are
    kept by text, copies once, and verified by exact containment; only their texts are read again.

    Expressions only. The documents' shingles meet the sketch where they are read when the sketch's
    counted rows are few; else both sides shuffle. Nothing is sent per pair of documents.

    Null or wordless texts and items match nothing. Repeated items or rows give their pairs each time.
    Null ids stay. Other columns are not looked at. Empty tables give no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    own = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("_w")).filter(F.size("_w") > 0)
    own = own.withColumn("_size", F.least(F.size("_w"), F.lit(SHINGLE)))
    sizes = sorted(r["_size"] for r in own.select("_size").distinct().collect())
    picked = F.coalesce(*(F.when(F.col("_size") == n, shingles("_w", [n])) for n in sizes)) if sizes else F.array().cast("array<bigint>")
    own = own.select("item_id", picked.alias("_s"), F.monotonically_increasing_id().alias("_item")).withColumn("n_shingles", F.size("_s"))
    largest = F.pow(F.lit(2), F.floor(F.log2("n_shingles")) + 1) - 1
    # The tiny shift keeps (1 - 0.8) * 5 from falling just under 1.
    keep = F.least(F.floor((1 - threshold) * largest + 1e-9) + 1, F.col("n_shingles")).cast("int")
    own = materialize(own.withColumn("_sketch", F.slice(F.array_sort("_s"), F.lit(1), keep)), "benchmark-items")
    sketch = own.select(F.explode("_sketch").alias("shingle"), "_item")
    every = own.select(F.explode("_s").alias("shingle"), "_item")
    rows = own.agg(F.sum(F.size("_sketch")).alias("a"), F.sum(F.size("_s")).alias("b")).first()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"))
    texts = texts.filter(F.col("_text").isNotNull())
    key = [F.xxhash64("_text").alias("_key"), F.length("_text").alias("_length")]
    read = texts.select(*key, words(F.col("_text")).alias("_w"))
    probes = read.select("_key", "_length", F.explode(shingles("_w", sizes)).alias("shingle"))
    found = _spread(probes, sketch, rows["a"] or 0).select("_key", "_length", "_item").distinct()
    candidates = materialize(found, "candidates")

    suspects = candidates.select("_key", "_length").distinct()
    again = texts.select("doc_id", *key, "_text").join(suspects, ["_key", "_length"], "left_semi")
    again = again.select("doc_id", "_key", "_length", words(F.col("_text")).alias("_w"), F.monotonically_increasing_id().alias("_row"))
    held = again.select("doc_id", "_row", "_key", "_length", F.explode(shingles("_w", sizes)).alias("shingle"))
    hits = _spread(held, every, rows["b"] or 0).groupBy("_row", "_item", "doc_id", "_key", "_length").agg(F.count("*").alias("n_found"))
    hits = hits.join(candidates, ["_key", "_length", "_item"], "left_semi").join(own.select("_item", "item_id", "n_shingles"), "_item")
    return hits.filter(F.col("n_found") >= threshold * F.col("n_shingles") - 1e-9).select(
        "doc_id", "item_id", (F.col("n_found") / F.col("n_shingles")).alias("containment"), F.col("n_found").cast("long").alias("n_found"), F.col("n_shingles").cast("long").alias("n_shingles"), F.col("_key").alias("text_hash")
    )


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents that contain no benchmark item, with all their columns. Null ids are told apart by text."""
    found = contaminated(docs, items, threshold)
    bad = materialize(found.select("doc_id", "text_hash").distinct(), "contaminated")
    same = (docs["doc_id"].cast("long").eqNullSafe(bad["doc_id"])) & (F.xxhash64(docs["text"].cast("string")) == bad["text_hash"])
    return docs.join(F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad, same, "left_anti")
