"""Exact duplicates by content hash.

Groups are never gathered: counts and keepers are aggregated before the shuffle (a group of
copies shrinks to one row per input partition), and members stay rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.formats import file_hash
from corpusforge.session import materialize


def with_hash(docs: DataFrame, content: str = "text", algorithm: str = "md5") -> DataFrame:
    return docs.withColumn("content_hash", file_hash(F.col(content), algorithm))


def duplicate_groups(docs: DataFrame, key: str, content: str = "text") -> DataFrame:
    """Hashes seen more than once: how often, and the smallest member key."""
    hashed = with_hash(docs, content).select(key, "content_hash")
    groups = hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_members"), F.min(key).alias("first_member"))
    return groups.filter("n_members > 1")


def duplicate_members(docs: DataFrame, key: str, content: str = "text") -> DataFrame:
    """One row per file of each duplicate group.

    Contents are hashed once, into a written table of keys and hashes. The join is many-to-one; a hot
    hash is split by the skew-join rule of adaptive execution, since its other side is a single row.
    """
    hashed = materialize(with_hash(docs, content).select(key, "content_hash"), "hashes")
    groups = hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_members"), F.min(key).alias("first_member"))
    return hashed.join(groups.filter("n_members > 1"), "content_hash")


def dedupe(docs: DataFrame, key: str, content: str = "text") -> DataFrame:
    """Keep, of each group of identical contents, the row with the smallest key.

    Contents are hashed where they are read; only keys and hashes move. The rows that lose, far fewer
    than those that stay, are taken out by key and hash, so a key may come with several contents.
    Null keys lose to any other; of rows equal in key and content all stay, as none is the smaller.
    Null contents are never copies.
    """
    hashed = with_hash(docs, content).select(F.col(key).alias("_key"), F.col("content_hash").alias("_hash")).filter("_hash IS NOT NULL")
    first = hashed.groupBy("_hash").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 AND _first IS NOT NULL").select("_hash", "_first")
    losers = hashed.join(first, "_hash").filter("_key IS NULL OR _key > _first").select("_key", "_hash").distinct()
    # Joined by key alone: only rows with a loser's key are hashed again. Hashes are of one length, so found means equal.
    same = F.instr(losers["_hash"], file_hash(docs[content])) > 0
    return docs.join(losers, docs[key].eqNullSafe(losers["_key"]) & same, "left_anti")
