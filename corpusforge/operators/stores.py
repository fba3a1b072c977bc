"""Work against stores far larger than what arrives: bucketed tables, and a filter of known contents."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.formats import file_hash
from corpusforge.operators.dedupe import with_hash
from corpusforge.session import discard, materialize, shared_dir

#: Bits of one row of a filter, as Spark's bitmap functions have it.
BITMAP_BITS = 32_768


def write_bucketed(rows: DataFrame, name: str, by: str, buckets: int, path: str | None = None) -> DataFrame:
    """Keep `rows` as the table `name`, dealt into `buckets` by a column and sorted by it.

    Joins on that column take the table as it lies: only the other side is shuffled, to the same number of
    buckets. Rows are dealt out before they are written, so each bucket is one file.
    """
    writer = rows.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).format("parquet").option("compression", "zstd")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return rows.sparkSession.table(name)


@contextmanager
def bucketed(rows: DataFrame, by: str, buckets: int) -> Iterator[DataFrame]:
    """A bucketed table for as long as the block lasts; results that read it must be written within."""
    spark, name = rows.sparkSession, f"store_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    try:
        yield write_bucketed(rows, name, by, buckets, path)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _probes(content_hash: Column, rows: int, probes: int) -> Column:
    """Positions of a content in a filter of `rows` bitmaps: array of (bucket, bit)."""
    at = [F.pmod(F.xxhash64(content_hash, F.lit(i)), F.lit(rows * BITMAP_BITS)) for i in range(probes)]
    return F.array(*[F.struct((F.floor(x / BITMAP_BITS)).cast("long").alias("bucket"), (x % BITMAP_BITS).cast("long").alias("bit")) for x in at])


def content_filter(hashes: DataFrame, rows: int, probes: int = 4) -> DataFrame:
    """A Bloom filter of the column content_hash as a table: bucket, bitmap.

    Bitmaps are aggregates, combined before they are shuffled, and filters of two stores merge by
    `merge_filters`. A filter of `rows` has 32,768 bits in each; take about 10 bits per content for
    one false positive in a hundred. Null hashes are left out.
    """
    known = hashes.filter("content_hash IS NOT NULL").select(F.explode(_probes(F.col("content_hash"), rows, probes)).alias("p"))
    return known.groupBy("p.bucket").agg(F.bitmap_construct_agg(F.col("p.bit")).alias("bitmap"))


def merge_filters(*filters: DataFrame) -> DataFrame:
    """The filter of everything that any of the given ones, equal in rows and probes, has seen."""
    out = filters[0]
    for other in filters[1:]:
        out = out.unionByName(other)
    return out.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bit_is_set(bitmap: Column, bit: Column) -> Column:
    """Whether a bit of a bitmap is 1; bits count from the lowest of each byte."""
    byte = F.conv(F.hex(F.substr(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(1) == 1


def perhaps_known(hashes: DataFrame, filter_: DataFrame, rows: int, probes: int = 4) -> DataFrame:
    """The distinct content hashes that the filter cannot rule out: all known ones and a few others."""
    asked = hashes.filter("content_hash IS NOT NULL").select("content_hash").distinct()
    asked = asked.select("content_hash", F.explode(F.array_distinct(_probes(F.col("content_hash"), rows, probes))).alias("p")).select("content_hash", "p.bucket", "p.bit")
    met = asked.join(filter_, "bucket", "left")
    return met.groupBy("content_hash").agg(F.bool_and(F.coalesce(bit_is_set(F.col("bitmap"), F.col("bit")), F.lit(False))).alias("hit")).filter("hit").select("content_hash")


def dedupe_arrivals(arrived: DataFrame, known: DataFrame, key: str, content: str = "text", filter_: DataFrame | None = None, rows: int | None = None, probes: int = 4) -> DataFrame:
    """Of new rows those whose content a store does not have, one per content: that of the smallest key.

    `known` has the store's content_hash. Its filter (kept beside the store, or made here with about 10
    bits per content) rules out most arrivals without a look at the store; the few contents it cannot
    rule out are checked exactly, so a false positive never drops a row. The store itself is
    only met by those few hashes. Texts are hashed once and move no further than to be taken out by key and
    hash. Null contents are never copies, and stay; null keys lose to any other; rows equal in key and
    content all stay.
    """
    if filter_ is None:
        rows = rows or max(1, -(-known.count() * 10 // BITMAP_BITS))
        filter_ = content_filter(known, rows, probes)
    if rows is None:
        raise ValueError("a filter comes with its number of rows")
    hashed = materialize(with_hash(arrived, content).select(F.col(key).alias("_key"), F.col("content_hash")), "arrived")
    suspects = materialize(perhaps_known(hashed, filter_, rows, probes), "suspects")
    there = suspects.join(known.select("content_hash"), "content_hash", "left_semi")
    first = hashed.filter("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min("_key").alias("_first"), F.count("*").alias("_n"))
    stored = hashed.join(there, "content_hash", "left_semi")
    later = hashed.join(first.filter("_n > 1 AND _first IS NOT NULL"), "content_hash").filter("_key IS NULL OR _key > _first")
    gone = materialize(stored.select("_key", "content_hash").unionByName(later.select("_key", "content_hash")).distinct(), "gone")
    discard(hashed, suspects)
    same = F.instr(gone["content_hash"], file_hash(arrived[content])) > 0
    return arrived.join(gone, arrived[key].eqNullSafe(gone["_key"]) & same, "left_anti")
