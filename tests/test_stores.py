"""Stores larger than what arrives: filters, bucketed joins, kept metrics, books read by member."""

import io
import os
import zipfile

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from corpusforge.operators import dedupe, manifest, stores
from corpusforge.plans import derived
from corpusforge.sources.books import read_books
from corpusforge.sources.files import read_epub
from corpusforge.streaming import corpus


def hashes(spark, low, high):
    return dedupe.with_hash(spark.range(low, high).select(F.concat(F.lit("text "), "id").alias("text")))


@pytest.mark.parametrize("rows,probes", [(1, 1), (1, 4), (3, 4)])
def test_filter_has_no_false_negative(spark, rows, probes):
    known = hashes(spark, 0, 3000)
    whole = stores.content_filter(known, rows, probes)
    parts = stores.merge_filters(stores.content_filter(hashes(spark, 0, 1700), rows, probes), stores.content_filter(hashes(spark, 1500, 3000), rows, probes))
    assert sorted((r["bucket"], bytes(r["bitmap"])) for r in whole.collect()) == sorted((r["bucket"], bytes(r["bitmap"])) for r in parts.collect())
    hits = {r["content_hash"] for r in stores.perhaps_known(hashes(spark, 0, 6000), whole, rows, probes).collect()}
    assert {r["content_hash"] for r in known.collect()} <= hits
    assert len(hits) - 3000 < 3000 * (0.15 if probes == 4 or rows > 1 else 0.2)


def test_a_full_filter_drops_no_row(spark):
    """Every bit set: all arrivals are suspects, and the exact check decides."""
    arrived = [(1, "a"), (2, "b"), (3, "b"), (None, "b"), (4, None), (5, None), (6, "c"), (6, "d"), (7, "d"), (None, "e"), (None, "a")]
    df = spark.createDataFrame(arrived, "k long, text string")
    known = dedupe.with_hash(spark.createDataFrame([("a",), ("c",), ("a",), (None,)], "text string")).select("content_hash")
    full = spark.range(1).select(F.lit(0).cast("long").alias("bucket"), F.unhex(F.lit("FF" * 4096)).alias("bitmap"))
    want = sorted(map(repr, [(2, "b"), (4, None), (5, None), (6, "d"), (None, "e")]))
    for filter_, rows in ((full, 1), (None, None), (None, 2)):
        assert sorted(map(repr, map(tuple, stores.dedupe_arrivals(df, known, "k", filter_=filter_, rows=rows).collect()))) == want
    assert stores.dedupe_arrivals(df.limit(0), known, "k").collect() == []
    assert stores.dedupe_arrivals(df, known.limit(0), "k").count() == 7
    with pytest.raises(ValueError):
        stores.dedupe_arrivals(df, known, "k", filter_=full)


def test_a_bucketed_store_is_joined_as_it_lies(spark, documents):
    files = derived.files_of(documents)
    key = F.md5("path")
    store = files.select(key.alias("cache_key"), F.lit("2.0").alias("version"), "length", "mtime", (F.col("mtime") + F.expr("INTERVAL 2 HOURS")).alias("cached_at"), F.col("content").alias("text"))
    wanted = files.select("path", "length", "mtime", key.alias("cache_key"))
    now = F.lit("2024-01-31 06:00:00").cast("timestamp")
    with stores.bucketed(store, "cache_key", 8) as kept:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            out = manifest.reuse_extractions(wanted, kept, now)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1, plan
            assert sorted(map(repr, out.collect())) == sorted(map(repr, manifest.reuse_extractions(wanted, store, now).collect()))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("store_")]


def test_metrics_are_added_once_per_batch(spark, documents, tmp_path):
    log = derived.run_log_of(documents)
    for i in range(3):
        log.filter(F.col("seq") % 3 == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = str(tmp_path / "table")
    corpus.keep_metrics(stream, table, str(tmp_path / "check")).awaitTermination()
    want = sorted(map(tuple, corpus.stream_metrics(log).collect()))
    assert sorted(map(tuple, corpus.kept_metrics(spark, table).collect())) == want
    # The last batch again, as after a failure between its commit and the stream's own.
    last = max((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    os.remove(last)
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    corpus.keep_metrics(stream, table, str(tmp_path / "check")).awaitTermination()
    assert sorted(map(tuple, corpus.kept_metrics(spark, table).collect())) == want


def test_books_by_member_equal_whole_archives(spark, tmp_path):
    derived.write_books(spark.read.parquet(f"{SMALL}/pages.parquet"), str(tmp_path / "books"), 7)
    for name, content in (("broken.epub", b"no archive"), ("note.txt", b"x")):
        (tmp_path / "books" / name).write_bytes(content)
    (tmp_path / "books" / "deep").mkdir()
    with zipfile.ZipFile(tmp_path / "books" / "deep" / "HALF.EPUB", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="b.opf"/></rootfiles></container>')
        z.writestr("b.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="gone.xhtml" media-type="application/xhtml+xml"/></manifest></package>')
        z.writestr("a.xhtml", "<p>first</p>")
    got = read_books(spark, str(tmp_path / "books"), partitionBytes=20_000)
    assert got.rdd.getNumPartitions() > 1
    files = spark.read.format("binaryFile").load(str(tmp_path / "books")).withColumnRenamed("modificationTime", "mtime")
    plain = F.regexp_replace("path", "^file:", "")
    want = read_epub(files).withColumn("path", plain)
    at = "kind <> 'error' AND path NOT LIKE '%HALF%'"
    assert sorted(map(repr, map(tuple, got.filter(at).collect()))) == sorted(map(repr, map(tuple, want.filter(at).collect())))
    odd = sorted((os.path.basename(r["path"]), r["kind"], r["member_no"]) for r in got.filter(f"NOT ({at})").collect())
    assert odd == [("HALF.EPUB", "chapter", 1), ("HALF.EPUB", "error", None), ("broken.epub", "error", None)]
