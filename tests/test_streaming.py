import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from corpusforge.operators import dedupe
from corpusforge.plans import derived
from corpusforge.streaming import corpus


@pytest.fixture
def arrivals(documents, tmp_path):
    """The documents as several files."""
    path = str(tmp_path / "in")
    documents.repartition(5, "doc_id").write.parquet(path)
    return path


def test_stream_gives_the_batch_result(spark, documents, arrivals, tmp_path):
    stream = corpus.stream_table(spark, arrivals, documents.schema, "*.parquet", max_files=2)
    corpus.append_to(corpus.corpus_chunks(stream, ["doc_id"]), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = corpus.corpus_chunks(documents, ["doc_id"])
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_only_new_files_are_read(spark, documents, tmp_path):
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for part in documents.randomSplit([0.5, 0.5], 1):
        part.write.mode("append").parquet(source)
        stream = corpus.stream_table(spark, source, documents.schema, "*.parquet")
        corpus.append_to(stream.select("doc_id"), out, cp).awaitTermination()
    assert spark.read.parquet(out).count() == documents.count()


@pytest.mark.parametrize("spread_by", [None, "doc_id"])
def test_stream_dedupe_over_batches(spark, documents, arrivals, tmp_path, spread_by):
    stream = corpus.stream_table(spark, arrivals, documents.schema, "*.parquet", max_files=1)
    first = corpus.stream_dedupe(stream, F.col("text"), F.col(spread_by) if spread_by else None).select("content_hash")
    corpus.append_to(first, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.distinct().count() == dedupe.dedupe(documents, "doc_id").count()


def test_stream_dedupe_with_event_time(spark, documents, arrivals, tmp_path):
    stream = corpus.stream_table(spark, arrivals, documents.schema, "*.parquet", max_files=1)
    timed = stream.withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    first = corpus.stream_dedupe(timed, F.col("text"), F.col("doc_id"), event_time="at").select("content_hash")
    corpus.append_to(first, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 189


def test_stream_dedupe_forgets_after_the_delay(spark, tmp_path):
    """A copy within the delay goes, one long after comes again, one older than the watermark is late and goes."""
    source = str(tmp_path / "in")
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    days = [("a", 1, 1), ("a", 1, 2), ("b", 9, 3), ("a", 9, 4), ("c", 2, 5)]
    got = []
    for text, day, number in days:
        row = spark.createDataFrame([(text, number)], "text string, doc_id long")
        row.withColumn("at", F.make_timestamp(*map(F.lit, (2024, 1, day, 0, 0, 0)))).coalesce(1).write.mode("append").parquet(source)
        stream = corpus.stream_table(spark, source, spark.read.parquet(source).schema, "*.parquet", max_files=1)
        first = corpus.stream_dedupe(stream, F.col("text"), F.col("doc_id"), event_time="at", delay="1 day").select("doc_id")
        corpus.append_to(first, out, cp).awaitTermination()
        got.append(sorted(r[0] for r in spark.read.parquet(out).collect()))
    assert got == [[1], [1], [1, 3], [1, 3, 4], [1, 3, 4]]


def test_stream_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.txt").write_text(f"file {i}")
    (tmp_path / "in" / "x.bin").write_text("no")
    stream = corpus.stream_files(spark, str(tmp_path / "in"), "*.txt").select("path", F.col("content").cast("string").alias("text"))
    corpus.append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"file 0", "file 1", "file 2"}


def test_stream_metrics(spark, documents, tmp_path):
    log = derived.run_log_of(documents)
    path = str(tmp_path / "in")
    log.repartition(3).write.parquet(path)
    stream = corpus.stream_table(spark, path, log.schema, "*.parquet", max_files=1)
    query = corpus.stream_metrics(stream).writeStream.outputMode("complete").format("memory").queryName("metrics").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {tuple(r) for r in spark.table("metrics").collect()}
    assert got == {tuple(r) for r in corpus.stream_metrics(log).collect()}


def test_auto_stop_refuses_the_next_batch_and_loses_nothing(spark, tmp_path):
    schema = "seq long, path string, success boolean, seconds double, error string"
    source, table = tmp_path / "in", str(tmp_path / "log")
    for i, flags in enumerate(([1, 0, 0], [0, 1, 1], [1, 1, 1])):
        rows = [(3 * i + j, f"f{3 * i + j}", bool(ok), 1.0, None) for j, ok in enumerate(flags)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))

    def start(**limits):
        stream = corpus.stream_table(spark, str(source), spark.createDataFrame([], schema).schema, "*.parquet", max_files=1)
        sink = lambda batch, batch_id: batch.write.mode("append").parquet(table)
        return corpus.run_with_auto_stop(stream, sink, str(tmp_path / "state"), str(tmp_path / "cp"), **limits)

    with pytest.raises(StreamingQueryException, match="consecutive failures"):
        start().awaitTermination()
    assert spark.read.parquet(table).count() == 6
    start(max_failures=99).awaitTermination()
    assert sorted(r["seq"] for r in spark.read.parquet(table).collect()) == list(range(9))
