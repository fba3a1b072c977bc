import pytest
from pyspark.sql import functions as F

from corpusforge import fixed_values as fixed
from corpusforge.operators import dedupe, manifest, pages, runs
from corpusforge.plans import derived
from corpusforge.settings import Settings

LOG = "seq long, path string, processor string, success boolean, text_chars long, image_count long, seconds double, error string"


def log_of(spark, flags, error=None):
    rows = [(i, f"f{i}", "p", bool(ok), 10, 1, 2.0, None if ok else error) for i, ok in enumerate(flags)]
    return spark.createDataFrame(rows, LOG)


def test_auto_stop_golden(spark):
    log = log_of(spark, [1, 0, 0, 1, 0, 0, 0, 1, 0])
    stop = runs.auto_stop_point(log).first()
    assert (stop["stop_seq"], stop["reason"]) == (6, "consecutive failures")
    assert runs.auto_stop_point(log_of(spark, [1, 0, 0, 1])).first()["stop_seq"] is None
    assert runs.auto_stop_point(log, max_failures=9, max_files=2).first()["stop_seq"] == 3
    assert runs.auto_stop_point(log, max_failures=9, max_seconds=5).first()["stop_seq"] == 2
    quota = runs.auto_stop_point(log_of(spark, [1, 1, 0, 1], "HTTP 429"), max_failures=9).first()
    assert (quota["stop_seq"], quota["reason"]) == (2, "quota exceeded")
    assert runs.auto_stop_point(log_of(spark, [1, 0], "QUOTA"), on_quota=False).first()["reason"] is None


def brute_stop(rows, max_failures, max_files, max_seconds):
    """Row by row: (streak, successes, elapsed) of all rows, and the first row that stops."""
    streak = done = 0
    elapsed, seen, stop = 0.0, [], (None, None)
    for seq, ok, seconds, error in rows:
        streak, done, elapsed = (0 if ok else streak + 1), done + bool(ok), elapsed + seconds
        seen.append((seq, streak, done, elapsed))
        reason = (
            "consecutive failures" if streak >= max_failures
            else "time limit" if max_seconds is not None and elapsed >= max_seconds
            else "file limit" if max_files is not None and done >= max_files
            else "quota exceeded" if not ok and error else None
        )
        if reason and stop[0] is None:
            stop = (seq, reason)
    return seen, stop


def test_segments_equal_a_row_by_row_run(spark):
    """Streaks and stops over many segments, with gaps in the places, equal one pass over all rows."""
    import random

    rng = random.Random(5)
    for trial in range(6):
        places = sorted(rng.sample(range(400), 150))
        rows = [(seq, rng.random() < 0.4, rng.randrange(64) / 64, None) for seq in places]
        rows = [(s, ok, t, "HTTP 429" if not ok and trial == 5 and s > 200 else None) for s, ok, t, _ in rows]
        log = spark.createDataFrame(rows, "seq long, success boolean, seconds double, error string").repartition(5)
        limits = [(3, None, None), (50, 40, None), (50, None, 30.0), (9, 60, 70.0), (50, None, None), (50, None, None)][trial]
        seen, stop = brute_stop(rows, *limits)
        got = runs.failure_streaks(log, part_rows=7).orderBy("seq").collect()
        assert [(r["seq"], r["streak"], r["successes"], r["elapsed"]) for r in got] == seen
        named = dict(zip(("max_failures", "max_files", "max_seconds"), limits))
        for part_rows in (1, 7, 1000):
            assert tuple(runs.auto_stop_point(log, part_rows, **named).first()) == stop, (trial, part_rows)
    assert tuple(runs.auto_stop_point(log.limit(0)).first()) == (None, None)


def test_state_goes_on_from_batch_to_batch(spark):
    flags = [1, 0, 0, 0, 1, 1, 0, 0]
    whole = runs.run_state(log_of(spark, flags, "429"))
    assert whole == runs.RunState(streak=2, max_streak=3, successes=3, elapsed=16.0, quota=True)
    log, state = log_of(spark, flags, "429"), runs.RunState()
    for low, high in ((0, 2), (3, 3), (4, 6), (7, 9)):
        state = runs.run_state(log.filter(F.col("seq").between(low, high)), state)
    assert state == whole
    assert runs.run_state(log.limit(0), whole) == whole
    assert whole.reason() == "consecutive failures" and whole.reason(9, max_seconds=16) == "time limit"
    assert whole.reason(9, max_files=3) == "file limit" and whole.reason(9) == "quota exceeded" and whole.reason(9, on_quota=False) is None


def test_checkpoint_halves(spark):
    log = log_of(spark, [1, 0, 0, 0, 1])
    got = {r["seq"]: r["state"] for r in runs.checkpoint_split(log).collect()}
    assert got == {0: "processed", 1: "processed", 2: "processed", 3: "remaining", 4: "remaining"}
    assert {r["state"] for r in runs.checkpoint_split(log_of(spark, [1, 1])).collect()} == {"processed"}


def test_summary_and_stats(spark):
    log = log_of(spark, [1, 0, 1], "bad")
    assert runs.run_summary(log).first().asDict() == {
        "files_total": 3, "files_successful": 2, "files_failed": 1, "total_text_chars": 20, "total_images": 2,
    }
    assert runs.run_summary(log.limit(0)).first()["total_text_chars"] == 0
    stats = runs.processor_stats(log_of(spark, [0, 0], "bad")).first()
    assert (stats["success_rate"], stats["avg_text_per_file"]) == (0.0, 0.0)
    report = {r["processor"]: r for r in runs.processor_performance(log).collect()}
    assert set(report) == {"p", "*"} and report["*"]["chars_per_second"] == 5.0
    assert [r["seq"] for r in runs.recent_errors(log).collect()] == [1]


def test_retention_goldens(spark):
    def verdicts(rows, max_bytes, days=30):
        df = spark.createDataFrame(rows, "path string, size long, at string").withColumn("accessed_at", F.to_timestamp("at"))
        out = manifest.retention(df, F.lit("2024-02-01").cast("timestamp"), max_bytes, days)
        return {r["path"]: r["verdict"] for r in out.collect()}

    rows = [("a", 3, "2024-01-10"), ("b", 3, "2024-01-11"), ("c", 3, "2024-01-12")]
    assert verdicts(rows, 6) == {"a": "evicted", "b": "kept", "c": "kept"}
    assert verdicts(rows, 100) == {"a": "kept", "b": "kept", "c": "kept"}
    assert verdicts([("old", 50, "2023-12-01"), *rows], 9) == {"old": "expired", "a": "kept", "b": "kept", "c": "kept"}
    assert verdicts([("old", 50, "2023-12-01"), *rows], 9, 0) == {"old": "evicted", "a": "kept", "b": "kept", "c": "kept"}


def test_retention_equals_a_full_order(spark):
    """Cuts inside cells, inside one moment that many rows share, and among rows never used."""
    import random
    from datetime import datetime, timedelta

    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    times = [None, *(start + timedelta(microseconds=rng.choice([0, 1, 5, 10**6, 86_400 * 10**6, 9 * 10**11])) for _ in range(60))]
    rows = [(f"{rng.choice('aé文')}{i}", rng.choice([0, 1, 7, 100]), rng.choice(times)) for i in range(300)]
    store = spark.createDataFrame(rows, "path string, size long, accessed_at timestamp")
    order = sorted(rows, key=lambda r: (r[2] or datetime(1, 1, 1), r[0].encode()), reverse=True)
    total = sum(r[1] for r in rows)
    for max_bytes, cell_rows in [(0, 1), (1, 4), (total // 3, 1), (total // 2, 1000), (total - 1, 2), (total, 5)]:
        expected, newer = {}, 0
        for path, size, _ in order:
            newer += size
            expected[path] = "evicted" if newer > max_bytes else "kept"
        out = manifest.retention(store, F.lit("2024-02-01").cast("timestamp"), max_bytes, 0, cell_rows=cell_rows)
        assert {r["path"]: r["verdict"] for r in out.collect()} == expected, (max_bytes, cell_rows)
    assert manifest.retention(store.limit(0), F.lit("2024-02-01").cast("timestamp"), 5).count() == 0


def test_same_snapshot_has_no_changes(documents):
    files = derived.files_of(documents)
    assert manifest.snapshot_diff(files, files).count() == 0


def test_remaining_and_batches(spark, documents):
    files = derived.files_of(documents).select("path", "length")
    assert manifest.remaining(files, files).count() == 0
    sizes = manifest.assign_batches(files).groupBy("batch_no").count().collect()
    assert sorted(r["batch_no"] for r in sizes) == list(range(1, 21)) and {r["count"] for r in sizes} == {10}


def test_dedupe(documents):
    kept = dedupe.dedupe(documents, "doc_id")
    assert kept.count() == 189 == documents.select("text").distinct().count()
    members, groups = dedupe.duplicate_members(documents, "doc_id"), dedupe.duplicate_groups(documents, "doc_id")
    assert members.count() == groups.agg(F.sum("n_members")).first()[0]


def test_one_content_holding_most_rows(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 700, "same").otherwise(F.col("id").cast("string")).alias("text"))
    assert dedupe.dedupe(docs, "doc_id").count() == 301
    group = dedupe.duplicate_groups(docs, "doc_id").collect()
    assert [(r["n_members"], r["first_member"]) for r in group] == [(700, 0)]


@pytest.mark.parametrize(
    "counts, content_type, strategy, confidence",
    [
        ((10, 0, 0, 4, 500.0), "mixed_content", "mixed_processing", 0.7),
        ((10, 7, 0, 2, 500.0), "mixed_content", "text_primary_mixed", 0.72),
        ((10, 9, 0, 0, 500.0), "text_only", "text_only", 0.9),
        ((10, 1, 8, 0, 20.0), "image_only", "image_heavy", 0.8),
        ((10, 4, 6, 0, 50.0), "scanned_document", "ocr_primary", 0.7),
        ((10, 0, 0, 0, 1.0), "empty", "skip", 0.9),
        ((10, 5, 1, 0, 500.0), "mixed_content", "conservative_mixed", 0.5),
        ((0, 0, 0, 0, 0.0), "empty", "error", 0.0),
    ],
)
def test_document_classes(spark, counts, content_type, strategy, confidence):
    total, text, image, mixed, avg = counts
    share = lambda n: n / total if total else 0.0
    row = [("d", total, text, image, mixed, avg, share(text + mixed), share(image + mixed))]
    df = spark.createDataFrame(row, "path string, total_pages long, text_pages long, image_pages long, mixed_pages long, avg_text_per_page double, text_coverage double, image_coverage double")
    got = pages.classify_document(df).first()
    assert (got["content_type"], got["strategy"]) == (content_type, strategy)
    assert got["confidence"] == pytest.approx(confidence)


def test_assembled_texts_keep_every_page(spark):
    df = spark.range(1, 1201).select(F.lit("d").alias("path"), F.col("id").alias("page_num"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("text"))
    texts = [r["text"] for r in pages.assemble_document(df).collect()]
    assert texts == ["\n\n".join(f"p{i}" for i in range(1, 1201))]


def test_settings_are_checked():
    assert Settings().problems() == []
    for wrong in ({"start_page": 0}, {"end_page": 3, "start_page": 5}, {"chunk_size": 50}, {"overlap": 3000}, {"quality_threshold": 1.5},
                  {"threads": 65}, {"max_workers": 0}, {"timeout": 5}, {"mode": "x"}, {"text_generators": ("poems",)}, {"provider": "local", "model": ""}):
        with pytest.raises(ValueError):
            Settings.of(**wrong)
    with pytest.raises(ValueError, match="unknown settings"):
        Settings.of(nothing=1)


def test_estimates(one):
    assert one(manifest.estimated_seconds(F.lit("a.pdf"), F.lit(1024 * 1024))) == 2.0
    assert one(manifest.processing_estimate(F.lit(".pdf"), F.lit(0), F.lit(10), F.lit("text_only"))) == pytest.approx(10.0)
    assert one(manifest.processing_estimate(F.lit(".epub"), F.lit(0), F.lit(10), F.lit(None).cast("string"), images=False)) == pytest.approx(2.0)
    assert fixed.MAX_FILE_BYTES == 104857600


def test_dedupe_of_repeated_keys(spark):
    def kept(rows):
        return sorted(map(repr, map(tuple, dedupe.dedupe(spark.createDataFrame(rows, "k long, text string"), "k").collect())))

    assert kept([(1, "A"), (2, "A"), (2, "B")]) == [repr((1, "A")), repr((2, "B"))]
    assert kept([(None, "A"), (2, "A"), (None, "C")]) == [repr((2, "A")), repr((None, "C"))]
    assert kept([(1, "A"), (1, "A"), (3, None), (4, None)]) == [repr((1, "A")), repr((1, "A")), repr((3, None)), repr((4, None))]
    assert kept([(None, "A"), (None, "A")]) == [repr((None, "A"))] * 2
    assert kept([]) == []
