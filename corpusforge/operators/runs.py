"""Run logs: stopping, resuming, progress and reports. One row per handled file, ordered by `seq`."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge import fixed_values as fixed
from corpusforge.operators.running import PART, PART_ROWS, OrderedRows, RowNumber, RunningSum


@dataclass(frozen=True)
class RunState:
    """Where a run stands after the rows seen so far; one row, whatever the size of the log."""

    streak: int = 0
    max_streak: int = 0
    successes: int = 0
    elapsed: float = 0.0
    quota: bool = False

    def reason(self, max_failures: int = fixed.MAX_CONSECUTIVE_FAILURES, max_files: int | None = None,
               max_seconds: float | None = None, on_quota: bool = True) -> str | None:
        """Why the run should not go on under these limits."""
        if self.max_streak >= max_failures:
            return "consecutive failures"
        if max_seconds is not None and self.elapsed >= max_seconds:
            return "time limit"
        if max_files is not None and self.successes >= max_files:
            return "file limit"
        return "quota exceeded" if on_quota and self.quota else None


def _segments(run_log: DataFrame, part_rows: int) -> DataFrame:
    """The log in segments of `part_rows` places, with row number, successes, seconds and the row number of
    the last success inside the segment. `seq` is the place in the run, so a segment has at most as many rows."""
    span = Window.partitionBy(PART).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ok = F.coalesce(F.col("success"), F.lit(False))
    counted = run_log.withColumn(PART, F.floor(F.col("seq") / part_rows)).select(
        "*",
        F.count(F.lit(1)).over(span).alias("_n"),
        F.sum(ok.cast("long")).over(span).alias("_ok"),
        F.sum("seconds").over(span).alias("_seconds"),
    )
    return counted.withColumn("_last_ok", F.max(F.when(ok, F.col("_n"))).over(span))


def _carried(segments: DataFrame, *more: Column) -> DataFrame:
    """One row per segment: what the segments before it add up to, and `more` aggregates of its own rows.

    Summaries combine in order: rows, successes and seconds add, the last success is the greatest
    place of any. They are as many as segments and the only thing that comes together in one task.
    """
    own = segments.groupBy(PART).agg(
        F.max("_n").alias("_rows"), F.max("_ok").alias("_oks"), F.sum("seconds").alias("_took"), F.max("_last_ok").alias("_at"), *more
    )
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    start = {"_rows_before": "_rows", "_ok_before": "_oks", "_seconds_before": "_took"}
    summed = own.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name) for name, c in start.items()])
    return summed.withColumn("_last_before", F.max(F.col("_rows_before") + F.col("_at")).over(before))


def failure_streaks(run_log: DataFrame, start: RunState = RunState(), part_rows: int = PART_ROWS) -> DataFrame:
    """The log with `streak` (failures in a row up to here), `successes` and `elapsed` so far,
    going on from `start`. The rows move once; nothing is staged."""
    segments = _segments(run_log, part_rows)
    # At most one row per segment.
    before = F.broadcast(_carried(segments).select(F.col(PART).alias("_of"), "_rows_before", "_ok_before", "_seconds_before", "_last_before"))
    rows = segments.join(before, F.col(PART).eqNullSafe(F.col("_of")))
    place = F.col("_rows_before") + F.col("_n")
    last_ok = F.coalesce(F.col("_rows_before") + F.col("_last_ok"), "_last_before", F.lit(-start.streak))
    return rows.select(
        *run_log.columns,
        (place - last_ok).alias("streak"),
        (F.col("_ok_before") + F.col("_ok") + start.successes).alias("successes"),
        (F.col("_seconds_before") + F.col("_seconds") + start.elapsed).alias("elapsed"),
    )


def run_state(run_log: DataFrame, start: RunState = RunState()) -> RunState:
    """The state after these rows (an aggregate of one row, read by the driver)."""
    last = failure_streaks(run_log.select("seq", "success", "seconds", "error"), start).agg(
        F.max_by("streak", "seq").alias("streak"),
        F.max("streak").alias("max_streak"),
        F.max("successes").alias("successes"),
        F.max("elapsed").alias("elapsed"),
        F.max(~F.col("success") & _mentions_quota()).alias("quota"),
    ).first()
    if last["streak"] is None:
        return start
    return RunState(
        last["streak"], max(start.max_streak, last["max_streak"]), last["successes"], last["elapsed"], start.quota or last["quota"]
    )


def _mentions_quota() -> Column:
    message = F.lower(F.coalesce(F.col("error"), F.lit("")))
    quota = F.lit(False)
    for word in fixed.QUOTA_WORDS:
        quota = quota | message.contains(word)
    return quota


def stop_reason(max_failures: int = fixed.MAX_CONSECUTIVE_FAILURES, max_files: int | None = None, max_seconds: float | None = None,
                on_quota: bool = True) -> Column:
    """Why a run would stop after a row, null to go on. Limits come before the quota message."""
    reason = F.when(F.col("streak") >= max_failures, "consecutive failures")
    if max_seconds is not None:
        reason = reason.when(F.col("elapsed") >= max_seconds, "time limit")
    if max_files is not None:
        reason = reason.when(F.col("successes") >= max_files, "file limit")
    return reason.when(~F.col("success") & _mentions_quota(), "quota exceeded") if on_quota else reason


def stopping_segment(run_log: DataFrame, part_rows: int = PART_ROWS, max_failures: int = fixed.MAX_CONSECUTIVE_FAILURES,
                     max_files: int | None = None, max_seconds: float | None = None, on_quota: bool = True) -> DataFrame:
    """The first segment in which some row stops the run, with the sums before it: one row or none.

    What a segment needs for that: its failures before the first success (they continue the streak from
    before), its longest streak after one, its greatest running time, its successes, and any quota message.
    """
    segments = _segments(run_log, part_rows)
    carried = _carried(
        segments,
        F.count_if(F.col("_last_ok").isNull()).alias("_prefix"),
        F.coalesce(F.max(F.col("_n") - F.col("_last_ok")), F.lit(0)).alias("_longest"),
        F.max("_seconds").alias("_reached"),
        F.coalesce(F.max(~F.col("success") & _mentions_quota()), F.lit(False)).alias("_quota"),
    )
    streak = F.col("_rows_before") - F.coalesce("_last_before", F.lit(0))
    longest = F.greatest("_longest", F.when(F.col("_prefix") > 0, streak + F.col("_prefix")))
    stops = longest >= max_failures
    if max_seconds is not None:
        stops = stops | F.coalesce(F.col("_seconds_before") + F.col("_reached") >= max_seconds, F.lit(False))
    if max_files is not None:
        stops = stops | (F.col("_ok_before") + F.col("_oks") >= max_files)
    if on_quota:
        stops = stops | F.col("_quota")
    first = carried.filter(stops).agg(
        *[F.min_by(c, PART).alias(c) for c in (PART, "_ok_before", "_seconds_before")], F.min_by(streak, PART).alias("_streak")
    )
    return first.filter(F.col(PART).isNotNull())


def auto_stop_point(run_log: DataFrame, part_rows: int = PART_ROWS, **limits) -> DataFrame:
    """The first row that stops the run, as one row of `stop_seq` and `reason`; nulls if none.

    Summaries of segments tell which one holds it (one row for the driver); then only that segment is read again."""
    needed = run_log.select("seq", "success", "seconds", "error")
    found = stopping_segment(needed, part_rows, **limits).first()
    if found is None:
        return run_log.sparkSession.range(1).select(F.lit(None).cast(run_log.schema["seq"].dataType).alias("stop_seq"), F.lit(None).cast("string").alias("reason"))
    start = RunState(found["_streak"], successes=found["_ok_before"], elapsed=found["_seconds_before"])
    low = found[PART] * part_rows
    segment = needed.filter((F.col("seq") >= low) & (F.col("seq") < low + part_rows))
    marked = failure_streaks(segment, start, part_rows).withColumn("reason", stop_reason(**limits)).filter("reason IS NOT NULL")
    return marked.agg(F.min("seq").alias("stop_seq"), F.min_by("reason", "seq").alias("reason"))


def checkpoint_split(run_log: DataFrame, **limits) -> DataFrame:
    """`processed` before the stopping row, `remaining` from it on."""
    stop = auto_stop_point(run_log, **limits).select("stop_seq").scalar()
    state = F.when(stop.isNull() | (F.col("seq") < stop), "processed").otherwise("remaining")
    return run_log.select("seq", "path", state.alias("state"))


def run_summary(run_log: DataFrame) -> DataFrame:
    """Totals of a run. Files and errors stay rows (`run_files`, `run_errors`)."""
    ok = F.col("success")
    return run_log.agg(
        F.count(F.lit(1)).alias("files_total"),
        F.count_if(ok).alias("files_successful"),
        F.count_if(~ok).alias("files_failed"),
        F.coalesce(F.sum(F.when(ok, F.col("text_chars"))), F.lit(0)).alias("total_text_chars"),
        F.coalesce(F.sum(F.when(ok, F.col("image_count"))), F.lit(0)).alias("total_images"),
    )


def run_files(run_log: DataFrame) -> DataFrame:
    return run_log.filter("success").select("path", "text_chars", "image_count")


def run_errors(run_log: DataFrame) -> DataFrame:
    return run_log.filter(~F.col("success")).select("seq", "path", "error")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def processor_performance(run_log: DataFrame) -> DataFrame:
    """Speed per processor over successful files, and the overall row (processor `*`)."""
    n, seconds, chars = F.count(F.lit(1)), F.sum("seconds"), F.sum("text_chars")
    report = run_log.filter("success").rollup("processor").agg(
        n.alias("files"),
        F.sum("seconds").alias("total_seconds"),
        _ratio(seconds, n).alias("avg_seconds"),
        _ratio(chars, n).alias("avg_chars"),
        _ratio(chars, seconds).alias("chars_per_second"),
        F.sum("image_count").alias("images"),
        F.grouping("processor").alias("_all"),
    )
    return report.withColumn("processor", F.when(F.col("_all") == 1, "*").otherwise(F.col("processor"))).drop("_all")


def processor_stats(run_log: DataFrame) -> DataFrame:
    ok = F.col("success")
    n, good = F.count(F.lit(1)), F.count_if(ok)
    return run_log.groupBy("processor").agg(
        n.alias("files_processed"),
        good.alias("files_successful"),
        _ratio(good, n).alias("success_rate"),
        _ratio(F.sum("seconds"), n).alias("avg_seconds"),
        _ratio(F.sum(F.when(ok, F.col("text_chars"))), good).alias("avg_text_per_file"),
        _ratio(F.sum(F.when(ok, F.col("image_count"))), good).alias("avg_images_per_file"),
    )


def slowest_files(run_log: DataFrame, n: int = fixed.SLOWEST_FILES) -> DataFrame:
    return run_log.filter("success").orderBy(F.col("seconds").desc(), "path").limit(n).select("path", "seconds")


def recent_errors(run_log: DataFrame, n: int = fixed.RECENT_ERRORS) -> DataFrame:
    return run_errors(run_log).orderBy(F.col("seq").desc()).limit(n)


def batch_totals(batched_log: DataFrame) -> DataFrame:
    """Results per batch and over all batches (`batch_no` 0). Success means no failure."""
    ok = F.col("success")
    totals = batched_log.rollup("batch_no").agg(
        F.count(F.lit(1)).alias("files_processed"),
        F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"),
        F.sum(F.when(ok, F.col("text_chars")).otherwise(0)).alias("total_text_chars"),
        F.grouping("batch_no").alias("_all"),
    )
    batch = F.when(F.col("_all") == 1, 0).otherwise(F.col("batch_no"))
    return totals.withColumn("batch_no", batch).withColumn("all_ok", F.col("failed") == 0).drop("_all")


def progress(run_log: DataFrame) -> DataFrame:
    """After each file: share done, totals so far, mean seconds, and seconds left."""
    total = run_log.agg(F.count(F.lit(1))).scalar()
    ordered = OrderedRows(run_log.select("seq", "success", "seconds", "text_chars"), [], ["seq"]).add(
        processed=RowNumber(),
        completed=RunningSum(F.col("success").cast("long")),
        chars=RunningSum(F.when(F.col("success"), F.col("text_chars")).otherwise(0)),
        elapsed=RunningSum(F.col("seconds")),
    )
    rows = ordered.rows
    mean = F.col("elapsed") / F.col("processed")
    return rows.select(
        "seq",
        "processed",
        "completed",
        "chars",
        "elapsed",
        (F.col("processed") / total * 100).alias("percent"),
        mean.alias("avg_seconds"),
        (mean * (total - F.col("processed"))).alias("eta_seconds"),
    )
