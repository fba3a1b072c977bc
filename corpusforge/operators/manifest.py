"""File manifests: facts per file, comparison of snapshots, reuse and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge import fixed_values as fixed
from corpusforge.functions.formats import file_ext, file_name, file_stem
from corpusforge.operators.quality import admission, route_processor
from corpusforge.operators.running import PART_ROWS, OrderedRows, RunningSum, number_rows

MB = 1024 * 1024


def file_manifest(files: DataFrame, content: str | None = None) -> DataFrame:
    """Name, stem, extension, sizes, type and hash for rows of `path`, `length`, `mtime`."""
    path, size = F.col("path"), F.col("length")
    pairs = [F.lit(x) for item in fixed.MIME_BY_EXT.items() for x in item]
    facts = files.select(
        path,
        file_name(path).alias("name"),
        file_stem(path).alias("stem"),
        file_ext(path).alias("ext"),
        size,
        (size / MB).alias("size_mb"),
        (size / (MB * 1024)).alias("size_gb"),
        "mtime",
        F.try_element_at(F.create_map(*pairs), file_ext(path)).alias("mime_type"),
        route_processor(path).alias("processor"),
        *([F.when(size < fixed.MAX_FILE_BYTES, F.md5(content)).alias("md5")] if content else []),
    )
    return facts


def by_type(manifest: DataFrame) -> DataFrame:
    """Files and bytes per extension; the files themselves stay rows of the manifest."""
    return manifest.groupBy("ext").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("length").alias("total_bytes"),
        F.min("path").alias("first_path"),
        F.max("path").alias("last_path"),
    )


def ext_union(manifest: DataFrame) -> DataFrame:
    return manifest.select("ext").distinct()


def dir_size(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"))


def validation_details(manifest: DataFrame, max_bytes: int = fixed.MAX_FILE_BYTES) -> DataFrame:
    return manifest.select(
        "path",
        F.col("ext"),
        (F.col("length") / MB).alias("size_mb"),
        F.col("ext").isin(list(fixed.PROCESSOR_BY_EXT)).alias("supported"),
        (F.col("length") > max_bytes).alias("too_large"),
        admission(F.col("path"), F.col("length"), max_bytes).alias("status"),
    )


def validation_summary(manifest: DataFrame, max_bytes: int = fixed.MAX_FILE_BYTES) -> DataFrame:
    d = validation_details(manifest, max_bytes)
    return d.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if("supported").alias("supported_files"),
        F.count_if(~F.col("supported")).alias("unsupported_files"),
        F.count_if("too_large").alias("large_files"),
        F.sum("size_mb").alias("total_size_mb"),
    )


def sort_files(manifest: DataFrame) -> DataFrame:
    return manifest.orderBy("path")


def limit_files(manifest: DataFrame, n: int = fixed.TEST_MODE_FILES) -> DataFrame:
    """The first `n` paths (a feature of test mode): a bounded top-n, not a full sort."""
    return manifest.orderBy("path").limit(n)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "path", stamp: str = "mtime") -> DataFrame:
    """`added`, `modified` or `deleted` for every path that changed between two listings."""
    a = old.select(key, F.col(stamp).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(key, F.col(stamp).alias("_new"), F.lit(True).alias("_in_new"))
    change = (
        F.when(F.col("_in_old").isNull(), "added")
        .when(F.col("_in_new").isNull(), "deleted")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    )
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter("change IS NOT NULL")


def remaining(manifest: DataFrame, run_log: DataFrame, key: str = "path") -> DataFrame:
    """Files a run has not handled yet."""
    return manifest.join(run_log.select(key), key, "left_anti")


def reuse_extractions(manifest: DataFrame, store: DataFrame, now: Column, max_days: int = fixed.STORE_MAX_DAYS) -> DataFrame:
    """Each file with its stored text, where the stored row still holds for it.

    `store` has one row per `cache_key` with version, length, mtime, cached_at and text. The
    `reuse` column says `valid`, `missing`, or what made the entry stale.
    """
    kept = store.select(
        "cache_key",
        F.col("version").alias("_version"),
        F.col("length").alias("_length"),
        F.col("mtime").alias("_mtime"),
        "cached_at",
        F.col("text").alias("stored_text"),
    )
    age_days = (F.unix_micros(now) - F.unix_micros("cached_at")) / (86400 * 1e6)
    reuse = (
        F.when(F.col("_version").isNull(), "missing")
        .when(F.col("_version") != fixed.STORE_VERSION, "version")
        .when((F.col("_length") != F.col("length")) | (F.col("_mtime") != F.col("mtime")), "changed")
        .when(age_days > max_days, "expired")
        .when(F.col("stored_text").isNull(), "incomplete")
        .otherwise("valid")
    )
    joined = manifest.join(kept, "cache_key", "left").withColumn("reuse", reuse)
    text = F.when(F.col("reuse") == "valid", F.col("stored_text"))
    return joined.withColumn("text", text).drop("_version", "_length", "_mtime", "cached_at", "stored_text")


#: Cells of one histogram of bytes over access time; each round looks into one cell of the last.
RETENTION_CELLS = 65_536
#: Microseconds of the year 1, the place of rows that were never used.
NEVER = -62_135_596_800_000_000


def retention(store: DataFrame, now: Column, max_bytes: float, max_days: int = fixed.STORE_MAX_DAYS, key: str = "path",
              cell_rows: int = PART_ROWS) -> DataFrame:
    """Which stored rows to drop: those not used for `max_days`, then the least recently used
    ones until the rest fits `max_bytes`.

    An entry stays when the entries used at least as recently as itself (ties: those of greater `key`), with
    it, fit. The first row that does not is found by `eviction_cut`; then the store is read once more and
    each row compared with it. `key` must be unique, sizes at least zero; null sizes count nothing, a null
    time is before all others and never expires.
    """
    age_days = (F.unix_micros(now) - F.unix_micros("accessed_at")) / (86400 * 1e6)
    old = F.coalesce(age_days > max_days, F.lit(False)) if max_days > 0 else F.lit(False)
    cut = eviction_cut(store.filter(~old), max_bytes, key, cell_rows)
    verdict = F.when(old, "expired")
    if cut is not None:
        kind = store.schema[key].dataType
        at_cut = F.struct(F.lit(cut[0]).cast("long").alias("at"), F.lit(cut[1]).cast(kind).alias("key"))
        verdict = verdict.when(F.struct(_used().alias("at"), F.col(key).alias("key")) <= at_cut, "evicted")
    return store.withColumn("verdict", verdict.otherwise("kept"))


def _used() -> Column:
    return F.coalesce(F.unix_micros("accessed_at"), F.lit(NEVER))


def eviction_cut(live: DataFrame, max_bytes: float, key: str = "path", cell_rows: int = PART_ROWS) -> tuple | None:
    """Time (microseconds) and key of the most recently used row that does not fit `max_bytes`; None if all fit.

    A selection, no order of the store: the range of access times is cut into cells, bytes are summed per
    cell, and the cell in which the sum of the newest passes `max_bytes` is cut again, until it has at most
    `cell_rows` rows or is one microsecond. Only its rows are ordered; rows of one moment that are more than
    that are ordered in parts.
    """
    rows = live.select(_used().alias("_at"), F.col(key).alias("_key"), F.coalesce("size", F.lit(0)).alias("_size"), "accessed_at")
    low, high, total, n = rows.agg(F.min("_at"), F.max("_at"), F.sum("_size"), F.count(F.lit(1))).first()
    if n == 0 or total <= max_bytes:
        return None
    newer, first = 0, True
    while first or (n > cell_rows and low < high):
        first = False
        width = (high - low) // RETENTION_CELLS + 1
        cells = _between(rows, low, high).groupBy(F.expr(f"(_at - ({low}L)) div {width}L").alias("cell")).agg(
            F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("_at").alias("low"), F.max("_at").alias("high")
        )
        # At most RETENTION_CELLS rows.
        upto = F.sum("bytes").over(Window.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, 0))
        crossed = cells.withColumn("upto", upto + newer).filter(F.col("upto") > max_bytes)
        cell = crossed.orderBy(F.col("cell").desc()).first()
        low, high, n, newer = cell["low"], cell["high"], cell["n"], cell["upto"] - cell["bytes"]
    inside = _between(rows, low, high).select("_at", "_key", "_size")
    order = [F.col("_at").desc(), F.col("_key").desc()]
    if n > cell_rows:
        summed = OrderedRows(inside, [], order).add(_newer=RunningSum(F.col("_size"))).rows
    else:
        summed = inside.withColumn("_newer", F.sum("_size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return tuple(summed.filter(F.col("_newer") + newer > max_bytes).orderBy(*order).select("_at", "_key").first())


def _between(rows: DataFrame, low: int, high: int) -> DataFrame:
    """Rows used in this range; the filter names the stored column, so that a scan can skip what lies outside."""
    used = (F.col("accessed_at") >= F.timestamp_micros(F.lit(low))) & (F.col("accessed_at") <= F.timestamp_micros(F.lit(high)))
    return rows.filter(used | F.col("accessed_at").isNull() if low <= NEVER else used)


def store_stats(store: DataFrame) -> DataFrame:
    mb = F.col("size") / MB
    compressed = F.count_if(F.col("path").endswith(".gz"))
    return store.agg(
        F.count(F.lit(1)).alias("entries"),
        F.round(F.sum(mb), 2).alias("total_mb"),
        F.round(F.avg(mb), 2).alias("avg_mb"),
        compressed.alias("compressed_entries"),
        F.round(compressed / F.count(F.lit(1)), 2).alias("compressed_share"),
    )


def sample_store_types(store: DataFrame, n: int = fixed.STORE_SAMPLE) -> DataFrame:
    """Extensions among the first `n` entries (the report looks at a sample by design)."""
    return store.orderBy("cache_key").limit(n).groupBy(file_ext(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("n_entries"))


def assign_batches(manifest: DataFrame, size: int = fixed.BATCH_SIZE, order: str = "path") -> DataFrame:
    """Consecutive batches of `size` files in path order, numbered from 1."""
    numbered = number_rows(manifest, [], [order], "_n")
    return numbered.withColumn("batch_no", (F.floor((F.col("_n") - 1) / size) + 1).cast("long")).drop("_n")


def estimated_seconds(path: Column, size: Column) -> Column:
    """Planner estimate of one file from its size and extension."""
    rate = F.lit(fixed.DRY_RUN_RATE_OTHER)
    for ext, seconds in fixed.DRY_RUN_RATE.items():
        rate = F.when(file_ext(path) == ext, seconds).otherwise(rate)
    return size / MB * rate


def dry_run_report(manifest: DataFrame, threads: int = 1) -> DataFrame:
    speedup = min(threads, 4) * 0.7 if threads > 1 else 1.0
    return manifest.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum(F.col("length") / MB).alias("total_mb"),
        (F.sum(estimated_seconds(F.col("path"), F.col("length"))) / speedup).alias("estimated_seconds"),
    )


def processing_estimate(
    ext: Column, size: Column, units: Column, page_kind: Column, images: bool = True, ocr: bool = True
) -> Column:
    """Seconds a processor would take: by page kind for PDF, by chapter for EPUB, else by MB."""
    mb = size / MB
    page = F.when(page_kind == "text_only", 0.2).when(page_kind == "image_only", 1.0).when(page_kind == "scanned_document", 2.0).otherwise(0.8)
    extra = (0.3 if images else 0.0) + (0.5 if ocr else 0.0)
    return (
        F.when(ext == ".pdf", units * (page + extra))
        .when(ext == ".epub", units * (0.3 if images else 0.2))
        .when(ext.isin(".png", ".jpg", ".jpeg", ".bmp", ".tiff"), mb * (2.1 if ocr else 0.1))
        .when(ext.isin(".txt", ".srt", ".vtt"), mb * 0.1)
        .otherwise(mb * 1.0)
    )
