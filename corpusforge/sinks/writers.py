"""Writing datasets: JSON Lines, JSON, CSV, text, Markdown, XML, per file and merged."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.operators.items import item_schemas, typed_columns
from corpusforge.operators.render import csv_columns, render_blocks

FORMATS = ("jsonl", "json", "csv", "txt", "markdown", "xml")
# --- Fixed values: formats chosen by file suffix -----------------------------------------
FORMAT_BY_SUFFIX = {".jsonl": "jsonl", ".json": "json", ".csv": "csv", ".txt": "txt", ".md": "markdown", ".xml": "xml"}


# Values as they are, white space at their ends too.
CSV = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
# Overwriting replaces the keys that are written, and no other.
OVERWRITE = {"partitionOverwriteMode": "dynamic"}


def choose_format(configured: str | None = None, path: str | None = None, kind: str | None = None) -> str:
    """The configured format, else that of the file suffix, else one named like the kind, else JSON Lines."""
    if configured:
        if configured not in FORMATS:
            raise ValueError(f"unknown format: {configured}")
        return configured
    suffix = PurePosixPath(path).suffix.lower() if path else ""
    return FORMAT_BY_SUFFIX.get(suffix) or (kind if kind in FORMATS else "jsonl")


def write_jsonl(items: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "append") -> None:
    """One JSON object per line, non-ASCII characters as they are."""
    writer = items.write.mode(mode).options(**OVERWRITE).option("ignoreNullFields", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def write_csv(items: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "append") -> None:
    """Columns in name order with a header in every part file; nested values as JSON."""
    writer = csv_columns(items).write.mode(mode).options(**OVERWRITE).options(**CSV)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_typed_csv(items: DataFrame, path: str, generators: list[str], mode: str = "append") -> None:
    """A CSV folder per generator, its columns and types taken from the items themselves (`item_schemas`)."""
    for generator, (schema, loose) in item_schemas(items, generators).items():
        write_csv(typed_columns(items, generator, schema, loose), f"{path}/{generator}", mode=mode)


def write_xml(items: DataFrame, path: str, root: str, row: str, mode: str = "append") -> None:
    """Rows as XML elements; fields named `_x` become attributes."""
    items.write.mode(mode).format("xml").options(rootTag=root, rowTag=row).save(path)


def write_documents(blocks: DataFrame, path: str, keys: list[str], mode: str = "append") -> None:
    """Rendered documents: a folder per key, whose part files in name order are the document.

    Range partitioning on keys and block number keeps blocks in order and splits a huge
    document over several part files.
    """
    ordered = blocks.repartitionByRange(*keys, "block_no").sortWithinPartitions(*keys, "block_no")
    ordered.select(*keys, F.col("block").alias("value")).write.mode(mode).options(**OVERWRITE).partitionBy(*keys).text(path)


# Writers of a whole dataset by format name: items, path and keys. Any other name is a document
# format; add an entry for a sink of your own.
WRITERS = {"jsonl": write_jsonl, "csv": write_csv}


def messages_as_rows(items: DataFrame) -> DataFrame:
    """Conversations as one row per message, as CSV has them; other columns are repeated."""
    kept = [c for c in items.columns if c != "messages"]
    rows = items.select(*kept, F.size("messages").alias("conversation_length"), F.posexplode("messages").alias("message_index", "_m"))
    return rows.select(*kept, "message_index", "_m.role", "_m.content", "conversation_length")


def write_items(items: DataFrame, path: str, kind: str, fmt: str, keys: list[str], mode: str = "append") -> None:
    """Write items per document in a dataset format of `WRITERS` or a document format."""
    if fmt == "csv" and kind == "conversations" and "messages" in items.columns:
        items = messages_as_rows(items)
    if fmt in WRITERS:
        # Items of a document next to each other, so that it becomes one file and not one per
        # task; the item number in the key lets a huge document spread over several.
        near = [*keys, *(["item_no"] if "item_no" in items.columns else [])]
        WRITERS[fmt](items.repartitionByRange(*near), path, keys, **({} if mode == "append" else {"mode": mode}))
    else:
        write_documents(render_blocks(items, keys, kind, fmt), path, keys, mode)


def write_per_file_and_final(items: DataFrame, base: str, batch: str, kind: str, formats: list[str], stem: str = "stem") -> None:
    """Per source file and merged outputs of one generator.

    Per-file rows land in `data/<batch>/<format>/<generator>/stem=<stem>/`, where a later run replaces
    those of the files it has; the merged dataset `final_<generator>` exists for JSON Lines and
    CSV and is appended to.
    """
    for fmt in formats:
        root = f"{base}/data/{batch}/{fmt}"
        write_items(items, f"{root}/{kind}", kind, fmt, [stem], "overwrite")
        merged = items.drop(stem, "item_no")
        if fmt == "jsonl":
            write_jsonl(merged, f"{root}/final_{kind}")
        elif fmt == "csv":
            write_csv(merged, f"{root}/final_{kind}")


def write_run_summary(summary: DataFrame, base: str, name: str = "summary_results", stamp: str = "") -> str:
    """The one-row summary as a single JSON file in a folder of its own."""
    path = f"{base}/{name}_{stamp}" if stamp else f"{base}/{name}"
    summary.coalesce(1).write.mode("overwrite").json(path)
    return path


def write_run_log(run_log: DataFrame, path: str) -> None:
    """Append the metadata row of each handled file."""
    run_log.withColumn("processed_at", F.current_timestamp()).write.mode("append").parquet(path)


def write_validation_report(summary: DataFrame, details: DataFrame, base: str) -> None:
    summary.coalesce(1).write.mode("overwrite").json(f"{base}/validation_summary")
    details.write.mode("overwrite").json(f"{base}/validation_details")


def preview(items: DataFrame, n: int = 5) -> None:
    items.show(n, truncate=80)
