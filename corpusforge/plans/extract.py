"""From files to documents: admit, read, clean and judge, with a row for every file."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.formats import file_ext, file_stem
from corpusforge.functions.layout import keep_image
from corpusforge.functions.text import clean_text, remove_header_lines
from corpusforge.operators.manifest import remaining
from corpusforge.operators.quality import admission, min_text_length, quality_status, route_processor
from corpusforge.operators.runs import checkpoint_split
from corpusforge.session import materialize
from corpusforge.settings import Settings
from corpusforge.sources.files import Extractor, epub_text, extract_batch, read_epub, read_text

BUILT_IN = (".txt", ".srt", ".vtt", ".epub")
STATUS_TEXT = {
    "too_large": "File too large",
    "unsupported": "No processor for extension",
    "too_short": "Content quality below threshold",
    "low_quality": "Content quality below threshold",
    "no_content": "Content quality below threshold",
}


def _raw_texts(files: DataFrame, settings: Settings, extractors: list[Extractor]) -> DataFrame:
    """Texts of the files the library reads itself and of the user's extractors."""
    admitted = admission(F.col("path"), F.col("length"), settings.max_file_size, list(BUILT_IN)) == "ok"
    own = files.filter(admitted)
    plain = read_text(own).select("path", "text")
    # Written once: books and broken files are both read from it.
    members = materialize(read_epub(own), "members")
    books = epub_text(members, settings.start_page, settings.end_page, list(settings.skip_pages), settings.min_text_length)
    found = plain.unionByName(books.select("path", "text"))
    ok = found.select("path", "text", F.lit("[]").alias("images"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"))
    broken = members.filter("kind = 'error'").select(
        "path", F.lit("").alias("text"), F.lit("[]").alias("images"), F.lit("error").alias("status"), "error"
    )
    rows = ok.unionByName(broken)
    if extractors:
        exts = [e for x in extractors for e in x.extensions]
        rows = rows.unionByName(extract_batch(files.filter(file_ext(F.col("path")).isin(exts)), extractors, settings.max_file_size))
    return rows


def _kept_images(images: Column, settings: Settings) -> Column:
    """The JSON list without images that are too small, too poor or, if asked for, of one colour.

    An image is an object that may have `area` (or `width` and `height`), `quality_score` and
    `single_color`; what it does not say is not held against it.
    """
    field = lambda image, name, kind: F.get_json_object(image, f"$.{name}").cast(kind)

    def keep(image: Column) -> Column:
        area = F.coalesce(field(image, "area", "double"), field(image, "width", "double") * field(image, "height", "double"))
        return keep_image(area, field(image, "quality_score", "double"), field(image, "single_color", "boolean"), settings.min_image_size, settings.quality_threshold, settings.skip_single_color_images)

    listed = F.from_json(images, "array<string>")
    kept = F.filter(listed, lambda image: ~image.startswith("{") | keep(image))
    written = F.transform(kept, lambda image: F.when(image.startswith("{"), image).otherwise(F.concat(F.lit('"'), image, F.lit('"'))))
    same = listed.isNull() | (F.size(kept) == F.size(listed))
    return F.when(same, images).otherwise(F.concat(F.lit("["), F.array_join(written, ","), F.lit("]")))


def extract_documents(files: DataFrame, settings: Settings = Settings(), extractors: list[Extractor] | None = None) -> DataFrame:
    """One row per file: path, stem, processor, cleaned text, images, `status` and `error`.

    `status` is `ok` or says why the file has no text: too_large, unsupported, too_short,
    low_quality, no_content or error.
    """
    extractors = extractors or []
    supported = [*BUILT_IN, *(e for x in extractors for e in x.extensions)]
    admitted = admission(F.col("path"), F.col("length"), settings.max_file_size, supported)
    listed = files.select("path", "length", "mtime", admitted.alias("_admitted"))
    text = remove_header_lines(min_text_length(F.col("text"), settings.min_text_length), settings.header_regex)
    read = _raw_texts(files, settings, extractors).withColumn("text", clean_text(text)).withColumn("images", _kept_images(F.col("images"), settings))
    has_images = F.when(F.col("images") != "[]", 1).otherwise(0)
    verdict = quality_status(F.col("text"), settings.min_text_length, settings.quality_threshold, has_images)
    judged = read.withColumn("status", F.when(F.col("status") == "ok", verdict).otherwise(F.col("status")))
    joined = listed.join(judged, "path", "left")
    status = F.when(F.col("_admitted") != "ok", F.col("_admitted")).otherwise(F.coalesce("status", F.lit("no_content")))
    pairs = [F.lit(x) for item in STATUS_TEXT.items() for x in item]
    return joined.select(
        "path",
        file_stem(F.col("path")).alias("stem"),
        route_processor(F.col("path")).alias("processor"),
        "length",
        "mtime",
        F.when(status == "ok", F.col("text")).otherwise("").alias("text"),
        F.coalesce("images", F.lit("[]")).alias("images"),
        status.alias("status"),
        F.coalesce("error", F.try_element_at(F.create_map(*pairs), status)).alias("error"),
    )


def run_log(documents: DataFrame, seconds: str | None = None) -> DataFrame:
    """The run log of extracted documents; a row counts as a success only with status `ok`."""
    ok = F.col("status") == "ok"
    return documents.select(
        "path",
        "processor",
        ok.alias("success"),
        F.length("text").cast("long").alias("text_chars"),
        F.size(F.from_json("images", "array<string>")).cast("long").alias("image_count"),
        (F.col(seconds) if seconds else F.lit(0.0)).alias("seconds"),
        F.when(~ok, F.col("error")).alias("error"),
    )


def resume(files: DataFrame, log: DataFrame, run: Callable[[DataFrame], DataFrame], **limits) -> DataFrame:
    """The log of a stopped run that goes on, with `run` telling `before` from `resumed`.

    What the log holds before the row that stopped it stays; `run` handles all other files (rows with a `path`) and
    returns their log. A log that never met its limits keeps all its rows. Files handled before, failed
    or not, are not handled again.
    """
    done = checkpoint_split(log, **limits).filter("state = 'processed'").select("seq", "path")
    kept = log.join(done.select("seq"), "seq", "left_semi").withColumn("run", F.lit("before"))
    return kept.unionByName(run(remaining(files, done)).withColumn("run", F.lit("resumed")))
