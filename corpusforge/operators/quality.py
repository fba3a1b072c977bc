"""Gates that keep, blank or drop documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge import fixed_values as fixed
from corpusforge.functions.formats import file_ext
from corpusforge.functions.text import WS, has_length, has_words, is_blank, text_quality, word_count


def min_text_length(text: Column, n: int = fixed.MIN_TEXT_LENGTH) -> Column:
    """Blank the text when its stripped form is shorter than `n`. Comes before cleaning."""
    return F.when(~has_length(text, n), F.lit("")).otherwise(text)


def quality_status(
    text: Column,
    min_length: int = fixed.MIN_TEXT_LENGTH,
    threshold: float = fixed.QUALITY_THRESHOLD,
    valid_images: Column | None = None,
    allow_low: bool = False,
) -> Column:
    """`ok`, or why the document fails: `too_short`, `low_quality`, `no_content`."""
    images = F.lit(0) if valid_images is None else valid_images
    status = (
        F.when(~has_length(text, min_length), "too_short")
        .when(text_quality(text) < threshold, "low_quality")
        .when(is_blank(text) & (images == 0), "no_content")
        .otherwise("ok")
    )
    return F.lit("ok") if allow_low else status


def quality_gate(docs: DataFrame, text: str = "text", **rules) -> DataFrame:
    return docs.filter(quality_status(F.col(text), **rules) == "ok")


def simple_extraction_check(text: Column, min_length: int = fixed.MIN_TEXT_LENGTH) -> Column:
    """Long enough, at least 10 words, words of 15 characters or fewer on average."""
    words = F.split(text, f"[{WS}]+", -1)
    count = word_count(text)
    return has_length(text, min_length) & has_words(text, 10) & (F.length(F.array_join(words, "")) <= count * 15)


def admission(path: Column, size: Column, max_bytes: int = fixed.MAX_FILE_BYTES, extensions: list[str] | None = None) -> Column:
    """`ok`, or why a file is not taken: `missing`, `too_large`, `unsupported`."""
    supported = list(fixed.PROCESSOR_BY_EXT) if extensions is None else extensions
    return (
        F.when(size.isNull(), "missing")
        .when(size > max_bytes, "too_large")
        .when(~file_ext(path).isin(supported), "unsupported")
        .otherwise("ok")
    )


def route_processor(path: Column, routes: dict[str, str] | None = None) -> Column:
    """Processor of a file by its extension. The map is settings, so no join is needed."""
    pairs = [F.lit(x) for item in (routes or fixed.PROCESSOR_BY_EXT).items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), file_ext(path)), F.lit("unsupported"))


def page_filter(pages: DataFrame, start: int = 1, end: int | None = None, skip: list[int] | None = None, page: str = "page_num") -> DataFrame:
    """Pages or chapters from `start` to `end` (null: the last), without the skipped ones."""
    keep = F.col(page) >= start
    if end is not None:
        keep = keep & (F.col(page) <= end)
    if skip:
        keep = keep & ~F.col(page).isin(list(skip))
    return pages.filter(keep)


def filter_by_quality(items: DataFrame, score: str = "quality_score", threshold: float = fixed.QUALITY_THRESHOLD) -> DataFrame:
    """Keep items that score at least `threshold`; an unknown score counts as 1."""
    return items.filter(F.coalesce(F.col(score), F.lit(1.0)) >= threshold)


def join_labels(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Attach labels; documents without one are kept. `key` is unique in `labels`."""
    return docs.join(labels, key, "left")
