"""Page tables: what a page holds, what kind of document its pages make, and reassembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge import fixed_values as fixed
from corpusforge.functions.layout import resolution_class
from corpusforge.functions.text import is_meaningful_text, strip, word_count


def analyze_pages(pages: DataFrame) -> DataFrame:
    """Text and image facts of each page of `path, page_num, text, image_count, image_areas`."""
    body = strip(F.col("text"))
    chars, words = F.length(body), word_count(body)
    meaningful = (
        (chars >= fixed.MIN_PAGE_CHARS) & (words >= fixed.MIN_PAGE_WORDS) & is_meaningful_text(F.col("text"))
    )
    return pages.select(
        "path",
        "page_num",
        chars.alias("text_length"),
        words.alias("word_count"),
        meaningful.alias("has_meaningful_text"),
        (F.col("image_count") > 0).alias("has_images"),
        "image_count",
        F.size(F.filter("image_areas", lambda a: F.coalesce(a > fixed.SIGNIFICANT_IMAGE_AREA, F.lit(True)))).alias(
            "significant_images"
        ),
        (chars / F.greatest(F.col("image_count"), F.lit(1))).alias("text_to_image_ratio"),
    )


def document_coverage(page_info: DataFrame) -> DataFrame:
    """Page counts and coverages per document; partial sums keep a huge document cheap."""
    text, images = F.col("has_meaningful_text"), F.col("has_images")
    counts = page_info.groupBy("path").agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.count_if(text & ~images).alias("text_pages"),
        F.count_if(~text & images).alias("image_pages"),
        F.count_if(text & images).alias("mixed_pages"),
        F.avg("text_length").alias("avg_text_per_page"),
        F.sum("image_count").alias("total_images"),
    )
    total = F.col("total_pages")
    return counts.withColumns(
        {
            "text_coverage": (F.col("text_pages") + F.col("mixed_pages")) / total,
            "image_coverage": (F.col("image_pages") + F.col("mixed_pages")) / total,
        }
    )


def classify_document(coverage: DataFrame) -> DataFrame:
    """Content type, strategy and confidence of each document, by the first rule that holds."""
    text, image = F.col("text_coverage"), F.col("image_coverage")
    mixed = F.col("mixed_pages") / F.col("total_pages")

    def verdict(kind: str, strategy: str, confidence: Column) -> Column:
        return F.struct(F.lit(kind).alias("content_type"), F.lit(strategy).alias("strategy"), confidence.cast("double").alias("confidence"))

    choice = (
        F.when(F.coalesce(F.col("total_pages"), F.lit(0)) == 0, verdict("empty", "error", F.lit(0.0)))
        .when(mixed > 0.3, verdict("mixed_content", "mixed_processing", F.least(F.lit(0.9), mixed + 0.3)))
        .when((text > 0.7) & (image > 0.1), verdict("mixed_content", "text_primary_mixed", text * 0.8))
        .when((text > 0.8) & (image < 0.2), verdict("text_only", "text_only", text))
        .when((image > 0.6) & (text < 0.3), verdict("image_only", "image_heavy", image))
        .when((text < 0.5) & (image > 0.5) & (F.col("avg_text_per_page") < 100), verdict("scanned_document", "ocr_primary", F.lit(0.7)))
        .when((text < 0.1) & (image < 0.1), verdict("empty", "skip", F.lit(0.9)))
        .otherwise(verdict("mixed_content", "conservative_mixed", F.lit(0.5)))
    )
    return coverage.withColumn("_v", choice).select("*", "_v.content_type", "_v.strategy", "_v.confidence").drop("_v")


def document_stats(pages: DataFrame) -> DataFrame:
    chars, images = F.length("text"), F.col("image_count")
    return pages.groupBy("path").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.sum(chars).alias("total_text_length"),
        F.sum(images).alias("total_images"),
        F.avg(chars).alias("avg_text_per_page"),
        F.avg(images).alias("avg_images_per_page"),
    )


def page_image_quality(images: DataFrame) -> DataFrame:
    """Counts by resolution class and the mean area for the images of each page."""
    kind = resolution_class(F.col("area"))
    stats = images.groupBy("path", "page_num").agg(
        F.count(F.lit(1)).alias("total_images"),
        F.count_if(kind == "high").alias("high"),
        F.count_if(kind == "medium").alias("medium"),
        F.count_if(kind == "low").alias("low"),
        F.avg("area").alias("average_resolution"),
    )
    dominant = (
        F.when(F.col("high") > F.col("medium") + F.col("low"), "high_quality")
        .when(F.col("medium") > F.col("low"), "medium_quality")
        .when(F.col("low") > 0, "low_quality")
        .otherwise("none")
    )
    vector = F.col("average_resolution") > 1000000
    return stats.withColumns({"dominant_image_type": dominant, "has_vector_graphics": vector})


def explode_images(pages: DataFrame, outer: bool = False) -> DataFrame:
    """One row per image of a page row; with `outer`, pages without images stay as well."""
    explode = F.posexplode_outer if outer else F.posexplode
    return pages.select("path", "page_num", explode("images").alias("image_index", "image"))


def assemble_document(pages: DataFrame, headers: str | None = None) -> DataFrame:
    """Pages to one text per document in page order, with blank lines between.

    `headers` is a format such as `=== Chapter %d ===` put before each page, which then also
    gets a wider gap.
    """
    body, gap = F.col("text"), "\n\n"
    if headers:
        gap = "\n\n\n\n"
        body = F.concat(F.format_string(headers, F.col("page_num")), F.lit("\n\n"), body)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("page_num").alias("p"), body.alias("t"))))
    return pages.groupBy("path").agg(
        strip(F.array_join(F.transform(ordered, lambda x: x["t"]), gap)).alias("text"), F.count(F.lit(1)).alias("n_pages")
    )


def markup_profile(pages: DataFrame, by: str, markup: str = "html") -> DataFrame:
    """Chapters, bytes and estimated pages of each book."""
    size = F.sum(F.octet_length(markup))
    return pages.groupBy(by).agg(
        F.count(F.lit(1)).alias("chapter_count"),
        size.alias("total_content_size"),
        F.floor(size / fixed.BYTES_PER_PAGE).alias("estimated_pages"),
    )
