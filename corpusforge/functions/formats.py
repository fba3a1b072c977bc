"""Hashes, keys, parsed settings and printed forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusforge import fixed_values as fixed


def file_hash(content: Column, algorithm: str = "md5") -> Column:
    if algorithm == "md5":
        return F.md5(content)
    if algorithm == "sha1":
        return F.sha1(content)
    if algorithm == "sha256":
        return F.sha2(content, 256)
    raise ValueError(f"unsupported hash algorithm: {algorithm}")


def cache_key(path: Column, size: Column, mtime: Column, settings: dict) -> Column:
    """SHA-256 of the file facts and the settings that change an extraction."""
    parts = F.struct(
        F.struct(*[F.lit(settings[k]).alias(k) for k in sorted(settings)]).alias("config"),
        mtime.alias("file_mtime"),
        path.alias("file_path"),
        size.alias("file_size"),
    )
    return F.sha2(F.to_json(parts), 256)


def simple_cache_key(path: Column, mtime: Column, size: Column) -> Column:
    return F.md5(F.concat(path, mtime.cast("string"), size.cast("string")))


def parse_skip_pages(text: Column) -> Column:
    """'1,2,5-10' to a sorted array of distinct pages; a bad part raises."""

    def expand(part: Column) -> Column:
        part = F.trim(part)
        single = part.rlike(r"\A[0-9]+\z")
        span = F.regexp_extract(part, r"\A([0-9]+) *- *([0-9]+)\z", 1)
        last = F.regexp_extract(part, r"\A([0-9]+) *- *([0-9]+)\z", 2).try_cast("int")
        first = span.try_cast("int")
        return (
            F.when(single, F.array(part.try_cast("int")))
            .when((span != "") & (first <= last), F.sequence(first, last))
            .when(span != "", F.array().cast("array<int>"))
            .otherwise(F.raise_error(F.concat(F.lit("Invalid page range: "), part)).cast("array<int>"))
        )

    pages = F.flatten(F.transform(F.split(text, ",", -1), expand))
    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.array_sort(F.array_distinct(pages)))


def parse_file_size(text: Column) -> Column:
    """'1.5MB' to bytes; plain numbers are bytes; empty means the default limit."""
    upper = F.upper(F.trim(text))
    number = F.regexp_extract(upper, r"\A([0-9.]+) *[KMG]B\z", 1).try_cast("double")
    scaled = F.lit(None).cast("double")
    for unit, factor in (("GB", 1024**3), ("MB", 1024**2), ("KB", 1024)):
        scaled = F.when(upper.endswith(unit), number * factor).otherwise(scaled)
    return (
        F.when(upper == "", F.lit(fixed.MAX_FILE_BYTES).cast("long"))
        .otherwise(F.coalesce(scaled.cast("long"), upper.try_cast("long")))
    )


def format_duration(seconds: Column, decimals: int = 1) -> Column:
    """`12.3s`, `2m 5s` or `1h 3m`."""
    whole = F.floor(seconds)
    return (
        F.when(seconds < 60, F.format_string(f"%.{decimals}fs", seconds.cast("double")))
        .when(
            seconds < 3600,
            F.format_string("%dm %.0fs", F.floor(whole / 60), (seconds - F.floor(whole / 60) * 60).cast("double")),
        )
        .otherwise(F.format_string("%dh %dm", F.floor(whole / 3600), F.floor((whole % 3600) / 60)))
    )


def batch_label(moment: Column) -> Column:
    return F.date_format(moment, "ddMMyyHHmm")


def output_path(stem: Column, generator: Column, fmt: str, batch: Column) -> Column:
    return F.format_string(f"data/%s/%s/%s_%s.{fmt}", batch, stem, stem, generator)


def final_path(generator: Column, fmt: str, batch: Column) -> Column:
    return F.format_string(f"data/%s/final_%s.{fmt}", batch, generator)


def flat_path(stem: Column, generator: Column, fmt: str) -> Column:
    return F.format_string(f"%s_%s.{fmt}", stem, generator)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_ext(path: Column) -> Column:
    """Lower-case suffix with its dot; hidden files and bare names have none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))


def file_stem(path: Column) -> Column:
    name = file_name(path)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+\z", "")
