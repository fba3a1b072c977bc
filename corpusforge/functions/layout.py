"""Geometry and image measures of page content, on metadata columns only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusforge import fixed_values as fixed


def image_position(box: Column, width: Column, height: Column) -> Column:
    """Which third of the page, down and across, holds the centre of the image."""

    def third(low: Column, high: Column, span: Column, names: tuple[str, str, str]) -> Column:
        centre = (low + high) / 2
        return F.when(centre < span / 3, names[0]).when(centre > span * 2 / 3, names[2]).otherwise(names[1])

    return F.concat_ws(
        "_",
        third(box["y0"], box["y1"], height, ("top", "middle", "bottom")),
        third(box["x0"], box["x1"], width, ("left", "center", "right")),
    )


def rect_distance(a: Column, b: Column) -> Column:
    """Gap between two axis-aligned boxes; 0 when they touch."""
    gap_x = F.greatest(F.lit(0.0), a["x0"] - b["x1"], b["x0"] - a["x1"])
    gap_y = F.greatest(F.lit(0.0), a["y0"] - b["y1"], b["y0"] - a["y1"])
    return F.sqrt(gap_x * gap_x + gap_y * gap_y)


def is_nearby(a: Column, b: Column, limit: float = fixed.NEARBY_DISTANCE) -> Column:
    return rect_distance(a, b) <= limit


def nearby_text(blocks: Column, box: Column, limit: float = fixed.NEARBY_DISTANCE) -> Column:
    """Texts of the blocks of one page that lie within `limit` of a box, in block order.

    Blocks are an array of the page row itself, so this needs no join and no shuffle.
    """
    near = F.filter(blocks, lambda b: is_nearby(b["bbox"], box, limit) & (F.trim(b["text"]) != ""))
    return F.transform(near, lambda b: F.trim(b["text"]))


def text_around_image(blocks: Column, box: Column) -> tuple[Column, Column]:
    """Text of the blocks wholly above, and wholly below, a box of the same page row."""
    above = F.filter(blocks, lambda b: b["bbox"]["y1"] <= box["y0"])
    below = F.filter(blocks, lambda b: b["bbox"]["y0"] >= box["y1"])
    return tuple(F.trim(F.array_join(F.transform(side, lambda b: b["text"]), "\n")) for side in (above, below))


def table_to_text(rows: Column) -> Column:
    def line(cells: Column) -> Column:
        return F.array_join(F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit("")))), " | ")

    return F.array_join(F.transform(rows, line), "\n")


def table_block(rows: Column, page: Column) -> Column:
    return F.concat(F.lit("\n[TABLE on page "), page.cast("string"), F.lit("]\n"), table_to_text(rows), F.lit("\n[/TABLE]\n\n"))


def form_fields_to_text(fields: Column) -> Column:
    def line(f: Column) -> Column:
        value = F.when(F.coalesce(f["value"], F.lit("")) != "", F.concat(F.lit(" = "), f["value"])).otherwise("")
        return F.concat(F.lit("Field: "), f["name"], F.lit(" (Type: "), f["type"], F.lit(")"), value, F.lit("\n"))

    body = F.array_join(F.transform(fields, line), "")
    return F.when(F.size(fields) > 0, F.concat(F.lit("\n[FORM FIELDS]\n"), body, F.lit("[/FORM FIELDS]\n\n"))).otherwise("")


def append_image_marker(text: Column, count: Column, contextual: bool = False) -> Column:
    n = count.cast("string")
    if contextual:
        mark = F.concat(F.lit("\n[This page contains "), n, F.lit(" image(s) with contextual relationships]\n"))
    else:
        mark = F.concat(F.lit("\n[Document contains "), n, F.lit(" image(s) on this page]\n"))
    return F.when(count > 0, F.concat(text, mark)).otherwise(text)


def combine_ocr_text(text: Column, image_texts: Column) -> Column:
    """Page text followed by the non-empty image texts, blank line between."""
    found = F.filter(image_texts, lambda t: F.coalesce(t, F.lit("")) != "")
    return F.array_join(F.concat(F.array(text), found), "\n\n")


def image_quality(area: Column, size_bytes: Column, mode: Column, n_colors: Column) -> Column:
    per_pixel = F.when(area > 0, size_bytes / area).otherwise(0.0)
    ideal = F.when(mode == "RGB", 3.0).when(mode == "RGBA", 4.0).otherwise(1.0)
    colors = F.coalesce(F.least(F.lit(1.0), n_colors / 1000), F.lit(1.0))
    return (
        F.least(F.lit(1.0), area / 100000) * 0.4
        + F.least(F.lit(1.0), per_pixel / ideal) * 0.3
        + colors * 0.3
    )


def epub_image_quality(area: Column, size_bytes: Column) -> Column:
    per_pixel = F.when(area > 0, size_bytes / area).otherwise(0.0)
    score = (F.least(F.lit(1.0), area / 100000) + F.least(F.lit(1.0), per_pixel / 3.0)) / 2
    return F.when(area.isNull(), F.lit(0.3)).otherwise(score)


def is_single_color(color_counts: Column, area: Column) -> Column:
    """At most 3 colours, or one covering over 95 %; null or over 100 colours means no."""
    few = F.size(color_counts) <= 3
    dominant = F.exists(color_counts, lambda c: c["n"] > area * 0.95)
    return F.when(color_counts.isNull() | (F.size(color_counts) > 100), F.lit(False)).otherwise(few | dominant)


def color_count_label(n: Column) -> Column:
    return (
        F.when(n.isNull(), "many (>16M)")
        .when(n > 10000, F.concat(F.lit("many (~"), F.floor(n / 1000).cast("string"), F.lit("K)")))
        .otherwise(n.cast("string"))
    )


def resolution_class(area: Column) -> Column:
    return F.when(area > 500000, "high").when(area > 100000, "medium").otherwise("low")


def is_small_image(area: Column, size_bytes: Column, source: str) -> Column:
    """Too small to keep, by where the image comes from."""
    least = fixed.SMALL_IMAGE[source]
    small = area < least
    return small | (size_bytes < least) if source == "epub" else small


def keep_image(area: Column, score: Column, single_color: Column, min_area: int, threshold: float, skip_single: bool) -> Column:
    """Large enough, good enough (unknown score counts as 1), and not one flat colour."""
    keep = (F.coalesce(area, F.lit(min_area)) >= min_area) & (F.coalesce(score, F.lit(1.0)) >= threshold)
    return keep & ~F.coalesce(single_color, F.lit(False)) if skip_single else keep
