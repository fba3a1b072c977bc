"""Splitting documents into chunks.

Overlapping chunks start from one regular expression per text that cuts it into back-to-back
segments, each ending where a chunk ends. A chunk is then its segment preceded by the last
characters of the text before it. The whole strategy stays in the JVM, is linear in the text,
and needs neither a shuffle nor Python.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge import fixed_values as fixed
from corpusforge.functions.text import LINE_BREAK, is_blank, let, strip


# Overlaps up to this size are safe for the matcher's stack whatever the characters (see `_narrow`).
SAFE_OVERLAP = 500
WIDE = r"[\x{10000}-\x{10ffff}]"


def _segment_pattern(size: int, overlap: int) -> str:
    """Cut a text at the ends of its chunks.

    A chunk ends after the last full stop among its last `overlap` characters (the first of
    them does not count), or else at `size`. The first segment is the first chunk; later chunks
    begin `overlap` characters back, so their segments are that much shorter. The last segment
    is what remains when no full chunk is left.
    """

    def cut(span: int) -> str:
        stop = rf".{{{span - overlap + 1},{span - 1}}}\.|" if overlap >= 2 else ""
        return f"(?=.{{{span + 1}}})(?:{stop}.{{{span}}})"

    return rf"(?s)\A{cut(size)}|(?!\A)(?:{cut(size - overlap)}|.+)"


def check_window(size: int, overlap: int) -> None:
    if size < 1 or overlap < 0 or size < 2 * overlap:
        raise ValueError(f"chunk size {size} must be positive and at least twice the overlap {overlap}")


def _carry(segments: Column, i: Column, size: int, overlap: int) -> Column:
    """The `overlap` characters before segment `i`."""
    if overlap == 0:
        return F.lit("")
    shortest = size - 2 * overlap + 2
    back = ceil(overlap / shortest)
    before = (
        F.get(segments, i - 1)
        if back == 1
        else F.array_join(F.slice(segments, F.greatest(i - back + 1, F.lit(1)), F.least(i, F.lit(back))), "")
    )
    return F.when(i == 0, "").otherwise(F.right(before, F.lit(overlap)))


def _narrow(text: Column) -> Column:
    """The text with wide (supplementary) characters replaced by narrow ones, length unchanged.

    The matcher recurses where narrow and wide characters alternate inside a bounded repetition
    of the dot, and a long one could exhaust its stack.
    """
    return F.regexp_replace(text, WIDE, "\ufffd")


def _segments(text: Column, size: int, overlap: int) -> Column:
    pattern = F.lit(_segment_pattern(size, overlap))
    plain = F.regexp_extract_all(text, pattern, 0)
    if overlap <= SAFE_OVERLAP:
        return plain
    # Segments of the narrow text; a text with wide characters is then cut by their lengths.
    cut = lambda acc, s: F.struct(
        (acc["at"] + F.length(s)).alias("at"), F.array_append(acc["out"], text.substr(acc["at"], F.length(s))).alias("out")
    )
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))
    by_length = F.aggregate(F.regexp_extract_all(_narrow(text), pattern, 0), start, cut, lambda acc: acc["out"])
    return F.when(text.rlike(WIDE), by_length).otherwise(plain)


def _tail(segments: Column, size: int, overlap: int) -> Column:
    """Characters of the last segment that lie beyond one further step: a chunk of their own."""
    last = F.element_at(segments, -1)
    return F.right(last, F.length(last) - (size - 2 * overlap))


def chunk_default(text: Column, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP) -> Column:
    """Overlapping chunks that end at a sentence where they can; short texts stay one chunk."""
    check_window(size, overlap)

    def build(segments: Column) -> Column:
        raw = F.transform(segments, lambda s, i: F.concat(_carry(segments, i, size, overlap), s))
        raw = F.array_append(raw, _tail(segments, size, overlap)) if overlap else raw
        return F.filter(F.transform(raw, strip), lambda c: c != "")

    long_text = F.when(F.length(text) > size, text)
    return F.when(F.length(text) <= size, F.array(text)).otherwise(let(_segments(long_text, size, overlap), build))


def chunk_tokens(text: Column, tokens: int = fixed.TOKENS_PER_CHUNK, overlap: int = fixed.CHUNK_OVERLAP) -> Column:
    return chunk_default(text, tokens * fixed.CHARS_PER_TOKEN, overlap)


def chunk_spans(text: Column, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP) -> Column:
    """Chunks with their positions: array of (start, end, chunk), 0-based, end exclusive."""
    check_window(size, overlap)

    def span(start: Column, chunk: Column) -> Column:
        end = start + F.length(chunk)
        return F.struct(start.alias("start"), end.alias("end"), strip(chunk).alias("chunk"))

    def build(segments: Column) -> Column:
        ends = F.aggregate(
            segments,
            F.array(F.lit(0)),
            lambda acc, s: F.array_append(acc, F.element_at(acc, -1) + F.length(s)),
        )

        def place(pair: Column, i: Column) -> Column:
            carry = _carry(segments, i, size, overlap)
            return span(pair["at"] - F.length(carry), F.concat(carry, pair["s"]))

        placed = F.transform(F.arrays_zip(segments.alias("s"), F.slice(ends, 1, F.size(segments)).alias("at")), place)
        if overlap:
            tail = _tail(segments, size, overlap)
            placed = F.array_append(placed, span(F.length(text) - F.length(tail), tail))
        return F.filter(placed, lambda c: c["chunk"] != "")

    long_text = F.when(F.length(text) > size, text)
    return F.when(F.length(text) <= size, F.array(span(F.lit(0), text).withField("chunk", text))).otherwise(
        let(_segments(long_text, size, overlap), build)
    )


def drop_contained_tail(spans: Column) -> Column:
    """Spans without those that lie inside the span before them."""
    return F.filter(spans, lambda s, i: (i == 0) | (s["end"] > F.try_element_at(spans, i)["end"]))


def chunk_paragraph(text: Column, size: int = fixed.CHUNK_SIZE) -> Column:
    """Paragraphs merged in order while they fit; an oversize paragraph stays whole.

    On the stripped paragraphs joined again, a chunk is the longest piece of at most `size`
    characters that ends at a paragraph, or else the first paragraph. For a text with wide
    characters, matching its narrow form tells how many paragraphs each chunk takes, and the
    chunks are slices of the paragraphs.
    """
    end = r"(?=\n\n|\z)"
    pattern = F.lit(rf"(?s)(.{{1,{size}}}{end}|.+?{end})(?:\n\n|\z)")
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at:int,n:int>>").alias("out"))

    def place(acc: Column, piece: Column) -> Column:
        n = ((F.length(piece) - F.length(F.replace(piece, F.lit("\n\n"), F.lit("")))) / 2 + 1).cast("int")
        slot = F.struct(acc["at"].alias("at"), n.alias("n"))
        return F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], slot).alias("out"))

    def build(paragraphs: Column) -> Column:
        joined = F.array_join(paragraphs, "\n\n")
        pieces = F.regexp_extract_all(_narrow(joined), pattern, 1)
        slots = F.aggregate(pieces, start, place, lambda acc: acc["out"])
        slices = F.transform(slots, lambda s: F.array_join(F.slice(paragraphs, s["at"], s["n"]), "\n\n"))
        return F.when(joined.rlike(WIDE), slices).otherwise(pieces)

    return let(F.filter(F.transform(F.split(text, "\n\n", -1), strip), lambda p: p != ""), build)


def chunk_lines(text: Column, lines_per_chunk: int = fixed.LINES_PER_CHUNK) -> Column:
    """Groups of consecutive lines, stripped, blank groups dropped."""

    def groups(rows: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(rows), F.lit(lines_per_chunk))
        return F.transform(starts, lambda at: strip(F.array_join(F.slice(rows, at, F.lit(lines_per_chunk)), "\n")))

    return F.filter(let(F.split(text, LINE_BREAK, -1), groups), lambda c: c != "")


def chunk_separator(text: Column, separator: str = fixed.CHUNK_SEPARATOR) -> Column:
    pieces = F.split(text, re.escape(separator).replace("\\\n", "\n"), -1)
    return F.filter(F.transform(pieces, strip), lambda c: c != "")


STRATEGIES = {
    "default": chunk_default,
    "paragraph": chunk_paragraph,
    "lines": chunk_lines,
    "separator": chunk_separator,
    "tokens": chunk_tokens,
}


def explode_chunks(docs: DataFrame, text: str = "text", strategy: str = "default", keep: list[str] | None = None, **options) -> DataFrame:
    """One row per chunk: the kept columns, `chunk_id` from 0, and `chunk`."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy: {strategy}")
    pieces = STRATEGIES[strategy](F.col(text), **options)
    columns = keep if keep is not None else [c for c in docs.columns if c != text]
    return docs.select(*columns, F.posexplode(pieces).alias("chunk_id", "chunk"))


def drop_blank_docs(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.filter(~is_blank(F.col(text)))


def explode_lines(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    columns = keep if keep is not None else [c for c in docs.columns if c != text]
    return docs.select(*columns, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))


def chunk_offsets(docs: DataFrame, text: str = "text", keep: list[str] | None = None, **window: int) -> DataFrame:
    """Chunks with `start`, `end` and the `overlap` with the chunk before (null on the first).

    All chunks of a text come from one row, so the neighbour is found inside the row's array.
    """
    columns = keep if keep is not None else [c for c in docs.columns if c != text]
    spans = docs.select(*columns, chunk_spans(F.col(text), **window).alias("spans"))
    linked = F.transform(
        F.arrays_zip(F.col("spans"), F.concat(F.array(F.lit(None).cast("int")), F.col("spans.end")).alias("prev")),
        lambda z: F.struct(z["spans"].alias("span"), (z["prev"] - z["spans"]["start"]).alias("overlap")),
    )
    rows = spans.select(*columns, F.posexplode(F.filter(linked, lambda z: z["span"].isNotNull())).alias("chunk_id", "z"))
    return rows.select(*columns, "chunk_id", "z.span.start", "z.span.end", "z.overlap", "z.span.chunk")


def limit_chunks_per_doc(chunks: DataFrame, n: int = fixed.TEST_MODE_CHUNKS) -> DataFrame:
    """Test-mode feature: the first `n` chunks of every document."""
    return chunks.filter(F.col("chunk_id") < n)


def fan_out(chunks: DataFrame, templates: dict[str, str]) -> DataFrame:
    """Every chunk with every configured generator and its template, made inside the row."""
    pairs = F.array(*[F.struct(F.lit(g).alias("generator"), F.lit(t).alias("template")) for g, t in templates.items()])
    return chunks.select("*", F.inline(pairs))
