"""Column functions over text: cleaning, scoring, counting, markup removal."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusforge import fixed_values as fixed

# White space as Unicode sees it, written out because `\s` alone is ASCII-only in the JVM.
WS = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
_SPACES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
TRIM_CHARS = "".join(map(chr, [*_SPACES, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
OTHER_BREAKS = "\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
# Stands where a tag was. A noncharacter: it cannot occur in interchanged text.
TAG_MARK = "\ufdd0"
# Stands behind the `<` of an opener that has no closer.
OPENER_MARK = "\ufdd1"
HIDDEN_KINDS = ("script", "style", "template")
HTML_HIDDEN = (
    r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
    r"|<template\b[^>]*>.*?</template\s*>"
)
HTML_TAG = r"(?s)</?[A-Za-z][^>]*>|<[!?][^>]*>"
SRT_TIME = (
    rf"\A\p{{Nd}}{{2}}:\p{{Nd}}{{2}}:\p{{Nd}}{{2}},\p{{Nd}}{{3}}[{WS}]*-->[{WS}]*"
    r"\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2},\p{Nd}{3}\z"
)


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.trim(text, F.lit(TRIM_CHARS))


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"[^{WS}]")


def has_length(text: Column, n: int) -> Column:
    """Whether the stripped text has at least `n` characters; reads no further than it must."""
    if n <= 0:
        return text.isNotNull()
    if n == 1:
        return ~is_blank(text)
    return text.rlike(rf"(?s)\A[{WS}]*[^{WS}].{{{n - 2}}}.*?[^{WS}]")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _split_words(text: Column) -> Column:
    return F.split(text, f"[{WS}]+", -1)


def _edge_blanks(text: Column) -> Column:
    """How many ends of a text are white space: each adds an empty piece to a split."""
    at_ends = [F.substring(text, at, 1).rlike(f"[{WS}]").cast("int") for at in (1, -1)]
    return at_ends[0] + at_ends[1]


def word_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(_split_words(text)) - _edge_blanks(text))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def normalize_nfkc(text: Column) -> Column:
    """NFKC form, by the ICU library that Spark itself ships; texts already in it pass at once."""

    def form(t: Column) -> Column:
        return F.when(t.isNotNull(), F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), t, F.lit(True)))

    return let(text, form)


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def clean_text(text: Column) -> Column:
    """Normalise, squeeze blank runs, drop characters outside the kept set, strip."""
    text = normalize_newlines(normalize_nfkc(text))
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"[ \t]{2,}", " ")
    # All printable ASCII is kept; beyond it letters, numbers and white space.
    return strip(F.regexp_replace(text, rf"[^\x20-\x7e\p{{L}}\p{{N}}{WS}]", ""))


def remove_header_lines(text: Column, pattern: str) -> Column:
    """Drop the lines whose stripped form matches `pattern`; a bad pattern drops nothing."""
    if not pattern:
        return text
    try:
        re.compile(pattern)
    except re.error:
        return text
    return F.array_join(F.filter(lines(text), lambda l: ~strip(l).rlike(f"(?i){pattern}")), "\n")


# Characters that most texts show; looked for one by one, without taking the text apart.
COMMON_CHARS = "etaoinsrhldcumfpgwybvkxjqz .,\n'-\""


def distinct_chars(text: Column) -> Column:
    """Number of different characters, ignoring case."""
    return F.size(F.array_distinct(F.split(F.lower(text), "")))


def _variety(text: Column, full: int) -> Column:
    """Share of `full` different characters, at most 1; only a text that lacks common ones is taken apart."""
    seen = let(F.lower(text), lambda t: sum((t.contains(c).cast("int") for c in COMMON_CHARS), F.lit(0)))
    return F.when(seen >= full, F.lit(1.0)).otherwise(F.least(F.lit(1.0), distinct_chars(text) / full))


def text_quality(text: Column) -> Column:
    """Score in [0, 1] from length, words, word length, sentences and character variety."""

    def share(count: Column, full: int) -> Column:
        return F.least(F.lit(1.0), count / full)

    measures = F.struct(
        F.length(text).alias("chars"),
        F.regexp_count(text, F.lit(f"[^{WS}]+")).alias("words"),
        F.regexp_count(text, F.lit(f"[{WS}]")).alias("blanks"),
        (F.regexp_count(text, F.lit("[.!?]+")) + 1).alias("sentences"),
    )

    def score(m: Column) -> Column:
        mean = (m["chars"] - m["blanks"]) / m["words"]
        return (
            share(m["chars"], 1000) * 0.2
            + share(m["words"], 100) * 0.2
            + F.when(mean < 4, mean / 4).when(mean <= 8, F.lit(1.0)).otherwise(F.greatest(F.lit(0.1), 8 / mean)) * 0.3
            + share(m["sentences"], 10) * 0.2
            + _variety(text, 26) * 0.1
        )

    return F.when(text.isNull() | is_blank(text), F.lit(0.0)).otherwise(let(measures, score))


def text_profile(text: Column) -> dict[str, Column]:
    words = word_count(text)
    return {
        "line_count": F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1,
        "word_count": words,
        "char_count": F.length(text),
        "reading_minutes": words / fixed.WORDS_PER_MINUTE,
    }


def has_words(text: Column, n: int) -> Column:
    """At least `n` words; stops reading at the n-th. Anchored and without going back, so it is linear."""
    return text.rlike(rf"\A[{WS}]*+(?:[^{WS}]++[{WS}]++){{{n - 1}}}[^{WS}]")


def is_header_footer(line: Column) -> Column:
    """At most 3 words, or one of the listed words anywhere."""
    listed = "|".join(re.escape(word).replace("\\ ", " ") for word in fixed.HEADER_FOOTER_WORDS)
    # The look-ahead rejects most positions by one character.
    firsts = "".join(sorted({word[0] for word in fixed.HEADER_FOOTER_WORDS}))
    return ~has_words(line, 4) | F.lower(line).rlike(f"(?=[{firsts}])(?:{listed})")


def is_meaningful_text(text: Column, min_lines: int = fixed.MIN_PAGE_LINES) -> Column:
    """At least `min_lines` non-empty lines, more than half of them real prose.

    Prose is longer than 10 characters, not a number, and no header or footer (which also asks
    for more than 3 words).
    """
    prose = lambda l: (F.length(l) > 10) & ~is_header_footer(l) & ~l.rlike(r"\A\p{Nd}+\z")
    full = F.filter(F.transform(lines(text), strip), lambda l: l != "")
    enough = lambda rows: (F.size(rows) >= min_lines) & (F.size(F.filter(rows, prose)) * 2 > F.size(rows))
    return F.coalesce(let(full, enough), F.lit(False))


def estimate_tokens_chars(text: Column) -> Column:
    return F.floor(F.length(text) / fixed.CHARS_PER_TOKEN)


def estimate_tokens_words(text: Column) -> Column:
    return word_count(text)


def estimate_tokens_bytes(size: Column) -> Column:
    return F.floor(size / 2)


def strip_code_fence(text: Column) -> Column:
    """Drop an opening fence line, and a closing one, from a fenced answer.

    The lines are found by their breaks; a regular expression reads the text only where it has other breaks than line feeds.
    """

    def opened(flat: Column) -> Column:
        at = F.position(F.lit("\n"), flat)
        return F.when(at == 0, "").otherwise(F.substring(flat, at + 1, F.length(flat)))

    def closed(body: Column) -> Column:
        last = F.substring_index(body, "\n", -1)
        rest = F.substring(body, F.lit(1), F.greatest(F.length(body) - F.length(last) - 1, F.lit(0)))
        return F.when(last.startswith("```"), rest).otherwise(body)

    def unfenced(fenced: Column) -> Column:
        other = reduce(or_, [fenced.contains(mark) for mark in OTHER_BREAKS])
        flat = F.when(other, F.regexp_replace(fenced, LINE_BREAK, "\n")).otherwise(fenced)
        ended = let(let(flat, opened), lambda t: F.when(t.endswith("\n"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t))
        return let(ended, closed)

    return F.when(text.startswith("```"), let(text, unfenced)).otherwise(text)


def excerpt(text: Column, size: int) -> Column:
    """The first `size` characters, marked with dots when the text goes on."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


# --- subtitles and markup ---------------------------------------------------------------


def srt_to_text(text: Column) -> Column:
    rows = F.transform(lines(normalize_newlines(text)), strip)
    spoken = F.filter(rows, lambda l: (l != "") & ~l.rlike(r"\A\p{Nd}+\z") & ~l.rlike(SRT_TIME))
    return F.array_join(spoken, " ")


def srt_entries(text: Column) -> Column:
    return F.size(F.filter(lines(normalize_newlines(text)), lambda l: strip(l).rlike(SRT_TIME)))


def _vtt_cues(text: Column) -> Column:
    blocks = F.split(normalize_newlines(text), r"\n[ \t]*\n[ \t\n]*", -1)
    return F.filter(blocks, lambda b: b.contains("-->"))


def _before_last_close(text: Column, change) -> Column:
    """Change the text up to its last `>`. Tags end there, so none is sought where it cannot close."""

    def changed(t: Column) -> Column:
        return let(F.length(t) - F.length(F.substring_index(t, ">", -1)), lambda size: F.concat(change(F.left(t, size)), F.substr(t, size + 1)))

    return let(text, changed)


def vtt_to_text(text: Column) -> Column:
    """Caption texts in order without tags; a file without the header is returned as it is."""

    def caption(block: Column) -> Column:
        body = F.regexp_replace(block, r"(?s)\A.*?-->[^\n]*\n?", "")
        return _before_last_close(F.regexp_replace(body, r"\n+\z", ""), lambda part: F.regexp_replace(part, "<[^>]+>", ""))

    said = F.array_join(F.transform(_vtt_cues(text), caption), " ")
    return F.when(text.rlike(r"\A\x{feff}?WEBVTT"), said).otherwise(normalize_newlines(text))


def vtt_entries(text: Column) -> Column:
    return F.when(text.rlike(r"\A\x{feff}?WEBVTT"), F.size(_vtt_cues(text))).otherwise(F.lit(0))


def decode_entities(text: Column) -> Column:
    """Named and numbered character references to characters."""

    def plain(t: Column) -> Column:
        named = F.replace(t, F.lit("&apos;"), F.lit("'"))
        return F.when(t.isNotNull(), F.java_method(F.lit("org.apache.commons.text.StringEscapeUtils"), F.lit("unescapeHtml4"), named))

    return let(text, plain)


def _marking(opener: str, last: str):
    def marked(t: Column) -> Column:
        head = let(F.length(F.regexp_extract(t, last, 0)), lambda size: F.concat(F.left(t, size), F.regexp_replace(F.substr(t, size + 1), opener, f"<{OPENER_MARK}")))
        return F.when(t.rlike(opener), head).otherwise(t)

    return marked


def _only_closed(markup: Column) -> Column:
    """Mark the openers of hidden elements behind the last place where one of their kind can still close.

    An element is sought from each opener up to its closer, so openers that never close would each be
    followed to the end of the text. An opener before the last `>` in front of the last closer of
    its kind always closes; one behind it never does.
    """
    for kind in HIDDEN_KINDS:
        markup = let(markup, _marking(rf"(?i)<(?={kind}\b)", rf"(?is)\A.*>(?=[^>]*</{kind}\s*>)"))

    def comments(t: Column) -> Column:
        size = F.length(t) - F.length(F.substring_index(t, "-->", -1))
        return F.when(t.contains("<!--"), let(size, lambda n: F.concat(F.left(t, n), F.replace(F.substr(t, n + 1), F.lit("<!--"), F.lit(f"<{OPENER_MARK}!--"))))).otherwise(t)

    return let(markup, comments)


def html_to_text(markup: Column) -> Column:
    """Visible strings of a page, each stripped, joined by one space."""
    shown = F.replace(F.regexp_replace(_only_closed(markup), HTML_HIDDEN, TAG_MARK), F.lit(OPENER_MARK), F.lit(""))
    shown = decode_entities(_before_last_close(shown, lambda part: F.regexp_replace(part, HTML_TAG, TAG_MARK)))
    pieces = F.filter(F.transform(F.split(shown, TAG_MARK, -1), strip), lambda s: s != "")
    return F.array_join(pieces, " ")
