import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import formats, layout, prompts, text
from corpusforge.operators.quality import min_text_length, quality_status, simple_extraction_check


def values(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


def strange_texts(n=300, seed=5):
    rnd = random.Random(seed)
    alphabet = "ab.  \n\t\r.!?,é ÉΩ中 　  ﬁ…“”—́​\x1f\x85\x0b😀9_'\"|"
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize(
    "sample, score",
    [
        ("", 0.0),
        ("   ", 0.0),
        ("abc", 0.259138),
        ("Hello world.", 0.381015),
        ("a b c d", 0.123631),
        ("supercalifragilistic expialidocious", 0.233715),
        ("One. Two! Three?", 0.431508),
    ],
)
def test_quality_goldens(one, sample, score):
    assert one(F.round(text.text_quality(F.col("t")), 6), t=sample) == score


def test_words_and_strip_follow_unicode_white_space(spark):
    texts = strange_texts()
    assert values(spark, texts, text.word_count) == [len(t.split()) for t in texts]
    assert values(spark, texts, text.strip) == [t.strip() for t in texts]
    assert values(spark, texts, text.is_blank) == [not t.strip() for t in texts]
    assert values(spark, texts, lambda t: text.has_words(t, 4)) == [len(t.split()) > 3 for t in texts]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 40])
def test_has_length_is_the_stripped_length(spark, n):
    texts = [*strange_texts(), "a" + " " * 50, " " * 50 + "a", "ab\n" * 20]
    assert values(spark, texts, lambda t: text.has_length(t, n)) == [len(t.strip()) >= n for t in texts]


def test_clean_text_on_strange_characters(spark):
    def expected(t):
        t = unicodedata.normalize("NFKC", t).replace("\r\n", "\n").replace("\r", "\n")
        t = re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", t))
        return "".join(c for c in t if c.isalnum() or c.isspace() or c == "_" or "!" <= c <= "~").strip()

    texts = strange_texts()
    assert values(spark, texts, text.clean_text) == [expected(t) for t in texts]


def test_null_text_stays_null(spark):
    assert values(spark, [None], text.clean_text) == [None]
    assert values(spark, [None], text.html_to_text) == [None]
    assert values(spark, [None], text.text_quality) == [0.0]


def test_remove_header_lines(one):
    sample = "Page 1\nreal line\n  PAGE 2 \nmore"
    assert one(text.remove_header_lines(F.col("t"), r"^page \d+$"), t=sample) == "real line\nmore"
    assert one(text.remove_header_lines(F.col("t"), "([bad"), t=sample) == sample


def test_meaningful_text(one):
    prose = "this is a line with enough words\nanother line of ordinary text here\n"
    assert one(text.is_meaningful_text(F.col("t")), t=prose) is True
    assert one(text.is_meaningful_text(F.col("t")), t="only one line of ordinary text here") is False
    assert one(text.is_meaningful_text(F.col("t")), t="Page 3 of this long book\n12345678901\nshort\n" + prose) is False


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("```json\n{}\n```", "{}"),
        ("```\n{}\n```\n", "{}"),
        ("```json\n{}", "{}"),
        ("{}", "{}"),
        ("``` only", ""),
        ("x\n```\ny", "x\n```\ny"),
        ("```json\r\n[1]\r\n```", "[1]"),
    ],
)
def test_strip_code_fence(one, raw, expected):
    assert one(text.strip_code_fence(F.col("t")), t=raw) == expected


def test_html_to_text(one):
    page = '<html><head><title>T &amp; &lt;x&gt;</title><script>var a="</p>";</script><style>p{}</style></head><body><!-- no --><p>one<b> two</b>\n three</p>&copy;&#233;&hellip;&amp;lt;</body></html>'
    assert one(text.html_to_text(F.col("t")), t=page) == "T & <x> one two three ©é…&lt;"


def test_subtitles(one):
    srt = "1\r\n00:00:01,000 --> 00:00:02,000\r\nHello there\r\n42\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\nBye"
    assert one(text.srt_to_text(F.col("t")), t=srt) == "Hello there Bye"
    assert one(text.srt_entries(F.col("t")), t=srt) == 2
    vtt = "WEBVTT\n\nNOTE hi\n\nid\n00:01.000 --> 00:02.000\n<v Bob>Hello\nthere\n\n00:03.000 --> 00:04.000\nBye\n"
    assert one(text.vtt_to_text(F.col("t")), t=vtt) == "Hello\nthere Bye"
    assert one(text.vtt_entries(F.col("t")), t=vtt) == 2
    assert one(text.vtt_to_text(F.col("t")), t="plain\nfile") == "plain\nfile"


def test_gates(one):
    assert one(min_text_length(F.col("t"), 3), t=" ab ") == ""
    assert one(min_text_length(F.col("t"), 2), t=" ab ") == " ab "
    assert one(quality_status(F.col("t"), min_length=5), t="abc") == "too_short"
    assert one(quality_status(F.col("t"), min_length=0), t="abc") == "low_quality"
    assert one(quality_status(F.col("t"), min_length=0, threshold=0.0), t=" ") == "no_content"
    assert one(quality_status(F.col("t"), min_length=0, threshold=0.0, valid_images=F.lit(1)), t=" ") == "ok"
    assert one(quality_status(F.col("t"), allow_low=True), t="abc") == "ok"
    assert one(simple_extraction_check(F.col("t")), t="word " * 30) is True
    assert one(simple_extraction_check(F.col("t")), t="w" * 300) is False


@pytest.mark.parametrize(
    "spec, pages", [("1,2,5-10,15", [1, 2, 5, 6, 7, 8, 9, 10, 15]), ("", []), ("7-5", []), (" 3 , 3", [3])]
)
def test_skip_pages(one, spec, pages):
    assert one(formats.parse_skip_pages(F.col("t")), t=spec) == pages


def test_skip_pages_rejects_words(one):
    with pytest.raises(Exception, match="Invalid page"):
        one(formats.parse_skip_pages(F.col("t")), t="3,x")


@pytest.mark.parametrize(
    "spec, size", [("500KB", 512000), ("1.5MB", 1572864), ("1GB", 1073741824), ("42", 42), ("", 104857600), (" 2 mb", 2097152)]
)
def test_file_size(one, spec, size):
    assert one(formats.parse_file_size(F.col("t")), t=spec) == size


@pytest.mark.parametrize("seconds, shown", [(59.94, "59.9s"), (125.0, "2m 5s"), (7320.0, "2h 2m"), (0.0, "0.0s")])
def test_duration(one, seconds, shown):
    assert one(formats.format_duration(F.lit(seconds))) == shown


def test_paths(one):
    assert one(formats.file_ext(F.col("t")), t="a/b.c/name.TXT") == ".txt"
    assert one(formats.file_ext(F.col("t")), t="a/.hidden") == ""
    assert one(formats.file_stem(F.col("t")), t="a/b/name.tar.gz") == "name.tar"
    assert one(formats.output_path(F.lit("s"), F.lit("qa_pairs"), "jsonl", F.lit("b"))) == "data/b/s/s_qa_pairs.jsonl"
    assert one(formats.batch_label(F.lit("2025-07-07 18:04:00").cast("timestamp"))) == "0707251804"


def test_prompts(one):
    assert one(prompts.build_prompt(F.lit("a {chunk} {text}"), F.lit("x"))) == "a x {text}"
    assert one(prompts.build_prompt(F.lit("a {text}"), F.lit("x"))) == "a x"
    assert one(prompts.build_prompt(F.lit("a"), F.lit("x"))) == "a"
    assert one(prompts.prompt_for(F.lit("odd"), F.lit("summaries"))) == "Create a summary of this content."
    assert one(prompts.prompt_for(F.lit("casual"), F.lit("qa_pairs"), {"summaries": "own"})) is None
    assert one(prompts.image_data_url(F.lit("x" * 100).cast("binary"), F.lit("a.PNG"))).startswith("data:image/png;base64,eHh4")
    assert "\n" not in one(prompts.image_data_url(F.lit("x" * 100).cast("binary"), F.lit("a.gif")))
    assert one(prompts.response_text(F.lit('{"candidates": []}'), F.lit("candidates"))) == ""
    assert one(prompts.estimate_cost(F.lit(2000), F.lit(1.0), F.lit(2.0), images=F.lit(3), image_price=F.lit(0.5))) == 7.5


def test_layout(one):
    def box(*c):
        return F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), c)])

    assert one(layout.image_position(box(0, 0, 10, 10), F.lit(300.0), F.lit(300.0))) == "top_left"
    assert one(layout.image_position(box(100, 200, 200, 290), F.lit(300.0), F.lit(300.0))) == "bottom_center"
    assert one(layout.rect_distance(box(0, 0, 10, 10), box(13, 14, 20, 20))) == 5.0
    assert one(layout.is_nearby(box(0, 0, 10, 10), box(61, 0, 70, 10))) is False
    cells = F.array(F.array(F.lit(" a "), F.lit(None).cast("string")), F.array(F.lit("b"), F.lit("c")))
    assert one(layout.table_to_text(cells)) == "a | \nb | c"
    assert one(layout.color_count_label(F.lit(12345))) == "many (~12K)"
    assert one(layout.color_count_label(F.lit(None).cast("int"))) == "many (>16M)"
    counts = F.array(*[F.struct(F.lit(n).alias("n")) for n in (96, 2, 1, 1)])
    assert one(layout.is_single_color(counts, F.lit(100))) is True
    assert one(layout.is_single_color(counts, F.lit(200))) is False
    assert one(layout.image_quality(F.lit(0), F.lit(10), F.lit("L"), F.lit(None).cast("int"))) == pytest.approx(0.3)


def test_one_very_long_word_is_read_once(spark):
    """A megabyte without white space, and one of opening brackets, take no time to speak of."""
    import time

    df = spark.createDataFrame([("x" * 1_000_000,), ("<" * 1_000_000,)], "t string")
    df.select(text.has_words(F.col("t"), 4)).collect()
    start = time.time()
    rows = df.select(text.has_words(F.col("t"), 4).alias("w"), text.is_header_footer(F.col("t")).alias("h"), text.html_to_text(F.col("t")).alias("p")).collect()
    assert time.time() - start < 8
    assert [(r["w"], r["h"]) for r in rows] == [(False, True)] * 2 and rows[0]["p"] == "x" * 1_000_000


def test_variety_of_unusual_texts(one):
    for value in ("аб" * 30, "abcdefghijklmnopqrstuvwxyz", "0123456789" * 3, "ABCabc"):
        kinds = min(1.0, len(set(value.lower())) / 26)
        assert one(text._variety(F.lit(value), 26)) == pytest.approx(kinds)


@pytest.mark.parametrize("opener", ["<!--", "<script>", "<style>", "<template>", "<script", "<!-- <style> "])
@pytest.mark.parametrize("end", ["", "</script>", "-->", "</style>x"])
def test_broken_pages_take_linear_time(spark, opener, end):
    page = spark.createDataFrame([(opener * (1_000_000 // len(opener)) + end,)], "t string")
    page.select(F.length(text.html_to_text(F.lit("<p>a</p>")))).collect()
    start = time.perf_counter()
    page.select(F.length(text.html_to_text(F.col("t")))).collect()
    assert time.perf_counter() - start < 5


def test_hidden_elements_as_plain_patterns_find_them(one):
    """Marking openers changes no result: the same as one pass of the pattern over the whole page."""
    rng, parts = random.Random(5), ["<!--", "-->", "<script>", "<script a='>'", "</script>", "</script >", "<style", ">", "</style>", "<template>", "</TEMPLATE>", "x", " y ", "<b>", "<!-->", "<", "&amp;", "<SCRIPT>", "\n"]
    for _ in range(150):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        hidden = re.sub(r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<template\b[^>]*>.*?</template\s*>", "﷐", page)
        shown = re.sub(r"(?s)</?[A-Za-z][^>]*>|<[!?][^>]*>", "﷐", hidden).replace("&amp;", "&")
        assert one(text.html_to_text(F.col("t")), t=page) == " ".join(p.strip() for p in shown.split("﷐") if p.strip()), page


def test_code_fences_by_lines_equal_regular_expressions(spark):
    import random

    rng = random.Random(3)
    parts = ["```", "`", "\n", "\n", "a", "json", "\r", "\r\n", "\x0b", "\x85", " ", " ", " ", "é", "😀", '{"a":1}', "42"]
    rows = [("```" * (i % 2) + "".join(rng.choice(parts) for _ in range(rng.randrange(9))),) for i in range(4000)] + [(None,)]
    df = spark.createDataFrame(rows, "t string")
    body = F.regexp_replace(F.regexp_replace("t", text.LINE_BREAK, "\n"), r"\A```[^\n]*\n?", "")
    body = F.regexp_replace(F.regexp_replace(body, r"\n?\z", ""), r"(?:\A|\n)```[^\n]*\z", "")
    want = F.when(F.col("t").startswith("```"), body).otherwise(F.col("t"))
    assert df.filter(~text.strip_code_fence(F.col("t")).eqNullSafe(want)).count() == 0


def test_answers_are_stripped_of_any_white_space(spark):
    from corpusforge.operators.items import parse_json

    rows = [(" [1] ",), (" 42 ",), (' {"a": 1}\n',), (" ",), ("x",), (None,)]
    df = spark.createDataFrame(rows, "raw string")
    assert [r["j"] for r in df.select(F.to_json(parse_json(F.col("raw"))).alias("j")).collect()] == ["[1]", "42", '{"a":1}', None, None, None]
