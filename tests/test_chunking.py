import random

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import chunking


def windows(text, size, overlap):
    """The rule, one step at a time: (start, end, chunk)."""
    n, start, out = len(text), 0, []
    if n <= size:
        return [(0, n, text)]
    while start < n:
        end = start + size
        if end < n:
            stop = text.rfind(".", end - overlap, end)
            end = stop + 1 if stop > end - overlap else end
        piece = text[start:end].strip()
        if piece:
            out.append((start, min(end, n), piece))
        start = end - overlap
    return out


def merged(text, size):
    out, cur = [], ""
    for p in (p.strip() for p in text.split("\n\n")):
        if not p:
            continue
        if cur and len(cur) + len(p) + 2 <= size:
            cur += "\n\n" + p
        else:
            out += [cur] if cur else []
            cur = p
    return out + ([cur] if cur else [])


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    made = ["".join(rnd.choice("ab .\n\n😀é.") for _ in range(rnd.randint(0, 220))) for _ in range(250)]
    return ["", " hi ", "x" * 18, "." * 50, " " * 40, "a." * 40, *made]


def collect(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("size, overlap", [(10, 4), (20, 5), (20, 8), (20, 10), (30, 0), (50, 1), (50, 2), (7, 3)])
def test_windows_match_the_rule(spark, texts, size, overlap):
    want = [windows(t, size, overlap) for t in texts]
    assert collect(spark, texts, lambda t: chunking.chunk_default(t, size, overlap)) == [[c for _, _, c in w] for w in want]
    spans = collect(spark, texts, lambda t: chunking.chunk_spans(t, size, overlap))
    assert [[(s["start"], s["end"], s["chunk"]) for s in row] for row in spans] == want


@pytest.mark.parametrize(
    "text, size, overlap, chunks",
    [
        (" hi ", 10, 4, [" hi "]),
        ("x" * 18, 10, 4, ["x" * 10, "x" * 10, "x" * 6]),
        ("abcdefghij" * 3, 20, 5, ["abcdefghij" * 2, "fghijabcdefghij"]),
        ("aaaa bbbb cccc. dddd eeee ffff gggg", 20, 8, ["aaaa bbbb cccc.", "bb cccc. dddd eeee f", "d eeee ffff gggg", "gggg"]),
    ],
)
def test_window_goldens(one, text, size, overlap, chunks):
    assert one(chunking.chunk_default(F.col("t"), size, overlap), t=text) == chunks


def test_window_needs_room():
    with pytest.raises(ValueError):
        chunking.chunk_default(F.lit("x"), 10, 6)


def test_contained_tail_can_be_dropped(one):
    text = "aaaa bbbb cccc. dddd eeee ffff gggg"
    spans = one(chunking.drop_contained_tail(chunking.chunk_spans(F.col("t"), 20, 8)), t=text)
    assert [s["chunk"] for s in spans] == ["aaaa bbbb cccc.", "bb cccc. dddd eeee f", "d eeee ffff gggg"]


@pytest.mark.parametrize("size, overlap", [(4000, 200), (4000, 500), (4000, 2000), (60000, 20000)])
def test_long_text_of_wide_characters(one, size, overlap):
    """Alternating narrow and wide characters must not exhaust the matcher's stack."""
    text = ("a😀" * 700 + "b.") * 60
    assert one(chunking.chunk_default(F.col("t"), size, overlap), t=text) == [c for _, _, c in windows(text, size, overlap)]
    spans = one(chunking.chunk_spans(F.col("t"), size, overlap), t=text)
    assert [(s["start"], s["end"], s["chunk"]) for s in spans] == windows(text, size, overlap)


def test_many_lines_in_a_chunk(one):
    text = "one é😀 line\n" * 30000
    assert [len(c) for c in one(chunking.chunk_lines(F.col("t"), 20000), t=text)] == [20000 * 12 - 1, 10000 * 12 - 1]


@pytest.mark.parametrize("size", [5, 9, 40])
def test_paragraphs(spark, texts, size):
    assert collect(spark, texts, lambda t: chunking.chunk_paragraph(t, size)) == [merged(t, size) for t in texts]


def test_many_and_wide_paragraphs(one):
    text = "\n\n".join(["a😀b" * 30, "one é line", "two"] * 4000)
    assert one(chunking.chunk_paragraph(F.col("t"), 900), t=text) == merged(text, 900)


def test_paragraph_golden(one):
    text = "aa\n\nbbb\n\ncccc\n\n" + "d" * 13
    assert one(chunking.chunk_paragraph(F.col("t"), 9), t=text) == ["aa\n\nbbb", "cccc", "d" * 13]


@pytest.mark.parametrize("n", [1, 2, 7])
def test_lines(spark, texts, n):
    odd = [*texts, "a\r\nb\x0bc\x85d e\n\n\nf\n"]

    def groups(t):
        rows = t.splitlines()
        made = ("\n".join(rows[i : i + n]).strip() for i in range(0, len(rows), n))
        return [g for g in made if g]

    assert collect(spark, odd, lambda t: chunking.chunk_lines(t, n)) == [groups(t) for t in odd]


def test_separator(spark, texts):
    for sep in (".", "a b", "\n---\n", "(*"):
        want = [[p.strip() for p in t.split(sep) if p.strip()] for t in texts]
        assert collect(spark, texts, lambda t: chunking.chunk_separator(t, sep)) == want


def test_table_counts(spark):
    for scale, n in (("0.001", 245), ("0.01", 1236)):
        docs = spark.read.parquet(f"/root/testdata/sf{scale}/documents.parquet")
        assert chunking.explode_chunks(docs, keep=["doc_id"]).count() == n


def test_chunks_cover_the_text(documents):
    """Between two starts every character is in a chunk, and no chunk is longer than the size."""
    rows = chunking.chunk_offsets(documents, keep=["doc_id", "n_chars"])
    assert rows.filter("end - start > 4000").count() == 0
    assert rows.filter("chunk_id > 0 AND overlap < 0").count() == 0
    ends = rows.groupBy("doc_id", "n_chars").agg(F.max("end").alias("e"), F.min("start").alias("s"))
    assert ends.filter("e <> n_chars OR s <> 0").count() == 0


def test_fan_out_and_limits(documents):
    chunks = chunking.explode_chunks(documents, keep=["doc_id"])
    pairs = chunking.fan_out(chunks, {"a": "1", "b": "2"})
    assert pairs.count() == 2 * chunks.count()
    assert chunking.limit_chunks_per_doc(chunks).agg(F.max("chunk_id")).first()[0] == 1


def test_unknown_strategy(documents):
    with pytest.raises(ValueError):
        chunking.explode_chunks(documents, strategy="magic")
