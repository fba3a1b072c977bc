"""Spelling variants against a deletion index, at several block sizes."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_tables import ODD, nothing, odd  # noqa: F401
from pyspark.sql import functions as F

from corpusforge.llm import spelling
from corpusforge.llm.queries import QUERIES

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def apart(a, b):
    """Whether a and b differ by one edit, told from every possible edit of the shorter one."""
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def near_of(words):
    """Near words by deletion signatures."""
    signs, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            signs[w[:i], w[i + 1 :]].add(w)
    for members in signs.values():
        for w in members:
            near[w] |= members - {w}
    for w in words:
        for i in range(len(w)):
            if (x := w[:i] + w[i + 1 :]) in words:
                near[w].add(x)
                near[x].add(w)
    return near


def expected(words, ratio=5):
    near, form = near_of(words), {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= ratio * words[w]:
                form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def counted(rows, least=6, times=5):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UPPER, UPPER.lower()))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= least and n >= times}


@settings(max_examples=200, deadline=None)
@given(st.text("abé\U0001f600", min_size=1, max_size=6), st.text("abé\U0001f600", min_size=1, max_size=6))
def test_common_ends_tell_one_edit(x, y):
    import numpy as np
    import pyarrow as pa

    sizes = np.array([len(x), len(y)])
    left, right = spelling.code_points(pa.array([x, y]), sizes, int(sizes.max()))
    near, _, _ = spelling.one_edit(left, right, sizes, np.array([0]), np.array([1]))
    assert bool(near[0]) == (x != y and abs(len(x) - len(y)) <= 1 and apart(x, y))


@pytest.mark.parametrize("block", [1, 3, 2048])
def test_variants_against_brute_force(spark, block):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    words = counted(rows, 3, 1)
    words = dict(sorted(words.items())[:1500]) | {"aaaa": 1, "aaab": 5, "aaac": 5, "aaaaa": 30, "aaaaaa": 200, "x" * 5000: 9, "x" * 4999 + "y": 80, "x" * 4998: 1, "": 3, "b": 20, "東京都": 1, "東京": 7}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    got = sorted(tuple(r) for r in spelling.variants(df, block=block).collect())
    assert got == expected(words)
    assert any(f for _, f, root, *_ in got if f and f != root)


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in QUERIES["op12_spelling"](spark, "/root/testdata/sf0.01").collect()) == expected(counted(rows))


def test_odd_rows_and_nothing(spark, odd, nothing):
    words = spelling.typed_words(odd, times=1)
    assert {r["word"]: r["n"] for r in words.collect()} == counted(ODD, times=1)
    assert sorted(tuple(r) for r in spelling.variants(words.withColumns({"near": F.lit(1), "m": F.lit(2), "form": F.lit("z")})).collect()) == expected(counted(ODD, times=1))
    assert spelling.variants(spelling.typed_words(nothing)).collect() == []
    assert [tuple(r) for r in spelling.variants(spark.createDataFrame([(None, 3), ("word", None)], "word string, n long")).collect()] == [("word", None, "word", 0, 0, None)]
    with pytest.raises(ValueError):
        spelling.variants(words, ratio=1)
