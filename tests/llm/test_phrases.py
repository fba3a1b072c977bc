"""Phrase mining against counting every phrase of every text."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd_tables import ODD, nothing, odd  # noqa: F401
from pyspark.sql import functions as F

from corpusforge.llm import phrases
from corpusforge.llm.fm_index import WordIndex
from corpusforge.llm.queries import QUERIES

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def counted(rows):
    """(lang -> Counter of word tuples up to 5, words in all)."""
    out, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(str.maketrans(UPPER, UPPER.lower()))):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    out[lang][tuple(words[i : i + size])] += 1
    return out, n


def expected(rows, least=100, top=2000):
    out = []
    for lang, f in (found := counted(rows))[0].items():
        n = found[1][lang]
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    if 100 * a >= 100 * f[p[i : i + size]]:
                        gone.add(p[i : i + size])
        scored = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -score) for i, (score, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("n,most", [(0, 2), (1, 2), (300, 3), (2000, 6)])
def test_index_counts_and_extends(n, most):
    ids = np.random.default_rng(n).integers(0, most, n)
    index = WordIndex.from_bytes(*WordIndex.of(ids, most).to_bytes(), most)
    text = ids.tolist()
    f = Counter(tuple(text[i : i + k]) for k in range(1, 6) for i in range(n - k + 1) if 0 not in text[i : i + k])
    for phrase in [*f, (1,) * 5, (1, 1)]:
        if max(phrase, default=0) < most:
            assert index.find(np.array([phrase])).n.tolist() == [f[phrase]]
    words, now = index.words()
    names = [(int(w),) for w in words]
    for size in range(2, 6):
        for to_left in (True, False):
            owner, word, found = index.extend(now, to_left)
            got = {((int(w),) + names[o] if to_left else names[o] + (int(w),)): int(c) for o, w, c in zip(owner, word, found.n)}
            assert got == {p: c for p, c in f.items() if len(p) == size and (p[1:] if to_left else p[:-1]) in set(names)}
        # Only phrases seen twice or more go on; what is listed from both sides is what has such a beginning and end.
        frequent = {p for p in names if f[p] > 1}
        now = now.take(np.array([p in frequent for p in names], bool))
        names = [p for p in names if p in frequent]
        owner, word, found = index.longer(now)
        got = {(int(w),) + names[o]: int(c) for o, w, c in zip(owner, word, found.n)}
        assert got == {p: c for p, c in f.items() if len(p) == size and p[1:] in frequent and p[:-1] in frequent}
        names, now = list(got), found
        if names and size < 5:
            again = index.find(np.array(names))
            assert [again.lo.tolist(), again.back.tolist(), again.n.tolist()] == [now.lo.tolist(), now.back.tolist(), now.n.tolist()]


@pytest.mark.parametrize("shard,least", [(50, 2), (500, 5), (phrases.SHARD_WORDS, 3)])
def test_collocations_against_brute_force(spark, shard, least):
    rows = [(r.lang if r.doc_id % 7 else None, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:60]
    rows += [(None, "A b\0c d. a B\0C d; a b\0c d\tx  y"), ("en", None), ("xx", "ta ta ta ta ta ta ta")]
    df = spark.createDataFrame([(t, g, 1) for g, t in rows], "text string, lang string, n int").repartition(3)
    got = phrases.top_collocations(df, least, 300, shard, spread=7)
    assert sorted(map(tuple, got.collect())) == expected(rows, least, 300)


def test_query_against_brute_force(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op11_phrases"](spark, "/root/testdata/sf0.01").collect())) == expected(rows)


def test_scores_are_exact(spark):
    rows = [(a, n, left, right) for a in (100, 10**15 + 7) for n in (10**17, 10**12 + 3) for left in (10**15 + 9, 3 * 10**15) for right in (10**15 + 7, 10**16 + 1)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = df.select("*", phrases.cut_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(s == 1000 * a * n // (left * right) for a, n, left, right, s in got)


def test_odd_rows_and_nothing(odd, nothing):
    assert sorted(map(tuple, phrases.top_collocations(odd, 2).collect())) == expected([(None, t) for _, t in ODD], 2)
    assert phrases.top_collocations(nothing).collect() == []
