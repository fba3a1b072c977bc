"""Best-fit packing: the plan over lengths against brute force, and every id in exactly one place."""

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_tables import ODD, nothing, odd, prose  # noqa: F401
from pyspark.sql import functions as F
from test_texts import ids_of

from corpusforge.llm import best_fit_packing, configurations
from corpusforge.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def held(made):
    out = Counter()
    for c in made.configurations:
        assert sum(n * t for n, t in zip(c.lengths, c.counts)) <= made.limit and c.copies > 0
        for length, times in zip(c.lengths, c.counts):
            out[length] += times * c.copies
    return out


def fewest(limit, lengths):
    """Fewest sequences by trying every way to add a piece to an open sequence or a new one."""
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= lengths[i]:
                rest = list(rooms)
                rest.remove(room)
                place(i + 1, [*rest, room - lengths[i]])
        place(i + 1, [*rooms, limit - lengths[i]])

    place(0, [])
    return best[0]


def test_best_fill_is_the_best():
    rng = np.random.default_rng(3)
    for _ in range(40):
        lengths = np.unique(rng.integers(1, 20, 5))
        most, prices = rng.integers(1, 4, len(lengths)), rng.random(len(lengths))
        worth, fills = configurations.best_fills(30, lengths, most, prices)
        options = itertools.product(*(range(m + 1) for m in most))
        assert worth == pytest.approx(max(np.dot(o, prices) for o in options if np.dot(o, lengths) <= 30))
        assert sum(t * prices[i] for i, t in fills[0]) == pytest.approx(worth)
        for fill in fills:
            assert sum(t * lengths[i] for i, t in fill) <= 30 and all(t <= most[i] for i, t in fill)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_plan_against_the_fewest(lengths):
    made = configurations.plan(dict(Counter(lengths)), 12)
    assert held(made) == Counter(lengths)
    best = fewest(12, sorted(lengths, reverse=True))
    assert made.lower_bound <= best <= made.sequences <= best + 1


@pytest.mark.parametrize("low,high,n,slack", [(1, 64, 20_000, 1.005), (1, 20, 500, 1.02), (20, 43, 30_000, 1.02)])
def test_plan_is_near_the_bound(low, high, n, slack):
    lengths = np.random.default_rng(n).integers(low, high, n)
    made = configurations.plan(dict(Counter(lengths.tolist())), 64)
    assert held(made) == Counter(lengths.tolist())
    assert made.lower_bound <= made.sequences <= slack * made.lower_bound + 1


def test_plan_of_full_and_equal_lengths():
    assert configurations.plan({}, 8).configurations == []
    made = configurations.plan({8: 10**12, 4: 10**12, 5: 1}, 8)
    assert held(made) == Counter({8: 10**12, 4: 10**12, 5: 1}) and made.sequences == 10**12 + 10**12 // 2 + 1
    with pytest.raises(ValueError):
        configurations.plan({9: 1}, 8)


def check(rows, expected, limit):
    documents, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        documents[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    for members in sequences.values():
        members.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in members] == [0, *np.cumsum([r["length"] for r in members])[:-1]]
        assert sum(r["length"] for r in members) <= limit
    for own in documents.values():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and [r["start"] for r in own] == [i * limit for i in range(len(own))]
        assert all(r["length"] == limit for r in own[:-1])
    assert {d: [i for r in own for i in r["ids"]] for d, own in documents.items()} == expected
    return sequences


@pytest.mark.parametrize("limit", [2048, 100, 7, 1])
def test_every_id_is_in_one_place(spark, limit):
    rows = {d: t for d, t in ODD if d is not None and (d != 6 or limit > 50)} | {100 + i: prose(i, 20 + i % 150) for i in range(40 if limit > 10 else 5)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5).withColumn("length", F.lit("clash"))
    packed = best_fit_packing.pack_whole(df, PATH, 0, limit, with_ids=True).collect()
    expected = {d: [*ids_of("word_bpe_49k.json", t)[:-1], 0] for d, t in rows.items()}
    sequences = check(packed, expected, limit)
    assert len(sequences) <= 1.05 * sum(map(len, expected.values())) / limit + 1


def test_odd_rows_and_nothing(odd, nothing):
    rows = best_fit_packing.pack_whole(odd, PATH, 0, 512).collect()
    assert sum(r["length"] for r in rows) == sum(len(ids_of("word_bpe_49k.json", t)) for _, t in ODD)
    assert sum(r["doc_id"] is None for r in rows) == 2 and sum(r["doc_id"] == 2 for r in rows) == 2 * len([r for r in rows if r["doc_id"] == 2 and r["piece"] == 0]) // 2
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert best_fit_packing.pack_whole(nothing, PATH, 0).collect() == []


def test_query_is_near_the_bound(spark):
    rows = QUERIES["op13_best_fit_packing"](spark, "/root/testdata/sf0.01").collect()
    used, sequences = sum(r["length"] for r in rows), len({r["sequence_id"] for r in rows})
    assert sequences <= -(-used // 2048) + 1
