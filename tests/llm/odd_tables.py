"""A small table with every kind of odd row, and columns that clash with names the operators use."""

import random

import pytest
from pyspark.sql import functions as F

CLASHES = "start length fingerprint component_id score predicted kept n_words item_id containment shingle seed text_key node root range run a b n h label grade".split()
WORDS = "river stone cloud amber north silver candle meadow harbor thunder velvet copper lantern orchard winter garden pebble falcon timber marble".split()


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) + rng.choice(["", "", "", ",", "."]) for _ in range(words))


PASSAGE = prose(1, 90)
ODD = [
    (1, PASSAGE + "\n" + prose(2, 60)),
    (2, prose(3, 40) + " " + PASSAGE),
    (2, prose(3, 40) + " " + PASSAGE),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (None, prose(4, 30)),
    (None, None),
    (6, prose(5, 12_000)),
    (7, "word"),
    (8, "one two"),
    (9, "same line here\nsame line here\n\nother"),
    (10, "x" * 3000),
    (11, "Ünïcödé ßtraße — 東京 ΣΑΣ  double  spaces wide space <|endoftext|>"),
    (12, prose(6, 50)),
    (13, prose(6, 50).replace("river", "rivers", 1)),
    (14, prose(6, 50)),
    (15, "0 1 2 ... !!! $$$"),
]


def odd_rows(spark, rows=ODD):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    extra = {c: F.lit(7) for c in CLASHES}
    return df.withColumns({"lang": F.lit(None).cast("string"), "source": F.when(F.col("doc_id") % 2 == 0, "even"), "n_chars": F.length("text").cast("long")} | extra)


@pytest.fixture
def odd(spark):
    return odd_rows(spark)


@pytest.fixture
def nothing(spark):
    return odd_rows(spark).limit(0)
