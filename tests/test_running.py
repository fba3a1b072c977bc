import random

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import running
from corpusforge.operators.running import OrderedRows, RowNumber, RunningMax, RunningSum, number_rows, sliding_average


@pytest.fixture(scope="module")
def rows():
    """One group holds most rows, one key is null, some groups are tiny."""
    rnd = random.Random(2)
    keys = ["hot"] * 700 + [None] * 200 + [f"k{rnd.randint(0, 40)}" for _ in range(300)]
    rnd.shuffle(keys)
    return [(k, i, rnd.randint(-5, 9), rnd.random() < 0.3) for i, k in enumerate(keys)]


def expected(rows, grouped, descending=False):
    state, out = {}, {}
    for key, i, v, flag in sorted(rows, key=lambda r: -r[1] if descending else r[1]):
        n, total, top = state.get(key if grouped else 0, (0, 0, None))
        n, total = n + 1, total + v
        top = (v if top is None else max(top, v)) if flag else top
        state[key if grouped else 0] = (n, total, top)
        out[i] = (n, total, top)
    return out


@pytest.mark.parametrize("grouped", [True, False])
@pytest.mark.parametrize("parts", [1, 7, 32])
def test_running_values(spark, rows, grouped, parts):
    df = spark.createDataFrame(rows, "k string, i int, v int, flag boolean")
    ordered = OrderedRows(df, ["k"] if grouped else [], ["i"], parts)
    out = ordered.add(n=RowNumber(), s=RunningSum(F.col("v")), m=RunningMax(F.when(F.col("flag"), F.col("v")))).rows
    assert {r["i"]: (r["n"], r["s"], r["m"]) for r in out.collect()} == expected(rows, grouped)


def test_descending_order_and_chained_values(spark, rows):
    df = spark.createDataFrame(rows, "k string, i int, v int, flag boolean")
    ordered = OrderedRows(df, [], [F.col("i").desc()], 5).add(n=RowNumber()).add(last=RunningMax(F.when(F.col("flag"), F.col("n"))))
    got = {r["i"]: (r["n"], r["last"]) for r in ordered.rows.collect()}
    last = None
    for n, (_, i, _, flag) in enumerate(sorted(rows, key=lambda r: -r[1]), 1):
        last = n if flag else last
        assert got[i] == (n, last)


def test_hot_group_is_split(spark, rows):
    df = spark.createDataFrame(rows, "k string, i int, v int, flag boolean")
    staged = OrderedRows(df, ["k"], ["i"], 8).df
    biggest = staged.groupBy("_part").count().agg(F.max("count")).first()[0]
    assert biggest < len(rows) / 3


@pytest.mark.parametrize("span", [1, 3, 10, 1000])
def test_sliding_average(spark, rows, span):
    n = 4
    df = spark.createDataFrame([(k, i, v) for k, i, v, _ in rows], "k string, i int, v int")
    df = df.withColumn("ts", F.timestamp_seconds("i"))
    got = {r["i"]: (r["moving_avg"], r["sample_count"], r["span_seconds"]) for r in sliding_average(df, ["k"], ["i"], "v", "ts", n, span).collect()}
    seen = {}
    for k, i, v, _ in sorted(rows, key=lambda r: r[1]):
        frame = (seen.get(k, []) + [(i, v)])[-n:]
        seen[k] = frame
        assert got[i] == (pytest.approx(sum(x for _, x in frame) / len(frame)), len(frame), float(i - frame[0][0]))
    assert len(got) == len(rows)


def test_parts_grow_with_the_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(running, "PART_ROWS", 40)
    df = spark.createDataFrame(rows, "k string, i int, v int, flag boolean")
    ordered = OrderedRows(df, [], ["i"])
    sizes = [r["count"] for r in ordered.df.groupBy("_part").count().collect()]
    assert 25 <= len(sizes) <= 30 and max(sizes) < 120
    out = ordered.add(n=RowNumber(), s=RunningSum(F.col("v")), m=RunningMax(F.when(F.col("flag"), F.col("v")))).rows
    assert {r["i"]: (r["n"], r["s"], r["m"]) for r in out.collect()} == expected(rows, False)


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, i int")
    assert number_rows(df, ["k"], ["i"]).count() == 0
