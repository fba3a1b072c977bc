"""Writes that appear whole or not at all."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusforge.sinks import committed

SCHEMA = "k long, t string, x double, flag boolean"
ROWS = [(1, "a \"quoted\"\nline, é", 0.5, True), (2, None, None, None), (3, "", -1.25, False), (None, "\\ back", 3.0, True)]


@pytest.fixture
def table(spark):
    committed.register(spark)
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def read(spark, path, **options):
    return sorted(map(repr, map(tuple, spark.read.format(committed.NAME).schema(SCHEMA).options(**options).load(path).collect())))


@pytest.mark.parametrize("fmt", committed.FORMATS)
def test_round_trip_append_overwrite_and_old_commits(spark, table, tmp_path, fmt):
    path = str(tmp_path / "out")
    write = lambda df, mode: df.write.format(committed.NAME).option("format", fmt).option("rowsPerFile", 1).mode(mode).save(path)
    want = sorted(map(repr, ROWS))
    write(table, "append")
    assert read(spark, path) == want
    write(table, "append")
    assert read(spark, path) == sorted(want * 2)
    write(table.filter("k = 1"), "overwrite")
    assert read(spark, path) == [repr(ROWS[0])] and read(spark, path, number=2) == sorted(want * 2)
    write(table.limit(0), "append")
    assert read(spark, path) == [repr(ROWS[0])]


def test_a_failing_task_leaves_nothing_visible(spark, table, tmp_path):
    path = str(tmp_path / "out")
    table.write.format(committed.NAME).mode("append").save(path)
    before = read(spark, path)

    @F.udf("string")
    def breaks(t):
        if t == "row 997":
            raise RuntimeError("lost")
        return t

    many = spark.range(0, 1000, 1, 4).select(F.col("id").alias("k"), breaks(F.concat(F.lit("row "), "id")).alias("t"), F.lit(1.0).alias("x"), F.lit(True).alias("flag"))
    with pytest.raises(PySparkException):
        many.write.format(committed.NAME).option("rowsPerFile", 10).mode("overwrite").save(path)
    assert read(spark, path) == before
    assert len(os.listdir(f"{path}/commits")) == 1 and len(os.listdir(f"{path}/data")) == len(committed.committed(*committed.open_folder(path))["files"])


def test_a_write_that_was_overtaken_is_refused(spark, table, tmp_path):
    path = str(tmp_path / "out")
    late = committed.CommittedWriter({"path": path}, table.schema, False)
    table.write.format(committed.NAME).mode("append").save(path)
    with pytest.raises(RuntimeError):
        late.commit([committed.Written([("x", 1)])])
    assert read(spark, path) == sorted(map(repr, ROWS))
    with pytest.raises(PySparkException):
        table.write.format(committed.NAME).option("format", "csv").mode("append").save(path)
    with pytest.raises(PySparkException):
        table.write.format(committed.NAME).option("format", "pdf").mode("append").save(path)
    assert read(spark, path) == sorted(map(repr, ROWS))
