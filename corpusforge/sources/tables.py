"""Parquet corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


PARTITIONS = "spark.corpusforge.readPartitions"


def read_table(spark: SparkSession, folder: str, name: str, partitions: int | None = None) -> DataFrame:
    """A Parquet table of a folder.

    `partitions`, or the setting `spark.corpusforge.readPartitions` of a caller, deals its rows to that many tasks.
    It is for small tables in few row groups, which few tasks would read; large ones need no such shuffle.
    """
    table = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    partitions = partitions or int(spark.conf.get(PARTITIONS, "0"))
    return table.repartition(partitions) if partitions else table
