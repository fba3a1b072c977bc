"""Changes of a listed folder as a stream, against the difference of listings."""

import os

import pytest
from pyspark.sql import functions as F

from corpusforge.operators.manifest import snapshot_diff
from corpusforge.streaming import changes, corpus

LISTINGS = [
    {"a": 1, "b": 1, "c": 1, "d": 1},
    {"a": 1, "b": 2, "d": 1, "e": 5},
    {"a": 3, "c": 1, "d": 1, "e": 5, "f": 9},
    {"a": 3, "c": 1, "d": 2},
]


@pytest.mark.parametrize("at_once", [1, 100])
def test_changes_equal_the_differences(spark, tmp_path, at_once):
    changes.use_rocksdb(spark)
    frames = []
    for number, files in enumerate(LISTINGS):
        rows = [(p, s, number, (number + 1) * 86_400) for p, s in files.items()]
        df = spark.createDataFrame(rows, "path string, s long, listing long, t long").select("path", F.timestamp_seconds("s").alias("mtime"), "listing", F.timestamp_seconds("t").alias("listed_at"))
        (tmp_path / "in").mkdir(exist_ok=True)
        df.toPandas().to_parquet(tmp_path / "in" / f"listing-{number}.parquet", coerce_timestamps="us", index=False)
        # A stream takes files by their time.
        os.utime(tmp_path / "in" / f"listing-{number}.parquet", (1_700_000_000 + 60 * number,) * 2)
        frames.append(df)
    want = {(p, "added", 0) for p in LISTINGS[0]}
    for number in range(1, len(frames)):
        want |= {(r["path"], r["change"], number) for r in snapshot_diff(frames[number - 1], frames[number]).collect()}
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", at_once).parquet(str(tmp_path / "in"))
    query = corpus.append_to(changes.file_changes(stream, "1 hour"), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    got = [tuple(r) for r in spark.read.schema(changes.CHANGES).parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(want)


def test_state_is_read_and_written_once_per_batch():
    """Each access is a message to the JVM, so a path of many listings in one batch costs as many as a path of one."""
    from pyspark.sql import Row

    class Handle:
        calls, timers, value = [], set(), None

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def exists(self):
            self.calls.append("exists")
            return self.value is not None

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def registerTimer(self, at):
            self.calls.append("register")
            self.timers.add(at)

        def deleteTimer(self, at):
            self.calls.append("delete")
            self.timers.discard(at)

    path, handle = changes.PathState(), Handle()
    path.init(handle)
    rows = [Row(stamp=s, listing=n, at=10 * n) for n, s in ((5, 8), (0, 7), (2, 8), (1, 7), (3, 8))]
    out = [(r["change"], r["listing"]) for r in path.handleInputRows(("p",), iter(rows), None)]
    assert out == [("added", 0), ("modified", 2), ("deleted", 4), ("added", 5)]
    assert handle.calls == ["get", "update", "register"] and handle.timers == {51}
    assert list(path.handleInputRows(("p",), iter([Row(stamp=8, listing=6, at=60)]), None)) == [] and handle.timers == {61}
