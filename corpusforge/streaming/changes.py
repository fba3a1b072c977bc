"""Added, modified and deleted files of a folder that is listed again and again, as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "path string, change string, listing long"


class PathState(StatefulProcessor):
    """What is known of one path: its time stamp, the number of the last listing that had it, and that listing's time.

    A path of the last listing holds a timer just behind that listing's time. It goes off once a later
    listing has moved the watermark on, unless the path has been seen there and the timer moved: then it is deleted.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "stamp long, listing long, at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # State is read and written once per path and batch: each access is a message to the JVM.
        out, known = [], self.seen.get()
        before = known
        for stamp, listing, at in sorted(((r["stamp"], r["listing"], r["at"]) for r in rows), key=itemgetter(1)):
            if known is not None and listing > known[1] + 1:
                # Missing in a listing between: gone, and now here again.
                out.append(Row(path=key[0], change="deleted", listing=known[1] + 1))
                known = None
            if known is None:
                out.append(Row(path=key[0], change="added", listing=listing))
            elif known[0] != stamp:
                out.append(Row(path=key[0], change="modified", listing=listing))
            known = (stamp, listing, at)
        if before is not None and before[2] != known[2]:
            self.handle.deleteTimer(before[2] + 1)
        self.seen.update(known)
        if before is None or before[2] != known[2]:
            self.handle.registerTimer(known[2] + 1)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.seen.get()
        self.seen.clear()
        yield Row(path=key[0], change="deleted", listing=known[1] + 1)

    def close(self) -> None:
        pass


def file_changes(listings: DataFrame, apart: str = "1 second") -> DataFrame:
    """`added`, `modified` or `deleted` for every path, with the number of the listing that showed it.

    `listings` is a stream of path, mtime, listing (a number that goes up by one) and listed_at, its time; listings are
    more than `apart` apart, and all rows of one come before the next one's. State is one row per path that is
    there, kept in RocksDB by key; a deleted path leaves none. Needs the RocksDB state store (`use_rocksdb`).
    A deletion is reported once a later listing has come.
    """
    rows = listings.withWatermark("listed_at", apart).select(
        "path", F.unix_micros("mtime").alias("stamp"), F.col("listing").cast("long").alias("listing"), F.unix_millis("listed_at").alias("at"), "listed_at"
    )
    return rows.groupBy("path").transformWithState(PathState(), CHANGES, "Append", "eventTime")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
