"""Row numbers and running values over an order, for groups of any size.

A plain window would send a whole group (or, without a group, the whole table) to one task. Here
the rows are range-partitioned on group and order, so that one hot group spreads over many parts;
each part computes its own running values, and what the earlier parts of the same group add up to
is carried in. Only groups that cross a part border have something to carry, so the carried table
has at most one row per part and is safe to broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.session import materialize

PART = "_part"
#: Rows of one ordered part, about: what one task sorts.
PART_ROWS = 1_000_000


@dataclass(frozen=True)
class RowNumber:
    """Position in the group, from 1."""

    def local(self, ordered, span) -> Column:
        return F.row_number().over(ordered).cast("long")

    def total(self) -> Column:
        return F.count(F.lit(1))

    carry = staticmethod(F.sum)

    def add(self, own: Column, before: Column) -> Column:
        return own + F.coalesce(before, F.lit(0))


@dataclass(frozen=True)
class RunningSum:
    """Sum of `value` over the group up to and including the row."""

    value: Column

    def local(self, ordered, span) -> Column:
        return F.sum(self.value).over(span)

    def total(self) -> Column:
        return F.sum(self.value)

    carry = staticmethod(F.sum)

    def add(self, own: Column, before: Column) -> Column:
        return F.coalesce(own + before, own, before)


@dataclass(frozen=True)
class RunningMax:
    """Greatest `value` of the group up to and including the row; null before the first."""

    value: Column

    def local(self, ordered, span) -> Column:
        return F.max(self.value).over(span)

    def total(self) -> Column:
        return F.max(self.value)

    carry = staticmethod(F.max)

    def add(self, own: Column, before: Column) -> Column:
        return F.greatest(own, before)


class OrderedRows:
    """Rows of `df` in the order `group`, `order`; `order` must be unique within a group.

    Unless `parts`, the number of ordered parts, is given, the rows are counted: a part holds about
    `PART_ROWS` rows, and there are at least as many parts as the session has shuffle partitions."""

    def __init__(self, df: DataFrame, group: list[str], order: list[Column | str], parts: int | None = None):
        n = parts or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PART_ROWS))
        ranged = df.repartitionByRange(n, *group, *order).withColumn(PART, F.spark_partition_id())
        # Written once: the borders between parts must not move while later steps read them.
        self.df, self.group, self.order = materialize(ranged, "ordered"), group, order

    def add(self, **values: RowNumber | RunningSum | RunningMax) -> "OrderedRows":
        """Add running columns, all in one pass. A value may use columns added before."""
        ordered = Window.partitionBy(*self.group, PART).orderBy(*self.order)
        span = ordered.rowsBetween(Window.unboundedPreceding, 0)
        before = Window.partitionBy(*self.group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)

        totals = self.df.groupBy(*self.group, PART).agg(*[v.total().alias(f"_{name}") for name, v in values.items()])
        carried = totals.select(
            *self.group,
            PART,
            F.row_number().over(Window.partitionBy(*self.group).orderBy(PART)).alias("_rank"),
            *[v.carry(F.col(f"_{name}")).over(before).alias(f"_{name}") for name, v in values.items()],
        ).filter("_rank > 1")

        own = self.df.select("*", *[v.local(ordered, span).alias(name) for name, v in values.items()])
        on = F.col(f"a.{PART}") == F.col(f"b.{PART}")
        for key in self.group:
            on = on & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
        # At most one row per part: the group that goes on from an earlier part.
        joined = own.alias("a").join(F.broadcast(carried.alias("b")), on, "left")
        finished = [v.add(F.col(f"a.{name}"), F.col(f"b._{name}")).alias(name) for name, v in values.items()]

        new = OrderedRows.__new__(OrderedRows)
        new.df = joined.select(*[F.col(f"a.{c}") for c in self.df.columns], *finished)
        new.group, new.order = self.group, self.order
        return new

    @property
    def rows(self) -> DataFrame:
        return self.df.drop(PART)


def number_rows(df: DataFrame, group: list[str], order: list[Column | str], name: str = "row_no", parts: int | None = None) -> DataFrame:
    return OrderedRows(df, group, order, parts).add(**{name: RowNumber()}).rows


def sliding_average(
    df: DataFrame, group: list[str], order: list[Column | str], value: str, moment: str, n: int, span: int = 100_000
) -> DataFrame:
    """Mean of the last `n` rows of the group, how many they are, and the seconds they cover.

    The rows of a group are numbered and cut into spans; each span also gets the `n - 1` rows
    before it, so no group needs to fit one task.
    """
    numbered = number_rows(df, group, order, "_n")
    span = max(span, n)
    own = F.floor((F.col("_n") - 1) / span)
    leads = (F.col("_n") - 1) % span >= span - (n - 1)
    copies = F.when(leads, F.array(own, own + 1)).otherwise(F.array(own))
    spread = numbered.withColumn("_span", F.explode(copies)).withColumn("_own", F.col("_span") == own)
    frame = Window.partitionBy(*group, "_span").orderBy("_n").rowsBetween(-(n - 1), 0)
    at = F.col(moment).cast("timestamp")
    result = spread.select(
        "*",
        F.avg(value).over(frame).alias("moving_avg"),
        F.count(value).over(frame).alias("sample_count"),
        (F.unix_micros(at) - F.unix_micros(F.first(at).over(frame))).alias("_micros"),
    )
    return result.filter("_own").withColumn("span_seconds", F.col("_micros") / 1e6).drop("_n", "_span", "_own", "_micros")
