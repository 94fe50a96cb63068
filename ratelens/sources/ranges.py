"""Places of rows in a global order without a single task: a range sort, numbers within ranges, and the ranges' starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.sources.tables import cut, drop

#: Starts of ranges (about 30 bytes each) are broadcast up to this many; beyond, the join shuffles.
BROADCAST_RANGES = 1_000_000
#: Bits of a row's number within its range, as monotonically_increasing_id() sets them.
_BITS = 33


def sorted_ranges(df: DataFrame, order: list[Column], name: str = "ranges") -> DataFrame:
    """df written in the given order, with `__range` (ascending along the order) and `__at` (0, 1, 2... within the range)."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    return cut(ranges.select(*df.columns, F.shiftright("__id", _BITS).cast("int").alias("__range"), F.col("__id").bitwiseAND(F.lit((1 << _BITS) - 1)).alias("__at")), name)


def bounded(rows: DataFrame, most: int = BROADCAST_RANGES) -> DataFrame:
    """The rows marked for a broadcast if they are few enough."""
    return F.broadcast(rows) if rows.count() <= most else rows


def _numbered(df: DataFrame, order: list[Column], column: str) -> tuple[DataFrame, list[DataFrame]]:
    placed = sorted_ranges(df, order)
    counts = placed.groupBy("__range").agg(F.count("*").alias("n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = cut(counts.select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start")), "range-starts")
    return placed.join(bounded(starts), "__range").select(*df.columns, (F.col("__start") + F.col("__at")).alias(column)), [placed, starts]


def numbered(df: DataFrame, order: list[Column], column: str) -> DataFrame:
    """df with its rows' places 0, 1, 2... in the given order.

    The order should tell different rows apart; equal rows share a range, so a row repeated very often makes one large range.
    """
    return _numbered(df, order, column)[0]


def cut_numbered(df: DataFrame, order: list[Column], column: str, name: str) -> DataFrame:
    """numbered(), written as a table."""
    found, read = _numbered(df, order, column)
    found = cut(found, name)
    drop(*read)
    return found
