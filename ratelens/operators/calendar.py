"""Leave calendars: intervals unrolled to days, load of each day, worst day of each month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def days_of(intervals: DataFrame, start: str, end: str, *keep: str) -> DataFrame:
    """One row for each day of each interval: the interval join as an equi-join on days."""
    return intervals.where(F.col(end) >= F.col(start)).select(*keep, F.explode(F.sequence(F.col(start).cast("date"), F.col(end).cast("date"))).alias("day"))


def daily_load(intervals: DataFrame, start: str, end: str, who: str, staff: int, limit_share: float) -> DataFrame:
    """day, away, share of staff, over (more than the limit)."""
    load = days_of(intervals, start, end, who).groupBy("day").agg(F.countDistinct(who).alias("away"))
    return load.select("day", "away", F.round(F.col("away") / staff, 4).alias("share"), (F.col("away") > staff * limit_share).alias("over"))


def monthly_peak(load: DataFrame) -> DataFrame:
    return load.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.max("away").alias("peak"), F.count_if("over").alias("days_over"), F.count("*").alias("days"))


def extended_end(intervals: DataFrame, start: str, length: str, holidays: DataFrame, *keep: str) -> DataFrame:
    """End of a leave of `length` counted days from start, holidays not counted.

    holidays: a year's few dates, broadcast as one array.
    """
    free = holidays.agg(F.collect_set(F.col("holiday").cast("date")).alias("__free"))
    rows = intervals.crossJoin(F.broadcast(free))
    first = F.col(start).cast("date")
    horizon = F.sequence(first, F.date_add(first, F.col(length) + F.size("__free")))
    counted = F.filter(horizon, lambda d: ~F.array_contains("__free", d))
    return rows.select(*keep, start, length, F.get(counted, F.col(length) - 1).alias("end"))
