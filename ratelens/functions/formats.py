"""How values are written in reports: money, percentages, percentage points, plural forms, Moscow time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(amount: Column) -> Column:
    """1234567.5 as "1 234 567,50 ₽", without ",00"."""
    return F.concat(F.regexp_replace(F.translate(F.format_number(amount, 2), ",.", " ,"), ",00$", ""), F.lit(" ₽"))


def percent(value: Column) -> Column:
    """12.50 as "12,5%"."""
    plain = F.format_string("%.6f", value.cast("double"))
    return F.concat(F.replace(F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", ""), F.lit("."), F.lit(",")), F.lit("%"))


def points(value: Column) -> Column:
    """Percentage points with two decimals and a comma."""
    return F.concat(F.replace(F.format_string("%.2f", value.cast("double")), F.lit("."), F.lit(",")), F.lit(" п.п."))


def plural(count: Column, one: str, few: str, many: str) -> Column:
    """The form of a noun after a number: 1 акция, 2 акции, 5 акций, 11 акций."""
    tail = F.abs(count) % 10
    return F.when((F.abs(count) % 100).between(11, 14), many).when(tail == 1, one).when(tail.between(2, 4), few).otherwise(many)


def moscow(moment: Column, with_time: bool = True) -> Column:
    """A UTC timestamp as Moscow time, with its zone; a dash for none."""
    shifted = moment + F.expr("INTERVAL 3 HOURS")
    return F.coalesce(F.date_format(shifted, "dd.MM.yyyy HH:mm 'МСК'" if with_time else "dd.MM.yyyy"), F.lit("—"))
