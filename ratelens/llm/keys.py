"""Row keys: rows are named by 128 bits of their values, as two of 1e10 rows would share 64."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_key(*columns: Column) -> Column:
    """struct<k1, k2> of a row's values; rows with equal values have equal keys. Never null."""
    return F.struct(F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit("second"), *columns).alias("k2"))


def type_of(df: DataFrame, column: str) -> str:
    """The column's type as Spark writes it in a schema string."""
    return df.schema[column].dataType.simpleString()
