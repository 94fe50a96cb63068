"""Frames for export: long format, fingerprints, BI tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.functions.text import formula_safe


def long_format(rows: DataFrame, ids: list[str], parameters: list[str]) -> DataFrame:
    """One row for each known parameter of each product."""
    return rows.unpivot(ids, parameters, "parameter", "value").where("value is not null")


def trimmed(number: Column, places: int = 4) -> Column:
    """A number as text with at most `places` decimals and no trailing zeros."""
    text = F.format_string(f"%.{places}f", number.cast("double"))
    return F.when(number.isNotNull(), F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def fingerprint(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row: 12 hex digits that depend on the content of a (small, aggregated) dataset and not on its order.

    Rows are hashed where they are; only their digests are gathered, added up in a way that order doesn't matter.
    """
    line = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    digest = rows.select(F.conv(F.left(F.sha2(line, 256), F.lit(15)), 16, 10).cast("decimal(38,0)").alias("h"))
    return digest.agg(F.count("*").alias("rows"), F.left(F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum("h").cast("string")), 256), F.lit(12)).alias("fingerprint"))


def write_bi(rows: DataFrame, path: str, partition: str = "snapshot_date") -> None:
    """A BI table as CSV with cells that can't be formulas, one folder for each snapshot date; reruns replace their dates."""
    safe = rows.select(*[formula_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])
    safe.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).option("header", True).csv(path)


def write_snapshot(rows: DataFrame, path: str, partition: str = "snapshot_date") -> None:
    """A snapshot table as parquet, partitioned by date; reruns replace their dates."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
