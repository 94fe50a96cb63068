"""Declared constraints of a configuration or dataset: what breaks them, as rows, and how many in one pass.

Conditions on a row are one projection over the rows; constraints on several rows (unique, at most one, known elsewhere) are one
aggregation or join by their key each, and only the keys that break them meet the rows again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ratelens.functions.text import url_host


@dataclass
class Holds:
    """A condition on each row; null counts as broken."""

    name: str
    condition: Column


@dataclass
class Unique:
    """No two rows share the columns' values; rows with a null among them are left to a Holds."""

    name: str
    columns: Sequence[str]


@dataclass
class AtMostOne:
    """At most one row of each group (of all rows, without columns) has the condition."""

    name: str
    condition: Column
    within: Sequence[str] = ()


@dataclass
class Known:
    """The columns' values, in order, are those of a row of another table."""

    name: str
    columns: Sequence[str]
    of: DataFrame


def violations(rows: DataFrame, id_col: str, constraints: Sequence[Holds | Unique | AtMostOne | Known]) -> DataFrame:
    """(constraint, id): every row that breaks a constraint, once for each."""
    parts = []
    conditions = [c for c in constraints if isinstance(c, Holds)]
    if conditions:
        broken = F.array_compact(F.array(*[F.when(~F.coalesce(c.condition, F.lit(False)), c.name) for c in conditions]))
        parts.append(rows.select(F.explode(broken).alias("constraint"), F.col(id_col).alias("id")))
    for c in constraints:
        if isinstance(c, Unique):
            keys = [F.col(k).alias(f"__{i}") for i, k in enumerate(c.columns)]
            same = [rows[k] == F.col(f"__{i}") for i, k in enumerate(c.columns)]
            twice = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1")
            parts.append(rows.join(twice, reduce(Column.__and__, same), "left_semi").select(F.lit(c.name), F.col(id_col)))
        elif isinstance(c, AtMostOne):
            marked = rows.where(c.condition)
            keys = [F.col(k).alias(f"__{i}") for i, k in enumerate(c.within)]
            many = marked.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1")
            same = [marked[k].eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(c.within)]
            # Without groups `many` is one row or none.
            met = marked.join(many, reduce(Column.__and__, same), "left_semi") if same else marked.join(F.broadcast(many.select(F.lit(True).alias("__many"))), F.col("__many"), "left_semi")
            parts.append(met.select(F.lit(c.name), F.col(id_col)))
        elif isinstance(c, Known):
            known = c.of.distinct().toDF(*[f"__{i}" for i in range(len(c.columns))])
            same = [rows[k] == F.col(f"__{i}") for i, k in enumerate(c.columns)]
            parts.append(rows.join(known, reduce(Column.__and__, same), "left_anti").select(F.lit(c.name), F.col(id_col)))
    return reduce(DataFrame.union, [p.toDF("constraint", "id") for p in parts])


def observed(rows: DataFrame, constraints: Sequence[Holds], name: str = "constraints") -> tuple[DataFrame, Observation]:
    """The rows as they are, with an observation of their number and of how many break each condition, taken while they are written."""
    seen = Observation(name)
    counts = [F.count(F.when(~F.coalesce(c.condition, F.lit(False)), 1)).alias(c.name) for c in constraints]
    return rows.observe(seen, F.count("*").alias("rows"), *counts), seen


def of_hosts(url: Column, hosts: Column) -> Column:
    """The url's host is one of the hosts or a subdomain of one; www. is left out of account."""
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    return F.exists(hosts, lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h)))


def source_constraints(banks: DataFrame) -> list[Known | Unique | Holds]:
    """Constraints of sources (bank, key, url, mode, hosts of its bank) of a registry. banks: slug."""
    return [
        Known("unknown_bank", ["bank"], banks.select("slug")),
        Unique("repeated_source", ["bank", "key"]),
        Holds("mode", F.col("mode").isin("fetch", "manual")),
        Holds("foreign_host", F.col("hosts").isNull() | of_hosts(F.col("url"), F.col("hosts"))),
    ]


def dataset_constraints() -> list[Holds]:
    """Constraints of a report's products (documents: ids, checked_at, name, url, rate_min, rate_max); documents known to the dataset are joined as `known`.

    A product is traceable to saved documents, has a day of checking, isn't made up, and its rates are percentages.
    """
    # Words of made-up data.
    synthetic = r"(?iu)\b(test|demo|example|lorem|тест|демо)\b"
    return [
        Holds("no_document", (F.size("documents") > 0) & (F.size(F.array_except("documents", "known")) == 0)),
        Holds("no_check_date", F.col("checked_at").isNotNull()),
        Holds("synthetic", ~F.concat_ws(" ", "name", "url").rlike(synthetic)),
        *[Holds(c, F.col(c).isNull() | F.col(c).between(0, 100)) for c in ("rate_min", "rate_max")],
    ]


def with_known(products: DataFrame, documents: DataFrame, id_col: str) -> DataFrame:
    """products with `known`: those of their documents that exist. documents: document."""
    each = products.select(F.col(id_col).alias("__id"), F.explode("documents").alias("document")).join(documents.select("document").distinct(), "document")
    found = each.groupBy("__id").agg(F.collect_set("document").alias("known"))
    return products.join(found, F.col(id_col) == F.col("__id"), "left").drop("__id").withColumn("known", F.coalesce("known", F.array().cast(products.schema["documents"].dataType)))
