"""Bounded samples of labelled rows for training, the same for the same rows wherever they are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`: the folds of the labelled rows. Null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(0))


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, held_out: int, modulus: int, bound: int, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, text, label, extra columns) of at most `bound` labelled documents outside the held-out fold.

    The ids are the lowest by a hash, found by a top-k that each task cuts to `bound` rows. They are few by construction,
    so they are broadcast. Defined results: an id labelled more than once counts with its highest label; an id on several
    rows counts once, with its greatest text; null ids and labels other than 0 and 1 are left out; empty tables
    give no rows; other columns are ignored, whatever their names.
    """
    usable = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where(F.col("__label").isin(0, 1) & F.col("__id").isNotNull())
    usable = usable.where(remainder(F.col("__id"), modulus) != held_out).groupBy("__id").agg(F.max("__label").alias("__label"))
    chosen = usable.orderBy(F.xxhash64(F.lit(label_col), "__id"), "__id").limit(bound)
    extra = extra or {}
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("text"), *(c.alias(n) for n, c in extra.items()))
    found = texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).groupBy("__doc").agg(F.max(F.struct("text", *extra)).alias("row"), F.max("__label").alias("label"))
    return found.select(F.col("__doc").alias("doc_id"), "row.text", "label", *(f"row.{n}" for n in extra))
