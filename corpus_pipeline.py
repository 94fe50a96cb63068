"""From raw documents to a training mix: five operators in a row, each on all that the one before kept.

quality     documents that the quality classifier rejects go
near_dedup  one document of each near-duplicate component stays
decontaminate  documents that hold a benchmark window go
secrets     secrets in texts are replaced by [SECRET], n_chars follows
mix         documents that the mix takes words from, with the number it takes in mix_words

All but the last return the columns of documents. There is no SQL for the whole (a factorisation machine is
trained in it); tests/llm/test_pipeline.py holds every stage against a brute-force version.
A stage's table is removed once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratelens.llm import decontaminate, mixing, near_dup, quality_fm, secrets_rf
from ratelens.sources.tables import cut, drop, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_fm.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets_rf.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("secrets", secrets), ("mix", mix)]

#: Training isn't SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop(*written)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
