"""Runs: what came since the last good one, entries that are fresh enough, and one writer at a time."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def last_success(runs: DataFrame) -> DataFrame:
    """One row: the start of the newest run (by its number) with status ok, null if there is none. runs: run, started, status."""
    return runs.where("status = 'ok'").agg(F.max_by("started", "run").alias("since"))


def since_last_success(posts: DataFrame, runs: DataFrame, at: str, default: Column) -> DataFrame:
    """Posts after the start of the last successful run; where no run has succeeded, after `default`. A failed run moves nothing."""
    since = last_success(runs).select(F.coalesce("since", default).alias("__since"))  # one row
    return posts.join(F.broadcast(since), F.col(at) > F.col("__since")).drop("__since")


def fresh_entries(cache: DataFrame, key: str, at: str, now: Column, days: int) -> DataFrame:
    """The newest entry of each key, if it is less than `days` whole days old."""
    newest = cache.groupBy(key).agg(F.max(F.struct(at, *[c for c in cache.columns if c not in (key, at)])).alias("__e")).select(key, "__e.*")
    age = F.floor((F.unix_micros(now) - F.unix_micros(F.col(at).cast("timestamp"))) / F.lit(86_400_000_000))
    return newest.where(age < days).select(*cache.columns)


@contextmanager
def single_writer(spark: SparkSession, path: str, ttl_seconds: int = 3600) -> Iterator[bool]:
    """Whether this caller may write: True for the one that made the lock file at `path`, False while another one's is younger than the ttl.

    The file system makes the file for one caller only. A lock that outlived its ttl is moved away, which only one caller can do,
    and made anew. It is removed at the end if it is still one's own.
    """
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    lock, token = hadoop.Path(path), uuid.uuid4().hex
    files = lock.getFileSystem(context._jsc.hadoopConfiguration())

    def made() -> bool:
        try:
            out = files.create(lock, False)
        except Exception as error:  # py4j wraps what the file system throws
            if "already exists" in str(error):
                return False
            raise
        out.write(token.encode())
        out.close()
        return True

    got = made()
    if not got and files.exists(lock):
        age = context._jvm.java.lang.System.currentTimeMillis() - files.getFileStatus(lock).getModificationTime()
        stale = hadoop.Path(f"{path}.{token}")
        if age > ttl_seconds * 1000 and files.rename(lock, stale):
            files.delete(stale, False)
            got = made()
    try:
        yield got
    finally:
        if got and files.exists(lock):
            inside = files.open(lock)
            own = bytes(inside.readAllBytes()).decode() == token
            inside.close()
            if own:
                files.delete(lock, False)
