"""Readers for the driver's parquet tables, and the way the library cuts long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder; projections and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, local mode gets a temporary folder; a cluster gets an error, as its machines share none.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or tempfile.mkdtemp(prefix="ratelens-")).rstrip("/")


def cut(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    The result has no lineage before the written files, so a lost executor costs one read, and each
    reader of the table starts from the same rows. Unlike an eager checkpoint() it computes df once.
    drop() removes the table when nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ratelens/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.cut_path = path
    return written


def drop(*tables: DataFrame) -> None:
    """Remove tables that cut() returned. Call it once whatever was made from them has itself been written."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
