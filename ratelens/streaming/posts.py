"""Structured Streaming over posts: bounded dedup, fixed slots, late repeats that attach, output that is sent once.

Timestamps of files without a zone are read as UTC; watermarks need TIMESTAMP, so event time is cast first.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HORIZON = "3 days"


def read_posts(spark: SparkSession, path: str, schema: T.StructType, at: str = "ts", files_per_batch: int = 1) -> DataFrame:
    """A folder of parquet files as a stream, with event time as TIMESTAMP."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn(at, F.col(at).cast("timestamp"))


def deduplicated(posts: DataFrame, keys: list[str], at: str = "ts", horizon: str = HORIZON) -> DataFrame:
    """Each key once within the horizon; state older than the watermark is dropped."""
    return posts.withWatermark(at, horizon).dropDuplicatesWithinWatermark(keys)


def slot_counts(posts: DataFrame, at: str = "ts", slot: str = "4 hours", offset: str = "0 seconds", lateness: str = "1 hour") -> DataFrame:
    """Tumbling slots: slot_start, n, total."""
    w = F.window(F.col(at), slot, slot, offset)
    return posts.withWatermark(at, lateness).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("slot_start"), "n", "total")


def sessions(posts: DataFrame, key: str, at: str = "ts", gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    w = F.session_window(F.col(at), gap)
    return posts.withWatermark(at, lateness).groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def attach_repeats(posts: DataFrame, key: str, id_col: str, at: str = "ts", horizon_ms: int = 3 * 24 * 3600 * 1000) -> DataFrame:
    """Every post with the first post of its key within the horizon and what to do: emit (it is the first) or attach.

    State is one (id, time) for each key, removed by an event-time timeout after the horizon.
    """
    out = T.StructType([T.StructField(key, posts.schema[key].dataType), T.StructField(id_col, T.LongType()), T.StructField("event", T.LongType()), T.StructField("action", T.StringType())])
    kept = T.StructType([T.StructField("event", T.LongType()), T.StructField("since", T.LongType())])

    def step(group: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values([at, id_col])
        event, since = state.get if state.exists else (None, None)
        found = []
        for post, when in zip(rows[id_col], rows[at]):
            ms = int(when.timestamp() * 1000)
            if event is None or ms - since > horizon_ms:
                event, since = int(post), ms
                found.append((group[0], int(post), event, "emit"))
            else:
                found.append((group[0], int(post), event, "attach"))
        state.update((event, since))
        state.setTimeoutTimestamp(max(since + horizon_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(found, columns=[key, id_col, "event", "action"])

    return posts.withWatermark(at, "1 hour").groupBy(key).applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.EventTimeTimeout)


def write_once(rows: DataFrame, path: str, checkpoint: str, keys: list[str], at: str | None = None, horizon_days: int = 3):
    """Append each key once over all batches: a batch that is run again replaces its own files.

    Every batch has a folder named by its id. With an event time `at`, the keys sent are logged by day beside the output, and a
    batch reads only the days from its earliest one less the horizon on: a key comes once within the horizon, and what a batch reads
    doesn't grow with the number of batches. Without it, keys of all earlier batches are read.
    """
    log = f"{path.rstrip('/')}_sent"

    def put(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.dropDuplicates(keys)
        if batch_id > 0 and at is None:
            sent = batch.sparkSession.read.schema(batch.schema).parquet(*[f"{path}/batch={i}" for i in range(batch_id)])
            fresh = fresh.join(sent.select(*keys), keys, "left_anti")
        elif batch_id > 0:
            first = batch.agg(F.date_sub(F.to_date(F.min(at)), horizon_days)).first()[0]
            if first is not None:
                kept = ", ".join(f"`{c}` {batch.schema[c].dataType.simpleString()}" for c in keys)
                sent = batch.sparkSession.read.schema(f"{kept}, batch int, day date").parquet(log)
                fresh = fresh.join(sent.where((F.col("batch") < batch_id) & (F.col("day") >= F.lit(first))).select(*keys), keys, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if at is not None:
            # The keys of this batch's own files, so that a batch that is run again logs what it wrote.
            written = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/batch={batch_id}")
            written.select(*keys, F.to_date(at).alias("day")).write.mode("overwrite").partitionBy("day").parquet(f"{log}/batch={batch_id}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(rows: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and read its result (for tests and small digests)."""
    rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.table(name)
