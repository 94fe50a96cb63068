"""Target-distribution importance resampling by hashed word n-grams.

Features are all runs of 1 to `order` consecutive words, joined by one space; a feature's bucket is its crc32 modulo `buckets`.
A ring of running zlib states makes one scan of a text enough: at each word it holds the states of the runs that started at
the last `order` - 1 words, extends each by a space and the word, and starts a new one. No run is ever spelled out. Words are
taken a piece at a time, the states of one length after another, so that the loops run inside map().

Two scans over the texts: the first counts buckets over the whole corpus (each task sends at most `buckets` counts), the second
sums each document's bucket gains. Gains are a table of `buckets` numbers, bounded by that parameter. A document's score is its
weight plus Gumbel noise from a hash of its id, so the highest scores are a draw without replacement by importance.

Ranks need no single task: documents are sorted by ranges (those that may be drawn first, then by score), each row is
numbered within its range, and ranges start at the sum of those before (one row for each range).

Defined results: null text has no words and no features (weight 0); null ids hash as '42:' and come last among ties; repeated
rows each count and each get a row; ties go to the smaller id, then to fewer features; an empty corpus gives no rows, an empty
target counts as nothing but the smoothing of one; texts are scanned in pieces of bounded memory, however long; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.sources.ranges import numbered
from ratelens.sources.tables import cut, drop

#: Bytes as words are cut: A-Z made lower, separators [\x00-\x2F\x3A-\x60\x7B-\x7F] made blanks.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 18


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time; a piece ends at a separator."""
    plain = text.translate(WORDS)
    first = 0
    while first < len(plain):
        end = plain.find(b" ", first + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[first:end].split()
        first = end


def ring(text: bytes, order: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of their features) of each piece of a text, in one scan.

    The states of the runs that end at a word are those that ended at the word before, each extended, and a new one;
    the ring holds the last word's, from one piece to the next.
    """
    held: list[int | None] = [None] * order
    for words in _pieces(text):
        if not words:
            continue
        longer = [b" " + word for word in words]
        states: list[int | None] = list(map(crc32, words))
        found = [np.array(states, dtype=np.int64)]
        last: list[int | None] = [states[-1]]
        for n in range(1, order):
            before = [held[n - 1], *states[:-1]]
            skip = sum(state is None for state in before[:n])  # runs that would start before the text
            states = [None] * skip + list(map(crc32, longer[skip:], before[skip:]))
            found.append(np.array(states[skip:], dtype=np.int64))
            last.append(states[-1])
        held = last
        yield len(words), np.concatenate(found) % buckets


def _texts(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.large_binary()):
        yield value.as_buffer().to_pybytes() if value.is_valid else b""


def _counter(order: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in _texts(batch.column(0)):
                for _, hit in ring(text, order, buckets):
                    np.add.at(count, hit, 1)
        seen = np.flatnonzero(count)
        yield pa.record_batch([pa.array(seen), pa.array(count[seen])], names=["bucket", "n"])

    return run


def _scorer(order: int, gains: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((3, len(batch)), dtype=np.int64)
            for row, text in enumerate(_texts(batch.column("text"))):
                for words, hit in ring(text, order, len(gains)):
                    sums[:, row] += words, len(hit), gains[hit].sum()
            yield pa.record_batch([batch.column("doc_id"), batch.column("h"), *map(pa.array, sums)], names=["doc_id", "h", "n_words", "n_features", "weight"])

    return run


def bucket_counts(df: DataFrame, text_col: str = "text", order: int = 3, buckets: int = 10_000) -> DataFrame:
    """bucket, n: how often a feature of any text falls in each bucket that occurs."""
    counted = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_counter(order, buckets), "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", order: int = 3, buckets: int = 10_000) -> DataFrame:
    """bucket, gain: floor(1000 * ln of the smoothed share in the target over that in the documents), for every bucket."""
    spark = docs.sparkSession
    s = bucket_counts(docs, text_col, order, buckets).withColumnRenamed("n", "s")
    t = bucket_counts(target, text_col, order, buckets).withColumnRenamed("n", "t")
    both = cut(spark.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0, ["s", "t"]), "resample-counts")
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    smoothed = [F.col("t") + F.lit(1.0), F.lit(float(all_s + buckets)), F.col("s") + F.lit(1.0), F.lit(float(all_t + buckets))]
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(smoothed[0] * smoothed[1] / (smoothed[2] * smoothed[3]))).alias("gain"))


def gumbel(h: Column) -> Column:
    """floor(-1000 * ln(-ln(u))) for a uniform u from 32 bits."""
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 5,
    least_words: int = 20,
    order: int = 3,
    buckets: int = 10_000,
    seed: str = "42",
) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank: 1, 2, 3... for the drawn ones, else null."""
    gains = np.zeros(buckets, dtype=np.int64)
    for row in bucket_gains(docs, target, text_col, order, buckets).collect():  # `buckets` rows
        gains[row["bucket"]] = row["gain"]
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), 1, 8), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), h.alias("h"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, h long, n_words long, n_features long, weight long"
    scored = rows.mapInArrow(_scorer(order, gains), schema).withColumn("score", F.col("weight") + gumbel(F.col("h")))
    scored = cut(scored.select("doc_id", "n_features", "weight", "score", (F.col("n_words") >= least_words).alias("fit")), "resample-score")
    drawn = scored.where("fit").count() * percent // 100
    ranked = numbered(scored, [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()], "place")
    drop(scored)
    place = F.col("place") + 1
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(place <= drawn, place).alias("rank"))
