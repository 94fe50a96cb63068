"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Every source gets a target share of all words. Equal rows are counted first, so that a row repeated any number of
times is one place of that many times its size. Documents get a hash-random key; within a source the key's
range is cut into about sqrt(documents) equal ranges, so the range sort needs no sampling and no range holds
more than about sqrt(documents) rows, however large the source is. Word counts are summed for each range,
the range sums are summed along the source (about sqrt(documents) rows), and a document's place in its source is
the sum before its range plus the running sum within it. Whole epochs take every document; the rest of the
budget is cut at that place, to the exact word: the last document is taken in part.

Targets are weights' shares stopped at `cap` times the source's size, the excess reshared by weight until no
target is above. That is min(cap_i, level * weight_i) for one level, found by ordering sources by cap / weight.
It works on one row for each source.

Defined results: null text has size 0; null is a source of its own, after all others; a source of size 0
has target 0; ties in the key are broken by id, size and a hash of the text; repeated rows each count and each get a row;
null ids are allowed and are keyed by their text; very long texts count whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratelens.llm.keys import row_key
from ratelens.sources.tables import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Source rows are broadcast up to this many (about 40 bytes each); beyond, the join shuffles.
BROADCAST_SOURCES = 100_000
#: Copies of a row in one run.
RUN = 4096
#: Keys of mixed documents (about 60 bytes each) are broadcast up to this many; beyond, the join shuffles the documents.
BROADCAST_KEYS = 2_000_000


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.0, cap: int = 3) -> DataFrame:
    """From rows (source, size, copies): source, rank, n, source_size, target."""
    totals = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    whole = Window.partitionBy()
    limit = F.col("source_size") * cap
    steps = weighed.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share))).withColumn("before", F.coalesce(F.sum(limit).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    steps = steps.withColumn("left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))).withColumn("level", (F.col("total") - F.col("before")) / F.col("left"))
    levels = steps.withColumn("fits", F.col("level") * F.col("weight") <= limit)
    level = F.min(F.when(F.col("fits"), F.struct((F.col("source_size") / F.col("weight")).alias("r"), "rank", "level"))).over(whole)["level"]
    target = F.least(limit.cast("double"), F.coalesce(level * F.col("weight"), limit.cast("double")))
    return levels.select("source", "rank", "n", "source_size", target.alias("target"))


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int], share: float, cap: int, seed: str) -> DataFrame:
    """One row for each distinct (doc_id, source, text): its columns, `copies`, and `words` that the mix takes of all copies before each one."""
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), row_key(F.col(id_col), text, F.col(source_col)).alias("k"))
    rows = cut(rows.groupBy("doc_id", "source", "size", "k.k1", "k.k2").agg(F.count("*").alias("copies")), "mix-size")
    sources = cut(source_targets(rows.select("source", "size", "copies"), weights, share, cap), "mix-source")
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("k1").cast("string")))))
    placed = rows.join(sources.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("key", key)
    ranges = F.ceil(F.sqrt("n"))
    placed = placed.withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / F.lit(2**32)))
    whole = F.col("size") * F.col("copies")
    sums = placed.groupBy("rank", "range").agg(F.sum(whole).alias("range_size"))
    along = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("rank", "range", F.coalesce(F.sum("range_size").over(along), F.lit(0)).alias("start"))
    within = Window.partitionBy("rank", "range").orderBy("key", "doc_id", "size", "k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.withColumn("inside", F.coalesce(F.sum(whole).over(within), F.lit(0))).join(starts, ["rank", "range"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("start") - F.col("inside")
    return ordered.select("doc_id", "k1", "k2", "size", "source", "source_size", "target", "copies", epochs.alias("epochs"), rest.alias("rest"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.0,
    cap: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """One row for each document: doc_id, size, source, source_size, target, taken (words, repeats counted)."""
    placed = _placed(docs, id_col, text_col, source_col, weights, share, cap, seed)
    # Copies of a row are listed a run at a time, so that no array grows with them.
    runs = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RUN).cast("long"))).alias("run"))
    each = runs.select("*", F.explode(F.sequence("run", F.least(F.col("run") + RUN, "copies") - 1)).alias("copy"))
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least("size", F.col("rest") - F.col("copy") * F.col("size")))
    return each.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), share: float = 1.0, cap: int = 3, seed: str = "mix") -> DataFrame:
    """The documents that the mix takes words from, with how many words it takes (repeats counted) in `mix_words`.

    Rows that are equal in id, text and source come out once, with the words taken of all of them.
    """
    placed = _placed(docs, id_col, text_col, source_col, weights, share, cap, seed)
    whole = F.col("size") * F.col("copies")
    taken = F.col("epochs") * whole + F.greatest(F.lit(0).cast("long"), F.least(whole, F.col("rest")))
    taken = cut(placed.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), taken.alias("mix_words"), (F.col("copies") > 1).alias("__repeated")).where("mix_words > 0"), "mix-taken")
    key = row_key(F.col(id_col), F.col(text_col).cast("string"), F.col(source_col))
    joined = docs.join(F.broadcast(taken) if taken.count() <= BROADCAST_KEYS else taken, (key["k1"] == F.col("__k1")) & (key["k2"] == F.col("__k2")))
    if taken.where("__repeated").isEmpty():
        return joined.select(*docs.columns, "mix_words")
    once = joined.where("__repeated").dropDuplicates(["__k1", "__k2"])
    return joined.where("not __repeated").unionByName(once).select(*docs.columns, "mix_words")
