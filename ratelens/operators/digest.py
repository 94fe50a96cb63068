"""News and event operators: anti-joins against history, digests, slots, feedback, token costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.sources.tables import cut


def unseen(posts: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Posts whose key is not known yet, each once (the earliest by all columns of the key)."""
    return posts.join(known.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def daily_cards(events: DataFrame, day: Column, order: list[Column], limit: int = 15) -> DataFrame:
    """The first `limit` events of every day with their place; a top-k report."""
    w = Window.partitionBy("day").orderBy(*order)
    return events.withColumn("day", day).withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def within_budget(rows: DataFrame, group: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """Rows of each group while their running size stays within the budget."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("running_size", F.sum(size).over(w)).where(F.col("running_size") <= budget)


def slots(events: DataFrame, at: str, length: str, offset: str | None = None) -> DataFrame:
    """Tumbling windows over event time: slot_start, n, total of value."""
    cut = F.window(F.col(at), length, length, offset) if offset else F.window(F.col(at), length)
    return events.groupBy(cut.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("slot_start"), "n", "total")


def largest_gap(hours: DataFrame, hour: str = "hour") -> DataFrame:
    """Largest distance in hours between consecutive slots of a daily schedule, across midnight too."""
    w = Window.orderBy(hour)
    spaced = hours.select(hour).distinct().withColumn("next", F.coalesce(F.lead(hour).over(w), F.min(hour).over(Window.partitionBy()) + 24))
    return spaced.agg(F.max(F.col("next") - F.col(hour)).alias("max_gap"), F.count("*").alias("slots"))


def feedback_bias(votes: DataFrame) -> DataFrame:
    """votes: category, stars (model), vote. Mean of vote - stars for each category, with a verdict at 0.7."""
    rows = votes.groupBy("category").agg(F.count("*").alias("votes"), F.round(F.avg("vote"), 3).alias("mean_vote"), F.round(F.avg(F.col("vote") - F.col("stars")), 3).alias("bias"))
    return rows.withColumn("verdict", F.when(F.col("bias") >= 0.7, "underrated").when(F.col("bias") <= -0.7, "overrated").otherwise("fair"))


def calibration_examples(votes: DataFrame, item: str, least_votes: int = 2, least_items: int = 6, n: int = 4) -> DataFrame:
    """Best and worst liked items as examples, only once enough items have votes; a top-k report."""
    items = votes.groupBy(item).agg(F.count("*").alias("votes"), F.avg("vote").alias("mean_vote")).where(F.col("votes") >= least_votes)
    total = items.agg(F.count("*").alias("items"))
    enough = items.crossJoin(F.broadcast(total)).where(F.col("items") >= least_items)
    good = enough.where("mean_vote >= 4").orderBy(F.desc("mean_vote"), item).limit(n).withColumn("kind", F.lit("good"))
    bad = enough.where("mean_vote <= 2").orderBy("mean_vote", item).limit(n).withColumn("kind", F.lit("bad"))
    return good.unionByName(bad).select("kind", item, "votes", F.round("mean_vote", 3).alias("mean_vote"))


def cost_by_run(usage: DataFrame, run: list[str]) -> DataFrame:
    """usage: stage, tokens, price (NULL: unknown). The cost of a run is NULL if any used stage lacks a price."""
    unknown = F.count_if(F.col("price").isNull() & (F.col("tokens") > 0))
    return usage.groupBy(*run).agg(F.sum("tokens").alias("tokens"), F.count("price").alias("priced"), F.when(unknown == 0, F.round(F.sum(F.col("tokens") * F.col("price")), 2)).alias("cost"))


def merged_errors(errors: DataFrame, group: list[str], key: str, value: str, order: str) -> DataFrame:
    """Union of error maps where later entries win, as sorted key=value text."""
    last = errors.groupBy(*group, key).agg(F.max_by(value, order).alias("v"))
    return last.groupBy(*group).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", key, F.col("v").cast("string")))), ";").alias("errors"))


def popularity(links: DataFrame, target: str, position: str) -> DataFrame:
    """Crawl order: the most referenced url first, then the one found earliest.

    Urls are range-partitioned in that order and numbered within their range; a range starts after the rows of those before
    it, so no task sees more than its range.
    """
    counts = links.groupBy(target).agg(F.count("*").alias("references"), F.min(position).alias("first_seen"))
    order = [F.desc("references"), F.asc("first_seen"), F.asc(target)]
    ranged = cut(counts.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "frontier")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = ranged.groupBy("__range").agg(F.count("*").alias("__rows")).select("__range", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    placed = ranged.withColumn("place", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    return placed.join(F.broadcast(starts), "__range").select(target, "references", "first_seen", (F.col("place") + F.col("__start")).alias("place"))


def duration_estimate(runs: DataFrame, group: str, order: str, minutes: str, last: int = 5) -> DataFrame:
    """Median of the last runs, and the range of 15 % to either side rounded to five minutes."""
    recent = runs.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).where(F.col("__n") <= last)
    mid = recent.groupBy(group).agg(F.round(F.median(minutes), 3).alias("median_minutes"))
    five = lambda f: (F.floor(F.col("median_minutes") * f / 5 + 0.5) * 5).cast("long")
    return mid.select(group, "median_minutes", five(0.85).alias("low"), five(1.15).alias("high"))


def new_since(rows: DataFrame, keys: list[str], at: str, since: Column) -> DataFrame:
    """Candidates by their first sighting, with whether it is new."""
    return rows.groupBy(*keys).agg(F.min(at).alias("first_seen"), F.count("*").alias("seen")).withColumn("is_new", F.col("first_seen") >= since)


def merge_groups(posts: DataFrame, group: str, position: str, text: str, label: str, score: str) -> DataFrame:
    """One row a group: its main post (the longest text, the earliest of equal ones), labels in order of appearance, highest score.

    Labels are reduced to their first position before they are collected, so a group's array holds different labels only.
    """
    main = posts.groupBy(group).agg(F.min_by(position, F.struct(-F.length(F.coalesce(text, F.lit(""))), F.col(position))).alias("main"), F.max(score).alias("score"), F.count("*").alias("posts"))
    firsts = posts.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.min(position).alias("p"))
    labels = firsts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", label))), lambda x: x[label]).alias("labels"))
    return main.join(labels, group, "left")


def totals_known(rows: DataFrame, value: Column, *keys: str) -> DataFrame:
    """Count, number with a known value, and their sum (NULL where none is known)."""
    return rows.groupBy(*keys).agg(F.count("*").alias("events"), F.count(value).alias("known"), F.round(F.sum(value), 2).alias("total"))


def top_news(events: DataFrame, group: str, least: int = 3, n: int = 7, *ids: str) -> DataFrame:
    """The n best events of each group at or above a score: by score, then those with a picture, then by id; a top-k report."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), F.when(F.col("image").isNotNull(), 0).otherwise(1), *ids)
    return events.where(F.col("score") >= least).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
