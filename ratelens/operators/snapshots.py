"""Append-only snapshots: latest rows, previous runs, as-of lookups, diffs, change events and retention.

Joins are equi-joins on (entity, run) keys; "previous run" is a lag over the few distinct runs of a source,
never a self-join of the data by inequality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key (order: newest first)."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def last_run_per_day(runs: DataFrame, run: str, started: str, ok: Column | None = None) -> DataFrame:
    """(day, run) of the last successful run of each day."""
    good = runs if ok is None else runs.where(ok)
    return good.groupBy(F.to_date(started).alias("day")).agg(F.max(run).alias(run))


def with_previous(runs: DataFrame, run: str, by: list[str]) -> DataFrame:
    """Adds previous_<run>: the run before, within each source."""
    return runs.select(*by, run).distinct().withColumn(f"previous_{run}", F.lag(run).over(Window.partitionBy(*by).orderBy(run)))


def as_of(facts: DataFrame, at: str, values: DataFrame, since: str, value: str, lookback_days: int | None = None) -> DataFrame:
    """Adds the value in force at each fact's time, and in_force_since: the newest one not after it.

    values is a dimension of validity starts (days or times, different ones; null starts never come into force). Its starts become
    intervals [start, next); facts join them by day, so the join is an equi-join: each interval is unrolled to the days that it
    touches, the last one up to the latest fact, and a day on which a value changes has all its intervals in one row, among which
    the fact's time decides. With a look-back, a value that started more than that many days earlier counts as unknown. A null time has none.
    """
    started = values.where(F.col(since).isNotNull()).select(F.col(since).alias("__since"), F.col(since).cast("timestamp").alias("__from"), F.col(value).alias("__value"))
    until = F.lead("__from").over(Window.orderBy("__from"))  # the dimension: one row for each start
    latest = facts.agg(F.max(F.to_date(at)).alias("__latest"))  # one row
    spans = started.withColumn("__until", until).crossJoin(F.broadcast(latest))
    first, last = F.to_date("__from"), F.coalesce(F.least(F.to_date("__until"), F.col("__latest")), F.col("__latest"))
    if lookback_days is not None:
        last = F.least(last, F.date_add(first, lookback_days))
    days = spans.withColumn("__first", first).withColumn("__last", last).where("__last >= __first").select(F.explode(F.sequence("__first", "__last")).alias("__day"), "__from", "__until", "__since", "__value")
    days = days.groupBy("__day").agg(F.array_sort(F.collect_list(F.struct("__from", "__until", "__since", "__value"))).alias("__spans"))
    moment = F.col(at).cast("timestamp")
    held = F.filter("__spans", lambda s: (s["__from"] <= moment) & (s["__until"].isNull() | (moment < s["__until"])))
    joined = facts.join(days, F.to_date(at) == F.col("__day"), "left").withColumn("__held", F.get(held, F.lit(0)))
    return joined.select(*facts.columns, F.col("__held.__value").alias(value), F.col("__held.__since").alias("in_force_since"))


def diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison of two snapshots: keys, old_value, new_value, kind (new, gone, changed, same)."""
    a = old.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("__old"))
    b = new.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("__new"))
    kind = F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "gone").when(F.col("old_value").eqNullSafe(F.col("new_value")), "same").otherwise("changed")
    return a.join(b, keys, "full_outer").select(*keys, "old_value", "new_value", kind.alias("kind"))


def rate_alerts(changes: DataFrame, significant: float = 0.25) -> DataFrame:
    """Severity of changes of a snapshot diff: rates by size, products by kind; same rows and unknown sides go."""
    delta = F.round(F.col("new_value") - F.col("old_value"), 3)
    rows = changes.where((F.col("kind") != "same") & ((F.col("kind") != "changed") | (F.col("old_value").isNotNull() & F.col("new_value").isNotNull()))).withColumn("delta", delta)
    severity = F.when(F.col("kind") != "changed", "medium").when(F.abs("delta") >= significant, "high").otherwise("info")
    return rows.withColumn("severity", severity)


def events_between_runs(rows: DataFrame, source: str, run: str, entity: str, value: str) -> DataFrame:
    """Change events of every run against the one before it in its source; the first run of a source is silent.

    Events: added (rate severity if the entity is new or back, info if the source alone lists it anew), removed
    (info while another source's newest run still lists it), changed.
    """
    runs = with_previous(rows, run, [source])
    now = rows.select(source, run, entity, F.col(value).alias("new_value"))
    later = runs.where(f"previous_{run} is not null")
    before = rows.select(source, F.col(run).alias(f"previous_{run}"), entity, F.col(value).alias("old_value")).join(later, [source, f"previous_{run}"])
    current = now.join(later, [source, run])
    both = current.select(source, run, entity, "new_value", F.lit(1).alias("__n")).join(before.select(source, run, entity, "old_value", F.lit(1).alias("__o")), [source, run, entity], "full_outer")
    kind = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed")
    events = both.withColumn("kind", kind).where("kind is not null")
    first = rows.groupBy(entity).agg(F.min(run).alias("__first"))
    elsewhere = still_listed(rows, source, run, entity).select(entity, F.lit(True).alias("__listed")).distinct()
    judged = events.join(first, entity).join(elsewhere, entity, "left")
    severity = F.when(F.col("kind") == "changed", "conditions").when((F.col("kind") == "added") & (F.col("__first") < F.col(run)), "info").when((F.col("kind") == "removed") & F.col("__listed"), "info").otherwise("rate")
    return judged.select(source, run, entity, "kind", "old_value", "new_value", severity.alias("severity"))


def still_listed(rows: DataFrame, source: str, run: str, entity: str) -> DataFrame:
    """(entity, source) pairs where the entity's last run in the source is the source's newest run."""
    newest = rows.groupBy(source).agg(F.max(run).alias(run))
    last = rows.groupBy(source, entity).agg(F.max(run).alias(run))
    return last.join(newest, [source, run], "left_semi").select(entity, source)


def map_diff(old: Column, new: Column) -> Column:
    """Labels of two string maps that differ: array of struct<label, old, new>, sorted by label."""
    labels = F.array_sort(F.array_union(F.map_keys(old), F.map_keys(new)))
    rows = F.transform(labels, lambda k: F.struct(k.alias("label"), F.try_element_at(old, k).alias("old"), F.try_element_at(new, k).alias("new")))
    return F.filter(rows, lambda r: ~r["old"].eqNullSafe(r["new"]))


def carry_over(previous: DataFrame, fresh: DataFrame, source: str, run: str, new_run: Column) -> DataFrame:
    """The new run's rows: fresh ones, and the previous run's rows of every source that was not read again."""
    kept = previous.join(fresh.select(source).distinct(), source, "left_anti").withColumn(run, new_run)
    return fresh.unionByName(kept)


def keep_unread(previous: DataFrame, fresh: DataFrame, key: str, title: str, age_days: Column, limit: int = 14) -> DataFrame:
    """After a partial crawl: fresh rows and the previous ones not seen again by key or title and not too old."""
    kept = previous.where(age_days <= limit).join(fresh.select(key).distinct(), key, "left_anti").join(fresh.select(title).distinct(), title, "left_anti")
    return fresh.unionByName(kept)


def prunable(snapshots: DataFrame, keys: list[str], order: list[Column], keep: int, protected: DataFrame, id_col: str) -> DataFrame:
    """Snapshots beyond the newest `keep` (3 at least) of their key, except protected ids."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    old = snapshots.withColumn("place", place).where(F.col("place") > max(3, keep))
    return old.join(protected.select(id_col).distinct(), id_col, "left_anti")


def replace_by_key(stored: DataFrame, incoming: DataFrame, keys: list[str], run: str) -> DataFrame:
    """Append-only insert with replacement by key: for each key the rows of the newest run stay."""
    newest = F.max(run).over(Window.partitionBy(*keys))
    return stored.unionByName(incoming).withColumn("__newest", newest).where(F.col(run) == F.col("__newest")).drop("__newest")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Last write wins by key."""
    return latest_per_key(stored.unionByName(incoming), keys, [F.col(at).desc()])


def first_seen(rows: DataFrame, keys: list[str], day: str) -> DataFrame:
    """First day of each key, and whether it was there on the first day of all (the baseline)."""
    first = rows.groupBy(*keys).agg(F.min(day).alias("first_day"))
    start = rows.agg(F.min(day).alias("__start"))
    return first.crossJoin(F.broadcast(start)).select(*keys, "first_day", (F.col("first_day") == F.col("__start")).alias("baseline"))


def _severity_rank(severity: Column, order: tuple[str, ...]) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, order)), severity).cast("int") - 1, F.lit(-1))


def at_least(changes: DataFrame, order: tuple[str, ...], least: str) -> DataFrame:
    """Changes of at least a severity; order is from the lowest to the highest, an unknown severity counts as the lowest."""
    return changes.where(F.greatest(_severity_rank(F.col("severity"), order), F.lit(0)) >= order.index(least))


def highest_severity(changes: DataFrame, order: tuple[str, ...], *keys: str) -> DataFrame:
    """The highest severity of each group's changes."""
    top = F.max(F.greatest(_severity_rank(F.col("severity"), order), F.lit(0)))
    return changes.groupBy(*keys).agg(F.count("*").alias("changes"), F.get(F.array(*map(F.lit, order)), top).alias("severity"))


def in_severity_order(changes: DataFrame, order: tuple[str, ...], group: str, *ids: str) -> DataFrame:
    """Place of each change in its group: the highest severity first, then by id."""
    return changes.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(_severity_rank(F.col("severity"), order).desc(), *ids)))
