"""Snapshot, change, retention and calendar queries. run = month of an order, source = order priority or supplier, entity = customer or part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.operators import calendar, digest, snapshots
from ratelens.plans.registry import query
from ratelens.sources.tables import table


@query("snapshot_last_per_day", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, max(o_orderkey) AS run FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def snapshot_last_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), "o_orderdate", "o_orderstatus")
    return snapshots.last_run_per_day(rows, "run", "o_orderdate", F.col("o_orderstatus") != "P").select(F.col("day").cast("string").alias("day"), "run")


@query("snapshot_prev_asof", "WITH r AS (SELECT DISTINCT o_orderpriority AS source, strftime(o_orderdate, '%Y-%m') AS run FROM orders) SELECT source, run, lag(run) OVER (PARTITION BY source ORDER BY run) AS previous_run FROM r")
def snapshot_prev_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.date_format("o_orderdate", "yyyy-MM").alias("run"))
    return snapshots.with_previous(rows, "run", ["source"])


@query(
    "key_rate_asof",
    """WITH rates AS (SELECT date_trunc('month', o_orderdate)::DATE AS since, round(5 + count(*) % 17 / 4.0, 2)::DOUBLE AS key_rate FROM orders WHERE month(o_orderdate) % 2 = 1 GROUP BY 1)
    SELECT o.o_orderkey, r.key_rate, strftime(r.since, '%Y-%m-%d') AS in_force_since FROM orders o ASOF LEFT JOIN rates r ON o.o_orderdate::DATE >= r.since""",
)
def key_rate_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    rates = orders.where(F.month("o_orderdate") % 2 == 1).groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("since")).agg(F.round(5 + F.count("*") % 17 / 4.0, 2).alias("key_rate"))
    return snapshots.as_of(orders, "o_orderdate", rates, "since", "key_rate").select("o_orderkey", "key_rate", F.col("in_force_since").cast("string").alias("in_force_since"))


MONTHS = "now AS (SELECT l_suppkey AS bank, l_partkey AS product, max(round(l_discount * 100, 3)) AS v FROM lineitem WHERE year(l_shipdate) = 1998 GROUP BY 1, 2), was AS (SELECT l_suppkey AS bank, l_partkey AS product, max(round(l_discount * 100, 3)) AS v FROM lineitem WHERE year(l_shipdate) = 1997 GROUP BY 1, 2)"
DIFF = MONTHS + """, d AS (SELECT coalesce(n.bank, w.bank) AS bank, coalesce(n.product, w.product) AS product, w.v AS old_value, n.v AS new_value,
  CASE WHEN w.bank IS NULL THEN 'new' WHEN n.bank IS NULL THEN 'gone' WHEN w.v IS NOT DISTINCT FROM n.v THEN 'same' ELSE 'changed' END AS kind FROM was w FULL JOIN now n ON w.bank = n.bank AND w.product = n.product)"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    def year(y: int) -> DataFrame:
        rows = table(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= f"{y}-01-01") & (F.col("l_shipdate") < f"{y + 1}-01-01"))
        return rows.groupBy(F.col("l_suppkey").alias("bank"), F.col("l_partkey").alias("product")).agg(F.max(F.round(F.col("l_discount") * 100, 3)).alias("v"))

    return snapshots.diff(year(1997), year(1998), ["bank", "product"], "v")


@query("snapshot_diff_full_outer", f"WITH {DIFF} SELECT * FROM d")
def snapshot_diff_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir)


@query(
    "rate_change_alerts",
    f"""WITH {DIFF}, x AS (SELECT *, round(new_value - old_value, 3) AS delta FROM d WHERE kind <> 'same')
    SELECT *, CASE WHEN kind <> 'changed' THEN 'medium' WHEN abs(delta) >= 0.25 THEN 'high' ELSE 'info' END AS severity FROM x""",
)
def rate_change_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.rate_alerts(_diff(spark, sf_dir))


@query(
    "condition_label_diff",
    """WITH m AS (SELECT o_custkey, o_orderpriority AS label, max(o_totalprice) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS old, max(o_totalprice) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS new FROM orders GROUP BY 1, 2)
    SELECT o_custkey AS customer, label, old, new FROM m WHERE old IS DISTINCT FROM new""",
)
def condition_label_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_totalprice", (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).alias("before"))
    best = rows.groupBy("o_custkey", "before", "o_orderpriority").agg(F.max("o_totalprice").alias("v"))
    maps = best.groupBy("o_custkey").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("before") == flag, F.struct("o_orderpriority", "v")))).alias(name) for flag, name in ((True, "old"), (False, "new"))])
    return maps.select(F.col("o_custkey").alias("customer"), F.explode(snapshots.map_diff(F.col("old"), F.col("new"))).alias("d")).select("customer", "d.*")


RUNS = "runs AS (SELECT DISTINCT o_orderpriority AS source, year(o_orderdate)::INT AS run, o_custkey AS entity FROM orders)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.year("o_orderdate").alias("run"), F.col("o_custkey").alias("entity"), "o_totalprice").groupBy("source", "run", "entity").agg(F.max("o_totalprice").alias("v"))


@query("still_listed_elsewhere", f"WITH {RUNS}, n AS (SELECT source, max(run) AS run FROM runs GROUP BY 1), l AS (SELECT source, entity, max(run) AS run FROM runs GROUP BY 1, 2) SELECT entity, source FROM l JOIN n USING (source, run)")
def still_listed_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.still_listed(runs(spark, sf_dir), "source", "run", "entity")


@query(
    "change_events_between_runs",
    """WITH r AS (SELECT o_orderpriority AS source, year(o_orderdate)::INT AS run, o_custkey AS entity, max(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3),
    p AS (SELECT source, run, lag(run) OVER (PARTITION BY source ORDER BY run) AS prev FROM (SELECT DISTINCT source, run FROM r)),
    a AS (SELECT r.source, r.run, r.entity, r.v FROM r JOIN p ON p.source = r.source AND p.run = r.run AND p.prev IS NOT NULL),
    b AS (SELECT r.source, p.run, r.entity, r.v FROM r JOIN p ON p.source = r.source AND p.prev = r.run),
    e AS (SELECT coalesce(a.source, b.source) AS source, coalesce(a.run, b.run) AS run, coalesce(a.entity, b.entity) AS entity, b.v AS old_value, a.v AS new_value,
      CASE WHEN b.entity IS NULL THEN 'added' WHEN a.entity IS NULL THEN 'removed' WHEN a.v IS DISTINCT FROM b.v THEN 'changed' END AS kind FROM a FULL JOIN b ON a.source = b.source AND a.run = b.run AND a.entity = b.entity),
    f AS (SELECT entity, min(run) AS first FROM r GROUP BY 1), n AS (SELECT source, max(run) AS run FROM r GROUP BY 1), l AS (SELECT source, entity, max(run) AS run FROM r GROUP BY 1, 2),
    listed AS (SELECT DISTINCT entity FROM l JOIN n USING (source, run))
    SELECT e.source, e.run, e.entity, e.kind, e.old_value, e.new_value, CASE WHEN kind = 'changed' THEN 'conditions' WHEN kind = 'added' AND f.first < e.run THEN 'info' WHEN kind = 'removed' AND listed.entity IS NOT NULL THEN 'info' ELSE 'rate' END AS severity
    FROM e JOIN f USING (entity) LEFT JOIN listed USING (entity) WHERE kind IS NOT NULL""",
)
def change_events_between_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.events_between_runs(runs(spark, sf_dir), "source", "run", "entity", "v")


@query(
    "carry_over_union",
    """WITH prev AS (SELECT o_orderkey, o_orderpriority, 1999 AS run FROM orders WHERE year(o_orderdate) = 1997), fresh AS (SELECT o_orderkey, o_orderpriority, 2000 AS run FROM orders WHERE year(o_orderdate) = 1998 AND o_orderpriority IN ('1-URGENT', '2-HIGH'))
    SELECT * FROM fresh UNION ALL SELECT o_orderkey, o_orderpriority, 2000 FROM prev WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM fresh)""",
)
def carry_over_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("y"))
    prev = rows.where("y = 1997").select("o_orderkey", "o_orderpriority", F.lit(1999).alias("run"))
    fresh = rows.where("y = 1998 and o_orderpriority in ('1-URGENT', '2-HIGH')").select("o_orderkey", "o_orderpriority", F.lit(2000).alias("run"))
    return snapshots.carry_over(prev, fresh, "o_orderpriority", "run", F.lit(2000))


@query(
    "keep_unread",
    """WITH prev AS (SELECT o_orderkey, o_custkey, o_orderpriority || o_custkey AS title, o_orderdate FROM orders WHERE year(o_orderdate) = 1997), fresh AS (SELECT o_orderkey, o_custkey, o_orderpriority || o_custkey AS title, o_orderdate FROM orders WHERE year(o_orderdate) = 1998)
    SELECT o_orderkey, title FROM fresh UNION ALL SELECT o_orderkey, title FROM prev WHERE date_diff('day', o_orderdate::DATE, DATE '1998-01-01') <= 14 AND o_custkey NOT IN (SELECT o_custkey FROM fresh) AND title NOT IN (SELECT title FROM fresh)""",
)
def keep_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.concat("o_orderpriority", F.col("o_custkey").cast("string")).alias("title"), "o_orderdate", F.year("o_orderdate").alias("y"))
    kept = snapshots.keep_unread(rows.where("y = 1997"), rows.where("y = 1998"), "o_custkey", "title", F.datediff(F.lit("1998-01-01").cast("date"), F.col("o_orderdate").cast("date")))
    return kept.select("o_orderkey", "title")


@query(
    "retention_top_k",
    """WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders)
    SELECT o_orderkey, o_custkey, place FROM r WHERE place > 5 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.09)""",
)
def retention_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    protected = table(spark, sf_dir, "lineitem").where("l_discount >= 0.09").select(F.col("l_orderkey").alias("o_orderkey"))
    out = snapshots.prunable(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5, protected, "o_orderkey")
    return out.select("o_orderkey", "o_custkey", F.col("place").cast("long").alias("place"))


@query("retention_doc_anti", "SELECT o_orderkey FROM orders o WHERE year(o_orderdate) < 1997 AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R') AND o_orderkey NOT IN (SELECT max(o_orderkey) FROM orders GROUP BY o_custkey)")
def retention_doc_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    latest = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey")).select("o_orderkey")
    return orders.where(F.year("o_orderdate") < 1997).select("o_orderkey").join(used.union(latest).distinct(), "o_orderkey", "left_anti")


@query("replace_by_key", "WITH r AS (SELECT o_custkey, o_orderpriority, year(o_orderdate)::INT AS run, o_orderkey FROM orders), m AS (SELECT *, max(run) OVER (PARTITION BY o_custkey, o_orderpriority) AS newest FROM r) SELECT o_custkey, o_orderpriority, run, o_orderkey FROM m WHERE run = newest")
def replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.year("o_orderdate").alias("run"), "o_orderkey")
    return snapshots.replace_by_key(rows.where("run < 1998"), rows.where("run >= 1998"), ["o_custkey", "o_orderpriority"], "run")


@query("upsert_last_write", "SELECT c AS o_custkey, k AS o_orderkey, t AS o_totalprice FROM (SELECT o_custkey AS c, o_orderkey AS k, o_totalprice AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def upsert_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return snapshots.upsert(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey")


@query("first_seen_baseline", "WITH f AS (SELECT l_suppkey AS bank, l_partkey AS product, min(l_shipdate)::DATE AS d FROM lineitem GROUP BY 1, 2) SELECT bank, product, strftime(d, '%Y-%m-%d') AS first_day, d = (SELECT min(l_shipdate)::DATE FROM lineitem) AS baseline FROM f")
def first_seen_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("bank"), F.col("l_partkey").alias("product"), F.col("l_shipdate").cast("date").alias("day"))
    return snapshots.first_seen(rows, ["bank", "product"], "day").withColumn("first_day", F.col("first_day").cast("string"))


@query("monitoring_status", "SELECT max(n) - 1 AS comparisons, strftime(min(a), '%Y-%m-%d') AS data_from, strftime(max(b), '%Y-%m-%d') AS data_to FROM (SELECT o_orderpriority, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS n, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1)")
def monitoring_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.countDistinct(F.date_format("o_orderdate", "yyyy-MM")).alias("n"), F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return rows.agg((F.max("n") - 1).alias("comparisons"), F.date_format(F.min("a"), "yyyy-MM-dd").alias("data_from"), F.date_format(F.max("b"), "yyyy-MM-dd").alias("data_to"))


@query(
    "duration_estimate",
    """WITH r AS (SELECT o_orderpriority AS source, o_totalprice / 1000 AS m, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) AS n FROM orders), e AS (SELECT source, round(median(m), 3) AS median_minutes FROM r WHERE n <= 5 GROUP BY 1)
    SELECT *, (floor(median_minutes * 0.85 / 5 + 0.5) * 5)::BIGINT AS low, (floor(median_minutes * 1.15 / 5 + 0.5) * 5)::BIGINT AS high FROM e""",
)
def duration_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), "o_orderkey", (F.col("o_totalprice") / 1000).alias("minutes"))
    return digest.duration_estimate(rows, "source", "o_orderkey", "minutes")


LEAVE = "leave AS (SELECT o_custkey AS who, o_orderdate::DATE AS a, o_orderdate::DATE + (o_orderkey % 14)::INT AS b FROM orders), load AS (SELECT day::DATE AS day, count(DISTINCT who) AS away FROM (SELECT who, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM leave) GROUP BY 1)"


def leave(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("who"), start.alias("a"), F.date_add(start, (F.col("o_orderkey") % 14).cast("int")).alias("b"))


@query("calendar_load", f"WITH {LEAVE} SELECT strftime(day, '%Y-%m-%d') AS day, away, round(away / 1000, 4) AS share, away > 60 AS over FROM load")
def calendar_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.daily_load(leave(spark, sf_dir), "a", "b", "who", 1000, 0.06).withColumn("day", F.col("day").cast("string"))


@query("calendar_monthly_peak", f"WITH {LEAVE} SELECT strftime(day, '%Y-%m') AS month, max(away) AS peak, count(*) FILTER (WHERE away > 60) AS days_over, count(*) AS days FROM load GROUP BY 1")
def calendar_monthly_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.monthly_peak(calendar.daily_load(leave(spark, sf_dir), "a", "b", "who", 1000, 0.06))
