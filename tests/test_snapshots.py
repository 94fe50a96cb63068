import datetime

from pyspark.sql import functions as F

from ratelens.operators import calendar, digest, snapshots


def runs(spark):
    rows = [("s1", 1, "a", 1.0), ("s1", 1, "b", 2.0), ("s1", 2, "a", 1.5), ("s1", 2, "c", 3.0), ("s2", 2, "b", 2.0), ("s1", 3, "a", 1.5), ("s1", 3, "b", 2.0)]
    return spark.createDataFrame(rows, "source string, run int, entity string, v double")


def test_events_between_runs(spark):
    got = {(r.source, r.run, r.entity): (r.kind, r.severity) for r in snapshots.events_between_runs(runs(spark), "source", "run", "entity", "v").collect()}
    assert got == {
        ("s1", 2, "a"): ("changed", "conditions"),
        ("s1", 2, "b"): ("removed", "info"),
        ("s1", 2, "c"): ("added", "rate"),
        ("s1", 3, "c"): ("removed", "rate"),
        ("s1", 3, "b"): ("added", "info"),
    }


def test_first_run_and_same_run_are_silent(spark):
    once = runs(spark).where("run = 1")
    assert snapshots.events_between_runs(once, "source", "run", "entity", "v").count() == 0
    same = snapshots.diff(once, once, ["source", "entity"], "v")
    assert {r.kind for r in same.collect()} == {"same"} and snapshots.rate_alerts(same).count() == 0


def test_alert_severity(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", None)], "k string, v double")
    new = spark.createDataFrame([("a", 1.25), ("b", 1.1), ("e", 1.0), ("d", 2.0)], "k string, v double")
    got = {r.k: r.severity for r in snapshots.rate_alerts(snapshots.diff(old, new, ["k"], "v")).collect()}
    assert got == {"a": "high", "b": "info", "c": "medium", "e": "medium"}


def test_as_of(spark):
    day = datetime.date
    facts = spark.createDataFrame([(1, day(2026, 1, 1)), (2, day(2026, 1, 10)), (3, day(2026, 3, 1)), (4, day(2025, 1, 1))], "id int, d date")
    rates = spark.createDataFrame([(day(2026, 1, 1), 16.0), (day(2026, 1, 10), 15.0)], "since date, rate double")
    got = {r.id: r.rate for r in snapshots.as_of(facts, "d", rates, "since", "rate", lookback_days=31).collect()}
    assert got == {1: 16.0, 2: 15.0, 3: None, 4: None}


def test_map_diff(spark):
    a, b = F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), F.lit("2")), F.create_map(F.lit("y"), F.lit("3"), F.lit("z"), F.lit("4"))
    rows = spark.range(1).select(snapshots.map_diff(a, b).alias("d")).first()["d"]
    assert [(r.label, r.old, r.new) for r in rows] == [("x", "1", None), ("y", "2", "3"), ("z", None, "4")]


def test_retention_keeps_protected(spark):
    rows = spark.createDataFrame([(i, "p", i) for i in range(1, 8)], "id int, k string, seq int")
    protected = spark.createDataFrame([(2,), (None,)], "id int")
    got = snapshots.prunable(rows, ["k"], [F.desc("seq")], 1, protected, "id")
    assert sorted(r.id for r in got.collect()) == [1, 3, 4]


def test_partial_crawl_and_replacement(spark):
    prev = spark.createDataFrame([("k1", "t1", 1), ("k2", "t2", 1), ("k3", "t3", 20), ("k4", "t9", 1)], "k string, t string, age int")
    fresh = spark.createDataFrame([("k1", "t1", 0), ("k9", "t9", 0)], "k string, t string, age int")
    assert sorted(r.k for r in snapshots.keep_unread(prev, fresh, "k", "t", F.col("age")).collect()) == ["k1", "k2", "k9"]
    stored = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, run int, v int")
    incoming = spark.createDataFrame([("a", 2, 5)], "k string, run int, v int")
    assert sorted((r.k, r.v) for r in snapshots.replace_by_key(stored, incoming, ["k"], "run").collect()) == [("a", 5), ("b", 1)]


def test_calendar(spark):
    day = datetime.date
    rows = spark.createDataFrame([("a", day(2027, 1, 1), day(2027, 1, 3)), ("b", day(2027, 1, 3), day(2027, 1, 3)), ("c", day(2027, 1, 5), day(2027, 1, 4))], "who string, a date, b date")
    load = calendar.daily_load(rows, "a", "b", "who", 10, 0.15)
    assert {str(r.day): (r.away, r.over) for r in load.collect()} == {"2027-01-01": (1, False), "2027-01-02": (1, False), "2027-01-03": (2, True)}
    assert [(r.month, r.peak, r.days_over) for r in calendar.monthly_peak(load).collect()] == [("2027-01", 2, 1)]
    leave = spark.createDataFrame([("a", day(2027, 1, 1), 3)], "who string, a date, n int")
    free = spark.createDataFrame([(day(2027, 1, 2),)], "holiday date")
    assert calendar.extended_end(leave, "a", "n", free, "who").first().end == day(2027, 1, 4)


def test_digest_pieces(spark):
    hours = spark.createDataFrame([(8,), (12,), (22,)], "hour int")
    assert digest.largest_gap(hours).first().max_gap == 10
    usage = spark.createDataFrame([("r", 10, 1.0), ("r", 5, None), ("s", 0, None), ("s", 4, 2.0)], "run string, tokens int, price double")
    assert {r.run: r.cost for r in digest.cost_by_run(usage, ["run"]).collect()} == {"r": None, "s": 8.0}
    votes = spark.createDataFrame([("x", 5, 3), ("x", 5, 5), ("y", 1, 3)], "category string, vote int, stars int")
    assert {r.category: r.verdict for r in digest.feedback_bias(votes).collect()} == {"x": "underrated", "y": "overrated"}


def test_as_of_decides_within_the_day(spark):
    t = datetime.datetime
    values = spark.createDataFrame([(t(2026, 1, 1), 1.0), (t(2026, 1, 5, 15), 2.0), (t(2026, 1, 5, 18), 3.0), (t(2026, 1, 7), 4.0), (None, 9.0)], "since timestamp, rate double")
    times = {1: t(2026, 1, 5, 8), 2: t(2026, 1, 5, 15), 3: t(2026, 1, 5, 17, 59), 4: t(2026, 1, 5, 18, 1), 5: t(2026, 1, 6), 6: t(2026, 1, 7), 7: t(2025, 12, 31), 8: None, 9: t(2026, 3, 1, 9)}
    facts = spark.createDataFrame(list(times.items()), "id int, at timestamp")
    got = {r.id: r.rate for r in snapshots.as_of(facts, "at", values, "since", "rate").collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 2.0, 4: 3.0, 5: 3.0, 6: 4.0, 7: None, 8: None, 9: 4.0}
    back = {r.id: r.rate for r in snapshots.as_of(facts, "at", values, "since", "rate", lookback_days=5).collect()}
    assert back == got | {9: None}
