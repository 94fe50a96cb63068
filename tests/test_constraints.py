from pyspark.sql import functions as F

from ratelens.operators import constraints as c


def test_violations(spark):
    rows = spark.createDataFrame([(1, "a", "x", 5.0), (2, "a", "x", None), (3, "b", None, -1.0), (4, "b", None, 2.0), (5, None, "y", 3.0)], "id long, g string, k string, v double")
    known = spark.createDataFrame([("a",), ("a",)], "name string")
    rules = [c.Holds("positive", F.col("v") > 0), c.Holds("small", F.col("v").isNull() | (F.col("v") < 5)), c.Unique("twice", ["g", "k"]), c.AtMostOne("one_x", F.col("k") == "x", ["g"]), c.AtMostOne("one_y", F.col("k") == "y"), c.AtMostOne("one_b", F.col("g") == "b"), c.Known("unknown", ["g"], known)]
    got = sorted((r["constraint"], r.id) for r in c.violations(rows, "id", rules).collect())
    assert got == sorted([("positive", 2), ("positive", 3), ("small", 1), ("twice", 1), ("twice", 2), ("one_x", 1), ("one_x", 2), ("one_b", 3), ("one_b", 4), ("unknown", 3), ("unknown", 4), ("unknown", 5)])
    assert c.violations(rows.limit(0), "id", rules).collect() == []


def test_observed_counts(spark):
    rows, seen = c.observed(spark.range(10), [c.Holds("small", F.col("id") < 7), c.Holds("even", F.col("id") % 2 == 0)])
    assert rows.count() == 10 and seen.get == {"rows": 10, "small": 3, "even": 5}


def test_hosts(spark):
    cases = {"https://bank.ru/x": True, "https://www.bank.ru": True, "https://a.b.bank.ru/": True, "https://evilbank.ru": False, "https://bank.ru.evil.com": False, "x": False}
    got = spark.createDataFrame([(u,) for u in cases], "u string").select("u", c.of_hosts(F.col("u"), F.array(F.lit("bank.ru"), F.lit("other.ru"))).alias("ok")).collect()
    assert {r.u: r.ok for r in got} == cases
