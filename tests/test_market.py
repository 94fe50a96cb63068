from pyspark.sql import functions as F

from ratelens.operators import market, quality


def test_position_of_the_home_bank(spark):
    offers = spark.createDataFrame([("p", "home", 14.0), ("p", "a", 15.0), ("p", "b", 13.8), ("p", "c", 13.0), ("p", "c", 12.0), ("alone", "home", 5.0), ("away", "a", 5.0), ("p", "d", None)], "program string, bank string, rate double")
    rows = {r.program: r for r in market.market_position(market.best_by_bank(offers), F.lit("home")).collect()}
    p = rows["p"]
    assert (p.home_value, p.best_value, p.others_median, p.rank, p.banks_compared, p.delta_best, p.status) == (14.0, 15.0, 13.8, 2, 4, -1.0, "in_market")
    assert rows["alone"].status == "no_rivals" and rows["away"].status == "not_found"


def test_lower_is_better_and_ties_share_a_rank(spark):
    offers = spark.createDataFrame([("p", "home", 10.0), ("p", "a", 10.0), ("p", "b", 12.0)], "program string, bank string, rate double")
    r = market.market_position(market.best_by_bank(offers, False), F.lit("home"), higher_is_better=False).first()
    assert (r["rank"], r.status, r.advantage) == (1, "leader", 1.0)


def test_traffic_light_thresholds(spark):
    best = spark.createDataFrame([("p", "home", 10.0), ("p", "a", 10.4), ("p", "b", 11.0), ("p", "c", 9.0), ("p", "d", 10.7), ("q", "a", 1.0)], "program string, bank string, value double")
    got = {(r.program, r.bank): r.light for r in market.traffic_light(best, F.lit("home")).collect()}
    assert got == {("p", "a"): "yellow", ("p", "b"): "red", ("p", "c"): "green", ("p", "d"): "yellow", ("q", "a"): "grey"}


def test_plausibility_boundaries(spark):
    rows = spark.createDataFrame([(1, 31.0), (2, 17.0), (3, None), (4, 0.0)], "id int, value double")
    rules = quality.rate_rules(F.col("value"), F.lit(14.0), F.lit(True), F.lit(True))
    assert {r.id: r.confidence for r in quality.assess(rows, rules).collect()} == {1: "low", 2: "high", 3: "high", 4: "low"}
    silent = quality.rate_rules(F.col("value"), F.lit(None).cast("double"), F.lit(True), F.lit(True))
    assert {r.id: r.confidence for r in quality.assess(rows, silent).collect()} == {1: "high", 2: "high", 3: "high", 4: "low"}


def test_matrix_is_dense(spark):
    products = spark.createDataFrame([("x", "a", True), ("x", "b", False)], "category string, bank string, rated boolean")
    links = spark.createDataFrame([("y", "a", "/long/url"), ("y", "a", "/url")], "category string, bank string, url string")
    cells = quality.coverage_matrix(products, links, spark.createDataFrame([("a",), ("b",)], "bank string"), spark.createDataFrame([("x",), ("y",)], "category string"))
    assert {(r.category, r.bank): (r.status, r.url) for r in cells.collect()} == {("x", "a"): ("compared", None), ("x", "b"): ("collected", None), ("y", "a"): ("link", "/url"), ("y", "b"): ("none", None)}


def test_segment_verdict(spark):
    home = spark.createDataFrame([("s", "rate", 5.0), ("s", "cash", 1.0), ("t", "cash", 1.0)], "segment string, kind string, value double")
    rival = spark.createDataFrame([("s", "rate", 4.0), ("s", "cash", 2.0), ("u", "cash", 2.0)], "segment string, kind string, value double")
    order = spark.createDataFrame([("cash", 1), ("rate", 2)], "kind string, priority int")
    assert {r.segment: r.verdict for r in market.segment_verdict(home, rival, order).collect()} == {"s": "red", "t": "grey", "u": "grey"}
