from pyspark.sql import functions as F

from ratelens.sources import html, sinks

PAGE = """<html><head><title>T</title><script>window.state = {"a": {"b": [1, "}"]}};</script></head><body>
<a href="/x">One <b>two</b></a><a>none</a>
<table><tr><td>Rate</td><td>5 %</td></tr><tr><td>Rate</td><td>6 %</td></tr><tr><td>only</td></tr></table>
<div class="product-card"><h3>Card</h3><span class="card-advantage">up to 5%</span></div>
<div class="product-card"><h3>Card</h3><span class="card-advantage">other</span></div>
<td>25.10.2026</td><td>16,50</td></body></html>"""


def pages(spark):
    return spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")


def test_links(spark):
    assert [(r.page_id, r.href, r.text) for r in html.page_links(pages(spark)).orderBy("position").collect()] == [(1, "/x", "One two"), (1, "", "none")]


def test_label_values(spark):
    got = [(r.label, r.value, r.n) for r in html.label_values(pages(spark)).orderBy("n").collect()]
    assert got[:2] == [("Rate", "5 %", 1), ("Rate", "6 %", 2)]


def test_cards_and_state_and_rates(spark):
    assert [(r.title, r.advantages) for r in html.product_cards(pages(spark)).collect()] == [("Card", ["up to 5%"])]
    rows = pages(spark).select("page_id", html.embedded_json(F.col("html"), "window.state").alias("j")).orderBy("page_id").collect()
    assert [r.j for r in rows] == ['{"a": {"b": [1, "}"]}}', None, None]
    assert [(str(r.day), r.rate) for r in html.key_rates(pages(spark)).collect()] == [("2026-10-25", 16.5)]


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(2, None), (1, "x")], "k int, v string")
    c = spark.createDataFrame([(2, None), (1, "y")], "k int, v string")
    prints = [sinks.fingerprint(d, ["k"]).first().fingerprint for d in (a, b, c)]
    assert prints[0] == prints[1] != prints[2]


def test_bi_tables_replace_their_dates(spark, tmp_path):
    path = str(tmp_path / "bi")
    first = spark.createDataFrame([("2026-01-01", "=x"), ("2026-01-02", "b")], "snapshot_date string, v string")
    sinks.write_bi(first, path)
    sinks.write_bi(spark.createDataFrame([("2026-01-02", "c")], "snapshot_date string, v string"), path)
    got = spark.read.option("header", True).csv(path)
    assert sorted(r.v for r in got.collect()) == ["'=x", "c"]


def test_numbers_as_text(spark):
    rows = spark.createDataFrame([(1.5,), (2.0,), (None,)], "x double").select(sinks.trimmed(F.col("x")).alias("t"))
    assert [r.t for r in rows.collect()] == ["1.5", "2", None]
