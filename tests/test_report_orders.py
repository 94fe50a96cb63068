from pyspark.sql import functions as F

from ratelens.operators import reports


def test_listing_copies(spark):
    paths = {"bank.ru": r"^/personal/karty/(?:s-[\w-]+|imennye)/?$"}
    cases = {"https://www.bank.ru/personal/karty/s-keshbekom/": True, "https://BANK.ru/personal/karty/imennye?x=1": True, "https://bank.ru/personal/karty/black": False, "https://m.bank.ru/personal/karty/imennye": False, "no url": False}
    got = spark.createDataFrame([(u,) for u in cases], "u string").select("u", reports.is_listing_copy(F.col("u"), paths).alias("c")).collect()
    assert {r.u: r.c for r in got} == cases
    assert spark.createDataFrame([(None,)], "u string").select(reports.is_listing_copy(F.col("u"), paths).alias("c")).first().c is False


def test_real_promotions(spark):
    cases = {"Акция до 31.12.2026": True, "Вернём 5 %": True, "Дарим подарок": True, "Карта мир": False, "": False, None: False}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", reports.is_real_promotion(F.col("t")).alias("p")).collect()
    assert {r.t: r.p for r in got} == cases


def test_sources(spark):
    rows = spark.createDataFrame([(1, "active", "fetch"), (2, "todo", "fetch"), (3, "active", "manual"), (4, "off", "fetch"), (5, None, "fetch")], "id int, status string, mode string")
    assert [r.id for r in reports.eligible_sources(rows).collect()] == [1]
    assert sorted(r.id for r in reports.eligible_sources(rows, probing=True).collect()) == [1, 2]
