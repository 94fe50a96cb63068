"""Rates and links of tariffs."""

from pyspark.sql import functions as F

from ratelens.functions import tariffs

CASES = {
    "Тарифный план\nПолная стоимость кредита 19,9% — 64,9%\nНеустойка при неоплате 20% годовых\nПроцентная ставка: от 18,9% до 54,9% годовых\n": (18.9, 54.9, "Процентная ставка: от 18,9% до 54,9%"),
    "Неустойка — ставка 0,1% в день": None,
    "1. Процентная ставка:\n1.1. на покупки в период до 55 дней\n1.2. на покупки\nПроценты не начисляются, если:\n0% годовых\nот 29,9% до 51,9% годовых\n2. Плата за обслуживание\n": (29.9, 51.9, "1. Процентная ставка: от 29,9% до 51,9% годовых"),
    "1. Процентная ставка\n1.1. Базовая\nот 0,01 до 31,0% годовых\n+ 15 процентных пунктов\n2. Плата\n": (0.01, 31.0, "1. Процентная ставка: от 0,01 до 31,0% годовых"),
    "1. Процентная ставка\n55\n2. Плата\n": None,
    "1. Процентная ставка\nсм. ниже\n2. Плата\n12% годовых\nСтавка 15,5%": (15.5, 15.5, "Ставка 15,5%"),
    "Ставка 75%\nставка по кредиту 17%": (17.0, 17.0, "ставка по кредиту 17%"),
    "Ключевая ставка 16% и ставка 18%\nСтавка от 20% до 18%": None,
    "": None,
}


def test_rates_of_tariffs(spark):
    rows = spark.createDataFrame([(t,) for t in CASES] + [(None,)], "t string").select("t", tariffs.tariff_rate(F.col("t")).alias("r")).collect()
    got = {r.t: None if r.r is None else (r.r.low, r.r.high, r.r.quote) for r in rows}
    assert got.pop(None) is None and got == CASES
    assert spark.createDataFrame([("Ставка 65%",)], "t string").select(tariffs.tariff_rate(F.col("t"), 70.0).alias("r")).first().r.low == 65.0


def test_links_of_tariffs(spark):
    links = [("https://c/doc-requirements.pdf", "Требования"), ("https://c/loyalty-tariff.pdf", "Правила"), ("https://c/loan-tariff-2x.PDF?v=1", None), ("https://c/5b.pdf", "Тарифы по кредиту"), ("https://c/loan", "Тариф"), ("https://c/third-tarif.pdf", "")]
    row = spark.createDataFrame([(links,), ([],)], "l array<struct<href:string,text:string>>").select(tariffs.tariff_links(F.col("l")).alias("x")).collect()
    assert [r.x for r in row] == [["https://c/loan-tariff-2x.PDF?v=1", "https://c/5b.pdf"], []]
