"""Programs, tags, similarity and the matrix on products whose analogues are known."""

import pytest
from pyspark.sql import functions as F

from ratelens.operators import analogues

SCHEMA = "bank string, product int, category string, title string, context string, rate_min double, rate_max double, kind string, closed string, offered string"


@pytest.mark.parametrize(
    "title,category,program",
    [
        ("Кредит без залога", "Кредиты", "Потребительский кредит"),
        ("Кредит под залог автомобиля", "Кредиты", "Кредит под залог авто"),
        ("Кредит под залог недвижимости", "Кредиты", "Кредит под залог"),
        ("Семейная военная ипотека", "Ипотека", "Военная ипотека"),
        ("Военная ипотека. Рефинансирование", "Ипотека", "Военная ипотека"),
        ("Госпрограмма. Новые субъекты 2%", "Ипотека", "Льготная для новых регионов"),
        ("Ипотека", "Ипотека", "Рыночная ипотека"),
        ("Вклад до востребования", "Накопительные счета", "Счета до востребования"),
        ("Карта", "Дебетовые карты", "Дебетовые карты"),
        (None, "Кредиты", "Потребительский кредит"),
    ],
)
def test_programs(spark, title, category, program):
    assert spark.createDataFrame([(title, category)], "t string, c string").select(analogues.program_of(F.col("c"), F.coalesce("t", F.lit(""))).alias("p")).first().p == program


def test_tags(spark):
    cases = {("Автонакопления", ""): ["сервис"], ("Автокредит", ""): ["авто"], ("Вклад «Забота о будущем»", ""): ["пдс"], ("Накопилка", ""): [], ("Кредит на образование", ""): [], ("Кредит на образование с господдержкой", ""): ["господ"], ("Кредит с пониженной ставкой", "Оплачивайте товары и услуги в кредит онлайн"): ["рассрочка"], ("Вклад", "Ставка меняется вслед за ключевой ставкой"): ["ключ"], ("Black", ""): ["иностр"], ("", ""): []}
    got = spark.createDataFrame(list(cases), "t string, c string").select("t", "c", analogues.tags_of(F.col("t"), F.col("c")).alias("g")).collect()
    assert {(r.t, r.c): r.g for r in got} == cases


def test_matrix_and_lights(spark):
    def p(bank, n, title, rate, category="Вклады", context="", kind="base", closed=None, offered="lnr"):
        return (bank, n, category, title, context, rate, rate, kind, closed, offered)

    rows = [
        p("home", 1, "Вклад Выгодный старт", 12.5), p("home", 2, "Вклад в дирхамах", 3.0), p("home", 3, "Вклад в юанях", 1.0), p("home", 4, "Накопилка", 10.0),
        p("home", 5, "Кредит наличными", 18.0, "Кредиты"), p("home", 6, "Карта болельщика", 1.0, "Дебетовые карты"), p("home", 7, "Вклад Летний", None),
        p("x", 11, "Вклад «Ключевой»", 12.6), p("x", 12, "Вклад в юанях", 0.9), p("x", 13, "Семейная копилка", 12.0), p("x", 14, "Кредит наличными", 20.0, "Кредиты"),
        p("x", 15, "Кредит на газификацию с господдержкой", 3.0, "Кредиты", kind="niche"), p("x", 16, "Карта ЦСКА", 2.0, "Дебетовые карты"),
        p("t", 21, "Вклад", 12.3, context="Ставка меняется вслед за ключевой ставкой ЦБ"), p("z", 31, "Вклад Обычный", 12.0, offered="absent"), p("z", 32, "Вклад Обычный", 11.0), p("z", 33, "Вклад Обычный летний", 11.0), p("w", 41, "Вклад Старый", 20.0, closed="закрыт", kind="niche"),
    ]
    cells = analogues.matrix(spark.createDataFrame(rows, SCHEMA), "home")
    got = {(r["product"], r.bank): (r.twin, r.nearest, r.close) for r in cells.collect()}
    assert got[1, "x"] == (13, None, False) and got[1, "t"] == (None, 21, False) and got[1, "w"] == (None, 41, False)
    assert got[1, "z"] == (32, None, True)  # offered here, then the better rate, then the shorter title
    assert got[3, "x"] == (12, None, True) and got[2, "x"][0] is None
    assert got[5, "x"] == (14, None, True) and got[6, "x"] == (16, None, False)  # co-branded cards alone aren't close
    assert (4, "t") in got and (5, "t") not in got
    seen = {(r["product"], r.bank): (r.delta, r.light) for r in analogues.lights(cells).collect()}
    assert seen[5, "x"] == (-2.0, "green") and seen[1, "z"] == (1.5, "green") and seen[7, "z"] == (None, "grey") and seen[3, "x"] == (0.1, "yellow")
    assert (1, "x") not in seen and (6, "x") not in seen
    assert analogues.matrix(spark.createDataFrame([], SCHEMA), "home").collect() == []
