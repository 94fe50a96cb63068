"""Promotion, availability, text and report operators against results written out by hand."""

import datetime

from pyspark.sql import functions as F

from ratelens.functions import formats, text
from ratelens.operators import availability, digest, promotions, quality, scenarios, snapshots


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_offer_or_article(spark):
    titles = {"Что такое акции": False, "Как подключить услугу": False, "Тарифы и документы": False, "": False, None: False, "Кешбэк 10%": True, "Акция: что такое?": True}
    for title, offered in titles.items():
        assert one(spark, promotions.is_offer(F.lit(title).cast("string"))) == offered


def test_segments(spark):
    cases = {
        ("/personal/debetcards/x", "Кредит", "", ""): "Дебетовые карты",
        ("/personal", "Тарифы карт", "", ""): "Банковские карты",
        ("", "Кредитной картой", "", ""): "Кредитные карты",
        (None, None, "вклад", None): "Вклады",
        (None, "Подарок", None, "points"): "Кешбэк и бонусные программы",
        (None, None, None, None): "Прочие предложения",
    }
    for given, expected in cases.items():
        assert one(spark, promotions.segment(*[F.lit(v).cast("string") for v in given])) == expected


def test_prizes_are_no_headline(spark):
    rows = [("s", 1, "prize", "rub", 1e6), ("s", 2, "points", "pts", 2000.0), ("s", 3, "cashback", "%", 30.0), ("s", 4, "cashback", "%", None), ("t", 5, "prize", "rub", 5.0), ("t", 6, "other", "", None)]
    promos = spark.createDataFrame(rows, "segment string, promo int, kind string, unit string, value double")
    assert {r.segment: r.promo for r in promotions.headline(promos, ["segment"], "promo").collect()} == {"s": 3, "t": 6}
    assert {(r.kind, r.best_value) for r in promotions.best_values(promos, "segment").collect()} == {("points", 2000.0), ("cashback", 30.0)}
    assert promotions.headline(promos.limit(0), ["segment"], "promo").count() == 0


def test_denial_clause(spark):
    said = {
        "Всё хорошо. Кредит не предоставляется  в ДНР, ЛНР. Конец": "Кредит не предоставляется в ДНР, ЛНР",
        "Ипотека для жителей ЛНР, кроме Луганска": "",
        "Карта не выдаётся. Офис в Луганске": "",
        "Недоступна для жителей новых регионов": "Недоступна для жителей новых регионов",
    }
    for page, clause in said.items():
        assert one(spark, availability.denial_clause(F.lit(page))) == clause
    assert one(spark, availability.denial_clause(F.lit(None).cast("string"))) == ""


def test_numbers_of_texts(spark):
    assert one(spark, text.money_list(F.lit("От 30 000 до 1,5 млн ₽"))) == [30000.0, 1500000.0]
    assert one(spark, text.money_list(F.lit("от 1 до 3 млн руб. в 2026 году"))) == [1e6, 3e6, 2026.0]
    assert one(spark, text.money_list(F.lit("до 5 млн"))) == []
    assert one(spark, text.term_months(F.lit("От 36 до 84 месяцев"))) == [36, 84]
    assert one(spark, text.term_months(F.lit("10 дней или 2 года"))) == [1, 24]
    assert tuple(one(spark, text.rate_range(F.lit("До 16% годовых")))) == (None, 16.0)
    assert tuple(one(spark, text.rate_range(F.lit("20 – 16,5 %")))) == (16.5, 20.0)
    assert one(spark, text.rate_range(F.lit("16"))) is None


def test_content_title(spark):
    names = F.array(F.lit("ООО «Ромашка»"))
    assert one(spark, text.content_title(F.lit("«Ромашка» начала поставки"), names)) == "начала поставки"
    assert one(spark, text.content_title(F.lit("Ромашка растёт"), names)) == ""


def test_formats(spark):
    assert one(spark, formats.money(F.lit(1234567.5))) == "1 234 567,50 ₽"
    assert one(spark, formats.money(F.lit(100.0))) == "100 ₽"
    assert one(spark, formats.percent(F.lit(12.50))) == "12,5%"
    assert [one(spark, formats.plural(F.lit(n), "акция", "акции", "акций")) for n in (1, 3, 11, 112, 121, 0)] == ["акция", "акции", "акций", "акций", "акция", "акций"]
    assert one(spark, formats.moscow(F.lit(datetime.datetime(2026, 10, 27, 22, 25)))).endswith("МСК")
    assert one(spark, formats.moscow(F.lit(None).cast("timestamp"))) == "—"


def test_statuses_and_severities(spark):
    reads = spark.createDataFrame([("a", True), ("a", None), ("b", False), ("c", True)], "bank string, ok boolean")
    assert {r.bank: r.status for r in quality.collection_status(reads, "bank").collect()} == {"a": "partial", "b": "failed", "c": "ok"}
    changes = spark.createDataFrame([(1, 1, "info"), (1, 2, "rate"), (2, 3, None), (1, 4, "conditions")], "run int, id int, severity string")
    order = ("info", "conditions", "rate")
    assert {r.run: r.severity for r in snapshots.highest_severity(changes, order, "run").collect()} == {1: "rate", 2: "info"}
    assert {r.id for r in snapshots.at_least(changes, order, "conditions").collect()} == {2, 4}
    assert [r.id for r in snapshots.in_severity_order(changes, order, "run", "id").where("run = 1").orderBy("place").collect()] == [2, 4, 1]


def test_goals_and_groups(spark):
    options = spark.createDataFrame([("g", 1, False, "нет", False), ("g", 2, True, None, False), ("h", 3, False, None, False), ("h", 4, True, None, True), ("i", 5, None, None, None)], "goal string, n int, available boolean, note string, no_region boolean")
    assert [tuple(r) for r in scenarios.blocked_goals(options, "goal", "n").collect()] == [("h", "недоступно", 1)]
    posts = spark.createDataFrame([(1, 1, "ab", "x", 3), (1, 2, "abc", "y", 1), (1, 3, "abd", "x", 2), (2, 1, None, None, 5)], "g int, p int, t string, c string, s int")
    got = {r.g: (r.main, r.score, r.labels) for r in digest.merge_groups(posts, "g", "p", "t", "c", "s").collect()}
    assert got == {1: (2, 3, ["x", "y"]), 2: (1, 5, None)}
