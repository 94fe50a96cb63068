"""Product pages: each layout with its expected product; pages of other kinds; nulls and very long pages."""

import time

import pytest
from pyspark.sql import functions as F

from ratelens.functions import rates
from ratelens.operators import pages

MENU = ["Частным лицам", "Бизнесу", "Войти"]
FOOT = ["Другие предложения", "Вклад до 22%", "Кредит от 3,5% годовых"]


def page(h1, *lines, category="Кредиты", tail=FOOT):
    return (h1, f"{h1} | Банк", "\n".join([*MENU, h1, *lines, *tail]), category)


# (page, name, rate_min, rate_max, apr_min, apr_max, further expectations)
CASES = {
    "caption says it is the first payment": (page("Семейная ипотека", "от 21,5%", "Первоначальный взнос", "от 7%", "Ставка", category="Ипотека"), "Семейная ипотека", 7.0, 7.0, None, None, {}),
    "share of a value": (page("Кредит под залог квартиры", "Сумма до 75% от стоимости недвижимости", "от 18,4%"), "Кредит под залог квартиры", 18.4, 18.4, None, None, {}),
    "rate below the end of the description": (page("Кредит наличными", "Деньги за пять минут"), "Кредит наличными", None, None, None, None, {"recheck": True}),
    "full cost above, captions first": (
        page("Ипотека для новых территорий", "От 12,1%", "Первый взнос", "Скидка 0,4%", "Условия", "Требования", "Документы", "Страхование", "Диапазон полной стоимости кредита", "Ставка", "На весь срок", "17,512 – 24,643%", "от 2%", "При условии:", category="Ипотека"),
        "Ипотека для новых территорий", 2.0, 2.0, 17.512, 24.643, {},
    ),
    "cost between two numbers belongs to the one above": (
        page("Кредит на всё", "От 40 тыс. ₽", "Минимальная сумма", "Полезная информация", "Условия", "Ставки", "Документы", "21,900% – 52,400%", "Полная стоимость кредита", "От 8,6%", "Ставка"),
        "Кредит на всё", 8.6, 8.6, 21.9, 52.4, {"amount_min": 40_000.0, "amount_max": None},
    ),
    "own label beats the caption below": (page("Кредит под залог авто", "СТАВКА ПО КРЕДИТУ: 23,5% ГОДОВЫХ", "Минимальный размер полной стоимости кредита:", "23,510%", "Максимальный размер полной стоимости кредита:", "25,1%"), "Кредит под залог авто", 23.5, 23.5, None, None, {}),
    "cost and rate in one line": (page("Образовательный кредит", "Полная стоимость кредита — 2,950% — 3,100% годовых, ставка — 3% на весь срок", "Например, полная ставка — 22,88% годовых."), "Образовательный кредит", 3.0, 3.0, 2.95, 3.1, {}),
    "the common rate below a salary rate": (
        page("Потребительский кредит", "Получаю зарплату в банке", "Ставка", "От 17,4%", "Срок", "до 5 лет", "Сумма", "до 5 млн ₽", "Заявка", "Решение", "Выдача", "Общие условия", "Ставка", "От 19,4%"),
        "Потребительский кредит", 19.4, 19.4, None, None, {"rate_kind": "base", "amount_max": 5e6, "amount_min": None, "term_max": 60, "term_min": None},
    ),
    "only a salary rate": (page("Кредит зарплатный", "Ставка", "От 16,4%", "Для тех, кто получает: зарплатный клиент"), "Кредит зарплатный", 16.4, 16.4, None, None, {"rate_kind": "salary", "recheck": True}),
    "welcome rate by its repeated number": (page("Накопительный счёт Простой", "До 14,2%", "Снимайте когда угодно", "Без комиссий", "14,2% годовых — для новых клиентов", category="Накопительные счета"), "Накопительный счёт Простой", 14.2, 14.2, None, None, {"rate_kind": "welcome"}),
    "yield is no rate": (page("Вклад «Ключ» доходность до 16,21%", "Ставка следует за ключевой ставкой ЦБ", "Доходность до 16,21%", category="Вклады"), "Вклад «Ключ»", None, None, None, None, {}),
    "rate in the headline": (page("Вклад «Рост» в рублях до 13,7% годовых", "Пополнение без ограничений", category="Вклады"), "Вклад «Рост» в рублях", 13.7, 13.7, None, None, {"rate_source": "headline"}),
    "category by title": (page("Пополняемый вклад", "Ставка", "12,5%", category="Накопительные счета"), "Пополняемый вклад", 12.5, 12.5, None, None, {"category": "Вклады"}),
    "bonus caption above": (page("Кредитная карта", "Начисление бонусов по программе", "до 1%", "годовых", category="Кредитные карты"), "Кредитная карта", None, None, None, None, {}),
    "card: categories are cashback": (
        page("Карта путешественника", "До 7% за авиабилеты", "2% в супермаркетах, кафе", "до 50%", "за покупки у партнеров", "9% годовых по накопительному счету", "Ставка на покупки", "29,9 — 61,9% годовых", category="Кредитные карты"),
        "Карта путешественника", 29.9, 61.9, None, None, {},
    ),
    "debit: cashback is no rate": (page("Детская карта", "Экономия на билетах", "до 45%", "в магазине", category="Дебетовые карты"), "Детская карта", None, None, None, None, {}),
    "debit: on the balance": (page("Карта пенсионера", "До 10% кешбэк", "5,5% годовых на остаток", category="Дебетовые карты"), "Карта пенсионера", 5.5, 5.5, None, None, {"rate_source": "balance"}),
    "block of rates further down": (page("Кредит на ремонт", "Деньги на карту", tail=[*FOOT, "Подробные условия", "Ставка", "от 18,8%", "Документы", "от 1%"]), "Кредит на ремонт", 18.8, 18.8, None, None, {"rate_source": "section"}),
    "condition far below estimates": (page("Ипотека на новостройку", "20,4 %", "Ставка", "Платёж 51 200 ₽", category="Ипотека", tail=[*FOOT, "Расчёт произведён по умолчанию", "Первый взнос", "от 20%", "Срок", "От 18,1%", "Ставка"]), "Ипотека на новостройку", 18.1, 18.1, None, None, {"estimate": False}),
    "estimate only": (page("Ипотека на дом", "Ставка 20,4 %", category="Ипотека", tail=[*FOOT, "Расчет произведен с настройками"]), "Ипотека на дом", 20.4, 20.4, None, None, {"estimate": True}),
    "footnote without the service": (page("Кредит с подпиской", "Ставка", "от 9,6%", "С услугой «Выгода»", tail=[*FOOT, "Без услуги «Выгода» ставка 19,9%-55,4% годовых."]), "Кредит с подпиской", 19.9, 55.4, None, None, {"rate_source": "footnote", "rate_kind": "base"}),
    "closed": (page("Золотая карта", "Карта больше не выпускается с 1 марта 2025 года.", category="Дебетовые карты"), "Золотая карта", None, None, None, None, {"rate_kind": "niche", "closed": "Карта больше не выпускается с 1 марта 2025 года"}),
    "not in the region": (page("Кредит сельский", "от 5,1%", "Кредит не предоставляется в ДНР и ЛНР."), "Кредит сельский", 5.1, 5.1, None, None, {"absent": "Кредит не предоставляется в ДНР и ЛНР"}),
    "too high for a mortgage": (page("Ипотека без бумаг", "79,9%", "от 11,1%", category="Ипотека"), "Ипотека без бумаг", 11.1, 11.1, None, None, {}),
    "repeated for the narrow layout": (page("Рефинансирование", "от 19,144 до 23,705%", "19,144-23,705%", "Ставка"), "Рефинансирование", 19.144, 23.705, None, None, {}),
    "call as a headline": (page("Оформите кредит наличными онлайн", "от 17%", "Ставка"), "Кредит наличными", 17.0, 17.0, None, None, {}),
    "without h1, the title is longer than the line": ((None, "Кредит на образование с поддержкой | Банк", "Меню\nКредит на образование\nот 3%\nСтавка", "Кредиты"), "Кредит на образование с поддержкой", 3.0, 3.0, None, None, {}),
    "title is no line": (("Кредит мечты", None, "Меню\nот 3%\nСтавка", "Кредиты"), "Кредит мечты", None, None, None, None, {}),
    "subsidised cost": (page("Льготная ипотека", "ПСК", "18,1%", "Базовая ставка", "18,7%", category="Ипотека", tail=["Субсидирование процентной ставки учитывалось в расчёте"]), "Льготная ипотека", 18.7, 18.7, 18.1, 18.1, {"subsidised": True, "recheck": True}),
}
NO_PRODUCTS = ["Ипотечные каникулы", "Программы поддержки заёмщиков", "Управляйте списаниями", "sberbank.ru", "Банковские карты с кешбэком", "Вклады в Самаре", "ВКЛАДЫ И CЧЕТА", "Ипотека", "Курс золота", "404"]
SCHEMA = "h1 string, title string, text string, category string"


def test_products_of_layouts(spark):
    rows = [(name, *case[0]) for name, case in CASES.items()]
    got = {r["case"]: r for r in pages.page_products(spark.createDataFrame(rows, f"case string, {SCHEMA}")).collect()}
    wrong = {}
    for name, (_, title, *numbers, more) in CASES.items():
        r = got.get(name)
        if r is None:
            wrong[name] = "no product"
            continue
        said = (r["name"], r.rate_min, r.rate_max, r.apr_min, r.apr_max, {k: r[k] for k in more})
        if said != (title, *numbers, more):
            wrong[name] = (said, r.rate_raw, r.rate_kind)
    assert not wrong, wrong


def test_pages_that_are_no_products(spark):
    rows = [page(t, "от 17%", "Ставка") for t in NO_PRODUCTS] + [(None, None, None, None), ("", "", "от 17%", ""), ("Вклад", "Вклад", "404\nТАКОЙ СТРАНИЦЫ НЕТ :(", "Вклады"), ("Вклад «А»", "502 Bad Gateway", "x", "Вклады"), ("Вклад «А»", None, "Возникла проблема при открытии сайта", "Вклады")]
    assert [r["name"] for r in pages.page_products(spark.createDataFrame(rows, SCHEMA)).collect()] == []
    assert pages.page_products(spark.createDataFrame([], SCHEMA)).collect() == []


def test_names_and_titles(spark):
    names = {"Оформите кредит наличными онлайн": "Кредит наличными", "Откройте вклад со ставкой до 12,3% годовых": "Вклад", "Открыть СберВклад в СберБанке онлайн": "СберВклад", "Кредит на авто": "Кредит на авто", "Кредит с пониженной ставкой до 3%": "Кредит с пониженной ставкой", "ВТБ-Вклад в рублях до 13,7% годовых": "ВТБ-Вклад в рублях"}
    got = spark.createDataFrame([(n,) for n in names], "t string").select("t", pages.product_name(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == names
    kept = ["Платёжный стикер", "Кредит наличными", "Дебетовая карта Black", "Накопительный ВТБ-Счет в рублях", "Ипотека на новых территориях"]
    assert [r.ok for r in spark.createDataFrame([(n,) for n in kept], "t string").select(pages.is_product_title(F.col("t")).alias("ok")).collect()] == [True] * 5


@pytest.mark.parametrize("line,expected", [("Ставка ниже до 5%", None), ("Оплачивайте до 99% чека", None), ("до 13,7% годовых", [13.7]), ("Ставка 0,01% годовых", [0.01]), ("Неустойка 0,05% в день", None), ("При взносе от 20,1% ставка 11,3% годовых", [11.3]), ("Ставка ЦБ минус 2%", None), ("от 16% до 20%", [16.0, 20.0]), ("без процентов", None)])
def test_rates_of_a_line(spark, line, expected):
    assert spark.createDataFrame([(line,)], "x string").select(rates.line_rates(F.col("x")).alias("r")).first().r == expected


@pytest.mark.parametrize(
    "lines,expected",
    [
        (["От 30 тыс. ₽", "Минимальная сумма", "До 7 млн ₽", "Максимальная сумма", "До 5 лет"], (30_000, 7_000_000, None, 60)),
        (["от 100 000 до 3 000 000 ₽, от 3 до 60 месяцев"], (100_000, 3_000_000, 3, 60)),
        (["до 5 млн ₽"], (None, 5_000_000, None, None)),
        (["Сумма: от 50 000 ₽", "Срок кредита: от 1 года"], (50_000, None, 12, None)),
        (["От 30 тыс. ₽", "до 20 тыс. ₽"], (30_000, None, None, None)),
        (["нет чисел"], (None, None, None, None)),
        ([], (None, None, None, None)),
    ],
)
def test_amounts_and_terms(spark, lines, expected):
    got = spark.createDataFrame([(lines,)], "l array<string>").select(pages.amounts_and_terms(F.col("l")).alias("a")).first().a
    assert (got.amount_min, got.amount_max, got.term_min, got.term_max) == expected


def test_presence_needs_an_address(spark):
    quotes = {"Города: Москва, Луганск, Ялта": "", "Москва\nг. Луганск,  ул. Советская, 12\nЯлта": "г. Луганск, ул. Советская, 12", "": ""}
    got = spark.createDataFrame([(q,) for q in quotes], "t string").select("t", pages.presence_quote(F.col("t"), "Луганск").alias("q")).collect()
    assert {r.t: r.q for r in got} == quotes


def test_long_pages_take_time_in_proportion(spark):
    def seconds(lines):
        text = "\n".join([*MENU, "Кредит наличными", "от 17%", "Ставка", *["Строка текста про всё подряд"] * lines])
        rows = spark.createDataFrame([("Кредит наличными", "t", text, "Кредиты")] * 4, SCHEMA)
        start = time.perf_counter()
        assert [r.rate_min for r in pages.page_products(rows).collect()] == [17.0] * 4
        return time.perf_counter() - start

    seconds(10)
    assert seconds(40_000) < 60  # over 1 MB a page


def test_clauses_of_long_texts_take_time_by_their_length(spark):
    """From each character of a text, up to 80 before a city or 60 before a clause were tried."""
    import time

    from pyspark.sql import functions as F

    from ratelens.operators import pages

    noise = "слово и слово " * 40_000
    rows = spark.createDataFrame([(f"{noise}\nг. Луганск, ул. Советская, 5; г. Луганск, ул. Мира, 7\n{noise}", f"{noise}\nКарта больше не выпускается. Да")], "page string, said string")
    began = time.perf_counter()
    got = rows.select(pages.presence_quote(F.col("page"), "Луганск").alias("p"), pages.closing_clause(F.col("said")).alias("c")).first()
    assert (got.p, got.c) == ("г. Луганск, ул. Советская, 5; г. Луганск, ул. Мира, 7", "Карта больше не выпускается")
    assert time.perf_counter() - began < 30
