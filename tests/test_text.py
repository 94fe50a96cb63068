import datetime
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ratelens.functions import text
from ratelens.functions.rules import all_matches, first_match


def values(spark, f, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in rows.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_normalised_keeps_cyrillic(spark):
    assert values(spark, text.normalised, "Вклад, НОВЫЙ! Ёлка https://a.b/c @me #tag", None) == ["вклад новый елка", None]


def test_slug(spark):
    assert values(spark, text.slug, "Лучший вклад!", "  Жёлтая щука ", "A--B") == ["luchshiy-vklad", "zheltaya-shchuka", "a-b"]
    assert values(spark, text.slug, "хит цен объём", "a" * 39 + " b") == ["khit-tsen-obem", "a" * 39]


def test_organisation_name(spark):
    assert values(spark, text.organisation_name, "ООО «Ромашка»", 'АО "Завод Аорта"') == ["ромашка", "завод аорта"]


def test_numbers(spark):
    assert values(spark, text.numbers, "1 500,5 и 20, снова 20", "нет") == [["1500.5", "20"], []]


def test_money(spark):
    a, b, c = values(spark, text.money_range, "от 10 тыс до 1,5 млн ₽", "до 300 000 USD", "сколько угодно")
    assert (a["min"], a["max"], a["currency"]) == (Decimal("10000.00"), Decimal("1500000.00"), "RUB")
    assert (b["min"], b["max"], b["currency"]) == (None, Decimal("300000.00"), "USD")
    assert (c["min"], c["max"], c["currency"]) == (None, None, None)


def test_terms(spark):
    a, b, c, d = values(spark, text.term_days, "от 3 до 12 мес.", "3 и 6 мес", "до 3 лет", "91 день")
    assert (a["min_days"], a["max_days"], a["values"]) == (91, 365, None)
    assert b["values"] == [91, 183] and d["values"] == [91]
    assert (c["min_days"], c["max_days"], c["values"]) == (None, None, None)


@pytest.mark.parametrize("page,value,found", [("ставка 14,8 %", 14.8, True), ("ставка 114,8 %", 14.8, False), ("ставка 14,85 %", 14.8, False), ("2 %", 2.0, True), ("2 года", 2.0, False)])
def test_number_on_page(spark, page, value, found):
    assert spark.range(1).select(text.number_on_page(F.lit(page), F.lit(value)).alias("v")).first()["v"] is found


def test_benefit_and_status(spark):
    said = {
        "Кэшбэк 10% на всё": ("cashback", 10.0, "%"),
        "кешбэк 9000 ₽": ("cashback", 9000.0, "rub"),
        "снизим ставку до 5% и кешбэк 10%": ("rate", 5.0, "%"),
        "до 4 000 бонусных баллов": ("points", 4000.0, "pts"),
        "скидка 15 %": ("discount", 15.0, "%"),
        "скидка 500 руб": ("discount", 500.0, "rub"),
        "вернём 500 ₽": ("cashback", 500.0, "rub"),
        "розыгрыш 1 000 000 ₽": ("prize", 1000000.0, "rub"),
        "обслуживание бесплатно, 300 ₽ в подарок": ("free", None, ""),
        "300 ₽ в подарок": ("free", None, ""),  # an amount that ends in 0 reads as "0 ₽"
        "305 ₽ в подарок": ("money", 305.0, "rub"),
        "до 7 %": ("other", 7.0, "%"),
        "просто так": ("other", None, ""),
    }
    assert [(k["type"], k["value"], k["unit"]) for k in values(spark, text.benefit, *said)] == list(said.values())
    today = F.lit(datetime.date(2026, 10, 25))
    status = {
        "Акция действует до 01.10.2026": "expired",
        "предложение действует по 31.12.26": "active",
        "акция до 31 октября 2020 года": "expired",
        "Оформите карту до 31 декабря 2026": "active",
        "успейте до 31 октября": "undated",
        "для карт, полученных до 31.01.2024": "undated",
        "до 01.10.2020": "undated",
        "Акция для карт, открытых до 31.01.2024, действует до 31.12.2026": "active",
        "акция до 45.13.2026, срок до 01.02.2026": "expired",
        "Акция завершена 30.06.2026": "expired",
    }
    assert values(spark, lambda t: text.promo_status(t, today), *status) == list(status.values())


def test_tax_ids(spark):
    assert values(spark, text.tax_id_valid, "7707083893", "7707083894", "500100732259", "500100732258", "12", None) == [True, False, True, False, False, False]


def test_urls(spark):
    assert values(spark, text.without_tracking, "https://a/b?utm_source=x&c=1", "https://a/b?utm_source=x", "https://a/b?c=1&utm_x=2#t") == ["https://a/b?c=1", "https://a/b", "https://a/b?c=1#t"]
    host = lambda u: text.is_official(text.url_host(u), ["bank.ru"])
    assert values(spark, host, "https://bank.ru/x", "https://www.bank.ru/", "https://notbank.ru/") == [True, True, False]


def test_html_to_text(spark):
    page = "<html><head><title>t</title></head><body><script>var a='<p>'</script><table><tr><td>a</td><td>b&amp;c</td></tr></table><p>x&nbsp;y</p></body></html>"
    assert values(spark, text.html_to_text, page) == ["a | b&c\nx y"]


def test_rules_are_ordered(spark):
    rules = [("a", "x"), ("b", "x|y")]
    assert values(spark, lambda t: first_match(t, rules, "none"), "x", "y", "z", None) == ["a", "b", "none", "none"]
    assert values(spark, lambda t: all_matches(t, rules), "x", "z") == [["a", "b"], []]


def test_formula_and_quotes(spark):
    assert values(spark, text.formula_safe, "=1+1", "ok") == ["'=1+1", "ok"]
    rows = spark.createDataFrame([("ставка 14,8 %", "наша ставка 14,8 % годовых", "14,8"), ("ставка 14,8 %", "наша ставка 14,8 % годовых", "15")], "q string, s string, v string")
    assert [r[0] for r in rows.select(text.quote_holds(F.col("q"), F.col("s"), F.col("v"))).collect()] == [True, False]


def test_hostile_input_is_fast(spark):
    hostile = "1 " * 50_000 + "от " * 20_000 + "<" * 20_000
    for f in (text.numbers, text.money_range, text.term_days, text.benefit, text.html_to_text, text.normalised):
        start = time.perf_counter()
        values(spark, f, hostile)
        assert time.perf_counter() - start < 10  # seconds on a busy machine; quadratic patterns take minutes


def test_entities(spark):
    cases = {"&#8470; 5 &mdash; &laquo;a&raquo; &amp;lt; &#x1F600; &unknown; & co &#0; &#xD800; &#99999999;": "№ 5 — «a» &lt; 😀 &unknown; & co &#0; &#xD800; &#99999999;", "no references": "no references", "&": "&", "&nbsp;x": "\u00a0x", "&#65;&#1071;": "AЯ"}
    got = {r.t: r.v for r in spark.createDataFrame([(c,) for c in cases], "t string").select("t", text.entities_resolved(F.col("t")).alias("v")).collect()}
    assert got == cases


def test_terms_in_days_and_nights(spark):
    got = spark.createDataFrame([("от 30 до 60 сут.",)], "t string").select(text.term_days(F.col("t")).alias("d")).first().d
    assert (got.min_days, got.max_days) == (30, 60)


def test_lines_near_digits_take_time_by_their_number(spark, tmp_path):
    """One text of very many lines; made anew for each line, its digits took hours."""
    import time

    from ratelens.plans.text_queries import lines_with_digits_window

    n = 60_000
    said = "\n".join("7" if i % 10 == 0 else "a" for i in range(n))
    spark.createDataFrame([(1, said), (2, "no\nnumber"), (3, None), (4, "a\n1")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.perf_counter()
    got = {r.doc_id: (r.lines, r.chars) for r in lines_with_digits_window(spark, str(tmp_path)).collect()}
    assert got == {1: (3 * n // 10 - 1, 3 * n // 10 - 1), 4: (2, 2)}
    assert time.perf_counter() - began < 60
