"""Queries over pages: a page's own text around a product's block, and what has to be read from it.

Each page of the table gets one of LAYOUTS, by its key, with numbers made from the key, above and below its own visible text. The
SQL states what has to come out of each layout; it doesn't read texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.functions import tariffs, text
from ratelens.operators import pages
from ratelens.plans.registry import query
from ratelens.sources import adapters
from ratelens.sources.tables import table

#: (h1, category of the page, lines, expected: name, category, low, high, apr_low, apr_high, kind, source, amount_max, term_max)
#: {a} < {b} < {c} are rates, {n} a number of years.
LAYOUTS = [
    ("Семейная ипотека", "Ипотека", "от 21,5%|Первоначальный взнос|от {a}%|Ставка", "Семейная ипотека", "Ипотека", "a", "a", None, None, "base", "body", None, None),
    ("Кредит под залог квартиры", "Кредиты", "Сумма до 75% от стоимости недвижимости|от {a}%|до {n} млн ₽, до {n} лет", "Кредит под залог квартиры", "Кредиты", "a", "a", None, None, "base", "body", "n * 1000000", "n * 12"),
    ("Ипотека на новых землях", "Ипотека", "Диапазон полной стоимости кредита|Ставка|На весь срок|{b} – {c}%|от {a}%|При условии:", "Ипотека на новых землях", "Ипотека", "a", "a", "b", "c", "base", "body", None, None),
    ("Кредит на всё", "Кредиты", "{b}% – {c}%|Полная стоимость кредита|От {a}%|Ставка", "Кредит на всё", "Кредиты", "a", "a", "b", "c", "base", "body", None, None),
    ("Потребительский кредит", "Кредиты", "Получаю зарплату в банке|Ставка|От {a}%|Срок|до {n} лет|Заявка|Решение|Выдача|Деньги|Общие условия|Ставка|От {b}%", "Потребительский кредит", "Кредиты", "b", "b", None, None, "base", "body", None, "n * 12"),
    ("Накопительный счёт Простой", "Вклады", "До {a}%|Снимайте когда угодно|Без комиссий|{a}% годовых — для новых клиентов", "Накопительный счёт Простой", "Накопительные счета", "a", "a", None, None, "welcome", "body", None, None),
    ("Вклад «Рост» в рублях до {a}% годовых", "Вклады", "Пополнять можно в любой день и на любую сумму|Открывают и закрывают его в любом отделении банка", "Вклад «Рост» в рублях", "Вклады", "a", "a", None, None, "base", "headline", None, None),
    ("Карта покупок", "Кредитные карты", "До 7% за авиабилеты|до 50%|за покупки у партнеров|9% годовых по накопительному счету|Ставка на покупки|{a} — {b}% годовых", "Карта покупок", "Кредитные карты", "a", "b", None, None, "base", "body", None, None),
    ("Карта на каждый день", "Дебетовые карты", "До 10% кешбэк|{a}% годовых на остаток", "Карта на каждый день", "Дебетовые карты", "a", "a", None, None, "base", "balance", None, None),
    ("Золотая карта", "Дебетовые карты", "Карта больше не выпускается.|до 40%|в магазине", "Золотая карта", "Дебетовые карты", None, None, None, None, "niche", None, None, None),
    ("Вклады в городах", "Вклады", "до {a}%|Ставка", None, None, None, None, None, None, None, None, None, None),
    ("Откройте вклад «Копилка» со ставкой до {b}% годовых", "Вклады", "Ставка|{a}%|от {n} месяцев", "Вклад «Копилка»", "Вклады", "a", "a", None, None, "base", "body", None, None),
]
_NUMBERS = {"a": "(page_id % 17 + 5.5)", "b": "(page_id % 17 + 7.25)", "c": "(page_id % 17 + 9.75)", "n": "(page_id % 9 + 2)"}


def _expected(i: int, kind: str) -> str:
    cases = []
    for k, layout in enumerate(LAYOUTS):
        value = layout[i]
        if value is not None:
            for name, sql in _NUMBERS.items():
                value = value.replace(name, sql) if kind == "DOUBLE" and i > 4 else value
            cases.append(f"WHEN {k} THEN " + (f"CAST({value} AS DOUBLE)" if kind == "DOUBLE" else f"'{value}'"))
    return f"CASE page_id % {len(LAYOUTS)} {' '.join(cases)} END"


_COLUMNS = [("name", 3, "VARCHAR"), ("category", 4, "VARCHAR"), ("rate_min", 5, "DOUBLE"), ("rate_max", 6, "DOUBLE"), ("apr_min", 7, "DOUBLE"), ("apr_max", 8, "DOUBLE"), ("rate_kind", 9, "VARCHAR"), ("rate_source", 10, "VARCHAR"), ("amount_max", 11, "DOUBLE"), ("term_max", 12, "DOUBLE")]
_SQL = f"""SELECT page_id, {", ".join(f"{_expected(i, kind)} AS {name}" for name, i, kind in _COLUMNS)}, page_id % {len(LAYOUTS)} = 9 AS is_closed, 'г. Луганск, ул. Советская, ' || (page_id % 90 + 10) AS presence
FROM pages WHERE page_id % {len(LAYOUTS)} <> 10"""


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, h1, title, text, category: the table's pages with a product's block in their text."""
    # A page takes long for its bytes: files of few parts are dealt over all cores.
    spread = table(spark, sf_dir, "pages").select("page_id", "html").repartition(6 * spark.sparkContext.defaultParallelism)
    rows = spread.select("page_id", text.html_to_text(F.col("html")).alias("own"))
    layout = (F.col("page_id") % len(LAYOUTS)).cast("int")

    def of(i: int):
        out = F.element_at(F.array(*[F.lit(x[i]) for x in LAYOUTS]), layout + 1)
        for name, sql in _NUMBERS.items():
            shown = F.expr(f"replace(regexp_replace(CAST({sql} AS STRING), '[.]?0+$', ''), '.', ',')") if name != "n" else F.expr(f"CAST({sql} AS STRING)")
            out = F.replace(out, F.lit(f"{{{name}}}"), shown)
        return out

    h1 = of(0)
    office = F.concat(F.lit("Города: Москва, Луганск\nг. Луганск, ул. Советская, "), (F.col("page_id") % 90 + 10).cast("string"))
    shown = F.concat_ws("\n", F.col("own"), h1, F.replace(of(2), F.lit("|"), F.lit("\n")), F.lit("Другие предложения"), F.lit("Вклад до 22%"), F.col("own"), office)
    return rows.select("page_id", h1.alias("h1"), F.concat(h1, F.lit(" | Банк")).alias("title"), shown.alias("text"), of(1).alias("category"))


@query("page_products", _SQL)
def page_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.page_products(product_pages(spark, sf_dir))
    return found.select("page_id", *[F.col(n).cast("double").alias(n) if kind == "DOUBLE" else n for n, _, kind in _COLUMNS], (F.col("closed") != "").alias("is_closed"), "presence")


@query(
    "channel_newest_posts",
    """WITH p AS (SELECT coalesce(source, 'none') AS channel, doc_id AS post_id, 'Post ' || doc_id || ' & more' || chr(10) || 'of ' || coalesce(n_chars, 0) || ' characters' AS text, TIMESTAMP '2026-10-01 00:00:00' + to_minutes(doc_id) AS published_at, text IS NOT NULL AND doc_id % 9 <> 4 AS whole FROM documents),
    n AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY post_id DESC) AS n FROM p WHERE whole AND published_at > TIMESTAMP '2026-10-01 03:00:00')
    SELECT channel, post_id, text, strftime(published_at, '%Y-%m-%d %H:%M') AS published_at FROM n WHERE n <= 20""",
)
def channel_newest_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages of their source's channel, up to 16 on a saved page; some messages have no text or no time."""
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("channel"), "doc_id", F.col("n_chars"), F.col("text").isNotNull().alias("said"))
    said = F.when(F.col("said"), F.concat(F.lit('<div class="tgme_widget_message_text">Post '), F.col("doc_id").cast("string"), F.lit(" &amp; more<br><i>of "), F.coalesce(F.col("n_chars").cast("string"), F.lit("0")), F.lit(" characters</i></div>"))).otherwise("")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2026-10-01 03:00:00")) + F.col("doc_id") * 60)
    stamp = F.when(F.col("doc_id") % 9 != 4, F.concat(F.lit('<a class="tgme_widget_message_date"><time datetime="'), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit('+03:00">x</time></a>'))).otherwise("")
    one = F.concat(F.lit('<div class="tgme_widget_message" data-post="'), "channel", F.lit("/"), F.col("doc_id").cast("string"), F.lit('">'), said, stamp, F.lit("</div>"))
    pages = d.select("channel", F.floor(F.col("doc_id") / 16).alias("page"), one.alias("message")).groupBy("channel", "page").agg(F.concat_ws("", F.collect_list("message")).alias("html"))
    posts = adapters.newest_posts(adapters.channel_posts(pages), F.to_timestamp(F.lit("2026-10-01 03:00:00")), 20)
    return posts.select("channel", "post_id", "text", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published_at"))


#: Tariffs with {a} < {b}: text, expected low and high, the beginning of the quote.
TARIFFS = [
    ("Полная стоимость кредита 19,9% — 64,9%|Неустойка 20% годовых|Процентная ставка: от {a}% до {b}% годовых", "a", "b", "Процентная ставка: от "),
    ("1. Процентная ставка:|1.1. на покупки|0% годовых|от {a}% до {b}% годовых|2. Плата за обслуживание|ставка 7%", "a", "b", "1. Процентная ставка: от "),
    ("3. Процентная ставка|1.1. Базовая|от {a} до {b}% годовых|4. Плата", "a", "b", "3. Процентная ставка: от "),
    ("1. Процентная ставка|индивидуально|2. Плата|{a}% годовых|Ставка {b}%", "b", "b", "Ставка "),
    ("Неустойка — ставка {a}% в день|Ключевая ставка {b}%", None, None, None),
]


@query(
    "tariff_rates",
    f"""WITH d AS (SELECT doc_id, doc_id % {len(TARIFFS)} AS k, (doc_id % 17 + 5.5)::DOUBLE AS a, (doc_id % 17 + 7.25)::DOUBLE AS b FROM documents)
    SELECT doc_id, CASE k {' '.join(f'WHEN {i} THEN {t[1]}' for i, t in enumerate(TARIFFS) if t[1])} END AS low, CASE k {' '.join(f'WHEN {i} THEN {t[2]}' for i, t in enumerate(TARIFFS) if t[2])} END AS high,
      CASE k {' '.join(f"WHEN {i} THEN '{t[3]}' || replace({t[1]}::VARCHAR, '.', ',')" for i, t in enumerate(TARIFFS) if t[3])} END AS quote FROM d""",
)
def tariff_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with a tariff below its text."""
    form = F.element_at(F.array(*[F.lit(t[0]) for t in TARIFFS]), (F.col("doc_id") % len(TARIFFS)).cast("int") + 1)
    shown = {n: F.expr(f"replace(regexp_replace(CAST({_NUMBERS[n].replace('page_id', 'doc_id')} AS STRING), '[.]?0+$', ''), '.', ',')") for n in "ab"}
    for name, value in shown.items():
        form = F.replace(form, F.lit(f"{{{name}}}"), value)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", "text", F.replace(form, F.lit("|"), F.lit("\n"))).alias("said"), shown["a"].alias("a"), shown["b"].alias("b"))
    found = rows.withColumn("r", tariffs.tariff_rate(F.col("said")))
    start = F.regexp_extract(F.col("r.quote"), r"^(.*?\d+(?:,\d+)?)(?=%| до)", 1)
    return found.select("doc_id", F.col("r.low").alias("low"), F.col("r.high").alias("high"), F.when(F.col("r").isNotNull(), start).alias("quote"))
