"""The matrix of analogues and its lights over parts: each part is a product with one of TITLES, of one of six banks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.functions import rates
from ratelens.operators import analogues
from ratelens.plans.registry import query
from ratelens.sources.tables import table

#: (title, category, program, tags, kind by title, main product): the last four are what the rules have to find.
TITLES = [
    ("Кредит наличными", "Кредиты", "Потребительский кредит", "", "base", True),
    ("Кредит наличными пенсионерам", "Кредиты", "Потребительский кредит", "пенс", "niche", False),
    ("Кредит на газификацию с господдержкой", "Кредиты", "Потребительский кредит", "господ", "niche", False),
    ("Автокредит", "Кредиты", "Автокредит", "авто", "base", False),
    ("Кредит под залог недвижимости", "Кредиты", "*Залог недвижимости", "", "base", False),
    ("Кредит под залог недвижимости", "Ипотека", "*Залог недвижимости", "", "base", False),
    ("Вклад Выгодный старт", "Вклады", "Вклады", "", "base", False),
    ("ВТБ-Вклад «Ключевой»", "Вклады", "Вклады", "ключ", "base", False),
    ("Вклад в юанях", "Вклады", "Вклады", "валюта,юань", "niche", False),
    ("Социальный вклад", "Вклады", "Вклады", "соц", "niche", False),
    ("Пенсионный плюс", "Вклады", "Вклады", "пенс", "niche", False),
    ("Семейная ипотека", "Ипотека", "Семейная ипотека", "", "base", False),
    ("Ипотека на новостройку", "Ипотека", "Новостройки", "", "base", True),
    ("Ипотека на гараж", "Ипотека", "Рыночная ипотека", "гараж", "base", False),
    ("Ипотека", "Ипотека", "Рыночная ипотека", "", "base", False),
    ("Дебетовая карта Black", "Дебетовые карты", "Дебетовые карты", "", "base", True),
    ("Детская карта", "Дебетовые карты", "Дебетовые карты", "дети", "niche", False),
    ("Black Premium", "Дебетовые карты", "Дебетовые карты", "иностр,прем", "premium", True),
    ("Карта болельщика ЦСКА", "Дебетовые карты", "Дебетовые карты", "кобренд", "base", False),
    ("Накопительный счёт", "Накопительные счета", "Накопительные счета", "", "base", True),
    ("Накопилка", "Накопительные счета", "Накопительные счета", "", "base", False),
    ("Семейная копилка", "Накопительные счета", "Накопительные счета", "дети", "base", False),
]
_N = len(TITLES)
_LIST = ", ".join(f"({i}, '{t}', '{c}', '{p}', {[x for x in g.split(',') if x]}, '{k}', {m})" for i, (t, c, p, g, k, m) in enumerate(TITLES))
_STRICT = list(analogues.STRICT)
_MATRIX = f"""titles AS (SELECT * FROM (VALUES {_LIST}) AS x(i, title, category, program, tags, named, main)),
products AS (SELECT p_partkey AS product, 'b' || (p_partkey // {_N}) % 6 AS bank, t.* EXCLUDE (i, named), CASE WHEN p_size % 5 > 0 THEN p_size END AS low, CASE WHEN p_size % 7 > 0 THEN p_size + 2 END AS high, p_partkey % 37 = 0 AS closed,
    ['absent', 'unknown', 'federal', 'lnr'][p_partkey % 4 + 1] AS offered, CASE WHEN p_partkey % 37 = 0 THEN 'niche' WHEN named <> 'base' THEN named WHEN p_partkey % 3 = 1 THEN 'welcome' WHEN p_partkey % 3 = 2 THEN 'short_term' ELSE 'base' END AS k FROM part JOIN titles t ON p_partkey % {_N} = i),
d AS (SELECT *, category IN ('Вклады', 'Накопительные счета') AS saves, CASE WHEN program LIKE '*%' THEN program ELSE category || program END AS slot, CASE WHEN category IN ('Вклады', 'Накопительные счета') THEN coalesce(high, low) ELSE coalesce(low, high) END AS rate,
    CASE WHEN category IN ('Вклады', 'Накопительные счета') OR k = 'niche' THEN k ELSE 'base' END AS kind FROM products),
pairs AS (SELECT a.product, a.category, a.program, a.rate AS home_rate, a.tags AS own, b.bank, b.product AS twin, b.rate AS twin_rate, b.tags AS theirs, b.offered, b.saves, b.title,
    len(list_intersect(a.tags, b.tags)) AS common, list_filter(b.tags, lambda x: NOT list_contains(a.tags, x)) AS more, list_filter(a.tags, lambda x: NOT list_contains(b.tags, x)) AS less, a.kind AS ka, b.kind AS kb, b.main, b.closed
    FROM d a JOIN d b ON a.slot = b.slot WHERE a.bank = 'b0' AND b.bank <> 'b0'),
scored AS (SELECT *, CASE WHEN len(list_intersect(list_concat(more, less), {_STRICT})) > 0 THEN -10 ELSE 1 + 3 * common - 2 * len(more) - len(less) + CASE WHEN ka = kb THEN 2 WHEN ka IN ('welcome', 'short_term') AND kb IN ('welcome', 'short_term') THEN 1 ELSE 0 END
    - CASE WHEN kb = 'niche' AND common = 0 THEN 3 ELSE 0 END + CASE WHEN len(theirs) = 0 AND ka = kb AND main THEN 1 ELSE 0 END - CASE WHEN closed THEN 5 ELSE 0 END END AS score FROM pairs),
top AS (SELECT *, row_number() OVER (PARTITION BY product, bank ORDER BY score DESC, list_position(['absent', 'unknown', 'federal', 'lnr'], offered) DESC, twin_rate IS NOT NULL DESC, CASE WHEN saves THEN twin_rate ELSE -twin_rate END DESC NULLS LAST, length(title), twin) AS n FROM scored),
cells AS (SELECT product, category, ltrim(program, '*') AS program, home_rate::DOUBLE AS home_rate, bank, CASE WHEN score >= 1 THEN twin END AS twin, CASE WHEN score >= 1 THEN twin_rate END::DOUBLE AS twin_rate, CASE WHEN score < 1 THEN twin END AS nearest, score,
    score >= 2 AND len(less) = 0 AND NOT (len(own) > 0 AND len(list_filter(own, lambda x: x NOT IN ('кобренд', 'город', 'валюта'))) = 0) AS close FROM top WHERE n = 1)"""


def analogue_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products with what the rules take: titles, rates, kinds near them, closed ones, where they are offered."""
    i = (F.col("p_partkey") % _N).cast("int") + 1
    k = F.col("p_partkey")
    title, category = (F.element_at(F.array(*[F.lit(t[n]) for t in TITLES]), i) for n in (0, 1))
    rows = table(spark, sf_dir, "part").select(
        k.alias("product"),
        F.concat(F.lit("b"), (F.floor(k / _N) % 6).cast("string")).alias("bank"),
        title.alias("title"),
        category.alias("category"),
        F.lit("").alias("context"),
        F.when(F.col("p_size") % 5 > 0, F.col("p_size")).cast("double").alias("rate_min"),
        F.when(F.col("p_size") % 7 > 0, F.col("p_size") + 2).cast("double").alias("rate_max"),
        F.when(k % 37 == 0, "Приём заявок завершен").alias("closed"),
        F.when(k % 3 == 1, F.array(F.lit("welcome"))).when(k % 3 == 2, F.array(F.lit("short_term"))).otherwise(F.array().cast("array<string>")).alias("kinds"),
        F.element_at(F.array(*map(F.lit, analogues.OFFERED)), (k % 4).cast("int") + 1).alias("offered"),
    )
    return rows.withColumn("kind", rates.rate_kind(F.col("title"), F.col("kinds"), F.col("closed"))).drop("kinds")


@query("analogue_matrix", f"WITH {_MATRIX} SELECT product, CASE WHEN program = 'Залог недвижимости' AND category = 'Кредиты' THEN 'Кредит под залог' WHEN program = 'Залог недвижимости' THEN 'Кредит под залог недвижимости' ELSE program END AS program, home_rate, bank, twin, twin_rate, nearest, score, close FROM cells")
def analogue_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analogues.matrix(analogue_products(spark, sf_dir), "b0").drop("category").withColumn("score", F.col("score").cast("long"))


@query(
    "analogue_lights",
    f"""WITH {_MATRIX}, x AS (SELECT *, round(home_rate - twin_rate, 3) AS delta, CASE WHEN category IN ('Вклады', 'Накопительные счета') THEN 1 ELSE -1 END AS sign FROM cells WHERE close)
    SELECT product, bank, twin, home_rate, twin_rate, delta, CASE WHEN delta IS NULL THEN 'grey' WHEN abs(delta) < 0.5 THEN 'yellow' WHEN sign * delta > 0 THEN 'green' WHEN abs(delta) >= 1 THEN 'red' ELSE 'yellow' END AS light FROM x""",
)
def analogue_lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analogues.lights(analogues.matrix(analogue_products(spark, sf_dir), "b0")).drop("category", "program")
