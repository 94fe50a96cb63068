"""Promotions: offer or article, segment, best values, headline offers and the order of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.functions.rules import first_match

# Segments by section of the site.
SECTIONS = {
    "debetcards": "Дебетовые карты",
    "creditcards": "Кредитные карты",
    "cards": "Банковские карты",
    "pensioncards": "Пенсионные карты",
    "pensioners": "Пенсионные продукты",
    "salary": "Зарплатные карты",
    "loans": "Кредиты",
    "mortgage": "Ипотека",
    "saving": "Вклады",
    "savingsaccount": "Накопительные счета",
    "insurance": "Страхование",
    "wealth": "Инвестиции",
    "premium": "Премиальное обслуживание",
    "ecommerce": "Счета и переводы",
    "pds": "Долгосрочные сбережения",
}
# Segments by words of the title.
TITLE_RULES = [("Банковские карты", r"(?iuU)тариф\w*\s+карт"), ("Сервисы и услуги", "(?iuU)консультац|юридическ|правокард|налог|госуслуг")]
# Segments by words of the title or text, in order of precedence.
WORD_RULES = [
    ("Кредитные карты", r"(?iuU)кредитн\w*\s+карт"),
    ("Дебетовые карты", r"(?iuU)дебетов\w*\s+карт|карт[аоуы]\s+«?мир"),
    ("Зарплатные карты", "(?iuU)зарплатн"),
    ("Пенсионные продукты", "(?iuU)пенси"),
    ("Ипотека", "(?iuU)ипотек"),
    ("Кредиты", "(?iuU)кредит"),
    ("Вклады", "(?iuU)вклад|депозит"),
    ("Накопительные счета", "(?iuU)накопительн"),
    ("Инвестиции", "(?iuU)инвест|брокер|облигац"),
    ("Страхование", "(?iuU)страхов"),
]
BONUS, OTHER = "Кешбэк и бонусные программы", "Прочие предложения"
BONUS_WORDS = "(?iuU)кешб[эе]к|кэшб[эе]к|бонус|балл|покупк"
# Beginnings of titles of articles and notices.
NOT_OFFERS = (
    "(?iuU)^(что такое|как (заработать|подключить|пользоваться|выбрать|получить доступ)|когда (растут|падают)|зачем|почему|чем отличается|инвестируйте в|инвестиции в|во что инвестировать"
    "|мы продлили|информация|уведомлени|правила|условия обслуживания|документы|тариф)"
)
# What offers are compared by, percentages first.
HEADLINES = (("cashback", "%"), ("rate", "%"), ("discount", "%"), ("cashback", "rub"), ("money", "rub"), ("discount", "rub"), ("points", "pts"))
VERDICTS = ("red", "yellow", "green", "grey")


def is_offer(title: Column) -> Column:
    """Whether a title offers something: not empty, and not that of an article or notice."""
    head = F.trim(F.coalesce(title, F.lit("")))
    return (head != "") & ~head.rlike(NOT_OFFERS)


def segment(path: Column, title: Column, text: Column, kind: Column) -> Column:
    """Segment by section of the site, then words of the title, then of the text, then the kind of benefit."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda x: x != "")
    listed = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])
    section = F.when(F.get(parts, F.lit(0)) == "personal", F.element_at(listed, F.coalesce(F.get(parts, F.lit(1)), F.lit(""))))
    both = F.concat_ws(" ", title, text)
    by_kind = F.when(kind.isin("cashback", "points", "discount") | both.rlike(BONUS_WORDS), BONUS).otherwise(OTHER)
    return F.coalesce(section, first_match(F.coalesce(title, F.lit("")), TITLE_RULES, None), first_match(both, WORD_RULES, None), by_kind)


def guaranteed(kind: Column) -> Column:
    """Everyone gets it: anything but a prize of a draw."""
    return F.coalesce(kind, F.lit("other")) != "prize"


def best_values(promos: DataFrame, *keys: str) -> DataFrame:
    """Best value for each of the keys, kind and unit; prizes don't count, as they go to one person."""
    return promos.where(guaranteed(F.col("kind")) & F.col("value").isNotNull()).groupBy(*keys, "kind", "unit").agg(F.max("value").alias("best_value"))


def headline(promos: DataFrame, keys: list[str], promo: str) -> DataFrame:
    """The strongest promotion for each of the keys: the best value within the first kind and unit of HEADLINES that is there.

    Without a measured one the first guaranteed one stands for the group, else the first (by promo). Ties go to the lower promo.
    """
    sure = guaranteed(F.col("kind"))
    rank = F.lit(None).cast("int")
    for i, (kind, unit) in reversed(list(enumerate(HEADLINES))):
        rank = F.when((F.col("kind") == kind) & (F.col("unit") == unit), i).otherwise(rank)
    rank = F.when(sure & F.col("value").isNotNull(), rank)
    order = F.struct(F.coalesce(rank, F.when(sure, 100).otherwise(101)), F.when(rank.isNotNull(), -F.col("value")).otherwise(0.0), F.col(promo))
    best = promos.groupBy(*keys).agg(F.min_by(F.struct(promo, "kind", "unit", "value"), order).alias("b"))
    return best.select(*keys, "b.*")


def in_show_order(promos: DataFrame, group: str, promo: str) -> DataFrame:
    """Place of each promotion in its group: guaranteed ones first, then by value, title and promo."""
    order = [F.when(guaranteed(F.col("kind")), 0).otherwise(1), F.desc(F.coalesce("value", F.lit(0.0))), F.col("title"), F.col(promo)]
    return promos.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def in_verdict_order(segments: DataFrame, *group: str) -> DataFrame:
    """Place of each segment in its group: by verdict, then by number of promotions, then by name."""
    order = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict"))
    w = Window.partitionBy(*group).orderBy(F.when(order == 0, len(VERDICTS) + 1).otherwise(order), F.desc("total"), "segment")
    return segments.withColumn("place", F.row_number().over(w))
