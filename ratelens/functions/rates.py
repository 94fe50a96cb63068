"""Rates in lines of a page: which percentages are rates, which are shares, bonuses or full costs, and under what conditions.

All patterns are searched with (?iuU): Cyrillic letters fold case and count as word characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A percentage, one that is relative to another rate, words that make a percentage a share, a fee or a
# bonus (before and after it), words with which a tiny percentage is a rate, and captions of numbers that are no rates.
PERCENT = r"(\d{1,3}(?:[.,]\d{1,3})?)\s*%"
RATE_LINE = r"\d{1,2}(?:[,.]\d{1,2})?\s?%"
RELATIVE = r"ключев\w*\s+ставк|ставк\w*\s+цб|цб\s*[+−-]|мину́?с\s*\d|плюс\s*\d|(?:ниже|выше|снизим|снижени\w*)\s+(?:на|до)\s*\d"
SHARE_WORDS = r"взнос\w*|комисси\w*|к[еэ]шб[еэ]к\w*|cashback|скидк\w*|страхов\w*|ндфл|удержан\w*|дол[яию]\w*|долей|аванс\w*|доходност\w*|эффективн\w*\s+ставк\w*"
SHARE_OF = "стоимост|цен|суммы|рыночн|дохода|платеж|покупк|зарплат|мил[ьи]|бонус|балл|чек|к[еэ]шб[еэ]к|cashback|скидк"
SPENT_ON = r"авиа|отел|тур|ж/?д|ж\.\s?д|билет|повседневн|такси|кафе|рестора|супермаркет|продукт|аптек|азс|топлив|транспорт|категори|сделк|путешеств|развлечен|кино|одежд|связь|подписк|перевод|сняти"
TINY = r"ставк\w*|годовых"
NOT_RATE_CAPTION = (
    r"^(?:(?:первоначальн|перв)\w*\s+)?взнос|^к[еэ]шб[еэ]к|^от\s+(?:рыночн\w*\s+)?(?:стоимост|цен|суммы)|^стоимост|^(?:скидк|комисси|дол[яи]|аванс|снижени|возврат|бонус)\w*"
    r"|снизил|сократил|баллами|бонусами|начислени\w*\s+бонус|бонусов|^доходност|^эффективн|^за\s+покупк\w*\s+у\s+партн|^у\s+партн[её]р|^в\s+выбранн\w*\s+категори|^ставк\w*[^.]{0,30}\b(?:ниже|меньше|выше)\b"
)
# Kinds of rates from what stands near them, strongest first, and from a product's title.
NEAR_RATE = [
    ("welcome", r"в\s+первый\s+(?:месяц|период)[^.]{0,30}(?:ставк|%)|(?:ставк|%)[^.]{0,40}первы[ехй]\s+\d+\s+(?:дн|мес|календ)\w*|первы[ехй]\s+\d+\s+(?:дн|мес|календ)\w*[^.]{0,30}(?:ставк|%)|приветственн\w*|для\s+«?нов\w+»?\s+(?:клиент|вкладчик)\w*|«?нов\w+»?\s+вкладчик\w*|впервые\s+откры\w*|«?новых»?\s+клиентов"),
    ("new_money", r"«?нов\w+»?\s+(?:деньг|денег)\w*|«новые»"),
    ("premium", r"премиальн\w*|привилеги\w*|\bprivate\b|премьер"),
    ("salary", r"зарплатн\w+\s+(?:клиент|карт)\w*|получа\w+\s+зарплат\w*|с\s+зарплатной\s+картой"),
    ("subscription", r"подписк\w*|с\s+услугой\s+«[^»]+»|\d[\d\s]*₽\s+в\s+месяц"),
    ("short_term", r"до\s+31\s+дн\w*|на\s+1\s+месяц\b"),
]
NICHE_TITLE = (
    r"пдс|долгосрочн\w*\s+сбереж|забота\s+о\s+будущем|ставка\s+на\s+будущее|драгоцен|металл|социальн|пенсион|\bсво\b|ветеран|участник|kids|детск|акционер|инвестиц|двойная\s+выгода|в\s+юан|валют"
    r"|рупи|дирхам|доллар|евро|юан|тенге|лир[аы]\b|для\s+получателей|почте\s+россии|оплата\s+частями|рассрочк|сплит|за\s+покупку|газификац|деньги\s+до\s+пенсии|автокредит\w*\s+с\s+господдерж|от\s+производител"
)
PREMIUM_TITLE = r"премиум|премиальн|премьер|\bprime\b|\bpremium\b|прайм|private|привилеги"


def has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iuU){pattern}")


def number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def line_rates(line: Column) -> Column:
    """The rates that a line names, in order; NULL if it names none.

    Shares are taken out with their percentage before rates are read: first those that say of what after the number,
    then those that a word before it marks.
    """
    share_after = rf"(?iuU)\d{{1,3}}(?:[,.]\d{{1,2}})?\s?%\s*(?:(?:от|из)\s+)?(?:[а-яё]+(?:ой|ая|ую|ого|ей)\s+)?(?:{SHARE_OF}|за\s+(?:{SPENT_ON}))\w*"
    share_before = rf"(?iuU)(?:первоначальн\w*\s+)?(?:{SHARE_WORDS})[^%]{{0,40}}?\d{{1,3}}(?:[,.]\d{{1,2}})?\s?%"
    left = F.regexp_replace(F.regexp_replace(line, share_after, " "), share_before, " ")
    floor = F.when(has(left, TINY), 0.01).otherwise(0.1)
    values = F.filter(F.transform(F.regexp_extract_all(left, F.lit(PERCENT), F.lit(1)), number), lambda v: (v >= floor) & (v <= 100))
    named = line.rlike(RATE_LINE) & ~has(line, RELATIVE) & left.rlike(RATE_LINE)
    return F.when(named & (F.size(values) > 0), values)


def excluded_by(caption: Column) -> Column:
    """The caption of a number says that it is no rate."""
    return F.coalesce(has(F.trim(caption), NOT_RATE_CAPTION), F.lit(False))


def kinds_near(text: Column) -> Column:
    """Kinds of rates that a text names, strongest first."""
    return F.array_compact(F.array(*[F.when(has(text, pattern), kind) for kind, pattern in NEAR_RATE]))


def rate_kind(title: Column, kinds: Column, closed: Column) -> Column:
    """base, or why the rate can't be compared: a product no longer offered or niche, premium, else the strongest kind near the rate."""
    named = F.when(F.coalesce(closed, F.lit("")) != "", "niche").when(has(title, NICHE_TITLE), "niche").when(has(title, PREMIUM_TITLE), "premium")
    for kind, _ in NEAR_RATE:
        named = named.when(F.array_contains(kinds, kind), kind)
    return named.otherwise("base")


def same_kind(kind: Column) -> Column:
    """Kinds that count as one when analogues are looked for: new money is a welcome rate."""
    return F.when(kind == "new_money", "welcome").otherwise(kind)
