"""Text, number, money, term, url and promotion expressions.

Patterns that touch letters use (?U) and (?iu), so Cyrillic counts as letters and folds case.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Transliteration of names, letter by letter.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
# Legal forms that don't belong to an organisation's name.
LEGAL_FORMS = r"(?iu)(?<![\p{L}\d])(ооо|оао|зао|пао|ао|гуп|муп|гбу|гбуз|фгуп|фгбу|нко|ип)(?![\p{L}\d])"
# Stems of month names in dates.
MONTHS = {"январ": 1, "феврал": 2, "март": 3, "апрел": 4, "ма": 5, "июн": 6, "июл": 7, "август": 8, "сентябр": 9, "октябр": 10, "ноябр": 11, "декабр": 12}
# Words before a date that make it the end of an offer, words that make it a condition, and words of an ended offer.
EXPIRY_WORDS = "акци предложени действу действительн срок продлен продлится успейте оформите откройте подключите активируйте станьте получите соверши купите переведите".split()
QUALIFIERS = "полученн оформленн выпущенн открыт заключённ заключенн совершённ совершенн выданн зарегистрированн".split()
FINISHED = r"(?iu)акция\s+(завершена|окончена|завершилась)|предложение\s+(завершено|окончено)"
NUMBER = r"\d+(?:[   ]\d{3})*(?:[.,]\d+)?"
# Names of characters.
ENTITIES = {
    "nbsp": "\u00a0", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&", "laquo": "«", "raquo": "»", "ldquo": "“", "rdquo": "”", "bdquo": "„", "lsquo": "‘", "rsquo": "’",
    "mdash": "—", "ndash": "–", "minus": "−", "hellip": "…", "bull": "•", "middot": "·", "times": "×", "deg": "°", "plusmn": "±", "sect": "§", "copy": "©", "reg": "®", "trade": "™",
    "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "frac12": "½", "frac14": "¼", "sup2": "²", "shy": "\u00ad", "ensp": "\u2002", "emsp": "\u2003", "thinsp": "\u2009",
}
#: Query parameters that only track a visit.
TRACKING = r"utm_[^=&#]*=[^&#]*"


def normalised(text: Column) -> Column:
    """For duplicate checks: lower case, ё as е, no urls, handles or tags, punctuation to blanks, blanks squeezed."""
    low = F.translate(F.lower(text), "ё", "е")
    bare = F.regexp_replace(F.regexp_replace(low, r"https?://\S+|www\.\S+", " "), r"(?U)[@#]\w+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def organisation_name(text: Column) -> Column:
    """Name without quotes and legal form, squeezed and lower-cased."""
    plain = F.regexp_replace(F.lower(text), "[«»\"'“”„,.]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, LEGAL_FORMS, " "), r"\s+", " "))


def plain_name(text: Column) -> Column:
    """A product's name for comparison: lower case, ё as е, punctuation to blanks, blanks squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(text), "ё", "е"), "[«»\"'.,:;!?()]+", " "), r"\s+", " "))


def slug(text: Column, size: int = 40) -> Column:
    """Latin slug: Cyrillic transliterated, other characters to single hyphens, none at either end of the cut."""
    low = F.lower(text)
    single = {a: b for a, b in CYRILLIC.items() if len(b) <= 1}
    for a, b in CYRILLIC.items():
        if a not in single:
            low = F.replace(low, F.lit(a), F.lit(b))
    kept = [a for a, b in single.items() if b]
    low = F.translate(low, "".join(kept + [a for a, b in single.items() if not b]), "".join(single[a] for a in kept))
    hyphen = F.lit("-")
    return F.trim(F.left(F.trim(F.regexp_replace(low, "[^a-z0-9]+", "-"), hyphen), F.lit(size)), hyphen)


def numbers(text: Column) -> Column:
    """Distinct numbers in a text in order, "1 500,5" as 1500.5 (as text)."""
    found = F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, "[   ]", ""), ",", ".")))


def percents(text: Column) -> Column:
    """All "12,5 %" of a text as doubles."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:[.,]\d+)?)\s*%"), F.lit(1)), lambda x: F.try_to_number(F.regexp_replace(x, ",", "."), F.lit("999999.999999")).cast("double"))


def number_on_page(text: Column, value: Column) -> Column:
    """Whether a page shows a number, in either decimal notation and not as part of a longer one; whole ones need a %."""
    whole = value == F.floor(value)
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", value.cast("double")), r"0+$", ""), r"\.$", "")
    pattern = F.concat(F.lit(r"(?<![\d.,])"), F.regexp_replace(plain, r"\.", "[.,]"), F.when(whole, r"(?:[.,]0+)?\s*%").otherwise(r"0*(?![\d]|[.,]\d)"))
    return F.regexp_like(text, pattern)


def money_range(text: Column) -> Column:
    """struct<min, max, currency> from "from A to B", thousands and millions in words, signs or codes; NULL sides are open."""
    low = F.translate(F.lower(text), "  ", "  ")

    def side(word: str) -> Column:
        number = F.regexp_extract(low, rf"(?:^|[^\p{{L}}])(?:{word})\s*(\d+(?: \d{{3}})*(?:[.,]\d+)?)", 1)
        unit = F.regexp_extract(low, rf"(?:^|[^\p{{L}}])(?:{word})\s*\d+(?: \d{{3}})*(?:[.,]\d+)?\s*(тыс|млн|млрд|thousand|million|billion)?", 1)
        return scaled(number, unit)

    currency = F.when(low.rlike(r"₽|руб|rub"), "RUB").when(low.rlike(r"\$|usd|долл"), "USD").when(low.rlike(r"€|eur|евро"), "EUR").when(low.rlike(r"¥|cny|юан"), "CNY")
    return F.struct(side("от|from").alias("min"), side("до|to").alias("max"), currency.alias("currency"))


def scaled(number: Column, unit: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(number, " ", ""), ",", ".").try_cast("decimal(18,2)")
    factor = F.when(unit.isin("тыс", "thousand"), 1_000).when(unit.isin("млн", "million"), 1_000_000).when(unit.isin("млрд", "billion"), 1_000_000_000).otherwise(1)
    return (base * factor).cast("decimal(24,2)")


def term_days(text: Column) -> Column:
    """struct<min_days, max_days, values>: a range "from A to B unit" or the set of listed terms; one bound alone is unknown."""
    low = F.lower(text)
    unit = r"(дн|день|дня|сут|day|мес|month|год|года|лет|year)"

    def days(number: Column, word: Column) -> Column:
        n = number.try_cast("int")
        months = F.round(n.cast("decimal(9,0)") * 365 / 12, 0).cast("int")
        return F.when(word.rlike("^(мес|month)"), months).when(word.rlike("^(год|лет|year)"), n * 365).otherwise(n)

    pair = rf"(?:от|from)?\s*(\d+)\s*{unit}?\p{{L}}*\.?\s*(?:до|to|-|–|—)\s*(\d+)\s*{unit}"
    first, first_unit, second, second_unit = (F.regexp_extract(low, pair, i) for i in (1, 2, 3, 4))
    is_range = second != ""
    low_days = days(first, F.when(first_unit == "", second_unit).otherwise(first_unit))
    single_bound = low.rlike(r"(?:^|[^\p{L}])(от|до|from|to)\s*\d") & ~is_range
    listed = F.regexp_extract_all(low, F.lit(rf"(\d+)\s*{unit}?"), F.lit(0))
    last_unit = F.element_at(F.filter(F.transform(listed, lambda x: F.regexp_extract(x, unit, 1)), lambda u: u != ""), -1)
    has_unit = F.size(F.filter(listed, lambda x: F.regexp_extract(x, unit, 1) != "")) > 0
    values = F.transform(listed, lambda x: days(F.regexp_extract(x, r"\d+", 0), F.when(F.regexp_extract(x, unit, 1) != "", F.regexp_extract(x, unit, 1)).otherwise(last_unit)))
    known = ~single_bound & ~is_range & has_unit
    return F.struct(F.when(is_range, low_days).alias("min_days"), F.when(is_range, days(second, second_unit)).alias("max_days"), F.when(known, F.array_sort(F.array_distinct(F.when(known, values)))).alias("values"))


def rate_range(text: Column) -> Column:
    """struct<low, high> of "от 16% до 20%", "до 16%", "от 5%", "28,0%"; NULL without a % or with more than two numbers."""
    low = F.lower(F.translate(text, "\u00a0", " "))
    found = F.transform(F.regexp_extract_all(low, F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))
    one, size = F.get(found, F.lit(0)), F.size(found)
    bounds = F.struct(F.when((size == 2) | ~F.startswith(low, F.lit("до")), F.array_min(found)).alias("low"), F.when((size == 2) | ~F.startswith(low, F.lit("от")), F.when(size == 2, F.array_max(found)).otherwise(one)).alias("high"))
    return F.when(F.contains(low, F.lit("%")) & size.between(1, 2), bounds)


def _with_units(text: Column, unit: str) -> Column:
    """array<struct<value, unit, own>>: numbers of a text with their unit; one without takes that of the next number that has one."""
    pattern = F.lit(r"(\d+(?:[ \u00a0]\d{3})*(?:[.,]\d+)?)(\D*)")
    low = F.lower(text)
    values = F.transform(F.regexp_extract_all(low, pattern, F.lit(1)), lambda x: F.replace(F.regexp_replace(x, r"[ \u00a0]", ""), F.lit(","), F.lit(".")).cast("double"))
    units = F.transform(F.regexp_extract_all(low, pattern, F.lit(2)), lambda x: F.regexp_extract(x, unit, 1))

    def read(value: Column, i: Column) -> Column:
        later = F.filter(F.slice(units, i + 1, F.size(units)), lambda u: u != "")
        return F.struct(value.alias("value"), F.coalesce(F.get(later, F.lit(0)), F.lit("")).alias("unit"), (F.get(units, i) != "").alias("own"))

    return F.transform(values, read)


def money_list(text: Column) -> Column:
    """Sums of roubles in a text with a currency; a multiplier is inherited by numbers under 1000 only, results under 1000 are no sums."""
    factor = {"млрд": 1e9, "млн": 1e6, "тыс": 1e3}

    def amount(x: Column) -> Column:
        by = F.lit(1.0)
        for unit, times in factor.items():
            by = F.when(x["unit"] == unit, times).otherwise(by)
        return x["value"] * F.when(x["own"] | (x["value"] < 1000), by).otherwise(1.0)

    found = F.filter(F.transform(_with_units(text, "(млрд|млн|тыс)"), amount), lambda v: v >= 1000)
    return F.when(F.lower(text).rlike("₽|руб"), found).otherwise(F.array().cast("array<double>"))


def term_months(text: Column) -> Column:
    """Terms of a text in whole months: years by 12, days by 30 (half to even, one at least); numbers without a unit are no terms."""

    def months(x: Column) -> Column:
        days = F.greatest(F.lit(1), F.bround(x["value"] / 30).cast("int"))
        return F.when(x["unit"].isin("лет", "год"), (x["value"] * 12).cast("int")).when(x["unit"] == "мес", x["value"].cast("int")).when(x["unit"] == "дн", days)

    return F.array_compact(F.transform(_with_units(text, "(лет|год|мес|дн)"), months))


def content_title(title: Column, organisations: Column) -> Column:
    """A normalised title without the words of its organisations' names; empty if fewer than two words of four letters are left."""
    names = F.flatten(F.transform(F.coalesce(organisations, F.array().cast("array<string>")), lambda o: F.split(organisation_name(o), " ")))
    kept = F.filter(F.split(normalised(title), " "), lambda w: ~F.array_contains(names, w))
    long_words = F.size(F.filter(kept, lambda w: F.length(w) >= 4))
    return F.when(long_words >= 2, F.array_join(kept, " ")).otherwise("")


def _first_amount(low: Column, pattern: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(low, pattern, 1), r"[\s\u00a0]", ""), ",", ".").try_cast("double")


def benefit(text: Column) -> Column:
    """struct<type, value, unit> of a promotion.

    In fixed precedence: rate, cashback, points, prize, discount, free, money, other. Cashback and discounts are in percent
    if the text has a percentage, else in roubles.
    """
    low = F.lower(text)
    percent = _first_amount(low, r"(\d{1,3}(?:[.,]\d{1,2})?)\s*%")
    rub = _first_amount(low, r"(\d[\d\s\u00a0]{0,30}+)(?:₽|руб)")
    points = _first_amount(low, r"(\d[\d\s\u00a0]{0,30}+)(?:[а-яё]{1,30}+\s{1,5}+){0,2}балл")
    either = F.coalesce(percent, rub)
    cases = [
        ("rate", low.rlike("ставк"), percent, "%"),
        ("cashback", low.rlike("кешб[эе]к|кэшб[эе]к|верн[её]м|возврат"), either, None),
        ("points", low.rlike("балл"), points, "pts"),
        ("prize", low.rlike("розыгрыш|выиграй|приз|лотере"), rub, "rub"),
        ("discount", low.rlike("скидк"), either, None),
        ("free", low.rlike(r"бесплатн|без комиссии|0\s*₽"), F.lit(None).cast("double"), ""),
        ("money", rub.isNotNull(), rub, "rub"),
    ]
    found = F.struct(F.lit("other").alias("type"), percent.alias("value"), F.when(percent.isNotNull(), "%").otherwise("").alias("unit"))
    for kind, test, value, unit in reversed(cases):
        unit = F.when(percent.isNotNull(), "%").otherwise("rub") if unit is None else F.lit(unit)
        found = F.when(test, F.struct(F.lit(kind).alias("type"), value.alias("value"), unit.alias("unit"))).otherwise(found)
    return found


def promo_until(text: Column) -> Column:
    """struct<day, dated> of the end of an offer: the first valid date that an expiry word precedes within 60 characters.

    Numeric dates come before written ones. A date right after a participle ("cards issued before ...") is a condition and not an
    end. dated is false where the year is not given; day is then null.
    """
    low = F.lower(text)
    near = "|".join(f"{w}.{{0,{60 - len(w)}}}" for w in EXPIRY_WORDS)
    after = rf"(?us)(?<=(?:{near}))(?<!(?:{'|'.join(QUALIFIERS)})[а-яё]{{0,12}}\s{{0,4}})"
    numeric = F.transform(F.regexp_extract_all(low, F.lit(after + r"(?:по|до)\s+(\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4})"), F.lit(1)), lambda d: F.regexp_replace(d, r"[\-/]", "."))
    whole = F.transform(numeric, lambda d: F.regexp_replace(d, r"\.(\d\d)$", ".20$1"))
    days = F.filter(F.transform(whole, lambda d: F.try_to_date(d, "d.M.yyyy")), lambda d: d.isNotNull())
    written = F.regexp_extract_all(low, F.lit(after + r"(?:по|до|включительно по)\s+(\d{1,2}\s+[а-я]+\s*(?:\d{4})?)"), F.lit(1))

    def read(d: Column) -> Column:
        word, month = F.regexp_extract(d, r"\d+\s+([а-я]+)", 1), F.lit(None).cast("int")
        for stem, number in reversed(MONTHS.items()):
            month = F.when(F.startswith(word, F.lit(stem)), number).otherwise(month)
        year = F.regexp_extract(d, r"(\d{4})$", 1)
        day = F.regexp_extract(d, r"^(\d+)", 1)
        valid = F.try_to_date(F.concat(day, F.lit("."), month.cast("string"), F.lit("."), F.when(year == "", F.lit("2000")).otherwise(year)), "d.M.yyyy")
        return F.struct(F.when(year != "", valid).alias("day"), (year != "").alias("dated"), valid.isNotNull().alias("valid"))

    first = F.get(F.filter(F.transform(written, read), lambda r: r["valid"]), F.lit(0))
    return F.when(F.size(days) > 0, F.struct(F.get(days, F.lit(0)).alias("day"), F.lit(True).alias("dated"))).otherwise(F.struct(first["day"].alias("day"), F.coalesce(first["dated"], F.lit(False)).alias("dated")))


def promo_status(text: Column, today: Column) -> Column:
    """expired, active or undated; an offer that says it has ended is expired, a date without a year can't expire."""
    until = promo_until(text)["day"]
    return F.when(text.rlike(FINISHED), "expired").when(until.isNull(), "undated").when(until < today, "expired").otherwise("active")


def tax_id_valid(digits: Column) -> Column:
    """Checksums of 10- and 12-digit tax numbers."""
    d = F.transform(F.split(digits, ""), lambda x: x.try_cast("int"))

    def check(weights: list[int]) -> Column:
        total = F.aggregate(F.zip_with(F.slice(d, 1, len(weights)), F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0), lambda s, x: s + x)
        return total % 11 % 10

    ten = check([2, 4, 10, 3, 5, 9, 4, 6, 8]) == F.get(d, F.lit(9))
    eleventh = check([7, 2, 4, 10, 3, 5, 9, 4, 6, 8]) == F.get(d, F.lit(10))
    twelfth = check([3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]) == F.get(d, F.lit(11))
    return F.when(digits.rlike("^[0-9]{10}$"), ten).when(digits.rlike("^[0-9]{12}$"), eleventh & twelfth).otherwise(False)


def without_tracking(url: Column) -> Column:
    """The url without utm_* parameters and dangling separators."""
    cut = F.regexp_replace(F.regexp_replace(url, rf"([?&]){TRACKING}", "$1"), r"&{2,}", "&")
    return F.regexp_replace(F.regexp_replace(cut, r"\?&", "?"), r"[?&]+(#|$)", "$1")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#:]*)", 1))


def is_official(host: Column, official: list[str]) -> Column:
    """host is one of the official hosts or a subdomain of one."""
    test = F.lit(False)
    for h in official:
        test = test | (host == h) | host.endswith("." + h)
    return test


def html_to_text(html: Column) -> Column:
    """Visible text: scripts, styles and comments away, table cells and blocks apart, entities resolved, blanks squeezed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    rows = F.regexp_replace(F.regexp_replace(bare, r"(?i)</t[dh]>\s*<t[dh][^>]*>", " | "), r"(?i)<(br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>", "\n")
    text = F.regexp_replace(rows, r"<[^<>]*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(entities_resolved(text), r"[ \t\r\u00a0]+", " "), r" ?\n[\n ]*", "\n"), F.lit(" \n"))


def entities_resolved(text: Column) -> Column:
    """Character references of a text replaced: the usual names, decimal and hexadecimal numbers; unknown ones stay. Once, so "&amp;lt;" gives "&lt;"."""
    known = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def character(code: Column) -> Column:
        """UTF-8 of a code point; surrogates, 0 and what is beyond Unicode have none."""
        two = code.between(0x80, 0x7FF)
        three = code.between(0x800, 0xFFFF)
        tail = [F.lpad(F.hex(F.lit(0x80) + F.shiftright(code, 6 * i).bitwiseAND(F.lit(0x3F))), 2, "0") for i in range(3)]
        lead = F.when(two, F.hex(F.lit(0xC0) + F.shiftright(code, 6))).when(three, F.hex(F.lit(0xE0) + F.shiftright(code, 12))).otherwise(F.hex(F.lit(0xF0) + F.shiftright(code, 18)))
        spelled = F.when(code < 0x80, F.lpad(F.hex(code), 2, "0")).when(two, F.concat(lead, tail[0])).when(three, F.concat(lead, tail[1], tail[0])).otherwise(F.concat(lead, tail[2], tail[1], tail[0]))
        return F.when((code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(spelled), "UTF-8"))

    def resolved(piece: Column, i: Column) -> Column:
        name = F.regexp_extract(piece, r"^(#?\w{1,8});", 1)
        digits = F.when(name.rlike("^#[0-9]{1,7}$"), F.substr(name, F.lit(2)).cast("int")).when(name.rlike("^#[xX][0-9A-Fa-f]{1,6}$"), F.conv(F.substr(name, F.lit(3)), 16, 10).cast("int"))
        value = F.coalesce(F.try_element_at(known, name), character(digits))
        return F.when((i == 0) | value.isNull(), F.concat(F.when(i == 0, "").otherwise("&"), piece)).otherwise(F.concat(value, F.substr(piece, F.length(name) + 2)))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "&"), resolved), "")).otherwise(text)


def is_blocked_page(status: Column, body: Column) -> Column:
    """A refusal or a captcha instead of a page."""
    return status.isin(403, 429) | ((F.length(body) < 20_000) & F.lower(body).rlike("captcha|access denied|are you a robot|проверка браузера|доступ ограничен"))


def formula_safe(cell: Column) -> Column:
    """Spreadsheet cells that start like a formula become text."""
    return F.when(cell.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def person_in_text(name: Column, text: Column) -> Column:
    """Every word of a name occurs by its stem (the first max(3, n - 2) letters)."""
    words = F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != "")
    return F.forall(words, lambda w: F.contains(F.lower(text), F.left(w, F.greatest(F.lit(3), F.length(w) - 2))))


def folded(text: Column) -> Column:
    """For quotes: NFKC, quotation marks and dashes made plain, blanks squeezed, case folded. Each different text of a batch is folded once."""

    def fold(value: str) -> str:
        plain = unicodedata.normalize("NFKC", value).translate({ord("«"): '"', ord("»"): '"', ord("—"): "-", ord("–"): "-"})
        return " ".join(plain.split()).casefold()

    @F.pandas_udf("string")
    def of(values: pd.Series) -> pd.Series:
        codes, different = pd.factorize(values)
        done = pd.Series([fold(v) for v in different] + [None], dtype="object")
        return done.iloc[codes].reset_index(drop=True)  # null has code -1

    return of(text)


def quote_holds(quote: Column, source: Column, value: Column) -> Column:
    """A quote of 8 to 400 characters that is in the source and holds every number of the value."""
    return F.length(quote).between(8, 400) & F.contains(normalised(source), normalised(quote)) & (F.size(F.array_except(numbers(value), numbers(quote))) == 0)
