"""A product page to its product: title, the lines that describe it, its base rate, amounts, terms and clauses.

A page is a row, its lines are an array, and every rule is an expression over the array: a line is judged by itself and by
its neighbours, positions are found by the first line that a rule holds for. Nothing is shuffled and no line leaves its
row, so the work follows the text. Only the description is judged closely, which is at most SPAN lines of however long a page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.functions import rates, text
from ratelens.functions.rates import has, line_rates
from ratelens.operators.availability import denial_clause

#: Lines of a description, and of the block under a heading of rates.
SPAN, BLOCK = 150, 80

# Titles that aren't products (listings, services, calls), categories by title, and by how they are judged.
GENERIC_TITLE = r"^(все\s+)?(вклады( и сч[её]та)?|сч[её]та|кредиты|ипотек[аи]|карты|кредитные карты|дебетовые карты|банковские карты|накопительные сч[её]та|сбережения|частным клиентам)$"
NOT_A_PRODUCT = (
    r"^(?:платите|управляйте|создайте|привез[её]м|покупайте|открыть|откройте|оформите|узнайте|получите|переведите|подключите)\b|каникул|программ\w*\s+поддержк|^[\w.-]+\.(?:ru|рф|com)$|^404|страница не найдена"
    r"|способы\s+пополнения|страхование\s+вкладов|^выпуск\s+карты|соотношение|^вклады\s+и\s+[сc]ч[её]та|^кредиты\s+наличными$|^кредитный\s+лимит|^вкладывайте|^(?:банковские|дебетовые|кредитные)\s+карты\b"
    r"|^(?:вклады|накопительные\s+сч[её]та|сберегательные\s+вклады)\b|^курс\s|монет\w*\s+из\s+драгоцен|металлическ\w*\s+сч[её]т|^услуги\s+по\s+размещению"
)
CATEGORY_BY_TITLE = [
    ("Накопительные счета", r"накопительн\w*\s+(?:\w+-)?сч[её]т"),
    ("Накопительные счета", r"сберегательн\w*\s+сч[её]т|до\s+востребования"),
    ("Кредитные карты", r"кредитн\w*\s+\w*карт"),
    ("Дебетовые карты", r"дебетов\w*\s+\w*карт"),
    ("Ипотека", r"ипотек"),
    ("Вклады", r"\bвклад\b"),
]
CREDIT = ("Кредиты", "Ипотека", "Кредитные карты")
DEBIT = ("Дебетовые карты", "Банковские карты", "Пенсионные карты")
WITH_RATE = ("Вклады", "Накопительные счета", *CREDIT)
CEILING = {"Ипотека": 40.0, "Кредиты": 50.0}
# Calls before a name, what follows a name, and a rate in it.
CALL = r"^(?:оформите|откройте|оформить|открыть)\s+(.+)$"
NAME_TAIL = r"\s+(?:со\s+ставкой|с\s+кэшбэком|получайте|онлайн\b|до\s+\d|в\s+(?:сбер\w*|втб|т-банке|банке)\b).*$"
RATE_IN_NAME = r"(?:\s+доходност\w*|\s+со\s+ставк\w*|(?<!ой)(?<!ей)\s+ставк\w*)?\s+(?:до|от|со\s+ставкой)\s+\d[\d,.]*\s?%.*$"
# Lines that end a description, tabs of a menu, headings of a block of rates and what ends it.
STOP_LINE = r"^(другие|ещё|еще|похожие|рекомендуем|вам (может|также)|полезн|вопросы и ответы|часто задаваемые|остались вопросы|все вопросы|документы|оцените|какой (вклад|кредит|карт)|смотрите также)"
TAB = r"^(открыть( вклад| сч[её]т)? онлайн|оформить( онлайн| карту)?|рассчитать|подробные условия|где (открыть|оформить|получить)|как (оформить|вносить|открыть|получить)|начисление процентов|проверить специальность|изменить условия|подать заявку|спросить гигачат|условия|требования)$"
RATES_HEADING = r"^(?:ставки по (?:кредиту|ипотеке|вкладу)|ставки рефинансирования|ставки и условия|условия и ставки|процентные ставки|подробные условия|условия кредит\w*)$"
SECTION_END = r"^(?:требования к заё?е?мщик|документы|документы и ссылки|вопросы и ответы|юридическая информация|оцените)"
# The full cost of a credit, captions and forms of a rate, other products' rates, bonuses, and percentages of cards.
FULL_COST = r"\bпск\b|полн\w*\s+стоимост"
COST_THEN_RATE = r"(?iuU)[,.;]\s+(?=(?:процентн\w+\s+)?ставк\w*\s*[—–:-]?\s*(?:от\s+|до\s+)?\d)"
OWN_RATE = r"\bставк\w*\b[^%]*\d"
FROM_RATE = r"^\s*(?:ставка\s+)?от\s+\d"
RATE_CAPTION = r"^\s*(?:процентная\s+|базовая\s+)?ставка\s*[:*\d]*\s*$"
RANGE = r"(?iuU)(\d{1,3}(?:[,.]\d{1,3})?)\s*(?:[–—-]|до)\s*(\d{1,3}(?:[,.]\d{1,3})?)\s*%"
RATE_WORD = r"годов|ставк|\bпск\b|полн\w*\s+стоимост|процентн"
OTHER_PRODUCT = r"накопительн\w*\s+сч[её]т|по\s+вклад|ставк\w*\s+по\s+вклад|на\s+остат"
BONUS = r"^\s*(?:до\s*)?\+\s?\d"
ON_BALANCE = r"на\s+остат|остаток|на\s+(?:сво[йи]|минимальн\w*)\s+остат|доход\w*\s+на\s+(?:остат|деньги)|процент\w*\s+на\s+(?:остат|сумм)"
CASHBACK = r"кешб|кэшб|cashback|бонус|балл|скидк|милл|мил[еь]"
# A footnote's rate without a paid service, an estimate by a calculator, a subsidised cost, an ended offer, pages that are errors.
WITHOUT_SERVICE = r"(?iuU)\bбез\s+(?:услуги\s+|подписки\s+)?(?:«[^»]{2,40}»|[А-ЯЁ]{2,4}\b|подписки|услуги)[^.]{0,80}?\bставк\w*\s+(?:от\s+)?(\d{1,2}(?:[,.]\d{1,3})?)\s?%(?:\s*[-–—]\s*(\d{1,2}(?:[,.]\d{1,3})?)\s?%)?"
ESTIMATE = r"расч[её]т\s+произвед"
SUBSIDISED = r"субсидир\w*[^.]{0,60}?учитыва"
_NO_LONGER = (
    r"(?:(?:больше|уже|сейчас|временно)\s+не\s+(?:выпуска|оформля|открыва|выда|принима)\w*|прекращ\w+\s+(?:выпуск|оформлени|при[её]м|открыти)\w*|при[её]м\s+заявок\s+(?:завершен|прекращ|приостановл)\w*"
    r"|не\s+доступ\w+\s+для\s+(?:оформления|открытия)|(?:больше|уже|сейчас)\s+нельзя\s+(?:приобрести|оформить|открыть|купить|подключить))"
)
CLOSED = rf"(?iuU)[^.\n]{{0,60}}{_NO_LONGER}[^.\n]{{0,60}}"
NOT_FOUND = r"такой страницы нет|такой страницы не существует|страница не найдена|page not found"
SERVER_ERROR = r"^\s*(?:404|50[0-4])\b|bad gateway|service unavailable"
BLOCKED = r"возникла проблема при открытии сайта|support id"
# Parts of a line that are sums or terms, and labels before them.
LABEL = r"(?iuU)^(сумма|срок|лимит|размер)(\s+(кредита|вклада|займа|лимита))?\s*:?\s*"
AMOUNT_PART = r"^(от|до)?\s*\d[\d\s]*(?:[,.]\d+)?\s*(?:(?:тыс\.?|млн)\s*(?:₽|руб\.?)?\s*)?(?:до\s*\d[\d\s]*(?:[,.]\d+)?\s*)?(₽|руб|млн|млрд|тыс)"
TERM_PART = r"^(от|до|на)?\s*\d+\s*(?:(?:года?|лет|мес\w*)\s*)?(?:до\s*\d+\s*)?(лет|года|год|мес|дн|день|дня)"
# Signs of an address.
ADDRESS = r"\bул\.|улиц|просп|пр-т|пл\.|площад|кв-л|квартал|\bд\.\s?\d|\d{2,}[,\s]|часы\s+работы|режим\s+работы"


def stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def squeezed(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " "))


def page_lines(page: Column) -> Column:
    """The lines of a text that aren't blank."""
    return F.filter(F.transform(F.split(F.coalesce(page, F.lit("")), "\n"), stripped), lambda line: line != "")


def title_key(title: Column) -> Column:
    """For comparing titles: lower case, ё as е, without quotes and plus signs."""
    return squeezed(F.regexp_replace(F.translate(F.lower(title), "ё", "е"), "[«»\"'„“”+]", " "))


def clean_title(title: Column) -> Column:
    """One line, up to the first separator of a tail such as a site's name."""
    out = squeezed(title)
    for separator in (" | ", " — ", " - "):
        out = F.substring_index(out, separator, 1)
    return F.trim(out)


def product_name(title: Column) -> Column:
    """The product in a promotional headline: without the call to open it, without a rate."""
    called = F.regexp_extract(title, f"(?iuU){CALL}", 1)
    bare = F.trim(F.regexp_replace(called, f"(?iuU){NAME_TAIL}", ""), F.lit(" —-,"))
    named = F.concat(F.upper(F.left(bare, F.lit(1))), F.substr(bare, F.lit(2)))
    plain = F.trim(F.regexp_replace(title, f"(?iuU){RATE_IN_NAME}", ""))
    return F.when((called != "") & (bare != ""), named).when(called != "", title).when(plain != "", plain).otherwise(title)


def is_product_title(title: Column) -> Column:
    """Not empty, generic, a listing, a service or a call, and not all in capitals (of more than four letters)."""
    letters = F.regexp_replace(F.coalesce(title, F.lit("")), r"[^\p{L}]", "")
    shouting = (F.length(letters) > 4) & (F.upper(letters) == letters) & (F.lower(letters) != letters)
    return F.coalesce((title != "") & ~has(title, GENERIC_TITLE) & ~has(title, NOT_A_PRODUCT) & ~shouting, F.lit(False))


def category_of(title: Column, category: Column) -> Column:
    """The category that a title names beats the page's."""
    out = F.when(F.lit(False), category)
    for name, pattern in CATEGORY_BY_TITLE:
        out = out.when(has(title, pattern), name)
    return out.otherwise(category)


def is_error_page(h1: Column, title: Column, page: Column) -> Column:
    """A server's error or a notice that a page doesn't exist, or the stub of a site's protection."""
    heads = [F.coalesce(c, F.lit("")) for c in (h1, title)]
    shown = F.coalesce(page, F.lit(""))
    bad = has(F.left(shown, F.lit(3000)), NOT_FOUND) | has(F.left(shown, F.lit(2000)), BLOCKED)
    for head in heads:
        bad = bad | has(head, SERVER_ERROR) | has(head, NOT_FOUND)
    return bad


def presence_quote(page: Column, city: str, size: int = 200) -> Column:
    """The first line that names the city and looks like an address or hours; "" if none: a name in a list of cities is no office."""
    # Only lines with the city: what may stand before it is tried from each character of a text.
    named = F.filter(F.split(F.coalesce(page, F.lit("")), "\n"), lambda line: line.rlike(rf"(?iuU)\b{city}"))
    near = F.flatten(F.transform(named, lambda line: F.regexp_extract_all(line, F.lit(rf"(?iuU)([^\n]{{0,80}}\b{city}\w*[^\n]{{0,120}})"), F.lit(1))))
    return F.left(F.coalesce(F.get(F.filter(F.transform(near, squeezed), lambda q: has(q, ADDRESS)), F.lit(0)), F.lit("")), F.lit(size))


def closing_clause(said: Column) -> Column:
    """What says that a product is no longer offered, "" if nothing; its words are looked for first, then what stands around them."""
    return F.when(said.rlike(f"(?iuU){_NO_LONGER}"), F.regexp_extract(said, CLOSED, 0)).otherwise("")


def first_at(items: Column, test: Callable[[Column, Column], Column]) -> Column:
    """1-based position of the first item that a test (of item and 0-based position) holds for; 0 if none."""
    return F.array_position(F.transform(items, lambda x, i: F.coalesce(test(x, i), F.lit(False))), True).cast("int")


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns by a generator of one row, so that filters and projections above use them and don't copy their expressions."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def titled(pages: DataFrame) -> DataFrame:
    """Adds headline and name; pages: h1, title."""
    rows = once(pages, headline=F.coalesce(F.nullif(clean_title(F.col("h1")), F.lit("")), clean_title(F.col("title"))))
    return once(rows, name=product_name(F.col("headline")))


def described(pages: DataFrame) -> DataFrame:
    """Adds lines and body: the lines between the title and the first line about something else.

    pages: h1, text, headline, name. The description starts after the line that is the title; without an h1, after a line of two words or
    more that the title starts with; else at a line that starts with the product's name. No such line: no description.
    """
    rows = pages.withColumn("lines", page_lines(F.col("text")))
    rows = rows.withColumn("heads", F.when(squeezed(F.col("h1")) != "", page_lines(F.col("h1"))).otherwise(F.array("headline")))
    rows = rows.withColumn("__key", title_key(F.get("heads", F.lit(0)))).withColumn("__name", title_key(F.col("name"))).withColumn("__keys", F.transform("lines", title_key))
    exact = F.array_position("__keys", F.col("__key")).cast("int")
    prefix = first_at(F.col("__keys"), lambda k, i: F.contains(k, F.lit(" ")) & F.startswith(F.col("__key"), k))
    named = first_at(F.col("__keys"), lambda k, i: F.startswith(k, F.col("__name")) & (F.length(k) <= F.length("__name") + 40))
    rows = rows.withColumn("__exact", exact)
    rows = rows.withColumn("__prefix", F.when((F.col("__exact") == 0) & (squeezed(F.col("h1")) == ""), prefix).otherwise(0))
    rows = rows.withColumn("__named", F.when((F.col("__exact") == 0) & (F.col("__prefix") == 0) & (F.col("__name") != F.col("__key")) & (F.length("__name") >= 4), named).otherwise(0))
    after = F.when(F.col("__exact") > 0, F.col("__exact") + F.size("heads")).when(F.col("__prefix") > 0, F.col("__prefix") + 1).when(F.col("__named") > 0, F.col("__named"))
    rest = F.when((F.col("headline") != "") & after.isNotNull(), F.slice("lines", after, F.lit(SPAN))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("__rest", rest)
    rows = rows.withColumn("__short", F.transform("__rest", lambda line: (F.length(line) <= 32) & ~line.rlike(r"\d")))

    def ends(line: Column, i: Column) -> Column:
        def short(k: int) -> Column:
            return F.coalesce(F.when(i + k >= 0, F.get("__short", F.greatest(i + k, F.lit(0)))), F.lit(False))

        tab = F.coalesce(F.when(i > 0, has(F.get("__rest", F.greatest(i - 1, F.lit(0))), TAB)), F.lit(False))
        return has(line, STOP_LINE) & ~tab & ~((short(-2) & short(-1)) | (short(1) & short(2)))

    rows = rows.withColumn("__end", first_at(F.col("__rest"), ends))
    body = F.when(F.col("__end") > 0, F.slice("__rest", F.lit(1), F.col("__end") - 1)).otherwise(F.col("__rest"))
    return rows.withColumn("body", body).drop("heads", "__key", "__name", "__keys", "__exact", "__prefix", "__named", "__rest", "__short", "__end")


def _conditional(lines: Column, values: Column) -> Column:
    """For each line whether it is a rate's condition: "from N %" with the caption of a rate right above or below."""

    def caption(i: Column) -> Column:
        return F.coalesce(F.when(i >= 0, has(F.get(lines, F.greatest(i, F.lit(0))), RATE_CAPTION)), F.lit(False))

    return F.transform(lines, lambda line, i: has(line, FROM_RATE) & F.get(values, i).isNotNull() & (caption(i - 1) | caption(i + 1)))


def base_rate(rows: DataFrame, lines: str, out: str) -> DataFrame:
    """Adds `out`: struct<low, high, raw, kinds, apr_low, apr_high, apr_raw> of the base rate in an array of lines.

    rows: category and the array. The first rate counts, unless what stands in its own window makes it special; then the
    first one with the same caption that isn't, if there is one. Full costs are kept apart. kinds: what is said near the chosen
    rate, beside bonuses, and where its number is repeated.
    """
    names = [f"__{n}" for n in ("l", "v", "p", "c", "w", "m", "a", "r")]
    line, value, cost, cond, window, mark, aprs, found = names
    credit = F.col("category").isin(*CREDIT)
    parted = F.transform(lines, lambda x: F.split(x, COST_THEN_RATE, 2))
    apart = F.flatten(F.zip_with(lines, parted, lambda x, p: F.when(has(x, FULL_COST) & (F.size(p) == 2) & has(p[0], FULL_COST), F.transform(p, stripped)).otherwise(F.array(x))))
    rows = rows.withColumn(line, apart).withColumn(value, F.transform(line, line_rates)).withColumn(cost, F.transform(line, lambda x: has(x, FULL_COST)))
    rows = rows.withColumn(cond, _conditional(F.col(line), F.col(value)))
    n = F.size(line)

    def at(name: str, i: Column, default: Column) -> Column:
        return F.coalesce(F.when(i >= 0, F.get(name, F.greatest(i, F.lit(0)))), default)

    def text_at(i: Column) -> Column:
        return at(line, i, F.lit(""))

    def rated(i: Column) -> Column:
        return at(value, i, F.lit(None).cast("array<double>")).isNotNull()

    def full(i: Column) -> Column:
        return at(cost, i, F.lit(False))

    # The lines that are a rate's own: down from the rate before it, up to some lines before the rate after it or a heading.
    def own_lines(i: Column) -> Column:
        back, ahead = F.sequence(F.lit(1), F.lit(12)), F.sequence(F.lit(1), F.lit(8))
        above = F.array_min(F.filter(back, lambda k: rated(i - k) & ~(full(i - k) | full(i - k - 1))))
        start = F.greatest(F.lit(0), i - F.coalesce(above - 1, F.lit(12)))
        heading = F.array_min(F.filter(ahead, lambda k: has(text_at(i + k), RATES_HEADING) | has(text_at(i + k), SECTION_END)))
        end = F.least(n, i + F.coalesce(heading, F.lit(9)))
        following = F.array_min(F.filter(ahead, lambda k: (i + k < end) & rated(i + k)))
        end = F.when(following.isNotNull(), F.greatest(i + 1, i + following - 6)).otherwise(end)
        return F.array_join(F.slice(line, start + 1, end - start), " ")

    rows = rows.withColumn(window, F.transform(line, lambda x, i: F.when(F.get(value, i).isNotNull(), rates.kinds_near(own_lines(i)))))
    from_only = credit & F.exists(cond, lambda x: x)
    ceiling = F.when(F.lit(False), 0.0)
    for category, most in CEILING.items():
        ceiling = ceiling.when(F.col("category") == category, most)

    # What each line is: apr (a full cost), rate, or neither; with the values that count.
    def judged(x: Column, i: Column) -> Column:
        v = F.get(value, i)
        before, after = text_at(i - 1), text_at(i + 1)
        repeated = F.coalesce(F.array_sort(at(value, i - 1, F.lit(None).cast("array<double>"))) == F.array_sort(v), F.lit(False))
        captioned = rates.excluded_by(after) | (rates.excluded_by(before) & ~rated(i - 2))
        usable = v.isNotNull() & ~(credit & has(x, OTHER_PRODUCT)) & ~repeated & ~captioned
        near = F.array_min(F.filter(F.sequence(F.lit(1), F.lit(3)), lambda k: (i - k < 0) | rated(i - k)))
        reach = F.coalesce(near - 1, F.lit(3))
        cost_above = F.exists(F.sequence(F.lit(1), F.lit(3)), lambda k: (k <= reach) & full(i - k))
        below_number = (reach == 1) & (i > 1) & rated(i - 2) & ~F.endswith(before, F.lit(":"))
        own_caption = has(after, RATE_CAPTION) & ~full(i - 1)
        own = has(x, OWN_RATE) & ~F.get(cost, i)
        is_cost = ~own & (F.get(cost, i) | full(i + 1) | (cost_above & ~below_number & ~own_caption))
        first, last = rates.number(F.regexp_extract(x, RANGE, 1)), rates.number(F.regexp_extract(x, RANGE, 2))
        spanned = F.when(is_cost & first.isNotNull(), F.array(first, last)).when(~is_cost & (F.size(v) == 1) & (last == v[0]), F.array(first, v[0])).otherwise(v)
        worded = (F.col("category") != "Кредитные карты") | has(F.concat_ws(" ", before, x, after), RATE_WORD)
        counts = worded & F.coalesce(F.array_max(spanned) <= ceiling, F.lit(True)) & (~from_only | own | F.get(cond, i))
        kind = F.when(usable & is_cost, "apr").when(usable & ~is_cost & counts, "rate")
        return F.struct(i.alias("i"), kind.alias("kind"), spanned.alias("values"), x.alias("raw"), before.alias("caption"), after.alias("after"), F.get(window, i).alias("kinds"))

    # Only lines with a percentage are judged.
    spots = F.filter(F.transform(line, lambda x, i: i), lambda i: F.get(value, i).isNotNull())
    rows = rows.withColumn(mark, F.filter(F.transform(spots, lambda i: judged(F.get(line, i), i)), lambda m: m["kind"].isNotNull()))
    rows = rows.withColumn(aprs, F.filter(mark, lambda m: m["kind"] == "apr")).withColumn(found, F.filter(mark, lambda m: m["kind"] == "rate"))
    first = F.get(found, F.lit(0))
    common = F.get(F.filter(found, lambda m: (F.size(m["kinds"]) == 0) & (m["caption"] == F.get(found, F.lit(0))["caption"])), F.lit(0))
    rows = rows.withColumn("__first", first).withColumn("__common", F.when(F.size(F.col("__first.kinds")) > 0, common))
    rows = rows.withColumn("__pick", F.coalesce("__common", "__first"))
    # The full cost: all that stand before the first rate, or the last one between a passed-over rate and the chosen one.
    passed = F.array_max(F.transform(F.filter(found, lambda m: m["i"] < F.col("__common.i")), lambda m: m["i"]))
    rows = rows.withColumn("__passed", passed)
    block = F.try_element_at(F.filter(aprs, lambda m: (m["i"] > F.col("__passed")) & (m["i"] < F.col("__common.i"))), F.lit(-1))["values"]
    earlier = F.filter(aprs, lambda m: F.col("__first").isNull() | (m["i"] < F.col("__first.i")))
    rows = rows.withColumn("__block", block).withColumn("__earlier", earlier)
    cost_values = F.coalesce("__block", F.flatten(F.transform("__earlier", lambda m: m["values"])))
    last_cost = F.try_element_at("__earlier", F.lit(-1))
    raw_cost = F.trim(F.concat_ws(" ", last_cost["raw"], last_cost["after"]))

    # Conditions: near the rate, beside bonuses, and where the same number stands again.
    top = F.array_max(F.col("__pick.values"))
    digits = F.replace(F.regexp_replace(F.regexp_replace(F.format_string("%.3f", top), "0+$", ""), r"\.$", ""), F.lit("."), F.lit(","))

    def beside(i: Column, back: int) -> Column:
        return rates.kinds_near(F.concat_ws(" ", *[text_at(i + k) for k in range(-back, 3 if back == 0 else 2)]))

    rows = rows.withColumn("__again", F.concat(F.lit(r"(?<![\d,])"), digits, F.lit(r"(?:0*)\s?%")))
    bonus = F.flatten(F.transform(line, lambda x, i: F.when(x.rlike(BONUS), beside(i, 0)).otherwise(F.array().cast("array<string>"))))
    again = F.flatten(F.transform(line, lambda x, i: F.when((i != F.col("__pick.i")) & F.regexp_like(x, F.col("__again")), beside(i, 1)).otherwise(F.array().cast("array<string>"))))
    kinds = F.when(F.col("__pick").isNotNull(), F.array_distinct(F.concat(F.col("__pick.kinds"), bonus, again)))
    fields = F.struct(
        F.array_min("__pick.values").alias("low"),
        F.array_max("__pick.values").alias("high"),
        F.col("__pick.raw").alias("raw"),
        kinds.alias("kinds"),
        F.array_min(cost_values).alias("apr_low"),
        F.array_max(cost_values).alias("apr_high"),
        F.when(last_cost.isNotNull(), raw_cost).alias("apr_raw"),
    )
    return rows.withColumn(out, fields).drop(*names, "__first", "__common", "__pick", "__passed", "__block", "__earlier", "__again")


def amounts_and_terms(lines: Column) -> Column:
    """struct<amount_min, amount_max, term_min, term_max> (roubles, months) from the first 15 lines of a description.

    The first part of a line that is a sum counts, and the first that is a term; one bound leaves the other open. A sum
    with "from" alone takes its end from a later part with "to", if that is more.
    """
    parts = F.flatten(F.transform(F.slice(lines, 1, 15), lambda line: F.transform(F.split(line, ","), lambda p: F.regexp_replace(stripped(p), LABEL, ""))))

    def opens(part: Column, word: str) -> Column:
        return has(part, rf"^{word}\b")

    def money(part: Column) -> Column:
        return text.money_list(F.when(has(part, "₽|руб"), part).otherwise(F.concat(part, F.lit(" ₽"))))

    sums = F.transform(F.filter(parts, lambda p: has(p, AMOUNT_PART)), lambda p: F.struct(p.alias("part"), money(p).alias("values")))
    terms = F.transform(F.filter(parts, lambda p: has(p, TERM_PART) & ~has(p, AMOUNT_PART)), lambda p: F.struct(p.alias("part"), text.term_months(p).alias("values")))

    def bounds(item: Column) -> tuple[Column, Column]:
        single = F.size(item["values"]) == 1
        return F.when(~(single & opens(item["part"], "до")), F.array_min(item["values"])), F.when(~(single & opens(item["part"], "от")), F.array_max(item["values"]))

    # A let-binding: the arrays are made once and named inside.
    def of(s: Column, t: Column) -> Column:
        at = first_at(s, lambda x, i: F.size(x["values"]) > 0)
        amount, term = F.when(at > 0, F.get(s, F.greatest(at - 1, F.lit(0)))), F.get(F.filter(t, lambda x: F.size(x["values"]) > 0), F.lit(0))
        low, high = bounds(amount)
        end = F.get(F.filter(F.slice(s, F.greatest(at, F.lit(0)) + 1, F.size(s)), lambda x: opens(x["part"], "до")), F.lit(0))
        most = F.array_max(end["values"])
        high = F.when(high.isNull() & (at > 0) & (most > low), most).otherwise(high)
        first, last = bounds(term)
        return F.struct(low.alias("amount_min"), high.alias("amount_max"), first.alias("term_min"), last.alias("term_max"))

    return F.transform(F.array(F.struct(sums.alias("s"), terms.alias("t"))), lambda x: of(x["s"], x["t"]))[0]


def rates_block(rows: DataFrame, out: str) -> DataFrame:
    """Adds `out`: the lines under the first heading of rates that has a rate among its first 25; empty if none."""
    rows = rows.withColumn("__heads", F.filter(F.transform("lines", lambda x, i: F.when(has(x, RATES_HEADING), i)), lambda i: i.isNotNull()))

    def block(i: Column) -> Column:
        below = F.slice("lines", i + 2, F.lit(BLOCK - 1))
        end = F.array_position(F.transform(below, lambda x: has(x, SECTION_END)), True).cast("int")
        return F.when(end > 0, F.slice(below, F.lit(1), end - 1)).otherwise(below)

    rated = F.filter(F.transform("__heads", block), lambda b: F.exists(F.slice(b, 1, 25), lambda x: line_rates(x).isNotNull()))
    return rows.withColumn(out, F.coalesce(F.get(rated, F.lit(0)), F.array().cast("array<string>"))).drop("__heads")


def page_products(pages: DataFrame, h1: str = "h1", title: str = "title", page: str = "text", category: str = "category", city: str = "Луганск") -> DataFrame:
    """One row for each page that is a product's: its columns but those named, then name, category and what the page says of it.

    rate_min, rate_max, rate_raw, rate_source (body, headline, section, footnote, balance), rate_kind; apr_min, apr_max; amount_min,
    amount_max (roubles), term_min, term_max (months); closed (what says that it is no longer offered), absent (the clause that
    denies it to the region), estimate (the rate is a calculator's), subsidised (its full cost is), recheck (the numbers look wrong).

    Defined results: pages of errors and pages whose title isn't a product's give no row; null texts have no lines; equal pages
    give equal rows; a page is read whole, its description up to SPAN lines after the title.
    """
    rest = [c for c in pages.columns if c not in (h1, title, page, category)]
    rows = pages.select(*rest, F.col(h1).alias("h1"), F.col(title).alias("title"), F.col(page).alias("text"), F.col(category).alias("category"))
    rows = titled(rows.where(~is_error_page(F.col("h1"), F.col("title"), F.col("text")))).where(is_product_title(F.col("name")))
    rows = described(rows.withColumn("category", category_of(F.col("name"), F.col("category"))))
    credit, debit = F.col("category").isin(*CREDIT), F.col("category").isin(*DEBIT)
    # A credit page with rates but no condition in its description: the condition further down belongs to it.
    rows = rows.withColumn("__bv", F.transform("body", line_rates)).withColumn("__bc", _conditional(F.col("body"), F.col("__bv")))
    lacking = credit & F.exists("__bv", lambda v: v.isNotNull()) & ~F.exists("__bc", lambda c: c)
    rows = once(rows, __pv=F.when(lacking, F.transform("lines", line_rates))).withColumn("__pc", F.when(lacking, _conditional(F.col("lines"), F.col("__pv"))))
    spot = F.coalesce(F.array_position("__pc", True).cast("int"), F.lit(0))
    extra = F.when(spot > 0, F.slice("lines", F.greatest(F.lit(1), spot - 4), spot + 4 - F.greatest(F.lit(1), spot - 4))).otherwise(F.array().cast("array<string>"))
    rows = rates_block(rows.withColumn("__rated", F.concat("body", extra)).withColumn("__cond", F.exists("__bc", lambda c: c) | (F.coalesce(F.array_position("__pc", True), F.lit(0)) > 0)), "__section")
    rows = base_rate(base_rate(rows, "__rated", "__own"), "__section", "__below")
    spoken = F.when(F.col("headline") != F.col("name"), line_rates(F.col("headline")))
    source = F.when(F.col("__own.low").isNotNull(), "body").when(spoken.isNotNull(), "headline").when(F.col("__below.low").isNotNull(), "section")
    rows = rows.withColumn("__spoken", spoken).withColumn("rate_source", source)

    def chosen(own: Column, head: Column, below: Column) -> Column:
        return F.when(F.col("rate_source") == "body", own).when(F.col("rate_source") == "headline", head).when(F.col("rate_source") == "section", below)

    rows = rows.withColumns(
        {
            "rate_min": chosen(F.col("__own.low"), F.array_min("__spoken"), F.col("__below.low")),
            "rate_max": chosen(F.col("__own.high"), F.array_max("__spoken"), F.col("__below.high")),
            "rate_raw": chosen(F.col("__own.raw"), F.col("headline"), F.col("__below.raw")),
            "__kinds": F.coalesce(chosen(F.col("__own.kinds"), rates.kinds_near(F.col("headline")), F.col("__below.kinds")), F.array().cast("array<string>")),
            "apr_min": F.coalesce("__own.apr_low", "__below.apr_low"),
            "apr_max": F.coalesce("__own.apr_high", "__below.apr_high"),
            "__at": amounts_and_terms(F.col("body")),
            "closed": F.left(squeezed(closing_clause(F.concat_ws("\n", F.col("name"), F.slice("body", 1, 40)))), F.lit(160)),
            "absent": denial_clause(F.array_join(F.concat("body", "__section"), "\n")),
            "__page": F.coalesce("text", F.lit("")),
        }
    )
    # Cards: a percentage is a rate only on the balance.
    balance = F.flatten(F.transform("body", lambda x, i: F.when(has(x, ON_BALANCE), F.array(x, F.get("body", i + 1), F.when(i > 0, F.get("body", F.greatest(i - 1, F.lit(0)))))).otherwise(F.array().cast("array<string>"))))
    kept = F.get(F.filter(balance, lambda x: line_rates(x).isNotNull() & ~has(x, CASHBACK)), F.lit(0))
    rows = rows.withColumn("__kept", F.when(debit & F.col("rate_min").isNotNull(), kept)).withColumn("__debit", debit & F.col("rate_min").isNotNull())
    on_balance = line_rates(F.col("__kept"))
    rows = rows.withColumns(
        {
            "rate_min": F.when(F.col("__debit"), F.array_min(on_balance)).otherwise(F.col("rate_min")),
            "rate_max": F.when(F.col("__debit"), F.array_max(on_balance)).otherwise(F.col("rate_max")),
            "rate_raw": F.when(F.col("__debit"), F.col("__kept")).otherwise(F.col("rate_raw")),
            "rate_source": F.when(F.col("__debit") & F.col("__kept").isNull(), F.lit(None)).when(F.col("__debit"), "balance").otherwise(F.col("rate_source")),
        }
    )
    # A rate with a paid service gives way to the footnote's without it, if that is higher.
    low = rates.number(F.regexp_extract("__page", WITHOUT_SERVICE, 1))
    high = F.coalesce(rates.number(F.regexp_extract("__page", WITHOUT_SERVICE, 2)), low)
    rows = rows.withColumn("rate_kind", rates.rate_kind(F.col("name"), F.col("__kinds"), F.lit("")))
    rows = rows.withColumn("__low", F.when(F.col("rate_kind") == "subscription", low)).withColumn("__foot", F.coalesce(F.col("__low") > F.col("rate_min"), F.col("__low").isNotNull()))
    rows = rows.withColumns(
        {
            "rate_min": F.when(F.col("__foot"), F.col("__low")).otherwise(F.col("rate_min")),
            "rate_max": F.when(F.col("__foot"), high).otherwise(F.col("rate_max")),
            "rate_raw": F.when(F.col("__foot"), F.left(squeezed(F.regexp_extract("__page", WITHOUT_SERVICE, 0)), F.lit(200))).otherwise(F.col("rate_raw")),
            "rate_source": F.when(F.col("__foot"), "footnote").otherwise(F.col("rate_source")),
            "rate_kind": rates.rate_kind(F.col("name"), F.when(F.col("__foot"), F.array().cast("array<string>")).otherwise(F.col("__kinds")), F.col("closed")),
            "estimate": credit & F.col("rate_min").isNotNull() & ~F.coalesce(has(F.col("rate_raw"), FROM_RATE), F.lit(False)) & ~F.col("__cond") & has(F.col("__page"), ESTIMATE),
            "subsidised": has(F.col("__page"), SUBSIDISED),
        }
    )
    bare = F.col("rate_min").isNull() & F.col("apr_min").isNull()
    odd = F.coalesce(F.col("apr_min") < F.col("rate_min"), F.lit(False)) | F.coalesce((F.col("rate_min") < 12) & (F.col("category") != "Ипотека"), F.lit(False)) | (F.col("rate_kind") != "base")
    recheck = F.col("category").isin(*WITH_RATE) & (bare | (credit & odd))
    told = ["rate_min", "rate_max", "rate_raw", "rate_source", "rate_kind", "apr_min", "apr_max"]
    last = ["closed", "absent", "estimate", "subsidised"]
    return rows.select(*rest, "name", "category", *told, "__at.amount_min", "__at.amount_max", "__at.term_min", "__at.term_max", *last, recheck.alias("recheck"), presence_quote(F.col("text"), city).alias("presence"))
