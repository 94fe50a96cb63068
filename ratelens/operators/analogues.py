"""Which products of other banks are analogues of the home bank's: programs and tags by title, similarity, the matrix and its lights.

Similarity depends on a product's tags, kind of rate, and whether it is a bank's main product or closed. Both sides are first
reduced to their different signatures within a program, so that the join compares signatures and not products, however many
products share one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.functions.rates import has, same_kind
from ratelens.operators.market import showcase_rate

SAVINGS = ("Вклады", "Накопительные счета")
# Programs of a category by title, in order; programs without a pattern; one program in two categories.
PROGRAMS = {
    "Ипотека": [
        ("Кредит под залог недвижимости", r"(?<!без )залог"),
        ("Военная ипотека", r"военн"),
        ("Рефинансирование ипотеки", r"рефинанс"),
        ("Семейная ипотека", r"семейн"),
        ("Льготная для новых регионов", r"нов\w+\s+(регион|субъект|территор)|днр|лнр"),
        ("Дальневосточная и арктическая", r"дальневост|арктич"),
        ("IT-ипотека", r"\bит\b|\bit\b|айти"),
        ("С застройщиком-партнёром", r"самол[её]т|застройщ|партн[её]р"),
        ("Сельская ипотека", r"сельск"),
        ("Строительство дома", r"ижс|строительств|построй|построить"),
        ("Готовый дом и загородная недвижимость", r"готов\w*\s+дом|загородн|\bдом\b|дачн|коттедж|таунхаус"),
        ("С материнским капиталом", r"материнск"),
        ("Вторичное жильё", r"вторичн|готов"),
        ("Новостройки", r"новостро|строящ"),
    ],
    "Кредиты": [
        ("Рефинансирование", r"рефинанс"),
        ("Кредит под залог авто", r"залог\w*\s+(?:авто|автомоб|транспорт|машин)"),
        ("Кредит под залог", r"(?<!без )залог"),
        ("Автокредит", r"\bавто"),
        ("Образовательный кредит", r"образова"),
    ],
    "Накопительные счета": [("Счета до востребования", r"до\s+востребования|сберегательн\w*\s+сч[её]т")],
}
DEFAULT_PROGRAM = {"Ипотека": "Рыночная ипотека", "Кредиты": "Потребительский кредит"}
SHARED_PROGRAM = {("Кредиты", "Кредит под залог"): "Залог недвижимости", ("Ипотека", "Кредит под залог недвижимости"): "Залог недвижимости"}
# Tags by title, those that must be on both sides or on none, and those that make no analogues by themselves.
TAGS = [
    ("соц", r"социальн|соцвыплат|мер\w*\s+социальн|ветеран"),
    ("пенс", r"пенсион|пенси[ия]"),
    ("дети", r"детск|дет(?:ей|и)\b|ребен|ребён|kids|школ|подрост|(?<!на)копилк|юн\w+\s"),
    ("молод", r"молод|студент|стипенд|young"),
    ("зарпл", r"зарплат"),
    ("прем", r"премиал|premium|сберперв|private|supreme|премьер|привилег"),
    ("валюта", r"юан|дирхам|рупи|доллар|евро|валют"),
    ("юань", r"юан|cny"),
    ("дирхам", r"дирхам|aed"),
    ("рупия", r"рупи|inr"),
    ("доллар", r"доллар|usd"),
    ("евро", r"евро\b|eur\b"),
    ("ключ", r"ключев"),
    ("путеш", r"тревел|путешеств|аэрофлот|миль|airlines|travel|s7"),
    ("господ", r"господдерж|газифик|льготн|субсид"),
    ("иностр", r"иностран|мигрант|нерезидент"),
    ("благо", r"подари\s+жизнь|благотвор"),
    ("авто", r"\bавто(?!накоп|плат|пополн|перевод)|автомоб|машин"),
    ("пдс", r"забота\s+о\s+будущ|программ\w*\s+долгосрочн|\bпдс\b"),
    ("сервис", r"автонакоп|автокопил|округлени\w*\s+покуп"),
    ("счёт", r"^платёжн\w*\s+сч[её]т|^платежн\w*\s+сч[её]т"),
    ("пушкин", r"пушкинск"),
    ("рефин", r"рефинанс"),
    ("земля", r"земл|земел|участ"),
    ("гараж", r"гараж|машино|кладов"),
    ("комб", r"комбинир"),
    ("город", r"петербур|москв|кузбас|жител|единая\s+карта|екп|приморец|уралочк|оренбурж|сахалин|самарск|мордови|вологд|псков|(?<![а-яё])тройк|ситикард"),
    ("ип", r"\bип\b|предпринимател|самозанят"),
    ("кобренд", r"магнит|кибер|яндекс|ozon|озон|лукойл|lamoda|ламода|ржд|цска|болельщ|адафа|пят[её]роч|перекр[её]ст|okko|wildberries|all\s+airlines"),
    ("стикер", r"стикер"),
    ("пакет", r"пакет|сберпрайм|\bпрайм|привилег"),
    ("номинал", r"номинальн"),
    ("рассрочка", r"оплата\s+частями|рассрочк|за\s+покупку|сплит|плати\s+частями"),
    ("ислам", r"islam|исламск|халял"),
]
STRICT = ("гараж", "иностр", "ип", "пакет", "номинал", "рассрочка", "комб", "стикер", "пушкин", "рефин", "ислам", "соц", "прем", "ключ", "юань", "дирхам", "рупия", "доллар", "евро", "пдс", "счёт", "сервис")
LOOSE = ("кобренд", "город", "валюта")
# A bank's main products; a floating rate and a loan for purchases by a page's text.
FLAGSHIP = r"^(?:дебетовая|кредитная)\s+карта(?:\s+(?:втб|мир|black|пс?б))?$|мультикарт|\bblack\b|platinum|платинум|карта\s+возможност|^кредит\s+наличными$|^ипотека\s+на\s+(?:вторичн|новостро)|^накопительн\w*\s+(?:\S+-)?сч[её]т$"
FLOATING = r"вслед\s+за\s+ключев|ключев\w*\s+ставк\w*\s+(?:цб|банка\s+россии)?\s*(?:минус|плюс|[-−+])|привязан\w*\s+к\s+ключев|равн\w*\s+ключев"
PURCHASE_LOAN = r"товар\w*\s+(?:и\s+услуг\w*\s+)?в\s+кредит|в\s+кредит\s+онлайн\s+или\s+в\s+магазин"
PROMOTIONAL = ("welcome", "new_money", "short_term")
#: Where a product is offered, best known last.
OFFERED = ("absent", "unknown", "federal", "lnr")


def program_of(category: Column, title: Column) -> Column:
    """The program within a category that a title belongs to; the first pattern that it has decides."""
    out = F.when(F.lit(False), category)
    for name, rules in PROGRAMS.items():
        for program, pattern in rules:
            out = out.when((category == name) & has(title, pattern), program)
    for name, program in DEFAULT_PROGRAM.items():
        out = out.when(category == name, program)
    return out.otherwise(category)


def slot_of(category: Column, program: Column) -> Column:
    """What analogues share: category and program, or a program that stands in two categories."""
    out = F.when(F.lit(False), program)
    for (name, of), shared in SHARED_PROGRAM.items():
        out = out.when((category == name) & (program == of), F.lit(f"*/{shared}"))
    return out.otherwise(F.concat_ws("/", category, program))


def tags_of(title: Column, context: Column) -> Column:
    """Sorted tags of a product by its title and its page's text; a title without Cyrillic letters is a copy for foreigners."""
    by_title = [F.when(has(title, pattern), tag) for tag, pattern in TAGS]
    by_text = [F.when(has(context, FLOATING), "ключ"), F.when(has(context, PURCHASE_LOAN), "рассрочка"), F.when((title != "") & ~has(title, "[а-яё]"), "иностр")]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*by_title, *by_text))))


def described(products: DataFrame) -> DataFrame:
    """products (bank, product, category, title, context, rate_min, rate_max, kind, closed, offered) with program, slot, tags, rate and signature.

    rate is the advertised bound: the upper one for savings, the lower one for loans. Only savings tell kinds of rates apart; of
    other categories a niche product is told from the rest.
    """
    title = F.coalesce("title", F.lit(""))
    savings = F.col("category").isin(*SAVINGS)
    kind = F.when(savings, same_kind(F.coalesce("kind", F.lit("base")))).when(F.col("kind") == "niche", "niche").otherwise("base")
    rows = products.withColumn("program", program_of(F.col("category"), title)).withColumn("tags", tags_of(title, F.coalesce("context", F.lit(""))))
    signature = F.struct("tags", kind.alias("kind"), has(title, FLAGSHIP).alias("flagship"), (F.coalesce("closed", F.lit("")) != "").alias("closed"))
    return rows.withColumn("slot", slot_of(F.col("category"), F.col("program"))).withColumn("rate", showcase_rate(F.col("rate_min"), F.col("rate_max"), savings)).withColumn("signature", signature)


def similarity(a: Column, b: Column) -> Column:
    """How much of an analogue the signature b is of a: the higher the closer, below 1 none; -10 where a strict tag is on one side only."""
    common, more, less = F.array_intersect(a["tags"], b["tags"]), F.array_except(b["tags"], a["tags"]), F.array_except(a["tags"], b["tags"])
    strict = F.arrays_overlap(F.concat(more, less), F.array(*map(F.lit, STRICT)))
    score = 1 + 3 * F.size(common) - 2 * F.size(more) - F.size(less)
    score += F.when(a["kind"] == b["kind"], 2).when(a["kind"].isin(*PROMOTIONAL) & b["kind"].isin(*PROMOTIONAL), 1).otherwise(0)
    score += F.when((b["kind"] == "niche") & (F.size(common) == 0), -3).otherwise(0)
    score += F.when((F.size(b["tags"]) == 0) & (a["kind"] == b["kind"]) & b["flagship"], 1).otherwise(0)
    return F.when(strict, -10).otherwise(score + F.when(b["closed"], -5).otherwise(0))


def matrix(products: DataFrame, home: str) -> DataFrame:
    """For each home product and each other bank that has products of its program: product, bank, twin, twin_rate, score, close.

    The twin is the most similar product; ties go to the one that is better known to be offered, has a rate, the better rate, the shorter
    title, the lower product. Below a score of 1 there is no analogue: twin is null and nearest names the product. close: all that is
    special about the home product the twin has too, and not only tags that make no analogues.
    """
    rows = described(products)
    savings = F.col("category").isin(*SAVINGS)
    worth = F.struct(
        F.array_position(F.array(*map(F.lit, OFFERED)), F.col("offered")).alias("offered"),
        F.col("rate").isNotNull().alias("rated"),
        F.coalesce(F.when(savings, F.col("rate")).otherwise(-F.col("rate")), F.lit(0.0)).alias("better"),
        (-F.length(F.coalesce("title", F.lit("")))).alias("short"),
        (-F.col("product")).alias("first"),
    )
    mine = rows.where(F.col("bank") == home).select("product", "category", "program", "slot", F.col("rate").alias("home_rate"), F.col("signature").alias("a"))
    best = F.max(F.struct(worth.alias("worth"), "product", "rate")).alias("best")
    rivals = rows.where(F.col("bank") != home).groupBy("slot", "bank", F.col("signature").alias("b")).agg(best)
    met = mine.select("slot", "a").distinct().join(rivals, "slot").withColumn("score", similarity(F.col("a"), F.col("b")))
    top = met.groupBy("slot", "a", "bank").agg(F.max(F.struct("score", "best", F.col("b.tags").alias("tags"))).alias("t"))
    own, theirs = F.col("a.tags"), F.col("t.tags")
    loose = (F.size(own) > 0) & (F.size(F.array_except(own, F.array(*map(F.lit, LOOSE)))) == 0)
    close = (F.col("t.score") >= 2) & (F.size(F.array_except(own, theirs)) == 0) & ~loose
    found = F.col("t.score") >= 1
    cells = top.select(
        F.col("slot").alias("__slot"), F.col("a").alias("__a"), "bank", F.when(found, F.col("t.best.product")).alias("twin"), F.when(found, F.col("t.best.rate")).alias("twin_rate"), F.when(~found, F.col("t.best.product")).alias("nearest"), F.col("t.score").alias("score"), (found & close).alias("close")
    )
    return mine.join(cells, (F.col("slot") == F.col("__slot")) & (F.col("a") == F.col("__a"))).select("product", "category", "program", "home_rate", "bank", "twin", "twin_rate", "nearest", "score", "close")


def lights(cells: DataFrame, parity: float = 0.5, loss: float = 1.0) -> DataFrame:
    """The traffic light of each close pair of a matrix: delta and light (yellow within parity or up to a loss of `loss`, grey without a rate)."""
    delta = F.round(F.col("home_rate") - F.col("twin_rate"), 3)
    better = F.when(F.col("category").isin(*SAVINGS), F.col("delta")).otherwise(-F.col("delta"))
    light = F.when(F.col("delta").isNull(), "grey").when(F.abs("delta") < parity, "yellow").when(better > 0, "green").when(F.abs("delta") >= loss, "red").otherwise("yellow")
    return cells.where("close").withColumn("delta", delta).withColumn("light", light).select("product", "category", "program", "bank", "twin", "home_rate", "twin_rate", "delta", "light")

