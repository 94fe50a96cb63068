"""Whether a product is offered in the region, why, and which products represent a program."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the region and of its neighbours, words of denial, purposes too narrow for a program.
REGION = r"(ДНР|ЛНР|Луганск\w*|Донецк\w*|Запорожск\w*|Херсонск\w*|нов\w+\s+(регион|субъект|территори)\w*)"
DENIAL = r"\bне\s+(предоставля|выда[её]т|выдаю|оформля|обслужива|распространя|действу)|недоступ|\bкроме\b|\bза\s+исключением\b"
NARROW = ("иностр", "ип", "гараж", "комб", "номинал", "пакет", "ислам", "пушкин", "стикер")


def denial_clause(text: Column, size: int = 220) -> Column:
    """The first sentence that denies the product to the region ("" if none): a denial before a name of the region.

    A program made for the region ("for residents of ...") is a denial only if it says no.
    """
    sentences = F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?\n]+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))

    def denies(s: Column) -> Column:
        made_for = s.rlike(rf"(?iuU)\bдля\s+(жителей\s+)?{REGION}") & ~s.rlike(r"(?iuU)\bне\b|недоступ")
        return s.rlike(rf"(?iuU)({DENIAL}).{{0,100}}{REGION}") & ~made_for

    return F.left(F.coalesce(F.get(F.filter(sentences, denies), F.lit(0)), F.lit("")), F.lit(size))


def status(absent: Column, calculator: Column, method: Column, presence: Column) -> Column:
    """struct<code, reason>: absent, lnr, federal or unknown; the first evidence in this order decides.

    absent: words of a denial; calculator: what the site's calculator shows, which counts if it names the region and a rate;
    method: how the conditions are tied to the region; presence: a source that the bank works there.
    """
    calc = F.coalesce(calculator, F.lit(""))
    shown = ~F.contains(calc, F.lit("регион не выбран")) & calc.rlike("(?iuU)луганск") & calc.rlike(r"\d\s?%")

    def found(code: str, reason: str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(reason).alias("reason"))

    here = F.coalesce(presence, F.lit("")) != ""
    cases = F.when(F.coalesce(absent, F.lit("")) != "", found("absent", "page")).when(shown, found("lnr", "calculator"))
    cases = cases.when(method == "selector", found("lnr", "selector")).when(method == "local", found("lnr", "local"))
    return cases.when((method == "federal") & here, found("federal", "presence")).when(method == "federal", found("unknown", "no_presence")).otherwise(found("unknown", "region_not_chosen"))


def representative(products: DataFrame, tags: Column, kind: Column, absent: Column, not_for_region: tuple[str, ...] = (), narrow: tuple[str, ...] = NARROW) -> DataFrame:
    """Products that may represent a program: a base rate, no narrow purpose, offered in the region, in a program made for it."""
    wide = ~F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, narrow))), F.lit(False))
    kept = wide & (F.coalesce(kind, F.lit("base")) == "base") & (F.coalesce(absent, F.lit("")) == "")
    return products.where(kept & ~F.col("program").isin(*not_for_region) if not_for_region else kept)
