"""Rates in texts of tariffs: under a numbered heading, or in a line that labels them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratelens.functions.rates import has, number

# Links to tariffs and to other documents; a labelled rate, labels of other percentages; a heading, the next section, a range on a line of its own.
TARIFF_LINK = r"тариф|tarif|tariff|процентн\w+\s+ставк"
OTHER_LINK = r"requirement|documents?-required|loyalty|program|terms-of-|promo|требовани|перечень\s+документ|правила\s+программ|анкет"
LABELLED = r"(?iuU)(?:процентн\w+\s+)?ставк\w*[^\n%]{0,80}?(?:от\s+|до\s+)?(\d{1,2}(?:[,.]\d{1,3})?)\s?%(?:\s*(?:[-–—]|до)\s*(\d{1,2}(?:[,.]\d{1,3})?)\s?%)?"
OTHER_RATE = r"неустойк|штраф|пен[яи]\b|ключев\w*\s+ставк|полн\w+\s+стоимост|\bпск\b|льготн\w+\s+период|беспроцентн"
HEADING = r"(?imuU)^\s*\d+\.?\s*процентн\w+\s+ставк\w*\s*:?\s*$"
NEXT_SECTION = r"(?mU)^\s*\d+\.\s+\S"
OWN_LINE = r"(?imuU)^\s*(?:от\s+)?(\d{1,2}(?:[,.]\d{1,3})?)\s?%?\s*(?:(?:до|[-–—])\s*(\d{1,2}(?:[,.]\d{1,3})?)\s?%)?\s*(?:годовых)?\s*$"
#: Characters below a heading that are its own.
BELOW = 1200


def tariff_links(links: Column, limit: int = 2) -> Column:
    """Different addresses of the first `limit` links (href, text) that are tariffs: PDF files that their name or label says so of."""

    def tariff(link: Column) -> Column:
        href, label = link["href"], F.coalesce(link["text"], F.lit(""))
        file = F.endswith(F.substring_index(F.lower(href), "?", 1), F.lit(".pdf"))
        return file & ~has(href, OTHER_LINK) & ~has(label, OTHER_LINK) & (has(label, TARIFF_LINK) | has(href, TARIFF_LINK))

    return F.array_distinct(F.transform(F.slice(F.filter(links, tariff), 1, limit), lambda x: x["href"]))


def _squeezed(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def _found(whole: Column, pattern: str) -> Column:
    """array<struct<said, low, high>> of all matches of a pattern with a lower and maybe an upper bound."""
    said, low, high = (F.regexp_extract_all(whole, F.lit(pattern), F.lit(i)) for i in (0, 1, 2))
    return F.transform(F.arrays_zip(said.alias("said"), low.alias("low"), high.alias("high")), lambda m: F.struct(m["said"].alias("said"), number(m["low"]).alias("low"), F.coalesce(number(F.nullif(m["high"], F.lit(""))), number(m["low"])).alias("high")))


def tariff_rate(value: Column, ceiling: float = 60.0) -> Column:
    """struct<low, high, quote> of the rate that a tariff names as one; NULL if it names none.

    First of all a range on a line of its own, with a % in it, within the section under a heading "N. interest rate"; else the
    first labelled rate of a line that isn't about penalties, the key rate or the full cost. Bounds are above 0, in order and up
    to the ceiling.
    """

    def fits(m: Column) -> Column:
        return (m["low"] > 0) & (m["low"] <= m["high"]) & (m["high"] <= ceiling)

    def section(heading: Column, below: Column) -> Column:
        own = F.split(F.left(below, F.lit(BELOW)), NEXT_SECTION, 2)[0]
        hits = F.filter(_found(own, OWN_LINE), lambda m: F.contains(m["said"], F.lit("%")) & fits(m))
        title = F.rtrim(_squeezed(heading), F.lit(":"))
        return F.transform(hits, lambda m: F.struct(m["low"].alias("low"), m["high"].alias("high"), F.left(F.concat(title, F.lit(": "), _squeezed(m["said"])), F.lit(200)).alias("quote")))

    def line(x: Column) -> Column:
        def labelled(m: Column) -> Column:
            return fits(m) & ~has(F.left(x, F.instr(x, m["said"]) - 1 + F.length(m["said"])), OTHER_RATE)

        return F.transform(F.filter(_found(x, LABELLED), labelled), lambda m: F.struct(m["low"].alias("low"), m["high"].alias("high"), F.left(_squeezed(m["said"]), F.lit(200)).alias("quote")))

    text = F.coalesce(value, F.lit(""))
    headings, pieces = F.regexp_extract_all(text, F.lit(HEADING), F.lit(0)), F.split(text, HEADING)
    under = F.flatten(F.zip_with(headings, F.slice(pieces, F.lit(2), F.size(headings)), section))
    labelled = F.flatten(F.transform(F.split(text, "\n"), line))
    return F.coalesce(F.get(under, F.lit(0)), F.get(labelled, F.lit(0)))
