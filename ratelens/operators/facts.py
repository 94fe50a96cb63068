"""Facts of a product from its card, its detail page and extracted facts; card conditions; redundancy of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assemble(cards: DataFrame, details: DataFrame, extracted: DataFrame) -> DataFrame:
    """One row for each product with conflicts resolved.

    cards: product, min_days, max_days, terms, min_amount, max_amount, fetched_at; details: the same without terms;
    extracted: product, field, value; of several values of a field the first by its text counts. A detail page's term beats the card's, unless the card lists terms that all
    lie in the detail's range: the stricter wins. A detail's amounts beat the card's, with a note where they
    differ. Extracted facts only fill gaps. checked_at is the oldest of the sources used.
    """
    d = details.select("product", *[F.col(c).alias(f"d_{c}") for c in ("min_days", "max_days", "min_amount", "max_amount", "fetched_at")])
    single = extracted.where("field IS NOT NULL").groupBy("product", "field").agg(F.min("value").alias("value"))
    x = single.groupBy("product").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("x"))
    rows = cards.join(d, "product", "left").join(x, "product", "left")
    listed = F.col("terms").isNotNull() & F.forall("terms", lambda t: t.between(F.col("d_min_days"), F.col("d_max_days")))
    has_detail = F.col("d_min_days").isNotNull() | F.col("d_max_days").isNotNull()
    by_detail = has_detail & ~F.coalesce(listed, F.lit(False))

    def term(name: str) -> Column:
        return F.coalesce(F.when(by_detail, F.col(f"d_{name}")).otherwise(F.col(name)), F.try_element_at("x", F.lit(name)).try_cast("int"))

    def money(name: str) -> Column:
        return F.coalesce(f"d_{name}", name, F.try_element_at("x", F.lit(name)).try_cast("decimal(18,2)"))

    notes = F.array_compact(F.array(*[F.when(F.col(f"d_{c}") != F.col(c), F.concat(F.lit(f"{c} differs: card "), F.col(c).cast("string"), F.lit(", detail "), F.col(f"d_{c}").cast("string"))) for c in ("min_amount", "max_amount")]))
    return rows.select("product", term("min_days").alias("min_days"), term("max_days").alias("max_days"), F.when(~by_detail, F.col("terms")).alias("terms"), money("min_amount").alias("min_amount"), money("max_amount").alias("max_amount"), notes.alias("notes"), F.least("fetched_at", "d_fetched_at").alias("checked_at"))


def card_terms(text: Column) -> Column:
    """struct of a card's service price, cashback percent, cap and grace days from its description."""
    low = F.lower(text)

    def number(pattern: str) -> Column:
        return F.regexp_replace(F.regexp_replace(F.regexp_extract(low, pattern, 1), "[  ]", ""), ",", ".").try_cast("double")

    free = low.rlike("бесплатн\\p{L}* обслуживани|обслуживание\\W+(?:бесплатно|0\\s*₽)|free service")
    return F.struct(
        F.when(free, 0.0).otherwise(number(r"обслуживани\p{L}*\D{0,20}(\d[\d  ]*)\s*₽")).alias("service"),
        number(r"(?:кэшб|кешб|cashback)\p{L}*\D{0,20}(\d+(?:[.,]\d+)?)\s*%").alias("cashback_pct"),
        number(r"(?:не более|максимум|up to)\s*(\d[\d  ]*)\s*₽\s*(?:в месяц|a month)").alias("cap"),
        number(r"(\d{2,3})\s*(?:дн|дней|days)[^.]{0,20}(?:без процентов|interest.free)").alias("grace_days"),
    )


def availability(rows: DataFrame, method: str, stored: str, note: str) -> DataFrame:
    """Adds availability and its reason: an absent note, then how the region was chosen; a stored method wins over an empty one."""
    how = F.when(F.col(stored).isin("", "not_confirmed") | F.col(stored).isNull(), F.col(method)).otherwise(F.col(stored))
    status = F.when(F.col(note).isNotNull() & (F.col(note) != ""), "absent").when(how.isin("selector", "local"), "local").when(how == "federal", "federal").otherwise("unknown")
    return rows.withColumn("availability", status).withColumn("availability_reason", F.when(status == "absent", F.col(note)).otherwise(how))
