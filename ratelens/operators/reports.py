"""Orders and selections of reports, and what may enter one: sources, pages, promotions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.functions.text import url_host
from ratelens.sources.ranges import numbered

LIGHTS = ("red", "yellow", "green", "grey")
# Signs that a text offers a promotion.
PROMO_SIGNAL = r"(?iuU)акци|кешб[эе]к|кэшб[эе]к|скидк|снизим|снижен|бонус|дарим|подар|приз|выигр|бесплатн|вернем|вернём|возврат|повышенн|\d+\s*%|до\s+\d{1,2}[.\s]\d{2}[.\s]\d{2,4}"


def lights_in_order(lights: DataFrame, label: str, id_col: str) -> DataFrame:
    """Lights with their place in the report: red, yellow, green, grey, then by label, then by id. Numbered by ranges, no task sees all."""
    level = F.array_position(F.array(*map(F.lit, LIGHTS)), F.col("light"))
    return numbered(lights.withColumn("__level", level), [F.col("__level"), F.col(label), F.col(id_col)], "__place").withColumn("place", F.col("__place") + 1).drop("__level", "__place")


def eligible_in_order(results: DataFrame, id_col: str) -> DataFrame:
    """Eligible results (reason is null) of each scenario with their place by income, highest first; ties by id."""
    order = Window.partitionBy("scenario").orderBy(F.desc("income_max"), id_col)
    return results.where("reason IS NULL").withColumn("place", F.row_number().over(order))


def chart_rows(results: DataFrame, id_col: str, restricted: Column, most: int = 8) -> DataFrame:
    """The `most` eligible results of each scenario with the highest income for a chart: open ones before restricted ones of the same income."""
    marked = results.where("reason IS NULL").withColumn("restricted", restricted)
    order = Window.partitionBy("scenario").orderBy(F.desc("income_max"), "restricted", id_col)
    return marked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def recent_changes(changes: DataFrame, at: str, id_col: str, now: Column, days: int = 30, most: int = 100) -> DataFrame:
    """The newest `most` changes of the last `days` days, newest first, ties by id downwards (the feature of the report)."""
    return changes.where((F.col(at) >= now - F.expr(f"INTERVAL {days} DAYS")) & (F.col(at) <= now)).orderBy(F.desc(at), F.desc(id_col)).limit(most)


def eligible_sources(sources: DataFrame, mode: str = "fetch", probing: bool = False) -> DataFrame:
    """Sources of a mode that a person has confirmed (active); when a site's root is probed, those still to do as well."""
    wanted = ["active", "todo"] if probing else ["active"]
    return sources.where(F.col("status").isin(*wanted) & (F.col("mode") == mode))


def is_listing_copy(url: Column, paths: dict[str, str]) -> Column:
    """A copy of products made for search engines: the path has the pattern that is kept for its host (without www.)."""
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    path = F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1)
    test = F.lit(False)
    for name, pattern in paths.items():
        test = test | ((host == name) & path.rlike(pattern))
    return F.coalesce(test, F.lit(False))


def is_real_promotion(text: Column) -> Column:
    return F.coalesce((text != "") & text.rlike(PROMO_SIGNAL), F.lit(False))
