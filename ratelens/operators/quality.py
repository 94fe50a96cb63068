"""Plausibility of offers, quality roll-ups, coverage matrices and audit scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("low", "medium", "high")
# Categories whose percentage is a rate, programs with a subsidy, pages of a section, titles that are a part of an address.
SAVINGS = ("Вклады", "Накопительные счета")
CREDIT = ("Кредиты", "Автокредиты", "Ипотека", "Кредитные карты")
SUBSIDISED = r"(?iuU)льготн|семейн|госпрограм|господдерж|нов\w+\s+(регион|субъект|территор)|дальневост|арктич|\bит\b|\bit\b|военн|субсид|сельск|образова"
SECTION_PAGE = r"(?iuU)для\s+(физических|частных)\s+лиц"
SLUG_TITLE = r"^[a-z0-9_\-]+$"
#: Percentage points: a full cost below its rate, savings above the key rate.
COST_TOLERANCE, OVER_KEY = 0.5, 3.0


def assess(offers: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """Adds issues (array of rule names that hold) and confidence (the lowest level among them, else high).

    rules are (name, level, condition); a NULL condition does not hold.
    """
    issues = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, _, test in rules]))
    worst = F.least(F.lit(2), *[F.when(F.coalesce(test, F.lit(False)), F.lit(LEVELS.index(level))).otherwise(2) for _, level, test in rules])
    return offers.withColumn("issues", issues).withColumn("confidence", F.element_at(F.array(*map(F.lit, LEVELS)), worst + 1))


def rate_rules(value: Column, key_rate: Column, is_savings: Column, confirmed: Column, over_key: float = 3.0) -> list[tuple[str, str, Column]]:
    """The rules on a rate that don't need texts. Key-rate rules are silent when the key rate is unknown."""
    return [
        ("region_not_confirmed", "low", ~confirmed),
        ("rate_out_of_range", "low", (value <= 0) | (value >= 100)),
        ("savings_over_key", "low", is_savings & (value > key_rate + over_key)),
        ("credit_under_key", "low", ~is_savings & (value < key_rate)),
    ]


def product_rules(key_rate: Column) -> list[tuple[str, str, Column]]:
    """All rules on a collected product: category, title, rate_min, rate_max, apr_min, region_method, absent, rate_source, subsidised.

    They judge whether its rate may be ranked. A missing rate is noted and lowers nothing; rules on the key rate are silent where it is unknown.
    """
    category, title = F.coalesce("category", F.lit("")), F.coalesce("title", F.lit(""))
    savings, credit = category.isin(*SAVINGS), category.isin(*CREDIT)
    rated, priced = savings | credit, F.col("rate_min").isNotNull() | F.col("rate_max").isNotNull()
    has_rate = rated & priced
    low, high = F.least("rate_min", "rate_max"), F.greatest("rate_min", "rate_max")
    section = title.rlike(SECTION_PAGE) | (F.lower(F.trim(title)) == F.lower(category))
    source = F.coalesce("rate_source", F.lit(""))
    return [
        ("no_rate", "high", rated & ~priced),
        ("region_not_confirmed", "low", F.col("region_method") == "not_confirmed"),
        ("not_in_region", "low", F.coalesce("absent", F.lit("")) != ""),
        ("section_page", "low", section),
        ("slug_title", "medium", ~section & F.trim(title).rlike(SLUG_TITLE)),
        ("from_showcase", "medium", rated & (source == "showcase")),
        ("from_tariff", "medium", source == "tariff"),
        ("from_estimate", "medium", source == "estimate"),
        ("rate_out_of_range", "low", has_rate & ((low <= 0) | (high >= 100))),
        ("savings_over_key", "low", has_rate & savings & (high > key_rate + OVER_KEY)),
        ("credit_under_key", "low", has_rate & credit & ~title.rlike(SUBSIDISED) & (low < key_rate)),
        ("cost_under_rate", "low", has_rate & (category != "Кредитные карты") & ~F.coalesce("subsidised", F.lit(False)) & (F.col("apr_min") < F.col("rate_min") - COST_TOLERANCE)),
    ]


def rollup(assessed: DataFrame, *keys: str) -> DataFrame:
    """Counts for each group, issue counts as a map, and the share of usable among rated (NULL if none is rated)."""
    rated = F.col("rated")
    has = rated & F.col("value").isNotNull()
    usable = has & (F.col("confidence") != "low")
    counts = assessed.groupBy(*keys).agg(
        F.count("*").alias("products"),
        F.count_if(rated).alias("rated"),
        F.count_if(has).alias("with_rate"),
        F.count_if(usable).alias("usable"),
        F.count_if(F.col("confidence") == "low").alias("low"),
    )
    kinds = assessed.select(*keys, F.explode("issues").alias("issue")).groupBy(*keys, "issue").agg(F.count("*").alias("n"))
    maps = kinds.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "issue", F.col("n").cast("string")))), ";").alias("issue_counts"))
    share = F.round(100.0 * F.try_divide(F.col("usable"), F.when(F.col("rated") > 0, F.col("rated"))), 1)
    return counts.join(maps, list(keys), "left").withColumn("coverage_pct", share).withColumn("issue_counts", F.coalesce("issue_counts", F.lit("")))


def coverage_matrix(products: DataFrame, links: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Dense category x bank: counts and status compared > collected > link > none.

    products: (category, bank, rated); links: (category, bank, url). rows and columns are the full lists; their
    product is the result's size.
    """
    found = products.groupBy("category", "bank").agg(F.count("*").alias("products"), F.count_if("rated").alias("rated"))
    linked = links.groupBy("category", "bank").agg(F.min_by("url", F.struct(F.length("url"), "url")).alias("url"))
    cells = rows.crossJoin(F.broadcast(columns)).join(found, ["category", "bank"], "left").join(linked, ["category", "bank"], "left")
    status = F.when(F.col("rated") > 0, "compared").when(F.col("products") > 0, "collected").when(F.col("url").isNotNull(), "link").otherwise("none")
    return cells.select("category", "bank", F.coalesce("products", F.lit(0)).alias("products"), F.coalesce("rated", F.lit(0)).alias("rated"), "url", status.alias("status"))


def sample_cells(offers: DataFrame, keys: list[str], order: list[Column], n: int, limit: int | None = None) -> DataFrame:
    """The first n rows of each cell, and at most `limit` in all: a sampling operator."""
    picked = offers.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)
    return picked if limit is None else picked.orderBy(*keys, "place").limit(limit)


def audit_score(cells: DataFrame, keys: list[str], weights: dict[str, float], unreachable_cap: float = 7.0, unreachable_share: float = 0.3) -> DataFrame:
    """Weighted score of 0 to 10 for each group.

    cells: keys, criterion, points (0 to 1), reachable. A criterion with more than 30 % unreachable cells is
    capped at 7. Criteria without cells don't count; their weights are left out.
    """
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("criterion"))
    by = cells.groupBy(*keys, "criterion").agg(F.avg(F.when(F.col("reachable"), F.col("points"))).alias("mean"), F.avg(F.when(F.col("reachable"), 0.0).otherwise(1.0)).alias("lost"))
    score = F.when(F.col("lost") > unreachable_share, F.least(10 * F.col("mean"), F.lit(unreachable_cap))).otherwise(10 * F.col("mean"))
    by = by.withColumn("score", score).withColumn("weight", weight).where(F.col("score").isNotNull())
    return by.groupBy(*keys).agg(F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 2).alias("total"), F.count("*").alias("criteria"))


def funnel(offers: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """How many rows satisfy each step and all before it: (step, position, n)."""
    passed, counts = F.lit(True), []
    for name, test in steps:
        passed = passed & F.coalesce(test, F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    row = offers.agg(*counts)
    stacked = ", ".join(f"{i + 1}, '{name}', `{name}`" for i, (name, _) in enumerate(steps))
    return row.select(F.expr(f"stack({len(steps)}, {stacked}) AS (position, step, n)"))


def parameter_coverage(planned: DataFrame, collected: DataFrame, keys: list[str], parameter: str) -> DataFrame:
    """Share of each group's planned parameters that were collected with a value, in percent with one decimal."""
    have = collected.where(F.col("value").isNotNull()).select(*keys, parameter).distinct().withColumn("have", F.lit(1))
    joined = planned.select(*keys, parameter).distinct().join(have, [*keys, parameter], "left")
    return joined.groupBy(*keys).agg(F.count("*").alias("planned"), F.count("have").alias("collected")).withColumn("coverage_pct", F.round(100.0 * F.col("collected") / F.col("planned"), 1))


def collection_status(reads: DataFrame, *keys: str) -> DataFrame:
    """reads: one row a source with `ok`. All failed: failed, some: partial, else ok."""
    counts = reads.groupBy(*keys).agg(F.count("*").alias("sources"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"))
    return counts.withColumn("status", F.when(F.col("failed") == F.col("sources"), "failed").when(F.col("failed") > 0, "partial").otherwise("ok"))


def unknown_documents(products: DataFrame, known: DataFrame, product: str, document: str) -> DataFrame:
    """products: one row a product and document. Number of each product's documents that are not known; complete if none."""
    marked = products.join(known.select(document).distinct().withColumn("known", F.lit(1)), document, "left")
    counts = marked.groupBy(product).agg(F.count(document).alias("documents"), F.count_if(F.col(document).isNotNull() & F.col("known").isNull()).alias("unknown"))
    return counts.withColumn("complete", F.col("unknown") == 0)
