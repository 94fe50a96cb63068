"""Scenario comparison: admission with reasons, income, rate-table lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.functions import finance

TOLERANCE_DAYS = 3


def term_admits(days: Column, low: Column, high: Column, values: Column) -> Column:
    """A scenario's term fits a listed term within three days, or the range."""
    near = F.exists(values, lambda v: F.abs(days - v) <= TOLERANCE_DAYS)
    return F.coalesce(near, F.lit(False)) | F.coalesce(days.between(low, high), F.lit(False))


def admission(products: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every product under every scenario: the first failing reason (NULL: eligible) and the income.

    products: product, bank, currency, rate, min_days, max_days, terms (array or NULL), min_amount, max_amount.
    scenarios: scenario, amount, days, currency; the caller's few parameter sets, so they are broadcast.
    """
    rows = products.alias("p").crossJoin(F.broadcast(scenarios).alias("s"))
    reason = (
        F.when(F.col("p.currency").isNull(), "currency_unknown")
        .when(F.col("p.currency") != F.col("s.currency"), "currency_differs")
        .when(F.col("p.rate").isNull(), "rate_unknown")
        .when(F.col("p.min_days").isNull() & F.col("p.terms").isNull(), "term_unknown")
        .when(~term_admits(F.col("s.days"), F.col("p.min_days"), F.col("p.max_days"), F.col("p.terms")), "term_not_allowed")
        .when(F.col("s.amount") < F.col("p.min_amount"), "amount_below_minimum")
        .when(F.col("s.amount") > F.col("p.max_amount"), "amount_above_maximum")
    )
    income = F.when(reason.isNull(), finance.simple_interest(F.col("s.amount"), F.col("p.rate"), F.col("s.days")))
    return rows.select("scenario", "product", "bank", "rate", reason.alias("reason"), income.alias("income"))


def best_by_bank(judged: DataFrame) -> DataFrame:
    """Each bank's best eligible product in each scenario; ties go to the lower product."""
    w = Window.partitionBy("scenario", "bank").orderBy(F.col("income").desc(), "product")
    return judged.where("reason is null").withColumn("place", F.row_number().over(w)).where("place = 1").drop("place", "reason")


def banks_without(judged: DataFrame, banks: DataFrame) -> DataFrame:
    """(scenario, bank) without an eligible product."""
    eligible = judged.where("reason is null").select("scenario", "bank").distinct()
    return judged.select("scenario").distinct().crossJoin(banks.select("bank").distinct()).join(eligible, ["scenario", "bank"], "left_anti")


def rate_lookup(points: DataFrame, table: DataFrame, fixed_terms: bool = False) -> DataFrame:
    """Rate of (amount, days) in a tiered table.

    table: tier (its order), min_sum, term (its order), days, rate; a bank's published table, a few hundred rows,
    so it is broadcast. points: point, amount, days. The tier is the last listed one whose minimum is not above the
    amount; in it the entry is the last with days not above the scenario's (fixed terms: the exact one,
    else the entry before the first longer one). Terms outside the table, NULL and non-positive rates give no row's rate.
    """
    tiers = table.groupBy("tier", "min_sum").agg(F.array_sort(F.collect_list(F.struct("term", "days", "rate"))).alias("entries"))
    matrix = tiers.agg(F.array_sort(F.collect_list(F.struct("tier", "min_sum", "entries"))).alias("tiers"), F.min(F.array_min("entries.days")).alias("least"), F.max(F.array_max("entries.days")).alias("most"))
    rows = points.crossJoin(F.broadcast(matrix))
    tier = F.element_at(F.filter("tiers", lambda t: t["min_sum"] <= F.col("amount")), -1)
    rows = rows.withColumn("tier_found", F.when(F.exists("tiers", lambda t: t["min_sum"] <= F.col("amount")), tier))
    upto = F.filter("tier_found.entries", lambda e: e["days"] <= F.col("days"))
    rows = rows.withColumn("entry", F.when(F.size(upto) > 0, F.element_at(upto, -1)))
    inside = F.col("days").between(F.col("least"), F.col("most"))
    rate = F.when(inside & (F.col("entry.rate") > 0), F.col("entry.rate"))
    used = F.when(rate.isNotNull(), F.col("entry.days") if fixed_terms else F.col("days"))
    return rows.select(*points.columns, F.col("tier_found.tier").alias("tier"), rate.alias("rate"), used.alias("used_days"))


def nearest_term(days: Column, terms: Column) -> Column:
    """The listed term within three days of the wanted one; of two equally near, the shorter."""
    near = F.filter(terms, lambda t: F.abs(t - days) <= TOLERANCE_DAYS)
    return F.array_min(F.transform(near, lambda t: F.struct(F.abs(t - days).alias("d"), t.alias("t"))))["t"]


def inherit_units(rows: DataFrame, text: str, position: str, unit: str) -> DataFrame:
    """Right-to-left inheritance: a number without a unit takes the next unit to its right ("3 and 6 months")."""
    ahead = Window.partitionBy(text).orderBy(position).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.withColumn("unit_inherited", F.first(unit, ignorenulls=True).over(ahead))


def blocked_goals(options: DataFrame, goal: str, position: str) -> DataFrame:
    """Goals whose options are all unavailable, with the first option's note; options outside the region's choice don't count."""
    counted = options.where(~F.coalesce("no_region", F.lit(False)) & F.col(goal).isNotNull())
    all_blocked = F.every(F.coalesce(F.col("available") == F.lit(False), F.lit(False)))
    goals = counted.groupBy(goal).agg(all_blocked.alias("blocked"), F.min_by(F.coalesce("note", F.lit("недоступно")), position).alias("note"), F.count("*").alias("options"))
    return goals.where("blocked").drop("blocked")


def warnings(days: Column, rate_low: Column, rate_high: Column, confirmed: Column, flags: Column, stale_after: int = 7) -> Column:
    """Array of what to know about a computed offer: bounds of its rate, flags, region, and age of the data in days (NULL: unknown)."""
    cases = [
        (rate_low.isNull(), "only_upper_rate"),
        (rate_low != rate_high, "rate_range"),
        (F.array_contains(flags, "floating_rate"), "floating_rate"),
        (F.array_contains(flags, "limited_time"), "limited_time"),
        (F.array_contains(flags, "restricted_audience"), "restricted_audience"),
        (~F.coalesce(confirmed, F.lit(False)), "region_not_confirmed"),
        (days > stale_after, "stale"),
        (days.isNull(), "unknown_date"),
    ]
    return F.array_compact(F.array(*[F.when(test, name) for test, name in cases]))


#: Inputs that each product's scenario needs.
NEEDED = {
    "deposit": ("rate", "capitalisation"),
    "savings_account": ("base_rate",),
    "debit_card": ("cashback_pct", "cashback_limit", "balance_rate", "monthly_fee"),
    "credit_card": ("monthly_fee", "cash_fee_pct", "cash_fee_min", "grace_days"),
    "cash_loan": ("rate",),
    "car_loan": ("rate", "down_payment_min_pct"),
    "mortgage": ("rate", "down_payment_min_pct"),
}


def compute(rows: DataFrame) -> DataFrame:
    """Adds missing (array of needed inputs that are NULL), status (ok, no_data, not_offered) and the product's metrics.

    income (deposit, account), benefit or cost of a year (cards), payment and overpayment (loans). A missing input is never
    replaced: the scenario has no data then. amount is the price for loans with a down payment.
    """
    c, no_list = F.col, F.array().cast("array<string>")
    missing = no_list
    for product, names in NEEDED.items():
        lacking = F.array_compact(F.array(*[F.when(c(n).isNull(), F.lit(n)) for n in names]))
        if product == "savings_account":
            lacking = F.when((c("welcome_months") > 0) & c("welcome_rate").isNull() & c("base_rate").isNotNull(), F.array(F.lit("welcome_rate"))).otherwise(lacking)
        missing = F.when(c("product") == product, lacking).otherwise(missing)
    with_down = c("product").isin("car_loan", "mortgage")
    refused = (c("product").isin("cash_loan", "mortgage") & (c("amount") * F.when(with_down, 1 - c("down_payment_pct") / 100).otherwise(1.0) > c("amount_max"))) | (with_down & (c("down_payment_pct") < c("down_payment_min_pct")))
    status = F.when(~c("product").isin(*NEEDED), "unknown_product").when(F.size("missing") > 0, "no_data").when(F.coalesce(refused, F.lit(False)), "not_offered").otherwise("ok")
    welcome = F.least(F.coalesce("welcome_months", F.lit(0)), "months")
    plain = finance.deposit_income(c("amount"), c("rate"), c("months"))
    income = F.when(c("product") == "deposit", F.when(c("capitalisation"), finance.deposit_income(c("amount"), c("rate"), c("months"), True)).otherwise(plain))
    income = income.when(c("product") == "savings_account", finance.deposit_income(c("amount"), F.coalesce("welcome_rate", F.lit(0.0)), welcome) + finance.deposit_income(c("amount"), c("base_rate"), c("months") - welcome))
    year = F.when(c("product") == "debit_card", finance.debit_card_benefit(c("spend"), c("cashback_pct"), c("cashback_limit"), c("amount"), c("balance_rate"), c("monthly_fee")))
    year = year.when(c("product") == "credit_card", finance.credit_card_cost(c("monthly_fee"), c("amount"), c("cash_fee_pct"), c("cash_fee_min")))
    principal = F.when(c("product") == "cash_loan", c("amount")).when(with_down, c("amount") * (1 - c("down_payment_pct") / 100))
    metrics = {"income": income, "year_value": year, "payment": finance.annuity(principal, c("rate"), c("months")), "overpayment": finance.overpayment(principal, c("rate"), c("months"))}
    out = rows.withColumn("missing", missing).withColumn("status", status)
    return out.withColumns({name: F.when(F.col("status") == "ok", finance.to_cents(value)) for name, value in metrics.items()})
