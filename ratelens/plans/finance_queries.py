"""Scenario and formula queries. product = part, bank = its first supplier, rates and bounds derived from its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.functions import finance
from ratelens.operators import scenarios
from ratelens.plans.registry import query
from ratelens.sources.tables import table

PRODUCTS = """products AS (SELECT p_partkey AS product, (p_partkey % 10)::BIGINT AS bank, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 = 1 THEN 'CNY' ELSE 'RUB' END AS currency,
  CASE WHEN p_size % 11 = 0 THEN NULL ELSE (5 + p_size % 13)::DECIMAL(6,3) END AS rate, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 30 + p_size * 2 END AS min_days,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE 180 + p_size * 10 END AS max_days, CASE WHEN p_size % 10 = 0 THEN [91, 183, 365] END AS terms,
  (p_size * 5000)::DECIMAL(18,2) AS min_amount, (200000 + p_size * 30000)::DECIMAL(18,2) AS max_amount FROM part),
scenarios(scenario, amount, days, currency) AS (VALUES ('short', 100000::DECIMAL(18,2), 91, 'RUB'), ('half', 500000::DECIMAL(18,2), 183, 'RUB'), ('year', 1000000::DECIMAL(18,2), 365, 'RUB')),
rows0 AS (SELECT s.scenario, p.product, p.bank, p.rate, s.amount, s.days, CASE WHEN p.currency IS NULL THEN 'currency_unknown' WHEN p.currency <> s.currency THEN 'currency_differs' WHEN p.rate IS NULL THEN 'rate_unknown'
    WHEN p.min_days IS NULL AND p.terms IS NULL THEN 'term_unknown'
    WHEN NOT (coalesce(len(list_filter(p.terms, lambda v: abs(s.days - v) <= 3)) > 0, false) OR coalesce(s.days BETWEEN p.min_days AND p.max_days, false)) THEN 'term_not_allowed'
    WHEN s.amount < p.min_amount THEN 'amount_below_minimum' WHEN s.amount > p.max_amount THEN 'amount_above_maximum' END AS reason FROM products p, scenarios s),
judged AS (SELECT scenario, product, bank, rate, reason, CASE WHEN reason IS NULL THEN round((amount * rate)::DECIMAL(38,5) * days / 36500, 2) END AS income FROM rows0)"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product"),
        (F.col("p_partkey") % 10).alias("bank"),
        F.when(size % 7 == 0, None).when(size % 7 == 1, "CNY").otherwise("RUB").alias("currency"),
        F.when(size % 11 != 0, (5 + size % 13).cast("decimal(6,3)")).alias("rate"),
        F.when(size % 5 != 0, 30 + size * 2).alias("min_days"),
        F.when(size % 5 != 0, 180 + size * 10).alias("max_days"),
        F.when(size % 10 == 0, F.array(F.lit(91), F.lit(183), F.lit(365))).alias("terms"),
        (size * 5000).cast("decimal(18,2)").alias("min_amount"),
        (200000 + size * 30000).cast("decimal(18,2)").alias("max_amount"),
    )


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = spark.sql("SELECT scenario, CAST(amount AS DECIMAL(18,2)) AS amount, days, currency FROM VALUES ('short', 100000, 91, 'RUB'), ('half', 500000, 183, 'RUB'), ('year', 1000000, 365, 'RUB') AS t(scenario, amount, days, currency)")
    return scenarios.admission(products(spark, sf_dir), sets)


@query("scenario_exclusion_reasons", f"WITH {PRODUCTS} SELECT scenario, coalesce(reason, 'eligible') AS reason, count(*) AS products FROM judged GROUP BY 1, 2")
def scenario_exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).groupBy("scenario", F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("products"))


@query("scenario_income", f"WITH {PRODUCTS} SELECT scenario, product, bank, rate::DOUBLE AS rate, income::DOUBLE AS income FROM judged WHERE reason IS NULL")
def scenario_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).where("reason is null").select("scenario", "product", "bank", F.col("rate").cast("double").alias("rate"), F.col("income").cast("double").alias("income"))


@query(
    "scenario_best_by_bank",
    f"""WITH {PRODUCTS}, r AS (SELECT *, row_number() OVER (PARTITION BY scenario, bank ORDER BY income DESC, product) AS n FROM judged WHERE reason IS NULL)
    SELECT scenario, bank, product, rate::DOUBLE AS rate, income::DOUBLE AS income FROM r WHERE n = 1""",
)
def scenario_best_by_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scenarios.best_by_bank(judged(spark, sf_dir))
    return rows.select("scenario", "bank", "product", F.col("rate").cast("double").alias("rate"), F.col("income").cast("double").alias("income"))


@query("scenario_missing_banks", f"WITH {PRODUCTS} SELECT s.scenario, b.bank FROM (SELECT DISTINCT scenario FROM judged) s, (SELECT DISTINCT bank FROM products) b WHERE NOT EXISTS (SELECT 1 FROM judged j WHERE j.reason IS NULL AND j.scenario = s.scenario AND j.bank = b.bank AND j.rate > 16)")
def scenario_missing_banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir)
    strict = rows.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("rate") > 16), None).otherwise(F.coalesce("reason", F.lit("rate_too_low"))))
    return scenarios.banks_without(strict, products(spark, sf_dir))


TIERS = "tiers(tier, min_sum, term, days, rate) AS (VALUES (1, 0, 1, 31, 9.0), (1, 0, 2, 91, 9.5), (1, 0, 3, 183, 10.0), (2, 100000, 1, 31, 10.0), (2, 100000, 2, 91, 0.0), (2, 100000, 3, 365, 11.5), (3, 250000, 1, 61, 12.0), (3, 250000, 2, 183, 12.5), (3, 250000, 3, 365, 13.0))"


@query(
    "rate_table_lookup",
    f"""WITH {TIERS}, points AS (SELECT o_orderkey AS point, o_totalprice AS amount, (10 + o_custkey % 400)::INT AS days FROM orders),
    t AS (SELECT p.*, (SELECT max(tier) FROM tiers WHERE min_sum <= p.amount) AS tier FROM points p),
    e AS (SELECT t.point, arg_max(r.rate, r.term) AS rate FROM t JOIN tiers r ON r.tier = t.tier AND r.days <= t.days GROUP BY 1)
    SELECT t.point, t.amount, t.days, t.tier, CASE WHEN t.days BETWEEN 31 AND 365 AND e.rate > 0 THEN e.rate::DOUBLE END AS rate, CASE WHEN t.days BETWEEN 31 AND 365 AND e.rate > 0 THEN t.days END AS used_days FROM t LEFT JOIN e USING (point)""",
)
def rate_table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = spark.sql(f"WITH {TIERS.replace('(VALUES', '(SELECT * FROM VALUES')} SELECT tier, min_sum, term, days, CAST(rate AS DOUBLE) AS rate FROM tiers")
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point"), F.col("o_totalprice").alias("amount"), (10 + F.col("o_custkey") % 400).cast("int").alias("days"))
    return scenarios.rate_lookup(points, rates)


LOANS = "loans AS (SELECT o_orderkey AS loan, o_totalprice AS principal, (o_custkey % 25)::DOUBLE AS rate, (6 + o_orderkey % 54)::INT AS months FROM orders)"


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("loan"), F.col("o_totalprice").alias("principal"), (F.col("o_custkey") % 25).cast("double").alias("rate"), (6 + F.col("o_orderkey") % 54).cast("int").alias("months"))


_ANNUITY = "CASE WHEN rate = 0 THEN principal / months ELSE principal * (rate / 1200) / (1 - pow(1 + rate / 1200, -months)) END"


@query("annuity_overpayment", f"WITH {LOANS} SELECT loan, round(({_ANNUITY}) + 1e-7, 2) AS payment, round(({_ANNUITY}) * months - principal + 1e-7, 2) AS overpayment FROM loans")
def annuity_overpayment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col(x) for x in ("principal", "rate", "months")]
    return loans(spark, sf_dir).select("loan", finance.to_cents(finance.annuity(*c)).alias("payment"), finance.to_cents(finance.overpayment(*c)).alias("overpayment"))


@query("deposit_capitalisation", f"WITH {LOANS} SELECT loan, round(principal * (rate / 1200) * months + 1e-7, 2) AS simple, round(principal * (pow(1 + rate / 1200, months) - 1) + 1e-7, 2) AS capitalised, round((pow(1 + rate / 1200, 12) - 1) * 100, 3) AS effective FROM loans")
def deposit_capitalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col(x) for x in ("principal", "rate", "months")]
    return loans(spark, sf_dir).select("loan", finance.to_cents(finance.deposit_income(*c)).alias("simple"), finance.to_cents(finance.deposit_income(*c, capitalised=True)).alias("capitalised"), F.round(finance.effective_rate(F.col("rate")), 3).alias("effective"))


@query(
    "card_benefit_cost",
    """SELECT c_custkey, round(12 * least(abs(c_acctbal) * 5.0 / 100, 1000.0) + abs(c_acctbal) * 10.0 / 100 - 12 * 100.0 + 1e-7, 2) AS debit_benefit,
    round(12 * 99.0 + CASE WHEN c_acctbal > 0 THEN greatest(c_acctbal * 3.9 / 100, 390.0) ELSE 0.0 END + 1e-7, 2) AS credit_cost FROM customer""",
)
def card_benefit_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.lit
    balance = F.abs("c_acctbal")
    debit = finance.debit_card_benefit(balance, n(5.0), n(1000.0), balance, n(10.0), n(100.0))
    return table(spark, sf_dir, "customer").select("c_custkey", finance.to_cents(debit).alias("debit_benefit"), finance.to_cents(finance.credit_card_cost(n(99.0), F.col("c_acctbal"), n(3.9), n(390.0))).alias("credit_cost"))


@query("implied_rate", f"WITH {LOANS} SELECT loan, round(rate, 4) AS implied FROM loans WHERE rate > 0")
def implied_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate found from the payment is the rate that made the payment."""
    payment = F.when(F.col("rate") == 0, F.col("principal") / F.col("months")).otherwise(finance.annuity(F.col("principal"), F.col("rate"), F.col("months")))
    return loans(spark, sf_dir).where("rate > 0").select("loan", F.round(finance.implied_rate(F.col("principal"), payment, F.col("months")), 4).alias("implied"))


@query("payroll_potential", "SELECT c_custkey, (10 + c_custkey % 500)::BIGINT AS employees, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE round((10 + c_custkey % 500) * (40000.0 + c_nationkey * 1000) * 12 * 0.5 * 0.02, 2) END::DOUBLE AS potential FROM customer")
def payroll_potential(spark: SparkSession, sf_dir: str) -> DataFrame:
    staff = 10 + F.col("c_custkey") % 500
    salaries = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), (F.lit(40000.0) + F.col("n_nationkey") * 1000).alias("salary"))
    rows = table(spark, sf_dir, "customer").join(salaries, "c_nationkey", "left")
    return rows.select("c_custkey", staff.alias("employees"), F.round(finance.payroll_potential(staff, F.col("salary")), 2).alias("potential"))


@query(
    "id_checksum",
    """WITH d AS (SELECT c_custkey, lpad((c_custkey * 7919 % 10000000000)::VARCHAR, 10, '0') AS id FROM customer),
    s AS (SELECT *, list_sum(list_transform(range(1, 10), lambda i: id[i]::INT * [2, 4, 10, 3, 5, 9, 4, 6, 8][i])) AS t FROM d)
    SELECT c_custkey, id, t % 11 % 10 = id[10]::INT AS valid FROM s""",
)
def id_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ratelens.functions.text import tax_id_valid

    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lpad((F.col("c_custkey") * 7919 % 10000000000).cast("string"), 10, "0").alias("id"))
    return rows.withColumn("valid", tax_id_valid(F.col("id")))


@query(
    "unit_inheritance",
    "SELECT o_custkey, o_orderkey, first_value(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM orders",
)
def unit_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("u"))
    return scenarios.inherit_units(rows, "o_custkey", "o_orderkey", "u").select("o_custkey", "o_orderkey", F.col("unit_inherited").alias("unit"))
