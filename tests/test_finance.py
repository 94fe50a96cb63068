"""Value-exact expectations of the formulas and of the rate table."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ratelens.functions import finance
from ratelens.operators import scenarios


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("amount,rate,days,income", [("100000", 12, 365, "12000.00"), ("100000", 15, 91, "3739.73"), ("500000", "14.1", 365, "70500.00"), ("0.01", 10, 1, "0.00")])
def test_simple_interest(spark, amount, rate, days, income):
    got = one(spark, finance.simple_interest(F.lit(Decimal(amount)), F.lit(Decimal(str(rate))), F.lit(days)))
    assert got == Decimal(income)


def test_simple_interest_refuses_negatives_and_nulls(spark):
    assert one(spark, finance.simple_interest(F.lit(Decimal("-1")), F.lit(Decimal(1)), F.lit(1))) is None
    assert one(spark, finance.simple_interest(F.lit(None), F.lit(Decimal(1)), F.lit(1))) is None


@pytest.mark.parametrize("months,days", [(3, 91), (6, 183), (12, 365)])
def test_months_to_days(spark, months, days):
    assert one(spark, finance.months_to_days(F.lit(months))) == days


def test_annuity_deposit_effective(spark):
    n = F.lit
    assert one(spark, finance.annuity(n(300000.0), n(20.0), n(36))) == pytest.approx(11149.07, abs=0.01)
    assert one(spark, finance.annuity(n(120000.0), n(0.0), n(12))) == 10000
    assert one(spark, finance.deposit_income(n(1e6), n(14.0), n(12))) == pytest.approx(140000)
    assert one(spark, finance.deposit_income(n(1e6), n(14.0), n(12), capitalised=True)) == pytest.approx(149342, abs=1)
    assert one(spark, finance.effective_rate(n(14.0))) == pytest.approx(14.934, abs=0.001)


def test_cards(spark):
    n = F.lit
    assert one(spark, finance.debit_card_benefit(n(30000.0), n(5.0), n(1000.0), n(50000.0), n(10.0), n(100.0))) == 15800
    assert one(spark, finance.credit_card_cost(n(0.0), n(10000.0), n(3.9), n(390.0))) == 390
    assert one(spark, finance.credit_card_cost(n(99.0), n(10000.0), n(3.9), n(390.0))) == 1578
    assert one(spark, finance.credit_card_cost(n(99.0), n(0.0), n(3.9), n(390.0))) == 1188


def test_implied_rate_inverts_annuity(spark):
    assert one(spark, finance.implied_rate(F.lit(300000.0), F.lit(11149.07), F.lit(36))) == pytest.approx(20.0, abs=0.001)
    assert one(spark, finance.implied_rate(F.lit(1000.0), F.lit(900.0), F.lit(12))) is None
    assert one(spark, finance.implied_rate(F.lit(1000.0), F.lit(50.0), F.lit(20))) is None  # payments equal the loan
    for rate, months in ((0.02, 6), (0.5, 360), (13.8, 1), (60.0, 84), (198.0, 3), (198.0, 360)):
        payment = finance.annuity(F.lit(250000.0), F.lit(rate), F.lit(months))
        assert one(spark, finance.implied_rate(F.lit(250000.0), payment, F.lit(months))) == pytest.approx(rate, abs=1e-4)


def test_payroll(spark):
    assert one(spark, finance.payroll_potential(F.lit(100), F.lit(100000.0), share=1.0, package_yield=1.0)) == 120_000_000
    assert one(spark, finance.payroll_potential(F.lit(None).cast("int"), F.lit(100000.0))) is None


def test_rate_table(spark):
    table = spark.createDataFrame([(1, 0, 1, 31, 9.0), (1, 0, 2, 91, 9.5), (2, 1000, 1, 31, 10.0), (2, 1000, 2, 91, 0.0)], "tier int, min_sum int, term int, days int, rate double")
    points = spark.createDataFrame([(1, 500, 91), (2, 500, 60), (3, 1500, 31), (4, 1500, 91), (5, 500, 30), (6, 500, 92)], "point int, amount int, days int")
    loose = {r.point: (r.tier, r.rate, r.used_days) for r in scenarios.rate_lookup(points, table).collect()}
    assert loose == {1: (1, 9.5, 91), 2: (1, 9.0, 60), 3: (2, 10.0, 31), 4: (2, None, None), 5: (1, None, None), 6: (1, None, None)}
    fixed = {r.point: r.used_days for r in scenarios.rate_lookup(points, table, fixed_terms=True).collect()}
    assert fixed[2] == 31


def test_admission_gives_the_first_reason(spark):
    products = spark.createDataFrame(
        [(1, 1, None, None, None, None, None, None, None), (2, 1, "USD", 5.0, 1, 400, None, 0, 9), (3, 1, "RUB", None, 1, 400, None, 0, 9), (4, 1, "RUB", 5.0, None, None, None, 0, 9), (5, 1, "RUB", 5.0, 1, 50, None, 0, 9), (6, 1, "RUB", 5.0, None, None, [93], 200, 900), (7, 1, "RUB", 5.0, 1, 400, None, 0, 50), (8, 1, "RUB", 5.0, 1, 400, None, 0, 900)],
        "product int, bank int, currency string, rate double, min_days int, max_days int, terms array<int>, min_amount int, max_amount int",
    )
    sets = spark.createDataFrame([("s", 100.0, 91, "RUB")], "scenario string, amount double, days int, currency string")
    got = {r["product"]: r.reason for r in scenarios.admission(products, sets).collect()}
    assert got == {1: "currency_unknown", 2: "currency_differs", 3: "rate_unknown", 4: "term_unknown", 5: "term_not_allowed", 6: "amount_below_minimum", 7: "amount_above_maximum", 8: None}


def test_nearest_term(spark):
    terms = F.array(F.lit(88), F.lit(94), F.lit(180))
    assert one(spark, scenarios.nearest_term(F.lit(91), terms)) == 88
    assert one(spark, scenarios.nearest_term(F.lit(120), terms)) is None
