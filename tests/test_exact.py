"""Exact rules as columns, at their edges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from verdex.operators import exact as E

D = dt.date


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x)


def test_checks_look_at_the_present_position(spark):
    check = lambda restricted, position, qty, price: one(spark, E.pre_trade(lit(restricted), lit(position), lit(qty), lit(price), 10000, 500000))
    assert check(True, 0, 1, 1.0) == "restricted"
    assert check(False, 8000, 2000, 1.0) == "accept"  # just the limit
    assert check(False, 8000, 2001, 1.0) == "position"
    assert check(False, 8000, 500, 1000.0) == "accept" and check(False, 8000, 500, 1000.5) == "notional"
    assert check(False, 15000, 9000, 910.0) == "position"  # before the notional


@pytest.mark.parametrize(("kind", "settle", "want"), [("call", 100.01, True), ("call", 100.005, False), ("put", 99.99, True), ("put", 100.0, False), ("call", 99.0, False)])
def test_options(spark, kind, settle, want):
    assert one(spark, E.auto_exercised(lit(kind), lit(settle), lit(100.0))) is want


def test_time_rules(spark):
    refund = lambda a, b: one(spark, E.prorated_refund(lit(1200.0), lit(a), lit(b)))
    assert refund(D(2026, 1, 1), D(2026, 1, 1)) == 1175 and refund(D(2026, 1, 1), D(2026, 1, 31)) == 1075 and refund(D(2026, 1, 1), D(2026, 2, 1)) == 975
    assert refund(D(2026, 1, 1), D(2027, 6, 1)) == 0
    fee = lambda n: one(spark, E.late_fee(lit(100.0), lit(D(2026, 1, 1)), lit(D(2026, 1, 1) + dt.timedelta(n))))
    assert [fee(n) for n in (-3, 0, 1, 7, 8, 400)] == [0, 0, 1.5, 1.5, 3.0, 12.0]
    assert [one(spark, c) for c in E.shifted(lit(30), lit(-90))] == [1380, -1] and [one(spark, c) for c in E.shifted(lit(1430), lit(330))] == [320, 1]
    assert one(spark, E.notice_in_time(lit(D(2026, 1, 1)), lit(D(2026, 1, 31)), 30)) and not one(spark, E.notice_in_time(lit(D(2026, 1, 2)), lit(D(2026, 1, 31)), 30))
    assert one(spark, E.presented_in_time(lit(D(2026, 1, 22)), lit(D(2026, 1, 1)), lit(D(2026, 3, 1)), 21)) and not one(spark, E.presented_in_time(lit(D(2026, 1, 22)), lit(D(2026, 1, 1)), lit(D(2026, 1, 20)), 21))


def test_money(spark):
    assert one(spark, E.instalment(lit(1200.0), lit(0.0), lit(12))) == 100 and one(spark, E.instalment(lit(1000.0), lit(12.0), lit(1))) == pytest.approx(1010)
    assert one(spark, E.exchanged(lit(115.0), 15, lit(2.0), lit(0.01))) == pytest.approx(198)
    assert one(spark, E.liquidation_price(lit(100.0), lit(10), 0.005, "long")) == pytest.approx(90.5) and one(spark, E.liquidation_price(lit(100.0), lit(10), 0.005, "short")) == pytest.approx(109.5)
    assert one(spark, E.net_pnl(lit(10.0), lit(11.0), lit(100), 10)) == pytest.approx(100 - 2.1)
    accrued = lambda c: one(spark, E.accrued_interest(lit(360000.0), 0.01, lit(D(2026, 1, 31)), lit(D(2026, 3, 31)), c))
    assert accrued("act/360") == pytest.approx(590) and accrued("act/365") == pytest.approx(360000 * 0.01 * 59 / 365) and accrued("30E/360") == pytest.approx(600)
    assert one(spark, E.concentration_allowed(lit(20.0), lit(5.0), lit(100.0), 0.25)) and not one(spark, E.concentration_allowed(lit(20.0), lit(5.1), lit(100.0), 0.25))
    assert not one(spark, E.margin_called(lit(100.0), lit(75.0), 0.25)) and one(spark, E.margin_called(lit(100.0), lit(75.1), 0.25))
    band = lambda p, r: one(spark, E.within_band(lit(p), lit(r), ((10, 0.2), (100, 0.1)), 0.05))
    assert band(12.0, 10.0) is False and band(11.0, 10.0) and band(6.0, 5.0) and not band(6.1, 5.0) and band(105.0, 100.0) and not band(105.1, 100.0)


def test_conditions(spark):
    none = F.lit(None).cast("boolean")
    assert one(spark, E.permitted(lit(True), none)) and not one(spark, E.permitted(none, lit(False))) and not one(spark, E.permitted(lit(True), lit(True)))
    assert [one(spark, E.tier(lit(x), (10, 20))) for x in (10, 11, 20, 21)] == ["tier0", "tier1", "tier1", "tier2"] and one(spark, E.tier(lit(99), (10,), lit(True))) == "exempt"
    assert [one(spark, E.risk_level([lit(i < n) for i in range(3)], lit(False))) for n in (0, 1, 2, 3)] == [0, 1, 2, 2] and one(spark, E.risk_level([none], lit(True))) == 3
    assert one(spark, E.posterior(lit(0.01), 0.9, lit(0.05))) == pytest.approx(0.009 / (0.009 + 0.0495))
    assert [one(spark, c) for c in E.count_classes(lit(0.5), lit(0.5))] == [0.25, 0.5, 0.25]
    assert not one(spark, E.loan_approved(lit(0.3), 0.36, [none])) and one(spark, E.loan_approved(lit(0.36), 0.36, [lit(True)]))
