"""Exact rules: dates, money, probability and first-match clauses, over cases from orders, line items, parts and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdex.operators import exact as E
from verdex.operators import rules as R
from verdex.plans.dialect import Duck, Spark, doubles
from verdex.plans.registry import query


def case(d: Spark) -> str:
    """One case per order with derived columns (RUL-00): a first line item by a total order, amounts, dates and small integers."""
    return f"""l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS rn FROM {d.t('lineitem')}),
c AS (SELECT o_orderkey AS id, o_totalprice AS total, {d.date('o_orderdate')} AS d1, {d.date('l_shipdate')} AS d2, l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_tax AS tax,
  o_orderpriority AS prio, o_orderstatus AS status, o_custkey AS cust, l_returnflag AS flag, o_orderkey % 12 AS k, o_orderkey % 7 AS m, l_extendedprice / greatest(l_quantity, 1) AS unit
  FROM {d.t('orders')} JOIN l ON o_orderkey = l_orderkey AND rn = 1)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(doubles(f"WITH {case(Spark(sf_dir))} SELECT * FROM c"))


def rule(name: str, **columns: Callable[[], Column]):
    """Register a rule over cases: the columns come from the operators; the function that is decorated gives the select list
    of the other engine, written apart."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return cases(spark, sf_dir).select("id", *(make().alias(n) for n, make in columns.items()))

        run.__doc__ = f.__doc__
        query(name, doubles(f"WITH {case(Duck())} SELECT id, {f(Duck())} FROM c"))(run)
        return f

    return add


C = F.col
#: RUL-01, RUL-02, RUL-04: three conditions as data.
THREE = [("total", ">=", 150000), ("status", "not in", ("F", "P"))]


def _three() -> list[Column]:
    return [*map(R.condition, THREE), C("d2") > C("d1")]


def _shift() -> tuple[Column, Column]:
    return E.shifted(C("k") * 60 + C("m") * 7, ((5.5 - (C("m") - 3)) * 60).cast("int"))


def _classes() -> tuple[Column, Column, Column]:
    return E.count_classes(0.05 + C("k") / 50.0, 0.1 + C("m") / 50.0)


def _accrued(convention: str) -> Column:
    return F.round(E.accrued_interest(C("total"), 0.05, C("d1"), C("d2"), convention), 8)


@rule("numeric_and_enum", large=lambda: R.condition(THREE[0]), final=lambda: R.condition(("status", "in", ("F", "P"))), later=lambda: C("d2") > C("d1"), all_true=lambda: R.holding(_three(), 3), any_true=lambda: R.holding(_three(), 1), two_true=lambda: R.holding(_three(), 2))
def numeric_and_enum(d: Spark) -> str:
    """RUL-01, RUL-02, RUL-04, RUL-05: comparisons, membership, dates before and after, at least two of three."""
    t = "(CASE WHEN total >= 150000 THEN 1 ELSE 0 END + CASE WHEN status NOT IN ('F', 'P') THEN 1 ELSE 0 END + CASE WHEN d2 > d1 THEN 1 ELSE 0 END)"
    return f"total >= 150000 AS large, status IN ('F', 'P') AS final, d2 > d1 AS later, {t} = 3 AS all_true, {t} > 0 AS any_true, {t} >= 2 AS two_true"


@rule("permit_exception", permitted=lambda: E.permitted((C("total") < 200000) & (C("status") == "O"), (C("prio") == "1-URGENT") & (C("qty") > 25)))
def permit_exception(d: Spark) -> str:
    """RUL-06: permitted by the base rule unless the exception holds."""
    return "total < 200000 AND status = 'O' AND NOT (prio = '1-URGENT' AND qty > 25) AS permitted"


@rule("first_match_route", route=lambda: R.first_match([([("prio", "=", "1-URGENT"), ("total", ">", 100000)], "desk_a"), ([("status", "=", "F")], "archive"), ([("disc", ">=", 0.05)], "pricing")], "general"))
def first_match_route(d: Spark) -> str:
    """RUL-07, JOIN-16: the first line that holds, else the default."""
    return "CASE WHEN prio = '1-URGENT' AND total > 100000 THEN 'desk_a' WHEN status = 'F' THEN 'archive' WHEN disc >= 0.05 THEN 'pricing' ELSE 'general' END AS route"


@rule("tier_table", tier=lambda: E.tier(C("total"), (50000, 100000, 200000, 300000), (C("flag") == "R") & (C("qty") < 5)))
def tier_table(d: Spark) -> str:
    """RUL-08: tier is the number of cuts strictly below the value; an exception exempts."""
    cuts = " + ".join(f"CASE WHEN total > {x} THEN 1 ELSE 0 END" for x in (50000, 100000, 200000, 300000))
    return f"CASE WHEN flag = 'R' AND qty < 5 THEN 'exempt' ELSE concat('tier', cast({cuts} as string)) END AS tier"


@rule("risk_matrix", risk=lambda: E.risk_level([C("total") > 200000, C("disc") > 0.07, C("qty") > 40], (C("prio") == "1-URGENT") & (C("status") == "P")))
def risk_matrix(d: Spark) -> str:
    """RUL-09: none, one or more findings give 0, 1, 2; a critical one gives 3."""
    return "CASE WHEN prio = '1-URGENT' AND status = 'P' THEN 3 ELSE least(2, CASE WHEN total > 200000 THEN 1 ELSE 0 END + CASE WHEN disc > 0.07 THEN 1 ELSE 0 END + CASE WHEN qty > 40 THEN 1 ELSE 0 END) END AS risk"


@rule("renewal_notice", in_time=lambda: E.notice_in_time(C("d1"), C("d2"), 30))
def renewal_notice(d: Spark) -> str:
    """TMP-03: notice is in time if so many days are left."""
    return f"{d.days('d1', 'd2')} >= 30 AS in_time"


@rule("prorated_refund", refund=lambda: F.round(E.prorated_refund(C("total"), C("d1"), C("d2")), 4))
def prorated_refund(d: Spark) -> str:
    """TMP-04: months begun of 30 days are kept, and a fee."""
    return f"round(greatest(0, total * (12 - ceil(abs({d.days('d1', 'd2')}) / 30.0)) / 12 - 25), 4) AS refund"


@rule("time_zone_shift", minute=lambda: _shift()[0], day_shift=lambda: _shift()[1])
def time_zone_shift(d: Spark) -> str:
    """TMP-05: local time under fractional offsets, in minutes of the day and days shifted."""
    t = "(k * 60 + m * 7 + cast((5.5 - (m - 3)) * 60 as int))"
    return f"cast({t} - floor({t} / 1440.0) * 1440 as bigint) AS minute, cast(floor({t} / 1440.0) as bigint) AS day_shift"


@rule("late_fee", fee=lambda: F.round(E.late_fee(C("total"), C("d1"), C("d2")), 5))
def late_fee(d: Spark) -> str:
    """TMP-06: weeks begun times the rate, capped."""
    return f"round(total * least(ceil(greatest({d.days('d1', 'd2')}, 0) / 7.0) * 1.5, 12.0) / 100, 5) AS fee"


@rule("bayes", posterior=lambda: F.round(E.posterior((C("k") + 1) / 100.0, 0.9, (C("m") + 1) / 50.0), 7))
def bayes(d: Spark) -> str:
    """PRB-04: posterior of a positive test."""
    b, t, f = "((k + 1) / 100.0)", "0.9", "((m + 1) / 50.0)"
    return f"round({b} * {t} / ({b} * {t} + (1 - {b}) * {f}), 7) AS posterior"


@rule("count_classes", p_none=lambda: _classes()[0], p_one=lambda: _classes()[1], p_two=lambda: _classes()[2])
def count_classes(d: Spark) -> str:
    """PRB-06: none, one, two or more; the last is what the rounded others leave."""
    p, q = "(0.05 + k / 50.0)", "(0.1 + m / 50.0)"
    none, one = f"round((1 - {p}) * (1 - {q}), 4)", f"round({p} * (1 - {q}) + {q} * (1 - {p}), 4)"
    return f"{none} AS p_none, {one} AS p_one, round(1 - {none} - {one}, 4) AS p_two"


@rule("annuity", instalment=lambda: F.round(E.instalment(C("total"), 3 + C("k"), 12 + C("m") * 6), 4))
def annuity(d: Spark) -> str:
    """FIN-01: monthly instalment."""
    i = "((3 + k) / 1200.0)"
    return f"round(total * {i} / (1 - power(1 + {i}, -(12 + m * 6))), 4) AS instalment"


@rule("fx_fee_spread", received=lambda: F.round(E.exchanged(C("total"), 15, 1 + C("k") / 100.0, C("m") / 1000.0), 8))
def fx_fee_spread(d: Spark) -> str:
    """FIN-02: fee first, then the spread on the mid rate."""
    return "round((total - 15) * (1 + k / 100.0) * (1 - m / 1000.0), 8) AS received"


@rule("debt_to_income", approved=lambda: E.loan_approved(C("price") / C("total"), 0.36, [C("k") >= 3, C("m") != 0]))
def debt_to_income(d: Spark) -> str:
    """FIN-03: all three conditions."""
    return "price / total <= 0.36 AND k >= 3 AND m <> 0 AS approved"


@rule("liquidation", long_at=lambda: F.round(E.liquidation_price(F.floor("unit"), 2 + C("k"), 0.005, "long"), 9), short_at=lambda: F.round(E.liquidation_price(F.floor("unit"), 2 + C("k"), 0.005, "short"), 9), hit=lambda: C("price") / C("qty") <= E.liquidation_price(C("unit"), 2 + C("k"), 0.005, "long"))
def liquidation(d: Spark) -> str:
    """FIN-06: liquidation prices of a leveraged long and short."""
    return "round(floor(unit) * (1 - 1.0 / (2 + k) + 0.005), 9) AS long_at, round(floor(unit) * (1 + 1.0 / (2 + k) - 0.005), 9) AS short_at, price / qty <= unit * (1 - 1.0 / (2 + k) + 0.005) AS hit"


@query(
    "pre_trade_checks",
    f"""WITH {case(Duck())}, p AS (SELECT c.*, coalesce((SELECT sum(e.qty) FROM c e WHERE e.cust = c.cust AND (e.d1 < c.d1 OR e.d1 = c.d1 AND e.id < c.id)), 0) AS position FROM c)
SELECT id, position, CASE WHEN prio = '5-LOW' THEN 'restricted' WHEN position + qty > 150 THEN 'position' WHEN qty * unit > 60000 THEN 'notional' ELSE 'accept' END AS check_result FROM p""",
)
def pre_trade_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIN-07: restricted, then the position that the order would make on top of what its customer's earlier ones have, then notional."""
    earlier = Window.partitionBy("cust").orderBy("d1", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = cases(spark, sf_dir).withColumn("position", F.coalesce(F.sum("qty").over(earlier), F.lit(0.0)))
    return rows.select("id", "position", E.pre_trade(C("prio") == "5-LOW", C("position"), C("qty"), C("unit"), 150, 60000).alias("check_result"))


@rule("net_pnl", pnl=lambda: F.round(E.net_pnl(C("unit"), C("unit") * 1.02, C("qty"), 5), 5))
def net_pnl(d: Spark) -> str:
    """FIN-08: gain less costs in basis points on both sides."""
    return "round((unit * 1.02 - unit) * qty - (qty * unit + qty * unit * 1.02) * 5 / 10000, 5) AS pnl"


@rule("option_exercise", exercised=lambda: E.auto_exercised(F.lit("call"), F.round(C("unit") - C("k") * 10, 2), F.lit(1500.0)), put=lambda: E.auto_exercised(F.lit("put"), F.round(C("unit"), 2), 1200.0 + C("k") * 10))
def option_exercise(d: Spark) -> str:
    """FIN-10: exercised if a cent or more in the money, with room for rounding."""
    return "round(unit - k * 10, 2) - 1500.0 >= 0.01 - 1e-9 AS exercised, (1200.0 + k * 10) - round(unit, 2) >= 0.01 - 1e-9 AS put"


@rule("margin_call", called=lambda: E.margin_called(C("price"), C("total") * 0.2, 0.25))
def margin_call(d: Spark) -> str:
    """TRD-01: equity strictly under the requirement."""
    return "price - total * 0.2 < 0.25 * price AS called"


@rule("price_band", inside=lambda: E.within_band(C("unit"), 900.0 + C("k") * 70, ((1000, 0.2), (1500, 0.1)), 0.05))
def price_band(d: Spark) -> str:
    """TRD-04: 20, 10 or 5 percent by reference price, with room for rounding."""
    return "abs(unit - (900.0 + k * 70)) <= (900.0 + k * 70) * CASE WHEN 900.0 + k * 70 < 1000 THEN 0.2 WHEN 900.0 + k * 70 < 1500 THEN 0.1 ELSE 0.05 END + 1e-9 AS inside"


@rule("accrued_interest", act360=lambda: _accrued("act/360"), act365=lambda: _accrued("act/365"), e30=lambda: _accrued("30E/360"))
def accrued_interest(d: Spark) -> str:
    """TRD-06: actual/360, actual/365, 30E/360."""
    e = "((year(d2) - year(d1)) * 360 + (month(d2) - month(d1)) * 30 + least(day(d2), 30) - least(day(d1), 30))"
    n = d.days("d1", "d2")
    return f"round(total * 0.05 * {n} / 360, 8) AS act360, round(total * 0.05 * {n} / 365, 8) AS act365, round(total * 0.05 * {e} / 360, 8) AS e30"


@rule("issuer_concentration", allowed=lambda: E.concentration_allowed(C("price"), C("k") * 1000, C("total"), 0.25))
def issuer_concentration(d: Spark) -> str:
    """TRD-07."""
    return "(price + k * 1000) / total <= 0.25 + 1e-12 AS allowed"


@rule("lc_presentation", compliant=lambda: E.presented_in_time(F.date_add("d1", (C("k") + C("m")).cast("int")), C("d2"), F.date_add("d1", 90), 21))
def lc_presentation(d: Spark) -> str:
    """TRD-10: documents by the earlier of shipment plus days and expiry."""
    return f"{d.add_days('d1', '(k + m)')} <= least({d.add_days('d2', '21')}, {d.add_days('d1', '90')}) AS compliant"
