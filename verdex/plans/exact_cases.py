"""Exact rules over literal parameter rows, with the rows that they must give, and over tables against SQL written apart."""

from __future__ import annotations

import datetime as dt
import itertools
import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.operators import calendar as C
from verdex.operators import exact as E
from verdex.operators import textops as X
from verdex.plans import rules
from verdex.plans.cases import cases
from verdex.plans.dialect import Duck, Spark, doubles
from verdex.plans.registry import query
from verdex.sources.tables import table

D = dt.date
PAIRS = [(D(2026, 3, 2), D(2026, 3, 2)), (D(2026, 3, 6), D(2026, 3, 9)), (D(2026, 3, 7), D(2026, 3, 8)), (D(2026, 3, 9), D(2026, 3, 6)), (D(2026, 1, 31), D(2026, 3, 1)), (D(2025, 12, 25), D(2026, 1, 5)), (D(2026, 5, 3), D(2026, 4, 4))]


def _business_days(a: D, b: D) -> int:
    step, n = (1 if b >= a else -1), 0
    while a != b:
        a += dt.timedelta(step)
        n += step * (a.weekday() < 5)
    return n


@cases("business_days", "a date, b date, n bigint", [(a, b, _business_days(a, b)) for a, b in PAIRS])
def business_days(spark: SparkSession) -> DataFrame:
    """RUL-03: weekend ends, reversed dates, month and year ends."""
    return spark.createDataFrame(PAIRS, "a date, b date").select("a", "b", C.business_days(F.col("a"), F.col("b")).alias("n"))


FILINGS = [(D(2026, 3, 2), 5, []), (D(2026, 3, 6), 1, [D(2026, 3, 9)]), (D(2026, 3, 7), 3, [D(2026, 3, 10), D(2026, 3, 11), D(2026, 3, 14)]), (D(2025, 12, 23), 10, [D(2025, 12, 25), D(2025, 12, 26), D(2026, 1, 1)]), (D(2026, 3, 2), 2, None)]


def _nth(day: D, n: int, off: list) -> D:
    while n:
        day += dt.timedelta(1)
        n -= day.weekday() < 5 and day not in off
    return day


@cases("business_deadlines", "start date, n bigint, due date", [(s, n, _nth(s, n, h or [])) for s, n, h in FILINGS])
def business_deadlines(spark: SparkSession) -> DataFrame:
    """TMP-01, FIN-09: any number of days, any holidays, one on the due day and one on a weekend among them."""
    rows = spark.createDataFrame(FILINGS, "start date, n bigint, off array<date>")
    return rows.select("start", "n", C.add_business_days(F.col("start"), F.col("n"), F.col("off")).alias("due"))


T = dt.datetime
SLA = [(T(2026, 3, 6, 16, 30), 8), (T(2026, 3, 6, 17, 0), 8), (T(2026, 3, 7, 12, 15), 4), (T(2026, 3, 8, 8, 0), 16), (T(2026, 3, 4, 8, 45), 8), (T(2026, 3, 4, 9, 0), 8), (T(2026, 3, 5, 13, 45), 12), (T(2026, 3, 5, 18, 0), 4), (T(2026, 3, 2, 9, 0), 40), (T(2026, 3, 2, 16, 59), 41)]


def _deadline(t: T, hours: int) -> T:
    left = hours * 60
    while left:
        if t.weekday() >= 5 or t.hour >= 17:
            t = T(t.year, t.month, t.day, 9) + dt.timedelta(1)
        elif t.hour < 9:
            t = t.replace(hour=9, minute=0)
        else:
            t, left = t + dt.timedelta(minutes=1), left - 1
    return t


@cases("sla_deadlines", "opened timestamp, hours bigint, due timestamp", [(t, h, _deadline(t, h)) for t, h in SLA])
def sla_deadlines(spark: SparkSession) -> DataFrame:
    """TMP-02: opened after hours, on a weekend, at 17:00; a clock that is full at 17:00 stops there."""
    rows = spark.createDataFrame(SLA, "opened timestamp_ntz, hours bigint")
    return rows.select("opened", "hours", C.sla_deadline(F.col("opened"), F.col("hours")).alias("due"))


@query("sla_clock", """WITH e AS (SELECT event_id, date_trunc('minute', ts) AS o, (event_id % 4 + 1) * 240 AS need, ts + to_minutes(CAST(event_id % 5000 AS INT)) AS resolved FROM events),
d AS (SELECT event_id, need, resolved, CAST(o AS DATE) + i::INT AS day, CASE WHEN isodow(CAST(o AS DATE) + i::INT) > 5 THEN 0 WHEN i = 0 THEN greatest(0, 1020 - greatest(540, hour(o) * 60 + minute(o))) ELSE 480 END AS cap FROM e, range(0, 9) t(i)),
c AS (SELECT *, sum(cap) OVER (PARTITION BY event_id ORDER BY day) AS run FROM d),
f AS (SELECT event_id, resolved, need, min_by(day, day) AS day, min(run) AS run FROM c WHERE run >= need GROUP BY ALL)
SELECT event_id, day + to_minutes(CAST(1020 - (run - need) AS INT)) AS due, resolved > day + to_minutes(CAST(1020 - (run - need) AS INT)) AS breach FROM f""")  # fmt: skip
def sla_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TMP-02: of every event the deadline of 4, 8, 12 or 16 business hours, and whether it was resolved after it."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", C.sla_deadline(F.col("ts"), (F.col("event_id") % 4 + 1) * 4).alias("due"))
    return e.select("event_id", "due", (F.timestamp_add("MINUTE", (F.col("event_id") % 5000).cast("int"), F.col("ts")) > F.col("due")).alias("breach"))


INSPECTIONS = [(30, 5, 4, 1), (30, 5, 4, 2), (10, 3, 9, 1), (8, 1, 2, 2), (12, 0, 3, 1), (20, 6, 6, 0), (25, 8, 3, 3)]


def _inspect(n: int, d: int, s: int, c: int) -> float:
    return round(float(sum(Fraction(math.comb(d, k) * math.comb(n - d, s - k), math.comb(n, s)) for k in range(c, min(d, s) + 1))), 4)


@cases("hypergeometric", "population bigint, bad bigint, sample bigint, c bigint, p double", [(*x, _inspect(*x)) for x in INSPECTIONS])
def hypergeometric(spark: SparkSession) -> DataFrame:
    """PRB-01: c bad ones or more, for any c."""
    r = spark.createDataFrame(INSPECTIONS, "population bigint, bad bigint, sample bigint, c bigint")
    return r.select("*", E.at_least(*(F.col(x) for x in r.columns)).alias("p"))


RAFFLES = [(100, 5, 3), (20, 1, 1), (10, 8, 3), (200, 25, 5)]


@cases("raffle", "tickets bigint, held bigint, drawn bigint, p double", [(t, h, w, round(float(1 - Fraction(math.comb(t - h, w), math.comb(t, w))), 4)) for t, h, w in RAFFLES])
def raffle(spark: SparkSession) -> DataFrame:
    """PRB-03: with too few other tickets the chance is 1."""
    r = spark.createDataFrame(RAFFLES, "tickets bigint, held bigint, drawn bigint")
    return r.select("*", E.raffle(*(F.col(x) for x in r.columns)).alias("p"))


PARTS = [(0, [0.9, 0.95]), (1, [0.8, 0.97, 0.99, 0.85]), (2, [0.9]), (3, [])]


@cases("reliability", "id bigint, series double, parallel double", [(i, round(math.prod(p), 6), round(1 - math.prod(1 - x for x in p), 6)) for i, p in PARTS])
def reliability(spark: SparkSession) -> DataFrame:
    """PRB-02: any number of parts."""
    r = spark.createDataFrame(PARTS, "id bigint, parts array<double>")
    return r.select("id", F.round(E.in_series(F.col("parts")), 6).alias("series"), F.round(E.in_parallel(F.col("parts")), 6).alias("parallel"))


DICE = [(2, 6, 7), (3, 6, 16), (4, 8, 20), (2, 4, 9), (1, 6, 6), (3, 4, 3)]


@cases("dice", "n int, faces int, total int, p_sum double, p_any double", [
    (n, f, t, round(sum(sum(o) >= t for o in itertools.product(range(1, f + 1), repeat=n)) / f**n, 4), round(sum(f in o for o in itertools.product(range(1, f + 1), repeat=n)) / f**n, 4)) for n, f, t in DICE
])
def dice(spark: SparkSession) -> DataFrame:
    """PRB-05: any number of dice and faces: a sum at least, one face at least once."""
    r = spark.createDataFrame(DICE, "n int, faces int, total int")
    return r.select("*", E.dice_sum_at_least(F.col("n"), F.col("faces"), F.col("total")).alias("p_sum"), E.dice_any(F.col("n"), F.col("faces")).alias("p_any"))


@cases("three_way_match", "invoice varchar, po varchar, outcome varchar", [
    ("i1", "p1", "approve_payment"), ("i2", "p2", "hold_quantity_mismatch"), ("i3", "p3", "hold_price_variance"), ("i4", "p4", "hold_quantity_mismatch"), ("i5", "p9", "reject_invoice"), ("i6", "p5", "approve_payment"), ("i7", None, "reject_invoice"),
])
def three_way_match(spark: SparkSession) -> DataFrame:
    """FIN-04: invoices, orders and receipts; quantity before price, a cheaper price passes, no receipt is a quantity of 0."""
    orders = spark.createDataFrame([("p1", 10.0), ("p2", 10.0), ("p3", 10.0), ("p4", 10.0), ("p5", 10.0)], "po string, price double")
    receipts = spark.createDataFrame([("p1", 60), ("p1", 40), ("p2", 90), ("p3", 100), ("p5", 100)], "po string, qty bigint")
    invoices = spark.createDataFrame([("i1", "p1", 100, 10.2), ("i2", "p2", 100, 12.0), ("i3", "p3", 100, 10.21), ("i4", "p4", 5, 10.0), ("i5", "p9", 1, 1.0), ("i6", "p5", 100, 7.0), ("i7", None, 1, 1.0)], "invoice string, po string, qty bigint, price double")
    return E.three_way_match(invoices, orders, receipts, 2.0)


@query("pattern_day_trader", """WITH d AS (SELECT day, (SELECT count(*) FROM range(0, 60) t(i) WHERE isodow(DATE '2023-12-15' + i::INT) < 6 AND DATE '2023-12-15' + i::INT <= day) AS b FROM (SELECT DISTINCT ts::DATE AS day FROM events)),
t AS (SELECT user_id, b, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS dt, count(*) AS n FROM events JOIN d ON day = ts::DATE GROUP BY 1, 2)
SELECT user_id AS account, bool_or((SELECT sum(x.dt) >= 4 AND sum(x.dt) / sum(x.n) > 0.06 FROM t x WHERE x.user_id = t.user_id AND x.b BETWEEN t.b - 4 AND t.b)) AS flagged FROM t GROUP BY 1""")  # fmt: skip
def pattern_day_trader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRD-02: four day trades in five business days and over 6 % of the trades in them. A purchase stands for a day trade."""
    e = table(spark, sf_dir, "events")
    trades = e.select(F.col("user_id").alias("account"), F.to_date("ts").alias("day"), (F.col("event_type") == "purchase").cast("int").alias("day_trades"), F.lit(1).alias("trades"))
    return E.pattern_day_traders(trades)


TRADES = [("full", [(D(2026, 3, 2), 2, 10), (D(2026, 3, 6), 2, 10)], True), ("six_days", [(D(2026, 3, 2), 2, 10), (D(2026, 3, 9), 2, 10)], False), ("weekend", [(D(2026, 3, 5), 2, 10), (D(2026, 3, 11), 2, 10)], True), ("share", [(D(2026, 3, 2), 4, 67)], False), ("over", [(D(2026, 3, 2), 4, 66)], True), ("three", [(D(2026, 3, 2), 3, 5)], False)]


@cases("pattern_day_trader_edges", "account varchar, flagged boolean", [(a, f) for a, _, f in TRADES])
def pattern_day_trader_edges(spark: SparkSession) -> DataFrame:
    """TRD-02: the fifth and sixth business day, a weekend between, the share just under and over."""
    return E.pattern_day_traders(spark.createDataFrame([(a, *r) for a, rows, _ in TRADES for r in rows], "account string, day date, day_trades int, trades int"))


@query("wash_sale", """SELECT s.o_orderkey AS sale, EXISTS (SELECT 1 FROM orders b WHERE b.o_orderstatus = 'O' AND b.o_custkey = s.o_custkey AND b.o_orderpriority = s.o_orderpriority
  AND abs(date_diff('day', b.o_orderdate::DATE, s.o_orderdate::DATE)) <= 30) AS wash FROM orders s WHERE s.o_orderstatus = 'F'""")  # fmt: skip
def wash_sale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRD-03: sales (finished orders) with a purchase (an open order) of the same customer and kind within 30 days either side."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("account"), F.col("o_orderpriority").alias("asset"), F.to_date("o_orderdate").alias("day"))
    return E.wash_sales(o.filter("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "sale"), o.filter("o_orderstatus = 'O'"))


FILLS = [(0, "buy", 25.0, [25.5, 25.0, 24.0], 2), (1, "sell", 25.0, [24.0, 24.9, 25.5], 3), (2, "buy", 10.0, [11.0, 12.0], None), (3, "sell", 10.0, [], None)]


@cases("limit_fill", "id bigint, quote bigint", [(i, q) for i, *_, q in FILLS])
def limit_fill(spark: SparkSession) -> DataFrame:
    """TRD-08, WIN-06: buys and sells, the limit itself, no fill, no quotes."""
    r = spark.createDataFrame([x[:4] for x in FILLS], "id bigint, side string, l double, quotes array<double>")
    return r.select("id", E.limit_fill(F.col("quotes"), F.col("l"), F.col("side")).alias("quote"))


STOPS = [(0, [(50.0, 49.0), (49.5, 47.4)], 47.5, 2, 47.5), (1, [(50.0, 49.0), (46.0, 45.0)], 47.5, 2, 46.0), (2, [(47.5, 47.5)], 47.5, 1, 47.5), (3, [(50.0, 49.0)], 47.5, None, None)]


@cases("stop_fill", "id bigint, bar bigint, price double", [(i, b, p) for i, _, _, b, p in STOPS])
def stop_fill(spark: SparkSession) -> DataFrame:
    """TRD-05, WIN-06: a bar through the stop, one that gaps below it, one that opens at it, none."""
    r = spark.createDataFrame([x[:3] for x in STOPS], "id bigint, bars array<struct<open: double, low: double>>, stop double")
    return r.select("id", E.stop_fill(F.col("bars"), F.col("stop")).alias("f")).select("id", "f.bar", "f.price")


@cases("incoterm_risk", "term varchar, stage bigint, bears varchar", [
    (t, s, ("buyer" if s >= n else "seller") if n is not None else None)
    for t, n in (("EXW", 1), ("FCA", 2), ("CPT", 2), ("CIP", 2), ("FAS", 3), ("FOB", 4), ("CFR", 4), ("CIF", 4), ("DAP", 5), ("DDP", 5), ("DPU", 6), ("XXX", None)) for s in range(7)
])
def incoterm_risk(spark: SparkSession) -> DataFrame:
    """TRD-09: each term at each stage."""
    terms = spark.createDataFrame([(t,) for t in (*E.TERM_STAGE, "XXX")], "term string")
    return terms.withColumn("stage", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(6).cast("bigint")))).withColumn("bears", E.risk_bearer(F.col("term"), F.col("stage")))


VAT = [("DE", "FR", True, "reverse_charge_no_vat"), ("DE", "FR", False, "charge_vat"), ("DE", "DE", True, "charge_vat")]
GST = [("Delhi", "Gujarat", 48000.0, 0.18, 8640.0, 0.0, 0.0), ("Delhi", "Delhi", 48000.0, 0.05, 0.0, 1200.0, 1200.0)]


@cases("vat_treatment", "seller varchar, buyer varchar, business boolean, vat varchar", VAT)
def vat_treatment(spark: SparkSession) -> DataFrame:
    """TRD-11."""
    r = spark.createDataFrame([x[:3] for x in VAT], "seller string, buyer string, business boolean")
    return r.withColumn("vat", E.vat_treatment(F.col("seller"), F.col("buyer"), F.col("business")))


@cases("gst_lines", "supplier varchar, place varchar, igst double, cgst double, sgst double", [(a, b, *x) for a, b, _, _, *x in GST])
def gst_lines(spark: SparkSession) -> DataFrame:
    """TRD-12."""
    r = spark.createDataFrame([x[:4] for x in GST], "supplier string, place string, value double, rate double")
    return r.select("supplier", "place", E.gst_lines(*(F.col(x) for x in r.columns)).alias("g")).select("supplier", "place", "g.*")


@cases("sanctions_screening", "id bigint, outcome varchar", [(1, "confirmed_match"), (2, "confirmed_match"), (3, "false_positive"), (4, "no_match"), (5, "no_match"), (6, "confirmed_match"), (7, "false_positive")])
def sanctions_screening(spark: SparkSession) -> DataFrame:
    """TRD-13: full name, first and last name, another birthday, a middle name alone, two listed people of one name."""
    listed = spark.createDataFrame([("Ana Maria Lopez", D(1971, 4, 12)), ("Omar Ali", D(1980, 9, 3)), ("Omar  Ali", D(1990, 1, 1))], "name string, dob date")
    people = [(1, "Ana Maria Lopez", D(1971, 4, 12)), (2, "Ana Lopez", D(1971, 4, 12)), (3, "Ana Lopez", D(1985, 4, 12)), (4, "Ana Maria", D(1971, 4, 12)), (5, "Omar Ali Jr.", D(1980, 9, 3)), (6, "Omar Ali", D(1990, 1, 1)), (7, "Omar Ali", None)]
    return E.screen(spark.createDataFrame(people, "id bigint, name string, dob date"), listed)


SUIT = [(3, 3, 5, 5, True), (4, 3, 5, 5, False), (1, 5, 0, 1, False), (7, 5, 0, 3, False), (1, 1, 9, 1, True)]


@cases("suitability", "product bigint, profile bigint, horizon bigint, holding bigint, ok boolean", SUIT)
def suitability(spark: SparkSession) -> DataFrame:
    """TRD-14."""
    r = spark.createDataFrame([x[:4] for x in SUIT], "product bigint, profile bigint, horizon bigint, holding bigint")
    return r.withColumn("ok", E.suitable(*(F.col(x) for x in r.columns)))


DISPUTES = [(D(2026, 1, 1), D(2026, 1, 20), True, D(2026, 3, 21), 60, True), (D(2026, 1, 1), D(2026, 1, 20), True, D(2026, 3, 22), 60, False), (D(2026, 1, 1), D(2026, 1, 20), False, D(2026, 3, 21), 60, False), (D(2026, 1, 1), D(2026, 1, 20), False, D(2026, 3, 2), 60, True)]


@cases("chargeback_window", "a date, b date, c boolean, filed date, days int, ok boolean", DISPUTES)
def chargeback_window(spark: SparkSession) -> DataFrame:
    """TRD-16: from the delivery or from the transaction; the last day counts."""
    r = spark.createDataFrame([x[:5] for x in DISPUTES], "a date, b date, c boolean, filed date, days int")
    return r.withColumn("ok", E.in_dispute_window(*(F.col(x) for x in r.columns)))


WRONG = [(0, 120.0, "mul", 1.1, 132.0), (1, 120.0, "scale", 0.01, 1.2), (2, 120.0, "add", -0.04, 115.2), (3, 2.0, "add", 0.02, 2.5), (4, -7.5, "sign", 0.0, 7.5), (5, 0.0, "sign", 0.0, 1.0), (6, 123.46, "swap", 1.0, 132.46), (7, -123.45, "swap", 3.0, -123.54), (8, 11.11, "swap", 0.0, 13.332), (9, 0.1, "mul", 1.05, 0.105)]


@cases("answer_perturb", "id bigint, wrong double, source varchar, drops boolean", [(i, w, f"{w:.1f}", abs(round(w, 2) - round(g, 2)) < 0.006 or f"{w:.1f}" == f"{g:.1f}") for i, g, _, _, w in WRONG])
def answer_perturb(spark: SparkSession) -> DataFrame:
    """JDG-01, PRJ-23: five ways to be wrong; dropped if near gold at two decimals, or if it prints like gold at the source's."""
    r = spark.createDataFrame([x[:4] for x in WRONG], "id bigint, gold double, kind string, par double")
    w = F.round(E.perturbed(F.col("gold"), F.col("kind"), F.col("par")), 9)
    printed = lambda x: X.formatted(x, "source", 1)
    return r.select("id", w.alias("wrong"), printed(w).alias("source"), ((F.abs(F.round(w, 2) - F.round("gold", 2)) < 0.006) | (printed(w) == printed(F.col("gold")))).alias("drops"))


SOLVED = [("1,234", 1234.0, True), ("$5.", 5.0, True), ("7.0000001", 7.0, True), ("7.00001", 7.0, False), ("seven", 7.0, None), ("", 0.0, None)]


@cases("answer_check", "proposed varchar, gold double, same boolean", SOLVED)
def answer_check(spark: SparkSession) -> DataFrame:
    """JDG-02: a proposed answer against gold."""
    r = spark.createDataFrame([x[:2] for x in SOLVED], "proposed string, gold double")
    return r.withColumn("same", E.same_number(F.col("proposed"), F.col("gold")))


def _windows(duck: Duck) -> str:
    """The dates of every case, days enumerated one by one from the first date."""
    n = duck.days("d1", "d2")
    ahead, back = (f"len(list_filter(range(1, {sign}{n} + 1), lambda i: isodow(d1 {op} i::INT) < 6))" for sign, op in (("", "+"), ("-", "-")))
    return doubles(f"WITH {rules.case(duck)} SELECT id, {n} AS days, CASE WHEN {n} >= 0 THEN {ahead} ELSE -{back} END AS bdays, {n} BETWEEN 0 AND 30 AS within FROM c")


@query("date_window", _windows(Duck()))
def date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-03: calendar and business days between two dates, within 0 to 30."""
    c = spark.sql(doubles(f"WITH {rules.case(Spark(sf_dir))} SELECT id, d1, d2 FROM c"))
    days = F.datediff("d2", "d1")
    return c.select("id", days.cast("bigint").alias("days"), C.business_days(F.col("d1"), F.col("d2")).alias("bdays"), days.between(0, 30).alias("within"))
