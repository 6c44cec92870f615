"""Rules and calendars as relations, against loops over every rule and every day."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from verdex.operators import calendars, rulebooks

OPS = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b, "=": lambda a, b: a == b, "<>": lambda a, b: a != b}


def holds(case, conditions):
    sets = {}
    for _, a, op, number, text in conditions:
        sets.setdefault((a, op), []).append(text if text is not None else number)
    for (a, op), values in sets.items():
        x = case[a]
        if x is None:
            return False
        if op in ("in", "not in"):
            ok = (x in values) == (op == "in")
        else:
            ok = all(v is not None and OPS[op](x, v) for v in values)
        if not ok:
            return False
    return True


@pytest.fixture(scope="module")
def book(spark):
    r = random.Random(9)
    rows = []
    for c in range(1, 150):
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.6:
                rows.append((c * 3, r.choice(["x", "y"]), r.choice([*OPS]), float(r.randint(0, 30)), None))
            else:
                op = r.choice(["in", "not in", "=", "<>", "<", ">="])
                rows += [(c * 3, "s", op, None, r.choice("abcdé")) for _ in range(r.randint(1, 2) if "in" in op else 1)]
    rows += [(1, "x", ">=", None, None), (2, "s", "=", None, "z")]
    r.shuffle(rows)
    cases = [(i, r.choice([None, *range(32)]), r.choice([0.5, *map(float, range(32))]), r.choice(["a", "b", "c", "d", "é", "", None, "zz"])) for i in range(500)]
    return rows, cases, spark.createDataFrame(rows, rulebooks.CONDITIONS), spark.createDataFrame(cases, "id long, x int, y double, s string")


@pytest.mark.parametrize(("block", "indexes"), [(2048, 8), (7, 3), (64, 1)])
def test_first_clause(book, block, indexes):
    rows, cases, conditions, df = book
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    want = {i: next((c for c in sorted(by) if holds({"x": x, "y": y, "s": s}, by[c])), None) for i, x, y, s in cases}
    got = rulebooks.first_clauses(df, conditions, block, indexes).collect()
    assert {r["id"]: r["first_clause"] for r in got} == want and len(got) == len(cases)


def test_without_rules_or_cases(book):
    _, _, conditions, df = book
    assert {r["first_clause"] for r in rulebooks.first_clauses(df, conditions.limit(0)).collect()} == {None}
    assert rulebooks.first_clauses(df.limit(0), conditions).count() == 0


def test_cited(book):
    rows, cases, conditions, df = book
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    got = rulebooks.cited(df.withColumn("k", F.col("id")), conditions, "k").collect()
    assert {r["id"]: r["holds"] for r in got} == {i: holds({"x": x, "y": y, "s": s}, by[i]) if i in by else None for i, x, y, s in cases}


def test_deadlines(spark):
    r = random.Random(4)
    base = dt.date(2025, 12, 1)
    off = [(r.choice("ab"), base + dt.timedelta(r.randint(-10, 80))) for _ in range(40)] + [("a", base), ("a", base), (None, base), ("c", None)]
    rows = [(i, r.choice(["a", "b", "none", None]), base + dt.timedelta(r.randint(0, 40)), r.choice([1, 2, 5, 10, 60])) for i in range(200)] + [(900, "a", None, 3), (901, "a", base, 0), (902, "a", base, None)]
    closed = {(m, d) for m, d in off}

    def due(m, d, n):
        if d is None or not n:
            return None
        while n:
            d += dt.timedelta(1)
            n -= d.weekday() < 5 and (m, d) not in closed
        return d

    df = spark.createDataFrame(rows, "id long, m string, start date, n int").withColumn("rank", F.lit(1))
    got = calendars.deadlines(df, spark.createDataFrame(off, "market string, day date"), "m", "start", F.col("n"))
    assert {x["id"]: x["due"] for x in got.collect()} == {i: due(m if m else "", d, n) for i, m, d, n in rows}
    assert got.count() == len(rows) and calendars.deadlines(df.limit(0), spark.createDataFrame(off, "market string, day date"), "m", "start", F.col("n")).count() == 0


def test_many_narrow_clauses_take_few_passes(spark):
    """Clauses of narrow ranges, most of them copies under other numbers, go to the cells that they reach, not to all cases in turn."""
    width = [(c, float(c * 7919 % 1500), float(c * 7919 % 1500 + 12)) for c in range(1500)]
    rows = [(c + 1500 * k, "x", op, v, None) for k in range(4) for c, lo, hi in width for op, v in ((">", lo), ("<=", hi))]
    rows += [(9000, "x", "<>", 3.0, None), (9001, "s", "in", None, "a"), (9002, "x", ">", 9.0, None), (9002, "x", "<", 5.0, None)]
    cases = [(i, None if i % 50 == 7 else i * 0.8, "ab"[i % 2]) for i in range(2000)]
    want = {i: min((c for c, lo, hi in width if x is not None and lo < x <= hi), default=9000 if x not in (None, 3.0) else 9001 if s == "a" else None) for i, x, s in cases}
    got = rulebooks.first_clauses(spark.createDataFrame(cases, "id long, x double, s string"), spark.createDataFrame(rows, rulebooks.CONDITIONS), 64, 2)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow run") <= 2
    assert {r["id"]: r["first_clause"] for r in got.collect()} == want
