"""Prefix scans and range windows against loops, in any partitioning."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from verdex.operators import scans


@pytest.mark.parametrize(("cells", "parts"), [(1, 1), (7, 3), (40, 5), (None, 2)])
def test_balance(spark, cells, parts):
    r = random.Random(3)
    rows = [(f"k{i % 2}" if i % 5 else None, i, r.choice(["yes"] * 5 + ["no"] * 2 + ["maybe", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "family string, ord long, label string").withColumn("before", F.lit("clash")).repartition(parts)
    count, want = {}, {}
    for k, i, x in rows:
        c = count.setdefault(k, {"yes": 0, "no": 0})
        want[i] = x not in c or c[x] <= c["yes" if x == "no" else "no"] + 2
        if want[i] and x in c:
            c[x] += 1
    got = scans.balanced(df.drop("before"), ["family"], "ord", "label", 2, cells)
    assert {r["ord"]: r["accepted"] for r in got.collect()} == want and got.columns == ["family", "ord", "label", "accepted"]


def test_cells_stay_whole_when_starts_are_broadcast(spark, tmp_path):
    """Rows over the limit of a broadcast, which the starts are under when they are told, so that join changes as it runs."""
    rows = spark.range(0, 300_000, 1, 24).select((F.col("id") % 3).alias("k"), F.col("id").alias("i"), (F.pmod(F.xxhash64("id"), F.lit(3)) - 1).alias("x"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
    rows.write.parquet(str(tmp_path / "rows"))
    limits = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB"}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        got = scans.clamped_sum(spark.read.parquet(str(tmp_path / "rows")), ["k"], "i", F.col("x"), -50, 50, 23).collect()
    finally:
        for k in limits:
            spark.conf.unset(k)
    at, bad = {0: 0, 1: 0, 2: 0}, 0
    for r in sorted(got, key=lambda r: r["i"]):
        bad += r["before"] != at[r["k"]]
        at[r["k"]] = min(max(at[r["k"]] + r["x"], -50), 50)
    assert len(got) == 300_000 and not bad


def test_counter_without_key_and_without_rows(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([3, 3, -9, None, 1, 5, 5, -1])], "i long, x long")
    got = scans.clamped_sum(df, [], "i", F.col("x"), -4, 6, 3).orderBy("i").collect()
    assert [r["before"] for r in got] == [0, 3, 6, -3, -3, -2, 3, 6]
    assert scans.clamped_sum(df.limit(0), [], "i", F.col("x"), -4, 6).count() == 0


@pytest.mark.parametrize(("span", "width"), [(1, None), (5, 5), (5, 7), (3, 100)])
def test_range_sums(spark, span, width):
    r = random.Random(5)
    rows = [("hot" if i % 3 else "b", r.randint(-20, 20), r.randint(0, 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at long, x long")
    want = {(k, a): sum(x for q, b, x in rows if q == k and a <= b < a + span) for k, a, _ in rows}
    got = scans.range_sums(df, ["k"], "at", ["x"], span, width).collect()
    assert {(r["k"], r["at"]): r["ahead_x"] for r in got} == want and len(got) == len(want)


def test_structuring(spark):
    day = lambda d: dt.date(2026, 3, d)
    rows = [("a", day(1), 9500.0), ("a", day(3), 9500.0), ("a", day(5), 9999.99), ("b", day(1), 9500.0), ("b", day(3), 9500.0), ("b", day(6), 9500.0), ("c", day(1), 10000.0), ("c", None, 9500.0), ("d", day(2), None)]
    got = scans.structuring(spark.createDataFrame(rows, "acc string, day date, v double"), "acc", "day", "v", 9000, 10000)
    assert {r["acc"]: (r["most"], r["alert"]) for r in got.collect()} == {"a": (3, True), "b": (2, False), "c": (0, False), "d": (0, False)}


def test_nights_start_anew(spark):
    t = lambda d, h, m=0: dt.datetime(2026, 3, d, h, m)
    rows = [(1, "a", t(1, 20), 600.0), (2, "a", t(1, 23), 500.0), (3, "a", t(2, 2), 400.0), (4, "a", t(2, 5, 59), 1.0), (5, "a", t(2, 6), 4000.0), (6, "a", t(2, 19, 59), 60000.0), (7, "a", t(2, 20), 1000.0), (8, "a", t(3, 1), 0.01), (9, "b", t(1, 21), 1000.0), (10, None, t(1, 21), None)]
    df = spark.createDataFrame(rows, "id long, acc string, ts timestamp, v double")
    got = scans.night_transfers(df, "acc", "ts", "id", "v", 1000, 50000)
    # 2 is over the limit and so isn't sent; 3 and the night's 1000 fit; 5 by day is over the night's limit, 6 over the day's
    assert {r["id"]: r["allowed"] for r in got.collect()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False, 7: True, 8: False, 9: True, 10: True}
    assert {r["id"]: str(r["night"]) for r in got.collect()}[4] == "2026-03-01"
