"""The source of sampled cases, nested JSON by VARIANT, and counters that cost no further scan."""

import json

import pytest
from pyspark.sql import functions as F

from verdex.operators import counters, nested
from verdex.sources import sampled


@pytest.mark.parametrize("n", [0, 1, 57])
def test_same_rows_in_any_partitions(spark, n):
    sampled.register(spark)
    options = {"n": str(n), "attributes": json.dumps([["x", "int", [1, 10]], ["k", "enum", ["a", "b"]], ["m", "money", [0, 5]], ["p", "pct", [0, 1]], ["u", "bool", []]]), "accept": json.dumps([["x", ">=", 9], ["k", "not in", ["b"]]])}
    read = lambda **more: spark.read.format("sampled_cases").options(**options, **more).load()
    rows = [sorted(map(tuple, read(partitions=p).collect())) for p in ("1", "3", "40")]
    assert rows[0] == rows[1] == rows[2] and [r[0] for r in rows[0]] == list(range(n))
    assert all(r[2] and r[3] >= 9 and r[4] == "a" and 0 <= r[5] <= 5 for r in rows[0])
    for number, attempt, _, x, *_ in rows[0]:
        assert sampled.drawn("1", number, attempt, "x", "int", [1, 10]) == x
    half = read(balance="true").collect()
    assert all(r["holds"] == (r["number"] % 2 == 0) == (r["x"] >= 9 and r["k"] == "a") for r in half) and len(half) == n


def test_what_is_never_accepted_is_an_error(spark):
    sampled.register(spark)
    df = spark.read.format("sampled_cases").options(n="3", most="50", attributes='[["x", "int", [1, 2]]]', accept='[["x", ">", 5]]').load()
    with pytest.raises(Exception, match="no case was accepted in 50 attempts"):
        df.collect()


def test_members_and_pairs(spark):
    rows = [(1, '{"a":[{"x":1,"t":"p"},{"x":"2"},[]],"q":{"k2":"B","k1":{"z":1}},"r":{"k1":"yes","k9":0}}'), (2, "[1]"), (3, "no json {"), (4, None), (5, '{"a":{"u":{"x":7}},"q":[3]}'), (6, '{"q":{"k":null},"r":5}')]
    df = spark.createDataFrame(rows, "id int, j string").withColumn("v", nested.parsed(F.col("j")))
    got = nested.members(df, "v", "$.a").select("id", "pos", "key", nested.field("value", "$.x", "int").alias("x"), nested.field("value", "$.t").alias("t"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, None, 1, "p"), (1, 1, None, 2, None), (1, 2, None, None, None), (5, 0, "u", 7, None)]
    got = nested.paired(df, "v", "$.q", "$.r").select("id", "key", F.to_json("a").alias("a"), F.to_json("b").alias("b"))
    assert sorted(map(tuple, got.collect())) == [(1, "k1", '{"z":1}', '"yes"'), (1, "k2", '"B"', None), (6, "k", "null", None)]
    with pytest.raises(ValueError, match="prefix"):
        nested.members(df.withColumn("pos", F.lit(1)), "v", "$.a")


def test_counts_come_with_the_rows(spark, tmp_path):
    rows = spark.range(100).withColumn("reason", F.when(F.col("id") < 60, None).when(F.col("id") < 90, "over_quota").when(F.col("id") < 97, "no_target").otherwise("odd"))
    told, counts = counters.by_reason(rows, ("over_quota", "no_target", "absent"))
    told.filter("reason IS NULL").write.parquet(str(tmp_path / "kept"))  # one job gives the rows and the counts
    assert counts() == {"rows": 100, "kept": 60, "over_quota": 30, "no_target": 7, "absent": 0, "other": 3}
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 60


def test_rates_by_trigger(spark, tmp_path):
    for k in range(3):
        spark.range(10 * (k + 1)).select("id", (F.col("id") % 2 == 0).alias("agree")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    listener = counters.Rates()
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long, agree boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = counters.Rates.observed(stream).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    assert sorted(t[1] for t in listener.triggers) == [10, 20, 30] and listener.totals() == (60, 30)
