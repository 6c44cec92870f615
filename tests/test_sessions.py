"""Sessions in a state store: answers, a restart, and what an append writes."""

import duckdb

from verdex.plans import registry
from verdex.streaming import sessions

SCHEMA = "session string, seq long, op string, text string"


def run(spark, folder, out, check):
    """Take what is new in the folder, a file a trigger; returns the triggers' progress."""
    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    with sessions.rocksdb(spark):
        q = sessions.stored_sessions(rows, lambda text, question: f"{text.count(question)}:{text[-3:]}").writeStream.foreachBatch(write)
        q = q.option("checkpointLocation", check).trigger(availableNow=True).outputMode("append").start()
        q.awaitTermination()
    return [p for p in q.recentProgress if p["numInputRows"]]


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_answers_and_restart(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    put(spark, folder, [("a", 0, "append", "lost"), ("a", 1, "create", "one "), ("a", 3, "evaluate", "o"), ("a", 2, "append", "two"), ("b", 1, "create", None), ("c", 1, "delete", None)])
    run(spark, folder, out, check)
    put(spark, folder, [("a", 4, "append", "!"), ("a", 5, "evaluate", "t"), ("a", 6, "rename", "x"), ("b", 2, "append", "x")])
    run(spark, folder, out, check)  # another query that goes on from the checkpoint
    put(spark, folder, [("a", 7, "delete", None), ("a", 8, "evaluate", "x"), ("a", 9, "delete", None), ("a", 10, "create", "é"), ("b", 3, "create", "anew")])
    run(spark, folder, out, check)
    got = {(r["session"], r["seq"]): (r["status"], r["chars"], r["answer"]) for r in spark.read.parquet(out).collect()}
    assert got == {
        ("a", 0): (404, None, None), ("a", 1): (200, 4, None), ("a", 2): (200, 7, None), ("a", 3): (200, 7, "2:two"), ("b", 1): (200, 0, None), ("c", 1): (404, None, None),
        ("a", 4): (200, 8, None), ("a", 5): (200, 8, "1:wo!"), ("a", 6): (404, None, None), ("b", 2): (200, 1, None),
        ("a", 7): (200, None, None), ("a", 8): (404, None, None), ("a", 9): (404, None, None), ("a", 10): (200, 1, None), ("b", 3): (200, 4, None),
    }


def test_an_append_writes_its_piece(spark, tmp_path):
    """Ten appends of a kilobyte to a text that grows: each trigger writes about as much as the one before."""
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    put(spark, folder, [("a", 0, "create", "x" * 200_000)])
    wrote = []
    for k in range(6):
        put(spark, folder, [("a", k + 1, "append", f"{k}" * 1000)])
        told = run(spark, folder, out, check)
        wrote.append(sum(s["customMetrics"].get("rocksdbTotalBytesWritten", 0) for p in told[-1:] for s in p["stateOperators"]))
    assert spark.read.parquet(out).filter("seq = 6").first()["chars"] == 206_000
    assert 1000 < max(wrote[1:]) < 20_000, wrote


def test_gaps_count_seconds_as_the_sql_does(spark, tmp_path):
    """Gaps of 30 minutes less a fraction, which cross 1800 seconds or 1799, before and after 1970, against DuckDB."""
    rows = [(1, 1, "2024-01-01 00:00:00.9"), (2, 1, "2024-01-01 00:30:00.1"), (3, 1, "2024-01-01 00:59:59.9"), (4, 2, "1969-12-31 23:45:00.5"), (5, 2, "1970-01-01 00:15:00.2"), (6, 2, "1970-01-01 00:44:59.9"), (7, 3, "1969-12-31 22:00:00.9"), (8, 3, "1969-12-31 22:30:00.1")]
    path = f"{tmp_path}/events.parquet"
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT 0::BIGINT AS event_id, 0::BIGINT AS user_id, TIMESTAMP '2024-01-01' AS ts, 'a' AS event_type, 1.0::DOUBLE AS value LIMIT 0")
    con.executemany("INSERT INTO events VALUES (?, ?, ?::TIMESTAMP, 'a', 1.0)", rows)
    con.execute(f"COPY events TO '{path}' (FORMAT parquet)")
    for name in ("session_windows", "tumbling_windows"):
        got = registry.queries()[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(con.execute(registry.oracle_sql()[name]).fetchall())
    assert {r["user_id"]: r["sessions"] for r in registry.queries()["session_windows"](spark, str(tmp_path)).collect()} == {1: 2, 2: 2, 3: 2}
