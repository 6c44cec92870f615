"""Sequential rules over the tables: running balance, deposits in windows of days, transfers by night."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.operators import scans
from verdex.plans.registry import query
from verdex.sources.tables import table

#: Item by item, as the rule says it: a table of the lead after each item.
_BALANCE = """
WITH RECURSIVE i AS (SELECT event_id, event_type AS kind, user_id % 3 AS family, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS n,
  CASE WHEN value > 60 THEN 'yes' ELSE 'no' END AS label FROM events WHERE event_type = (SELECT min(event_type) FROM events)),
r AS (SELECT family, n, event_id, label, TRUE AS accepted, CASE WHEN label = 'yes' THEN 1 ELSE -1 END AS lead FROM i WHERE n = 1
  UNION ALL SELECT i.family, i.n, i.event_id, i.label, CASE WHEN i.label = 'yes' THEN lead <= 5 ELSE lead >= -5 END,
  lead + CASE WHEN i.label = 'yes' AND lead <= 5 THEN 1 WHEN i.label = 'no' AND lead >= -5 THEN -1 ELSE 0 END FROM r JOIN i ON i.family = r.family AND i.n = r.n + 1)
SELECT family, event_id, label, accepted FROM r"""


@query("balance_scan", _BALANCE)
def balance_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-09: events of one kind as yes/no items, in order per family; the class that leads by more than five waits."""
    events = table(spark, sf_dir, "events")
    kind = F.broadcast(events.agg(F.min("event_type").alias("event_type")))  # one row
    items = events.join(kind, "event_type").select((F.col("user_id") % 3).alias("family"), "event_id", F.when(F.col("value") > 60, "yes").otherwise("no").alias("label"))
    return scans.balanced(items, ["family"], "event_id", "label")


@query(
    "structuring_window",
    """WITH e AS (SELECT user_id, ts::DATE AS day, (value >= 40 AND value < 60)::INT AS in_band FROM events)
SELECT a.user_id, max(n)::BIGINT AS most, max(n) >= 3 AS flagged FROM (SELECT x.user_id, x.day, (SELECT sum(y.in_band) FROM e y WHERE y.user_id = x.user_id AND y.day >= x.day AND y.day < x.day + 5) AS n FROM (SELECT DISTINCT user_id, day FROM e) x) a GROUP BY a.user_id""",
)
def structuring_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIN-05, WIN-05: three deposits in the band within 5 days of a deposit, per user."""
    rows = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "value")
    return scans.structuring(rows, "user_id", "day", "value", 40, 60).withColumnRenamed("alert", "flagged")


_NIGHT = """
WITH RECURSIVE e AS (SELECT event_id, user_id, value AS v, CASE WHEN hour(ts) >= 20 THEN ts::DATE WHEN hour(ts) < 6 THEN (ts::DATE - 1)::DATE END AS night, ts FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, night ORDER BY ts, event_id) AS n FROM e WHERE night IS NOT NULL),
r AS (SELECT user_id, night, n, event_id, v <= 120 AS allowed, CASE WHEN v <= 120 THEN v ELSE 0 END AS sent FROM o WHERE n = 1
  UNION ALL SELECT o.user_id, o.night, o.n, o.event_id, sent + v <= 120, CASE WHEN sent + v <= 120 THEN sent + v ELSE sent END FROM r JOIN o ON o.user_id = r.user_id AND o.night = r.night AND o.n = r.n + 1)
SELECT event_id, CAST(night AS VARCHAR) AS night, allowed FROM r UNION ALL SELECT event_id, NULL, v <= 200 FROM e WHERE night IS NULL"""


@query("night_limit", _NIGHT)
def night_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRD-15: transfers between 20:00 and 06:00 add up to the limit at most, each night anew; by day the day's limit holds."""
    out = scans.night_transfers(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value", 120, 200)
    return out.select("event_id", F.col("night").cast("string").alias("night"), "allowed")
