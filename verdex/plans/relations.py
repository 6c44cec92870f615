"""Rules and calendars as relations, over orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.operators import calendars, rulebooks
from verdex.plans.registry import query
from verdex.sources.tables import table


def clauses(parts: DataFrame) -> DataFrame:
    """A clause for each part: orders of a total between two multiples of its price, of a priority or not of a status, by size."""
    low, high = F.round(F.col("p_retailprice") * 150, 2), F.round(F.col("p_retailprice") * 151, 2)
    none = F.lit(None)
    row = lambda a, op, number=none, text=none: F.struct(F.lit(a).alias("attribute"), F.lit(op).alias("op"), number.cast("double").alias("number"), text.cast("string").alias("text"))
    ranges = [row("o_totalprice", ">", low), row("o_totalprice", "<=", high)]
    urgent = [row("o_orderpriority", "in", text=F.lit("1-URGENT")), row("o_orderpriority", "in", text=F.lit("2-HIGH"))]
    kinds = F.when(F.col("p_size") > 30, F.array(*ranges, *urgent)).otherwise(F.array(*ranges, row("o_orderstatus", "<>", text=F.lit("F"))))
    return parts.select(F.col("p_partkey").alias("clause"), F.explode(kinds).alias("c")).select("clause", "c.*")


_APPLIES = """o_totalprice > round(p_retailprice * 150, 2) AND o_totalprice <= round(p_retailprice * 151, 2)
AND CASE WHEN p_size > 30 THEN o_orderpriority IN ('1-URGENT', '2-HIGH') ELSE o_orderstatus <> 'F' END"""


@query("rules_relation", f"SELECT o_orderkey, (SELECT min(p_partkey) FROM part WHERE {_APPLIES}) AS first_clause FROM orders")
def rules_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-16, RUL-10: a clause for each part, the first that applies for each order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return rulebooks.first_clauses(orders, clauses(table(spark, sf_dir, "part"))).select("o_orderkey", "first_clause")


@query("rules_cited", f"SELECT o_orderkey, ({_APPLIES}) AS holds FROM orders LEFT JOIN part ON p_partkey = o_custkey")
def rules_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-10: whether the one clause that an order cites, by its customer's number, holds for it."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return rulebooks.cited(orders, clauses(table(spark, sf_dir, "part")), "o_custkey").select("o_orderkey", "holds")


@query(
    "calendar_deadlines",
    """WITH h AS (SELECT DISTINCT o_orderpriority AS market, o_orderdate::DATE AS day FROM orders WHERE o_orderstatus = 'P'),
m AS (SELECT DISTINCT o_orderpriority AS market FROM orders), s AS (SELECT unnest(generate_series((SELECT min(o_orderdate)::DATE FROM orders), (SELECT max(o_orderdate)::DATE + 900 FROM orders), INTERVAL 1 DAY))::DATE AS day),
o AS (SELECT market, list(day ORDER BY day) AS days FROM m, s WHERE isodow(day) < 6 AND NOT EXISTS (SELECT 1 FROM h WHERE h.market = m.market AND h.day = s.day) GROUP BY market)
SELECT o_orderkey, list_filter(days, lambda d: d > o_orderdate::DATE)[1 + o_orderkey % 15] AS due FROM orders JOIN o ON market = o_orderpriority""",
)
def calendar_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TMP-01, FIN-09: deadlines of 1 to 15 business days, in a market for each priority, whose holidays are days of pending orders."""
    orders = table(spark, sf_dir, "orders")
    holidays = orders.filter("o_orderstatus = 'P'").select(F.col("o_orderpriority").alias("market"), F.to_date("o_orderdate").alias("day"))
    return calendars.deadlines(orders, holidays, "o_orderpriority", "o_orderdate", 1 + F.col("o_orderkey") % 15).select("o_orderkey", "due")
