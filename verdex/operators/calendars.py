"""TMP-01, FIN-09: deadlines by a relation of calendars: business days are numbered, and a deadline is found by its number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdex.operators.calendar import business_index


def ranked_days(holidays: DataFrame, markets: DataFrame, first: object, last: object) -> DataFrame:
    """(market, day, open, rank): every day from first to last in each market; rank: its business days up to and with the day,
    less a constant of the market. Holidays on weekends or repeated don't count twice; days outside are counted, too.

    A day's rank is its number of weekdays, a closed form, less the holidays up to it, which are few rows per market.
    """
    days = markets.select("market").distinct().select("market", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    off = holidays.filter("market IS NOT NULL AND day IS NOT NULL").select("market", F.to_date("day").alias("day")).distinct().filter(F.weekday("day") < 5).withColumn("_off", F.lit(1))
    before = off.filter(F.col("day") < F.lit(first).cast("date")).groupBy("market").agg(F.count("*").alias("_before"))
    upto = Window.partitionBy("market").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    days = days.join(off, ["market", "day"], "left").join(before, "market", "left")
    gone = F.coalesce("_before", F.lit(0)) + F.sum(F.coalesce("_off", F.lit(0))).over(upto)
    return days.select("market", "day", ((F.weekday("day") < 5) & F.col("_off").isNull()).alias("open"), (business_index(F.col("day")) - gone).alias("rank"))


def deadlines(rows: DataFrame, holidays: DataFrame, market: str, start: str, n: Column, out: str = "due") -> DataFrame:
    """rows with `out`: the n-th business day (n from 1) of the row's market after its start; null for a null start, n < 1.

    holidays: (market, day). A market without holidays has weekends only; a null market has none either. Starts meet the
    numbered days twice, by (market, day) and by (market, number), so no row is expanded into days and n may be any number.
    The table of days has a row per market and day between the first start and the last deadline.
    """
    named = rows.withColumns({"_market": F.coalesce(F.col(market).cast("string"), F.lit("\x00")), "_start": F.to_date(start), "_n": n.cast("bigint")})
    markets = named.select(F.col("_market").alias("market")).distinct()
    off = holidays.select(F.col("market").cast("string").alias("market"), F.to_date("day").alias("day")).distinct()
    span = named.agg(F.min("_start").alias("a"), F.max("_start").alias("b"), F.max("_n").alias("n")).first()
    if span["a"] is None or span["n"] is None:
        return named.select(*rows.columns, F.lit(None).cast("date").alias(out))
    most = off.groupBy("market").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    last = span["b"].toordinal() + 7 * ((max(span["n"], 0) + most) // 5 + 2)
    days = ranked_days(off, markets, span["a"], span["b"].fromordinal(last))
    begins = days.select(F.col("market").alias("_market"), F.col("day").alias("_start"), F.col("rank").alias("_rank"))
    opens = days.filter("open").select(F.col("market").alias("_market"), F.col("rank").alias("_goal"), F.col("day").alias(out))
    told = named.join(begins, ["_market", "_start"], "left").withColumn("_goal", F.when(F.col("_n") >= 1, F.col("_rank") + F.col("_n")))
    return told.join(opens, ["_market", "_goal"], "left").select(*rows.columns, out)
