"""Sequential rules without a sequential task: prefix scans over cells of an order, and range windows with a halo."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdex.operators import ranks

#: Rows of a cell of a scan, about, and cells at most.
CELL_ROWS, MOST_CELLS = 50_000, 4096
FAR = 1 << 40


def clamped_sum(df: DataFrame, keys: list[str], order: str, step: Column, low: int, high: int, cells: int | None = None) -> DataFrame:
    """df with `before`: what a counter, from 0, had before the row, if each row of a key adds its step in order and the
    counter stays between low and high. Orders (numbers) don't tie inside a key; a null step is 0; null keys are a key.

    A row is a function x -> clamp(x + a, l, h), and such functions compose to one of the same form, so the scan is parallel:
    the order is cut into cells, each (key, cell) composes its rows, the cells' functions are run through in order (one short
    row per key and cell), and each cell starts from what it is told. A key with all rows is as many tasks as there are cells.
    Rows of a key and cell meet by a window, which demands it: a repartition after the join of the starts is left out as
    done already, and adaptive execution then reads that join's side by its writers, a cell in several tasks.
    """
    if cells is None:
        cells = max(1, min(MOST_CELLS, df.count() // CELL_ROWS))
    kept = df.columns
    names = {c: f"_k{i}" for i, c in enumerate(keys)}
    rows = df.withColumns({"_step": F.coalesce(step, F.lit(0)).cast("bigint"), "_cell": ranks.cut(df, order, cells), **{n: F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c, n in names.items()}})
    of = [*names.values(), "_cell"]

    def compose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One function (a, l, h) per key and cell; rows come sorted."""
        at, out = None, []
        for f in frames:
            for *key, x in f[[*of, "_step"]].itertuples(index=False):
                if key != at:
                    at = key
                    out.append([*key, 0, -FAR, FAR])
                a, lo, hi = out[-1][-3:]
                out[-1][-3:] = a + x, min(max(lo + x, low), high), min(max(hi + x, low), high)
            if len(out) > 10_000:
                yield pd.DataFrame(out[:-1], columns=[*of, "a", "l", "h"])
                out = out[-1:]
        yield pd.DataFrame(out, columns=[*of, "a", "l", "h"])

    kinds = ", ".join(f"{n} string" for n in names.values())
    kinds = f"{kinds}, " if kinds else ""
    dealt = lambda d: d.withColumn("_n", F.row_number().over(Window.partitionBy(*of).orderBy(order)))
    functions = dealt(rows.select(*of, order, "_step")).mapInPandas(compose, f"{kinds}_cell int, a bigint, l bigint, h bigint")

    def starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each cell's start, from the functions of the key's cells before it."""
        at, x = None, 0
        for f in frames:
            out = []
            for *key, cell, a, lo, hi in f[[*of, "a", "l", "h"]].itertuples(index=False):
                if key != at:
                    at, x = key, 0
                out.append([*key, cell, x])
                x = min(max(x + a, lo), hi)
            yield pd.DataFrame(out, columns=[*of, "_start"])

    told = (functions.repartition(*names.values()) if names else functions.coalesce(1)).sortWithinPartitions(*of)
    told = told.mapInPandas(starts, f"{kinds}_cell int, _start bigint")
    out = rows.join(told, of)
    schema = out.select(*kept).schema.add("before", "long")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, x = None, 0
        for f in frames:
            told = []
            for *key, start, step in f[[*of, "_start", "_step"]].itertuples(index=False):
                if key != at:
                    at, x = key, start
                told.append(x)
                x = min(max(x + step, low), high)
            yield f[kept].assign(before=told)

    return dealt(out).mapInPandas(run, schema)


def balanced(df: DataFrame, keys: list[str], order: str, label: str, slack: int = 5, cells: int | None = None) -> DataFrame:
    """WIN-09: df with `accepted`: a yes or no that already leads the other by more than `slack` accepted rows isn't.

    The lead is a counter between -(slack + 1) and slack + 1 to which a yes adds and from which a no takes; at its end a row
    of that class changes nothing, which is just when it isn't accepted. Other labels are accepted and don't count.
    """
    x = F.col(label)
    step = F.when(x == "yes", 1).when(x == "no", -1).otherwise(0)
    out = clamped_sum(df, keys, order, step, -slack - 1, slack + 1, cells)
    full = ((x == "yes") & (F.col("before") > slack)) | ((x == "no") & (F.col("before") < -slack))
    return out.select(*df.columns, (~F.coalesce(full, F.lit(False))).alias("accepted"))


def range_sums(df: DataFrame, keys: list[str], at: str, sums: list[str], span: int, width: int | None = None) -> DataFrame:
    """WIN-05: (keys..., at, ahead_x...): for each key and place that has a row, the sum of x over [at, at + span).

    `at` is a whole number, such as a day. Rows of one place are added up first. Places are cut into slices of `width`, and the
    first `span` of a slice are given to the one before as well, so a key with all rows is as many tasks as it has slices.
    """
    width = max(width or 16 * span, span)
    places = df.groupBy(*keys, at).agg(*(F.sum(x).alias(x) for x in sums))
    slice_ = F.floor(F.col(at) / width).cast("bigint")
    own = places.withColumns({"_slice": slice_, "_own": F.lit(True)})
    halo = places.filter(F.pmod(F.col(at), F.lit(width)) < span - 1).withColumns({"_slice": slice_ - 1, "_own": F.lit(False)})
    ahead = Window.partitionBy(*keys, "_slice").orderBy(at).rangeBetween(0, span - 1)
    out = own.unionByName(halo).withColumns({f"ahead_{x}": F.sum(x).over(ahead) for x in sums})
    return out.filter("_own").drop("_own", "_slice", *sums)


def structuring(deposits: DataFrame, account: str, day: str, amount: str, low: float, below: float, days: int = 5, least: int = 3) -> DataFrame:
    """FIN-05: (account, most, alert): the most deposits of [low, below) in `days` days from any deposit's day; alert: `least` are."""
    rows = deposits.filter(F.col(day).isNotNull()).select(account, F.datediff(day, F.lit("1970-01-01").cast("date")).alias("_day"), F.coalesce(((F.col(amount) >= low) & (F.col(amount) < below)).cast("int"), F.lit(0)).alias("n"))
    most = range_sums(rows, [account], "_day", ["n"], days).groupBy(account).agg(F.max("ahead_n").cast("bigint").alias("most"))
    return most.withColumn("alert", F.col("most") >= least)


def night_transfers(df: DataFrame, key: str, ts: str, id: str, amount: str, night_limit: float, day_limit: float, first: int = 20, last: int = 6) -> DataFrame:
    """TRD-15: df with `night` (the date that a night began on; null by day) and `allowed`.

    From `first` to `last` o'clock an account's transfers of one night add up to night_limit at most, and what was blocked
    wasn't sent; each night starts anew. By day only the single transfer's limit holds. Transfers go by (ts, id); null amounts
    are 0. What was sent decides what may follow, so a night of an account is one run in one task, which holds a sum.
    """
    hour = F.hour(ts)
    night = F.when((hour >= first) | (hour < last), F.to_date(F.col(ts) - F.expr(f"INTERVAL {last} HOURS")))
    rows = df.withColumns({"night": night, "_key": F.coalesce(F.col(key).cast("string"), F.lit("\x00")), "_amount": F.coalesce(F.col(amount).cast("double"), F.lit(0.0))})
    kept = [*df.columns, "night"]
    schema = rows.select(*kept).schema.add("allowed", "boolean")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sent = None, 0.0
        for f in frames:
            told = []
            for k, n, v in zip(f["_key"], f["night"], f["_amount"], strict=True):
                if (k, n) != at:
                    at, sent = (k, n), 0.0
                ok = sent + v <= night_limit
                sent += v if ok else 0.0
                told.append(ok)
            yield f[kept].assign(allowed=told)

    dark = rows.filter("night IS NOT NULL").repartition("_key", "night").sortWithinPartitions("_key", "night", ts, id)
    light = rows.filter("night IS NULL").select(*kept, (F.col("_amount") <= day_limit).alias("allowed"))
    return dark.mapInPandas(run, schema).unionByName(light)
