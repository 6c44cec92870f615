"""Positions, first-k and running totals without a window over a whole key: rows are cut into cells, cells are counted, and only
the rows of one cell are sorted together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cells that an order is cut into. Their counts, times the keys, are what a window over a whole key sees.
CELLS = 4096


def _below(cells: DataFrame, keys: list[str], cell: str, sums: list[str]) -> DataFrame:
    """cells with before_x for each x of sums: its total over lower cells of the same keys."""
    low = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    return cells.select(*keys, cell, *(F.coalesce(F.sum(x).over(low), F.lit(0)).alias(f"before_{x}") for x in sums))


def cut(df: DataFrame, order: str, cells: int = CELLS) -> Column:
    """The cell of a row by quantiles of a number (their error only makes cells uneven); null comes first."""
    bounds = sorted(set(df.agg(F.percentile_approx(order, [k / cells for k in range(1, cells)], 10 * cells)).first()[0] or []))
    if not bounds:
        return F.lit(0)
    return F.when(F.col(order).isNull(), -1).otherwise(bucket(F.col(order), bounds))


def bucket(x: Column, bounds: list) -> Column:
    """How many bounds are below x: a search in a sorted literal array by halves."""
    array = F.array(*(F.lit(b) for b in bounds))
    steps = len(bounds).bit_length()
    state = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        up = (s["lo"] < s["hi"]) & (F.get(array, mid) < x)
        return F.struct(F.when(up, mid + 1).otherwise(s["lo"]).alias("lo"), F.when((s["lo"] < s["hi"]) & ~up, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step, lambda s: s["lo"])


def positions(df: DataFrame, keys: list[str], order: str, tie: str, cells: int = 64) -> DataFrame:
    """df with `pos`, from 0, in the order of (order, tie) among the rows of its keys, and `of`, their number.

    Rows that tie in `order` share a cell: an order with few values is better given with its hash.
    """
    df = df.withColumn("_cell", cut(df, order, cells))
    counts = df.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("of"))
    below = _below(counts, keys, "_cell", ["_n"])
    told = below.join(sizes, keys) if keys else F.broadcast(below.join(F.broadcast(sizes)))  # without keys a row per cell
    out = df.join(told, [*keys, "_cell"])
    inside = Window.partitionBy(*keys, "_cell").orderBy(order, tie)
    return out.withColumn("pos", F.col("before__n") + F.row_number().over(inside) - 1).drop("_cell", "before__n")


def first_k(df: DataFrame, keys: list[str], seed: str, id: str, k: str, cells: int = CELLS) -> DataFrame:
    """The first k (a column that a key's rows share) rows of each key in a seeded hash order; equal hashes by id.

    Cells that lie wholly below k are kept, only the cell that k falls into is sorted.
    """
    h = F.xxhash64(F.lit(seed), F.col(id).cast("string"))
    df = df.withColumn("_h", h).withColumn("_cell", F.shiftright(F.shiftrightunsigned("_h", 1), 63 - (cells - 1).bit_length()).cast("int"))
    counts = df.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    told = counts.join(_below(counts, keys, "_cell", ["_n"]), [*keys, "_cell"])
    out = df.join(told, [*keys, "_cell"])
    below, n, k = F.col("before__n"), F.col("_n"), F.col(k)
    whole, edge = out.filter(below + n <= k), out.filter((below < k) & (below + n > k))
    inside = Window.partitionBy(*keys, "_cell").orderBy(F.shiftrightunsigned("_h", 1), "_h", id)
    edge = edge.withColumn("_r", F.row_number().over(inside)).filter(below + F.col("_r") <= k).drop("_r")
    return whole.union(edge).drop("_h", "_cell", "_n", "before__n")


def running(df: DataFrame, order: str, sums: list[str], cells: int = 256) -> DataFrame:
    """df with total_x, for each x of sums, over all rows up to and with this one in an order without ties."""
    df = df.withColumn("_cell", cut(df, order, cells))
    totals = df.groupBy("_cell").agg(*(F.sum(x).alias(x) for x in sums))
    below = F.broadcast(_below(totals, [], "_cell", sums))
    inside = Window.partitionBy("_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(below, "_cell")
    return out.select(*df.columns, *((F.col(f"before_{x}") + F.sum(x).over(inside)).alias(f"total_{x}") for x in sums)).drop("_cell")


def trailing_mean(df: DataFrame, keys: list[str], order: str, value: str, n: int, block: int = 100_000) -> DataFrame:
    """WIN-11: df with `mean`, over the last n values up to and with this one in an order without ties.

    Rows are numbered and cut into blocks; the last n - 1 of a block are given to the next one as well.
    """
    rows = positions(df, keys, order, order).withColumn("_block", F.floor(F.col("pos") / block).cast("int"))
    halo = rows.filter(F.col("pos") % block > block - n).withColumn("_block", F.col("_block") + 1).withColumn("_own", F.lit(False))
    last = Window.partitionBy(*keys, "_block").orderBy("pos").rowsBetween(1 - n, 0)
    every = rows.withColumn("_own", F.lit(True)).unionByName(halo).withColumn("mean", F.avg(value).over(last))
    return every.filter("_own").drop("_own", "_block", "pos", "of")
