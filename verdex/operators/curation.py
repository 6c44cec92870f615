"""Curation of items: selection with reasons, running balance, dossiers and fillers of other topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdex.operators import items as I
from verdex.operators import ranks, scans

#: Shares of the dev split in 1/10000, of generated items and of others.
DEV_GEN, DEV_OTHER = 800, 400


def bucket(id: Column) -> Column:
    """PRJ-11: the first 8 hex digits of the id's sha1, modulo 10000."""
    return F.conv(F.substring(F.sha1(id.cast("string")), 1, 8), 16, 10).cast("bigint") % 10000


def exclusion_reason(id: Column, source: Column, reserved: tuple[str, ...]) -> Column:
    """FLT-02, FLT-09: why an excluded id is: its own mark, a reserved source, else contamination."""
    return F.when(F.contains(id, F.lit("-finqa-")), "excluded:finqa").when(F.coalesce(source.isin(*reserved), F.lit(False)), "excluded:reserved_rules").otherwise("excluded:contamination")


def select(rows: DataFrame, excluded: DataFrame, caps: dict[str, int], reserved: tuple[str, ...] = (), held: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """FLT-01 to FLT-04, FLT-09, WIN-01, AGG-08: rows with `src`, `reason` (null: selected) and `split`.

    rows: items with `file` and `ord`, their order in it. In order: the teacher disagrees (a missing verdict agrees), the id
    is excluded, the file's quota of the source (text before the first colon, `gen` without one) is used up, no target. A
    row without a target uses quota. Split: held out by a column's value, else dev by the id's hash, else train.

    Only sources with a quota are ranked, and a rank over the largest quota isn't looked at, so Spark keeps that many rows
    of a source and task before they meet.
    """
    src = F.split_part(F.when(F.coalesce("source", F.lit("")) != "", F.col("source")).otherwise("gen"), F.lit(":"), F.lit(1))
    rows = rows.withColumn("src", src).join(excluded.select("id").distinct().withColumn("_out", F.lit(True)), "id", "left")
    early = F.when(~F.coalesce("agree", F.lit(True)), "teacher_disagreed").when(F.col("_out"), exclusion_reason(F.col("id"), F.col("source"), reserved))
    rows = rows.withColumn("reason", early).drop("_out")
    capped = F.col("reason").isNull() & F.col("src").isin(*caps)
    cap = F.lit(None).cast("int")
    for name, n in caps.items():
        cap = F.when(F.col("src") == name, n).otherwise(cap)
    inside = Window.partitionBy("file", "src").orderBy("ord", "id")
    most = max(caps.values(), default=0)
    within = rows.filter(capped).withColumn("_n", F.row_number().over(inside)).filter(F.col("_n") <= most).filter(F.col("_n") <= cap).select("file", "src", "ord", "id", F.lit(True).alias("_in"))
    rows = rows.join(within, ["file", "src", "ord", "id"], "left")
    target = I.target()
    over = capped & F.col("_in").isNull()
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(over, "over_quota").when(target.isNull(), "no_target"))).drop("_in")
    out = F.lit(False)
    for name, values in (held or {}).items():
        out = out | F.coalesce(F.col(name).isin(*values), F.lit(False))
    dev = bucket(F.col("id")) < F.when(F.col("src") == "gen", DEV_GEN).otherwise(DEV_OTHER)
    return rows.withColumn("split", F.when(F.col("reason").isNull(), F.when(out, "heldout").when(dev, "validation").otherwise("train")))


def balanced(rows: DataFrame, key: str, order: str, label: str, slack: int = 5) -> DataFrame:
    """WIN-09: rows (key, order, label yes or no) with `accepted`: a row of the class that leads by more than slack is not."""
    return scans.balanced(rows, [key], order, label, slack)


def fillers(targets: DataFrame, pool: DataFrame, n: int = 400, seed: str = "17") -> DataFrame:
    """JOIN-15: (target, filler, at) of up to n pool items for each target, in a seeded order, less those of its own topic.

    targets and pool: (id, topic). All of the pool stands in a circle by seeded hash, numbered from 0; a target takes n in a
    row from a place of its own, so pairs number n per target, and the two meet by number in an equi-join. The numbers come
    from counted cells, so no task orders the pool.
    """
    numbered = ranks.positions(pool.select(F.col("id").alias("filler"), F.col("topic").alias("other"), F.xxhash64(F.lit(seed), F.col("id").cast("string")).alias("_h")), [], "_h", "filler")
    circle = numbered.select("filler", "other", F.col("pos").alias("number"))
    size = pool.count()
    if not size:
        return targets.select(F.col("id").alias("target"), F.col("id").alias("filler"), F.lit(0).alias("at")).limit(0)
    start = F.pmod(F.xxhash64(F.lit(seed), F.col("id").cast("string")), F.lit(size))
    asked = targets.select(F.col("id").alias("target"), "topic", F.posexplode(F.sequence(F.lit(0), F.lit(min(n, size) - 1))).alias("at", "k"), start.alias("start"))
    asked = asked.withColumn("number", (F.col("start") + F.col("k")) % size)
    return asked.join(circle, "number").filter(~F.col("topic").eqNullSafe(F.col("other")) & ~F.col("target").eqNullSafe(F.col("filler"))).select("target", "filler", "at")


def first_of_each(rows: DataFrame, caps: dict[str, int], keys: tuple[str, ...] = ("file",), source: str = "src", order: tuple[str, str] = ("ord", "id")) -> DataFrame:
    """WIN-01: rows with `place`, the running count from 1 in order of each key and source: of a source with a cap the first
    so many rows, of a source without one every row. Of capped sources Spark keeps no more rows per task than the largest
    cap; other rows are numbered by counted cells, so an uncapped source may hold any share of the rows. The order is a
    number and its tie."""
    capped = F.coalesce(F.col(source).isin(*caps), F.lit(False)) if caps else F.lit(False)
    cap = F.lit(None).cast("int")
    for name, n in caps.items():
        cap = F.when(F.col(source) == name, n).otherwise(cap)
    inside = Window.partitionBy(*keys, source).orderBy(*order)
    first = rows.filter(capped).withColumn("place", F.row_number().over(inside)).filter(F.col("place") <= max(caps.values(), default=0)).filter(F.col("place") <= cap)
    others = rows.filter(~capped).withColumn("_of", F.struct(*keys, source))  # as one column, in which nulls are equal
    others = ranks.positions(others, ["_of"], *order).withColumn("place", F.col("pos") + 1)
    return first.withColumn("place", F.col("place").cast("bigint")).unionByName(others.select(*rows.columns, "place"))


def dossiers(pairs: DataFrame, texts: DataFrame, budget: Column, seed: str = "17") -> DataFrame:
    """WIN-08: (id, docs, place): the documents of each target's dossier in order and where the target itself stands, from 0.

    pairs: (target, filler, at); texts: (id, n) with the characters of each; budget: of the target's row (id, n). Fillers
    join in order until the next one would exceed the budget; there it stops, whatever comes later. The place is seeded.
    """
    own = texts.select(F.col("id").alias("target"), F.col("n").alias("used"), budget.alias("budget"))
    asked = pairs.join(texts.select(F.col("id").alias("filler"), "n"), "filler").join(own, "target")
    upto = Window.partitionBy("target").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    asked = asked.withColumn("sum", F.col("used") + F.sum("n").over(upto)).withColumn("ok", F.max((F.col("sum") > F.col("budget")).cast("int")).over(upto) == 0)
    packed = asked.filter("ok").groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "filler"))), lambda x: x["filler"]).alias("docs"))
    empty = F.array().cast(packed.schema["docs"].dataType)
    out = own.select("target").join(packed, "target", "left").select(F.col("target").alias("id"), F.coalesce("docs", empty).alias("docs"))
    return out.withColumn("place", F.pmod(F.xxhash64(F.lit(f"{seed}:place"), F.col("id").cast("string")), F.size("docs") + 1).cast("int"))


def keep_first(rows: DataFrame, key: Column, order: str, id: str, answer: str) -> DataFrame:
    """WIN-02: (id, copies, conflict): of rows with one key the id of the first by order, how many there are, and whether their
    answers differ (a null is an answer of its own). All of it is aggregates, which combine before rows meet, so a key with any
    share of the rows, such as that of empty texts, is one row per task. Equal orders go to the smaller id."""
    said = F.coalesce(F.concat(F.lit("="), F.col(answer).cast("string")), F.lit(""))
    told = rows.groupBy(key.alias("_key")).agg(F.min(F.struct(F.col(order).alias("o"), F.col(id).alias("i"))).alias("_first"), F.count("*").alias("copies"), (F.min(said) != F.max(said)).alias("conflict"))
    return told.select(F.col("_first.i").alias(id), "copies", "conflict")


def drop_list(*reports: DataFrame) -> DataFrame:
    """JOIN-14, SET-01: (id, reports) of ids that some report names, each once, with how many do; a report may name one twice."""
    out = None
    for k, r in enumerate(reports):
        one = r.select("id", F.lit(k).alias("report")).distinct()
        out = one if out is None else out.unionByName(one)
    return out.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("reports"))


def released(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose id isn't on the list; a null id is on none."""
    return rows.join(dropped.select("id"), "id", "left_anti").select(rows.columns)
