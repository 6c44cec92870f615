"""n-gram overlap joins over 64-bit hashes of the n-grams, so that no n-gram's text is moved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdex.functions import text as T

#: n-grams of the items' side, at most, that are broadcast (16 bytes each); more of them meet the documents' in a shuffle.
BROADCAST = 2_000_000


def gram_rows(df: DataFrame, key: str, n: int = 8) -> DataFrame:
    """(key, g): one row per distinct n-gram of a row; df has the key and the word array w."""
    return df.select(key, F.explode(T.gram_hashes(F.col("w"), n)).alias("g"))


def _meet(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """docs' n-grams joined with the items': by broadcast if the items' are counted to be few, so no n-gram of a document that
    no item has is moved; else dealt by hash, with Spark's runtime filter in front."""
    small = grams.limit(BROADCAST + 1).count() <= BROADCAST
    return docs.join(F.broadcast(grams) if small else grams, "g")


def containment(docs: DataFrame, items: DataFrame, n: int = 8) -> DataFrame:
    """Per document with a shared n-gram: hits of its best item, its own n-gram count and their ratio (JOIN-01).

    docs: (id, w), items: (pid, w). The per-(id, pid) count combines on the map side.
    """
    grams = docs.select("id", T.gram_hashes(F.col("w"), n).alias("grams")).select("id", F.size("grams").alias("n_grams"), F.explode("grams").alias("g"))
    hits = _meet(grams, gram_rows(items, "pid", n)).groupBy("id", "n_grams", "pid").agg(F.count("*").alias("hits"))
    best = hits.groupBy("id", "n_grams").agg(F.max("hits").alias("hits"))
    return best.withColumn("containment", F.col("hits") / F.col("n_grams"))


def both_ways(docs: DataFrame, items: DataFrame, n: int = 8, most: int = 200, least: int = 8, over: float = 0.15) -> DataFrame:
    """(id, pid, shared, containment) of pairs that share `least` n-grams and over a share of either side's (JOIN-02).

    n-grams of more than `most` items leave on both sides first, which also bounds the fan-out of the join; of what a row
    has left is known from its own count and how many of its n-grams left, so its n-grams aren't dealt again.
    """
    b = gram_rows(items, "pid", n)
    df = b.groupBy("g").agg(F.count("*").alias("df"))
    items_left = b.join(df.filter(F.col("df") <= most).select("g"), "g")
    grams = docs.select("id", T.gram_hashes(F.col("w"), n).alias("grams")).select("id", F.size("grams").alias("na"), F.explode("grams").alias("g"))
    stopped = df.filter(F.col("df") > most).select("g")
    shared = _meet(grams, items_left).groupBy("id", "na", "pid").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)
    sizes = items_left.groupBy("pid").agg(F.count("*").alias("nb"))
    full = shared.join(sizes, "pid")
    if not stopped.isEmpty():
        lost = _meet(grams, stopped).groupBy("id").agg(F.count("*").alias("lost"))
        full = full.join(lost, "id", "left").withColumn("na", F.col("na") - F.coalesce("lost", F.lit(0))).drop("lost")
    return full.withColumn("containment", F.greatest(F.col("shared") / F.col("na"), F.col("shared") / F.col("nb"))).filter(F.col("containment") > over)


def suite_summary(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """AGG-12: per suite of the items (pid, suite): its items, the pairs flagged (not rows) and their largest containment."""
    told = pairs.join(items.select("pid", "suite"), "pid").groupBy("suite").agg(F.count("*").alias("flagged"), F.max("containment").alias("max_containment"))
    return items.groupBy("suite").agg(F.count("*").alias("items")).join(told, "suite", "left").select("suite", "items", F.coalesce("flagged", F.lit(0)).alias("flagged"), "max_containment")


def worst(pairs: DataFrame, k: int = 5) -> DataFrame:
    """SRT-02: the k pairs of largest containment, then largest id and item."""
    return pairs.orderBy(F.desc("containment"), F.desc("id"), F.desc("pid")).limit(k)
