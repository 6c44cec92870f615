"""Curation over literal items, with the rows that they must give, and over tables against SQL written apart."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.operators import curation as C
from verdex.operators import ranks
from verdex.plans.cases import cases
from verdex.plans.registry import query
from verdex.sources.tables import table

PROBS = {"yes": 0.5, "no": 0.5}
# (file, ord, id, agree, source, family, gold, teacher, reason)
SELECTED = [
    ("a", 0, "a0", None, None, None, None, PROBS, None), ("a", 1, "a1", False, "s:x", None, None, PROBS, "teacher_disagreed"), ("a", 2, "x-finqa-1", True, "s", None, None, PROBS, "excluded:finqa"),
    ("a", 3, "a3", True, "rule", None, None, PROBS, "excluded:reserved_rules"), ("a", 4, "a4", True, "s", None, None, PROBS, "excluded:contamination"), ("a", 5, "a5", True, "s:x", None, None, None, "no_target"),
    ("a", 6, "a6", True, "s", None, {}, PROBS, None), ("a", 7, "a7", True, "s:y:z", None, PROBS, None, "over_quota"), ("b", 0, "b0", True, "s", None, {"yes": 0.0}, PROBS, "no_target"),
    ("b", 1, "b1", True, "s", "held", {"yes": -1.0, "no": 2.0}, None, None), ("b", 2, "b2", True, "", None, None, PROBS, None), ("b", 3, "b3", True, "t", None, None, PROBS, None), ("b", 4, "b4", False, "s", None, None, PROBS, "teacher_disagreed"),
]


def _split(id: str, source: str | None, family: str | None, reason: str | None) -> str | None:
    if reason:
        return None
    share = 800 if (source or "gen").split(":")[0] == "gen" else 400
    return "heldout" if family == "held" else "validation" if int(hashlib.sha1(id.encode()).hexdigest()[:8], 16) % 10000 < share else "train"


def _selection(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([x[:8] for x in SELECTED], "file string, ord int, id string, agree boolean, source string, family string, gold_probs map<string,double>, teacher_probs map<string,double>")
    excluded = spark.createDataFrame([("x-finqa-1",), ("a3",), ("a4",), ("a4",), ("absent",)], "id string")
    return C.select(rows, excluded, {"s": 2, "t": 1}, ("rule",), {"family": ("held",)})


@cases("selection_rows", "id varchar, reason varchar, split varchar", [(x[2], x[8], _split(x[2], x[4], x[5], x[8])) for x in SELECTED])
def selection_rows(spark: SparkSession) -> DataFrame:
    """FLT-01 to FLT-04, FLT-09, WIN-01: every reason in order; a row without a target uses quota, a rejected one doesn't; quotas are per file."""
    return _selection(spark).select("id", "reason", "split")


@cases("selection_counts", "reason varchar, n bigint", [(r, sum(x[8] == r for x in SELECTED)) for r in sorted({x[8] for x in SELECTED if x[8]})])
def selection_counts(spark: SparkSession) -> DataFrame:
    """AGG-08: rejected rows by reason."""
    return _selection(spark).filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


BALANCE = [("k", i, x) for i, x in enumerate("nnnnnnnnynnyyyyyyyyyyyyyyyyn")] + [("l", 0, "y"), ("l", 1, "?")]


def _balance() -> list[tuple]:
    out, count = [], {}
    for k, i, x in BALANCE:
        x = {"n": "no", "y": "yes"}.get(x, "maybe")
        ok = x == "maybe" or count.get((k, x), 0) <= count.get((k, "yes" if x == "no" else "no"), 0) + 5
        count[k, x] = count.get((k, x), 0) + ok
        out.append((k, i, ok))
    return out


@cases("running_balance", "k varchar, i bigint, accepted boolean", _balance())
def running_balance(spark: SparkSession) -> DataFrame:
    """WIN-09: a class that leads by more than five waits; other labels pass."""
    rows = spark.createDataFrame([(k, i, {"n": "no", "y": "yes"}.get(x, "maybe")) for k, i, x in BALANCE], "k string, i bigint, label string")
    return C.balanced(rows.repartition(3), "k", "i", "label").select("k", "i", "accepted")


@query("class_balance", """WITH i AS (SELECT doc_id AS id, lang, toxic AS expected FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL),
n AS (SELECT lang, least(count(*) FILTER (expected = 1), count(*) FILTER (expected = 0)) AS k FROM i GROUP BY lang)
SELECT lang, expected, k AS n, k AS ids FROM n, (SELECT unnest([0, 1]) AS expected) WHERE k > 0""")  # fmt: skip
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-06: of each language as many items of one class as of the other, in a seeded order; counted, as the order is of another hash."""
    i = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").filter("toxic IS NOT NULL").select("doc_id", F.col("toxic").alias("expected")), "doc_id")
    n = i.groupBy("lang").agg(F.least(F.count_if(F.col("expected") == 1), F.count_if(F.col("expected") == 0)).alias("k"))
    kept = ranks.first_k(i.join(F.broadcast(n), "lang"), ["lang", "expected"], "7", "doc_id", "k")
    return kept.groupBy("lang", "expected").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"))


@query("other_topic_pairs", """SELECT doc_id AS target, true AS enough, 0 AS own_topic FROM documents""")
def other_topic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-15: up to 400 fillers for every document; none of its own topic, and as many as the draw has of others. A null source is a topic."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("topic"))
    pairs = C.fillers(docs, docs, 40).join(docs.select(F.col("id").alias("filler"), F.col("topic").alias("other")), "filler")
    told = pairs.join(docs.select(F.col("id").alias("target"), "topic"), "target").groupBy("target").agg(F.count("*").alias("n"), F.count_if(F.col("topic").eqNullSafe(F.col("other"))).cast("int").alias("own_topic"))
    return docs.select(F.col("id").alias("target")).join(told, "target", "left").select("target", (F.coalesce("n", F.lit(0)) >= 20).alias("enough"), F.coalesce("own_topic", F.lit(0)).alias("own_topic"))


PACK = {"t": [("a", 40), ("b", 50), ("c", 30), ("d", 1)], "u": [("a", 200), ("b", 1)], "v": []}


@cases("dossier_pack", "id varchar, docs varchar, inside boolean", [("t", "a,b", True), ("u", "", True), ("v", "", True)])
def dossier_pack(spark: SparkSession) -> DataFrame:
    """WIN-08: documents join until the next would exceed the budget; a later one that would fit doesn't; the target counts."""
    pairs = spark.createDataFrame([(t, f, i) for t, rows in PACK.items() for i, (f, _) in enumerate(rows)], "target string, filler string, at int")
    texts = spark.createDataFrame([("t", 10), ("u", 10), ("v", 10), ("a", 40), ("b", 50), ("c", 30), ("d", 1)], "id string, n int")
    sized = C.dossiers(pairs.filter("target <> 'u'").union(spark.createDataFrame([("u", "big", 0), ("u", "d", 1)], "target string, filler string, at int")), texts.union(spark.createDataFrame([("big", 200)], "id string, n int")), F.lit(100))
    return sized.filter("id IN ('t', 'u', 'v')").select("id", F.array_join("docs", ",").alias("docs"), F.col("place").between(0, F.size("docs")).alias("inside"))


@query("trailing_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 79 PRECEDING AND CURRENT ROW), 9) AS mean80 FROM events")
def trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-11: mean of the last 80 values of a type, block by block."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return ranks.trailing_mean(e, ["event_type"], "event_id", "value", 80).select("event_id", F.round("mean", 9).alias("mean80"))


@query("percentile_nearest", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(CASE WHEN i = floor(0.95 * (n - 1) + 0.5) THEN value END) AS p95_rounded, max(CASE WHEN i = floor(n / 2) THEN value END) AS median_upper, max(CASE WHEN i = floor(0.95 * n) THEN value END) AS p95_floor FROM r GROUP BY event_type""")  # fmt: skip
def percentile_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13: order statistics by position, three conventions of the index; positions come from counted cells."""
    e = ranks.positions(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], "value", "event_id")
    at = lambda i: F.max(F.when(F.col("pos") == F.floor(i), F.col("value")))
    n = F.col("of")
    return e.groupBy("event_type").agg(at(0.95 * (n - 1) + 0.5).alias("p95_rounded"), at(n / 2).alias("median_upper"), at(0.95 * n).alias("p95_floor"))


@query("agree_rate", """WITH g AS (SELECT floor(event_id / 500) AS k, count(*) AS n, count(*) FILTER (event_type = 'click') AS hits FROM events GROUP BY 1)
SELECT cast(k as bigint) AS k, cast(sum(n) OVER (ORDER BY k) as bigint) AS total, round(sum(hits) OVER (ORDER BY k) / sum(n) OVER (ORDER BY k), 9) AS rate FROM g""")  # fmt: skip
def agree_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-27, STM-04: cumulative counts and agreement by interval; a stream tells them in metrics_stream."""
    e = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 500).alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("hits"))
    r = ranks.running(e, "k", ["n", "hits"])
    return r.select("k", F.col("total_n").alias("total"), F.round(F.col("total_hits") / F.col("total_n"), 9).alias("rate"))


@query("weighted_choice", """WITH w AS (SELECT source, count(*) AS n FROM documents GROUP BY source), c AS (SELECT source, sum(n) OVER (ORDER BY source NULLS FIRST) AS hi, sum(n) OVER () AS z FROM w),
u AS (SELECT doc_id, CAST(concat('0x', substr(sha1(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM documents)
SELECT doc_id, (SELECT arg_min(source, hi) FROM c WHERE u.u * z < hi) AS picked FROM u""")  # fmt: skip
def weighted_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-07: an option by cumulative weight for each item's hash, looked up in one array of the options (a list that a config holds)."""
    docs = table(spark, sf_dir, "documents")
    w = docs.groupBy("source").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("w"))
    table_ = F.broadcast(w.select("w", F.aggregate("w", F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<bigint>").alias("a")), lambda a, x: F.struct((a["s"] + x["n"]).alias("s"), F.concat(a["a"], F.array(a["s"] + x["n"])).alias("a"))).alias("c")))
    u = F.conv(F.substring(F.sha1(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    at = F.size(F.filter("c.a", lambda hi: hi <= u * F.col("c.s")))
    return docs.select("doc_id").crossJoin(table_).select("doc_id", F.get("w", at)["source"].alias("picked"))


@query("prefix_phases", """WITH p AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
SELECT CASE WHEN a = 1 THEN 1 WHEN b = 1 THEN 2 ELSE 3 END AS phase, count(*) AS n FROM p GROUP BY 1""")  # fmt: skip
def prefix_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-10: one request per prefix (role) first, then one per state (conversation), then the rest. The first of a key is a minimum."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    of_prefix = F.broadcast(c.groupBy("role").agg(F.min(F.struct("conv_id", "turn")).alias("first")))  # a row per prefix
    of_state = c.groupBy("conv_id").agg(F.min("turn").alias("turn0"))
    out = c.join(of_prefix, "role").join(of_state, "conv_id")
    phase = F.when(F.struct("conv_id", "turn") == F.col("first"), 1).when(F.col("turn") == F.col("turn0"), 2).otherwise(3)
    return out.groupBy(phase.alias("phase")).agg(F.count("*").alias("n"))
