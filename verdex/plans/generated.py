"""Generated cases, nested JSON and counters in the same pass, over what the tables give."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.operators import nested
from verdex.plans.registry import query
from verdex.sources import sampled
from verdex.sources.tables import table

ATTRIBUTES = [["amount", "int", [1, 100]], ["urgent", "bool", []], ["region", "enum", ["north", "south", "west"]]]
ACCEPT = [["amount", ">", 40], ["region", "in", ["north", "west"]]]

_DRAW = "('0x' || substr(md5('7:{}:' || number || ':' || attempt), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(
    "rejection_cases",
    f"""WITH a AS (SELECT number, attempt, number % 2 = 0 AS want, floor(1 + {_DRAW.format('amount')} * 100)::BIGINT AS amount, {_DRAW.format('urgent')} < 0.5 AS urgent,
['north', 'south', 'west'][floor({_DRAW.format('region')} * 3)::BIGINT + 1] AS region FROM range((SELECT count(*) FROM orders)) n(number), range(90) t(attempt)),
f AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY attempt) AS rn FROM a WHERE (amount > 40 AND region <> 'south') = want)
SELECT number, attempt, want AS holds, amount, urgent, region FROM f WHERE rn = 1""",
)
def rejection_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14, RUL-00: as many cases as there are orders, drawn until they are accepted, yes and no in turn."""
    sampled.register(spark)
    n = table(spark, sf_dir, "orders").count()
    options = {"n": str(n), "seed": "7", "attributes": json.dumps(ATTRIBUTES), "accept": json.dumps(ACCEPT), "balance": "true"}
    return spark.read.format("sampled_cases").options(**options).load()


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON record for each document, as a VARIANT: a list of its sentences, its questions and the answers to two of them."""
    docs = table(spark, sf_dir, "documents")
    sentence = F.transform(F.split(F.coalesce("text", F.lit("")), r"\. "), lambda s: F.named_struct(F.lit("chars"), F.length(s), F.lit("text"), s))
    kinds = F.create_map(*(x for k, t in (("lang", "choice"), ("source", "choice"), ("toxic", "noul")) for x in (F.lit(k), F.named_struct(F.lit("type"), F.lit(t)))))
    record = F.struct(sentence.alias("sentences"), kinds.alias("questions"), F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("answers"))
    return docs.select("doc_id", nested.parsed(F.to_json(record)).alias("v"))


@query("nested_sentences", "SELECT doc_id, i - 1 AS pos, length(s[i]) AS chars FROM (SELECT doc_id, string_split(coalesce(text, ''), '. ') AS s, unnest(range(1, len(s) + 1)) AS i FROM documents)")
def nested_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07, SRC-08: a row for each member of a record's list, in order."""
    rows = nested.members(records(spark, sf_dir), "v", "$.sentences")
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), nested.field("value", "$.chars", "bigint").alias("chars"))


@query("nested_answers", "SELECT doc_id, unnest(['lang', 'source', 'toxic']) AS key, unnest(['choice', 'choice', 'noul']) AS type, unnest([lang, source, NULL]) AS answer FROM documents")
def nested_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-09: each question of a record's map with its answer of the other map, null without one."""
    rows = nested.paired(records(spark, sf_dir), "v", "$.questions", "$.answers")
    return rows.select("doc_id", "key", F.try_variant_get("a", "$.type", "string").alias("type"), F.try_variant_get("b", "$", "string").alias("answer"))
