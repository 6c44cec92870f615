"""Prediction logs as JSON lines made from the tables, joined with a suite's metadata, and what items show to a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.operators import decisions as D
from verdex.operators import items as I
from verdex.operators import textops as X
from verdex.plans import releases
from verdex.plans.registry import query
from verdex.sources.tables import table


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each document: ids and tasks under several names, `correct` (perhaps null) or `ok`, conf or probs, errors."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    id, n = F.col("doc_id"), F.col("n_chars")
    text = lambda c: c.cast("string")
    name = F.when(id % 2 == 0, F.concat(F.lit('"id": "'), text(id), F.lit('", "task": "'), "source", F.lit('"'))).otherwise(F.concat(F.lit('"task_id": "'), text(id), F.lit('", "cfg": "'), "lang", F.lit('"')))
    right = F.when(id % 3 == 0, F.concat(F.lit(', "correct": '), F.coalesce(text(F.col("toxic")), F.lit("null")), F.lit(', "ok": true'))).otherwise(F.concat(F.lit(', "ok": '), F.when(F.col("quality") == 1, "true").otherwise("false")))
    sure = F.when(id % 13 == 0, ', "err": "timeout"').when(n % 4 != 0, F.concat(F.lit(', "conf": '), text((n % 100) / 100))).otherwise(F.concat(F.lit(', "probs": {"a": '), text((n % 10) / 10), F.lit(', "b": 0.35}')))
    return d.select(F.concat(F.lit("{"), name, right, sure, F.lit("}")).alias("value"))


_LOG = """p AS (SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS task, source, lang, n_chars AS n,
coalesce(CASE WHEN doc_id % 3 = 0 THEN toxic = 1 ELSE quality = 1 END, FALSE) AND doc_id % 13 <> 0 AS ok,
CASE WHEN doc_id % 13 <> 0 THEN CASE WHEN n_chars % 4 <> 0 THEN (n_chars % 100) / 100.0::DOUBLE ELSE greatest((n_chars % 10) / 10.0::DOUBLE, 0.35) END END AS conf FROM documents LEFT JOIN labels USING (doc_id))"""


@query("prediction_lines", f"WITH {_LOG} SELECT id, task, ok, conf FROM p")
def prediction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-14: prediction lines in their several shapes as one log."""
    return D.predictions(lines(spark, sf_dir))


@query(
    "suite_accuracy",
    f"""WITH {_LOG} SELECT CASE WHEN source = 'src0' AND lang IN ('en', 'de') THEN 'legalbench' ELSE task END AS task, CASE WHEN lang IN ('en', 'de') THEN CASE WHEN n % 2 = 0 THEN 'noul' ELSE 'choice' END END AS qtype,
count(*) AS n, round(avg(ok::INT), 9) AS acc FROM p GROUP BY ALL""",
)
def suite_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-11, PRJ-15, AGG-01: predictions with the suite's metadata, where it has the item; accuracy by rolled-up task and type."""
    docs = table(spark, sf_dir, "documents").filter("lang IN ('en', 'de')")
    kind = F.when(F.col("n_chars") % 2 == 0, "noul").otherwise("choice")
    suite = docs.select(F.col("doc_id").cast("string").alias("id"), kind.alias("qtype"), F.lit(2).alias("n_opts"), F.when(F.col("source") == "src0", F.concat(F.lit("legalbench_"), "lang")).alias("task"))
    log = D.with_suite(D.predictions(lines(spark, sf_dir)), suite)
    return log.groupBy(D.rollup(F.col("task")).alias("task"), "qtype").agg(F.count("*").alias("n"), F.round(F.avg(F.col("ok").cast("double")), 9).alias("acc"))


_K = """k AS (SELECT 'd' || d.doc_id AS id, coalesce(text, '') AS state, lang, toxic, CASE WHEN source = 'src5' THEN '' ELSE 'Which answer fits?' END AS ins, CASE n_chars % 8 WHEN 0 THEN 'noul' WHEN 4 THEN 'noul' WHEN 2 THEN 'score' WHEN 6 THEN 'score' WHEN 7 THEN 'rank' ELSE 'choice' END AS kind
FROM documents d LEFT JOIN labels USING (doc_id) WHERE source <> 'src7')"""
_CRITERIA = """CASE kind WHEN 'noul' THEN CASE WHEN lang = 'fr' THEN '{"true": "it is"}' ELSE '{"false": "it isn''t", "true": "it is"}' END WHEN 'score' THEN CASE WHEN lang = 'es' THEN '["low", "high"]' ELSE '["low", "middle", "high"]' END ELSE '{"a": "first", "b": "second", "unknown": "neither"}' END"""
_OPTIONS = "CASE kind WHEN 'noul' THEN 'A. yes: it is' || chr(10) || 'B. no: ' || CASE WHEN lang = 'fr' THEN 'no' ELSE 'it isn''t' END WHEN 'score' THEN 'A. 0: low' || chr(10) || CASE WHEN lang = 'es' THEN 'B. 1: high' ELSE 'B. 1: middle' || chr(10) || 'C. 2: high' END ELSE 'A. a: first' || chr(10) || 'B. b: second' || chr(10) || 'C. unknown: neither' END"


@query(
    "item_fields",
    f"""WITH {_K} SELECT id, sha256(state || ' ' || ins) AS text, substr(sha1(state || '{{"criteria": ' || {_CRITERIA} || ', "instructions": "' || ins || '", "type": "' || kind || '"}}'), 1, 16) AS content,
sha256('State:' || chr(10) || state || chr(10) || chr(10) || 'Question: ' || ins || chr(10) || chr(10) || 'Options:' || chr(10) || {_OPTIONS} || chr(10) || chr(10) || 'Answer with the letter of the correct option.') AS prompt,
kind = 'noul' AND coalesce(toxic <> 1, TRUE) AS wrong, kind = 'score' OR kind = 'noul' AND toxic IS NULL OR kind IN ('choice', 'rank') AND coalesce(toxic = 0, FALSE) AS degenerate FROM k""",
)
def item_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-02, PRJ-10, PRJ-16, PRJ-26, FLT-06, FLT-11: digests of an item's text and prompt, its content id, and two checks of its answer."""
    rows = releases.items(spark, sf_dir).filter(~F.col("id").startswith("x-finqa-")).withColumn("options", I.options())
    prompt = I.prompt(F.col("options"), X.option_codes(), "plain")
    return rows.select("id", F.sha2(I.text(), 256).alias("text"), I.content_id().alias("content"), F.sha2(prompt, 256).alias("prompt"), I.wrong_target(F.lit("yes")).alias("wrong"), I.degenerate(F.col("labels"), F.col("expected")).alias("degenerate"))


@query(
    "options_back",
    """SELECT 'd' || doc_id AS id, CASE WHEN n_chars % 4 <> 2 THEN 'a|b|unknown' WHEN lang = 'es' THEN '0|1' ELSE '0|1|2' END AS labels,
CASE WHEN n_chars % 4 <> 2 THEN 'first|second|neither' WHEN lang = 'es' THEN 'low|high' ELSE 'low|middle|high' END AS described FROM documents WHERE n_chars % 8 NOT IN (0, 4, 7) AND source <> 'src7'""",
)
def options_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-03, PRJ-04: labels and what describes them of choice and score questions, from their options and back."""
    rows = releases.items(spark, sf_dir).filter("qtype IN ('choice', 'score') AND id NOT LIKE 'x-finqa-%'").withColumn("options", I.options())
    labels, criteria, levels = I.question_of(F.col("qtype"), F.col("options"))
    return rows.select("id", F.array_join(labels, "|").alias("labels"), F.array_join(F.coalesce(levels, F.map_values(criteria)), "|").alias("described"))
