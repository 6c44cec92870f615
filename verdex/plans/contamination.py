"""Contamination between documents and benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.functions import text as T
from verdex.operators.overlap import both_ways, containment, suite_summary, worst
from verdex.plans.registry import query
from verdex.sources.tables import spread, table

GRAMS_SQL = """
  {name}_w AS (SELECT {key} AS {id}, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {table}),
  {name} AS (SELECT DISTINCT {id}, g FROM (SELECT {id}, unnest(list_transform(generate_series(1, len(w) - 7), lambda i: array_to_string(w[i:i+7], ' '))) AS g FROM {name}_w WHERE len(w) >= 8))"""
DOC_GRAMS = GRAMS_SQL.format(name="dg", key="doc_id", id="id", table="documents")
ITEM_GRAMS = GRAMS_SQL.format(name="bg", key="item_id", id="pid", table="benchmark")


@query(
    "contamination",
    f"""WITH {DOC_GRAMS}, {ITEM_GRAMS},
  n AS (SELECT id, count(*) AS n_grams FROM dg GROUP BY id),
  h AS (SELECT id, pid, count(*) AS hits FROM dg JOIN bg USING (g) GROUP BY id, pid),
  m AS (SELECT id, max(hits) AS hits FROM h GROUP BY id)
SELECT id AS doc_id, hits, n_grams, hits / n_grams AS containment, hits / n_grams > 0.15 AS excluded FROM m JOIN n USING (id)""",
)
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-01: share of a document's 8-grams that its closest benchmark item has; over 0.15 it is excluded."""
    docs = _docs(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pid"), T.words(F.col("text")).alias("w"))
    return containment(docs, items).select(F.col("id").alias("doc_id"), "hits", "n_grams", "containment", (F.col("containment") > 0.15).alias("excluded"))


@query("ngram_df", f"WITH {ITEM_GRAMS} SELECT g, count(*) AS df FROM bg GROUP BY g")
def ngram_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11: items per n-gram."""
    return _items(spark, sf_dir).select("pid", F.explode(T.word_ngrams(F.col("w"))).alias("g")).groupBy("g").agg(F.count("*").alias("df"))


@query(
    "overlap_bidirectional",
    f"""WITH {DOC_GRAMS}, {ITEM_GRAMS}, stop AS (SELECT g FROM bg GROUP BY g HAVING count(*) > 200),
  a AS (SELECT * FROM dg WHERE g NOT IN (SELECT g FROM stop)), b AS (SELECT * FROM bg WHERE g NOT IN (SELECT g FROM stop)),
  na AS (SELECT id, count(*) AS na FROM a GROUP BY id), nb AS (SELECT pid, count(*) AS nb FROM b GROUP BY pid),
  h AS (SELECT id, pid, count(*) AS shared FROM a JOIN b USING (g) GROUP BY id, pid HAVING count(*) >= 8)
SELECT id AS doc_id, pid AS item_id, shared, greatest(shared / na, shared / nb) AS containment FROM h JOIN na USING (id) JOIN nb USING (pid) WHERE greatest(shared / na, shared / nb) > 0.15""",
)
def overlap_bidirectional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-02, AGG-12: pairs with 8 shared n-grams or more that hold over 0.15 of either side, without n-grams of over 200 items."""
    docs = _docs(spark, sf_dir)
    return both_ways(docs, _items(spark, sf_dir)).select(F.col("id").alias("doc_id"), F.col("pid").alias("item_id"), "shared", "containment")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), T.words(F.col("text")).alias("w"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pid"), T.words(F.col("text")).alias("w"))


SUITE = "CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END"


@query("suite_overlap", f"""WITH {DOC_GRAMS}, {ITEM_GRAMS}, na AS (SELECT id, count(*) AS na FROM dg GROUP BY id), nb AS (SELECT pid, count(*) AS nb FROM bg GROUP BY pid),
  h AS (SELECT id, pid, count(*) AS s FROM dg JOIN bg USING (g) GROUP BY id, pid HAVING count(*) >= 8), p AS (SELECT pid AS item_id, greatest(s / na, s / nb) AS c FROM h JOIN na USING (id) JOIN nb USING (pid))
SELECT suite, items, coalesce(flagged, 0) AS flagged, c AS max_containment FROM (SELECT {SUITE} AS suite, count(*) AS items FROM benchmark GROUP BY 1)
  LEFT JOIN (SELECT {SUITE} AS suite, count(*) AS flagged, max(c) AS c FROM p WHERE c > 0.15 GROUP BY 1) USING (suite)""")  # fmt: skip
def suite_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12: items of a suite, pairs flagged, largest containment. No n-gram is in over 200 items of these tables."""
    docs = _docs(spark, sf_dir)
    suites = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pid"), F.expr(SUITE).alias("suite"))
    return suite_summary(both_ways(docs, _items(spark, sf_dir)), suites)


@query("worst_overlaps", f"""WITH {DOC_GRAMS}, {ITEM_GRAMS}, na AS (SELECT id, count(*) AS na FROM dg GROUP BY id), nb AS (SELECT pid, count(*) AS nb FROM bg GROUP BY pid),
  h AS (SELECT id, pid, count(*) AS s FROM dg JOIN bg USING (g) GROUP BY id, pid HAVING count(*) >= 8)
SELECT id, pid, greatest(s / na, s / nb) AS containment FROM h JOIN na USING (id) JOIN nb USING (pid) WHERE greatest(s / na, s / nb) > 0.15 ORDER BY 3 DESC, 1 DESC, 2 DESC LIMIT 5""")  # fmt: skip
def worst_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-02: the five pairs of largest containment."""
    docs = _docs(spark, sf_dir)
    return worst(both_ways(docs, _items(spark, sf_dir))).select("id", "pid", "containment")
