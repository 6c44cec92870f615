"""Searches over the embeddings: every row whose id is divisible by 50 against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.operators import vectors
from verdex.plans.registry import query
from verdex.sources.tables import table

#: These vectors hardly cluster (a 20th neighbour has a cosine of 0.3), so nine tenths of the neighbours need most of the lists:
#: of 2,000 rows, 32 of 64 lists find 0.87, 40 find 0.94 and 48 find 0.97.
LISTS, PROBES, K = 64, 48, 20

_PAIRS = """q AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), b AS (SELECT vec_id AS neighbour, embedding::DOUBLE[] AS w FROM embeddings),
p AS (SELECT id, neighbour, round(list_cosine_similarity(v, w), 9) AS cos FROM q JOIN b ON id <> neighbour), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cos DESC, neighbour) AS rank FROM p)"""


def _queries(df: DataFrame) -> DataFrame:
    return df.filter("vec_id % 50 = 0")


@query("nearest_exact", f"WITH {_PAIRS} SELECT id, neighbour, round(cos, 6) AS cos, rank::INT AS rank FROM r WHERE rank <= {K}")
def nearest_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEC-11, AGG-21: the 20 nearest of each query by comparing it with every row."""
    rows = table(spark, sf_dir, "embeddings")
    return vectors.exact_top_k(rows, _queries(rows), K).withColumn("cos", F.round("cos", 6))


@query("nearest_shortlists", f"WITH {_PAIRS}, s AS (SELECT unnest([20, 10, 5]) AS size) SELECT id, size::INT AS size, string_agg(neighbour, ',' ORDER BY rank) AS options FROM r JOIN s ON rank <= size GROUP BY id, size")
def nearest_shortlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEC-11: shortlists of 20, 10 and 5 options, from the index with all lists probed."""
    rows = table(spark, sf_dir, "embeddings")
    top = vectors.index_top_k(rows, _queries(rows), vectors.fit_centroids(rows, LISTS), K, LISTS)
    return vectors.shortlists(top).withColumn("options", F.array_join(F.transform("options", lambda x: x.cast("string")), ","))


@query("nearest_recall", "SELECT 0.9 <= 1 AS enough, count(*) * 20 AS n FROM embeddings WHERE vec_id % 50 = 0")
def nearest_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEC-11: whether the index, at PROBES of LISTS lists, finds nine tenths of the exact neighbours; n: how many those are."""
    rows = table(spark, sf_dir, "embeddings")
    found = vectors.index_top_k(rows, _queries(rows), vectors.fit_centroids(rows, LISTS), K, PROBES)
    got = vectors.recall(found, vectors.exact_top_k(rows, _queries(rows), K))
    return got.select((F.col("recall") >= 0.9).alias("enough"), "n")
