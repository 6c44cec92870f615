"""Stages of the training-data pipeline: toxicity, exact copies, near copies, benchmark passages, then token ids.

STAGES lists (name, function); a function takes (spark, docs, sf_dir), works on every row that its predecessor kept and
returns a DataFrame, which is written as Parquet and read again as the next one's docs. All but the last return the columns
of documents.

Each stage that filters keeps the rows of docs whole, further columns included. Null texts are empty: they are one text to
exact dedup, link with nothing, have no benchmark item and no token. Rows of an empty table give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.llm import decontaminate, exact_dedup, ngram_join, sentencepiece_codec, toxicity
from verdex.llm.common import fresh_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labelled documents of the whole table. Rows that repeat
    get one score and stay or go together, as do equal texts; a null doc_id has no label and is scored."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one of the least doc_id; of rows that repeat both, one; a null doc_id comes last."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the one of the least doc_id."""
    return ngram_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; a null or empty item is in none, and without items all stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left: doc_id, source, n_tokens, ids. A text of any length is encoded whole."""
    v = sentencepiece_codec.Vocabulary.load()
    return sentencepiece_codec.encode(docs, v).select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("sentencepiece", tokenise),
]

#: The toxicity classifier is fitted numerically and token ids need the vocabulary's merge order, so SQL can't give run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each but the last returns is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
