"""Streaming queries: the batch forms are checked by SQL, these run the same logic as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.operators import decisions, fitting
from verdex.plans.cases import cases
from verdex.plans.registry import query
from verdex.sources.tables import table
from verdex.streaming import jobs, sessions


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern, as a stream takes no single file


@query("stream_windows", "SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time windows as a stream in complete mode."""
    return jobs.drain(spark, jobs.windowed_counts(stream(spark, sf_dir, "events")), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_sessions", "SELECT conv_id, cast(sum(length(text)) as bigint) AS state_chars, count(*) AS appends FROM conversations GROUP BY conv_id")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-05 as a stream of appends: the state of each session after all of them."""
    return jobs.drain(spark, jobs.append_sessions(stream(spark, sf_dir, "conversations")), "complete")


@query("metrics_stream", "SELECT time_bucket(INTERVAL '6 hours', ts) AS start, count(*) AS labelled, count(*) FILTER (event_type = 'click') AS agreed FROM events GROUP BY 1")
def metrics_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-04, AGG-27: labelled rows and those that agree, by interval, as a stream."""
    rows = stream(spark, sf_dir, "events").select("ts", (F.col("event_type") == "click").alias("agree"))
    return jobs.drain(spark, jobs.agreement(rows), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


REQUESTS = [
    ("a", 0, "append", "lost", 404, None, None), ("a", 1, "create", "one ", 200, 4, None), ("a", 2, "append", "two", 200, 7, None), ("a", 3, "evaluate", "o", 200, 7, "2"), ("a", 4, "append", None, 200, 7, None), ("a", 5, "rename", "x", 404, None, None),
    ("a", 6, "delete", None, 200, None, None), ("a", 7, "delete", None, 404, None, None), ("a", 8, "evaluate", "x", 404, None, None), ("a", 9, "create", "é", 200, 1, None), ("b", 1, "create", None, 200, 0, None), ("b", 2, "create", "new", 200, 3, None), ("c", 1, "delete", None, 404, None, None),
]


@cases("session_requests", "session varchar, seq bigint, op varchar, status int, chars bigint, answer varchar", [(s, k, o, *x) for s, k, o, _, *x in REQUESTS])
def session_requests(spark: SparkSession) -> DataFrame:
    """STM-05: create, append, evaluate and delete; unknown sessions and ops, a second delete, a session made again."""
    rows = spark.createDataFrame([x[:4] for x in REQUESTS], "session string, seq bigint, op string, text string")
    return jobs.session_log(rows.repartition(3), lambda text, question: str(text.count(question)))


@query(
    "session_stream",
    """SELECT CAST(conv_id AS VARCHAR) AS session, turn AS seq, CASE WHEN turn = first THEN 'create' WHEN role = 'assistant' THEN 'evaluate' ELSE 'append' END AS op, 200 AS status,
sum(CASE WHEN turn = first OR role <> 'assistant' THEN length(coalesce(text, '')) ELSE 0 END) OVER w AS chars,
CASE WHEN turn <> first AND role = 'assistant' THEN CAST(sum(CASE WHEN turn = first OR role <> 'assistant' THEN length(coalesce(text, '')) ELSE 0 END) OVER w AS VARCHAR) END AS answer
FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-05: each conversation as a session's requests: its first turn creates it, an assistant's turn asks, others append."""
    first = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first"))
    rows = stream(spark, sf_dir, "conversations").join(first, "conv_id")
    op = F.when(F.col("turn") == F.col("first"), "create").when(F.col("role") == "assistant", "evaluate").otherwise("append")
    requests = rows.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), op.alias("op"), "text")
    with sessions.rocksdb(spark):
        return jobs.drain(spark, sessions.stored_sessions(requests, lambda text, question: str(len(text))), "append")


@query("token_batches")
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-07: greedy batches under a token budget (sequential: no SQL)."""
    return jobs.token_batches(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars"))


def shorter(states: list[str], questions: list[list[list[str]]]) -> list[list[list[float]]]:
    """The default scorer: shorter options are likelier, whatever the state."""
    weights = [[[1 / (1 + len(x)) for x in o] for o in q] for q in questions]
    return [[[round(w / sum(o), 6) for w in o] for o in q] for q in weights]


@query("pluggable_scorer", """WITH o AS (SELECT doc_id AS id, [[lang, source, 'other'], ['yes', 'no']] AS q FROM documents), w AS (SELECT id, list_transform(q, lambda o: list_transform(o, lambda x: 1.0::DOUBLE / (1 + length(x)))) AS w FROM o)
SELECT id, array_to_string(list_transform(w, lambda o: array_to_string(list_transform(o, lambda x: format('{:.6f}', round(x / list_sum(o), 6))), ',')), ';') AS probs FROM w""")  # fmt: skip
def pluggable_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-01, DEC-08: two questions on each state, by the default scorer."""
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("state"), F.array(F.array("lang", "source", F.lit("other")), F.array(F.lit("yes"), F.lit("no"))).alias("questions"))
    each = lambda a: F.array_join(F.transform(a, lambda p: F.format_string("%.6f", p)), ",")
    return jobs.decide(items, shorter).select("id", F.array_join(F.transform("probs", each), ";").alias("probs"))


@query("global_temperature")
def global_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAL-01: b and w of the temperature, single and by features, from a log of all embeddings (numeric: no SQL).

    The log: embeddings' first four numbers as logits of four options; gold is the likeliest, or for a third of the labels the next.
    """
    gold = (decisions.first_largest(F.slice("embedding", 1, 4)) + (F.col("label") % 3 == 0).cast("int")) % 4
    log = table(spark, sf_dir, "embeddings").select(
        F.transform(F.slice("embedding", 1, 4), lambda x: 3 * x.cast("double")).alias("logits"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (i == gold).cast("double")).alias("target"),
        (50 + F.col("vec_id") % 900).alias("n_tok"), F.lit(4).alias("n_opts"), F.when(F.col("label") % 2 == 0, "choice").otherwise("score").alias("qtype"), F.when(F.col("label") == 3, "hard").otherwise("easy").alias("difficulty"), F.lit("gen").alias("src"),
    )
    told = [(mode, *fitting.fit_temperature(log, features)) for mode, features in (("global", False), ("features", True))]
    return spark.createDataFrame([(mode, round(b, 6), ",".join(f"{x:.5f}" for x in w)) for mode, b, w in told], "mode string, b double, w string")
