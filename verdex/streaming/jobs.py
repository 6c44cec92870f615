"""Structured Streaming: labelling with a dead-letter sink, windows with watermarks, sessions, metrics, batching and scoring."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def label_stream(items: DataFrame, scorer: Callable[[DataFrame], DataFrame], out: str, failed: str, checkpoint: str, all_there: bool = True) -> StreamingQuery:
    """STM-01, STM-03, SNK-02: label a stream of items in micro-batches; rows that the scorer leaves without a label go to the dead letters.

    The queue between reader and labeller is the micro-batch, bounded by the source's maxFilesPerTrigger. Each one is appended
    as a part of its own number, so one that is repeated after a failure replaces itself and no row is appended twice. The
    stream ends with what is there, or goes on until it is stopped, as by stop_at().
    """

    def write(batch: DataFrame, number: int) -> None:
        scored = scorer(batch).persist()
        scored.filter("label IS NOT NULL").write.mode("overwrite").parquet(f"{out}/batch={number}")
        scored.filter("label IS NULL").write.mode("overwrite").parquet(f"{failed}/batch={number}")
        scored.unpersist()

    stream = items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if all_there else stream.trigger(processingTime="1 second")).start()


def stop_at(stream: StreamingQuery, agreed: Callable[[], int], target: int, every: float = 0.5) -> int:
    """STM-01: wait until so many labelled rows agree, stop the stream, and return how many do.

    `agreed` counts them, as there may be no file yet. What the stream hasn't taken by then stays for a later one.
    """
    while stream.isActive and agreed() < target:
        time.sleep(every)
    stream.stop()
    return agreed()


def windowed_counts(events: DataFrame, window: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Tumbling windows per event type with a watermark; ts is cast, as a timestamp without zone can't carry one."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def agreement(labelled: DataFrame, every: str = "6 hours") -> DataFrame:
    """STM-04: labelled rows (ts, agree) and those that agree, by interval; their running sums are the reporter's lines."""
    e = labelled.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", every).start.alias("start")).agg(F.count("*").alias("labelled"), F.count_if("agree").alias("agreed"))


def append_sessions(rows: DataFrame) -> DataFrame:
    """STM-05: a session's state grows with each append; what a trigger leaves is the text's length and the number of appends."""
    return rows.groupBy("conv_id").agg(F.sum(F.length("text")).alias("state_chars"), F.count("*").alias("appends"))


ANSWERS = "session string, seq bigint, op string, status int, chars bigint, answer string"


def sessions(requests: DataFrame, evaluate: Callable[[str, str], str]) -> DataFrame:
    """STM-05: requests (session, seq, op, text) to sessions, each answered as ANSWERS; a stream's state store keeps the texts.

    `create` sets the text (again, if the session is there), `append` adds to it, `evaluate` asks a question about it,
    `delete` ends the session. An unknown session gives 404, as does a second delete, an unknown op too. A session never
    expires. Requests of one trigger apply in the order of seq.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told, text = _answers(key[0], pd.concat(list(frames)), state.get[0] if state.exists else None, evaluate)
        if text is None:
            state.remove()
        else:
            state.update((text,))
        yield told

    return requests.groupBy("session").applyInPandasWithState(run, ANSWERS, "text string", "append", GroupStateTimeout.NoTimeout)


def session_log(requests: DataFrame, evaluate: Callable[[str, str], str]) -> DataFrame:
    """STM-05: the answers to a whole log of requests, as sessions() gives them; a session's requests are in one task."""
    return requests.groupBy("session").applyInPandas(lambda key, rows: _answers(key[0], rows, None, evaluate)[0], ANSWERS)


def _answers(session: str, rows: pd.DataFrame, text: str | None, evaluate: Callable[[str, str], str]) -> tuple[pd.DataFrame, str | None]:
    """The answers to a session's requests, given its text (null: no session), and the text that is left."""
    out = []
    for r in rows.sort_values("seq", kind="stable").itertuples(index=False):
        more = r.text if isinstance(r.text, str) else ""
        status, answer = 200, None
        if r.op == "create":
            text = more
        elif text is None or r.op not in ("append", "evaluate", "delete"):
            status = 404
        elif r.op == "append":
            text += more
        elif r.op == "evaluate":
            answer = evaluate(text, more)
        else:
            text = None
        out.append((session, r.seq, r.op, status, len(text) if status == 200 and text is not None else None, answer))
    return pd.DataFrame(out, columns=["session", "seq", "op", "status", "chars", "answer"]).astype({"chars": "Int64"}), text


def token_batches(items: DataFrame, budget: int = 40_000, most: int = 8) -> DataFrame:
    """WIN-07: items dealt by a hash into blocks of about most x 32, where the shortest come first and fill a batch while the
    padded size stays in the budget; returns id, block, batch. items: id, n_chars. Blocks grow in number, not in size."""
    blocks = max(1, items.count() // (most * 32))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_chars", "id"])
        batch, size, out = 0, 0, []
        for n in pdf["n_chars"]:
            if size and ((size + 1) * n / 3.5 > budget or size >= most):
                batch, size = batch + 1, 0
            size += 1
            out.append(batch)
        return pdf.assign(batch=out)[["id", "block", "batch"]]

    dealt = items.select("id", "n_chars", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    return dealt.groupBy("block").applyInPandas(pack, "id bigint, block int, batch int")


#: UDF-01: a scorer sees the states and, of each, its questions' options; it gives a probability for each option.
Scorer = Callable[[list[str], list[list[list[str]]]], list[list[list[float]]]]


def decide(items: DataFrame, scorer: Scorer) -> DataFrame:
    """UDF-01, DEC-08: items (id, state, questions: array of option arrays) get probs, an array for each question.

    A scorer is called once for an Arrow batch, and a state goes to it once for all its questions.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            asked = [[list(o) for o in q] for q in b["questions"]]
            yield b.assign(probs=scorer(list(b["state"]), asked))[["id", "probs"]]

    return items.select("id", "state", "questions").mapInPandas(run, "id bigint, probs array<array<double>>")


def drain(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and return its result, which is written to the shared folder: in complete mode what the
    last trigger leaves, else what all of them append. On one machine that folder may be a temporary one; on a cluster, whose
    executors would each write to a disk of their own, spark.checkpoint.dir must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="verdex-stream-")
    path = f"{base.rstrip('/')}/drained-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path).select(df.columns)
