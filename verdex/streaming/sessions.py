"""STM-05: sessions in a state store, whose text is a list of pieces: an append writes its piece and nothing else."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ANSWERS = "session string, seq bigint, op string, status int, chars bigint, answer string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sessions(StatefulProcessor):
    """One session's requests: `pieces` holds its text as it was appended, `size` its length; without a size there is none."""

    def __init__(self, evaluate: Callable[[str, str], str]):
        self.evaluate = evaluate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pieces = handle.getListState("pieces", "text string")
        self.size = handle.getValueState("size", "chars bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        chars = self.size.get()[0] if self.size.exists() else None
        before = chars
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples(index=False):
            text = r.text if isinstance(r.text, str) else ""
            status, answer = 200, None
            if r.op == "create":
                self.pieces.put([(text,)])
                chars = len(text)
            elif chars is None or r.op not in ("append", "evaluate", "delete"):
                status = 404
            elif r.op == "append":
                if text:
                    self.pieces.appendValue((text,))
                    chars += len(text)
            elif r.op == "evaluate":
                answer = self.evaluate("".join(p[0] for p in self.pieces.get()), text)
            else:
                self.pieces.clear()
                chars = None
            out.append((key[0], r.seq, r.op, status, chars if status == 200 else None, answer))
        if chars is not None and chars != before:
            self.size.update((chars,))
        elif chars is None and before is not None:
            self.size.clear()
        yield pd.DataFrame(out, columns=["session", "seq", "op", "status", "chars", "answer"]).astype({"chars": "Int64"})

    def close(self) -> None:
        pass


def stored_sessions(requests: DataFrame, evaluate: Callable[[str, str], str]) -> DataFrame:
    """Requests (session, seq, op, text) to sessions, each answered as ANSWERS, with the text in RocksDB.

    `create` sets the text (again, if the session is there), `append` adds to it, `evaluate` asks a question about it, `delete`
    ends the session. An unknown session gives 404, as do a second delete and an unknown op. A session never expires. Requests
    of one trigger apply in the order of seq. What an append writes doesn't depend on how long the text is.
    The stream must be started under rocksdb(), as list states need that store.
    """
    asked = requests.selectExpr("cast(session AS string) AS session", "cast(seq AS bigint) AS seq", "op", "text")
    return asked.groupBy("session").transformWithStateInPandas(Sessions(evaluate), ANSWERS, "append", "None")


class rocksdb:  # noqa: N801
    """In a with-block, streams that start keep their state in RocksDB; afterwards the session's setting is what it was."""

    NAME = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.NAME, None)
        self.spark.conf.set(self.NAME, ROCKSDB)

    def __exit__(self, *_: object) -> None:
        self.spark.conf.unset(self.NAME) if self.before is None else self.spark.conf.set(self.NAME, self.before)
