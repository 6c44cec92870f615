"""AGG-08, AGG-27, STM-04: counters that come from the pass over the rows itself, of a batch job and of each trigger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def counted(rows: DataFrame, values: dict[str, Column]) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """(rows, counts): rows as they are, and a function that gives, once an action has gone over them, how many had each value
    true. The names are known beforehand; nothing is scanned for the counts."""
    seen = Observation()
    told = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in values.items()))
    return told, lambda: dict(seen.get)


def by_reason(rows: DataFrame, reasons: tuple[str, ...], column: str = "reason") -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """counted() of rows by their reason; `kept`: those without one, `other`: those with one that isn't listed."""
    c = F.col(column)
    return counted(rows, {"kept": c.isNull(), **{r: c == r for r in reasons}, "other": c.isNotNull() & ~c.isin(*reasons)})


class Rates(StreamingQueryListener):
    """What each trigger of a stream has labelled: (batch, rows, agreed, rows a second), in order, from the stream's own metrics.

    The stream must be observed as observed(); the reporter's totals are the running sums.
    """

    NAME = "verdex_rates"

    def __init__(self) -> None:
        self.triggers: list[tuple[int, int, int, float]] = []

    @classmethod
    def observed(cls, stream: DataFrame, agree: str = "agree") -> DataFrame:
        return stream.observe(cls.NAME, F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(F.col(agree), F.lit(False))).alias("agreed"))

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        got = event.progress.observedMetrics.get(self.NAME)
        if got is not None and got["rows"]:
            self.triggers.append((event.progress.batchId, got["rows"], got["agreed"], event.progress.processedRowsPerSecond))

    def totals(self) -> tuple[int, int]:
        """Labelled rows and those that agree, so far."""
        return sum(t[1] for t in self.triggers), sum(t[2] for t in self.triggers)
