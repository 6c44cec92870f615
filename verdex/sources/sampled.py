"""SRC-14: a source of generated cases: attributes are drawn until a case is accepted, and n cases are accepted exactly."""

from __future__ import annotations

import hashlib
import json
import operator
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TESTS = {">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt, "=": operator.eq, "<>": operator.ne, "in": lambda x, v: x in v, "not in": lambda x, v: x not in v}
KINDS = {"int": "bigint", "money": "double", "float": "double", "pct": "double", "enum": "string", "bool": "boolean"}
ARROW = {"int": pa.int64(), "money": pa.float64(), "float": pa.float64(), "pct": pa.float64(), "enum": pa.string(), "bool": pa.bool_()}


def drawn(seed: str, number: int, attempt: int, name: str, kind: str, par: list) -> object:
    """An attribute's value in one attempt: by the first 8 hex digits of md5("seed:name:number:attempt") as a share of 2**32.

    int from low to high, both included; money to two places, float and pct to one, each from low to high; enum one of par.
    """
    u = int(hashlib.md5(f"{seed}:{name}:{number}:{attempt}".encode()).hexdigest()[:8], 16) / 2**32
    if kind == "enum":
        return par[int(u * len(par))]
    if kind == "bool":
        return u < 0.5
    low, high = par
    return int(low + u * (high - low + 1)) if kind == "int" else round(low + u * (high - low), 2 if kind == "money" else 1)


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.n, self.parts, self.most = int(options["n"]), int(options.get("partitions", 8)), int(options.get("most", 10_000))
        self.seed, self.attributes, self.accept = options.get("seed", "1"), json.loads(options["attributes"]), json.loads(options.get("accept", "[]"))
        self.balance = str(options.get("balance", "false")).lower() == "true"

    def partitions(self) -> list[Range]:
        k = max(1, min(self.parts, self.n))
        return [Range(self.n * i // k, self.n * (i + 1) // k) for i in range(k)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.bool_(), *(ARROW[k] for _, k, _ in self.attributes)]
        names = ["number", "attempt", "holds", *(a for a, _, _ in self.attributes)]
        for at in range(part.first, part.last, 10_000):
            rows = [self.one(i) for i in range(at, min(at + 10_000, part.last))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def one(self, number: int) -> tuple:
        """A case's first accepted attempt."""
        want = number % 2 == 0 if self.balance else True
        for attempt in range(self.most):
            case = {name: drawn(self.seed, number, attempt, name, kind, par) for name, kind, par in self.attributes}
            if all(TESTS[op](case[a], v) for a, op, v in self.accept) == want:
                return number, attempt, want, *case.values()
        raise ValueError(f"no case was accepted in {self.most} attempts: {self.accept}")


class SampledCases(DataSource):
    """`spark.read.format("sampled_cases")` with the options n, attributes (JSON: [[name, kind, parameters], ...]), accept (JSON:
    [[attribute, test, value], ...], all of which must hold), balance (of every second case they mustn't all hold), seed,
    partitions, most (attempts; more is an error). Columns: number, attempt, holds, and the attributes.

    A case's attempts depend on the seed and its number alone, so any number of partitions gives the same n rows, a lost task
    draws its own again, and no partition waits for another one to reach n.
    """

    @classmethod
    def name(cls) -> str:
        return "sampled_cases"

    def schema(self) -> str:
        return "number bigint, attempt bigint, holds boolean" + "".join(f", `{n}` {KINDS[k]}" for n, k, _ in json.loads(self.options["attributes"]))

    def reader(self, schema: object) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SampledCases)
