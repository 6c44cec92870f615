"""DEC-11, AGG-21: nearest vectors by cosine: exact in blocks of queries, and by an inverted file over centroids.

Vectors are arrays of numbers of one length; a null or zero vector has no direction, is nobody's neighbour and has none. A
neighbour is another id; of equal cosines (to 9 places) the smaller id comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries that go to all tasks at once: 2 MB of 64 dimensions in doubles.
BLOCK = 4096
#: Rows of a list that one task scores together, and queries that meet them at once; a list of more is split.
LIST_ROWS, LIST_QUERIES = 20_000, 2_000
#: Rows that centroids are fitted on, at most, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 8
FOUND = "id bigint, neighbour bigint, cos double"


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; those without a direction as zeros."""
    v = np.asarray(vectors, np.float64)
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def best(ids: np.ndarray, queries: np.ndarray, others: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, neighbour, cos): of each query the k nearest of the other vectors, of unit length all, in no order."""
    cos = np.round(queries @ vectors.T, 9)
    cos[ids[:, None] == others[None, :]] = -np.inf
    order = np.argsort(others, kind="stable")  # by id, so that what stands first among equals is the smaller one
    cos, others = cos[:, order], others[order]
    if cos.shape[1] > k:
        least = np.partition(cos, cos.shape[1] - k, 1)[:, -k][:, None]
        above, tied = cos > least, cos == least
        keep = above | tied & (np.cumsum(tied, 1) <= k - above.sum(1, keepdims=True))
    else:
        keep = np.ones(cos.shape, bool)
    row, col = np.nonzero(keep & (cos > -np.inf))
    return ids[row], others[col], cos[row, col]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best (id, neighbour, cos) of each id, with `rank` from 1. Each task has sent k for an id at most."""
    order = Window.partitionBy("id").orderBy(F.desc("cos"), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _directed(df: DataFrame, id: str, vector: str) -> DataFrame:
    norm = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return df.select(F.col(id).cast("bigint").alias("id"), F.col(vector).alias("v")).filter((norm > 0) & F.col("id").isNotNull())


def exact_top_k(base: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(id, neighbour, cos, rank) of every query among all rows of base, by comparing it with each.

    Queries come in blocks of `block` at most, so what goes to the tasks has a bound; each block is one pass over base. A task
    keeps k rows per query of the block, batch after batch, and the tasks' rows meet by query.
    """
    base, queries = _directed(base, id, vector), _directed(queries, id, vector)
    n = queries.count()
    blocks = max(1, -(-n // (block // 2)))  # by hash, so half of what is allowed is what a block has on average
    out = None
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow() if n else queries.limit(0).toArrow()
        if not rows.num_rows:
            continue
        ids, vectors = rows.column("id").to_numpy(), unit(_matrix(rows.column("v").combine_chunks()))

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, vectors: np.ndarray = vectors) -> Iterator[pa.RecordBatch]:
            held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for x in batches:
                for i in range(0, x.num_rows, 1024):
                    part = x.slice(i, 1024)
                    more = best(ids, vectors, part.column(0).to_numpy(), unit(_matrix(part.column(1))), k)
                    held = tuple(np.concatenate(c) for c in zip(held, more, strict=True))
                order = np.lexsort((held[1], -held[2], held[0]))
                held = tuple(c[order] for c in held)
                first = np.searchsorted(held[0], held[0])
                keep = np.arange(len(first)) - first < k
                held = tuple(c[keep] for c in held)
            if len(held[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["id", "neighbour", "cos"])

        found = base.mapInArrow(run, FOUND)
        out = found if out is None else out.unionByName(found)
    return ranked(out if out is not None else base.sparkSession.createDataFrame([], FOUND), k)


def fit_centroids(base: DataFrame, lists: int, id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Directions of `lists` lists, by spherical k-means over at most `sample` rows of least hash of their id: a bounded sample,
    the same on every run."""
    rows = _directed(base, id, vector).orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    x = unit(_matrix(rows.column("v").combine_chunks())) if rows.num_rows else np.zeros((1, 1))
    x = np.unique(x, axis=0)  # copies of one vector are one point, or they'd take many lists
    centre = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(rounds):
        to = (x @ centre.T).argmax(1)
        sums = np.zeros_like(centre)
        np.add.at(sums, to, x)
        has = np.bincount(to, minlength=len(centre)) > 0
        centre[has] = unit(sums)[has]
    return centre


def assign(base: DataFrame, centroids: np.ndarray, probes: int = 1, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v, list): every row with its nearest list, or one row for each of its `probes` nearest lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cos = unit(_matrix(b.column(1))) @ centroids.T
                m = min(probes, cos.shape[1])
                near = np.argpartition(-cos, m - 1, 1)[:, :m] if m < cos.shape[1] else np.tile(np.arange(m), (len(cos), 1))
                rows = np.repeat(np.arange(len(cos)), m)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array(near.ravel(), pa.int32())], names=["id", "v", "list"])

    kind = base.schema[vector].dataType.simpleString()
    return _directed(base, id, vector).mapInArrow(run, f"id bigint, v {kind}, list int")


def index_top_k(base: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int, probes: int = 8, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, neighbour, cos, rank): the k nearest of each query in its `probes` nearest lists. Every row of base is in a list.

    Rows of a list are dealt to parts of about LIST_ROWS, and its queries to parts of LIST_QUERIES, and a part of rows meets a
    part of queries; so one list with a third of all rows, as copies of one vector make, is many tasks. With as many probes as
    there are lists the result is exact.
    """
    rows, asked = assign(base, centroids, 1, id, vector), assign(queries, centroids, probes, id, vector)
    count = lambda df, size, name: df.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    parts = F.broadcast(count(rows, LIST_ROWS, "row_parts").join(count(asked, LIST_QUERIES, "query_parts"), "list"))  # one short row per list
    part = lambda name, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = rows.join(parts, "list").select("list", part("row_parts", 1).alias("p"), every("query_parts").alias("q"), "id", "v")
    right = asked.join(parts, "list").select("list", every("row_parts").alias("p"), part("query_parts", 2).alias("q"), "id", "v")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "neighbour": [], "cos": []})
        got = best(b["id"].to_numpy(), unit(np.stack(b["v"])), a["id"].to_numpy(), unit(np.stack(a["v"])), k)
        return pd.DataFrame(dict(zip(("id", "neighbour", "cos"), got, strict=True)))

    keys = ["list", "p", "q"]
    return ranked(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, FOUND), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: (n, recall): of the exact neighbours, how many were found. A neighbour as near as the last exact one counts."""
    last = exact.groupBy("id").agg(F.min("cos").alias("last"), F.count("*").alias("n"))
    hits = found.join(last, "id").filter("cos >= last").groupBy("id").agg(F.least(F.count("*"), F.first("n")).alias("hits"))
    return last.join(hits, "id", "left").agg(F.sum("n").alias("n"), (F.sum(F.coalesce("hits", F.lit(0))) / F.sum("n")).alias("recall"))


def shortlists(top: DataFrame, sizes: tuple[int, ...] = (20, 10, 5)) -> DataFrame:
    """(id, size, options): of each id's ranked neighbours the first `size`, nearest first, for each size."""
    each = top.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).filter("rank <= size")
    return each.groupBy("id", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))), lambda x: x["neighbour"]).alias("options"))
