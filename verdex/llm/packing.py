"""Packing documents into training sequences by minimum bin slack.

Each window takes the multiset of remaining lengths that fills it closest to its capacity: a subset-sum over the lengths that
are left, whose reachable sums are the bits of one integer, with the counts traced back. Where no multiset fills a window, one
more document is cut to fill the rest, so only the last documents of a task can leave one open; they go into sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from verdex.llm import word_tokens
from verdex.llm.common import slices, table

CAPACITY = 2048
#: Ids that a task packs at once, 4 bytes each: windows choose among documents of that many ids.
CHUNK = 1 << 22
#: Bytes of text that are encoded at once.
SLICE = 1 << 23
#: The id that ends a document, as a fixed value of the query.
END = 1
#: Sequence numbers of a task; the task's number stands above them.
PER_TASK = 40


class Pieces(NamedTuple):
    """Of each piece its document, first id, length, sequence and place there; windows: how many sequences there are."""

    doc: np.ndarray
    start: np.ndarray
    length: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    windows: int


def fill(count: list[int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """(length, times) of the multiset that comes closest to `room`, at most count[length] of each, long lengths first.

    lengths: those that are left, descending. Bit s of an integer tells that the sum s can be reached; a length's count goes
    in by powers of two. The sums before each length are kept, and the counts follow backwards from the largest sum.
    """
    reach, mask, trail = 1, (1 << (room + 1)) - 1, []
    for x in lengths:
        if x > room or not count[x]:
            continue
        trail.append((x, reach))
        left, step = min(count[x], room // x), 1
        while left:
            step = min(step, left)
            reach |= reach << (step * x) & mask
            left -= step
            step *= 2
        if reach >> room:
            break
    total, out = reach.bit_length() - 1, []
    for x, before in reversed(trail):
        n = 0
        while not before >> total & 1:
            total -= x
            n += 1
        if n:
            out.append((x, n))
    return out


def pack_lengths(sizes: np.ndarray, capacity: int = CAPACITY) -> Pieces:
    """Pieces that hold each id of documents of these sizes exactly once.

    Every sequence has `capacity` ids but the last ones, at most log2(capacity), whose lengths are the powers of two in what is
    left. A document of more than a window gives whole windows first. A multiset that was found is used as often as the
    counts allow, so equal documents, however many, cost one search. Empty documents have no piece.
    """
    sizes = np.asarray(sizes, np.int64)
    whole = sizes // capacity
    of = np.repeat(np.arange(len(sizes)), whole)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(whole) - whole, whole)
    parts = [(of, nth * capacity, np.full(len(of), capacity), np.arange(len(of)), np.zeros(len(of), np.int64))]
    windows = len(of)
    rest = sizes - whole * capacity
    order = np.argsort(rest, kind="stable")[np.count_nonzero(rest == 0) :]
    edges = np.searchsorted(rest[order], np.arange(capacity + 1))
    pool: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(capacity)]  # of each length, lots of (document, first id)
    count = [0] * capacity
    for x in range(1, capacity):
        if edges[x + 1] > edges[x]:
            docs = order[edges[x] : edges[x + 1]]
            pool[x], count[x] = [(docs, whole[docs] * capacity)], len(docs)

    def take(x: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        count[x] -= n
        got: list[tuple[np.ndarray, np.ndarray]] = []
        while n:
            doc, at = pool[x].pop()
            if len(doc) > n:
                pool[x].append((doc[n:], at[n:]))
                doc, at = doc[:n], at[:n]
            got.append((doc, at))
            n -= len(doc)
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])

    def put(doc: np.ndarray, at: np.ndarray, length: int, k: int, offset: int) -> None:
        """Pieces for k windows, as many to each; they stand one after another from offset."""
        each = np.arange(len(doc))
        parts.append((doc, at, np.full(len(doc), length), windows + each % k, offset + each // k * length))

    lengths = [x for x in range(capacity - 1, 0, -1) if count[x]]
    while lengths:
        first = lengths[0]
        count[first] -= 1
        chosen = dict(fill(count, lengths, capacity - first))
        count[first] += 1
        chosen[first] = chosen.get(first, 0) + 1
        used = sum(x * n for x, n in chosen.items())
        slack = capacity - used
        cut = next((x for x in lengths if count[x] > chosen.get(x, 0)), 0) if slack else 0  # it's longer than the slack, or it were chosen
        if slack and not cut:
            at = 0
            for x, n in sorted(chosen.items(), reverse=True):
                for doc, start in zip(*(v.tolist() for v in take(x, n)), strict=True):
                    done = 0
                    while done < x:  # the sequence that this id is in: the largest powers of two come first
                        base, number = 0, 0
                        for p in (1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1):
                            if at < base + p:
                                break
                            base, number = base + p, number + 1
                        step = min(x - done, base + p - at)
                        parts.append(tuple(np.array([v]) for v in (doc, start + done, step, windows + number, at - base)))
                        done, at = done + step, at + step
            windows += used.bit_count()
            break
        need = dict(chosen)
        if cut:
            need[cut] = need.get(cut, 0) + 1
        k = min(count[x] // n for x, n in need.items())
        at = 0
        for x, n in sorted(chosen.items(), reverse=True):
            put(*take(x, n * k), x, k, at)
            at += x * n
        if cut:
            doc, start = take(cut, k)
            put(doc, start, slack, k, at)
            pool[cut - slack].append((doc, start + slack))
            count[cut - slack] += k
        windows += k
        lengths = [x for x in range(first, 0, -1) if count[x]]
    return Pieces(*(np.concatenate([p[i] for p in parts]) for i in range(5)), windows)


def _task(batches: Iterator[pa.RecordBatch], ids_of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], tell: Callable[..., pa.RecordBatch], capacity: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """Pack the documents of a task, `chunk` ids at once; chunks don't share windows."""
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << PER_TASK
    keys: list[pa.Array] = []
    flats: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal number, held
        key, flat, size = pa.concat_arrays(keys), np.concatenate(flats), np.concatenate(sizes)
        keys.clear(), flats.clear(), sizes.clear()
        held = 0
        got = pack_lengths(size, capacity)
        begin = (np.cumsum(size) - size)[got.doc] + got.start
        out = tell(key.take(pa.array(got.doc)), got, begin, flat, size[got.doc], number)
        number += got.windows
        return out

    for b in batches:
        flat, bounds = ids_of(b)
        for i, j in _runs(np.diff(bounds), chunk):
            keys.append(b.column(0).slice(i, j - i)), flats.append(flat[bounds[i] : bounds[j]]), sizes.append(np.diff(bounds[i : j + 1]))
            held += int(bounds[j] - bounds[i])
            if held >= chunk:
                yield flush()
    if held:
        yield flush()


def _runs(sizes: np.ndarray, chunk: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `chunk` ids at most; a longer row stands alone."""
    at, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and total + n > chunk:
            yield at, i
            at, total = i, 0
        total += n
    if len(sizes) > at:
        yield at, len(sizes)


def pack(tokens: DataFrame, key: str = "doc_id", ids: str = "ids", capacity: int = CAPACITY, chunk: int = CHUNK) -> DataFrame:
    """The pieces of all documents: key, start (ids of the document before it), length, ids, doc_tokens, sequence_id, offset.

    tokens has a key and an array of ids; further columns are left out. Each id lies in exactly one piece. Keys may be null
    or repeat: rows are packed one by one, and nothing is looked up by key. Null or empty ids have no piece, a null id is 0,
    an empty table gives no rows. Offsets in a sequence are gapless from 0; a sequence has `capacity` ids (a power of two),
    or a smaller power of two at the end of a chunk, so nothing is padded.

    Narrow: each task packs its own documents, `chunk` ids at once, in which windows of any multiset can be filled; there is
    no shuffle, equal documents only share a search, and a task that is repeated gives its own rows again.
    """
    schema = T.StructType([T.StructField("key", tokens.schema[key].dataType)])
    for name, kind in (("start", T.LongType()), ("length", T.LongType()), ("ids", T.ArrayType(T.IntegerType())), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())):
        schema = schema.add(name, kind)

    def ids_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        col = b.column(1)
        sizes = pa.compute.fill_null(pa.compute.list_value_length(col), 0).to_numpy(zero_copy_only=False)
        return pa.compute.fill_null(col.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int32), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

    def tell(key: pa.Array, got: Pieces, begin: np.ndarray, flat: np.ndarray, size: np.ndarray, number: int) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(got.length)]), pa.int32()), pa.array(flat[word_tokens.ragged(begin, got.length)], pa.int32()))
        return pa.RecordBatch.from_arrays([key, pa.array(got.start), pa.array(got.length), lists, pa.array(size), pa.array(number + got.sequence), pa.array(got.offset)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _task(slices(batches, ids, SLICE), ids_of, tell, capacity, chunk)

    return tokens.select(key, ids).mapInArrow(run, schema).withColumnRenamed("key", key)


def tokenise(docs: DataFrame, path: str, end: int | None = END) -> DataFrame:
    """docs with its text's ids as an array column `ids` (replaced if there), `end` after each; a null text is empty.

    Ids are those of the `tokenizers` library for the file at `path`, a file on every machine, without special tokens around.
    """
    kept = docs.drop("ids")
    schema = T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens.encoder(path)
        for b in slices(batches, "text", SLICE):
            flat, bounds = encoder.encode(b.column(b.schema.get_field_index("text")), end)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=schema.names)

    return kept.mapInArrow(run, schema)


def pack_texts(docs: DataFrame, path: str, end: int | None = END, capacity: int = CAPACITY, chunk: int = CHUNK) -> DataFrame:
    """pack() of tokenise() in one pass, without the ids: doc_id, start, length, ids_crc32 (of the piece's ids as
    little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset."""
    kind = docs.select("doc_id").schema[0].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])

    def tell(key: pa.Array, got: Pieces, begin: np.ndarray, flat: np.ndarray, size: np.ndarray, number: int) -> pa.RecordBatch:
        raw = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B")
        crc = [zlib.crc32(raw[4 * i : 4 * (i + n)]) for i, n in zip(begin.tolist(), got.length.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([key, pa.array(got.start), pa.array(got.length), pa.array(crc, pa.int64()), pa.array(size), pa.array(number + got.sequence), pa.array(got.offset)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens.encoder(path)
        return _task(slices(batches, "text", SLICE), lambda b: encoder.encode(b.column(1), end), tell, capacity, chunk)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids."""
    import public_tokenizers

    return pack_texts(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
