"""Suffix-array deduplication of bytes: every byte that lies in a repeated string of WINDOW bytes is removed.

Equal windows have equal anchors: the GRAM-byte string with the least hash inside them. Runs of windows with one anchor form
a fragment. Anchors that occur once can't be in a repeated window; the fragments of the others are dealt to shards by anchor,
equal fragments as one, and each shard's suffixes are sorted by external induction. Two neighbours in that order with a
common prefix of WINDOW bytes are repeats. What a shard finds goes back to the texts as spans. GRAM decides how long a string
must recur for its surroundings to be sorted at all: the longer, the less is sorted, but the more the fragments overlap.

An anchor with more fragments than a part holds (a passage with many copies in other surroundings) is split: its windows by
the half of the places where the anchor may stand in them, and each half by the longer string that all its windows then
share, again and again, down to single windows. Equal windows stay together, so no repeat is lost.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.llm import files, textvec
from verdex.llm.common import cut, fresh_path, slices, table
from verdex.llm.suffix_array import Scratch, suffixes

_U = np.uint64
WINDOW, GRAM = 200, 64
#: Bytes of text per shard, about.
SHARD_BYTES = 24 << 20
#: Bytes of fragments, about, whose suffixes a task sorts at once, and that one anchor may have before it is split.
PART_BYTES = 2 << 20
#: Places of one content that are held before they are told.
PLACES = 1 << 17


def text_key(text: bytes) -> tuple[int, int]:
    """A text's name: 128 bits of a digest, as two signed numbers. Equal texts have one name, and lose the same bytes."""
    raw = hashlib.blake2b(text, digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


@dataclass
class Fragments:
    """Runs of windows with one anchor: row of the text, first window (in the buffer), windows, anchor hash, its place."""

    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    at: np.ndarray


def fragments(buf: np.ndarray, off: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> Fragments:
    """All windows of all texts, in runs with one anchor (the leftmost of equal hashes), which depends on a window's bytes alone."""
    n = len(buf)
    if n < window:
        e = np.zeros(0, np.int64)
        return Fragments(e, e, e, e.astype(_U), e)
    h = textvec.gram_hashes(buf, gram)
    m = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=_U)
    span, size = window - gram + 1, 1
    while size * 2 <= span:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < span:
        m = np.minimum(m[: len(m) - (span - size)], m[span - size :])
    at = (m & _U(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(len(at) + 1, np.int8)
    long = np.flatnonzero(np.diff(off) >= window)
    np.add.at(valid, off[long], 1)
    np.add.at(valid, off[long + 1] - window + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    begins[off[long]] = True
    start = np.flatnonzero(begins)
    row = np.searchsorted(off, start, side="right") - 1
    end = np.minimum(np.append(start[1:], len(at)), off[row + 1] - window + 1)
    return Fragments(row, start, end - start, h[at[start]], at[start])


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return (textvec.mix(h + _U(1)) >> _U(32)).astype(np.int64) * shards >> 32


def _anchors(shards: int):
    """Each slice's anchors by shard, and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            a, n = np.unique(fragments(*textvec.utf8(b.column(0))).anchor, return_counts=True)
            if not len(a):
                continue
            shard = _shard(a, shards)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            rows = [(k, a[order[i:j]].tobytes(), np.minimum(n[order[i:j]], 65535).astype("<u2").tobytes()) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["shard", "anchors", "n"])

    return run


def _repeated(path: str):
    """Writes each shard's anchors that occur more than once, as a sorted array, and which may have too many fragments for a
    part; returns its number and theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        for b in batches:
            for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(k, []).append(row)
        for k, rows in held.items():
            a = np.concatenate([np.frombuffer(x, "<u8") for x, _ in rows])
            u, at = np.unique(a, return_inverse=True)
            n = np.bincount(at, np.concatenate([np.frombuffer(x, "<u2") for _, x in rows]), len(u))
            hot = n[n > 1] * WINDOW > PART_BYTES
            files.put(f"{path}/anchors-{k:06d}", [u[n > 1], hot])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([int(hot.sum())], pa.int64())], names=["shard", "hot"])

    return run


#: Rows of fragments: the range [low, high] of the anchor's places in their windows, the anchor's place in the content, how
#: often it occurs, and its distinct places: the two halves of the text's name, and where it starts there.
FRAGMENTS = "shard int, anchor bigint, low int, high int, at int, content binary, n bigint, keys array<bigint>, more array<bigint>, starts array<bigint>"
Place = tuple[int, int, int]


def _batch(rows: list[tuple], shards: int) -> pa.RecordBatch:
    """(anchor, low, high, at, content, n, places) as FRAGMENTS."""
    anchor, low, high, at, content, n, places = zip(*rows, strict=True)
    anchors, many = np.array(anchor, np.int64), pa.list_(pa.int64())
    lists = [[[p[k] for p in x] for x in places] for k in range(3)]
    return pa.RecordBatch.from_arrays(
        [pa.array(_shard(anchors.view(_U), shards), pa.int32()), pa.array(anchors), *(pa.array(x, pa.int32()) for x in (low, high, at)), pa.array(content, pa.binary()), pa.array(n, pa.int64()), *(pa.array(x, many) for x in lists)],
        names=[x.split()[0] for x in FRAGMENTS.split(", ")],
    )


def _fragments(path: str, shards: int, hot: bool):
    """The fragments whose anchor occurs again and is, or isn't, hot; equal ones of a slice as one row with their distinct places:
    copies of a text have one name, so however many there are, they add one place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = files.Shards(path, "anchors", lambda data: (data[: len(data) // 9 * 8].view("<u8"), data[len(data) // 9 * 8 :].view(bool)))
        for b in slices(batches):
            buf, off = textvec.utf8(b.column(0))
            f = fragments(buf, off)
            shard = _shard(f.anchor, shards)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            again = np.zeros(len(f.anchor), bool)
            for k in np.flatnonzero(np.diff(cuts)):
                part, (have, hots) = order[cuts[k] : cuts[k + 1]], known[k]
                if len(have):
                    at = np.minimum(np.searchsorted(have, f.anchor[part]), len(have) - 1)
                    again[part] = (have[at] == f.anchor[part]) & (hots[at] == hot)
            if not again.any():
                continue
            keys: dict[int, tuple[int, int]] = {}
            found: dict[tuple[int, bytes], tuple[int, Counter[Place]]] = {}
            raw, anchors = buf.tobytes(), f.anchor.view(np.int64)
            for i in np.flatnonzero(again).tolist():
                row, start = int(f.row[i]), int(f.start[i])
                if row not in keys:
                    keys[row] = text_key(raw[off[row] : off[row + 1]])
                to = found.setdefault((int(anchors[i]), raw[start : start + int(f.count[i]) + WINDOW - 1]), (int(f.at[i]) - start, Counter()))
                to[1][*keys[row], start - int(off[row])] += 1
            yield _batch([(a, 0, WINDOW - GRAM, at, c, x.total(), x) for (a, c), (at, x) in found.items()], shards)

    return run


def halves(low: int, high: int, at: int, content: bytes) -> Iterator[tuple[int, int, int, int, bytes, int]]:
    """A fragment cut into the windows that have the anchor in the lower and in the upper half of the places from low to
    high: (anchor, low, high, at, content, windows before). The new anchor is what all windows of a half must share."""
    count, mid = len(content) - WINDOW + 1, (low + high + 1) // 2
    for lo, hi in ((low, mid - 1), (mid, high)):
        first, last = max(0, at - hi), min(count - 1, at - lo)
        if first <= last:
            shared = hashlib.blake2b(content[at - lo : at + WINDOW - hi], digest_size=8, salt=lo.to_bytes(2, "little") + hi.to_bytes(2, "little"))
            yield int.from_bytes(shared.digest(), "little", signed=True), lo, hi, at - first, content[first : last + WINDOW], first


def _halved(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "content"):
            found: dict[tuple[int, bytes], tuple[int, int, int, list[int], set[Place]]] = {}
            for _, _, low, high, at, content, n, *places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for anchor, *place, part, first in halves(low, high, at, content):
                    to = found.setdefault((anchor, part), (*place, [], set()))
                    to[3].append(n)
                    to[4].update((k, m, s + first) for k, m, s in zip(*places, strict=True))
            if found:
                yield _batch([(a, lo, hi, at, c, sum(n), x) for (a, c), (lo, hi, at, n, x) in found.items()], shards)

    return run


def split_hot(hot: DataFrame, shards: int) -> DataFrame:
    """Fragments of hot anchors under anchors with PART_BYTES of distinct fragments at most, or of one window only.

    Anchors over PART_BYTES number less than the fragments' bytes by PART_BYTES, and are broadcast: 2 bytes a megabyte.
    """
    done = None
    while True:
        hot = cut(hot)
        size = hot.groupBy("anchor").agg(F.sum(F.octet_length("content")).alias("bytes"), F.max(F.col("low") < F.col("high")).alias("more"))
        over = F.broadcast(cut(size.filter((F.col("bytes") > PART_BYTES) & F.col("more")).select("anchor")))
        small = hot.join(over, "anchor", "left_anti").select(hot.columns)
        done = small if done is None else done.union(small)
        hot = hot.join(over, "anchor", "left_semi").select(hot.columns)
        if hot.isEmpty():
            return done
        hot = hot.mapInArrow(_halved(shards), FRAGMENTS)


def repeated_windows(contents: Iterable[bytes], scratch: Scratch, window: int = WINDOW) -> Iterator[np.ndarray]:
    """For each byte string in turn, which of its windows another place in the strings has too. Text, queues and marks are
    on disk, in the scratch folder."""
    name = scratch.name()
    sizes = []
    with open(name, "wb") as f:
        for c in contents:
            (np.frombuffer(c, np.uint8).astype("<u2") + np.uint16(2)).tofile(f)
            f.write(b"\1\0")
            sizes.append(len(c))
        f.write(b"\0\0")
    if not sizes:
        return
    t = np.memmap(name, "<u2", "r")
    marks = np.memmap(scratch.name(), np.uint8, "w+", shape=(len(t),))
    before = np.zeros(0, np.int64)
    for rows in suffixes(t, window, scratch):
        far = np.flatnonzero(rows["lcp"] >= window)
        pos = np.concatenate([before, rows["pos"]])
        marks[pos[far + len(before)]] = 1
        marks[pos[far + len(before) - 1]] = 1
        before = rows["pos"][-1:]
    at = 0
    for n in sizes:
        yield np.asarray(marks[at : at + max(0, n - window + 1)]).astype(bool)
        at += n + 1


class _Content:
    """One distinct fragment, how often it occurs and its distinct places, a row each; `known`: places of it were told before."""

    def __init__(self, content: bytes):
        self.content, self.rows, self.held, self.n, self.known = content, [], 0, 0, False

    def add(self, n: int, places: np.ndarray) -> None:
        self.rows.append(places)
        self.n += n
        self.held += len(places)
        if self.held > 2 * PLACES:
            self.rows = [np.unique(np.concatenate(self.rows), axis=0)]
            self.held = len(self.rows[0])

    def places(self) -> np.ndarray:
        out = np.unique(np.concatenate(self.rows), axis=0) if len(self.rows) > 1 else self.rows[0] if self.rows else np.zeros((0, 3), np.int64)
        self.rows, self.held = [], 0
        return out


def _spans(shards: int, window: int = WINDOW):
    """Spans of repeated windows, by text key; rows come sorted by shard, anchor and content. A task holds a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []
        size = 0

        def tell(marks: np.ndarray, places: np.ndarray) -> None:
            nonlocal size
            keys, more, starts = places.T
            edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
            if len(edge) and len(keys):
                a, b = edge[::2], edge[1::2] + window - 1
                out.append((np.repeat(keys, len(a)), np.repeat(more, len(a)), (starts[:, None] + a).ravel(), (starts[:, None] + b).ravel()))
                size += len(keys) * len(a)

        def whole(c: _Content) -> None:
            tell(np.ones(len(c.content) - window + 1, bool), c.places())

        def batch() -> pa.RecordBatch:
            nonlocal size
            cols = [pa.array(np.concatenate([x[k] for x in out]), pa.int64()) for k in range(4)]
            out.clear()
            size = 0
            return pa.RecordBatch.from_arrays([*cols, pa.array(_shard(cols[0].to_numpy().view(_U), shards), pa.int32())], names=["key", "more", "begin", "end", "shard"])

        def anchors() -> Iterator[list[_Content]]:
            """The distinct fragments of one anchor at a time, with their places."""
            anchor, held = None, []
            for b in batches:
                at, texts, counts, *lists = (b.column(b.schema.get_field_index(x)) for x in ("anchor", "content", "n", "keys", "more", "starts"))
                o, places = lists[0].offsets.to_numpy(), np.stack([c.flatten().to_numpy() for c in lists], 1)
                o = o - o[0]
                for i, (a, content, n) in enumerate(zip(at.to_pylist(), texts.to_pylist(), counts.to_pylist(), strict=True)):
                    if a != anchor:
                        if held:
                            yield held
                        anchor, held = a, []
                    if not held or held[-1].content != content:
                        held.append(_Content(content))
                    held[-1].add(n, places[o[i] : o[i + 1]])
                    if held[-1].held > PLACES:
                        held[-1].known = True
                        whole(held[-1])
            if held:
                yield held

        def compare(part: list[_Content]) -> None:
            with Scratch() as scratch:
                for marks, c in zip(repeated_windows((c.content for c in part), scratch), part, strict=True):
                    tell(marks | (c.known or c.n > 1), c.places())

        part, total = [], 0
        for held in anchors():
            if size > 1 << 17:
                yield batch()
            if len(held) == 1:
                if held[0].known or held[0].n > 1:
                    whole(held[0])
                continue
            more = sum(len(c.content) for c in held)
            if part and total + more > PART_BYTES:  # anchors don't share windows, so they may be compared in parts
                compare(part)
                part, total = [], 0
            part += held
            total += more
        if part:
            compare(part)
        if out:
            yield batch()

    return run


def _store(path: str):
    """Writes each shard's spans, overlapping and touching ones as one: both halves of texts' names, first span of each, begins, ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[], [], [], [], []]
        for b in batches:
            for k in range(5):
                cols[k].append(b.column(k).to_numpy())
        if not cols[0]:
            return
        key, more, begin, end, of = (np.concatenate(c) for c in cols)
        for k in np.unique(of).tolist():
            part = np.flatnonzero(of == k)
            part = part[np.lexsort((begin[part], more[part], key[part]))]
            a, m, b, c = key[part], more[part], begin[part], end[part]
            other = np.append(True, (a[1:] != a[:-1]) | (m[1:] != m[:-1]))
            rank = np.cumsum(other) - 1
            wide = int(c.max()) + 2
            reach = np.maximum.accumulate(c + rank * wide)
            new = np.append(True, b[1:] + rank[1:] * wide > reach[:-1])
            start = np.flatnonzero(new)
            first = np.searchsorted(rank[start], np.arange(rank[-1] + 2))
            last = np.append(start[1:], len(a)) - 1
            files.put(f"{path}/spans-{k:06d}", [np.array([rank[-1] + 1, len(start)]), a[other], m[other], first, b[start], reach[last] - rank[last] * wide])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64())], names=["shard"])

    return run


def _parse_spans(data: np.ndarray) -> list[np.ndarray]:
    """Both halves of texts' names, first span of each, begins, ends."""
    data = data.view("<i8")
    return np.split(data[2:], np.cumsum([data[0], data[0], data[0] + 1, data[1]])) if len(data) else [data] * 5


@dataclass
class Repeats:
    """Where the spans of repeated bytes are, by text."""

    path: str
    shards: int

    def open(self) -> files.Shards:
        return files.Shards(self.path, "spans", _parse_spans)

    def spans(self, known: files.Shards, name: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """(begins, ends) of a text's spans, in order."""
        keys, more, first, begin, end = known[int(_shard(np.array(name[:1], np.int64).view(_U), self.shards)[0])]
        i = int(np.searchsorted(keys, name[0]))
        while i < len(keys) and keys[i] == name[0] and more[i] != name[1]:
            i += 1
        if i == len(keys) or keys[i] != name[0]:
            return begin[:0], end[:0]
        return np.asarray(begin[first[i] : first[i + 1]]), np.asarray(end[first[i] : first[i + 1]])


def find_repeats(docs: DataFrame) -> Repeats:
    """Find every string of WINDOW bytes of the column `text` that starts at two places, in one text or in two.

    Null texts are empty; texts below WINDOW bytes have no windows; repeated rows repeat each other. A text of any length is
    read whole, and only `text` is read, so other columns can't clash. An empty table gives no spans. Files go to the shared
    folder; tasks map what they need of them.
    """
    path = fresh_path(docs.sparkSession, "suffix-dedup")
    texts = docs.select("text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(6, -(-size // SHARD_BYTES))
    stored = spans_of(texts, path, shards).repartitionById(shards, F.col("shard")).mapInArrow(_store(path), "shard bigint")
    files.tell(path, "spans", shards, (r["shard"] for r in stored.collect()))
    return Repeats(path, shards)


def spans_of(texts: DataFrame, path: str, shards: int) -> DataFrame:
    """(key, more, begin, end, shard): spans of repeated windows by a text's name; copies of a text have theirs once."""
    own = F.col("shard")
    counted = texts.mapInArrow(_anchors(shards), "shard int, anchors binary, n binary").repartitionById(shards, own)
    told = counted.mapInArrow(_repeated(path), "shard bigint, hot bigint").collect()  # a row per shard
    files.tell(path, "anchors", shards, (r["shard"] for r in told))
    hot = sum(r["hot"] for r in told)
    dealt = texts.mapInArrow(_fragments(path, shards, False), FRAGMENTS)
    if hot:
        dealt = dealt.union(split_hot(texts.mapInArrow(_fragments(path, shards, True), FRAGMENTS), shards))
    dealt = dealt.select("shard", "anchor", "content", "n", "keys", "more", "starts").repartitionById(shards, own)
    return dealt.sortWithinPartitions("shard", "anchor", "content").mapInArrow(_spans(shards), "key bigint, more bigint, begin bigint, end bigint, shard int")


def remove_repeats(docs: DataFrame, repeats: Repeats) -> DataFrame:
    """doc_id, n_bytes, begins, ends (spans of removed bytes, in order), kept (the remaining bytes): one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = repeats.open()
        for b in slices(batches):
            buf, off = textvec.utf8(b.column(1))
            raw = buf.tobytes()
            begins, ends, kept = [], [], []
            for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                text = raw[i:j]
                a, e = repeats.spans(known, text_key(text)) if len(text) >= WINDOW else ((), ())
                begins.append(list(map(int, a)))
                ends.append(list(map(int, e)))
                kept.append(b"".join(text[x:y] for x, y in zip([0, *ends[-1]], [*begins[-1], len(text)], strict=True)))
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off)), pa.array(begins, many), pa.array(ends, many), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "begins", "ends", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, begins array<bigint>, ends array<bigint>, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated strings of 200 bytes."""
    docs = table(spark, sf_dir, "documents")
    out = remove_repeats(docs, find_repeats(docs))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"), F.size("begins").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
