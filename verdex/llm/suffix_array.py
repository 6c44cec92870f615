"""Suffix order and common prefixes of a text by external induced sorting.

A suffix is L if it is larger than the next one, else S; an S suffix after an L one is a star. The star suffixes are sorted
first: their substrings up to the next star get names by rank, and if names repeat, the string of names is sorted by the
same method, recursively. From the stars all L suffixes follow in one scan of increasing order, and from these all S
suffixes in one of decreasing order: whenever a suffix is settled, the one that starts a symbol earlier goes into a priority
queue under its first symbol. Queues hold tuples (position, length of the common prefix with its neighbour) and spill to
disk; the common prefix of two neighbours that enter a queue is one more than the least one between the suffixes that sent
them.
"""

from __future__ import annotations

import heapq
import os
import shutil
import tempfile
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np

#: Tuples that a queue holds in memory before it spills; tuples handled at once; names whose recursion fits one array of slots.
MEMORY, CHUNK, SLOTS = 1 << 20, 1 << 18, 1 << 22
#: Bytes of a text that are read into memory; a longer one stays on disk and is mapped.
HELD = 1 << 26


class Scratch:
    """A folder for one task's spill files, inside Spark's own scratch space as its sorters' are; gone with the task."""

    def __enter__(self) -> Scratch:
        at = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if d and os.path.isdir(d)]
        self.path = tempfile.mkdtemp(prefix="suffixes-", dir=at[0] if at else None)
        self.n = 0
        return self

    def __exit__(self, *_: object) -> None:
        shutil.rmtree(self.path, ignore_errors=True)

    def name(self) -> str:
        self.n += 1
        return os.path.join(self.path, str(self.n))


    def array(self, dtype: str) -> Spill:
        """An array that is written on disk from front to back and read from either end."""
        return Spill(self.name(), np.dtype(dtype))


class Spill:
    """A growing array in a file; CHUNK elements at most are in memory."""

    def __init__(self, path: str, dtype: np.dtype):
        self.path, self.dtype, self.size, self.held = path, dtype, 0, []
        open(path, "wb").close()

    def append(self, x: int) -> None:
        self.held.append(x)
        self.size += 1
        if len(self.held) >= CHUNK:
            self.flush()

    def flush(self) -> None:
        with open(self.path, "ab") as f:
            np.array(self.held, self.dtype).tofile(f)
        self.held = []

    def mapped(self) -> np.ndarray:
        self.flush()
        return np.memmap(self.path, self.dtype, "r") if self.size else np.zeros(0, self.dtype)


def elements(a: np.ndarray) -> Iterator[int]:
    """The elements of an array in order, CHUNK of them in memory."""
    for i in range(0, len(a), CHUNK):
        yield from a[i : i + CHUNK].tolist()


class Text:
    """Four symbols at a time of a text of symbols below 2**16, the first in the highest bits; zeros follow the end."""

    FULL = np.array([2**64 - 1, 2**48 - 1, 2**32 - 1, 2**16 - 1, 0], np.uint64)

    def __init__(self, t: np.ndarray, scratch: Scratch):
        held = len(t) * 8 <= HELD
        self.packed = np.empty(len(t), np.uint64) if held else np.memmap(scratch.name(), np.uint64, "w+", shape=(len(t),))
        for i in range(0, len(t), 1 << 22):
            x = np.zeros(min(len(t) - i, 1 << 22) + 3, np.uint64)
            x[: len(t[i : i + (1 << 22) + 3])] = t[i : i + (1 << 22) + 3]
            n = len(x) - 3
            self.packed[i : i + n] = x[:n] << np.uint64(48) | x[1 : n + 1] << np.uint64(32) | x[2 : n + 2] << np.uint64(16) | x[3:]

    def four(self, at: np.ndarray) -> np.ndarray:
        last = len(self.packed) - 1
        return self.packed[at] if not len(at) or int(at.max()) <= last else np.where(at <= last, self.packed[np.minimum(at, last)], np.uint64(0))


_TUPLE = np.dtype([("pos", "<i8"), ("lcp", "<u2")])


class BucketQueue:
    """A priority queue over few symbols: tuples of one symbol leave in the order they came. Beyond `memory` tuples it spills."""

    def __init__(self, scratch: Scratch, memory: int | None = None):
        self.scratch, self.memory, self.held = scratch, memory or MEMORY, 0
        self.mem: dict[int, deque] = defaultdict(deque)
        self.file: dict[int, tuple[str, int]] = {}

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        rows = np.empty(len(pos), _TUPLE)
        rows["pos"], rows["lcp"] = pos, lcp
        self.mem[symbol].append(rows)
        self.held += len(rows)
        if self.held > self.memory:
            for s, parts in self.mem.items():
                if parts:
                    name, at = self.file.setdefault(s, (self.scratch.name(), 0))
                    with open(name, "ab") as f:
                        for p in parts:
                            p.tofile(f)
            self.mem.clear()
            self.held = 0

    def pop(self, symbol: int) -> np.ndarray | None:
        """The next tuples of a symbol, CHUNK at most; None if there are none now."""
        if symbol in self.file:
            name, at = self.file[symbol]
            rows = np.fromfile(name, _TUPLE, CHUNK, offset=at)
            if len(rows):
                self.file[symbol] = (name, at + rows.nbytes)
                return rows
            os.remove(name)
            del self.file[symbol]
        parts = self.mem.get(symbol)
        if not parts:
            return None
        rows = parts.popleft()
        if len(rows) > CHUNK:
            parts.appendleft(rows[CHUNK:])
            rows = rows[:CHUNK]
        else:
            small = [rows]
            size = len(rows)
            while parts and size + len(parts[0]) <= CHUNK:
                small.append(parts.popleft())
                size += len(small[-1])
            rows = np.concatenate(small) if len(small) > 1 else rows
        self.held -= len(rows)
        return rows


class DiskHeap:
    """A priority queue over any symbols, first in first out among equals; beyond `memory` tuples a sorted run goes to disk."""

    def __init__(self, scratch: Scratch, memory: int | None = None):
        self.scratch, self.memory, self.count = scratch, memory or MEMORY, 0
        self.mem: list[tuple[int, int, int]] = []
        self.heads: list[tuple[tuple[int, int, int], int]] = []
        self.runs: list[Iterator[tuple[int, int, int]]] = []

    def push(self, symbol: int, pos: int) -> None:
        heapq.heappush(self.mem, (symbol, self.count, pos))
        self.count += 1
        if len(self.mem) > self.memory:
            name = self.scratch.name()
            self.mem.sort()
            np.array(self.mem, np.int64).tofile(name)
            self.mem = []
            self.runs.append(self._read(name))
            self._next(len(self.runs) - 1)

    @staticmethod
    def _read(name: str) -> Iterator[tuple[int, int, int]]:
        at = 0
        while len(rows := np.fromfile(name, np.int64, 3 << 14, offset=at)):
            at += rows.nbytes
            yield from map(tuple, rows.reshape(-1, 3).tolist())
        os.remove(name)

    def _next(self, run: int) -> None:
        head = next(self.runs[run], None)
        if head is not None:
            heapq.heappush(self.heads, (head, run))

    def least(self) -> int | None:
        """The symbol that pop() would return."""
        a, b = self.mem[0][0] if self.mem else None, self.heads[0][0][0] if self.heads else None
        return b if a is None else a if b is None else min(a, b)

    def pop(self) -> tuple[int, int]:
        if self.heads and (not self.mem or self.heads[0][0] < self.mem[0]):
            head, run = heapq.heappop(self.heads)
            self._next(run)
        else:
            head = heapq.heappop(self.mem)
        return head[0], head[2]


def stars(t: np.ndarray, chunk: int = 1 << 22) -> np.ndarray:
    """Positions of the star suffixes, in order; t ends with its least symbol, which it has once."""
    n, found, right_s = len(t), [], True
    end = n - 1
    if n > 1:
        found.append(np.array([n - 1]))  # what stands before the end is larger
    while end > 0:
        begin = max(0, end - chunk)
        x = np.asarray(t[begin : end + 1]).astype(np.int64)
        d = np.sign(x[1:] - x[:-1])
        at = np.where(d != 0, np.arange(len(d)), len(d))
        at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ
        s = np.where(at < len(d), d[np.minimum(at, len(d) - 1)] > 0, right_s)
        if end < n - 1 and right_s and not s[-1]:
            found.append(np.array([end]))
        found.append(np.flatnonzero(s[1:] & ~s[:-1])[::-1] + begin + 1)
        right_s, end = bool(s[0]), begin
    return np.concatenate(found)[::-1] if found else np.zeros(0, np.int64)


def names(t: np.ndarray, star: np.ndarray, text: Text | None = None) -> np.ndarray:
    """The rank, from 0 without gaps, of each star's substring up to the next star; where one ends it counts as largest.

    Four symbols at a time where `text` has them so; only substrings that tie and go on take part in the next round.
    """
    m = len(star)
    stop = np.append(star[1:] + 1, len(t))
    pack = 4 if text else 1
    rank = np.zeros(m, np.int64)
    active, step = np.arange(m), 0
    while len(active):
        at = star[active] + step
        if text:
            key = text.four(at) | Text.FULL[np.clip(stop[active] - at, 0, 4)]
        else:
            key = np.where(at < stop[active], t[np.minimum(at, len(t) - 1)].astype(np.uint64), np.uint64(2**63))
        order = np.lexsort((key, rank[active])) if step else np.argsort(key, kind="stable")
        r, key, who = rank[active][order], key[order], active[order]
        old = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        new = np.append(True, (r[1:] != r[:-1]) | (key[1:] != key[:-1]))
        place = np.arange(len(who))
        group = np.maximum.accumulate(np.where(new, place, 0))
        base = np.repeat(old, np.diff(np.append(old, len(who))))
        rank[who] = r + group - base
        size = np.bincount(np.cumsum(new) - 1)
        tied = np.repeat(size, size) > 1
        step += pack
        active = np.sort(who[tied & (star[who] + step <= stop[who])])  # until its end has counted
    return np.unique(rank, return_inverse=True)[1]


def sorted_stars(t: np.ndarray, scratch: Scratch, text: Text | None = None) -> np.ndarray:
    """The star suffixes in increasing order."""
    star = stars(t)
    name = names(t, star, text)
    return star[np.argsort(name)] if len(star) == 0 or name.max() + 1 == len(name) else star[order(name, scratch)]


def order(t: np.ndarray, scratch: Scratch) -> np.ndarray:
    """The suffixes of a string of names in increasing order, one suffix at a time; t ends with its least symbol.

    Up to SLOTS names the queues are the slots of one array; beyond, heaps that spill, and the settled suffixes are on disk.
    """
    n = len(t)
    if n < 2:
        return np.arange(n)
    star = sorted_stars(t, scratch)
    if n <= SLOTS:
        return _order_in_memory(t, star)
    kept = np.memmap(scratch.name(), np.int64, "w+", shape=(n,))
    kept[:] = t
    t = kept
    seeds = elements(star)
    queue, large = DiskHeap(scratch), scratch.array("<i8")
    p = next(seeds, None)
    while p is not None or queue.least() is not None:
        if p is None or queue.least() is not None and queue.least() <= t[p]:
            symbol, at = queue.pop()
            large.append(at)
            if at and t[at - 1] >= symbol:
                queue.push(int(t[at - 1]), at - 1)
        else:
            if p:
                queue.push(int(t[p - 1]), p - 1)
            p = next(seeds, None)
    queue, out = DiskHeap(scratch), scratch.array("<i8")
    settled = elements(large.mapped()[::-1])
    p = next(settled, None)
    while p is not None or queue.least() is not None:
        if p is None or queue.least() is not None and -queue.least() >= t[p]:
            symbol, at = queue.pop()
            out.append(at)
            if at and t[at - 1] <= -symbol:
                queue.push(-int(t[at - 1]), at - 1)
        else:
            out.append(p)
            if p and t[p - 1] < t[p]:
                queue.push(-int(t[p - 1]), p - 1)
            p = next(settled, None)
    out.append(n - 1)
    return out.mapped()[::-1]


def _order_in_memory(t: np.ndarray, star: np.ndarray) -> np.ndarray:
    """order() where the suffixes fit: the queues are the symbols' slots in one array, filled from both ends."""
    n = len(t)
    d = np.sign(t[1:] - t[:-1])
    at = np.where(d != 0, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    small = [*(np.append(d, 1)[at] > 0).tolist(), True]
    size = np.bincount(t)
    ends = np.cumsum(size)
    sa, tail, head = [-1] * n, ends.tolist(), (ends - size).tolist()
    t = t.tolist()
    for p in reversed(star.tolist()):
        tail[t[p]] -= 1
        sa[tail[t[p]]] = p
    for i in range(n):
        p = sa[i]
        if p > 0:
            s = t[p - 1]
            if s >= t[p]:
                sa[head[s]] = p - 1
                head[s] += 1
    tail = ends.tolist()
    sa[0] = n - 1
    for i in range(n - 1, -1, -1):
        p = sa[i]
        if p > 0:
            s = t[p - 1]
            if s < t[p] or s == t[p] and small[p]:
                tail[s] -= 1
                sa[tail[s]] = p - 1
    return np.array(sa)


def common_prefix(text: Text, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of the common prefixes of pairs of suffixes, limit at most; a position of -1 has none."""
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero((a >= 0) & (b >= 0))
    for at in range(0, limit, 4):
        if not len(live):
            break
        x = text.four(a[live] + at) ^ text.four(b[live] + at)
        out[live] += (x < 1 << 48).astype(np.int64) + (x < 1 << 32) + (x < 1 << 16) + (x == 0)
        live = live[x == 0]
    return np.minimum(out, limit)


class _Induction:
    """One scan: settled tuples come in, the tuples that they induce go into the queue, with their common prefixes."""

    def __init__(self, t: np.ndarray, symbols: int, limit: int, queue: BucketQueue):
        self.t, self.limit, self.queue = t, limit, queue
        self.since = np.full(symbols, limit)  # least common prefix since a symbol's last tuple was sent
        self.started = np.zeros(symbols, bool)

    def settle(self, rows: np.ndarray, allowed) -> None:
        pos, lcp = rows["pos"], rows["lcp"].astype(np.int64)
        symbol = self.t[np.maximum(pos - 1, 0)].astype(np.int64)
        sends = (pos > 0) & allowed(symbol)
        low = lcp.min()
        places = np.flatnonzero(sends)
        if not len(places):
            self.since = np.minimum(self.since, low)
            return
        by = places[np.argsort(symbol[places], kind="stable")]
        kinds, first = np.unique(symbol[by], return_index=True)
        least = np.minimum(self.since, low)
        for d, p in zip(kinds.tolist(), np.split(by, first[1:]), strict=True):
            cuts = np.concatenate([[0], p + 1])
            mins = np.minimum.reduceat(np.append(lcp, self.limit), cuts)
            value = np.minimum(mins[:-1] + 1, self.limit)
            value[0] = min(mins[0], self.since[d]) + 1 if self.started[d] else 0
            self.queue.push(d, pos[p] - 1, np.minimum(value, self.limit))
            self.started[d] = True
            least[d] = mins[-1]
        self.since = least


def suffixes(t: np.ndarray, limit: int, scratch: Scratch, memory: int | None = None) -> Iterator[np.ndarray]:
    """All suffixes but the last in decreasing order, as chunks of (pos, lcp): lcp is the common prefix with the suffix that
    came before, limit at most. t is uint8 or uint16 and ends with 0, which it has once."""
    symbols = int(t.max()) + 1
    text = Text(t, scratch)
    star = sorted_stars(t, scratch, text)
    bounds = np.searchsorted(t[star], np.arange(symbols + 1))
    queue = BucketQueue(scratch, memory)
    scan = _Induction(t, symbols, limit, queue)
    large = scratch.name()
    at = [0]
    with open(large, "wb") as out:
        for c in range(symbols):
            last = -1
            while (rows := queue.pop(c)) is not None:
                rows.tofile(out)
                last = int(rows["pos"][-1])
                scan.settle(rows, lambda s, c=c: s >= c)
            at.append(out.tell() // _TUPLE.itemsize)
            for i in range(bounds[c], bounds[c + 1], CHUNK):
                part = star[i : min(i + CHUNK, bounds[c + 1])]
                rows = np.empty(len(part), _TUPLE)
                rows["pos"] = part
                rows["lcp"] = common_prefix(text, np.append(star[i - 1] if i > bounds[c] else last, part[:-1]), part, limit)
                scan.settle(rows, lambda s, c=c: s > c)
    queue = BucketQueue(scratch, memory)
    scan = _Induction(t, symbols, limit, queue)
    for c in range(symbols - 1, 0, -1):
        last = -1
        while (rows := queue.pop(c)) is not None:
            last = int(rows["pos"][-1])
            yield rows
            scan.settle(rows, lambda s, c=c: s <= c)
        carried = None  # common prefix of the last L tuple taken with the one below it
        for end in range(at[c + 1], at[c], -CHUNK):
            begin = max(at[c], end - CHUNK)
            rows = np.fromfile(large, _TUPLE, end - begin, offset=begin * _TUPLE.itemsize)[::-1]
            own = rows["lcp"].copy()
            rows["lcp"][1:] = own[:-1]
            rows["lcp"][0] = carried if carried is not None else common_prefix(text, np.array([last]), rows["pos"][:1], limit)[0]
            carried = own[-1]
            yield rows
            scan.settle(rows, lambda s, c=c: s < c)
    os.remove(large)
