"""Exact n-gram Jaccard join: sets that could have a partner are dealt into groups, and signature trees join each group.

A set is a text's distinct word shingles as 64-bit hashes. Steps: equal sets collapse into one; a shuffle by shingle finds
which shingles two or more sets have; a set with too few of those has no partner; the rest keep a prefix of their rarest
shingles, of which linked sets share at least one. Two rounds group the sets by a least hash of their shingles and link
most families. What is left are pairs of sets in different components: the sets that have a prefix shingle form its list,
and a list within one component is done. Inside a group or list, a tree over the sets holds OR-combined bitmaps and size
ranges, and a dual traversal prunes node pairs by the largest overlap that they allow; what is left is compared exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.llm import textvec
from verdex.llm.common import carry_back, cut, slices, table
from verdex.llm.components import components

_U = np.uint64
#: Shingles per shard of the shared-shingle shuffle, about; a task holds one shard at a time.
SHARD = 4_000_000
#: Sets per chunk of a list; a task holds two chunks at most.
CHUNK = 500


def need(n: int | np.ndarray, percent: int = 80) -> int | np.ndarray:
    """The smallest overlap that a set of n shingles has with any linked set."""
    return (percent * n + 99) // 100


def shingle_sets(col: pa.Array, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than `size` make one shingle, no words none."""
    w = textvec.words(col)
    m = len(w.hash)
    grams = textvec.chain([w.hash[i : m - size + 1 + i] for i in range(size)]) if m >= size else w.hash[:0]
    out = []
    for i, j in zip(w.first[:-1], w.first[1:], strict=True):
        if j - i >= size:
            out.append(np.unique(grams[i : j - size + 1]))
        else:
            out.append(textvec.chain([w.hash[k : k + 1] for k in range(i, j)]) if j > i else w.hash[:0])
    return out


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 20):
            sets = shingle_sets(b.column(1), size)
            ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n", "set_id"])

    return run


def _pack(size: int, shards: int):
    """Shingles by shard: of each slice of texts and each shard, set ids, set sizes, counts and shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 20):
            sets = {hashlib.blake2b(s.tobytes(), digest_size=16).digest(): s for s in shingle_sets(b.column(1), size) if len(s)}
            if not sets:
                continue
            every = np.concatenate(list(sets.values()))
            lengths = np.array([len(s) for s in sets.values()])
            owner = np.repeat(np.arange(len(sets)), lengths)
            shard = (every >> _U(32)) * _U(shards) >> _U(32)
            order = np.argsort(shard, kind="stable")  # owners stay in order inside a shard
            every, owner, shard = every[order].astype("<u8"), owner[order], shard[order]
            ids = np.array(list(sets), "V16")
            rows = []
            bounds = np.searchsorted(shard, np.arange(shards + 1))
            for k, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if j > i:
                    who, count = np.unique(owner[i:j], return_counts=True)
                    rows.append((k, ids[who].tobytes(), lengths[who].astype("<u4").tobytes(), count.astype("<u4").tobytes(), every[i:j].tobytes()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["shard", "ids", "sizes", "counts", "shingles"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each shard the shingles that two or more sets have, by set: (set_id, n, shingles, df)."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, at = np.unique(np.concatenate([np.frombuffer(x[0], "V16") for x in held]), return_inverse=True)
        counts = np.concatenate([np.frombuffer(x[2], "<u4") for x in held])
        sizes = np.zeros(len(ids), np.int64)
        sizes[at] = np.concatenate([np.frombuffer(x[1], "<u4") for x in held])
        token = np.concatenate([np.frombuffer(x[3], "<u8") for x in held])
        owner = np.repeat(at, counts)
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        new_pair = np.ones(len(token), bool)
        new_pair[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        group = np.cumsum(new) - 1
        df = np.bincount(group[new_pair])[group]
        keep = (df >= 2) & new_pair  # a copy of a set in another slice repeats its pairs
        token, owner, df = token[keep], owner[keep], df[keep]
        order = np.argsort(owner, kind="stable")
        token, owner, df = token[order], owner[order], df[order]
        who, first = np.unique(owner, return_index=True)
        ends = np.append(first, len(owner))
        whole = token.view(np.int64)
        for i in range(0, len(who), 20_000):
            part = slice(first[i], ends[min(i + 20_000, len(who))])
            off = pa.array(ends[i : min(i + 20_000, len(who)) + 1] - first[i], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[k].tobytes() for k in who[i : i + 20_000]], pa.binary()), pa.array(sizes[who[i : i + 20_000]]), pa.ListArray.from_arrays(off, pa.array(whole[part])), pa.ListArray.from_arrays(off, pa.array(df[part], pa.int64()))],
                names=["set_id", "n", "shingles", "df"],
            )

    shard, held = -1, []
    for b in batches:
        for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if k != shard:
                if held:
                    yield from flush(held)
                shard, held = k, []
            held.append(row)
    if held:
        yield from flush(held)


def _candidates(percent: int):
    """Sets with enough shared shingles for a partner, with the prefix that a linked set must meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, tokens, dfs, out = None, 0, [], [], []

        def close() -> None:
            if key is None:
                return
            t, d = np.concatenate(tokens), np.concatenate(dfs)
            least = need(n, percent)
            if len(t) < least:
                return
            order = np.lexsort((t, d))
            prefix = t[order[: n - least + 1 - (n - len(t))]]
            out.append((key, n, np.sort(t).tobytes(), prefix.tolist()))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["set_id", "n", "tokens", "prefix"])

        for b in batches:
            lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (b.column(2), b.column(3))]
            for i, (k, size) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if k != key:
                    close()
                    key, n, tokens, dfs = k, size, [], []
                    if len(out) >= 2000:
                        yield batch()
                        out.clear()
                for (off, values), to in zip(lists, (tokens, dfs), strict=True):
                    to.append(values[off[i] : off[i + 1]])
        close()
        if out:
            yield batch()

    return run


class Forest:
    """Union-find over 0..n-1 whose roots are least members."""

    def __init__(self, label: np.ndarray):
        self.up = np.arange(len(label))
        first: dict[int, int] = {}
        for i, x in enumerate(label.tolist()):
            self.up[i] = first.setdefault(x, i)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if (nxt == up).all():
                break
            up = nxt
        self.up = up
        return up


class SignatureTree:
    """Sets in a fixed order under a tree of fan-out F; a node has the OR of its sets' bitmaps, their least and largest size,
    and the largest number of shingles by which a set exceeds its own bits."""

    FAN = 8

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, order: np.ndarray, bits: int):
        self.order = order
        maps = np.zeros((len(order), bits // 64), _U)
        over = np.zeros(len(order), np.int64)
        for i, k in enumerate(order):
            h = textvec.mix(sets[k].view(_U)) & _U(bits - 1)
            np.bitwise_or.at(maps[i], (h >> _U(6)).astype(np.int64), _U(1) << (h & _U(63)))
            over[i] = len(sets[k]) - int(np.bitwise_count(maps[i]).sum())
        self.levels = [(maps, sizes[order], sizes[order], over)]
        while len(self.levels[-1][0]) > 1:
            m, low, high, ex = self.levels[-1]
            at = np.arange(0, len(m), self.FAN)
            self.levels.append((np.bitwise_or.reduceat(m, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(ex, at)))

    def uniform(self, roots: np.ndarray) -> list[np.ndarray]:
        """Of each level the component that all sets of a node are in, or -1."""
        out = [roots[self.order]]
        for _ in self.levels[1:]:
            c = out[-1]
            at = np.arange(0, len(c), self.FAN)
            low, high = np.minimum.reduceat(c, at), np.maximum.reduceat(c, at)
            out.append(np.where(low == high, low, -1))
        return out


def tree_join(sets: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, side: np.ndarray, percent: int = 80) -> np.ndarray:
    """Component roots (positions) after linking every pair of sets with Jaccard similarity of percent or more.

    sets: sorted shared shingles; sizes: the sets' full sizes; labels: components known so far; side: 0 sets are compared
    with all, 1 sets with 0 sets only (they were compared with one another before).
    A pair inside one component isn't looked at: linking it changes nothing.
    """
    forest = Forest(labels)

    def linked(a: int, b: int) -> bool:
        x, y = sets[a], sets[b]
        most = min(len(x), len(y))
        total = int(sizes[a] + sizes[b])
        if 100 * most < percent * (total - most):
            return False
        both = np.concatenate([x, y])
        both.sort()
        o = int((both[1:] == both[:-1]).sum())
        return 100 * o >= percent * (total - o)

    def check(pairs: np.ndarray) -> None:
        for a, b in pairs:
            if (side[a] == 0 or side[b] == 0) and forest.find(a) != forest.find(b) and linked(a, b):
                forest.union(a, b)

    keys = []
    for salt in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):  # sets with equal least shingles are likely linked
        keys.append(np.array([textvec.mix(s.view(_U) * _U(salt)).min() for s in sets]))
        order = np.lexsort((sizes, keys[-1]))
        check(np.stack([order[:-1], order[1:]], 1))
    bits = 1 << max(10, min(14, int(np.median(sizes) * 4).bit_length()))
    tree = SignatureTree(sets, sizes, np.lexsort((keys[1], keys[0])), bits)
    stack = [(len(tree.levels) - 1, np.zeros((1, 2), np.int64))]
    while stack:
        level, pairs = stack.pop()
        same = tree.uniform(forest.roots())[level]
        maps, low, high, over = tree.levels[level]
        for i in range(0, len(pairs), 4096):
            p, q = pairs[i : i + 4096].T
            alive = (same[p] != same[q]) | (same[p] < 0)
            p, q = p[alive], q[alive]
            least = np.maximum(need(np.maximum(low[p], low[q]), percent), (percent * (low[p] + low[q]) + 99 + percent) // (100 + percent))
            alive = least <= np.minimum(high[p], high[q])
            p, q, least = p[alive], q[alive], least[alive]
            bound = np.bitwise_count(maps[p] & maps[q]).sum(axis=1).astype(np.int64) + np.minimum(over[p], over[q])
            p, q = p[bound >= least], q[bound >= least]
            if not len(p):
                continue
            if level == 0:
                check(np.stack([tree.order[p], tree.order[q]], 1)[p != q])
                continue
            below = len(tree.levels[level - 1][0])
            kid = np.arange(tree.FAN)
            a = (p[:, None, None] * tree.FAN + kid[None, :, None]) + 0 * kid[None, None, :]
            b = (q[:, None, None] * tree.FAN + kid[None, None, :]) + 0 * kid[None, :, None]
            a, b = a.ravel(), b.ravel()
            ok = (a < below) & (b < below) & (a <= b)
            if level == 1:
                ok &= a != b
            stack.append((level - 1, np.stack([a[ok], b[ok]], 1)))
    return forest.roots()


def _join(percent: int):
    """Components of each task key's sets: (node, label) for every set given as side 0 or 1; labels are least nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            node = np.array([r[0] for r in rows])
            order = np.argsort(node, kind="stable")
            rows = [rows[i] for i in order]
            node = node[order]
            label = np.array([r[1] for r in rows])
            roots = tree_join([np.frombuffer(r[3], np.int64) for r in rows], np.array([r[2] for r in rows]), label, np.array([r[4] for r in rows]), percent)
            # links of the known components come along, as their least nodes may be elsewhere
            a = np.concatenate([node, node])
            b = np.concatenate([node[roots], label])
            new = a != b
            return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])

        key, held = None, []
        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if len(held) > 1:
                        yield flush(held)
                    key, held = k, []
                held.append(row)
        if len(held) > 1:
            yield flush(held)

    return run


def _task_join(rows: DataFrame, percent: int) -> DataFrame:
    """Edges that join linked sets, from rows (task, node, label, n, tokens, side)."""
    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(_join(percent), "a bigint, b bigint")


def _key(*c: Column) -> Column:
    """A task's name."""
    return F.to_json(F.struct(*(x.alias(f"c{i}") for i, x in enumerate(c))))


def _chunk(salt: int, size: Column) -> Column:
    """The chunk of a node among as many as `size` rows need."""
    return F.pmod(F.xxhash64(F.lit(salt), "node"), F.ceil(size / CHUNK)).cast("bigint")


def _least_hash(salt: int):
    """node and the least of its shingles' hashes under a salt; sets of similarity s agree with probability s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = [int(textvec.mix(np.frombuffer(t, "<u8") + _U(salt)).view(np.int64).min()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(low, pa.int64())], names=["node", "low"])

    return run


def _families(cands: DataFrame, percent: int, rows: int) -> DataFrame:
    """Edges of the links inside groups with one least hash, in two rounds; a group over CHUNK sets is cut by the node.

    This is linear: it only makes the lists short that must be joined in full. cands: (node, n, tokens).
    """
    edges = None
    for salt in (1, 2):
        low = cands.select("node", "tokens").mapInArrow(_least_hash(salt), "node bigint, low bigint")
        sizes = low.groupBy("low").agg(F.count("*").alias("size")).filter("size > 1")
        grouped = carry_back(low, cut(sizes), "low", "size", rows)
        sets = cands.join(grouped, "node").select(_key(F.col("low"), _chunk(salt, F.col("size"))).alias("task"), "node", F.col("node").alias("label"), "n", "tokens", F.lit(0).alias("side"))
        found = _task_join(sets, percent)
        edges = found if edges is None else edges.union(found)
    return cut(edges)


def _bands(n: Column, percent: int) -> Column:
    """The two bands of a set's size: sets whose sizes allow a link have one in common."""
    if percent == 100:
        return F.array(n)
    band = F.floor(F.log(n.cast("double")) / math.log(100 / percent) + 1e-9).cast("bigint")
    return F.array(band, band + 1)


def _lists(cands: DataFrame, percent: int, rows: int) -> DataFrame:
    """Edges of the links between sets of different components that have a prefix shingle in common.

    cands: (node, label, n, tokens, prefix). A shingle's list whose sets are all of one component has nothing to add. Lists
    with one least label have much in common, so they make one task, in which each set stands once. Where that is over
    CHUNK sets, each list is a task of its own, but lists of the same sets are one; a list over CHUNK sets is cut by bands
    of size, and a band's list that is still longer into chunks: the sets outside the list's largest component meet every
    chunk, so that no link is lost.
    """
    posts = cands.select("node", "label", "n", F.explode("prefix").alias("token"))
    hashes = [F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("h2")]
    lists = posts.groupBy("token").agg(F.count("*").alias("size"), F.min("label").alias("g"), F.max("label").alias("high"), *hashes).filter("g <> high").drop("high")
    lists = cut(lists)
    posts = cut(carry_back(posts, lists.select("token", "size", "g"), "token", "size", rows))
    groups = posts.groupBy("g", "node").agg(F.min("label").alias("label"), F.min("n").alias("n"))
    many = cut(groups.groupBy("g").agg(F.count("*").alias("k")))
    groups = carry_back(groups, many.filter(F.col("k") <= CHUNK), "g", "k", rows)
    sets = cands.select("node", "tokens")
    task = lambda rows: _task_join(rows.join(sets, "node").select("task", "node", "label", "n", "tokens", "side"), percent)
    found = cut(task(groups.select(_key(F.col("g")).alias("task"), "node", "label", "n", F.lit(0).alias("side"))))
    many = many.filter(F.col("k") > CHUNK)
    if many.isEmpty():
        return found
    posts = posts.join(lists.groupBy("size", "h1", "h2").agg(F.min("token").alias("token")).select("token"), "token", "left_semi")
    posts = cut(carry_back(posts, many, "g", "k", posts.count()))
    short = posts.filter(F.col("size") <= CHUNK).select(_key(F.col("token")).alias("task"), "node", "label", "n", F.lit(0).alias("side"))
    found = found.union(cut(task(short)))
    long = cut(posts.filter(F.col("size") > CHUNK).drop("size", "k").withColumn("band", F.explode(_bands(F.col("n"), percent))).withColumn("list", _key(F.col("token"), F.col("band"))))
    if long.isEmpty():
        return found
    of_label = cut(long.groupBy("list", "label").agg(F.count("*").alias("k")))
    size = of_label.groupBy("list").agg(F.sum("k").alias("size"), F.max(F.struct("k", "label"))["label"].alias("main")).filter("size > 1")
    size = size.join(of_label.withColumnRenamed("label", "main"), ["list", "main"]).withColumn("others", F.col("size") - F.col("k")).filter("others > 0")
    long = cut(carry_back(long, cut(size.select("list", "size", "main", "others")), "list", "size", long.count()))
    # every set sits in chunk i of its list; a set outside the main component also in chunk j of those. Task (i, j) compares j's with i's.
    whole = F.col("size") <= CHUNK
    chunks = lambda c: F.sequence(F.lit(0).cast("bigint"), F.when(whole, 0).otherwise(F.ceil(F.col(c) / CHUNK) - 1).cast("bigint"))
    left = long.select("*", F.explode(chunks("others")).alias("j")).select(_key(F.col("list"), F.when(whole, 0).otherwise(_chunk(3, F.col("size"))), F.col("j")).alias("task"), "node", "label", "n", F.when(whole, 0).otherwise(1).alias("side"))
    rest = long.filter((F.col("label") != F.col("main")) & ~whole)
    right = rest.select("*", F.explode(chunks("size")).alias("i")).select(_key(F.col("list"), F.col("i"), _chunk(4, F.col("others"))).alias("task"), "node", "label", "n", F.lit(0).alias("side"))
    return found.union(cut(task(left.union(right))))


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: components of the links between texts.

    Words are runs of non-space bytes with A-Z lowered; two texts link when 100 * intersection >= percent * union of their
    distinct shingles. A text with fewer words than `size` is one shingle; an empty, blank or null text has none and links
    with nothing. component_id is the least doc_id in reach; null doc_ids are left out of that minimum, and a component of
    null doc_ids only has a null one. Repeated rows link as equal texts. Only doc_id and text are read. An empty table
    gives no rows. A text of any length has its whole set. Exact but for the hashes: shingles are compared by 64 bits, whole
    sets by 128.
    """
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    info = cut(read.mapInArrow(_describe(size), "doc_id bigint, n bigint, set_id binary"))
    total = info.agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).first()
    shards = max(12, -(-(total["shingles"] or 0) // SHARD))
    sets = cut(info.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    packed = read.mapInArrow(_pack(size, shards), "shard int, ids binary, sizes binary, counts binary, shingles binary")
    shared = packed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(_shared, "set_id binary, n bigint, shingles array<bigint>, df array<bigint>")
    cands = shared.repartition("set_id").sortWithinPartitions("set_id").mapInArrow(_candidates(percent), "set_id binary, n bigint, tokens binary, prefix array<bigint>")
    cands = cut(cands.join(sets.filter("rep IS NOT NULL").select("set_id", F.col("rep").alias("node")), "set_id").select("node", "n", "tokens", "prefix"))
    families = _families(cands, percent, total["rows"])
    known = cands.join(components(families), "node", "left").withColumn("label", F.coalesce("label", "node"))
    labels = components(families.union(_lists(cut(known), percent, total["rows"])))
    named = sets.join(labels, sets["rep"] == labels["node"], "left").select("set_id", "copies", F.coalesce("label", "rep").alias("component_id"))
    full = carry_back(info.filter("set_id IS NOT NULL"), cut(named), "set_id", "copies", total["rows"])
    return full.select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(info.filter("set_id IS NULL").select("doc_id", "n", "doc_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one with the least doc_id, all columns unchanged.

    Texts without words are all kept. Rows go out by doc_id, so only the ids that leave are joined with the texts; rows that
    repeat a doc_id stay or go together, and a row without one stays. A text of any length has its whole set.
    """
    gone = jaccard_components(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count and near-duplicate component."""
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id FROM (SELECT a AS doc_id, min(c) AS c FROM r GROUP BY 1) LEFT JOIN n USING (doc_id)"""
