"""Language-model scores from an interpolated modified Kneser-Ney bigram model.

Bigrams are counted in Spark. The model is a set of sorted hash arrays in the shared folder, one file per shard, which the
scoring workers memory-map, so its size isn't bounded by a worker's memory and grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.llm import files, textvec
from verdex.llm.common import cut, fresh_path, slices, table

_U = np.uint64
#: Words are known by 56 bits of their hash. The end of a text is a word, its start only a context.
WORD_BITS = 56
END, START = _U(1), _U(2)
#: Bytes of text per shard of the model, about, and words per flush of a counting task.
SHARD_BYTES, FLUSH = 24 << 20, 3 << 19
#: A word with this share of a sample's words, as a context, has its bigrams spread over all shards. It affects where counts
#: are kept, not what they are.
HOT_SHARE, SAMPLE = 1 / 256, 0.02
#: The largest count that stands in 4 bytes.
LARGE = 2**32 - 1


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words, first): each text's words and END, as 56-bit numbers; row i has words[first[i]:first[i + 1]]."""
    w = textvec.words(col)
    first = w.first + np.arange(len(w.first))
    out = np.full(first[-1], END, _U)
    body = np.ones(len(out), bool)
    body[first[1:] - 1] = False
    out[body] = (w.hash >> _U(64 - WORD_BITS)) | _U(4)  # never END or START
    return out, first


def contexts(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word before each word; START at the beginning of a text."""
    out = np.empty_like(words)
    out[1:] = words[:-1]
    out[first[:-1]] = START
    return out


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return textvec.mix(textvec.mix(left) + right)


def shard_of(left: np.ndarray, right: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """A context's bigrams lie in one shard, but those of a hot context in all."""
    key = np.where(np.isin(left, hot), pair_key(left, right), textvec.mix(left))
    return (key >> _U(32)).astype(np.int64) * shards >> 32


def word_shard(words: np.ndarray, shards: int) -> np.ndarray:
    return (textvec.mix(words + _U(1)) >> _U(32)).astype(np.int64) * shards >> 32


def _narrow(words: np.ndarray) -> bytes:
    """56-bit numbers in 7 bytes each."""
    return words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return out.view("<u8").ravel()


def _counts(n: np.ndarray) -> bytes:
    """Counts in 4 bytes each, or in 8 where one needs them."""
    return n.astype("<u4" if n.max(initial=0) <= LARGE else "<u8").tobytes()


def _counted(data: bytes, size: int) -> np.ndarray:
    """The `size` numbers that _counts() wrote."""
    return np.frombuffer(data, "<u4" if len(data) == 4 * size else "<u8").astype(np.int64)


def _count(shards: int, hot: np.ndarray):
    """Bigrams of a task's texts by shard: contexts, their run lengths, next words (7 bytes), counts (1 byte; larger ones repeat)."""

    def flush(held: list[np.ndarray], begins: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate([*held, np.array([START])])
        words, at = np.unique(every, return_inverse=True)
        at = at.astype(np.int64)
        left = np.concatenate([at[-1:], at[:-2]])
        left[np.concatenate(begins)] = at[-1]
        pair = left * len(words) + at[:-1]
        del every, left, at
        pair, n = np.unique(pair, return_counts=True)
        again = -(-n // 255)
        pair, total = np.repeat(pair, again), np.repeat(n, again)
        lead = np.repeat(np.cumsum(again) - again, again)
        n = np.minimum(255, total - 255 * (np.arange(len(pair)) - lead)).astype(np.uint8)
        v, w = words[pair // len(words)], words[pair % len(words)]
        shard = shard_of(v, w, hot, shards)
        order = np.argsort(shard, kind="stable")
        v, w, n, shard = v[order], w[order], n[order], shard[order]
        rows = []
        bounds = np.searchsorted(shard, np.arange(shards + 1))
        for k, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if j > i:
                start = np.flatnonzero(np.append(True, v[i + 1 : j] != v[i : j - 1]))
                rows.append((k, v[i:j][start].tobytes(), np.diff(np.append(start, j - i)).astype("<u4").tobytes(), _narrow(w[i:j]), n[i:j].tobytes()))
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["shard", "v", "runs", "w", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begins, size = [], [], 0
        for b in slices(batches):
            w, first = tokens(b.column(0))
            held.append(w)
            begins.append(first[:-1] + size)
            size += len(w)
            if size >= FLUSH:
                yield flush(held, begins)
                held, begins, size = [], [], 0
        if size:
            yield flush(held, begins)

    return run


def _merge(path: str, shards: int):
    """One shard's bigrams summed up: writes the shard's file and returns word statistics by word shard.

    Of a word: its count and in how many contexts it was seen (as next word), its total and how many next words it has with
    counts 1, 2, 3 and more (as context).
    """

    def flush(shard: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        v = np.concatenate([np.repeat(np.frombuffer(x[0], "<u8"), np.frombuffer(x[1], "<u4")) for x in held])
        w = np.concatenate([_wide(x[2]) for x in held])
        n = np.concatenate([np.frombuffer(x[3], np.uint8) for x in held]).astype(np.int64)
        order = np.lexsort((w, v))
        v, w, n = v[order], w[order], n[order]
        start = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
        v, w, n = v[start], w[start], np.add.reduceat(n, start)
        key = pair_key(v, w)
        order = np.argsort(key)
        key, count = key[order], n[order]
        large = np.flatnonzero(count > LARGE)  # their counts follow in full
        files.put(f"{path}/bigrams-{shard:06d}", [np.array([len(key)]), key, large, count[large], np.minimum(count, LARGE).astype("<u4")])
        of_of = np.bincount(np.minimum(n, 5), minlength=6)[1:5]
        start = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        left = np.stack([np.add.reduceat(x, start) for x in (n, n == 1, n == 2, n >= 3)], 1)
        word, at = np.unique(w, return_inverse=True)
        right = np.stack([np.bincount(at, n, len(word)).astype(np.int64), np.bincount(at, minlength=len(word))], 1)
        by_left, by_right = word_shard(v[start], shards), word_shard(word, shards)
        lo, ro = np.argsort(by_left, kind="stable"), np.argsort(by_right, kind="stable")
        lb, rb = (np.searchsorted(x, np.arange(shards + 1)) for x in (by_left[lo], by_right[ro]))
        rows = []
        for k in range(shards):
            i, j = lo[lb[k] : lb[k + 1]], ro[rb[k] : rb[k + 1]]
            if len(i) or len(j):
                rows.append((k, _narrow(v[start][i]), _counts(left[i]), _narrow(word[j]), _counts(right[j]), (0 * of_of if rows else of_of).tolist(), 0 if rows else 1))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:5]), pa.array(cols[5], pa.list_(pa.int64())), pa.array([shard if x else None for x in cols[6]], pa.int64())], names=["shard", "left", "left_n", "right", "right_n", "of_of", "of"])

    return _by_shard(flush)


def _by_shard(flush):
    """A task body that hands the rows of each shard together to flush(shard, rows); rows come sorted by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = -1, []
        for b in batches:
            for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != shard:
                    if held:
                        yield from flush(shard, held)
                    shard, held = k, []
                held.append(row)
        if held:
            yield from flush(shard, held)

    return run


def _words(path: str):
    """One word shard's statistics summed up: writes them as sorted arrays and returns totals.

    Totals: words with a count, their counts, contexts they were seen in, and how many were seen in 1, 2, 3, 4 contexts.
    """

    def flush(shard: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        every = [np.concatenate([_wide(x[k]) for x in held]) for k in (0, 2)]
        word = np.unique(np.concatenate(every))
        stats = np.zeros((len(word), 6), np.int64)  # count, contexts; total, with 1, with 2, with 3 and more
        for (k, width, base), at in zip(((1, 4, 2), (3, 2, 0)), (np.searchsorted(word, x) for x in every), strict=True):
            n = np.concatenate([_counted(x[k], len(x[k - 1]) // 7 * width) for x in held]).reshape(-1, width)
            for c in range(width):
                stats[:, base + c] += np.bincount(at, n[:, c], len(word)).astype(np.int64)
        files.put(f"{path}/words-{shard:06d}", [word, *stats.T])
        seen = stats[:, 1]
        told = [int((stats[:, 0] > 0).sum()), int(stats[:, 0].sum()), int(seen.sum()), *(int((seen == k).sum()) for k in (1, 2, 3, 4))]
        yield pa.RecordBatch.from_arrays([pa.array([[*told, shard]], pa.list_(pa.int64()))], names=["totals"])

    return _by_shard(flush)


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, 3 and more, from how many have counts 1 to 4.

    Where these are too few to tell, 0.5, 1 and 1.5.
    """
    if min(n[:3]) <= 0:
        return np.array([0, 0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return np.array([0, *(float(np.clip(x, 0.05, k + 0.95)) for k, x in enumerate(d))])


@dataclass
class Model:
    """Where the model's files are, and the corpus-wide numbers: the corpus's words (n), distinct ones (v), distinct bigrams."""

    path: str
    shards: int
    hot: np.ndarray
    n: int
    v: int
    bigrams: int
    d2: np.ndarray
    d1: np.ndarray
    lambda1: float

    def open(self) -> Scorer:
        if self.path not in _open:
            _open.clear()
            _open[self.path] = Scorer(self)
        return _open[self.path]


class Scorer:
    """A worker's view of the model: files are mapped as they are first needed."""

    def __init__(self, m: Model):
        self.m = m
        self.files = {"bigrams": files.Shards(m.path, "bigrams", self._bigrams), "words": files.Shards(m.path, "words", self._words)}

    @staticmethod
    def _bigrams(data: np.ndarray) -> list[np.ndarray]:
        """Keys, counts, which counts are larger than LARGE and what these are."""
        if not len(data):
            return [data.view("<u8"), data.view("<u4"), data.view("<i8"), data.view("<i8")]
        n = int(data[:8].view("<i8")[0])
        at = [8, 8 + 8 * n, len(data) - 4 * n]
        large = data[at[1] : at[2]].view("<i8")
        return [data[at[0] : at[1]].view("<u8"), data[at[2] :].view("<u4"), *np.split(large, 2)]

    @staticmethod
    def _words(data: np.ndarray) -> list[np.ndarray]:
        n = len(data) // 56
        return [data[: 8 * n].view("<u8"), *data[8 * n :].view("<i8").reshape(6, n)]

    def _find(self, kind: str, shard: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
        """Values of sorted distinct keys, 0 where the model has none; one pass over each shard asked for."""
        out = np.zeros((width, len(keys)), np.int64)
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(self.m.shards + 1))
        for k in np.flatnonzero(np.diff(bounds)):
            part = order[bounds[k] : bounds[k + 1]]
            have, *values = self.files[kind][k]
            if len(have):
                at = np.minimum(np.searchsorted(have, keys[part]), len(have) - 1)
                hit = have[at] == keys[part]
                for c in range(width):
                    out[c, part[hit]] = values[c][at[hit]]
                if kind == "bigrams" and len(values[1]):
                    large = np.minimum(np.searchsorted(values[1], at), len(values[1]) - 1)
                    over = hit & (values[1][large] == at)
                    out[0, part[over]] = values[2][large[over]]
        return out

    def score(self, col: pa.Array) -> tuple[np.ndarray, ...]:
        """Per text: words (END too), known words, base score and model score (log10)."""
        m = self.m
        w, first = tokens(col)
        if not len(w):
            return tuple(np.zeros(0) for _ in range(4))
        v = contexts(w, first)
        word, at = np.unique(np.concatenate([w, v]), return_inverse=True)
        wi, vi = at[: len(w)], at[len(w) :]
        count, seen, total, n1, n2, n3 = self._find("words", word_shard(word, m.shards), word, 6)
        base = np.log10((count + 0.1) / (m.n + 0.1 * (m.v + 1)))
        low = np.maximum(seen - m.d1[np.minimum(seen, 3)], 0) / max(m.bigrams, 1) + m.lambda1 / (m.v + 1)
        back = np.where(total > 0, (m.d2[1] * n1 + m.d2[2] * n2 + m.d2[3] * n3) / np.maximum(total, 1), 1.0)
        pair, pair_at = np.unique(vi * len(word) + wi, return_inverse=True)
        pv, pw = pair // len(word), pair % len(word)
        key, shard = pair_key(word[pv], word[pw]), shard_of(word[pv], word[pw], m.hot, m.shards)
        order = np.argsort(key)
        c = np.zeros(len(pair), np.int64)
        c[order] = self._find("bigrams", shard[order], key[order], 1)[0]
        p = np.where(c > 0, (c - m.d2[np.minimum(c, 3)]) / np.maximum(total[pv], 1), 0) + back[pv] * low[pw]
        row = np.repeat(np.arange(len(col)), np.diff(first))
        sums = lambda x: np.bincount(row, x, len(col))
        return np.diff(first), sums(count[wi] > 0).astype(np.int64), sums(base[wi]), sums(np.log10(p)[pair_at])


_open: dict[str, Scorer] = {}


def train(texts: DataFrame, path: str | None = None) -> Model:
    """Count the column `text` of all rows and write the model under path (by default in the shared folder).

    Null texts count as empty, and an empty text is one END. Repeated rows count each time. Without rows the model knows no
    word and gives every word the same probability.
    """
    spark = texts.sparkSession
    path = path or fresh_path(spark, "kneser-ney")
    texts = texts.select("text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(6, -(-size // SHARD_BYTES))
    hot = _hot_words(texts)
    counted = texts.mapInArrow(_count(shards, hot), "shard int, v binary, runs binary, w binary, n binary")
    merged = cut(counted.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(_merge(path, shards), "shard int, left binary, left_n binary, right binary, right_n binary, of_of array<bigint>, of bigint"))
    files.tell(path, "bigrams", shards, (r["of"] for r in merged.filter("of IS NOT NULL").select("of").collect()))
    of_of = merged.select(*(F.sum(F.col("of_of")[k]) for k in range(4))).first()
    columns = merged.select("shard", "left", "left_n", "right", "right_n")
    totals = columns.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(_words(path), "totals array<bigint>")
    told = [r["totals"] for r in totals.collect()]  # a row per shard
    files.tell(path, "words", shards, (x[7] for x in told))
    t = [sum(x[k] for x in told) for k in range(7)]
    d1 = discounts(t[3:])
    more = t[0] - t[3] - t[4]  # words seen in 3 contexts or more
    lambda1 = (d1[1] * t[3] + d1[2] * t[4] + d1[3] * more) / t[2] if t[2] else 1.0
    return Model(path, shards, hot, t[1], t[0], t[2], discounts([x or 0 for x in of_of]), d1, float(lambda1))


def _hot_words(texts: DataFrame) -> np.ndarray:
    """Words with HOT_SHARE of a sample's words: fewer than 1 / HOT_SHARE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w, n = np.unique(tokens(b.column(0))[0], return_counts=True)
            top = np.argsort(-n)[: int(2 / HOT_SHARE)]
            yield pa.RecordBatch.from_arrays([pa.array(w[top].astype(np.int64)), pa.array(n[top])], names=["w", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([int(n.sum())])], names=["w", "n"])

    found = texts.sample(fraction=SAMPLE, seed=7).mapInArrow(run, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    rows = [(r["w"], r["n"]) for r in found.orderBy(F.desc("n")).limit(int(2 / HOT_SHARE)).collect()]
    every = dict(rows).get(-1, 0)
    return np.array(sorted({int(START), *(w for w, n in rows if w >= 0 and n >= HOT_SHARE * every)}), _U)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row over its whole text; null is empty. One row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.open()
        for b in slices(batches):
            n, known, base, s = scorer.score(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(s, pa.float64())], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 10 == 0
    model = train(docs.filter(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("bigint").alias("train_tokens"), "base_score", "score")
