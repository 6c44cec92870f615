"""Benchmark decontamination: training passages query a BM25 index of the test items with block-max WAND; hits are verified."""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdex.llm import files, textvec
from verdex.llm.common import cut, fresh_path, lowered, slices, table, unused

K1, B = 1.2, 0.75
#: Postings of a block, whose largest impact is kept.
BLOCK = 32
#: Share of the item's word 5-grams, or of the question's and of the answer's each, that the passage must have.
MIN_OVERLAP = 0.8
GRAM = 5
#: Bytes of test items per index file. A worker holds one at a time, and IN_HAND bytes of texts that meet them in turn.
INDEX_BYTES, IN_HAND = 8 << 20, 1 << 23
#: Ranges of items, at most, for which all passages of a batch are bounded at once before any is searched.
RANGES = 64

HITS = "array<struct<item_id: bigint, bm25: double, whole: double, question: double, answer: double>>"
_PARTS = re.compile(r"(?is)\banswer\s*:|\?|(?<=[.!])\s+(?=\S[^.!?]*[.!?]?\s*$)")


def question_and_answer(text: str) -> tuple[str, str]:
    """An item cut at `Answer:`, else after its last question mark, else before its last sentence; one sentence is all question."""
    marks = list(_PARTS.finditer(text))
    for kind in ("answer", "?"):
        cuts = [m for m in marks if m[0].strip().lower().startswith(kind)]
        if cuts and text[cuts[-1].end() :].strip():
            return text[: cuts[-1].start() if kind == "answer" else cuts[-1].end()], text[cuts[-1].end() :]
    cuts = [m for m in marks if not m[0].strip()]
    return (text[: cuts[-1].start()], text[cuts[-1].end() :]) if cuts else (text, "")


def grams(h: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Distinct hashes of the runs of `size` words."""
    return np.unique(textvec.chain([h[i : len(h) - size + 1 + i] for i in range(size)])) if len(h) >= size else h[:0]


def most_lost(h: np.ndarray, mass: np.ndarray) -> float:
    """Most mass that words may have which are absent from a text with MIN_OVERLAP of the words' distinct grams.

    mass is by position. An absent word takes every gram that holds it, so this is the heaviest set of positions that lie
    in no more grams than may be missing: over positions in order, the best for each number of grams, by the distance to
    the last absent position (from GRAM on the grams of two positions are apart). Grams that recur count as often as
    they can, which only raises the result.
    """
    size = min(GRAM, len(h))
    runs = textvec.chain([h[i : len(h) - size + 1 + i] for i in range(size)])
    times = np.sort(np.unique(runs, return_counts=True)[1])[::-1]
    room = int(times[: int((1 - MIN_OVERLAP) * len(times) + 1e-9)].sum())
    if not room:
        return 0.0
    far, near = np.zeros(room + 1), []  # best with the last absent position GRAM or more back; and those after it
    for q in range(len(h)):
        if len(near) == size:
            far = np.maximum(far, near.pop(0))
        here = np.full(room + 1, -np.inf)
        for before, back in [(far, size), *((x, len(near) - k) for k, x in enumerate(near))]:
            cost = min(q, len(runs) - 1) - max(q - size + 1, q - back + 1, 0) + 1
            if 0 <= cost <= room:
                np.maximum(here[cost:], before[: room + 1 - cost] + mass[q], out=here[cost:])
            elif cost < 0:
                np.maximum(here, before + mass[q], out=here)
        near.append(here)
    return float(max(far.max(), *(x.max() for x in near)))


@dataclass
class Corpus:
    """Statistics of all test items that have words: number, mean and greatest length, and in how many items each term is."""

    items: int
    length: float
    longest: int
    terms: np.ndarray  # sorted word hashes
    df: np.ndarray


@dataclass
class Index:
    """Postings in item order, with impacts, block maxima, and each item's threshold and shingles."""

    item_ids: np.ndarray
    terms: np.ndarray  # sorted word hashes
    first: np.ndarray  # of each term its first posting
    items: np.ndarray
    impact: np.ndarray
    top: np.ndarray  # largest impact of each term
    blocks: list[np.ndarray]  # of each term the largest impact of each block
    threshold: np.ndarray
    range_top: np.ndarray  # of each term and range of items the largest impact
    range_low: np.ndarray  # of each range the lowest threshold
    parts: list[list[tuple[int, np.ndarray]]]  # of each item, for the whole, question and answer: gram size, grams
    stride: int

    def postings(self, term: int) -> tuple[list[int], list[float], list[float], float]:
        """A term's items, impacts, block maxima and largest impact, as lists for the cursors; kept once asked for."""
        kept = self.__dict__.setdefault("_lists", {})
        if term not in kept:
            i, j = self.first[term], self.first[term + 1]
            kept[term] = (self.items[i:j].tolist(), self.impact[i:j].tolist(), self.blocks[term].tolist(), float(self.top[term]))
        return kept[term]

    @classmethod
    def build(cls, rows: list[tuple[int, str]], whole: Corpus | None = None) -> Index:
        """The index of some items, with the statistics of the whole benchmark (by default these items are all)."""
        rows = sorted((i, t) for i, t in rows if i is not None and t)
        words = [textvec.words(lowered(pa.array([t])), textvec.ALNUM).hash for _, t in rows]
        order = sorted((k for k in range(len(rows)) if len(words[k])), key=lambda k: (len(words[k]), k))  # items of a range have thresholds alike
        rows, words = [rows[k] for k in order], [words[k] for k in order]
        length = np.array([len(w) for w in words], float)
        item = np.repeat(np.arange(len(words)), length.astype(int))
        every = np.concatenate(words) if words else np.zeros(0, np.uint64)
        terms, at = np.unique(every, return_inverse=True)
        key, tf = np.unique(at * max(len(words), 1) + item, return_counts=True)
        term, items = key // max(len(words), 1), key % max(len(words), 1)
        first = np.searchsorted(term, np.arange(len(terms) + 1))
        df = np.diff(first)
        whole = whole or Corpus(len(words), length.mean() if len(length) else 1.0, int(length.max(initial=1)), terms, df)
        df = whole.df[np.searchsorted(whole.terms, terms)] if len(terms) else df
        idf = np.log1p((whole.items - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / whole.length)
        impact = idf[term] * tf * (K1 + 1) / (tf + norm[items])
        top = np.array([impact[i:j].max() for i, j in zip(first[:-1], first[1:], strict=True)])
        blocks = [np.maximum.reduceat(impact[i:j], np.arange(0, j - i, BLOCK)) for i, j in zip(first[:-1], first[1:], strict=True)]
        parts, threshold = [], np.zeros(len(words))
        held = np.argsort(items, kind="stable")
        bounds = np.searchsorted(items[held], np.arange(len(words) + 1))
        for k, (_, t) in enumerate(rows):
            split = [textvec.words(lowered(pa.array([x])), textvec.ALNUM).hash for x in question_and_answer(t)]
            if not len(split[0]):
                split = [split[1], split[0]]
            split = [h for h in split if len(h)]
            parts.append([(min(GRAM, len(h)), grams(h, min(GRAM, len(h)))) for h in [words[k], *split]])
            # What a verified passage scores at least: an item's words have its impacts, shared out among their places.
            post = held[bounds[k] : bounds[k + 1]]
            own_terms, own_impact = terms[term[post]], impact[post]
            kept = []
            for held_parts in filter(None, ([words[k]], split)):
                have, count = np.unique(np.concatenate(held_parts), return_counts=True)
                least = 0.0
                for h in held_parts:
                    at = np.minimum(np.searchsorted(own_terms, h), len(own_terms) - 1)
                    mass = np.where(own_terms[at] == h, own_impact[at], 0) / count[np.searchsorted(have, h)]
                    least += mass.sum() - most_lost(h, mass)
                kept.append(least)
            threshold[k] = min(kept) * (1 - 1e-9)
        ranges = max(1, min(RANGES, len(words)))
        range_top, range_low = np.zeros((len(terms), ranges), np.float32), np.full(ranges, np.inf)
        np.maximum.at(range_top, (term, items * ranges // max(len(words), 1)), np.nextafter(impact.astype(np.float32), np.float32(np.inf)))
        np.minimum.at(range_low, np.arange(len(words)) * ranges // max(len(words), 1), threshold)
        return cls(np.array([i for i, _ in rows], np.int64), terms, first, items, impact, top, blocks, threshold, range_top, range_low, parts, whole.longest)

    @classmethod
    def load(cls, path: str, k: int) -> Index:
        """A file of the index in the shared folder."""
        return pickle.loads(files.mapped(f"{path}/{k:06d}").tobytes())

    def search(self, query: np.ndarray) -> list[tuple[int, float]]:
        """All items whose score against the query's terms reaches their threshold, by block-max WAND.

        query: distinct term numbers. Cursors stay sorted by item; the pivot is the first item that the cursors' largest
        impacts could lift over the lowest threshold; if the maxima of the blocks around it can't, all of these blocks are
        passed at once.
        """
        low, last, out = float(self.threshold.min()), len(self.item_ids), []
        cur = []  # [item, position, items, impacts, block maxima, largest impact]
        for t in query.tolist():
            items, impacts, blocks, top = self.postings(t)
            cur.append([items[0], 0, items, impacts, blocks, top])

        def move(c: list, item: int) -> None:
            """The cursor's first posting at or after item."""
            c[1] = bisect_left(c[2], item, c[1])
            c[0] = c[2][c[1]] if c[1] < len(c[2]) else last

        while True:
            cur.sort(key=itemgetter(0))
            while cur and cur[-1][0] == last:
                cur.pop()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cur):
                bound += c[5]
                if bound >= low:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = cur[pivot][0]
            while pivot + 1 < len(cur) and cur[pivot + 1][0] == item:
                pivot += 1
            near, edge = 0.0, cur[pivot + 1][0] if pivot + 1 < len(cur) else last
            for c in cur[: pivot + 1]:
                at = c[1] if c[0] >= item else bisect_left(c[2], item, c[1])
                if at < len(c[2]):
                    block = at // BLOCK
                    near += c[4][block]
                    end = (block + 1) * BLOCK
                    edge = min(edge, c[2][end - 1] + 1 if end <= len(c[2]) else last)
            if near < low:
                for c in cur[: pivot + 1]:
                    move(c, max(edge, item + 1))
            elif cur[0][0] == item:
                score = sum(c[3][c[1]] for c in cur[: pivot + 1])
                if score >= self.threshold[item]:
                    out.append((item, score))
                for c in cur[: pivot + 1]:
                    move(c, item + 1)
            else:
                for c in cur[:pivot]:
                    if c[0] < item:
                        move(c, item)

    def hits(self, col: pa.Array) -> list[list[dict]]:
        """Verified hits of each text, the best passage for each item.

        Passages are runs of two strides, one stride apart, so each run of words as long as the longest item lies in one.
        """
        out: list[list[dict]] = [[] for _ in range(len(col))]
        w = textvec.words(lowered(col), textvec.ALNUM)
        if not len(w.hash) or not len(self.item_ids):
            return out
        term = np.minimum(np.searchsorted(self.terms, w.hash), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[term] == w.hash)
        place = (known - w.first[w.row[known]]) // self.stride
        count = -(-np.diff(w.first) // self.stride) + 1
        base = np.concatenate([[0], np.cumsum(count)])
        passage = base[w.row[known]] + place + 1  # this one and the one before it have the word
        n_terms = len(self.terms)
        key = np.unique(np.concatenate([passage, passage - 1]) * n_terms + np.tile(term[known], 2))
        passage, term = key // n_terms, key % n_terms
        starts = np.flatnonzero(np.append(True, passage[1:] != passage[:-1])) if len(key) else np.zeros(0, int)
        if not len(starts):
            return out
        ends = np.append(starts[1:], len(key))
        able = np.flatnonzero(np.add.reduceat(self.top[term], starts) >= self.threshold.min())
        low = (self.range_low * (1 - 1e-4)).astype(np.float32)  # single precision, with room for its rounding
        for i in range(0, len(able), 2048):
            part = able[i : i + 2048]
            size = ends[part] - starts[part]
            rows = np.repeat(starts[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            bound = np.add.reduceat(self.range_top[term[rows]], np.cumsum(size) - size, axis=0)
            able[i : i + 2048] = np.where((bound >= low).any(axis=1), part, -1)
        for s in able[able >= 0]:
            found = self.search(term[starts[s] : ends[s]])
            if not found:
                continue
            p = int(passage[starts[s]])
            row = int(np.searchsorted(base, p, side="right")) - 1
            begin = w.first[row] + max(0, p - 1 - base[row]) * self.stride
            if p == base[row]:
                begin, end = w.first[row], min(w.first[row] + self.stride, w.first[row + 1])
            else:
                end = min(begin + 2 * self.stride, w.first[row + 1])
            h, by_size = w.hash[begin:end], {}
            for item, score in found:
                share = []
                for size, own in self.parts[item]:
                    if size not in by_size:
                        by_size[size] = grams(h, size)
                    share.append(float(np.isin(own, by_size[size]).mean()))
                if share[0] >= MIN_OVERLAP or min(share[1:], default=0.0) >= MIN_OVERLAP:
                    out[row].append({"item_id": int(self.item_ids[item]), "bm25": score, "whole": share[0], "question": share[1] if share[1:] else share[0], "answer": share[-1]})
        for row, found in enumerate(out):
            best: dict[int, dict] = {}
            for x in found:
                if x["item_id"] not in best or x["bm25"] > best[x["item_id"]]["bm25"]:
                    best[x["item_id"]] = x
            out[row] = [best[k] for k in sorted(best)]
        return out


def _build(path: str, k: int, rows: pd.DataFrame, whole: Corpus | None) -> pd.DataFrame:
    """Writes the file of one part of the items, in a task."""
    rows = rows[rows["text"].notna()].sort_values(["item_id", "text"])
    files.put(f"{path}/{k:06d}", [np.frombuffer(pickle.dumps(Index.build(list(zip(rows["item_id"].tolist(), rows["text"].tolist(), strict=True)), whole)), np.uint8)])
    return pd.DataFrame({"part": [k]})


def find_hits(docs: DataFrame, benchmark: DataFrame, out: str = "hits") -> DataFrame:
    """docs with a column of the benchmark items that each row's text contains: item_id, bm25, whole, question and answer overlap.

    An item is contained if some passage has MIN_OVERLAP of its word 5-grams, or of those of its question and of its
    answer each, which may then stand apart (fewer words: the whole). Only passages are verified that reach the least BM25
    score such a passage can have. Null or empty texts have no hits, nor do items without words; without items there are
    none at all. A column named `out` is replaced; other columns pass unchanged.

    Passages overlap, so a text of any length is searched whole; repeated rows each get their hits, and of several passages
    with an item the one of the highest score is told (the first of equal ones). Test items may repeat: each has its hits.

    The index is cut into files of INDEX_BYTES of items, all with the statistics of the whole benchmark, so hits don't
    depend on the cut; each is built in a task of its own, from one pass over the benchmark. A task takes IN_HAND bytes of texts, which meet one file after another. There is no shuffle of texts.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // INDEX_BYTES))
    path = fresh_path(spark, "bm25")
    part = items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int"))
    every = spark.range(shards).select(F.lit(0).cast("bigint").alias("item_id"), F.lit(None).cast("string").alias("text"), F.col("id").cast("int").alias("part"))  # a part may be empty
    grouped = part.unionByName(every).groupBy("part")
    if shards > 1:
        terms = cut(part.select("part", "text").mapInArrow(_terms, "part int, term bigint, n bigint"))
        total = terms.filter("term IS NULL").agg(F.count("*").alias("items"), F.avg("n").alias("length"), F.max("n").alias("longest")).first()
        df = terms.filter("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))
        own = terms.filter("term IS NOT NULL").select("part", "term").distinct().join(df, "term")
        counts = (total["items"], total["length"] or 1.0, total["longest"] or 1)

        def shard(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            own = own.assign(term=own["term"].to_numpy(np.int64).view(np.uint64)).sort_values("term")
            return _build(path, key[0], rows, Corpus(*counts, own["term"].to_numpy(), own["df"].to_numpy()))

        built = grouped.cogroup(own.groupBy("part")).applyInPandas(shard, "part int")
    else:
        built = grouped.applyInPandas(lambda key, rows: _build(path, key[0], rows, None), "part int")
    if built.count() != shards:
        raise RuntimeError("a file of the index is missing")
    schema = T.StructType([*docs.drop(out).schema.fields, T.StructField(out, T._parse_datatype_string(HITS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), *((x, pa.float64()) for x in ("bm25", "whole", "question", "answer"))]))
        index = Index.load(path, 0) if shards == 1 else None
        for held in _in_hand(slices(batches, most=1 << 20)):
            found = [[[] for _ in range(b.num_rows)] for b in held]
            for k in range(shards):
                index = index if shards == 1 else Index.load(path, k)
                for b, hits in zip(held, found, strict=True):
                    for to, more in zip(hits, index.hits(b.column(b.schema.get_field_index("text"))), strict=True):
                        to += more
            for b, hits in zip(held, found, strict=True):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([sorted(x, key=itemgetter("item_id")) for x in hits], kind)], names=[*b.schema.names, out])

    return docs.drop(out).mapInArrow(run, schema)


def _in_hand(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches together, of IN_HAND bytes about."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size > IN_HAND:
            yield held
            held, size = [], 0
    if held:
        yield held


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's distinct terms, and one row without a term that has its number of words; items without words have none."""
    for b in slices(batches, most=1 << 20):
        w = textvec.words(lowered(b.column(1)), textvec.ALNUM)
        part, n = b.column(0).to_numpy(), np.diff(w.first)
        row, at = np.unique(w.row, return_index=True)
        length = pa.RecordBatch.from_arrays([pa.array(part[row], pa.int32()), pa.nulls(len(row), pa.int64()), pa.array(n[row], pa.int64())], names=["part", "term", "n"])
        word, code = np.unique(w.hash, return_inverse=True)
        pair = np.unique(w.row * max(len(word), 1) + code)
        yield length
        yield pa.RecordBatch.from_arrays([pa.array(part[pair // max(len(word), 1)], pa.int32()), pa.array(word[pair % max(len(word), 1)].view(np.int64)), pa.nulls(len(pair), pa.int64())], names=["part", "term", "n"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that contain no benchmark item, all columns unchanged."""
    hits = unused(docs, "hits")
    return find_hits(docs, benchmark, hits).filter(F.size(hits) == 0).drop(hits)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: the benchmark items in it, in order, its best BM25 score, and whether it is contaminated."""
    docs = find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return docs.select(
        "doc_id",
        F.size("hits").cast("bigint").alias("n_items"),
        F.array_join(F.transform(F.array_sort(F.transform("hits", lambda h: h["item_id"])), lambda i: i.cast("string")), ",").alias("item_ids"),
        F.round(F.array_max(F.transform("hits", lambda h: h["bm25"])), 6).alias("best_bm25"),
        (F.size("hits") > 0).alias("contaminated"),
    )
