"""Target-distribution importance resampling: documents whose hashed n-grams look like a target's are drawn more often.

Each slice of a task's texts becomes one sequence of word ids, whose suffixes are sorted by as many words as the longest
feature has. Common prefixes of neighbours give runs: all places of one n-gram stand together. An n-gram is hashed once per
run, and its bucket goes back to all its places, from which bucket counts and the scores of documents are summed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from verdex.llm import textvec
from verdex.llm.common import cut, slices, table

BUCKETS = 10_000
#: Bytes of text whose suffixes are sorted together.
SLICE = 1 << 23
#: Letters and digits in lower case, any other byte a space; bytes beyond ASCII belong to words.
_WORD = np.where(textvec.ALNUM, textvec.LOWER, np.uint8(0x20))


class Places(NamedTuple):
    """Of each feature's place its text and bucket; words: of each text."""

    row: np.ndarray
    bucket: np.ndarray
    words: np.ndarray


def suffix_order(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of the suffixes of a sequence of word ids by their first `depth` words, by prefix doubling.

    left: how many words of its text a place has from there on, so no suffix goes on into the next text; a shorter one comes
    first. common[i]: how many of the first `depth` words suffixes order[i - 1] and order[i] share; 0 for the first.
    """
    n, rank, k = len(ids), ids.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while k < depth:
        after = np.full(n, -1, np.int64)
        has = np.flatnonzero(left > k)
        after[has] = rank[has + k]
        order = np.lexsort((after, rank))
        a, b = rank[order], after[order]
        new = np.ones(n, np.int64)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        k *= 2
    common = np.zeros(n, np.int64)
    here, before = order[1:], order[:-1]
    for d in range(depth):
        alike = np.flatnonzero((common[1:] == d) & (left[here] > d) & (left[before] > d))
        alike = alike[ids[here[alike] + d] == ids[before[alike] + d]]
        common[alike + 1] = d + 1
    return order, common


def places(col: pa.Array, least: int, most: int, buckets: int) -> Places:
    """The features of each text: all runs of `least` to `most` words, joined by a space; bucket: crc32 of that in UTF-8."""
    buf, off = textvec.utf8(col)
    if len(off) > 1 and off[-1] >= 1 << 31:
        raise ValueError("a text of over 2 GB")
    text = pa.Array.from_buffers(pa.string(), len(col), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(_WORD[buf])])
    lists = pc.ascii_split_whitespace(text)
    flat = lists.flatten()
    sizes = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(col)), sizes)
    full = pc.greater(pc.binary_length(flat), 0)  # white space at an end of a text leaves an empty string there
    seen, row = flat.filter(full).dictionary_encode(), row[full.to_numpy(zero_copy_only=False)]
    words = [w.encode() for w in seen.dictionary.to_pylist()]
    ids = seen.indices.to_numpy()
    count = np.bincount(row, minlength=len(col))
    left = np.cumsum(count)[row] - np.arange(len(ids))
    order, common = suffix_order(ids, left, most)
    rows, found = [], []
    for n in range(least, most + 1):
        at = np.flatnonzero(left[order] >= n)  # suffixes too short for a feature stand before the runs of longer ones
        place = order[at]
        first = np.ones(len(at), bool)
        first[1:] = (common[at[1:]] < n) | (at[1:] != at[:-1] + 1)
        heads = place[first].tolist()
        hashed = np.fromiter((zlib.crc32(b" ".join([words[w] for w in ids[p : p + n].tolist()])) for p in heads) if n > 1 else (zlib.crc32(words[w]) for w in ids[place[first]].tolist()), np.int64, len(heads))
        bucket = np.empty(len(ids), np.int64)
        bucket[place] = (hashed % buckets)[np.cumsum(first) - 1]
        has = np.flatnonzero(left >= n)
        rows.append(row[has]), found.append(bucket[has])
    return Places(np.concatenate(rows), np.concatenate(found), count)


def bucket_counts(docs: DataFrame, least: int = 1, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): the features of all texts by bucket. A task gives one row per bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in slices(batches, "text", SLICE):
            n += np.bincount(places(b.column(0), least, most, buckets).bucket, minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) by bucket, from the bucket_counts() of both.

    One number per bucket comes to the driver: `buckets` bounds them, whatever the texts are.
    """
    source, target = cut(source), cut(target)
    sums = [int(x.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) + buckets for x in (source, target)]
    every = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    s, t = source.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    counts = every.join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0)
    double = lambda name: (F.col(name) + 1).cast("double")
    gain = F.floor(1000 * F.log(double("t") * F.lit(float(sums[0])) / (double("s") * F.lit(float(sums[1])))))
    out = np.zeros(buckets, np.int64)
    for r in counts.select("bucket", gain.alias("gain")).collect():
        out[r["bucket"]] = r["gain"]
    return out


def score(docs: DataFrame, gain: np.ndarray, least: int = 1, most: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains of each text's features, 0 without any."""
    kind = docs.select("doc_id").schema[0].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            p = places(b.column(1), least, most, len(gain))
            n = np.bincount(p.row, minlength=b.num_rows)
            total = np.zeros(b.num_rows, np.int64)
            np.add.at(total, p.row, gain[p.bucket])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.words), pa.array(n), pa.array(total // np.maximum(n, 1))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def gumbel(seed: int, doc_id: Column) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 8 hex digits of sha256("seed:doc_id"); a null doc_id counts as the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def draw(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """scored (doc_id, n_words, score, ...) with `rank`: 1, 2, ... for the floor(percent N / 100) highest scores of the N rows
    of at least `least_words` words, ties to the smaller doc_id, null for all others.

    Scores are thousandths of logarithms, so there are at most some 115,000 of them however many rows there are: 44,000 either
    way for gains of 64-bit counts, 26,000 for the noise. Their counts are broadcast; only rows of one score are sorted together.
    """
    fits = F.col("n_words") >= least_words
    counts = scored.filter(fits).groupBy("score").agg(F.count("*").alias("n"))
    counts = cut(counts.withColumn("cell", F.shiftright("score", 8)))  # at most some hundred cells, of 256 scores each
    cells = counts.groupBy("cell").agg(F.sum("n").alias("n"))
    higher = lambda key, by: (Window.partitionBy(by) if by else Window).orderBy(F.desc(key)).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("cell", F.coalesce(F.sum("n").over(higher("cell", None)), F.lit(0)).alias("above"), F.sum("n").over(Window.partitionBy()).alias("fit"))
    told = counts.withColumn("inside", F.coalesce(F.sum("n").over(higher("score", "cell")), F.lit(0))).join(F.broadcast(cells), "cell")
    quota = F.call_function("div", percent * F.col("fit"), F.lit(100))
    told = told.select("score", (F.col("above") + F.col("inside")).alias("before"), quota.alias("quota"))
    rows = scored.join(F.broadcast(told), "score", "left")
    near = fits & (F.col("before") < F.col("quota"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    chosen = rows.filter(near).withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= F.col("quota"), F.col("rank")))
    others = rows.filter(~F.coalesce(near, F.lit(False))).withColumn("rank", F.lit(None).cast("bigint"))
    return chosen.unionByName(others).select(*scored.columns, F.col("rank").cast("bigint").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, least: int = 1, most: int = 1, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """Every row of docs with doc_id, n_words, n_features, weight, score and rank (null: not drawn), docs like `target` first.

    docs and target need text, docs doc_id too; further columns are left out. Features are runs of `least` to `most` words of
    ASCII letters and digits in lower case and of characters beyond ASCII; a null or empty text has none, its weight is 0. An
    empty target has no features, an empty table of docs gives no rows. Rows that repeat are scored alike and ranked one
    after another; a null doc_id has the noise of the empty text and comes last among equals.

    Texts are read twice, for the counts and for the scores; a task holds the suffixes of one slice of SLICE bytes (or one
    longer text) and sends one number per bucket, then one row per document, which is written once before ranks are given.
    """
    gain = gains(bucket_counts(docs, least, most, buckets), bucket_counts(target, least, most, buckets), buckets)
    rows = score(docs, gain, least, most)
    return draw(cut(rows.withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id")))), percent, least_words)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with all texts of the benchmark as the target."""
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_features", "weight", "score", "rank")


#: crc32 over each distinct word's bytes, by a table of 256 numbers made from the polynomial's rule.
ORACLE = r"""
WITH RECURSIVE steps(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
w AS (SELECT 'd' AS kind, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL SELECT 'b', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
v AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM w),
b AS (SELECT word, list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT) AS bytes FROM v),
f AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM b, crc),
c AS (SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM w JOIN f USING (word) GROUP BY bucket),
a AS (SELECT count(*) FILTER (kind = 'd') AS S_all, count(*) FILTER (kind = 'b') AS T_all FROM w),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (S_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (T_all + 10000)::DOUBLE)))::BIGINT AS gain FROM c, a),
n AS (SELECT id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM w JOIN f USING (word) JOIN g USING (bucket) WHERE kind = 'd' GROUP BY id),
s AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM documents LEFT JOIN n ON n.id = doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS fit FROM s WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * fit // 100 THEN rank END AS rank FROM s LEFT JOIN r ON r.doc_id = s.doc_id
"""
