"""Source divergence audit: which sources of a language differ from each other, and by which terms, in exact arithmetic.

Relational: the terms of each slice of texts are counted, groups (a source in a language) are joined with the kept terms that
they have, and those rows with themselves on language and term. A term that one group of a pair lacks, or both, adds a value
that depends on its count in the other group alone, so it is taken from the number of terms by group and count: the sums go
over the whole vocabulary, without a row for each group and term. Ranks follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdex.llm import textvec
from verdex.llm.common import cut, slices, table

#: A-Z as a-z, and a space for each byte that belongs to no term, `[\x00-\x40\x5B-\x60\x7B-\x7F]`; bytes beyond ASCII belong to terms.
_TERM = np.where(textvec.ALNUM & ~np.isin(np.arange(256), range(48, 58)), textvec.LOWER, np.uint8(0x20))
#: Bytes of text whose terms are counted together.
SLICE = 1 << 22
SCALE = 1_000_000_000
#: So many groups, a row each, are broadcast at most.
FEW = 1_000
#: Parts that the groups' numbers of terms by count are dealt into when they meet the other groups of their language.
SALTS = 64


def share(count: Column, total: Column, terms: Column, alpha: int) -> Column:
    """1 + floor(SCALE (count + alpha) / (total + alpha terms)), exact: in long integers, or in decimals where those overflow."""
    over = total + alpha * terms
    small = F.call_function("div", F.lit(SCALE) * (count + alpha), over)
    large = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + alpha).cast("decimal(20,0)"), over.cast("decimal(20,0)"))
    return 1 + F.when(count < 9_000_000_000 - alpha, small).otherwise(large)


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); p and q are at most SCALE + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of some texts; of each occurrence its text's place and its term's."""
    buf, off = textvec.utf8(texts)
    if len(off) > 1 and off[-1] >= 1 << 31:
        raise ValueError("a text of over 2 GB")
    lists = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(_TERM[buf])]))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)  # white space at an end of a text leaves an empty string there
    seen = flat.filter(full).dictionary_encode()
    row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))[full.to_numpy(zero_copy_only=False)]
    return seen.dictionary, row, seen.indices.to_numpy()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of each slice of (lang, source, text): occurrences, and texts that have the term."""
    for b in slices(batches, "text", SLICE):
        terms, row, term = _terms(b.column(2))
        wide = max(len(terms), 1)
        of, n = np.unique(row * wide + term, return_counts=True)  # by text and term
        langs, sources = b.column(0).dictionary_encode(), b.column(1).dictionary_encode()
        group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        key = group[of // wide] * wide + of % wide
        order = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.diff(key[order], prepend=-1))
        group, term = np.divmod(key[order][at], wide)
        lang, source = np.divmod(group, len(sources.dictionary))
        columns = [langs.dictionary.take(pa.array(lang)), sources.dictionary.take(pa.array(source)), terms.take(pa.array(term))]
        columns += [pa.array(np.add.reduceat(n[order], at)), pa.array(np.diff(at, append=len(key)))]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def grouped(docs: DataFrame) -> DataFrame:
    """lang and source, null as ''; text."""
    return docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))


def term_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n, n_lang, first): occurrences, in the group and in its language, of the terms that at least
    `least_docs` documents (rows) of their language have. first: one row of a language's term has true."""
    counted = grouped(docs).mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("term", "lang")
    every = counted.select("*", F.sum("n").over(same).alias("n_lang"), F.sum("docs").over(same).alias("docs_lang"), F.min("source").over(same).alias("least"))
    return every.filter(F.col("docs_lang") >= least_docs).select("lang", "source", "term", "n", "n_lang", (F.col("source") == F.col("least")).alias("first"))


def divergence(docs: DataFrame, least_docs: int = 3, alpha: int = 1, top: int = 200) -> DataFrame:
    """How each (lang, source) group differs from the other sources of its language and from the language: lang, source,
    part, item, value, rank.

    docs needs text, lang and source; nulls count as '', further columns are left out, rows that repeat count each time. A
    term of a text is a run of letters (_TERM), A-Z as a-z. A language keeps the terms of at least `least_docs` of its
    documents. p = share() of a term in a group, q in what it is held against. Part `pair`: item is another source of the
    language, value the sum of excess(p, q) over the whole kept vocabulary, 0 without one. Part `term`: item is a term that
    the group has, with p above the language's q, value excess(p, q), and only ranks up to `top`. Ranks count from 1 per
    group and part, by value descending, then item in order of UTF-8. A group without terms gives its pairs; an empty table
    gives no rows.

    Counts combine in slices of the texts and on the map side. What is kept is written once. Of a pair of groups with counts
    0 or more, p and p0 (that of a term that the group lacks):
        excess(p, q) = excess(p0, q0) + [excess(p, q0) - excess(p0, q0)] + [excess(p0, q) - excess(p0, q0)] + the rest.
    The first holds for all terms, the second for those of the one group, the third for those of the other, both by number of
    terms of one count, and the rest is 0 but for terms of both: the self-join by (lang, term), which has a row per group that
    has the term. All of these are whole numbers. excess(p, q) is at most p^2 / q or q, and the p of one group sum up to about
    SCALE, so each sum has about SCALE^2 at most and a long holds what they add up to. A hot source is one row per term.
    """
    counts = cut(term_counts(docs, least_docs))
    groups = grouped(docs).select("lang", "source").distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("v"))
    totals = groups.join(totals, ["lang", "source"], "left").na.fill(0, ["total", "v"])
    lang = Window.partitionBy("lang")
    groups = totals.select("lang", "source", F.row_number().over(lang.orderBy("source")).cast("int").alias("group"), "total", F.sum("v").over(lang).alias("v"), F.sum("total").over(lang).alias("total_lang"))
    # without a vocabulary there is no share, and no term to have one
    groups = cut(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v"), alpha)).otherwise(1)))
    near = F.broadcast if groups.count() <= FEW else lambda df: df
    held = counts.join(near(groups), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v"), alpha))
    # by aliases and not by new names, so that both sides are one exchange; a term of one group alone meets no other
    shared = held.filter("n < n_lang").select("lang", "term", "group", "p", "p0")
    both = shared.alias("a").join(shared.alias("b"), ["term", "lang"]).filter("a.group < b.group")
    rest = lambda p, p0, q, q0: excess(p, q) - excess(p, q0) - excess(p0, q) + excess(p0, q0)
    ap, ap0, bp, bp0 = (F.col(x) for x in ("a.p", "a.p0", "b.p", "b.p0"))
    both = both.groupBy("lang", F.col("a.group").alias("low"), F.col("b.group").alias("high")).agg(F.sum(rest(ap, ap0, bp, bp0)).alias("up"), F.sum(rest(bp, bp0, ap, ap0)).alias("down"))
    both = both.select("lang", F.inline(F.array(F.struct(F.col("low").alias("group"), F.col("high").alias("other"), F.col("up").alias("value")), F.struct(F.col("high").alias("group"), F.col("low").alias("other"), F.col("down").alias("value")))))
    by_count = held.groupBy("lang", "group", "p", "p0").agg(F.count("*").alias("terms")).withColumn("salt", F.pmod(F.xxhash64("group", "p"), F.lit(SALTS)).cast("int"))
    others = groups.select("lang", F.col("group").alias("other"), F.col("p0").alias("q0"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    p, p0, q0, terms = (F.col(x) for x in ("p", "p0", "q0", "terms"))
    one = by_count.join(near(others), ["lang", "salt"]).filter("group <> other")
    one = one.groupBy("lang", "group", "other").agg(F.sum(terms * (excess(p, q0) - excess(p0, q0))).alias("own"), F.sum(terms * (excess(q0, p) - excess(q0, p0))).alias("given"))
    named = groups.select("lang", "source", "group", "v", "p0")
    pairs = named.join(groups.select("lang", F.col("source").alias("item"), F.col("group").alias("other"), F.col("p0").alias("q0")), "lang").filter("group <> other")
    parts = both.unionByName(one.select("lang", "group", "other", F.col("own").alias("value"))).unionByName(one.select("lang", F.col("other").alias("group"), F.col("group").alias("other"), F.col("given").alias("value")))
    sums = parts.groupBy("lang", "group", "other").agg(F.sum("value").alias("value"))
    value = F.col("v") * excess(p0, q0) + F.coalesce("value", F.lit(0))
    pairs = pairs.join(sums, ["lang", "group", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(own))
    found = held.select("lang", "source", F.col("term").alias("item"), "p", share(F.col("n_lang"), F.col("total_lang"), F.col("v"), alpha).alias("q"))
    found = found.filter("p > q").select("lang", "source", F.lit("term").alias("part"), "item", excess(F.col("p"), F.col("q")).alias("value"))
    found = found.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= top)
    return pairs.unionByName(found)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All groups of all documents."""
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
e AS (SELECT lang, source, id, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM e GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source, FALSE AS whole FROM d UNION ALL SELECT DISTINCT lang, NULL, TRUE FROM d),
c AS (SELECT lang, source, FALSE AS whole, term, count(*) AS n FROM e SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
  UNION ALL SELECT lang, NULL, TRUE, term, count(*) FROM e SEMI JOIN kept USING (lang, term) GROUP BY lang, term),
t AS (SELECT lang, source, whole, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, g.whole, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + v.v) AS p
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN v ON v.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source IS NOT DISTINCT FROM g.source AND c.whole = g.whole AND c.term = k.term
  LEFT JOIN t ON t.lang = g.lang AND t.source IS NOT DISTINCT FROM g.source AND t.whole = g.whole),
f AS (SELECT a.lang, a.source, b.source AS other, b.whole, a.term, a.n, a.p, b.p AS q, ((a.p - b.p) * (a.p - b.p)) // b.p AS f
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND NOT a.whole AND (b.whole OR a.source <> b.source)),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND NOT a.whole AND NOT b.whole AND a.source <> b.source
  LEFT JOIN (SELECT lang, source, other, sum(f) AS value FROM f WHERE NOT whole GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
  UNION ALL SELECT lang, source, 'term', term, f FROM f WHERE whole AND n > 0 AND p > q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM k WHERE part = 'pair' OR rank <= 200
"""
