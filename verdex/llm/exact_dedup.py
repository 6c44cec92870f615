"""Exact deduplication against a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdex.llm.common import SPACE, carry_back, cut, fresh_path, remove, table, text_of, unused

#: Digests per bucket that a new index plans for; 40 bytes each.
PER_BUCKET = 4_000_000


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(text, SPACE, " ")


class DigestIndex:
    """A table of (digest, keep_id, seen, batch), bucketed and sorted by digest, in the catalog under `name` at `location`.

    One row per distinct text ever appended; batch says with which batch it came. A new batch meets it in a sort-merge join
    that reads the index without a shuffle, as its buckets are dealt by the join key, and without a sort while each bucket
    is one file: compact() makes it so again.
    """

    #: Files of a bucket from which an append compacts first.
    FILES = 8

    def __init__(self, spark: SparkSession, name: str, location: str, buckets: int = 64):
        self.spark, self.name, self.location, self.buckets = spark, name, location, buckets

    def rows(self) -> DataFrame:
        self.spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # a bucket of one file is read as sorted
        if not self.spark.catalog.tableExists(self.name):
            self.spark.sql(
                f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, seen BIGINT, batch STRING) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.location}'"
            )
        return self.spark.table(self.name)

    def _write(self, rows: DataFrame, name: str, location: str) -> None:
        (
            rows.select("digest", "keep_id", "seen", "batch").repartition(self.buckets, "digest").write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").option("path", location).saveAsTable(name)
        )

    def has(self, batch: str) -> bool:
        return not self.rows().filter(F.col("batch") == batch).isEmpty()

    def append(self, fresh: DataFrame, batch: str) -> None:
        """Add rows whose digests the index lacks, as one batch; each bucket gets one more sorted file. A batch that the
        index has already, as its job failed later and runs again, isn't added twice."""
        if self.has(batch):
            return
        if len(self.rows().inputFiles()) >= self.FILES * self.buckets:
            self.compact()
        self._write(fresh.withColumn("batch", F.lit(batch)), self.name, self.location)
        self.spark.catalog.refreshTable(self.name)

    def compact(self) -> None:
        """Rewrite each bucket as one sorted file, in a new folder; the table then points there, and the old folder goes."""
        old, new, temp = self.location, f"{self.location}-{uuid.uuid4().hex}", f"{self.name}_compacted"
        self._write(self.spark.read.parquet(old), temp, new)  # as plain files: the planner would leave out the shuffle of a bucketed scan
        self.spark.sql(f"DROP TABLE {temp}")  # the files stay
        self.spark.sql(f"ALTER TABLE {self.name} SET LOCATION '{new}'")
        self.spark.catalog.refreshTable(self.name)
        self.location = new
        remove(self.spark, old)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.location)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, digest) of every row; rid tells rows with one doc_id apart."""
    return docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.unhex(F.sha2(normalised(text_of()), 256)).alias("digest"))


def dedup(docs: DataFrame, index: DigestIndex, batches: int = 1, name: str | None = None, hot_share: int = 1000) -> DataFrame:
    """Decide on each row by the index and append its new digests to it, in batches of ascending doc_id.

    Returns doc_id, rid, keep_id, group_size (rows of this call with the text), kept, digest: one row per input row.
    Kept is the row with the smallest doc_id of a text that the index lacked (of repeated doc_ids the first read; a null
    doc_id comes after all others); of a text that the index had, none is kept and keep_id is the index's.
    An empty table gives no rows. Other columns are not read, so their names can't clash. `name` names the call's batches:
    one that is repeated under its name after a failure gives the same result, as its own digests don't count as known.

    Groups are counted with map-side combining, so a large group of copies reaches its reducer as one row per task. To
    carry the verdict back, groups with over 1/hot_share of all rows (under hot_share of them: a bound by counting) are
    broadcast; all other rows meet theirs in a sort-merge join, where no key then holds more than that share.
    """
    name = name or uuid.uuid4().hex
    d = cut(digests(docs))
    bounds = (d.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)])).first()[0] or []) if batches > 1 else []
    batch = sum((F.coalesce(F.col("doc_id") > b, F.lit(True)).cast("int") for b in bounds), F.lit(0))
    verdict = None
    for k in range(len(bounds) + 1):
        groups = cut(
            d.filter(batch == k).groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "rid")).alias("low"), F.count("*").alias("seen"))
            .select("digest", F.col("low.doc_id").alias("keep_id"), F.col("low.rid").alias("keep_rid"), "seen")
        )
        known = index.rows().filter(F.col("batch") != f"{name}-{k}")
        fresh = cut(groups.hint("merge").join(known.select("digest"), "digest", "left_anti"))
        old = groups.join(known.select("digest", F.col("keep_id").alias("old_id")).hint("merge"), "digest").select("digest", "old_id", F.lit(None).cast("bigint").alias("keep_rid"), "seen")
        told = cut(fresh.select("digest", "keep_id", "keep_rid", "seen").union(old))
        index.append(fresh, f"{name}-{k}")
        verdict = told if verdict is None else verdict.union(told)
    if bounds:  # what the index says of a text is the same in each batch
        verdict = cut(verdict.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("keep_rid").alias("keep_rid"), F.sum("seen").alias("seen")))
    full = carry_back(d, verdict, "digest", "seen", d.count(), hot_share)
    return full.select("doc_id", "rid", "keep_id", F.col("seen").alias("group_size"), F.coalesce(F.col("keep_rid") == F.col("rid"), F.lit(False)).alias("kept"), "digest")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without copies: of equal texts (white space aside) the row with the smallest doc_id, all columns unchanged.

    Decisions come from dedup() with an index of this table alone. They go back by (digest, doc_id), so that a group of
    copies is spread over tasks; of rows that repeat both, one stays. Null texts are empty, and all empty texts are one.
    """
    spark = docs.sparkSession
    index = fresh_index(spark)
    digest, n = unused(docs, "digest"), unused(docs, "n")
    kept = dedup(docs, index).filter("kept").select(F.col("digest").alias("k_digest"), F.col("doc_id").alias("k_id"))
    index.drop()  # verdicts are written elsewhere
    rows = docs.withColumn(digest, F.unhex(F.sha2(normalised(text_of()), 256)))
    rows = rows.join(kept, (rows[digest] == kept["k_digest"]) & rows["doc_id"].eqNullSafe(kept["k_id"]), "left_semi")
    one = Window.partitionBy(digest, "doc_id").orderBy(digest)
    return rows.withColumn(n, F.row_number().over(one)).filter(F.col(n) == 1).select(*docs.columns)


def fresh_index(spark: SparkSession, rows: int = 0) -> DigestIndex:
    """An empty index in the shared folder, with buckets for so many rows."""
    return DigestIndex(spark, f"verdex_digests_{uuid.uuid4().hex}", fresh_path(spark, "digest-index"), max(16, rows // PER_BUCKET))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: which row of its text stays, how many share it. The table comes in three batches, and what an
    earlier batch put into the index decides on the later ones."""
    docs = table(spark, sf_dir, "documents")
    index = fresh_index(spark, docs.count())
    out = dedup(docs.select("doc_id", "text"), index, batches=3)
    index.drop()  # the result stands in what dedup() has written beside it
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""
