"""Proportional stratified interleaving: shards of equal row counts, each with the whole mixture of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdex.llm.common import cut, table, text_of

#: Rows of a cell, about, and the largest number of cells, as their counts are summed up in one window.
CELL_ROWS, MOST_CELLS = 2_000, 1 << 20


def _offsets(rows: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """rows with `before`: how many rows of the same keys lie in lower cells. Cells are counted first, so a window sees counts only."""
    counts = rows.groupBy(*keys, cell).agg(F.count("*").alias("_n"))
    low = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy(*(keys or [F.lit(0)]))
    counts = counts.select(*keys, cell, F.coalesce(F.sum("_n").over(low), F.lit(0)).alias("before"), F.sum("_n").over(own).alias("total"))
    return rows.join(counts, [*keys, cell])


def interleave(docs: DataFrame, shards: int, seed: int = 42) -> DataFrame:
    """Give every row a shard and a slot in it; law `rows`: the shards' counts are at most one apart.

    docs needs doc_id, source, text; other columns are left out. Returns doc_id, source, size (UTF-8 bytes + 1; null: 1),
    text_crc32, shard, slot (from 0, gapless). Rows of a source are shuffled by a seeded digest of the doc_id and ranked;
    all rows are then sorted by their fractional rank (2 rank - 1) / (2 n) in their source, equal ones by a seeded digest
    of the source, and this order is cut into equal runs, so each shard holds each source's share to within a row. A null
    source is a source of its own, a null doc_id counts as the empty text; rows with one doc_id are told apart by size and
    checksum, and if those agree too, either order gives the same result. Of a text of any length only its size and
    checksum go on. An empty table gives no rows.

    No source is sorted in one task: its digests are cut into cells of about CELL_ROWS rows, cells are counted, and a
    rank is the count below the cell plus the rank inside. The fractional ranks are placed in the same way; a fraction
    with more rows than a cell, as many small sources have, is cut by the digests of their sources. Such fractions number
    less than the rows by CELL_ROWS, and only those of crowded slices are counted, so they are broadcast.
    """
    n = docs.count()
    cells = max(1, min(MOST_CELLS, -(-n // CELL_ROWS)))
    bits = max(1, (cells - 1).bit_length())
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = cut(
        docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("_stratum"), F.col("source").isNull().alias("_no_source"), "source", (F.octet_length(text_of()).cast("bigint") + 1).alias("size"), F.crc32(F.encode(text_of(), "UTF-8")).alias("text_crc32"), order.alias("_order"))
        .withColumn("_cell", F.shiftright(F.conv(F.substring("_order", 1, 7), 16, 10).cast("int"), 28 - bits))
    )
    rows = _offsets(rows, ["_stratum", "_no_source"], "_cell")
    inside = Window.partitionBy("_stratum", "_no_source", "_cell").orderBy("_order", "doc_id", "size", "text_crc32")
    rows = rows.withColumn("_rank", F.col("before") + F.row_number().over(inside)).withColumn("_frac", (2 * F.col("_rank") - 1) / (2 * F.col("total")))
    tie = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_no_source").cast("string"), F.col("_stratum"))), 1, 7), 16, 10).cast("bigint")
    rows = cut(rows.drop("before", "total").withColumn("_slice", F.floor(F.col("_frac") * cells).cast("int")).withColumn("_tie", tie))
    crowded = F.broadcast(rows.groupBy("_slice").agg(F.count("*").alias("_n")).filter(F.col("_n") > 4 * CELL_ROWS).select("_slice"))
    tied = rows.join(crowded, "_slice").groupBy("_slice", "_frac").agg(F.count("*").alias("_n")).filter(F.col("_n") > CELL_ROWS)
    tied = tied.groupBy("_slice").agg(F.map_from_entries(F.collect_list(F.struct("_frac", "_n"))).alias("_tied"))
    rows = rows.join(F.broadcast(cut(tied)), "_slice", "left")
    # in a slice: rows below its first tied fraction, then those of it by _tie, then those up to the next one
    low = F.coalesce(F.array_max(F.filter(F.map_keys("_tied"), lambda f: f <= F.col("_frac"))), F.lit(-1.0))
    sub = F.when(low == F.col("_frac"), F.shiftright(F.col("_tie") * F.ceil(F.col("_tied")[F.col("_frac")] / CELL_ROWS), 28)).otherwise(0)
    rows = rows.withColumn("_part", F.struct("_slice", low.alias("low"), (low != F.col("_frac")).alias("after"), sub.alias("sub"))).drop("_tied")
    rows = _offsets(rows, [], "_part")
    place = Window.partitionBy("_part").orderBy("_frac", "_tie", "_no_source", "_stratum", "_rank")
    rows = rows.withColumn("_at", F.col("before") + F.row_number().over(place) - 1)
    rows = rows.withColumn("shard", F.expr(f"cast(_at * {shards} div {max(n, 1)} as int)"))
    shard_start = F.expr(f"(shard * {max(n, 1)}L + {shards - 1}) div {shards}")
    return rows.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("_at") - shard_start).cast("bigint").alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards, law `rows`."""
    out = interleave(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Ranks over whole sources and over all rows; crc32 goes byte by byte through a table made from the polynomial's rule.
ORACLE = r"""
WITH RECURSIVE steps(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
b AS (SELECT doc_id, source, strlen(coalesce(text, ''))::BIGINT + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT doc_id, source, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32, md5('42:' || coalesce(doc_id::VARCHAR, '')) AS o FROM b, crc),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY o, doc_id, size, text_crc32) AS k, count(*) OVER (PARTITION BY source) AS total, count(*) OVER () AS n FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * k - 1)::DOUBLE / (2 * total)::DOUBLE, ('0x' || substr(md5('42:' || CASE WHEN source IS NULL THEN 'true' ELSE 'false' END || coalesce(source, '')), 1, 7))::BIGINT, source IS NULL, source, k) - 1 AS pos FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * 16 // n)::INT AS shard, pos - ((pos * 16 // n) * n + 15) // 16 AS slot, NULL::INT AS grown_shard FROM p
"""
