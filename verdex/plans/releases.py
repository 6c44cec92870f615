"""Curation as one job over real input: items made from documents and labels are validated, selected, counted and released.

An item is a document: its state is the text, its question by the length of that, its answer by its label, its file by language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.functions import privacy as P
from verdex.operators import counters, curation
from verdex.operators import items as I
from verdex.plans.registry import query
from verdex.sources.tables import table

CAPS, RESERVED = {"src0": 10, "src1": 20, "gen": 3}, ("src2:en",)
REASONS = ("teacher_disagreed", "excluded:finqa", "excluded:reserved_rules", "excluded:contamination", "over_quota", "no_target")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with ITEM's columns, `file`, `ord` and `used_in`; some are broken in each way that the validator knows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    n = F.col("n_chars")
    kind = F.when(n % 4 == 0, "noul").when(n % 4 == 1, "choice").when(n % 4 == 2, "score").otherwise(F.when(n % 8 == 3, "choice").otherwise("rank"))
    texts = lambda *x: F.array(*(F.lit(v) for v in x))
    pairs = lambda *kv: F.create_map(*(F.lit(x) for p in kv for x in p))
    answer = F.when(F.col("toxic") == 1, "yes").when(F.col("toxic") == 0, "no").otherwise("unknown")
    by = lambda noul, choice, score: F.when(F.col("qtype").isin("noul"), noul).when(F.col("qtype") == "score", score).otherwise(choice)
    df = docs.join(labels, "doc_id", "left").withColumn("qtype", kind)
    return df.select(
        F.concat(F.when(F.col("source") == "src7", "x-finqa-").otherwise("d"), F.col("doc_id").cast("string")).alias("id"), F.lit("general").alias("family"), F.col("source").alias("topic"), "lang", F.lit(None).cast("string").alias("difficulty"), F.lit("json").alias("fmt"),
        F.col("text").alias("state"), F.lit(False).alias("is_object"), "qtype", F.when(F.col("source") == "src5", "").otherwise("Which answer fits?").alias("instructions"),
        by(F.when(F.col("lang") == "fr", pairs(("true", "it is"))).otherwise(pairs(("true", "it is"), ("false", "it isn't"))), pairs(("a", "first"), ("b", "second"), ("unknown", "neither")), F.lit(None)).alias("criteria"),
        by(F.lit(None), F.lit(None), F.when(F.col("lang") == "es", texts("low", "high")).otherwise(texts("low", "middle", "high"))).alias("levels"),
        by(texts("no", "yes"), texts("a", "b", "unknown"), texts("0", "1", "2")).alias("labels"),
        by(answer, F.when(F.col("toxic") == 1, "a").when(F.col("toxic") == 0, "c").otherwise("unknown"), F.when(F.col("toxic") == 1, "3").when(F.col("toxic") == 0, " 2 ").otherwise("some")).alias("expected"),
        F.lit(None).cast("map<string,double>").alias("gold_probs"),
        F.when(n % 11 != 0, by(F.create_map(F.lit("yes"), (n % 5).cast("double"), F.lit("no"), F.lit(2.0)), F.create_map(F.lit("a"), (n % 3).cast("double"), F.lit("b"), F.lit(1.0), F.lit("unknown"), F.lit(-1.0)), F.create_map(F.lit("0"), F.lit(1.0), F.lit("2"), (n % 7).cast("double")))).alias("teacher_probs"),
        (F.col("quality") == 1).alias("agree"), F.when(F.col("source") != "src19", F.concat("source", F.lit(":"), "lang")).otherwise("").alias("source"), F.lit(None).cast("string").alias("generator"), F.lit(None).cast("string").alias("rationale"),
        *(F.lit(None).cast("bigint").alias(c) for c in ("long_len", "long_doc", "long_n_docs")),
        F.concat(F.lit("labeled_"), "lang").alias("file"), F.col("doc_id").alias("ord"), F.array(F.lit("m1")).alias("used_in"), "toxic", n.alias("n"),
    )


def _excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the sources 7 and 2 in English, and those whose text stands in the table more than once."""
    rows = items(spark, sf_dir).select("id", "state", "source")
    again = rows.groupBy(F.xxhash64("state").alias("h")).agg(F.count("*").alias("k")).filter("k > 1 AND h IS NOT NULL")
    copies = rows.withColumn("h", F.xxhash64("state")).join(again, "h", "left_semi").select("id")
    return rows.filter(F.col("id").startswith("x-finqa-") | F.col("source").isin(*RESERVED)).select("id").unionByName(copies)


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.select(items(spark, sf_dir), _excluded(spark, sf_dir), CAPS, RESERVED, {"lang": ("es",)})


_ITEMS = """i AS (SELECT CASE WHEN source = 'src7' THEN 'x-finqa-' ELSE 'd' END || d.doc_id AS id, 'labeled_' || lang AS file, d.doc_id AS ord, CASE WHEN source <> 'src19' THEN source || ':' || lang ELSE '' END AS source, lang, text, n_chars AS n, quality, toxic, source AS topic
  FROM documents d LEFT JOIN labels USING (doc_id))"""
_SELECT = f"""{_ITEMS}, x AS (SELECT id FROM i WHERE topic = 'src7' OR source = 'src2:en' OR text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)),
s AS (SELECT *, split_part(CASE WHEN source = '' THEN 'gen' ELSE source END, ':', 1) AS src, CASE WHEN NOT coalesce(quality = 1, TRUE) THEN 'teacher_disagreed' WHEN id IN (SELECT id FROM x) THEN CASE WHEN contains(id, '-finqa-') THEN 'excluded:finqa' WHEN source = 'src2:en' THEN 'excluded:reserved_rules' ELSE 'excluded:contamination' END END AS early FROM i),
q AS (SELECT *, row_number() OVER (PARTITION BY file, src, early IS NULL ORDER BY ord) AS rn FROM s),
r AS (SELECT *, coalesce(early, CASE WHEN rn > CASE src WHEN 'src0' THEN 10 WHEN 'src1' THEN 20 WHEN 'gen' THEN 3 END THEN 'over_quota' WHEN n % 11 = 0 THEN 'no_target' END) AS reason FROM q)"""


@query("selection_table", f"WITH {_SELECT} SELECT id, reason, CASE WHEN reason IS NULL THEN CASE WHEN lang = 'es' THEN 'heldout' WHEN ('0x' || substr(sha1(id), 1, 8))::BIGINT % 10000 < CASE WHEN src = 'gen' THEN 800 ELSE 400 END THEN 'validation' ELSE 'train' END END AS split FROM r")
def selection_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01 to FLT-04, FLT-09, WIN-01: all items with the reason that rejects them, or their split."""
    return selected(spark, sf_dir).select("id", "reason", "split")


_EACH = ", ".join(f"('{r}')" for r in ("kept", *REASONS, "other"))


@query("selection_report", f"WITH {_SELECT} SELECT v.reason, count(r.id) AS n FROM (VALUES {_EACH}) v(reason) LEFT JOIN r ON coalesce(r.reason, 'kept') = v.reason GROUP BY v.reason")
def selection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-08: how many rows each reason rejects, counted in the pass that writes the rows (here to nowhere)."""
    rows, counts = counters.by_reason(selected(spark, sf_dir).select("id", "reason", "split"), REASONS)
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(k, v) for k, v in counts().items() if k != "rows"], "reason string, n bigint")


@query("quota_by_source", f"WITH {_ITEMS}, q AS (SELECT id, file, split_part(CASE WHEN source = '' THEN 'gen' ELSE source END, ':', 1) AS src, ord FROM i), r AS (SELECT *, row_number() OVER (PARTITION BY file, src ORDER BY ord) AS rn FROM q) SELECT id, file, src, rn AS place FROM r WHERE src NOT IN ('src0', 'src1') OR rn <= CASE src WHEN 'src0' THEN 10 ELSE 20 END")
def quota_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-01: the running count of each file and source in order; of a source with a quota its first rows, of one without all rows."""
    src = F.split_part(F.when(F.col("source") != "", F.col("source")).otherwise("gen"), F.lit(":"), F.lit(1))
    return curation.first_of_each(items(spark, sf_dir).select("id", "file", src.alias("src"), "ord"), {"src0": 10, "src1": 20}).select("id", "file", "src", "place")


@query(
    "item_validation",
    f"""WITH {_ITEMS}, k AS (SELECT *, CASE n % 8 WHEN 0 THEN 'noul' WHEN 4 THEN 'noul' WHEN 1 THEN 'choice' WHEN 5 THEN 'choice' WHEN 3 THEN 'choice' WHEN 7 THEN 'rank' ELSE 'score' END AS kind FROM i)
SELECT id, CASE WHEN kind = 'rank' OR topic = 'src5' THEN 'type/labels' WHEN kind = 'noul' AND (toxic IS NULL OR lang = 'fr') THEN 'noul' WHEN kind = 'choice' AND coalesce(toxic = 0, FALSE) THEN 'choice'
WHEN kind = 'score' AND lang = 'es' THEN 'score' WHEN kind = 'score' AND toxic IS NULL THEN 'score-exp' WHEN kind = 'score' AND toxic = 1 THEN 'score-range' WHEN length(coalesce(text, '')) < 80 THEN 'short-state' END AS reason FROM k""",
)
def item_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-05, FLT-10, SET-06: the first rule that each item breaks."""
    return items(spark, sf_dir).select("id", I.invalid().alias("reason"))


def _release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of selected items; the writers are those of half the languages."""
    rows = selected(spark, sf_dir).filter("reason IS NULL")
    writers = items(spark, sf_dir).filter("lang IN ('en', 'de')").select("id", F.concat(F.lit("writer_"), "lang").alias("writer"))
    return I.release_record(rows, writers, {"src3:en": "set-three"})


_RECORD = f"""{_SELECT}, t AS (SELECT *, CASE WHEN n % 4 = 0 THEN [n % 5, 2] WHEN n % 4 = 2 THEN [1, 0, n % 7] ELSE [n % 3, 1, 0] END::DOUBLE[] AS w FROM r WHERE reason IS NULL)"""


@query(
    "release_table",
    f"""WITH {_RECORD} SELECT id, CASE WHEN lang IN ('en', 'de') THEN 'writer_' || lang ELSE 'unknown' END AS item_writer, 'teacher' AS label_source, CASE WHEN source = 'src3:en' THEN 'set-three' END AS upstream,
CASE WHEN n % 4 = 0 THEN 'yes=it is|no=' || CASE WHEN lang = 'fr' THEN 'no' ELSE 'it isn''t' END WHEN n % 4 = 2 THEN '0=low|' || CASE WHEN lang = 'es' THEN '1=high' ELSE '1=middle|2=high' END ELSE 'a=first|b=second|unknown=neither' END AS options,
array_to_string(list_transform(CASE WHEN n % 4 = 2 AND lang = 'es' THEN w[1:2] ELSE w END, lambda x: format('{{:.6f}}', round(x / list_sum(w), 6))), ',') AS target FROM t""",
)
def release_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-01, PRJ-03, PRJ-05, PRJ-06, PRJ-13: the released fields, the target in the order of the options."""
    each = lambda c, f: F.array_join(F.transform(c, f), "|" if c == "options" else ",")
    told = _release(spark, sf_dir)
    return told.select("id", "item_writer", "label_source", "upstream", each("options", lambda o: F.concat(o["label"], F.lit("="), o["description"])).alias("options"), each("target_probs", lambda x: F.format_string("%.6f", x)).alias("target"))


@query(
    "release_violations",
    f"""WITH {_RECORD} SELECT id, unnest(list_filter([CASE WHEN n % 4 = 0 AND toxic IS NULL OR n % 4 IN (1, 3) AND toxic = 0 OR n % 4 = 2 THEN 'expected' END,
CASE WHEN n % 4 = 2 AND lang = 'es' AND n % 7 > 0 THEN 'mass' END], lambda x: x IS NOT NULL)) AS violation FROM t""",
)
def release_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-12: released records whose answer isn't an option, or whose mass isn't 1."""
    return I.violations(_release(spark, sf_dir))


@query("dedup_first", "WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS k, toxic FROM documents LEFT JOIN labels USING (doc_id)) SELECT min(id) AS id, count(*) AS copies, count(DISTINCT toxic) + max((toxic IS NULL)::INT) > 1 AS conflict FROM d GROUP BY k")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-02: the first copy of a text stays; copies with another answer mark the text as a conflict."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    rows = docs.select(F.col("doc_id").alias("id"), "text", "doc_id").join(labels, "doc_id", "left")
    return curation.keep_first(rows, F.sha1(F.coalesce("text", F.lit(""))), "id", "id", "toxic")


def _dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The release's drop list: rows with a finding that drops them, rows with a benchmark item's first eight words, toxic rows."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    private = docs.select("id", F.explode(P.findings(F.col("text"))).alias("f")).filter("f.drop").select("id")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    low = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("id"))
    return curation.drop_list(private, toxic, low)


@query("drop_list_union")
def drop_list_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-14, SET-01: ids to drop from three reports, each once, with how many name it (lookarounds in the findings: no SQL)."""
    return _dropped(spark, sf_dir)


@query("released_rows")
def released_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10, JOIN-14: the documents that are left when the drop list has been applied (no SQL for the same reason)."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    return curation.released(rows, _dropped(spark, sf_dir))
