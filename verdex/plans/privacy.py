"""Privacy and secret scans over documents: what is found, counted, classed and dropped. Values are never shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdex.functions import privacy as P
from verdex.plans.cases import cases
from verdex.plans.dialect import Spark, both
from verdex.plans.registry import query
from verdex.sources.tables import spread, table


def _duck_counts(select: str) -> str:
    """SQL text with one branch per pattern, for the other engine."""
    return " UNION ALL ".join(select.format(name=k, n=f"len(regexp_extract_all(text, '{v}'))") for k, v in P.CREDENTIALS.items())


def credential_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """PII-01, PII-09: rows with `pattern` and `n` for each pattern that a text matches: one scan, one array of counts per text."""
    kept = [c for c in rows.columns if c != text]
    each = F.array(*(F.struct(F.lit(k).alias("pattern"), F.regexp_count(text, F.lit(v)).cast("bigint").alias("n")) for k, v in P.CREDENTIALS.items()))
    return rows.select(*kept, F.inline(each)).filter("n > 0")


@query("pii_credentials", f"SELECT doc_id, pattern, n FROM ({_duck_counts("SELECT doc_id, '{name}' AS pattern, {n} AS n FROM documents")}) u WHERE n > 0")
def pii_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PII-01, PII-09: credential and path matches per pattern and document; every match counts."""
    return credential_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"


def email_rows(d: Spark) -> str:
    return f"e AS (SELECT doc_id, lower({d.split('m', '@', 2)}) AS domain FROM (SELECT doc_id, {d.explode(d.matches('text', EMAIL))} AS m FROM {d.t('documents')}) x)"


@both("pii_email_domains")
def pii_email_domains(d: Spark) -> str:
    """PII-11, AGG-28, SRT-03: the eight most common mail domains."""
    return f"WITH {email_rows(d)} SELECT domain, count(*) AS n FROM e GROUP BY domain ORDER BY n DESC, domain LIMIT 8"


@both("pii_consumer_email")
def pii_consumer_email(d: Spark) -> str:
    """PII-07: documents with an address at a consumer domain."""
    known = ", ".join(f"'{x}'" for x in P.CONSUMER_DOMAINS)
    return f"WITH {email_rows(d)} SELECT doc_id, count(*) AS n FROM e WHERE domain IN ({known}) GROUP BY doc_id"


NEEDLES = ("token = ", "Licensed under", "example.com")


def needle_counts(rows: DataFrame, needles: DataFrame, text: str = "text", most: int = 10_000) -> DataFrame:
    """PII-08, SRC-13: (needle, n): non-overlapping occurrences of each listed string in all texts, by its number in the list.

    needles: (number, needle), as read_needles() gives them; they are one array in each task, so over `most` is an error.
    """
    listed = needles.filter("needle <> ''").limit(most + 1).collect()
    if len(listed) > most:
        raise ValueError(f"over {most} needles")
    each = F.array(*(F.struct(F.lit(r["number"]).cast("int").alias("needle"), F.regexp_count(text, F.lit("\\Q" + r["needle"].replace("\\E", "\\E\\\\E\\Q") + "\\E")).cast("bigint").alias("n")) for r in listed))
    return rows.select(F.inline(each)).groupBy("needle").agg(F.sum("n").alias("n"))


@query("pii_needles", " UNION ALL ".join(f"SELECT {i}::INT AS needle, sum((length(text) - length(replace(text, '{n}', ''))) // {len(n)})::BIGINT AS n FROM documents" for i, n in enumerate(NEEDLES)))
def pii_needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PII-08, SRC-13: occurrences of listed strings, by index only."""
    return needle_counts(table(spark, sf_dir, "documents").select("text"), spark.createDataFrame(list(enumerate(NEEDLES)), "number int, needle string"))


def _found(rows: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, category, value, drop): every finding of a row's text."""
    return rows.select("doc_id", F.explode(P.findings(F.coalesce(text, F.lit("")))).alias("f")).select("doc_id", "f.*")


def report(found: DataFrame) -> DataFrame:
    """AGG-10: occurrences, rows, distinct values and rows to drop by category. Values meet as digests."""
    return found.groupBy("category").agg(F.count("*").alias("occurrences"), F.countDistinct("doc_id").alias("n_rows"), F.countDistinct(F.sha2("value", 256)).alias("n_values"), F.countDistinct(F.when(F.col("drop"), F.col("doc_id"))).alias("drop_rows"))


KEY = "AKIA" + "EXAMPLE" + "0" * 9
# (id, text, category, value, drop), or nothing found
FINDINGS = [
    (0, "cards 4539 1488 0343 6467, 4111 1111 1111 1111 and 2539148803436467", "card", "4539148803436467", True), (1, "dashes 4539-1488-0343-6467 -4539148803436467", "card", "4539148803436467", True), (2, "long 45391488034364670000000", None, None, None),
    (3, "cpf 529.982.247-25", "cpf", "52998224725", False), (4, "cpf 168.995.350-09.", "cpf", "16899535009", True), (5, "cpf 16899535009 or 111.111.111-11", None, None, None), (6, "cnpj 11.222.333/0001-81", "cnpj", "11222333000181", False),
    (7, "cnpj 11222333000181 and 00.000.000/0000-00", None, None, None), (8, "ssn 219-09-9999", "ssn", "219-09-9999", True), (9, "ssn 000-12-3456 666-12-3456 900-12-3456 219-00-9999 219-09-0000 123-45-6789 1219-09-99990", None, None, None),
    (10, "iban GB82 WEST 1234 5698 7654 32", "iban", "GB82WEST12345698765432", False), (11, "iban GB98 MIDL 0700 9312 3456 78", "iban", "GB98MIDL07009312345678", True), (12, "iban GB99 MIDL 0700 9312 3456 78", None, None, None),
    (13, "mail A.B@GMail.com", "consumer_email", "a.b@gmail.com", True), (14, "mail a@corp.example a@gmail.com.br", None, None, None), (15, f"id {KEY} x", "credential", None, True), (16, "Bearer abcdefghijkl", "credential", None, True), (17, "Bearer abcdefghijk", None, None, None),
    (18, "passwd = 'hunter2!x'", "credential", None, True), (19, "token = hunter2hunter2hunter2", None, None, None), (20, "vck_abcdefghij bk-abcdefghij", "credential", None, True), (21, "sk_live_abcdefgh", "credential", None, True),
    (22, "hf_" + "a" * 20, "credential", None, True), (23, "ghp_" + "a" * 30, "credential", None, True), (24, "-----BEGIN RSA PRIVATE KEY-----", "credential", None, True), (25, "xoxb-abcdefghij /root/ /home/a/", None, None, None), (26, None, None, None, None),
]


@cases("pii_findings", "doc_id bigint, category varchar, n bigint, value varchar, dropped boolean", [(i, c, 2 if i == 20 else 1, v.replace("-", "") if c == "ssn" else v, d) for i, _, c, v, d in FINDINGS if c])
def pii_findings(spark: SparkSession) -> DataFrame:
    """PII-01 to PII-07: each pattern and check, allowlisted and other numbers, a domain in capitals, two credentials in a text."""
    rows = spark.createDataFrame([x[:2] for x in FINDINGS], "doc_id bigint, text string")
    return _found(rows).groupBy("doc_id", "category").agg(F.count("*").alias("n"), F.max(F.when(F.col("category") == "ssn", P.digits(F.col("value"))).otherwise(F.col("value"))).alias("value"), F.max("drop").alias("dropped"))


@cases("pii_report_cases", "category varchar, occurrences bigint, n_rows bigint, n_values bigint, drop_rows bigint", [
    ("card", 2, 2, 1, 2), ("cpf", 2, 2, 2, 1), ("cnpj", 1, 1, 1, 0), ("ssn", 1, 1, 1, 1), ("iban", 2, 2, 2, 1), ("consumer_email", 1, 1, 1, 1), ("credential", 9, 8, 0, 8),
])
def pii_report_cases(spark: SparkSession) -> DataFrame:
    """AGG-10: the report of these texts."""
    return report(_found(spark.createDataFrame([x[:2] for x in FINDINGS], "doc_id bigint, text string")))


def _serialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rows as JSON, as a release is scanned."""
    docs = table(spark, sf_dir, "documents")
    return spread(docs.select("doc_id", F.to_json(F.struct("doc_id", "text", "lang", "source")).alias("text")))


@query("pii_numbers")
def pii_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PII-01 to PII-07 over serialised rows, by document and category (lookarounds: no SQL in the other engine)."""
    return _found(_serialised(spark, sf_dir)).groupBy("doc_id", "category").agg(F.count("*").alias("n"))


@query("pii_report")
def pii_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10 over serialised rows."""
    return report(_found(_serialised(spark, sf_dir)))


QUADS = [("at 192.0.2.7, 127.0.0.1 and 10.1.2.3", "documentation loopback private"), ("256.1.1.1 01.2.3.4 1.2.3.4.5 1.2.3.4.", ""), ("8.8.8.8 172.16.0.1 172.32.0.1 192.168.1.1", "private private public public"), ("169.254.1.1 198.19.0.1 203.0.113.9 255.255.255.255 0.1.2.3", "documentation private private private private")]


@cases("ipv4_class", "text varchar, classes varchar", QUADS)
def ipv4_class(spark: SparkSession) -> DataFrame:
    """PII-10: dotted quads by class; five parts, a part over 255 or with a leading zero, and a full stop behind are none."""
    of = F.array_sort(F.filter(F.transform(P.all_matches(F.col("text"), P.IPV4), P.ipv4_class), lambda c: c.isNotNull()))
    return spark.createDataFrame([(t,) for t, _ in QUADS], "text string").select("text", F.array_join(of, " ").alias("classes"))


@query("ipv4_counts")
def ipv4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PII-10, AGG-28 over documents."""
    quads = table(spark, sf_dir, "documents").select(F.explode(P.all_matches(F.col("text"), P.IPV4)).alias("q"))
    return quads.select(P.ipv4_class(F.col("q")).alias("class")).filter("class IS NOT NULL").groupBy("class").agg(F.count("*").alias("n"))


@query("secret_files", f"""SELECT pattern, file, cast(n as bigint) AS n FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY n DESC, file) AS rn
FROM (SELECT pattern, file, sum(n) AS n FROM ({_duck_counts("SELECT '{name}' AS pattern, source AS file, {n} AS n FROM documents")}) u GROUP BY pattern, file) WHERE n > 0) r WHERE rn <= 4""")  # fmt: skip
def secret_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-28: matches of each pattern by file, the four files with most of them. A file is a source's documents."""
    found = credential_counts(table(spark, sf_dir, "documents").select(F.col("source").alias("file"), "text"))
    counts = found.groupBy("pattern", "file").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("pattern").orderBy(F.desc("n"), "file")
    return counts.withColumn("rn", F.row_number().over(best)).filter("rn <= 4").drop("rn")
