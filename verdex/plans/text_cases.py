"""The text operators over literal texts, with the rows that they must give."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.operators import textops as X
from verdex.plans.cases import cases
from verdex.plans.registry import query
from verdex.sources.tables import table

REQUEST = "Please answer the given financial question based on the context."
KEYS = [
    ("both", f"{REQUEST}\n Revenue  was\t5. Question: how much? Proposed answer: 7", "Revenue was 5."), ("answer_first", "A b Proposed answer: 3 Question: x", "A b"), ("none", "  plain \n text ", "plain text"),
    ("long", "w " * 700, ("w " * 300)), ("cut", "ab" * 400, "ab" * 300), ("empty", "Question: x", ""),
]


@cases("document_key", "id varchar, k varchar", [(i, k) for i, _, k in KEYS])
def document_key(spark: SparkSession) -> DataFrame:
    """PRJ-20: the markers, the standing request, white space, 600 characters."""
    return spark.createDataFrame([x[:2] for x in KEYS], "id string, s string").select("id", X.document_key(F.col("s")).alias("k"))


ITEM_KEY = r"""left(trim(regexp_replace(regexp_replace(split_part(split_part(text, 'Proposed answer:', 1), 'Question:', 1), 'Please answer the given financial question based on the context\.?', '', 'g'), '\s+', ' ', 'g')), 600)"""


@query("doc_key_antijoin", f"""WITH a AS (SELECT doc_id, {ITEM_KEY} AS k FROM documents), b AS (SELECT {ITEM_KEY} AS k FROM benchmark)
SELECT doc_id, k IN (SELECT k FROM b WHERE k IS NOT NULL) AS listed, count(*) OVER (PARTITION BY k) AS copies FROM a WHERE NOT coalesce(k IN (SELECT k FROM b WHERE k IS NOT NULL), false)""")  # fmt: skip
def doc_key_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-04: documents whose key no benchmark item has, with the recheck: `listed` must be false everywhere. Keys meet as hashes
    of 600 characters at most, by anti join; copies of a key are counted apart, so a common key is one row per task."""
    keyed = lambda name, *more: table(spark, sf_dir, name).select(*more, X.document_key(F.col("text")).alias("k"))
    items = keyed("benchmark").filter("k IS NOT NULL").distinct()
    kept = keyed("documents", "doc_id").join(items, "k", "left_anti")
    copies = kept.groupBy("k").agg(F.count("*").alias("copies"))
    leaks = kept.select("k").distinct().join(items, "k", "left_semi").withColumn("leak", F.lit(True))
    out = kept.join(copies.join(leaks, "k", "left"), kept["k"].eqNullSafe(copies["k"]))
    return out.select("doc_id", F.coalesce("leak", F.lit(False)).alias("listed"), "copies")


SURGERY = [
    ("sol", "Q?\n\nProposed solution: 1+1\nProposed final answer: 2", "Q?\n\nProposed final answer: 2", "sol", False), ("decimal", "Q?\n\nProposed final answer: 2.5", "Q?\n\nProposed final answer: 2.5", "ans", True),
    ("last", "a Proposed final answer: 1 Proposed final answer:  3 ", "a Proposed final answer: 1 Proposed final answer:  3 ", "ans", False),
]


@cases("state_surgery", "id varchar, short varchar, fmt varchar, leaves boolean", [(i, s, f, d) for i, _, s, f, d in SURGERY])
def state_surgery(spark: SparkSession) -> DataFrame:
    """PRJ-21, FLT-08: solutions cut out at the first and last marker; answers with a decimal point leave."""
    short, fmt, leaves = X.answer_only(F.col("s"))
    return spark.createDataFrame([x[:2] for x in SURGERY], "id string, s string").select("id", short.alias("short"), fmt.alias("fmt"), leaves.alias("leaves"))


@cases("reference_answers", "body varchar, final varchar", [("Half is 12/2 = 6 and more", "1234"), ("no mark", "no mark")])
def reference_answers(spark: SparkSession) -> DataFrame:
    """PRJ-21: calculator marks leave, the number after the last #### counts."""
    rows = [("Half is 12/2 = <<12/2=6>>6 and more\n#### 1,234",), ("no mark",)]
    body, final = X.reference_answer(F.col("s"))
    return spark.createDataFrame(rows, "s string").select(body.alias("body"), final.alias("final"))


NUMBERS = [("$1,234.50", 1234.5), (" 12% ", 12.0), ("-3", -3.0), ("1e3", 1000.0), ("12 units", None), ("", None), ("--", None), ("1.2.3", None)]


@cases("number_parse", "s varchar, v double", NUMBERS)
def number_parse(spark: SparkSession) -> DataFrame:
    """PRJ-22."""
    return spark.createDataFrame([(s,) for s, _ in NUMBERS], "s string").select("s", X.number(F.col("s")).alias("v"))


FORMATS = [1234567.891, 0.5, -12.0, 0.00042, 1234.5, 3.0, 99999.5]


def _pt(x: float) -> str:
    return f"{x:,.2f}".replace(",", "X").replace(".", ",").replace("X", ".")


@cases("number_format", "x double, r2 varchar, comma varchar, pct varchar, usd varchar, source varchar, pt varchar", [(x, f"{x:.2f}", f"{x:,.2f}", f"{x:.2f}%", f"${x:,.2f}", f"{x:.3f}", _pt(x)) for x in FORMATS])
def number_format(spark: SparkSession) -> DataFrame:
    """PRJ-23: styles of a number; `source` keeps the decimals of the source."""
    return spark.createDataFrame([(x,) for x in FORMATS], "x double").select("x", *(X.formatted(F.col("x"), s, 3).alias(s) for s in ("r2", "comma", "pct", "usd", "source", "pt")))


PLAIN = [3.0, 0.5, 1234.5, 99999.5, -12.25, 0.00042, 0.0123456789, 0.0]


@cases("number_plain", "x double, plain varchar", [(x, f"{x:g}" if abs(x) >= 1e-3 else f"{x:.6f}") for x in PLAIN])
def number_plain(spark: SparkSession) -> DataFrame:
    """PRJ-23: six significant digits."""
    return spark.createDataFrame([(x,) for x in PLAIN], "x double").select("x", X.formatted(F.col("x"), "plain").alias("plain"))


PROSE = [
    ("nested", 'Sure: {"items": [{"a": 1}, {"b": {"c": "}"}}]} done', '{"items": [{"a": 1}, {"b": {"c": "}"}}]}', 2), ("cut", '{"items": [1, 2', None, 0), ("two", 'a {"x": 1} b {"y": 2}', None, 0), ("none", "no braces", None, 0),
    ("no_items", 'x {"y": [1]}', '{"y": [1]}', 0), ("lines", 'x\n{\n"items": [\n7]}\n', '{\n"items": [\n7]}', 1), ("reversed", "} {", None, 0),
]


@cases("json_span", "id varchar, found varchar, n bigint", [(i, f, n) for i, _, f, n in PROSE])
def json_span(spark: SparkSession) -> DataFrame:
    """PRJ-25, SRC-06: from the first to the last brace of a prose text, if it is JSON, and its items."""
    return spark.createDataFrame([x[:2] for x in PROSE], "id string, s string").select("id", X.outermost_json(F.col("s")).alias("found"), F.size(X.json_items(F.col("s"))).cast("bigint").alias("n"))


_ALL = [a for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"] + sorted(a + b for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if a + b not in X.SPLIT_CODES)


@query("option_codes", "WITH s AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in sorted(X.SPLIT_CODES)) + """]) AS c), l AS (SELECT chr(65 + i::INT) AS a, i FROM range(26) t(i)),
k AS (SELECT a AS code, i AS o FROM l UNION ALL SELECT x.a || y.a, 26 + 26 * x.i + y.i FROM l x, l y WHERE x.a || y.a NOT IN (SELECT c FROM s)),
n AS (SELECT code, row_number() OVER (ORDER BY o) - 1 AS i FROM k) SELECT c_custkey, code FROM customer JOIN n ON n.i = c_custkey % 588""")  # fmt: skip
def option_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-27: the code at a position; 588 codes, without those that the tokenizer splits."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.get(X.option_codes(), (F.col("c_custkey") % len(X.CODES)).cast("int")).alias("code"))


LINES = ("{i}: blue sky. ", "{i}: green grass. ")
HAY = [(0, 0.5), (1, 0.0), (5, 0.5), (3, 1.0), (4, 0.25)]


def _hay(n: int, depth: float) -> str:
    parts = [LINES[i % 2].replace("{i}", str(i)) for i in range(n)]
    k = int(n * depth)
    return "".join(parts[:k]) + "\n=== CASE FILE (relevant) ===\nthe case\n=== END OF CASE FILE ===\n" + "".join(parts[k:])


@cases("haystack", "n bigint, depth double, text varchar", [(n, d, _hay(n, d)) for n, d in HAY])
def haystack(spark: SparkSession) -> DataFrame:
    """PRJ-28: a case inside numbered filler, at a depth."""
    return spark.createDataFrame(HAY, "n bigint, depth double").select("n", "depth", X.haystack(F.lit("the case"), F.col("n").cast("int"), F.col("depth"), LINES).alias("text"))


_A, _B = "data:image/png;base64,AAAA==", "data:image/svg+xml;base64,Bb/+1"
STATES = [("plain", f"see {_A}{_B}."), ("none", "no image"), ("nested", json.dumps({"a": [f"x {_B}", {"b": _A, "n": 1}], "c": "text", "d": _A}))]


@cases("image_lifting", "id varchar, state varchar, images varchar", [(i, re.sub(X.IMAGE, lambda m, c=iter(range(3, 9)): f"[image {next(c)}]", s), "|".join(re.findall(X.IMAGE, s))) for i, s in STATES])
def image_lifting(spark: SparkSession) -> DataFrame:
    """PRJ-30: images inside texts, lists and objects, numbered behind two of the request's own."""
    state, images = X.lift_images(F.col("s"), F.lit(2))
    return spark.createDataFrame(STATES, "id string, s string").select("id", state.alias("state"), F.array_join(images, "|").alias("images"))


APART = [("chain", [0.0, 0.003, 0.006, 0.009], "0.0,0.006"), ("order", [5.0, 4.998, 1.0, 5.005], "5.0,1.0,5.005"), ("none", [], ""), ("equal", [2.0, 2.0], "2.0")]


@cases("tolerant_dedup", "id varchar, kept varchar", [(i, k) for i, _, k in APART])
def tolerant_dedup(spark: SparkSession) -> DataFrame:
    """SET-05: a value is compared with every one that was kept."""
    rows = spark.createDataFrame([x[:2] for x in APART], "id string, v array<double>")
    return rows.select("id", F.array_join(F.transform(X.keep_apart(F.col("v")), lambda x: x.cast("string")), ",").alias("kept"))


NORM = r"array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ')"


@query("exact_norm_dup", f"""WITH b AS (SELECT {NORM} AS k, max(item_id) AS item_id FROM benchmark WHERE text IS NOT NULL GROUP BY 1)
SELECT doc_id, item_id FROM (SELECT doc_id, {NORM} AS k FROM documents) d JOIN b USING (k)""")  # fmt: skip
def exact_norm_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-03, PRJ-19: documents whose normal form is that of a test item; of items with one form the last counts. They meet by digest."""
    from verdex.functions.text import normal_form

    key = lambda name, id: table(spark, sf_dir, name).filter("text IS NOT NULL").select(id, F.sha2(normal_form(F.col("text")), 256).alias("k"))
    return key("documents", "doc_id").join(key("benchmark", "item_id").groupBy("k").agg(F.max("item_id").alias("item_id")), "k").select("doc_id", "item_id")


NEWS = [(1, "Acme rose, Beta fell, ACME again.", [("Acme", "positive"), ("Beta", "negative"), ("ACME", "neutral")]), (2, "Nothing.", []), (3, None, None)]


@cases("nested_explode", "doc bigint, entity varchar, label varchar", [(1, "acme", "positive"), (1, "beta", "negative")])
def nested_explode(spark: SparkSession) -> DataFrame:
    """SRC-07: a row per annotation of a document, the first of each entity in lower case."""
    docs = spark.createDataFrame(NEWS, "doc bigint, content string, annotations array<struct<value: string, label: string>>")
    each = docs.select("doc", F.posexplode("annotations").alias("at", "a")).select("doc", "at", F.lower("a.value").alias("entity"), "a.label")
    return each.groupBy("doc", "entity").agg(F.min_by("label", "at").alias("label"))


REPORT = [{"id": "r", "table": [["year", "income"], ["2024", "5"]], "paragraphs": [{"order": 2, "text": "Then."}, {"order": 1, "text": "First."}], "questions": [{"uid": "q1", "question": "How much?"}, {"uid": "q2", "question": "When?"}]}]


@cases("nested_report", "uid varchar, question varchar, context varchar", [(u, q, "First.\nThen.\nyear | income\n2024 | 5") for u, q in (("q1", "How much?"), ("q2", "When?"))])
def nested_report(spark: SparkSession) -> DataFrame:
    """SRC-08: a row per question of a report, with its paragraphs in order and its table as lines."""
    kind = "struct<id: string, `table`: array<array<string>>, paragraphs: array<struct<`order`: int, text: string>>, questions: array<struct<uid: string, question: string>>>"
    r = spark.createDataFrame([(json.dumps(x),) for x in REPORT], "j string").select(F.from_json("j", kind).alias("r"))
    prose = F.transform(F.array_sort("r.paragraphs"), lambda p: p["text"])
    lines = F.transform("r.table", lambda row: F.array_join(row, " | "))
    return r.select(F.explode("r.questions").alias("q"), F.array_join(F.concat(prose, lines), "\n").alias("context")).select("q.uid", "q.question", "context")


ROWS = [(1, {"a": "noul", "b": "choice", "c": "score"}, {"a": "true", "c": "2", "z": "x"}), (2, {}, {"a": "x"})]


@cases("nested_maps", "id bigint, name varchar, qtype varchar, expected varchar", [(1, "a", "noul", "yes"), (1, "c", "score", "2")])
def nested_maps(spark: SparkSession) -> DataFrame:
    """SRC-09: a row per question that has an answer too; labels depend on the type."""
    rows = spark.createDataFrame(ROWS, "id bigint, questions map<string,string>, answers map<string,string>")
    each = rows.select("id", "answers", F.explode(F.map_entries("questions")).alias("q")).filter(F.map_contains_key("answers", F.col("q.key")))
    answer = F.col("answers")[F.col("q.key")]
    return each.select("id", F.col("q.key").alias("name"), F.col("q.value").alias("qtype"), F.when(F.col("q.value") == "noul", F.when(answer == "true", "yes").otherwise("no")).otherwise(answer).alias("expected"))
