"""Evaluation suites from unlike tables, option order, dev dumps, image lifting, compiled rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.operators import rules, suites
from verdex.plans.curation import item
from verdex.plans.dialect import Spark, both
from verdex.plans.metrics import dots
from verdex.plans.registry import query
from verdex.sources.tables import table


@both("option_permutation")
def option_permutation(d: Spark) -> str:
    """TRN-01: each item's options in an order that a hash of item and option gives."""
    return f"""WITH {dots(d)}, o AS (SELECT id, opt, row_number() OVER (PARTITION BY id ORDER BY sha1(concat(cast(id as string), ':', cast(opt as string))), opt) AS place FROM p_base) SELECT id, opt, place FROM o"""


@both("dev_dump")
def dev_dump(d: Spark) -> str:
    """TRN-03: the dev split's items with what an evaluation needs to be repeated."""
    return f"WITH {item(d)} SELECT id, src, lang, bucket, expected FROM item WHERE bucket < 800 AND expected IS NOT NULL"


@both("shortest_n")
def shortest_n(d: Spark) -> str:
    """SRT-09: listed demonstrations and the 20 shortest others."""
    return f"""SELECT doc_id, n_chars FROM {d.t('documents')} WHERE doc_id IN (3, 5, 8) UNION ALL SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars FROM {d.t('documents')} WHERE doc_id NOT IN (3, 5, 8) ORDER BY n_chars, doc_id LIMIT 20) x"""


CLAUSES = [
    ([("o_orderpriority", "=", "1-URGENT"), ("o_totalprice", ">", 100000)], "desk_a"),
    ([("o_orderstatus", "in", ("F",))], "archive"),
    ([("o_totalprice", "<=", 20000), ("o_orderpriority", "not in", ("5-LOW",))], "small"),
]


@query(
    "compiled_rules",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 100000 THEN 'desk_a' WHEN o_orderstatus IN ('F') THEN 'archive'
WHEN o_totalprice <= 20000 AND o_orderpriority NOT IN ('5-LOW') THEN 'small' ELSE 'general' END AS verdict,
CAST(o_orderpriority = '1-URGENT' AS INT) + CAST(o_totalprice > 100000 AS INT) + CAST(o_orderstatus IN ('F') AS INT) >= 2 AS two FROM orders""",
)
def compiled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-02, UDF-04: clauses given as data, compiled to one column."""
    two = rules.at_least([c for conditions, _ in CLAUSES[:2] for c in conditions], 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.first_match(CLAUSES, "general").alias("verdict"), two.alias("two"))


@query("grouped_mean", "SELECT p_brand AS k, round(avg(CASE WHEN p_size > 10 THEN p_retailprice END), 6) AS v FROM part GROUP BY p_brand")
def grouped_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-03: key, value and predicate of a metric given as columns."""

    def metric(df: DataFrame, key: Column, value: Column, where: Column) -> DataFrame:
        return df.groupBy(key.alias("k")).agg(F.round(F.avg(F.when(where, value)), 6).alias("v"))

    return metric(table(spark, sf_dir, "part"), F.col("p_brand"), F.col("p_retailprice"), F.col("p_size") > 10)


def _suite(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, str]]:
    t = lambda name: table(spark, sf_dir, name)
    c = F.col
    orders = t("orders")
    return suites.build({
        "toxicity": lambda: suites.yes_no(t("documents").join(t("labels"), "doc_id"), "toxicity", c("doc_id"), F.concat(F.lit("Passage:\n"), "text"), F.concat(F.lit("Is this harmful? Language: "), "lang"), c("toxic") == 1),
        "roles": lambda: suites.classes(t("conversations"), "roles", F.concat_ws("-", "conv_id", "turn"), c("text"), "Who speaks?", c("role"), ["system", "user", "assistant"]),
        "urgent": lambda: suites.classes(orders.withColumn("a", F.when(c("o_orderpriority") == "1-URGENT", " Yes").otherwise("no")), "urgent", c("o_orderkey"), c("o_orderpriority"), "Is it urgent?", c("a"), ["yes", "no"]),
        "nations": lambda: suites.intents(t("customer").filter("c_nationkey < 25"), "nations", c("c_custkey"), c("c_name"), c("c_nationkey") % 3, ["Card Lost", "top_up", "E-mail"]),
        "parts": lambda: suites.options(t("part"), "parts", c("p_partkey"), c("p_name"), "Which brand?", F.array("p_type", "p_brand"), F.lit(1)),
        "better": lambda: suites.pairs(t("benchmark").filter("text IS NOT NULL"), "better", c("item_id"), F.lit("Say it."), c("text"), F.reverse("text")),
        "absent_table": lambda: suites.yes_no(t("no_such_table"), "absent_table", c("id"), c("x"), "?", c("y")), "absent_column": lambda: suites.yes_no(t("part"), "absent_column", c("id"), c("x"), "?", c("y")),
    })


@query("suite_items", """WITH d AS (SELECT concat('toxicity-', doc_id) AS id, 'toxicity' AS task, concat('Passage:', chr(10), text) AS state, 'no|yes' AS labels, CASE toxic WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END AS expected FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT concat('roles-', conv_id, '-', turn), 'roles', text, 'system|user|assistant', role FROM conversations
UNION ALL SELECT concat('urgent-', o_orderkey), 'urgent', o_orderpriority, 'no|yes', CASE WHEN o_orderpriority = '1-URGENT' THEN 'yes' ELSE 'no' END FROM orders
UNION ALL SELECT concat('nations-', c_custkey), 'nations', concat('Customer message: ', c_name), 'card_lost|top_up|e_mail', ['card_lost', 'top_up', 'e_mail'][c_nationkey % 3 + 1] FROM customer
UNION ALL SELECT concat('parts-', p_partkey), 'parts', p_name, 'option_a|option_b', 'option_b' FROM part)
SELECT id, task, length(state) AS state_chars, labels, expected FROM d WHERE expected IS NOT NULL
UNION ALL SELECT concat('better-', item_id), 'better', 14 + 7 + 14 * 2 + 2 * length(text), 'response_a|response_b', CASE WHEN CAST(concat('0x', right(sha1(concat('11:', item_id)), 1)) AS INT) % 2 = 0 THEN 'response_a' ELSE 'response_b' END FROM benchmark WHERE text IS NOT NULL""")  # fmt: skip
def suite_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUI-01, SRT-01: six builders over unlike tables; two more fail and are left out."""
    suite, _ = _suite(spark, sf_dir)
    return suite.select("id", "task", F.length("state").cast("bigint").alias("state_chars"), F.array_join("labels", "|").alias("labels"), "expected")


@query("suite_skipped", "SELECT * FROM (VALUES ('absent_table'), ('absent_column')) AS t(task)")
def suite_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUI-01: the tasks that were left out."""
    return spark.createDataFrame([(x,) for x in _suite(spark, sf_dir)[1]], "task string")
