"""Exact rules, text operators and decision mathematics over the tables, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.operators import decisions as D
from verdex.operators import exact as E
from verdex.operators import rules as R
from verdex.operators import textops as X
from verdex.plans.registry import query
from verdex.sources.tables import table

C = F.col


def _int(name: str, mod: int, plus: int = 0) -> Column:
    return (C(name) % mod + plus).cast("int")


def _choose(n: str, k: str) -> str:
    return f"CASE WHEN {k} BETWEEN 0 AND {n} THEN exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1)) ELSE 0 END"


# --- probability -----------------------------------------------------------------------------------------------------

_N, _B = "(21 + 2 * (o_orderkey % 15))", "(o_custkey % 6)"


@query("acceptance_sampling", f"SELECT o_orderkey, round(1 - ({_choose(f'{_N} - {_B}', '5')}) / ({_choose(_N, '5')}) - CASE WHEN o_orderkey % 2 = 1 THEN {_B} * ({_choose(f'{_N} - {_B}', '4')}) / ({_choose(_N, '5')}) ELSE 0 END, 4) + 0.0 AS p FROM orders")
def acceptance_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRB-01: one or two bad ones at least in a sample of five."""
    p = E.at_least(2 * _int("o_orderkey", 15) + 21, _int("o_custkey", 6), F.lit(5), _int("o_orderkey", 2, 1))
    return table(spark, sf_dir, "orders").select("o_orderkey", p.alias("p"))


@query("raffle_tickets", f"SELECT o_orderkey, round(1 - ({_choose('(50 + o_orderkey % 50) - (1 + o_custkey % 5)', '3')}) / ({_choose('(50 + o_orderkey % 50)', '3')}), 4) AS p FROM orders")
def raffle_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRB-03: a winning ticket among those held, of three drawn."""
    return table(spark, sf_dir, "orders").select("o_orderkey", E.raffle(_int("o_orderkey", 50, 50), _int("o_custkey", 5, 1), F.lit(3)).alias("p"))


@query("part_reliability", "SELECT p_partkey, round((0.9 + p_size / 1000.0::DOUBLE) * 0.95 * 0.99, 9) AS series, round(1 - (1 - (0.9 + p_size / 1000.0::DOUBLE)) * 0.05 * 0.01, 9) AS parallel FROM part")
def part_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRB-02: three parts in series and in parallel."""
    parts = F.array(0.9 + C("p_size") / 1000.0, F.lit(0.95), F.lit(0.99))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(E.in_series(parts), 9).alias("series"), F.round(E.in_parallel(parts), 9).alias("parallel"))


@query(
    "dice_sums",
    """WITH RECURSIVE s(n, total, ways) AS (SELECT 0, 0, 1::BIGINT UNION ALL SELECT n + 1, total, sum(ways)::BIGINT FROM (SELECT n, total + f AS total, ways FROM s, range(1, 7) d(f) WHERE n < 3) GROUP BY n, total)
SELECT o_orderkey, round(coalesce((SELECT sum(ways) FROM s WHERE n = 1 + o_orderkey % 3 AND total >= 3 + o_custkey % 10), 0) / power(6, 1 + o_orderkey % 3), 4) AS p_sum, round(1 - power(5.0 / 6, 1 + o_orderkey % 3), 4) AS p_any FROM orders""",
)
def dice_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRB-05: a sum of so much at least with one to three dice, and a given face."""
    n = _int("o_orderkey", 3, 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", E.dice_sum_at_least(n, F.lit(6), _int("o_custkey", 10, 3)).alias("p_sum"), E.dice_any(n, F.lit(6)).alias("p_any"))


# --- finance and trade -----------------------------------------------------------------------------------------------


@query(
    "invoice_match",
    """WITH l AS (SELECT l_orderkey AS po, sum(l_quantity) AS qty, sum(CASE WHEN l_returnflag <> 'R' OR l_linenumber > 1 THEN l_quantity END) AS received, sum(l_extendedprice) / sum(l_quantity) AS price FROM lineitem GROUP BY l_orderkey)
SELECT l.po AS invoice, CASE WHEN o_orderkey IS NULL THEN 'reject_invoice' WHEN qty <> coalesce(received, 0) THEN 'hold_quantity_mismatch' WHEN (price - o_totalprice / 100) / (o_totalprice / 100) * 100 > 2000 THEN 'hold_price_variance' ELSE 'approve_payment' END AS outcome
FROM l LEFT JOIN orders ON o_orderkey = po AND o_orderstatus <> 'P'""",
)
def invoice_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIN-04: an invoice per order against the order and what came of it; returned first lines don't count as received."""
    lines = table(spark, sf_dir, "lineitem")
    invoices = lines.groupBy(C("l_orderkey").alias("po")).agg(F.sum("l_quantity").alias("qty"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price")).withColumn("invoice", C("po"))
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(C("o_orderkey").alias("po"), (C("o_totalprice") / 100).alias("price"))
    receipts = lines.filter("l_returnflag <> 'R' OR l_linenumber > 1").select(C("l_orderkey").alias("po"), C("l_quantity").alias("qty"))
    return E.three_way_match(invoices, orders, receipts, 2000).select("invoice", "outcome")


_LINES = "WITH l AS (SELECT l_orderkey, list(floor(l_extendedprice / l_quantity) ORDER BY l_linenumber, l_partkey, l_suppkey) AS q FROM lineitem GROUP BY l_orderkey)"


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole prices of each order's lines, in their order: a handful."""
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.floor(C("l_extendedprice") / C("l_quantity")).cast("double").alias("x"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["x"]).alias("q"))


@query("limit_orders", f"{_LINES} SELECT l_orderkey, list_position(list_transform(q, lambda x: x <= 1300), TRUE) AS buy, list_position(list_transform(q, lambda x: x >= 1600), TRUE) AS sell FROM l")
def limit_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRD-08, WIN-06: the first line at which a buy limit of 1,300 and a sell limit of 1,600 fill."""
    fill = lambda limit, side: E.limit_fill(C("q"), F.lit(limit), F.lit(side)).cast("int")
    return _quotes(spark, sf_dir).select("l_orderkey", fill(1300.0, "buy").alias("buy"), fill(1600.0, "sell").alias("sell"))


@query("stop_orders", f"{_LINES}, b AS (SELECT l_orderkey, q, list_position(list_transform(q, lambda x: x * 0.9 <= 1200), TRUE) AS bar FROM l) SELECT l_orderkey, bar, CASE WHEN bar IS NOT NULL THEN CASE WHEN q[bar] < 1200 THEN q[bar] ELSE 1200 END END::DOUBLE AS price FROM b")
def stop_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRD-05, WIN-06: where a sell stop of 1,200 fills: bars open at the lines' prices and fall a tenth."""
    bars = F.transform("q", lambda x: F.struct(x.alias("open"), (x * 0.9).alias("low")))
    got = E.stop_fill(bars, F.lit(1200.0))
    return _quotes(spark, sf_dir).select("l_orderkey", got["bar"].cast("int").alias("bar"), got["price"].alias("price"))


TERMS = ("EXW", "FCA", "CPT", "CIP", "FAS", "FOB", "CFR", "CIF", "DAP", "DDP", "DPU", "XXX")
_FROM = (1, 2, 2, 2, 3, 4, 4, 4, 5, 5, 6)


@query("shipment_risk", f"SELECT o_orderkey, CASE WHEN o_orderkey % 12 < 11 THEN CASE WHEN o_custkey % 7 >= {list(_FROM)}[o_orderkey % 12 + 1] THEN 'buyer' ELSE 'seller' END END AS bearer FROM orders")
def shipment_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRD-09: each term at each stage, and an unknown term."""
    term = F.get(F.array(*map(F.lit, TERMS)), _int("o_orderkey", 12))
    return table(spark, sf_dir, "orders").select("o_orderkey", E.risk_bearer(term, C("o_custkey") % 7).alias("bearer"))


@query(
    "customer_taxes",
    """SELECT c_custkey, CASE WHEN c_nationkey % 5 <> c_custkey % 5 AND c_acctbal > 0 THEN 'reverse_charge_no_vat' ELSE 'charge_vat' END AS vat, CASE WHEN c_nationkey % 5 <> c_custkey % 5 THEN round(c_custkey * 18 / 100.0::DOUBLE, 2) ELSE 0 END::DOUBLE AS igst,
CASE WHEN c_nationkey % 5 = c_custkey % 5 THEN round(c_custkey * 9 / 100.0::DOUBLE, 2) ELSE 0 END::DOUBLE AS cgst FROM customer""",
)
def customer_taxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRD-11, TRD-12: across borders and inside one, verified and not."""
    a, b = C("c_nationkey") % 5, C("c_custkey") % 5
    gst = E.gst_lines(a, b, C("c_custkey").cast("double"), F.lit(0.18))
    return table(spark, sf_dir, "customer").select("c_custkey", E.vat_treatment(a, b, C("c_acctbal") > 0).alias("vat"), gst["igst"].alias("igst"), gst["cgst"].alias("cgst"))


@query(
    "sanctions_table",
    """WITH l AS (SELECT DISTINCT 'AUTO' || ' ' || s_nationkey AS name, DATE '1970-01-01' + (s_suppkey % 9)::INT AS dob FROM supplier), c AS (SELECT c_custkey AS id, CASE WHEN c_acctbal > 5000 THEN 'AUTO' ELSE 'OTHER' END || ' ' || c_nationkey AS name, DATE '1970-01-01' + (c_custkey % 9)::INT AS dob FROM customer)
SELECT id, CASE WHEN NOT EXISTS (SELECT 1 FROM l WHERE l.name = c.name) THEN 'no_match' WHEN EXISTS (SELECT 1 FROM l WHERE l.name = c.name AND l.dob = c.dob) THEN 'confirmed_match' ELSE 'false_positive' END AS outcome FROM c""",
)
def sanctions_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRD-13: customers against a list made of suppliers, whose names have a middle part."""
    day = lambda x: F.date_add(F.lit("1970-01-01").cast("date"), (x % 9).cast("int"))
    listed = table(spark, sf_dir, "supplier").select(F.concat(F.lit("AUTO Q. "), C("s_nationkey").cast("string")).alias("name"), day(C("s_suppkey")).alias("dob"))
    name = F.concat(F.when(C("c_acctbal") > 5000, "AUTO").otherwise("OTHER"), F.lit("  "), C("c_nationkey").cast("string"))
    return E.screen(table(spark, sf_dir, "customer").select(C("c_custkey").alias("id"), name.alias("name"), day(C("c_custkey")).alias("dob")), listed)


@query(
    "customer_claims",
    """SELECT o_orderkey, o_orderkey % 7 <= o_custkey % 5 AND o_orderkey % 11 >= o_custkey % 4 AS suits, date_diff('day', CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE + (o_custkey % 30)::INT ELSE o_orderdate::DATE END, o_orderdate::DATE + (o_orderkey % 150)::INT) <= 90 + o_custkey % 2 * 30 AS in_time FROM orders""",
)
def customer_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRD-14, TRD-16: suitability of a product, and disputes counted from the purchase or from the delivery."""
    day = F.to_date("o_orderdate")
    in_time = E.in_dispute_window(day, F.date_add(day, _int("o_custkey", 30)), C("o_orderkey") % 2 == 0, F.date_add(day, _int("o_orderkey", 150)), 90 + C("o_custkey") % 2 * 30)
    return table(spark, sf_dir, "orders").select("o_orderkey", E.suitable(C("o_orderkey") % 7, C("o_custkey") % 5, C("o_orderkey") % 11, C("o_custkey") % 4).alias("suits"), in_time.alias("in_time"))


# --- answer checking -------------------------------------------------------------------------------------------------


@query(
    "perturbed_answers",
    """WITH g AS (SELECT o_orderkey, floor(o_totalprice) AS g, replace(format('{:.2f}', floor(o_totalprice)), '.', '') AS d FROM orders),
p AS (SELECT o_orderkey, g, CASE o_orderkey % 5 WHEN 0 THEN g * 1.5 WHEN 1 THEN g - greatest(g * 0.1, 0.5) WHEN 2 THEN CASE WHEN g <> 0 THEN -g ELSE 1 END WHEN 3 THEN g * 100 ELSE NULL END AS v, substr(d, 1, 1) || substr(d, 3, 1) || substr(d, 2, 1) || substr(d, 4) AS s FROM g),
q AS (SELECT *, (substr(s, 1, length(s) - 2) || '.' || right(s, 2))::DOUBLE AS w FROM p)
SELECT o_orderkey, round(coalesce(v, CASE WHEN abs(w - g) > 1e-6 THEN w ELSE g * 1.2 END), 4) AS wrong, o_orderkey % 3 = 0 AS same FROM q""",
)
def perturbed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JDG-01, JDG-02: each kind of wrong answer to an order's total, and whether a proposal with separators equals it."""
    gold, k = F.floor("o_totalprice").cast("double"), C("o_orderkey") % 5
    kind = F.get(F.array(*map(F.lit, ("mul", "add", "sign", "scale", "swap"))), k.cast("int"))
    by = F.get(F.array(*map(F.lit, (1.5, -0.1, 0.0, 100.0, 1.0))), k.cast("int"))
    shown = F.concat(F.lit(" $"), F.format_string("%,.2f", F.when(C("o_orderkey") % 3 == 0, gold).otherwise(gold + 0.01)), F.lit(". "))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(E.perturbed(gold, kind, by), 4).alias("wrong"), E.same_number(shown, gold).alias("same"))


# --- text ------------------------------------------------------------------------------------------------------------

_STATE = "('Please answer the given financial question based on the context.  ' || coalesce(text, '') || ' Question: how much? Proposed answer: ' || doc_id)"


@query("document_keys", f"""SELECT doc_id, sha256(left(regexp_replace(regexp_replace(split_part(split_part({_STATE}, 'Proposed answer:', 1), 'Question:', 1), 'Please answer the given financial question based on the context\\.?', '', 'g'), '\\s+', ' ', 'g').trim(), 600)) AS k FROM documents""")
def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-20: keys of questions about documents, as digests."""
    state = F.concat(F.lit("Please answer the given financial question based on the context.  "), F.coalesce("text", F.lit("")), F.lit(" Question: how much? Proposed answer: "), C("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.document_key(state), 256).alias("k"))


@query("answers_only", "SELECT doc_id, 'Q' || doc_id || CASE WHEN n_chars % 3 > 0 THEN chr(10) || chr(10) || 'Proposed final answer: ' || n_chars || CASE WHEN n_chars % 2 = 0 THEN '.5' ELSE '' END ELSE ' Proposed final answer:  7 ' END AS short, CASE WHEN n_chars % 3 > 0 THEN 'sol' ELSE 'ans' END AS fmt, n_chars % 3 > 0 AND n_chars % 2 = 0 AS leaves FROM documents")
def answers_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-21, FLT-08: solutions cut out between the first and the last marker; answers with a decimal point leave."""
    n = C("n_chars")
    shown = F.concat(n.cast("string"), F.when(n % 2 == 0, ".5").otherwise(""))
    state = F.concat(F.lit("Q"), C("doc_id").cast("string"), F.when(n % 3 > 0, F.concat(F.lit("\n\nProposed solution: "), F.coalesce("text", F.lit("")), F.lit("\nProposed final answer: 1 Proposed final answer:  "), shown, F.lit(" "))).otherwise(" Proposed final answer:  7 "))
    short, fmt, leaves = X.answer_only(state)
    return table(spark, sf_dir, "documents").select("doc_id", short.alias("short"), fmt.alias("fmt"), leaves.alias("leaves"))


@query("numbers_shown", "SELECT o_orderkey, format('{:,.2f}', o_orderkey / 4.0::DOUBLE) AS comma, '$' || format('{:,.2f}', o_orderkey / 4.0::DOUBLE) AS usd, translate(format('{:,.2f}', o_orderkey / 4.0::DOUBLE), ',.', '.,') AS pt, o_orderkey / 4.0::DOUBLE AS parsed FROM orders")
def numbers_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-22, PRJ-23: numbers in three styles, and one read back."""
    x = C("o_orderkey") / 4.0
    return table(spark, sf_dir, "orders").select("o_orderkey", *(X.formatted(x, s).alias(s) for s in ("comma", "usd", "pt")), X.number(F.concat(X.formatted(x, "usd"), F.lit("% "))).alias("parsed"))


@query("json_in_text", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN doc_id % 3 > 0 THEN lang END AS first FROM documents")
def json_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-25: the outermost JSON of an answer in prose; in a third of them it is broken."""
    text = F.concat(F.lit("Here it is: "), F.to_json(F.struct(F.array("lang", "source").alias("items"), F.struct(F.lit("}").alias("x")).alias("y"))), F.when(C("doc_id") % 3 == 0, "}").otherwise(""), F.lit(" done"))
    items = X.json_items(text)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(items).alias("n"), F.get(items, F.lit(0)).alias("first"))


@query(
    "haystacks",
    """WITH l AS (SELECT doc_id, source, (doc_id % 7)::INT AS n, list_transform(range(doc_id % 7), lambda i: CASE WHEN i % 2 = 0 THEN 'Sky ' || i || '. ' ELSE 'Grass ' || i || '. ' END) AS f FROM documents)
SELECT doc_id, array_to_string(f[1:n // 2], '') || chr(10) || '=== CASE FILE (relevant) ===' || chr(10) || source || chr(10) || '=== END OF CASE FILE ===' || chr(10) || array_to_string(f[n // 2 + 1:], '') AS hay FROM l""",
)
def haystacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-28: a case half-way down up to six lines."""
    return table(spark, sf_dir, "documents").select("doc_id", X.haystack(C("source"), _int("doc_id", 7), F.lit(0.5), ("Sky {i}. ", "Grass {i}. ")).alias("hay"))


@query("images_lifted", "SELECT doc_id, lang || ' [image ' || (1 + doc_id % 3) || ']' || CASE WHEN doc_id % 2 = 0 THEN source || '[image ' || (2 + doc_id % 3) || ']' ELSE '' END AS state, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS n FROM documents")
def images_lifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-30: one or two images in a text, numbered behind those that are there."""
    uri = lambda x: F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode(x, "UTF-8")))
    # base64 runs on into letters, so the source stands behind a sign
    state = F.concat("lang", F.lit(" "), uri(C("source")), F.when(C("doc_id") % 2 == 0, F.concat(F.lit("\x01"), "source", uri(C("lang")))).otherwise(""))
    text, found = X.lift_images(state, C("doc_id") % 3)
    return table(spark, sf_dir, "documents").select("doc_id", F.replace(text, F.lit("\x01"), F.lit("")).alias("state"), F.size(found).alias("n"))


@query("apart_values", "WITH l AS (SELECT l_orderkey, list(l_discount / 10 ORDER BY l_linenumber, l_discount) AS v FROM lineitem GROUP BY l_orderkey), k AS (SELECT l_orderkey, list_reduce(list_transform(v, lambda x: [x]), lambda a, b: CASE WHEN len(list_filter(a, lambda u: abs(b[1] - u) <= 0.004)) > 0 THEN a ELSE list_concat(a, b) END) AS kept FROM l) SELECT l_orderkey, len(kept)::INT AS n, round(list_sum(kept), 9) AS total FROM k")
def apart_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-05: a tenth of an order's discounts, without those within 0.004 of one before."""
    row = F.struct("l_linenumber", "l_discount")
    values = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["l_discount"] / 10)
    kept = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(values.alias("v")).withColumn("kept", X.keep_apart(C("v")))
    return kept.select("l_orderkey", F.size("kept").alias("n"), F.round(D.total(C("kept")), 9).alias("total"))


# --- rules -----------------------------------------------------------------------------------------------------------


@query("order_traces", "SELECT o_orderkey, 'total over 100000 [' || format('{:,.2f}', o_orderkey / 4.0::DOUBLE) || '] → ' || CASE WHEN o_totalprice > 100000 THEN 'true' ELSE 'false' END AS en, '| prioridade | ' || o_orderpriority || ' |' || chr(10) || '| aberto | ' || CASE WHEN o_orderstatus = 'O' THEN 'sim' ELSE 'não' END || ' |' AS pt FROM orders")
def order_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-11, RUL-12: a condition with its value and outcome, and a case as a table in Portuguese."""
    o = table(spark, sf_dir, "orders").withColumn("open", C("o_orderstatus") == "O")
    en = R.trace(("o_totalprice", ">", 100000), "total over 100000", R.shown(C("o_orderkey") / 4.0, "money"))
    pt = R.render_case([("o_orderpriority", "enum", "priority", "prioridade"), ("open", "bool", "open", "aberto")], "the order", "table", "pt")
    return o.select("o_orderkey", en.alias("en"), pt.alias("pt"))


# --- decisions -------------------------------------------------------------------------------------------------------

_SOFT = "list_transform(v[{a}:{b}], lambda x: exp(x) / list_sum(list_transform(v[{a}:{b}], lambda y: exp(y))))"
_PQ = f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT vec_id, {_SOFT.format(a=1, b=4)} AS p, {_SOFT.format(a=5, b=8)} AS q FROM e)"
_SIX = "array_to_string(list_transform({}, lambda x: format('{{:.5f}}', x)), ' ')"
_MIX = "list_transform(range(1, 5), lambda i: power(p[i], 0.7) * power(q[i], 0.3))"


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distributions of four options for each vector."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", D.softmax(F.slice(v, 1, 4)).alias("p"), D.softmax(F.slice(v, 5, 4)).alias("q"))


def _five(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.format_string("%.5f", x)), " ")


@query("expert_mixes", f"{_PQ}, m AS (SELECT vec_id, list_transform(range(1, 5), lambda i: (p[i] + q[5 - i]) / 2) AS mean, {_MIX} AS w FROM s) SELECT vec_id, {_SIX.format('mean')} AS mean, {_SIX.format('list_transform(w, lambda x: x / list_sum(w))')} AS mixed FROM m")
def expert_mixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEC-04, DEC-05: the mean over both orders of the options, and the product of experts."""
    return _two(spark, sf_dir).select("vec_id", _five(D.symmetrised(C("p"), C("q"))).alias("mean"), _five(D.experts(C("p"), C("q"), 0.3)).alias("mixed"))


@query("tails_spread", f"{_PQ} SELECT vec_id, {_SIX.format('list_transform(range(1, 5), lambda i: CASE WHEN i <= 1 + vec_id % 4 THEN p[i] ELSE (1 - list_sum(p[1:1 + vec_id % 4])) / (3 - vec_id % 4) END)')} AS p FROM s")
def tails_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEC-06: the first one to four options are seen, the others share the rest."""
    labels = F.array(*map(F.lit, "abcd"))
    k = _int("vec_id", 4, 1)
    return _two(spark, sf_dir).select("vec_id", _five(D.tail_spread(labels, F.map_from_arrays(F.slice(labels, F.lit(1), k), F.slice("p", F.lit(1), k)))).alias("p"))


@query(
    "tournaments",
    """WITH e AS (SELECT vec_id, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id, (i - 1) // 32 ORDER BY x DESC, i) AS rn FROM e),
w AS (SELECT *, exp(x) AS g FROM b WHERE rn <= 16), p AS (SELECT vec_id, i, x, g / sum(g) OVER (PARTITION BY vec_id) / (1 + 0.0001 * 32) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS best FROM w)
SELECT vec_id, max(CASE WHEN best = 1 THEN i - 1 END)::INT AS best, round(max(p), 7) AS p, 32 AS lost FROM p GROUP BY vec_id""",
)
def tournaments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEC-03, SRT-04: 64 options where one pass reads 32: two blocks, the better half of each goes on."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("scores"))
    t = D.tournament(rows, limit=32)
    lost = F.size(F.filter("probs", lambda p: F.abs(p - D.LOST / (1 + 32 * D.LOST)) < 1e-12))
    return t.select("vec_id", D.first_largest(C("probs")).alias("best"), F.round(F.array_max("probs"), 7).alias("p"), lost.alias("lost"))


_CUT = "CASE WHEN fits THEN s ELSE left(s, floor(floor(length(s) * 300 / n * 0.9) * 0.7)::INT) || chr(10) || '[...]' || chr(10) || right(s, floor(floor(length(s) * 300 / n * 0.9) * 0.3)::INT) END"
_STEPS = ", ".join(f"n{k} AS (SELECT doc_id, s, fits, ceil(length(s) / 3.5::DOUBLE) + 40 AS n FROM c{k}), f{k} AS (SELECT doc_id, s, n, fits OR n <= 300 AS fits FROM n{k}), c{k + 1} AS (SELECT doc_id, {_CUT} AS s, fits FROM f{k})" for k in range(4))


@query("head_tail_truncation", f"WITH c0 AS (SELECT doc_id, text AS s, FALSE AS fits FROM documents), {_STEPS} SELECT doc_id, s AS cut, fits FROM c4")
def head_tail_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-29: texts cut to 300 tokens around a marker, looked at again up to four times."""
    docs = table(spark, sf_dir, "documents").select("doc_id", C("text").alias("cut"))
    return X.truncated(docs, "cut", lambda s: F.ceil(F.length(s) / 3.5) + 40, 300)
