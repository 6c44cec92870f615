"""Decision operators over literal rows, with the rows that they must give, and over tables against SQL written apart."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.operators import decisions as X
from verdex.plans.cases import cases
from verdex.plans.registry import query
from verdex.sources.tables import table


def _softmax(s: list[float]) -> list[float]:
    e = [math.exp(x - max(s)) for x in s]
    return [x / sum(e) for x in e]


def _tournament(opts: list[tuple[int, float]], limit: int, chunk: int | None = None, keep: int | None = None) -> dict[int, float]:
    """In plain Python, round by round."""
    if len(opts) <= limit:
        return dict(zip([i for i, _ in opts], _softmax([s for _, s in opts]), strict=True))
    size = min(chunk or limit, limit)
    best = keep or max(1, min(size // 2, limit // math.ceil(len(opts) / size)))
    final = []
    for i in range(0, len(opts), size):
        final += sorted(opts[i : i + size], key=lambda o: -o[1])[:best]
    p = dict.fromkeys([i for i, _ in opts], 1e-4) | _tournament(final, limit, chunk, keep)
    z = sum(p.values())
    return {i: v / z for i, v in p.items()}


def _scores(n: int) -> list[float]:
    return [((i * 7919) % 101) / 20 for i in range(n)]


SIZES = [1, 4, 5, 9, 16, 17, 23, 70, 200]


@cases("tournament_rounds", "n bigint, best bigint, ties bigint, shares varchar", [
    (n, max(p, key=lambda i: (p[i], -i)), sum(abs(v - max(p.values())) < 1e-12 for v in p.values()), " ".join(f"{p[i]:.6f}" for i in range(min(n, 12)))) for n in SIZES for p in [_tournament(list(enumerate(_scores(n))), 4)]
])
def tournament_rounds(spark: SparkSession) -> DataFrame:
    """DEC-03, SRT-04: the limit, one over it, odd tails, and more than the limit squared, which plays several rounds."""
    rows = spark.createDataFrame([(n, _scores(n)) for n in SIZES], "n bigint, scores array<double>")
    t = X.tournament(rows, limit=4)
    top = F.array_max("probs")
    return t.select("n", X.first_largest(F.col("probs")).cast("bigint").alias("best"), F.size(F.filter("probs", lambda p: F.abs(p - top) < 1e-12)).cast("bigint").alias("ties"), F.array_join(F.transform(F.slice("probs", 1, 12), lambda p: F.format_string("%.6f", p)), " ").alias("shares"))


@cases("tournament_legacy", "n bigint, shares varchar", [(n, " ".join(f"{p[i]:.6f}" for i in range(n))) for n in (26, 27, 70) for p in [_tournament(list(enumerate(_scores(n))), 26, 20, 2)]])
def tournament_legacy(spark: SparkSession) -> DataFrame:
    """SRT-04: blocks of 20, two of each, 26 in one pass."""
    rows = spark.createDataFrame([(n, _scores(n)) for n in (26, 27, 70)], "n bigint, scores array<double>")
    return X.tournament(rows, limit=26, chunk=20, keep=2).select("n", F.array_join(F.transform("probs", lambda p: F.format_string("%.6f", p)), " ").alias("shares"))


MIXES = [(0, [0.5, 0.3, 0.2], [0.1, 0.2, 0.7]), (1, [1.0, 0.0], [0.5, 0.5]), (2, [0.25] * 4, [0.7, 0.1, 0.1, 0.1])]


def _experts(p: list[float], q: list[float], w: float) -> list[float]:
    m = [max(a, 1e-12) ** (1 - w) * max(b, 1e-12) ** w for a, b in zip(p, q, strict=True)]
    return [x / sum(m) for x in m]


@cases("expert_mix", "id bigint, both varchar, mixed varchar", [
    (i, " ".join(f"{(a + b) / 2:.6f}" for a, b in zip(p, q[::-1], strict=True)), " ".join(f"{x:.6f}" for x in _experts(p, q, 0.3))) for i, p, q in MIXES
])
def expert_mix(spark: SparkSession) -> DataFrame:
    """DEC-04, DEC-05: the mean over both orders of the options; the product of experts."""
    r = spark.createDataFrame(MIXES, "id bigint, p array<double>, q array<double>")
    six = lambda a: F.array_join(F.transform(a, lambda x: F.format_string("%.6f", x)), " ")
    return r.select("id", six(X.symmetrised(F.col("p"), F.col("q"))).alias("both"), six(X.experts(F.col("p"), F.col("q"), 0.3)).alias("mixed"))


TAILS = [(0, ["a", "b", "c", "d"], {"a": 0.5, "c": 0.3}, "0.5 0.1 0.3 0.1"), (1, ["a", "b"], {"a": 0.75, "b": 0.25}, "0.75 0.25"), (2, ["a", "b"], {}, "0.5 0.5"), (3, ["a", "b"], {"a": 1.25}, "1.25 0.0")]


@cases("tail_spread", "id bigint, p varchar", [(i, p) for i, _, _, p in TAILS])
def tail_spread(spark: SparkSession) -> DataFrame:
    """DEC-06: what is missing to 1 is shared among the labels that weren't seen, however many."""
    r = spark.createDataFrame([x[:3] for x in TAILS], "id bigint, labels array<string>, seen map<string,double>")
    return r.select("id", F.array_join(F.transform(X.tail_spread(F.col("labels"), F.col("seen")), lambda x: F.round(x, 9).cast("string")), " ").alias("p"))


@query("conditional_temperature", "SELECT doc_id, round(exp(0.1 + 0.2 * (ln(greatest(n_chars, 1)) - 6.5) - 0.1 * (ln(2 + doc_id % 30) - 1.2) + CASE WHEN doc_id % 3 = 0 THEN 0.05 WHEN doc_id % 3 = 1 THEN -0.07 ELSE 0 END), 9) AS t FROM documents")
def conditional_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEC-02: all four features."""
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "noul").when(F.col("doc_id") % 3 == 1, "score").otherwise("choice")
    return d.select("doc_id", F.round(X.temperature(F.col("n_chars"), 2 + F.col("doc_id") % 30, kind, 0.1, (0.2, -0.1, 0.05, -0.07)), 9).alias("t"))


def _near(n: int) -> list[tuple]:
    return [(f"o{i}", [math.cos(i / 12), math.sin(i / 12)], 10) for i in range(n)]


@cases("shortlist", "n bigint, room double, route varchar, kept varchar", [
    (8, 80.0, "all", " ".join(f"o{i}" for i in range(8))), (30, 299.0, "shortlist_k20", " ".join(f"o{i}" for i in range(20))), (30, 150.0, "shortlist_k10", " ".join(f"o{i}" for i in range(10))),
    (30, 50.0, "shortlist_k5", "o0 o1 o2 o3 o4"), (30, 49.0, "error", None),
])
def shortlist(spark: SparkSession) -> DataFrame:
    """DEC-11, DEC-12, AGG-21: all options if they fit, else the nearest 20, 10 or 5 by cosine."""
    r = spark.createDataFrame([(n, room, _near(n), [1.0, 0.0]) for n, room in ((8, 80.0), (30, 299.0), (30, 150.0), (30, 50.0), (30, 49.0))], "n bigint, room double, options array<struct<label: string, vector: array<double>, cost: int>>, query array<double>")
    return X.shortlist(r, "options", "query", "cost", F.col("room")).select("n", "room", "route", F.array_join(F.transform("kept", lambda o: o["label"]), " ").alias("kept"))


LOG = [
    ({"id": "a", "task": "t", "ok": True, "conf": 0.5}, ("a", "t", True, 0.5)), ({"id": "b", "cfg": "c", "ok": True, "correct": False, "conf": 1}, ("b", "c", False, 1.0)), ({"task_id": "c", "family": "f", "correct": "True", "probs": {"x": 0.2, "y": 0.8}}, ("c", "f", True, 0.8)),
    ({"id": "d", "ok": 1, "probs": "{'x': 1}"}, ("d", None, True, None)), ({"id": "e", "ok": True, "err": "timeout"}, ("e", None, False, None)), ({"id": "f", "ok": True, "err": "late", "conf": 0.25}, ("f", None, True, 0.25)), ({"id": "g", "ok": "yes", "err": "None"}, ("g", None, False, None)),
    ({"id": "h", "ok": True, "correct": None, "conf": None}, ("h", None, False, None)), ({"id": "i", "task": "legalbench_x", "ok": "true", "conf": 0.0}, ("i", "legalbench_x", True, 0.0)),
]


def _log(spark: SparkSession) -> DataFrame:
    return X.predictions(spark.createDataFrame([(json.dumps(x),) for x, _ in LOG], "value string"))


@cases("prediction_normal", "id varchar, task varchar, ok boolean, conf double", [x for _, x in LOG])
def prediction_normal(spark: SparkSession) -> DataFrame:
    """PRJ-14: truthy values, `correct` before `ok`, null confidence, probabilities as text, errors."""
    return _log(spark)


@cases("suite_join", "id varchar, task varchar, qtype varchar", [("a", "s1", "noul"), ("b", "c", None), ("c", "f", "choice"), ("d", None, None), ("e", None, None), ("f", None, None), ("g", None, None), ("h", None, None), ("i", "legalbench", "score")])
def suite_join(spark: SparkSession) -> DataFrame:
    """JOIN-11, PRJ-15: the suite's task before the prediction's own, subtasks under one key."""
    suite = spark.createDataFrame([("a", "noul", 2, "s1"), ("c", "choice", 3, None), ("i", "score", 5, "legalbench_x")], "id string, qtype string, n_opts int, task string")
    return X.with_suite(_log(spark), suite).select("id", X.rollup(F.col("task")).alias("task"), "qtype")


AXES = [(0.6, 0.9, 0.8, 0.05, 0.2, 0.05, 0.4, 0.004), (0.1, 0.2, 0.1, 0.6, None, 9.0, 60.0, 3.0), (1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0001)]


def _composite(h: float, e: float, o: float, ece: float, tv: float | None, p50: float, p95: float, usd: float) -> tuple:
    speed = lambda s: max(0.0, min(100.0, 100 - 20 * math.log10(max(s, 1e-6) / 0.1)))
    a = round(100 * (0.30 * h + 0.14 * e + 0.56 * o) / 1.0, 1)
    near = 100 * (1 - ece / 0.5)
    c = round((near + (100 * (1 - tv) if tv is not None else near)) / 2, 1)
    s = round((speed(2 * p50 + 0.15) + speed(2 * p95 + 0.15)) / 2, 1)
    m = round(max(0.0, min(100.0, 100 - 30 * math.log10(usd / 0.001))), 1)
    return a, c, s, m, round(math.exp(sum(0.25 * math.log(max(x, 1)) for x in (a, c, s, m))), 1)


@cases("composite_score", "id bigint, intelligence double, calibration double, speed double, cost double, score double", [(i, *_composite(*x)) for i, x in enumerate(AXES)])
def composite_score(spark: SparkSession) -> DataFrame:
    """AGG-18: four axes and their geometric mean; no variation of probability items, axes below 1."""
    r = spark.createDataFrame([(i, *x) for i, x in enumerate(AXES)], "id bigint, hard double, easy double, original double, ece double, tv double, p50 double, p95 double, usd double")
    axes = X.composite({t: F.col(t) for t in ("hard", "easy", "original")}, *(F.col(x) for x in ("ece", "tv", "p50", "p95", "usd")))
    return r.select("id", *(c.alias(n) for n, c in axes.items()))


@query("temperature_grid_crossfit", """WITH x AS (SELECT vec_id AS id, CASE WHEN label % 2 = 0 THEN 'choice' ELSE 'score' END AS qtype, 3 + label % 2 AS n_opts, label % 3 <> 0 AS ok,
  list_transform(embedding[1:3 + label % 2], lambda v: abs(v::DOUBLE) + 0.01) AS w FROM embeddings),
l AS (SELECT *, list_transform(w, lambda v: ln(greatest(v / list_sum(w), 1e-9))) AS lg, CAST(concat('0x', right(sha1(CAST(id AS VARCHAR)), 1)) AS BIGINT) % 2 AS fold FROM x),
g AS (SELECT fold, qtype, n_opts, 0.25 * k AS t, round(sum(-ln(greatest(CASE WHEN ok THEN p ELSE 1 - p END, 1e-9))), 7) AS nll FROM (SELECT fold, qtype, n_opts, ok, k,
  1 / list_sum(list_transform(lg, lambda v: exp((v - list_max(lg)) / (0.25 * k)))) AS p FROM l, range(1, 41) r(k)) GROUP BY ALL)
SELECT 1 - fold AS applied_to, qtype, n_opts, CAST(arg_min(t, (nll, t)) AS DOUBLE) AS t FROM g GROUP BY fold, qtype, n_opts""")  # fmt: skip
def temperature_grid_crossfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAL-02: by type and number of options."""
    e = table(spark, sf_dir, "embeddings")
    w = F.transform(F.slice("embedding", F.lit(1), (3 + F.col("label") % 2).cast("int")), lambda v: F.abs(v.cast("double")) + 0.01)
    rows = e.select(F.col("vec_id").alias("id"), F.when(F.col("label") % 2 == 0, "choice").otherwise("score").alias("qtype"), (3 + F.col("label") % 2).alias("n_opts"), (F.col("label") % 3 != 0).alias("ok"), X.shared(w).alias("probs"))
    return X.crossfit_temperature(rows)
