"""Evaluation analytics over prediction logs, and decision mathematics on option distributions.

The log: a nearest-centroid classifier over embeddings. A system's option probabilities are the softmax of the cosine to each
class centroid; gold is the label, the task vec_id mod 5. Systems: base (all dimensions) and variant (the first 48).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.operators import evaluation
from verdex.plans.dialect import Duck, Spark, both, doubles
from verdex.plans.registry import query

TAU = 0.05


def dots(d: Spark, system: str = "base") -> str:
    """cos: one row per item and option, with its cosine. Centroids are one short row each; they come to every item as one array."""
    dims = 64 if system == "base" else 48
    part = "e.embedding" if dims == 64 else f"slice(e.embedding, 1, {dims})" if d.t("x") != "x" else f"e.embedding[1:{dims}]"
    norm = lambda a: f"sqrt({d.fold_sum(d.each(a, 'x', 'cast(x as double) * cast(x as double)'))})"
    dot = d.fold_sum(d.each(d.series("1", str(dims)), "i", f"cast({d.at('e.v', 'i')} as double) * {d.at('c.c', 'i')}"))
    return f"""x_{system} AS (SELECT label, i, avg(cast({d.at('embedding', 'i')} as double)) AS x FROM (SELECT label, embedding, {d.explode(d.series('1', str(dims)))} AS i FROM {d.t('embeddings')}) z GROUP BY label, i),
c_{system} AS (SELECT label AS opt, {d.list_agg('x', 'i')} AS c FROM x_{system} GROUP BY label),
e_{system} AS (SELECT vec_id, label, {part} AS v FROM {d.t('embeddings')} e),
cos_{system} AS (SELECT e.vec_id AS id, e.label AS gold, c.opt, {dot} / ({norm('e.v')} * {norm('c.c')}) AS cos FROM e_{system} e CROSS JOIN c_{system} c),
m_{system} AS (SELECT *, exp((cos - max(cos) OVER (PARTITION BY id)) / {TAU}) AS w FROM cos_{system}),
p_{system} AS (SELECT id, gold, opt, round(w / sum(w) OVER (PARTITION BY id), 9) AS p FROM m_{system}),
r_{system} AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, opt) AS rn FROM p_{system}),
{system} AS (SELECT id, id % 5 AS task, gold, opt AS pred, CASE WHEN gold = opt THEN 1 ELSE 0 END AS ok, round(p, 6) AS conf FROM r_{system} WHERE rn = 1)"""


BINS = "bins AS (SELECT * FROM (VALUES " + ", ".join(f"({b}, cast({b / 10} as double), cast({(b + 1) / 10} as double))" for b in range(10)) + ") AS t(b, lo, hi))"


def log(spark: SparkSession, sf_dir: str, system: str = "base") -> DataFrame:
    """The prediction log of a system."""
    return spark.sql(doubles(f"WITH {dots(Spark(sf_dir), system)} SELECT id, task, gold, pred, ok, conf FROM {system}"))


def duck(sql: str, *systems: str) -> str:
    """sql over the logs of the systems, for DuckDB."""
    return doubles("WITH " + ", ".join(dots(Duck(), s) for s in systems) + sql)


@both("pred_log")
def pred_log(d: Spark) -> str:
    """PRJ-09, PRJ-14, DEC-01: prediction log; the first largest option wins."""
    return f"WITH {dots(d)} SELECT id, task, gold, pred, ok, conf FROM base"


@both("accuracy_by_task")
def accuracy_by_task(d: Spark) -> str:
    """AGG-01, JOIN-11."""
    return f"WITH {dots(d)} SELECT task, count(*) AS n, round(avg(cast(ok as double)), 9) AS acc FROM base GROUP BY task"


@both("macro_accuracy")
def macro_accuracy(d: Spark) -> str:
    """AGG-02: mean of the tasks' means, and of their values rounded to 4 places as summaries print them."""
    return f"WITH {dots(d)}, t AS (SELECT task, avg(cast(ok as double)) AS acc FROM base GROUP BY task) SELECT round(avg(acc), 9) AS macro, round(avg(round(acc, 4)), 9) AS macro_of_rounded FROM t"


@both("balanced_accuracy")
def balanced_accuracy(d: Spark) -> str:
    """AGG-03: mean recall over gold classes, by task."""
    return f"WITH {dots(d)}, g AS (SELECT task, gold, avg(cast(ok as double)) AS recall FROM base GROUP BY task, gold) SELECT task, round(avg(recall), 9) AS balanced FROM g GROUP BY task"


@both("ece10")
def ece10(d: Spark) -> str:
    """AGG-04, AGG-05: calibration error over ten bins (lo, hi]; confidence 0 is in no bin, or in bin 0 for the second figure."""
    return f"""WITH {dots(d)}, {BINS}, j AS (SELECT b, count(*) AS n, avg(cast(ok as double)) AS acc, avg(conf) AS conf FROM base JOIN bins ON conf > lo AND conf <= hi GROUP BY b),
z AS (SELECT b, count(*) AS n, avg(cast(ok as double)) AS acc, avg(conf) AS conf FROM base JOIN bins ON (conf > lo OR b = 0 AND conf = 0) AND conf <= hi GROUP BY b), a AS (SELECT count(*) AS n FROM base)
SELECT 'positive' AS kind, round(sum(j.n * abs(acc - conf)) / max(a.n), 8) AS ece FROM j CROSS JOIN a UNION ALL SELECT 'with_zero', round(sum(z.n * abs(acc - conf)) / max(a.n), 8) FROM z CROSS JOIN a"""


@both("policy_threshold")
def policy_threshold(d: Spark) -> str:
    """AGG-06: coverage at confidence t and over, and the error among those decided."""
    return f"""WITH {dots(d)}, t AS (SELECT * FROM (VALUES (cast(0.5 as double)), (cast(0.9 as double)), (cast(0.95 as double))) AS t(t))
SELECT t, round(avg(CASE WHEN conf >= t THEN 1.0 ELSE 0.0 END), 9) AS coverage, round(1 - avg(CASE WHEN conf >= t THEN cast(ok as double) END), 9) AS error FROM base CROSS JOIN t GROUP BY t"""


@both("chance_level")
def chance_level(d: Spark) -> str:
    """AGG-07: mean of 1 / options."""
    return f"WITH {dots(d)}, n AS (SELECT id, id % 5 AS task, count(*) AS k FROM p_base GROUP BY id) SELECT task, round(avg(1.0 / k), 9) AS chance FROM n GROUP BY task"


@both("count_by_task_expected")
def count_by_task_expected(d: Spark) -> str:
    """AGG-25."""
    return f"SELECT vec_id % 5 AS task, label AS expected, count(*) AS n FROM {d.t('embeddings')} GROUP BY vec_id % 5, label"


@both("common_items")
def common_items(d: Spark) -> str:
    """JOIN-09, AGG-22, SET-02: macro accuracy of each system over the items that all systems answered."""
    return f"""WITH {dots(d)}, {dots(d, 'variant')}, l AS (SELECT 'base' AS system, * FROM base WHERE id % 11 <> 0 UNION ALL SELECT 'variant', * FROM variant WHERE id % 13 <> 0),
k AS (SELECT id FROM l GROUP BY id HAVING count(DISTINCT system) = 2), t AS (SELECT system, task, avg(cast(ok as double)) AS acc, count(*) AS n FROM l WHERE id IN (SELECT id FROM k) GROUP BY system, task)
SELECT system, cast(sum(n) as bigint) AS items, round(avg(acc), 9) AS macro FROM t GROUP BY system"""


@both("fit_subset")
def fit_subset(d: Spark) -> str:
    """AGG-23, DEC-12: accuracy on the items that fit a competitor's context."""
    return f"WITH {dots(d)}, f AS (SELECT doc_id AS id, n_chars / 3.5 <= 512 AS fits FROM {d.t('documents')}) SELECT f.fits, count(*) AS n, round(avg(cast(ok as double)), 9) AS acc FROM base JOIN f ON base.id = f.id GROUP BY f.fits"


@both("flips_low_confidence")
def flips_low_confidence(d: Spark) -> str:
    """AGG-15: agreement where the base is confident, and the share of flips where it isn't."""
    return f"""WITH {dots(d)}, {dots(d, 'variant')}, j AS (SELECT b.conf, CASE WHEN b.pred = v.pred THEN 1.0 ELSE 0.0 END AS same FROM base b JOIN variant v ON b.id = v.id)
SELECT round(avg(CASE WHEN conf >= 0.7 THEN same END), 9) AS agree70, round(avg(CASE WHEN conf >= 0.9 THEN same END), 9) AS agree90, round(avg(CASE WHEN same = 0 THEN CASE WHEN conf < 0.7 THEN 1.0 ELSE 0.0 END END), 9) AS flips_below70 FROM j"""


@both("release_matrix")
def release_matrix(d: Spark) -> str:
    """AGG-26: accuracy per build and suite with the difference to the base build."""
    return f"""WITH {dots(d)}, {dots(d, 'variant')}, l AS (SELECT 'base' AS build, task, ok FROM base UNION ALL SELECT 'variant', task, ok FROM variant),
m AS (SELECT build, {', '.join(f'avg(CASE WHEN task = {k} THEN cast(ok as double) END) AS s{k}' for k in range(5))} FROM l GROUP BY build)
SELECT m.build, {', '.join(f'round(m.s{k}, 8) AS s{k}' for k in range(5))}, round((m.s0 + m.s1 + m.s2 + m.s3 + m.s4 - b.s0 - b.s1 - b.s2 - b.s3 - b.s4) / 5, 8) AS delta FROM m CROSS JOIN (SELECT * FROM m WHERE build = 'base') b"""


PAIR = "q AS (SELECT b.id, b.gold, b.opt, b.p AS p, v.p AS q FROM p_base b JOIN p_variant v ON b.id = v.id AND b.opt = v.opt)"


@both("distribution_distance")
def distribution_distance(d: Spark) -> str:
    """AGG-16, AGG-17, SRT-02: largest and total variation between two builds' distributions, the five worst items."""
    return f"""WITH {dots(d)}, {dots(d, 'variant')}, {PAIR}, i AS (SELECT id, round(max(abs(p - q)), 7) AS linf, round(sum(abs(p - q)) / 2, 7) AS tv FROM q GROUP BY id)
SELECT id, linf, tv FROM i ORDER BY linf DESC, id LIMIT 5"""


@both("soft_cross_entropy")
def soft_cross_entropy(d: Spark) -> str:
    """AGG-19, PRJ-07, PRJ-08: cross-entropy against soft targets of 0.95 on gold, the rest shared evenly."""
    return f"WITH {dots(d)} SELECT round(-sum(CASE WHEN opt = gold THEN 0.95 ELSE 0.05 / 9 END * ln(greatest(p, 1e-9))) / count(DISTINCT id), 6) AS soft_ce, round(-avg(CASE WHEN opt = gold THEN ln(greatest(p, 1e-9)) END), 6) AS nll FROM p_base"


@both("symmetric_kl")
def symmetric_kl(d: Spark) -> str:
    """AGG-20: half the sum of both divergences, mean over items."""
    return f"WITH {dots(d)}, {dots(d, 'variant')}, {PAIR} SELECT round(sum((p - q) * (ln(greatest(p, 1e-9)) - ln(greatest(q, 1e-9)))) / 2 / count(DISTINCT id), 6) AS sym_kl FROM q"


@both("answer_format")
def answer_format(d: Spark) -> str:
    """DEC-07: a yes/no probability with its value, a score's top level with its expectation."""
    return f"""WITH {dots(d)} SELECT id, round(sum(CASE WHEN opt >= 5 THEN p ELSE 0 END), 6) AS p_yes, sum(CASE WHEN opt >= 5 THEN p ELSE 0 END) >= 0.5 AS yes, round(sum(opt * p) / sum(p), 5) AS expected_score FROM p_base GROUP BY id"""


@both("tier_accuracy")
def tier_accuracy(d: Spark) -> str:
    """JOIN-13: accuracy by tier of the reference list; an item without a prediction is wrong."""
    return f"WITH {dots(d)}, t AS (SELECT doc_id AS id, source AS tier FROM {d.t('documents')}) SELECT tier, count(*) AS n, round(avg(cast(coalesce(ok, 0) as double)), 9) AS acc FROM t LEFT JOIN base ON t.id = base.id GROUP BY tier"


@both("long_context_grid")
def long_context_grid(d: Spark) -> str:
    """AGG-24: accuracy and mean length by length class and depth."""
    return f"""WITH {dots(d)}, g AS (SELECT b.ok, CASE WHEN n_chars < 1000 THEN 1 WHEN n_chars < 4000 THEN 4 ELSE 16 END AS len_k, b.id % 3 AS depth, n_chars FROM base b JOIN {d.t('documents')} x ON x.doc_id = b.id)
SELECT len_k, depth, count(*) AS n, round(avg(cast(ok as double)), 9) AS acc, round(avg(cast(n_chars as double)), 6) AS mean_chars FROM g GROUP BY len_k, depth"""


@both("task_rollup")
def task_rollup(d: Spark) -> str:
    """PRJ-15: subtasks under one key."""
    return f"SELECT CASE WHEN source LIKE 'src1%' THEN 'src1x' ELSE source END AS task, count(*) AS n FROM {d.t('documents')} GROUP BY CASE WHEN source LIKE 'src1%' THEN 'src1x' ELSE source END"


#: The curve item by item: each item's accuracy is that of the items before its group and of its group's mean, as often as it stands in it.
CURVE = """, o AS (SELECT conf, ok, row_number() OVER (ORDER BY conf DESC) AS k, count(*) OVER () AS n FROM base),
w AS (SELECT k, n, min(k) OVER (PARTITION BY conf) - 1 AS k0, avg(ok) OVER (PARTITION BY conf) AS r, conf FROM o),
a AS (SELECT k, n, conf, ((SELECT coalesce(sum(b.ok), 0) FROM base b WHERE b.conf > w.conf) + (k - k0) * r) / k AS acc FROM w)"""


@query("risk_coverage", duck(CURVE + " SELECT round(avg(1 - acc), 8) AS aurc, round(max(acc) FILTER (k = greatest(1, round_even(0.8 * n, 0))), 8) AS acc80, round(max(acc) FILTER (k = greatest(1, round_even(0.5 * n, 0))), 8) AS acc50 FROM a", "base"))
def risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-04: accuracy at each coverage; inside a group of equal confidence, the expected one over their order. AURC is the mean of 1 - accuracy."""
    out = evaluation.risk_coverage(log(spark, sf_dir))
    return out.select(*(F.round(c, 8).alias(a) for c, a in (("aurc", "aurc"), ("acc_80", "acc80"), ("acc_50", "acc50"))))


TARGETS = (0.5, 0.6, 0.95, 0.99)


@query("coverage_at", duck(", t AS (SELECT unnest([" + ", ".join(map(str, TARGETS)) + "]) AS target), c AS (SELECT DISTINCT conf FROM base), e AS (SELECT c.conf, avg(b.ok) AS acc, count(*) / (SELECT count(*) FROM base) AS share FROM c JOIN base b ON b.conf >= c.conf GROUP BY c.conf) SELECT target, round(coalesce(max(share) FILTER (acc >= target), 0), 8) AS coverage FROM e, t GROUP BY target", "base"))
def coverage_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-04: the largest coverage that a threshold can cut off with the target accuracy."""
    return evaluation.coverage_at(log(spark, sf_dir), TARGETS).select("target", F.round("coverage", 8).alias("coverage"))


#: Calibration as a loop over bins would give it, each bin by its own filter.
_ECE = " + ".join(f"coalesce(abs(sum(ok) FILTER (conf > {b / 10} AND conf <= {(b + 1) / 10}) - sum(conf) FILTER (conf > {b / 10} AND conf <= {(b + 1) / 10})), 0)" for b in range(10))


@query("build_compare", duck(f""", i AS (SELECT id FROM base INTERSECT SELECT id FROM variant), eb AS (SELECT avg(ok) AS acc, ({_ECE}) / count(*) AS e FROM base SEMI JOIN i USING (id)), ev AS (SELECT avg(ok) AS acc, ({_ECE}) / count(*) AS e FROM variant SEMI JOIN i USING (id)),
j AS (SELECT count(*) AS n, avg((b.pred = v.pred)::int) AS agree, avg(abs(b.conf - v.conf)) AS dc FROM base b JOIN variant v ON b.id = v.id)
SELECT n, round(agree, 9) AS agree, round(dc, 7) AS mean_change, round(ev.e, 7) AS ece, round(eb.e, 7) AS base_ece, ev.acc >= eb.acc - 0.01 AND ev.e <= eb.e + 0.01 AND agree >= 0.97 AS gate FROM j, eb, ev""", "base", "variant"))
def build_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-10, AGG-14: agreement and mean change of confidence of two builds, and the release gate: accuracy, calibration, agreement."""
    out = evaluation.compare_builds(log(spark, sf_dir), log(spark, sf_dir, "variant"))
    return out.select("n", F.round("agree", 9).alias("agree"), F.round("mean_change", 7).alias("mean_change"), F.round("ece", 7).alias("ece"), F.round("base_ece", 7).alias("base_ece"), "gate")


_SUM = """, l AS (SELECT 'base' AS system, task AS suite, ok, conf FROM base UNION ALL SELECT 'variant', task, ok, conf FROM variant),
o AS (SELECT *, row_number() OVER (PARTITION BY system, suite ORDER BY conf DESC) AS k, count(*) OVER (PARTITION BY system, suite) AS n, avg(ok) OVER (PARTITION BY system, suite, conf) AS r FROM l),
w AS (SELECT *, min(k) OVER (PARTITION BY system, suite, conf) - 1 AS k0, max(k) OVER (PARTITION BY system, suite, conf) AS k1 FROM o),
a AS (SELECT *, (coalesce((SELECT sum(b.ok) FROM l b WHERE b.system = w.system AND b.suite = w.suite AND b.conf > w.conf), 0) + (k - k0) * r) / k AS acc FROM w)
SELECT system, suite, max(n)::BIGINT AS n, round(avg(ok), 8) AS acc, round(avg(1 - acc), 8) AS aurc, round(max(acc) FILTER (k = greatest(1, round_even(0.8 * n, 0))), 8) AS acc_80, round(max(acc) FILTER (k = greatest(1, round_even(0.5 * n, 0))), 8) AS acc_50,
round(coalesce(max(k1 / n) FILTER (k = k1 AND acc >= 0.95), 0), 8) AS coverage_95, round(avg((conf >= 0.9)::INT), 8) AS decided_90, round(1 - avg(ok) FILTER (conf >= 0.9), 8) AS error_90, round((""" + _ECE.replace("conf > 0.0 AND", "conf >= 0 AND") + ") / count(*), 6) AS ece FROM a GROUP BY system, suite"


@query("system_summary", duck(_SUM, "base", "variant"))
def system_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-22, WIN-04, AGG-05, AGG-06: systems by suites in one table: accuracy, risk against coverage, calibration, a policy."""
    logs = [log(spark, sf_dir, s).select(F.lit(s).alias("system"), F.col("task").alias("suite"), "ok", "conf") for s in ("base", "variant")]
    out = evaluation.summary(logs[0].unionByName(logs[1]))
    eight = ("acc", "aurc", "acc_80", "acc_50", "coverage_95", "decided_90", "error_90")
    return out.select("system", "suite", "n", *(F.round(c, 8).alias(c) for c in eight), F.round("ece", 6).alias("ece"))
