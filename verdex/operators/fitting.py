"""CAL-01: fits whose gradient and curvature are aggregates: each step of Newton's method is one pass of sums over all rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdex.operators.decisions import first_largest, total

#: Names of what a temperature depends on, besides a constant.
FEATURES = ("tokens", "options", "noul", "score")


def minimise(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], size: int, steps: int = 60, tolerance: float = 1e-9) -> np.ndarray:
    """The least point of a smooth function from (value, gradient, Hessian), by damped Newton steps from 0.

    A step that doesn't lower the value is taken again with more damping. Directions along which the function is flat stay 0.
    """
    x, damping = np.zeros(size), 0.0
    value, g, h = evaluate(x)
    for _ in range(steps):
        scale = max(np.abs(h).max(), 1e-12)
        if np.abs(g).max() <= tolerance:
            break
        step = np.linalg.lstsq(h + damping * scale * np.eye(size), -g, rcond=1e-10)[0]
        if step @ g >= 0:  # not downhill, as the function isn't convex here
            damping = max(10 * damping, 1e-3)
            continue
        new = evaluate(x + step)
        if new[0] <= value + 1e-15 * abs(value):
            x, (value, g, h), damping = x + step, new, damping / 10 if damping > 1e-8 else 0.0
            if np.abs(step).max() <= tolerance:
                break
        else:
            damping = max(10 * damping, 1e-4)
    return x


def temperature_rows(log: DataFrame, features: bool, hard_weight: float, least: int) -> DataFrame:
    """(z, gold, wt, f0...): logits, the index of gold, the weight and the features of the rows that count."""
    generated = F.coalesce(F.col("src"), F.lit("")).isin("", "gen")
    rows = log.filter(F.size("logits") > 0)
    if rows.filter(generated).limit(least).count() >= least:
        rows = rows.filter(generated)
    f = [F.ln(F.greatest(F.col("n_tok"), F.lit(1))) - 6.5, F.ln("n_opts") - 1.2, (F.col("qtype") == "noul").cast("double"), (F.col("qtype") == "score").cast("double")]
    of = [F.coalesce(x, F.lit(0.0)).alias(f"f{i}") for i, x in enumerate(f, 1)] if features else []
    return rows.select(F.transform("logits", lambda x: x.cast("double")).alias("z"), first_largest(F.col("target")).alias("gold"), F.when(F.col("difficulty") == "hard", hard_weight).otherwise(1.0).alias("wt"), F.lit(1.0).alias("f0"), *of)


def _sums(rows: DataFrame, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean weighted loss with its gradient and Hessian in theta, from one aggregate of 2 + n + n (n + 1) / 2 sums.

    With a = z exp(-u), u = theta . f, and p its softmax: the loss is ln sum exp a - a[gold], its slope by u is
    a[gold] - E a, and the slope of that is Var a + E a - a[gold], under p.
    """
    n = len(theta)
    u = sum((F.lit(float(t)) * F.col(f"f{i}") for i, t in enumerate(theta)), F.lit(0.0))
    step = rows.withColumn("a", F.transform("z", lambda x: x * F.exp(-u))).withColumn("top", F.array_max("a"))
    step = step.withColumn("e", F.transform("a", lambda x: F.exp(x - F.col("top"))))
    dot: Callable[[Callable[[Column, Column], Column]], Column] = lambda g: total(F.zip_with("a", "e", g))
    step = step.select("wt", *(f"f{i}" for i in range(n)), F.get("a", F.col("gold")).alias("at"), "top", total(F.col("e")).alias("s"), dot(lambda a, e: a * e).alias("m1"), dot(lambda a, e: a * a * e).alias("m2"))
    mean = F.col("m1") / F.col("s")
    step = step.select("wt", *(f"f{i}" for i in range(n)), (F.col("top") + F.ln("s") - F.col("at")).alias("loss"), (F.col("at") - mean).alias("d1"), (F.col("m2") / F.col("s") - mean * mean + mean - F.col("at")).alias("d2"))
    wt = F.col("wt")
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    sums = [F.sum(wt), F.sum(wt * F.col("loss")), *(F.sum(wt * F.col("d1") * F.col(f"f{i}")) for i in range(n)), *(F.sum(wt * F.col("d2") * F.col(f"f{i}") * F.col(f"f{j}")) for i, j in pairs)]
    got = np.array([x or 0.0 for x in step.agg(*(s.alias(f"s{k}") for k, s in enumerate(sums))).first()], float)
    weight = got[0] or 1.0
    h = np.zeros((n, n))
    for (i, j), x in zip(pairs, got[2 + n :], strict=True):
        h[i, j] = h[j, i] = x / weight
    return got[1] / weight, got[2 : 2 + n] / weight, h


def fit_temperature(log: DataFrame, features: bool = True, hard_weight: float = 3.0, least: int = 80) -> tuple[float, list[float]]:
    """(b, w) of the temperature exp(b + w . f) with the least weighted log loss of gold, over all rows of a log of any size.

    log: logits, target, n_tok, n_opts, qtype, difficulty, src. Only generated items count if there are `least` of them; hard
    items weigh hard_weight; gold is the first largest target; rows without logits don't count. Without features w stays 0,
    and so does what no row tells apart. An empty log gives zeros. A step sends its sums to the driver and nothing else.
    """
    rows = temperature_rows(log, features, hard_weight, least).persist()
    try:
        theta = minimise(lambda x: _sums(rows, x), 1 + len(FEATURES) * features)
    finally:
        rows.unpersist()
    return float(theta[0]), [float(x) for x in theta[1:]] if features else [0.0] * len(FEATURES)
