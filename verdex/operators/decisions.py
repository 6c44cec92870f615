"""Decisions over option scores: softmax, tournament, mixes, temperature, answers, and the prediction log's normal form."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an option that lost a round keeps before the distribution is normalised.
LOST = 1e-4


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def softmax(scores: Column, temperature: Column | float = 1.0) -> Column:
    """DEC-01: exp((x - max) / T), normalised."""
    t = F.lit(temperature) if isinstance(temperature, float) else temperature
    return shared(F.transform(scores, lambda x: F.exp((x - F.array_max(scores)) / t)))


def shared(weights: Column) -> Column:
    """Weights divided by their sum."""
    return F.transform(weights, lambda w: w / total(weights))


def first_largest(p: Column) -> Column:
    """PRJ-09: position from 0 of the first largest element."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def symmetrised(p: Column, reverse: Column) -> Column:
    """DEC-04: mean of the probabilities in the options' order and of those that were read with the options reversed."""
    return F.zip_with(p, F.reverse(reverse), lambda a, b: 0.5 * (a + b))


def experts(p: Column, q: Column, w: Column | float) -> Column:
    """DEC-05: p^(1 - w) q^w with a floor of 1e-12, normalised."""
    weight = F.lit(w) if isinstance(w, float) else w
    floor = lambda x: F.greatest(x, F.lit(1e-12))
    return shared(F.zip_with(p, q, lambda a, b: F.pow(floor(a), 1 - weight) * F.pow(floor(b), weight)))


def tail_spread(labels: Column, seen: Column) -> Column:
    """DEC-06: a probability for each label: what `seen` (label to probability) says, the rest of 1 shared evenly among labels
    that it lacks."""
    own = lambda x: F.get(F.map_values(F.map_filter(seen, lambda k, _: k == x)), F.lit(0))
    absent = F.size(F.filter(labels, lambda x: ~F.map_contains_key(seen, x)))
    rest = F.greatest(F.lit(0.0), 1 - total(F.map_values(seen)))
    return F.transform(labels, lambda x: F.coalesce(own(x), rest / absent))


def temperature(tokens: Column, options: Column, qtype: Column, bias: float, weights: tuple[float, float, float, float]) -> Column:
    """DEC-02: exp(b + w . f); features: log tokens - 6.5, log options - 1.2, yes/no question, score question."""
    f = [F.ln(F.greatest(tokens, F.lit(1)).cast("double")) - 6.5, F.ln(options.cast("double")) - 1.2, qtype.isin("noul", "boolean").cast("double"), (qtype == "score").cast("double")]
    return F.exp(F.lit(bias) + sum((w * x for w, x in zip(weights, f, strict=True)), F.lit(0.0)))


def rounds(n: int, limit: int, chunk: int, keep: int | None) -> int:
    """How many rounds n options play before they fit in one pass."""
    k = 0
    while n > limit:
        blocks = -(-n // chunk)
        best = keep or max(1, min(chunk // 2, limit // blocks))
        n, k = sum(min(best, min(chunk, n - i * chunk)) for i in range(blocks)), k + 1
    return k


def _winners(options: Column, chunk: int, best: Column):
    """Of a block, by its number, the best options."""

    def run(block: Column) -> Column:
        part = F.slice(options, block * chunk + 1, F.lit(chunk))
        ranked = F.array_sort(F.transform(part, lambda o, i: F.struct((-o["score"]).alias("s"), i.alias("i"), o.alias("o"))))
        return F.slice(F.transform(ranked, lambda x: x["o"]), F.lit(1), best)

    return run


def tournament(df: DataFrame, scores: str = "scores", limit: int = 588, chunk: int | None = None, keep: int | None = None, out: str = "probs") -> DataFrame:
    """DEC-03, SRT-04: df with the options' probabilities where one pass reads `limit` options at most.

    More options play in blocks of chunk (limit at most), whose distributions are softmaxes of their own; the best `keep` of
    a block (default: half a chunk, or as many as fit in one pass, 1 at least) go on, in the order of their probability,
    equal ones in that of the block; and so on until they fit. Losers of a round keep LOST, and each round is normalised.
    A row's rounds are columns, so it stays in one stage; how many there are follows from the longest row.
    """
    chunk = min(chunk or limit, limit)
    if keep is not None and keep >= chunk:
        raise ValueError("a block must lose an option")
    longest = df.agg(F.max(F.size(scores))).first()[0] or 0
    alive = F.transform(F.col(scores), lambda s, i: F.struct(i.alias("at"), s.alias("score")))
    df = df.withColumn("_alive0", alive)
    n = rounds(longest, limit, chunk, keep)
    for k in range(n):
        now, size = F.col(f"_alive{k}"), F.size(f"_alive{k}")
        blocks = F.ceil(size / chunk).cast("int")
        best = F.lit(keep) if keep else F.greatest(F.lit(1), F.least(F.lit(chunk // 2), F.floor(F.lit(limit) / blocks).cast("int")))
        winners = F.flatten(F.transform(F.sequence(F.lit(0), blocks - 1), _winners(now, chunk, best)))
        df = df.withColumn(f"_alive{k + 1}", F.when(size > limit, winners).otherwise(now))
    final = F.col(f"_alive{n}")
    p = softmax(F.transform(final, lambda o: o["score"]))
    place = lambda k, i: F.exists(F.col(f"_alive{k}"), lambda o: o["at"] == i)
    df = df.withColumn("_final", F.map_from_arrays(F.transform(final, lambda o: o["at"]), p))
    # a round of m options of which w go on is normalised by 1 + LOST (m - w), so an option is divided by its own and all earlier rounds
    share, scale = F.lit(None).cast("double"), F.lit(1.0)
    for k in range(n):
        scale = scale / (1 + LOST * (F.size(f"_alive{k}") - F.size(f"_alive{k + 1}")))
        df = df.withColumn(f"_scale{k}", scale)
    every = F.sequence(F.lit(0), F.size(scores) - 1)

    def prob(i: Column) -> Column:
        value = F.get(F.map_values(F.map_filter("_final", lambda a, _: a == i)), F.lit(0)) * (F.col(f"_scale{n - 1}") if n else F.lit(1.0))
        for k in range(n - 1, -1, -1):
            value = F.when(place(k, i) & ~place(k + 1, i), LOST * F.col(f"_scale{k}")).otherwise(value)
        return value

    df = df.withColumn(out, F.when(F.size(scores) > 0, F.transform(every, prob)))
    return df.drop("_final", *(f"_alive{k}" for k in range(n + 1)), *(f"_scale{k}" for k in range(n)))


def shortlist(df: DataFrame, options: str, query: str, cost: str, room: Column, sizes: tuple[int, ...] = (20, 10, 5)) -> DataFrame:
    """DEC-11: df with `route` and `kept`, the options (struct with vector and cost) that go into the question.

    All of them if their cost fits into room; else the nearest 20 by cosine to the query vector, else 10, else 5: the first
    that fit; none if even these don't.
    """
    dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    cosine = lambda v: dot(v, F.col(query)) / F.greatest(F.sqrt(dot(v, v)) * F.sqrt(dot(F.col(query), F.col(query))), F.lit(1e-12))
    ranked = F.transform(F.array_sort(F.transform(options, lambda o, i: F.struct((-F.round(cosine(o["vector"]), 9)).alias("d"), i.alias("i"), o.alias("o")))), lambda x: x["o"])
    df = df.withColumn("_ranked", ranked)
    fits = lambda a: total(F.transform(a, lambda o: o[cost].cast("double"))) <= room
    route, kept = F.when(fits(F.col(options)), "all"), F.when(fits(F.col(options)), F.col(options))
    for k in sizes:
        part = F.slice("_ranked", 1, k)
        route, kept = route.when(fits(part), f"shortlist_k{k}"), kept.when(fits(part), part)
    return df.withColumn("route", route.otherwise("error")).withColumn("kept", kept).drop("_ranked")


def truthy(text: Column) -> Column:
    """PRJ-14: whether a value, given as text, counts as true."""
    return F.coalesce(text.isin("true", "True", "1", "1.0"), F.lit(False))


def predictions(lines: DataFrame, column: str = "value") -> DataFrame:
    """PRJ-14: (id, task, ok, conf) of prediction lines in JSON.

    id or task_id; task, cfg or family; `correct` before `ok`, even if it is null; conf, else the largest of the
    probabilities if these are a map; an error without confidence is wrong and has none.
    """
    at = lambda path: F.get_json_object(F.col(column), f"$.{path}")
    has = F.array_contains(F.json_object_keys(column), "correct")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(column), "$.probs", "variant"))
    probs = F.when(kind.startswith("OBJECT"), F.from_json(at("probs"), "map<string,double>"))
    conf = F.coalesce(at("conf").try_cast("double"), F.array_max(F.map_values(probs)))
    failed = ~F.coalesce(at("err"), F.lit("")).isin("", "None") & conf.isNull()
    either = lambda *names: F.coalesce(*(F.when(at(n) != "", at(n)) for n in names))
    return lines.select(either("id", "task_id").alias("id"), either("task", "cfg", "family").alias("task"), (F.when(has, truthy(at("correct"))).otherwise(truthy(at("ok"))) & ~failed).alias("ok"), conf.alias("conf"))


def rollup(task: Column, prefixes: tuple[str, ...] = ("legalbench",)) -> Column:
    """PRJ-15: tasks that start with a prefix under that prefix."""
    out = task
    for p in prefixes:
        out = F.when(task.startswith(p), p).otherwise(out)
    return out


def with_suite(log: DataFrame, suite: DataFrame) -> DataFrame:
    """JOIN-11: predictions with the suite's qtype, n_opts and task; the prediction's own task where the suite has none."""
    meta = suite.select("id", "qtype", "n_opts", F.col("task").alias("_task"))
    return log.join(meta, "id", "left").withColumn("task", F.coalesce("_task", "task")).drop("_task")


def speed(seconds: Column) -> Column:
    """AGG-18: 100 less 20 per power of ten over a tenth of a second, within 0 and 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - 20 * F.log10(F.greatest(seconds, F.lit(1e-6)) / 0.1)))


def composite(accuracy: dict[str, Column], ece: Column, tv: Column, p50: Column, p95: Column, usd_per_1k: Column) -> dict[str, Column]:
    """AGG-18: intelligence, calibration, speed, cost and their geometric mean (each 1 at least), to one place.

    accuracy: by tier among hard (weight .30), easy (.14) and original (.56), weights of absent tiers left out; tv may be null.
    """
    weight = {"hard": 0.30, "easy": 0.14, "original": 0.56}
    mass = sum(weight[t] for t in accuracy)
    intelligence = F.round(100 * sum((weight[t] * a for t, a in accuracy.items()), F.lit(0.0)) / mass, 1)
    near = 100 * (1 - ece / 0.5)
    calibration = F.round((near + F.coalesce(100 * (1 - tv), near)) / 2, 1)
    fast = F.round((speed(2 * p50 + 0.15) + speed(2 * p95 + 0.15)) / 2, 1)
    cost = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - 30 * F.log10(usd_per_1k / 0.001))), 1)
    axes = (intelligence, calibration, fast, cost)
    score = F.round(F.exp(sum((0.25 * F.ln(F.greatest(x, F.lit(1.0))) for x in axes), F.lit(0.0))), 1)
    return {"intelligence": intelligence, "calibration": calibration, "speed": fast, "cost": cost, "score": score}


# --- calibration -----------------------------------------------------------------------------------------------------


def fit_temperature(rows: pd.DataFrame, features: bool, hard_weight: float = 3.0, least: int = 80, steps: int = 400, rate: float = 0.05) -> tuple[float, list[float]]:
    """CAL-01: (b, w) of T = exp(b + w . f) with the least weighted log loss of gold, by Adam over all rows.

    rows: logits, target, n_tok, n_opts, qtype, difficulty, src. Only generated items count if there are `least` of them;
    hard items weigh hard_weight; gold is the first largest target. Without features w stays 0.
    """
    generated = rows[rows["src"].fillna("").replace("", "gen") == "gen"]
    rows = generated if len(generated) >= least else rows
    if not len(rows):
        return 0.0, [0.0] * 4
    width = max(len(x) for x in rows["logits"])
    z = np.full((len(rows), width), -np.inf)
    for i, x in enumerate(rows["logits"]):
        z[i, : len(x)] = x
    gold = np.array([int(np.argmax(t)) for t in rows["target"]])
    f = np.stack([np.log(np.maximum(rows["n_tok"], 1)) - 6.5, np.log(rows["n_opts"]) - 1.2, rows["qtype"] == "noul", rows["qtype"] == "score"], 1).astype(float)
    weight = np.where(rows["difficulty"] == "hard", hard_weight, 1.0)
    x = np.concatenate([np.ones((len(rows), 1)), f if features else np.zeros_like(f)], 1)
    theta, m, v = np.zeros(5), np.zeros(5), np.zeros(5)
    at, real = z[np.arange(len(z)), gold], np.where(np.isfinite(z), z, 0.0)
    for k in range(1, steps + 1):
        t = np.exp(x @ theta)[:, None]
        s = z / t
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        slope = weight * ((at[:, None] / t)[:, 0] - (p * real).sum(1) / t[:, 0])  # of the loss, by log T
        g = x.T @ slope / weight.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return float(theta[0]), theta[1:].tolist()


def crossfit_temperature(df: DataFrame, grid: tuple[float, ...] = tuple(0.25 * k for k in range(1, 41))) -> DataFrame:
    """CAL-02: (applied_to, qtype, n_opts, t) from (id, qtype, n_opts, probs, ok): in each fold and group of questions the grid's
    first temperature of least log loss on whether the predicted label is right, for use on the other fold.

    One pass: each grid point is an aggregate of its own.
    """
    fold = F.conv(F.right(F.sha1(F.col("id").cast("string")), F.lit(1)), 16, 10).cast("int") % 2
    logs = df.select(fold.alias("fold"), "qtype", "n_opts", "ok", F.transform("probs", lambda v: F.ln(F.greatest(v, F.lit(1e-9)))).alias("lg"))
    logs = logs.withColumn("top", F.array_max("lg"))

    def loss(t: float) -> Column:
        p = 1 / total(F.transform("lg", lambda x: F.exp((x - F.col("top")) / t)))
        return F.round(F.sum(-F.ln(F.greatest(F.when(F.col("ok"), p).otherwise(1 - p), F.lit(1e-9)))), 7)

    told = logs.groupBy("fold", "qtype", "n_opts").agg(F.array(*(loss(t) for t in grid)).alias("losses"))
    best = F.get(F.array(*map(F.lit, grid)), first_largest(F.transform("losses", lambda x: -x)))
    return told.select((1 - F.col("fold")).alias("applied_to"), "qtype", "n_opts", best.alias("t"))


def log_loss(rows: pd.DataFrame, b: float, w: list[float]) -> float:
    """Mean log loss of gold under T = exp(b + w . f), in plain Python."""
    out = 0.0
    for r in rows.itertuples():
        f = [math.log(max(r.n_tok, 1)) - 6.5, math.log(r.n_opts) - 1.2, float(r.qtype == "noul"), float(r.qtype == "score")]
        t = math.exp(b + sum(x * y for x, y in zip(w, f, strict=True)))
        s = [x / t for x in r.logits]
        out -= s[int(np.argmax(r.target))] - max(s) - math.log(sum(math.exp(x - max(s)) for x in s))
    return out / max(len(rows), 1)
