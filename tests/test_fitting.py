"""The distributed temperature fit against the local one, which takes many steps of another method over the same rows."""

import random

import pandas as pd
import pytest

from verdex.operators import decisions, fitting

SCHEMA = "logits array<double>, target array<double>, n_tok int, n_opts int, qtype string, difficulty string, src string"


def log(n, seed, src="gen"):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        k = r.choice([2, 3, 5])
        gold = r.randrange(k)
        z = [r.gauss(0, 2) + (1.5 if i == gold else 0) for i in range(k)]
        rows.append((z, [float(i == (gold if r.random() < 0.9 else 0)) for i in range(k)], r.randint(20, 3000), k, r.choice(["choice", "noul", "score"]), r.choice(["hard", "easy", None]), r.choice([src, ""]) if src == "gen" else src))
    return rows


@pytest.mark.parametrize("features", [False, True])
def test_equals_the_local_fit(spark, features):
    rows = log(300, 1) + log(100, 2, "other")
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    b, w = fitting.fit_temperature(df, features)
    local = decisions.fit_temperature(pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")]), features, steps=12_000, rate=0.01)
    assert b == pytest.approx(local[0], abs=1e-6)
    assert w == pytest.approx(local[1], abs=1e-6)


def test_few_generated_rows_and_none(spark):
    rows = log(60, 3) + log(100, 4, "other")
    frame = pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])
    b, _ = fitting.fit_temperature(spark.createDataFrame(rows, SCHEMA), False)
    assert b == pytest.approx(decisions.fit_temperature(frame, False, steps=6000, rate=0.01)[0], abs=1e-6)  # all rows count
    assert fitting.fit_temperature(spark.createDataFrame([], SCHEMA)) == (0.0, [0.0] * 4)
    one = [([2.0, 0.0], [1.0, 0.0], 665, 2, "choice", None, "gen")] * 3 + [([2.0, 0.0], [0.0, 1.0], 665, 2, "choice", None, "gen")]
    b, w = fitting.fit_temperature(spark.createDataFrame(one, SCHEMA), False)
    import math

    assert 2 / math.exp(b) == pytest.approx(math.log(3), abs=1e-8)  # three of four are right
