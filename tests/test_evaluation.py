"""Release gate, calibration and risk against coverage, against plain Python on rows that tell wrong forms from right ones."""

import collections
import random

import pytest

from verdex.operators import evaluation

SCHEMA = "id long, pred string, ok int, conf double"


def plain_ece(rows):
    out = 0.0
    for b in range(10):
        own = [(c, ok) for _, _, ok, c in rows if b / 10 < c <= (b + 1) / 10]
        if own:
            out += len(own) / len(rows) * abs(sum(ok for _, ok in own) / len(own) - sum(c for c, _ in own) / len(own))
    return out


def plain_curve(rows):
    groups = collections.defaultdict(list)
    for _, _, ok, c in rows:
        groups[c].append(ok)
    accs, k, right = [], 0, 0
    for c in sorted(groups, reverse=True):
        g = groups[c]
        accs += [(right + j * sum(g) / len(g)) / (k + j) for j in range(1, len(g) + 1)]
        k, right = k + len(g), right + sum(g)
    at = lambda x: accs[max(1, round(x * len(rows))) - 1]
    return sum(1 - a for a in accs) / len(accs), at(0.8), at(0.5)


@pytest.mark.parametrize("n", [1, 2, 5, 7, 9, 11, 300])
def test_risk_coverage(spark, n):
    """n = 7: 0.5 n rounds to 4 and not 3; n = 5 and 9: a half goes to the even number, 2 and 4."""
    r = random.Random(n)
    rows = [(i, "a", int(r.random() < 0.6), r.choice([0.0, 0.1, 0.3, 0.30000000000000004, 0.7, 1.0, r.random()])) for i in range(n)]
    df = spark.createDataFrame(rows + [(900, "a", None, 0.5), (901, "a", 1, None)], SCHEMA)
    got = evaluation.risk_coverage(df).first()
    assert got["n"] == n
    assert [got["aurc"], got["acc_80"], got["acc_50"]] == pytest.approx(plain_curve(rows), abs=1e-12)
    assert evaluation.ece(df).first()["ece"] == pytest.approx(plain_ece(rows), abs=1e-12)


def test_gate_needs_calibration(spark):
    """Equal answers with other confidence: only the calibration error closes the gate."""
    base = [(i, "a", int(i % 10 < 9), 0.9) for i in range(100)]
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    gate = lambda rows: evaluation.compare_builds(frame(base), frame(rows)).first()
    assert gate(base)["gate"]
    odd = gate([(i, p, ok, 0.5) for i, p, ok, _ in base])
    assert (odd["gate"], odd["acc"], odd["agree"]) == (False, odd["base_acc"], 1.0)
    assert odd["ece"] == pytest.approx(plain_ece([(0, "a", ok, 0.5) for _, _, ok, _ in base]))
    assert not gate([(i, "b" if i < 4 else p, ok, c) for i, p, ok, c in base])["gate"]  # 96 % agree
    assert not gate([(i, p, 0 if i in (0, 1) else ok, c) for i, p, ok, c in base])["gate"]  # two points fewer
    assert tuple(gate([(500, "a", 1, 0.5)]))[0] == 0


def test_coverage_at(spark):
    rows = [(1, "a", 1, 0.9), (2, "a", 1, 0.8), (3, "a", 0, 0.8), (4, "a", 1, 0.2)]
    got = {r["target"]: r["coverage"] for r in evaluation.coverage_at(spark.createDataFrame(rows, SCHEMA), (0.5, 0.7, 0.99, 1.0)).collect()}
    assert got == {0.5: 1.0, 0.7: 1.0, 0.99: 0.25, 1.0: 0.25}
