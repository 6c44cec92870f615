"""Nearest vectors against brute force: ties, copies, vectors without direction, split lists."""

import math
import random

import numpy as np
import pytest

from verdex.operators import vectors


def data():
    r = random.Random(7)
    rows = [(i, [r.gauss(0, 1) + (i % 5) for _ in range(6)]) for i in range(260)]
    rows += [(300 + i, rows[4][1]) for i in range(60)]  # copies
    return rows + [(400, None), (401, [0.0] * 6), (None, [1.0] * 6)]


def brute(rows, asked, k):
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b)), 9)
    real = [(i, v) for i, v in rows if i is not None and v and any(v)]
    out = {}
    for i, v in real:
        if i in asked:
            out[i] = [j for _, j in sorted((-cos(v, w), j) for j, w in real if j != i)[:k]]
    return out


@pytest.fixture(scope="module")
def frames(spark):
    df = spark.createDataFrame(data(), "vec_id long, embedding array<double>").repartition(4)
    asked = {i for i, _ in data() if i is not None and (i % 10 == 0 or i == 401)}
    return df, df.filter("vec_id % 10 = 0 OR vec_id = 401"), brute(data(), asked, 7)


def lists(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append(r["neighbour"])
    return out


@pytest.mark.parametrize("block", [4096, 8])
def test_exact(frames, block):
    df, asked, want = frames
    assert lists(vectors.exact_top_k(df, asked, 7, block=block)) == want


def test_index_with_all_lists_is_exact(frames, monkeypatch):
    df, asked, want = frames
    monkeypatch.setattr(vectors, "LIST_ROWS", 25)
    monkeypatch.setattr(vectors, "LIST_QUERIES", 4)
    centroids = vectors.fit_centroids(df, 6)
    assert len(centroids) == 6
    assert lists(vectors.index_top_k(df, asked, centroids, 7, 6)) == want
    few = vectors.index_top_k(df, asked, centroids, 7, 3)
    assert vectors.recall(few, vectors.exact_top_k(df, asked, 7)).first()["recall"] >= 0.7
    assert vectors.assign(df, centroids).count() == len([1 for i, v in data() if i is not None and v and any(v)])


def test_recall_and_shortlists(spark):
    exact = spark.createDataFrame([(1, 2, 0.9, 1), (1, 3, 0.5, 2), (2, 1, 0.9, 1)], "id long, neighbour long, cos double, rank int")
    found = spark.createDataFrame([(1, 2, 0.9, 1), (1, 9, 0.4, 2)], "id long, neighbour long, cos double, rank int")
    assert tuple(vectors.recall(found, exact).first()) == (3, pytest.approx(1 / 3))
    got = {(r["id"], r["size"]): r["options"] for r in vectors.shortlists(exact, (2, 1)).collect()}
    assert got == {(1, 2): [2, 3], (1, 1): [2], (2, 2): [1], (2, 1): [1]}


def test_nothing_to_search(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert vectors.exact_top_k(empty, one, 3).count() == vectors.exact_top_k(one, empty, 3).count() == vectors.exact_top_k(one, one, 3).count() == 0
    assert vectors.index_top_k(one, one, np.array([[1.0, 0.0]]), 3).count() == 0
