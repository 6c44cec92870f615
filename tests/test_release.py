"""Layered reading, truncation, first copies, drop lists, and one table of systems by suites."""

import json
import re

from pyspark.sql import functions as F

from verdex.functions import privacy
from verdex.operators import curation, evaluation, textops
from verdex.plans import registry
from verdex.sources import readers

SF = "/root/testdata/sf0.001"


def test_later_files_override(spark, tmp_path):
    for k, rows in enumerate(([{"id": "a", "v": 1}, {"id": "b", "v": 1}, {"id": "a", "v": 2}], [{"id": "b", "v": 3}], [{"id": "c", "v": None}, {"v": 9}])):
        (tmp_path / f"{k}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows) + "no json\n")
    paths = [str(tmp_path / f"{k}.jsonl") for k in range(3)]
    got = readers.read_layered(spark, ",".join(paths), "id string, v int")
    assert {r["id"]: r["v"] for r in got.collect()} == {"a": 2, "b": 3, "c": None, None: 9}
    assert {r["id"]: r["v"] for r in readers.read_layered(spark, paths[::-1], "id string, v int").collect()}["b"] == 1
    assert readers.read_layered(spark, [], "id string, v int").count() == 0


def test_truncation(spark):
    def plain(s, budget):
        for _ in range(4):
            n = len(s) + 10
            if n <= budget:
                return s, True
            keep = int(len(s) * budget / n * 0.9)
            s = s[: int(keep * 0.7)] + "\n[...]\n" + s[-int(keep * 0.3) :]
        return s, False

    texts = ["", "short", "é" * 120, "".join(chr(97 + i % 26) for i in range(5000)), "x" * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "id int, s string").withColumn("n", F.lit("clash"))
    for budget in (200, 100, 40):
        got = {r["id"]: (r["s"], r["fits"]) for r in textops.truncated(df, "s", lambda s: F.length(s) + 10, budget).collect()}
        assert got == {i: plain(t, budget) for i, t in enumerate(texts)} | {99: (None, True)}


def test_first_copies(spark):
    rows = [(3, "x", "a"), (1, "x", "a"), (2, "x", None), (4, "y", "b"), (5, "y", "b"), (6, None, None), (7, None, None), (8, "z", "")]
    got = curation.keep_first(spark.createDataFrame(rows, "id int, t string, y string"), F.col("t"), "id", "id", "y")
    assert sorted(map(tuple, got.collect())) == [(1, 3, True), (4, 2, False), (6, 2, False), (8, 1, False)]


def test_drop_list_is_applied(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    told = {r["id"]: r["reports"] for r in registry.queries()["drop_list_union"](spark, SF).collect()}
    mail = re.compile(r"[\w.+-]+@(?:gmail|hotmail|outlook|yahoo)\.com\b", re.I)
    for d in docs:
        own = labels.get(d["doc_id"])
        least = (own is not None and own["toxic"] == 1) + (own is not None and own["quality"] == 0)
        assert least <= told.get(d["doc_id"], 0) <= least + 1
        if mail.search(d["text"] or ""):
            assert told.get(d["doc_id"], 0) == least + 1
    left = {r["id"] for r in registry.queries()["released_rows"](spark, SF).collect()}
    assert left == {d["doc_id"] for d in docs} - set(told) and left and told
    assert privacy.findings is not None


def test_summary_of_keys(spark):
    rows = [("s", "a", 1, 0.9), ("s", "a", 0, 0.0), ("s", "b", 1, 0.2), ("t", "a", 0, 0.95), ("t", "a", None, 0.5)]
    got = {(r["system"], r["suite"]): r for r in evaluation.summary(spark.createDataFrame(rows, "system string, suite string, ok int, conf double")).collect()}
    assert set(got) == {("s", "a"), ("s", "b"), ("t", "a")}
    one = got["s", "a"]
    assert (one["n"], one["acc"], one["acc_80"], one["acc_50"], one["decided_90"], one["error_90"], one["coverage_95"]) == (2, 0.5, 0.5, 1.0, 0.5, 0.0, 0.5)
    assert abs(one["aurc"] - 0.25) < 1e-12 and abs(one["ece"] - 0.05) < 1e-12
    assert got["s", "b"]["error_90"] is None and got["t", "a"]["error_90"] == 1.0


def test_quota_numbers_every_row(spark):
    """Rows of a source without a quota have their running count too, and none is cut; a null key is a key."""
    rows = [(f"d{i}", ("en", "de", None)[i % 3], ("a", "b", "free", None)[i % 4], i // 2) for i in range(600)]
    want, count = {}, {}
    for id, file, src, ord in sorted(rows, key=lambda r: (r[3], r[0])):
        n = count[file, src] = count.get((file, src), 0) + 1
        if n <= {"a": 3, "b": 7}.get(src, n):
            want[id] = n
    df = spark.createDataFrame(rows, "id string, file string, src string, ord long").repartition(5)
    got = curation.first_of_each(df, {"a": 3, "b": 7}).collect()
    assert {r["id"]: r["place"] for r in got} == want and len(got) == len(want)
    assert {r["id"]: r["place"] for r in curation.first_of_each(df.filter("src = 'free'"), {}).collect()} == {k: v for k, v in want.items() if int(k[1:]) % 4 == 2}


def test_quota_cuts_no_source_without_one(spark):
    """Items without a source (`gen`) have no quota in quota_by_source: each of them is there, with its number."""
    got = registry.queries()["quota_by_source"](spark, SF).filter("src = 'gen'").collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").filter("source = 'src19'").count()
    assert sorted((r["file"], r["place"]) for r in got) == [(f, k + 1) for f in sorted({r["file"] for r in got}) for k in range(sum(r["file"] == f for r in got))]
