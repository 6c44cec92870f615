"""Edge rules that the tables don't have: literal rows for detectors, readers, n-grams and streams."""

import json

import pytest
from pyspark.sql import functions as F

from verdex.functions import privacy as P
from verdex.functions import text as T
from verdex.operators.overlap import both_ways, containment
from verdex.sources import readers as R
from verdex.streaming import jobs


def told(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r"))
    return [r["r"] for r in sorted(rows.collect())]


def test_checksums(spark):
    assert told(spark, P.cpf_ok, "529.982.247-25", "529.982.247-24", "111.111.111-11", "12") == [True, False, False, False]
    assert told(spark, P.cnpj_ok, "11.222.333/0001-81", "11.222.333/0001-80") == [True, False]
    assert told(spark, P.card_ok, "4539 1488 0343 6467", "4539 1488 0343 6468", "4111111111111111", "9012888888881881") == [True, False, False, False]
    assert told(spark, P.ssn_ok, "219-09-9999", "000-12-3456", "666-12-3456", "912-12-3456", "219-00-9999", "219-09-0000", "123-45-6789") == [True, *[False] * 6]
    assert told(spark, P.iban_ok, "GB82 WEST 1234 5698 7654 32", "GB83 WEST 1234 5698 7654 32", "DE89370400440532013000", "DE8") == [True, False, True, False]


def test_ipv4_class(spark):
    assert told(spark, P.ipv4_class, "192.0.2.7", "127.0.0.1", "10.1.2.3", "172.31.0.1", "8.8.8.8", "256.1.1.1") == ["documentation", "loopback", "private", "private", "public", None]


def test_words_are_unicode(spark):
    assert told(spark, T.words, "Été à là_1, x", None, "") == [["été", "à", "là_1", "x"], [], []]


@pytest.mark.parametrize("n, grams", [(0, 0), (7, 0), (8, 1), (9, 2)])
def test_ngrams(spark, n, grams):
    assert told(spark, lambda v: F.size(T.word_ngrams(T.words(v))), " ".join(f"w{i}" for i in range(n))) == [grams]


def test_containment(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text), (2, text + " tail"), (3, "other words only")], "id long, t string").select("id", T.words(F.col("t")).alias("w"))
    items = spark.createDataFrame([(9, text)], "pid long, t string").select("pid", T.words(F.col("t")).alias("w"))
    assert {r["id"]: r["containment"] for r in containment(docs, items).collect()} == {1: 1.0, 2: 13 / 14}
    assert {(r["id"], r["shared"]) for r in both_ways(docs, items).collect()} == {(1, 13), (2, 13)}


def test_readers(spark, tmp_path):
    (tmp_path / "core").mkdir()
    good, bad = tmp_path / "core" / "train.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"id": "a", "x": 1}\n{"id": "b", "x": 2}\n')
    bad.write_text('{"id": "a", "x": 1}\n{"id": \n')
    schema = "id string, x long"
    assert R.read_jsonl(spark, str(good), schema).count() == 2
    assert len(R.read_jsonl(spark, str(bad), schema, strict=False).collect()) == 1
    with pytest.raises(Exception):
        R.read_jsonl(spark, str(bad), schema).collect()
    assert R.bad_lines(spark, str(bad)).first()[0] == 1
    assert R.read_optional(spark, str(tmp_path / "none.jsonl"), schema).count() == 0
    row = R.read_directory(spark, str(tmp_path / "core"), schema).first()
    assert (row["config"], row["split"], row["file_rank"]) == ("core", "train", 1)
    (tmp_path / "one.json").write_text('{\n"id": "z",\n"x": 5}')
    assert R.read_document(spark, str(tmp_path / "one.json"), schema).first()["x"] == 5
    assert R.read_whole_texts(spark, str(tmp_path / "core")).count() == 1
    (tmp_path / "needles.txt").write_text(" a \n\n b\n")
    assert {r[0] for r in R.read_needles(spark, str(tmp_path / "needles.txt")).collect()} == {"a", "b"}


def test_sinks(spark, tmp_path):
    items = spark.createDataFrame([("b", "core", "train"), ("a", "core", "train"), ("c", "core", "dev")], "id string, config string, split string")
    R.write_splits(items, str(tmp_path / "out"))
    lines = [json.loads(x)["id"] for f in (tmp_path / "out" / "config=core" / "split=train").glob("*.json") for x in f.read_text().splitlines()]
    assert lines == ["a", "b"]
    R.write_report(items.groupBy("split").count(), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2
    assert R.fixed_width(items.orderBy("id")).splitlines()[1].split() == ["a", "core", "train"]
    assert R.generate_rows(spark, 50).collect() == R.generate_rows(spark.newSession(), 50).repartition(7).orderBy("id").collect()


def test_label_stream(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(10)], "id long").coalesce(2).write.json(str(tmp_path / "in"))
    items = spark.readStream.schema("id long").json(str(tmp_path / "in"))
    scorer = lambda df: df.withColumn("label", F.when(F.col("id") % 4 != 0, "yes"))
    for _ in range(2):  # the second run finds nothing new
        jobs.label_stream(items, scorer, str(tmp_path / "out"), str(tmp_path / "failed"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7
    assert {r["id"] for r in spark.read.parquet(str(tmp_path / "failed")).collect()} == {0, 4, 8}


def test_label_stream_stops_at_its_target(spark, tmp_path):
    for k in range(5):
        spark.createDataFrame([(10 * k + i,) for i in range(10)], "id long").coalesce(1).write.json(str(tmp_path / "in" / f"{k}"))
    items = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    scorer = lambda df: df.withColumn("label", F.lit("yes")).withColumn("agree", F.col("id") % 2 == 0)
    q = jobs.label_stream(items, scorer, str(tmp_path / "out"), str(tmp_path / "failed"), str(tmp_path / "check"), all_there=False)
    agreed = lambda: sum(spark.read.parquet(str(p)).filter("agree").count() for p in (tmp_path / "out").glob("batch=*") if (p / "_SUCCESS").exists())
    assert 12 <= jobs.stop_at(q, agreed, 12) <= 25 and not q.isActive
    jobs.label_stream(items, scorer, str(tmp_path / "out"), str(tmp_path / "failed"), str(tmp_path / "check")).awaitTermination()
    assert agreed() == 25  # the rest comes with a later run, none twice


def test_sessions_keep_their_state(spark, tmp_path):
    """The requests of a log in two triggers of a stream give what the whole log gives."""
    from verdex.plans.streams import REQUESTS

    schema = "session string, seq long, op string, text string"
    for k, part in enumerate(([r[:4] for r in REQUESTS if r[1] < 4], [r[:4] for r in REQUESTS if r[1] >= 4])):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / "in" / f"{k}"))
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    got = jobs.drain(spark, jobs.sessions(rows, lambda text, question: str(text.count(question))), "append").collect()
    assert {(r["session"], r["seq"]): (r["status"], r["chars"], r["answer"]) for r in got} == {(s, k): tuple(x) for s, k, _, _, *x in REQUESTS}


def test_tolerant_lines_dont_depend_on_the_columns(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a", "x": 1}\n{"id": "b", "x": "text"}\n{"id": \n\n')
    df = R.read_jsonl(spark, str(tmp_path / "x.jsonl"), "id string, x long", strict=False)
    assert df.count() == len(df.collect()) == df.select("id").count() == len(df.select("id").collect()) == 1


def test_token_batches(spark):
    got = jobs.token_batches(spark.createDataFrame([(i, 1000) for i in range(20)], "id long, n_chars long"), budget=1000, most=3).collect()
    assert sorted(r["batch"] for r in got) == [i // 3 for i in range(20)]
