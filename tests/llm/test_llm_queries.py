"""The subpackage's queries: against SQL where there is some, and the pipeline stage by stage."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdex.llm import queries, sentencepiece_codec, stages, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    told = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in told.description]
    want = {tuple(r[columns.index(c)] for c in sorted(columns)) for r in told.fetchall()}
    df = queries.queries()[name](spark, SF)
    assert {tuple(r[c] for c in sorted(columns)) for r in df.collect()} == want


def test_pipeline(spark):
    """Each stage on what is left by the one before, against brute force; the classifier by its own scores, the ids by the library."""
    import sentencepiece
    from test_operators import brute_components, brute_hits

    docs = stages.table(spark, SF, "documents").withColumn("n", F.lit("x")).withColumn("digest", F.lit(1))
    items = [tuple(r) for r in stages.table(spark, SF, "benchmark").collect() if r["text"]]
    longest = max(len(re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())) for _, t in items)
    model = toxicity.fit(stages.table(spark, SF, "documents"), stages.table(spark, SF, "labels"))
    left = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for name, stage in stages.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        ids = sorted(left)
        if name == "toxicity":
            scores = dict(zip(ids, model.scores(pa.array([left[i] for i in ids])), strict=True))
            want = {i for i in ids if scores[i] < toxicity.THRESHOLD}
        elif name == "exact_dedup":
            texts = {}
            for i in ids:
                texts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i]), i)
            want = set(texts.values())
        elif name == "ngram_jaccard":
            want = {c for _, c in brute_components([(i, left[i]) for i in ids]).values()}
        else:
            want = {i for i in ids if not brute_hits(left[i], items, longest)}
        docs = spark.createDataFrame(after.collect(), after.schema)
        assert {r["doc_id"] for r in docs.collect()} == want, name
        assert docs.count() == len(want), name
        left = {i: left[i] for i in want}
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    got = {r["doc_id"]: (r["n_tokens"], r["ids"]) for r in stages.run(spark, SF).collect()}
    assert got == {i: (len(library.encode(t)), library.encode(t)) for i, t in left.items()}


def test_stages_take_any_rows(spark, tmp_path):
    """Null ids, texts and sources, empty and long texts, repeated rows, clashing names; then no rows at all."""
    rows = [(1, None, "en", None, 0), (2, "", "en", "s", 0), (None, "a b c d e f", None, "s", 9), (3, "a  b c d e f", "en", "s", 9), (3, "a  b c d e f", "en", "s", 9), (4, "long " * 30_000, "en", "s", 1), (5, "the whole item of the benchmark stands in here", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for n, name in ((len(rows), "some"), (0, "none")):
        at = f"{tmp_path}/{name}"
        df = spark.createDataFrame(rows[:n], schema).coalesce(1)
        df.write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(1, 1, None), (2, 0, 0), (4, 1, 0)][: n and 3], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, "The whole item of the benchmark"), (None, "x"), (2, None)][: n and 3], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        for extra in ("_hits", "hits", "_digest", "_n", "_gone", "label", "node", "score", "ids"):
            df = df.withColumn(extra, F.lit(extra))
        kept = {}
        for stage, f in stages.STAGES:
            out = f(spark, df, at)
            kept[stage] = sorted(r["doc_id"] or 0 for r in out.collect())
            if stage != "sentencepiece":
                assert out.columns == df.columns
        if n:
            assert kept == {"toxicity": [0, 1, 2, 3, 3, 4, 5], "exact_dedup": [1, 3, 4, 5], "ngram_jaccard": [0, 1, 2, 3, 3, 4, 5], "decontamination": [0, 1, 2, 3, 3, 4], "sentencepiece": [0, 1, 2, 3, 3, 4, 5]}
        else:
            assert all(v == [] for v in kept.values())


def edge_tables(spark, at):
    """A folder with documents and labels that have nulls, empty and long texts, copies, and doc_ids of both held-out kinds."""
    r = random.Random(3)
    w = ["".join(r.choice("abcdeéü") for _ in range(4)) for _ in range(80)]
    rows = [(i, " ".join(r.choice(w) for _ in range(r.choice([0, 1, 20, 90]))), f"s{i % 3}") for i in range(120)]
    rows += [(200, None, None), (201, "", "s0"), (202, "W " * 20_000, "s1"), (203, rows[3][1], "s1"), (204, rows[4][1] + " x", "s2")]
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.withColumn("score", F.lit("clash")).withColumn("shard", F.lit(1)).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, i % 2) for i in range(100)] + [(5, 0, 1), (6, 0, None), (None, 1, 1), (999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return rows


def test_queries_on_edge_tables(spark, tmp_path):
    from test_operators import brute_interleave, brute_repeats, words

    import sentencepiece

    rows, at = edge_tables(spark, tmp_path), str(tmp_path)
    text = {i: t or "" for i, t, _ in rows}
    crc = {i: zlib.crc32(str(i).encode()) for i in text}
    run = lambda name: {r["doc_id"]: r for r in queries.queries()[name](spark, at).collect()}
    got = run("op1_kneser_ney")
    count = Counter(x for i in text if crc[i] % 10 for x in [*words(text[i]), None])
    n, v = sum(count.values()), len(count)
    for i, t in text.items():
        own = [*words(t), None]
        assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (crc[i] % 10 == 0, len(own), sum(x in count for x in own), n)
        assert math.isclose(got[i]["base_score"], sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in own), rel_tol=1e-9)
        assert -1e7 < got[i]["score"] < 0
    got = run("op2_sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    for i, t in text.items():
        ids = library.encode(t)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest() and got[i]["round_trip"]
    got = run("op7_suffix_dedup")
    for i, (size, gone, spans, kept) in brute_repeats(list(text.items())).items():
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (size, gone, spans, hashlib.sha256(kept).hexdigest())
    got = run("op8_sharding")
    assert sorted(((i, r["shard"], r["slot"]) for i, r in got.items()), key=str) == brute_interleave(rows, 16)
    assert all((r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text[i].encode()) + 1, zlib.crc32(text[i].encode()), "rows", None) for i, r in got.items())
    got = run("op10_toxicity")
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r["held_out"] == (crc[i] % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    chosen = toxicity.training_rows(stages.table(spark, at, "documents"), stages.table(spark, at, "labels")).collect()
    want = [(text[i], max(y for j, _, y in [(k, 1, k % 2) for k in range(100)] + [(5, 0, 1)] if j == i)) for i in range(100) if crc[i] % 3 != 1]
    assert Counter((r["text"], r["toxic"]) for r in chosen) == Counter(want)
