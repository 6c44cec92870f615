"""The dealt operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdex.llm import chat_format, decontaminate, exact_dedup, kneser_ney, ngram_join, pii, sentencepiece_codec, sharding, suffix_array, suffix_dedup, textvec, toxicity
from verdex.llm import components as components_module
from verdex.llm.components import components

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))


def texts():
    r = random.Random(5)
    w = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(60)]
    base = [" ".join(r.choice(w) for _ in range(r.choice([0, 1, 3, 30, 120]))) for _ in range(30)]
    near = base[3] + " " + " ".join(r.choice(w) for _ in range(90))
    edited = [" ".join("EDIT" if i in (k, k + 40) else x for i, x in enumerate(near.split(" "))) for k in range(6)]
    return [None, "", " \t\n", "One", "one", *base, base[4], base[4].replace(" ", " \n"), near, near, *edited, "x" * 50_000, "ab " * 30_000]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if (i or 1) % 7 else None, len(t or "")) for i, t in rows], schema)


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(texts()))
    return rows, frame(spark, rows).withColumn("digest", F.lit(1)).withColumn("n", F.lit(2)).withColumn("_cell", F.lit("x")).withColumn("hits", F.lit(3)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(spark, docs, empty):
    rows, df = docs
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    got = {r["doc_id"]: r for r in exact_dedup.dedup(df, exact_dedup.fresh_index(spark)).collect()}
    for i in norm:
        group = [j for j in norm if norm[j] == norm[i]]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (min(group), len(group), i == min(group))
    assert exact_dedup.dedup(empty, exact_dedup.fresh_index(spark)).count() == 0
    kept = exact_dedup.keep_first(df.union(df))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({min(j for j in norm if norm[j] == v) for v in norm.values()})
    assert kept.columns == df.columns


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_exact_dedup_in_batches(spark, docs, batches):
    """Only the index can tell a later batch which row of an earlier one stays."""
    rows, df = docs
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    index = exact_dedup.fresh_index(spark)
    for name in ("a", "a"):  # the second run stands for one that is repeated after a failure
        got = {r["doc_id"]: r for r in exact_dedup.dedup(df, index, batches, name).collect()}
        for i in norm:
            group = [j for j in norm if norm[j] == norm[i]]
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (min(group), len(group), i == min(group))
    assert index.rows().count() == len(set(norm.values()))
    assert index.rows().select("batch").distinct().count() == batches
    index.drop()
    assert not spark.catalog.tableExists(index.name)


def test_digest_index_persists(spark):
    index = exact_dedup.fresh_index(spark)
    first = exact_dedup.dedup(frame(spark, [(1, "a"), (2, "b")]), index)
    assert first.filter("kept").count() == 2
    later = {r["doc_id"]: r for r in exact_dedup.dedup(frame(spark, [(3, "a"), (4, "c"), (None, "c")]), index).collect()}
    assert (later[3]["kept"], later[3]["keep_id"]) == (False, 1)
    assert later[4]["kept"] and not later[None]["kept"]
    assert index.rows().count() == 3
    for k in (1, 2):
        exact_dedup.dedup(frame(spark, [(i, f"{k} {i}") for i in range(200)]), index)
    new = exact_dedup.digests(frame(spark, [(i, f"t{i}") for i in range(50)] + [(90, "a")]))
    join = lambda: new.hint("merge").join(index.rows().select("digest"), "digest", "left_anti")
    sorts = lambda: join()._jdf.queryExecution().executedPlan().toString().count("Sort [")
    before = sorts()
    index.compact()
    assert join().count() == 50 and index.rows().count() == 403
    assert len(index.rows().inputFiles()) <= index.buckets
    assert sorts() == before - 1  # the compacted index is read as sorted


def test_sharding(spark, docs, empty):
    rows, df = docs
    got = sharding.interleave(df, 4).collect()
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(got) == len(rows)
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    text = dict(rows)
    for r in got:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    for source in {r["source"] for r in got}:
        mine = Counter(r["shard"] for r in got if r["source"] == source)
        assert max(mine[s] for s in sizes) - min(mine[s] for s in sizes) <= 2
    assert sharding.interleave(empty, 4).count() == 0
    assert "Python" not in sharding.interleave(df, 4)._jdf.queryExecution().toString()


def brute_interleave(rows, shards, seed=42):
    """(doc_id, shard, slot) of rows (doc_id, text, source), by sorting them all."""
    strata = defaultdict(list)
    for i, t, source in rows:
        raw = (t or "").encode()
        strata[source is None, source or ""].append((hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), (i is not None, i or 0), len(raw), zlib.crc32(raw)))
    order = []
    for (none, source), own in strata.items():
        tie = int(hashlib.md5(f"{seed}:{str(none).lower()}{source}".encode()).hexdigest()[:7], 16)
        order += [((2 * k - 1) / (2 * len(own)), tie, none, source, k, x[1][1] if x[1][0] else None) for k, x in enumerate(sorted(own), 1)]
    order.sort(key=lambda x: x[:5])
    n, out = len(order), []
    for at, x in enumerate(order):
        shard = at * shards // n
        out.append((x[5], shard, at - -(-shard * n // shards)))
    return sorted(out, key=str)


@pytest.mark.parametrize("cell", [2_000, 3])
def test_sharding_order(spark, monkeypatch, cell):
    """Hot and one-row sources, null and repeated ids and sources: the order of a sort of all rows, however rows are cut."""
    monkeypatch.setattr(sharding, "CELL_ROWS", cell)
    rows = [(i, f"t{i}", "hot" if i % 3 else f"host{i}") for i in range(400)] + [(400 + i, None, "two%d" % (i // 2)) for i in range(60)]
    rows += [(None, "x", None), (None, "y", None), (7, "t7", "hot"), (7, "t7", "hot"), (900, "é" * 5000, None), (901, "", "")]
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)
    got = sharding.interleave(df, 7)
    assert sorted(((r["doc_id"], r["shard"], r["slot"]) for r in got.collect()), key=str) == brute_interleave(rows, 7)


def test_sharding_spreads_ties(spark, monkeypatch):
    """Twenty thousand sources of one row have one fraction; no cell holds a large share of them."""
    seen = []
    offsets = sharding._offsets
    monkeypatch.setattr(sharding, "_offsets", lambda rows, keys, cell: seen.append(rows.groupBy(*keys, cell).count().agg(F.max("count")).first()[0]) or offsets(rows, keys, cell))
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.concat(F.lit("h"), "id").alias("source"))
    got = sharding.interleave(df, 16).groupBy("shard").count().collect()
    assert {r["count"] for r in got} == {1250} and seen[-1] < 2 * sharding.CELL_ROWS


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("chunk", [2000, 3])
def test_ngram_join(docs, empty, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)  # 3: blocks are cut into chunks
    rows, df = docs
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect()}
    assert got == brute_components(rows)
    nulls = {r["component_id"] for r in ngram_join.jaccard_components(df.union(df.withColumn("doc_id", F.lit(None).cast("long")))).filter("doc_id IS NULL AND n_shingles > 0").collect()}
    assert nulls == {c for n, c in got.values() if n}
    if chunk > 3:
        assert ngram_join.jaccard_components(empty).count() == 0
        assert sorted(r["doc_id"] for r in ngram_join.keep_one(df).collect()) == sorted({c for _, c in got.values()})


def test_tree_join_is_exact():
    r = np.random.default_rng(4)
    sets = []
    for _ in range(25):
        base = r.integers(0, 2**60, r.integers(5, 80))
        for _ in range(r.integers(1, 8)):
            keep = base[r.random(len(base)) > r.choice([0.0, 0.05, 0.2])]
            sets.append(np.unique(np.concatenate([keep, r.integers(0, 2**60, r.integers(0, 6))])))
    sizes = np.array([len(s) for s in sets])
    up = list(range(len(sets)))
    find = lambda i: i if up[i] == i else find(up[i])
    for i in range(len(sets)):
        for j in range(i):
            o = len(np.intersect1d(sets[i], sets[j]))
            if 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    got = ngram_join.tree_join(sets, sizes, np.arange(len(sets)), np.zeros(len(sets), int))
    assert got.tolist() == [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("per", [250_000, 0])
def test_components(spark, monkeypatch, per):
    monkeypatch.setattr(components_module, "PER_PARTITION", per)  # 0: in rounds
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (None, 3), (200, 150), (150, 199)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 150: 150, 199: 150, 200: 150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, window=200):
    c = Counter()
    for _, t in rows:
        b = (t or "").encode()
        c.update(b[i : i + window] for i in range(len(b) - window + 1))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if c[b[s : s + window]] > 1:
                gone[s : s + window] = b"\1" * window
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(b), sum(gone), runs, bytes(x for x, m in zip(b, gone, strict=True) if not m))
    return out


def test_suffix_dedup(spark, empty):
    r = random.Random(8)
    passage = "".join(r.choice("abcdefg ü") for _ in range(420))
    rows = [(0, None), (1, ""), (2, passage[:199]), (3, "x" + passage), (4, passage + "y" * 300), (5, passage[100:310] + "q"), (6, "z" * 250), (7, "kü" * 400), (8, "".join(r.choice("abc") for _ in range(900)))]
    rows += [(9, rows[8][1]), (10, passage[:200]), (11, "".join(r.choice("hijk") for _ in range(3000)))]
    df = frame(spark, rows)
    got = {x["doc_id"]: (x["n_bytes"], sum(e - b for b, e in zip(x["begins"], x["ends"], strict=True)), len(x["begins"]), bytes(x["kept"])) for x in suffix_dedup.remove_repeats(df, suffix_dedup.find_repeats(df)).collect()}
    assert got == brute_repeats(rows)
    assert suffix_dedup.remove_repeats(empty, suffix_dedup.find_repeats(empty)).count() == 0


@pytest.mark.parametrize("part", [1 << 22, 2_000])
def test_suffix_dedup_splits_hot_anchors(spark, monkeypatch, part):
    """A passage in other surroundings each time is an anchor's every fragment: 2,000 bytes hold few of them."""
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", part)
    r = random.Random(4)
    some = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    passage, tail = some(150), some(60)
    rows = [(i, some(r.randint(90, 400)) + passage + (tail if i % 3 else some(70)) + some(r.randint(90, 400))) for i in range(40)]
    rows += [(40 + i, rows[i][1][50:-60]) for i in range(4)] + [(50 + i, passage + tail) for i in range(60)]
    df = frame(spark, rows).repartition(3)
    seen = []
    split = suffix_dedup.split_hot
    monkeypatch.setattr(suffix_dedup, "split_hot", lambda *a: seen.append(1) or split(*a))
    got = {x["doc_id"]: (x["n_bytes"], sum(e - b for b, e in zip(x["begins"], x["ends"], strict=True)), len(x["begins"]), bytes(x["kept"])) for x in suffix_dedup.remove_repeats(df, suffix_dedup.find_repeats(df)).collect()}
    assert got == brute_repeats(rows)
    assert bool(seen) == (part == 2_000)


def test_halves_keep_equal_windows_together():
    r = random.Random(2)
    anchor = bytes(r.randrange(97, 105) for _ in range(suffix_dedup.GRAM))
    most = suffix_dedup.WINDOW - suffix_dedup.GRAM
    told = defaultdict(set)
    for _ in range(30):
        before, after = (bytes(r.choice(b"xy") for _ in range(r.randint(5, most))) for _ in range(2))
        if len(before) + len(after) >= most:
            rows = [(0, 0, most, len(before), before + anchor + after)]
            while rows:
                key, low, high, at, content = rows.pop()
                assert content[at : at + len(anchor)] == anchor and len(content) >= suffix_dedup.WINDOW
                if low == high:
                    told[content].add(key)
                else:
                    rows += [x[:5] for x in suffix_dedup.halves(low, high, at, content)]
    assert told and all(len(keys) == 1 for keys in told.values())


@pytest.mark.parametrize("memory, chunk, slots", [(1 << 20, 1 << 18, 1 << 22), (5, 3, 0)])
def test_suffix_order_and_prefixes(monkeypatch, memory, chunk, slots):
    monkeypatch.setattr(suffix_array, "CHUNK", chunk)
    monkeypatch.setattr(suffix_array, "MEMORY", memory)
    monkeypatch.setattr(suffix_array, "SLOTS", slots)
    monkeypatch.setattr(suffix_array, "HELD", slots)
    spilled, heap, bucket = Counter(), suffix_array.DiskHeap._read, suffix_array.BucketQueue.push
    monkeypatch.setattr(suffix_array.DiskHeap, "_read", staticmethod(lambda name: spilled.update(["heap"]) or heap(name)))

    def push(queue, *row):
        bucket(queue, *row)
        spilled.update(["bucket"] * bool(queue.file))

    monkeypatch.setattr(suffix_array.BucketQueue, "push", push)
    r = random.Random(3)
    for _ in range(150):
        k = r.choice([1, 2, 3, 30])
        body = bytes(r.randint(1, k) for _ in range(r.randint(1, 70))) * r.choice([1, 1, 3])
        raw, limit = body + b"\0", r.choice([1, 3, 50])
        want = sorted(range(len(body)), key=lambda i: raw[i:], reverse=True)
        with suffix_array.Scratch() as scratch:
            got = [tuple(x) for c in suffix_array.suffixes(np.frombuffer(raw, np.uint8), limit, scratch) for x in c.tolist()]
        assert [p for p, _ in got] == want
        for (p, n), q in zip(got[1:], want, strict=False):
            common = next((i for i in range(limit) if raw[p + i : p + i + 1] != raw[q + i : q + i + 1] or p + i >= len(raw)), limit)
            assert n == common
    assert set(spilled) == (set() if slots else {"heap", "bucket"})


def test_kneser_ney(docs, empty):
    rows, df = docs
    train = [t for i, t in rows if i % 3]
    model = kneser_ney.train(df.filter("doc_id % 3 <> 0"))
    got = {r["doc_id"]: r for r in kneser_ney.score(df, model).collect()}
    c, bi = Counter(), Counter()
    for t in train:
        w = [*words(t), "</e>"]
        c.update(w)
        bi.update(zip(["<s>", *w[:-1]], w, strict=True))
    n, v = sum(c.values()), len(c)
    assert (model.n, model.v, model.bigrams) == (n, v, len(bi))
    cont, total, back = Counter(w for _, w in bi), Counter(), defaultdict(float)
    d2, d1 = (kneser_ney.discounts([list(x.values()).count(k) for k in (1, 2, 3, 4)]) for x in (bi, cont))
    for (a, _), k in bi.items():
        total[a] += k
        back[a] += d2[min(k, 3)]
    left = sum(d1[min(k, 3)] for k in cont.values()) / len(bi)
    low = lambda w: max(cont[w] - d1[min(cont[w], 3)], 0) / len(bi) + left / (v + 1)
    p = lambda a, w: ((bi[a, w] - d2[min(bi[a, w], 3)]) / total[a] if bi[a, w] else 0) + (back[a] / total[a] if total[a] else 1) * low(w)
    assert math.isclose(sum(p("<s>", w) for w in c) + back["<s>"] / total["<s>"] * left / (v + 1), 1, rel_tol=1e-9)
    for i, t in rows:
        w = [*words(t), "</e>"]
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (len(w), sum(x in c for x in w))
        assert math.isclose(got[i]["base_score"], sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert math.isclose(got[i]["score"], sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w[:-1]], w, strict=True)), rel_tol=1e-9)
    bare = kneser_ney.score(df, kneser_ney.train(empty)).collect()
    assert len(bare) == len(rows) and all(r["n_known"] == 0 for r in bare)


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece_codec.Vocabulary.load()


def test_sentencepiece(docs, empty, vocabulary):
    import sentencepiece

    rows, df = docs
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    r = random.Random(2)
    odd = ["日本語 テスト\n\n", "▁x▁", "<s> </s> <0x0A>", "a" * 300, "\t if x:\n    return  y", "é\u0301🙂 ok", " " * 40 + "x"]
    odd += ["".join(r.choice("aeinrst hoü  \n.1") for _ in range(r.randint(0, 90))) for _ in range(300)]
    codec = sentencepiece_codec.Codec(vocabulary)
    assert codec.encode(pa.array(odd)).to_pylist() == library.encode(odd)
    coded = sentencepiece_codec.encode(df, vocabulary)
    assert {x["doc_id"]: x["ids"] for x in coded.collect()} == {i: library.encode(t or "") for i, t in rows}
    back = sentencepiece_codec.decode(coded.drop("text"), vocabulary)
    assert {x["doc_id"]: x["text"] for x in back.collect()} == {i: t or "" for i, t in rows}
    assert all(x["round_trip"] for x in sentencepiece_codec.round_trip(df, vocabulary).collect())
    assert sentencepiece_codec.encode(empty, vocabulary).count() == 0


def test_sentencepiece_unigram(vocabulary):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(sentencepiece_codec.MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for i, x in enumerate(m.pieces):
        if x.type == 1:
            x.score = -5.0 - (i * 7919 % 9973) / 997
    library = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    scores = np.array([x.score for x in m.pieces])
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary(vocabulary.pieces, scores, vocabulary.plain, vocabulary.byte_id, vocabulary.unk, False))
    some = [t for t in texts() if t and len(t) < 2000]
    for ours, theirs in zip(codec.encode(pa.array(some)).to_pylist(), library.encode(some), strict=True):
        assert ours == theirs or math.isclose(scores[ours].sum(), scores[theirs].sum(), rel_tol=1e-5)  # equal sums may tie in single precision


def test_decontamination(spark, docs, empty):
    r = random.Random(9)
    w = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    say = lambda n: " ".join(r.choice(w) for _ in range(n))
    items = [(k, f"{say(12)}? {say(6)}.") for k in range(20)] + [(20, None), (21, ""), (22, say(30)), (None, say(9))]
    rows = [(0, None), (1, ""), (2, say(500)), (3, say(90) + " " + items[4][1].upper() + " " + say(200)), (4, items[5][1]), (5, items[6][1].split("?")[0] + " " + say(50)), (6, say(200) + items[7][1] + items[8][1] + say(10)), (7, items[22][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: [h["item_id"] for h in x["hits"]] for x in decontaminate.find_hits(frame(spark, rows), bench).collect()}
    assert got == {0: [], 1: [], 2: [], 3: [4], 4: [5], 5: [], 6: [8], 7: [22]} or got[6] in ([7, 8], [8], [7])
    assert got[3] == [4] and got[4] == [5] and got[5] == [] and got[7] == [22]
    assert {x["doc_id"] for x in decontaminate.drop_contaminated(frame(spark, rows), bench).collect()} == {i for i in got if not got[i]}
    assert decontaminate.find_hits(empty, bench).count() == 0
    assert all(x["hits"] == [] for x in decontaminate.find_hits(docs[1], bench.limit(0)).collect())


def brute_hits(text, items, stride):
    """{item: (whole, question, answer)} of the passages (two strides, one apart, and the first stride) that pass, unfiltered."""
    low = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    w, out = low(text), {}
    passages = [w[:stride], *(w[i : i + 2 * stride] for i in range(0, len(w), stride))]
    for i, t in items:
        split = [x for x in map(low, decontaminate.question_and_answer(t)) if x]
        parts = [(min(5, len(x)), x) for x in [low(t), *split] if x]
        for p in passages:
            share = [len(grams(x, n) & grams(p, n)) / len(grams(x, n)) for n, x in parts]
            if share and (share[0] >= 0.8 or min(share[1:]) >= 0.8):
                out.setdefault(i, []).append(tuple(round(s, 9) for s in (share[0], share[1], share[-1])))
    return out


@pytest.mark.parametrize("size", [8 << 20, 700])
def test_hits_are_those_of_brute_force(spark, monkeypatch, size):
    """Copies with words cut, changed or missing at either end, rare words lost, answers apart, long and repeated texts, for
    an index in one file and in many; the tables have further columns."""
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", size)
    r = random.Random(12)
    common, rare = [f"c{i}" for i in range(40)], [f"rare{i}" for i in range(900)]
    say = lambda n: [r.choice(common if r.random() < 0.8 else rare) for _ in range(n)]
    items = []
    for k in range(60):
        q = say(r.choice([3, 8, 20, 40]))
        items.append((k, " ".join(q) + r.choice(["? ", " Answer: ", ". ", " "]) + " ".join(say(r.choice([1, 2, 6])))))
    q = say(34)
    items += [(60, " ".join([*q, *(f"lone{i}" for i in range(6))])), (61, items[3][1]), (62, "..."), (63, None)]
    rows = [(0, " ".join(say(50) + q + say(20)))]
    for k in range(160):
        w = r.choice(items[:60])[1].split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(rare)
        w = w[r.choice([0, 0, 1, 2]) : len(w) - r.choice([0, 0, 1])]
        at = r.randrange(len(w) + 1)
        rows.append((k + 1, " ".join([*say(r.choice([0, 5, 60])), *w[:at], *(say(r.choice([0, 0, 30]))), *w[at:], *say(r.choice([0, 90]))])))
    rows += [(200, " ".join(say(4000)) + " " + items[7][1]), (201, rows[5][1]), (201, rows[5][1]), (202, None), (203, "")]
    df = frame(spark, rows).withColumn("hits", F.lit("x")).withColumn("item_id", F.lit(5)).withColumn("part", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("part", F.lit("y"))
    held = [(i, t) for i, t in items if t]
    stride = max(len(re.findall(r"[a-z0-9]+", t.lower())) for _, t in held)
    got = decontaminate.find_hits(df, bench).collect()
    assert len(got) == len(rows)
    found = 0
    for x in got:
        want = brute_hits(dict(rows)[x["doc_id"]] or "", held, stride)
        assert [h["item_id"] for h in x["hits"]] == sorted(want), x["doc_id"]
        assert all((round(h["whole"], 9), round(h["question"], 9), round(h["answer"], 9)) in want[h["item_id"]] for h in x["hits"])
        found += len(x["hits"])
        if x["doc_id"] == 0:
            scores = {h["item_id"]: h["bm25"] for h in x["hits"]}
    assert found > 40 and 60 in scores
    whole = decontaminate.Index.build(held)  # an index in many files has the scores of one
    assert math.isclose(scores[60], dict((int(whole.item_ids[i]), s) for i, s in whole.search(np.flatnonzero(np.isin(whole.terms, textvec.words(pa.array([" ".join(q)])).hash))))[60], rel_tol=1e-9)


def test_decontamination_query(spark, tmp_path):
    items = [(1, "the first item has eight words in it"), (2, "one more item that no text of these has")]
    rows = [(5, "so the first item has eight words in it too"), (6, None), (7, "nothing")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in decontaminate.op3_decontaminate(spark, str(tmp_path)).collect()}
    assert {i: (r["n_items"], r["item_ids"], r["contaminated"]) for i, r in got.items()} == {5: (1, "1", True), 6: (0, "", False), 7: (0, "", False)}
    assert got[5]["best_bm25"] > 0 and got[6]["best_bm25"] is None


def test_block_max_wand_finds_all():
    r = random.Random(1)
    w = [f"w{i}" for i in range(150)]
    index = decontaminate.Index.build([(k, " ".join(r.choice(w) for _ in range(r.randint(5, 40)))) for k in range(200)])
    g = np.random.default_rng(1)
    for k in range(100):
        query = np.unique(np.concatenate([g.integers(0, len(index.terms), 60), np.flatnonzero(np.isin(np.arange(len(index.terms)), g.integers(0, 150, 40)))]))
        score = np.zeros(len(index.item_ids))
        for t in query:
            part = slice(index.first[t], index.first[t + 1])
            score[index.items[part]] += index.impact[part]
        assert sorted(i for i, _ in index.search(query)) == np.flatnonzero(score >= index.threshold).tolist()


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t, kind):
    out = []
    for m in re.finditer(BASE[kind], t):
        d = re.sub(r"[^0-9]", "", m[0])
        ok = {"email": True, "ip": all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
        if ok:
            out.append((m.start(), m.end()))
    return out


def test_pii(docs, empty):
    cues = pii._automaton()
    r = random.Random(6)
    fixed = ["a@b@c.de@f.gh", "x@y.z.@q.w", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3", "4111 1111-1111 1111 4111111111111111", "+1 (017) 555-7713 +1--- +12", "4242424242424242 5", "é@a.b ü+49 30 1234567."]
    for t in fixed + ["".join(r.choice("a1@.+ -()9é42") for _ in range(r.randint(0, 60))) for _ in range(6000)]:
        got = pii.spans(t, cues)
        for kind in BASE:
            assert got.get(kind, []) == brute_spans(t, kind), (t, kind)
    t = "IBAN GB82 WEST 1234 5698 7654 32, account no 12345678, ssn 219-09-9999, see https://me:pw@host.org/x and https://host.org/y"
    assert {k: [t[a:b] for a, b in v] for k, v in pii.spans(t, cues).items() if k in pii.KINDS[4:]} == {"iban": ["GB82 WEST 1234 5698 7654 32"], "account": ["12345678"], "ssn": ["219-09-9999"], "url_login": ["https://me:pw@host.org/x"]}
    assert pii.find(docs[1]).count() == len(docs[0]) and pii.find(empty).count() == 0


@pytest.mark.parametrize("text, kinds", [
    ("1.1.1." + "9" * 5000, {}), ("1.1.1." + "0" * 5000 + "7", {"ip": 1}), ("a://" * 250_000, {}), ("://" * 300_000, {}), ("a@" * 500_000, {}),
    ("@" * 1_000_000, {}), ("1." * 400_000 + "x", {"ip": 100_000}), ("+1 " * 300_000, {}), ("1-" * 300_000, {}), ("a" * 1_000_000 + "@b.c", {"email": 1}),
    ("u:p@h " * 100_000 + "s://u:p@h/" + "x" * 500_000, {"url_login": 1}), ("iban " * 100_000, {}), ("a.b@c." * 100_000, {"email": 50_000}), ("AB12 " * 100_000, {}),
])
def test_pii_is_linear(text, kinds):
    began = time.process_time()
    got = pii.spans(text, pii._automaton())
    assert {k: len(v) for k, v in got.items() if v} == kinds
    assert time.process_time() - began < 20


def test_pii_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate([None, "", "mail a@b.co.uk and 1.2.3.4, +49 30 1234567", "ü 4111 1111 1111 1111 x@y.z é 9.9.9.9", "1.1.1." + "9" * 5000])]
    frame(spark, rows + rows[2:3] + [(None, "q@r.st")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in pii.op4_pii(spark, str(tmp_path)).select("doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans").collect()), key=str)
    want = []
    for i, t in [*rows, rows[2], (None, "q@r.st")]:
        found = {k: brute_spans(t or "", k) for k in BASE}
        base = ",".join(f"{k}:{a}:{b}" for k, v in found.items() for a, b in v)
        want.append((i, *(len(v) for v in found.values()), hashlib.sha256(base.encode()).hexdigest(), base))
    assert got == sorted(want, key=str)


def test_chat_events(spark):
    log = [(1, 0, 0, 0, "message", "user", "hi <s>"), (1, 1, 0, 1, "delta", "assistant", "Hel"), (1, 1, 0, 3, "delta", None, "lo"), (1, 1, 0, 2, "delta", None, "l"), (1, 1, 0, 4, "regenerate", None, None), (1, 1, 0, 5, "delta", None, "Bye\\"), (1, 0, 0, 6, "edit", None, "HI [INST]"), (2, 0, 0, 0, "delta", None, None), (1, 1, 0, 7, "other", None, "zz")]
    events = spark.createDataFrame(log, chat_format.EVENTS).withColumn("rendered", F.lit("clash"))
    got = sorted(chat_format.reconstruct(events).collect(), key=lambda r: (r["conv_id"], r["turn"]))
    assert [list(chat_format.read_back(r["rendered"])) for r in got] == [[("user", "HI [INST]")], [("assistant", "Bye\\")], [("", "")]]
    assert chat_format.unescape(got[1]["rendered"][got[1]["loss_start"] : got[1]["loss_end"]]) == "Bye\\"
    assert not any(c in got[0]["rendered"][3:-6] for c in chat_format.CONTROL)
    assert chat_format.reconstruct(events.limit(0)).count() == 0
    for role in ("us\ner", "\\n", "n\\\n<s>", "", "\n"):
        assert list(chat_format.read_back(chat_format.render(role, "x\ny")[0])) == [(role, "x\ny")]
    r = random.Random(7)
    for _ in range(2000):
        t = "".join(r.choice(["<s>", "</s>", "[INST]", "\\", "<|", "a", "\n", "<", "s>", "[/INST]"]) for _ in range(r.randint(0, 8)))
        assert chat_format.unescape(chat_format.escape(t)) == t and not any(c in chat_format.escape(t) for c in chat_format.CONTROL)
        assert list(chat_format.read_back(chat_format.render("user", t)[0] * 2)) == [("user", t)] * 2


def test_chat_log_folds_back(spark):
    """Rows with null ids, roles and texts, repeated turns, long texts; each step of the fold is needed."""
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "x" * 1000 + "é" * 300), (1, 1, "assistant", None), (None, 0, "assistant", "</s>"), (None, 1, None, "a\nb"), (2, 0, "a\nb", ""), (3, 0, "assistant", "z" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    log = chat_format.as_events(df)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"message", "edit", "delta", "regenerate"}
    fold = lambda events: sorted((r["conv_id"] or 0, r["turn"], *next(chat_format.read_back(r["rendered"]))) for r in chat_format.reconstruct(events).collect())
    want = sorted((c or 0, t, role or "", text or "") for c, t, role, text in rows)
    assert fold(log) == want
    for kind in ("edit", "delta", "regenerate"):
        assert fold(log.filter(F.col("kind") != kind)) != want


def test_toxicity(spark, docs, empty):
    r = random.Random(11)
    w = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(900):
        bad = r.random() < 0.3
        t = [r.choice(w) for _ in range(20)] + (["vilest", r.choice(["women", "men"])] if bad else [r.choice(["muslims", ""])])
        if bad and r.random() < 0.8:
            t.append("women")
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(bad)))
    df, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, lab)
    truth = {i: y for i, _, y in labels}
    held = [x for x in toxicity.score(df, model).collect() if zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1]
    assert np.mean([(x["score"] >= 0.7) == truth[x["doc_id"]] for x in held]) > 0.97
    neutral = model.scores(pa.array(["all women here", "all men here", "all girls here"]))
    assert neutral.max() < 0.7 and abs(neutral[0] - neutral[2]) < 0.2  # the swap penalty keeps a group's terms together
    assert 0 <= toxicity.score(docs[1], model).agg(F.min("score")).first()[0] <= 1
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(df, lab.limit(0)).scores(pa.array(["x"]))[0] == 0.5
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and 0 < kept.count() < 900


def test_word_hashes_respect_texts():
    got = textvec.words(pa.array(["A b", None, "", "a B c", " \tA"]))
    assert np.diff(got.first).tolist() == [2, 0, 0, 3, 1]
    assert got.hash[0] == got.hash[2] == got.hash[5] != got.hash[1] == got.hash[3]


def test_digest_of_conversation_minus_7(spark):
    got = chat_format.op5_chat_format(spark, "/root/testdata/sf0.001").filter("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert got["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (got["n_turns"], got["loss_chars"], got["loss_sha256"]) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
