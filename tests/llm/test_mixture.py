"""Packing, the divergence audit and importance resampling against brute force, with edge rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdex.llm import divergence, importance, packing, word_tokens

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string"
PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def rows():
    r = random.Random(11)
    w = ["".join(r.choice("abcdEé1") for _ in range(r.randint(1, 6))) for _ in range(70)]
    out = [(i, " ".join(r.choice(w) for _ in range(r.choice([0, 1, 19, 20, 60, 400]))), r.choice(["en", "de", None]), r.choice(["s0", "s0", "s0", "s1", "é2", None])) for i in range(90)]
    return out + [(200, None, None, None), (201, "", "en", "only"), (202, " \t!", "fr", "x"), (203, "fr fr fr", "fr", "y"), (None, out[3][1], "en", "s1"), (5, out[5][1], "en", "s1"), (5, out[5][1], "en", "s1"), (204, "Word " * 9000, "en", "s0"), (205, "x" * 30_000, "de", "s0")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    for name in ("n", "rank", "group", "ids", "score", "p", "term", "all"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- packing


def check_pieces(pieces, sizes, capacity):
    """pieces: (document, start, length, sequence, offset); each id in one piece, sequences gapless, full or a power of two."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for d, s, n, q, o in pieces:
        assert n > 0
        sequences[q].append((o, n)), documents[d].append((s, n))
    for x in (*sequences.values(), *documents.values()):
        assert [a for a, _ in sorted(x)] == [0, *itertools.accumulate(n for _, n in sorted(x))][:-1]
    totals = [sum(n for _, n in x) for x in sequences.values()]
    assert all(t == capacity or t < capacity and t & (t - 1) == 0 for t in totals)
    assert {d: sum(n for _, n in x) for d, x in documents.items()} == {d: n for d, n in sizes.items() if n}
    return sum(t != capacity for t in totals)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_windows_are_full(capacity):
    r = random.Random(capacity)
    kinds = [lambda: r.randint(0, 3 * capacity), lambda: capacity * 3 // 4, lambda: capacity // 7 if r.random() < 0.6 else r.randint(1, capacity), lambda: capacity // 2 + 1, lambda: r.randint(1, 3), lambda: 0]
    for n in (0, 1, 2, 7, 60, 1500):
        for kind in kinds:
            sizes = [kind() for _ in range(n)]
            got = packing.pack_lengths(np.array(sizes, np.int64), capacity)
            pieces = list(zip(*(x.tolist() for x in got[:5]), strict=True))
            assert check_pieces(pieces, dict(enumerate(sizes)), capacity) <= math.log2(capacity)
            assert {p[3] for p in pieces} == set(range(got.windows))
            assert len(pieces) <= n + 2 * got.windows + 12  # a window cuts one document at most


def test_fill_is_the_closest_sum():
    r = random.Random(3)
    for _ in range(300):
        room, count = r.randint(1, 40), [0] * 50
        for _ in range(r.randint(0, 6)):
            count[r.randint(1, 40)] += r.randint(1, 3)
        lengths = [x for x in range(49, 0, -1) if count[x]]
        sums = {0}
        for x in lengths:
            sums = {s + k * x for s in sums for k in range(count[x] + 1) if s + k * x <= room}
        got = packing.fill(count, lengths, room)
        assert sum(x * n for x, n in got) == max(sums) and all(n <= count[x] for x, n in got)


def test_ids_equal_the_library():
    e = word_tokens.encoder(PATH)
    assert e.quick
    r = random.Random(1)
    signs = [*"abcXYZ 019'\t\n.,-!<|>/é'ÉßİſȺ́İ \u0085  中文ąŁǅΣς½²\x00\x1f\x7f_", "<|endoftext|>", "'s", "'re", " 'll ", "é", "</w>"]
    texts = [None, "", " ", "a" * 3000, "é" * 500, "'" * 99, *("".join(r.choice(signs) for _ in range(r.randint(1, 40))) for _ in range(4000))]
    for _ in range(2):  # the second time from what is remembered
        ids, at = e.encode(pa.array(texts), 1)
        assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)] == [x.ids + [1] for x in e.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    other = word_tokens.Encoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    ids, at = other.encode(pa.array(["a b", None, "  two  spaces"]))
    assert not other.quick and ids.tolist() == sum((other.library.encode(t, add_special_tokens=False).ids for t in ("a b", "  two  spaces")), [])


def test_units_are_forgotten_when_full(monkeypatch):
    monkeypatch.setattr(word_tokens, "UNITS", 50)
    e = word_tokens.Encoder(PATH)
    r = random.Random(4)
    for _ in range(20):
        texts = [" ".join("".join(r.choice("abcde") for _ in range(r.randint(1, 4))) for _ in range(30))]
        assert e.encode(pa.array(texts))[0].tolist() == e.library.encode(texts[0], add_special_tokens=False).ids


def test_packing(spark, docs, empty, tmp_path):
    library = word_tokens.encoder(PATH).library
    ids = [(i, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, _, _ in rows()]
    assert packing.pack_texts(empty, PATH).count() == 0
    for chunk in (packing.CHUNK, 3000):
        got = packing.pack_texts(docs, PATH, chunk=chunk).collect()
        assert Counter(r["doc_id"] for r in got if r["start"] == 0) == Counter(i for i, _ in ids)
        whole = {i: x for i, x in ids}
        for r in got:
            x = whole[r["doc_id"]]
            assert r["doc_tokens"] == len(x)
            assert r["ids_crc32"] == zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        once = [r for r in got if r["doc_id"] != 5]
        assert sum(r["length"] for r in once if r["doc_id"] is not None) == sum(len(x) for i, x in ids if i not in (None, 5))
        sequences = defaultdict(list)
        for r in got:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for x in sequences.values():
            assert [a for a, _ in sorted(x)] == [0, *itertools.accumulate(n for _, n in sorted(x))][:-1]
            total = sum(n for _, n in x)
            assert total == 2048 or total & (total - 1) == 0
    tokens = packing.tokenise(docs, PATH)
    assert tokens.columns == [*(c for c in docs.columns if c != "ids"), "ids"]
    got = packing.pack(tokens.filter("doc_id < 80 AND doc_id <> 5"), capacity=64).collect()
    parts = defaultdict(list)
    for r in got:
        parts[r["doc_id"]].append((r["start"], r["ids"]))
    assert {i: sum((x for _, x in sorted(p)), []) for i, p in parts.items()} == {i: x for i, x in ids if i is not None and i < 80 and i != 5}
    check_pieces([(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in got], {i: len(x) for i, x in ids if i is not None and i < 80 and i != 5}, 64)
    nulls = spark.createDataFrame([(1, None), (2, []), (None, [None, 7])], "doc_id long, ids array<int>")
    assert [(r["doc_id"], r["ids"]) for r in packing.pack(nulls).collect()] == [(None, [0, 7])]


# --- divergence


def brute_divergence(data, least_docs, alpha, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    data = [(lang or "", source or "", term.findall((t or "").translate(UP))) for _, t, lang, source in data]
    out = []
    for lang in {d[0] for d in data}:
        own = [d for d in data if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least_docs}
        counts = {s: Counter(t for d in own if s in (None, d[1]) for t in d[2] if t in kept) for s in {d[1] for d in own} | {None}}
        p = {s: {t: 1 + 10**9 * (c[t] + alpha) // (sum(c.values()) + alpha * len(kept)) for t in kept} for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            if s is None:
                continue
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o is not None and o != s]
            terms = [(-f(p[s][t], p[None][t]), t) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, items in (("pair", sorted(pair, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -value, k) for k, (value, item) in enumerate(items, 1)]
    return sorted(out)


def test_divergence(spark, docs, empty):
    for args in ((3, 1, 200), (1, 2, 5)):
        got = divergence.divergence(docs, *args)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(tuple(r) for r in got.collect()) == brute_divergence(rows(), *args)
    assert divergence.divergence(empty).count() == 0
    few = docs.filter("lang = 'fr'")
    assert sorted(tuple(r) for r in divergence.divergence(few).collect()) == [("fr", "x", "pair", "y", 0, 1), ("fr", "y", "pair", "x", 0, 1)]  # no kept term


def most_rows(df):
    """The largest number of rows that an operator of the executed plan gave."""
    def walk(node):
        inner = [getattr(node, x)() for x in ("executedPlan", "plan") if x in dir(node)] or [node.children().apply(i) for i in range(node.children().size())]
        rows = node.metrics().get("numOutputRows")
        return max([rows.get().value() if rows.isDefined() else 0, *map(walk, inner)])

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_divergence_makes_no_row_for_a_term_that_a_group_lacks(spark):
    # 30 sources with 100 terms of their own each and 5 that all have: by groups and terms that's 91,350 rows, by pairs 2.6 million
    word = lambda s, k: "w" + "".join(chr(97 + int(c)) for c in f"{s:02}{k:03}")
    data = [(d, " ".join([*(word(s, k) for k in range(100)), *(word(99, k) for k in range(5)), *["more"] * s]), "en", f"s{s:02}") for s in range(30) for d in range(3)]
    got = divergence.divergence(spark.createDataFrame(data, SCHEMA))
    assert most_rows(got) < 10_000
    assert sorted(tuple(r) for r in got.collect()) == brute_divergence(data, 3, 1, 200)


def test_divergence_with_groups_that_are_not_broadcast(docs, monkeypatch):
    monkeypatch.setattr(divergence, "FEW", 0)
    assert sorted(tuple(r) for r in divergence.divergence(docs, 1, 2, 5).collect()) == brute_divergence(rows(), 1, 2, 5)


def test_terms_are_cut_at_ascii_alone():
    texts = ["É\u00a0b É", "Aa aA é12x\x00y\u2028x[Z`z{~\x7f", "", " 12 ", "x\u3000X K\u212a İI"]
    batch = pa.RecordBatch.from_pydict({"lang": ["de", "en", "en", "en", "de"], "source": ["x", "y", "y", "z", "x"], "text": texts})
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    want = Counter((a, b, t) for a, b, x in zip(*batch.to_pydict().values(), strict=True) for t in term.findall(x.translate(UP)))
    (got,) = divergence._count([batch])
    assert {(r["lang"], r["source"], r["term"]): r["n"] for r in got.to_pylist()} == want
    assert [x.num_rows for x in divergence._count([batch.slice(2, 2)])] == [0]


def test_share_is_exact(spark):
    data = [(0, 0, 1), (10**10 * 3 + 7, 10**11, 12345), (9 * 10**9 - 1, 10**10, 3), (9 * 10**9, 10**10, 3), (5, 7, 2)]
    df = spark.createDataFrame(data, "n long, total long, v long").select("n", "total", "v", divergence.share(F.col("n"), F.col("total"), F.col("v"), 1).alias("p"))
    assert [r["p"] for r in df.collect()] == [1 + 10**9 * (n + 1) // (t + v) for n, t, v in data]


# --- importance


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(t, least, most):
    w = WORDS.findall((t or "").translate(UP))
    return [" ".join(w[i : i + n]) for n in range(least, most + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize(("least", "most"), [(1, 1), (1, 3), (2, 5)])
def test_places(least, most):
    texts = [t for _, t, _, _ in rows()][:60] + [None, "", "a b a b a b a", "  a b", "b a  ", "A-b.A"]
    got = importance.places(pa.array(texts), least, most, 997)
    by = defaultdict(list)
    for i, b in zip(got.row.tolist(), got.bucket.tolist(), strict=True):
        by[i].append(b)
    for i, t in enumerate(texts):
        assert sorted(by[i]) == sorted(zlib.crc32(g.encode()) % 997 for g in grams(t, least, most))
        assert got.words[i] == len(grams(t, 1, 1))


def brute_resample(data, target, percent, least_words, least, most, buckets):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, t, _, _ in data for g in grams(t, least, most))
    t = Counter(bucket(g) for x in target for g in grams(x, least, most))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text, _, _ in data:
        g = grams(text, least, most)
        weight = sum(gain[bucket(x)] for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(grams(text, 1, 1)), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    fit = sorted((x for x in out if x[1] >= least_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = fit[: percent * len(fit) // 100]
    return Counter((*x, k) for k, x in enumerate(drawn, 1)) + Counter((*x, None) for x in out) - Counter((*x, None) for x in drawn)


def test_resample(spark, docs, empty):
    target = [rows()[7][1], rows()[8][1], None, ""]
    frame = spark.createDataFrame([(x, 1) for x in target], "text string, bucket int")
    for args in ((10, 20, 1, 1, 10_000), (50, 1, 1, 2, 97), (100, 0, 1, 1, 1)):
        got = importance.resample(docs, frame, *args)
        assert Counter(tuple(r) for r in got.collect()) == brute_resample(rows(), target, *args)
    assert Counter(tuple(r) for r in importance.resample(docs, empty).collect()) == brute_resample(rows(), [], 10, 20, 1, 1, 10_000)
    assert importance.resample(empty, frame).count() == 0


def test_long_units_take_linear_time():
    """Texts without spaces: ids equal the library's, and four times the text takes four times as long, not sixteen."""
    import base64
    import time

    import sentencepiece

    from verdex.llm import sentencepiece_codec

    codec = sentencepiece_codec.Vocabulary.load().codec()
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    r = random.Random(2)
    kinds = [lambda n: base64.b64encode(r.randbytes(n)).decode(), lambda n: "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(n)), lambda n: "".join(r.choice("etaoin=_-.,;(){}é中😀") for _ in range(n)), lambda n: "a" * n, lambda n: "tion" * n]
    for kind in kinds:
        for n in (49, 257, 1000, 20_000):
            t = kind(n)
            assert codec.encode(pa.array([t, None, t + " x"])).to_pylist() == [library.encode(t), [], library.encode(t + " x")]
    took = []
    for n in (100_000, 400_000):
        began = time.process_time()
        codec.encode(pa.array([kinds[0](n)]))
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 1


def test_copies_of_a_text_have_their_spans_once(spark):
    """However many copies there are, one shard holds as many spans as for two."""
    from verdex.llm import suffix_dedup
    from verdex.llm.common import fresh_path

    r = random.Random(8)
    text = "".join(r.choice("abcdefgh ") for _ in range(3009))
    counts = []
    for copies in (2, 600):
        df = spark.createDataFrame([(i, text) for i in range(copies)], "doc_id long, text string").repartition(1 if copies == 2 else 4)
        counts.append(suffix_dedup.spans_of(df.select("text"), fresh_path(spark, "spans"), 6).count())
        out = suffix_dedup.remove_repeats(df, suffix_dedup.find_repeats(df)).collect()
        assert all(x["begins"] == [0] and x["ends"] == [3009] and not x["kept"] for x in out)
    assert counts[0] == counts[1] < 100
