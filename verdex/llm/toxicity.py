"""Toxicity by a counterfactual-regularised linear classifier over the words of a text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.llm import textvec
from verdex.llm.common import cut, lowered, slices, table

#: The classifier is fitted on at most so many labelled rows (those with the lowest digests of their ids).
MAX_LABELLED = 40_000
#: Features are words and the first bytes of longer words, which stand for a stem.
STEMS = (5, 6, 7, 8)
#: A word or stem is a feature if so many labelled texts have it and its rates in the two classes differ by so many standard errors.
MIN_TEXTS, MIN_Z = 5, 3.5
#: Strength of the ridge and of the counterfactual penalty.
RIDGE, PAIRING = 0.1, 5.0
THRESHOLD = 0.7

#: Groups of identity terms that may be swapped for one another.
IDENTITY = (
    ("woman", "man", "girl", "boy", "trans", "nonbinary"),
    ("women", "men", "girls", "boys"),
    ("female", "male"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual", "homosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists", "sikhs"),
    ("black", "white", "asian", "latino", "hispanic", "arab", "african", "european"),
    ("american", "mexican", "chinese", "indian", "russian", "german", "french", "spanish", "polish", "turkish"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young", "elderly", "teenage"),
    # German
    ("frau", "mann", "mädchen", "junge"),
    ("frauen", "männer", "jungen"),
    ("weiblich", "männlich"),
    ("schwul", "lesbisch", "bisexuell", "heterosexuell", "homosexuell"),
    ("muslim", "christ", "jude", "buddhist", "katholik", "atheist"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "katholiken", "atheisten"),
    ("ausländer", "flüchtling", "einwanderer", "migrant"),
    ("flüchtlinge", "einwanderer", "migranten"),
    ("türken", "deutsche", "polen", "russen", "araber", "afrikaner"),
    ("taub", "behindert", "autistisch"),
    # French
    ("femme", "homme", "fille", "garçon"),
    ("femmes", "hommes", "filles", "garçons"),
    ("gay", "lesbienne", "hétérosexuel", "homosexuel", "bisexuel"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "catholique", "athée"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "catholiques", "athées"),
    ("noir", "blanc", "arabe", "asiatique", "africain", "européen"),
    ("immigré", "réfugié", "étranger", "migrant"),
    ("immigrés", "réfugiés", "étrangers", "migrants"),
    ("sourd", "aveugle", "handicapé", "autiste"),
    # Spanish
    ("mujer", "hombre", "chica", "chico", "niña", "niño"),
    ("mujeres", "hombres", "chicas", "chicos", "niñas", "niños"),
    ("gay", "lesbiana", "heterosexual", "homosexual", "bisexual"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "católico", "ateo"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "católicos", "ateos"),
    ("negro", "blanco", "asiático", "latino", "árabe", "africano", "europeo"),
    ("inmigrante", "refugiado", "extranjero", "migrante"),
    ("inmigrantes", "refugiados", "extranjeros", "migrantes"),
    ("sordo", "ciego", "discapacitado", "autista"),
)


def word_hash(word: str) -> np.uint64:
    return textvec.words(pa.array([word]), textvec.ALNUM).hash[0]


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word and stem of the texts."""
    w = textvec.words(lowered(col), textvec.ALNUM)
    stems = [w.prefixes(n) for n in STEMS]
    return np.concatenate([w.row, *(x[0] for x in stems)]), np.concatenate([w.hash, *(x[1] for x in stems)])


def chosen_features(col: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, index in the sorted hashes) pairs of the texts."""
    row, h = features(col)
    if not len(hashes) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    hit = hashes[at] == h
    pairs = np.unique(row[hit] * len(hashes) + at[hit])
    return pairs // len(hashes), pairs % len(hashes)


@dataclass
class Model:
    """Weights by feature hash, sorted; a text's logit is the bias and the weights of its distinct features."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, col: pa.Array) -> np.ndarray:
        row, at = chosen_features(col, self.hashes)
        logits = self.bias + np.bincount(row, self.weights[at], len(col))
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's features: in how many texts, and in how many toxic ones."""
    texts = toxic = 0
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        return h, *(np.bincount(at, np.concatenate([x[k] for x in held]), len(h)).astype(np.int64) for k in (1, 2))

    for b in slices(batches, most=1 << 20):
        y = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        row, h = features(b.column(0))
        _, at = np.unique(h, return_inverse=True)
        _, first = np.unique(row * (len(h) + 1) + at, return_index=True)
        h, at = np.unique(h[first], return_inverse=True)
        held.append((h, np.bincount(at, minlength=len(h)), np.bincount(at, y[row[first]], len(h)).astype(np.int64)))
        texts, toxic, size = texts + len(y), toxic + int(y.sum()), size + len(h)
        if size > 1 << 22:
            held = [merged()]
            size = len(held[0][0])
            if size > 1 << 21:
                yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1]), pa.array(held[0][2])], names=["h", "n", "pos"])
                held, size = [], 0
    if held:
        h, n, pos = merged()
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(pos)], names=["h", "n", "pos"])


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the labelled rows to learn from: crc32(doc_id as text) mod 3 isn't 1, MAX_LABELLED of them at most.

    The chosen labels are MAX_LABELLED rows of two numbers, so they are broadcast; texts don't move. A null label is no
    label; of a doc_id with several labels the highest counts, and of one that several rows have, one row does.
    """
    chosen = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
        .filter(F.crc32(F.encode(F.col("_id").cast("string"), "UTF-8")) % 3 != 1)
        .orderBy(F.xxhash64("_id"), "_id").limit(MAX_LABELLED)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    first = F.min_by("text", F.xxhash64("text"))  # of rows that repeat a doc_id, one, so the rows have the bound of the labels
    return rows.groupBy("_id").agg(first.alias("text"), F.first("toxic").cast("int").alias("toxic")).select("text", "toxic")


def _terms() -> dict[int, np.ndarray]:
    """Of each identity term, by the hash of the word, the hashes of the word and of its stems."""
    return {int(word_hash(x)): features(pa.array([x]))[1] for x in sorted({x for g in IDENTITY for x in g})}


def identity_features(col: pa.Array, hashes: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index in the sorted hashes, distinct words that have it) of the features in `shared`, sorted by row."""
    w = textvec.words(lowered(col), textvec.ALNUM)
    row, h, word = [w.row], [w.hash], [w.hash]
    for n in STEMS:
        long = w.end - w.start > n
        r, x = w.prefixes(n)
        row, h, word = [*row, r], [*h, x], [*word, w.hash[long]]
    row, h, word = (np.concatenate(x) for x in (row, h, word))
    mine = np.isin(h, shared)
    at = np.searchsorted(hashes, h[mine])
    seen = np.unique(np.stack([row[mine].astype(np.uint64), at.astype(np.uint64), word[mine]]), axis=1)
    pairs, n = np.unique(seen[:2].astype(np.int64), axis=1, return_counts=True)
    return pairs[0], pairs[1], n


def _swaps(texts: Iterator[dict[int, int]], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Swaps of an identity term of a text for another term of its group that the text lacks: (swap, feature, sign) of each
    feature that goes or comes, and of each swap how many texts have it.

    A text is the number of its distinct words that have each feature. A feature goes with the term's word unless another
    word has it, and comes with the other term's unless a word that stays has it. Equal swaps are one.
    """
    index = {int(h): i for i, h in enumerate(hashes)}
    own = {index[h]: [index[int(x)] for x in fs if int(x) in index] for h, fs in _terms().items()}
    group: dict[int, set[int]] = {}
    for g in IDENTITY:
        terms = {index[int(word_hash(x))] for x in g}
        for t in terms:
            group[t] = group.get(t, set()) | terms - {t}
    count: Counter = Counter()
    for text in texts:
        for c in text.keys() & group.keys():
            left = {f: text[f] - 1 for f in own[c]}
            for t in group[c] - text.keys():
                gone = [f for f in own[c] if not left[f] and f not in own[t]]
                new = [f for f in own[t] if not text.get(f, 0)]
                count[tuple(sorted(gone)), tuple(sorted(new))] += 1
    rows = [(k, f, sign) for k, (gone, new) in enumerate(count) for sign, fs in ((-1, gone), (1, new)) for f in fs]
    out = np.array(rows, np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2], np.array(list(count.values()), float)


def fit(docs: DataFrame, labels: DataFrame, steps: int = 200) -> Model:
    """Learn which words and stems mark toxic texts.

    Logistic loss with a ridge, plus PAIRING times the squared change of the logit between a labelled text and the same
    text with an identity term swapped for another of its group: the word's and its stems' weights, as the scores change.
    Features are all that the classes have at clearly different rates, counted in Spark, and all identity terms; their
    number is bounded by that of the labelled rows. A null or empty text has no features and counts; a row that repeats
    counts each time; texts of any length are read whole. With no labelled rows every score is 0.5.
    """
    sample = cut(training_rows(docs, labels))
    total = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")).first()
    n_all, n1 = total["n"], total["pos"] or 0
    if not n_all:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    a, b_, p = (F.col("pos") / F.lit(max(n1, 1)), (F.col("n") - F.col("pos")) / F.lit(max(n_all - n1, 1)), F.col("n") / F.lit(n_all))
    z = F.abs(a - b_) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * F.lit(1 / max(n1, 1) + 1 / max(n_all - n1, 1)))
    counted = sample.mapInArrow(_count, "h bigint, n bigint, pos bigint").groupBy("h").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    best = counted.filter(F.col("n") >= MIN_TEXTS).withColumn("z", z).filter(F.col("z") >= MIN_Z).select("h").toPandas()
    identity = np.array([word_hash(x) for g in IDENTITY for x in g], np.uint64)
    hashes = np.union1d(best["h"].to_numpy(np.int64).view(np.uint64), identity)
    shared = np.intersect1d(hashes, np.concatenate(list(_terms().values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 20):
            row, at = chosen_features(b.column(0), hashes)
            ends = np.searchsorted(row, np.arange(len(b) + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32()))
            row, at, n = identity_features(b.column(0), hashes, shared)
            ends = pa.array(np.searchsorted(row, np.arange(len(b) + 1)), pa.int32())
            mine, held = (pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (at, n))
            yield pa.RecordBatch.from_arrays([lists, b.column(1).cast(pa.int32()), mine, held], names=["f", "toxic", "mine", "held"])

    got = sample.mapInArrow(run, "f array<int>, toxic int, mine array<int>, held array<int>").toArrow()
    y = got["toxic"].to_numpy().astype(float)
    lists = [x for x in got["f"].chunks]
    r = np.repeat(np.arange(len(y)), np.concatenate([pa.compute.list_value_length(x).to_numpy(zero_copy_only=False) for x in lists]))
    c = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in lists]).astype(np.int64)
    swap, feature, sign, times = _swaps((dict(zip(f, n, strict=True)) for f, n in zip(got["mine"].to_pylist(), got["held"].to_pylist(), strict=True)), hashes)
    w, b = np.zeros(len(hashes)), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        s = 1 / (1 + np.exp(-np.clip(b + np.bincount(r, w[c], len(y)), -30, 30)))
        g = np.bincount(c, (s - y)[r], len(w)) + RIDGE * w
        change = PAIRING * times * np.bincount(swap, sign * w[feature], len(times))
        g += np.bincount(feature, sign * change[swap], len(w))
        gb = float((s - y).sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 / np.sqrt(1 + step / 50)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return Model(hashes, w, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, over its whole text; null and empty texts get the score of a text without words.

    Only doc_id and text are read: further columns, labels among them, can't take part. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1)))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns unchanged, whose score is below the threshold."""

    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 20):
            text = b.column(b.schema.get_field_index("text"))
            yield b.filter(pa.array(model.scores(text) < threshold))

    return docs.mapInArrow(run, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score and prediction, and whether its label was held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
