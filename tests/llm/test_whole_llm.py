"""Training-data operators where a shortcut would lose part of the job, against brute force."""

import random

import numpy as np
import pyarrow as pa

from verdex.llm import decontaminate, toxicity


def five_grams(t):
    w = t.lower().replace("?", " ").replace(".", " ").replace(":", " ").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def share(part, text):
    """Of a part's 5-grams (fewer words: of the whole part) the share that the text has."""
    own, size = five_grams(part), len(next(iter(five_grams(part))))
    w = text.lower().replace("?", " ").replace(".", " ").replace(":", " ").split()
    return len(own & {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}) / len(own)


def test_altered_items_are_found():
    r = random.Random(8)
    pool = [f"w{i}" for i in range(3000)]
    say = lambda n: " ".join(pool[int(3000 * r.random() ** 3)] for _ in range(n))
    items = [say(r.randint(20, 60)) + ". " + say(r.randint(1, 9)) + "." if k % 3 else say(30) + "? Answer: " + say(4) for k in range(60)]
    index = decontaminate.Index.build(list(enumerate(items)))
    texts, asked = [], []
    for k, t in enumerate(items):
        w = t.split(" ")
        for _ in range(20):
            v, n = list(w), r.randint(1, 10)
            i = r.choice([0, len(v) - n, r.randrange(len(v))])  # a run of words at the start, the end or anywhere, or one word
            if r.random() < 0.5:
                v[i : i + n] = []
            else:
                v[r.randrange(len(v))] = "other"
            texts.append(" ".join(v))
            asked.append(k)
    got = index.hits(pa.array(texts))
    want = []
    for t, k in zip(texts, asked, strict=True):
        parts = decontaminate.question_and_answer(items[k])
        want.append(share(items[k], t) >= 0.8 or min(share(p, t) for p in parts if p.strip()) >= 0.8)
    assert [k in {h["item_id"] for h in hits} for k, hits in zip(asked, got, strict=True)] == want
    assert 300 < sum(want) < 1200


def test_most_lost_is_the_most():
    r = random.Random(2)
    for n in [3, 9, 10, 12, 13, 14]:
        for _ in range(4):
            h = np.array([r.randrange(1 << 60) for _ in range(n)], np.uint64)
            mass = np.array([r.random() ** 3 for _ in range(n)])
            size = min(5, n)
            room = int(0.2 * (n - size + 1) + 1e-9)
            best = 0.0
            for absent in range(1 << n):
                if sum(any(absent >> i & 1 for i in range(s, s + size)) for s in range(n - size + 1)) <= room:
                    best = max(best, sum(mass[i] for i in range(n) if absent >> i & 1))
            assert abs(decontaminate.most_lost(h, mass) - best) < 1e-9


def test_swaps_reach_stems(spark):
    r = random.Random(4)
    w = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(1500):
        bad = r.random() < 0.4
        t = [r.choice(w) for _ in range(15)] + (["vilest"] if bad and r.random() < 0.5 else [])
        t += [r.choice(["muslims", "immigrants", "musulmanes", "flüchtlinge"])] if r.random() < (0.8 if bad else 0.05) else []
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    for group in (("muslims", "christians", "atheists"), ("immigrants", "natives"), ("musulmanes", "cristianos"), ("flüchtlinge", "migranten")):
        p = model.scores(pa.array([f"all {x} here" for x in group]))
        logits = np.log(p / (1 - p))
        assert logits.max() - logits.min() < 0.3, (group, logits)


def test_swap_is_the_change_of_the_score():
    r = random.Random(5)
    terms = sorted({x for g in toxicity.IDENTITY for x in g})
    every = np.unique(np.concatenate(list(toxicity._terms().values())))
    model = toxicity.Model(every, np.array([r.random() for _ in every]), 0.0)
    for text in ["muslim muslims x", "christian christians christmas", "homosexual woman", *(" ".join(r.sample(terms, 4)) for _ in range(40))]:
        row, at, n = toxicity.identity_features(pa.array([text]), every, every)
        swap, feature, sign, times = toxicity._swaps([dict(zip(at.tolist(), n.tolist(), strict=True))], every)
        got = np.repeat(np.bincount(swap, sign * model.weights[feature], len(times)), times.astype(int))
        words, want = set(text.split()), []
        logit = lambda ws: float(model.weights[toxicity.chosen_features(pa.array([" ".join(ws)]), every)[1]].sum())
        for c in words:
            others = {x for g in toxicity.IDENTITY if c in g for x in g} - words
            want += [logit(words - {c} | {t}) - logit(words) for t in others]
        assert np.allclose(sorted(got), sorted(want))
