import math
import random
import zlib
from collections import defaultdict

import pytest

from lumenlog.llm import toxicity as tox

SCHEMA = "doc_id long, text string, lang string, score string, label int"


def test_learner_against_a_plain_loop():
    rng = random.Random(1)
    z, n = defaultdict(float), defaultdict(float)
    model, bits = tox.Ftrl(1 << 12), 12
    for k in range(60):
        text = " ".join(rng.choice("ab cd ef gh slur mean".split()) for _ in range(rng.randint(0, 9)))
        label = int("slur" in text)
        at = tox.features(text.encode(), bits)
        w = {}
        for i in at.tolist():
            l1 = 0 if i == 0 else tox.L1
            w[i] = 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((tox.BETA + math.sqrt(n[i])) / tox.ALPHA + tox.L2)
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i in w:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / tox.ALPHA * w[i]
            n[i] += g * g
        model.learn(at, label)
    assert all(abs(model.z[i] - v) < 1e-9 for i, v in z.items()) and all(abs(model.n[i] - v) < 1e-9 for i, v in n.items())


def test_skip_grams_are_features():
    a, b = (set(tox.slots(t).tolist()) for t in (b"you utter clown", b"you complete clown"))
    assert len(a & b) >= 3  # you, clown, and the pair around the middle word


def test_held_out_accuracy_and_edge_cases(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 6 == 0
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 60))]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["Grobian!", "nitwit", "nitwits"]))
        rows.append((i, " ".join(words), "en", "s", 9))
        labels.append((i, int(toxic)))
    rows += [(2000, None, None, None, 9), (2001, "", "", "", 9), (None, "nitwit", "", "", 9), (2002, "w1 " * 60_000 + "nitwit", "", "", 9), (5, rows[5][1], "", "", 9)]
    labels += [(2000, 0), (None, 1), (7, None), (8, 3), (9999, 1)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = tox.with_toxicity(docs, marks)
    assert set(got.columns) == {"doc_id", "text", "lang", "label", "held_out", "score", "predicted"}
    got = got.collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out and r.doc_id < 1200]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[2002].predicted == by[None].predicted == 1 and by[2000].score == by[2001].score < 0.3
    assert tox.with_toxicity(docs.limit(0), marks).count() == 0
    assert {r.score for r in tox.with_toxicity(docs.where("doc_id < 5"), marks.limit(0)).collect()} == {0.5}


def plain_features(text):
    """Slots by plain numbers: words, stems, neighbours, neighbours but one."""
    found = "".join(c.lower() if c.isascii() else c for c in text or "")
    found = [x.encode() for x in "".join(c if c.isalnum() and c.isascii() or not c.isascii() else " " for c in found).split(" ") if x]
    crc, cut, out = zlib.crc32, (1 << 64) - 1, {0}
    hashed = [crc(x) * 0x9E3779B97F4A7C15 for x in found] + [crc(x[:k], k) * 0xD6E8FEB86659FD93 for x in found for k in tox.STEMS if len(x) > k]
    for gap, salt in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        hashed += [(crc(a) * salt + crc(b)) * 0x9E3779B97F4A7C15 for a, b in zip(found, found[gap:], strict=False)]
    return sorted(out | {(h & cut) >> (64 - tox.BITS) for h in hashed})


def plain_scores(docs, labels, learners):
    shares = defaultdict(list)
    for i, label in labels:
        crc = None if i is None else zlib.crc32(str(i).encode())
        if label in (0, 1) and crc is not None and crc % 4 != 2:
            shares[crc // 4 % learners] += [(i, label, (t or "").encode()) for d, t, *_ in docs if d == i]
    total = defaultdict(float)
    for rows in shares.values():
        z, n = defaultdict(float), defaultdict(float)

        def weight(i, z=z, n=n):
            l1 = 0 if i == 0 else tox.L1
            return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((tox.BETA + math.sqrt(n[i])) / tox.ALPHA + tox.L2)

        for _ in range(tox.EPOCHS):
            for _, label, text in sorted(rows):
                at = plain_features(text.decode())
                w = [weight(i) for i in at]
                g = 1 / (1 + math.exp(-max(-30, min(30, sum(w))))) - label
                for i, x in zip(at, w, strict=True):
                    z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / tox.ALPHA * x
                    n[i] += g * g
        for i in list(z):
            total[i] += weight(i) / learners
    return [1 / (1 + math.exp(-max(-30, min(30, sum(total[i] for i in plain_features(t)))))) for _, t, *_ in docs]


@pytest.mark.parametrize("per_learner", [10_000, 60])
def test_whole_scores_against_brute_force(spark, monkeypatch, per_learner):
    """Choice of labels, shares, order, epochs, average and scores, by one learner and by several."""
    monkeypatch.setattr(tox, "LEARNER_ROWS", per_learner)
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(60)] + ["Über", "grübeln", "vile", "clown"]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 30))), "en", "s", 1) for i in range(260)]
    docs += [(900, None, None, None, None), (901, "", "", "", 1), (902, "VILE-clown, vile clown!", "", "", 1), (None, "clown", "", "", 1), docs[4]]
    labels = [(i, int("vile" in t or "clown" in t)) for i, t, *_ in docs[:240]] + [(900, 0), (901, 1), (4, 1), (None, 1), (7, None), (8, 3), (5000, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = sum(1 for i, label in labels if label in (0, 1) and i is not None and zlib.crc32(str(i).encode()) % 4 != 2)
    want = sorted(zip([str(d[0]) for d in docs], plain_scores(docs, labels, max(1, -(-rows // per_learner))), strict=True))
    got = sorted((str(r.doc_id), r.score) for r in tox.with_toxicity(spark.createDataFrame(docs, SCHEMA).repartition(3), frame).collect())
    assert [i for i, _ in got] == [i for i, _ in want] and max(abs(a - b) for (_, a), (_, b) in zip(got, want, strict=True)) < 1e-9
