import random
import re

from lumenlog.llm import licenses

SCHEMA = "doc_id long, text string, spans string, score int, row long"


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    at, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        hit = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += hit
        labels |= {label} if hit else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_against_brute_force_and_added_labels(spark):
    rng = random.Random(3)
    words = "alpha MIT License, apache general public license Ähre x9 <b> LICENSE mit".split()
    texts = [None, "", "mit", "MIT_license mit-License mit license", "General  public\nlicense general public license"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    planted = {}
    for label, notice in licenses.TEMPLATES:
        planted[len(texts)] = label
        texts.append("lead words here " + notice + " trailing words é")
    texts += ["filler " * 40_000 + "Released under the MIT License.", "word " * 3 + " ".join(["Licensed under CC BY-NC 4.0."] * 300)]
    rows = [(i, t, "x", 1, 7) for i, t in enumerate(texts)] + [(None, "the MIT license", "x", 1, 7), (3, texts[3], "x", 1, 7)]
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "the MIT license" if r.doc_id is None else texts[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        if r.doc_id in planted:
            assert planted[r.doc_id] in r.labels.split(",") and r.score == 1
            assert (3, 3 + len(licenses.words(licenses.TEMPLATES[r.doc_id - 65][1].encode()))) in [(s.start, s.end) for s in r.spans]
    many = next(r for r in got if r.doc_id == len(texts) - 1)
    assert many.labels == "cc-by-nc" and len(many.spans) == 300


def test_edited_notice_is_one_span(spark):
    words = licenses.TEMPLATES[1][1].split()
    edited = words[:7] + ["inserted"] + words[7:12] + words[13:]
    docs = spark.createDataFrame([(1, " ".join(["a", "b", *edited, "c"]))], "doc_id long, text string")
    r = licenses.scan(docs).first()
    assert r.labels == "mit" and r.base_labels == "" and len(r.spans) == 1
    assert (r.spans[0].start, r.spans[0].end) == (2, 2 + len(edited))
    assert licenses.scan(docs.limit(0)).count() == 0


def voted(text):
    """Spans by plain loops: every pair of places whose four words are equal, diagonals in order, gaps of over three part them."""
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    w, out = fold(text), []
    for label, notice in licenses.TEMPLATES:
        t = fold(notice)
        hits = sorted((i - j, i, j) for i in range(len(w) - 3) for j in range(len(t) - 3) if w[i : i + 4] == t[j : j + 4])
        groups = []
        for h in hits:
            if groups and h[0] - groups[-1][-1][0] <= licenses.DRIFT:
                groups[-1].append(h)
            else:
                groups.append([h])
        for g in groups:
            cover = len({j + k for _, _, j in g for k in range(4)}) / len(t)
            if cover >= licenses.COVER:
                out.append((label, min(i for _, i, _ in g), max(i for _, i, _ in g) + 4, cover))
    return sorted(out)


def test_spans_labels_and_scores_against_brute_force(spark):
    """Templates cut, with words put in, left out and swapped, twice in a text, side by side, and close variants."""
    rng, texts = random.Random(11), [None, "", "a b c", "Licensed under CC BY"]
    notices = [n for _, n in licenses.TEMPLATES]
    for _ in range(220):
        parts = []
        for notice in rng.choices(notices, k=rng.randint(1, 3)):
            w = notice.split()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.choice([0, 1, 2])] = rng.choice([[], ["new"], ["two", "more"], w[:2]])
                w = w or ["x"]
            parts += w[: rng.choice([99, 99, len(w) * 3 // 4, 6])] + ["gap"] * rng.choice([0, 1, 4, 9])
        texts.append(" ".join(parts))
    rows = [(i, t, "x", 1, 7) for i, t in enumerate(texts)]
    for r in licenses.scan(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect():
        spans, (_, n_base, _, _, base) = voted(texts[r.doc_id]), brute(texts[r.doc_id])
        assert sorted((s.label, s.start, s.end, s.cover) for s in r.spans) == spans, texts[r.doc_id]
        assert r.labels == ",".join(sorted({s[0] for s in spans} | set(filter(None, base.split(",")))))
        assert abs(r.score - max([s[3] for s in spans] + [0.5 if n_base else 0.0])) < 1e-12
