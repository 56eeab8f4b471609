import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lumenlog.llm import hmm

SCHEMA = "doc_id long, text string, lang string, score string, n long"


def split(text):
    return [*(text or "").encode().lower().split(), hmm.END]


def brute(rows):
    train = Counter()
    for i, t, *_ in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(split(t))
    total, size = sum(train.values()), len(train)
    return train, total, {i: (len(split(t)), sum(train[w] > 0 for w in split(t)), sum(np.log10((train[w] + 1) / (total + size + 1)) for w in split(t))) for i, t, *_ in rows}


def rows_of(seed=3, n=160):
    rng, rows = random.Random(seed), []
    langs = [[f"{p}{i}" for i in range(60)] for p in ("the", "der", "élé")]
    for i in range(n):
        words = rng.choice(langs)
        rows.append((i, " ".join(rng.choice(words) if rng.random() < 0.9 else f"rare{rng.randint(0, 999)}" for _ in range(rng.randint(1, 300))), "x", "y", 1))
    rows += [(1000, None, None, None, None), (1001, "", "", "", 1), (1002, "Only ONE", "", "", 1), (1003, "the1 " * 30_000, "", "", 1), (None, "the1 null", "", "", 1)]
    return rows


def test_base_counts_and_held_out_gain(spark, monkeypatch):
    monkeypatch.setattr(hmm, "SYMBOLS", 60)
    monkeypatch.setattr(hmm, "KNOWN", 140)
    rows = rows_of()
    train, total, want = brute(rows)
    got = hmm.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.score < 0
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_edge_tables(spark):
    assert hmm.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = hmm.score_documents(spark.createDataFrame([(held, "a b", "", "", 1)], SCHEMA)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and np.isfinite(r.score)


def plain_forward(m, seq):
    a, log = m.start * m.emit[seq[0]], 0.0
    for s in seq[1:]:
        a = (a @ m.step) * m.emit[s]
    return np.log10(a.sum()) + log


def test_forward_is_exact_and_counts_match_posteriors():
    rng = np.random.default_rng(1)
    shares = rng.dirichlet(np.ones(12))
    m = hmm.Hmm.random(shares)
    docs = [rng.integers(0, 12, n).astype(np.uint16) for n in (1, 2, 5, 30, 7, 1, 60)]
    assert np.allclose(m.log10_likelihoods(docs), [plain_forward(m, d) for d in docs])
    # expected counts as derivatives of the log likelihood: count(step i->j) = step[i, j] * d log P / d step[i, j]
    seqs = [(d, True) for d in docs]
    got = m.counts(seqs)
    like = lambda: sum(plain_forward(m, d) for d in docs) * np.log(10)
    for i, j in ((0, 0), (1, 3), (5, 2)):
        old, h = m.step[i, j], 1e-6
        m.step[i, j] = old + h
        up = like()
        m.step[i, j] = old - h
        down = like()
        m.step[i, j] = old
        assert abs(got[1 + i, j] - old * (up - down) / (2 * h)) < 1e-5
    assert np.isclose(got[1 + hmm.STATES :].sum(), sum(map(len, docs))) and np.isclose(got[0].sum(), len(docs))
    assert np.allclose(got[1 + hmm.STATES :].sum(axis=1), np.bincount(np.concatenate(docs), minlength=12))


def test_passes_raise_the_likelihood():
    rng = np.random.default_rng(4)
    shares = np.ones(20) / 20
    docs = [np.concatenate([rng.integers(0, 10, 40), rng.integers(10, 20, 40)]).astype(np.uint16) for _ in range(30)]
    m, before = hmm.Hmm.random(shares), -np.inf
    for _ in range(6):
        now = m.log10_likelihoods(docs).sum()
        assert now > before - 1e-6
        before, m = now, hmm.Hmm.fitted(m.counts([(d, True) for d in docs]), shares)


def test_passes_cover_all_documents_by_shares_and_whole(spark, monkeypatch):
    monkeypatch.setattr(hmm, "SYMBOLS", 30)
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randint(0, 19) + 20 * (i % 2)}" for _ in range(rng.randint(1, 12))) for i in range(3600)]
    docs = spark.createDataFrame([(i, False, bytearray(t.encode())) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text binary")
    lex = hmm.lexicon(hmm.word_counts(docs))
    coded = hmm.encode(docs, lex).where("symbols is not null").select("row", "symbols", "doc_id").cache()
    share = F.pmod(F.xxhash64("symbols", "doc_id"), F.lit(hmm.SHARES)).alias("share")
    whole = [(r.share, (np.frombuffer(r.symbols, np.uint16), True)) for r in coded.select("symbols", share).collect()]
    m = trained([[s for at, s in whole if at == k] for k in range(hmm.SHARES)], lex.shares(), hmm.Hmm.counts, lambda m, segs: m.log10_likelihoods([s for s, _ in segs]).sum())
    for _ in range(hmm.FULL):
        m = hmm.Hmm.fitted(m.counts([s for _, s in whole]), lex.shares())
    got = hmm.train(coded, lex)
    assert np.allclose(got.start, m.start) and np.allclose(got.step, m.step) and np.allclose(got.emit, m.emit)


def plain_counts(m, segments):
    """Expected counts by the plain forward and backward recursion, position by position."""
    out, later = np.zeros((1 + hmm.STATES + len(m.emit), hmm.STATES)), np.linalg.matrix_power(m.step, 64)[0]
    for seq, first in segments:
        alpha = [(m.start if first else later) * m.emit[seq[0]]]
        for s in seq[1:]:
            alpha.append((alpha[-1] / alpha[-1].sum() @ m.step) * m.emit[s])
        beta = [np.ones(hmm.STATES)]
        for s in reversed(seq[1:]):
            b = m.step @ (m.emit[s] * beta[0])
            beta.insert(0, b / b.sum())
        gamma = [a * b / (a @ b) for a, b in zip(alpha, beta, strict=True)]
        out[0] += gamma[0] * first
        for t, s in enumerate(seq):
            out[1 + hmm.STATES + s] += gamma[t]
            if t:
                x = alpha[t - 1][:, None] * m.step * (m.emit[s] * beta[t])[None, :]
                out[1 : 1 + hmm.STATES] += x / x.sum()
    return out


def plain_log(m, seq):
    log, a = 0.0, m.start * m.emit[seq[0]]
    for s in seq[1:]:
        log, a = log + np.log10(a.sum()), (a / a.sum() @ m.step) * m.emit[s]
    return log + np.log10(a.sum())


def trained(of_share, shares, counts, likelihood):
    """Passes over the shares: every start over the first ones, the likeliest on the last share over the rest."""
    tried = []
    for s in range(hmm.STARTS):
        m, kept = hmm.Hmm.random(shares, hmm.SEED + s), 0.0
        for k in range(hmm.TRIED):
            kept = hmm.FADE * kept + counts(m, of_share[k])
            m = hmm.Hmm.fitted(kept, shares)
        tried.append((likelihood(m, of_share[-1]), -s, m, kept))
    _, _, m, kept = max(tried, key=lambda t: t[:2])
    for k in range(hmm.TRIED, hmm.SHARES):
        kept = hmm.FADE * kept + counts(m, of_share[k])
        m = hmm.Hmm.fitted(kept, shares)
    return m


def test_scores_against_brute_force(spark, monkeypatch):
    """score as a whole: symbols, shares, passes, forward pass and words within their class, all anew from the texts."""
    monkeypatch.setattr(hmm, "SYMBOLS", 40)
    monkeypatch.setattr(hmm, "KNOWN", 90)
    rows = [r for r in rows_of(8, 50) if r[0] != 1003]
    train, total, _ = brute(rows)
    known = [w for w in sorted(train, key=lambda w: (-train[w], w)) if w != hmm.END][:40]
    at = {w: 1 + k for k, w in enumerate(known)} | {hmm.END: 0}
    symbol = lambda w: at.get(w, 41 + hmm.shape(w) if w else 0)
    mass = np.ones(hmm.CLASSES)
    for w, n in train.items():
        if w not in at:
            mass[hmm.shape(w)] += n + 1
    shares = np.concatenate(([train[hmm.END] + 1], [train[w] + 1 for w in known], mass))
    shares = shares / shares.sum()
    docs = {i: np.array([symbol(w) for w in split(t)], np.uint16) for i, t, *_ in rows}
    coded = spark.createDataFrame([(i, bytearray(d.tobytes())) for i, d in docs.items()], "doc_id long, symbols binary")
    share = {r.doc_id: r.share for r in coded.select("doc_id", F.pmod(F.xxhash64("symbols", "doc_id"), F.lit(hmm.SHARES)).alias("share")).collect()}
    parts = {i: [(d[lo : lo + hmm.SEGMENT], lo == 0) for lo in range(0, len(d), hmm.SEGMENT)] for i, d in docs.items() if i is None or zlib.crc32(str(i).encode()) % 7 != 2}
    of_share = [[s for i, segs in parts.items() if share[i] == k for s in segs] for k in range(hmm.SHARES)]
    last = [docs[i] for i in parts if share[i] == hmm.SHARES - 1]
    m = trained(of_share, shares, plain_counts, lambda m, _: sum(plain_log(m, d) for d in last))
    for _ in range(hmm.FULL):
        m = hmm.Hmm.fitted(plain_counts(m, [s for segs in parts.values() for s in segs]), shares)
    for r in hmm.score_documents(spark.createDataFrame(rows, SCHEMA)).collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        log = plain_log(m, docs[r.doc_id]) + sum(np.log10((train[w] + 1) / mass[hmm.shape(w)]) for w in split(text) if w not in at)
        assert abs(r.score - log) < 1e-6 * abs(log), r.doc_id


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(hmm, "SYMBOLS", 60)
    monkeypatch.setattr(hmm, "KNOWN", 140)
    df = spark.createDataFrame(rows_of(6, 120), SCHEMA)
    one, *others = ({r.doc_id: r.score for r in hmm.score_documents(part).collect()} for part in (df.coalesce(1), df.repartition(7), df.repartition(3, "text")))
    for other in others:
        assert all(abs(one[k] - other[k]) <= 1e-9 * abs(one[k]) for k in one)
