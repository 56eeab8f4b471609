import random

import numpy as np
from pyspark.sql import functions as F

from lumenlog.llm import langid

WORDS = {
    "en": "the and that with which there have from this would about their people because".split(),
    "de": "der und nicht ein ist auch werden für über schön zwischen jedoch möglich".split(),
    "fr": "le les dans est une avec pour être où déjà voilà français leçon".split(),
}
SCHEMA = "doc_id long, text string, lang string, source string, language int"


def corpus(n=300, seed=3):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randint(1, 80))), lang, f"s{i % 3}", 7))
    return rows


def test_documents(spark):
    rows = corpus()
    odd = [(1000, None, None, None, 7), (1001, "", "xx", "", 7), (1002, "123 !!", None, "s0", 7), (1003, "der " * 60_000, "de", "s1", 7), (None, "the people", "en", "s2", 7), (5, *rows[5][1:])]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    model = langid.train(docs)
    out = langid.identify_documents(docs, model)
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "language", "posterior", "text_language", "accepted"}
    got = out.collect()
    assert len(got) == len(rows) + len(odd)
    plain = [r for r in got if r.doc_id is not None and r.doc_id < 1000]
    assert all(r.accepted for r in plain) and np.mean([r.language == r.lang for r in plain]) > 0.98
    by = {r.doc_id: r for r in got}
    assert not any(by[i].accepted for i in (1000, 1001, 1002)) and by[1003].language == "de" and by[None].accepted
    assert langid.identify_documents(docs.limit(0), model).count() == 0
    none = langid.train(docs.limit(0))
    assert {r.accepted for r in langid.identify_documents(docs, none).collect()} == {False}


def test_text_evidence_is_the_sum_of_log_shares(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    model = langid.train(docs)
    text = "Voilà, the 3 people!".encode()
    folded = b" voil\xc3\xa0 the people "
    want = np.zeros(len(model.languages))
    grams = [folded[i : i + 3] for i in range(len(folded) - 2)]
    for g in grams:
        slot = ((g[0] << 16 | g[1] << 8 | g[2]) * 2654435761 & 0xFFFFFFFF) >> 16
        want += model.logs[slot]
    want *= min(langid.CAP, langid.TEMPER * len(grams)) / len(grams)
    assert np.allclose(model.evidence(text), want, rtol=1e-4)


def test_declaration_and_host_decide_what_text_leaves_open(spark):
    model = langid.train(spark.createDataFrame(corpus(), SCHEMA))
    rng, rows = random.Random(1), []
    for i in range(200):
        lang = ("de", "fr")[i % 2]
        body = "" if i % 10 > 7 else " ".join(rng.choices(WORDS[lang], k=30))
        rows.append((i, f"https://www.{lang}host.{'com' if i % 4 < 2 else lang}/x", f'<html lang="{lang}"><script>the people</script><p>{body}</p>'))
    rows += [(500, "http://x.com", None), (501, None, "<p>the people that would</p>"), (502, "not a url", "<html lang=zz>the people because")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in langid.identify_pages(pages, model).collect()}
    assert len(got) == len(rows)
    for i in range(200):
        assert got[i].language == ("de", "fr")[i % 2]
        assert got[i].accepted == (i % 10 <= 7) == (got[i].text_language is not None)
    assert got[501].language == got[502].language == "en" and not got[500].accepted


def test_foreign_and_random_texts_are_not_accepted(spark):
    rng, clean = random.Random(8), corpus()
    model = langid.train(spark.createDataFrame(clean, SCHEMA))
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(300)) for _ in range(20)]
    foreign = [
        "Съешь же ещё этих мягких французских булок, да выпей чаю, а потом приходи к нам в гости",
        "いろはにほへと ちりぬるを わかよたれそ つねならむ うゐのおくやま けふこえて",
        "Zażółć gęślą jaźń, bo wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
    ]
    rows = clean + [(1000 + i, t, None, "s0", 7) for i, t in enumerate(noise + foreign)]
    got = {r.doc_id: r.accepted for r in langid.identify_documents(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert all(got[r[0]] for r in clean) and not any(got[1000 + i] for i in range(len(noise + foreign)))


def test_every_language_is_learnt_and_rare_ones_keep_all_rows(spark):
    rng = random.Random(2)
    rows = [(f"l{k:02d}", " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{rng.choice('aeiou')}" for _ in range(9))) for k in range(70) for _ in range(3)]
    rows += [("big", f"{rng.choice('xyz')}{rng.choice('aeiou')} " * rng.randint(1, 40)) for _ in range(3000)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    few, all_rows = langid.train(docs, rows=400), langid.train(docs, rows=10_000)
    assert few.languages == all_rows.languages == sorted({r[0] for r in rows})
    rare = [k for k, name in enumerate(few.languages) if name != "big"]
    assert np.allclose(few.logs[:, rare], all_rows.logs[:, rare])


def test_hot_hosts_are_dealt_and_nothing_changes(spark, monkeypatch):
    """Beyond the broadcast bound, a host of nine tenths of the rows is dealt over parts; every posterior stays."""
    rows = [(i, t, lang, "hot" if i % 10 else f"s{i % 7}", 7) for i, t, lang, *_ in corpus(400, 5)]
    docs = spark.createDataFrame([*rows, (None, "the people", "en", None, None), rows[3]], SCHEMA).repartition(5)
    model = langid.train(docs)
    answers = lambda df: sorted(((r.doc_id or -1, r.language, round(r.posterior, 9), r.accepted) for r in df.collect()), key=str)
    sent = answers(langid.identify_documents(docs, model))
    monkeypatch.setattr(langid, "BROADCAST_HOSTS", 0)
    monkeypatch.setattr(langid, "HUB", 50)
    out = langid.identify_documents(docs, model)
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "language", "posterior", "text_language", "accepted"}
    assert answers(out) == sent and len(sent) == 402


def plain_fusion(rows, model):
    """rows: (declared, suffix, host, text). Evidence multiplied out by plain loops: text, declaration, and host smoothed to
    suffix to all, each row's own share left out of host and suffix."""
    names, n = model.languages, len(model.languages)
    kinds = [*names, "other", "none"]
    guess = {(k, m): 0.6 if k == m else 0.25 if k == "none" else 0.05 if k == "other" else 0.1 / n for k in kinds for m in names}
    seen = []
    for declared, suffix, host, text in rows:
        e, other = model.weighed((text or "").encode())
        d = "none" if not declared else declared.lower() if declared.lower() in names else "other"
        if len(e):
            p = [np.exp(x) for x in np.append(e, other + np.log(langid.FOREIGN)) - max(*e, other)]
            seen.append((d, suffix or "", host or "", [x / sum(p) for x in p[:n]], e, other))
        else:
            seen.append((d, suffix or "", host or "", None, e, other))
    own = lambda test: np.sum([p for d, s, h, p, *_ in seen if p is not None and test(d, s, h)] or [[0.0] * n], axis=0)
    table = {k: own(lambda d, s, h, k=k: d == k) for k in kinds}
    said = {(k, m): (table[k][i] + langid.SMOOTHING * guess[k, m] / sum(guess[x, m] for x in kinds)) / (sum(table[x][i] for x in kinds) + langid.SMOOTHING) for k in kinds for i, m in enumerate(names)}
    smooth = lambda c, above: (c + langid.SMOOTHING * above) / (c.sum() + langid.SMOOTHING)
    whole = smooth(own(lambda d, s, h: True), np.full(n, 1 / n))
    out = []
    for d, s, h, p, e, other in seen:
        less = np.zeros(n) if p is None else np.array(p)
        prior = smooth(np.maximum(own(lambda d, x, y, s=s, h=h: (x, y) == (s, h)) - less, 0), smooth(np.maximum(own(lambda d, x, y, s=s: x == s) - less, 0), whole))
        like = np.array([said[d, m] for m in names])
        post = prior * like * (np.exp(e - (e.max() if len(e) else 0)) if len(e) else 1.0)
        none = langid.FOREIGN * np.exp(other - e.max()) * like.mean() if len(e) else 0.0
        post = post / (post.sum() + none)
        out.append((names[int(post.argmax())], float(post.max()), bool(len(e) and post.max() >= langid.ACCEPT)))
    return out


def test_fused_posteriors_against_brute_force(spark):
    model = langid.train(spark.createDataFrame(corpus(), SCHEMA))
    rng, rows = random.Random(12), []
    for _ in range(150):
        lang, host = rng.choice(list(WORDS)), rng.choice(["a.de", "b.de", "c.fr", "d.com", None])
        body = " ".join(rng.choices(WORDS[lang] + ["12", "zq"], k=rng.choice([0, 1, 2, 20])))
        rows.append((rng.choice([lang, "EN", "xx", "", None]), host and host.rsplit(".", 1)[1], host, rng.choice([body, body, "9 9", None, "щука жила"])))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, declared string, suffix string, host string, text string").repartition(4)
    got = langid.identify(df, model, F.col("text"), F.col("declared"), F.col("suffix"), F.col("host")).orderBy("id").collect()
    for r, (language, posterior, accepted) in zip(got, plain_fusion(rows, model), strict=True):
        assert abs(r.posterior - posterior) < 1e-6 and r.accepted == accepted and (r.language == language or posterior < 0.51)
