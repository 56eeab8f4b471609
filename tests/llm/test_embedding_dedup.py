from itertools import combinations

import numpy as np

from lumenlog.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, component_id string, same int"


def brute(rows):
    vecs = {}
    for i, e, label, *_ in rows:
        v = None if e is None or any(x is None for x in e) else np.array(e, np.float32).astype(float)
        if label is not None and v is not None and np.isfinite(v).all() and v.any():
            vecs[i] = (label, v)
    up = {i: i for i, *_ in rows}
    links = dict.fromkeys(up, 0)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(vecs, 2):
        (la, x), (lb, y) = vecs[a], vecs[b]
        if la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
            links[a] += 1
            links[b] += 1
            p, q = sorted((root(a), root(b)))
            up[q] = p
    return {i: (links[i], root(i), root(i) == i) for i in up}


def make(seed=2):
    rng, rows = np.random.default_rng(seed), []
    for _ in range(30):
        c = rng.normal(size=24)
        for _ in range(rng.integers(1, 12)):
            v = c + rng.normal(size=24) * rng.choice([0.0, 0.1, 0.3])
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)], int(rng.integers(0, 2)), "c", 1))
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 24, [nan] * 24, [inf] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 0.0], [2.0, 0.0], [-0.0, 1.0], [0.0, 1.0], [5.0], [7.0], [-7.0]]
    rows += [(len(rows) + k, e, 1, "c", 1) for k, e in enumerate(odd)]
    rows += [(len(rows) + k, rows[0][1], None, "c", 1) for k in range(2)]
    return rows


def answers(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_against_brute_force(spark):
    rows = make()
    assert answers(ed.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    rows = make(5)
    monkeypatch.setattr(ed.link_vectors, "__defaults__", (ed.THRESHOLD, 4))
    assert answers(ed.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_empty(spark):
    assert ed.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z
    met = (ed.buckets(x)[..., :, None] == ed.buckets(y)[..., None, :]).any(axis=(1, 2, 3))
    assert met.mean() > 0.999
