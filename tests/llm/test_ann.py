import numpy as np

from pyspark.sql import functions as F

from lumenlog.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score string, id string"


def brute(rows, queries, k=10):
    good = {}
    for i, e, *_ in rows:
        v = None if not e or any(x is None for x in e) else np.array(e, np.float32).astype(float)
        if i is not None and v is not None and np.isfinite(v).all() and v.any():
            good[i] = v
    out = {}
    for i in queries:
        if i in good:
            d = sorted((float(np.sqrt(((v - good[i]) ** 2).sum())), j) for j, v in good.items() if j != i and len(v) == len(good[i]))
            out[i] = d[:k]
    return out


def data(n, dims, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, dims))
    x = centers[rng.integers(0, 5, n)] + rng.normal(size=(n, dims))
    return [(i, [float(v) for v in np.float32(e)], 0, "s", "x") for i, e in enumerate(x)]


def test_recall_and_exact_scores(spark):
    rows = data(3000, 32)
    df = spark.createDataFrame(rows, SCHEMA)
    got = ann.nearest(df, df.where("vec_id % 100 = 0")).collect()
    want = brute(rows, range(0, 3000, 100))
    vecs = {r[0]: np.array(r[1], np.float32).astype(float) for r in rows}
    hits = 0
    for q, best in want.items():
        mine = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert [m[1:] for m in mine] == sorted(m[1:] for m in mine)
        for _, s, v in mine:
            assert abs(s - np.sqrt(((vecs[v] - vecs[q]) ** 2).sum())) < 1e-12
        hits += len({j for _, j in best} & {m[2] for m in mine})
    assert hits / (10 * len(want)) >= 0.9


def test_few_odd_and_repeated_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0], 1, "", ""), (1, [1.0, 2.0], 1, "", ""), (2, [50.0, -9.0], 1, "", ""), (2, [50.0, -9.0], 1, "", ""), (3, None, 1, "", "")]
    rows += [(4, [0.0, 0.0], 1, "", ""), (5, [nan, 1.0], 1, "", ""), (6, [None, 1.0], 1, "", ""), (7, [1.0, 2.0, 3.0], 1, "", ""), (None, [1.0, 1.0], 1, "", ""), (100, [7.0, 7.0], 1, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = ann.nearest(df, df).collect()
    want = brute(rows, [0, 1, 2, 7, 100])
    assert {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got} == {(q, n, j, round(s, 9)) for q, b in want.items() for n, (s, j) in enumerate(b, 1)}
    assert len(got) == 12
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_blocks_meet_every_query_and_row_once(spark):
    rows = data(300, 8)
    df = spark.createDataFrame([(r[0], r[1], 5) for r in rows], "id long, vec array<double>, bucket long")
    got = ann.ranked(ann.search_buckets(df, df.where("id < 40"), 10, block=16), 10).collect()
    want = brute(rows, range(40))
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == {(q, n, j) for q, b in want.items() for n, (_, j) in enumerate(b, 1)}


def test_the_sample_of_distances_is_that_of_the_least_hashes(spark, monkeypatch):
    """The bound on the hash changes no sample, nor do ids that repeat."""
    monkeypatch.setattr(ann, "FIT_ROWS", 40)
    rng = np.random.default_rng(3)
    for ids in (range(3000), [i % 3 for i in range(3000)], [7] * 500, range(10), []):
        rows = spark.createDataFrame([(int(i), [float(x) for x in rng.normal(size=8)]) for i in ids], "id long, vec array<double>").repartition(4, "id")
        kept = rows.orderBy(F.xxhash64("id"), "id").limit(40).select("vec").collect()
        got = ann.typical_distances(rows)
        if len(set(ids)) == len(list(ids)) and kept:
            x = np.array([r.vec for r in kept])
            d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))[np.triu_indices(len(x), 1)]
            assert abs(got[8] - np.median(d)) < 1e-9
        assert set(got) == ({8} if kept else set())
