import hashlib
import math
from fractions import Fraction

import duckdb
import numpy as np

from lumenlog.llm import centroids
from lumenlog.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<double>, cluster string, inertia int"


def brute(rows, rounds=10, k=8):
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in e]) for i, e, *_ in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest())
    centres = [q for _, q in order[:k]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        of = [near(q)[1] for _, q in kept]
        for j in range(len(centres)):
            own = [q for (_, q), at in zip(kept, of, strict=True) if at == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [(i, *near(q)) for i, q in kept]
    inertia = {j: sum(d for _, d, at in last if at == j) for j in range(len(centres))}
    fit = lambda x: x if x < 1 << 63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted([(i, at, fit(d), fit(inertia[at]), fit(sum(inertia.values())), sha[at]) for i, d, at in last], key=str)


def answers(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def make(n, seed=4):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(11, 64))
    return [(i, [float(x) for x in middles[rng.integers(11)] + rng.normal(size=64) * 0.4], "c", 1) for i in range(n)]


def test_against_brute_force(spark):
    nan, inf = float("nan"), float("inf")
    rows = make(300)
    rows += [(300 + i, e, "c", 1) for i, e in enumerate([None, [], [1.0] * 63, [1.0] * 65, [nan] + [0.0] * 63, [inf] + [0.0] * 63, [None] + [0.0] * 63, [0.0] * 64, [-0.0] * 64])]
    rows += [rows[0], (400, rows[1][1], None, None), (None, rows[2][1], "c", 1)]
    assert answers(centroids.cluster(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_large_components_are_exact(spark):
    rows = [(i, [x * 1e9 if i % 3 else x * 1e30 for x in e], "c", 1) for i, e, *_ in make(40)] + [(40 + i, *r) for i, *r in make(20, 5)]
    assert answers(centroids.cluster(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_few_vectors_and_none(spark):
    rows = make(3)
    assert answers(centroids.cluster(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert centroids.cluster(spark.createDataFrame([(1, None, "c", 1)], SCHEMA)).count() == 0
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    same = [(i, [0.5] * 64, "c", 1) for i in range(20)]
    assert {r[1] for r in answers(centroids.cluster(spark.createDataFrame(same, SCHEMA)))} == {0}


def test_progressive_search_gives_up_worse_centroids_only():
    rng = np.random.default_rng(1)
    smooth = np.cumsum(rng.integers(-40, 40, (2000, 64)), axis=1)
    centres = np.array([smooth[5], smooth[9], smooth[5], smooth[70], *smooth[100:104]])
    at, distance, finished = centroids.nearest(smooth, centres)
    full = ((smooth[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (distance == full.min(axis=1)).all() and (at == full.argmin(axis=1)).all()
    assert finished < 0.6 * full.size  # vectors whose energy is in coarse coefficients finish few pairs


def test_transform_is_exact_and_ordered():
    eye = centroids.walsh(np.eye(64, dtype=np.int64) * 1)
    assert (eye @ eye.T == 64 * np.eye(64)).all()
    assert [int((np.diff(c) != 0).sum()) for c in eye.T] == list(range(64))


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = c.execute(ORACLE_SQL["op13_centroids"])
    names = [d[0] for d in want.description]
    got = QUERIES["op13_centroids"](spark, sf)
    assert got.columns == names and answers(got) == sorted(want.fetchall(), key=str)
