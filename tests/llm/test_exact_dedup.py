import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenlog.llm import exact_dedup as ed
from lumenlog.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, key string, n int, kept boolean"


def brute(rows):
    groups = {}
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted([(i, least[norm(t)], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in rows], key=str)


def answers(df):
    rows = df.collect()
    kept = [r for r in rows if r.kept]
    assert len({r.text_sha256 for r in kept}) == len(kept) == len({r.text_sha256 for r in rows})
    assert all(r.doc_id == r.keep_id for r in kept)
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows], key=str)


def make(seed=3):
    rng = random.Random(seed)
    words = ["a", "b ", " c", "\t", "\n", "\r\n", "\x0b", " ", " ", "é", "\x1c", "  "]
    texts = ["".join(rng.choices(words, k=rng.randint(0, 3))) for _ in range(300)] + [None, "", " ", "x " * 60_000, "x  " * 60_000, "hot"] + ["hot"] * 200
    rows = [(i, t, "k", "key", 1, True) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "only null", None, None, None, None), (None, "only null", None, None, None, None), (None, "a", None, None, None, None)]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = make()
    assert answers(ed.deduplicate_rows(spark.createDataFrame(rows, SCHEMA).repartition(6))) == brute(rows)


def test_hot_groups_and_hits_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(ed, "SENT", 1)
    monkeypatch.setattr(ed, "HUB", 20)
    rows = make(4)
    assert answers(ed.deduplicate_rows(spark.createDataFrame(rows, SCHEMA).repartition(6))) == brute(rows)


def test_full_bytes_are_compared_on_hits(spark, tmp_path):
    """A digest of four values: every hit is a clash, and groups are the same."""
    rows = make(5)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/t")
    run = ed.ExactDedup(spark, f"{tmp_path}/t", f"{tmp_path}/home", digest=lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 4), 2, "0")))
    run.absorb()
    got = run.members().withColumnRenamed("id", "doc_id")
    assert answers(got) == brute(rows)


def test_the_state_goes_on_with_new_files_and_never_expires(spark, tmp_path):
    first, second = make(6), make(7)
    path, home = f"{tmp_path}/t", f"{tmp_path}/home"
    spark.createDataFrame(first, SCHEMA).repartition(3).write.parquet(path)
    ed.ExactDedup(spark, path, home).absorb(1)  # a file a batch
    spark.createDataFrame(second, SCHEMA).repartition(2).write.mode("append").parquet(path)
    run = ed.ExactDedup(spark, path, home)
    run.absorb()
    run.absorb()  # nothing new: nothing changes
    assert answers(run.members().withColumnRenamed("id", "doc_id")) == brute(first + second)
    assert run.state().agg(F.sum("n")).first()[0] == len(first) + len(second)


def test_no_rows(spark):
    assert ed.deduplicate_rows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_main_path_is_native(spark):
    plan = QUERIES["op12_exact_dedup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "MapIn"))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    want = c.execute(ORACLE_SQL["op12_exact_dedup"])
    names = [d[0] for d in want.description]
    got = QUERIES["op12_exact_dedup"](spark, f"/root/testdata/{sf}")
    assert got.columns == names and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
