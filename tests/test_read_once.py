"""Lines that are read several times are parsed once."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lumenlog.functions import text
from lumenlog.operators import auth
from lumenlog.operators.group import read_once
from lumenlog.plans.catalogue import QUERIES


@pytest.mark.parametrize("name", ["sessions_by_start", "session_suspicion", "session_stats", "sessions_grouped", "sessions_paired", "sessions_linked", "session_types"])
def test_sessions_parse_their_lines_once(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan


def test_rows_read_once_are_the_same(spark):
    rows = [("a", (1, None), None), ("a", (1, None), None), (None, None, 2.5), ("", ("2", 3), float("nan"))]
    df = spark.createDataFrame([(r[0], r[1] and (str(r[1][0]), r[1][1]), r[2]) for r in rows], "k string, seq struct<file:string,row:long>, v double")
    once = read_once(df)
    assert once.columns == df.columns and once.exceptAll(df).isEmpty() and df.exceptAll(once).isEmpty() and once.count() == 4
    assert once.where("k = 'a'").join(once.groupBy("k").agg(F.count("*").alias("n")), "k").select("n").collect() == [(2,), (2,)]


def test_actions_spared_the_patterns_are_the_same(spark):
    """Most lines are settled by their small letters and by having no point; what is found is what the patterns find."""
    texts = [
        "Jan  5 10:00:00 h sshd[1]: SESSION Opened for User bob from 1.2.3.4", "session closed for user ", "session closed for user b 9.9.9", "Kession opened for user x", "İ session opened for user İ",
        "Failed password for invalid user al from 10.0.0.1; accepted PASSWORD for al from 10.0.0.2; session opened for user al; Session closed for user al", "Failed password for al from 10.0.0", "ſession opened for user bob",
        "sudo: bob : TTY=p ; PWD=/ ; USER=root ; COMMAND=/bin/ls 8.8.8.8", "session  opened for user bob", "", None,
    ]
    rows = spark.createDataFrame([("c", i, t, datetime(2024, 6, 1)) for i, t in enumerate(texts)], "collection string, seq long, line string, file_mtime timestamp")
    parsed = auth.parse_auth(rows)
    line = F.col("line")
    plain = parsed.withColumn("ip", F.regexp_extract(line, text.IPV4, 0)).select("seq", F.explode(F.array(*auth.actions_of_line().values())).alias("a")).where("a is not null")
    want = sorted(plain.select("seq", "a.action", "a.who", "a.address", "a.command").collect())
    assert sorted(auth.auth_actions(parsed).select("seq", "action", "who", "address", "command").collect()) == want and len(want) == 7  # line 5 has four, 0, 2 and 8 have one
    narrow = auth.session_actions(parsed).select("seq", "action", "who", "address").collect()
    assert sorted(narrow) == [r[:4] for r in want if r.action != "sudo"]
    assert [r.ip for r in parsed.where("line is null or line = ''").orderBy("seq").collect()] == ["", None]


def test_addresses_are_looked_for_in_actions_that_need_one(spark):
    """The parser's column of addresses is not worked out for every line."""
    plan = QUERIES["failed_logins_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    projects = [n for n in plan.splitlines() if "Project [" in n]
    assert projects and not any("25[0-5]" in n for n in projects)
