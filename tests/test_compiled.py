"""Logs' marks run in code that Spark generates, in methods short enough that the JVM compiles them."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lumenlog.functions import rules
from lumenlog.functions.timeparse import parse_ts
from lumenlog.operators import auth, marks
from lumenlog.plans.registry import LOG_TYPES
from lumenlog.sources.derive import lines

AT = datetime(2024, 2, 1)
STAMPS = [
    "2024-01-05T10:00:00Z h a: x", "2024-01-05T10:00:00.5+02:00 h a: x", "2024-13-05T10:00:00Z h a: x", "Jan  5 10:00:00 h a: x", "Feb  1 23:00:00 h a: x", "Dec 31 10:00:00 h a: x", "Feb 29 10:00:00 h a: x",
    "Xyz  5 10:00:00 h a: x", "anF  5 10:00:00 h a: x", "Jan 32 10:00:00 h a: x", "[05/Jan/2024:10:00:00 +0130] x", "Jan  5 10:00:00 h a: [06/Jan/2024:10:00:00 +0000]", "[32/Jan/2024:10:00:00 +0000] x",
    "type=A msg=audit(1700000000.1:2): x", "msg=audit(99999999999999999999.1:2)", "2024-13-05T10:00:00Z msg=audit(1700000000.1:2)", "none", "",
]


def frame(spark, texts):
    return spark.createDataFrame([("c", i, t, AT, "f") for i, t in enumerate(texts)], "collection string, seq long, line string, file_mtime timestamp, file_path string")


@pytest.mark.parametrize("name", ["AUTH", "SYSLOG", "MESSAGES", "WEB", "AUDIT"])
def test_marks_are_compiled(spark, name):
    kind = LOG_TYPES[name]
    rows = lines(spark, "/root/testdata/sf0.001", kind.source)
    rows, found = (auth.parse_auth(rows), marks.auth_marks()) if name == "AUTH" else (kind.events(rows), marks.OF_LOG[name]())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = marks.tally(rows, name, found, F.lit(AT)).drop("example")._jdf.queryExecution()
        nodes = [n for n in plan.executedPlan().toString().splitlines() if re.search("RLIKE|regexp_", n)]
        assert nodes and all(re.match(r"[\s:+-]*\*\(", n) for n in nodes)
        codegen = plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
        assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", codegen)) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_stamps_are_as_parse_ts_gives_them(spark):
    rows = frame(spark, STAMPS)
    want = {r.seq: r.ts for r in rows.select("seq", parse_ts(F.col("line"), F.col("file_mtime")).alias("ts")).collect()}
    assert {r.seq: r.ts for r in auth.parse_auth(rows).collect()} == want
    assert sum(t is not None for t in want.values()) == 9


def test_patterns_are_found_where_any_is(spark):
    texts = ["kernel: RAID x degraded", "raid degrade", "xmd0 is degraded", "m degraded", "oo m", "zoom", "I/O Error", "", "panic", "no"]
    for patterns in (rules.SYSTEM_CRITICAL, ["a?b", "c"], ["x|y", "zoo"]):
        got = {r.line for r in frame(spark, texts).where(rules.matches_any(F.col("line"), patterns)).collect()}
        assert got == {t for t in texts if any(re.search(p, t.lower()) for p in patterns)}
