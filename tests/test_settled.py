"""Lines are matched once whatever uses their fields; reports of files classify no line."""

import re
from datetime import datetime

from pyspark.sql import functions as F

from lumenlog.functions import rules
from lumenlog.functions.text import HEADER, extract
from lumenlog.operators import auth, system
from lumenlog.plans.catalogue import QUERIES

AT = datetime(2024, 6, 1)
LINES = [
    "Jan  5 10:00:00 h sshd[12]: Failed password for bob from 8.8.8.8 port 1", "2024-01-05T10:00:00Z h kernel: panic", "no header", "", "Jan  5 10:00:00 h app: a\x01b\x02c",
    "Jan  5 10:00:00 h app: last\n", "Jan  5 10:00:00 h app: two\nlines", "\x01", "# Jan  5 10:00:00 h app: x", "Jan  5 10:00:00 h CRON[1]: (root) CMD (/tmp/x) \x02",
]


def frame(spark, texts=LINES):
    return spark.createDataFrame([("c", i, t, AT) for i, t in enumerate(texts)], "collection string, seq long, line string, file_mtime timestamp")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_header_is_matched_once(spark):
    for parse, classify in ((system.parse_syslog, system.classify_syslog), (system.parse_messages, system.classify_messages), (auth.parse_auth, auth.auth_events_norm)):
        plan = optimized(classify(parse(frame(spark))).where("ts >= timestamp'2024-01-01' and host <> ''"))
        assert plan.count(r"([^\s:\[]+)") == 1
    plan = optimized(system.classify_audit(system.parse_audit(frame(spark))).where("type <> 'PATH'"))
    assert plan.count(r"type=(\w+)") == 1


def test_fields_are_as_extract_gives_them(spark):
    got = {r.seq: r for r in auth.parse_auth(frame(spark)).collect()}
    want = frame(spark).select("seq", *(extract(F.col("line"), HEADER, k).alias(n) for n, k in (("host", 2), ("daemon", 3), ("pid", 4)))).collect()
    assert len(got) == len(LINES)
    for r in want:
        assert (got[r.seq].host, got[r.seq].daemon, got[r.seq].pid) == (r.host, r.daemon or "AUTH", r.pid)
    assert got[4].message == "a\x01b\x02c" and got[5].message == "last" and got[3].message == "" and got[7].message == "\x01"
    cron = system.parse_syslog(frame(spark)).where("cron_cmd <> ''").collect()
    assert [(r.seq, r.cron_user, r.cron_cmd) for r in cron] == [(9, "root", "/tmp/x")]


def test_alternation_finds_what_any_word_is(spark):
    lists = [v for k, v in vars(rules).items() if k.isupper() and isinstance(v, list) and k not in ("SYSTEM_CRITICAL", "MESSAGES_CRITICAL")]
    texts = sorted({t for ws in lists for w in ws for t in (w, w[1:], w[:-1], f"x{w.upper()} y")})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for words in lists:
        hit = {r.t for r in df.where(rules.contains_any(F.col("t"), words)).collect()}
        assert hit == {t for t in texts if any(w.lower() in t.lower() for w in words)}


def test_reports_of_files_classify_nothing(spark):
    for name in ("coverage", "coverage_levels"):
        plan = optimized(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert not re.search("tier|SortAggregate|min_by", plan)
    physical = QUERIES["findings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in physical
