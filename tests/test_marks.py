"""Reports out of one pass: logs read once, two rotated files by hand, texts and counts."""

from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lumenlog.operators import auth, marks, report, system
from lumenlog.plans import catalogue

AT = datetime(2024, 1, 10)


@pytest.mark.parametrize("name", ["findings", "per_log_status", "global_summary", "coverage", "coverage_levels"])
def test_each_log_is_read_once(spark, monkeypatch, name):
    asked, read = Counter(), catalogue.lines
    monkeypatch.setattr(catalogue, "lines", lambda s, d, source: asked.update([source]) or read(s, d, source))
    df = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    for log in ("auth", "syslog", "messages", "audit", "web", "crontab", "history", "journal"):
        assert asked[log] == 1
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    read = [line for line in plan.splitlines() if "Relation [" in line]
    assert sum("l_orderkey" in line for line in read) == 1 and sum("o_orderkey" in line for line in read) == 2  # web; syslog, messages
    assert len(plan) < 400_000


def rotated(spark):
    fail = "Failed password for bob from 8.8.8.8 port 1 ssh2"
    texts = [("auth.log", f"Jan  5 10:00:0{i} h sshd[1]: {fail}") for i in range(4)] + [("auth.log", "no time here")]
    texts += [("auth.log.1", f"Jan  4 10:00:0{i} h sshd[1]: {fail}") for i in range(3)]
    texts += [("auth.log.1", "Jan  4 11:00:00 h sudo: eve : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/bash"), ("auth.log.1", "Jan  4 12:00:00 h sshd[1]: Accepted password for eve from 9.9.9.9 port 1")]
    rows = [("c", i, t, AT, f) for i, (f, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "collection string, seq long, line string, file_mtime timestamp, file_path string").repartition(4)


def sums_of(spark):
    parsed = auth.parse_auth(rotated(spark))
    sums = marks.tally(parsed, "AUTH", marks.auth_marks(), F.lit(datetime(2024, 6, 1)))
    return marks.settled_logins(sums, 5)


def test_two_rotated_files(spark):
    sums = sums_of(spark)
    levels = {(r.level, r.file_path): (r.files, r.rows, r.first_ts and str(r.first_ts)) for r in marks.coverage_levels(sums).collect()}
    assert levels == {
        ("file", "auth.log"): (1, 5, "2024-01-05 10:00:00"), ("file", "auth.log.1"): (1, 5, "2024-01-04 10:00:00"),
        ("log_type", ""): (2, 10, "2024-01-04 10:00:00"), ("collection", ""): (2, 10, "2024-01-04 10:00:00"),
    }
    found = {(r.severity, r.key): (r.n, str(r.first_ts)) for r in marks.findings(sums).collect()}
    assert found == {
        ("BRUTEFORCE", "8.8.8.8"): (7, "2024-01-04 10:00:00"), ("MEDIUM", "8.8.8.8 user=bob"): (7, "2024-01-04 10:00:00"), ("MEDIUM", "eve from 9.9.9.9"): (1, "2024-01-04 12:00:00"),
        ("HIGH", "eve ran: /bin/bash"): (1, "2024-01-04 11:00:00"),
    }
    assert [(r.files, r.suspicious, r.status) for r in marks.per_log_status(sums).collect()] == [(2, 4, "4 suspicious")]
    summary = {(r.section, r.item): r.n for r in marks.global_summary(sums).collect()}
    assert summary == {
        ("rows", ""): 10, ("files", ""): 2, ("suspicious", ""): 4, ("pattern", "Failed login"): 7, ("pattern", "Sudo command"): 1, ("pattern", "Successful login"): 1,
        ("ip", "8.8.8.8"): 7, ("ip", "9.9.9.9"): 1, ("finding", "8.8.8.8"): 7, ("finding", "eve ran: /bin/bash"): 1,
    }


def test_more_findings_than_shown_and_a_clean_log(spark):
    texts = [f"Jan  5 01:00:00 h kernel: panic {w}" for w in "abcdefgh"] + ["Jan  5 01:00:00 h x: fine"]
    df = spark.createDataFrame([("c", i, t, AT) for i, t in enumerate(texts)], "collection string, seq long, line string, file_mtime timestamp")
    events = system.classify_syslog(system.parse_syslog(df))
    sums = marks.tally(events, "SYSLOG", marks.OF_LOG["SYSLOG"](), F.lit(datetime(2024, 6, 1)))
    got = {(r.section, r.rank): r.n for r in marks.global_summary(sums).where("section <> 'pattern'").collect()}
    assert got == {("rows", 1): 9, ("files", 1): 1, ("suspicious", 1): 8, ("more", 1): 3} | {("finding", k): 1 for k in range(1, 6)}
    clean = marks.tally(events.where("tier = 'Info'"), "SYSLOG", marks.OF_LOG["SYSLOG"](), F.lit(datetime(2024, 6, 1)))
    assert [(r.files, r.status) for r in marks.per_log_status(clean).collect()] == [(1, "clean")]


def test_a_key_counts_by_file(spark):
    texts = [("a", 3), ("b", 2)]
    rows = [("c", i * 10 + k, "Jan  5 01:00:00 h kernel: panic 7", AT, f) for i, (f, n) in enumerate(texts) for k in range(n)]
    df = spark.createDataFrame(rows, "collection string, seq long, line string, file_mtime timestamp, file_path string")
    events = system.classify_syslog(system.parse_syslog(df))
    assert [r.n for r in system.syslog_findings(events).collect()] == [5]
    assert sorted((r.file_path, r.n) for r in system.syslog_findings(events, per_file=True).collect()) == texts


def test_texts_of_findings(spark):
    rows = report.with_text(marks.findings(sums_of(spark))).collect()
    assert {r.text for r in rows if r.severity == "BRUTEFORCE"} == {"[AUTH] [BRUTEFORCE] [2024-01-04 10:00:00 → 2024-01-05 10:00:03 UTC (x7)] failed logins from 8.8.8.8"}
