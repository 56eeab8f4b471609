"""Golden lines, order-dependent operators against plain loops, scans of real files, and independence of the layout."""

import gzip
import random
from datetime import datetime

from pyspark.sql import functions as F

from lumenlog.functions import rules, text
from lumenlog.functions.timeparse import in_range, parse_ts, valid_ts
from lumenlog.operators import activity, auth, fleet, score, sessions, system
from lumenlog.operators.report import findings
from lumenlog.plans.config import TriageConfig
from lumenlog.sources import files, sinks

AT = datetime(2024, 1, 10)


def lines(spark, texts, **more):
    rows = [("c", i, t, AT, *more.values()) for i, t in enumerate(texts)]
    extra = "".join(f", {k} string" for k in more)
    return spark.createDataFrame(rows, "collection string, seq long, line string, file_mtime timestamp" + extra)


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


def test_timestamps(spark):
    stamps = ["2024-01-02T03:04:05Z a", "2024-01-02T03:04:05+02:00 a", "Jan  5 10:00:00 h a: b", "Dec 31 10:00:00 h a: b", "Feb 29 10:00:00 h a: b", 'x [10/Oct/2023:13:55:36 +0100] "', "msg=audit(1700000000.1:2): x", "none"]
    df = lines(spark, stamps).withColumn("ts", parse_ts(F.col("line"), F.col("file_mtime")))
    got = [r.ts for r in df.orderBy("seq").collect()]
    assert got == [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 1, 4, 5), datetime(2024, 1, 5, 10), datetime(2023, 12, 31, 10), None, datetime(2023, 10, 10, 12, 55, 36), datetime(2023, 11, 14, 22, 13, 20), None]
    kept = df.where(in_range(F.col("ts"), datetime(2024, 1, 1), datetime(2024, 1, 3))).count()
    assert kept == 4  # two in range and two without a time
    assert df.where(valid_ts(F.col("ts"), F.lit(datetime(2024, 6, 1)))).count() == 6


def test_header_is_anchored(spark):
    rows = auth.parse_auth(lines(spark, ["Jan  5 02:17:43 web1 sshd[77]: Failed password for invalid user bob from 1.2.3.4 port 5", "no header", "Jan  5 02:17:43 web1 su: x"])).orderBy("seq").collect()
    assert (rows[0].host, rows[0].daemon, rows[0].pid, rows[0].user, rows[0].ip) == ("web1", "sshd", "77", "bob", "1.2.3.4")
    assert rows[0].message.startswith("Failed password") and rows[1].daemon == "AUTH" and rows[1].message == "no header" and rows[2].daemon == "su"


def test_a_line_may_hold_several_actions(spark):
    df = lines(spark, ["Jan  5 02:17:43 w sshd[1]: Accepted password for bob from 1.2.3.4; session opened for user bob"])
    assert {r.action for r in auth.auth_actions(auth.parse_auth(df)).collect()} == {"accepted", "opened"}


def test_pairing_equals_a_stack(spark):
    rng, rows = random.Random(5), []
    for i in range(1500):
        rows.append(("c", f"u{rng.randint(0, 3)}", rng.choice(["", "1.2.3.4"]), "sshd", i, datetime.fromtimestamp(1_700_000_000 + i), rng.choice(["opened", "closed", "accepted"])))
    df = spark.createDataFrame(rows, "collection string, who string, address string, daemon string, seq long, ts timestamp, action string")
    stacks, want = {}, {}
    for _, who, ip, _, seq, _, action in rows:
        stack = stacks.setdefault((who, ip), [])
        if action == "closed":
            if stack:
                want[stack.pop()] = seq
        else:
            stack.append(seq)
            want[seq] = None
    got = {r.seq: r.end_seq for r in sessions.pair_sessions(df.repartition(7)).collect()}
    assert got == want


def test_record_high_and_folder_cap_equal_a_loop(spark):
    rng, config = random.Random(2), TriageConfig(body_per_folder=3)
    paths = [f"/tmp/d{rng.randint(0, 3)}/miner{rng.randint(0, 5)}.{rng.choice(['elf', 'x'])}" for _ in range(400)]
    raw = [f"0|{p}|1|r|0|0|{rng.choice([10, 5000])}|1|{1_600_000_000 + i}|1|0" for i, p in enumerate(paths)]
    entries = score.parse_bodyfile(lines(spark, raw).repartition(5))
    best, count = {}, {}
    for r in sorted(score.score_bodyfile(entries, config).collect(), key=lambda r: r.seq):
        folder = r.path.rsplit("/", 1)[0]
        if count.get(folder, 0) >= 3 or (r.path in best and r.score <= best[r.path]):
            continue
        best[r.path], count[folder] = r.score, count.get(folder, 0) + 1
    assert {r.path: r.score for r in score.bodyfile_findings(entries, config).collect()} == best


def test_history_stamps_and_gaps(spark):
    texts = ["ls", "#1700000000", "", "wget http://x", "#1700100000", "#1700100005", "cat /etc/shadow", "history -c", "cat a", "ssh -p 22 root@10.0.0.5"]
    rows = activity.classify_shell(activity.history_commands(lines(spark, texts, username=None).withColumn("username", F.lit("u")))).orderBy("seq").collect()
    assert [r.ts is not None for r in rows] == [False, True, True, False, False, False]
    assert [r.gap_hours for r in rows] == [None, None, 27, None, None, None]
    assert [r.tier for r in rows] == ["Info", "Suspicious", "Critical", "Info", "Info", "Info"] and rows[3].anti_forensics
    edge = activity.lateral_movement(activity.history_commands(lines(spark, texts, username=None).withColumn("username", F.lit("u")))).first()
    assert (edge.as_user, edge.target) == ("root", "10.0.0.5")


def test_syslog_rules(spark):
    texts = ["Jan  5 01:00:00 h CRON[1]: (root) CMD (/tmp/x)", "Jan  5 01:00:00 h CRON[1]: (root) CMD (run-parts /tmp/x)", "Jan  5 01:00:00 h kernel: md0 raid5 degraded", "Jan  5 01:00:00 h systemd[1]: permission denied", "Jan  5 01:00:00 h app[1]: Permission denied", "# x", "nope"]
    rows = system.classify_syslog(system.parse_syslog(lines(spark, texts))).orderBy("seq").collect()
    assert [(r.tier, r.label) for r in rows] == [("Critical", "Suspicious cron job"), ("Info", None), ("Critical", "RAID degraded"), ("Info", None), ("Noise", "permission denied")]


def test_control_bytes_hide_no_request(spark):
    """Signs that part a match's groups, in the line's own text, and line separators after the agent."""
    head = '1.2.3.4 - - [10/Oct/2023:13:55:36 +0100] "GET /../../etc/passwd HTTP/1.1" 200 5 "-" '
    agents = ["x", "x\x01y", "\x01" * 7, "\x02a\x01\x02b", "x\x02", "é"]
    texts = [f'{head}"{a}"' for a in agents] + [head + '"x" tail\u2028more', 'no\x01req\x01uest\x01"a"\x01\x01\x01\x01\x01 "x']
    rows = activity.classify_web(activity.parse_web(lines(spark, texts))).orderBy("seq").collect()
    assert [r.agent for r in rows] == [*agents, "x", ""]
    assert [(r.ip, r.uri, r.status, r.tier) for r in rows[:-1]] == [("1.2.3.4", "/../../etc/passwd", "200", "Critical")] * 7
    assert rows[0].ts == datetime(2023, 10, 10, 12, 55, 36) and (rows[-1].method, rows[-1].message) == ("", texts[-1])


def test_a_web_line_is_matched_once(spark):
    events = activity.classify_web(activity.parse_web(lines(spark, ["x"])))
    plans = [events, activity.web_attack_findings(events), activity.web_bruteforce(activity.parse_web(lines(spark, ["x"])), 1), events.where("attack is not null").groupBy("ip").count()]
    for df in plans:
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1


def test_container_binds(spark):
    def config(binds, privileged="false"):
        return '{"Name":"/a","Config":{"User":"app","Cmd":["run"]},"HostConfig":{"Privileged":' + privileged + ',"Binds":[' + binds + "]}}"

    df = lines(spark, [config('"/data/etc:/etc"'), config('"/etc/x:/y"'), config('"/:/host"', "true"), config('"/var/run/docker.sock:/s"'), "{bad"], container_id="id")
    rows = activity.containers(df).collect()
    assert sorted(len(r.mounts) for r in rows) == [0, 1, 1, 1]
    assert {r.label for r in activity.container_risk(activity.containers(df)).collect()} == {"Dangerous host mount", "Privileged + host mount (escape risk)", "Docker socket mount"}


def test_text_helpers(spark):
    x = F.col("x")
    assert one(spark, "root:$6$abc:1:2", text.redact_shadow(x)) == "root:********:1:2"
    assert one(spark, "a" * 20, text.ellipsis(x, 10)) == "aaaaaaa..."
    assert one(spark, "/a/b.TAR.Gz", text.file_ext(x)) == ".gz" and one(spark, "/a", text.folder_of(x)) == "/"
    assert [one(spark, ip, text.is_public_ip(x)) for ip in ("8.8.8.8", "10.1.1.1", "172.20.0.1", "169.254.1.1", "::1", "host")] == [True, False, False, False, True, False]
    assert [one(spark, p, text.is_public_peer(x)) for p in ("8.8.4.4:53", "10.0.0.1%eth0:22", "*:*")] == [True, False, False]
    assert one(spark, "2024-01-01 10:00:00 pid=77 from 10.0.0.1 took 0xff 5", text.normalize_for_grouping(x)) == "TIMESTAMP PID from IP took HEX N"
    assert one(spark, "95000", text.format_duration(x.cast("long"))) == "1d 2h 23m" and one(spark, "59", text.format_duration(x.cast("long"))) == "59s"
    assert one(spark, "Union+Select", rules.first_match(x, rules.URI_ATTACKS)) == "union+select" and one(spark, "no", rules.first_match(x, rules.URI_ATTACKS)) is None
    assert one(spark, "x (root) CMD (a b)", text.cron_command_of(x)) == "a b"


def test_netstat_tail(spark):
    rows = fleet.parse_sockets(lines(spark, ["tcp 0 0 0.0.0.0:22 0.0.0.0:* LISTEN 812/sshd", "tcp 0 0 10.0.0.1:5 8.8.4.4:443 ESTABLISHED 9/curl"])).orderBy("seq").collect()
    assert [(r.state, r.port, r.process) for r in rows] == [("LISTEN", 22, "sshd/812"), ("ESTABLISHED", 5, "curl/9")]


def test_scans_keep_line_order(spark, tmp_path):
    root = tmp_path / "uac-host1" / "root" / "var" / "log"
    root.mkdir(parents=True)
    (root / "auth.log").write_text("".join(f"line {i}\n" for i in range(5000)))
    with gzip.open(root / "auth.log.2.gz", "wt") as f:
        f.write("old\n")
    (root / "auth.log.swp").write_text("no\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.scan_rotated_logs(spark, str(tmp_path), "auth.log").orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line for r in rows] == [f"line {i}" for i in range(5000)] + ["old"] and {r.collection for r in rows} == {"uac-host1"}
    home = tmp_path / "uac-host1" / "root" / "home" / "bob"
    home.mkdir(parents=True)
    (home / "bash_history.txt").write_text("ls\n")
    assert files.scan_shell_history(spark, str(tmp_path)).first().username == "bob"
    live = tmp_path / "uac-host1" / "live_response"
    live.mkdir()
    (live / "ss.txt").write_text("tcp LISTEN 0 1 0.0.0.0:22 0.0.0.0:*\n")
    (live / "netstat.txt").write_text("other\n")
    assert [r.line[:3] for r in files.scan_live_dumps(spark, str(tmp_path), "sockets").collect()] == ["tcp"]
    box = tmp_path / "uac-host1" / "containers" / "abc"
    box.mkdir(parents=True)
    (box / "config.v2.json").write_text('{"Name":"/n",\n"Config":{}}')
    assert activity.containers(files.scan_container_configs(spark, str(tmp_path))).first().container_id == "abc"


def test_sinks_overwrite_by_partition(spark, tmp_path):
    rows = auth.auth_events_norm(auth.parse_auth(lines(spark, ["Jan  5 02:17:43 w su: a, \"b\""])))
    out = str(tmp_path / "events")
    for _ in range(2):
        sinks.write_events_norm(rows.drop("seq"), out, "csv")
    got = spark.read.option("header", "true").option("escape", '"').csv(out).collect()
    assert len(got) == 1 and got[0].message == 'a, "b"' and got[0].ts == "2024-01-05T02:17:43.000Z"
    grouped = system.syslog_findings(system.classify_syslog(system.parse_syslog(lines(spark, ["Jan  5 01:00:00 h kernel: panic 7"] * 3))))
    sinks.write_findings(findings(grouped, "SYSLOG", "HIGH", "key"), str(tmp_path / "f"))
    assert "(x3)" in spark.read.parquet(str(tmp_path / "f")).first().text
