"""Normalised events, date ranges, staging of hidden files and fleet lists against expectations written by hand."""

import dataclasses
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lumenlog.operators import auth, fleet
from lumenlog.plans.config import TriageConfig
from lumenlog.plans.registry import LOG_TYPES, dated, normalised_events, register
from lumenlog.sources import files

AT = datetime(2024, 1, 10)


def lines(spark, texts, artifact=""):
    return spark.createDataFrame([("c", i, t, AT, artifact) for i, t in enumerate(texts)], "collection string, seq long, line string, file_mtime timestamp, artifact string")


def test_events_of_two_types_in_a_range(spark):
    texts = {
        "secure": ["Jan  5 10:00:00 h sshd[1]: Failed password for bob from 8.8.8.8 port 1 ssh2", "Jan  7 10:00:00 h sshd[1]: Accepted password for bob from 8.8.8.8 port 1", "no time"],
        "syslog": ["Jan  5 10:00:01 h CRON[1]: (root) CMD (/tmp/x)", "Jan  5 10:00:00 h app[1]: permission denied"],
    }
    config = TriageConfig(start=datetime(2024, 1, 5, 10), end=datetime(2024, 1, 6))
    rows = normalised_events(lambda s: lines(spark, texts[s]), config, ["SECURE", "SYSLOG"]).orderBy("log_type", "ts").collect()
    assert [(r.log_type, str(r.ts), r.daemon, r.user, r.ip, r.severity) for r in rows] == [
        ("SECURE", "None", "AUTH", "", "", "Info"),
        ("SECURE", "2024-01-05 10:00:00", "sshd", "bob", "8.8.8.8", "Medium"),
        ("SYSLOG", "2024-01-05 10:00:01", "CRON", "root", "", "High"),
    ]


def test_registered_type_is_used(spark):
    register(dataclasses.replace(LOG_TYPES["AUTH"], name="OTHER", source="other"))
    try:
        assert [r.log_type for r in normalised_events(lambda s: lines(spark, ["x"]), TriageConfig(), ["OTHER"]).collect()] == ["OTHER"]
    finally:
        del LOG_TYPES["OTHER"]


def test_hidden_history_is_staged(spark, tmp_path):
    home = tmp_path / "uac-h1" / "home" / "bob"
    home.mkdir(parents=True)
    (home / ".bash_history").write_text("ls\nwget http://x\n")
    with pytest.raises(FileNotFoundError):
        files.scan_shell_history(spark, str(tmp_path / "uac-h1"))
    assert files.stage_shell_history(spark, str(tmp_path / "uac-h1"), str(tmp_path / "laid")) == 1
    rows = files.scan_shell_history(spark, str(tmp_path / "laid")).orderBy("seq").collect()
    assert [(r.collection, r.username, r.line) for r in rows] == [("uac-h1", "bob", "ls"), ("uac-h1", "bob", "wget http://x")]
    (tmp_path / "none").mkdir()
    assert files.scan_shell_history(spark, str(tmp_path / "none")).count() == 0


def test_a_hundred_homes_are_staged_by_tasks_and_once(spark, tmp_path):
    root, laid = tmp_path / "trees", tmp_path / "laid"
    for i in range(100):
        home = root / f"uac-h{i % 7}" / "home" / f"u{i}"
        home.mkdir(parents=True)
        (home / ".bash_history").write_text(f"ls {i}\n")
    (root / "uac-h0" / "home" / "u0" / "bash_history.txt").write_text("visible\n")
    with pytest.raises(FileNotFoundError):  # hidden ones beside a visible one are not dropped silently
        files.scan_shell_history(spark, str(root))
    assert files.stage_shell_history(spark, str(root), str(laid)) == 100
    rows = files.scan_shell_history(spark, str(laid)).collect()
    assert sorted((r.username, r.line) for r in rows) == sorted((f"u{i}", f"ls {i}") for i in range(100)) and {r.collection for r in rows} == {f"uac-h{k}" for k in range(7)}
    (root / "uac-h1" / "home" / "u1" / ".bash_history").write_text("more than before\n")
    assert files.stage_shell_history(spark, str(root), f"file://{laid}") == 100
    staged = spark.read.parquet(str(laid / "_staged"))
    assert staged.where("copied").count() == 1 and "more than before" in {r.line for r in files.scan_shell_history(spark, str(laid)).collect()}


def test_rows_of_several_times_in_a_range(spark):
    config = TriageConfig(start=datetime(2024, 1, 5), end=datetime(2024, 1, 6))
    rows = [(1, None, None), (2, datetime(2024, 1, 5), None), (3, datetime(2023, 1, 1), datetime(2024, 1, 6)), (4, datetime(2023, 1, 1), datetime(2025, 1, 1)), (5, None, datetime(2025, 1, 1))]
    df = spark.createDataFrame(rows, "id int, a timestamp, b timestamp")
    assert [r.id for r in dated(df, config, "a", "b").orderBy("id").collect()] == [1, 2, 3]


def test_containers_are_events(spark):
    text = '{"Name":"/a","Created":"2024-01-05T10:00:00.123456789Z","State":{"Status":"up"},"Config":{"Image":"i","User":"app"},"HostConfig":{"Privileged":true,"PidMode":"host","Binds":["/etc/x:/y"]}}'
    df = spark.createDataFrame([("c", "id1", text), ("c", "id2", '{"Name":"/b","Created":"?"}')], "collection string, container_id string, line string")
    rows = normalised_events(lambda s: df, TriageConfig(start=datetime(2024, 1, 1), end=datetime(2024, 2, 1)), ["DOCKER"]).orderBy("raw").collect()
    assert [(r.log_type, r.daemon, r.severity, r.message, r.raw) for r in rows] == [
        ("DOCKER", "docker", "Critical", "Container=a Image=i State=up [PRIVILEGED] [HOST_PID] [MOUNTS:/etc/x:/y]", "ID=id1 Name=a Image=i"),
        ("DOCKER", "docker", "Medium", "Container=b Image= State=", "ID=id2 Name=b Image="),
    ]
    assert (str(rows[0].ts)[:19], rows[1].ts) == ("2024-01-05 10:00:00", None)


def test_sketches_of_days_add_up(spark):
    """20,000 users of one hot address over five days, each seen on three of them, within three standard errors."""
    actions = spark.range(60_000).selectExpr(
        "'c' as collection", "'failed' as action", "if(id % 10 = 0, '1.1.1.1', '8.8.8.8') as address", "concat('u', id % 20000) as who", "timestamp_seconds(1704067200 + (id % 5) * 86400 + id div 60) as ts"
    )
    days = auth.login_sketches(actions)
    got = {r.ip: r for r in auth.bruteforce_of_sketches(days.where("day < '2024-01-03'").unionByName(days.where("day >= '2024-01-03'")), 5).collect()}
    exact = {r.address: (r.n, r.u) for r in actions.groupBy("address").agg(F.count("*").alias("n"), F.count_distinct("who").alias("u")).collect()}
    for ip, (n, users) in exact.items():
        assert got[ip].n == n and abs(got[ip].users / users - 1) < 3 * 1.04 / 64
    assert auth.bruteforce_of_sketches(days, 10**6).count() == 0


def test_open_files_and_trees(spark):
    rows = lines(spark, ["a TCP x (deleted)", "b UDP", "bash", "plain"], "lsof").unionByName(lines(spark, ["init---Bash", "cron"], "pstree"))
    assert sorted((r.kind, r.line) for r in fleet.open_file_hits(rows).collect()) == [("deleted", "a TCP x (deleted)"), ("shell", "init---Bash"), ("socket", "a TCP x (deleted)"), ("socket", "b UDP")]


IP_A = """1: lo: <LOOPBACK,UP> mtu 65536 qdisc noqueue
    link/loopback 00:00:00:00:00:00 brd 00:00:00:00:00:00
    inet 127.0.0.1/8 scope host lo
    inet6 ::1/128 scope host
2: eth0@if5: <BROADCAST,UP> mtu 1500
    link/ether 52:54:00:12:34:56 brd ff:ff:ff:ff:ff:ff
    inet 10.0.0.5/24 brd 10.0.0.255 scope global eth0
    inet 10.0.0.6/24 brd 10.0.0.255 scope global secondary eth0
    inet6 fe80::5054:ff:fe12:3456/64 scope link"""
IFCONFIG = """        inet 192.168.7.7  netmask 255.255.255.0
eth1: flags=4163<UP,BROADCAST>  mtu 1500
        inet 10.0.0.9  netmask 255.255.255.0  broadcast 10.0.0.255
        inet6 2001:db8::9  prefixlen 64  scopeid 0x0<global>
        ether 52:54:00:12:34:57  txqueuelen 1000
wlan0     Link encap:Ethernet  HWaddr 52:54:00:12:34:58
          inet addr:172.16.0.3  Bcast:172.16.255.255  Mask:255.255.0.0
          inet6 addr: fe80::3/64 Scope:Link"""


def test_addresses_of_whole_dumps(spark):
    """Each file has its own interfaces, whatever the order of the rows of two dumps of a collection."""
    both = [("a", t) for t in IP_A.splitlines()] + [("b", t) for t in IFCONFIG.splitlines()]
    rows = [("c", i, t, AT, "ip", f) for i, (f, t) in enumerate(both)]
    rows += [("c", 90, "nameserver 8.8.8.8", AT, "resolv", "r"), ("c", 91, "default via 10.0.0.1 dev eth0", AT, "route", "r"), ("c", 92, "2: inet x", AT, "hosts", "r")]
    df = spark.createDataFrame(rows, "collection string, seq long, line string, file_mtime timestamp, artifact string, file_path string")
    got = [(r.kind, r.name, r.value) for r in fleet.net_config(df.repartition(4)).orderBy("seq", "value").collect()]
    assert got == [
        ("address", "lo", "127.0.0.1"), ("address", "lo", "::1"), ("address", "eth0", "10.0.0.5"), ("address", "eth0", "10.0.0.6"), ("address", "eth0", "fe80::5054:ff:fe12:3456"),
        ("address", "unknown", "192.168.7.7"), ("address", "eth1", "10.0.0.9"), ("address", "eth1", "2001:db8::9"), ("address", "wlan0", "172.16.0.3"), ("address", "wlan0", "fe80::3"),
        ("resolver", "", "8.8.8.8"), ("default_route", "", "default via 10.0.0.1 dev eth0"),
    ]
    assert fleet.net_config(df.drop("file_path")).where("kind = 'address'").count() == 10


def test_lists_are_cut_in_order(spark):
    sockets = fleet.parse_sockets(lines(spark, [f"tcp LISTEN 0 1 0.0.0.0:{p} 0.0.0.0:*" for p in range(20, 0, -1)]))
    assert [r.port for r in fleet.listeners_shown(sockets).orderBy("rank").collect()] == list(range(1, 11))
    assert [r.line for r in fleet.recent_files_shown(lines(spark, ["a", "c", " ", "b"], "recent"), 2).orderBy("rank").collect()] == ["c", "b"]
