"""Two-pass running values and session pairing against plain loops, one key holding most rows in many blocks."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenlog.operators import sessions, system
from lumenlog.operators.prefix import Running, running

BEGIN = datetime(2024, 1, 1)
ACTIONS = "collection string, who string, address string, host string, pid string, daemon string, seq long, ts timestamp, action string"


def make(n=1200, seed=3):
    """90 % of rows have one key and one address."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        hot = rng.random() < 0.9
        who, ip = ("root", "8.8.8.8") if hot else (f"u{rng.randint(0, 3)}", rng.choice(["", "1.2.3.4"]))
        action = rng.choices(["opened", "closed", "accepted", "failed"], [3, 4, 2, 2])[0]
        rows.append(("c", who, ip, f"h{rng.randint(0, 1)}", str(rng.randint(1, 4)), "sshd", i, BEGIN + timedelta(seconds=i), action))
    return rows


def nested(rows):
    """Scan-like order keys: file, block start, row."""
    return [(*r[:6], (f"f{r[6] // 400}", r[6] // 90 * 1000, r[6]), *r[7:]) for r in rows]


def stack_of(rows):
    stacks, want = {}, {}
    for _, who, ip, _, _, _, seq, _, action in rows:
        stack = stacks.setdefault((who, ip), [])
        if action == "closed" and stack:
            want[stack.pop()] = seq
        elif action in ("opened", "accepted"):
            stack.append(seq)
            want[seq] = None
    return want


@pytest.mark.parametrize("bits", [3, 6, 16])
def test_pairing_of_a_hot_key_equals_a_stack(spark, bits):
    rows = make()
    paired = sessions.pair_sessions(spark.createDataFrame(rows, ACTIONS).repartition(7), bits)
    assert {r.seq: r.end_seq for r in paired.collect()} == stack_of(rows)


def test_pairing_by_the_order_key_of_a_scan(spark):
    rows = make(700, 8)
    schema = ACTIONS.replace("seq long", "seq struct<file:string,start:long,row:long>")
    paired = sessions.pair_sessions(spark.createDataFrame(nested(rows), schema).repartition(5), 4).collect()
    assert {r.seq.row: r.end_seq and r.end_seq.row for r in paired} == stack_of(rows)


def test_no_window_holds_a_hot_key(spark):
    """The largest group of any window over rows is a block's; windows over a whole key see a row per block."""
    df = spark.createDataFrame([("c", "root", "8.8.8.8", "h", "1", "sshd", i, BEGIN, "opened" if i % 2 else "closed") for i in range(4096)], ACTIONS)
    plan = sessions.pair_sessions(df, 6)._jdf.queryExecution().optimizedPlan().toString()
    over = [line for line in plan.splitlines() if "Window [" in line]
    assert over and all("block" in line or "group" in line or "depth" in line for line in over)


@pytest.mark.parametrize("bits", [2, 16])
def test_attempt_numbers_of_a_hot_source(spark, bits):
    rows = make(900, 4)
    count, want = {}, {}
    for r in rows:
        if r[8] == "failed":
            count[r[2]] = count.get(r[2], 0) + 1
            want[r[6]] = count[r[2]]
    got = sessions.running_failures(spark.createDataFrame(rows, ACTIONS).repartition(6), bits)
    assert {r.seq: r.attempt for r in got.collect()} == want


@pytest.mark.parametrize("bits", [2, 16])
def test_failures_before_a_close(spark, bits):
    rows = make(900, 5)
    df = spark.createDataFrame(rows, ACTIONS).repartition(6)
    judged = sessions.session_suspicion(sessions.pair_sessions(df, bits), df, 5, bits)
    failed = lambda ip, seq: sum(r[8] == "failed" and r[2] == ip and r[6] <= seq for r in rows)
    ends = {k: v for k, v in stack_of(rows).items() if v is not None}
    got = judged.where("type <> 'SshFailed'").collect()
    assert {r.seq: r.failures for r in got} == {k: failed("" if r_ip == "" else r_ip, v) if r_ip else 0 for k, v in ends.items() for r_ip in [rows[k][2]]}
    assert judged.where("type = 'SshFailed'").count() == sum(r[8] == "failed" for r in rows)


@pytest.mark.parametrize("frame", ["row", "before", "ties"])
def test_running_values_of_every_kind(spark, frame):
    rng = random.Random(1)
    rows = [(rng.choice("aaaab"), i // 2, i % 2, rng.choice([None, rng.randint(-9, 9)])) for i in range(300)]
    wanted = [Running(k, F.col("v"), k) for k in ("sum", "min", "max")] + ([Running("last", F.col("v"), "last")] if frame != "ties" else [])
    order = ["seq"] if frame == "ties" else ["seq", "nth"]
    got = running(spark.createDataFrame(rows, "k string, seq long, nth int, v int").repartition(4), ["k"], wanted, order, frame, bits=3).collect()
    assert len(got) == len(rows)
    for r in got:
        upto = {"row": lambda o, r=r: (o[1], o[2]) <= (r.seq, r.nth), "before": lambda o, r=r: (o[1], o[2]) < (r.seq, r.nth), "ties": lambda o, r=r: o[1] <= r.seq}[frame]
        values = [o[3] for o in rows if o[0] == r.k and upto(o) and o[3] is not None]
        assert (r["sum"], r["min"], r["max"]) == (sum(values), min(values, default=None), max(values, default=None))
        assert frame == "ties" or r["last"] == (values[-1] if values else None)


def test_success_after_failures_of_a_hot_account(spark):
    rng, seen, want = random.Random(6), {}, {}
    rows = []
    for i in range(800):
        acct, ok = ("Root" if rng.random() < 0.9 else f"u{i % 5}"), rng.random() < 0.1
        rows.append(("c", i, "USER_AUTH", BEGIN + timedelta(seconds=i), acct, "x res=success" if ok else "x res=failed"))
        n, last = seen.get(acct.lower(), (0, None))
        if ok and n >= 5:
            want.setdefault(acct.lower(), (i, n, last))
        if not ok:
            seen[acct.lower()] = (n + 1, i)
    df = spark.createDataFrame(rows, "collection string, seq long, type string, ts timestamp, acct string, message string")
    got = system.success_after_failures(df.repartition(5), 5, 3).collect()
    at = lambda t: int((t - BEGIN).total_seconds())
    assert {r.acct: (at(r.ts), r.failures, at(r.last_failure)) for r in got} == want


@pytest.mark.parametrize("bits", [2, 16])
def test_link_by_pid_equals_a_loop(spark, bits):
    rows = make(900, 9)
    login, want = {}, []
    for r in rows:
        key, action, ip = (r[3], r[4]), r[8], r[2]
        held = login.get(key, "")
        if action == "closed":
            ip, login[key] = held or ip, ""
        if action == "accepted":
            login[key] = ip
        if not (action == "opened" and held):
            want.append((r[6], action, ip))
    got = sessions.link_by_pid(spark.createDataFrame(rows, ACTIONS).repartition(5), bits)
    assert sorted((r.seq, r.action, r.address) for r in got.collect()) == want
    bare = spark.createDataFrame([(*r[:4], None if i % 2 else "", *r[5:]) for i, r in enumerate(rows)], ACTIONS)
    assert sessions.link_by_pid(bare).count() == len(rows)


def test_notes_of_a_group_are_those_of_its_first_suspicious_session(spark):
    rows = [("c", "ip", 0, "bob", "sshd", BEGIN, BEGIN, 9, "SshInteractive", k, reason, notes) for k, (reason, notes) in enumerate([(None, "plain"), ("RootSSH", "b"), ("UnusualTime", "a")])]
    df = spark.createDataFrame(rows, "collection string, ip string, failures long, user string, daemon string, start_ts timestamp, end_ts timestamp, seconds long, type string, seq long, reason string, notes string")
    r = sessions.sessions_grouped(df.repartition(3)).first()
    assert (r.n, r.suspicious, r.reason, r.notes) == (3, True, "RootSSH", "b")
    assert sessions.sessions_grouped(df.where("reason is null")).first().notes == ""
