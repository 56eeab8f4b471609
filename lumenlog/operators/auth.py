"""Authentication logs: fields, actions, logins, sudo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions import rules
from lumenlog.functions.text import AUTH_USERS, HEADER, ellipsis, extract, extract_ipv4, first_of, groups_of, message_of, part_of, settled
from lumenlog.functions.timeparse import ts_of, ts_steps
from lumenlog.operators.group import carried, read_once

OPENED = r"(?i)session opened for user (\w+)"
CLOSED = r"(?i)session closed for user (\w+)"
FAILED = r"(?i)Failed password for (?:invalid user )?(\w+) from (\d{1,3}(?:\.\d{1,3}){3})"
ACCEPTED = r"(?i)Accepted password for (\w+) from (\d{1,3}(?:\.\d{1,3}){3})"
#: What a line that matches has in small letters, looked for before the pattern.
HINTS = {OPENED: "session opened for user ", CLOSED: "session closed for user ", FAILED: "failed password for ", ACCEPTED: "accepted password for "}
SUDO = r"(?i):\s+(\w+)\s+:\s+TTY=.*?;\s+PWD=.*?;\s+USER=.*?;\s+COMMAND=(.+)$"


def parse_auth(lines: DataFrame) -> DataFrame:
    """Adds ts, host, daemon (AUTH if none), pid, ip, user, message; lines without a timestamp keep a null one."""
    line, mtime = F.col("line"), F.col("file_mtime")
    rows = settled(lines, lambda parts: {"line": line, "ts": ts_of(line, mtime), "parts": parts}, groups_of(line, HEADER, (2, 3, 4, 5)), steps=ts_steps(line, mtime))
    part = lambda k: part_of(F.col("parts"), k, 4, line)
    user = first_of(*[extract(line, p) for p in AUTH_USERS])
    return rows.select(
        "collection", "seq", "line", "ts", part(1).alias("host"), F.coalesce(F.nullif(part(2), F.lit("")), F.lit("AUTH")).alias("daemon"), part(3).alias("pid"),
        extract_ipv4(line).alias("ip"), user.alias("user"), message_of(line, part(4)).alias("message"), *carried(lines),
    )


def actions_of_line(low: Column | None = None, ip: Column | None = None) -> dict[str, Column]:
    """The actions of a line, of which there may be several, by name: (action, who, address, command, label), null if the line has none of that name.

    low: the line in small letters, if at hand, to spare most lines the patterns. ip: the line's address, a column by default.
    """
    line, first_ip = F.col("line"), F.col("ip") if ip is None else ip

    def action(name: str, pattern: str, label: str, ip: bool = False, command: bool = False):
        user = extract(line, pattern, 1)
        address = extract(line, pattern, 2) if ip else first_ip
        cmd = F.trim(extract(line, pattern, 2)) if command else F.lit("")
        row = F.struct(F.lit(name).alias("action"), user.alias("who"), address.alias("address"), cmd.alias("command"), F.lit(label).alias("label"))
        hit = line.rlike(pattern)
        return F.when(hit if low is None or pattern not in HINTS else low.contains(HINTS[pattern]) & hit, row)

    return {
        "opened": action("opened", OPENED, "Session opened"), "closed": action("closed", CLOSED, "Session closed"), "failed": action("failed", FAILED, "Failed login", ip=True),
        "accepted": action("accepted", ACCEPTED, "Successful login", ip=True), "sudo": action("sudo", SUDO, "Sudo command", command=True),
    }


def auth_actions(parsed: DataFrame, names: tuple[str, ...] = ("opened", "closed", "failed", "accepted", "sudo")) -> DataFrame:
    """A row per action of a line, of those named: opened, closed, failed, accepted, sudo; a line may hold several."""
    have = ["collection", "seq", "ts", "host", "daemon", "pid", "line"]
    ip = F.when(~F.col("line").contains("."), "").otherwise(extract_ipv4(F.col("line")))  # looked for in lines that need it, if they have a point
    found = actions_of_line(F.col("low"), ip)
    rows = parsed.select(*have, F.lower("line").alias("low")).select(*have, F.explode(F.array(*(found[n] for n in names))).alias("a"))
    return rows.where("a is not null").select(*have, "a.*")


def session_actions(parsed: DataFrame) -> DataFrame:
    """Actions that make sessions (all but sudo), in a shuffle that is read several times: pairing and judging need not parse lines again."""
    return read_once(auth_actions(parsed, ("opened", "closed", "failed", "accepted")).drop("line", "command", "label"))


def logins(actions: DataFrame, action: str) -> DataFrame:
    """(collection, ip, user): n, first_ts, last_ts of failed or accepted logins."""
    rows = actions.where(F.col("action") == action).select("collection", F.col("address").alias("ip"), F.col("who").alias("user"), "ts")
    return rows.groupBy("collection", "ip", "user").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def ssh_bruteforce(actions: DataFrame, threshold: int) -> DataFrame:
    """Sources with at least ``threshold`` failed logins: n, first, last, distinct users."""
    failed = actions.where("action = 'failed'").groupBy("collection", F.col("address").alias("ip"))
    found = failed.agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct("who").alias("users"))
    return found.where(F.col("n") >= threshold)


def login_sketches(actions: DataFrame, lg_k: int = 12) -> DataFrame:
    """Failed logins of a source on a day: n, first, last, and a sketch of the users tried (HyperLogLog, 2^lg_k cells).

    A day's rows stand for its raw lines ever after: they are kept, and days are added up by bruteforce_of_sketches.
    The sketch is filled in each task before it is shuffled, so a source of any size is a few kilobytes of each task.
    """
    rows = actions.where("action = 'failed' and ts is not null").groupBy("collection", F.col("address").alias("ip"), F.to_date("ts").alias("day"))
    return rows.agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.hll_sketch_agg("who", lg_k).alias("users"))


def bruteforce_of_sketches(sketches: DataFrame, threshold: int) -> DataFrame:
    """Sources with at least ``threshold`` failed logins over the days given: n, first, last, days, about how many users.

    The relative standard error of users is 1.04 / 2^(lg_k / 2), 1.6 % at the default; some hundred users are exact.
    """
    rows = sketches.groupBy("collection", "ip").agg(
        F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.count("*").alias("days"), F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users")
    )
    return rows.where(F.col("n") >= threshold)


def sudo_tiers(actions: DataFrame) -> DataFrame:
    """sudo commands: tier (HIGH, or Info; automation is never HIGH) and the normalised severity, which looks at keywords alone."""
    command = F.col("command")
    bad = rules.contains_any(command, rules.SUDO_HIGH)
    return actions.where("action = 'sudo'").select(
        "collection", "seq", "ts", F.col("who").alias("user"), ellipsis(command, 200).alias("command"),
        F.when(bad & ~rules.contains_any(command, rules.AUTOMATION), "HIGH").otherwise("Info").alias("tier"),
        F.when(bad, "High").otherwise("Medium").alias("severity"),
    )


def auth_events_norm(parsed: DataFrame) -> DataFrame:
    """Normalised events of the authentication log."""
    line = F.col("line")
    sudo = F.when(rules.contains_any(extract(line, SUDO, 2), rules.SUDO_HIGH), "High").otherwise("Medium")
    severity = F.when(line.rlike(SUDO), sudo).when(line.rlike(ACCEPTED), "Info").when(line.rlike(FAILED), "Medium").otherwise("Info")
    return parsed.select("collection", "seq", "ts", "host", F.lit("AUTH").alias("log_type"), "daemon", "user", "ip", "message", severity.alias("severity"), F.col("line").alias("raw"))


def interesting_ips(actions: DataFrame, attacks: DataFrame | None = None) -> DataFrame:
    """ip -> hits over failed and accepted logins and, if given, web attacks (collection, ip)."""
    rows = actions.where("action in ('failed', 'accepted')").select("collection", F.col("address").alias("ip"))
    rows = rows if attacks is None else rows.unionByName(attacks.select("collection", "ip"))
    return rows.where("ip <> ''").groupBy("collection", "ip").agg(F.count("*").alias("n"))
