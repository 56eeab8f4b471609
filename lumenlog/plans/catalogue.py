"""The registered queries: each runs one plan over log lines derived from a whole given table, or over the table itself."""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.functions import rules
from lumenlog.functions.text import is_public_ip, normalize_for_grouping
from lumenlog.operators import activity, auth, fleet, marks, report, score, sessions, system
from lumenlog.operators.group import collapse_cron, pattern_counts, read_once, top_k
from lumenlog.plans.config import TriageConfig
from lumenlog.plans.registry import LOG_TYPES, dated, normalised_events
from lumenlog.sources.derive import lines

#: Derived requests are spread thin, so one in a minute is already the threshold.
CONFIG = TriageConfig(web_requests_per_minute=1)
RANGE = dataclasses.replace(CONFIG, start=dt.datetime(1995, 1, 1), end=dt.datetime(2024, 3, 15, 12))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(plan: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a plan under its name; timestamps are shown as text, to the second."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = plan(spark, sf_dir)
        shown = {f.name: F.date_format(f.name, "yyyy-MM-dd HH:mm:ss") for f in df.schema.fields if f.dataType.typeName().startswith("timestamp")}
        return df.withColumns(shown) if shown else df

    QUERIES[plan.__name__] = run
    return plan


def classified(spark, d, name):
    """Classified events of a log type in the analyst's range."""
    kind = LOG_TYPES[name]
    return dated(kind.events(lines(spark, d, kind.source)), CONFIG)


def actions(spark, d):
    return auth.auth_actions(dated(auth.parse_auth(lines(spark, d, "auth")), CONFIG))


def session_actions(spark, d):
    return auth.session_actions(dated(auth.parse_auth(lines(spark, d, "auth")), CONFIG))


def syslog(spark, d):
    return classified(spark, d, "SYSLOG")


def messages(spark, d):
    return classified(spark, d, "MESSAGES")


def audit(spark, d):
    return classified(spark, d, "AUDIT")


def web(spark, d):
    return classified(spark, d, "WEB")


def crontab(spark, d):
    return classified(spark, d, "CRONTAB")


def shell(spark, d):
    return activity.classify_shell(dated(activity.history_commands(lines(spark, d, "history"), CONFIG.history_gap_hours), CONFIG))


def journal(spark, d):
    return classified(spark, d, "JOURNAL")


def judged(spark, d):
    done = session_actions(spark, d)
    paired = read_once(sessions.pair_sessions(done))
    return sessions.all_sessions(paired, sessions.session_suspicion(paired, done, CONFIG.bruteforce_threshold))


@query
def ssh_bruteforce(spark, d):
    return auth.ssh_bruteforce(actions(spark, d), CONFIG.bruteforce_threshold)


@query
def ssh_bruteforce_sketched(spark, d):
    """ssh_bruteforce out of daily sketches; there are few users to a source here, so their number is exact."""
    return auth.bruteforce_of_sketches(auth.login_sketches(actions(spark, d)), CONFIG.bruteforce_threshold)


@query
def failed_logins_topk(spark, d):
    return top_k(auth.logins(actions(spark, d), "failed"), ["collection"], [F.col("n").desc(), F.col("ip"), F.col("user")], 10)


@query
def accepted_logins_topk(spark, d):
    return top_k(auth.logins(actions(spark, d), "accepted"), ["collection"], [F.col("n").desc(), F.col("ip"), F.col("user")], 20)


@query
def sudo_findings(spark, d):
    return auth.sudo_tiers(actions(spark, d))


@query
def auth_events_norm(spark, d):
    return auth.auth_events_norm(auth.parse_auth(lines(spark, d, "auth")))


@query
def events_norm(spark, d):
    """Every log type of which lines are derived, in a range of dates."""
    return normalised_events(lambda source: lines(spark, d, source), RANGE, [t for t in LOG_TYPES if t != "SECURE"])


@query
def pattern_counts_auth(spark, d):
    return pattern_counts(actions(spark, d))


@query
def interesting_ips(spark, d):
    return auth.interesting_ips(actions(spark, d), web(spark, d).where("attack is not null"))


@query
def public_ip_split(spark, d):
    rows = auth.parse_auth(lines(spark, d, "auth")).where("ip <> ''").withColumn("public", is_public_ip(F.col("ip")))
    return rows.groupBy("collection", "public").agg(F.count("*").alias("n"), F.count_distinct("ip").alias("ips"))


@query
def sessions_paired(spark, d):
    return sessions.pair_sessions(session_actions(spark, d)).drop("nth")


@query
def sessions_linked(spark, d):
    """Sessions whose closes take the address of their process's login."""
    done = sessions.link_by_pid(auth.session_actions(auth.parse_auth(lines(spark, d, "logins"))))
    return sessions.pair_sessions(done).drop("nth")


@query
def session_types(spark, d):
    return sessions.pair_sessions(session_actions(spark, d)).groupBy("collection", "type").agg(F.count("*").alias("n"), F.count("end_ts").alias("closed"))


@query
def session_suspicion(spark, d):
    return judged(spark, d).where("reason is not null").select("collection", "seq", "user", "ip", "daemon", "type", "failures", "reason", "notes")


@query
def session_stats(spark, d):
    return sessions.session_stats(judged(spark, d))


@query
def sessions_grouped(spark, d):
    return sessions.sessions_grouped(judged(spark, d)).orderBy("collection", F.desc("suspicious"), F.desc("n"), "first_ts")


@query
def sessions_by_start(spark, d):
    """Every session and failed login, in order of its start."""
    return judged(spark, d).drop("notes").orderBy("collection", "start_ts", "seq", "user", "ip")


@query
def syslog_tiers(spark, d):
    return syslog(spark, d).select("collection", "seq", "ts", "host", "daemon", "user", "ip", "cron_user", "cron_cmd", "tier", "label", "severity")


@query
def syslog_findings(spark, d):
    return system.syslog_findings(syslog(spark, d)).orderBy("collection", F.col("key").startswith("cron|").desc(), F.desc("n"), "first_ts")


@query
def messages_findings(spark, d):
    return system.messages_findings(messages(spark, d)).orderBy("collection", F.desc("n"), "first_ts", "key")


@query
def messages_tiers(spark, d):
    return messages(spark, d).groupBy("collection", "tier", "label", "severity", "user").agg(F.count("*").alias("n"))


@query
def audit_tiers(spark, d):
    return audit(spark, d).select("collection", "seq", "ts", "type", "acct", "tier", "label")


@query
def audit_findings(spark, d):
    return system.audit_findings(audit(spark, d)).orderBy("collection", F.desc("n"), "first_ts", "key")


@query
def auth_success_after_failures(spark, d):
    return system.success_after_failures(system.parse_audit(lines(spark, d, "audit")), CONFIG.bruteforce_threshold)


@query
def web_events_norm(spark, d):
    return web(spark, d).select("collection", "seq", "ts", "ip", "method", "uri", "status", "size", "message", "tier", "severity")


@query
def web_attack_findings(spark, d):
    return activity.web_attack_findings(web(spark, d)).orderBy("collection", F.desc("n"), "first_ts", "attack")


@query
def web_bruteforce(spark, d):
    return activity.web_bruteforce(dated(activity.parse_web(lines(spark, d, "web")), CONFIG), CONFIG.web_requests_per_minute)


@query
def crontab_findings(spark, d):
    return crontab(spark, d).where("tier <> 'Info'").select("collection", "seq", "schedule", "user", "command", "tier", "severity")


@query
def history_commands(spark, d):
    return activity.history_commands(lines(spark, d, "history"), CONFIG.history_gap_hours).drop("file_path")


@query
def history_gaps(spark, d):
    rows = activity.history_commands(lines(spark, d, "history"), CONFIG.history_gap_hours).where("gap_hours is not null")
    return rows.groupBy("collection", "username").agg(F.count("*").alias("gaps"), F.max("gap_hours").alias("longest"))


@query
def shell_findings(spark, d):
    return shell(spark, d).where("tier <> 'Info'").select("collection", "username", "seq", "command", "tier", "severity", "anti_forensics")


@query
def anti_forensics_by_user(spark, d):
    return activity.anti_forensics_by_user(shell(spark, d))


@query
def lateral_movement(spark, d):
    return activity.lateral_movement(activity.history_commands(lines(spark, d, "history")))


@query
def bodyfile_timeline(spark, d):
    return score.bodyfile_timeline(score.parse_bodyfile(lines(spark, d, "bodyfile"))).drop("file_path")


def bodyfile(spark, d, config=CONFIG):
    """Entries any of whose four times is in the range, or that have none."""
    return dated(score.bodyfile_timeline(score.parse_bodyfile(lines(spark, d, "bodyfile"))), config, "atime", "mtime", "ctime", "crtime")


@query
def bodyfile_timeline_in_range(spark, d):
    narrow = dataclasses.replace(CONFIG, start=dt.datetime(2023, 11, 20), end=dt.datetime(2023, 11, 25, 6))
    return bodyfile(spark, d, narrow).drop("file_path")


@query
def bodyfile_findings(spark, d):
    return score.bodyfile_findings(score.parse_bodyfile(lines(spark, d, "bodyfile")), CONFIG).orderBy("collection", F.desc("score"), "path")


@query
def sha1_candidates(spark, d):
    return score.sha1_candidates(score.score_sha1(score.parse_sha1(lines(spark, d, "sha1"))), CONFIG.sha1_min_score)


@query
def sha1_shown(spark, d):
    return score.sha1_shown(score.sha1_candidates(score.score_sha1(score.parse_sha1(lines(spark, d, "sha1"))), CONFIG.sha1_min_score))


@query
def sha1_stats(spark, d):
    return score.sha1_stats(score.score_sha1(score.parse_sha1(lines(spark, d, "sha1"))), CONFIG.sha1_min_score)


@query
def container_inventory(spark, d):
    rows = activity.container_severity(activity.containers(lines(spark, d, "containers")))
    return rows.withColumns({c: F.array_join(c, "; ") for c in ("capabilities", "mounts", "suspicious")})


@query
def container_risk(spark, d):
    return activity.container_risk(activity.containers(lines(spark, d, "containers")))


@query
def container_log_hits(spark, d):
    return activity.container_log_hits(lines(spark, d, "container_logs"), activity.containers(lines(spark, d, "containers")))


@query
def docker_event_hits(spark, d):
    return activity.docker_event_hits(lines(spark, d, "docker_events"))


@query
def journal_tiers(spark, d):
    return journal(spark, d).select("collection", "seq", "ts", "identifier", "tier", "label")


@query
def journal_findings(spark, d):
    return system.journal_findings(journal(spark, d)).orderBy("collection", "first_ts", "signature")


@query
def message_clusters(spark, d):
    texts = spark.read.parquet(f"{d}/conversations.parquet").select(F.lit("conversations").alias("collection"), F.col("text").alias("line"), F.struct("conv_id", "turn").alias("seq"))
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.lit("documents").alias("collection"), F.col("text").alias("line"), F.struct(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn")).alias("seq"))
    rows = texts.unionByName(docs).where("line is not null").withColumn("key", F.sha2(normalize_for_grouping(F.col("line")), 256))
    grouped = rows.groupBy("collection", "key").agg(F.count("*").alias("n"), F.min("seq").alias("s"))
    return grouped.select("collection", "key", "n", F.col("s.conv_id").alias("first_id"), F.col("s.turn").alias("first_turn"))


@query
def rank_keyword_hits(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text")
    raw = lines(spark, d, "auth").select(F.lit("auth").alias("source"), F.col("seq").alias("id"), F.col("line").alias("text"))
    typed = lines(spark, d, "history").select(F.lit("history").alias("source"), F.col("seq").alias("id"), F.col("line").alias("text"))
    return activity.rank_keyword_hits(docs.unionByName(raw).unionByName(typed), list(CONFIG.rank1), list(CONFIG.rank2), list(CONFIG.whitelist))


def sockets(spark, d):
    return fleet.parse_sockets(lines(spark, d, "sockets"))


@query
def socket_table(spark, d):
    return sockets(spark, d)


@query
def listening_ports(spark, d):
    return fleet.listening_ports(sockets(spark, d))


@query
def listeners_shown(spark, d):
    return fleet.listeners_shown(sockets(spark, d))


@query
def external_connections(spark, d):
    return fleet.external_connections(sockets(spark, d))


@query
def processes_by_user(spark, d):
    return fleet.processes_by_user(fleet.parse_ps(lines(spark, d, "ps")))


@query
def process_hits(spark, d):
    return fleet.process_hits(fleet.parse_ps(lines(spark, d, "ps")))


@query
def open_file_hits(spark, d):
    return fleet.open_file_hits(lines(spark, d, "open_files"))


@query
def account_inventory(spark, d):
    return fleet.accounts(lines(spark, d, "accounts"))


@query
def net_config(spark, d):
    return fleet.net_config(lines(spark, d, "net"))


@query
def persistence_hits(spark, d):
    return fleet.persistence_hits(lines(spark, d, "persistence"))


@query
def suspicious_temp_files(spark, d):
    return fleet.suspicious_temp_files(lines(spark, d, "files"))


@query
def recent_files_shown(spark, d):
    return fleet.recent_files_shown(lines(spark, d, "files"))


@query
def distinct_values(spark, d):
    return fleet.distinct_values(fleet.net_config(lines(spark, d, "net")), fleet.accounts(lines(spark, d, "accounts")))


@query
def fleet_counts(spark, d):
    return fleet.fleet_counts(lines(spark, d, "files"), fleet.accounts(lines(spark, d, "accounts")), sockets(spark, d), fleet.net_config(lines(spark, d, "net")), lines(spark, d, "persistence"))


@query
def collapsed_cron(spark, d):
    cron = syslog(spark, d).where("cron_cmd <> ''")
    text = F.concat(F.lit("FINDING: [CRON] Suspicious cron job at : "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" CMD: "), F.col("cron_cmd"))
    return collapse_cron(cron.withColumn("text", text), F.col("text"))


def summed(spark, d, files=True, found=True):
    """The marks of every source, summed: each log is read and parsed once, and all reports read these sums.

    Body files, hashes, containers and live dumps are read twice: for their files, and for their findings. A report of
    files alone (not found) needs no line classified; one of findings alone (not files) counts no file's rows.
    """
    as_of, of = F.lit(CONFIG.as_of), lambda name: lines(spark, d, name)
    tally = lambda rows, kind, of_log=None, **how: marks.tally(rows, kind, of_log, as_of, **({"files": files} | how))
    never = lambda rows: rows.withColumn("ts", F.lit(None).cast("timestamp"))
    events = of("docker_events").withColumn("ts", activity.docker_event_ts())
    logins = dated(auth.parse_auth(of("auth")), CONFIG)
    entries, stamps = score.parse_bodyfile(of("bodyfile")), [F.timestamp_seconds(c) for c in ("atime", "mtime", "ctime", "crtime")]
    hashes, parts = score.parse_sha1(of("sha1")), []
    if files:
        parts += [tally(never(of(name)), kind) for kind, name in (("DOCKER", "containers"), ("DOCKER", "container_logs"), ("LIVE", "ps"), ("LIVE", "persistence"), ("LIVE", "files"))]
        parts += [tally(entries.withColumns({"ts": F.least(*stamps), "last": F.greatest(*stamps)}), "BODYFILE", last="last"), tally(never(hashes), "SHA1")]
    if not found:
        parsed = {name: dated(LOG_TYPES[name].parse(of(LOG_TYPES[name].source)), CONFIG) for name in marks.OF_LOG}
        return report.union(parts + [tally(rows, kind) for kind, rows in ({"AUTH": logins, "DOCKER": events} | parsed).items()])
    plain = {"SYSLOG": syslog, "MESSAGES": messages, "AUDIT": audit, "WEB": web, "CRONTAB": crontab, "BASH": shell, "JOURNAL": journal}
    parts.append(marks.settled_logins(tally(logins, "AUTH", marks.auth_marks()), CONFIG.bruteforce_threshold))
    parts += [tally(plan(spark, d), kind, marks.OF_LOG[kind]()) for kind, plan in plain.items()]
    parts.append(tally(events, "DOCKER", marks.marks(*((test, marks.mark("finding", F.lit(label), severity)) for test, severity, label in activity.docker_hits_of_line()))))
    hits = lambda rows, kind, severity, key, ts=None: tally(rows if ts else never(rows), kind, F.array(marks.mark("finding", key, severity)), files=False, ts=ts or "ts")
    boxes = activity.containers(of("containers"))
    parts += [
        hits(activity.container_risk(boxes), "DOCKER", F.col("severity"), F.concat("label", F.lit(": "), "name")),
        hits(activity.container_log_hits(of("container_logs"), boxes), "DOCKER", "HIGH", F.concat("word", F.lit(" in log of "), "name")),
        hits(fleet.process_hits(fleet.parse_ps(of("ps"))).where("word is not null"), "LIVE", "MEDIUM", F.concat("word", F.lit(" in: "), "command")),
        hits(fleet.persistence_hits(of("persistence")), "LIVE", "MEDIUM", F.concat("kind", F.lit(": "), "line")),
        hits(fleet.suspicious_temp_files(of("files")), "LIVE", "MEDIUM", F.col("path")),
        hits(score.bodyfile_findings(entries, CONFIG), "BODYFILE", "SUSPICIOUS", F.col("path"), "mtime"),
        hits(score.sha1_candidates(score.score_sha1(hashes), CONFIG.sha1_min_score), "SHA1", F.col("severity"), F.concat("hash", F.lit(" "), "path")),
    ]
    return report.union(parts)


@query
def coverage(spark, d):
    return marks.coverage(summed(spark, d, found=False))


@query
def coverage_levels(spark, d):
    """Coverage per file, per log type and per collection."""
    return marks.coverage_levels(summed(spark, d, found=False))


@query
def findings(spark, d):
    return marks.findings(summed(spark, d, files=False)).drop("example")


@query
def per_log_status(spark, d):
    return marks.per_log_status(summed(spark, d))


@query
def global_summary(spark, d):
    return marks.global_summary(summed(spark, d))


@query
def syslog_findings_per_file(spark, d):
    """The option per_file: a key counts in each rotated file by itself."""
    return system.syslog_findings(syslog(spark, d), per_file=True).orderBy("collection", "file_path", F.desc("n"), "key")


@query
def severity_by_keyword(spark, d):
    """classify_severity over the messages log."""
    grade = rules.classify_severity(F.col("line"), {"emerg": "High", "fault": "Medium", "level=": "Low"})
    return lines(spark, d, "messages").groupBy("collection", grade.alias("severity")).agg(F.count("*").alias("n"))
