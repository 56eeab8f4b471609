"""System logs: syslog, messages, audit, crontabs, journal. Each parses lines to columns and classifies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions import rules
from lumenlog.functions.text import (
    FOR_USER, HEADER, USER_EQUALS, ellipsis, extract, extract_ipv4, first_of, groups_of, mask_digits, message_of, normalize_audit, nth_part, part_of, settled,
)
from lumenlog.functions.timeparse import let, ts_of, ts_steps
from lumenlog.operators.group import carried, group_events
from lumenlog.operators.prefix import BITS, Running, running

CRON_EXEC = r"(?i)CROND?\[\d+\]:\s*\(([^)]+)\)\s*CMD\s*\((.+)\)"
AUDIT_LINE = r"type=(\w+)\s+msg=audit\((\d+)\.\d+:\d+\):\s+(.*)"


def kept() -> Column:
    """Neither a blank line nor a comment."""
    return (F.trim("line") != "") & ~F.ltrim("line").startswith("#")


def kept_lines(lines: DataFrame) -> DataFrame:
    """Without blank lines and comments."""
    return lines.where(kept())


def parse_syslog(lines: DataFrame) -> DataFrame:
    """Lines with a header and a timestamp; cron_user and cron_cmd are empty but for cron executions."""
    line = F.col("line")
    mtime = F.col("file_mtime")
    ts = lambda parts: F.when(F.size(parts) == 5, ts_of(line, mtime))
    rows = settled(lines, lambda parts: {"line": line, "ts": ts(parts), "parts": parts}, groups_of(line, HEADER, (2, 3, 4, 5)), kept(), ts_steps(line, mtime)).where("ts is not null")
    cron = F.when(F.lower(line).contains("cron"), groups_of(line, f"^(?s:.*?){CRON_EXEC}", (1, 2))).otherwise(F.array(line))
    rows = rows.withColumn("cron", cron)
    part, cron = (lambda k: part_of(F.col("parts"), k, 4, line)), (lambda k: F.trim(part_of(F.col("cron"), k, 2, line)))
    return rows.select(
        "collection", "seq", "line", "ts", part(1).alias("host"), part(2).alias("daemon"), part(3).alias("pid"), F.trim(part(4)).alias("message"), extract_ipv4(line).alias("ip"),
        first_of(extract(line, USER_EQUALS), extract(line, FOR_USER)).alias("user"), cron(1).alias("cron_user"), cron(2).alias("cron_cmd"), *carried(lines),
    )


def classify_syslog(parsed: DataFrame) -> DataFrame:
    line, cmd = F.col("line"), F.col("cron_cmd")
    cron = F.when(rules.contains_any(cmd, rules.CRON_WHITELIST), "Info").when(rules.contains_any(cmd, rules.EXEC_CRITICAL), "Critical").otherwise("Info")
    tier = (
        F.when(cmd != "", cron)
        .when(rules.matches_any(line, rules.SYSTEM_CRITICAL), "Critical")
        .when(line.rlike(r"(?i)session\s+(?:opened|closed)"), "Info")
        .when(F.lower("daemon").isin(*rules.QUIET_DAEMONS), "Info")
        .when(rules.contains_any(line, rules.SYSTEM_NOISE), "Noise")
        .otherwise("Info")
    )
    first = F.coalesce(*[F.when(F.col("low").rlike(p), p) for p in rules.SYSTEM_CRITICAL])
    kind = F.col("rule")
    label = (
        F.when(F.col("tier") == "Info", F.lit(None).cast("string"))
        .when(cmd != "", "Suspicious cron job")
        .when(F.col("tier") == "Noise", rules.first_word(F.col("low"), rules.SYSTEM_NOISE))
        .when(kind.contains("oom") | kind.contains("memory"), "OOM / memory kill")
        .when(kind.contains("panic"), "Kernel panic")
        .when(kind.contains("segfault"), "Segfault")
        .when(kind.contains("raid") | kind.contains("md"), "RAID degraded")
        .when(kind.contains("i/o"), "I/O error")
        .otherwise("System critical event")
    )
    rows = settled(parsed, lambda _: {"tier": tier}).withColumn("low", F.lower(line)).withColumn("rule", F.when((F.col("tier") == "Critical") & (cmd == ""), first))
    severity = F.when(F.col("tier") == "Critical", "High").when(F.col("tier") == "Noise", "Low").otherwise("Info")
    return rows.withColumns({"label": label, "severity": severity}).drop("rule", "low")


def syslog_group() -> tuple[Column, Column]:
    """Key and example of a critical event."""
    cron = F.col("cron_cmd") != ""
    key = F.when(cron, F.concat(F.lit("CRON|"), mask_digits(F.col("cron_cmd")))).otherwise(F.concat(F.lit("SYS|"), mask_digits(F.col("message"))))
    example = F.when(cron, F.concat(F.lit("[CRON] user="), F.col("cron_user"), F.lit(" CMD: "), F.col("cron_cmd"))).otherwise(F.col("message"))
    return F.lower(F.substring(key, 1, 120)), ellipsis(example, 160)


def grouped(classified: DataFrame, group: tuple[Column, Column], per_file: bool = False) -> DataFrame:
    key, example = group
    return group_events(classified.where("tier = 'Critical'").withColumn("key", key), ["collection", "key"], example, per_file=per_file)


def syslog_findings(classified: DataFrame, per_file: bool = False) -> DataFrame:
    return grouped(classified, syslog_group(), per_file)


def parse_messages(lines: DataFrame) -> DataFrame:
    line, mtime = F.col("line"), F.col("file_mtime")
    user = first_of(extract(line, USER_EQUALS), extract(line, FOR_USER), extract(line, r"(?i)\bUID=(\d+)\b"))
    levels = (("level=emerg", "emerg"), ("level=alert", "alert"), ("level=crit", "crit"), ("level=error", "err"), ("level=err", "err"), ("level=warning", "warning"))
    token = lambda low: F.coalesce(*[F.when(low.contains(w), t) for w, t in levels], extract(low, r":\s*(emerg|alert|crit|err|error|warning)\b"))
    rows = settled(lines, lambda parts: {"line": line, "ts": ts_of(line, mtime), "parts": parts}, groups_of(line, HEADER, (2, 3, 5)), kept(), ts_steps(line, mtime)).where("ts is not null")
    rows = rows.withColumn("low", F.lower(line))
    part = lambda k: part_of(F.col("parts"), k, 3, line)
    return rows.select(
        "collection", "seq", "line", "ts", part(1).alias("host"), part(2).alias("daemon"), extract_ipv4(line).alias("ip"), user.alias("user"),
        message_of(line, part(3)).alias("message"), token(F.col("low")).alias("token"), *carried(lines),
    )


def classify_messages(parsed: DataFrame) -> DataFrame:
    token = F.col("token")
    tier = (
        F.when(token.isin("emerg", "alert", "crit") | rules.matches_any(F.col("line"), rules.MESSAGES_CRITICAL), "Critical")
        .when(token.isin("err", "error", "warning"), "Noise")
        .otherwise("Info")
    )
    names = {"emerg": "Emergency", "alert": "Alert", "crit": "Critical", "err": "Error", "error": "Error", "warning": "Warning"}
    grades = {"emerg": "High", "alert": "High", "crit": "High", "err": "Medium", "error": "Medium", "warning": "Low"}
    of = lambda table, rest: F.coalesce(*[F.when(token == k, v) for k, v in table.items()], F.lit(rest))
    return settled(parsed, lambda _: {"tier": tier}).withColumns({"label": F.when(F.col("tier") != "Info", of(names, "Critical event")), "severity": of(grades, "Info")})


def messages_group() -> tuple[Column, Column]:
    return F.lower(F.substring(mask_digits(F.col("message")), 1, 100)), F.col("message")


def messages_findings(classified: DataFrame, per_file: bool = False) -> DataFrame:
    return grouped(classified, messages_group(), per_file)


def parse_audit(lines: DataFrame) -> DataFrame:
    """Audit records; other lines are dropped."""
    line = F.col("line")
    rows = settled(lines, lambda parts: {"line": line, "parts": parts}, groups_of(line, f"^(?s:.*?){AUDIT_LINE}", (1, 2, 3))).where(F.size("parts") == 4)
    part = lambda k: nth_part(F.col("parts"), k)
    acct = let(extract(part(3), r'acct="?([^"\s]+)"?'), lambda x: F.when(x == "", "unknown").otherwise(x))
    return rows.select(
        "collection", "seq", "line", part(1).alias("type"), F.timestamp_seconds(part(2).try_cast("long")).alias("ts"), part(3).alias("message"), acct.alias("acct"), *carried(lines)
    )


def classify_audit(parsed: DataFrame) -> DataFrame:
    kind, msg = F.col("type"), F.col("message")
    bad, automatic = rules.contains_any(msg, rules.EXEC_CRITICAL), rules.contains_any(msg, rules.AUTOMATION)
    refused = F.lower(msg).rlike("res=failed|res=denied| denied ")
    tier = (
        F.when(F.upper(kind).isin(*rules.AUDIT_NOISE_TYPES), "Info")
        .when(F.upper(kind).isin(*rules.AUDIT_CRITICAL_TYPES), "Critical")
        .when(refused, "Noise")
        .when(kind.isin("EXECVE", "USER_CMD"), F.when(bad & ~automatic, "Critical").otherwise("Noise"))
        .when((kind == "SYSCALL") & F.lower(msg).rlike("syscall=59|syscall=execve") & bad, "Critical")
        .when(kind.isin("CHOWN", "CHMOD", "SETUID", "SETGID") & bad, "Critical")
        .otherwise("Noise")
    )
    label = (
        F.when(kind == "EXECVE", "Process execution")
        .when(kind == "USER_CMD", "Sudo command")
        .when(kind == "USER_AUTH", F.when(F.lower(msg).contains("res=failed"), "Auth failure").otherwise("Auth success"))
        .when(kind == "ANOM_ABEND", "Process crash (ANOM_ABEND)")
        .when(kind == "ANOM_PROMISCUOUS", "NIC promiscuous mode")
        .when(kind == "KERN_MODULE", "Kernel module")
        .when(kind == "MAC_POLICY_LOAD", "MAC policy change")
        .otherwise(kind)
    )
    return settled(parsed, lambda _: {"tier": tier}).withColumns({"label": F.when(F.col("tier") != "Info", label), "severity": F.when(F.col("tier") == "Critical", "High").otherwise("Info")})


def audit_group() -> tuple[Column, Column]:
    return F.lower(F.concat("type", F.lit("|"), F.substring(normalize_audit(F.col("message")), 1, 100))), ellipsis(F.col("message"), 160)


def audit_findings(classified: DataFrame, per_file: bool = False) -> DataFrame:
    return grouped(classified, audit_group(), per_file)


def success_after_failures(parsed: DataFrame, least: int = 5, bits: int = BITS) -> DataFrame:
    """Per account the first login success with at least ``least`` failures before it: their number and last time (J3).

    In two passes, so no task holds an account.
    """
    rows = parsed.where(F.col("type").isin("USER_AUTH", "USER_LOGIN")).withColumn("acct", F.lower("acct"))
    failed = F.lower("message").contains("res=failed")
    wanted = [Running("failures", F.when(failed, 1).otherwise(0)), Running("last_failure", F.when(failed, F.col("ts")), "last")]
    rows = running(rows, ["collection", "acct"], wanted, frame="before", bits=bits)
    hits = rows.where(~failed & F.lower("message").contains("res=success") & (F.col("failures") >= least))
    first = F.min_by(F.struct("ts", "failures", "last_failure"), "seq")
    return hits.groupBy("collection", "acct").agg(first.alias("f")).select("collection", "acct", "f.ts", "f.failures", "f.last_failure")


def parse_crontab(lines: DataFrame) -> DataFrame:
    """Schedule, user and command; comments, variables and lines without a schedule are dropped."""
    line, path = F.trim("line"), F.col("file_path")
    fields = r"^(\S+\s+\S+\s+\S+\s+\S+\s+\S+)\s+(.+)$"
    schedule = first_of(extract(line, r"^(@\w+)\s+.+$"), extract(line, fields, 1))
    rest = first_of(extract(line, r"^@\w+\s+(.+)$"), extract(line, fields, 2))
    system = F.lower(path).contains("cron.d") | F.lower(path).endswith("crontab")
    owner, command = extract(F.col("rest"), r"^(\S+)[ \t]+(.+)$", 1), extract(F.col("rest"), r"^(\S+)[ \t]+(.+)$", 2)
    rows = kept_lines(lines).where(~line.rlike("^(?:MAILTO|PATH|SHELL|HOME)")).withColumns({"schedule": schedule, "rest": rest, "system": system}).where("schedule <> ''")
    return rows.select(
        "collection", "seq", "line", "file_path", F.col("file_mtime").alias("ts"), "schedule",
        F.when(F.col("system"), owner).otherwise(F.substring_index("file_path", "/", -1)).alias("user"),
        F.when(F.col("system") & (owner != ""), command).otherwise(F.col("rest")).alias("command"),
    )


def classify_crontab(parsed: DataFrame) -> DataFrame:
    cmd = F.col("command")
    tier = (
        F.when(rules.contains_any(cmd, rules.JOB_WHITELIST), "Info")
        .when(rules.contains_any(cmd, rules.JOB_CRITICAL), "Critical")
        .when(rules.contains_any(cmd, rules.JOB_SUSPICIOUS), "Suspicious")
        .otherwise("Info")
    )
    label = F.when(F.col("tier") == "Critical", "Critical crontab entry").when(F.col("tier") == "Suspicious", "Suspicious crontab entry")
    severity = F.when(F.col("tier") == "Critical", "High").when(F.col("tier") == "Suspicious", "Medium").otherwise("Info")
    return parsed.withColumn("tier", tier).withColumns({"label": label, "severity": severity})


def parse_journal(entries: DataFrame) -> DataFrame:
    return entries.withColumn("ts", F.timestamp_millis(F.floor(F.col("ts_us") / 1000).cast("long")))


def classify_journal(entries: DataFrame) -> DataFrame:
    """entries: collection, seq, ts_us, hostname, identifier, message, cmdline, exe, uid, priority."""
    text = {c: F.coalesce(c, F.lit("")) for c in ("identifier", "message", "cmdline", "exe")}
    ident, msg, cmd, exe = (F.lower(text[c]) for c in ("identifier", "message", "cmdline", "exe"))
    automatic = cmd.contains("ansible") | text["cmdline"].contains("BECOME-SUCCESS") | msg.contains("ansible")
    in_temp = lambda c: rules.contains_any(c, rules.JOURNAL_EXE_PATHS)
    tier = (
        F.when(automatic | ident.isin("sshd", "ssh") | msg.startswith("pam_unix(sudo:session)"), "Noise")
        .when((F.col("priority") <= 1) | in_temp(exe) | rules.contains_any(cmd, rules.JOURNAL_CRITICAL) | rules.contains_any(msg, rules.JOURNAL_CRITICAL), "Critical")
        .when(ident == "sudo", F.when(in_temp(cmd) | (msg.contains("command=") & in_temp(msg)), "Critical").otherwise("Noise"))
        .when(rules.contains_any(cmd, rules.JOURNAL_NOISE) | rules.contains_any(msg, rules.JOURNAL_NOISE) | (F.col("priority") <= 4), "Noise")
        .otherwise("Info")
    )
    label = (
        F.when(automatic, "Ansible automation")
        .when(ident.isin("sshd", "ssh"), F.when(msg.contains("failed"), "SSH login failed").when(msg.contains("accepted"), "SSH login accepted").otherwise("SSH event"))
        .when(ident == "sudo", "Sudo command")
        .when(cmd.rlike("wget|curl"), "Download tool")
        .when(cmd.rlike("/tmp/|/dev/shm/"), "Temp path execution")
        .when(ident.isin("bash", "sh", "zsh"), "Shell execution")
        .otherwise("Suspicious journal entry")
    )
    masked = lambda c: F.regexp_replace(text[c], r"\d{5,}", "***")
    uid = F.coalesce(F.col("uid").cast("string"), F.lit(""))
    bar = lambda *parts: F.concat_ws("|", *parts)
    signature = (
        F.when(automatic, bar(F.lit("ANSIBLE"), uid))
        .when(ident == "sudo", bar("tier", F.lit("sudo"), uid, F.substring(masked("cmdline"), 1, 120)))
        .when(ident.startswith("ssh"), bar("tier", text["identifier"], masked("message")))
        .otherwise(bar("tier", text["identifier"], uid, F.substring(masked("message"), 1, 120)))
    )
    rows = parse_journal(entries).withColumn("tier", tier)
    return rows.withColumns({"label": F.when(F.col("tier") != "Info", label), "signature": signature, "severity": F.when(F.col("tier") == "Critical", "High").otherwise("Info")})


def journal_findings(classified: DataFrame) -> DataFrame:
    return group_events(classified.where("tier = 'Critical'"), ["collection", "signature"], F.col("message"))
