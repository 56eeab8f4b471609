"""The registered queries in DuckDB SQL, over the same derived lines."""

from __future__ import annotations

from lumenlog.functions import rules
from lumenlog.sources.derive import duck

# Patterns and lists, written here apart from the operators', so that a wrong one shows.
HEADER = r"^(\d{4}-\d{2}-\d{2}T\S+|[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^\s:\[]+)(?:\[(\d+)\])?:\s*(.*)$"
REST = r"^(?:\d{4}-\d{2}-\d{2}T\S+|[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+\S+\s+(.*)$"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
USER_EQUALS = r"(?i)\buser=([A-Za-z0-9._-]+)\b"
FOR_USER = r"(?i)\bfor user ([A-Za-z0-9._-]+)\b"
AUTH_USERS = [r"(?i)\b(?:Failed|Accepted)\s+password\s+for\s+(?:invalid\s+user\s+)?([A-Za-z0-9._-]+)\b", r"(?i)session\s+(?:opened|closed)\s+for\s+user\s+([A-Za-z0-9._-]+)", r"(?i):\s+([A-Za-z0-9._-]+)\s+:\s+TTY=", r"(?i)\buser=([A-Za-z0-9._-]+)\b"]
ISO = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2}))"
APACHE = r"\[(\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4})\]"
CLASSIC = r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
AUDIT = r"msg=audit\((\d+)\."
OPENED = r"(?i)session opened for user (\w+)"
CLOSED = r"(?i)session closed for user (\w+)"
FAILED = r"(?i)Failed password for (?:invalid user )?(\w+) from (\d{1,3}(?:\.\d{1,3}){3})"
ACCEPTED = r"(?i)Accepted password for (\w+) from (\d{1,3}(?:\.\d{1,3}){3})"
SUDO = r"(?i):\s+(\w+)\s+:\s+TTY=.*?;\s+PWD=.*?;\s+USER=.*?;\s+COMMAND=(.+)$"
CRON_EXEC = r"(?i)CROND?\[\d+\]:\s*\(([^)]+)\)\s*CMD\s*\((.+)\)"
AUDIT_LINE = r"type=(\w+)\s+msg=audit\((\d+)\.\d+:\d+\):\s+(.*)"
COMBINED = r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)(?:\s+([^"]+))?"\s+(\d{3})\s+(\d+|-)\s+"([^"]*)"\s+"([^"]*)"'
SSH = r"(?i)ssh\s+(?:-[bcDEFIiJLlmOopQRSWw]\s+\S+\s+|-\S+\s+)*(?:([A-Za-z0-9._-]+)@)?([A-Za-z0-9.-]+)"
STATES = [r"LISTEN", r"ESTAB", r"ESTABLISHED", r"UNCONN", r"CLOSE-WAIT", r"TIME-WAIT"]
NOTABLE_PORTS = [22, 23, 80, 443, 445, 3389, 8000, 8080, 8443, 3333, 5555, 6666, 7777, 14444, 18080]
IMPORTANCE = [r"JOURNAL", r"AUTH", r"SECURE", r"AUDIT", r"WEB", r"DOCKER", r"SYSLOG", r"MESSAGES", r"CRONTAB", r"BASH"]


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(c: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({c}, {q(pattern)}, {group})"


def like(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def any_of(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), {q(w.lower())})" for w in words) + ")"


def first(c: str, words: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({c}), {q(w.lower())}) THEN {q(w)}" for w in words) + " END"


def first_rx(c: str, patterns: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {like(f'lower({c})', p)} THEN {q(p)}" for p in patterns) + " END"


def starts(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with(lower({c}), {q(w.lower())})" for w in words) + ")"


def isin(c: str, words: list) -> str:
    return f"{c} IN ({', '.join(q(w) if isinstance(w, str) else str(w) for w in words)})"


def sub(c: str, pattern: str, to: str) -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(to)}, 'g')"


def some(*columns: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({c}, '')" for c in columns) + ", '')"


def short(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n - 3}) || '...' ELSE {c} END"


def shown(c: str, name: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {name or c}"


def epoch(c: str) -> str:
    return f"make_timestamp(({c}) * 1000000)"


def clock(year: str) -> str:
    return f"try_strptime(CAST({year} AS VARCHAR) || ' ' || {sub(rx('line', CLASSIC), chr(92) + 's+', ' ')}, '%Y %b %d %H:%M:%S')"


TS = f"""coalesce(
 CASE WHEN {rx('line', ISO)} <> '' THEN try_strptime(substr({rx('line', ISO)}, 1, 19), '%Y-%m-%dT%H:%M:%S') END,
 try_strptime(substr({rx('line', APACHE)}, 1, 20), '%d/%b/%Y:%H:%M:%S'),
 CASE WHEN {rx('line', CLASSIC)} = '' THEN NULL WHEN {clock('year(file_mtime)')} > file_mtime + INTERVAL 1 DAY THEN {clock('year(file_mtime) - 1')} ELSE {clock('year(file_mtime)')} END,
 {epoch(f"TRY_CAST({rx('line', AUDIT)} AS BIGINT)")})"""
MESSAGE = f"trim(coalesce(nullif({rx('line', HEADER, 5)}, ''), nullif({rx('line', REST)}, ''), line))"
KEPT = "trim(line) <> '' AND NOT starts_with(ltrim(line), '#')"


def action(name: str, pattern: str, label: str, ip: str = "ip", command: str = "''") -> str:
    return f"SELECT collection, seq, ts, daemon, {q(name)} AS action, {rx('line', pattern)} AS who, {ip} AS address, {command} AS command, {q(label)} AS label, host, pid FROM auth WHERE {like('line', pattern)}"


AUTH = f"""auth AS (SELECT collection, seq, line, file_path, {TS} AS ts, {rx('line', HEADER, 2)} AS host, coalesce(nullif({rx('line', HEADER, 3)}, ''), 'AUTH') AS daemon, {rx('line', HEADER, 4)} AS pid,
 {rx('line', IPV4, 0)} AS ip, {some(*[rx('line', p) for p in AUTH_USERS])} AS "user", {MESSAGE} AS message FROM ({duck('auth')}))"""
ACTIONS = f"""{AUTH}, actions AS ({action('opened', OPENED, 'Session opened')} UNION ALL {action('closed', CLOSED, 'Session closed')} UNION ALL
 {action('failed', FAILED, 'Failed login', rx('line', FAILED, 2))} UNION ALL {action('accepted', ACCEPTED, 'Successful login', rx('line', ACCEPTED, 2))} UNION ALL
 {action('sudo', SUDO, 'Sudo command', command=f"trim({rx('line', SUDO, 2)})")})"""
LINKED = f"""actions AS (SELECT * REPLACE (CASE WHEN action = 'closed' AND login <> '' THEN login ELSE address END AS address) FROM (
  SELECT *, coalesce(last_value(CASE action WHEN 'closed' THEN '' WHEN 'accepted' THEN address END IGNORE NULLS) OVER (PARTITION BY collection, host, pid
    ORDER BY seq, CASE action WHEN 'opened' THEN 0 WHEN 'closed' THEN 1 ELSE 2 END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS login FROM every)
  WHERE NOT (action = 'opened' AND login <> '')),"""
LOCAL = "(ip IN ('', 'N/A') OR ip LIKE '127.%')"
PAIRED = f"""{ACTIONS}, marks AS (SELECT collection, who AS "user", CASE WHEN address = '' THEN 'N/A' ELSE address END AS ip, daemon, seq, ts,
 CASE action WHEN 'closed' THEN -1 ELSE 1 END AS kind, CASE action WHEN 'opened' THEN 0 WHEN 'closed' THEN 1 ELSE 2 END AS nth FROM actions WHERE action IN ('opened', 'closed', 'accepted')),
 bal AS (SELECT *, sum(kind) OVER w AS balance FROM marks WINDOW w AS (PARTITION BY collection, "user", ip, daemon ORDER BY seq, nth ROWS UNBOUNDED PRECEDING)),
 low AS (SELECT *, least(min(balance) OVER w, 0) AS least_b FROM bal WINDOW w AS (PARTITION BY collection, "user", ip, daemon ORDER BY seq, nth ROWS UNBOUNDED PRECEDING)),
 prev AS (SELECT *, coalesce(lag(least_b) OVER (PARTITION BY collection, "user", ip, daemon ORDER BY seq, nth), 0) AS before FROM low),
 depth AS (SELECT *, balance - least_b + CASE WHEN kind = 1 THEN 0 ELSE 1 END AS depth FROM prev WHERE NOT (kind = -1 AND balance < before)),
 nexts AS (SELECT *, lead(kind) OVER w AS nk, lead(ts) OVER w AS nt, lead(seq) OVER w AS ns FROM depth WINDOW w AS (PARTITION BY collection, "user", ip, daemon, depth ORDER BY seq, nth)),
 opened AS (SELECT collection, "user", ip, daemon, seq, ts AS start_ts, CASE WHEN nk = -1 THEN nt END AS end_ts, CASE WHEN nk = -1 THEN ns END AS end_seq FROM nexts WHERE kind = 1),
 timed AS (SELECT *, CAST(date_diff('second', start_ts, end_ts) AS BIGINT) AS seconds FROM opened),
 paired AS (SELECT *, CASE WHEN lower(daemon) LIKE '%cron%' OR lower(daemon) LIKE '%atd%' THEN 'CronJob' WHEN lower(daemon) LIKE '%systemd%' THEN 'SystemdSession'
  WHEN coalesce(seconds <= 2, false) AND ({LOCAL} OR ip LIKE '::1%') THEN 'SudoCommand' WHEN lower(daemon) LIKE '%ssh%' AND NOT {LOCAL} THEN 'SshInteractive'
  WHEN lower(daemon) LIKE '%su%' AND coalesce(seconds <= 5, false) THEN 'SuCommand' WHEN {isin('lower("user")', rules.SERVICE_ACCOUNTS)} THEN 'ServiceAuth' ELSE 'PamGeneric' END AS type FROM timed)"""
NEAR = "(ip IN ('', 'N/A') OR ip LIKE '127.%' OR ip LIKE '::1%' OR ip LIKE '10.%' OR ip LIKE '192.168.%' OR (ip LIKE '172.%' AND TRY_CAST(split_part(ip, '.', 2) AS INT) BETWEEN 16 AND 31))"
JUDGED = f"""{PAIRED}, failed AS (SELECT collection, address AS ip, who AS "user", daemon, seq, ts, count(*) OVER (PARTITION BY collection, address ORDER BY seq ROWS UNBOUNDED PRECEDING) AS attempt FROM actions WHERE action = 'failed'),
 closes AS (SELECT p.*, (SELECT count(*) FROM failed f WHERE f.collection = p.collection AND f.ip = p.ip AND f.seq <= p.end_seq) AS failures FROM paired p WHERE end_seq IS NOT NULL),
 reasons AS (SELECT *, CASE WHEN {isin('lower("user")', rules.SERVICE_ACCOUNTS)} AND type = 'SshInteractive' THEN 'ServiceAccountSSH'
  WHEN lower("user") = 'root' AND type = 'SshInteractive' AND ip <> 'N/A' AND ip NOT LIKE '127.%' AND ip NOT LIKE '::1%' THEN 'RootSSH'
  WHEN seconds < 1 AND type = 'SshInteractive' AND ip <> 'N/A' AND NOT {NEAR} THEN 'VeryShortWithIP' WHEN type = 'SshInteractive' AND hour(start_ts) BETWEEN 2 AND 4 THEN 'UnusualTime'
  WHEN ip <> 'N/A' AND failures >= 10 THEN 'MultipleFailures' END AS reason FROM closes),
 judged AS (SELECT collection, ip, failures, "user", daemon, start_ts, end_ts, seconds, type, seq, reason, CASE reason WHEN 'ServiceAccountSSH' THEN 'Service account with SSH session' WHEN 'RootSSH' THEN 'Direct root SSH login'
   WHEN 'VeryShortWithIP' THEN 'Very short SSH session from external IP' WHEN 'UnusualTime' THEN 'Interactive session at unusual time (' || hour(start_ts) || ':00)'
   WHEN 'MultipleFailures' THEN 'IP has ' || failures || ' failed attempts before this success' END AS notes FROM reasons
  UNION ALL SELECT collection, ip, attempt, "user", daemon, ts, ts, 0, 'SshFailed', seq, CASE WHEN attempt >= 5 THEN 'MultipleFailures' END, CASE WHEN attempt >= 5 THEN 'Failed attempt #' || attempt || ' from this IP' ELSE 'Failed authentication' END FROM failed
  UNION ALL SELECT collection, ip, 0, "user", daemon, start_ts, end_ts, seconds, type, seq, NULL, '' FROM paired WHERE end_seq IS NULL)"""

SYSLOG = f"""sys0 AS (SELECT collection, seq, line, file_path, {TS} AS ts, {rx('line', HEADER, 2)} AS host, {rx('line', HEADER, 3)} AS daemon, trim({rx('line', HEADER, 5)}) AS message, {rx('line', IPV4, 0)} AS ip,
 {some(rx('line', USER_EQUALS), rx('line', FOR_USER))} AS "user", trim({rx('line', CRON_EXEC, 1)}) AS cron_user, trim({rx('line', CRON_EXEC, 2)}) AS cron_cmd FROM ({duck('syslog')}) WHERE {KEPT} AND {like('line', HEADER)}),
 sys1 AS (SELECT *, {first_rx('line', rules.SYSTEM_CRITICAL)} AS hit, CASE WHEN cron_cmd <> '' THEN CASE WHEN {any_of('cron_cmd', rules.CRON_WHITELIST)} THEN 'Info' WHEN {any_of('cron_cmd', rules.EXEC_CRITICAL)} THEN 'Critical' ELSE 'Info' END
  WHEN {first_rx('line', rules.SYSTEM_CRITICAL)} IS NOT NULL THEN 'Critical' WHEN {like('line', '(?i)session' + chr(92) + 's+(?:opened|closed)')} THEN 'Info' WHEN {isin('lower(daemon)', rules.QUIET_DAEMONS)} THEN 'Info'
  WHEN {any_of('line', rules.SYSTEM_NOISE)} THEN 'Noise' ELSE 'Info' END AS tier FROM sys0 WHERE ts IS NOT NULL),
 syslog AS (SELECT *, CASE WHEN tier = 'Info' THEN NULL WHEN cron_cmd <> '' THEN 'Suspicious cron job' WHEN tier = 'Noise' THEN {first('line', rules.SYSTEM_NOISE)} WHEN hit LIKE '%oom%' OR hit LIKE '%memory%' THEN 'OOM / memory kill'
  WHEN hit LIKE '%panic%' THEN 'Kernel panic' WHEN hit LIKE '%segfault%' THEN 'Segfault' WHEN hit LIKE '%raid%' OR hit LIKE '%md%' THEN 'RAID degraded' WHEN hit LIKE '%i/o%' THEN 'I/O error' ELSE 'System critical event' END AS label,
  CASE tier WHEN 'Critical' THEN 'High' WHEN 'Noise' THEN 'Low' ELSE 'Info' END AS severity FROM sys1)"""
DIGITS = chr(92) + "d+"
SYSLOG_F = f"""{SYSLOG}, syslog_f AS (SELECT collection, lower(substr(CASE WHEN cron_cmd <> '' THEN 'CRON|' || {sub('cron_cmd', DIGITS, '#')} ELSE 'SYS|' || {sub('message', DIGITS, '#')} END, 1, 120)) AS key,
 count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, arg_min({short("CASE WHEN cron_cmd <> '' THEN '[CRON] user=' || cron_user || ' CMD: ' || cron_cmd ELSE message END", 160)}, seq) AS example FROM syslog WHERE tier = 'Critical' GROUP BY ALL)"""

TOKEN = "CASE " + " ".join(f"WHEN contains(lower(line), {q(w)}) THEN {q(t)}" for w, t in (("level=emerg", "emerg"), ("level=alert", "alert"), ("level=crit", "crit"), ("level=err", "err"), ("level=warning", "warning")))
TOKEN += f" ELSE {rx('lower(line)', ':' + chr(92) + 's*(emerg|alert|crit|err|error|warning)' + chr(92) + 'b')} END"
MESSAGES = f"""mes0 AS (SELECT collection, seq, line, file_path, {TS} AS ts, {MESSAGE} AS message, {some(rx('line', USER_EQUALS), rx('line', FOR_USER), rx('line', '(?i)' + chr(92) + 'bUID=(' + DIGITS + ')' + chr(92) + 'b'))} AS "user", {TOKEN} AS token
 FROM ({duck('messages')}) WHERE {KEPT}),
 mes1 AS (SELECT *, CASE WHEN token IN ('emerg', 'alert', 'crit') OR {first_rx('line', rules.MESSAGES_CRITICAL)} IS NOT NULL THEN 'Critical' WHEN token IN ('err', 'error', 'warning') THEN 'Noise' ELSE 'Info' END AS tier FROM mes0 WHERE ts IS NOT NULL),
 messages AS (SELECT *, CASE WHEN tier = 'Info' THEN NULL ELSE CASE token WHEN 'emerg' THEN 'Emergency' WHEN 'alert' THEN 'Alert' WHEN 'crit' THEN 'Critical' WHEN 'err' THEN 'Error' WHEN 'error' THEN 'Error' WHEN 'warning' THEN 'Warning' ELSE 'Critical event' END END AS label,
  CASE WHEN token IN ('emerg', 'alert', 'crit') THEN 'High' WHEN token IN ('err', 'error') THEN 'Medium' WHEN token = 'warning' THEN 'Low' ELSE 'Info' END AS severity FROM mes1)"""
MESSAGES_F = f"""{MESSAGES}, messages_f AS (SELECT collection, lower(substr({sub('message', DIGITS, '#')}, 1, 100)) AS key, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(message, seq) AS example FROM messages WHERE tier = 'Critical' GROUP BY ALL)"""

NORM = "message"
for name in ("pid", "uid", "gid", "auid", "ses"):
    NORM = sub(NORM, rf"\b{name}=\d+", f"{name}=X")
for pattern, to in ((r"0x[0-9a-fA-F]+", "0xHEX"), (IPV4, "IP"), (r"\b\d{5,}\b", "N"), (r"\s{2,}", " ")):
    NORM = sub(NORM, pattern, to)
AUDIT_CTE = f"""aud0 AS (SELECT collection, seq, line, file_path, {rx('line', AUDIT_LINE)} AS type, {epoch(f"TRY_CAST({rx('line', AUDIT_LINE, 2)} AS BIGINT)")} AS ts, {rx('line', AUDIT_LINE, 3)} AS message FROM ({duck('audit')}) WHERE {like('line', AUDIT_LINE)}),
 aud1 AS (SELECT *, coalesce(nullif({rx('message', 'acct="?([^"' + chr(92) + 's]+)"?')}, ''), 'unknown') AS acct, {any_of('message', rules.EXEC_CRITICAL)} AS bad, CASE WHEN {isin('upper(type)', rules.AUDIT_NOISE_TYPES)} THEN 'Info' WHEN {isin('upper(type)', rules.AUDIT_CRITICAL_TYPES)} THEN 'Critical'
  WHEN {any_of('message', ['res=failed', 'res=denied', ' denied '])} THEN 'Noise' WHEN type IN ('EXECVE', 'USER_CMD') THEN CASE WHEN {any_of('message', rules.EXEC_CRITICAL)} AND NOT {any_of('message', rules.AUTOMATION)} THEN 'Critical' ELSE 'Noise' END
  WHEN type = 'SYSCALL' AND {any_of('message', ['syscall=59', 'syscall=execve'])} AND {any_of('message', rules.EXEC_CRITICAL)} THEN 'Critical' WHEN type IN ('CHOWN', 'CHMOD', 'SETUID', 'SETGID') AND {any_of('message', rules.EXEC_CRITICAL)} THEN 'Critical' ELSE 'Noise' END AS tier FROM aud0),
 audit AS (SELECT *, CASE WHEN tier = 'Info' THEN NULL ELSE CASE type WHEN 'EXECVE' THEN 'Process execution' WHEN 'USER_CMD' THEN 'Sudo command' WHEN 'USER_AUTH' THEN CASE WHEN contains(lower(message), 'res=failed') THEN 'Auth failure' ELSE 'Auth success' END
  WHEN 'ANOM_ABEND' THEN 'Process crash (ANOM_ABEND)' WHEN 'ANOM_PROMISCUOUS' THEN 'NIC promiscuous mode' WHEN 'KERN_MODULE' THEN 'Kernel module' WHEN 'MAC_POLICY_LOAD' THEN 'MAC policy change' ELSE type END END AS label FROM aud1)"""
AUDIT_F = f"""{AUDIT_CTE}, audit_f AS (SELECT collection, lower(type || '|' || substr(trim({NORM}), 1, 100)) AS key, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, arg_min({short('message', 160)}, seq) AS example FROM audit WHERE tier = 'Critical' GROUP BY ALL)"""

WEB = f"""web0 AS (SELECT collection, seq, line, file_path, {TS} AS ts, {rx('line', COMBINED, 1)} AS ip, {rx('line', COMBINED, 3)} AS method, {rx('line', COMBINED, 4)} AS uri, {rx('line', COMBINED, 6)} AS status, {rx('line', COMBINED, 7)} AS size FROM ({duck('web')})),
 web AS (SELECT *, CASE WHEN {like('line', COMBINED)} THEN method || ' ' || uri || ' -> ' || status || ' ' || size || 'B' ELSE line END AS message, {first('uri', rules.URI_ATTACKS)} AS attack,
  CASE WHEN {first('uri', rules.URI_ATTACKS)} IS NOT NULL THEN 'Critical' WHEN {any_of('uri', rules.URI_NOISE)} THEN 'Noise' ELSE 'Info' END AS tier FROM web0)"""
WEB_F = f"""{WEB}, web_f AS (SELECT collection, attack, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(ip, seq) AS ip, arg_min({short('uri', 80)}, seq) AS uri FROM web WHERE attack IS NOT NULL GROUP BY ALL)"""

FIELDS = r"^(\S+\s+\S+\s+\S+\s+\S+\s+\S+)\s+(.+)$"
OWNED = r"^(\S+)[ \t]+(.+)$"
CRONTAB = f"""cro0 AS (SELECT *, {some(rx('trim(line)', '^(@' + chr(92) + 'w+)' + chr(92) + 's+.+$'), rx('trim(line)', FIELDS, 1))} AS schedule, {some(rx('trim(line)', '^@' + chr(92) + 'w+' + chr(92) + 's+(.+)$'), rx('trim(line)', FIELDS, 2))} AS rest,
  (lower(file_path) LIKE '%cron.d%' OR lower(file_path) LIKE '%crontab') AS system FROM ({duck('crontab')}) WHERE {KEPT} AND NOT {like('trim(line)', '^(?:MAILTO|PATH|SHELL|HOME)')}),
 cro1 AS (SELECT collection, seq, line, file_path, file_mtime AS ts, schedule, CASE WHEN system THEN {rx('rest', OWNED)} ELSE regexp_extract(file_path, '[^/]*$') END AS "user", CASE WHEN system AND {rx('rest', OWNED)} <> '' THEN {rx('rest', OWNED, 2)} ELSE rest END AS command FROM cro0 WHERE schedule <> ''),
 crontab AS (SELECT *, CASE WHEN {any_of('command', rules.JOB_WHITELIST)} THEN 'Info' WHEN {any_of('command', rules.JOB_CRITICAL)} THEN 'Critical' WHEN {any_of('command', rules.JOB_SUSPICIOUS)} THEN 'Suspicious' ELSE 'Info' END AS tier FROM cro1)"""

HISTORY = f"""his0 AS (SELECT *, TRY_CAST({rx('line', '^#([0-9]{10,})$')} AS BIGINT) AS ep FROM ({duck('history')}) WHERE trim(line) <> ''),
 his1 AS (SELECT *, {epoch('lag(ep) OVER (PARTITION BY collection, username ORDER BY seq)')} AS ts FROM his0),
 his2 AS (SELECT *, date_diff('second', lag(ts) OVER (PARTITION BY collection, username ORDER BY seq), ts) AS gap FROM his1 WHERE ep IS NULL),
 history AS (SELECT collection, username, seq, file_path, trim(line) AS command, ts, CASE WHEN gap > 43200 THEN CAST(floor(gap / 3600) AS BIGINT) END AS gap_hours FROM his2)"""
LISTED = f"({starts('command', [w for w in rules.SHELL_WHITELIST if w != 'cat '])} OR {isin('lower(command)', [w.rstrip().lower() for w in rules.SHELL_WHITELIST])})"
SHELL = f"""{HISTORY}, shell AS (SELECT *, CASE WHEN CASE WHEN starts_with(lower(command), 'cat ') THEN NOT {any_of('command', rules.CAT_EXCEPTIONS)} ELSE {LISTED} END THEN 'Info'
  WHEN {any_of('command', rules.SHELL_CRITICAL)} THEN 'Critical' WHEN {any_of('command', rules.SHELL_SUSPICIOUS)} THEN 'Suspicious' ELSE 'Info' END AS tier,
  {any_of('command', rules.ANTI_FORENSICS)} OR (contains(lower(command), 'shred') AND contains(lower(command), 'log')) AS anti_forensics FROM history)"""

NOTE = r"\d{5,}"
AUTO = "(contains(lower(cmdline), 'ansible') OR contains(cmdline, 'BECOME-SUCCESS') OR contains(lower(message), 'ansible'))"
JOURNAL = f"""jou0 AS (SELECT *, make_timestamp(CAST(floor(ts_us / 1000) AS BIGINT) * 1000) AS ts, CASE WHEN {AUTO} OR lower(identifier) IN ('sshd', 'ssh') OR starts_with(lower(message), 'pam_unix(sudo:session)') THEN 'Noise'
  WHEN priority <= 1 OR {any_of('exe', rules.JOURNAL_EXE_PATHS)} OR {any_of('cmdline', rules.JOURNAL_CRITICAL)} OR {any_of('message', rules.JOURNAL_CRITICAL)} THEN 'Critical'
  WHEN lower(identifier) = 'sudo' THEN CASE WHEN {any_of('cmdline', rules.JOURNAL_EXE_PATHS)} OR (contains(lower(message), 'command=') AND {any_of('message', rules.JOURNAL_EXE_PATHS)}) THEN 'Critical' ELSE 'Noise' END
  WHEN {any_of('cmdline', rules.JOURNAL_NOISE)} OR {any_of('message', rules.JOURNAL_NOISE)} OR priority <= 4 THEN 'Noise' ELSE 'Info' END AS tier FROM ({duck('journal')})),
 journal AS (SELECT *, CASE WHEN tier = 'Info' THEN NULL WHEN {AUTO} THEN 'Ansible automation' WHEN lower(identifier) IN ('sshd', 'ssh') THEN CASE WHEN contains(lower(message), 'failed') THEN 'SSH login failed' WHEN contains(lower(message), 'accepted') THEN 'SSH login accepted' ELSE 'SSH event' END
  WHEN lower(identifier) = 'sudo' THEN 'Sudo command' WHEN {any_of('cmdline', ['wget', 'curl'])} THEN 'Download tool' WHEN {any_of('cmdline', ['/tmp/', '/dev/shm/'])} THEN 'Temp path execution' WHEN lower(identifier) IN ('bash', 'sh', 'zsh') THEN 'Shell execution' ELSE 'Suspicious journal entry' END AS label,
  CASE WHEN {AUTO} THEN 'ANSIBLE|' || uid WHEN lower(identifier) = 'sudo' THEN tier || '|sudo|' || uid || '|' || substr({sub('cmdline', NOTE, '***')}, 1, 120) WHEN starts_with(lower(identifier), 'ssh') THEN tier || '|' || identifier || '|' || {sub('message', NOTE, '***')}
   ELSE tier || '|' || identifier || '|' || uid || '|' || substr({sub('message', NOTE, '***')}, 1, 120) END AS signature FROM jou0)"""
JOURNAL_F = f"{JOURNAL}, journal_f AS (SELECT collection, signature, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(message, seq) AS example FROM journal WHERE tier = 'Critical' GROUP BY ALL)"


def ext(c: str) -> str:
    return f"lower({rx(c, '(' + chr(92) + '.[^.]*)$')})"


def positive(k: int) -> str:
    return f"CASE WHEN TRY_CAST(p[{k}] AS BIGINT) > 0 THEN TRY_CAST(p[{k}] AS BIGINT) END"


BODY = f"""bod0 AS (SELECT *, string_split(line, '|') AS p FROM ({duck('bodyfile')}) WHERE trim(line) <> '' AND NOT starts_with(line, '#')),
 body AS (SELECT collection, seq, file_path, p[2] AS path, coalesce(TRY_CAST(p[7] AS BIGINT), 0) AS size, p[4] AS mode, p[5] AS uid, p[6] AS gid, p[1] AS md5, {positive(8)} AS atime, {positive(9)} AS mtime, {positive(10)} AS ctime, {positive(11)} AS crtime FROM bod0 WHERE len(p) >= 11)"""
BODY_F = f"""{BODY}, sco0 AS (SELECT *, {any_of('path', rules.BODY_PATH_HINTS)} AS hint, {any_of('path', rules.BODY_KEYWORDS)} AS kw, {isin(ext('path'), rules.EXEC_EXTENSIONS)} AS ex, size >= 1024 AS big, coalesce({epoch('mtime')} > TIMESTAMP '2024-06-01' - INTERVAL 30 DAY, false) AS rec FROM body
  WHERE NOT {starts('path', rules.BODY_WHITELIST)} AND NOT {any_of('path', rules.FRAMEWORK_CACHES)} AND NOT {isin(ext('path'), rules.BENIGN_EXTENSIONS)}),
 sco1 AS (SELECT *, 2 * hint::INT + 3 * kw::INT + 2 * ex::INT + big::INT + 2 * rec::INT AS score, concat_ws(', ', CASE WHEN hint THEN 'PathHint=2' END, CASE WHEN kw THEN 'Keyword=3' END, CASE WHEN ex THEN 'ExecExt=2' END, CASE WHEN big THEN 'Size=1' END, CASE WHEN rec THEN 'RecentMTime=2(' || strftime({epoch('mtime')}, '%Y-%m-%d') || ')' END) AS reasons,
   lower(path) AS pk, lower(CASE WHEN {rx('path', '^(.+)/[^/]*$')} = '' THEN '/' ELSE {rx('path', '^(.+)/[^/]*$')} END) AS folder FROM sco0),
 sco2 AS (SELECT *, max(score) OVER (PARTITION BY collection, pk ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM sco1 WHERE score >= 6 AND kw),
 sco3 AS (SELECT *, row_number() OVER (PARTITION BY collection, folder ORDER BY seq) AS rn FROM sco2 WHERE best IS NULL OR score > best),
 sco4 AS (SELECT *, row_number() OVER (PARTITION BY collection, pk ORDER BY seq DESC) AS last FROM sco3 WHERE rn <= 10)"""


def prefix(c: str, words: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN starts_with(lower({c}), {q(w.lower())}) THEN {q(w)}" for w in words) + " END"


FILE = "lower(regexp_extract(path, '[^/]*$'))"
SHA = f"""sha0 AS (SELECT collection, seq, file_path, {rx('line', '^(' + chr(92) + 'S{40})' + chr(92) + 's+(.+)$')} AS hash, trim({rx('line', '^(' + chr(92) + 'S{40})' + chr(92) + 's+(.+)$', 2)}) AS path FROM ({duck('sha1')}) WHERE {like('line', '^(' + chr(92) + 'S{40})' + chr(92) + 's+(.+)$')}),
 sha1 AS (SELECT *, {starts('path', rules.HASH_WHITELIST)} AS white, {prefix('path', rules.HASH_HIGH_PATHS)} AS hi, {prefix('path', rules.HASH_MEDIUM_PATHS)} AS me, {first('path', rules.HASH_KEYWORDS)} AS kw, {ext(FILE)} AS ext, starts_with({FILE}, '.') AS hidden, {any_of('path', ['/tmp/', '/dev/shm/'])} AS world FROM sha0),
 scored AS (SELECT *, CASE WHEN hi IS NOT NULL THEN 3 WHEN me IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN kw IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN {isin('ext', rules.HASH_EXTENSIONS)} THEN 2 ELSE 0 END + (ext = '')::INT + 2 * hidden::INT + world::INT AS score,
  concat_ws(', ', CASE WHEN hi IS NOT NULL THEN 'high-interest path (' || hi || ')' WHEN me IS NOT NULL THEN 'medium-interest path (' || me || ')' END, CASE WHEN kw IS NOT NULL THEN 'suspicious keyword (' || kw || ')' END, CASE WHEN {isin('ext', rules.HASH_EXTENSIONS)} THEN 'suspicious extension (' || ext || ')' END,
   CASE WHEN ext = '' THEN 'no extension' END, CASE WHEN hidden THEN 'hidden file' END, CASE WHEN world THEN 'world-writable location' END) AS reasons FROM sha1),
 best AS (SELECT *, NOT white AND score >= 3 AS passing, max(CASE WHEN NOT white AND score >= 3 THEN score END) OVER (PARTITION BY collection, lower(hash) ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM scored)"""


def listed(path: str) -> str:
    return f"coalesce(TRY_CAST(json_extract(line, '{path}') AS VARCHAR[]), [])"


CONTAINERS = f"""con0 AS (SELECT collection, container_id, line FROM ({duck('containers')}) WHERE json_valid(line)),
 con1 AS (SELECT collection, container_id, ltrim(line->>'$.Name', '/') AS name, line->>'$.Config.Image' AS image, line->>'$.State.Status' AS status, line->>'$.Created' AS created, trim(array_to_string({listed('$.Config.Entrypoint')}, ' ') || ' ' || array_to_string({listed('$.Config.Cmd')}, ' ')) AS command,
  (line->>'$.HostConfig.Privileged') = 'true' AS privileged, lower(line->>'$.HostConfig.NetworkMode') = 'host' AS host_network, lower(line->>'$.HostConfig.PidMode') = 'host' AS host_pid, (line->>'$.Config.User') IN ('', '0', 'root') AS root,
  list_filter({rules.CONTAINER_CAPS}, lambda c: len(list_filter({listed('$.HostConfig.CapAdd')}, lambda h: contains(upper(h), c))) > 0) AS capabilities,
  list_filter({listed('$.HostConfig.Binds')}, lambda b: split_part(b, ':', 1) = '/' OR contains(b, 'docker.sock') OR len(list_filter({rules.CONTAINER_MOUNTS}, lambda m: split_part(b, ':', 1) = m OR starts_with(split_part(b, ':', 1), m || '/'))) > 0) AS mounts FROM con0),
 con AS (SELECT *, list_filter({rules.CONTAINER_EXEC}, lambda w: contains(lower(command), lower(w))) AS suspicious FROM con1)"""
TRAP, SOCK = "(privileged AND len(mounts) > 0)", "(len(list_filter(mounts, lambda m: contains(lower(m), 'docker.sock'))) > 0)"
RISKS = [
    (TRAP, "CRITICAL", "Privileged + host mount (escape risk)"), (f"NOT {TRAP} AND {SOCK}", "CRITICAL", "Docker socket mount"), (f"NOT {TRAP} AND NOT {SOCK} AND privileged", "HIGH", "Privileged container"),
    (f"NOT {TRAP} AND NOT {SOCK} AND host_network", "HIGH", "Host network mode"), (f"NOT {TRAP} AND NOT {SOCK} AND len(capabilities) > 0", "HIGH", "Dangerous capabilities"),
    (f"NOT {TRAP} AND NOT {SOCK} AND len(mounts) > 0", "HIGH", "Dangerous host mount"), (f"NOT {TRAP} AND NOT {SOCK} AND host_pid", "HIGH", "Host PID namespace"),
    ("len(suspicious) > 0", "MEDIUM", "Suspicious container command"), ("root AND NOT privileged", "MEDIUM", "Container running as root"),
]

USERS_RX = r'users:\(\("([^"]+)",pid=(\d+)'
SOCKETS = f"""soc0 AS (SELECT *, string_split_regex(trim(line), '\\s+') AS t FROM ({duck('sockets')}) WHERE {like('lower(line)', '^(?:tcp|udp)')}),
 soc1 AS (SELECT collection, seq, t[1] AS proto, coalesce(list_filter(t, lambda x: {isin('x', STATES)})[1], 'UNKNOWN') AS state, list_filter(t[2:], lambda x: contains(x, ':') AND NOT starts_with(x, 'users:')) AS a, CASE WHEN {rx('line', USERS_RX)} <> '' THEN {rx('line', USERS_RX)} || '/' || {rx('line', USERS_RX, 2)} ELSE '' END AS process FROM soc0),
 sockets AS (SELECT collection, seq, proto, state, coalesce(a[1], '') AS local, coalesce(a[2], '') AS peer, process, TRY_CAST(regexp_extract(coalesce(a[1], ''), '[^:]*$') AS INT) AS port FROM soc1)"""
PS_RX = r"^\s*(\S+)\s+(\d+)\s+(?:\S+\s+){8}(.+)$"
PS = f"ps AS (SELECT collection, seq, {rx('line', PS_RX)} AS \"user\", CAST({rx('line', PS_RX, 2)} AS BIGINT) AS pid, {rx('line', PS_RX, 3)} AS command FROM ({duck('ps')}) WHERE {like('line', PS_RX)})"
HASHED = "starts_with(ltrim(line), '#')"
ACCOUNTS = f"""acc0 AS (SELECT collection, seq, CASE WHEN artifact = 'passwd' AND NOT {HASHED} AND contains(line, ':') THEN 'account' WHEN artifact = 'shadow' AND (contains(line, '!*') OR contains(line, '!!')) THEN 'locked' WHEN artifact = 'sudoers' AND NOT {HASHED} AND contains(line, 'ALL') THEN 'sudoer'
  WHEN artifact = 'lastlog' AND (contains(line, 'pts/') OR contains(line, 'tty') OR contains(line, 'ssh')) THEN 'login' END AS kind, CASE WHEN artifact IN ('passwd', 'shadow') THEN split_part(line, ':', 1) ELSE {rx('line', '^' + chr(92) + 's*(' + chr(92) + 'S+)')} END AS name FROM ({duck('accounts')})),
 accounts AS (SELECT * FROM acc0 WHERE kind IS NOT NULL)"""
PUBLIC_V4 = "(a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR a = 127 OR (a = 169 AND b = 254))"
HEAD = "coalesce(" + ", ".join(f"nullif({rx('line', p)}, '')" for p in (r"^\d+:\s*([A-Za-z0-9._-]+)[:@]", r"^([A-Za-z0-9._-]+): flags=", r"^([A-Za-z0-9._-]+)\s+Link encap:")) + ")"
OWN = sub("line", r"(?i)\b(?:netmask|mask:|brd|broadcast|bcast:)\s*\S+", " ")
NET = f"""net0 AS (SELECT *, coalesce(last_value(CASE WHEN artifact = 'ip' THEN {HEAD} END IGNORE NULLS) OVER (PARTITION BY collection, file_path, artifact ORDER BY seq ROWS UNBOUNDED PRECEDING), 'unknown') AS interface, {rx('line', IPV4, 0)} AS addr,
 CASE WHEN artifact = 'ip' AND {like('line', r'\binet6?\b')} THEN list_concat(regexp_extract_all({OWN}, {q(r'\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b')}), regexp_extract_all({OWN}, '[0-9A-Fa-f]{{0,4}}(?::[0-9A-Fa-f]{{0,4}}){{2,7}}')) ELSE [''] END AS every FROM ({duck('net')})),
 net1 AS (SELECT * EXCLUDE (every), CASE WHEN address <> '' THEN 'address' WHEN artifact = 'route' AND (contains(line, 'default ') OR contains(line, '0.0.0.0')) THEN 'default_route' WHEN artifact = 'resolv' AND starts_with(lower(ltrim(line)), 'nameserver') THEN 'resolver'
  WHEN artifact = 'resolv' AND starts_with(lower(ltrim(line)), 'search') THEN 'search' WHEN artifact = 'hosts' AND NOT {HASHED} AND addr <> '' THEN 'host' WHEN artifact = 'firewall' AND starts_with(line, ':') THEN 'chain' WHEN artifact = 'firewall' AND starts_with(line, '-A') THEN 'rule'
  WHEN artifact = 'firewall' AND starts_with(line, '*') THEN 'table' END AS kind FROM (SELECT *, unnest(every) AS address FROM net0)),
 net AS (SELECT collection, seq, kind, CASE WHEN kind = 'address' THEN interface ELSE '' END AS name, CASE WHEN kind = 'address' THEN address WHEN kind = 'resolver' THEN addr WHEN kind = 'search' THEN trim(substr(ltrim(line), 7)) ELSE trim(line) END AS value, kind = 'resolver' AND {isin('addr', rules.PUBLIC_RESOLVERS)} AS public FROM net1 WHERE kind IS NOT NULL)"""

CONTAINER_RISK = " UNION ALL ".join(f"SELECT collection, container_id, name, image, {q(s)} AS severity, {q(label)} AS label FROM con WHERE {test}" for test, s, label in RISKS)
CONTAINER_LOGS = f"SELECT l.collection, l.seq, {first('l.line', rules.CONTAINER_EXEC)} AS word, coalesce(c.name, substr(l.container_id, 1, 12)) AS name, {short('l.line', 120)} AS line FROM ({duck('container_logs')}) l LEFT JOIN con c ON l.collection = c.collection AND l.container_id = c.container_id WHERE {any_of('l.line', rules.CONTAINER_EXEC)}"
DOCKER_TS = epoch(f"TRY_CAST({rx('line', '\"time\"' + chr(92) + 's*:' + chr(92) + 's*([0-9]+)')} AS BIGINT)")
DOCKER_EVENTS = f"""dev AS (SELECT collection, seq, file_path, artifact = 'daemon' AS daemon, lower(line) AS low, {DOCKER_TS} AS ts FROM ({duck('docker_events')})),
 docker_hits AS (SELECT collection, seq, ts, 'MEDIUM' AS severity, 'Privileged event' AS label FROM dev WHERE NOT daemon AND (contains(low, '"privileged":true') OR contains(low, '--privileged'))
  UNION ALL SELECT collection, seq, ts, 'HIGH', 'Privileged launch (daemon log)' FROM dev WHERE daemon AND contains(low, '--privileged')
  UNION ALL SELECT collection, seq, ts, 'HIGH', 'Suspicious mount (daemon log)' FROM dev WHERE daemon AND {like('low', 'mount.*(?:host|/proc|/dev|docker' + chr(92) + '.sock)')})"""
PERSISTENCE = f"""per0 AS (SELECT collection, seq, CASE WHEN artifact = 'systemd' AND (contains(line, 'WantedBy=') OR (contains(line, '.service') AND (contains(line, '/tmp/') OR contains(line, '/dev/shm/') OR contains(line, '/var/tmp/')))) THEN 'unit'
  WHEN artifact = 'crontab' AND NOT {HASHED} AND (contains(line, 'wget ') OR contains(line, 'curl ') OR contains(line, 'bash -c') OR contains(line, 'python ')) THEN 'cron' WHEN artifact = 'rc_local' AND NOT {HASHED} AND (contains(line, 'bash ') OR contains(line, 'sh ') OR contains(line, 'python ') OR contains(line, 'nohup ')) THEN 'rc.local'
  WHEN artifact = 'bashrc' AND starts_with(line, 'export ') THEN 'export' END AS kind, line FROM ({duck('persistence')})), persistence AS (SELECT * FROM per0 WHERE kind IS NOT NULL)"""
TEMP_FILES = f"SELECT collection, seq, line AS path FROM ({duck('files')}) WHERE {any_of('line', ['/tmp', '/var/tmp', '/dev/shm', '/home'])} AND ({like('lower(line)', chr(92) + '.(?:sh|py|elf)$')} OR {any_of('line', ['minerd', 'backdoor', 'revsh'])})"
PROCESS_HITS = f"""pro0 AS (SELECT *, {first('command', rules.PROCESS_KEYWORDS)} AS word, (contains(command, 'systemd') OR contains(command, 'sshd') OR contains(command, 'cron')) AS core FROM ps), process_hits AS (SELECT * FROM pro0 WHERE word IS NOT NULL OR core)"""


def hits(log_type: str, severity: str, key: str, ts: str, source: str) -> str:
    return f"SELECT collection, {q(log_type)} AS log_type, {severity} AS severity, {key} AS key, count(*) AS n, min({ts}) AS first_ts, max({ts}) AS last_ts FROM ({source}) GROUP BY ALL"


def top_logins(what: str, key: str, k: int) -> str:
    rows = f"SELECT collection, address AS ip, who AS \"user\", count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM actions WHERE action = {q(what)} GROUP BY ALL"
    return f"SELECT collection, 'AUTH', 'MEDIUM', {key}, n, first_ts, last_ts FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY n DESC, ip, \"user\") AS rank FROM ({rows})) WHERE rank <= {k}"


NEVER = "CAST(NULL AS TIMESTAMP)"
TIERS = "CASE tier WHEN 'Critical' THEN 'HIGH' ELSE 'SUSPICIOUS' END"
SHA_BEST = "SELECT collection, hash, path, score, reasons, CASE WHEN score >= 7 THEN 'HIGH' WHEN score >= 4 THEN 'SUSPICIOUS' ELSE 'INFO' END AS severity FROM (SELECT *, row_number() OVER (PARTITION BY collection, lower(hash) ORDER BY seq DESC) AS rn FROM best WHERE passing AND (best IS NULL OR score > best)) WHERE rn = 1"
EPOCHS = "[atime, mtime, ctime, crtime]"
COVERED_ROWS = " UNION ALL ".join(
    [f"SELECT collection, {q(t.upper())} AS log_type, file_path, ts, ts AS last FROM {t}" for t in ("auth", "syslog", "messages", "audit", "web", "crontab", "journal")]
    + ["SELECT collection, 'BASH', file_path, ts, ts FROM history", "SELECT collection, 'DOCKER', file_path, ts, ts FROM dev", f"SELECT collection, 'SHA1', file_path, {NEVER}, {NEVER} FROM sha0"]
    + [f"SELECT collection, {q(kind)}, file_path, {NEVER}, {NEVER} FROM ({duck(t)})" for kind, t in (("DOCKER", "containers"), ("DOCKER", "container_logs"), ("LIVE", "ps"), ("LIVE", "persistence"), ("LIVE", "files"))]
    + [f"SELECT collection, 'BODYFILE', file_path, {epoch(f'list_min({EPOCHS})')}, {epoch(f'list_max({EPOCHS})')} FROM body"]
)
VALID = "min(CASE WHEN year(ts) BETWEEN 2000 AND 2025 THEN ts END) AS first_ts, max(CASE WHEN year(last) BETWEEN 2000 AND 2025 THEN last END) AS last_ts"
COVERED = f"""{ACTIONS}, {SYSLOG_F}, {MESSAGES_F}, {AUDIT_F}, {WEB_F}, {CRONTAB}, {SHELL}, {JOURNAL_F}, {CONTAINERS}, {DOCKER_EVENTS}, {BODY_F}, {SHA}, {PS}, {PROCESS_HITS}, {PERSISTENCE},
 covered0 AS ({COVERED_ROWS}),
 covered AS (SELECT collection, log_type, count(*) AS rows, count(DISTINCT file_path) AS files, {VALID} FROM covered0 GROUP BY ALL),
 found AS (SELECT collection, 'SYSLOG' AS log_type, 'HIGH' AS severity, key, n, first_ts, last_ts FROM syslog_f UNION ALL SELECT collection, 'MESSAGES', 'HIGH', key, n, first_ts, last_ts FROM messages_f UNION ALL SELECT collection, 'AUDIT', 'HIGH', key, n, first_ts, last_ts FROM audit_f
  UNION ALL SELECT collection, 'WEB', 'HIGH', attack, n, first_ts, last_ts FROM web_f UNION ALL SELECT collection, 'JOURNAL', 'HIGH', signature, n, first_ts, last_ts FROM journal_f
  UNION ALL {hits('AUTH', "'HIGH'", "who || ' ran: ' || " + short('command', 200).join('()'), 'ts', f"SELECT * FROM actions WHERE action = 'sudo' AND {any_of('command', rules.SUDO_HIGH)} AND NOT {any_of('command', rules.AUTOMATION)}")}
  UNION ALL SELECT * FROM ({hits('AUTH', "'BRUTEFORCE'", 'address', 'ts', "SELECT * FROM actions WHERE action = 'failed'")}) WHERE n >= 5
  UNION ALL {top_logins('accepted', '"user" || ' + q(' from ') + ' || ip', 20)} UNION ALL {top_logins('failed', 'ip || ' + q(' user=') + ' || "user"', 10)}
  UNION ALL {hits('CRONTAB', TIERS, 'command', 'ts', "SELECT * FROM crontab WHERE tier <> 'Info'")} UNION ALL {hits('BASH', TIERS, "username || ': ' || command", 'ts', "SELECT * FROM shell WHERE tier <> 'Info'")}
  UNION ALL {hits('BASH', "'HIGH'", "'anti-forensics by ' || username", 'ts', "SELECT * FROM shell WHERE anti_forensics AND tier <> 'Info'")}
  UNION ALL {hits('DOCKER', 'severity', "label || ': ' || name", NEVER, CONTAINER_RISK)} UNION ALL {hits('DOCKER', "'HIGH'", "word || ' in log of ' || name", NEVER, CONTAINER_LOGS)}
  UNION ALL {hits('DOCKER', 'severity', 'label', 'ts', 'SELECT * FROM docker_hits')} UNION ALL {hits('BODYFILE', "'SUSPICIOUS'", 'path', epoch('mtime'), 'SELECT * FROM sco4 WHERE last = 1')}
  UNION ALL {hits('SHA1', 'severity', "hash || ' ' || path", NEVER, SHA_BEST)} UNION ALL {hits('LIVE', "'MEDIUM'", "word || ' in: ' || command", NEVER, 'SELECT * FROM process_hits WHERE word IS NOT NULL')}
  UNION ALL {hits('LIVE', "'MEDIUM'", "kind || ': ' || line", NEVER, 'SELECT * FROM persistence')} UNION ALL {hits('LIVE', "'MEDIUM'", 'path', NEVER, TEMP_FILES)})"""
IPS = "SELECT collection, address AS ip FROM actions WHERE action IN ('failed', 'accepted') AND address <> ''"
RANGE = f"{shown('first_ts')}, {shown('last_ts')}"


def topk(cte: str, k: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY n DESC, ip, \"user\") AS rank FROM ({cte})) WHERE rank <= {k}"


def logins(what: str) -> str:
    return f"SELECT collection, address AS ip, who AS \"user\", count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM actions WHERE action = {q(what)} GROUP BY ALL"


def grouping(c: str) -> str:
    for pattern, to in (
        (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", "TIMESTAMP"), (r"\b\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}", "TIMESTAMP"), (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "IP"),
        (r"\b(?:[A-Fa-f0-9]{1,4}:){1,7}[A-Fa-f0-9]{1,4}\b", "IP"), (r"(?i)\[?\bpid[=:]?\d+\]?", "PID"), (r"\[\d+\]", "PID"), (r"(?i)\b(?:uid|gid|auid)=\d+", "ID"), (r"0x[0-9a-fA-F]+", "HEX"), (r"\b\d+\b", "N"), (r"\s+", " "),
    ):
        c = sub(c, pattern, to)
    return f"trim({c})"


def ranked(part: str, k: int) -> str:
    return f"SELECT collection, log_type, section, item, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY collection, log_type ORDER BY n DESC, item) AS rank FROM ({part})) WHERE rank <= {k}"


AUTH_GRADE = f"CASE WHEN {like('line', SUDO)} THEN CASE WHEN {any_of(rx('line', SUDO, 2), rules.SUDO_HIGH)} THEN 'High' ELSE 'Medium' END WHEN {like('line', ACCEPTED)} THEN 'Info' WHEN {like('line', FAILED)} THEN 'Medium' ELSE 'Info' END"
JOB_GRADE = "CASE tier WHEN 'Critical' THEN 'High' WHEN 'Suspicious' THEN 'Medium' ELSE 'Info' END"
BOX = """'Container=' || name || ' Image=' || image || ' State=' || status || CASE WHEN privileged THEN ' [PRIVILEGED]' ELSE '' END || CASE WHEN host_network THEN ' [HOST_NETWORK]' ELSE '' END
 || CASE WHEN host_pid THEN ' [HOST_PID]' ELSE '' END || CASE WHEN len(mounts) > 0 THEN ' [MOUNTS:' || array_to_string(mounts, ';') || ']' ELSE '' END"""
NORMALISED = {
    "AUTH": ("host", "daemon", '"user"', "ip", "message", AUTH_GRADE, "line", "auth"),
    "SYSLOG": ("host", "daemon", "CASE WHEN tier = 'Critical' AND cron_user <> '' THEN cron_user ELSE \"user\" END", "ip", "message", "severity", "line", "syslog WHERE tier <> 'Noise'"),
    "MESSAGES": (rx("line", HEADER, 2), rx("line", HEADER, 3), '"user"', rx("line", IPV4, 0), "message", "severity", "line", "messages"),
    "AUDIT": ("''", "type", "''", "''", "substr(message, 1, 200)", "CASE tier WHEN 'Critical' THEN 'High' ELSE 'Info' END", "line", "audit"),
    "WEB": ("''", "'web'", "''", "ip", "message", "CASE WHEN attack IS NULL THEN 'Info' ELSE 'High' END", "line", "web"),
    "CRONTAB": ("''", "'cron'", '"user"', "''", "command", JOB_GRADE, "line", "crontab WHERE tier <> 'Info'"),
    "BASH": ("''", "'bash'", "username", "''", "command", JOB_GRADE, "command", "shell"),
    "DOCKER": ("''", "'docker'", "''", "''", BOX, f"CASE WHEN {TRAP} THEN 'Critical' WHEN privileged OR host_network OR len(capabilities) > 0 THEN 'High' WHEN len(suspicious) > 0 OR root THEN 'Medium' ELSE 'Info' END",
      "'ID=' || container_id || ' Name=' || name || ' Image=' || image", "(SELECT *, try_strptime(created, '%Y-%m-%dT%H:%M:%SZ') AS ts FROM con)"),
    "JOURNAL": ("hostname", "identifier", "CAST(uid AS VARCHAR)", "''", "message", "CASE tier WHEN 'Critical' THEN 'High' ELSE 'Info' END", "message", "journal"),
}
EVENTS_NORM = " UNION ALL ".join(
    f"SELECT collection, ts, {q(t)} AS log_type, {a} AS host, {b} AS daemon, {c} AS \"user\", {e} AS ip, {m} AS message, {g} AS severity, {r} AS raw FROM {source}" for t, (a, b, c, e, m, g, r, source) in NORMALISED.items()
)


ORACLE_SQL = {
    "ssh_bruteforce": f"WITH {ACTIONS} SELECT collection, address AS ip, count(*) AS n, {shown('min(ts)', 'first_ts')}, {shown('max(ts)', 'last_ts')}, count(DISTINCT who) AS users FROM actions WHERE action = 'failed' GROUP BY collection, address HAVING count(*) >= 5",
    "failed_logins_topk": f"WITH {ACTIONS} {topk(logins('failed'), 10)}",
    "accepted_logins_topk": f"WITH {ACTIONS} {topk(logins('accepted'), 20)}",
    "sudo_findings": f"WITH {ACTIONS} SELECT collection, seq, {shown('ts')}, who AS \"user\", {short('command', 200)} AS command, CASE WHEN {any_of('command', rules.SUDO_HIGH)} AND NOT {any_of('command', rules.AUTOMATION)} THEN 'HIGH' ELSE 'Info' END AS tier, CASE WHEN {any_of('command', rules.SUDO_HIGH)} THEN 'High' ELSE 'Medium' END AS severity FROM actions WHERE action = 'sudo'",
    "auth_events_norm": f"WITH {AUTH} SELECT collection, seq, {shown('ts')}, host, 'AUTH' AS log_type, daemon, \"user\", ip, message, CASE WHEN {like('line', SUDO)} THEN CASE WHEN {any_of(rx('line', SUDO, 2), rules.SUDO_HIGH)} THEN 'High' ELSE 'Medium' END WHEN {like('line', ACCEPTED)} THEN 'Info' WHEN {like('line', FAILED)} THEN 'Medium' ELSE 'Info' END AS severity, line AS raw FROM auth",
    "events_norm": f"WITH {AUTH}, {SYSLOG}, {MESSAGES}, {AUDIT_CTE}, {WEB}, {CRONTAB}, {SHELL}, {JOURNAL}, {CONTAINERS}, e AS ({EVENTS_NORM}) SELECT * REPLACE (strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts) FROM e WHERE ts IS NULL OR ts BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '2024-03-15 12:00:00'",
    "pattern_counts_auth": f"WITH {ACTIONS} SELECT collection, label, count(*) AS n FROM actions GROUP BY ALL",
    "interesting_ips": f"WITH {ACTIONS}, {WEB} SELECT collection, ip, count(*) AS n FROM ({IPS} UNION ALL SELECT collection, ip FROM web WHERE attack IS NOT NULL AND ip <> '') GROUP BY ALL",
    "public_ip_split": f"WITH {AUTH}, v AS (SELECT collection, ip, TRY_CAST(split_part(ip, '.', 1) AS INT) AS a, TRY_CAST(split_part(ip, '.', 2) AS INT) AS b FROM auth WHERE ip <> '') SELECT collection, NOT {PUBLIC_V4} AS public, count(*) AS n, count(DISTINCT ip) AS ips FROM v GROUP BY ALL",
    "sessions_paired": f"WITH {PAIRED} SELECT collection, \"user\", ip, daemon, seq, {shown('start_ts')}, {shown('end_ts')}, end_seq, seconds, type FROM paired",
    "sessions_linked": f"WITH {PAIRED.replace(duck('auth'), duck('logins')).replace('actions AS (', 'every AS (', 1).replace(' marks AS (', LINKED + ' marks AS (', 1)} SELECT collection, \"user\", ip, daemon, seq, {shown('start_ts')}, {shown('end_ts')}, end_seq, seconds, type FROM paired",
    "session_types": f"WITH {PAIRED} SELECT collection, type, count(*) AS n, count(end_ts) AS closed FROM paired GROUP BY ALL",
    "session_suspicion": f"WITH {JUDGED} SELECT collection, seq, \"user\", ip, daemon, type, failures, reason, notes FROM judged WHERE reason IS NOT NULL",
    "sessions_by_start": f"WITH {JUDGED} SELECT collection, ip, failures, \"user\", daemon, {shown('start_ts')}, {shown('end_ts')}, seconds, type, seq, reason FROM judged",
    "session_stats": f"WITH {JUDGED} SELECT collection, count(*) AS total, count(reason) AS suspicious, count_if(type = 'SshInteractive') AS ssh, count_if(type = 'SshFailed') AS failed, count_if(type = 'SudoCommand') AS sudo, count_if(type = 'CronJob') AS cron, count(DISTINCT CASE WHEN ip <> 'N/A' THEN ip END) AS ips FROM judged GROUP BY ALL",
    "sessions_grouped": f"WITH {JUDGED} SELECT collection, \"user\", ip, daemon, type, count(*) AS n, {shown('min(start_ts)', 'first_ts')}, {shown('max(start_ts)', 'last_ts')}, CAST(floor(avg(coalesce(seconds, 0))) AS BIGINT) AS avg_seconds, bool_or(reason IS NOT NULL) AS suspicious, arg_min(reason, seq) FILTER (reason IS NOT NULL) AS reason, coalesce(arg_min(notes, seq) FILTER (reason IS NOT NULL), '') AS notes FROM judged WHERE type NOT IN ('CronJob', 'SystemdSession', 'PamGeneric') GROUP BY collection, \"user\", ip, daemon, type",
    "syslog_tiers": f"WITH {SYSLOG} SELECT collection, seq, {shown('ts')}, host, daemon, \"user\", ip, cron_user, cron_cmd, tier, label, severity FROM syslog",
    "syslog_findings": f"WITH {SYSLOG_F} SELECT collection, key, n, {RANGE}, example FROM syslog_f",
    "messages_findings": f"WITH {MESSAGES_F} SELECT collection, key, n, {RANGE}, example FROM messages_f",
    "messages_tiers": f"WITH {MESSAGES} SELECT collection, tier, label, severity, \"user\", count(*) AS n FROM messages GROUP BY ALL",
    "audit_tiers": f"WITH {AUDIT_CTE} SELECT collection, seq, {shown('ts')}, type, acct, tier, label FROM audit",
    "audit_findings": f"WITH {AUDIT_F} SELECT collection, key, n, {RANGE}, example FROM audit_f",
    "auth_success_after_failures": f"""WITH {AUDIT_CTE}, l AS (SELECT *, lower(acct) AS who, contains(lower(message), 'res=failed') AS bad_login FROM audit WHERE type IN ('USER_AUTH', 'USER_LOGIN')),
 r AS (SELECT *, coalesce(sum(bad_login::INT) OVER w, 0) AS failures, last_value(CASE WHEN bad_login THEN ts END IGNORE NULLS) OVER w AS last_failure FROM l WINDOW w AS (PARTITION BY collection, who ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 f AS (SELECT *, row_number() OVER (PARTITION BY collection, who ORDER BY seq) AS rn FROM r WHERE NOT bad_login AND contains(lower(message), 'res=success') AND failures >= 5)
 SELECT collection, who AS acct, {shown('ts')}, CAST(failures AS BIGINT) AS failures, {shown('last_failure')} FROM f WHERE rn = 1""",
    "web_events_norm": f"WITH {WEB} SELECT collection, seq, {shown('ts')}, ip, method, uri, status, size, message, tier, CASE WHEN attack IS NULL THEN 'Info' ELSE 'High' END AS severity FROM web",
    "web_attack_findings": f"WITH {WEB_F} SELECT collection, attack, n, {RANGE}, ip, uri FROM web_f",
    "web_bruteforce": f"""WITH {WEB}, m AS (SELECT collection, ip, date_trunc('minute', ts) AS minute, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM web WHERE method <> '' AND ts IS NOT NULL GROUP BY ALL),
 p AS (SELECT *, row_number() OVER (PARTITION BY collection, ip ORDER BY n DESC, minute) AS rn FROM m) SELECT collection, ip, max(n) AS peak, {shown('max(CASE WHEN rn = 1 THEN minute END)', 'minute')}, CAST(sum(n) AS BIGINT) AS requests, {shown('min(first_ts)', 'first_ts')}, {shown('max(last_ts)', 'last_ts')} FROM p GROUP BY collection, ip HAVING max(n) > 1""",
    "crontab_findings": f"WITH {CRONTAB} SELECT collection, seq, schedule, \"user\", command, tier, CASE tier WHEN 'Critical' THEN 'High' ELSE 'Medium' END AS severity FROM crontab WHERE tier <> 'Info'",
    "history_commands": f"WITH {HISTORY} SELECT collection, username, seq, command, {shown('ts')}, gap_hours FROM history",
    "history_gaps": f"WITH {HISTORY} SELECT collection, username, count(*) AS gaps, max(gap_hours) AS longest FROM history WHERE gap_hours IS NOT NULL GROUP BY ALL",
    "shell_findings": f"WITH {SHELL} SELECT collection, username, seq, command, tier, CASE tier WHEN 'Critical' THEN 'High' ELSE 'Medium' END AS severity, anti_forensics FROM shell WHERE tier <> 'Info'",
    "anti_forensics_by_user": f"WITH {SHELL} SELECT collection, username, count(*) AS n FROM shell WHERE anti_forensics AND tier <> 'Info' GROUP BY ALL",
    "lateral_movement": f"WITH {HISTORY} SELECT collection, username, {rx('command', SSH, 1)} AS as_user, {rx('command', SSH, 2)} AS target, count(*) AS n, {shown('min(ts)', 'first_ts')}, {shown('max(ts)', 'last_ts')} FROM history WHERE starts_with(lower(command), 'ssh ') AND {like('command', SSH)} GROUP BY ALL",
    "bodyfile_timeline_in_range": f"""WITH {BODY}, b AS (SELECT *, [t for t in {EPOCHS} if t IS NOT NULL] AS stamps FROM body) SELECT collection, seq, path, size, mode, uid, gid, md5, {', '.join(shown(epoch(c), c) for c in ('atime', 'mtime', 'ctime', 'crtime'))} FROM b
  WHERE len(stamps) = 0 OR len([t for t in stamps if make_timestamp(t * 1000000) BETWEEN TIMESTAMP '2023-11-20 00:00:00' AND TIMESTAMP '2023-11-25 06:00:00']) > 0""",
    "ssh_bruteforce_sketched": f"WITH {ACTIONS} SELECT collection, address AS ip, count(*) AS n, {shown('min(ts)', 'first_ts')}, {shown('max(ts)', 'last_ts')}, count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT who) AS users FROM actions WHERE action = 'failed' AND ts IS NOT NULL GROUP BY collection, address HAVING count(*) >= 5",
    "bodyfile_timeline": f"WITH {BODY} SELECT collection, seq, path, size, mode, uid, gid, md5, {', '.join(shown(epoch(c), c) for c in ('atime', 'mtime', 'ctime', 'crtime'))} FROM body",
    "bodyfile_findings": f"WITH {BODY_F} SELECT collection, path, score, reasons, size, {shown(epoch('mtime'), 'mtime')} FROM sco4 WHERE last = 1",
    "sha1_candidates": f"WITH {SHA} {SHA_BEST}",
    "sha1_shown": f"WITH {SHA} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY score DESC, path, hash) AS rank FROM ({SHA_BEST})) WHERE rank <= 20",
    "sha1_stats": f"WITH {SHA} SELECT collection, count(*) AS total, count_if(white) AS whitelisted, count_if(NOT white) AS scored, count_if(NOT white AND score < 3) AS below, count_if(passing AND coalesce(score <= best, false)) AS duplicates, count(DISTINCT CASE WHEN passing THEN lower(hash) END) AS candidates FROM best GROUP BY ALL",
    "container_inventory": f"WITH {CONTAINERS} SELECT collection, container_id, name, image, status, created, command, privileged, host_network, host_pid, root, array_to_string(capabilities, '; ') AS capabilities, array_to_string(mounts, '; ') AS mounts, array_to_string(suspicious, '; ') AS suspicious, CASE WHEN {TRAP} THEN 'Critical' WHEN privileged OR host_network OR len(capabilities) > 0 THEN 'High' WHEN len(suspicious) > 0 OR root THEN 'Medium' ELSE 'Info' END AS severity FROM con",
    "container_risk": f"WITH {CONTAINERS} {CONTAINER_RISK}",
    "container_log_hits": f"WITH {CONTAINERS} {CONTAINER_LOGS}",
    "docker_event_hits": f"WITH {DOCKER_EVENTS} SELECT collection, seq, {shown('ts')}, severity, label FROM docker_hits",
    "journal_tiers": f"WITH {JOURNAL} SELECT collection, seq, {shown('ts')}, identifier, tier, label FROM journal",
    "journal_findings": f"WITH {JOURNAL_F} SELECT collection, signature, n, {RANGE}, example FROM journal_f",
    "message_clusters": f"""WITH t AS (SELECT 'conversations' AS collection, text AS line, conv_id, turn FROM conversations UNION ALL SELECT 'documents', text, doc_id, 0 FROM documents), k AS (SELECT *, sha256({grouping('line')}) AS key FROM t WHERE line IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY collection, key ORDER BY conv_id, turn) AS rn, count(*) OVER (PARTITION BY collection, key) AS n FROM k) SELECT collection, key, n, conv_id AS first_id, turn AS first_turn FROM r WHERE rn = 1""",
    "rank_keyword_hits": f"""WITH t AS (SELECT 'documents' AS source, doc_id AS id, text FROM documents UNION ALL SELECT 'auth', seq, line FROM ({duck('auth')}) UNION ALL SELECT 'history', seq, line FROM ({duck('history')}))
 SELECT source, id, coalesce({first('text', rules.RANK1)}, {first('text', rules.RANK2)}) AS keyword, CASE WHEN {first('text', rules.RANK1)} IS NOT NULL THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM t WHERE ({any_of('text', rules.RANK1)} OR {any_of('text', rules.RANK2)}) AND NOT {any_of('text', rules.RANK_WHITELIST)}""",
    "socket_table": f"WITH {SOCKETS} SELECT * FROM sockets",
    "listening_ports": f"WITH {SOCKETS} SELECT collection, proto, port, count(*) AS n, coalesce({isin('port', NOTABLE_PORTS)}, false) AS notable FROM sockets WHERE state LIKE 'LISTEN%' GROUP BY ALL",
    "listeners_shown": f"WITH {SOCKETS} SELECT collection, rank, port, proto, local, process FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY port ASC NULLS LAST, proto, seq) AS rank FROM sockets WHERE state LIKE 'LISTEN%') WHERE rank <= 10",
    "external_connections": f"""WITH {SOCKETS}, v AS (SELECT *, regexp_replace(peer, ':[^:]*$', '') AS bare FROM sockets WHERE state LIKE 'ESTAB%'), w AS (SELECT *, TRY_CAST(split_part(bare, '.', 1) AS INT) AS a, TRY_CAST(split_part(bare, '.', 2) AS INT) AS b FROM v)
 SELECT collection, peer, split_part(process, '/', 1) AS process, count(*) AS n FROM w WHERE NOT {PUBLIC_V4} GROUP BY ALL""",
    "processes_by_user": f"WITH {PS} SELECT collection, \"user\", count(*) AS n FROM ps GROUP BY ALL",
    "process_hits": f"WITH {PS}, {PROCESS_HITS} SELECT * FROM process_hits",
    "open_file_hits": f"""WITH o AS (SELECT collection, seq, artifact, line FROM ({duck('open_files')})) SELECT collection, seq, 'deleted' AS kind, trim(line) AS line FROM o WHERE artifact = 'lsof' AND contains(line, '(deleted)')
 UNION ALL SELECT collection, seq, 'socket', trim(line) FROM o WHERE artifact = 'lsof' AND (contains(line, 'TCP') OR contains(line, 'UDP')) UNION ALL SELECT collection, seq, 'shell', trim(line) FROM o WHERE artifact = 'pstree' AND {like('lower(line)', 'bash|sh|zsh|dash|ksh|python|perl|php|ruby')}""",
    "account_inventory": f"WITH {ACCOUNTS} SELECT * FROM accounts",
    "net_config": f"WITH {NET} SELECT * FROM net",
    "persistence_hits": f"WITH {PERSISTENCE} SELECT * FROM persistence",
    "suspicious_temp_files": TEMP_FILES,
    "recent_files_shown": f"SELECT collection, rank, line FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY line DESC, seq) AS rank FROM ({duck('files')}) WHERE artifact = 'recent' AND trim(line) <> '') WHERE rank <= 10",
    "distinct_values": f"WITH {ACCOUNTS}, {NET} SELECT DISTINCT collection, kind, value FROM net WHERE kind IN ('resolver', 'search', 'host') UNION SELECT collection, kind, name FROM accounts WHERE kind = 'sudoer'",
    "fleet_counts": f"""WITH {ACCOUNTS}, {SOCKETS}, {NET}, m AS (SELECT collection, artifact AS measure FROM ({duck('files')}) WHERE artifact IN ('suid', 'world_writable') UNION ALL SELECT collection, kind FROM accounts WHERE kind <> 'login'
  UNION ALL SELECT collection, CASE WHEN state LIKE 'LISTEN%' THEN 'listener' ELSE 'established' END FROM sockets WHERE state LIKE 'LISTEN%' OR state LIKE 'ESTAB%' UNION ALL SELECT collection, kind FROM net WHERE kind IN ('chain', 'rule', 'table')
  UNION ALL SELECT collection, CASE artifact WHEN 'systemd' THEN 'unit' ELSE 'cron_entry' END FROM ({duck('persistence')}) WHERE artifact = 'systemd' OR (artifact = 'crontab' AND NOT {HASHED})) SELECT collection, measure, count(*) AS n FROM m GROUP BY ALL""",
    "collapsed_cron": f"""WITH {SYSLOG}, c AS (SELECT collection, seq, cron_cmd, ts FROM syslog WHERE cron_cmd <> '') SELECT collection, 'FINDING: [CRON] Suspicious cron job CMD: ' || cron_cmd AS key, count(*) AS n, {shown('min(ts)', 'first_ts')}, {shown('max(ts)', 'last_ts')}, arg_min(cron_cmd, seq) AS example FROM c GROUP BY collection, cron_cmd HAVING count(*) >= 2""",
    "coverage": f"WITH {COVERED} SELECT collection, log_type, rows, {RANGE} FROM covered",
    "coverage_levels": f"""WITH {COVERED}, f AS (SELECT collection, log_type, file_path, count(*) AS rows, {VALID} FROM covered0 GROUP BY ALL)
  SELECT collection, coalesce(log_type, '') AS log_type, coalesce(file_path, '') AS file_path, CASE grouping(log_type, file_path) WHEN 0 THEN 'file' WHEN 1 THEN 'log_type' ELSE 'collection' END AS level,
  count(*) AS files, sum(rows)::BIGINT AS rows, {shown('min(first_ts)', 'first_ts')}, {shown('max(last_ts)', 'last_ts')} FROM f GROUP BY GROUPING SETS ((collection, log_type, file_path), (collection, log_type), (collection))""",
    "syslog_findings_per_file": f"WITH {SYSLOG_F.replace(', syslog_f AS (SELECT collection,', ', syslog_f AS (SELECT collection, file_path,')} SELECT collection, file_path, key, n, {RANGE}, example FROM syslog_f",
    "findings": f"WITH {COVERED} SELECT collection, log_type, severity, key, n, {RANGE} FROM found",
    "per_log_status": f"WITH {COVERED}, s AS (SELECT c.collection, c.log_type, any_value(c.files) AS files, count_if(coalesce(f.severity <> 'INFO', false)) AS suspicious FROM covered c LEFT JOIN found f ON c.collection = f.collection AND c.log_type = f.log_type GROUP BY ALL) SELECT *, CASE WHEN suspicious = 0 THEN 'clean' ELSE suspicious || ' suspicious' END AS status FROM s",
    "global_summary": f"""WITH {COVERED}, labels AS (SELECT collection, 'AUTH' AS log_type, 'pattern' AS section, label AS item, count(*) AS n FROM actions GROUP BY ALL UNION ALL SELECT collection, 'SYSLOG', 'pattern', label, count(*) FROM syslog WHERE label IS NOT NULL GROUP BY ALL
  UNION ALL SELECT collection, 'AUDIT', 'pattern', label, count(*) FROM audit WHERE label IS NOT NULL GROUP BY ALL UNION ALL SELECT collection, 'WEB', 'pattern', attack, count(*) FROM web WHERE attack IS NOT NULL GROUP BY ALL
  UNION ALL SELECT collection, 'MESSAGES', 'pattern', label, count(*) FROM messages WHERE label IS NOT NULL GROUP BY ALL UNION ALL SELECT collection, 'JOURNAL', 'pattern', label, count(*) FROM journal WHERE label IS NOT NULL GROUP BY ALL
  UNION ALL SELECT collection, 'CRONTAB', 'pattern', tier || ' crontab entry', count(*) FROM crontab WHERE tier <> 'Info' GROUP BY ALL UNION ALL SELECT collection, 'BASH', 'pattern', tier || ' shell command', count(*) FROM shell WHERE tier <> 'Info' GROUP BY ALL),
 ips AS (SELECT collection, 'AUTH' AS log_type, 'ip' AS section, ip AS item, count(*) AS n FROM ({IPS}) GROUP BY ALL UNION ALL SELECT collection, 'WEB', 'ip', ip, count(*) FROM web WHERE attack IS NOT NULL GROUP BY ALL), parts AS (SELECT collection, log_type, 'rows' AS section, '' AS item, rows AS n, 1 AS rank FROM covered
  UNION ALL SELECT collection, log_type, 'files', '', files, 1 FROM covered UNION ALL SELECT collection, log_type, 'suspicious', '', count(*), 1 FROM found WHERE severity <> 'INFO' GROUP BY ALL
  UNION ALL SELECT collection, log_type, 'more', '', count(*) - 5, 1 FROM found WHERE severity IN ('HIGH', 'CRITICAL', 'BRUTEFORCE', 'SUSPICIOUS') GROUP BY ALL HAVING count(*) > 5
  UNION ALL {ranked('SELECT * FROM labels', 5)} UNION ALL {ranked('SELECT * FROM ips', 3)}
  UNION ALL {ranked("SELECT collection, log_type, 'finding' AS section, key AS item, n FROM found WHERE severity IN ('HIGH', 'CRITICAL', 'BRUTEFORCE', 'SUSPICIOUS')", 5)}) SELECT *, CASE log_type {' '.join(f"WHEN {q(t)} THEN {i}" for i, t in enumerate(IMPORTANCE))} ELSE {len(IMPORTANCE)} END AS log_rank FROM parts""",
    "severity_by_keyword": f"SELECT collection, CASE WHEN contains(lower(line), 'fault') THEN 'Medium' WHEN contains(lower(line), 'level=') THEN 'Low' WHEN contains(lower(line), 'emerg') THEN 'High' ELSE 'Info' END AS severity, count(*) AS n FROM ({duck('messages')}) GROUP BY ALL",
}
