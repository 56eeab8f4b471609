"""Column helpers: extraction, normalisation and display of log text. All native expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.timeparse import let

#: Stands between the groups of a matched line; and what starts its own spelling, and that of SIGN, in a line that has them.
SIGN, ESCAPE = "\x01", "\x02"
# Patterns.
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
IPV6_WHOLE = r"(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){0,6}:(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})"
IPV6 = r"\b(?:[A-Fa-f0-9]{1,4}:){1,7}[A-Fa-f0-9]{1,4}\b"
#: stamp, host, daemon, pid, message of a syslog line; anchored, so a clock's colon is no daemon.
HEADER = r"^(\d{4}-\d{2}-\d{2}T\S+|[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^\s:\[]+)(?:\[(\d+)\])?:\s*(.*)$"
REST = r"^(?:\d{4}-\d{2}-\d{2}T\S+|[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+\S+\s+(.*)$"
USER_EQUALS = r"(?i)\buser=([A-Za-z0-9._-]+)\b"
FOR_USER = r"(?i)\bfor user ([A-Za-z0-9._-]+)\b"
AUTH_USERS = [
    r"(?i)\b(?:Failed|Accepted)\s+password\s+for\s+(?:invalid\s+user\s+)?([A-Za-z0-9._-]+)\b",
    r"(?i)session\s+(?:opened|closed)\s+for\s+user\s+([A-Za-z0-9._-]+)",
    r"(?i):\s+([A-Za-z0-9._-]+)\s+:\s+TTY=",
    USER_EQUALS,
]


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; the empty string without one."""
    return F.regexp_extract(text, pattern, group)


def first_of(*columns: Column) -> Column:
    """The first that is not empty, else the empty string; each is worked out once at most."""
    return F.coalesce(*map(filled, columns), F.lit(""))


def filled(text: Column) -> Column:
    """The text, null if it is empty."""
    return let(text, lambda x: F.when(x != "", x))


def settled(
    rows: DataFrame, columns: Callable[[Column], dict[str, Column]], given: Column | None = None, keep: Column | None = None, steps: Sequence[dict[str, Column]] = ()
) -> DataFrame:
    """The columns that ``columns`` makes of the value of ``given``, beside those of ``rows`` that they do not replace,
    for rows where ``keep`` holds. Each is worked out once a row, whatever columns and filters use it later.

    They pass through an explode of an array of one. The optimizer copies a column of a projection into filters above
    it, which then run its patterns again (and those of the column's own inputs), but does not look through an explode.
    The filter before it, a function of the element, ends the code that Spark generates for a stage: a method of over
    8,000 bytes of code is not compiled by the JVM but walked through for each row, and one stage of all steps is longer.
    steps: columns that ``columns`` reads beside those of ``rows`` and the given one (given_), each step out of those before it; they end here.
    """
    df = rows if given is None else rows.withColumn("given_", given)
    for step in steps:
        df = df.withColumns(step)
    made = F.struct(*(c.alias(n) for n, c in columns(F.col("given_")).items()))
    df = df.withColumn("settled_", made if keep is None else F.when(keep, made))
    new = df.schema["settled_"].dataType.names
    rest = [c for c in rows.columns if c not in new]
    one = F.filter(F.array("settled_"), lambda row: row.isNotNull())
    return df.select(*rest, F.explode(one).alias("settled_")).select(*rest, "settled_.*")


def groups_of(line: Column, pattern: str, groups: tuple[int, ...]) -> Column:
    """The wanted groups of a pattern that begins at the line's start, after an empty first element, for part_of or
    nth_part to read; an array of one if the line does not match. One evaluation gives all groups: they are written out
    with a sign between them, which the line's own text cannot hold, as it is spelt otherwise there first, and spelt back
    as a group is read."""
    odd = line.contains(SIGN) | line.contains(ESCAPE)
    to = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    safe = F.when(odd, to(to(line, ESCAPE, ESCAPE + "b"), SIGN, ESCAPE + "a")).otherwise(line)
    return F.split(F.regexp_replace(safe, f"{pattern}(?s:.*)$", SIGN + SIGN.join(f"${k}" for k in groups)), SIGN)


def spelt_back(part: Column) -> Column:
    to = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    return F.when(part.contains(ESCAPE), to(to(part, ESCAPE + "a", SIGN), ESCAPE + "b", ESCAPE)).otherwise(part)


def nth_part(parts: Column, k: int) -> Column:
    """The k-th group out of groups_of, of a line that matched."""
    return spelt_back(F.get(parts, F.lit(k)))


def part_of(parts: Column, k: int, of: int, line: Column) -> Column:
    """The k-th of the ``of`` groups that groups_of gives; empty without a match, null for a null line, as extract has it."""
    return F.when(F.size(parts) == of + 1, nth_part(parts, k)).when(line.isNotNull(), F.lit(""))


def extract_ipv4(text: Column) -> Column:
    return extract(text, IPV4, 0)


def extract_ip(text: Column) -> Column:
    """The first IPv4 address, else the first IPv6 one: eight groups, or fewer about a double colon, so no time of day."""
    return first_of(extract_ipv4(text), extract(text, rf"(?<![\w:]){IPV6_WHOLE}(?![\w:])", 0))


def extract_host(text: Column) -> Column:
    return extract(text, HEADER, 2)


def extract_daemon(text: Column) -> Column:
    return extract(text, HEADER, 3)


def extract_user(text: Column) -> Column:
    return first_of(extract(text, USER_EQUALS), extract(text, FOR_USER), extract(text, AUTH_USERS[1]))


def extract_message(text: Column) -> Column:
    return message_of(text, extract(text, HEADER, 5))


def message_of(text: Column, message: Column) -> Column:
    """extract_message where the header's fifth group is at hand."""
    rest = extract(text, REST)
    return F.trim(F.coalesce(F.when(message != "", message), F.when(rest != "", rest), text))


def normalize_for_grouping(text: Column) -> Column:
    """Ten ordered replacements that leave the shape of a message."""
    for pattern, to in (
        (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", "TIMESTAMP"),
        (r"\b\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}", "TIMESTAMP"),
        (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "IP"),
        (r"\b(?:[A-Fa-f0-9]{1,4}:){1,7}[A-Fa-f0-9]{1,4}\b", "IP"),
        (r"(?i)\[?\bpid[=:]?\d+\]?", "PID"),
        (r"\[\d+\]", "PID"),
        (r"(?i)\b(?:uid|gid|auid)=\d+", "ID"),
        (r"0x[0-9a-fA-F]+", "HEX"),
        (r"\b\d+\b", "N"),
        (r"\s+", " "),
    ):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def normalize_audit(text: Column) -> Column:
    for name in ("pid", "uid", "gid", "auid", "ses"):
        text = F.regexp_replace(text, rf"\b{name}=\d+", f"{name}=X")
    for pattern, to in ((r"0x[0-9a-fA-F]+", "0xHEX"), (IPV4, "IP"), (r"\b\d{5,}\b", "N"), (r"\s{2,}", " ")):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def normalize_journal(text: Column) -> Column:
    for pattern, to in (
        (r"key=[a-zA-Z0-9_]+", "key=***"),
        (r"BECOME-SUCCESS-[a-zA-Z0-9_]+", "BECOME-SUCCESS-***"),
        (r"""ansible[/-]tmp[^\s\]"']*""", "ansible-tmp-***"),
        (r"AnsiballZ_\w+\.py", "AnsiballZ_***.py"),
        (r"\d{5,}", "***"),
    ):
        text = F.regexp_replace(text, pattern, to)
    return ellipsis(text, 160)


def mask_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\d+", "#")


def ellipsis(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 3), F.lit("..."))).otherwise(text)


def file_ext(path: Column) -> Column:
    """From the last dot on, lower-cased; empty without a dot."""
    return F.lower(extract(path, r"(\.[^.]*)$"))


def folder_of(path: Column) -> Column:
    folder = extract(path, r"^(.+)/[^/]*$")
    return F.when(folder == "", "/").otherwise(folder)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def redact_shadow(line: Column) -> Column:
    """A password hash field becomes stars."""
    return F.regexp_replace(line, r"^([^:]+:)[^:]*(:.*)$", "$1********$2")


def format_ts(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("N/A"))


def format_range(first: Column, last: Column, count: Column) -> Column:
    one = F.concat(format_ts(first), F.lit(" UTC"))
    many = F.concat(format_ts(first), F.lit(" → "), format_ts(last), F.lit(" UTC (x"), count.cast("string"), F.lit(")"))
    return F.when(count == 1, one).otherwise(many)


def format_duration(seconds: Column) -> Column:
    d, h, m, s = F.floor(seconds / 86400), F.floor(seconds / 3600) % 24, F.floor(seconds / 60) % 60, seconds % 60
    part = lambda v, unit, when: F.when(when, F.concat(v.cast("string"), F.lit(unit)))
    text = F.concat_ws(" ", part(d, "d", d > 0), part(h, "h", h > 0), part(m, "m", m > 0), part(s.cast("long"), "s", (s > 0) & (seconds < 3600)))
    return F.when(seconds < 1, "< 1 second").otherwise(text)


def epoch_to_utc(epoch: Column) -> Column:
    return F.when(epoch > 0, F.timestamp_seconds(epoch))


def short_proc(process: Column) -> Column:
    return F.when(process == "", "?").otherwise(process)


def local_port(address: Column) -> Column:
    return F.substring_index(address, ":", -1).try_cast("int")


def cron_command_of(line: Column) -> Column:
    """The command of a cron finding: after CMD ( ), CMD=, CMD:, else after the last colon."""
    tail = F.trim(F.substring_index(line, ":", -1))
    return first_of(
        F.trim(extract(line, r"(?i)\)\s*CMD\s*\((.+?)\)\s*$")),
        F.trim(extract(line, r"(?i)\bCMD\s*=\s*(.+?)\s*$")),
        F.trim(extract(line, r"(?i)\bCMD\s*:\s*(.+?)\s*$")),
        F.when(line.contains(":"), tail),
    )


def is_public_ip(ip: Column) -> Column:
    """Private, loopback and link-local IPv4 are not public; any address with a colon is."""
    part = lambda k: F.get(F.split(ip, r"\."), F.lit(k - 1)).try_cast("int")
    a, b, four = part(1), part(2), F.size(F.split(ip, r"\.")) == 4
    private = (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | (a == 127) | ((a == 169) & (b == 254))
    return F.when(four & a.isNotNull() & b.isNotNull(), ~private).otherwise(ip.contains(":"))


def is_public_peer(address: Column) -> Column:
    """The same for a socket's peer, without its port and zone."""
    bare = F.regexp_replace(F.regexp_replace(address, r"%[^:\]]*", ""), r":[^:]*$", "")
    bare = F.regexp_replace(bare, r"[\[\]]", "")
    return F.when(bare.isin("", "*", "0.0.0.0", "::", "::1"), F.lit(False)).otherwise(is_public_ip(bare))


def is_local_ip(ip: Column) -> Column:
    second = F.get(F.split(ip, r"\."), F.lit(1)).try_cast("int")
    return (
        ip.isin("", "N/A") | ip.startswith("127.") | ip.startswith("::1") | ip.startswith("10.") | ip.startswith("192.168.")
        | (ip.startswith("172.") & F.coalesce(second.between(16, 31), F.lit(False)))
    )
