"""Live-response dumps as fleet tables: sockets, processes, accounts, networks, persistence, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions import rules
from lumenlog.functions.text import IPV4, extract, is_public_peer, local_port
from lumenlog.operators.group import top_k

# Ports whose listeners are named, and states of a socket.
NOTABLE_PORTS = [22, 23, 80, 443, 445, 3389, 8000, 8080, 8443, 3333, 5555, 6666, 7777, 14444, 18080]
STATES = ["LISTEN", "ESTAB", "ESTABLISHED", "UNCONN", "CLOSE-WAIT", "TIME-WAIT"]


def parse_sockets(lines: DataFrame) -> DataFrame:
    """ss and netstat lines: proto, state, local, peer, process (name/pid), port."""
    tokens = F.split(F.trim("line"), r"\s+")
    addresses = F.filter(F.slice(tokens, 2, F.size(tokens)), lambda t: t.contains(":") & ~t.startswith("users:"))
    state = F.coalesce(F.try_element_at(F.filter(tokens, lambda t: t.isin(*STATES)), F.lit(1)), F.lit("UNKNOWN"))
    name, pid = extract(F.col("line"), r'users:\(\("([^"]+)",pid=(\d+)', 1), extract(F.col("line"), r'users:\(\("([^"]+)",pid=(\d+)', 2)
    tail = extract(F.col("line"), r"(\d+)/(\S+)\s*$", 0)
    process = F.when(name != "", F.concat_ws("/", name, pid)).when(tail != "", F.concat_ws("/", extract(tail, r"(\d+)/(\S+)", 2), extract(tail, r"(\d+)/(\S+)", 1))).otherwise("")
    rows = lines.where(F.lower("line").rlike("^(?:tcp|udp)"))
    rows = rows.select("collection", "seq", tokens.getItem(0).alias("proto"), state.alias("state"), addresses.alias("a"), process.alias("process"))
    at = lambda k: F.coalesce(F.try_element_at("a", F.lit(k)), F.lit(""))
    return rows.select("collection", "seq", "proto", "state", at(1).alias("local"), at(2).alias("peer"), "process", local_port(at(1)).alias("port"))


def listening_ports(sockets: DataFrame) -> DataFrame:
    listen = sockets.where(F.col("state").startswith("LISTEN"))
    return listen.groupBy("collection", "proto", "port").agg(F.count("*").alias("n"), F.coalesce(F.max("port").isin(*NOTABLE_PORTS), F.lit(False)).alias("notable"))


def listeners_shown(sockets: DataFrame, k: int = 10) -> DataFrame:
    """The first k listeners of a collection, by port and protocol."""
    listen = sockets.where(F.col("state").startswith("LISTEN"))
    return top_k(listen, ["collection"], [F.col("port").asc_nulls_last(), F.col("proto"), F.col("seq")], k).select("collection", "rank", "port", "proto", "local", "process")


def external_connections(sockets: DataFrame) -> DataFrame:
    rows = sockets.where(F.col("state").startswith("ESTAB") & is_public_peer(F.col("peer")))
    return rows.groupBy("collection", "peer", F.substring_index("process", "/", 1).alias("process")).agg(F.count("*").alias("n"))


def parse_ps(lines: DataFrame) -> DataFrame:
    """user, pid and the command from the 11th column on."""
    pattern = r"^\s*(\S+)\s+(\d+)\s+(?:\S+\s+){8}(.+)$"
    line = F.col("line")
    return lines.where(line.rlike(pattern)).select("collection", "seq", extract(line, pattern, 1).alias("user"), extract(line, pattern, 2).cast("long").alias("pid"), extract(line, pattern, 3).alias("command"))


def processes_by_user(processes: DataFrame) -> DataFrame:
    return processes.groupBy("collection", "user").agg(F.count("*").alias("n"))


def process_hits(processes: DataFrame) -> DataFrame:
    word = rules.first_match(F.col("command"), rules.PROCESS_KEYWORDS)
    core = F.col("command").rlike("systemd|sshd|cron")
    rows = processes.withColumns({"word": word, "core": core}).where("word is not null or core")
    return rows.select("collection", "seq", "user", "pid", "command", "word", "core")


def open_file_hits(lines: DataFrame) -> DataFrame:
    """(kind, line): lsof lines of deleted files and of sockets, a line may be both; pstree lines that name a shell."""
    line, lsof = F.col("line"), F.col("artifact") == "lsof"
    shell = (F.col("artifact") == "pstree") & F.lower(line).rlike("bash|sh|zsh|dash|ksh|python|perl|php|ruby")
    kinds = F.array_compact(F.array(F.when(lsof & line.contains("(deleted)"), "deleted"), F.when(lsof & (line.contains("TCP") | line.contains("UDP")), "socket"), F.when(shell, "shell")))
    return lines.select("collection", "seq", F.explode(kinds).alias("kind"), F.trim("line").alias("line"))


def accounts(lines: DataFrame) -> DataFrame:
    """(kind, name): account, locked, sudoer, login. lines: artifact passwd, shadow, sudoers, lastlog."""
    line, what = F.col("line"), F.col("artifact")
    note = F.ltrim("line").startswith("#")
    kind = (
        F.when((what == "passwd") & ~note & line.contains(":"), "account").when((what == "shadow") & line.rlike(r"!\*|!!"), "locked")
        .when((what == "sudoers") & ~note & line.contains("ALL"), "sudoer").when((what == "lastlog") & line.rlike("pts/|tty|ssh"), "login")
    )
    name = F.when(what.isin("passwd", "shadow"), F.substring_index(line, ":", 1)).otherwise(extract(line, r"^\s*(\S+)"))
    return lines.select("collection", "seq", kind.alias("kind"), name.alias("name")).where("kind is not null")


# Patterns of interface headers (ip, ifconfig, older ifconfig), of addresses, and of what is no address of the interface.
HEADERS = [r"^\d+:\s*([A-Za-z0-9._-]+)[:@]", r"^([A-Za-z0-9._-]+): flags=", r"^([A-Za-z0-9._-]+)\s+Link encap:"]
ADDRESS6 = r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}"
MASKS = r"(?i)\b(?:netmask|mask:|brd|broadcast|bcast:)\s*\S+"


def net_config(lines: DataFrame) -> DataFrame:
    """(kind, name, value): addresses by the interface above them, default routes, resolvers, search domains, host overrides, firewall lines.

    A row per address: every IPv4 and IPv6 address of an inet or inet6 line but masks and broadcast addresses. The
    interface is the last header above in the line's file, by file_path if there is one; a file is one dump.
    """
    line, what = F.col("line"), F.col("artifact")
    interface = F.when(what == "ip", F.coalesce(*[F.nullif(extract(line, p), F.lit("")) for p in HEADERS]))
    # Only lines of interface dumps are put in order; any other line is a group of its own.
    file = [F.col("file_path")] if "file_path" in lines.columns else []
    order = Window.partitionBy("collection", *file, F.when(what != "ip", F.col("seq"))).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("interface", F.coalesce(F.last(interface, True).over(order), F.lit("unknown")))
    own = F.regexp_replace(line, MASKS, " ")
    every = F.concat(F.regexp_extract_all(own, F.lit(IPV4), F.lit(0)), F.regexp_extract_all(own, F.lit(ADDRESS6), F.lit(0)))
    inet = (what == "ip") & line.rlike(r"\binet6?\b")
    rows = rows.withColumn("address", F.explode(F.when(inet, every).otherwise(F.array(F.lit("")))))
    low, found = F.lower(F.ltrim("line")), extract(line, IPV4, 0)
    kind = (
        F.when(F.col("address") != "", "address").when((what == "route") & line.rlike(r"default |0\.0\.0\.0"), "default_route")
        .when((what == "resolv") & low.startswith("nameserver"), "resolver").when((what == "resolv") & low.startswith("search"), "search")
        .when((what == "hosts") & ~low.startswith("#") & (found != ""), "host")
        .when((what == "firewall") & line.startswith(":"), "chain").when((what == "firewall") & line.startswith("-A"), "rule").when((what == "firewall") & line.startswith("*"), "table")
    )
    value = F.when(kind == "address", F.col("address")).when(kind == "resolver", found).when(kind == "search", F.trim(F.substring(F.ltrim("line"), 7, 1 << 30))).otherwise(F.trim("line"))
    public = F.coalesce((kind == "resolver") & found.isin(*rules.PUBLIC_RESOLVERS), F.lit(False))
    return rows.select("collection", "seq", kind.alias("kind"), F.when(kind == "address", F.col("interface")).otherwise("").alias("name"), value.alias("value"), public.alias("public")).where("kind is not null")


def persistence_hits(lines: DataFrame) -> DataFrame:
    line, what = F.col("line"), F.col("artifact")
    unit = line.contains("WantedBy=") | (line.contains(".service") & line.rlike("/tmp/|/dev/shm/|/var/tmp/"))
    live = ~F.ltrim("line").startswith("#")
    kind = (
        F.when((what == "systemd") & unit, "unit").when((what == "crontab") & live & line.rlike("wget |curl |bash -c|python "), "cron")
        .when((what == "rc_local") & live & line.rlike("bash |sh |python |nohup "), "rc.local").when((what == "bashrc") & live & line.startswith("export "), "export")
    )
    return lines.select("collection", "seq", kind.alias("kind"), "line").where("kind is not null")


def is_suspicious_temp(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike("/tmp|/var/tmp|/dev/shm|/home") & (low.rlike(r"\.(?:sh|py|elf)$") | low.rlike("minerd|backdoor|revsh"))


def suspicious_temp_files(files: DataFrame) -> DataFrame:
    return files.where(is_suspicious_temp(F.col("line"))).select("collection", "seq", F.col("line").alias("path"))


def recent_files_shown(files: DataFrame, k: int = 10) -> DataFrame:
    """The last k lines of a collection's list of recent files, in the order of their text."""
    recent = files.where((F.col("artifact") == "recent") & (F.trim("line") != ""))
    return top_k(recent, ["collection"], [F.col("line").desc(), F.col("seq")], k).select("collection", "rank", "line")


def distinct_values(net: DataFrame, account_rows: DataFrame) -> DataFrame:
    """Each resolver, search domain, host override and sudoer of a collection once: (kind, value)."""
    known = net.where("kind in ('resolver', 'search', 'host')").select("collection", "kind", "value")
    return known.unionByName(account_rows.where("kind = 'sudoer'").select("collection", "kind", F.col("name").alias("value"))).distinct()


def fleet_counts(files: DataFrame, account_rows: DataFrame, sockets: DataFrame, net: DataFrame, persistence: DataFrame) -> DataFrame:
    """One row per collection and measure."""
    named = lambda df, what: df.select("collection", what.alias("measure"))
    rows = [
        named(files.where("artifact in ('suid', 'world_writable')"), F.col("artifact")),
        named(account_rows.where("kind <> 'login'"), F.col("kind")),
        named(sockets.where("state like 'LISTEN%' or state like 'ESTAB%'"), F.when(F.col("state").startswith("LISTEN"), "listener").otherwise("established")),
        named(net.where("kind in ('chain', 'rule', 'table')"), F.col("kind")),
        named(persistence.where("artifact = 'systemd' or (artifact = 'crontab' and ltrim(line) not like '#%')"), F.when(F.col("artifact") == "systemd", "unit").otherwise("cron_entry")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("collection", "measure").agg(F.count("*").alias("n"))
