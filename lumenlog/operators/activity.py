"""User and web activity: access logs, shell histories, containers, analyst keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions import rules
from lumenlog.functions.text import ellipsis, extract, groups_of, nth_part, part_of, settled
from lumenlog.functions.timeparse import apache_ts_of, ts_of, ts_steps
from lumenlog.operators.group import carried

COMBINED = r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)(?:\s+([^"]+))?"\s+(\d{3})\s+(\d+|-)\s+"([^"]*)"\s+"([^"]*)"'
#: Options that take an argument, other options, then [user@]host.
SSH = r"(?i)ssh\s+(?:-[bcDEFIiJLlmOopQRSWw]\s+\S+\s+|-\S+\s+)*(?:([A-Za-z0-9._-]+)@)?([A-Za-z0-9.-]+)"


def web_daemon(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.contains("nginx"), "nginx").when(low.contains("apache") | low.contains("httpd"), "apache2").otherwise("web")


def parse_web(lines: DataFrame) -> DataFrame:
    """Combined log format; other lines stay with their raw text as message and no request.

    A line is matched once, however many columns and filters use its groups.
    """
    line, mtime = F.col("line"), F.col("file_mtime")
    parts = F.when(line.startswith('"') | ~line.contains('"'), F.array(line)).otherwise(groups_of(line, COMBINED, (1, 2, 3, 4, 6, 7, 9)))
    steps = [{"between_": part_of(F.col("given_"), 2, 7, line)}, *ts_steps(line, mtime)]
    ts = F.coalesce(apache_ts_of(F.col("between_")), ts_of(line, mtime))
    rows = settled(lines, lambda parts: {"line": line, "ts": ts, "parts": parts}, parts, F.trim("line") != "", steps)
    found = F.size("parts") == 8
    part = lambda k: F.when(found, nth_part(F.col("parts"), k)).otherwise("")
    request = F.concat(part(3), F.lit(" "), part(4), F.lit(" -> "), part(5), F.lit(" "), part(6), F.lit("B"))
    return rows.select(
        "collection", "seq", "line", "ts", part(1).alias("ip"), part(3).alias("method"), part(4).alias("uri"), part(5).alias("status"),
        part(6).alias("size"), part(7).alias("agent"), F.when(found, request).otherwise(line).alias("message"), *carried(lines),
    )


def classify_web(parsed: DataFrame) -> DataFrame:
    """attack: the first attack substring of the address; tier Critical with one, Noise for addresses that scanners always ask."""
    rows = settled(parsed, lambda _: {"attack": rules.first_word(F.col("low"), rules.URI_ATTACKS)}, steps=[{"low": F.lower("uri")}])
    tier = F.when(F.col("attack").isNotNull(), "Critical").when(rules.contains_any(F.col("uri"), rules.URI_NOISE), "Noise").otherwise("Info")
    return rows.withColumns({"tier": tier, "label": F.col("attack"), "severity": F.when(F.col("attack").isNotNull(), "High").otherwise("Info")})


def web_attack_findings(classified: DataFrame) -> DataFrame:
    return classified.where("attack is not null").groupBy("collection", "attack").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("ip", "seq").alias("ip"), F.min_by(ellipsis(F.col("uri"), 80), "seq").alias("uri")
    )


def web_bruteforce(parsed: DataFrame, per_minute: int) -> DataFrame:
    """Sources with over ``per_minute`` requests in some minute: peak, its minute, all requests, first, last."""
    minute = parsed.where("method <> '' and ts is not null").groupBy("collection", "ip", F.window("ts", "1 minute").start.alias("minute"))
    minutes = minute.agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    by_ip = minutes.groupBy("collection", "ip").agg(
        F.max("n").alias("peak"), F.max_by("minute", F.struct("n", -F.unix_timestamp("minute"))).alias("minute"), F.sum("n").alias("requests"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
    )
    return by_ip.where(F.col("peak") > per_minute)


def history_commands(lines: DataFrame, gap_hours: int = 12) -> DataFrame:
    """Commands with the stamp of the line before them, and the whole hours since the command before if both are stamped and over the gap."""
    stamp = extract(F.col("line"), r"^#(\d{10,})$").try_cast("long")
    order = Window.partitionBy("collection", "username").orderBy("seq")
    rows = lines.where(F.trim("line") != "").withColumn("epoch", stamp)
    rows = rows.withColumn("ts", F.timestamp_seconds(F.lag("epoch").over(order))).where(F.col("epoch").isNull())
    hours = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(order))) / 3600)
    over = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(order)) > gap_hours * 3600
    return rows.withColumn("gap_hours", F.when(over, hours)).select("collection", "username", "seq", F.trim("line").alias("command"), "ts", "gap_hours", *carried(lines))


def classify_shell(commands: DataFrame) -> DataFrame:
    cmd = F.lower("command")
    listed = rules.starts_with_any(F.col("command"), [w for w in rules.SHELL_WHITELIST if w != "cat "]) | cmd.isin(*[w.rstrip().lower() for w in rules.SHELL_WHITELIST])
    white = F.when(cmd.startswith("cat "), ~rules.contains_any(cmd, rules.CAT_EXCEPTIONS)).otherwise(listed)
    tier = F.when(white, "Info").when(rules.contains_any(cmd, rules.SHELL_CRITICAL), "Critical").when(rules.contains_any(cmd, rules.SHELL_SUSPICIOUS), "Suspicious").otherwise("Info")
    label = F.when(F.col("tier") == "Critical", "Critical shell command").when(F.col("tier") == "Suspicious", "Suspicious shell command")
    anti = rules.contains_any(cmd, rules.ANTI_FORENSICS) | (cmd.contains("shred") & cmd.contains("log"))
    severity = F.when(F.col("tier") == "Critical", "High").when(F.col("tier") == "Suspicious", "Medium").otherwise("Info")
    return commands.withColumn("tier", tier).withColumns({"label": label, "severity": severity, "anti_forensics": anti})


def anti_forensics_by_user(classified: DataFrame) -> DataFrame:
    return classified.where("anti_forensics and tier <> 'Info'").groupBy("collection", "username").agg(F.count("*").alias("n"))


def lateral_movement(commands: DataFrame) -> DataFrame:
    """Edges user -> target of ssh commands, whatever their tier."""
    cmd = F.col("command")
    rows = commands.where(F.lower(cmd).startswith("ssh ") & cmd.rlike(SSH)).select("collection", "username", "ts", extract(cmd, SSH, 1).alias("as_user"), extract(cmd, SSH, 2).alias("target"))
    return rows.groupBy("collection", "username", "as_user", "target").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


CONTAINER = (
    "Name string, Created string, State struct<Status:string>, Config struct<Image:string,Cmd:array<string>,Entrypoint:array<string>,User:string>, "
    "HostConfig struct<Privileged:boolean,NetworkMode:string,PidMode:string,CapAdd:array<string>,Binds:array<string>>"
)


def containers(lines: DataFrame) -> DataFrame:
    """One row per container configuration; text that is no configuration is dropped."""
    j = F.from_json("line", CONTAINER)
    rows = lines.withColumn("j", j).where("j.Name is not null")
    none = F.array().cast("array<string>")
    command = F.trim(F.concat_ws(" ", F.array_join(F.coalesce("j.Config.Entrypoint", none), " "), F.array_join(F.coalesce("j.Config.Cmd", none), " ")))
    caps = F.filter(F.array(*map(F.lit, rules.CONTAINER_CAPS)), lambda c: F.exists(F.coalesce("j.HostConfig.CapAdd", none), lambda h: F.upper(h).contains(c)))
    host = lambda b: F.substring_index(b, ":", 1)
    under = lambda b: F.exists(F.array(*map(F.lit, rules.CONTAINER_MOUNTS)), lambda m: (host(b) == m) | host(b).startswith(F.concat(m, F.lit("/"))))
    binds = F.filter(F.coalesce("j.HostConfig.Binds", none), lambda b: (host(b) == "/") | b.contains("docker.sock") | under(b))
    words = F.filter(F.array(*map(F.lit, rules.CONTAINER_EXEC)), lambda w: F.lower(command).contains(F.lower(w)))
    user = F.coalesce("j.Config.User", F.lit("0"))
    return rows.select(
        "collection", "container_id", F.ltrim("j.Name", F.lit("/")).alias("name"), F.col("j.Config.Image").alias("image"), F.col("j.State.Status").alias("status"), F.col("j.Created").alias("created"),
        command.alias("command"), F.coalesce("j.HostConfig.Privileged", F.lit(False)).alias("privileged"), (F.lower(F.coalesce("j.HostConfig.NetworkMode", F.lit(""))) == "host").alias("host_network"),
        (F.lower(F.coalesce("j.HostConfig.PidMode", F.lit(""))) == "host").alias("host_pid"), user.isin("", "0", "root").alias("root"), caps.alias("capabilities"), binds.alias("mounts"), words.alias("suspicious"),
    )


def container_risk(inventory: DataFrame) -> DataFrame:
    """Findings (severity, label) of each container; several may hold."""
    mounts, caps = F.size("mounts") > 0, F.size("capabilities") > 0
    trapped, socket = F.col("privileged") & mounts, F.exists("mounts", lambda m: F.lower(m).contains("docker.sock"))
    plain = ~trapped & ~socket
    found = [
        (trapped, "CRITICAL", "Privileged + host mount (escape risk)"), (~trapped & socket, "CRITICAL", "Docker socket mount"), (plain & F.col("privileged"), "HIGH", "Privileged container"),
        (plain & F.col("host_network"), "HIGH", "Host network mode"), (plain & caps, "HIGH", "Dangerous capabilities"), (plain & mounts, "HIGH", "Dangerous host mount"),
        (plain & F.col("host_pid"), "HIGH", "Host PID namespace"), (F.size("suspicious") > 0, "MEDIUM", "Suspicious container command"), (F.col("root") & ~F.col("privileged"), "MEDIUM", "Container running as root"),
    ]
    each = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(s).alias("severity"), F.lit(label).alias("label"))) for test, s, label in found]))
    return inventory.select("collection", "container_id", "name", "image", F.explode(each).alias("f")).select("collection", "container_id", "name", "image", "f.*")


def container_severity(inventory: DataFrame) -> DataFrame:
    mounts, caps = F.size("mounts") > 0, F.size("capabilities") > 0
    grade = (
        F.when(F.col("privileged") & mounts, "Critical").when(F.col("privileged") | F.col("host_network") | caps, "High").when((F.size("suspicious") > 0) | F.col("root"), "Medium").otherwise("Info")
    )
    return inventory.withColumn("severity", grade)


def container_events(inventory: DataFrame) -> DataFrame:
    """Containers as events, at the time of their creation: ts, message, raw, severity."""
    note = lambda test, text: F.when(test, text).otherwise("")
    message = F.concat(
        F.lit("Container="), F.coalesce("name", F.lit("")), F.lit(" Image="), F.coalesce("image", F.lit("")), F.lit(" State="), F.coalesce("status", F.lit("")), note(F.col("privileged"), " [PRIVILEGED]"),
        note(F.col("host_network"), " [HOST_NETWORK]"), note(F.col("host_pid"), " [HOST_PID]"), note(F.size("mounts") > 0, F.concat(F.lit(" [MOUNTS:"), F.array_join("mounts", ";"), F.lit("]"))),
    )
    raw = F.concat(F.lit("ID="), "container_id", F.lit(" Name="), F.coalesce("name", F.lit("")), F.lit(" Image="), F.coalesce("image", F.lit("")))
    return container_severity(inventory).withColumns({"ts": F.col("created").try_cast("timestamp"), "message": message, "raw": raw})


def container_log_hits(logs: DataFrame, inventory: DataFrame) -> DataFrame:
    """Log lines that hold a suspicious word, under the container's name or else its id's first 12 characters."""
    word = rules.first_match(F.col("line"), rules.CONTAINER_EXEC)
    names = inventory.select("collection", "container_id", "name")
    hits = logs.withColumn("word", word).where("word is not null").join(names, ["collection", "container_id"], "left")
    return hits.select("collection", "seq", "word", F.coalesce("name", F.substring("container_id", 1, 12)).alias("name"), ellipsis(F.col("line"), 120).alias("line"))


def docker_event_ts() -> Column:
    return F.timestamp_seconds(extract(F.col("line"), r'"time"\s*:\s*(\d+)').try_cast("long"))


def docker_hits_of_line() -> list[tuple[Column, str, str]]:
    """(test, severity, label) of what may be found in a line of a daemon log or event file, told by ``artifact`` (daemon, events)."""
    line, daemon = F.lower("line"), F.col("artifact") == "daemon"
    return [
        (~daemon & (line.contains('"privileged":true') | line.contains("--privileged")), "MEDIUM", "Privileged event"),
        (daemon & line.contains("--privileged"), "HIGH", "Privileged launch (daemon log)"),
        (daemon & line.rlike(r"mount.*(?:host|/proc|/dev|docker\.sock)"), "HIGH", "Suspicious mount (daemon log)"),
    ]


def docker_event_hits(lines: DataFrame) -> DataFrame:
    """Hits (severity, label) of daemon logs and event files.

    Daemon log: privileged launches and mounts of host paths, HIGH each. Events: privileged containers, MEDIUM.
    """
    each = F.array(*[F.when(test, F.struct(F.lit(s).alias("severity"), F.lit(label).alias("label"))) for test, s, label in docker_hits_of_line()])
    return lines.select("collection", "seq", docker_event_ts().alias("ts"), F.explode(each).alias("f")).where("f is not null").select("collection", "seq", "ts", "f.*")


def rank_keyword_hits(texts: DataFrame, rank1: list[str], rank2: list[str], whitelist: list[str]) -> DataFrame:
    """texts: (source, id, text). Rows that hold an analyst's term, the higher rank first; whitelisted rows are let off."""
    text = F.col("text")
    first, second = rules.first_match(text, rank1), rules.first_match(text, rank2)
    hits = texts.withColumns({"keyword": F.coalesce(first, second), "severity": F.when(first.isNotNull(), "HIGH").otherwise("MEDIUM")})
    return hits.where(F.col("keyword").isNotNull() & ~rules.contains_any(text, whitelist)).select("source", "id", "keyword", "severity")
