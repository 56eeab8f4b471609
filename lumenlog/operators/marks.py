"""Reports in one pass: each parsed line gives marks, all marks of a log are summed up together, and every report reads the sums.

A mark is (kind, severity, item, ip, user, example): kind file (a row of a file), label, ip or finding; and, of logins
alone, brute, failed and accepted, which become findings by their numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions import rules
from lumenlog.functions.text import ellipsis, settled
from lumenlog.functions.timeparse import valid_ts
from lumenlog.operators import auth, system
from lumenlog.operators.report import is_high, is_suspicious, log_rank

FIELDS = ("kind", "severity", "item", "ip", "user", "example")


def mark(kind: Column | str, item: Column | str, severity: Column | str | None = None, **more: Column) -> Column:
    given = {"kind": F.lit(kind) if isinstance(kind, str) else kind, "item": F.col(item) if isinstance(item, str) else item, "severity": F.lit(severity) if severity is None or isinstance(severity, str) else severity, **more}
    return F.struct(*(given.get(f, F.lit(None)).cast("string").alias(f) for f in FIELDS))


def marks(*each: tuple[Column, Column]) -> Column:
    """An array of the marks, null where the test does not hold; tally leaves those out. (Cut out here, by a function of
    the element, they would keep Spark from compiling the marks.)"""
    return F.array(*(F.when(test, m) for test, m in each))


@dataclass(frozen=True)
class Staged:
    """Marks that read columns worked out first, as each is used several times."""

    columns: dict[str, Column]
    marks: Column


def tally(rows: DataFrame, log_type: str, found: Column | Staged | None, as_of: Column, files: bool = True, ts: str = "ts", last: str | None = None) -> DataFrame:
    """(collection, log_type, kind, severity, item, ip, user, n, first_ts, last_ts, example) of one log's rows.

    files: each row is a mark of its file too, with the valid times alone. Marks are summed in each task first, so what
    is shuffled are the sums; the example is that of the first row in order.
    """
    if isinstance(found, Staged):
        rows, found = settled(rows, lambda _: found.columns), found.marks
    have = rows.columns
    own = [mark("file", "file_path" if "file_path" in have else F.lit(""))] if files else []
    every = own[0] if found is None else F.explode(F.concat(F.array(*own), found) if own else found)
    at, to = F.col(ts), F.col(last or ts)
    seq = F.col("seq") if "seq" in have else F.lit(0)
    lean = rows.select("collection", at.alias("ts"), to.alias("last"), seq.alias("seq"), every.alias("m")).where("m is not null").select("collection", "ts", "last", "seq", "m.*")
    time = lambda c: F.when((F.col("kind") != "file") | valid_ts(F.col(c), as_of), F.col(c))
    sums = lean.groupBy("collection", *FIELDS[:-1]).agg(
        F.count("*").alias("n"), F.min(time("ts")).alias("first_ts"), F.max(time("last")).alias("last_ts"), F.min_by("example", "seq").alias("example")
    )
    return sums.select("collection", F.lit(log_type).alias("log_type"), *FIELDS[:-1], "n", "first_ts", "last_ts", F.coalesce("example", "item").alias("example"))


def auth_marks() -> Staged:

    def of(name: str) -> list[tuple[Column, Column]]:
        a = F.col(name)
        who, address, command = a["who"], a["address"], a["command"]
        found = [(a.isNotNull(), mark("label", a["label"]))]
        if name in ("failed", "accepted"):
            pair = F.concat(address, F.lit(" user="), who) if name == "failed" else F.concat(who, F.lit(" from "), address)
            found += [(address != "", mark("ip", address)), (a.isNotNull(), mark(name, pair, "MEDIUM", ip=address, user=who))]
        if name == "failed":
            found.append((a.isNotNull(), mark("brute", address, "BRUTEFORCE", example=F.concat(F.lit("failed logins from "), address))))
        if name == "sudo":
            high = rules.contains_any(command, rules.SUDO_HIGH) & ~rules.contains_any(command, rules.AUTOMATION)
            found.append((high, mark("finding", F.concat(who, F.lit(" ran: "), ellipsis(command, 200)), "HIGH")))
        return found

    actions = auth.actions_of_line()
    return Staged(actions, marks(*(m for name in actions for m in of(name))))


def settled_logins(sums: DataFrame, threshold: int, accepted: int = 20, failed: int = 10) -> DataFrame:
    """Logins' marks as findings: sources of ``threshold`` failures, and the logins that count most."""
    kind = F.col("kind")
    login = kind.isin("failed", "accepted")
    other = F.when(~login, F.struct("severity", "item"))  # all that is not ranked is a group of its own
    rank = F.row_number().over(Window.partitionBy("collection", "kind", other).orderBy(F.desc("n"), "ip", "user"))
    rows = sums.withColumn("rank", rank)
    stays = F.when(kind == "brute", F.col("n") >= threshold).when(login, F.col("rank") <= F.when(kind == "accepted", accepted).otherwise(failed)).otherwise(True)
    return rows.where(stays).withColumn("kind", F.when(login | (kind == "brute"), "finding").otherwise(kind)).drop("rank")


def plain_marks(group: tuple[Column, Column]) -> Column:
    key, example = group
    return marks((F.col("label").isNotNull(), mark("label", "label")), (F.col("tier") == "Critical", mark("finding", key, "HIGH", example=example)))


def web_marks() -> Column:
    hit = F.col("attack").isNotNull()
    return marks((hit, mark("label", "attack")), (hit, mark("ip", "ip")), (hit, mark("finding", "attack", "HIGH", example=ellipsis(F.col("uri"), 80))))


def tier_severity() -> Column:
    return F.when(F.col("tier") == "Critical", "HIGH").otherwise("SUSPICIOUS")


def crontab_marks() -> Column:
    return marks((F.col("label").isNotNull(), mark("label", "label")), (F.col("tier") != "Info", mark("finding", "command", tier_severity())))


def shell_marks() -> Column:
    hit = F.col("tier") != "Info"
    return marks(
        (F.col("label").isNotNull(), mark("label", "label")), (hit, mark("finding", F.concat("username", F.lit(": "), "command"), tier_severity())),
        (hit & F.col("anti_forensics"), mark("finding", F.concat(F.lit("anti-forensics by "), "username"), "HIGH")),
    )


#: Marks of the logs whose classified rows are one table; the others are told by the reports' caller.
OF_LOG: dict[str, Callable[[], Column]] = {
    "SYSLOG": lambda: plain_marks(system.syslog_group()), "MESSAGES": lambda: plain_marks(system.messages_group()), "AUDIT": lambda: plain_marks(system.audit_group()),
    "JOURNAL": lambda: plain_marks((F.col("signature"), F.col("message"))), "WEB": web_marks, "CRONTAB": crontab_marks, "BASH": shell_marks,
}


def findings(sums: DataFrame) -> DataFrame:
    """(collection, log_type, severity, key, n, first_ts, last_ts, example)."""
    return sums.where("kind = 'finding'").select("collection", "log_type", "severity", F.col("item").alias("key"), "n", "first_ts", "last_ts", "example")


def coverage(sums: DataFrame) -> DataFrame:
    """Rows, first and last valid time of each log type."""
    rows = sums.where("kind = 'file'").groupBy("collection", "log_type")
    return rows.agg(F.sum("n").alias("rows"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def coverage_levels(sums: DataFrame) -> DataFrame:
    """The same per file, per log type and per collection at once, with the number of files; what is summed over is empty."""
    rows = sums.where("kind = 'file'").withColumnRenamed("item", "file_path")
    sets = rows.groupingSets([["collection", "log_type", "file_path"], ["collection", "log_type"], ["collection"]], "collection", "log_type", "file_path")
    out = sets.agg(
        F.grouping_id("collection", "log_type", "file_path").alias("g"), F.count("*").alias("files"), F.sum("n").alias("rows"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
    )
    level = F.when(F.col("g") == 0, "file").when(F.col("g") == 1, "log_type").otherwise("collection")
    blank = {c: F.coalesce(c, F.lit("")) for c in ("log_type", "file_path")}
    return out.withColumns({"level": level, **blank}).drop("g")


def per_log_status(sums: DataFrame) -> DataFrame:
    """Files, suspicious findings, and clean or how many are suspicious, for each log type that has rows."""
    hit = (F.col("kind") == "finding") & is_suspicious(F.col("severity"))
    rows = sums.groupBy("collection", "log_type").agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(hit).alias("suspicious")).where("files > 0")
    return rows.withColumn("status", F.when(F.col("suspicious") == 0, "clean").otherwise(F.concat(F.col("suspicious").cast("string"), F.lit(" suspicious"))))


def global_summary(sums: DataFrame) -> DataFrame:
    """Rows of a report: (section, item, n, rank) per collection and log type, in one window over the sums.

    Sections: files and rows; the five patterns, three sources and five HIGH findings that count most; how many
    findings are suspicious, and how many more HIGH ones there are than shown (both only where there are any).
    """
    kind = F.col("kind")
    section = F.when(kind == "file", "rows").when(kind == "label", "pattern").when(kind == "ip", "ip").when(is_suspicious(F.col("severity")), "finding")
    rows = sums.withColumn("section", section).where("section is not null").withColumn("high", F.coalesce((kind == "finding") & is_high(F.col("severity")), F.lit(False)))
    group = Window.partitionBy("collection", "log_type", "section")
    ranked = rows.withColumns({
        "rank": F.row_number().over(group.orderBy(F.desc("high"), F.desc("n"), "item", "severity")), "groups": F.count("*").over(group), "total": F.sum("n").over(group), "highs": F.count_if("high").over(group),
    })
    most = F.when(F.col("section") == "ip", 3).otherwise(5)
    out = lambda name, item, n, rank: F.struct(F.lit(name).alias("section") if isinstance(name, str) else name.alias("section"), item.alias("item"), n.cast("long").alias("n"), rank.cast("int").alias("rank"))
    once = lambda test, name, n: F.when((F.col("rank") == 1) & test, out(name, F.lit(""), n, F.lit(1)))
    file, finding = F.col("section") == "rows", F.col("section") == "finding"
    shown = F.array_compact(F.array(
        once(file, "rows", F.col("total")), once(file, "files", F.col("groups")), once(finding, "suspicious", F.col("groups")), once(finding & (F.col("highs") > 5), "more", F.col("highs") - 5),
        F.when(~file & (F.col("rank") <= most) & (~finding | F.col("high")), out(F.col("section"), F.col("item"), F.col("n"), F.col("rank"))),
    ))
    return ranked.select("collection", "log_type", F.explode(shown).alias("s")).select("collection", "log_type", "s.*", log_rank(F.col("log_type")).alias("log_rank"))
