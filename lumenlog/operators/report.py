"""What several log types add up to: findings, coverage, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.text import ellipsis, format_range

# Log types in the order of a report.
IMPORTANCE = ["JOURNAL", "AUTH", "SECURE", "AUDIT", "WEB", "DOCKER", "SYSLOG", "MESSAGES", "CRONTAB", "BASH"]
HIGH, SUSPICIOUS = ["HIGH", "CRITICAL", "BRUTEFORCE", "SUSPICIOUS"], ["HIGH", "CRITICAL", "BRUTEFORCE", "SUSPICIOUS", "MEDIUM", "ERROR"]


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def normalise(events: DataFrame, log_type: str, **columns: Column) -> DataFrame:
    """The nine columns of a normalised event, and the collection. Absent ones are empty strings."""
    have = lambda c: columns.get(c, F.col(c) if c in events.columns else F.lit(""))
    raw = columns.get("raw", F.col("line") if "line" in events.columns else F.lit(""))
    rest = [F.coalesce(have(c).cast("string"), F.lit("")).alias(c) for c in ("host", "daemon", "user", "ip", "message", "severity")]
    return events.select("collection", "ts", F.lit(log_type).alias("log_type"), *rest, raw.alias("raw"))


def with_text(found: DataFrame) -> DataFrame:
    """Findings with their line of a report: log type, severity, times and number, example."""
    text = F.concat(
        F.lit("["), "log_type", F.lit("] ["), "severity", F.lit("] ["), format_range(F.col("first_ts"), F.col("last_ts"), F.col("n")), F.lit("] "), ellipsis(F.col("example"), 160)
    )
    return found.withColumn("text", text)


def findings(grouped: DataFrame, log_type: str, severity: str | Column, key: str) -> DataFrame:
    """Grouped events as findings: key, example, text for display."""
    grade = F.lit(severity) if isinstance(severity, str) else severity
    return with_text(grouped.select("collection", F.lit(log_type).alias("log_type"), grade.alias("severity"), F.col(key).alias("key"), "n", "first_ts", "last_ts", "example"))


def is_high(severity: Column) -> Column:
    return F.upper(severity).isin(*HIGH)


def is_suspicious(severity: Column) -> Column:
    return F.upper(severity).isin(*SUSPICIOUS)


def log_rank(log_type: Column) -> Column:
    return F.coalesce(*[F.when(log_type == t, F.lit(i)) for i, t in enumerate(IMPORTANCE)], F.lit(len(IMPORTANCE)))
