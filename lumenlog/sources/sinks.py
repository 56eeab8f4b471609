"""Result tables. Each is overwritten by partition, so a run can be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.text import ellipsis, normalize_audit
from lumenlog.operators.report import log_rank


def write(df: DataFrame, path: str, by: list[str], kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(kind)
    (writer.option("header", "true").option("escape", '"') if kind == "csv" else writer).save(path)


def write_events_norm(events: DataFrame, path: str, kind: str = "parquet") -> None:
    """Normalised events by collection and log type; in CSV the time is ISO 8601 with milliseconds."""
    stamped = events.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")) if kind == "csv" else events
    write(stamped, path, ["collection", "log_type"], kind)


def write_sessions_full(sessions: DataFrame, path: str) -> None:
    write(sessions, path, ["collection"])


def write_sessions_grouped(grouped: DataFrame, path: str) -> None:
    write(grouped, path, ["collection"])


def write_sha1_candidates(candidates: DataFrame, path: str) -> None:
    write(candidates.select("collection", "score", "hash", "path", "reasons", "severity"), path, ["collection"])


def write_bodyfile_timeline(timeline: DataFrame, path: str) -> None:
    write(timeline, path, ["collection"])


def write_containers(inventory: DataFrame, path: str, kind: str = "parquet") -> None:
    lists = {c: F.array_join(c, "; ") for c in ("capabilities", "mounts", "suspicious")}
    write(inventory.withColumns(lists) if kind == "csv" else inventory, path, ["collection"], kind)


def write_audit_parsed(classified: DataFrame, path: str) -> None:
    rows = classified.select(
        "collection", F.col("ts").alias("timestamp_utc"), F.col("type").alias("event_type"), "tier", (F.col("tier") == "Critical").alias("is_suspicious"),
        normalize_audit(F.col("message")).alias("normalized_message"), ellipsis(F.col("line"), 300).alias("raw_message"),
    )
    write(rows, path, ["collection"])


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings, within each file by severity, log type and count."""
    grade = F.coalesce(*[F.when(F.upper("severity") == s, i) for i, s in enumerate(["CRITICAL", "HIGH", "SUSPICIOUS", "MEDIUM"])], F.lit(9))
    write(findings.repartition("collection").sortWithinPartitions("collection", grade, log_rank(F.col("log_type")), F.col("n").desc()), path, ["collection"])


def write_summary(summary: DataFrame, path: str) -> None:
    write(summary, path, ["collection"])
