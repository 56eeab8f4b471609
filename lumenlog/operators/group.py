"""Grouping that every log type shares: pattern counts, grouped events, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pattern_counts(events: DataFrame, label: str = "label") -> DataFrame:
    """(collection, label, n)."""
    return events.where(F.col(label).isNotNull()).groupBy("collection", label).agg(F.count("*").alias("n"))


def carried(lines: DataFrame) -> list[str]:
    """Columns of the lines that parsers pass on where they are given."""
    return [c for c in ("file_path",) if c in lines.columns]


def read_once(rows: DataFrame) -> DataFrame:
    """``rows`` out of one shuffle, which all who read them share, so that what they are made of is worked out once.

    Spark shuffles anew for a reader that wants other columns or has a filter, as it moves both below the shuffle. A row
    packed in an array of one keeps them above: it goes by all its columns, and no filter passes the inline.
    """
    return rows.select(F.array(F.struct(*rows.columns)).alias("row")).repartition("row").select(F.inline("row"))


def group_events(events: DataFrame, key: list[str], example: Column, seq: str = "seq", per_file: bool = False) -> DataFrame:
    """Per key: n, first_ts, last_ts, and the example of the earliest row. Partial sums first, so a hot key is no load.

    per_file: a key is counted in each file of a rotation set by itself.
    """
    return events.groupBy(*key, *(["file_path"] if per_file else [])).agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by(example, F.col(seq)).alias("example")
    )


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in a total order; Spark cuts each partition to k rows before the shuffle."""
    at = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(at)).where(F.col(rank) <= k)


def collapse_cron(findings: DataFrame, text: Column, min_repeat: int = 2) -> DataFrame:
    """Cron findings alike but for their stamps: n, first and last stamp, sample command; at least ``min_repeat`` of each."""
    from lumenlog.functions.text import cron_command_of, extract

    iso, sys = r"\b\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\b", r"\b[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\b"
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, iso, ""), sys, ""), r"(?i)\bat\b\s*:\s*", " ")
    stamp = F.try_to_timestamp(F.nullif(extract(text, iso, 0), F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss"))
    rows = findings.select("collection", "seq", F.trim(F.regexp_replace(bare, r"\s{2,}", " ")).alias("key"), stamp.alias("ts"), cron_command_of(text).alias("cmd"))
    return group_events(rows, ["collection", "key"], F.col("cmd")).where(F.col("n") >= min_repeat)
