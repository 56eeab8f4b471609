"""Timestamps of log lines, and the date filters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns.
ISO = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2}))"
APACHE = r"\[(\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4})\]"
APACHE_STAMP = r"^\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}$"
CLASSIC = r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
AUDIT = r"msg=audit\((\d+)\."


# Names of the months, and at the same places their numbers.
MONTHS, NUMBERS = "JanFebMarAprMayJunJulAugSepOctNovDec", "01-02-03-04-05-06-07-08-09-10-11-12-"


def iso_of(year: Column, month: Column, day: Column, rest: Column) -> Column:
    """A timestamp out of its parts, the month by its name; null if they make none. A cast of the ISO spelling takes a
    small part of the time that a pattern does."""
    at = F.instr(F.lit(MONTHS), month)
    number = F.when(at % 3 == 1, F.substring(F.lit(NUMBERS), at, F.lit(3)))
    return F.concat(year, F.lit("-"), number, day, F.lit("T"), rest).try_cast("timestamp")


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), value being worked out once however often ``of`` uses it.

    A column that is used twice is written out twice in the code Spark makes; a long one, such as a pattern's match,
    then runs as often, and code over the size that the JVM compiles is interpreted.
    """
    return F.get(F.transform(F.array(value), of), F.lit(0))


def infer_year(stamp: Column, file_mtime: Column) -> Column:
    """A stamp without a year takes its file's; one that then lies over a day after the file is of the year before."""
    return let(in_year(stamp, F.year(file_mtime)), lambda this: F.when(year_before(this, file_mtime), in_year(stamp, F.year(file_mtime) - 1)).otherwise(this))


def apache_ts(stamp: Column) -> Column:
    """A stamp as access logs have it between brackets; null if it is none."""

    return let(stamp, apache_ts_of)


def apache_ts_of(stamp: Column) -> Column:
    """apache_ts of a stamp that is at hand, which is written out several times."""
    part = lambda a, n: F.substring(stamp, a, n)
    rest = F.concat(part(13, 8), part(22, 3), F.lit(":"), part(25, 2))
    return F.when(stamp.rlike(APACHE_STAMP), iso_of(part(8, 4), part(4, 3), part(1, 2), rest))


def in_year(stamp: Column, year: Column) -> Column:
    """A classic stamp in a year."""
    return iso_of(year.cast("string"), F.substring(stamp, 1, 3), F.regexp_extract(stamp, r"^...\s+(\d+)", 1), F.substring(stamp, -8, 8))


def year_before(ts: Column, file_mtime: Column) -> Column:
    return ts > file_mtime + F.expr("INTERVAL 1 DAY")


def parse_ts(line: Column, file_mtime: Column) -> Column:
    """ISO 8601 with an offset, then Apache, then classic syslog, then audit epoch; null if none."""

    def of(s: Column) -> Column:
        found = lambda pattern, made: let(F.regexp_extract(s, pattern, 1), lambda x: F.when(x != "", made(x)))
        return F.coalesce(
            found(ISO, lambda x: x.try_cast("timestamp")), found(APACHE, apache_ts), found(CLASSIC, lambda x: infer_year(x, file_mtime)),
            found(AUDIT, lambda x: F.timestamp_seconds(x.try_cast("long"))),
        )

    return let(line, of)


def ts_steps(line: Column, file_mtime: Column) -> list[dict[str, Column]]:
    """Columns that ts_of reads, in steps: one reads those of the steps before it."""
    iso, stamp = F.col("iso_"), F.col("stamp_")
    return [
        {"iso_": F.regexp_extract(line, ISO, 1).try_cast("timestamp")},
        {"apache_": F.when(iso.isNull(), F.regexp_extract(line, APACHE, 1)), "stamp_": F.when(iso.isNull(), F.regexp_extract(line, CLASSIC, 1))},
        {"this_": F.when(stamp != "", in_year(stamp, F.year(file_mtime)))},
    ]


def ts_of(line: Column, file_mtime: Column) -> Column:
    """parse_ts of a line that has the columns of ts_steps.

    parse_ts binds its values within one expression, which Spark walks as a tree for each row; out of columns at hand it
    compiles the same, and what is used twice is a column, so that it is worked out once.
    """
    this = F.col("this_")
    classic = F.when(year_before(this, file_mtime), in_year(F.col("stamp_"), F.year(file_mtime) - 1)).otherwise(this)
    return F.coalesce("iso_", apache_ts_of(F.col("apache_")), classic, F.timestamp_seconds(F.regexp_extract(line, AUDIT, 1).try_cast("long")))


def in_range(ts: Column, start: dt.datetime | None = None, end: dt.datetime | None = None) -> Column:
    """Inclusive; a row without a timestamp stays."""
    ok = F.lit(True)
    if start is not None:
        ok = ok & (ts >= F.lit(start))
    if end is not None:
        ok = ok & (ts <= F.lit(end))
    return ts.isNull() | ok


def valid_ts(ts: Column, as_of: Column) -> Column:
    return F.coalesce((F.year(ts) >= 2000) & (F.year(ts) <= F.year(as_of) + 1), F.lit(False))
