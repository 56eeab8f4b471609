"""Log types as records: where their lines come from, how they are parsed and classified, what a normalised event holds."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.rules import either
from lumenlog.functions.timeparse import in_range
from lumenlog.operators import activity, auth, report, system
from lumenlog.plans.config import TriageConfig

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class LogType:
    """columns: the normalised columns that are not simply the classified ones of that name; keep: which rows are events."""

    name: str
    source: str
    parse: Step
    classify: Step
    columns: Callable[[], dict[str, Column]] = dict
    keep: str = "true"

    def events(self, lines: DataFrame) -> DataFrame:
        return self.classify(self.parse(lines))

    def normalised(self, lines: DataFrame) -> DataFrame:
        return report.normalise(self.events(lines).where(self.keep), self.name, **self.columns())


LOG_TYPES: dict[str, LogType] = {}


def register(kind: LogType) -> LogType:
    """Add a log type, or replace the one of its name."""
    LOG_TYPES[kind.name] = kind
    return kind


def cron_user() -> Column:
    return F.when((F.col("tier") == "Critical") & (F.col("cron_user") != ""), F.col("cron_user")).otherwise(F.col("user"))


for _name in ("AUTH", "SECURE"):
    register(LogType(_name, _name.lower(), auth.parse_auth, auth.auth_events_norm, lambda: {"raw": F.col("raw")}))
register(LogType("SYSLOG", "syslog", system.parse_syslog, system.classify_syslog, lambda: {"user": cron_user()}, "tier <> 'Noise'"))
register(LogType("MESSAGES", "messages", system.parse_messages, system.classify_messages))
register(LogType("AUDIT", "audit", system.parse_audit, system.classify_audit, lambda: {"daemon": F.col("type"), "message": F.substring("message", 1, 200)}))
register(LogType("WEB", "web", activity.parse_web, activity.classify_web, lambda: {"daemon": F.lit("web")}))
register(LogType("CRONTAB", "crontab", system.parse_crontab, system.classify_crontab, lambda: {"daemon": F.lit("cron"), "message": F.col("command")}, "tier <> 'Info'"))
register(LogType("BASH", "history", activity.history_commands, activity.classify_shell, lambda: {"daemon": F.lit("bash"), "user": F.col("username"), "message": F.col("command"), "raw": F.col("command")}))
register(LogType("JOURNAL", "journal", system.parse_journal, system.classify_journal, lambda: {"host": F.col("hostname"), "daemon": F.col("identifier"), "user": F.col("uid"), "raw": F.col("message")}))


register(LogType("DOCKER", "containers", activity.containers, activity.container_events, lambda: {"daemon": F.lit("docker"), "raw": F.col("raw")}))


def dated(events: DataFrame, config: TriageConfig, *times: str) -> DataFrame:
    """Events in the analyst's range, ends included: those any of whose times is in it, and those without a time."""
    if config.start is None and config.end is None:
        return events
    columns = [F.col(t) for t in times or ("ts",)]
    inside = [c.isNotNull() & in_range(c, config.start, config.end) for c in columns]
    return events.where(reduce(either, inside) | F.coalesce(*columns).isNull())


def normalised_events(lines_of: Callable[[str], DataFrame], config: TriageConfig, names: Iterable[str]) -> DataFrame:
    """Events of the named log types in one table; ``lines_of`` gives the lines of a source."""
    return report.union([dated(t.normalised(lines_of(t.source)), config) for t in map(LOG_TYPES.__getitem__, names)])
