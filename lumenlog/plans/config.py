"""What an analyst sets: thresholds and lists, as one frozen argument of the plans."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from lumenlog.functions import rules


@dataclass(frozen=True)
class TriageConfig:
    start: dt.datetime | None = None
    end: dt.datetime | None = None
    as_of: dt.datetime = dt.datetime(2024, 6, 1)
    bruteforce_threshold: int = 5
    web_requests_per_minute: int = 50
    history_gap_hours: int = 12
    body_min_score: int = 6
    body_recent_days: int = 30
    body_min_size: int = 1024
    body_per_folder: int = 10
    body_require_keyword: bool = True
    body_keywords: tuple[str, ...] = field(default=tuple(rules.BODY_KEYWORDS))
    body_whitelist: tuple[str, ...] = field(default=tuple(rules.BODY_WHITELIST))
    sha1_min_score: int = 3
    rank1: tuple[str, ...] = field(default=tuple(rules.RANK1))
    rank2: tuple[str, ...] = field(default=tuple(rules.RANK2))
    whitelist: tuple[str, ...] = field(default=tuple(rules.RANK_WHITELIST))
