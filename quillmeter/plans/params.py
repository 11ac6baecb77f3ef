"""Query parameters: time buckets, ranges, filters, presets.  Plain Python; nothing here touches data."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

HOUR, DAY = 3600, 86400
MAX_RANGE, MAX_POINTS, MAX_FILTER_BYTES, MAX_OFFSET_MINUTES = 720 * DAY, 20_000, 128, 840
#: Fixed buckets: label and seconds; a calendar month has no seconds.
FIXED = {"1s": 1, "1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": HOUR, "2h": 2 * HOUR, "6h": 6 * HOUR, "12h": 12 * HOUR, "1d": DAY, "1mo": None}
AUTOMATIC = [30 * DAY, DAY, 12 * HOUR, 6 * HOUR, 2 * HOUR, HOUR, 1800, 900, 300, 60, 1]
UNITS = {"s": 1, "m": 60, "h": HOUR, "d": DAY}
FILTERS = ("node_id", "app_type", "provider_id", "model", "data_source")


class InvalidQuery(ValueError):
    """A query that cannot be answered as asked."""


@dataclass(frozen=True)
class Bucket:
    """``seconds`` is None for calendar months."""

    seconds: int | None

    @property
    def label(self) -> str:
        for name, seconds in FIXED.items():
            if seconds == self.seconds:
                return name
        for unit, seconds in (("d", DAY), ("h", HOUR), ("m", 60)):
            if self.seconds % seconds == 0:
                return f"{self.seconds // seconds}{unit}"
        return f"{self.seconds}s"

    @property
    def follows_time_zone(self) -> bool:
        return self.seconds == DAY

    def points(self, begin: int, end: int) -> int:
        return -(-(end - begin) // (self.seconds or 30 * DAY))


def automatic_bucket(span: int) -> Bucket:
    """The largest that gives ten points at least."""
    return Bucket(next((s for s in AUTOMATIC if -(-span // s) >= 10), 1))


def parse_bucket(text: str | None, span: int) -> Bucket:
    text = (text or "auto").strip()
    if text in ("", "auto"):
        return automatic_bucket(span)
    if text in FIXED:
        return Bucket(FIXED[text])
    if not (m := re.fullmatch(r"(\+?[0-9]+)([smhd])", text, re.ASCII)):
        raise InvalidQuery("bucket must be auto, a fixed bucket or <integer>{s,m,h,d}")
    seconds = int(m[1]) * UNITS[m[2]]
    if not 1 <= seconds <= MAX_RANGE:
        raise InvalidQuery("bucket must be between 1 second and 720 days")
    return Bucket(seconds)


def clean_filter(value: str | None) -> str | None:
    value = (value or "").strip()
    if len(value.encode()) > MAX_FILTER_BYTES:
        raise InvalidQuery("a filter has 128 bytes at most")
    return value or None


@dataclass(frozen=True)
class Query:
    begin: int
    end: int
    bucket: Bucket
    offset_minutes: int = 0
    filters: dict[str, str] = field(default_factory=dict)

    @property
    def offset(self) -> int:
        """Seconds by which buckets are shifted: local days only."""
        return self.offset_minutes * 60 if self.bucket.follows_time_zone else 0


def resolve_query(now: int, begin: int | None = None, end: int | None = None, bucket: str | None = None, offset_minutes: int | None = None, **filters: str | None) -> Query:
    """Defaults to the 24 hours before ``now``; the range is half-open."""
    end = now if end is None else end
    begin = end - DAY if begin is None else begin
    if begin >= end:
        raise InvalidQuery("from must be before to")
    if end - begin > MAX_RANGE:
        raise InvalidQuery("the range has 720 days at most")
    offset_minutes = offset_minutes or 0
    if abs(offset_minutes) > MAX_OFFSET_MINUTES:
        raise InvalidQuery("the time zone offset is beyond 14 hours")
    if unknown := set(filters) - set(FILTERS):
        raise InvalidQuery(f"unknown filters: {sorted(unknown)}")
    chosen = parse_bucket(bucket, end - begin)
    if chosen.points(begin, end) > MAX_POINTS:
        raise InvalidQuery("the range has too many buckets")
    return Query(begin, end, chosen, offset_minutes, {k: c for k, v in filters.items() if (c := clean_filter(v))})


def resolve_daily(now: int, begin: int | None = None, end: int | None = None, offset_minutes: int | None = None, **filters: str | None) -> Query:
    """Local days; by default the 364 before the local today, and today."""
    offset = (offset_minutes or 0) * 60
    today = (now + offset) // DAY * DAY - offset
    end = today + DAY if end is None else end
    begin = end - 365 * DAY if begin is None else begin
    return resolve_query(now, begin, end, "1d", offset_minutes, **filters)


def page_limit(limit: int | None) -> int:
    limit = 50 if limit is None else limit
    if not 1 <= limit <= 200:
        raise InvalidQuery("limit must be between 1 and 200")
    return limit


def page_cursor(created_at: int | None, event_id: str | None) -> tuple[int, str] | None:
    """Both parts or neither; a blank id is an error."""
    if created_at is None and event_id is None:
        return None
    if created_at is None or not (event_id or "").strip():
        raise InvalidQuery("a cursor needs a time and an event id")
    return created_at, event_id.strip()


def resolve_preset(name: str, now: datetime, tz: str = "UTC") -> tuple[int, int]:
    """(from, to) of today, 1h, 24h, 7d, 14d, 30d or 1y; days are local calendar days up to now."""
    local = now.astimezone(ZoneInfo(tz))
    midnight = local.replace(hour=0, minute=0, second=0, microsecond=0)
    days = {"today": 0, "7d": 6, "14d": 13, "30d": 29}
    if name in ("1h", "24h"):
        begin = now - timedelta(hours=int(name[:-1]))
    elif name in days:
        begin = midnight - timedelta(days=days[name])
    elif name == "1y":
        leap = midnight.month == 2 and midnight.day == 29
        begin = midnight.replace(year=midnight.year - 1, **({"day": 28} if leap else {}))
    else:
        raise InvalidQuery(f"unknown preset {name}")
    return int(begin.timestamp()), int(now.timestamp())
