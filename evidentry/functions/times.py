"""Time columns and query windows: UTC, half-open, aligned to minutes."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Window:
    """A half-open range of whole minutes; ``snapped`` tells whether the request was widened."""

    start: datetime
    end: datetime
    snapped: bool = False

    def holds(self, column: Column) -> Column:
        """Both bounds on the raw column, so that they reach the scan."""
        return (column >= F.lit(self.start)) & (column < F.lit(self.end))

    def dates(self) -> list[date]:
        """All dates that the window has an instant of, and its end's."""
        first = self.start.date()
        return [first + timedelta(days=k) for k in range((self.end.date() - first).days + 1)]

    def contains(self, value: datetime) -> bool:
        return self.start <= value < self.end

    def before(self) -> Window:
        """The equally long window that ends where this one starts."""
        return Window(self.start - (self.end - self.start), self.start)

    def widened(self, minutes: int) -> Window:
        return Window(self.start - timedelta(minutes=minutes), self.end, self.snapped)


def resolve_window(start: datetime, end: datetime) -> Window:
    """Snaps the start down and the end up to minutes; an end on a boundary stays."""
    if start.tzinfo is not None:
        start, end = start.astimezone(UTC), end.astimezone(UTC)
    if end <= start:
        raise ValueError("a window must end after it starts")
    low = start.replace(second=0, microsecond=0)
    high = end.replace(second=0, microsecond=0)
    high += timedelta(minutes=high < end)
    return Window(low, high, (low, high) != (start, end))


def minute(ts: Column | str) -> Column:
    """The minute a timestamp lies in, of the timestamp's own type where it has no zone."""
    return F.date_trunc("minute", ts)


def minute_ntz(ts: Column | str) -> Column:
    return F.date_trunc("minute", ts).cast("timestamp_ntz")


def bucket(ts: Column, minutes: int) -> Column:
    """The start of the ``minutes``-long bucket of the hour."""
    return F.date_trunc("hour", ts) + F.make_dt_interval(mins=(F.floor(F.minute(ts) / minutes) * minutes).cast("int"))


def wire(ts: Column | str) -> Column:
    """Microseconds and Z, as identities use it."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def wire_seconds(ts: Column | str) -> Column:
    """Whole seconds and Z, as rollup citations use it."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def attach_zone(local: Column, zone: Column) -> tuple[Column, Column, Column]:
    """A wall-clock time in a zone as (instant, ambiguous, nonexistent).

    Of a repeated time the first occurrence counts; a skipped time moves on by the gap. All
    are timestamps read in UTC: ``local`` is the wall clock, the instant its UTC reading.
    """
    instant = F.to_utc_timestamp(local, zone)
    missing = F.from_utc_timestamp(instant, zone) != local
    later = [F.from_utc_timestamp(instant + F.expr(f"INTERVAL {k} MINUTES"), zone) == local for k in (30, 60)]
    return instant, ~missing & (later[0] | later[1]), missing
