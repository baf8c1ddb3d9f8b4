"""Time rules on ISO strings; ``now`` is always given, as a timestamp literal or column.

A business day is a UTC+8 calendar day. A deadline given as a day lasts to that day's end in UTC+8;
an impossible day is unknown (null).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

ZONE = "+08:00"
DAY_ONLY = r"^\d{4}-\d{2}-\d{2}$"


def instant(text: Column) -> Column:
    """Timestamp of an ISO string; days are midnight UTC; null if it is not a time."""
    return F.try_to_timestamp(F.nullif(trimmed(text), F.lit("")))


def business_day(text: Column) -> Column:
    """``yyyy-MM-dd`` in UTC+8; days pass through; '' when unknown."""
    day = F.date_format(F.from_utc_timestamp(instant(text), ZONE), "yyyy-MM-dd")
    return F.when(text.rlike(DAY_ONLY), text).otherwise(F.coalesce(day, F.lit("")))


def day_of(ts: Column) -> Column:
    """UTC+8 date of a timestamp."""
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def deadline_instant(text: Column) -> Column:
    end = F.try_to_timestamp(F.concat(text, F.lit("T23:59:59.999+08:00")))
    return F.when(text.rlike(DAY_ONLY), end).otherwise(instant(text))


def expired(text: Column, now: Column) -> Column:
    """Strictly past; unknown deadlines are not."""
    return F.coalesce(deadline_instant(text) < now, F.lit(False))


def days_left(text: Column, now: Column) -> Column:
    """Difference of UTC+8 days, never negative; null when unknown."""
    left = F.datediff(day_of(deadline_instant(text)), day_of(now))
    return F.when(left.isNotNull(), F.greatest(F.lit(0), left))


def countdown(text: Column, now: Column) -> Column:
    """Expired, urgent (to 3 days), warning (to 7 days) or normal; null when unknown."""
    left = days_left(text, now)
    return (
        F.when(deadline_instant(text).isNull(), F.lit(None).cast("string"))
        .when(deadline_instant(text) <= now, "expired")
        .when(left <= 3, "urgent")
        .when(left <= 7, "warning")
        .otherwise("normal")
    )


def recent(text: Column, now: Column, days: int = 30) -> Column:
    """between one day ahead and ``days`` back, in fractional days."""
    age = (F.unix_micros(now) - F.unix_micros(instant(text))) / 86_400_000_000
    return F.coalesce(age.between(-1, days), F.lit(False))


def event_end(day: Column, start: Column, end: Column) -> Column:
    """End instant of an event in UTC+8; 23:59 when no end is known."""
    return F.try_to_timestamp(F.concat(day, F.lit("T"), F.coalesce(F.nullif(end, F.lit("")), F.lit("23:59")), F.lit(":00+08:00")))


def source_epoch(value: Column, now: Column) -> Column:
    """Seconds or milliseconds since 1970 as a timestamp; null before 2000 or over 5 minutes ahead."""
    ts = F.timestamp_seconds(F.when(value > 100_000_000_000, value / 1000).otherwise(value).cast("double"))
    return F.when((ts >= F.lit("2000-01-01").cast("timestamp")) & (ts <= now + F.expr("INTERVAL 5 MINUTES")), ts)
