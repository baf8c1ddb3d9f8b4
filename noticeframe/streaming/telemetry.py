"""Telemetry validation and sampling, for batch and stream alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("click", "view", "error", "purchase")
PAYLOAD = "k INT"


def valid(events: DataFrame, kind: str = "event_type", value: str = "value", body: str = "props", kinds: tuple[str, ...] = KINDS, limit: int = 4096) -> DataFrame:
    """Known kinds, finite non-negative values and bodies of at most ``limit`` bytes; adds ``payload``."""
    number = F.col(value)
    good = F.col(kind).isin(*kinds) & number.isNotNull() & ~F.isnan(number.cast("double")) & (number >= 0) & (F.octet_length(body) <= limit)
    return events.where(good).withColumn("payload", F.from_json(body, PAYLOAD, {"mode": "PERMISSIVE"}))


def verdict(body: Column, content_type: Column, kind: Column, limit: int = 4096, kinds: tuple[str, ...] = KINDS) -> Column:
    """Status an endpoint gives: 415, 413, 400 or 204."""
    return F.when(~F.coalesce(content_type.startswith("application/json"), F.lit(False)), 415).when(F.octet_length(body) > limit, 413).when(F.coalesce(kind.isin(*kinds), F.lit(False)), 204).otherwise(400)


def sampled(events: DataFrame, session: str, kind: str = "event_type", percent: int = 20) -> DataFrame:
    """``percent`` of sessions, whole; errors always. The same sessions in every run and batch."""
    return events.where((F.pmod(F.xxhash64(session), F.lit(100)) < percent) | (F.col(kind) == "error"))


def windowed_counts(events: DataFrame, at: str = "ts", late: str = "10 minutes", width: str = "5 minutes", kind: str = "event_type") -> DataFrame:
    """Counts per kind in tumbling windows; rows later than ``late`` are out. Works on streams and tables."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n"))
