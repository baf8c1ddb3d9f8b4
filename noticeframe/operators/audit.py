"""Health, freshness and coverage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def health(sources: DataFrame, ok: Column, failing: Column, pending: str, last_success: str) -> DataFrame:
    """One row: sources, healthy, failing, pending details, newest success."""
    return sources.agg(F.count("*").alias("sources"), F.count_if(ok).alias("healthy"), F.count_if(failing).alias("failing"), F.sum(pending).alias("pending"), F.max(last_success).alias("last_success"))


def freshness(rows: DataFrame, group: str, at: str, now: Column, days: int = 7) -> DataFrame:
    """Per group: rows, rows of the last ``days``, rows dated ahead, age of the newest in hours."""
    age = (F.unix_micros(now) - F.unix_micros(F.col(at).cast("timestamp"))) / 3_600_000_000
    return rows.groupBy(group).agg(
        F.count("*").alias("total"), F.count_if(age.between(0, days * 24)).alias("recent"), F.count_if(age < 0).alias("ahead"), F.round(F.min(F.when(age >= 0, age)), 4).alias("newest_age_hours")
    )


def coverage(places: DataFrame, facts: DataFrame, key: str, active: Column, statuses: dict[str, Column]) -> DataFrame:
    """Every place with counts of its facts; places without facts show zeros."""
    counts = facts.groupBy(key).agg(F.count_if(active).alias("active"), *[F.count_if(c).alias(n) for n, c in statuses.items()])
    return places.join(counts, key, "left").fillna(0, ["active", *statuses])
