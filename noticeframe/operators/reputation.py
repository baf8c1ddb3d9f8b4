"""Scoring of opinions as nested aggregates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the scoring policy.
WEIGHTS = {"pay": 0.3, "worklife": 0.3, "growth": 0.25, "management": 0.15}
LEAST_CONTRIBUTORS, PRIOR_WEIGHT, PRIOR_SCORE, LEAST_DIMENSIONS = 10, 5, 3.0, 3
RECENT_DAYS, SOURCE_AGE_DAYS = 365, 7


def eligible_evidence(rows: DataFrame, now) -> DataFrame:
    """Attributed experiences published within a year and collected within a week (five minutes ahead at most)."""
    published, collected = F.col("published_at"), F.col("collected_at")
    return rows.where(
        (F.col("kind") == "experience")
        & (F.col("attribution") != "uncertain")
        & (published <= now)
        & (published >= now - F.expr(f"INTERVAL {RECENT_DAYS} DAYS"))
        & (collected <= now + F.expr("INTERVAL 5 MINUTES"))
        & (collected > now - F.expr(f"INTERVAL {SOURCE_AGE_DAYS} DAYS"))
    )


def dimension_scores(signals: DataFrame, entity: str = "entity", dimension: str = "dimension", contributor: str = "contributor", polarity: str = "polarity") -> DataFrame:
    """Mean per contributor, then per dimension, shrunk to the prior; null under ``LEAST_CONTRIBUTORS``."""
    people = signals.where(F.col(contributor).isNotNull()).groupBy(entity, dimension, contributor).agg(F.avg(polarity).alias("p"))
    out = people.groupBy(entity, dimension).agg(
        F.count("*").alias("contributors"), F.count_if(F.col("p") > 0).alias("positive"), F.count_if(F.col("p") < 0).alias("negative"), F.sum((F.col("p") + 1) * 2 + 1).alias("_sum")
    )
    score = F.round((F.col("_sum") + PRIOR_WEIGHT * PRIOR_SCORE) / (F.col("contributors") + PRIOR_WEIGHT), 1)
    return out.withColumn("score", F.when(F.col("contributors") >= LEAST_CONTRIBUTORS, score)).drop("_sum")


def overall_scores(scores: DataFrame, weights: Mapping[str, float] = WEIGHTS, entity: str = "entity", dimension: str = "dimension") -> DataFrame:
    """A10: weighted mean of the scored dimensions; null when there are fewer than ``LEAST_DIMENSIONS``."""
    weight = F.create_map(*[F.lit(x) for p in weights.items() for x in p])[F.col(dimension)]
    known = F.when(F.col("score").isNotNull(), weight)
    return scores.groupBy(entity).agg(
        F.count("score").alias("scored"), F.when(F.count("score") >= LEAST_DIMENSIONS, F.round(F.sum(known * F.col("score")) / F.sum(known), 1)).alias("score")
    )


def queue_priority(age_days, active):
    """Age up to two weeks, and a logarithm of activity."""
    return F.least(F.lit(14), age_days) * 8 + F.least(F.lit(32.0), F.log2(1 + active) * 4)
