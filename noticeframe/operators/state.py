"""Keyed state, change events, hysteresis, versions, diffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, key: Sequence[str], at: str, priority: str | None = None, tie: str | None = None) -> DataFrame:
    """The version with the newest time; equal times fall to priority, then to ``tie``."""
    order = F.struct(*[F.col(c) for c in (at, priority, tie) if c])
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_v")).select(*key, "_v.*")


def newest_parts(df: DataFrame, key: str, parts: dict[str, Sequence[str]], tie: str) -> DataFrame:
    """Field groups that are newest independently of each other: ``{time column: fields}``."""
    aggs = [F.max_by(F.struct(at, *fields), F.struct(at, tie)).alias(f"_{i}") for i, (at, fields) in enumerate(parts.items())]
    return df.groupBy(key).agg(*aggs).select(key, *[f"_{i}.*" for i in range(len(parts))])


def upsert(state: DataFrame, batch: DataFrame, key: str, fingerprint: str, at: str, tie: str) -> DataFrame:
    """Merge a batch into keyed state.

    ``state``: key, fingerprint, first_seen_at, updated_at, revision. Unchanged fingerprints keep
    their revision and change time; the first sighting never moves; several rows of a key count by
    the newest.
    """
    new = newest(batch.select(key, fingerprint, at, tie), [key], at, tie).select(key, F.col(fingerprint).alias("_fp"), F.col(at).alias("_at"))
    both = state.join(new, key, "full_outer")
    changed = F.col("_fp").isNotNull() & ~F.col("_fp").eqNullSafe(F.col(fingerprint))
    return both.select(
        key,
        F.coalesce("_fp", fingerprint).alias(fingerprint),
        F.coalesce("first_seen_at", "_at").alias("first_seen_at"),
        F.when(changed, F.col("_at")).otherwise(F.col("updated_at")).alias("updated_at"),
        (F.coalesce("revision", F.lit(0)) + changed.cast("int")).alias("revision"),
        F.when(F.col("_fp").isNull(), "absent").when(F.col("revision").isNull(), "new").when(changed, "changed").otherwise("unchanged").alias("outcome"),
    )


def revisions(log: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """Replay of a whole log: revision and change flag of every row."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = F.when(F.row_number().over(w) == 1, True).otherwise(~F.col(value).eqNullSafe(F.lag(value).over(w)))
    return log.withColumn("changed", changed).withColumn("revision", F.sum(F.col("changed").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def change_events(log: DataFrame, key: str, order: Sequence[str], detectors: Sequence[tuple[str, Column]], columns: Sequence[str]) -> DataFrame:
    """Type of the first detector that fires between a row and its predecessor.

    Detectors are boolean columns over the fields and ``old_<field>``. First rows give no event.
    """
    w = Window.partitionBy(key).orderBy(*order)
    with_old = log.select("*", *[F.lag(c).over(w).alias(f"old_{c}") for c in columns], (F.row_number().over(w) > 1).alias("_later")).where("_later").drop("_later")
    kind = F
    for name, test in detectors:
        kind = kind.when(test, name)
    return with_old.withColumn("change", kind.otherwise(F.lit(None))).where("change IS NOT NULL")


def listing_status(checks: DataFrame, key: str, at: str, seen: str, complete: str, hours: int = 6) -> DataFrame:
    """Withdrawn after two misses in complete inventories at least ``hours`` apart; incomplete ones say nothing.

    Per key a fold over its checks in order of time; the state is two numbers.
    """
    runs = F.array_sort(F.collect_list(F.struct(F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(seen).alias("seen"), F.col(complete).alias("complete"))))
    start = F.struct(F.lit(0).alias("misses"), F.lit(None).cast("bigint").alias("since"), F.lit("active").alias("status"))
    gap = hours * 3_600_000_000

    def step(a: Column, x: Column) -> Column:
        counts = x["complete"] & (a["since"].isNull() | (x["t"] - a["since"] >= gap))
        n = F.when(counts, a["misses"] + 1).otherwise(a["misses"])
        missed = F.struct(n.alias("misses"), F.when(counts, x["t"]).otherwise(a["since"]).alias("since"), F.when(n >= 2, "withdrawn").otherwise("unconfirmed").alias("status"))
        return F.when(x["seen"], start).when(~x["complete"], a).otherwise(missed)

    return checks.groupBy(key).agg(F.aggregate(runs, start, step).alias("s")).select(key, F.col("s.status").alias("status"), F.col("s.misses").alias("misses"))


def retry_hours(failures: Column, transport: Column, gone: Column) -> Column:
    """T5: exponential waits: to 4 h for transport, to 72 h otherwise, at least 24 h when gone."""
    wait = F.least(F.when(transport, F.lit(4.0)).otherwise(F.lit(72.0)), F.pow(F.lit(2.0), failures.cast("double")))
    return F.when(gone, F.greatest(F.lit(24.0), wait)).otherwise(wait)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Every key of either snapshot: added, removed, changed or same."""
    a, b = old.select(key, F.struct(*fields).alias("_old")), new.select(key, F.struct(*fields).alias("_new"))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("diff"))


def attributed(df: DataFrame, reasons: Sequence[tuple[str, Column]], default: str = "unexplained") -> DataFrame:
    """Each row under the first reason that holds, counted."""
    reason = F
    for name, test in reasons:
        reason = reason.when(F.coalesce(test, F.lit(False)), name)
    return df.groupBy(reason.otherwise(default).alias("reason")).agg(F.count("*").alias("cnt"))


def conflicts(mine: DataFrame, theirs: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Keys of both sides with different fields."""
    a, b = mine.select(key, F.struct(*fields).alias("_a")), theirs.select(key, F.struct(*fields).alias("_b"))
    return a.join(b, key).where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key)
