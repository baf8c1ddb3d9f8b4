"""Planning, marts and histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_overlap
from .relational import facet_counts, first_of


def detail_priority(df: DataFrame, now: Column, deadline: str, failures: str, queued_at: str, key: str) -> DataFrame:
    """Details to fetch: due soon first, then never tried, then the longest waiting."""
    soon = F.coalesce(F.col(deadline).between(now, now + F.expr("INTERVAL 7 DAYS")), F.lit(False))
    return df.orderBy((~soon).asc(), (F.col(failures) > 0).asc(), F.col(queued_at).asc_nulls_first(), F.col(key).asc())


def retry_due(queued_at: Column, failures: Column, transport: Column, gone: Column, now: Column) -> Column:
    """T5: whether a deferred detail may be tried again."""
    from .state import retry_hours

    return F.unix_micros(now) - F.unix_micros(queued_at) >= retry_hours(failures, transport, gone) * 3_600_000_000


def normal_salary(low: Column, raw: Column) -> Column:
    """A yearly sum that was taken for a monthly one: a twelfth, rounded half to even."""
    yearly = (low >= 60000) & raw.rlike("[万wW]") & ~raw.rlike("年|/月|月薪|每月")
    return F.when(yearly, F.bround(low / 12, 0)).otherwise(low)


def sibling_links(rows: DataFrame, key: str, stem: str, least: int = 7) -> DataFrame:
    """``(child, parent)``: rows whose stem equals or contains another's of ``least`` characters or more.

    The parent has the longest such stem, then the smallest key. Equal stems are one row first, so many
    copies of a stem cost one. Containment has no equi-key, but a shared run of ``least`` characters does: distinct stems are
    exploded into such runs, joined with the stems that begin with them, and verified; so no cross join is made.
    """
    known = rows.where(F.char_length(stem) >= least).select(F.col(key).alias("child"), F.col(stem).alias("cs"))
    heads = known.groupBy("cs").agg(F.min("child").alias("first"))
    runs = F.transform(F.sequence(F.lit(1), F.char_length("cs") - least + 1), lambda i: F.substr(F.col("cs"), i, F.lit(least)))
    probe = heads.select("cs", F.explode(F.array_distinct(runs)).alias("run"))
    start = heads.select(F.col("first").alias("parent"), F.col("cs").alias("ps"), F.substring("cs", 1, least).alias("run"))
    inner = probe.join(start, "run").where(F.contains("cs", F.col("ps")) & (F.col("cs") != F.col("ps")))
    best = inner.groupBy("cs").agg(F.max_by("parent", F.struct(F.char_length("ps"), -F.col("parent"))).alias("within"))
    linked = known.join(heads.join(best, "cs", "left"), "cs")
    return linked.select("child", F.when(F.col("child") != F.col("first"), F.col("first")).otherwise(F.col("within")).alias("parent")).where("parent IS NOT NULL")


def source_report(sources: DataFrame, group: str, elapsed: str, failures: str, pending: str) -> DataFrame:
    """H5: totals per pack, the slowest first."""
    return sources.groupBy(group).agg(F.sum(elapsed).alias("elapsed"), F.sum(failures).alias("failures"), F.sum(pending).alias("pending"), F.count("*").alias("sources")).orderBy(F.desc("elapsed"), group)


def coverage_message(total: Column, failing: Column, stale: Column, events: Column) -> Column:
    """The first diagnosis that holds."""
    return F.when(total == 0, "no source").when(failing == total, "all failing").when(events > 0, "ok").when(stale > 0, "stale").otherwise("no event")


def capped_scores(scores: DataFrame, collected_at: str, now: Column, score: str = "score", days: int = 7) -> DataFrame:
    """Scores of sources not read within ``days``, or read more than five minutes ahead, are null."""
    fresh = (F.col(collected_at) > now - F.expr(f"INTERVAL {days} DAYS")) & (F.col(collected_at) <= now + F.expr("INTERVAL 5 MINUTES"))
    return scores.withColumn(score, F.when(fresh, F.col(score)))


def merged_history(old: DataFrame, new: DataFrame, key: Sequence[str], at: str) -> DataFrame:
    """Newest of both by time; the new side wins ties."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    return first_of(both, key, [-F.unix_micros(F.col(at).cast("timestamp")), -F.col("_side")]).drop("_side")


def changed_since(saved: DataFrame, current: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Saved events whose fields differ now, nulls compared as values."""
    c = current.select(key, F.struct(*fields).alias("_now"))
    return saved.join(c, key).withColumn("changed", ~F.struct(*fields).eqNullSafe(F.col("_now"))).drop("_now")


def mart(rows: DataFrame, key: str, day: str, tie: str, top: int = 60) -> tuple[DataFrame, DataFrame]:
    """The flat mart, one row per key (the newest), and its first screen of ``top`` rows."""
    one = first_of(rows, [key], [-F.unix_date(F.col(day)), -F.col(tie)])
    order = [F.col(day).desc(), F.col(tie).desc(), F.col(key).asc()]
    return one, one.orderBy(*order).limit(top).withColumn("seq", F.row_number().over(Window.orderBy(*order)))


def mart_facets(rows: DataFrame, single: Sequence[str], multi: Sequence[str]) -> DataFrame:
    """K4: facets stored next to the mart."""
    return facet_counts(rows, single, multi, top={c: 60 for c in multi})


def similar_names(a: Column, b: Column, least: float = 0.6) -> Column:
    """Names that share most of their characters."""
    return char_overlap(a, b) >= least


def government_article(title: Column) -> Column:
    """titles of notices, not of navigation or news."""
    return (F.char_length(title) >= 8) & title.rlike("招聘|招考|招录|选调|遴选|引进|公示|报名") & ~title.rlike("^(?:首页|更多|登录)|新闻|会议召开|学习贯彻")


def publishable(title: Column, url: Column, body: Column, kind: Column) -> Column:
    """a title and link, and for positions a body."""
    return (F.coalesce(title, F.lit("")) != "") & url.rlike("^https?://") & ((kind != "具体岗位") | (F.char_length(F.coalesce(body, F.lit(""))) > 0))
