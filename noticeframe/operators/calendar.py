"""Agenda entries, reminders, milestones, feeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_lines, ics_escaped, xml_escaped


def milestones(df: DataFrame, key: str, dates: Mapping[str, str]) -> DataFrame:
    """K7, K8: ``(key, milestone, at)``, one row per known date."""
    pairs = F.array(*[F.struct(F.lit(n).alias("milestone"), F.col(c).alias("at")) for n, c in dates.items()])
    return df.select(key, F.explode(pairs).alias("m")).select(key, "m.milestone", "m.at").where("at IS NOT NULL")


def reminders(df: DataFrame, key: str, now: Column, deadline: str, next_action: str, saved: Column, applied: Column, hidden: Column) -> DataFrame:
    """Follow-ups due within a day and deadlines of saved, not applied rows within three days."""
    entries = F.array(
        F.when(F.col(next_action) <= now + F.expr("INTERVAL 1 DAY"), F.struct(F.lit("followup").alias("label"), F.col(next_action).alias("at"))),
        F.when(saved & ~applied & F.col(deadline).between(now, now + F.expr("INTERVAL 3 DAYS")), F.struct(F.lit("deadline").alias("label"), F.col(deadline).alias("at"))),
    )
    return df.where(~hidden).select(key, F.explode(F.array_compact(entries)).alias("e")).select(key, "e.label", "e.at")


def agenda(events: DataFrame, start: str, stop: Column, now: Column, extra: Sequence[Column] = ()) -> DataFrame:
    """Upcoming first in time order, then past, latest first; ``agenda_order`` is a sortable number."""
    past = stop < now
    distance = F.unix_micros(F.col(start).cast("timestamp")) - F.unix_micros(now)
    return events.select("*", past.alias("past"), F.when(past, F.lit(1 << 61) - distance).otherwise(distance).alias("agenda_order"), *extra)


def ics_lines(uid: Column, summary: Column, day: Column, detail: Column) -> Column:
    """K7: one event of a calendar feed, folded to 75 octets a line."""
    text = lambda n, c: fold_lines(F.concat(F.lit(n), ics_escaped(c)))
    return F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), text("UID:", uid), F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(day, "yyyyMMdd")), text("SUMMARY:", summary), text("DESCRIPTION:", detail), F.lit("END:VEVENT"))


def ics_feed(events: DataFrame, uid: str, summary: str, day: str, detail: str, limit: int = 250) -> DataFrame:
    """K7: the feed of the next ``limit`` events, one row."""
    top = events.orderBy(day, uid).limit(limit).withColumn("_line", ics_lines(F.col(uid), F.col(summary), F.col(day), F.col(detail)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(day, uid, "_line"))), lambda x: x["_line"]), "\r\n")
    return top.agg(F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR\r\nVERSION:2.0"), F.nullif(body, F.lit("")), F.lit("END:VCALENDAR\r\n")).alias("ics"))


def rss_feed(rows: DataFrame, order: Sequence[Column], title: str, link: str, guid: str, channel: str, limit: int = 60) -> DataFrame:
    """K6: the feed of the first ``limit`` rows in a total order, one row."""
    top = rows.orderBy(*order).limit(limit).withColumn("_n", F.monotonically_increasing_id())
    item = F.concat(F.lit("<item><title>"), xml_escaped(F.col(title)), F.lit("</title><link>"), xml_escaped(F.col(link)), F.lit("</link><guid>"), xml_escaped(F.col(guid).cast("string")), F.lit("</guid></item>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", item.alias("x")))), lambda x: x["x"]), "")
    return top.agg(F.concat(F.lit(f'<rss version="2.0"><channel><title>{channel}</title>'), body, F.lit("</channel></rss>")).alias("rss"))
