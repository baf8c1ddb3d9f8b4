"""Facts of campus talks, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, spaced, trimmed

# Structured keys and the labels that stand for them in a body; words of states, types and modes.
KEYS = {"date": ("fairDate", "宣讲时间"), "start": ("fairStartTime", "宣讲时间"), "end": ("fairEndTime", "宣讲时间"), "school": ("schoolName", "宣讲学校"), "venue": ("fairAddress", "举办地点")}
CANCELLED = "已取消|已停办|取消宣讲"
TYPES = (("interview", "面试"), ("test", "笔试|测评|考试"), ("job_fair", "双选会|招聘会"), ("talk", "宣讲"), ("guidance", "指导|辅导"))
ONLINE = "线上|直播|空中宣讲|腾讯会议"
DAY = r"(20\d{2})[-/.年](\d{1,2})[-/.月](\d{1,2})"
CLOCK = r"(?<!\d)((?:[01]?\d|2[0-3]):[0-5]\d)"
EVENT = "struct<date:string,start_time:string,end_time:string,school:string,venue:string,status:string,event_type:string,mode:string>"


def talk_field(structured: Column, body: Column, name: str) -> Column:
    """A structured value, else the text after its label in the body; '' when there is neither."""
    key, label = KEYS[name]
    given = trimmed(F.regexp_replace(F.try_element_at(structured, F.lit(key)), spaced(r"\s+"), " "))
    said = trimmed(F.regexp_extract(F.coalesce(body, F.lit("")), spaced(rf"{label}\s*[：:]\s*([^\n]+)"), 1))
    return F.substring(F.coalesce(F.nullif(given, F.lit("")), said, F.lit("")), 1, 200)


def real_day(text: Column) -> Column:
    """``yyyy-MM-dd`` of the first date in a text; null for none and for days that do not exist."""
    part = lambda g, n: F.lpad(F.regexp_extract(text, DAY, g), n, "0")
    whole = F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2))
    return F.when(text.rlike(DAY) & F.try_to_timestamp(whole, F.lit("yyyy-MM-dd")).isNotNull(), whole)


def talk_event(title: Column, kind: Column, structured: Column, body: Column) -> Column:
    """Struct of an event, independent of work places and deadlines; null without a day or a school."""
    head = F.coalesce(title, F.lit(""))
    kinds = F.coalesce(*[F.when(head.rlike(p), n) for n, p in TYPES], F.when(kind == "宣讲会", "talk"), F.lit("unknown"))
    state = F.when(head.rlike(CANCELLED), "cancelled").otherwise("scheduled")
    ends = F.coalesce(F.try_element_at(structured, F.lit(KEYS["end"][0])), F.lit("")) != ""
    fields = F.struct(*[talk_field(structured, body, n).alias(n) for n in KEYS])

    def event(f: Column) -> Column:
        clocks = F.regexp_extract_all(f["end"], F.lit(CLOCK), F.lit(1))
        end = F.when(F.size(clocks) > 1, F.element_at(clocks, -1)).when(ends, F.get(clocks, F.lit(0)))
        day = real_day(f["date"])
        made = F.struct(
            day.alias("date"),
            F.nullif(F.regexp_extract(f["start"], CLOCK, 1), F.lit("")).alias("start_time"),
            end.alias("end_time"),
            F.substring(f["school"], 1, 80).alias("school"),
            f["venue"].alias("venue"),
            state.alias("status"),
            kinds.alias("event_type"),
            F.when(f["venue"].rlike(ONLINE), "online").when(f["venue"] != "", "offline").otherwise("unknown").alias("mode"),
        )
        return F.when(day.isNotNull() & (f["school"] != ""), made)

    return bound(fields, event)


def calendar_verification(event: Column, old_event: Column, old_title: Column, title: Column, old_verified: Column) -> Column:
    """H6: what an official list does to a record: ``ignored`` (no event, or nothing new beside a verified detail), ``kept`` (the detail stays, the event is new), or ``pending``."""
    gone = event.isNull() & ~(old_title.isNotNull() & F.coalesce(title, F.lit("")).rlike(CANCELLED))
    same = event.eqNullSafe(old_event) & old_title.eqNullSafe(title)
    verified = F.coalesce(old_verified, F.lit(False))
    return F.when(gone | (verified & same), "ignored").when(verified, "kept").otherwise("pending")


def date_label(date: Column, start: Column, end: Column) -> Column:
    """2026年3月5日 with its times."""
    day = F.concat(F.split(date, "-")[0], F.lit("年"), F.split(date, "-")[1].cast("int"), F.lit("月"), F.split(date, "-")[2].cast("int"), F.lit("日"))
    known = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.concat(day, F.when(known(start), F.concat(F.lit(" "), start, F.when(known(end), F.concat(F.lit("–"), end)).otherwise(""))).otherwise(""))


def scope_cities(scope: str | Sequence[str]) -> list[str]:
    """Cities of a scope; none means all."""
    return ([] if scope == "全部城市" else [scope]) if isinstance(scope, str) else list(scope)
