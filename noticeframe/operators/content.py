"""The whole content filter and what lies around it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import facts
from ..functions.majors import MajorProfile, matches_major
from ..functions.text import trimmed
from ..functions.timeutil import business_day, countdown, deadline_instant, expired, instant, recent
from ..functions.titles import job_types

# Supplementary offers, test records, places outside the mainland and words that take it in.
SUPPLEMENT = "补录|补招|追加|第[二两三]批|春招补录|秋招补录|续聘"
TEST_RECORD = "仅供测试使用|^测试(?:专业公司|岗位|职位)$"
OUTSIDE = "(?:香港|澳门)(?:分行|支行|子公司|分公司|代表处|地区|工作)|港澳地区"
MAINLAND = "国内|中国大陆|境内|内地|全国|各地可选|不限城市|各地招聘|各省市"
EXCLUDED_SOURCE, THIRD_PARTY, GENERAL = "sdei-civil-exams", "第三方线索", ("综合", "综合（高校 / 平台公告）", "单位性质未明确")
BOILERPLATE, READY = "招聘公告正文或附件内容已同步最新变动", "就绪|首次提取"


@dataclass(frozen=True)
class ContentFilters:
    """Content conditions; 全部, none and empty values ask nothing."""

    view: str = "all"
    show_expired: bool = False
    include_uncertain: bool = True
    include_unlimited_major: bool = False
    kind: str = "全部"
    provenance: str = "全部"
    location_scope: str = ""
    cities: tuple[str, ...] = ()
    validity: str = "all"
    employment: str = "all"
    type: str = "全部"
    year: str = "全部"
    sector: str = "全部"
    direction: str = "全部"
    education: str = ""
    min_salary: float = 0
    change: str = "全部"
    focus: str = "none"
    since: str | None = None
    only_new: bool = False
    keywords: tuple[str, ...] = ()


def text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def recent_change(now: Column) -> Column:
    """a recent change that is neither a first position table nor boilerplate."""
    c = F.col("recent_change")
    words = F.concat(F.coalesce(c["label"], F.lit("")), F.coalesce(c["detail"], F.lit("")))
    first_table = (c["label"] == "岗位表就绪") | ((c["type"] == "positions_updated") & words.rlike(READY))
    return F.coalesce(c.isNotNull() & ~F.coalesce(first_table, F.lit(False)) & ~F.coalesce(c["detail"] == BOILERPLATE, F.lit(False)) & recent(c["date"], now), F.lit(False))


def change_matches(wanted: str, stage: Column, now: Column) -> Column:
    """kinds of recent change: by the change itself, or by a stage of a row that is recent itself."""
    c = F.col("recent_change")
    fresh = F.coalesce(recent(c["date"], now), F.lit(False))
    recent_row = recent(F.coalesce("updated_at", "published_at", "first_seen_at"), now)
    kind = facts.deadline_change_kind(c["type"], c["label"], c["detail"], c["date"])
    by = {
        "有变更": recent_change(now),
        "截止延期": ((stage == "extended") & recent_row) | ((kind == "extended") & fresh),
        "补录招募": ((stage == "supplemental") & recent_row) | ((c["type"] == "supplemental") & fresh),
        "岗位调整": (c["type"] == "positions_updated") & fresh,
        "考核阶段": ((stage == "selection") & recent_row) | ((c["type"] == "selection_stage") & fresh),
    }
    return F.coalesce(by[wanted], F.lit(False)) if wanted in by else F.lit(True)


def focus_matches(focus: str, now: Column) -> Column:
    """today, supplement, urgent or change."""
    today = F.date_format(F.from_utc_timestamp(now, "+08:00"), "yyyy-MM-dd")
    c = F.col("recent_change")
    boost = F.when(facts.substantive_change(c["type"], c["label"], c["detail"], c["date"]), business_day(c["date"]))
    by = {
        "today": (business_day(text("published_at")) == today) | (business_day(text("first_seen_at")) == today) | F.coalesce(boost == today, F.lit(False)),
        "supplement": text("title").rlike(SUPPLEMENT) | F.coalesce(c["type"] == "supplemental", F.lit(False)) | (text("stored_stage") == "supplemental"),
        "urgent": F.coalesce(countdown(text("deadline"), now) == "urgent", F.lit(False)),
        "change": recent_change(now),
    }
    return by.get(focus, F.lit(True))


def outside_mainland(cities: Column, header: Column) -> Column:
    """No city, and a header that names only places outside the mainland."""
    return (F.coalesce(F.size(cities), F.lit(0)) <= 0) & header.rlike(OUTSIDE) & ~header.rlike(MAINLAND)


def header_text() -> Column:
    return F.concat_ws(" ", text("company"), text("title"), F.array_join(F.coalesce("location_evidence", F.array().cast("array<string>")), " "))


def content_predicate(f: ContentFilters, now: Column, stage: Column | None = None, location: Column | None = None, talk_near: Column | None = None, majors: Sequence[MajorProfile] = ()) -> Column:
    """conjunction over the opportunity columns, cheap tests first; ``location`` is a row's scope for the wanted cities.

    Conditions on education, majors, cities and year hold for one and the same position where a row has positions.
    ``stage`` is the row's lifecycle stage, ``talk_near`` whether a coming talk lies in a wanted city.
    """
    stage = F.coalesce(stage if stage is not None else F.col("stage"), F.lit(""))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    has = lambda c, v: F.coalesce(F.array_contains(c, v), F.lit(False))
    unsure = F.lit(f.include_uncertain)
    tests: list[Column] = []
    if f.view == "all":
        tests += [F.col("talk_attached_to").isNull(), (text("domestic_status") != "overseas") & ~outside_mainland(F.col("cities"), header_text())]
    if not f.show_expired:
        tests.append(~(expired(text("deadline"), now) | (text("listing_status") == "withdrawn")))
    if f.kind != "全部":
        tests.append(text("kind") == f.kind)
    if f.provenance in ("高校 / 政府", THIRD_PARTY):
        tests.append((text("provenance") == THIRD_PARTY) if f.provenance == THIRD_PARTY else (text("provenance") != THIRD_PARTY))
    if f.location_scope and location is not None:
        near = F.coalesce(talk_near, F.lit(False)) if talk_near is not None and f.location_scope == "exact" else F.lit(False)
        tests.append((location == f.location_scope) | near)
    if f.validity != "all":
        kind, sure = F.col("availability.kind"), F.col("availability.verified")
        tests.append(facts.validity(text("deadline"), F.col("listing_status"), kind, sure, F.col("listing_checked_at"), F.col("last_verified_at"), now) == f.validity)
    if f.employment != "all":
        tests.append((text("employment_type") == f.employment) | (unsure & text("employment_type").isin("", "unknown")))
    no_rows = empty("positions")
    year = f.year if f.type == "校招" else "全部"
    if f.education or majors or f.cities or f.year != "全部":
        tests.append(no_rows | F.coalesce(F.exists("positions", lambda p: position_matches(p, f, year, majors)), F.lit(False)))
    if majors:
        tests.append(~no_rows | matches_major(F.col("majors"), F.col("title"), majors, f.include_unlimited_major))
    types = job_types(F.col("types"), F.col("kind"), F.col("source_id"))
    if f.type != "全部":
        tests.append(has(types, f.type) | (unsure & (F.size(types) == 0)))
    if year != "全部":
        tests.append(~no_rows | has("graduation_years", year) | (unsure & empty("graduation_years")))
    if f.sector in GENERAL:
        tests.append(F.forall(F.coalesce("sectors", F.array().cast("array<string>")), lambda s: s.isin(*GENERAL)))
    elif f.sector != "全部":
        tests.append(has("sectors", f.sector))
    if f.direction != "全部":
        tests.append(has("directions", f.direction))
    if f.education:
        tests.append(~no_rows | facts.education_matches(F.col("education"), f.education, f.include_uncertain))
    if f.min_salary:
        pay = facts.salary_range(F.col("title"), F.col("excerpt"))
        tests.append(F.coalesce(pay["open_ended"] | (pay["max"] >= f.min_salary), F.lit(False)))
    tests += [change_matches(f.change, stage, now), focus_matches(f.focus, now)]
    tests += [F.contains(text("search_text"), F.lit(k.lower())) for k in f.keywords]
    if f.only_new:
        since = F.lit(f.since).cast("timestamp")
        tests.append(F.lit(f.since is not None) & F.coalesce((instant(F.col("first_seen_at")) > since) | (instant(F.col("updated_at")) > since), F.lit(False)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def position_matches(p: Column, f: ContentFilters, year: str, majors: Sequence[MajorProfile]) -> Column:
    """the conditions that one position must meet together."""
    unsure = F.lit(f.include_uncertain)
    city, cohort = F.coalesce(p["city"], F.lit("")), F.coalesce(p["cohort"], F.lit(""))
    tests = [facts.education_matches(p["education"], f.education, f.include_uncertain)]
    if f.cities:
        tests.append(reduce(lambda a, c: a | F.contains(city, F.lit(c)), f.cities, unsure & (city == "")))
    if year != "全部":
        tests.append(F.contains(cohort, F.lit(year)) | (unsure & (cohort == "")))
    if majors:
        tests.append(matches_major(p["majors"], p["name"], majors, f.include_unlimited_major))
    return reduce(lambda a, b: a & b, tests)


def scope_counts(df: DataFrame, rest: Column, location: Column, talk_near: Column) -> DataFrame:
    """Rows by scope in one scan; a row with a coming talk counts as exact besides its own scope."""
    kept = df.where(rest)
    return kept.agg(F.count_if((location == "exact") | F.coalesce(talk_near, F.lit(False))).alias("exact"), F.count_if(location == "possible").alias("possible"), F.count_if(location == "unknown").alias("unknown"))


def mart_excluded(snapshot: Column) -> Column:
    """rows that the mart leaves out: gone, attached, of the civil-exam source, overseas, tests, cancelled talks, past deadlines."""
    name, head, source = trimmed(text("company")), trimmed(text("title")), text("source_id")
    talk = (text("kind") == "宣讲会") | source.endswith("-talks")
    return (
        (text("listing_status") == "withdrawn")
        | F.col("talk_attached_to").isNotNull()
        | (source == EXCLUDED_SOURCE)
        | (text("domestic_status") == "overseas")
        | name.rlike(TEST_RECORD)
        | head.rlike(TEST_RECORD)
        | outside_mainland(F.col("cities"), header_text())
        | (talk & F.coalesce(F.col("talk_status") == "cancelled", F.lit(False)))
        | F.coalesce(deadline_instant(text("deadline")) < snapshot, F.lit(False))
    )


def benchmark_preset(location: Column, as_of: Column, kind: str = "校招", year: str = "2027", include_uncertain: bool = True) -> Column:
    """at home, exactly located, open, and of the preset's type and class, or without any if that is allowed."""
    said = lambda c, v: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.array_contains(c, v)).otherwise(F.lit(include_uncertain))
    gone = (text("listing_status") == "withdrawn") | F.coalesce(instant(F.col("deadline")) < as_of, F.lit(False))
    return (text("domestic_status") != "overseas") & (location == "exact") & ~gone & said("types", kind) & said("graduation_years", year)


def unread(updated_at: Column, read_at: Column) -> Column:
    """never read, or changed since."""
    return F.coalesce(read_at.isNull() | (updated_at > read_at), F.lit(False))


def pending_application(saved: Column, applied: Column, hidden: Column, past: Column) -> Column:
    """saved, not applied for, not hidden and not past."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return yes(saved) & ~yes(applied) & ~yes(hidden) & ~yes(past)


def pending_order(deadline: Column, key: Column) -> list[Column]:
    """By deadline, unknown last, then by id."""
    return [deadline_instant(deadline).asc_nulls_last(), key.asc()]


def reputation_filter(rows: DataFrame, scores: DataFrame | None, on: str, minimum: float = 0, include_unrated: bool = True) -> DataFrame:
    """rows with a score of at least ``minimum``; a missing index removes nothing. Adds ``score``."""
    if scores is None:
        return rows.withColumn("score", F.lit(None).cast("double"))
    joined = rows.join(scores.select(on, "score"), on, "left")
    return joined.where(F.coalesce(F.col("score") >= minimum, F.lit(include_unrated))) if minimum else joined


def score_order(score: str, order: str) -> list[Column]:
    """Best score first, unrated last, else the order there was."""
    return [F.coalesce(F.col(score), F.lit(-1)).desc(), F.col(order).asc()]


def hidden_by_parent(rows: DataFrame, key: str, parent: str, hidden: str) -> DataFrame:
    """A related row is hidden with its parent."""
    p = rows.where(F.col(hidden)).select(F.col(key).alias("_parent"), F.lit(True).alias("_gone"))
    return rows.join(p, F.col(parent) == F.col("_parent"), "left").withColumn(hidden, F.col(hidden) | F.coalesce("_gone", F.lit(False))).drop("_parent", "_gone")


def own_posts(posts: DataFrame, company: str, tagged: str) -> DataFrame:
    """Posts that are tagged with no other company."""
    return posts.where(F.col(tagged).isNull() | (F.col(tagged).cast("string").isin("", "0")) | (F.col(tagged).cast("string") == F.col(company).cast("string")))


def possible_cities(named: Column, sure: Column) -> Column:
    """Cities that a text names besides the sure ones."""
    return F.array_except(named, sure)


def set_changes(old: Column, new: Column, limit: int | None = None) -> Column:
    """struct(added, removed) of two lists, in order of value."""
    side = lambda a, b: F.array_sort(F.array_except(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))
    cut = lambda c: F.slice(c, 1, limit) if limit else c
    return F.struct(cut(side(new, old)).alias("added"), cut(side(old, new)).alias("removed"))
