"""Rules that derive facts from notice fields, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, spaced, trimmed
from .timeutil import DAY_ONLY, business_day, expired, instant

# Ranks of education levels and the words that name them.
EDUCATION_RANKS = {"专科": 1, "大专": 1, "本科": 2, "硕士": 3, "博士": 4}
EDUCATION_WORDS = ("大专|专科|高职", "本科|学士", "硕士", "博士")
EDUCATION_UNKNOWN = ("", "未明确", "未明确 / 见原公告", "学历待核实", "学历待确认", "招聘条件待核实")
SUPPLEMENT = "补录|补招|追加|第[二两三]批|续聘"
SELECTION = "(?:笔试|面试|初试|复试).*(?:安排|通知|名单|公示|复审)|(?:拟录用|录取公示|录用名单)"
LONG_TERM = "长期|常态|常年|招满为止"
# The text of a deadline that was moved, and what a stated or adjusted deadline is called.
MOVED = spaced(r"延长至\s*(\d{4}-\d{2}-\d{2})[^\d（(]*[（(]原截止时间[:：]\s*(\d{4}-\d{2}-\d{2})")
CLARIFIED, ADJUSTED = ("明确截止时间", "明确报名截止时间"), ("截止调整", "报名截止时间调整为")


def first_label(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first rule whose pattern occurs."""
    out = reduce(lambda c, r: c.when(text.rlike(r[1]), r[0]), rules[1:], F.when(text.rlike(rules[0][1]), rules[0][0]))
    return out.otherwise(F.lit(default))


def all_labels(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Labels of all rules whose pattern occurs, in rule order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(label)) for label, p in rules]))


def education_matches(actual: Column, wanted: str, include_unknown: bool) -> Column:
    """F8: equal level, or within the range that 及以上 / 以下 open."""
    if not wanted or wanted in ("全部", "不限"):
        return F.lit(True)
    clean = trimmed(
        F.regexp_replace(
            F.regexp_replace(F.regexp_replace(F.coalesce(actual, F.lit("")), spaced(r"(?:20)?\d{2}\s*届(?:[\s,/、，|-]*(?:20)?\d{2}\s*届)*"), ""), spaced(r"\s+"), " "),
            spaced(r"^[\s,/、，|-]+|[\s,/、，|-]+$"),
            "",
        )
    )
    has = [clean.rlike(w) for w in EDUCATION_WORDS]
    graduate = clean.rlike("研究生") & ~has[2] & ~has[3]
    levels = F.array_compact(F.array(F.when(has[0], 1), F.when(has[1], 2), F.when(has[2] | graduate, 3), F.when(has[3] | graduate, 4)))
    rank = EDUCATION_RANKS.get(wanted)
    named = F.contains(clean, F.lit(wanted))
    if rank is None:
        ranged = named
    else:
        above, below = clean.rlike("及以上|以上|起"), clean.rlike("及以下|以下")
        low, high = F.array_min(levels), F.array_max(levels)
        ranged = (
            F.when(F.size(levels) == 0, named)
            .when(F.array_contains(levels, rank), True)
            .when(above & below, (F.lit(rank) >= low) & (F.lit(rank) <= high))
            .when(above, F.lit(rank) >= low)
            .when(below, F.lit(rank) <= high)
            .otherwise(False)
        )
    return F.when(clean.isin(*EDUCATION_UNKNOWN), F.lit(include_unknown)).when(clean.rlike("不限"), True).otherwise(ranged)


def validity(deadline: Column, listing_status: Column, kind: Column, verified: Column, checked_at: Column, last_verified_at: Column, now: Column, fresh_days: int = 30) -> Column:
    """P25: closed, long_term, confirmed_open or unconfirmed."""
    checked = F.coalesce(F.nullif(checked_at, F.lit("")), last_verified_at)
    age = F.unix_millis(now) - F.unix_millis(instant(checked))
    sure = F.coalesce(verified, F.lit(False))
    return (
        F.when((F.coalesce(listing_status, F.lit("")) == "withdrawn") | expired(deadline, now), "closed")
        .when(sure & (kind == "long_term"), "long_term")
        .when(sure & (kind == "open") & (age >= 0) & (age <= fresh_days * 86_400_000), "confirmed_open")
        .otherwise("unconfirmed")
    )


def rolling_deadline(change_date: Column, detail: Column) -> Column:
    """A far deadline moved on by days, as pages with a rolling horizon do."""
    new, old = (F.try_to_timestamp(F.regexp_extract(detail, MOVED, g), F.lit("yyyy-MM-dd")).cast("date") for g in (1, 2))
    changed = F.try_to_timestamp(business_day(change_date), F.lit("yyyy-MM-dd")).cast("date")
    far = (F.datediff(new, changed) >= 330) & (F.datediff(old, changed) >= 300) & (F.datediff(new, old) <= 14)
    return F.coalesce(detail.rlike(MOVED) & far, F.lit(False))


def deadline_change_kind(kind: Column, label: Column, detail: Column, date: Column) -> Column:
    """Extended, clarified or adjusted; null for other changes."""
    text = F.coalesce(detail, F.lit(""))
    return F.when(
        kind == "deadline_extended",
        F.when((label == CLARIFIED[0]) | text.startswith(CLARIFIED[1]), "clarified")
        .when((label == ADJUSTED[0]) | text.startswith(ADJUSTED[1]), "adjusted")
        .when(rolling_deadline(date, text), "clarified")
        .otherwise("extended"),
    )


def substantive_change(kind: Column, label: Column, detail: Column, date: Column) -> Column:
    """P20: changes that put a notice back at the top."""
    text, words = F.coalesce(detail, F.lit("")), F.concat(F.coalesce(label, F.lit("")), F.coalesce(detail, F.lit("")))
    return F.coalesce(
        F.when(kind == "supplemental", True)
        .when(kind == "deadline_extended", deadline_change_kind(kind, label, detail, date) == "extended")
        .when(kind == "positions_updated", ~words.rlike("就绪|首次提取|缩减|减少") & ~text.rlike("为 0 个职位"))
        .when(kind == "content_updated", (label == "地点调整") & text.rlike("新增") & ~text.rlike("补全")),
        F.lit(False),
    )


def lifecycle_stage(title: Column, deadline: Column, listing_status: Column, change_kind: Column, selection: Column, now: Column) -> Column:
    """The first that holds. The three-day test reads a bare day as midnight UTC, as a kept quirk."""
    listed = F.coalesce(listing_status, F.lit(""))
    ahead = F.ceil((F.unix_millis(instant(deadline)) - F.unix_millis(now)) / 86_400_000)
    return (
        F.when(listed == "withdrawn", "expired")
        .when(listed == "unconfirmed", "unconfirmed")
        .when(expired(deadline, now), "expired")
        .when(selection, "selection")
        .when((change_kind == "extended") | title.rlike("延长|延期|推迟"), "extended")
        .when(title.rlike(SUPPLEMENT) | (change_kind == "supplemental"), "supplemental")
        .when(F.coalesce(ahead.between(0, 3), F.lit(False)), "expiring_soon")
        .otherwise("accepting")
    )


def healed_publication(published: Column, first_seen: Column, timeline_days: Column, now: Column) -> Column:
    """No future days; a day after the first sighting falls back to the earliest published event, else that sighting."""
    day, seen = business_day(F.coalesce(published, F.lit(""))), business_day(F.coalesce(first_seen, F.lit("")))
    today = F.date_format(F.from_utc_timestamp(now, "+08:00"), "yyyy-MM-dd")
    earliest = F.array_min(F.filter(F.coalesce(timeline_days, F.array().cast("array<string>")), lambda d: d.rlike(DAY_ONLY) & (d <= seen)))
    return F.when((day == "") | (day > today), "").when((seen != "") & (day > seen), F.coalesce(earliest, seen)).otherwise(day)


def effective_day(published_day: Column, substantive: Column, change_day: Column, today: Column) -> Column:
    """P20: the later of publication and substantive change not after today."""
    boost = F.when(substantive & (change_day != "") & (change_day <= today), change_day).otherwise("")
    return F.greatest(published_day, boost)


def graduation_years(text: Column, first: int = 2024, last: int = 2030) -> Column:
    """Years named as graduating classes, ascending."""
    long = F.regexp_extract_all(text, F.lit(spaced(r"(20\d{2})\s*(?:届|应届|年应届|年(?:高校)?毕业)")), F.lit(1))
    short = F.transform(F.regexp_extract_all(text, F.lit(spaced(r"(?<!\d)(2\d)\s*届")), F.lit(1)), lambda y: F.concat(F.lit("20"), y))
    return F.array_sort(F.array_distinct(F.filter(F.concat(long, short), lambda y: y.between(str(first), str(last)))))


def salary_range(title: Column, excerpt: Column) -> Column:
    """struct(min, max, open_ended, raw) per month, or null.

    The title's end is read first, then a labelled pay in the excerpt. Units k and 万/w scale; yearly
    pay, or 万 from 6 up without a monthly word, is divided by twelve. Daily, hourly and foreign pay
    and ranges that look like calendar years give null. An open upper end is a null max with a flag.
    """
    number, unit = spaced(r"(\d+(?:\.\d+)?)\s*(k|K|万|w|W|元)?"), spaced(r"\s*[-~至–]\s*")
    ends = {
        "title_range": (title, spaced(rf"[（(\n\s]{number}{unit}{number}(?:·\d+薪)?(?:元|/月|/年|/天|人民币)?[)）\s]*$")),
        "title_above": (title, spaced(rf"[（(\n\s]{number}\s*(?:以上|及以上)[)）\s]*$")),
    }
    label = F.regexp_extract(F.coalesce(excerpt, F.lit("")), spaced(r"薪资(?:待遇)?[:：]\s*([^\s,，;；\n*]+)"), 1)
    ends |= {"label_range": (label, rf"{number}{unit}{number}"), "label_above": (label, spaced(rf"{number}\s*(?:以上|及以上)"))}

    def parsed(name: str) -> Column:
        text, pattern = ends[name]
        text, above = F.coalesce(text, F.lit("")), name.endswith("above")
        amount = lambda said: F.try_to_number(said, F.lit("9999999999.99")).cast("double")
        parts = F.array(*[F.regexp_extract(text, pattern, g) for g in range(3 if above else 5)])

        def numbers(part: Column) -> Column:
            return F.struct(
                part[0].alias("raw"), amount(part[1]).alias("low"), amount(part[1 if above else 3]).alias("high"),
                (part[2] if above else F.when(part[4] != "", part[4]).otherwise(part[2])).alias("unit"),
            )

        def value(n: Column) -> Column:
            low, high, wan = n["low"], n["high"], n["unit"].rlike("^[万wW]$")
            scale = F.when(wan, 10000.0).when(n["unit"].rlike("^[kK]$"), 1000.0).otherwise(1.0)
            monthly, yearly = text.rlike("/月|月薪|每月"), text.rlike("/年|年薪") | n["raw"].rlike("年")
            factor = F.when(yearly | (wan & ~monthly & (low >= 6)), scale / 12).otherwise(scale)
            year_like = F.lit(False) if above else (low >= 2010) & (low <= 2030) & (high < 100)
            shown = lambda f: F.struct(
                F.round(low * f).alias("min"),
                (F.lit(None).cast("double") if above else F.round(high * f)).alias("max"),
                F.lit(above).alias("open_ended"),
                trimmed(n["raw"]).alias("raw"),
            )
            good = lambda f: ~text.rlike("(?i)/天|/日|/小时|日薪|时薪|美元|港币|USD|HKD") & (high * f >= 1000) & ~year_like
            return bound(factor, lambda f: F.struct(F.when(good(f), shown(f)).alias("v")))

        return F.when(text.rlike(pattern), bound(bound(parts, numbers), value))

    return F.coalesce(*[parsed(n) for n in ends])["v"]


def city_scope(city: str, province: str, cities: Column, detail: Column, other_city: Column) -> Column:
    """Exact, possible, unknown or none for one wanted city."""
    if city == "全部城市":
        return F.lit("exact")
    text = F.coalesce(detail, F.lit(""))
    return (
        F.when(F.array_contains(cities, city) | F.contains(text, F.lit(city)), "exact")
        .when(text.rlike(spaced(rf"{province}省?(?:$|[、,，;；。\s]|各地|全省|不限)")), "possible")
        .when(other_city, "none")
        .when(text.rlike("全国|不限城市|各地"), "possible")
        .when(F.size(cities) > 0, "none")
        .otherwise("unknown")
    )


def verdict(conflicts: Column, unknowns: Column) -> Column:
    """ineligible with any conflict, else unknown with any unknown, else eligible."""
    return F.when(F.size(conflicts) > 0, "ineligible").when(F.size(unknowns) > 0, "unknown").otherwise("eligible")


