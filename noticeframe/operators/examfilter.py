"""The exam filter, its category aliases and its query terms."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category names of the filter, with the stored categories and permanent-post labels each stands for.
CATEGORIES = {
    "公务员国考": (("国考",), ("公务员国考",), ()),
    "公务员省考": (("省考",), ("公务员省考",), ()),
    "选调生招录": (("选调生",), ("选调生招录",), ("选调生",)),
    "事业单位": ((), ("事业单位统考", "事业单位单招"), ("事业编", "控制总量 / 备案制")),
    "教师公开招聘": (("教师",), ("教师公开招聘",), ("教师编",)),
    "医疗卫生招聘": (("医疗卫生",), ("医疗卫生招聘",), ("医疗卫生编",)),
    "高校 / 科研院所": (("高校科研",), ("高校 / 科研院所",), ()),
    "人才引进 / 优才": (("人才引进",), ("人才引进 / 优才",), ("高层次 / 紧缺人才",)),
    "军队文职招考": (("军队文职",), ("军队文职招考",), ("军队文职",)),
    "三支一扶 / 基层": (("三支一扶",), ("三支一扶 / 基层",), ("三支一扶 / 基层项目",)),
}
# Stages behind each choice of the filter.
STAGES = {
    "可报名/进行中": ("upcoming", "registering", "closing_soon", "rolling", "payment_confirm", "admit_exam", "interview_review"),
    "正在报名": ("registering", "closing_soon"),
    "即将开始": ("upcoming",),
    "长期招聘": ("rolling",),
    "时间待确认": ("unknown",),
    "考务跟进（笔面试/资审）": ("payment_confirm", "admit_exam", "interview_review", "publicity"),
    "报名已结束": ("ended",),
}
TERMINAL = ("failed_audit", "not_shortlisted", "withdrawn")


@dataclass(frozen=True)
class ExamFilters:
    """Conditions over exams; 全部 and empty values ask nothing."""

    view: str = "all"
    cities: tuple[str, ...] = ()
    category: str = "全部"
    bianzhi: str = "全部"
    subject: str = "全部"
    stage: str = "全部"
    notice_role: str = "全部"
    unlimited_major: bool = False
    fresh_graduate: bool = False
    query: str = ""


def query_terms(query: str) -> list[str]:
    """Lower-case terms, split also at Chinese separators."""
    return [t for t in re.split(r"[\s,，、;/；]+", query.strip().lower()) if t]


def category_matches(category: Column, labels: Column, wanted: str) -> Column:
    """F16: the stored category, or a label, that the wanted name stands for; other names mean themselves."""
    for name, (aliases, stored, kinds) in CATEGORIES.items():
        if wanted == name or wanted in aliases:
            hit = F.coalesce(category.isin(*stored), F.lit(False))
            return hit | F.coalesce(F.arrays_overlap(labels, F.array(*map(F.lit, kinds))), F.lit(False)) if kinds else hit
    return F.lit(True) if wanted in ("", "全部") else F.coalesce(category == wanted, F.lit(False))


def city_matches(cities: Column, level: Column, province: Column, positions: Column, wanted: tuple[str, ...]) -> Column:
    """F16: any wanted city; 山东省直 and 全国 also stand for a level; a position's city counts."""

    def one(city: str) -> Column:
        listed = F.coalesce(F.array_contains(cities, city), F.lit(False))
        if city == "山东省直":
            return listed | F.coalesce((level == "省级") & (province == "山东"), F.lit(False))
        if city == "全国":
            return listed | F.coalesce(level == "国家级", F.lit(False))
        return listed | F.coalesce(F.exists(positions, lambda p: F.contains(F.coalesce(p["city"], F.lit("")), F.lit(city))), F.lit(False))

    asked = [c for c in wanted if c and c != "全部"]
    return reduce(lambda a, b: a | b, map(one, asked)) if asked else F.lit(True)


def exam_predicate(f: ExamFilters, eligible: Column | None = None) -> Column:
    """F16: conjunction over exam columns; ``eligible`` says whether a position may suit the profile.

    Columns: title, organizer, exam_category, bianzhi_types, cities, exam_subjects, majors, excerpt, stage, notice_role, region_level,
    province, fresh_grad_summary, has_unlimited_major, positions (department, employer, position_name, position_code, major_raw, city,
    fresh_grad_rule), and the user's saved, saved_positions, status, hidden.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = F.coalesce(F.size("positions"), F.lit(0)) > 0
    some = lambda test: F.coalesce(F.exists("positions", test), F.lit(False))
    views = {"saved": flag("saved") | (F.coalesce(F.size("saved_positions"), F.lit(0)) > 0), "tracker": ~text("status").isin("", "none")}
    tests = [views.get(f.view, ~flag("hidden")), city_matches(F.col("cities"), F.col("region_level"), F.col("province"), F.col("positions"), f.cities)]
    tests.append(category_matches(F.col("exam_category"), F.col("bianzhi_types"), f.category))
    if f.bianzhi != "全部":
        tests.append(F.coalesce(F.array_contains("bianzhi_types", f.bianzhi), F.lit(False)))
    if f.subject != "全部":
        tests.append(F.contains(F.coalesce(F.array_join("exam_subjects", " "), F.lit("")), F.lit(f.subject)))
    if f.stage in STAGES:
        tests.append(text("stage").isin(*STAGES[f.stage]))
    if f.notice_role in ("仅看招考简章", "考务进展通知"):
        notice = text("notice_role") == "招考简章"
        tests.append(notice if f.notice_role == "仅看招考简章" else ~notice)
    if f.unlimited_major:
        tests.append(some(lambda p: F.contains(F.coalesce(p["major_raw"], F.lit("")), F.lit("不限"))) | (~rows & flag("has_unlimited_major")))
    if f.fresh_graduate:
        said = F.concat_ws("\n", "fresh_grad_summary", "title").rlike("应届|毕业生|选调")
        tests.append((text("exam_category") == "选调生招录") | said | some(lambda p: F.coalesce(p["fresh_grad_rule"], F.lit("")).rlike("应届|毕业生")))
    if terms := query_terms(f.query):
        lists = [F.array_join(c, " ") for c in ("bianzhi_types", "cities", "exam_subjects", "majors")]
        inner = F.array_join(F.transform("positions", lambda p: F.concat_ws(" ", p["department"], p["employer"], p["position_name"], p["position_code"], p["major_raw"])), " ")
        hay = F.lower(F.concat_ws(" ", "title", "organizer", "exam_category", *lists, "excerpt", inner))
        tests += [F.contains(hay, F.lit(t)) for t in terms]
    if eligible is not None:
        tests.append(~rows | eligible)
    return reduce(lambda a, b: a & b, tests)


def tracked_to_an_end(status: Column) -> Column:
    """A tracked application that goes no further."""
    return F.coalesce(status.isin(*TERMINAL), F.lit(False))
