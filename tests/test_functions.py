"""Facts of fixture cases for time, text and fact rules."""

import pytest
from pyspark.sql import functions as F

from noticeframe.functions import facts, text, timeutil


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def ts(value):
    return F.lit(value).cast("timestamp")


VALIDITY = [
    (None, "2025-01-01T00:00:00+08:00", None, None, None, "2026-10-25 04:00:00", "unconfirmed"),
    ("2026-10-25", None, None, None, None, "2026-10-25 15:30:00", "unconfirmed"),
    ("2026-10-25", None, None, None, None, "2026-10-25 16:00:00", "closed"),
    (None, "2026-10-25T00:00:00+08:00", None, None, None, "2026-10-25 04:00:00", "unconfirmed"),
    (None, None, "open", True, "2026-10-24T00:00:00+08:00", "2026-10-25 04:00:00", "confirmed_open"),
    (None, "2026-10-25T00:00:00+08:00", "open", True, "2026-09-01T00:00:00+08:00", "2026-10-25 04:00:00", "unconfirmed"),
    (None, None, "open", True, "2026-10-27T00:00:00+08:00", "2026-10-25 04:00:00", "unconfirmed"),
    (None, None, "long_term", True, "2026-10-24T00:00:00+08:00", "2026-10-25 04:00:00", "long_term"),
    ("2026-11-01T23:59:00+08:00", None, "open", True, "2026-10-24T00:00:00+08:00", "2026-10-25 04:00:00", "confirmed_open"),
]


@pytest.mark.parametrize("deadline,verified_at,kind,verified,checked,now,expected", VALIDITY)
def test_validity_truth_table(spark, deadline, verified_at, kind, verified, checked, now, expected):
    s = lambda v: F.lit(v).cast("string")
    got = one(spark, facts.validity(s(deadline), s(None), s(kind), F.lit(verified).cast("boolean"), s(checked), s(verified_at), ts(now)))
    assert got == expected


def test_withdrawn_wins(spark):
    s = lambda v: F.lit(v).cast("string")
    got = one(spark, facts.validity(s(None), s("withdrawn"), s("long_term"), F.lit(True), s("2026-10-24T00:00:00+08:00"), s(None), ts("2026-10-25 04:00:00")))
    assert got == "closed"


@pytest.mark.parametrize(
    "value,expected",
    [("2026-02-30", None), ("", None), ("2026-10-25", "2026-10-25 15:59:59.999"), ("2026-10-25T08:00:00+08:00", "2026-10-25 00:00:00"), ("soon", None)],
)
def test_deadline_instant(spark, value, expected):
    got = one(spark, timeutil.deadline_instant(F.lit(value)).cast("string"))
    assert got == expected


@pytest.mark.parametrize(
    "name,expected",
    [
        ("北京 某某科技有限公司", "北京某某科技"),
        ("某某（中国）有限公司", "某某"),
        ("某某集团有限公司济南分公司", "某某济南分公司"),
        (None, ""),
        ("  ", ""),
    ],
)
def test_company_norm(spark, name, expected):
    assert one(spark, text.company_norm(F.lit(name).cast("string"))) == expected


@pytest.mark.parametrize("title,expected", [("【济南】某某2026年校园招聘公告", "某某2026"), ("某某招聘简章", "某某"), ("公告", "")])
def test_title_core(spark, title, expected):
    assert one(spark, text.title_core(F.lit(title))) == expected


@pytest.mark.parametrize(
    "title,excerpt,expected",
    [
        ("工程师\n6000-8000元", "", (6000.0, 8000.0, False)),
        ("工程师 (8k-15k)", "", (8000.0, 15000.0, False)),
        ("工程师 20000元以上", "", (20000.0, None, True)),
        ("工程师 15~18W/年", "", (12500.0, 15000.0, False)),
        ("工程师", "薪资：1万-2万", (10000.0, 20000.0, False)),
        ("工程师", "薪资：200-300元/天", None),
        ("工程师 2024-25", "", None),
        ("工程师", "", None),
    ],
)
def test_salary_range(spark, title, excerpt, expected):
    got = one(spark, facts.salary_range(F.lit(title), F.lit(excerpt)))
    assert (got and (got["min"], got["max"], got["open_ended"])) == expected


@pytest.mark.parametrize(
    "actual,wanted,unknown,expected",
    [("本科及以上", "硕士", False, True), ("本科及以上", "专科", False, False), ("硕士", "本科", False, False), ("", "本科", True, True), ("学历不限", "博士", False, True), ("研究生", "硕士", False, True), ("大专以上本科以下", "本科", False, True), (None, "本科", False, False)],
)
def test_education(spark, actual, wanted, unknown, expected):
    assert one(spark, facts.education_matches(F.lit(actual).cast("string"), wanted, unknown)) is expected


def test_change_kinds(spark):
    kind = lambda label, detail: one(spark, facts.deadline_change_kind(F.lit("deadline_extended"), F.lit(label), F.lit(detail), F.lit("2026-01-01")))
    assert kind("x", "延长至 2026-03-01（原截止时间：2026-02-01）") == "extended"
    assert kind("x", "延长至 2027-01-10（原截止时间：2027-01-05）") == "clarified"
    assert kind("明确截止时间", "") == "clarified"
    assert kind("截止调整", "") == "adjusted"


def test_text_helpers(spark):
    assert one(spark, text.trimmed_excerpt(F.lit("a" * 91))) == "a" * 89 + "…"
    assert one(spark, text.redacted(F.lit("a@b.co 13912345678"))) == "[email] [phone]"
    assert one(spark, text.plain_html(F.lit("<p>a&amp;b</p><script>x</script><p>c</p>"))) == "a&b\nc"
    assert one(spark, text.canonical(F.lit("Ａ  Ｂ"))) == "A B"
    assert one(spark, text.has_keyword(F.lit("use c++ and Go"), "go")) is True
    assert one(spark, text.has_keyword(F.lit("golang"), "go")) is False
    folded = one(spark, text.fold_lines(F.lit("汉" * 60)))
    assert all(len(x.encode()) <= 75 for x in folded.split("\r\n")) and folded.replace("\r\n ", "") == "汉" * 60
    assert one(spark, text.ics_escaped(F.lit("a;b,c\\d\ne"))) == "a\\;b\\,c\\\\d\\ne"
    assert one(spark, facts.graduation_years(F.lit("2026届、27届及2035届"))) == ["2026", "2027"]
