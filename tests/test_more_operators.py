"""Exam, place, employer, title and publication rules on literal cases."""

import pytest
from pyspark.sql import functions as F

from noticeframe.functions import exams, titles
from noticeframe.operators import employers, places, publish


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "title,category,role",
    [
        ("2026年度国家公务员招考公告", "公务员国考", "招考简章"),
        ("某市教育系统公开招聘教师公告", "教师公开招聘", "招考简章"),
        ("某大学公开招聘工作人员", "高校 / 科研院所", "招考简章"),
        ("某大学毕业生招聘", "事业单位单招", "招考简章"),
        ("某医院招聘笔试成绩查询", "医疗卫生招聘", "成绩/进面"),
        ("某局面试时间通知", "事业单位单招", "资格复审/面试"),
    ],
)
def test_exam_classes(spark, title, category, role):
    assert one(spark, exams.category(F.lit(title), F.lit(""))) == category
    assert one(spark, exams.notice_role(F.lit(title))) == role


def test_exam_schedule_and_stage(spark):
    body = "报名时间：2026年3月18日9:00—3月22日16:00。缴费时间：3月20日至24日；笔试时间：2026年4月11日！"
    s = exams.schedule(F.lit(body), F.lit("2026-03-01"))
    got = one(spark, s)
    assert (got.reg_start, got.reg_end, got.payment_end, got.written_exam_date) == ("2026-03-18", "2026-03-22", "2026-03-24", "2026-04-11")
    stage = lambda day: one(spark, exams.stage(s, F.lit("招考简章"), F.lit("2026-03-01"), day))
    assert [stage(d) for d in ("2026-03-10", "2026-03-18", "2026-03-21", "2026-03-23", "2026-04-01", "2026-05-01")] == ["upcoming", "registering", "closing_soon", "payment_confirm", "admit_exam", "ended"]
    step = one(spark, exams.next_step(s, "2026-03-23"))
    assert (step.step, step.days_left) == ("payment_end", 1)


ROW = dict(education="本科及以上", degree="学士", political_status="中共党员", fresh_grad_rule="不限", other_conditions="", hukou_rule="不限", major_raw="计算机类", majors=[], age_limit="35周岁及以下")


@pytest.mark.parametrize(
    "profile,change,status,conflicts",
    [
        (exams.Profile(education="本科", has_degree=True, political="中共党员", majors=("计算机",), birth_year=2000), {}, "eligible", []),
        (exams.Profile(education="专科", political="群众"), {}, "ineligible", ["education", "political"]),
        (exams.Profile(education="本科", majors=("法学",)), {"major_raw": "详见附件"}, "unknown", []),
        (exams.Profile(education="本科", birth_year=1980), {}, "ineligible", ["age"]),
        (exams.Profile(education="本科", birth_year=1990), {"age_limit": "30周岁及以下，高级职称40周岁及以下"}, "unknown", []),
        (exams.Profile(education="本科", grassroots_years=1), {"other_conditions": "需两年以上基层工作经历"}, "ineligible", ["grassroots"]),
        (exams.Profile(education="本科", hukou="省外"), {"hukou_rule": "限山东省户籍"}, "ineligible", ["hukou"]),
        (exams.Profile(education="本科", graduate="在职/社会人员"), {"fresh_grad_rule": "2026届应届毕业生"}, "ineligible", ["graduate"]),
    ],
)
def test_eligibility(spark, profile, change, status, conflicts):
    df = spark.createDataFrame([tuple({**ROW, **change}.values())], "education string, degree string, political_status string, fresh_grad_rule string, other_conditions string, hukou_rule string, major_raw string, majors array<string>, age_limit string")
    got = df.select(exams.eligibility(profile).alias("x")).first().x
    assert (got.status, got.conflicts) == (status, conflicts)


CITIES = {"济南": ["济南"], "佛山": ["佛山"], "吉林": ["吉林"], "上海": ["上海"], "朝阳": ["朝阳", "北京"], "四平": ["四平"]}


@pytest.mark.parametrize("text,expected", [("济南、上海", ["上海", "济南"]), ("千佛山", []), ("吉林省长春", []), ("吉林市", ["吉林"]), ("朝阳", []), (None, [])])
def test_places(spark, text, expected):
    assert one(spark, places.named_places(F.lit(text).cast("string"), CITIES)) == expected


def test_counties_only_without_cities(spark):
    counties = {"章丘": ["济南"]}
    assert one(spark, places.places_or_counties(F.lit("章丘"), CITIES, counties)) == ["济南"]
    assert one(spark, places.places_or_counties(F.lit("上海章丘路"), CITIES, counties)) == ["上海"]
    assert one(spark, places.coded_places(F.lit("代码370100，"), {"370100": "济南"})) == ["济南"]


def test_event_places(spark):
    rules = spark.createDataFrame([("r1", "甲大学", "中心校区", "济南"), ("r2", "甲大学", "南校区", "上海")], "rule_id string, rule_school string, pattern string, city string")
    events = spark.createDataFrame([(1, "甲大学", "中心校区101"), (2, "甲大学", "线上直播"), (3, "甲大学", "中心校区 上海厅"), (4, "乙大学", "礼堂"), (5, "乙大学", "济南宾馆"), (6, "甲大学", "中心校区南校区")], "id long, school string, venue string")
    got = {r.id: (r.city, r.method) for r in places.resolved_events(events, rules, "id", "school", "venue", CITIES).collect()}
    assert got == {1: ("济南", "campus"), 2: (None, "online"), 3: (None, "conflicting_locations"), 4: (None, "unverified_venue"), 5: ("济南", "explicit"), 6: (None, "conflicting_locations")}


def test_employers(spark):
    rows = [("某某有限公司", "s", "name"), ("甲公司、乙公司", "s", None), ("未知", "b", "brand"), ("未知", "s", None), ("海天研发中心", "b", "department"), ("小店", "s", "source"), ("海天", "b", "brand"), (None, "s", None)]
    who = employers.identity(F.col("c"), F.col("s"), {"b": "海天"})
    got = spark.createDataFrame([(c, s) for c, s, _ in rows], "c string, s string").select(who.alias("w"), employers.identity_from(employers.identity_id(who)).alias("back")).collect()
    assert [r.w and r.w.scope for r in got] == [x for _, _, x in rows]
    assert all(r.w == r.back for r in got)
    assert one(spark, employers.identity_from(F.lit("employer:v1:[1]"))) is None


def test_titles(spark):
    assert one(spark, titles.card_title(F.lit("某某·软件工程师（编号：J12345）"), F.lit("某某"))) == "软件工程师"
    assert one(spark, titles.role_portion(F.lit("某某2026年招聘公告"), F.lit("某某"))) == ""
    assert one(spark, titles.venue_display(F.lit("甲大学 中心校区"), F.lit("甲大学"))) == "中心校区"
    assert one(spark, titles.domestic_status(F.array(F.lit("新加坡")), F.array(F.lit("济南")))) == "mixed"
    assert one(spark, titles.employment_type(F.lit("工作性质：实习"))) == "internship"
    assert one(spark, titles.availability(F.lit("本次招聘：长期招聘"))).kind == "long_term"
    assert one(spark, titles.stored_stage(F.lit("t"), F.lit(""), F.lit("2026-01-03"), F.lit("active"), F.lit(None).cast("string"), "2026-01-01")) == "expiring_soon"
    assert one(spark, titles.education_display(F.lit("2026届 本科"))) == "本科"


def test_publication(spark):
    change = F.lit(None).cast("struct<date:string,type:string,title:string>")
    schema = "array<struct<date:string,type:string,title:string>>"
    df = spark.createDataFrame([([("2026-01-02", "published", "b"), ("2026-01-01", "published", "a")], "2026-01-01"), (None, "2026-01-05")], f"r {schema}, p string")
    got = df.select(publish.timeline(F.col("r"), F.col("p"), change).alias("t")).collect()
    assert [(e.date, e.type) for e in got[0].t] == [("2026-01-01", "published"), ("2026-01-02", "source_repost")]
    assert [(e.date, e.type) for e in got[1].t] == [("2026-01-05", "published")]
    assert one(spark, publish.card_summary(F.lit("<p>公司简介：我们做事</p><p>岗位职责：写代码</p>"))) == "我们做事"
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "n int, k string")
    ids = {r.n: r.row_id for r in publish.stable_row_ids(rows, ["k"], ["n"]).collect()}
    assert ids[2] == ids[1] + "-2" and "-" not in ids[3]
    bait = spark.createDataFrame([(1, True, "o", "d1"), (2, False, "o", "d1"), (3, True, "q", None)], "id int, bait boolean, org string, day string")
    assert sorted(r.id for r in publish.without_clickbait(bait, "bait", [["org", "day"]]).collect()) == [2, 3]
