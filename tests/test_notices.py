"""Exam tables, prose majors, bodies, organizers, companies, calendars and campaigns: cases that the table queries have no rows for."""

import random

import pytest
from pyspark.sql import functions as F

from noticeframe.functions import organizers, text, titles
from noticeframe.operators import bodies, campaigns, companies, examfacts, examtables, prose
from noticeframe.sources import calendars

# --- white space ------------------------------------------------------------------------------------------------------


def test_white_space_of_all_kinds(spark):
    assert text.spaced(r"a\s[^\s,]\S").count("x{3000}") == 3
    rows = [(f"{w}甲{w}·{w}乙{w}",) for w in text.WHITE]
    got = spark.createDataFrame(rows, "t string").select(titles.card_title(F.col("t"), F.lit("甲")), text.trimmed(F.col("t")).rlike("(?s)^甲.*乙$")).collect()
    assert {tuple(r) for r in got} == {("乙", True)}


# --- exam tables ------------------------------------------------------------------------------------------------------

HEAD = ["招聘单位", "岗位名称", "招聘人数", "学历", "专业要求"]


def test_grids_without_positions():
    read = examtables.positions_of
    assert read([], "e") == [] and read([HEAD], "e") == [] and read([["a", "b"], ["c", "d"]], "e") == []
    assert examtables.spread([["a"], [None, " b　 c "]], [(0, 0, 9, 9), (5, 5, 1, 1), (-1, 0, 1, 1)]) == [["a", "a"], ["a", "a"]]


def test_rows_of_a_grid():
    grid = [["某某公告", "", "", "", ""], HEAD, ["甲校", "教师", "共3人", "本科", "数学"], ["", "", "", "", ""], ["合计", "", "3", "", ""], ["甲校", "教师", "0", "备注", ""], ["甲校", "12", "1", "", ""], ["甲校", "教师", "9999999999", "", "法学"], ["注：x", "y", "", "", ""]]
    rows = examtables.positions_of(grid, "e", employer="总校")
    assert [(r["position_name"], r["recruit_count"], r["education"], r["major_raw"]) for r in rows] == [("教师", 3, "本科", "数学"), ("教师", None, "", ""), ("教师", None, "", "法学")]
    assert rows[1]["row_id"] == rows[0]["row_id"] + "-2" and rows[2]["row_id"] == rows[0]["row_id"] + "-3"


def test_the_fuller_header_counts():
    """A deeper header with more fields wins, and one tier of majors alone stands without its name."""
    grid = [["单位", "岗位", "人数", "专业要求", "专业要求"], ["单位名称", "岗位名称", "招聘人数", "本科专业要求", "研究生专业要求"], ["甲", "乙岗", "1", "", "法学"], ["甲", "丙岗", "1", "会计", "审计"]]
    assert [r["major_raw"] for r in examtables.positions_of(grid, "e")] == ["法学", "本科：会计；研究生：审计"]


def test_exam_positions_of_null_grids(spark):
    rows = [(1, None, None), (2, [], []), (3, [HEAD, ["甲校", None, "2", "本科", "数学类、不限,1234会计学等"]], None)]
    df = spark.createDataFrame(rows, "exam_id int, grid array<array<string>>, merges array<array<int>>")
    got = examtables.exam_positions(df, place_in=lambda t: F.when(F.contains(t, F.lit("甲")), "甲市")).collect()
    assert [(r.exam_id, r.position_name, r.city, r.majors) for r in got] == [(3, "公开招聘岗位", "甲市", ["数学", "会计学"])]


# --- prose ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_longest_words_as_by_trying_all(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("ab甲") for _ in range(r.randrange(1, 5))) for _ in range(12)]
    vocabulary = prose.Vocabulary(words)
    for _ in range(200):
        s = "".join(r.choice("ab甲乙") for _ in range(r.randrange(30)))
        found, at = [], 0
        while at < len(s):
            here = max((w for w in words if s.startswith(w, at)), key=len, default="")
            found += [here] if here else []
            at += max(1, len(here))
        assert vocabulary.longest(s) == found
    assert prose.Vocabulary([]).longest("ab") == [] and prose.Vocabulary(["", "a"]).longest("ba") == ["a"]


def test_majors_of_prose():
    read = prose.Reader(prose.MajorWords(frozenset({"金融"}), ("计算机", "法学"))).majors
    assert read("") == [] and read("计算机科学") == []
    assert read("专业不限。") == ["专业不限"]
    assert read("1、专业要求：计算机类、法学（法律）等相关专业，沟通能力强。计算机另行") == ["计算机类", "法学"]
    assert read("需求专业：\n计算机工程师\n金融\n报名方式：法学\n") == ["金融"]
    assert read("欢迎金融、MBA及相关专业毕业生，计算机等专业知识不作要求") == ["金融", "MBA"]
    assert len(prose.Reader(prose.MajorWords(frozenset(), ("学",)), 3).majors("专业要求：甲学、乙学、丙学、丁学")) == 3


# --- bodies -----------------------------------------------------------------------------------------------------------


def test_sections_of_short_and_plain_bodies(spark):
    rows = [(0, None), (1, ""), (2, "一、甲\n乙"), (3, "甲\n乙\n一、丙\n丁"), (4, "一、甲\n\n二、乙\n丙"), (5, "一、" + "长" * 31 + "\n二、乙\n丙\n三、丁")]
    got = {r.i: [(s.heading, s.content) for s in r.s] for r in spark.createDataFrame(rows, "i int, b string").select("i", bodies.announcement_sections(F.col("b")).alias("s")).collect()}
    assert got[0] == got[1] == [] and got[2] == [(None, "一、甲\n乙")] and got[3] == [(None, "甲\n乙\n一、丙\n丁")]
    assert got[4] == [("一、甲", ""), ("二、乙", "丙")] and [h for h, _ in got[5]] == [None, "二、乙", "三、丁"]


def test_places_and_blocks():
    assert bodies.place_text("统一分配工作地点：济南 1. 负责销售") == "济南" and bodies.place_text("负责全部工作") == "" and bodies.place_text("x" * 101) == ""
    assert bodies.says_only("山东省济南市、青岛", ["济南", "青岛"]) and not bodies.says_only("济南高新区", ["济南"]) and not bodies.says_only("济南", [])
    assert bodies.blocks_of(["岗位：甲", "1. 乙；2. 丙；", "① 丁", "- 戊", "己"]) == [
        {"type": "paragraph", "ordered": None, "items": ["岗位：甲"]}, {"type": "list", "ordered": True, "items": ["乙；", "丙；", "丁"]}, {"type": "list", "ordered": False, "items": ["戊"]}, {"type": "paragraph", "ordered": None, "items": ["己"]},
    ]
    assert bodies.heading_of("岗位职责：任职要求：本科") == ("任职要求", "本科") and bodies.heading_of("岗位") is None
    found = bodies.Body({}).read("工作地点：济南 1. 负责销售\n尾")
    assert found["place"] == "济南" and found["sections"][0]["heading"] == "岗位职责" and bodies.Body({}).read("")["sections"] == []


# --- organizers and companies -----------------------------------------------------------------------------------------


def test_organizers_in_order(spark):
    rows = [
        ("2026年山东省省级机关考试录用公务员公告", None, None, None, "山东省公务员局"),
        ("国防科技大学电子学院招聘", None, None, None, "国防科技大学"),
        ("14人！这家医院公开招聘了", "某公司", "山东省某某医院是一所三甲医院", None, "山东省某某医院"),
        ("招聘", "济南大学", "", "甲网 · x", "甲网"),
        (None, None, None, None, "官方招考主管部门"),
    ]
    df = spark.createDataFrame(rows, "t string, c string, b string, s string, want string")
    for r in df.select("want", organizers.organizer(*map(F.col, "tcbs")).alias("got")).collect():
        assert r.got == r.want


def test_company_support(spark):
    rows = [
        ("甲乙科技有限公司", "甲乙科技2026校园招聘", "", True),
        ("山东甲乙信息科技有限公司", "公告", "甲乙信息欢迎你", False),
        ("北京甲乙丙网络科技有限公司", "公告", "甲乙丙是一家公司", True),
        ("智联招聘网络有限公司", "公告", "智联招聘网络有限公司", False),
        ("甲乙有限公司", "甲乙集团招聘", "", True),
        ("甲乙丙丁有限公司", "别家招聘", "无关", False),
        (None, "公告", "", False),
    ]
    df = spark.createDataFrame(rows, "c string, t string, b string, want boolean")
    assert all(r.got == r.want for r in df.select("want", companies.supported(F.col("c"), F.col("t"), F.col("b"), ["北京"]).alias("got")).collect())


def test_company_candidates(spark):
    body = "东方电子有限责任公司（以下简称“东方”）\n公司简介：西方机械股份有限公司成立于1990年"
    df = spark.createDataFrame([("东方2026招聘", body), ("西方机械校园招聘", body), ("南方建设有限公司招聘公告", None), (None, None)], "t string, b string")
    got = [sorted((c.name, c.by) for c in r.c) for r in df.select(companies.candidates(F.col("t"), F.col("b"), F.lit("招聘公告"), F.lit("")).alias("c")).collect()]
    assert got == [[("东方电子有限责任公司", 1)], [("西方机械股份有限公司", 4)], [("南方建设有限公司", 2)], []]


# --- calendars, campaigns, enrichment ---------------------------------------------------------------------------------


def test_pages_that_are_no_calendars(spark):
    rows = [(1, "data_list", None), (2, "data_list", "<html>"), (3, "data_list", "[]"), (4, "data_list", '{"code": 1, "data": []}'), (5, "what", "{}"), (6, "object_list", '{"state": 1, "object": {"list": [{"id": 1, "startTime": "2026-02-30 08:00:00"}]}}'),
            (7, "object_page", '{"state": 1, "object": {"totalPage": 1, "count": 0, "list": [{"id": "a"}]}}'), (8, "data_list", '{"code": 1, "data": [{"career_talk_id": 7, "meet_day": "2026-03-01", "meet_name": "x", "more": [1]}]}')]
    pages = spark.createDataFrame(rows, "page int, format string, body string").selectExpr("*", "'b' AS base", "'s' AS school", "'c' AS code")
    got = {r.page: (r.status, r.identity, r.raw) for r in calendars.calendar_rows(pages).collect()}
    assert {p: s for p, (s, _, _) in got.items()} == {1: "broken", 2: "broken", 3: "refused", 4: "empty", 5: "unknown", 6: "empty", 7: "refused", 8: "event"}
    assert got[8][1] == "7" and '"more":[1]' in got[8][2]


def test_a_hot_company_and_shared_best(spark):
    schema = "id long, source_id string, kind string, title string, company string, body string, types array<string>, years array<string>, has_event boolean"
    rows = [(i, "a", "公告", "", "甲集团有限公司", "", ["校招"], [str(2020 + i % 200)], True) for i in range(1000)] + [(5000, "x-talks", None, "春招", "甲集团有限公司", None, None, ["2021"], True), (5001, "x-talks", None, None, "乙", None, None, ["2021"], True), (5002, "x-talks", None, None, None, None, None, None, None)]
    rows += [(7000, "a", "公告", "秋招", "乙有限公司", None, ["校招"], ["2021", "2022"], None), (7001, "a", "公告", "", "乙有限公司", None, ["校招"], ["2021"], None), (7001, "a", "公告", "", "乙有限公司", None, ["校招"], ["2021"], None), (7002, "a", "具体岗位", "", "乙", None, ["校招"], ["2021"], None)]
    got = campaigns.attached_talks(spark.createDataFrame(rows, schema)).collect()
    assert [(r.talk_id, r.campaign_id) for r in got] == [(5001, 7001)]


def test_enrichment_of_nothing(spark):
    exams = spark.createDataFrame([(1, None, None), (2, "共12人！", "招聘99999名。岗位 8 个岗位，30000个岗位")], "exam_id int, title string, body string")
    none = spark.createDataFrame([], "exam_id int, recruit_count int, major_raw string, source string")
    files = spark.createDataFrame([(3, "岗位表"), (2, None)], "exam_id int, title string")
    got = {r.exam_id: (r.positions_status, r.total_positions, r.total_headcount, r.unlimited) for r in examfacts.enriched_exams(exams, none, files).collect()}
    assert got == {1: ("none", None, None, False), 2: ("none", 8, 12, False)}


# --- detail pages -----------------------------------------------------------------------------------------------------


def test_pages_of_all_shapes():
    from noticeframe.sources import pages

    read = pages.read_page
    assert read("", "") == {"body": "", "attachments": [], "grids": []}
    assert read("<p>a<div class=content>short</div>b", "")["body"] == "a\nshort\nb"
    long = "长" * 50
    assert read(f"<div id=zoom>{long}<p>x</div>y<div class='content'>z</div>", "")["body"] == f"{long}\nx"
    assert read(f"<b><div class='a content b'>{long}</b></div></i>tail", "", (".content",))["body"] == long
    got = read(f"<body>{long}<a href=' /f.pdf '>x</a><a href='f.pdf#1'>附件</a><a href='http://[bad'>附件</a><a href='mailto:a'>附件</a><a href='http://www.gov.cn/'>附件</a><a title='附件二' href='/q'></a></body>", "https://h.cn/d/")
    assert [a["url"] for a in got["attachments"]] == ["https://h.cn/f.pdf", "https://h.cn/d/f.pdf#1", "http://www.gov.cn/", "https://h.cn/q"]


def test_addresses_of_the_portal():
    from noticeframe.sources.pages import attachment_url, kept_attachment

    assert attachment_url("https://a.sdei.edu.cn/resource/srst/att/1.doc?x=1") == "http://hrss.shandong.gov.cn/resource/srst/att/1.doc?x=1"
    assert attachment_url("https://a.sdei.edu.cn/sdu/n1/n2/c3/part/9.xls", "https://j.gov.cn") == "https://j.gov.cn/n1/n2/c3/part/9.xls"
    assert attachment_url("https://a.sdei.edu.cn/api-gateway/jpaas-x/f") == "http://hrss.shandong.gov.cn/api-gateway/jpaas-x/f"
    for same in ("https://b.cn/externalLink?target=x.y", "https://a.sdei.edu.cn/externalLink?target=x", "https://a.sdei.edu.cn/externalLink?target=x.%ff.z", "https://a.sdei.edu.cn/other", ""):
        assert attachment_url(same) == same
    assert not kept_attachment("", "https://www.gov.cn/") and not kept_attachment("x", "https://a.cn/img/b.png") and kept_attachment("表", "https://a.cn/b.gif")


def test_pages_are_dealt_over_tasks_and_walked_once(spark, tmp_path, monkeypatch):
    """a table in one row group is no single task, and a page's text, links and tables come from one walk."""
    from pyspark.sql import functions as F

    from noticeframe import notice_queries
    from noticeframe.operators import relational
    from noticeframe.sources import files, pages

    rows = relational.dealt(spark.range(0, 100, 1, 1), "id")
    assert rows.rdd.getNumPartitions() == 4 and rows.groupBy(F.spark_partition_id()).count().count() == 4
    dealt = []
    monkeypatch.setattr(relational, "dealt", lambda df, *keys: dealt.append(keys) or df)
    notice_queries.detail_pages(spark, "/root/testdata/sf0.001")
    assert dealt == [("p_partkey",)]
    walks = []
    monkeypatch.setattr(files.Tables, "feed", lambda self, html, feed=files.Tables.feed: walks.append(1) or feed(self, html))
    html = "<div id=zoom>" + "字" * 50 + "<table><tr><td>a<td>b<script>'<td>'</script></tr><tr><td>c<table><tr><td>内</td></tr></table></td></tr></table><table></table></div>"
    assert pages.read_page(html, "https://a.cn")["grids"] == [[["内"]], [["a", "b'<td>'"], ["c", ""]]] and len(walks) == 1
    assert pages.read_page(html, "https://a.cn")["grids"] == files.html_grids(html)


def dealt_by(monkeypatch, spark, query):
    """The keys by which a query deals its rows."""
    from noticeframe import notice_queries
    from noticeframe.operators import relational

    seen = []
    monkeypatch.setattr(relational, "dealt", lambda df, *keys: seen.append(keys) or df)
    getattr(notice_queries, query)(spark, "/root/testdata/sf0.001")
    return seen


def test_bodies_are_dealt_over_tasks_and_read_in_slices(spark, monkeypatch):
    """rows of a compact table reach all tasks; more bodies than a slice holds come back in order, null ones empty."""
    assert dealt_by(monkeypatch, spark, "structured_bodies") == [("p_partkey",)]
    rows = spark.range(0, 600, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("岗位类别："), F.col("id").cast("string"))).alias("t"))
    got = rows.select("id", bodies.structured_body(F.col("t"), cities=F.array(F.lit("济南"))).alias("b")).collect()
    assert [[(m.label, m.value) for m in r.b.meta] for r in got] == [[("岗位类别", str(r.id))] if r.id % 7 else [] for r in got] and len(got) == 600


def test_titles_are_dealt_over_tasks(spark, monkeypatch):
    """titles of a compact table are no single task."""
    assert dealt_by(monkeypatch, spark, "spaced_titles") == [("p_partkey",)]


def test_a_title_is_read_once(spark):
    """a title's code, its rest, its pay and a body's days are each computed once, however often rules use them."""
    from noticeframe.functions import facts, titles
    from noticeframe.operators import extract

    rows = spark.createDataFrame(
        [(1, "Acme · 工程师 8k-1.2万(岗位编号：AB1234)", "Acme"), (2, "(岗位编号：AB1234)", ""), (3, "校园招聘", None), (4, None, "Acme"), (5, "助理 10-20万·13薪", "x"), (6, "助理 3000以上", "助理 3000以上"), (7, "a｜ 2010-20k", "a")],
        "k int, t string, c string",
    )
    t = F.col("t")
    got = rows.select("k", titles.card_title(t, F.col("c")).alias("card"), titles.role_portion(t, F.col("c")).alias("role"), facts.salary_range(t, F.lit(None).cast("string")).alias("pay"), extract.sole_deadline(F.concat(F.lit("报名截止2026-5-1；网申时间2026.05.0"), F.col("k"))).alias("day"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("岗位编号") == 2 and plan.count("招聘简章") == 1 and plan.count("网申时间2026") == 1
    assert plan.count("至–") == 1 + 5  # one test, five groups
    assert [(r.card, r.role, r.pay and (r.pay.min, r.pay.max, r.pay.open_ended, r.pay.raw), r.day) for r in got.orderBy("k").collect()] == [
        ("工程师 8k-1.2万", "工程师 8k-1.2万", None, "2026-05-01"),
        ("(岗位编号：AB1234)", "(岗位编号：AB1234)", None, None),
        ("校园招聘", "", None, None),
        (None, None, None, None),
        ("助理 10-20万·13薪", "13薪", (8333.0, 16667.0, False, "10-20万·13薪"), None),
        ("助理 3000以上", "助理 3000以上", (3000.0, None, True, "3000以上"), None),
        ("｜ 2010-20k", "2010-20k", None, None),
    ]


def test_prose_is_dealt_over_tasks_and_read_in_slices(spark, monkeypatch):
    """notices of a compact table are no single task; more texts than a slice holds come back in order, null ones empty."""
    assert dealt_by(monkeypatch, spark, "majors_in_prose") == [("p_partkey",)]
    rows = spark.range(0, 600, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("专业要求：甲"), F.col("id").cast("string"), F.lit("学"))).alias("t"))
    got = rows.select("id", prose.prose_majors(F.col("t"), prose.MajorWords(stems=("甲",))).alias("m"), prose.words_in(F.col("t"), ["甲"]).alias("w")).collect()
    assert [(r.m, r.w) for r in got] == [([f"甲{r.id}学"], ["甲"]) if r.id % 7 else ([], []) for r in got] and len(got) == 600


def test_a_part_is_judged_once(monkeypatch):
    """majors that many notices name are cleaned and judged once; what a task remembers is bounded, and forgetting changes no result."""
    cleaned, seen = prose.Reader.cleaned, []
    monkeypatch.setattr(prose.Reader, "cleaned", lambda self, part: seen.append(part) or cleaned(self, part))
    texts = [f"专业要求：全日制甲{i % 7}学专业、甲能力、不限\n【需求专业】\n（1）甲{i % 3}工程专业" for i in range(70)]
    words = prose.MajorWords(stems=("甲",))
    reader = prose.Reader(words)
    got = [reader.majors(t) for t in texts]
    assert len(seen) == len(set(seen)) and {f"全日制甲{i}学专业" for i in range(7)} <= set(seen)
    monkeypatch.setattr(prose, "REMEMBERED", 1)
    assert [prose.Reader(words).majors(t) for t in texts] == got
    assert got[:2] == [["甲0学", "专业不限", "甲0工程"], ["甲1学", "专业不限", "甲1工程"]]


def test_a_change_is_computed_once(spark):
    """the plan holds the detectors once, not again in a condition below."""
    from noticeframe import notice_queries

    plan = notice_queries.notice_changes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("报名截止时间延长至") == 1
