"""Operators that SQL does not express, and fixture cases of entity and state rules."""

import datetime as dt

from pyspark.sql import functions as F

from noticeframe.operators import entity, extract, relational, state, workspace
from noticeframe.plans.params import Filters, Query, from_url, to_url


def test_chunks_restart_after_each_cut():
    assert relational.chunk_ids([5, 5, 5, 20, 1], 10, 5) == [0, 1, 1, 2, 3]
    assert relational.chunk_ids([], 10) == []


def test_greedy_unique_lets_dropped_rows_block_nothing(spark):
    rows = [("e", 1, "u1", "f1"), ("e", 2, "u1", "f2"), ("e", 3, "u3", "f2"), ("e", 4, "u3", "f4")]
    got = relational.greedy_unique(spark.createDataFrame(rows, "e string, n int, url string, fp string"), "e", ["url", "fp"], ["n"])
    assert sorted(r.n for r in got.collect()) == [1, 3]


def test_dedup_key_and_merge(spark):
    schema = "id string, source_id string, kind string, company string, title string, cities array<string>, types array<string>, graduation_years array<string>, body string, ord long, recent struct<type:string,label:string>"
    rows = [
        ("a", "s", "招聘公告", "某某有限公司", "某某2026届校园招聘公告", ["济南"], ["校招"], None, "x" * 10, 1, ("content_updated", "1")),
        ("b", "s", "招聘公告", "某某", "2026届校园招聘简章", ["青岛"], ["校招"], None, "y" * 300, 2, ("supplemental", "2")),
        ("c", "s", "招聘公告", "某某", "某某2026届春季校园招聘", ["青岛"], ["校招"], None, "", 3, None),
        ("d", "s-talks", "宣讲会", "某某", "某某2026届校园招聘公告", [], ["校招"], None, "", 4, None),
    ]
    keyed = spark.createDataFrame(rows, schema).withColumn("key", entity.dedup_key())
    merged = entity.merge_groups(keyed, "key", "ord", {"cities": entity.sorted_union, "body": entity.much_longer, "recent": entity.top_change}, ["id"])
    got = {r.id: r for r in merged.collect()}
    assert set(got) == {"a", "c", "d"}
    assert got["a"].members == 2 and got["a"].cities == ["济南", "青岛"] and got["a"].body == "y" * 300 and got["a"].recent.label == "2"


def test_user_state_inherits_only_absent_flags(spark):
    rows = spark.createDataFrame([("1", ["0"]), ("2", None)], "id string, aliases array<string>")
    at = dt.datetime(2026, 1, 1)
    known = spark.createDataFrame([("0", True, None, None, at, "n", at), ("1", None, False, None, at, "m", at)], "sid string, saved boolean, applied boolean, hidden boolean, read_at timestamp, note string, updated_at timestamp")
    got = {r.id: r for r in entity.with_user_state(rows, known, "id", "aliases", "sid").collect()}
    assert got["1"].saved is True and got["1"].applied is False and got["1"].hidden is None and got["2"].saved is None


def test_listing_hysteresis(spark):
    t0 = dt.datetime(2026, 1, 1)
    at = lambda h, m=0: t0 + dt.timedelta(hours=h, minutes=m)
    rows = [("a", at(0), False, True), ("a", at(5, 59), False, True), ("b", at(0), False, True), ("b", at(6), False, True), ("c", at(0), False, True), ("c", at(7), False, False), ("d", at(0), False, True), ("d", at(8), True, True)]
    got = state.listing_status(spark.createDataFrame(rows, "k string, ts timestamp, seen boolean, complete boolean"), "k", "ts", "seen", "complete")
    assert {r.k: r.status for r in got.collect()} == {"a": "unconfirmed", "b": "withdrawn", "c": "unconfirmed", "d": "active"}


def test_upsert_outcomes(spark):
    t = dt.datetime(2026, 1, 1)
    old = spark.createDataFrame([(1, "a", t, t, 1), (2, "b", t, t, 3)], "id long, fp string, first_seen_at timestamp, updated_at timestamp, revision int")
    u = dt.datetime(2026, 1, 2)
    new = spark.createDataFrame([(2, "c", u, 1), (2, "b", t, 1), (3, "z", u, 1)], "id long, fp string, at timestamp, n int")
    got = {r.id: r for r in state.upsert(old, new, "id", "fp", "at", "n").collect()}
    assert [got[i].outcome for i in (1, 2, 3)] == ["absent", "changed", "new"]
    assert got[2].revision == 4 and got[2].first_seen_at == t and got[2].updated_at == u and got[3].revision == 1


def test_parts_are_newest_independently(spark):
    rows = [("k", "2026-01-02", "new", "2026-01-01", "old list", 1), ("k", "2026-01-01", "old", "2026-01-03", "new list", 2)]
    df = spark.createDataFrame(rows, "k string, verified string, body string, checked string, listing string, prio int")
    got = state.newest_parts(df, "k", {"verified": ["body"], "checked": ["listing"]}, "prio").first()
    assert (got.body, got.listing) == ("new", "new list")


def test_grid_positions():
    grid = [["", "岗位", "岗位", "其他"], ["序号", "岗位名称", "专业要求", "备注"], ["1", "工程师", "计算机", ""], ["2", "岗位名称", "专业要求", "备注"], ["3", "会计", "财务", "x"]]
    assert [p["name"] for p in extract.positions_of_grid(grid)] == ["工程师", "会计"]
    assert extract.positions_of_grid([["岗位名称", "工程师"], ["学历要求", "本科"]])[0]["education"] == "本科"
    assert extract.text_grid("a | b\n--|--\nc | d\nplain") == [["a", "b"], ["c", "d"]]


def test_extraction(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    assert one(extract.sole_deadline(F.lit("报名截止：2026年3月1日。成立于2020年1月1日"))) == "2026-03-01"
    assert one(extract.sole_deadline(F.lit("报名截止2026-03-01\n网申截止2026-04-01"))) is None
    assert one(extract.split_majors(F.lit("计算机、软件工程；不限、计算机"))) == ["计算机", "软件工程"]
    assert [(r["name"], r["count"]) for r in one(extract.prose_positions(F.lit("招聘软件工程师3名，会计专员 2人")))] == [("招聘软件工程师", 3), ("会计专员", 2)]
    df = spark.createDataFrame([("工资高，没有加班多。管理混乱", )], "t string")
    assert [(r.dimension, r.polarity) for r in extract.opinion_signals(df, F.col("t")).collect()] == [("pay", 1), ("management", -1)]


def test_parameters_round_trip():
    q = Query(cities=("a", "b"), min_salary=5.0, q="x y", page=3)
    assert from_url(Query, to_url(q)) == q
    f = Filters(query="k", cities=("济南",), include_unknown=False)
    assert from_url(Filters, to_url(f)) == f and f.active() == 3
    n = Query(cities=tuple("abcdefghij"), page=9999, size=0, sort="x", q="q" * 99).normalised()
    assert (len(n.cities), n.page, n.size, n.sort, len(n.q)) == (8, 500, 1, "newest", 80)
    assert from_url(Query, "page=x&nope=1") == Query()


def test_workspace_filters(spark):
    schema = "id string, title string, excerpt string, search_text string, deadline string, listing_status string, kind string, employment_type string, provenance string, types array<string>, sectors array<string>, directions array<string>, graduation_years array<string>, cities array<string>, nationwide boolean, education string, positions array<struct<city:string,education:string,cohort:string>>, effective_day string, tie_ms long, hidden boolean, saved boolean, applied boolean"
    row = lambda i, **k: tuple({**dict(id=i, title="t", excerpt="", search_text="java 后端", deadline="", listing_status="active", kind="k", employment_type="", provenance="", types=["校招"], sectors=[], directions=[], graduation_years=["2027"], cities=["济南"], nationwide=False, education="本科", positions=[("济南", "硕士", "2027"), ("青岛", "本科", "2027")], effective_day="2026-01-01", tie_ms=1, hidden=None, saved=None, applied=None), **k}.values())
    rows = [row("1"), row("2", cities=["青岛"]), row("3", deadline="2020-01-01"), row("4", title="t 8k-9k", effective_day="2026-01-02"), row("5", hidden=True)]
    df = spark.createDataFrame(rows, schema)
    now = F.lit("2026-01-10").cast("timestamp")
    run = lambda f, **k: [r.id for r in workspace.workspace(df, f, now, **k).collect()]
    assert run(Filters()) == ["4", "1", "2"]
    assert run(Filters(cities=("济南",))) == ["4", "1"]
    assert run(Filters(cities=("济南",), education="本科", position_level=True)) == []
    assert run(Filters(cities=("青岛",), education="本科", position_level=True)) == ["2"]
    assert run(Filters(min_salary=8500)) == ["4"]
    assert run(Filters(query="JAVA 后端"), view="hidden") == ["5"]


def test_change_details(spark):
    """Details that the table query has no rows for: a rolling deadline, files, majors, identifiers in addresses, an unchanged version."""
    from noticeframe.operators import changes

    blank = dict.fromkeys(changes.VERSION)
    base = blank | {"title": "招聘", "body": "一二三四五", "deadline": "2027-01-01", "application_url": "https://a/campus/detail?jobAdId=ab12"}
    steps = [
        (base | {"deadline": "2027-01-10"}, None),
        (base | {"deadline": "2027-03-10"}, ("deadline_extended", "截止延期", "报名截止时间延长至 2027-03-10（原截止时间：2027-01-01）")),
        (base, None),
        (base | {"application_url": "https://a/campus/detail?jobAdId=ff-9"}, ("content_updated", "内容更新", "招聘公告正文说明已同步最新修订")),
        (base | {"majors": ["法学", "统计"], "attachments": ["好" * 25, "岗位表"]}, ("positions_updated", "岗位表更新", f"岗位需求变动为 0 个职位，新增专业：法学、统计；新增/更新附件「{'好' * 19}…」 等 2 个文件")),
        (base | {"body": f"一二三四五\n<b>{'新' * 30}</b>"}, ("content_updated", "内容更新", f"正文变动：补充「{'新' * 23}…」")),
    ]
    schema = "struct<" + ",".join(f"{c}:{t}" for c, t in changes.VERSION.items()) + ">"
    rows = [(i, tuple(base.values()), tuple(new.values())) for i, (new, _) in enumerate(steps)]
    df = spark.createDataFrame(rows, f"i int, old {schema}, new {schema}").selectExpr("*", "timestamp'2026-01-20 00:00:00' AS ts")
    got = {r.i: tuple(r.change) for r in changes.with_change(df, "ts").collect()}
    assert got == {i: want for i, (_, want) in enumerate(steps) if want}


def test_best_matches_count_pairs_where_they_are_dealt(spark):
    """no task counts pairs before rows are dealt, and the dealt rows keep as many partitions as a shuffle has."""
    from noticeframe import catalog

    plan = catalog.QUERIES["unique_best_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    lines = plan[plan.index("Repartition") if "Repartition" in plan else plan.rindex("Exchange") :]
    assert "Aggregate" not in lines
