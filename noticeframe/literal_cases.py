"""Queries of text and fact operators over literal notices.

The star-schema tables hold no notices, so each query lays a list of cases over all rows of ``orders``
(row k has case k modulo their number), applies the operator to every row, and is compared with the values that are
expected, written out by hand in the SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog import ORACLES, QUERIES, table
from .functions import display, exams, facts, majors, talks, text, timeutil, titles
from .operators import collection, content, employers, examfilter, extract, places, publish
from .streaming import telemetry, upsert

NOW = "2026-09-10T04:00:00Z"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def sql_literal(value: object) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, bool | int | float) else "'" + str(value).replace("'", "''") + "'"


def cases(inputs: Mapping[str, str], outputs: Sequence[str], rows: Sequence[tuple]) -> Callable:
    """Register a query: ``inputs`` with their types, then the expected ``outputs``, one tuple per case."""

    def add(f: Callable[..., Sequence[Column]]) -> Callable:
        def run(spark, sf_dir):
            orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % len(rows)).cast("int").alias("_case"))
            listed = spark.createDataFrame([(i, *r[: len(inputs)]) for i, r in enumerate(rows)], ", ".join(["_case int", *(f"`{n}` {k}" for n, k in inputs.items())]))
            # The list of cases is as long as it is written here, whatever the size of the data.
            given = orders.join(F.broadcast(listed), "_case")
            return given.select("o_orderkey", *[c.alias(n) for c, n in zip(f(*[F.col(name) for name in inputs]), outputs, strict=True)])

        run.__doc__ = f.__doc__
        values = ", ".join("(" + ", ".join([str(i), *map(sql_literal, r[len(inputs) :])]) + ")" for i, r in enumerate(rows))
        QUERIES[f.__name__] = run
        ORACLES[f.__name__] = f"SELECT o_orderkey, {', '.join(outputs)} FROM orders JOIN (VALUES {values}) AS e(i, {', '.join(outputs)}) ON o_orderkey % {len(rows)} = e.i"
        return f

    return add


def joined(c: Column) -> Column:
    return F.array_join(c, "|")


S, LIST, MAP = "string", "array<string>", "map<string,string>"


@cases({"t": S}, ["out"], [("短", "短"), ("好" * 90, "好" * 90), ("好" * 91, "好" * 89 + "…"), (None, None), ("好" * 88 + "  尾巴", "好" * 88 + "…")])
def excerpt_trim(t):
    """P4."""
    return [text.trimmed_excerpt(t)]


@cases({"head": S, "tail": S}, ["out"], [("ABC 招聘", "Xyz", "abc 招聘 Xyz"), ("A" * 300, "B" * 400, "a" * 240 + " " + "B" * 239), (None, "Q", "Q"), ("甲", None, "甲")])
def search_head(head, tail):
    """The tail keeps its case."""
    return [text.search_head_tail(head, tail)]


@cases(
    {"title": S, "company": S}, ["card", "role"],
    [
        ("某某公司 · 软件工程师（岗位编号：A1234）", "某某公司", "软件工程师", "软件工程师"),
        ("2026年校园招聘简章", "甲集团", "2026年校园招聘简章", ""),
        ("甲集团校园招聘", "甲集团", "校园招聘", ""),
        ("甲集团", "甲集团", "甲集团", "甲集团"),
        ("总部·财务部|会计", None, "总部·财务部|会计", "会计"),
        ("招聘公告", "", "招聘公告", ""),
    ],
)
def card_titles(title, company):
    """A title without its employer and code, and the role in it."""
    return [titles.card_title(title, company), titles.role_portion(title, company)]


@cases(
    {"title": S, "company": S, "excerpt": S}, ["clean", "salary"],
    [
        ("软件工程师（15k-25k）", "", None, "软件工程师", "15k-25k"),
        ("会计 8000-12000元/月", None, "薪资：20k", "会计", "8000-12000元/月"),
        ("前台（面议）", "", "薪资待遇：6k-8k，双休", "前台", "6k-8k"),
        ("校招 2025-2026", "", "无", "校招 2025-2026", None),
        ("司机 1.5万以上", "", "", "司机", "1.5万以上"),
        ("讲师", "", "薪资: 面议", "讲师", None),
        ("讲师", "", "薪资：300元/天·13薪加很多很多很多很多很多很多很多奖金", "讲师", None),
        ("讲师", "", "薪资：300元/天起", "讲师", "300元/天"),
    ],
)
def salary_badge(title, company, excerpt):
    """Pay shown beside a title."""
    d = display.salary_display(title, company, excerpt)
    return [d["title"], d["salary"]]


@cases(
    {"company": S, "title": S, "source": S}, ["name", "monogram"],
    [
        ("财务部", "会计", "b1", "甲银行 · 财务部", "甲银"), ("甲银行财务部", "会计", "b1", "甲银行财务部", "甲银"), ("", "", "b1", "甲银行", "甲银"), (None, "会计", "x", "企业名称待核实", "会计"),
        ("所属区县及以下机构", "人保财险-济南分公司-柜员", "picc-1", "人保财险济南分公司 · 所属区县及以下机构", "人保"), ("所属区县及以下机构", "柜员", "picc-1", "中国人民保险集团 · 所属区县及以下机构", "中国"),
        ("", "", "", "企业名称待核实", "招"), ("乙科技有限公司", "x", None, "乙科技有限公司", "乙科"),
    ],
)
def employer_names(company, title, source):
    """P10."""
    d = display.employer_display(company, title, source, {"b1": "甲银行"})
    return [d["name"], d["monogram"]]


@cases(
    {"title": S, "kind": S, "structured": MAP, "body": S}, ["out"],
    [
        ("甲公司宣讲会", "宣讲会", {"fairDate": "2026-09-15", "fairStartTime": "14:00", "fairEndTime": "16:30", "schoolName": "山东大学", "fairAddress": "中心校区 报告厅"}, None, "2026-09-15,14:00,16:30,山东大学,中心校区 报告厅,scheduled,talk,offline"),
        ("甲公司宣讲会（已取消）", "宣讲会", {}, "宣讲时间：2026年3月5日 9:30-11:00\n宣讲学校：济南大学\n举办地点：腾讯会议", "2026-03-05,9:30,11:00,济南大学,腾讯会议,cancelled,talk,online"),
        ("秋季双选会", "公告", {"schoolName": "X大学", "fairDate": "2026.10.01"}, "", "2026-10-01,-,-,X大学,,scheduled,job_fair,unknown"),
        ("面试安排", "公告", {"schoolName": "X大学", "fairDate": "2026/2/30"}, "", None),
        ("笔试", "公告", {"fairDate": "2026-01-02"}, "", None),
        ("就业指导", "公告", {"schoolName": "X", "fairDate": "2026-01-02 23:59"}, "宣讲时间：25:00 8:05", "2026-01-02,8:05,-,X,,scheduled,guidance,unknown"),
    ],
)
def talk_events(title, kind, structured, body):
    """Day, hours, school, venue, state, type and mode of a talk."""
    e = talks.talk_event(title, kind, structured, body)
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    return [F.when(e.isNotNull(), F.concat_ws(",", e["date"], dash(e["start_time"]), dash(e["end_time"]), e["school"], e["venue"], e["status"], e["event_type"], e["mode"]))]


@cases({"d": S, "a": S, "b": S}, ["out"], [("2026-03-05", "14:00", "16:00", "2026年3月5日 14:00–16:00"), ("2026-12-25", "9:00", None, "2026年12月25日 9:00"), ("2026-01-01", None, "10:00", "2026年1月1日")])
def talk_labels(d, a, b):
    """H26."""
    return [talks.date_label(d, a, b)]


@cases(
    {"title": S, "excerpt": S}, ["low", "high", "open_ended"],
    [
        ("工程师（15k-25k）", None, 15000.0, 25000.0, False), ("经理（20-30万）", None, 16667.0, 25000.0, False), ("店员", "薪资：5000-7000元", 5000.0, 7000.0, False), ("主管（8000以上）", "", 8000.0, None, True),
        ("小时工（20-30）", None, None, None, None), ("校招（2025-26）", None, None, None, None), ("兼职", "薪资：200-300/天", None, None, None), ("司机", "", None, None, None),
    ],
)
def salary_parse(title, excerpt):
    """Pay per month."""
    r = facts.salary_range(title, excerpt)
    return [r["min"], r["max"], r["open_ended"]]


@cases({"low": "double", "raw": S}, ["out"], [(120000.0, "12万", 10000.0), (120000.0, "12万/月", 120000.0), (50000.0, "5万", 50000.0), (66000.0, "6.6w", 5500.0), (None, "x", None)])
def salary_healed(low, raw):
    """P18."""
    return [collection.normal_salary(low, raw)]


@cases(
    {"published": S, "first_seen": S, "days": LIST}, ["out"],
    [
        ("2026-09-01", "2026-09-05", None, "2026-09-01"), ("2026-09-20", "2026-09-05", None, ""), ("2026-09-09", "2026-09-05", ["2026-09-03", "2026-09-04"], "2026-09-03"), ("2026-09-09", "2026-09-05", ["2026-09-08"], "2026-09-05"), (None, "2026-09-05", None, ""), ("2026-09-09T17:00:00Z", "", None, "2026-09-10"),
    ],
)
def publication_healed(published, first_seen, days):
    """P19."""
    return [facts.healed_publication(published, first_seen, days, now())]


@cases(
    {"kind": S, "label": S, "detail": S, "date": S}, ["change", "substantive", "rolling"],
    [
        ("deadline_extended", "", "报名截止时间延长至 2026-10-01（原截止时间：2026-09-01）", "2026-08-20", "extended", True, False),
        ("deadline_extended", "明确截止时间", "x", "2026-08-20", "clarified", False, False),
        ("deadline_extended", "", "报名截止时间调整为 2026-10-01", "2026-08-20", "adjusted", False, False),
        ("deadline_extended", "", "延长至 2027-08-20（原截止时间：2027-08-15）", "2026-08-20", "clarified", False, True),
        ("supplemental", "", "", "2026-08-20", None, True, False),
        ("positions_updated", "岗位表就绪", "首次提取 5 个职位", "2026-08-20", None, False, False),
        ("positions_updated", "岗位表更新", "岗位需求变动为 9 个职位", "2026-08-20", None, True, False),
        ("content_updated", "地点调整", "新增济南", "2026-08-20", None, True, False),
        ("content_updated", "地点调整", "补全新增", "2026-08-20", None, False, False),
        (None, None, None, None, None, False, False),
    ],
)
def change_facts(kind, label, detail, date):
    """What a change amounts to."""
    return [facts.deadline_change_kind(kind, label, detail, date), facts.substantive_change(kind, label, detail, date), facts.rolling_deadline(date, F.coalesce(detail, F.lit("")))]


@cases({"day": S, "sub": "boolean", "change": S}, ["out"], [("2026-09-01", True, "2026-09-05", "2026-09-05"), ("2026-09-01", False, "2026-09-05", "2026-09-01"), ("2026-09-01", True, "2026-09-11", "2026-09-01"), ("", True, "2026-09-10", "2026-09-10")])
def newest_day(day, sub, change):
    """P20: the day a row sorts by."""
    return [facts.effective_day(day, sub, change, F.lit("2026-09-10"))]


@cases(
    {"deadline": S, "status": S, "kind": S, "verified": "boolean", "checked": S}, ["out"],
    [
        ("2026-09-09", "active", "open", True, "2026-09-09T00:00:00Z", "closed"), ("2026-09-10", "active", "open", True, "2026-09-09T00:00:00Z", "confirmed_open"), ("", "withdrawn", "open", True, "2026-09-09T00:00:00Z", "closed"),
        ("", "active", "long_term", True, None, "long_term"), ("", "active", "open", True, "2026-08-01T00:00:00Z", "unconfirmed"), ("", "active", "open", False, "2026-09-09T00:00:00Z", "unconfirmed"), ("", None, None, None, None, "unconfirmed"),
    ],
)
def validity_status(deadline, status, kind, verified, checked):
    """P25."""
    return [facts.validity(deadline, status, kind, verified, checked, F.lit(None).cast("string"), now())]


@cases(
    {"actual": S}, ["bachelor", "master", "junior"],
    [
        ("本科及以上", True, True, False), ("硕士", False, True, False), ("专科及以下", False, False, True), ("不限", True, True, True), ("未明确", True, True, True), (None, True, True, True), ("本科", True, False, False), ("2026届 本科及以上", True, True, False), ("研究生", False, True, False), ("大专及以上", True, True, True),
    ],
)
def education_ranges(actual):
    """F8: levels within the range a text opens; unknown counts here."""
    return [facts.education_matches(actual, w, True) for w in ("本科", "硕士", "大专")]


@cases({"t": S}, ["ai", "cpp", "kj"], [("AI 工程师", True, False, False), ("email 会计", False, False, True), ("c++开发", False, True, False), ("（AI）", True, False, False), ("xc++", False, False, False), ("", False, False, False)])
def keyword_boundary(t):
    """ASCII keywords between boundaries."""
    return [text.has_keyword(t, "AI"), text.has_keyword(t, "c++"), text.has_keyword(t, "会计")]


@cases({"t": S}, ["out"], [("2026-09-09T00:00:00Z", True), ("2026-08-11T04:00:00Z", True), ("2026-08-11T03:59:00Z", False), ("2026-09-11T04:00:00Z", True), ("2026-09-11T04:00:01Z", False), ("x", False), (None, False)])
def recent_dates(t):
    """thirty days back to one ahead."""
    return [timeutil.recent(t, now())]


@cases({"d": S, "a": S, "b": S}, ["out"], [("2026-09-10", "14:00", "16:00", "2026-09-10 08:00:00"), ("2026-09-10", None, None, "2026-09-10 15:59:00"), ("bad", None, None, None)])
def event_ends(d, a, b):
    """end of an event, 23:59 when none is known."""
    return [F.date_format(timeutil.event_end(d, a, b), "yyyy-MM-dd HH:mm:ss")]


@cases({"v": "double"}, ["out"], [(1757476800.0, "2025-09-10 04:00:00"), (1757476800000.0, "2025-09-10 04:00:00"), (100.0, None), (4e12, None), (None, None)])
def source_epochs(v):
    """Seconds or milliseconds."""
    return [F.date_format(timeutil.source_epoch(v, now()), "yyyy-MM-dd HH:mm:ss")]


@cases({"t": S}, ["escaped", "folded"], [("a;b,c\\d\ne", "a\\;b\\,c\\\\d\\ne", "a;b,c\\d\ne"), ("招" * 26, "招" * 26, "招" * 25 + "\r\n 招"), ("x" * 75, "x" * 75, "x" * 75), ("x" * 76, "x" * 76, "x" * 75 + "\r\n x"), ("", "", "")])
def calendar_text(t):
    """Escapes, and folding at 75 octets."""
    return [text.ics_escaped(t), text.fold_lines(t)]


@cases({"a": S, "b": S}, ["ratio", "alike"], [("甲乙丙", "甲乙丁", 0.666667, True), ("甲", "甲甲甲", 1.0, True), ("甲乙", "丙丁", 0.0, False), ("", "甲", 0.0, False)])
def character_overlap(a, b):
    """Share of characters of the smaller set."""
    return [F.round(text.char_overlap(a, b), 6), collection.similar_names(a, b)]


@cases({"t": S}, ["out"], [("面向2026届、2027应届毕业生", "2026|2027"), ("26届和27届", "2026|2027"), ("2023届", ""), ("2030年高校毕业生", "2030"), ("126届", ""), ("无", "")])
def class_years(t):
    """E2."""
    return [joined(facts.graduation_years(t))]


@cases(
    {"evidence": LIST, "cities": LIST}, ["out"],
    [(["工作地点：美国"], [], "overseas"), (["国内外"], [], "domestic"), (["美国", "全国"], [], "mixed"), (None, ["济南"], "domestic"), (None, None, "unknown"), (["英国"], ["济南"], "mixed")],
)
def home_or_abroad(evidence, cities):
    """P28."""
    return [titles.domestic_status(evidence, cities)]


@cases(
    {"body": S}, ["kind", "available", "words"],
    [
        ("工作性质：全职", "full_time", None, None), ("2026实习生招聘：若干", "internship", None, None), ("岗位性质:兼职\n招聘时间：长期招聘", "part_time", "long_term", "招聘时间：长期招聘"), ("招聘状态：招聘中", "unknown", "open", "招聘状态：招聘中"), ("无", "unknown", None, None),
    ],
)
def employment_facts(body):
    """Kind of employment and statements of availability."""
    a = titles.availability(body)
    return [titles.employment_type(body), a["kind"], a["text"]]


@cases(
    {"title": S, "body": S, "deadline": S, "status": S, "change": S}, ["out"],
    [
        ("公告", "", "2026-09-01", "active", None, "expired"), ("公告", "", "2026-09-12", "active", None, "expiring_soon"), ("延期公告", "", "2026-10-12", "active", None, "extended"), ("补录公告", "", "", "active", None, "supplemental"),
        ("公告", "笔试安排如下", "", "active", None, "selection"), ("公告", "", "", "unconfirmed", None, "unconfirmed"), ("公告", None, "2026-10-12", "active", "deadline_extended", "extended"), ("公告", "", "", "withdrawn", None, "expired"), ("公告", "", "", "active", None, "accepting"),
    ],
)
def stored_stages(title, body, deadline, status, change):
    """P24."""
    return [titles.stored_stage(title, body, deadline, status, change, "2026-09-10")]


@cases({"kind": S, "detail": S, "recent": "boolean"}, ["out"], [("extended", "延长至 10月1日；其他", True, "延长至 10月1日"), ("extended", "x", False, None), ("positions_updated", "首次提取 3 个职位", True, None), ("positions_updated", "变动为 4 个职位", True, "变动为 4 个职位"), ("other", "x", True, None)])
def change_alerts(kind, detail, recent):
    """P44."""
    return [titles.change_alert(kind, detail, recent)]


@cases({"t": S}, ["out"], [("2026届 本科", "本科"), ("26届/27届、硕士", "硕士"), ("", "学历待核实"), (None, "学历待核实"), ("未明确", "学历待核实"), ("本科及以上", "本科及以上")])
def education_labels(t):
    """P45."""
    return [titles.education_display(t)]


@cases({"types": LIST, "kind": S, "source": S}, ["out"], [(["社招"], "公告", "x", "社招"), ([], "具体岗位", "s-positions", "校招"), (None, "具体岗位", "s-jobs", "校招"), (None, "公告", "s-jobs", ""), ([], "具体岗位", "s-talks", "")])
def type_inference(types, kind, source):
    """Types that follow from a campus source."""
    return [joined(titles.job_types(types, kind, source))]


@cases({"v": "double"}, ["out"], [(4.5, 5), (5.0, 5), (8.1, 10), (10.0, 10), (88.0, 100)])
def score_scales(v):
    """P51."""
    return [titles.score_scale(v)]


@cases({"cities": LIST, "title": S}, ["out"], [([], "全国招聘", True), (["济南"], "全国招聘", False), (None, "各地分支机构", True), (None, "招聘", False)])
def nationwide_flag(cities, title):
    """P7."""
    return [publish.nationwide(cities, title)]


@cases(
    {"cities": LIST, "detail": S, "other": "boolean"}, ["out"],
    [(["济南"], None, False, "exact"), (["青岛"], None, False, "none"), ([], "工作地点：济南市", False, "exact"), ([], "山东省各地", False, "possible"), ([], "全国", False, "possible"), ([], "全国", True, "none"), ([], "", False, "unknown")],
)
def location_scopes(cities, detail, other):
    """Scope of a row for one city."""
    return [facts.city_scope("济南", "山东", cities, detail, other)]


@cases(
    {"company": S, "source": S}, ["scope", "holder", "name", "back"],
    [
        ("甲科技有限公司", "s1", "name", "", "甲科技有限公司", "甲科技有限公司"), ("甲、乙公司", "s1", None, None, None, None), ("", "b1", "brand", "", "甲银行", "甲银行"), ("", "s1", None, None, None, None),
        ("财务部", "b1", "department", "甲银行", "财务部", "财务部"), ("某工作室", "s1", "source", "s1", "某工作室", "某工作室"), ("山东大学", "s1", "name", "", "山东大学", "山东大学"),
    ],
)
def employer_identity(company, source):
    """Who an employer is, and back from its id."""
    who = employers.identity(company, source, {"b1": "甲银行"})
    return [who["scope"], who["source"], who["name"], employers.identity_from(employers.identity_id(who))["name"]]


@cases({"title": S, "url": S, "body": S, "kind": S}, ["ok"], [("a", "https://x", "", "公告", True), ("", "https://x", "b", "公告", False), ("a", "ftp://x", "b", "公告", False), ("a", "http://x", "", "具体岗位", False), ("a", "http://x", "b", "具体岗位", True)])
def publishable_rows(title, url, body, kind):
    """F19."""
    return [F.coalesce(collection.publishable(title, url, body, kind), F.lit(False))]


@cases({"title": S}, ["ok"], [("某市2026年公开招聘公告", True), ("首页招聘信息列表更多", False), ("全市工作会议召开学习贯彻招聘", False), ("招聘公告", False)])
def government_titles(title):
    """titles of notices."""
    return [collection.government_article(title)]


@cases(
    {"total": "int", "failing": "int", "stale": "int", "events": "int"}, ["out"],
    [(0, 0, 0, 0, "no source"), (3, 3, 0, 2, "all failing"), (3, 1, 0, 2, "ok"), (3, 1, 1, 0, "stale"), (3, 0, 0, 0, "no event")],
)
def agenda_coverage(total, failing, stale, events):
    """H13."""
    return [collection.coverage_message(total, failing, stale, events)]


@cases(
    {"title": S, "body": S, "change": S}, ["notice", "standing"],
    [("面试名单公示", "", None, True, False), ("公告", "笔试时间安排：3月", None, True, False), ("公告", "面试安排另行通知", None, False, False), ("公告", "", "selection_stage", True, False), ("长期招聘", "", None, False, True), (None, "招满为止", None, False, True)],
)
def evidence_facts(title, body, change):
    """H7."""
    empty = F.lit("")
    return [display.selection_notice(title, body, empty, change), display.long_term(title, body, empty)]


@cases(
    {"t": S}, ["out", "on_"],
    [("2026-09-01", "2026-09-01 01:00:00", False), ("2026-09-01T10:00:00Z", "2026-09-01 10:00:00", False), ("2026-09-01 10:00:00", "2026-09-01 02:00:00", False), ("soon", "2026-09-10 04:00:00", False), (None, "2026-09-10 04:00:00", False), (" Yes ", "2026-09-10 04:00:00", True)],
)
def feed_times(t):
    """A feed's time with its fallback, and a switch's text."""
    return [F.date_format(display.feed_time(t, now()), "yyyy-MM-dd HH:mm:ss"), display.switched_on(t)]


@cases(
    {"row": MAP, "url": S, "page": "int"}, ["company", "link"],
    [({"companyName": " ", "unitName": "甲"}, "https://b.cn/zp/index.html", 1, "甲", "https://b.cn/zp/index.html"), ({"companyName": "乙", "orgName": "丙"}, "https://b.cn/zp/index.html", 3, "乙", "https://b.cn/zp/index_2.html"), ({}, "https://b.cn/zp/", 2, "", "https://b.cn/zp/index_1.html")],
)
def page_helpers(row, url, page):
    """An employer's field, and a list's next page."""
    return [display.first_given(row), display.list_page_url(url, page)]


@cases(
    {"scope": S, "brand": S, "source": S, "name": S}, ["label", "links", "first"],
    [("department", "甲银行", "s", "财务部", "甲银行 · 财务部", 3, "https://www.bing.com/search?q=site%3Akanzhun.com%20%22%E8%B4%A2%E5%8A%A1%E9%83%A8%22%20%E5%85%AC%E5%8F%B8%E8%AF%84%E4%BB%B7"), ("department", None, "s", "财务部", "s · 财务部", 3, "https://www.bing.com/search?q=site%3Akanzhun.com%20%22%E8%B4%A2%E5%8A%A1%E9%83%A8%22%20%E5%85%AC%E5%8F%B8%E8%AF%84%E4%BB%B7"), ("name", None, "", "", "", 0, None)],
)
def employer_links(scope, brand, source, name):
    """H14."""
    links = display.research_links(name)
    return [display.employer_label(scope, brand, source, name), F.size(links), F.get(links, F.lit(0))]


MATH = majors.MajorProfile(words=("数学与应用数学",), exact=("数学",), broad=("理学类",), off_track=("销售",), roles=("建模", "ai"))


@cases(
    {"m": LIST, "role": S}, ["strict", "loose"],
    [
        (["0701 数学与应用数学", "物理学"], "教师", True, True), (["数学类", "化学"], "教师", True, True), (["应用物理"], "建模师", False, False), (["理学类"], "销售经理", False, False), (["理学类"], "研究员", True, True), (["理学类"], "销售建模", True, True),
        (["专业不限"], "客服", False, True), (["不限"], "AI 算法", True, True), ([], "AI 算法", True, True), (None, "客服", False, False), (["会计学", "专业不限"], "客服", False, True), (["高等数学教育"], "教师", False, False),
    ],
)
def major_match(m, role):
    """Named directly, by a broad class unless off the track, by no limit, by the role."""
    wanted = majors.profiles("数学", {"数学": MATH})
    return [majors.matches_major(m, role, wanted), majors.matches_major(m, role, wanted, True)]


@cases({"m": S, "role": S}, ["term", "sibling", "tokens"], [("计算机科学与技术专业、软件工程", "开发", "软件", True, "计算机科学与技术专业|软件工程|计算机科学与技术"), ("CS、数学", "x", "CS", True, "cs|数学"), ("法学", "软件测试", "软件", False, "法学"), ("EE", "x", None, True, "ee"), (None, None, None, False, "")])
def major_clauses(m, role):
    """The term or alias that an announcement names, a sibling's, and its clauses."""
    groups = {"计算机": ["软件工程", "CS", "EE"], "法": ["法律"]}
    found = majors.categories_of("", ["cs"], groups, {})
    return [majors.concrete_match(["软件"], m, role, {"软件": ["CS"]}), majors.sibling_match(found, m, groups), joined(majors.clause_tokens(F.coalesce(m, F.lit(""))))]


@cases({"old": LIST, "new": LIST}, ["added", "removed", "possible"], [(["济南", "青岛"], ["青岛", "烟台"], "烟台", "济南", "烟台"), (None, ["济南"], "济南", "", None), (["a"], None, "", "a", None), ([], [], "", "", "")])
def list_changes(old, new):
    """What two lists differ in."""
    d = content.set_changes(old, new)
    return [joined(d["added"]), joined(d["removed"]), joined(content.possible_cities(new, old))]


@cases({"c": S, "labels": LIST}, ["inst", "sel", "own"], [("事业单位统考", [], True, False, False), ("其他", ["事业编"], True, False, False), ("其他", ["选调生"], False, True, False), ("社区工作者", None, False, False, True), (None, None, False, False, False)])
def exam_categories(c, labels):
    """F16: what a category's name stands for."""
    return [examfilter.category_matches(c, labels, w) for w in ("事业单位", "选调生", "社区工作者")]


@cases({"status": S}, ["done"], [("withdrawn", True), ("failed_audit", True), ("registered", False), (None, False)])
def track_ends(status):
    """H11."""
    return [examfilter.tracked_to_an_end(status)]


@cases(
    {"body": S}, ["days", "sole"],
    [("报名时间：2026年3月5日至2026年3月10日", "2026-03-05|2026-03-10", None), ("投递截止 2026-4-1。发布于2026年1月1日", "2026-04-01", "2026-04-01"), ("网申时间：2026年2月30日", "", None), (None, "", None), ("截止2026/5/1；截止2026.05.01", "2026-05-01", "2026-05-01")],
)
def deadline_candidates(body):
    """Days on lines that speak of an end, and the only one."""
    return [joined(extract.deadlines(body)), extract.sole_deadline(body)]


@cases({"t": S}, ["out"], [("1.数学、物理学；化学", "数学|物理学|化学"), ("不限", ""), ("会计学专业，法学等相关专业", "会计学|法学"), ("数学/数学", "数学"), (None, ""), ("A", "")])
def majors_of_cell(t):
    """Majors of a cell, without noise."""
    return [joined(extract.split_majors(t))]


@cases({"t": S}, ["out"], [("招聘软件工程师3名，会计专员 2 人", "软件工程师:3|会计专员:2"), ("无岗位", ""), (None, ""), ("行政助理（10名）", "行政助理:10")])
def positions_of_prose(t):
    """Names and headcounts in prose."""
    return [joined(F.transform(extract.prose_positions(t), lambda p: F.concat_ws(":", F.regexp_replace(p["name"], "^招聘", ""), p["count"].cast("string"))))]


@cases(
    {"title": S, "body": S}, ["category", "kinds", "role"],
    [
        ("中央机关及其直属机构2026年度考试录用公务员公告", "", "公务员国考", "公务员（行政编）", "招考简章"), ("某省2026年选调生招录面试安排", None, "选调生招录", "选调生", "资格复审/面试"), ("某县教育系统公开招聘教师公告", "", "教师公开招聘", "教师编", "招考简章"),
        ("某市医院招聘体检公示", "", "医疗卫生招聘", "事业编", "体检/递补/公示"), ("某单位招聘公告", "控制总量人员若干", "事业单位单招", "控制总量 / 备案制", "招考简章"), ("某大学公开招聘准考证打印", "", "高校 / 科研院所", "事业编", "准考证/笔试"), ("笔试成绩查询", "", "事业单位单招", "事业编", "成绩/进面"),
    ],
)
def exam_classes(title, body):
    """Category, kinds of permanent post and role of a notice."""
    return [exams.category(title, body), joined(exams.bianzhi(title, body)), exams.notice_role(title)]


@cases(
    {"body": S, "published": S}, ["start_", "end_", "written", "mode"],
    [
        ("报名时间：2026年3月1日至3月5日。笔试时间：4月10日。", "2026-02-20", "2026-03-01", "2026-03-05", "2026-04-10", "window"), ("网上报名：3月1日-5日", "2026-02-20", "2026-03-01", "2026-03-05", None, "window"), ("常年招聘，招满为止", "2026-01-01", None, None, None, "rolling"),
        ("报名期限 2026-03-09", "2026-02-20", None, "2026-03-09", None, "window"), (None, None, None, None, None, "window"),
    ],
)
def exam_schedules(body, published):
    """Milestone days of a notice."""
    s = exams.schedule(body, published)
    return [s["reg_start"], s["reg_end"], s["written_exam_date"], s["reg_mode"]]


@cases(
    {"start": S, "end": S, "pay": S, "written": S, "mode": S, "role": S, "published": S}, ["stage", "step", "left_"],
    [
        ("2026-09-20", "2026-09-25", None, None, "window", "招考简章", "2026-09-01", "upcoming", "reg_end", 15), ("2026-09-01", "2026-09-12", None, None, "window", "招考简章", "2026-09-01", "closing_soon", "reg_end", 2), ("2026-09-01", "2026-09-30", None, None, "window", "招考简章", "2026-09-01", "registering", "reg_end", 20),
        ("2026-08-01", "2026-09-01", "2026-09-11", None, "window", "招考简章", "2026-08-01", "payment_confirm", "payment_end", 1), ("2026-08-01", "2026-09-01", None, "2026-10-01", "window", "招考简章", "2026-08-01", "admit_exam", "written_exam_date", 21), ("2026-08-01", "2026-09-01", None, None, "window", "招考简章", "2026-08-01", "ended", None, None),
        (None, None, None, None, "rolling", "招考简章", "2026-08-01", "rolling", None, None), (None, None, None, None, "window", "体检/递补/公示", "2026-09-01", "publicity", None, None), (None, None, None, None, "window", "成绩/进面", "2026-07-01", "ended", None, None), (None, None, None, None, "window", "招考简章", "2026-09-01", "unknown", None, None),
    ],
)
def exam_stages(start, end, pay, written, mode, role, published):
    """Stage of an exam, and its next step."""
    none = F.lit(None).cast("string")
    s = F.struct(start.alias("reg_start"), end.alias("reg_end"), none.alias("audit_end"), pay.alias("payment_end"), none.alias("admit_card_start"), written.alias("written_exam_date"), none.alias("interview_date"), mode.alias("reg_mode"))
    step = exams.next_step(s, "2026-09-10")
    return [exams.stage(s, role, published, "2026-09-10"), step["step"], step["days_left"]]


@cases({"stage": S}, ["label"], [("registering", "报名中"), ("ended", "已结束"), ("other", ""), (None, "")])
def stage_badges(stage):
    """Label of a stage."""
    return [exams.badge(stage, {"registering": "报名中", "ended": "已结束"})]


@cases(
    {"education": S, "degree": S, "political_status": S, "fresh_grad_rule": S, "other_conditions": S, "hukou_rule": S, "major_raw": S, "majors": LIST, "age_limit": S}, ["status", "conflicts", "unknowns"],
    [
        ("本科及以上", "学士", "不限", "不限", "", "不限", "数学类", [], "35周岁以下", "eligible", "", ""), ("硕士研究生", "硕士", "中共党员", "当年应届", "", "济南市户籍", "法学", [], "25周岁以下", "ineligible", "education|political|graduate|major|age", ""),
        ("详见公告", "", "", "", "", "", "", [], "", "unknown", "", "education|degree|political|graduate|hukou|major|age"), ("仅限专科", "无要求", "不限", "不限", "", "不限", "专业不限", [], "30周岁以下", "ineligible", "education", ""), ("本科", "学士", "不限", "不限", "2年及以上基层工作经历", "不限", "数学", [], "35周岁以下", "ineligible", "grassroots", ""),
    ],
)
def exam_eligibility(education, degree, political_status, fresh_grad_rule, other_conditions, hukou_rule, major_raw, majors, age_limit):
    """eight dimensions of a position for one applicant."""
    p = exams.Profile(education="本科", has_degree=True, political="群众", graduate="在职/社会人员", hukou="济南", majors=("数学",), birth_year=1998, as_of_year=2026)
    e = exams.eligibility(p)
    return [e["status"], joined(e["conflicts"]), joined(e["unknowns"])]


@cases({"t": S}, ["named", "or_county", "coded"], [("在济南和青岛工作", "济南|青岛", "济南|青岛", ""), ("千佛山", "", "", ""), ("历下区", "", "济南", ""), ("吉林省、吉林", "吉林", "吉林", ""), ("370102 历城", "", "", "济南"), ("1370102", "", "", ""), (None, "", "", "")])
def places_in_text(t):
    """Cities by name, by county and by code; homonyms are none."""
    cities = {"济南": ["济南"], "青岛": ["青岛"], "佛山": ["佛山"], "吉林": ["吉林"], "两地": ["济南", "青岛"]}
    return [joined(places.named_places(t, cities)), joined(places.places_or_counties(t, cities, {"历下": ["济南"]})), joined(places.coded_places(t, {"370102": "济南"}))]


@cases(
    {"failures": "int", "transport": "boolean", "gone": "boolean", "hours": "int"}, ["due"],
    [(0, False, False, 0, False), (0, True, False, 1, True), (1, False, False, 2, True), (9, True, False, 4, True), (9, True, False, 3, False), (9, False, False, 72, True), (9, False, False, 71, False), (0, False, True, 23, False), (0, False, True, 24, True)],
)
def retries(failures, transport, gone, hours):
    """T5: when a deferred detail may be tried again."""
    return [collection.retry_due(F.timestamp_micros(F.unix_micros(now()) - hours * 3_600_000_000), failures, transport, gone, now())]


@cases({"d": S}, ["turn"], [("2026-01-01", 1), ("2026-01-05", 0), ("2026-12-31", 0)])
def source_turns(d):
    """The group whose turn it is."""
    return [upsert.rotating_group(d.cast("date"), 5)]


@cases({"body": S, "content": S, "kind": S}, ["answer"], [("{}", "application/json", "click", 204), ("{}", "text/plain", "click", 415), ("x" * 5000, "application/json; charset=utf-8", "click", 413), ("{}", "application/json", "other", 400), ("{}", None, "click", 415)])
def telemetry_answers(body, content, kind):
    """What an endpoint answers."""
    return [telemetry.verdict(body, content, kind)]


@cases({"t": S}, ["out"], [("招聘岗位：软件工程师、会计（2名）、1.法务、不限", "软件工程师|会计|法务"), ("热招岗位: 客服/客服/算法", "客服"), ("岗位：会计", ""), (None, ""), ("a\n需求岗位：管培生 销售代表。财务", "管培生|销售代表")])
def sample_posts(t):
    """Posts that a line lists."""
    return [joined(extract.sample_posts(t))]


@cases(
    {"venue": S, "school": S, "excerpt": S}, ["place", "words"],
    [
        ("山东大学 中心校区报告厅", "山东大学", "薪资：：面议；；双休", "中心校区报告厅", "薪资：面议；双休"), ("报告厅报告厅201", "", "a，， b   c", "报告厅201", "a， b c"), ("【中心校区】中心校区 大厅", None, None, "中心校区 大厅", ""), ("大厅（山东大学）", "山东大学", " 单位介绍与岗位说明请查看原公告。 ", "大厅", ""),
        ("大厅（东区）", "山东大学", "x: ：y", "大厅（东区）", "x：y"), ("山东大学", "山东大学", "", "山东大学", ""), (None, None, "只有一句。", "", "只有一句。"), ("东区大厅（东区）", "", "；", "东区大厅", "；"),
    ],
)
def display_forms(venue, school, excerpt):
    """Venues without repeats, excerpts without doubled signs."""
    return [titles.venue_display(venue, school), titles.clean_excerpt(excerpt)]
