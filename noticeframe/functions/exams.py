"""Exam notices: classes, schedule, stage, next step, eligibility."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .facts import all_labels, first_label, verdict
from .text import spaced, trimmed

# Fixed values: (label, pattern), the first that occurs counts.
TITLE_FIRST = (
    ("公务员国考", "中央机关及其直属机构|国家公务员|国考"),
    ("选调生招录", "选调生|选调应届优秀|鲁选|青年人才选调"),
    ("公务员省考", "考试录用公务员|省级机关及其直属机构|省考|公务员招考|公开遴选公务员|选调公务员"),
    ("军队文职招考", "军队文职|公开招考.*文职人员|战区.*文职|文职方阵|直接引进文职人员"),
    ("三支一扶 / 基层", "三支一扶|西部计划|社区工作者|网格员|特岗教师"),
    ("事业单位统考", "初级综合类|统一公开招聘|事业单位统考|省属事业单位公开招聘"),
    ("教师公开招聘", "教育系统|教体局|教育和体育局|中小学教师|幼儿教师|公开招聘.*教师|教师招考|公费师范|附属小学|附属学校"),
    ("医疗卫生招聘", "卫健|卫生健康|医院|医疗卫生|妇幼保健|疾控|中医药|公共卫生|精神卫生|荣军优抚"),
    ("高校 / 科研院所", "^(?!.*(?:毕业生|直通名校)).*(?:大学|学院|研究院|科学院|科研院所|技师学院|党校)"),
    ("人才引进 / 优才", "引进.*人才|青年人才|急需紧缺|优才|高层次人才|人才引进|硕博"),
)
TITLE_AND_TEXT = {"公务员国考", "公务员省考", "军队文职招考", "三支一扶 / 基层"}
BIANZHI = (
    ("选调生", "选调生|选调应届|优选选调|常规选调"),
    ("公务员（行政编）", "考试录用公务员|公务员招录|公务员考试|中央机关及其直属机构|公开遴选公务员|选调公务员|行政编"),
    ("参公管理", "参照公务员法|参公管理|参公单位"),
    ("军队文职", "军队文职|文职人员|部队文职|战区.*文职"),
    ("三支一扶 / 基层项目", "三支一扶|西部计划|社区工作者|城乡社区|网格员|特岗教师|基层服务"),
    ("控制总量 / 备案制", "控制总量|人员控制总量|备案制|员额制"),
    ("教师编", "中小学.*教师|幼儿园.*教师|教育系统.*公开招聘|教体局.*招聘|公开招聘.*教师|教师公开招聘|公费师范"),
    ("医疗卫生编", "卫生健康|卫健|医院.*公开招聘|医疗卫生|妇幼保健|疾控中心|医共体"),
    ("高层次 / 紧缺人才", "引进.*人才|青年人才|急需紧缺人才|高层次人才|优才计划|硕博优选|人才直通车"),
    ("事业编", "事业单位|事业编|全额拨款|差额补贴|财政拨款|省属事业|市属事业"),
)
ROLES = (
    ("报名统计", "报名人数|报名情况|核减|取消.*计划|改报"),
    ("准考证/笔试", "^(?!.*报名时间).*(?:准考证|笔试通知|笔试安排|笔试时间|笔试考点|笔试温馨)"),
    ("成绩/进面", "成绩查询|笔试成绩|综合成绩|面试成绩|合格分数线|进入面试范围|入围人员名单"),
    ("资格复审/面试", "资格审查|资格复审|面试通知|面试安排|面试时间|面试有关事宜|面谈"),
    ("体检/递补/公示", "体检|考察|政审|递补|拟聘用|拟录用|拟录取|公示"),
    ("补充公告", "补充公告|更正公告|延期|延长报名"),
)
#: Sentences that speak of a milestone.
MILESTONES = {
    "reg": "报名时间|网上报名|提交报名|报名起止|报名期限",
    "audit": "初审时间|资格初审|资格审核",
    "payment": "缴费时间|网上缴费|报名确认",
    "admit_card": "准考证",
    "written_exam": "笔试时间|笔试于",
    "interview": "面试时间|面试于",
}
EDUCATION = {"专科": 2, "本科": 3, "硕士研究生": 4, "博士研究生": 5}
UNKNOWN = "详见|见附件|见公告|见原|未明确|待定|另行"


def category(title: Column, body: Column) -> Column:
    """Exam category; four classes are also read from the start of the body."""
    both = F.concat_ws("\n", title, F.substring(F.coalesce(body, F.lit("")), 1, 1500))
    out = F
    for label, pattern in TITLE_FIRST:
        out = out.when((both if label in TITLE_AND_TEXT else title).rlike(f"(?s){pattern}" if "^" in pattern else pattern), label)
    return out.otherwise("事业单位单招")


def bianzhi(title: Column, body: Column) -> Column:
    """All establishment types, the last as default."""
    found = all_labels(F.concat_ws("\n", title, F.substring(F.coalesce(body, F.lit("")), 1, 3000)), BIANZHI)
    return F.when(F.size(found) == 0, F.array(F.lit(BIANZHI[-1][0]))).otherwise(found)


def notice_role(title: Column) -> Column:
    return first_label(title, ROLES, "招考简章")


def _dates(segment: Column, year: Column) -> Column:
    """Days of a sentence in order; a missing year or month is that of the date before."""
    pattern = spaced(r"(?:(202\d)\s*[年.-]\s*)?(?:(\d{1,2})\s*[月.-]\s*)?(\d{1,2})\s*日|(202\d)-(\d{1,2})-(\d{1,2})")
    group = lambda n: F.regexp_extract_all(segment, F.lit(pattern), F.lit(n))
    parts = F.arrays_zip(*[group(n).alias(f"g{n}") for n in range(1, 7)])
    start = F.struct(year.alias("y"), F.lit("").alias("m"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        iso = x["g4"] != ""
        y = F.when(iso, x["g4"]).when(x["g1"] != "", x["g1"]).otherwise(a["y"])
        m = F.when(iso, x["g5"]).when(x["g2"] != "", x["g2"]).otherwise(a["m"])
        d = F.when(iso, x["g6"]).otherwise(x["g3"])
        day = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
        return F.struct(y.alias("y"), m.alias("m"), F.when(m == "", a["out"]).otherwise(F.array_append(a["out"], day)).alias("out"))

    return F.aggregate(parts, start, step, lambda a: a["out"])


def schedule(body: Column, published_at: Column) -> Column:
    """Struct of milestone days: first sentence of each that has dates. Rolling notices say so."""
    year = F.regexp_extract(F.coalesce(published_at, F.lit("")), r"^(202\d)", 1)
    segments = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), "[\r\n。；;！!]+"), lambda s: trimmed(F.regexp_replace(s, spaced(r"\s+"), " "))), lambda s: s != "")

    def dates(words: str) -> Column:
        found = F.filter(F.transform(F.filter(segments, lambda s: s.rlike(words)), lambda s: _dates(s, year)), lambda d: F.size(d) > 0)
        return F.get(found, F.lit(0))

    reg = dates(MILESTONES["reg"])
    last = lambda k: F.when(F.size(dates(MILESTONES[k])) > 0, F.element_at(dates(MILESTONES[k]), -1))
    return F.struct(
        F.when(F.size(reg) > 1, reg[0]).alias("reg_start"),
        F.when(F.size(reg) > 0, F.element_at(reg, -1)).alias("reg_end"),
        last("audit").alias("audit_end"),
        last("payment").alias("payment_end"),
        F.get(dates(MILESTONES["admit_card"]), F.lit(0)).alias("admit_card_start"),
        F.get(dates(MILESTONES["written_exam"]), F.lit(0)).alias("written_exam_date"),
        F.get(dates(MILESTONES["interview"]), F.lit(0)).alias("interview_date"),
        F.when(F.coalesce(body, F.lit("")).rlike("长期有效|招满为止|随时报名|常年招聘"), "rolling").otherwise("window").alias("reg_mode"),
    )


def stage(s: Column, role: Column, published_at: Column, today: str) -> Column:
    """Stage on a day; days compare as text, as they are ISO."""
    day = F.lit(today)
    age = F.datediff(F.to_date(day), F.try_to_timestamp(F.substring(published_at, 1, 10)).cast("date"))
    ahead = lambda f: F.coalesce(s[f] >= day, F.lit(False))
    left = F.datediff(F.try_to_timestamp(F.substring(s["reg_end"], 1, 10)).cast("date"), F.to_date(day))
    notice = role != "招考简章"
    return (
        F.when(notice & (age > 45), "ended")
        .when(role == "体检/递补/公示", "publicity")
        .when(role.isin("成绩/进面", "资格复审/面试"), "interview_review")
        .when(role == "准考证/笔试", "admit_exam")
        .when(s["reg_mode"] == "rolling", "rolling")
        .when(F.coalesce(s["reg_start"] > day, F.lit(False)), "upcoming")
        .when(ahead("reg_end") & left.between(0, 3), "closing_soon")
        .when(ahead("reg_end"), "registering")
        .when(s["reg_end"].isNotNull() & (ahead("payment_end") | ahead("audit_end")), "payment_confirm")
        .when(s["reg_end"].isNotNull() & (ahead("written_exam_date") | ahead("admit_card_start")), "admit_exam")
        .when(s["reg_end"].isNotNull() & ahead("interview_date"), "interview_review")
        .when(s["reg_end"].isNotNull() | (age > 60), "ended")
        .otherwise("unknown")
    )


def next_step(s: Column, today: str) -> Column:
    """struct(step, day, days_left): the nearest milestone not past; null when none is left."""
    order = ("reg_end", "audit_end", "payment_end", "admit_card_start", "written_exam_date", "interview_date")
    steps = F.array(*[F.struct(s[f].alias("day"), F.lit(n).alias("n"), F.lit(f).alias("step")) for n, f in enumerate(order)])
    first = F.array_min(F.filter(steps, lambda x: x["day"].isNotNull() & (x["day"] >= today)))
    return F.when(first.isNotNull(), F.struct(first["step"].alias("step"), first["day"].alias("day"), F.datediff(F.to_date(first["day"]), F.to_date(F.lit(today))).alias("days_left")))


@dataclass(frozen=True)
class Profile:
    """Parameters of an applicant; empty means not stated."""

    education: str = ""
    has_degree: bool | None = None
    political: str = ""
    graduate: str = ""
    grassroots_years: int = 0
    hukou: str = ""
    majors: tuple[str, ...] = ()
    birth_year: int | None = None
    as_of_year: int = 2026


def _unknown(text: Column) -> Column:
    return (F.coalesce(text, F.lit("")) == "") | text.rlike(UNKNOWN)


def eligibility(p: Profile, province: str = "山东", cities: tuple[str, ...] = ()) -> Column:
    """struct(status, conflicts, unknowns) of a position row: education, degree, political status,
    graduate status, grassroots years, registered residence, major, age, in this order."""
    text = lambda c: F.coalesce(c, F.lit(""))
    conflicts, unknowns = [], []
    add = lambda to, test, label: to.append(F.when(F.coalesce(test, F.lit(False)), F.lit(label)))
    if p.education in EDUCATION:
        e, own = text("education"), EDUCATION[p.education]
        need = F.when(_unknown(e) | e.rlike("大学及以上|^大学$"), -1).when(e.rlike("不限"), 0).when(e.rlike("专科|大专|高职"), 2).when(e.rlike("本科"), 3).when(e.rlike("硕士|研究生") & ~e.rlike("博士"), 4).when(e.rlike("博士"), 5).when(e.rlike("中专|高中"), 1).otherwise(-1)
        most = F.when(e.rlike("[仅只]限专科"), 2).when(e.rlike("[仅只]限本科") & ~e.rlike("以上|研究生"), 3).when(e.rlike("[仅只]限硕士") & ~e.rlike("以上|博士"), 4).otherwise(5)
        add(unknowns, need < 0, "education")
        add(conflicts, (need > own) | (most < own), "education")
    if p.has_degree is not None:
        add(unknowns, _unknown(text("degree")), "degree")
        add(conflicts, text("degree").rlike("学士|硕士|博士") & F.lit(not p.has_degree), "degree")
    if p.political:
        q = text("political_status")
        party, league = q.rlike("中共党员"), q.rlike("共青团员")
        add(unknowns, _unknown(q), "political")
        add(conflicts, (party & ~league & F.lit("党员" not in p.political)) | (party & league & F.lit(p.political == "群众")), "political")
    if p.graduate and p.graduate != "不限":
        g = text("fresh_grad_rule")
        only = g.rlike(r"当年应届|20\d{2}届|仅限应届") & ~g.rlike("择业期")
        some = ~only & g.rlike("应届|高校毕业生") & ~g.rlike("应往届均可|不限")
        add(unknowns, _unknown(g), "graduate")
        add(conflicts, ~_unknown(g) & ((only & F.lit(p.graduate != "当年应届")) | (some & F.lit(p.graduate == "在职/社会人员"))), "graduate")
    work = F.concat_ws(" ", "fresh_grad_rule", "other_conditions")
    said = F.translate(F.regexp_extract(work, spaced(r"(\d+|[一二两三五])\s*年及?以上基层工作经历"), 1), "一二两三五", "12235")
    add(conflicts, F.try_to_number(F.nullif(said, F.lit("")), F.lit("999")).cast("int") > p.grassroots_years, "grassroots")
    if p.hukou and p.hukou != "全部":
        h = text("hukou_rule")
        local = h.rlike("本市|本县|本区") | (h.rlike("|".join(cities)) if cities else F.lit(False))
        inside = h.rlike(f"{province}|本省|省内")
        add(unknowns, _unknown(h), "hukou")
        bad = (inside | local) if p.hukou == "省外" else ~(F.contains(h, F.lit(p.hukou)) | inside) & local
        add(conflicts, ~_unknown(h) & ~h.rlike("不限") & bad, "hukou")
    if p.majors:
        m = F.lower(F.coalesce(F.nullif(F.col("major_raw"), F.lit("")), F.array_join("majors", " "), F.lit("")))
        hit = m.rlike("不限|无限制|全部专业|所有专业")
        for major in p.majors:
            hit = hit | F.contains(m, F.lit(major.lower()))
        add(unknowns, _unknown(m), "major")
        add(conflicts, ~_unknown(m) & ~hit, "major")
    if p.birth_year is not None:
        a, own = text("age_limit"), p.as_of_year - p.birth_year
        ages = F.transform(F.regexp_extract_all(a, F.lit(spaced(r"(\d{2})\s*周岁及?以下")), F.lit(1)), lambda x: x.cast("int"))
        relaxed = {"博士研究生": spaced(r"(?:博士|硕博|研究生)[^。；\n]*?(\d{2})\s*周岁"), "硕士研究生": spaced(r"(?:硕士|硕博|(?<!博士)研究生)[^。；\n]*?(\d{2})\s*周岁")}.get(p.education, "(?!)()")
        extra = F.try_to_number(F.nullif(F.regexp_extract(a, relaxed, 1), F.lit("")), F.lit("99")).cast("int")
        limit = F.greatest(F.get(ages, F.lit(0)), extra)
        maybe = (F.lit(own) <= F.array_max(ages)) & (F.lit(p.education == "") | a.rlike("职称|特聘|退役|基层|工作经历|紧缺"))
        add(unknowns, (F.size(ages) == 0) | ((limit < own) & maybe), "age")
        add(conflicts, (F.size(ages) > 0) & (limit < own) & ~maybe, "age")
    pack = lambda x: F.array_compact(F.array(*x)) if x else F.array().cast("array<string>")
    c, u = pack(conflicts), pack(unknowns)
    return F.struct(verdict(c, u).alias("status"), c.alias("conflicts"), u.alias("unknowns"))


def badge(stage_column: Column, labels: Mapping[str, str]) -> Column:
    """Label by stage."""
    return F.coalesce(F.create_map(*[F.lit(x) for p in labels.items() for x in p])[stage_column], F.lit(""))
