"""Clean titles of examination notices, and who recruits.

Every rule that fits a title, an introduction or a source field is a candidate; the one of the lowest rank, and of a rule
the first in the text, is the organizer. All of it is one expression inside the row.

Null texts count as empty; a notice without any candidate gets a general name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, replaced, spaced, trimmed

# What a title loses at its ends.
TITLE_LOSES = (
    (r"\s+", " "), (r"^ | $", ""), (r"^(?:主题[：:]\s*|招聘\s*[|｜]\s*|事业单位\s*[|｜]\s*)", ""), (r"\s*日期[：:]?\s*$", ""),
    (r"\s+\d{3,6}\s*[-~—至]\s*\d{3,6}\s*元(?:/月|·\d+薪)?\s*$", ""), (r"\*+$", ""),
)
# Titles with one organizer, in order; those named by themselves; and how titles begin.
AUTHORITIES = (
    ("中央机关及其直属机构.*考试录用公务员", "国家公务员局"),
    ("山东省.*选拔录用选调生|山东省.*第二批选调|山东省.*公开遴选.*公务员", "中共山东省委组织部"),
    ("山东省法院系统.*考试录用公务员", "山东省高级人民法院"),
    ("山东省检察机关.*考试录用公务员", "山东省人民检察院"),
    ("山东省公安机关.*考试录用公务员", "山东省公安厅"),
    ("山东省司法行政机关.*考试录用公务员", "山东省司法厅"),
    ("山东省省级机关.*考试录用公务员", "山东省公务员局"),
    ("山东省.*三支一扶", "山东省人力资源和社会保障厅"),
    ("北部战区陆军", "北部战区陆军"),
    ("北部战区", "北部战区"), ("南部战区", "南部战区"), ("东部战区", "东部战区"), ("西部战区", "西部战区"), ("中部战区", "中部战区"),
    ("火箭军", "中国人民解放军火箭军"),
    ("武警部队", "中国人民武装警察部队"),
    ("联勤保障部队", "联勤保障部队"),
    ("军事科学院", "中国人民解放军军事科学院"),
    ("国防科技大学", ""),
    (r"(?:^|共\d+人[！!]?)陆军.*文职", "中国人民解放军陆军"),
    (r"(?:^|共\d+人[！!]?)空军.*(?:文职|人才)", "中国人民解放军空军"),
    (r"(?:^|共\d+人[！!]?)海军.*文职", "中国人民解放军海军"),
    ("军队文职人员公开招考", "中央军委政治工作部"),
)
COLLEGE = "国防科技大学[一-龥]{0,12}?(?:学院)?"
OPENING = r"^(?:【[^】]+】\s*)?(?:重磅[！!]?\s*|正在报名中[！!]?\s*)?(?:共?\d+人[！!]*\s*|快来报名[！!]?\s*|不要错过[！!]?\s*)?(?:202\d年(?:度|下半年|上半年)?\s*)?"
# Names that organizations end in, words that no organization has, and public sectors of a place.
NAMED = (
    "^([一-龥（）()]{2,30}?(?:人力资源和社会保障厅|人力资源和社会保障局|人社厅|人社局|委员会组织部|市委组织部|县委组织部|区委组织部|教育厅|教育和体育局|教育体育局|教育局|卫生健康委员会|卫生健康局|卫健委|卫健局|"
    "自然资源和规划局|应急管理局|国资委|文化和旅游厅|文化和旅游局|体育局|司法局|退役军人事务局|税务局|出入境边防检查总站|水利委员会[一-龥]{2,12}(?:院|所|局)|科学研究院[一-龥]{2,14}(?:院|所)|研究院[一-龥]{0,8}(?:分院|院|所)?|"
    "科学院[一-龥]{0,14}(?:所|院)?|党校（[一-龥]+）|党校|大学城管委会|大学(?:[一-龥]{0,8}?(?:附属)?[一-龥]{2,12}?(?:医院|学院|研究院|学校|中学|小学))?|学院附属[一-龥]{2,10}|学院|技师学院|高等专科学校|专科学校|学校|中学|小学|幼儿园|"
    "医院(?:[一-龥]{2,8}?医院)?|妇幼保健院|医疗中心|临床中心|精神卫生中心|保健院|广播电视台|实验室|交流服务中心|服务中心|管委会))"
)
NOT_NAMED = "这家|这些|这个|这两家|招聘|招考|选聘|遴选|引进"
PLACE = r"(?:202\d年[度]?)?(?:山东省)?([一-龥]{2,14}?(?:市|县|区|高新区|起步区|开发区))(?:市属|市直|区属|县属"
SECTORS = (
    (rf"{PLACE})?(?:教育系统|教育体育系统|教育类|公开招聘教师)", "教育和体育局"),
    (rf"{PLACE})?(?:卫生健康系统|卫健系统|医疗卫生|卫生类|卫生事业单位)", "卫生健康局"),
    (rf"{PLACE}|部分)?事业单位", "人力资源和社会保障局"),
)
HEAD = 600
SCHOOLS = "(?:大学|学院)(?:[一-龥]{0,4}?附属[一-龥]{2,12}?(?:医院|小学|中学|学校))?"
INTRODUCED = (
    rf"(?:招聘单位简介|单位简介|学校简介|学院简介|医院简介|简介)\s*([一-龥（）()]{{2,28}}?(?:{SCHOOLS}|技师学院|医院|研究院|研究所|科学院|精神卫生中心|公共卫生临床中心|开发局|广播电视台|学校|小学|中学|保健院))",
    "一、([一-龥]{2,20}?(?:大学|学院|医院|研究院|科学院|广播电视台|中心|局))简介",
    r"(?:现将|根据)\s*([一-龥（）()]{2,24}?(?:大学|学院|医院|研究院|研究所|科学院|交流服务中心|公共卫生临床中心|保健院|卫生健康委员会|卫生健康局|教育和体育局|教育局|管委会))(?:所属[一-龥（）()]{1,10})?\s*(?:公开招聘|人员空缺|202\d)",
    rf"^\s*(?:202\d年[度]?)?\s*([一-龥（）()]{{2,24}}?(?:{SCHOOLS}|技师学院|医院|妇幼保健院|公共卫生临床中心|精神卫生中心|广播电视台|教育和体育局|教育局|卫生健康委员会|卫生健康局|管委会|教育系统|卫健系统|学校|中心))\s*"
    r"(?:是|为|坐落|位于|创建于|始建于|成立于|202\d年|所属|第二次|教育系统|卫健系统|公开招聘|本次计划|拟公开)",
)
VAGUE = "这家|这些|这个"
SYSTEMS = (("教育系统$", "教育和体育局"), ("卫健系统$", "卫生健康局"))
# Sources that only pass notices on, and general names.
PORTALS = (
    "山东省大学生就业服务平台", "山东大学就业信息网", "南开大学就业网", "学生就业指导中心 代发", "学生就业创业指导中心", "招聘单位待核实", "未知", "济南市政府", "济南人社", "军队人才网", "官方招考主管部门",
)
PROVINCE, GENERAL, NAMELESS = "山东省人力资源和社会保障厅", "官方招考主管部门", ("山东省", "山东")


def exam_title(title: Column) -> Column:
    """A title without portal prefixes, a trailing date mark or pay."""
    return trimmed(replaced(F.coalesce(title, F.lit("")), *[(spaced(p), r) for p, r in TITLE_LOSES]))


def organizer(title: Column, company: Column, body: Column, source: Column) -> Column:
    """Who recruits: a known authority, else who the title names, a place's sector, the introduction, a trusted company, the source, a general name."""
    single = lambda c: trimmed(F.regexp_replace(F.coalesce(c, F.lit("")), spaced(r"\s+"), " "))

    def chosen(given: Column) -> Column:
        clean, own, intro, sender = (given[n] for n in ("title", "company", "intro", "source"))
        names: list[tuple[Column, Column]] = []  # where a candidate stands and what it is, in the order of rank
        for pattern, name in AUTHORITIES:
            said = F.lit(name) if name else F.regexp_extract(clean, COLLEGE, 0)
            names.append((clean.rlike(pattern), said))
        opened = trimmed(F.regexp_replace(clean, spaced(OPENING), ""))
        named = F.regexp_extract(opened, NAMED, 1)
        names.append(((named != "") & ~named.rlike(NOT_NAMED), named))
        for n, (pattern, office) in enumerate(SECTORS):
            place = F.regexp_extract(clean, pattern, 1)
            last = n == len(SECTORS) - 1
            said = F.when(place.isin(*NAMELESS), PROVINCE).otherwise(F.concat(place, F.lit(office))) if last else F.concat(place, F.lit(office))
            names.append(((place != "") & (~place.rlike(f"{VAGUE}|省属") if last else F.lit(True)), said))
        for pattern in INTRODUCED:
            said = replaced(trimmed(F.regexp_extract(intro, spaced(pattern), 1)), (r"^(?:根据|现将|202\d年[度]?)", ""), *SYSTEMS)
            names.append((F.char_length(said).between(4, 30) & ~said.rlike(VAGUE), said))
        school = own.rlike("大学|学院") & ~F.contains(clean, F.substring(own, 1, 4)) & ~F.contains(clean, F.lit("附属"))
        names.append(((own != "") & ~own.isin(*PORTALS) & (own != clean) & ~F.endswith(own, F.lit("公")) & (F.char_length(own) <= 32) & ~school, own))
        names.append(((sender != "") & ~sender.isin(*PORTALS), sender))
        names.append((clean.rlike("山东|省属"), F.lit(PROVINCE)))
        return F.coalesce(*[F.when(test, said) for test, said in names], F.lit(GENERAL))

    intro = single(F.substring(F.coalesce(body, F.lit("")), 1, HEAD))
    sender = trimmed(F.get(F.split(F.coalesce(source, F.lit("")), " · "), F.lit(0)))
    return bound(F.struct(exam_title(title).alias("title"), single(company).alias("company"), intro.alias("intro"), sender.alias("source")), chosen)
