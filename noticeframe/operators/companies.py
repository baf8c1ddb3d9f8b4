"""Which company a record is of, when its fields and its texts do not agree.

Each text gives candidates: a full name whose declared short name the title has, a legal name that the title begins with, a
name that an introduction gives and the title ends like. Candidates and support for the stated company are counted in two
aggregates, first per record and name, then per record, both with map-side combine, so a record may have any number of texts.
One candidate replaces an absent or unsupported company; several contradict each other and replace nothing; an unsupported
company without a single candidate is blanked, and kept as the original.

Null texts and companies count as empty. Of several stated companies of a record the greatest counts. Null keys are one record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import spaced, trimmed

# Legal forms, declared short names, introductions, and titles that begin with an employer.
LEGAL, LEGAL_END = "有限责任公司|有限公司", "(?:股份)?(?:有限责任公司|有限公司)$"
ALIAS = rf"([一-龥A-Za-z0-9（）()·]{{3,60}}(?:{LEGAL}))\s*[（(]以下简称[：: ]*[“「\"]([^”」\"]{{2,30}})[”」\"]"
NO_ALIAS = ("公司", "集团", "本公司", "企业")
INTRO = rf"(?:^|\n)[ \t]*(?:[一二三四五六七八九十\d]+[、.．][ \t]*)?[【\[]?(?:公司|企业|单位)(?:简介|介绍)[】\]]?[：: \t]*\n?[ \t]*([一-龥A-Za-z0-9（）()·]{{2,60}}?(?:{LEGAL}))(?=[（(，,。\s]|是|为|成立|$)"
TITLE_START = r"(?:[？?]|【[^】]{1,15}】|招聘\s*[|｜:：]\s*|(?:20\d{2}\s*年(?:度)?(?:上半年|下半年)?\s*)|(?:[^—\-｜|：:“”]{2,16}(?:[—\-]{2,}|[|｜]|”)\s*))*"
TITLE_NAME = (
    r"[一-龥A-Za-z0-9Ａ-Ｚａ-ｚ０-９（）()·—\-]{2,60}?(?:(?:有限责任公司|股份有限公司|有限公司)(?:[一-龥0-9（）()]{2,24}?(?:分公司|支公司|分行|支行|中心|总厂|厂|研究所|研究院|设计院|分院|医院|学校|经营部|事业部|分所|实验室|局|处|站|部))?"
    r"|(?:集团|总)公司(?:[一-龥0-9（）()]{2,20}?(?:研究所|研究院|设计院|分公司|医院|中心|厂|院|所))?|(?<!本)(?<!各)(?<!某)(?<!企业)(?<!公司)(?<=[一-龥]{2})集团"
    r"|(?:会计师|律师|税务师)事务所(?:[（(][一-龥]{2,15}[）)])?(?:[一-龥]{2,12}分所)?"
    r"|(?<=[一-龥]{2})(?:银行(?:股份有限公司)?(?:[一-龥]{0,15}(?:分行|支行|总行|中心|信用卡中心|软件中心))?|大学|学院|党校|中学|附属中学分校|学校|医院|研究院|研究所|设计院|设计研究院|科学研究院|科学院|实验室|开发局|就业局|气象局|地震局|水文局|航道局|"
    r"海事局|管理局|广播电视台|报社|出版社)(?:[（(][一-龥0-9]{2,20}[）)])?)"
)
TITLE_NEXT = r"(?=\s|招聘|20\d{2}|校园|社会|春季|秋季|寒假|暑假|高层次|公开|诚聘|选聘|引进|常年|教师|博士|硕士|简章|公告|启事|专场|实习|特别研究助理|[—\-｜|：:]|$)"
NO_EMPLOYER = "招聘|简章|公告|启事|双选会|宣讲会|高层次人才|急需紧缺"
# Agencies, codes of organizations, what a name loses on the way to its stem, and stems that say nothing.
AGENCIES = "网聘|高层次人才网|千才汇|高博中进|月生信息|南方国际人力资源|前程无忧|智联招聘|猎聘|考仕网|高校人才网|神州硕博|高才信息|海天创高"
CODE = "^[0-9]{2}[0-9A-Z]{16}$"
BRANCH = "(?:[一-龥]{2,15}(?:分公司|支公司))?$"
TRADES = (
    "控股|数字技术|光电技术|在线网络技术|互动网络技术|网络技术|信息技术|网络科技|教育科技|科技|信息|网络|软件|电子|实业|发展|投资|管理|物业管理|资产管理|商业管理|商贸|贸易|国际贸易|医药|药业|生物|医疗|汽车|通信|数字|数科|智能|商用厨具|饮料|食品|"
    "农牧|农牧食品|机器人|电气|电器|新能源|新材料|重工|机械|工程|建设|环保|环境|文化|传媒|教育|艺术培训学校|培训学校|咨询|石油技术"
)
STEM_ENDS = (
    "(?:股份)?(?:有限责任公司|有限公司)",
    f"(?:股份)?(?:有限责任公司|有限公司){BRANCH}",
    f"(?:集团)?(?:{TRADES})+?(?:集团)?(?:股份)?(?:有限责任公司|有限公司){BRANCH}",
)
COMMON = (
    "公司", "集团", "科技", "有限", "控股", "实业", "国际", "中国", "山东", "北京", "上海", "深圳", "广州", "杭州", "江苏", "浙江", "广东", "信息", "网络", "软件", "电子", "医药", "医疗", "生物", "汽车", "教育", "投资", "管理", "发展", "银行", "证券", "保险",
    "物业", "商贸", "食品",
)
AFTER_SHORT = r"(?:集团|股份|20\d{2}|校园|校招|秋招|春招|招聘|全球|[（(|\s—\-·])"
# Kinds of sources and records, and what is said of a decision.
POSITION, ANNOUNCEMENTS, TALKS = "具体岗位", "-announcements", "-talks"
REPLACED, UNSURE, CODED = "企业名称按公告标题、明确简称或公司简介中的对应关系整理。", "来源单位字段与公告未能对应，企业名称待核对。", "来源单位字段为机构识别码；企业名称需按公告核实。"


def compact(text: Column) -> Column:
    """Without white space, with half-width brackets."""
    return F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), spaced(r"\s+"), ""), "（）", "()")


def candidates(title: Column, body: Column, kind: Column, host: Column) -> Column:
    """Names that the texts give, as array<struct<name, by>>; ``by`` is alias (1), title (2) or introduction (4)."""
    tight, text = compact(title), F.coalesce(body, F.lit(""))
    said = lambda p, g: F.regexp_extract_all(text, F.lit(spaced(p)), F.lit(g))
    pairs = F.arrays_zip(said(ALIAS, 1).alias("name"), said(ALIAS, 2).alias("short"))
    of = lambda names, by: F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(by).alias("by")))
    alias = F.transform(F.filter(pairs, lambda p: F.contains(tight, compact(p["short"])) & ~p["short"].isin(*NO_ALIAS)), lambda p: p["name"])
    first = F.regexp_extract(trimmed(F.coalesce(title, F.lit(""))), spaced(f"^{TITLE_START}({TITLE_NAME}){TITLE_NEXT}"), 1)
    leads = F.filter(F.array(first), lambda n: (n != "") & ~n.rlike(NO_EMPLOYER) & (n != host))
    head = F.get(F.split(tight, r"20\d{2}|校园招聘|招聘", 2), F.lit(0))
    fits = (F.char_length(head) >= 4) & (F.coalesce(kind, F.lit("")) != POSITION)
    intro = F.filter(said(INTRO, 1), lambda n: fits & F.endswith(F.regexp_replace(compact(n), LEGAL_END, ""), head))
    return F.concat(of(alias, 1), of(leads, 2), of(intro, 4))


def supported(company: Column, title: Column, body: Column, places: Sequence[str] = ()) -> Column:
    """Whether the texts speak of a company: by its name, or by a stem of it that is not too common."""
    name, head = compact(company), compact(title)
    hay = F.concat(compact(body), head)
    bases = F.array(name, F.regexp_replace(name, r"\([^)]*\)", ""))
    stems = F.flatten(F.transform(bases, lambda b: F.array(*[F.regexp_replace(b, p, "") for p in STEM_ENDS])))
    if places:
        local = f"^(?:{'|'.join(sorted(places, key=len, reverse=True))})市?(?:[一-龥]{{1,4}}[区县])?"
        stems = F.concat(stems, F.transform(stems, lambda s: F.regexp_replace(s, local, "")))
    telling = F.filter(F.array_distinct(stems), lambda s: (F.char_length(s) >= 2) & ~s.isin(*COMMON))
    plain = F.coalesce(title, F.lit(""))
    # Two characters must stand before a word of companies: the text splits there, and the part before ends in them.
    before = F.split(plain, f"(?={spaced(AFTER_SHORT)})")
    by_stem = F.exists(telling, lambda s: F.when(F.char_length(s) >= 3, F.contains(hay, s)).otherwise(F.exists(F.slice(before, 1, F.greatest(F.size(before) - 1, F.lit(0))), lambda b: F.endswith(b, s))))
    opens = F.startswith(head, F.regexp_replace(name, LEGAL_END, ""))
    return (name != "") & (F.contains(head, name) | opens | (~name.rlike(AGENCIES) & (F.contains(hay, name) | by_stem)))


def company_facts(texts: DataFrame, key: str, places: Sequence[str] = ()) -> DataFrame:
    """``(key, company, company_original, company_conflict, company_note, evidence)`` of each record of ``texts``.

    ``texts`` has the columns key, company, title, body, kind, source_id, source_name; ``evidence`` has the bits of the
    candidate that replaced a company, else 0.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    host = trimmed(F.get(F.split(text("source_name"), "·"), F.lit(0)))
    stated = trimmed(text("company"))
    rows = texts.select(F.col(key), stated.alias("stated"), "title", "body", "kind", F.col("source_id"), host.alias("host"))
    talks = F.endswith(text("source_id"), F.lit(TALKS)) & (F.col("host") != "") & (F.col("stated") == F.col("host")) & ~F.contains(text("title"), F.col("host"))
    doubted = F.endswith(text("source_id"), F.lit(ANNOUNCEMENTS)) & ~supported(F.col("stated"), F.col("title"), F.col("body"), places)
    judged = rows.select(
        key, F.when(compact(F.col("stated")).rlike(CODE), "").otherwise(F.col("stated")).alias("company"), "stated", (talks | doubted).alias("doubt"),
        F.explode_outer(candidates(F.col("title"), F.col("body"), F.col("kind"), F.col("host"))).alias("c"),
    )
    by_name = judged.groupBy(key, compact(F.col("c.name")).alias("n")).agg(
        F.min("c.name").alias("name"), F.bit_or("c.by").alias("by"), F.max("company").alias("company"), F.max("stated").alias("stated"), F.max("doubt").alias("doubt"), F.min("doubt").alias("all")
    )
    one = by_name.groupBy(key).agg(
        F.count("name").alias("names"), F.max("name").alias("name"), F.max("by").alias("by"), F.max("company").alias("company"), F.max("stated").alias("stated"), F.min("all").alias("doubt")
    )
    coded = (F.col("stated") != "") & (F.col("company") == "")
    conflict = F.col("doubt") & (F.col("company") != "")
    replaces = (F.col("names") == 1) & ((F.col("company") == "") | conflict) & (compact(F.col("name")) != compact(F.col("company")))
    return one.select(
        key,
        F.when(replaces, F.col("name")).when(conflict, "").otherwise(F.col("company")).alias("company"),
        F.when(coded | conflict, F.col("stated")).alias("company_original"),
        (coded | conflict).alias("company_conflict"),
        F.when(replaces, REPLACED).when(conflict, UNSURE).when(coded, CODED).alias("company_note"),
        F.when(replaces, F.col("by")).otherwise(0).alias("evidence"),
    )
