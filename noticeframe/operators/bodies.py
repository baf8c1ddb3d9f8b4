"""Sections of announcements, structured bodies, places in order.

Sections and places are column expressions. A structured body needs a memory from line to line (which section, which list), so
each text goes through a small line reader in Arrow batches; no text is shuffled.

Null and empty texts have no sections, no facts and no blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..batches import mapped
from ..functions.text import bound, spaced, trimmed

NUMERALS = "一二三四五六七八九十"
# What a heading looks like, its label, and how long both are.
HEADING = rf"^(?:[{NUMERALS}]+、[^\n]{{1,28}}|（[{NUMERALS}]+）[^\n]{{1,28}}|【[^】]{{2,20}}】[^\n]{{0,20}})$"
SECTION_HEADING, SECTION_LABEL, BODY_HEADING, BODY_LABEL = 32, 10, 34, 8
# Words that head a section by themselves.
KEYWORDS = (
    "单位介绍|单位简介|公司介绍|公司简介|企业介绍|企业简介|集团简介|企业概况|公司概况|关于我们|岗位职责|工作职责|职位职责|岗位描述|职位描述|工作内容|工作任务|职责描述|"
    "任职要求|任职资格|任职条件|岗位要求|应聘条件|应聘要求|资格条件|基本条件|招聘条件|报名条件|选聘条件|招聘对象|招聘岗位|需求岗位|热招岗位|招聘职位|招聘方向|招聘计划|岗位需求|"
    "薪资福利|薪酬福利|福利待遇|薪资待遇|薪酬待遇|福利保障|我们提供|培养发展|晋升发展|职业发展|人才培养|招聘流程|应聘流程|面试流程|选拔流程|"
    "投递方式|报名方式|应聘方式|简历投递|联系方式|联系我们|注意事项|其他说明|温馨提示|招聘简章|招聘附件"
)
# Leading fields by what becomes of them.
FIELDS = {
    "company": "招聘单位|所属企业|单位名称|公司名称|企业名称|用人单位|企业|公司",
    "title": "岗位名称|职位名称|招聘职位名称",
    "place": "工作地点|工作城市|工作地区|工作地域|统一分配工作地点",
    "deadline": "报名截止|报名截止时间|截止时间|截止日期|招聘截止日期|有效日期|报备截止",
    "batch": "招聘批次|招聘类型|工作性质|招聘性质",
    "education": "学历要求|学历|毕业届别与学历",
    "link": "网申或官网|职位投递网址链接|应聘网址|网申地址|投递链接|简历投递邮箱|投递邮箱",
}
LABELS = {
    "岗位类别": "岗位类别|职位类别|职能类别", "专业要求": "专业要求|需求专业|所需专业|专业方向", "薪资参考": "薪资|薪资待遇|薪资状况|薪酬|薪酬待遇|月薪|年薪", "招聘人数": "招聘人数|需求人数|拟招人数", "所属部门": "所属部门|用人部门|部门",
    "单位性质": "单位性质|企业性质", "所属行业": "所属行业|行业类别", "详细地址": "详细地址|单位地址|公司地址", "联系人": "联系人", "联系电话": "联系电话", "年龄要求": "年龄要求", "外语要求": "外语要求", "经验要求": "工作经验",
}
FORM_LABELS = ("招聘信息", "标题", "招聘截止日期", "应聘网址", "简历投递邮箱")
DISCLAIMER = r"此条为第三方公开招聘线索[，,].*请打开来源核对投递方式[。.]?"
DUTIES = r"(?:^|[；;：:\s])\d{1,2}[.、．]\s*(?:承接|负责|参与|协助|制定|开拓|跟进|完成|维护|独立|熟悉|具备|掌握|支持|主导|组织|开展|学习|配合|对接)"
NO_PLACE = "承接|业绩指标|岗位职责|任职要求|完成.*目标|负责.*工作"
PLACE_LOSES = (
    (r"\s+", " "), (r"^(?:由[^，,：:]{1,20}统一分配)?(?:统一分配)?工作(?:地点|城市|地域|地区)\s*[:：]+\s*", ""), (r"^原文工作地域\s*[:：]+\s*", ""), (rf"{DUTIES}.*$", ""),
    (r"[；;。\s]*工作(?:地点|城市)\s*[:：]*\s*$", ""), (r"^[·:：、，,；;\s]+|[；;。，,\s]+$", ""),
)
PROVINCES = r"(?:河北|山西|辽宁|吉林|黑龙江|江苏|浙江|安徽|福建|江西|山东|河南|湖北|湖南|广东|海南|四川|贵州|云南|陕西|甘肃|青海|台湾|内蒙古|广西|西藏|宁夏|新疆)(?:壮族自治区|维吾尔自治区|回族自治区|自治区|省)?[·.\s]*(?=(?!省|自治区)[一-龥])"
BETWEEN_PLACES = r"[、/，,；;·.\s（）()【】\[\]均在及等各]+"
ROLE = r"(?:招聘)?岗位\s*[:：]\s*(.{1,64})"
ITEM = r"\s*(?:(\d{1,2}[.、．)）]|[（(]\d{1,2}[)）]|[①②③④⑤⑥⑦⑧⑨⑩])|[•·▪▫●○]|[-*]\s+)\s*(.+)"
LEVEL = r"(?:^|[\d.、．)）\s])学历(?:要求)?\s*[:：]\s*((?:博士研究生|硕士研究生|大专|专科|本科|硕士|博士)(?:及以上)?)(?:学历)?(?=[；;。，,\s]|$)"
LONGEST_FIELD, LONGEST_PLACE, SHORT_BATCH, SHORT_LEVEL = 160, 100, 24, 16

SECTION = "struct<heading:string,label:string,content:string>"
BODY = "struct<education:string,deadline:string,place:string,meta:array<struct<label:string,value:string>>,sections:array<struct<heading:string,label:string,blocks:array<struct<type:string,ordered:boolean,items:array<string>>>>>,disclaimer:string>"

BLOCK_TYPE = pa.struct({"type": pa.string(), "ordered": pa.bool_(), "items": pa.list_(pa.string())})
BODY_TYPE = pa.struct({
    "education": pa.string(), "deadline": pa.string(), "place": pa.string(), "meta": pa.list_(pa.struct({"label": pa.string(), "value": pa.string()})),
    "sections": pa.list_(pa.struct({"heading": pa.string(), "label": pa.string(), "blocks": pa.list_(BLOCK_TYPE)})), "disclaimer": pa.string(),
})


def announcement_sections(body: Column) -> Column:
    """Sections of an announcement: what its heading lines divide. With fewer than two headings, or three lines, the whole body is one."""
    whole = F.array(F.struct(F.lit(None).cast("string").alias("heading"), F.lit(None).cast("string").alias("label"), body.alias("content")))
    label = lambda h: F.substring(F.regexp_replace(h, spaced(rf"^[（【]?([{NUMERALS}]+)[、）】]\s*"), "$1、"), 1, SECTION_LABEL)

    def divided(lines: Column) -> Column:
        heads = F.transform(lines, lambda x: trimmed(x).rlike(HEADING) & (F.char_length(trimmed(x)) <= SECTION_HEADING))
        places = F.filter(F.transform(heads, lambda h, i: F.when(h, i)), lambda i: i.isNotNull())

        def cut(at: Column) -> Column:
            starts = F.concat(F.array(F.lit(-1)), at)
            parts = F.transform(
                starts,
                lambda s, i: F.struct(
                    F.when(s >= 0, trimmed(F.get(lines, s))).alias("heading"),
                    F.when(s >= 0, label(trimmed(F.get(lines, s)))).alias("label"),
                    trimmed(F.array_join(F.slice(lines, s + 2, F.coalesce(F.get(starts, i + 1), F.size(lines)) - s - 1), "\n")).alias("content"),
                ),
            )
            return F.when((F.size(lines) < 3) | (F.size(at) < 2), whole).otherwise(F.filter(parts, lambda p: p["heading"].isNotNull() | (p["content"] != "")))

        return bound(places, cut)

    return F.when(F.coalesce(body, F.lit("")) == "", F.array().cast(f"array<{SECTION}>")).otherwise(bound(F.split(body, "\r?\n"), divided))


def place_chips(cities: Column, preferred: Column, near: Sequence[str]) -> Column:
    """struct(chips, prioritized): distinct places, the wanted first, then those ``near``, then the rest, each in the order given."""
    names = F.array_distinct(F.filter(F.transform(F.coalesce(cities, F.array().cast("array<string>")), trimmed), lambda c: c != ""))
    tier = lambda c: F.when(F.array_contains(F.coalesce(preferred, F.array().cast("array<string>")), c), 0).when(c.isin(*near), 1).otherwise(2)
    ranked = F.array_sort(F.transform(names, lambda c, i: F.struct(tier(c).alias("tier"), i.alias("at"), c.alias("name"))))
    return bound(ranked, lambda r: F.struct(F.transform(r, lambda x: x["name"]).alias("chips"), F.size(F.filter(r, lambda x: x["tier"] < 2)).alias("prioritized")))


def place_text(raw: str) -> str:
    """A named place without its label and what is no place; '' when nothing is left."""
    for pattern, instead in PLACE_LOSES:
        raw = re.sub(pattern, instead, raw).strip()
    return "" if len(raw) > LONGEST_PLACE or re.search(NO_PLACE, raw) else raw


def says_only(place: str, cities: Sequence[str]) -> bool:
    """Whether a place names nothing beyond the cities."""
    for city in sorted(filter(None, cities), key=len, reverse=True) if cities else ():
        place = re.sub(f"{re.escape(city)}市?", "", re.sub(PROVINCES, "", place))
    return bool(cities) and not re.sub(BETWEEN_PLACES, "", place)


def heading_of(line: str) -> tuple[str, str] | None:
    """The heading a line is, or begins with, and what follows it on the line."""
    if re.fullmatch(HEADING, line) and len(line) <= BODY_HEADING or re.fullmatch(rf"(?:[{NUMERALS}\d]+[、.．)）]\s*|[【（(\[])?(?:{KEYWORDS})[】）)\]]?\s*[:：]?\s*", line):
        return re.sub(r"\s*[:：]\s*$", "", line), ""
    led = re.fullmatch(rf"({KEYWORDS})\s*[:：]+\s*(.+)", line)
    return led and (heading_of(led[2].strip()) or (led[1], led[2].strip()))


def short_label(heading: str) -> str:
    return re.sub(r"^【([^】]+)】.*$", r"\1", re.sub(rf"^(?:[{NUMERALS}\d]+[、.．)）]|（[{NUMERALS}\d]+）)\s*", "", heading)).strip()[:BODY_LABEL]


def pieces(line: str) -> list[str]:
    """A line's numbered items when it holds several."""
    several = len(re.findall(r"(?:^|[。；;！!\s])\d{1,2}[.、．]\s*[^\d\s]", line)) > 1
    return [p for x in re.split(r"(?<=[。；;！!])\s*(?=\d{1,2}[.、．]\s*[^\d\s])", line) if (p := x.strip())] if several else [line]


def blocks_of(lines: Sequence[str]) -> list[dict]:
    """Paragraphs, lists of one kind, and runs of two or more role lines."""
    out: list[dict] = []
    flat = [p for line in lines for p in pieces(line)]
    roles = [m and m[1].strip() for m in (re.fullmatch(ROLE, x) for x in flat)]
    for i, line in enumerate(flat):
        last, item = out[-1] if out else None, re.fullmatch(ITEM, line)
        if roles[i] and (i and roles[i - 1] or i + 1 < len(flat) and roles[i + 1]):
            if not (i and roles[i - 1] and last):
                out.append({"type": "roles", "ordered": None, "items": []})
            out[-1]["items"] += [roles[i]] if roles[i] not in out[-1]["items"] else []
        elif item:
            ordered = item[1] is not None
            if not (last and last["type"] == "list" and last["ordered"] == ordered):
                out.append({"type": "list", "ordered": ordered, "items": []})
            out[-1]["items"].append(item[2].strip())
        else:
            out.append({"type": "paragraph", "ordered": None, "items": [line]})
    return out


@dataclass
class Body:
    """The reader of one body. ``known`` holds the record's own facts: company, title, cities, education, deadline, types, years."""

    known: dict
    out: dict = field(default_factory=lambda: {"education": None, "deadline": None, "place": None, "meta": [], "sections": [], "disclaimer": None})

    kinds = {w: k for k, words in FIELDS.items() for w in words.split("|")}
    labels = {w: k for k, words in LABELS.items() for w in words.split("|")}

    def note(self, label: str, value: str) -> None:
        if value not in ("", "-", "无", "暂无") and {"label": label, "value": value} not in self.out["meta"]:
            self.out["meta"].append({"label": label, "value": value})

    @property
    def no_level(self) -> bool:
        return not self.known.get("education") or "未明确" in self.known["education"]

    def company(self, key: str, value: str) -> None:
        company, title = self.known.get("company") or "", self.known.get("title") or ""
        if not (company and (company in value or value in company)) and value not in title:
            self.note("招聘单位", value)

    def title(self, key: str, value: str) -> None:
        own, bare = (re.sub(r"\s*[(（\[【]\s*(?:岗位编号|职位编号|职位代码|岗位代码|编号)?\s*[:：]?\s*[A-Za-z]{1,4}[-_]?\d{4,12}\s*[)）\]】]\s*$", "", v).strip() for v in (self.known.get("title") or "", value))
        if not own or bare not in own and own not in bare:
            self.note("招聘岗位", value)

    def place(self, key: str, value: str) -> str | None:
        """What follows a place on its line and is a duty."""
        duty = re.search(DUTIES, value)
        text = place_text(value[: duty.start()] if duty else value)
        if text and not says_only(text, self.known.get("cities") or ()):
            self.out["place"] = text
        return re.sub(r"^[；;：:\s]+", "", value[duty.start() :]).strip() if duty else None

    def deadline(self, key: str, value: str) -> None:
        if not self.known.get("deadline"):
            self.out["deadline"] = value

    def batch(self, key: str, value: str) -> None:
        campus = "校招" in (self.known.get("types") or ()) and re.search("校招|校园招聘|应届", value)
        if not campus and not any(y in value for y in self.known.get("years") or ()) and len(value) <= SHORT_BATCH:
            self.note(key, value)

    def education(self, key: str, value: str) -> None:
        if self.no_level and "未明确" not in value:
            if len(value) <= SHORT_LEVEL:
                self.out["education"] = value
            else:
                self.note("学历说明", value)
        elif len(value) > 10 and value != self.known.get("education"):
            self.note("学历说明", value)

    def link(self, key: str, value: str) -> None:
        """Links and addresses are shown elsewhere."""

    def form(self, lines: list[str]) -> int:
        """Lines of a form's labels and their values at the very start."""
        at = next((i for i, x in enumerate(lines) if x), len(lines))
        if at == len(lines) or lines[at] != FORM_LABELS[0]:
            return at
        at += 1
        while at < len(lines) and (not lines[at] or lines[at] in FORM_LABELS):
            label, value = lines[at], lines[at + 1] if at + 1 < len(lines) else ""
            day = bool(re.match(r"\d{4}-\d{2}-\d{2}", value))
            own = {"标题": bool(value) and value not in FORM_LABELS and not heading_of(value), "招聘截止日期": day, "应聘网址": bool(re.match("https?://", value, re.I)), "简历投递邮箱": "@" in value}.get(label, False)
            if label == "招聘截止日期" and day:
                self.deadline(label, value)
            at += 2 if own else 1
        return at

    def fields(self, lines: list[str], at: int) -> int:
        """Leading fields, up to the first line that is none of a known kind."""
        while at < len(lines):
            line = lines[at]
            pair = line and not heading_of(line) and not re.fullmatch(ROLE, line) and re.fullmatch(r"([一-龥A-Za-z]{2,10})\s*[:：]\s*(.{1,520})", line)
            if line and not pair:
                return at
            if pair:
                key, value = pair[1], pair[2].strip()
                kind, label = self.kinds.get(key), self.labels.get(key)
                if kind != "place" and len(value) > LONGEST_FIELD or not (kind or label or key == "招聘岗位" and len(value) <= 60):
                    return at
                rest = getattr(self, kind)(key, value) if kind else None
                if rest:
                    lines[at] = f"岗位职责：{rest}"
                    return at
                if rest is not None:
                    return at + 1
                if label == "招聘人数" and value.isdecimal():
                    value += "人"
                if not kind and not (label == "薪资参考" and re.fullmatch("面议|薪资面议|待定|面谈", value)):
                    self.note(label or key, value)
            at += 1
        return at

    def read(self, text: str) -> dict:
        lines = [re.sub(r"[ \t\xa0]+", " ", x).strip() for x in re.sub("：：+", "：", re.sub(r"\r\n?", "\n", text)).split("\n")]
        while lines and not lines[-1]:
            lines.pop()
        if lines and re.fullmatch(DISCLAIMER, lines[-1]):
            self.out["disclaimer"] = lines.pop()
        rest = lines[self.fields(lines, self.form(lines)) :]
        if self.no_level and not self.out["education"]:
            self.out["education"] = next((m[1] for x in rest if (m := re.search(LEVEL, x))), None)
        heading, held = None, []
        for line in [*filter(None, rest), None]:
            found = None if line is None else heading_of(line)
            if line is not None and not found:
                held.append(line)
                continue
            blocks = blocks_of(held)
            if heading or blocks:
                self.out["sections"].append({"heading": heading, "label": heading and short_label(heading), "blocks": blocks})
            heading, held = (found[0], [found[1]] if found[1] else []) if found else (None, [])
        return self.out


def structured_body(body: Column, **known: Column) -> Column:
    """A struct of ``BODY``: facts of a body that the record lacks (``known``: company, title, cities, education, deadline, types, years), its other leading fields, its sections of blocks, and a disclaimer at its end."""

    @F.arrow_udf(BODY)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield mapped(rows, lambda r: Body(r).read(r["body"] or ""), BODY_TYPE)

    return read(F.struct(body.alias("body"), *[c.alias(n) for n, c in known.items()]))
