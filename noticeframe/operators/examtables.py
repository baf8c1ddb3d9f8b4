"""E5: position tables of examinations, as a table function over grids.

A grid is an array of rows of cells, with the ranges of its merged cells beside it. Merged ranges are spread over all cells they
cover, the header is found among the first rows by what its cells are called, over one to three rows, and each row below becomes a
position. Grids are read one by one in Arrow batches; the rest (lists of majors, places) are column expressions.

Null or empty grids and grids without a header give no rows; null cells are blank; rows may have any number of cells; a merged
range outside the grid is cut at its edge.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import mapped
from ..functions.text import spaced, trimmed

# What a column of a position table is called, in the order in which columns are given away.
COLUMNS = {
    "department": "主管部门|主管机关|主办单位|所属部门|上级主管部门|招录机关",
    "employer": "招聘单位|用人单位|单位名称|招考单位|聘用单位|工作单位|学校名称|医院名称|卫生院名称|^单位$",
    "position_name": "岗位名称|职位名称|招聘岗位|招聘职位|需求岗位|招考职位|具体岗位|拟聘岗位|村?卫生室名称|^岗位$|^职位$",
    "position_code": "岗位代码|职位代码|岗位编号|职位编号|岗位代号|代码",
    "position_category": "岗位类别|职位类别|岗位性质|岗位等级|专业技术岗位|考试类别|试卷类别|笔试类别",
    "bianzhi": "编制性质|职位性质|经费形式|编制类型|经费来源|管理方式|总量控制",
    "recruit_count": "招聘人数|招录人数|计划人数|拟聘人数|需求人数|招聘计划|招录计划|录用计划|招考人数|计划数|人数|名额",
    "edu_degree": "学历学位|学历/学位|学历及学位",
    "education": "^学历$|学历要求|文化程度|最低学历|学历层次",
    "degree": "^学位$|学位要求|最低学位",
    "majors": "专业要求|专业名称|所学专业|需求专业|招聘专业|专业范围|学科专业|专业目录|^专业$",
    "political_status": "政治面貌|党派|党员",
    "fresh_grad_rule": "招聘对象|招录对象|招聘范围|应届要求|生源范围|毕业生范围|基层工作经历|基层工作最低年限|工作经历|人员范围",
    "age_limit": "年龄|年龄要求|年龄限制|出生日期",
    "hukou_rule": "户籍|生源地|户籍要求|生源要求",
    "city": "工作地点|工作地|所在地区|考区|城市|地点",
    "exam_subjects": "笔试科目|公共科目笔试类别|考试科目|考试内容|专业科目",
    "exam_ratio": "开考比例|面试人员比例|比例",
    "contact_phone": "咨询电话|联系电话|单位电话",
    "other_conditions": "其他条件|其他要求|备注|其他资格条件|职位简介|说明|附加条件",
}
# Labels of header cells, and what may follow one.
LABELS = (
    "序号|编号|代码|主管部门|主管机关|招聘单位|用人单位|单位名称|招录机关|单位|岗位名称|职位名称|招聘岗位|招聘职位|岗位代码|职位代码|岗位编号|岗位类别|职位类别|职位属性|岗位等级|岗位性质|职位性质|"
    "经费形式|编制性质|招聘人数|招录人数|计划人数|需求人数|招聘计划|招录计划|录用计划|人数|名额|学历|学历要求|学位|学位要求|学历学位|专业|专业要求|大学专科专业要求|大学本科专业要求|研究生专业要求|所学专业|需求专业|学科|"
    "政治面貌|年龄|年龄要求|招聘对象|招录对象|招聘范围|应届|基层工作经历|基层工作最低年限|服务基层项目工作经历|工作经历|户籍|生源|开考比例|面试人员比例|笔试科目|公共科目笔试类别|考试科目|工作地点|地点|职位简介|其他条件|其他要求|资格条件|备注|咨询电话\\d*|联系电话"
)
LABEL_TAIL = r"(?:[（(【\[][^】\)】\]]{0,30}[）)】\]]|[/:：、及&+].*)?"
TIERS = ("研究生", "本科", "专科")
# Rows that sum up or explain, and names and levels that are none.
SUMMARY, SUMMARY_FIRST = "合计|总计|小计|汇总|注[：:]", "合计|总计|小计|汇总|注[：:]|说明[：:]|填表说明"
NO_NAME = (
    r"[\d.\-—/序号]+|序号|类别|岗位类别|岗位代码|职位代码|岗位编号|招聘单位|用人单位|主管部门|要求|学历|学历要求|学位|学位要求|专业|专业要求|其他条件|备注|等级|成绩|笔试成绩|面试成绩|"
    r"面试分数|综合成绩|总成绩|姓名|准考证号|排名|名次|合计|总计|小计"
)
NO_LEVEL = r"[\d.\-—/]+|序号|类别|等级|要求|招聘单位|用人单位|主管部门|岗位名称|职位名称|岗位代码|职位代码|备注"
KINDS = (("控制总量|备案", "控制总量 / 备案制"), ("参公", "参公管理"), ("行政|公务员", "公务员（行政编）"))
# Majors that are none.
CODED, MAJOR_TAIL = r"^\d{4,6}[A-Za-z]?\s*(?=[一-龥])", "(?:及相关专业|相关专业|等专业|等|类)$"
NO_MAJORS = ("", "不限", "无", "其他", "专业", "本科", "硕士", "博士", "研究生", "大专", "专科")
MAJOR_NOISE = "热爱祖国|拥护|遵纪守法|品行端正|身体健康|无违法|服从分配|吃苦耐劳|沟通能力|团队精神|年龄|周岁|及以上学历|全日制本科|硕士研究生及以上"

HEADER_ROWS, HEADER_DEPTH, LONGEST_LABEL, MOST_POSTS, LONGEST_NAME = 10, 3, 45, 5000, 60
#: What tells a header row by itself, besides a label.
TELLING = ("position_name", "majors", "employer", "recruit_count", "education")
POSITION = "row_id string, department string, employer string, position_name string, position_code string, position_category string, bianzhi string, recruit_count int, city string, education string, degree string, major_raw string, political_status string, fresh_grad_rule string, age_limit string, hukou_rule string, exam_ratio string, exam_subjects string, other_conditions string, contact_phone string"
POSITION_TYPE = pa.struct({f: pa.int32() if kind == "int" else pa.string() for f, kind in (x.split() for x in POSITION.split(","))})

Grid = Sequence[Sequence[str]]


def spread(grid: Sequence[Sequence[object]], merges: Sequence[Sequence[int]] = ()) -> list[list[str]]:
    """The grid with single blanks, every merged range ``(row, column, rows, columns)`` filled with its first cell."""
    width = max((len(r) for r in grid), default=0)
    full = [[" ".join(str(c).split()) if c is not None else "" for c in r] + [""] * (width - len(r)) for r in grid]
    for row, col, rows, cols in merges:
        if 0 <= row < len(full) and 0 <= col < width:
            for r in range(row, min(row + rows, len(full))):
                full[r][col : min(col + cols, width)] = [full[row][col]] * (min(col + cols, width) - col)
    return full


class Columns:
    """A header: which column holds which field, and the columns of majors with their tier."""

    patterns = {f: re.compile(p) for f, p in COLUMNS.items()}
    label = re.compile(f"(?:{LABELS}){LABEL_TAIL}")

    def __init__(self, names: Sequence[str]):
        self.at: dict[str, int] = {}
        self.majors: list[tuple[str, int]] = []
        for i, name in enumerate(names):
            field = next((f for f, p in self.patterns.items() if (f == "majors" or f not in self.at) and p.search(name)), None) if name else None
            if field == "majors":
                self.majors.append((next((t for t in TIERS if t in name), ""), i))
            if field:
                self.at.setdefault(field, i)

    @property
    def usable(self) -> bool:
        return len(self.at) > 1 and not self.at.keys().isdisjoint(("position_name", "majors", "employer"))

    @classmethod
    def heads(cls, row: Sequence[str]) -> bool:
        """Whether a row could be part of a header: short cells, at least two and half of them (or five) known as labels."""
        cells = [c for c in row if c]
        known = sum(bool(cls.label.fullmatch(c)) or any(cls.patterns[f].search(c) for f in TELLING) for c in cells)
        return known >= 2 and (known >= len(cells) // 2 or known >= 5) and max(map(len, cells)) <= LONGEST_LABEL

    def majors_of(self, row: Sequence[str]) -> str:
        """Of several tiers each named one with its tier; one alone, or a single column, as it stands."""
        given = [(t, row[i]) for t, i in self.majors if row[i]]
        if len(given) > 1:
            return "；".join(f"{t}：{v}" if t else v for t, v in given)
        return given[0][1] if given else ""


def header_of(grid: Grid) -> tuple[Columns, int] | None:
    """The header with the most fields, of equals the deeper and then the upper one, and the row below it."""
    tells = [Columns.heads(r) for r in grid[: HEADER_ROWS + HEADER_DEPTH]]
    best, found = 0, None
    for start in range(min(HEADER_ROWS, len(grid))):
        for depth in range(1, min(HEADER_DEPTH, len(grid) - start) + 1):
            if not all(tells[start : start + depth]):
                break
            columns = Columns([" ".join(dict.fromkeys(c for c in parts if c)) for parts in zip(*grid[start : start + depth])])
            score = 10 * len(columns.at) + depth
            if columns.usable and score > best:
                best, found = score, (columns, start + depth)
    return found


def named(name: str) -> bool:
    """Whether a cell can name a position."""
    return bool(name) and len(name) <= LONGEST_NAME and not re.fullmatch(NO_NAME, name) and not re.fullmatch(r"[\d\W_]+", name)


def positions_of(grid: Grid, exam: str, kind: str = "事业编", city: str = "", employer: str = "") -> list[dict]:
    """The positions below the header of a spread grid. Ids are stable; repeats of a position get ``-2``, ``-3``, ..."""
    found = header_of(grid) if len(grid) > 1 else None
    if not found:
        return []
    columns, first = found
    out, seen = [], {}
    for row in grid[first:]:
        cell = lambda f, row=row: row[columns.at[f]] if f in columns.at else ""
        name, own, majors = cell("position_name"), cell("employer"), columns.majors_of(row)
        unit = own or employer
        department = cell("department") or unit
        opening = next((c for c in row if c), "")
        if not (name or majors or own) or re.match(SUMMARY_FIRST, opening) or re.match(SUMMARY, name or unit or department):
            continue
        title = name or cell("position_category") or "公开招聘岗位"
        if not named(title):
            continue
        unit = unit or department or "用人单位见简章"
        level = cell("education") or cell("edu_degree")
        level = "" if re.fullmatch(NO_LEVEL, level) else level
        number = re.search(r"\d+", cell("recruit_count"))
        count = int(number[0]) if number and len(number[0]) < 9 else 0
        own_kind = cell("bianzhi")
        base = hashlib.sha256(f"{exam}|{cell('position_code')}|{unit}|{title}".encode()).hexdigest()[:16]
        seen[base] = seen.get(base, 0) + 1
        plain = {f: cell(f) for f in ("position_code", "position_category", "political_status", "fresh_grad_rule", "age_limit", "hukou_rule", "exam_ratio", "exam_subjects", "contact_phone")}
        out.append(plain | {
            "row_id": base if seen[base] == 1 else f"{base}-{seen[base]}",
            "department": department or "招考主管部门", "employer": unit, "position_name": title,
            "bianzhi": next((k for p, k in KINDS if re.search(p, own_kind)), kind),
            "recruit_count": count if 0 < count <= MOST_POSTS else None,
            "city": cell("city") or city, "education": level, "degree": cell("degree") or (level if "学位" in level else ""),
            "major_raw": majors, "other_conditions": cell("other_conditions")[:160],
        })
    return out


def table_majors(text: Column, limit: int = 15) -> Column:
    """Majors of a cell: without codes and endings, and without what is no major."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), spaced(r"[,，、;/；\s]+")), lambda p: F.regexp_replace(F.regexp_replace(trimmed(p), spaced(CODED), ""), MAJOR_TAIL, ""))
    return F.slice(F.filter(parts, lambda p: ~p.isin(*NO_MAJORS) & ~p.rlike(MAJOR_NOISE)), 1, limit)


def exam_positions(
    grids: DataFrame, grid: str = "grid", merges: str | None = "merges", exam: str = "exam_id", kind: str = "事业编", city: Column | None = None, employer: Column | None = None,
    place_in: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row per position of each grid, with ``grids``' other columns beside it.

    ``merges`` holds ``array<array<int>>`` of (row, column, rows, columns). ``place_in`` gives the place that a text names, for rows without one.
    """

    @F.arrow_udf(f"array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in POSITION.split(','))}>>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rows = lambda v: [r or [] for r in v or []]
        of = lambda x: positions_of(spread(rows(x["grid"]), rows(x["merges"])), x["exam"] or "", kind, x["city"] or "", x["employer"] or "")
        for grids in batches:
            yield mapped(grids, of, pa.list_(POSITION_TYPE))

    text = lambda c: F.coalesce(c, F.lit("")) if c is not None else F.lit("")
    ranges = F.col(merges) if merges else F.array().cast("array<array<int>>")
    rest = [c for c in grids.columns if c not in (grid, merges)]
    read_rows = grids.select(*rest, F.inline(read(F.struct(F.col(grid).alias("grid"), ranges.alias("merges"), F.col(exam).cast("string").alias("exam"), text(city).alias("city"), text(employer).alias("employer")))))
    place = F.col("city") if place_in is None else F.coalesce(F.nullif("city", F.lit("")), place_in(F.concat_ws(" ", "department", "employer", "position_name")), F.lit(""))
    return read_rows.withColumn("city", place).withColumn("majors", table_majors(F.col("major_raw")))
