"""Table functions over texts and grids."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, spaced, trimmed

# Fixed values: (dimension, polarity, words) of opinion clauses.
OPINION_RULES = (
    ("pay", 1, "工资高|待遇好|薪资不错|福利好"),
    ("pay", -1, "工资低|待遇差|薪资低|拖欠"),
    ("worklife", 1, "双休|不加班|准时下班"),
    ("worklife", -1, "加班多|单休|大小周"),
    ("growth", 1, "晋升快|培训好|成长快"),
    ("growth", -1, "没有晋升|学不到|没前途"),
    ("management", 1, "氛围好|领导好|管理规范"),
    ("management", -1, "管理混乱|氛围差|画饼"),
)
NEGATION = "(?:不|没|没有|并非|不是)$"
CLAUSES = r"[。！？!?；;，,\n]"

# Words in headers of position tables, by field.
HEADER_WORDS = {
    "name": ("岗位名称", "职位名称", "招聘岗位", "岗位", "职位"),
    "category": ("岗位类别", "职位类别", "类别"),
    "majors": ("专业要求", "所需专业", "需求专业", "专业"),
    "education": ("学历要求", "学历", "学位"),
    "count": ("招聘人数", "需求人数", "人数", "名额"),
    "city": ("工作地点", "工作城市", "地点", "城市"),
    "cohort": ("毕业年份", "届别", "届次"),
    "notes": ("备注", "其他要求", "其他"),
}


def opinion_signals(df: DataFrame, body: Column, rules: Sequence[tuple[str, int, str]] = OPINION_RULES, limit: int = 4) -> DataFrame:
    """At most ``limit`` clauses with an opinion per text: dimension, polarity, quote.

    A negation right before the opinion word drops the clause.
    """
    clauses = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), CLAUSES), lambda c: trimmed(c)), lambda c: c != "")
    found = F.flatten(
        F.transform(
            clauses,
            lambda c: F.array_compact(
                F.array(
                    *[
                        F.when(
                            c.rlike(words) & ~F.regexp_extract(c, f"^(.*?)(?:{words})", 1).rlike(NEGATION),
                            F.struct(F.lit(dim).alias("dimension"), F.lit(pol).alias("polarity"), F.substring(c, 1, 60).alias("quote")),
                        )
                        for dim, pol, words in rules
                    ]
                )
            ),
        )
    )
    return df.select("*", F.inline(F.slice(found, 1, limit)))


def deadlines(body: Column) -> Column:
    """Distinct days on lines that speak of an end of application, ascending."""
    lines = F.filter(F.split(F.coalesce(body, F.lit("")), r"[\r\n。；;]"), lambda x: x.rlike("截止|报名时间|网申时间|投递时间"))
    pattern = spaced(r"(20\d{2})\s*[年./-]\s*(\d{1,2})\s*[月./-]\s*(\d{1,2})")

    def found(joined: Column) -> Column:
        parts = [F.regexp_extract_all(joined, F.lit(pattern), F.lit(g)) for g in (1, 2, 3)]
        return F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "ymd")]), lambda x: F.concat_ws("-", x["y"], F.lpad(x["m"], 2, "0"), F.lpad(x["d"], 2, "0")))

    days = bound(F.array_join(lines, "\n"), found)
    return F.array_sort(F.array_distinct(F.filter(days, lambda d: F.try_to_timestamp(d, F.lit("yyyy-MM-dd")).isNotNull())))


def sole_deadline(body: Column) -> Column:
    """The deadline if there is exactly one."""
    return bound(deadlines(body), lambda found: F.when(F.size(found) == 1, found[0]))


def split_majors(text: Column, limit: int = 15) -> Column:
    """Majors of a cell without noise, first seen first."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), spaced(r"[、,，;；/\n]|(?:\s{2,})")), lambda x: trimmed(F.regexp_replace(x, r"^\d+[.、]|等(?:相关)?专业$|专业$", "")))
    return F.slice(F.array_distinct(F.filter(parts, lambda x: (F.char_length(x) >= 2) & (F.char_length(x) <= 30) & ~x.rlike("^(?:不限|无|其他|详见)"))), 1, limit)


def prose_positions(body: Column, limit: int = 12) -> Column:
    """``name`` and ``count`` of phrases like 软件工程师 3 名."""
    pattern = spaced(r"([一-龥A-Za-z]{2,16}?(?:岗|师|员|经理|助理|专员|主管))[^\d一-龥]{0,3}(\d{1,3})\s*[名人]")
    names, counts = (F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(pattern), F.lit(g)) for g in (1, 2))
    return F.slice(F.transform(F.arrays_zip(names.alias("n"), counts.alias("c")), lambda x: F.struct(x["n"].alias("name"), x["c"].cast("int").alias("count"))), 1, limit)


# Lines that list posts, endings of posts, and words that no post has.
SAMPLE_LINE = spaced(r"(?:^|\n)\s*(?:招聘岗位|需求岗位|热招岗位|招募岗位|校招岗位)\s*[:：]\s*([^\n。]{2,140})")
POST_END = "(?:岗|员|师|生|经理|主管|助理|顾问|代表|专家|总监|主任|方向|类|出纳|会计|法务|财务|审计|税务|编辑|记者|翻译|客服|柜员|策划|运营|人事|行政|采购)$"
NO_POST = "能力|经验|技能|要求|熟悉|优先|职责|薪资|福利|招聘|公司|集团|企业|单位|部门|人数|报名|投递|面试|笔试|条件|岗位|职位|不限"


def sample_posts(body: Column, limit: int = 10) -> Column:
    """Posts that a line lists, without numbers and brackets, first seen first."""
    lists = F.regexp_extract_all(F.substring(F.coalesce(body, F.lit("")), 1, 6000), F.lit(SAMPLE_LINE), F.lit(1))
    parts = F.flatten(F.transform(lists, lambda x: F.split(x, spaced(r"[\s,，、;/／；｜|]+"))))
    clean = F.transform(parts, lambda x: trimmed(F.regexp_replace(F.regexp_replace(x, r"^\(?[一二三四五六七八九十\d]+[、.．)）]", ""), r"（[^）]*）|\([^)]*\)", "")))
    return F.slice(F.array_distinct(F.filter(clean, lambda x: F.char_length(x).between(2, 18) & ~x.rlike(NO_POST) & x.rlike(POST_END))), 1, limit)


def text_grid(text: str) -> list[list[str]]:
    """Rows of tab, bar or wide-space separated text; lines without a separator are dropped."""
    rows = []
    for line in (text or "").splitlines():
        cells = line.strip().strip("|").split("|") if "|" in line else line.split("\t") if "\t" in line else re.split(r"\s{2,}", line.strip())
        cells = [c.strip() for c in cells]
        if len(cells) > 1 and not all(re.fullmatch(r"[-:\s]*", c) for c in cells):
            rows.append(cells)
    return rows


def _fields_of(header: Sequence[str]) -> dict[str, int]:
    found: dict[str, int] = {}
    for field, words in HEADER_WORDS.items():
        for word in words:
            at = next((i for i, c in enumerate(header) if word in c and i not in found.values()), None)
            if at is not None:
                found[field] = at
                break
    return found


def positions_of_grid(grid: Sequence[Sequence[str]]) -> list[dict[str, str]]:
    """Rows under the best header of one to three rows among the first five; key-value cards otherwise.

    A header's score is ten per known field less its depth, so data rows do not join it. Header rows are joined by column; repeated
    headers inside the table are skipped; a row needs a name.
    """
    width = max((len(r) for r in grid), default=0)
    full = [[str(c or "").strip() for c in r] + [""] * (width - len(r)) for r in grid]
    best: tuple[int, int, dict[str, int]] = (0, 0, {})
    for start in range(min(5, len(full))):
        for depth in range(1, min(3, len(full) - start) + 1):
            joined = ["".join(dict.fromkeys(full[start + d][i] for d in range(depth))) for i in range(width)]
            found = _fields_of(joined)
            if "name" in found and len(found) > 1:
                score = 10 * len(found) - depth
                if score > best[0]:
                    best = (score, start + depth, found)
    score, first, fields = best
    out = []
    if score:
        for row in full[first:]:
            name = row[fields["name"]]
            if name and name not in HEADER_WORDS["name"] and len(name) <= 100:
                out.append({f: row[i] for f, i in fields.items()})
    elif full and all(len([c for c in r if c]) == 2 for r in full):
        card = {f: r[1] for r in full for f, at in _fields_of([r[0]]).items() if at == 0}
        if card.get("name"):
            out.append(card)
    return out
