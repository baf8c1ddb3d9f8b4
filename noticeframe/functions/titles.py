"""Display forms and small facts of titles and bodies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, replaced, spaced, trimmed

# Codes, places, notices without a role; signs that are not said twice, a stand-in sentence, bracketed
# tags at either end with their groups (tag, rest), and a doubled beginning.
ATS_CODE = spaced(r"\s*[(（\[【]\s*(?:岗位编号|职位编号|职位代码|岗位代码|编号)?\s*[:：]?\s*[A-Za-z]{1,4}[-_]?\d{4,12}\s*[)）\]】]\s*$")
OVERSEAS = "海外|境外|国外|美国|英国|日本|新加坡|德国|法国|澳大利亚|加拿大"
DOMESTIC = "全国|国内|中国大陆|各省市"
SIGNS = ("：:", "；;", "，,")
NO_EXCERPT = "单位介绍与岗位说明请查看原公告。"
BRACKETED = r"[【\[（(]([^】\]）)]{2,16})[】\]）)]"
TAGS = ((spaced(rf"^{BRACKETED}\s*(.+)$"), 1, 2), (spaced(rf"^(.+?)\s*{BRACKETED}$"), 2, 1))
TWICE = spaced(r"^([一-龥A-Za-z0-9]{2,14}?)\s*\1+")
NOT_A_ROLE = spaced(r"^(?:20\d{2}\s*[年届]?\s*)?(?:春季|秋季|校园|社会|公开)?(?:招聘|招聘简章|招聘公告|引才公告|简章|公告)$")


def without_ats_code(title: Column) -> Column:
    return trimmed(F.regexp_replace(title, ATS_CODE, ""))


def card_title(title: Column, company: Column) -> Column:
    """Title without its code and a leading company name."""
    name = trimmed(F.coalesce(company, F.lit("")))

    def without_name(bare: Column) -> Column:
        rest = F.when((name != "") & F.startswith(bare, name), trimmed(F.regexp_replace(F.substr(bare, F.char_length(name) + 1), spaced(r"^\s*[·•—\-:：]\s*"), "")))
        return bound(rest, lambda r: F.when(r != "", r).otherwise(bare))

    whole = lambda t: bound(without_ats_code(t), lambda c: F.when(c != "", c).otherwise(t))
    return bound(bound(trimmed(title), whole), without_name)


def role_portion(title: Column, company: Column) -> Column:
    """What names a role; '' for a mere notice."""
    role = F.element_at(F.split(card_title(title, company), "[·|｜]"), -1)
    return bound(trimmed(role), lambda r: F.when(r.rlike(NOT_A_ROLE), "").otherwise(r))


def clean_excerpt(text: Column) -> Column:
    """Signs said twice become one, wide gaps one blank; the sentence that stands for no text is none."""
    shown = reduce(lambda c, signs: F.regexp_replace(c, spaced(rf"[{signs}]\s*[{signs}]+"), signs[0]), SIGNS, trimmed(F.coalesce(text, F.lit(""))))
    return F.when(trimmed(text) == NO_EXCERPT, "").otherwise(trimmed(F.regexp_replace(shown, spaced(r"\s{2,}"), " ")))


def _without_tag(text: Column, school: Column, rule: tuple[str, int, int]) -> Column:
    """A bracketed tag at one end goes when the rest says it too, or when it is the school."""
    pattern, tag_group, rest_group = rule
    tag, rest = trimmed(F.regexp_extract(text, pattern, tag_group)), F.regexp_extract(text, pattern, rest_group)
    said = text.rlike(pattern) & (F.contains(rest, tag) | (tag == school))
    return F.when(said, trimmed(rest)).otherwise(text)


def venue_display(venue: Column, school: Column) -> Column:
    """A venue without what repeats itself: its school in front, a doubled beginning, a tag at either end."""
    name = trimmed(F.coalesce(school, F.lit("")))

    def shown(raw: Column) -> Column:
        inside = trimmed(F.regexp_replace(F.substr(raw, F.char_length(name) + 1), spaced(r"^[\s·•—-]+"), ""))
        bare = F.when((name != "") & F.startswith(raw, name) & (inside != ""), inside).otherwise(raw)
        return reduce(lambda c, rule: bound(c, lambda x: _without_tag(x, name, rule)), TAGS, F.regexp_replace(bare, TWICE, "$1"))

    return trimmed(bound(F.regexp_replace(trimmed(F.coalesce(venue, F.lit(""))), spaced(r"\s+"), " "), shown))


def education_display(text: Column, fallback: str = "学历待核实") -> Column:
    """Education without graduating classes, with single blanks."""
    rules = ((spaced(r"(?:20)?\d{2}\s*届(?:[\s,/、，|-]*(?:20)?\d{2}\s*届)*"), ""), (spaced(r"\s+"), " "), (spaced(r"^[\s,/、，|-]+|[\s,/、，|-]+$"), ""))
    clean = trimmed(replaced(F.coalesce(text, F.lit("")), *rules))
    return F.when(clean.isin("", "未明确 / 见原公告", "招聘条件待核实", "未明确"), fallback).otherwise(clean)


def job_types(types: Column, kind: Column, source: Column) -> Column:
    """Types, or 校招 for positions of campus sources."""
    campus = (kind == "具体岗位") & source.rlike("-(?:positions|jobs)$")
    return F.when(F.coalesce(F.size(types), F.lit(0)) > 0, types).when(campus, F.array(F.lit("校招"))).otherwise(F.array().cast("array<string>"))


def domestic_status(evidence: Column, cities: Column) -> Column:
    """Domestic, mixed, overseas or unknown."""
    text = F.array_join(F.coalesce(evidence, F.array().cast("array<string>")), "\n")
    home, abroad = (F.coalesce(F.size(cities), F.lit(0)) > 0) | text.rlike(DOMESTIC), text.rlike(OVERSEAS)
    return F.when(abroad & home, "mixed").when(abroad, "overseas").when(home, "domestic").otherwise("unknown")


# Kinds of employment and how they are said, statements of availability, and words of stages.
KINDS = {"全职": "full_time", "实习": "internship", "兼职": "part_time"}
KIND_SAID = spaced(rf"(?:工作性质|聘用性质|岗位性质)[：:\s]*({'|'.join(KINDS)})")
INTERNS = spaced(r"(?:^|\n)[^\n]{0,60}(?:实习生招聘|招聘实习生|实习岗位)[：\s]")
AVAILABLE = (
    ("long_term", spaced(r"(?:招聘期限|招聘时间|本岗位|本次招聘)[：:\s]*(?:长期|常年)(?:招聘)?")),
    ("open", spaced(r"(?:岗位状态|招聘状态)[：:\s]*(?:招聘中|开放|在招)")),
)
STAGES = {"selection": "笔试名单|面试名单|笔试安排|面试通知|资格复审|拟录用|录取公示", "extended": "延长|延期|推迟", "supplemental": "补录|补招|追加|第[二两三]批|续聘"}


def employment_type(body: Column) -> Column:
    """P32."""
    said = F.regexp_extract(body, KIND_SAID, 1)
    stated = F.coalesce(*[F.when(said == word, kind) for word, kind in KINDS.items()])
    return F.coalesce(stated, F.when(body.rlike(INTERNS), KINDS["实习"]), F.lit("unknown"))


def availability(body: Column) -> Column:
    """struct(kind, text) of an explicit statement, or null."""
    return F.coalesce(*[F.when(body.rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract(body, p, 0).alias("text"))) for k, p in AVAILABLE])


def stored_stage(title: Column, body: Column, deadline: Column, listing_status: Column, change: Column, today: str) -> Column:
    """The stored variant; the deadline compares as text."""
    text = F.concat_ws("\n", title, F.substring(F.coalesce(body, F.lit("")), 1, 1000))
    left = F.datediff(F.try_to_timestamp(F.substring(deadline, 1, 10)).cast("date"), F.to_date(F.lit(today)))
    known = F.coalesce(F.nullif(deadline, F.lit("")) < today, F.lit(False))
    rules = (
        ((listing_status == "withdrawn") | ((listing_status != "unconfirmed") & known), "expired"),
        (listing_status == "unconfirmed", "unconfirmed"),
        (text.rlike(STAGES["selection"]), "selection"),
        ((change == "deadline_extended") | title.rlike(STAGES["extended"]), "extended"),
        (title.rlike(STAGES["supplemental"]), "supplemental"),
        (left.between(0, 3), "expiring_soon"),
    )
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), stage) for test, stage in rules], F.lit("accepting"))


def score_scale(value: Column) -> Column:
    """The scale a platform score is on: 5, 10 or 100."""
    return F.when(value <= 5, 5).when(value <= 10, 10).otherwise(100)


def change_alert(kind: Column, detail: Column, recent: Column) -> Column:
    """First clause of a recent change that concerns applicants; else null."""
    first = trimmed(F.get(F.split(F.coalesce(detail, F.lit("")), "；"), F.lit(0)))
    shown = kind.isin("extended", "adjusted", "supplemental", "selection_stage") | ((kind == "positions_updated") & ~first.rlike("为 0 个职位|就绪|首次提取"))
    return F.when(recent & shown & (first != ""), first)
