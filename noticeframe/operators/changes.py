"""What changed between two versions of a record, and its locked first publication.

A version is a row with the columns of ``VERSION``. Nine detectors look at a version and the one before it, in order; the
first that fires names the change, and the first two that have something to say describe it. In batch the version before is a window
over a key's log, which sorts and spills; on streams it is the key's state (``streaming.changes``). Both go through the
same expressions.

Null fields count as empty. The first version of a key changes only what its own title or text announces. Two versions with equal
fields are no change. Versions of a key with the same time are ordered by the tie column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, trimmed

VERSION = {
    "title": "string", "body": "string", "deadline": "string", "position_count": "int", "majors": "array<string>", "cities": "array<string>",
    "application_url": "string", "attachments": "array<string>", "education": "string", "note": "string", "kind": "string", "published_at": "string",
}
#: Fields whose change makes a new version.
COMPARED = [c for c in VERSION if c not in ("published_at", "kind", "note")]
CHANGE = "struct<type:string,title:string,detail:string>"

# Words of batches, stages and extensions; what is said of each change; identifiers that addresses carry.
SUPPLEMENT, STAGE, STAGE_FIRST = "补录|补招|追加|第[二两三]批|续聘", "笔试|面试|初试|复试|录用名单|拟录用|公示", "笔试|面试|初试|复试|录用名单|拟录用|体检通知|公示"
EXTENDED_TITLE, EXTENDED_TEXT = "延长|延期|推迟", "经研究.*?延长|报名时间延长至|截止时间延长至"
STUB_NOTE = "仅核实"
ADDRESS_ID = r"(/(?:campus|social)/detail\?jobAdId=)[0-9a-fA-F-]+$"
TOPICS = (
    ("待遇|薪资|津贴|年薪|月薪|福利", "公告正文补充薪酬福利与待遇说明"),
    ("投递|邮箱|简历|报名|入口|方式|流程", "公告正文补充简历投递与报名流程说明"),
    ("专业|学科|学历|要求|条件|资格|生源", "公告正文微调应聘条件与资格要求"),
)
TALK = "宣讲会"
FAR_NEW, FAR_OLD, SMALL_MOVE = 330, 300, 14
LEAST_LINE, SHOWN_LINE, SHOWN_FILE, SHOWN_MAJORS, SHOWN_PARTS = 5, 24, 20, 3, 2


def said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def listed(names: Column) -> Column:
    return F.array_join(names, "、")


def day_of(text: Column) -> Column:
    """The date of a text that begins with a real ISO day; else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).cast("date"))


def shortened(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, said(F.substring(text, 1, most - 1), "…")).otherwise(text)


def _lines(body: Column) -> Column:
    bare = F.split(F.regexp_replace(body, "<[^>]+>", " "), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]")
    return F.filter(F.transform(bare, trimmed), lambda x: F.char_length(x) >= LEAST_LINE)


def change_between(old: Column, new: Column, day: Column) -> Column:
    """The change from version ``old`` to ``new``, both structs of ``VERSION``, on a date; null when nothing is said."""
    text = lambda v, c: F.coalesce(v[c], F.lit(""))
    array = lambda v, c: F.coalesce(v[c], F.array().cast("array<string>"))
    count = lambda v: F.coalesce(v["position_count"], F.lit(0))
    both = lambda c: (text(old, c), text(new, c))
    stub = (text(old, "body") == "") | F.startswith(text(old, "note"), F.lit(STUB_NOTE))
    found: list[Column] = []

    def told(test: Column, kind: str, title: str, detail: Column | str | None) -> None:
        detail = F.lit(None).cast("string") if detail is None else F.lit(detail) if isinstance(detail, str) else detail
        found.append(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(kind).alias("type"), F.lit(title).alias("title"), detail.alias("detail"))))

    before, now = both("deadline")
    away = lambda d: F.datediff(day_of(d), day)
    rolls = F.coalesce((before != "") & (now > before) & (away(now) >= FAR_NEW) & (away(before) >= FAR_OLD) & (F.datediff(day_of(now), day_of(before)) <= SMALL_MOVE), F.lit(False))
    told((before != "") & (now > before) & ~rolls, "deadline_extended", "截止延期", said("报名截止时间延长至 ", now, "（原截止时间：", before, "）"))
    told((before == "") & (now != ""), "deadline_extended", "明确截止时间", said("明确报名截止时间为 ", now))
    told((now != "") & (now < before), "deadline_extended", "截止调整", said("报名截止时间调整为 ", now, "（原截止时间：", before, "）"))

    before, now = both("title")
    told(now.rlike(SUPPLEMENT) & ~before.rlike(SUPPLEMENT), "supplemental", "补录招募", "招聘变更为补录 / 追加招聘批次")
    told(now.rlike(STAGE) & ~before.rlike(STAGE), "selection_stage", "考核进展", "发布笔试/面试或录用公示通知")

    before, now = count(old), count(new)
    added = F.array_except(array(new, "majors"), array(old, "majors"))
    moved = (before != now) | (F.size(added) > 0)
    of_majors = F.when(F.size(added) > 0, said("，新增专业：", listed(F.slice(added, 1, SHOWN_MAJORS)))).otherwise("")
    first_time, fewer = stub & (before == 0) & (now > 0), (now < before) & (F.size(added) == 0)
    told(moved & first_time, "positions_updated", "岗位表就绪", said("首次提取 ", now.cast("string"), " 个职位", of_majors))
    told(moved & ~first_time & fewer, "positions_updated", "岗位缩减", said("岗位数量缩减为 ", now.cast("string"), " 个职位（原 ", before.cast("string"), " 个）"))
    told(moved & ~first_time & ~fewer, "positions_updated", "岗位表更新", said("岗位需求变动为 ", now.cast("string"), " 个职位", of_majors))

    before, now = array(old, "cities"), array(new, "cities")
    more, less = F.array_sort(F.array_except(now, before)), F.array_sort(F.array_except(before, now))
    every = listed(F.array_sort(F.array_distinct(now)))
    completed = stub & (F.size(more) > 0)
    told(completed, "content_updated", "地点补全", said("首次补全工作地点「", every, "」"))
    detail = (
        F.when((F.size(more) > 0) & (F.size(less) == 0), said("工作地点新增「", listed(more), "」"))
        .when(F.size(more) > 0, said("工作地点调整为「", every, "」（新增", listed(more), "）"))
        .when(F.size(now) > 0, said("工作地点调整为「", every, "」"))
    )
    told(~completed & ((F.size(more) > 0) | (F.size(less) > 0)), "content_updated", "地点调整", detail)

    before, now = (trimmed(c) for c in both("application_url"))
    bare = lambda u: F.regexp_replace(u, ADDRESS_ID, "$1")
    detail = F.when(now == "", "网申投递方式调整").when(before == "", "新增网申投递入口").otherwise("网申投递入口已更新为最新链接")
    told(bare(before) != bare(now), "content_updated", "入口更新", detail)

    before, now = (F.filter(F.transform(array(v, "attachments"), trimmed), lambda t: t.isNotNull()) for v in (old, new))
    files = F.filter(now, lambda t: ~F.array_contains(before, t))
    several = F.when(F.size(files) > 1, said(" 等 ", F.size(files).cast("string"), " 个文件")).otherwise("")
    told(F.size(files) > 0, "content_updated", "附件变动", said("新增/更新附件「", shortened(F.get(files, F.lit(0)), SHOWN_FILE), "」", several))

    before, now = (trimmed(c) for c in both("education"))
    told((before != "") & (now != "") & (before != now), "content_updated", "资格调整", said("学历要求调整为「", now, "」（原要求：", before, "）"))

    def of_lines(lines: Column) -> Column:
        sample = F.array_join(lines, " ")
        topic = reduce(lambda c, rule: c.when(sample.rlike(rule[0]), rule[1]), TOPICS, F.when(F.size(lines) == 0, "招聘公告正文说明已同步最新修订"))
        detail = topic.otherwise(said("正文变动：补充「", shortened(F.get(lines, F.lit(0)), SHOWN_LINE), "」"))
        return F.struct(F.lit("content_updated").alias("type"), F.lit("内容更新").alias("title"), detail.alias("detail"))

    body = bound(F.array_except(_lines(text(new, "body")), _lines(text(old, "body"))), of_lines)

    def whole(f: Column) -> Column:
        parts = F.filter(F.transform(f, lambda x: x["detail"]), lambda d: d.isNotNull())
        all_found = F.when((F.size(parts) == 0) & ~rolls, F.concat(f, F.array(body))).otherwise(f)
        details = F.filter(F.transform(all_found, lambda x: x["detail"]), lambda d: d.isNotNull())
        first = F.get(all_found, F.lit(0))
        return F.when(F.size(details) > 0, F.struct(first["type"].alias("type"), first["title"].alias("title"), F.array_join(F.slice(details, 1, SHOWN_PARTS), "；").alias("detail")))

    differs = reduce(lambda a, b: a | b, [~old[c].eqNullSafe(new[c]) for c in COMPARED])
    return F.when(differs, bound(F.array_compact(F.array(*found)), whole))


def first_change(new: Column) -> Column:
    """What the first version of a record announces by itself; null for nothing."""
    title, body, deadline = (F.coalesce(new[c], F.lit("")) for c in ("title", "body", "deadline"))
    make = lambda kind, label, detail: F.struct(F.lit(kind).alias("type"), F.lit(label).alias("title"), detail.alias("detail"))
    until = F.when(deadline != "", said("报名截止时间延期至 ", deadline)).otherwise("报名截止时间已延期（见原公告）")
    return (
        F.when(title.rlike(EXTENDED_TITLE) | body.rlike(EXTENDED_TEXT), make("deadline_extended", "截止延期", until))
        .when(title.rlike(SUPPLEMENT), make("supplemental", "补录招募", F.lit("启动补录 / 追加招聘批次")))
        .when(title.rlike(STAGE_FIRST), make("selection_stage", "考核进展", F.lit("发布考核选拔或录用进展通知")))
    )


def with_change(pairs: DataFrame, at: str) -> DataFrame:
    """``pairs`` of ``old`` and ``new`` version structs with ``change``; rows that change nothing are left out."""
    change = F.when(F.col("old").isNull(), first_change(F.col("new"))).otherwise(change_between(F.col("old"), F.col("new"), F.to_date(at)))
    # As a row of a list the change is computed once; a condition on a plain column would compute it again below.
    return pairs.select("*", F.explode(F.array_compact(F.array(change))).alias("change"))


def as_versions(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` and a struct ``new`` with the columns of ``VERSION``, those that ``df`` lacks as nulls."""
    fields = [(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in VERSION.items()]
    return df.select(*keep, F.struct(*fields).alias("new"))


def version_pairs(log: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Batch form: ``(key, at, tie, new, old, first_seen, revision, published)`` of every row of a log.

    ``published`` is the locked publication: it never moves to a later day than it had, or than the day a record was first
    seen once there is a second version; talks are not locked; a text that is no day is taken as it is, and the lock starts again
    after it.
    """
    w = Window.partitionBy(key).orderBy(at, tie)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = as_versions(log, [key, at, tie]).select(
        "*", F.lag("new").over(w).alias("old"), F.date_format(F.first(at).over(upto), "yyyy-MM-dd").alias("first_seen"), F.row_number().over(w).alias("revision")
    )
    own, first = F.col("new.published_at"), F.col("first_seen")
    free = F.coalesce(F.col("new.kind") == TALK, F.lit(False))
    day = F.date_format(day_of(own), "yyyy-MM-dd")
    rows = rows.withColumn("_day", day).withColumn("_start", (F.col("revision") == 1) | free | day.isNull())
    rows = rows.withColumn("_run", F.sum(F.col("_start").cast("int")).over(upto))
    # A day after the first sighting, taken as it was, is healed by the version that follows, which then does not count itself.
    healed = F.coalesce(F.lag(F.col("_start") & (F.col("_day") > first)).over(w), F.lit(False)) & ~F.col("_start")
    rows = rows.withColumn("_counted", F.when(healed, first).otherwise(F.when(F.col("_day").isNotNull(), F.least(F.col("_day"), first))))
    kept = F.min("_counted").over(Window.partitionBy(key, "_run").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_kept", kept)
    published = F.when(F.col("_start") | (F.col("_kept") == F.col("_day")), own).otherwise(F.col("_kept"))
    return rows.withColumn("published", published).select(key, at, tie, "new", "old", "first_seen", "revision", "published")


def change_log(log: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """T2, T3 in batch: ``version_pairs`` with the change of each row that changes something."""
    return with_change(version_pairs(log, key, at, tie), at)
