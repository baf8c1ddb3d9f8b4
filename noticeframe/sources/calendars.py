"""Campus calendars in several JSON shapes as one event table, by schema on read.

Bodies are parsed to VARIANT once; a rule per format says where its rows are, what a row must have and where each field of an event
comes from. Fields that no rule names stay in ``raw``. Parsing, checks and fields are built-in expressions.

A page that is no JSON (``broken``), that does not say it succeeded, or that has a row without identity, title, day or clock its
format promises (``refused``) gives one row with that status and no event; so does a page without rows (``empty``), and one of a format
without a rule (``unknown``). Null bodies are broken.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days and clocks as the calendars write them.
DAY, STAMP, CLOCK = "^20[0-9]{2}-[0-9]{2}-[0-9]{2}$", "^20[0-9]{2}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$", "(?<![0-9])((?:[01]?[0-9]|2[0-3]):[0-5][0-9])"
EVENT = ("identity", "url", "title", "day", "starts", "ends", "school", "venue")
# Words before the venue or title of online and cancelled talks, and kinds that are online.
ONLINE, ONLINE_AT, CANCELLED, ONLINE_KINDS = "线上宣讲 ", "线上宣讲 · ", "已取消：", "'空宣', '空中宣讲会', '线上'"


def text(path: str, source: str = "r") -> str:
    """SQL for a field of a variant as text; '' for none."""
    return f"coalesce(try_variant_get({source}, '$.{path}', 'string'), '')"


@dataclass(frozen=True)
class Format:
    """``good``: SQL over the page's variant ``v``; ``rows``: path of its rows; ``must``: SQL a row ``r`` has to meet, ``skip``: rows that are left out instead."""

    good: str
    rows: str
    fields: dict[str, str]
    must: str = "true"
    skip: str = "false"
    extra: dict[str, str] = field(default_factory=dict)


def same_day_end(start: str, end: str) -> str:
    return f"CASE WHEN {end} <> '' AND substring({end}, 1, 10) = substring({start}, 1, 10) THEN substring({end}, 12, 5) END"


def real(stamp: str, shape: str) -> str:
    return f"({stamp} RLIKE '{shape}' AND try_to_timestamp({stamp}) IS NOT NULL)"


_CLOCKS = f"regexp_extract_all({text('kssjd')}, '{CLOCK}', 1)"
#: ``base``, ``school`` and ``code`` are columns of the page.
FORMATS = {
    "data_list": Format(
        good="try_variant_get(v, '$.code', 'int') = 1",
        rows="data",
        must=f"{text('career_talk_id')} RLIKE '^[0-9]+$' AND {text('meet_day')} <> '' AND {text('meet_name')} <> ''",
        fields={
            "identity": text("career_talk_id"), "url": f"concat(base, '/detail/career?id=', {text('career_talk_id')})",
            "title": f"concat(CASE WHEN {text('career_state')} = '1' THEN '{CANCELLED}' ELSE '' END, {text('meet_name')})",
            "day": text("meet_day"), "starts": "try_variant_get(r, '$.meet_time', 'string')", "ends": "try_variant_get(r, '$.meet_end_time', 'string')",
            "venue": f"concat(CASE WHEN {text('is_yun')} NOT IN ('', '0') THEN '{ONLINE}' ELSE '' END, {text('address')})",
        },
    ),
    "object_list": Format(
        good="try_variant_get(v, '$.state', 'int') = 1",
        rows="object.list",
        skip=f"NOT {real(text('startTime'), STAMP)}",
        fields={
            "identity": text("id"), "url": f"concat(base, {text('url')})", "title": text("title"), "day": f"substring({text('startTime')}, 1, 10)", "starts": f"substring({text('startTime')}, 12, 5)",
            "ends": same_day_end(text("startTime"), text("endTime")), "venue": text("fieldExport"),
        },
    ),
    "object_page": Format(
        good="try_variant_get(v, '$.state', 'int') = 1 AND try_variant_get(v, '$.object.totalPage', 'int') >= 0 AND try_variant_get(v, '$.object.count', 'int') >= size(try_variant_get(v, '$.object.list', 'array<variant>'))",
        rows="object.list",
        must=f"{text('id')} RLIKE '^[A-Za-z0-9_-]{{1,80}}$' AND {text('title')} <> '' AND {real(text('startTime'), STAMP)} AND ({text('endTime')} = '' OR {real(text('endTime'), STAMP)} AND {text('endTime')} >= {text('startTime')})",
        fields={
            "identity": text("id"), "url": f"concat(base, {text('url')})", "title": text("title"), "day": f"substring({text('startTime')}, 1, 10)", "starts": f"substring({text('startTime')}, 12, 5)",
            "ends": same_day_end(text("startTime"), text("endTime")),
            "venue": f"concat(CASE WHEN {text('fairTypeName')} IN ({ONLINE_KINDS}) THEN '{ONLINE_AT}' ELSE '' END, coalesce(nullif({text('fieldExport')}, ''), {text('place')}))",
        },
    ),
    "result_records": Format(
        good="try_variant_get(v, '$.code', 'int') = 200 AND try_variant_get(v, '$.success', 'boolean') AND try_variant_get(v, '$.result.total', 'int') >= size(try_variant_get(v, '$.result.records', 'array<variant>'))",
        rows="result.records",
        must=(
            f"{text('xjhid')} RLIKE '^[0-9]+$' AND {text('xjhmc')} <> '' AND {text('jbrq')} RLIKE '{DAY}' AND try_to_timestamp({text('jbrq')}) IS NOT NULL AND {text('jbxx')} = school AND size({_CLOCKS}) > 0 "
            f"AND size(filter(regexp_extract_all({text('kssjd')}, '20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}', 0), d -> d <> {text('jbrq')})) = 0"
        ),
        fields={
            "identity": f"concat(code, ':', {text('xjhid')})", "url": f"concat(base, '/sub-station/lectureDetail?xxdm=', code, '&xjhid=', {text('xjhid')})", "title": text("xjhmc"), "day": text("jbrq"),
            "starts": f"lpad(get({_CLOCKS}, 0), 5, '0')", "ends": f"lpad(get({_CLOCKS}, 1), 5, '0')", "venue": text("jbdd"),
        },
    ),
}


def calendar_rows(pages: DataFrame, formats: dict[str, Format] = FORMATS) -> DataFrame:
    """``(page, status, identity, url, title, day, starts, ends, school, venue, raw)`` of pages ``(page, format, body, base, school, code)``."""

    def by_format(of) -> Column:
        out = F
        for name, rule in formats.items():
            out = out.when(F.col("format") == name, F.expr(of(rule)))
        return out.otherwise(F.lit(None))

    known = F.col("format").isin(*formats)
    parsed = pages.select("page", "format", "base", "school", "code", F.try_parse_json("body").alias("v"))
    listed = parsed.withColumn("rows", by_format(lambda f: f"try_variant_get(v, '$.{f.rows}', 'array<variant>')")).withColumn("good", F.coalesce(by_format(lambda f: f.good), F.lit(False)) & F.col("rows").isNotNull())
    fits = lambda f: f"exists(rows, r -> NOT coalesce({f.must}, false))"
    taken = lambda f: f"filter(rows, r -> NOT coalesce({f.skip}, true))"
    judged = listed.withColumn("bad", F.coalesce(by_format(fits), F.lit(True))).withColumn("rows", by_format(taken))
    status = F.when(~known, "unknown").when(F.col("v").isNull(), "broken").when(~F.col("good") | F.col("bad"), "refused").when(F.size("rows") == 0, "empty").otherwise("event")
    rows = judged.withColumn("status", status).withColumn("r", F.explode_outer(F.when(status == "event", F.col("rows"))))
    event = {n: by_format(lambda f, n=n: f.fields[n]) for n in EVENT if n != "school"} | {"school": F.when(F.col("status") == "event", F.col("school"))}
    return rows.select("page", "status", *[F.when(F.col("status") == "event", event[n]).alias(n) for n in EVENT], F.to_json("r").alias("raw"))
