"""What is published of a record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_html, search_head_tail, spaced, trimmed, trimmed_excerpt

# Fields a summary leaves out, and headings of announcement sections.
HEAVY = ("body", "facts", "identity", "structured", "fingerprint", "content_fingerprint", "sample_positions", "duplicate_sources", "raw_evidence")
SECTIONS = (("company", "公司简介|企业简介|单位简介|关于我们"), ("responsibilities", "岗位职责|工作职责|工作内容"), ("notice", "招聘公告|招聘简章|公告正文"))


def summary(df: DataFrame, positions: str | None = "positions", timeline: str | None = "timeline") -> DataFrame:
    """Column and nested pruning: heavy fields dropped, positions cut to five fields, timeline without publications."""
    out = df.drop(*[c for c in HEAVY if c in df.columns])
    if positions in out.columns:
        out = out.withColumn(positions, F.transform(positions, lambda p: F.struct(*[p[f].alias(f) for f in ("name", "majors", "education", "city", "cohort")])))
    if timeline in out.columns:
        out = out.withColumn(timeline, F.filter(timeline, lambda e: ~e["type"].isin("published", "source_repost")))
    return out


def browsing(df: DataFrame) -> DataFrame:
    """Short excerpt, nationwide flag, search text; absent lists are empty."""
    lists = [f.name for f in df.schema if f.dataType.typeName() == "array"]
    out = df.select(*[F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)).alias(c) if c in lists else F.col(c) for c in df.columns])
    return out.withColumn("excerpt", trimmed_excerpt(F.col("excerpt"))).withColumn("nationwide", nationwide(F.col("cities"), F.col("title"))).withColumn("search_text", search_head_tail(F.concat_ws(" ", "title", "company"), F.col("excerpt")))


def nationwide(cities: Column, title: Column) -> Column:
    """No city and a title that says so."""
    return (F.coalesce(F.size(cities), F.lit(0)) <= 0) & F.coalesce(title, F.lit("")).rlike("全国|各地|不限城市|分支机构")


def card_summary(body: Column, limit: int = 200) -> Column:
    """Text under the first known heading, at most ``limit`` code points; '' when there is none."""
    text = plain_html(F.coalesce(body, F.lit("")))
    heads = "|".join(p for _, p in SECTIONS)
    found = [F.nullif(trimmed(F.regexp_extract(text, spaced(rf"(?s)(?:^|\n)[^\n]{{0,6}}(?:{p})[：:\s]*(.+?)(?=\n[^\n]{{0,6}}(?:{heads})|$)"), 1)), F.lit("")) for _, p in SECTIONS]
    return trimmed_excerpt(F.regexp_replace(F.coalesce(*found, F.lit("")), spaced(r"\s+"), " "), limit)


def reused_intros(df: DataFrame, employer: str, intro: str, published: str, key: str) -> DataFrame:
    """Rows without an intro get the latest one of exactly their employer."""
    latest = df.where(F.col(intro) != "").groupBy(employer).agg(F.max_by(intro, F.struct(published, key)).alias("_intro"))
    return df.join(latest, employer, "left").withColumn(intro, F.coalesce(F.nullif(F.col(intro), F.lit("")), F.col("_intro"))).drop("_intro")


def timeline(recorded: Column, published_at: Column, change: Column) -> Column:
    """Recorded events, the change and exactly one publication, by day; later publications are reposts.

    ``recorded``: array of struct(date, type, title); ``change``: such a struct or null.
    """
    first = F.struct(published_at.alias("date"), F.lit("published").alias("type"), F.lit("首次发布").alias("title"))
    empty = F.array().cast("array<struct<date:string,type:string,title:string>>")
    has = F.exists(F.coalesce(recorded, empty), lambda e: e["type"] == "published")
    events = F.array_sort(F.array_distinct(F.concat(F.coalesce(recorded, empty), F.when(has | published_at.isNull(), empty).otherwise(F.array(first)), F.when(change.isNull(), empty).otherwise(F.array(change)))))
    at = F.array_position(F.transform(events, lambda e: e["type"]), F.lit("published"))
    return F.transform(events, lambda e, i: F.struct(e["date"].alias("date"), F.when((e["type"] == "published") & (i + 1 != at), "source_repost").otherwise(e["type"]).alias("type"), e["title"].alias("title")))


def position_facts(positions: Column, samples: int = 4, majors: int = 12) -> Column:
    """struct(count, samples, majors, cities) of nested positions."""
    return F.struct(
        F.size(positions).alias("count"),
        F.slice(F.array_distinct(F.transform(positions, lambda p: p["name"])), 1, samples).alias("samples"),
        F.slice(F.array_distinct(F.flatten(F.transform(positions, lambda p: F.coalesce(p["majors"], F.array().cast("array<string>"))))), 1, majors).alias("majors"),
        F.array_sort(F.array_distinct(F.filter(F.transform(positions, lambda p: p["city"]), lambda c: c != ""))).alias("cities"),
    )


def stable_row_ids(df: DataFrame, parts: Sequence[str], order: Sequence[str], name: str = "row_id") -> DataFrame:
    """16 hex digits of the parts; repeats get -2, -3, ... in order."""
    base = F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256), 1, 16)
    with_id = df.withColumn(name, base)
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return with_id.withColumn("_n", n).withColumn(name, F.when(F.col("_n") > 1, F.concat_ws("-", name, "_n")).otherwise(F.col(name))).drop("_n")


def exam_dedup(df: DataFrame, title_key: str, organizer: str, is_hub: str, positions: str, body: str, key: str) -> DataFrame:
    """Best of equal title and organizer: no hub page, most positions, longest body; short titles stand alone."""
    group = F.when(F.char_length(title_key) >= 10, F.concat_ws("::", title_key, organizer)).otherwise(F.concat(F.lit("id:"), F.col(key).cast("string")))
    rest = [c for c in df.columns]
    best = F.struct((~F.col(is_hub)).alias("a"), F.col(positions).alias("b"), F.char_length(body).alias("c"), key)
    return df.withColumn("_g", group).groupBy("_g").agg(F.max_by(F.struct(*rest), best).alias("r")).select("r.*")


def without_clickbait(df: DataFrame, flag: str, keys: Sequence[Sequence[str]]) -> DataFrame:
    """Flagged rows with an unflagged twin on any of the key sets go."""
    bad, good = df.where(F.col(flag)), df.where(~F.col(flag))
    for cols in keys:
        known = good.dropna(subset=list(cols)).select(*cols).distinct()
        bad = bad.join(known, list(cols), "left_anti").select(df.columns)
    return good.unionByName(bad)


def exam_totals(df: DataFrame, positions: str, headcount: str, cities: str) -> DataFrame:
    """One row: exams, exams with positions, positions, headcount, cities."""
    n = F.coalesce(F.size(positions), F.lit(0))
    return df.agg(F.count("*").alias("exams"), F.count_if(n > 0).alias("with_positions"), F.sum(F.greatest(n, F.lit(0))).alias("positions"), F.sum(headcount).alias("headcount"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(cities)))).alias("cities"))
