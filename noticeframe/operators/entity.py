"""Duplicate merging, grouping and user state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import company_norm, spaced, title_core, trimmed

# Phases of a campaign, the first that occurs in a title counts.
PHASES = (
    ("春招补录", "春(?:季校园招聘|季招聘|招).*?补[录招]|补[录招].*?春[季招]"),
    ("秋招补录", "秋(?:季校园招聘|季招聘|招).*?补[录招]|补[录招].*?秋[季招]"),
    ("补录", "补录|补招|追加|第[二两三]批|续聘"),
    ("提前批", "提前批"),
    ("春招", "春(?:季校园招聘|季招聘|招)"),
    ("秋招", "秋(?:季校园招聘|季招聘|招)"),
    ("社招", "社招|社会"),
    ("实习", "实习"),
)
CHANGE_PRIORITY = {"deadline_extended": 5, "supplemental": 4, "selection_stage": 3, "positions_updated": 2, "content_updated": 1}


def campaign_phase(title: Column, default: str = "校招") -> Column:
    out = F
    for label, pattern in PHASES:
        out = out.when(title.rlike(pattern), label)
    return out.otherwise(default)


def dedup_key() -> Column:
    """A4: key cascade over id, source_id, kind, company, title, cities, types, graduation_years, body."""
    company, title = trimmed(F.coalesce("company", F.lit(""))), F.coalesce("title", F.lit(""))
    norm, core = company_norm(company), title_core(title)
    cities = F.array_join(F.array_sort(F.coalesce("cities", F.array().cast("array<string>"))), ",")
    named = F.array_distinct(F.regexp_extract_all(title, F.lit(spaced(r"(20\d{2})\s*(?:届|应届|年应届|年(?:高校)?毕业|(?=校园招聘|校招))")), F.lit(1)))
    campaign = F.array_distinct(F.regexp_extract_all(title, F.lit(spaced(r"(20\d{2})\s*(?:年(?:度)?\s*)?(?=校园招聘|校招)")), F.lit(1)))
    years = F.coalesce("graduation_years", F.array().cast("array<string>"))
    cohorts = F.array_join(F.array_sort(F.when(F.size(named) > 0, named).when(F.size(years) > 0, years).otherwise(campaign)), ",")
    tight = F.regexp_replace(title, spaced(r"\s+"), "")
    batch = F.regexp_extract(title, "(第[一二两三四五1-5](?:批|期))", 1)
    key = lambda *p: F.to_json(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in p]))
    return (
        F.when(F.col("source_id").endswith("-talks"), key("talk", F.col("id")))
        .when((F.col("kind") == "具体岗位") & ((company == "") | (title == "")), key("position-id", F.col("id")))
        .when(F.col("kind") == "具体岗位", key("position", norm, tight, cities))
        .when((company == "") & (core == ""), key("notice-id", F.col("id")))
        .when((norm != "") & (cohorts != "") & F.coalesce(F.array_contains("types", "校招"), F.lit(True)), key("campaign", norm, cohorts, campaign_phase(title), batch))
        .when((norm != "") & (core != ""), key("notice", norm, core))
        .when(core != "", key("title", core, cities))
        .otherwise(key("exact", tight, company))
    )


#: How a field of a merged record comes about; ``o`` orders the group, the first row is its primary.
def earliest(c: str, _: str) -> Column:
    return F.min(F.nullif(F.col(c), F.lit("")))


def latest(c: str, _: str) -> Column:
    return F.max(F.nullif(F.col(c), F.lit("")))


def first_known(c: str, o: str) -> Column:
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.col(o)))


def sorted_union(c: str, _: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))


def ordered_union(c: str, o: str, limit: int | None = None) -> Column:
    lists = F.transform(F.array_sort(F.collect_list(F.struct(F.col(o).alias("o"), F.coalesce(c, F.array().cast("array<string>")).alias("v")))), lambda x: x["v"])
    flat = F.array_distinct(F.flatten(lists))
    return F.slice(flat, 1, limit) if limit else flat


def much_longer(c: str, o: str, by: int = 200) -> Column:
    """A4h: fold in order; a later text wins only when more than ``by`` longer."""
    items = F.array_sort(F.collect_list(F.struct(F.col(o).alias("o"), F.coalesce(c, F.lit("")).alias("v"))))
    return F.aggregate(F.transform(items, lambda x: x["v"]), F.lit(""), lambda a, x: F.when((a == "") | (F.char_length(x) > F.char_length(a) + by), x).otherwise(a))


def top_change(c: str, o: str) -> Column:
    """A4i: the change of highest priority; the first of equals."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for p in CHANGE_PRIORITY.items() for x in p])[F.col(f"{c}.type")], F.lit(0))
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(rank.alias("p"), (-F.col(o)).alias("o"))))


def official_fields(columns: Sequence[str], official: str, keep_if_empty: Sequence[str] = ()):
    """A4g: a rule for a struct of fields: the first row's, unless it is a third party's and an official row follows.

    Fields in ``keep_if_empty`` (a body) are only replaced by text. Use as ``official_fields(...)(None, order)``.
    """

    def rule(_: str | None, o: str) -> Column:
        best = F.struct((~F.coalesce(F.col(official), F.lit(False))).alias("third"), F.col(o).alias("o"))
        filled = [F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", best)).alias(c) for c in keep_if_empty]
        return F.struct(*[F.min_by(c, best).alias(c) for c in columns if c not in keep_if_empty], *filled)

    return rule


def newest_check(status: str, checked_at: str):
    """A4j: a rule for a listing status: that of the newest check, the first of equals."""
    return lambda _, o: F.max_by(status, F.struct(F.coalesce(checked_at, F.lit("")).alias("at"), (-F.col(o)).alias("o")))


def merge_groups(df: DataFrame, key: str, order: str, rules: Mapping[str, object], primary: Sequence[str] = ()) -> DataFrame:
    """A4: one record per key; ``rules`` name a function above per field, ``primary`` fields come from the first row.

    Commutative fields are plain partial aggregates; only ordered fields collect, and only themselves.
    ``order`` is a long; ``_members`` lists the primary's rank and the size.
    """
    aggregates = [rule(c, order).alias(c) for c, rule in rules.items()]
    if primary:
        aggregates.append(F.min_by(F.struct(*primary), order).alias("_primary"))
    out = df.groupBy(key).agg(*aggregates, F.count("*").alias("members"))
    return out.select(key, *([F.col("_primary.*")] if primary else []), *rules, "members")


def grouped(df: DataFrame, keys: Sequence[str], order: str, members: Sequence[str]) -> DataFrame:
    """Groups in the order of their first member, members in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("ord"), *members)))
    return df.groupBy(*keys).agg(F.min(order).alias("first_ord"), F.count("*").alias("size"), rows.alias("members"))


def role_labels(df: DataFrame, group: Sequence[str], role: str, sub: str, city: str) -> DataFrame:
    """The shortest label that is unique in its group: role, role · sub, role · city."""
    n = lambda *c: F.count("*").over(Window.partitionBy(*group, *c))
    label = F.when(n(role) == 1, F.col(role)).when((F.col(sub) != "") & (n(role, sub) == 1), F.concat_ws(" · ", role, sub)).otherwise(F.concat_ws(" · ", role, city))
    return df.withColumn("label", label)


def with_user_state(df: DataFrame, state: DataFrame, id_col: str, aliases: str | None, state_id: str) -> DataFrame:
    """User records of a row or its aliases: flags by or, newest read, details by newest change.

    ``state`` has saved, applied, hidden, read_at, note, updated_at; an absent flag inherits, false stays false.
    """
    ids = F.array(F.col(id_col)) if aliases is None else F.array_distinct(F.array_append(F.coalesce(aliases, F.array().cast("array<string>")), F.col(id_col)))
    keys = df.select(F.col(id_col).alias("_owner"), F.explode(ids).alias("_alias"))
    found = keys.join(state, keys["_alias"] == state[state_id]).groupBy("_owner").agg(
        *[F.bool_or(c).alias(c) for c in ("saved", "applied", "hidden")], F.max("read_at").alias("read_at"), F.max_by("note", F.struct("updated_at", "_alias")).alias("note")
    )
    return df.join(found, df[id_col] == found["_owner"], "left").drop("_owner")
