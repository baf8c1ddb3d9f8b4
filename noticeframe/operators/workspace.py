"""F3 (short form), F4, O2, O3, O5: the content predicate, personal views and orders of a workspace."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import facts, text
from ..functions.timeutil import expired, instant
from ..plans.params import Filters


def content_predicate(f: Filters, now: Column) -> Column:
    """conjunction over the opportunity columns; cheap tests first, keywords last."""
    tests: list[Column] = []
    if not f.include_expired:
        tests.append(~(expired(F.col("deadline"), now) | (F.coalesce("listing_status", F.lit("")) == "withdrawn")))
    for wanted, column in ((f.kind, "kind"), (f.employment, "employment_type"), (f.provenance, "provenance")):
        if wanted not in ("", "全部"):
            tests.append(F.col(column) == wanted)
    for wanted, column in ((f.type, "types"), (f.sector, "sectors"), (f.direction, "directions"), (f.year, "graduation_years")):
        if wanted not in ("", "全部"):
            empty = F.coalesce(F.size(column), F.lit(0)) <= 0
            tests.append(F.coalesce(F.array_contains(column, wanted), F.lit(False)) | (F.lit(f.include_unknown) & empty))
    if f.cities:
        hit = F.arrays_overlap("cities", F.array(*map(F.lit, f.cities)))
        tests.append(F.coalesce(hit, F.lit(False)) | (F.lit(f.include_nationwide) & F.coalesce("nationwide", F.lit(False))))
    if f.education not in ("", "全部", "不限"):
        tests.append(facts.education_matches(F.col("education"), f.education, f.include_unknown))
    if f.position_level and (f.cities or f.education or f.year):
        tests.append(
            F.coalesce(
                F.exists(
                    "positions",
                    lambda p: reduce(
                        lambda a, b: a & b,
                        [
                            F.lit(not f.cities) | reduce(lambda a, c: a | F.contains(p["city"], F.lit(c)), f.cities, F.lit(f.include_unknown) & (F.coalesce(p["city"], F.lit("")) == "")),
                            facts.education_matches(p["education"], f.education, f.include_unknown),
                            F.lit(f.year in ("", "全部")) | F.contains(F.coalesce(p["cohort"], F.lit(f.year if f.include_unknown else "")), F.lit(f.year)),
                        ],
                    ),
                ),
                F.lit(False),
            )
        )
    if f.min_salary:
        pay = facts.salary_range(F.col("title"), F.col("excerpt"))
        tests.append(F.coalesce(pay["open_ended"] | (pay["max"] >= f.min_salary), F.lit(False)))
    if f.query:
        tests.append(text.contains_all(F.col("search_text"), f.query))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def personal_predicate(view: str) -> Column:
    """planned, pipeline, saved, applied, hidden or all; hidden rows show only in their own view."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    if view == "hidden":
        return flag("hidden")
    shown = ~flag("hidden")
    return shown & {
        "all": F.lit(True),
        "saved": flag("saved"),
        "applied": flag("applied"),
        "planned": flag("saved") & ~flag("applied"),
        "pipeline": flag("saved") | flag("applied"),
    }[view]


def workspace_order(sort: str, now: Column) -> list[Column]:
    """Total orders; the id breaks ties."""
    if sort == "deadline":
        at = instant(F.col("deadline"))
        return [F.coalesce(at < now, F.lit(False)).asc(), at.asc_nulls_last(), F.col("id").asc()]
    if sort == "salary":
        pay = facts.salary_range(F.col("title"), F.col("excerpt"))
        return [F.coalesce(pay["max"], pay["min"]).desc_nulls_last(), F.col("id").asc()]
    return [F.col("effective_day").desc(), F.col("tie_ms").desc(), F.col("id").asc()]


def workspace(df: DataFrame, filters: Filters, now: Column, view: str = "all", sort: str = "newest", page: int = 1, size: int = 20) -> DataFrame:
    """Entry B: filter, personal view, order, page; Catalyst fuses the first two into one scan."""
    kept = df.where(content_predicate(filters, now)).where(personal_predicate(view))
    return kept.orderBy(*workspace_order(sort, now)).offset((page - 1) * size).limit(size)
