"""F1, F2, O1, A1: the flat query: predicate, count, ordered page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_all
from .params import Query


def predicate(q: Query, today: str) -> Column:
    """Conjunction over listing_status, deadline, cities, nationwide, types, sectors, education, kind, salary_min, search_text."""
    tests = [
        F.coalesce("listing_status", F.lit("")) != "withdrawn",
        (F.coalesce("deadline", F.lit("")) == "") | (F.substring("deadline", 1, 10) >= today),
    ]
    if q.cities:
        hit = F.arrays_overlap("cities", F.array(*map(F.lit, q.cities)))
        tests.append(F.coalesce(hit | F.col("nationwide") if q.include_nationwide else hit, F.lit(False)))
    for value, column in ((q.type, "types"), (q.sector, "sectors")):
        if value not in ("", "全部"):
            tests.append(F.array_contains(column, value))
    for value, column in ((q.education, "education"), (q.kind, "kind")):
        if value not in ("", "全部"):
            tests.append(F.col(column) == value)
    if q.min_salary is not None:
        tests.append(F.col("salary_min") >= q.min_salary)
    if q.q:
        tests.append(contains_all(F.col("search_text"), q.q))
    return reduce(lambda a, b: a & b, tests)


def order(q: Query) -> list[Column]:
    if q.sort == "deadline":
        return [F.nullif(F.col("deadline"), F.lit("")).asc_nulls_last(), F.col("seq").asc()]
    if q.sort == "salary":
        return [F.col("salary_min").desc_nulls_last(), F.col("seq").asc()]
    return [F.col("seq").asc()]


def run(df: DataFrame, q: Query, today: str) -> tuple[DataFrame, DataFrame]:
    """``(page, total)``, both lazy."""
    q = q.normalised()
    kept = df.where(predicate(q, today))
    return kept.orderBy(*order(q)).offset((q.page - 1) * q.size).limit(q.size), kept.agg(F.count("*").alias("total"))
