"""Talks attached to the one campaign that fits best.

A talk and a campaign can belong together when they share a company name (or a short name declared beside it) and a graduating
class, and when their phases don't differ. Pairs meet on (name, class), so a company with very many campaigns is dealt out by class; the
best pair of a talk is a partial aggregate, and a talk whose best score is shared is attached to none.

Talks without an event, class or company, and campaigns of other kinds, take no part. Null texts count as empty. A repeated id
counts as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, company_norm, spaced
from .relational import unique_best

# Phases by the words that name them, how a short name is declared, and kinds of records.
PHASES = (("春招|春季招聘", "春"), ("秋招|秋季招聘", "秋"))
DECLARED = r"^\s*[（(]\s*(?:以下简称|简称)\s*[“\"‘]?([一-龥A-Za-z0-9]{3,15})"
DECLARED_WITHIN = 1200
TALK_SOURCE, POSITION, CAMPUS = "-talks", "具体岗位", "校招"


def phase(title: Column) -> Column:
    """The season that a title names; null for none."""
    said = F.coalesce(title, F.lit(""))
    return F.coalesce(*[F.when(said.rlike(p), n) for p, n in PHASES])


def company_names(company: Column, body: Column) -> Column:
    """Normal forms of a company and of the short name that the text declares beside its first mention with one."""
    name = F.coalesce(company, F.lit(""))

    def names(text: Column) -> Column:
        # What follows each mention: the text is cut at the name itself, which may hold any sign.
        after = F.slice(F.split(text, F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))), 2, 10_000)
        short = F.filter(F.transform(after, lambda t: F.regexp_extract(t, spaced(DECLARED), 1)), lambda s: s != "")
        return F.array_distinct(F.filter(F.array(company_norm(name), company_norm(F.get(short, F.lit(0)))), lambda n: n.isNotNull() & (n != "")))

    found = bound(F.substring(F.coalesce(body, F.lit("")), 1, DECLARED_WITHIN), names)
    return F.when(name == "", F.array().cast("array<string>")).otherwise(found)


def attached_talks(jobs: DataFrame) -> DataFrame:
    """``(talk_id, campaign_id)`` of the talks that one campaign fits best.

    ``jobs``: id, source_id, kind, title, company, body, types, years (arrays), has_event.
    """
    years = F.array_sort(F.array_distinct(F.coalesce("years", F.array().cast("array<string>"))))
    rows = jobs.select(
        "id", F.endswith(F.coalesce("source_id", F.lit("")), F.lit(TALK_SOURCE)).alias("is_talk"), "kind", F.coalesce("types", F.array().cast("array<string>")).alias("types"), "has_event",
        years.alias("years"), phase(F.col("title")).alias("phase"), company_norm(F.coalesce("company", F.lit(""))).alias("firm"), company_names(F.col("company"), F.col("body")).alias("names"),
    )
    met = lambda df: df.withColumn("name", F.explode("names")).withColumn("year", F.explode("years")).drop("names", "kind", "types", "is_talk", "has_event")
    talks = met(rows.where("is_talk AND has_event AND firm <> ''")).alias("t")
    campaigns = met(rows.where(f"NOT is_talk AND NOT (kind <=> '{POSITION}') AND array_contains(types, '{CAMPUS}')")).alias("c")
    apart = F.coalesce(F.col("t.phase") != F.col("c.phase"), F.lit(False))
    pairs = talks.join(campaigns, (F.col("t.name") == F.col("c.name")) & (F.col("t.year") == F.col("c.year")) & ~apart).select(
        F.col("t.id").alias("talk_id"), F.col("c.id").alias("campaign_id"), (F.col("t.firm") == F.col("c.firm")).cast("int").alias("same_firm"), (F.col("t.years") == F.col("c.years")).cast("int").alias("same_years")
    )
    return unique_best(pairs.distinct(), ["talk_id"], ["same_firm", "same_years"]).select("talk_id", "campaign_id")
