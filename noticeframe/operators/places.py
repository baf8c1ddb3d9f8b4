"""Places named in texts, and venues under campus rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that another word contains: (name, what may not stand before, what may not follow).
HOMONYMS = {"佛山": ("千", ""), "吉林": ("", "省区"), "海南": ("", "省区"), "朝阳": ("", "省区")}


def alternation(names: Sequence[str]) -> str:
    """Longest name first, so a name wins over its own beginning; homonyms by look-around."""
    quote = lambda s: "".join("\\" + c if c in r".*+?^${}()|[]\\" else c for c in s)
    parts = []
    for name in sorted(set(names), key=lambda n: (-len(n), n)):
        before, after = HOMONYMS.get(name, ("", ""))
        parts.append((f"(?<![{before}])" if before else "") + quote(name) + (f"(?![{after}])" if after else ""))
    return "|".join(parts)


def named_places(text: Column, aliases: Mapping[str, Sequence[str]]) -> Column:
    """Cities whose alias occurs, sorted; an alias of several cities names none.

    The dictionary is a fixed registry, sent as a literal: no join and no shuffle.
    """
    sole = {a: c[0] for a, c in aliases.items() if len(set(c)) == 1}
    if not aliases:
        return F.array().cast("array<string>")
    lookup = F.create_map(*[F.lit(x) for p in sole.items() for x in p]) if sole else F.create_map().cast("map<string,string>")
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({alternation(list(aliases))})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(found, lambda n: F.try_element_at(lookup, n)))))


def places_or_counties(text: Column, cities: Mapping[str, Sequence[str]], counties: Mapping[str, Sequence[str]]) -> Column:
    """Counties count only where no city is named."""
    found = named_places(text, cities)
    return F.when(F.size(found) > 0, found).otherwise(named_places(text, counties))


def coded_places(text: Column, codes: Mapping[str, str]) -> Column:
    """Cities of six-digit codes."""
    lookup = F.create_map(*[F.lit(x) for p in codes.items() for x in p])
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<!\d)(\d{6})(?!\d)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(found, lambda c: F.try_element_at(lookup, c)))))


def resolved_events(events: DataFrame, rules: DataFrame, key: str, school: str, venue: str, cities: Mapping[str, Sequence[str]]) -> DataFrame:
    """City and method of each event.

    ``rules``: rule_id, rule_school, pattern, city: a fixed table of campus rules, joined by
    broadcast under a regular expression. Explicit and inferred cities that differ give no city.
    """
    matched = events.select(key, school, venue).join(
        F.broadcast(rules), ((F.col("rule_school") == F.col(school)) | F.contains(F.col(venue), F.col("rule_school"))) & F.expr(f"`{venue}` rlike pattern"), "left"
    )
    per = matched.groupBy(key).agg(F.first(venue).alias("_venue"), F.array_sort(F.collect_set("city")).alias("_inferred"), F.min("rule_id").alias("rule_id"))
    explicit = named_places(F.col("_venue"), cities)
    e, i = F.size("_explicit"), F.size("_inferred")
    clash = (e > 1) | (i > 1) | ((e == 1) & (i == 1) & (F.col("_explicit")[0] != F.col("_inferred")[0]))
    online = F.col("_venue").rlike("线上|直播|空中宣讲|腾讯会议|网络会议")
    method = F.when(online, "online").when(clash, "conflicting_locations").when(e == 1, "explicit").when(i == 1, "campus").otherwise("unverified_venue")
    out = per.withColumn("_explicit", explicit).withColumn("method", method)
    city = F.when(F.col("method") == "explicit", F.get("_explicit", F.lit(0))).when(F.col("method") == "campus", F.get("_inferred", F.lit(0)))
    return out.select(key, city.alias("city"), "method", F.when(F.col("method") == "campus", F.col("rule_id")).alias("rule_id"))
