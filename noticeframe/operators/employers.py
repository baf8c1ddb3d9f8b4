"""Who an employer is."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical, spaced

# Fixed values.
JOINT = spaced(r"[、;；|｜]|\s[&+/]\s|等\d+家|多家企业|联合招聘")
NAMELESS = "待核实|待确认|见原|未知|未明确|招聘单位名称|来源单位字段|^(?:招聘单位|企业名称|公司名称|单位名称)$"
LEGAL_END = "(?:有限责任公司|股份有限公司|有限公司|股份公司|分公司|分行|支行)$"
BODY_END = "(?:银行|信用合作社|事务所|研究院|研究所|设计院|科学院|医院|大学|学院|广播电视台|出版社|报社)$"
UNIT = "事业部|中心|项目部|工作站|筹备组"
DEPARTMENT = "(?:部|中心|事业群|研究院|实验室)$"


def brand_of(source: Column, brands: Mapping[str, str]) -> Column:
    """Brand of a source; null when it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for p in brands.items() for x in p]), source) if brands else F.lit(None).cast("string")


def identity(company: Column, source: Column, brands: Mapping[str, str], conflict: Column | None = None) -> Column:
    """struct(scope, source, name), or null for joint notices and unknown names without a brand.

    Scopes, the first that holds: brand, department, name (a legal or institutional ending), source.
    """
    name, brand = canonical(F.coalesce(company, F.lit(""))), brand_of(source, brands)
    sure = ~F.coalesce(conflict, F.lit(False)) if conflict is not None else F.lit(True)
    profile = lambda scope, n, s: F.struct(F.lit(scope).alias("scope"), s.alias("source"), n.alias("name"))
    full = name.rlike(LEGAL_END) | ((F.char_length(name) >= 4) & name.rlike(BODY_END) & ~name.rlike(UNIT))
    none, empty = F.lit(None), F.lit("")
    return (
        F.when(name.rlike(JOINT), none)
        .when(((name == "") | name.rlike(NAMELESS)) & brand.isNotNull(), profile("brand", brand, empty))
        .when((name == "") | name.rlike(NAMELESS), none)
        .when(F.coalesce(name == brand, F.lit(False)), profile("brand", brand, empty))
        .when(brand.isNotNull() & name.rlike(DEPARTMENT), profile("department", name, brand))
        .when(F.char_length(name) > 160, none)
        .when(sure & full, profile("name", name, empty))
        .otherwise(profile("source", name, F.substring(F.coalesce(source, empty), 1, 120)))
    )


def identity_id(who: Column) -> Column:
    """Text id of an identity."""
    return F.when(who.isNotNull(), F.concat(F.lit("employer:v1:"), F.to_json(F.array(who["scope"], who["source"], who["name"]))))


def identity_from(text: Column) -> Column:
    """The identity of an id, or null when it is malformed."""
    parts = F.from_json(F.regexp_extract(text, "^employer:v1:(.*)$", 1), "array<string>")
    good = (F.size(parts) == 3) & parts[0].isin("brand", "department", "name", "source") & (parts[2] != "")
    return F.when(F.coalesce(good, F.lit(False)), F.struct(parts[0].alias("scope"), parts[1].alias("source"), parts[2].alias("name")))


def catalog(rows: DataFrame, who: str, order: str) -> DataFrame:
    """Employers with their counts, first seen first."""
    return rows.where(F.col(who).isNotNull()).groupBy(who).agg(F.count("*").alias("rows"), F.min(order).alias("first")).orderBy("first")


def gap_histogram(employers: DataFrame, summaries: DataFrame, key: str) -> DataFrame:
    """Employers by what their rating lacks."""
    joined = employers.join(summaries, key, "left")
    gap = F.when(F.col("records").isNull(), "unmatched").when(F.col("records") == 0, "no_records").when(F.col("score").isNull(), "too_few").otherwise("rated")
    return joined.groupBy(gap.alias("gap")).agg(F.count("*").alias("cnt"))
