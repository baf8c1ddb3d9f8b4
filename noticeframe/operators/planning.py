"""Order of a scan, diversified search candidates, asset paths."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import spaced
from .relational import first_of

# Endings that name a member of a family of companies, and the form of a positions asset.
FAMILY = spaced(r"(?:股份)?有限公司.*$|(?:集团)?(?:[^\s]{2,6}省)?分公司.*$|支公司.*$")
POSITIONS_ASSET = r"^/exam-assets/positions-[0-9a-f]{20}\.json$"
#: A source that goes after this many heads.
EARLY_HEADS = 4


def family_key(name: Column) -> Column:
    """A company's name without what tells it from its sisters."""
    return F.coalesce(F.nullif(F.regexp_replace(name, FAMILY, ""), F.lit("")), name)


def discovery_candidates(rows: DataFrame, history: DataFrame, now: Column, name: str = "name", order: str = "ord") -> DataFrame:
    """The first row of each family that was not tried within a day; names of 2 to 160 characters."""
    fit = rows.where(F.char_length(name).between(2, 160)).withColumn("_family", family_key(F.col(name)))
    tried = history.where(now - F.col("attempt_epoch") <= 86_400).select(F.regexp_replace("name", FAMILY, "").alias("_family")).distinct()
    return first_of(fit.join(tried, "_family", "left_anti"), ["_family"], [F.col(order)]).select(*rows.columns)


def scan_order(sources: DataFrame, order: str, priority: str, backfill: str, early: str | None = None) -> DataFrame:
    """``(source_id, head, pass, place)`` of a scan that reads newest pages first.

    Heads: announcements and talks of schools in turn, then their positions, each by priority. Then come
    the other sources in their order, and the schools again for older pages. One source may be put after
    the first heads. ``sources``: source_id, adapter, channel and the given columns, a registry of fixed size.
    """
    from pyspark.sql import Window

    school = F.col("adapter") == "sdei"
    turn = F.when(F.col("channel") == "announcements", 0).when(F.col("channel") == "talks", 1).when(F.col("channel") == "positions", 2)
    ranked = sources.where(school & turn.isNotNull()).withColumn("_turn", turn).withColumn("_n", F.row_number().over(Window.partitionBy("_turn").orderBy(priority, order)))
    heads = ranked.withColumn("place", F.row_number().over(Window.orderBy((F.col("_turn") == 2).asc(), F.col("_n"), F.col("_turn")))).select("source_id", F.lit(True).alias("head"), F.lit(0).alias("pass"), F.col("place").cast("long").alias("place"))
    late = sources.withColumn("pass", F.when(school, 2).when(F.col("source_id") == F.lit(early), 0).otherwise(1))
    late = late.withColumn("place", F.when(F.col("pass") == 0, EARLY_HEADS + 0.5).when(F.col("pass") == 1, F.col(order)).otherwise(F.row_number().over(Window.partitionBy("pass").orderBy(backfill, order))).cast("double"))
    rest = late.select("source_id", F.lit(False).alias("head"), F.col("pass"), "place")
    both = heads.withColumn("place", F.col("place").cast("double")).unionByName(rest)
    return both.withColumn("place", F.row_number().over(Window.orderBy("pass", "place", "source_id")).cast("long"))


def asset_paths(snapshot: Mapping[str, object]) -> list[str]:
    """Every file a snapshot names."""
    browse = snapshot.get("browse_index") or {}
    lists = [snapshot.get("index_shards"), snapshot.get("search_shards"), browse.get("shards"), browse.get("search_shards"), [snapshot.get("search_url")], [snapshot.get("coverage_url")]]
    return sorted({*(snapshot.get("detail_shards") or {}).values(), *(p for some in lists for p in some or () if p)})


def valid_positions_asset(path: Column) -> Column:
    """Whether a path has the form of a positions asset; none is fine."""
    return path.isNull() | path.rlike(POSITIONS_ASSET)
