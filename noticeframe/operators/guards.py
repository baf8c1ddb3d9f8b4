"""Merges and publications that refuse bad input, and rows of words on a page."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .state import newest


def foreign_rows(shards: DataFrame, owned: DataFrame, generation: str) -> DataFrame:
    """Rows of shards that were collected from another baseline, or of a source that is not their pack's; with ``reason``.

    ``shards``: pack, base_generation, source_id and more; ``owned``: pack, source_id, a registry of fixed size.
    """
    known = F.broadcast(owned.select("pack", "source_id").distinct().withColumn("_own", F.lit(True)))
    marked = shards.join(known, ["pack", "source_id"], "left")
    reason = F.when(~F.col("base_generation").eqNullSafe(F.lit(generation)), "other baseline").when(F.col("_own").isNull(), "not its source")
    return marked.withColumn("reason", reason).where("reason IS NOT NULL").drop("_own")


def shard_merge(baseline: DataFrame, shards: DataFrame, owned: DataFrame, generation: str, key: str = "id", at: str = "last_verified_at", tie: str | None = None) -> DataFrame:
    """Baseline and shards, the newest version of each key; at equal times a shard's.

    Raises when a shard has a foreign row. No key of the baseline can be lost, as the merge is a union.
    """
    bad = foreign_rows(shards, owned, generation).groupBy("pack", "reason").agg(F.count("*").alias("rows")).head()
    if bad is not None:
        raise ValueError(f"{bad['rows']} rows of shard {bad['pack']}: {bad['reason']}")
    columns = baseline.columns
    both = baseline.withColumn("_priority", F.lit(1)).unionByName(shards.select(*columns).withColumn("_priority", F.lit(2)))
    return newest(both, [key], at, "_priority", tie).select(*columns)


def stale_sources(expected: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Expected sources without a newer attempt than the baseline's."""
    old = before.select("source_id", F.col("last_attempt_at").alias("_old"))
    seen = after.join(old, "source_id", "left").where(F.col("last_attempt_at") > F.coalesce("_old", F.lit("")))
    return expected.join(seen.select("source_id"), "source_id", "left_anti")


def lost_keys(baseline: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    """Keys of the baseline that are not in the merge; empty when it is a superset."""
    return baseline.select(key).join(merged.select(key), key, "left_anti")


def guarded_publication(candidate: DataFrame, baseline: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, list[str]]:
    """The candidate, or the baseline if any check (an aggregate that must be true) fails; and what failed."""
    row = candidate.agg(*[c.alias(n) for n, c in checks.items()]).first()
    failed = [n for n in checks if not row[n]]
    return (baseline if failed else candidate), failed


def valid_payloads(rows: DataFrame, payload: str, rules: Mapping[str, Column]) -> DataFrame:
    """rows of payloads all of whose rows keep every rule; one bad row rejects its payload.

    The verdict per payload is a partial aggregate, joined back; a payload of very many rows costs one row more.
    """
    good = rows.select(payload, *[F.coalesce(c, F.lit(False)).alias(f"_{n}") for n, c in rules.items()])
    verdict = good.groupBy(payload).agg(*[F.bool_and(f"_{n}").alias(f"_{n}") for n in rules])
    whole = verdict
    for n in rules:
        whole = whole.where(F.col(f"_{n}"))
    return rows.join(whole.select(payload), payload, "left_semi")


def rejected_payloads(rows: DataFrame, payload: str, rules: Mapping[str, Column]) -> DataFrame:
    """``(payload, reasons, rows)`` of what ``valid_payloads`` leaves out; reasons in the order of the rules."""
    bad = F.array_compact(F.array(*[F.when(F.count_if(~F.coalesce(c, F.lit(False))) > 0, F.lit(n)) for n, c in rules.items()]))
    return rows.groupBy(payload).agg(bad.alias("reasons"), F.count("*").alias("rows")).where(F.size("reasons") > 0)


def word_rows(words: DataFrame, document: str = "path", page: str = "page", x: str = "x", y: str = "y", text: str = "text", height: int = 6) -> DataFrame:
    """``(document, page, line, cells)``: words of a page as rows of a grid, by their height on the page in steps of ``height``.

    The step behind a reader of page layouts: it needs words with places, from whatever decodes the file.
    """
    line = (F.round(F.col(y) / height) * height).cast("int")
    cells = F.transform(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(text).alias("t")))), lambda w: w["t"])
    return words.groupBy(document, page, line.alias("line")).agg(cells.alias("cells"))
