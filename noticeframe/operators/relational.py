"""Filters, facets, counts, orders, pages, joins and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durability import durable


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys to as many partitions as a shuffle has, for costly steps per row.

    A compact file has few row groups, and each is read by one task whatever its rows cost. Groups of the keys need no further shuffle.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def facet_counts(df: DataFrame, single: Sequence[str] = (), multi: Sequence[str] = (), unknown: str = "未明确", top: Mapping[str, int] | None = None) -> DataFrame:
    """A2: ``(facet, value, cnt)`` for all facets in one pass over the rows.

    Array facets are exploded, an empty or null one counts as ``unknown``; ``top`` keeps the largest
    values of a facet, ties by value. The pass explodes into (facet, value) pairs and counts them with
    partial aggregation, so the shuffle holds one row per task and distinct value.
    """
    known = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(unknown))
    pairs = [F.array(F.struct(F.lit(c).alias("facet"), known(F.col(c)).alias("value"))) for c in single]
    for c in multi:
        values = F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.array(F.lit(unknown))).otherwise(F.array_distinct(c))
        pairs.append(F.transform(values, _named(c)))
    counts = df.select(F.explode(F.concat(*pairs)).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("cnt"))
    if top:
        rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("cnt"), "value"))
        limits = reduce(lambda w, k: w.when(F.col("facet") == k, F.lit(top[k])), top, F.when(F.lit(False), F.lit(0)))
        counts = counts.withColumn("_rank", rank).withColumn("_top", limits).where("_top IS NULL OR _rank <= _top").drop("_rank", "_top")
    return counts


def _named(facet: str):
    return lambda v: F.struct(F.lit(facet).alias("facet"), v.cast("string").alias("value"))


def flag_counts(df: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """One row of conditional counts, one scan."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in flags.items()])


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page of a total order: take-ordered, never a full sort, when the offset is small."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def ranked(df: DataFrame, order: Sequence[Column], name: str = "seq") -> DataFrame:
    """1-based global rank. Ranks come from a range partitioning and per-part counts, not from one task."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select("*", *[o.alias(f"_k{i}") for i, o in enumerate(_plain(order))])
    wanted = [_like(o, F.col(f"_k{i}")) for i, o in enumerate(order)]
    # Durable: the bounds of a range partitioning come from a sample that differs from plan to plan.
    dealt = durable(keyed.repartitionByRange(parts, *wanted).withColumn("_part", F.spark_partition_id()))
    inside = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*wanted)))
    before = inside.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_before")
    )
    out = inside.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_in")).cast("long"))
    return out.select(*df.columns, name)


def _plain(order: Sequence[Column | tuple[Column, str]]) -> list[Column]:
    return [o[0] if isinstance(o, tuple) else o for o in order]


def _like(order: Column | tuple[Column, str], col: Column) -> Column:
    return {"desc": col.desc_nulls_last(), "asc": col.asc_nulls_last()}[order[1]] if isinstance(order, tuple) else col.asc_nulls_last()


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in order, as an argmin: partial aggregation instead of a window."""
    cols = [c for c in df.columns if c not in keys]
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*cols), key).alias("_first")).select(*keys, "_first.*")


def unique_best(candidates: DataFrame, key: Sequence[str], score: Sequence[str]) -> DataFrame:
    """The candidate with the highest score of each key, unless several share it.

    Two partial aggregations: equal scores of a key become one row with a count, then the best of these is taken.
    """
    rest = [c for c in candidates.columns if c not in key]
    tied = candidates.groupBy(*key, F.struct(*score).alias("_score")).agg(F.count("*").alias("_n"), F.min(F.struct(*rest)).alias("_row"))
    best = tied.groupBy(*key).agg(F.max_by(F.struct("_n", "_row"), "_score").alias("_b"))
    return best.where("_b._n = 1").select(*key, "_b._row.*").select(*candidates.columns)


def semi(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key occurs."""
    return df.join(keys, list(on), "left_semi")


def missing(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key does not occur."""
    return df.join(keys, list(on), "left_anti")


def keyed_union(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int | None = None) -> DataFrame:
    """A4f, A5: rows without repeats of a key, in order, at most ``limit`` per first key column."""
    kept = first_of(df, keys, order)
    if limit is None:
        return kept
    rank = F.row_number().over(Window.partitionBy(keys[0]).orderBy(*order))
    return kept.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def same_row_exists(rows: Column, test) -> Column:
    """all active conditions must hold for the same nested row."""
    return F.coalesce(F.exists(rows, test), F.lit(False))


def range_link(children: DataFrame, parents: DataFrame, on: str, child_at: str, parent_at: str, days: int, score: Column, at_least: float, child_id: str, parent_id: str) -> DataFrame:
    """Best earlier parent with the same key within ``days``; ties go to the first parent.

    The best parent is an argmax with partial aggregation.
    """
    # Days are cut into stretches of ``days``: a parent lies in its child's stretch or the one before, so a hot key's
    # rows only meet within a window of time. Rows without a day meet every row of their key.
    stretch = lambda c: F.floor(F.unix_date(F.col(c).cast("date")) / days)
    c = children.withColumn("_at", stretch(child_at))
    p = parents.withColumn("_at", F.explode(F.when(F.col(parent_at).isNotNull(), F.array(stretch(parent_at), stretch(parent_at) + 1)).otherwise(F.array(F.lit(None).cast("long")))))

    def met(left: DataFrame, right: DataFrame, same: Column, test: Column) -> DataFrame:
        pairs = left.alias("c").join(right.alias("p"), same & (F.col(f"c.{on}") == F.col(f"p.{on}")) & (F.col(f"c.{child_id}") != F.col(f"p.{parent_id}")) & test)
        return pairs.select(F.col(f"c.{child_id}").alias("child"), F.col(f"p.{parent_id}").alias("parent"), score.alias("score")).where(F.col("score") >= at_least)

    gap = F.datediff(F.col(f"c.{child_at}"), F.col(f"p.{parent_at}"))
    dated = met(c.where("_at IS NOT NULL"), p.where("_at IS NOT NULL"), F.col("c._at") == F.col("p._at"), gap.between(0, days))
    undated = met(c.where("_at IS NULL"), parents, F.lit(True), F.lit(True)).unionByName(met(c.where("_at IS NOT NULL"), p.where("_at IS NULL"), F.lit(True), F.lit(True)))
    best = F.max_by(F.struct("parent", "score"), F.struct(F.col("score"), -F.col("parent")))
    return dated.unionByName(undated).groupBy("child").agg(best.alias("b")).select("child", "b.parent", "b.score")


def unique_alias(names: DataFrame, alias: str, entity: str) -> DataFrame:
    """Aliases that name exactly one entity."""
    return names.groupBy(alias).agg(F.min(entity).alias(entity), F.count_distinct(entity).alias("_n")).where("_n = 1").drop("_n")


def interleaved(df: DataFrame, is_first: Column, order: Sequence[Column], ratio: int = 4) -> DataFrame:
    """``ratio`` rows of the first class, then one of the other, each in its own order.

    A row's slot follows from its rank in its class; when one class runs out the other goes on. The classes are
    ranked as one order, by range, so neither of them meets in one task.
    """
    classed = df.withColumn("_first", F.coalesce(is_first, F.lit(False)))
    size = classed.agg(F.count_if("_first")).first()[0]
    numbered = ranked(classed, [~F.col("_first"), *order], "_n")
    n = F.when(F.col("_first"), F.col("_n") - 1).otherwise(F.col("_n") - 1 - size)
    slot = F.when(F.col("_first"), F.floor(n / ratio) * (ratio + 1) + n % ratio).otherwise(n * (ratio + 1) + ratio)
    return numbered.withColumn("slot", slot.cast("long")).drop("_first", "_n")


def field_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(field, present, bytes)`` of every column in one scan."""
    cols = list(columns or df.columns)
    row = df.agg(*[F.struct(F.count(c).alias("present"), F.coalesce(F.sum(F.octet_length(F.col(c).cast("string"))), F.lit(0)).alias("bytes")).alias(c) for c in cols])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}.present").alias("present"), F.col(f"{c}.bytes").alias("bytes")) for c in cols])).alias("f")).select("f.*")


def chunk_ids(sizes: Sequence[int], budget: int, first: int | None = None) -> list[int]:
    """Greedy byte budget: a chunk closes when the next row would exceed it; the first may be smaller."""
    out, chunk, held, limit = [], 0, 0, first or budget
    for n, size in enumerate(sizes):
        if n and held and held + size > limit:
            chunk, held, limit = chunk + 1, 0, budget
        held += size
        out.append(chunk)
    return out


def chunked(df: DataFrame, group: str, order: str, size: str, budget: int, first: int | None = None) -> DataFrame:
    """K2: chunk ids within each group of a publication; the greedy reset is sequential, so it runs per group."""

    def run(pdf):
        pdf = pdf.sort_values(order)
        return pdf.assign(chunk=chunk_ids(pdf[size].tolist(), budget, first))

    narrow = df.select(group, order, size)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema)
    return narrow.groupBy(group).applyInPandas(run, f"{fields}, chunk int")


def greedy_unique(df: DataFrame, entity: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep rows in order unless one of several keys was taken by a kept row.

    A dropped row blocks nothing, so this is not a distinct on any key; it runs per entity, whose
    records are bounded by the collection policy.
    """

    def run(pdf):
        pdf = pdf.sort_values(list(order), kind="stable")
        seen, kept = [set() for _ in keys], []
        for row in pdf[list(keys)].itertuples(index=False):
            ok = not any(v in s for v, s in zip(row, seen))
            if ok:
                for v, s in zip(row, seen):
                    s.add(v)
            kept.append(ok)
        return pdf[kept]

    return df.groupBy(entity).applyInPandas(run, df.schema)
