"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durability import durable, read_once, shared_folder  # noqa: F401  (used from here by the operators and the pipeline)

#: White space that separates words everywhere in this subpackage: blank and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"


#: A key counts as hot when it holds more than one row in ``HOT_SHARE``: there are at most so many hot keys.
HOT_SHARE, HOT_LEAST = 5_000, 1_000


def join_counted(left: DataFrame, right: DataFrame, on: list[str], count: str) -> DataFrame:
    """``left`` with the columns of ``right``, one row per key, whose column ``count`` says how many rows of ``left`` a key has.

    Rows of hot keys are joined where they are, with a broadcast of at most ``HOT_SHARE`` rows; the rest
    is shuffled. ``left`` is read twice if there are hot keys, and should be durable.
    """
    right = durable(right)
    total, most = read_once(right.agg(F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.max(count), F.lit(0)))).collect()[0]
    bar = max(HOT_LEAST, total // HOT_SHARE)
    if most <= bar:
        return left.join(right.drop(count), on, "left")
    hot = F.broadcast(right.where(F.col(count) > bar).drop(count))
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.where(F.col(count) <= bar).drop(count), on, "left")
    return left.join(hot, on).unionByName(rest)


def repeatable(df: DataFrame) -> DataFrame:
    """``df`` if it gives the same rows in the same order whenever it is read: a plain scan of files, of which columns are computed or rows left out; else written first."""
    plan = df._jdf.queryExecution().optimizedPlan()
    steps = set(re.findall(r"^[ :+|-]*([A-Z]\w*)", plan.treeString(), re.M))
    return df if plan.deterministic() and "Relation" in steps and steps <= {"Project", "Filter", "Relation"} else durable(df)


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def set_aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under neutral column names, and the map to them: no column of a caller clashes with an inner one."""
    names = {c: f"__{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def words_of(text: Column) -> Column:
    """Array of the words of a text; an empty array when it has none."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP, -1))


def dealt_order(df: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """``df`` in global key order, with ``_part`` (its place in that order) and ``_row``.

    The rows are dealt by range, ties broken by a row number, so a key that holds a third of all
    rows is spread over many tasks. The result is durable: ``_part`` never changes again.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Durable at once: range partitioning reads its input twice, and row numbers must not change.
    tagged = durable(df.withColumn("_row", F.monotonically_increasing_id()))
    dealt = tagged.repartitionByRange(parts, *[F.col(k).asc_nulls_first() for k in keys], F.col("_row"))
    return durable(dealt.withColumn("_part", F.spark_partition_id()))
