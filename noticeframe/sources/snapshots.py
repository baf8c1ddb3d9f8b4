"""Snapshots of JSON shards, API pages, calendars; guarded writes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_shards(spark: SparkSession, paths: Sequence[str], row: T.StructType | str, field: str = "jobs") -> DataFrame:
    """Rows of ``{field: [...]}`` shard files; the schema is given, never inferred."""
    kind = row if isinstance(row, str) else row.simpleString()
    shard = spark.read.schema(f"`{field}` array<{kind}>").option("multiLine", "true").option("mode", "FAILFAST").json(list(paths))
    return shard.select(F.inline(field))


def guarded(df: DataFrame, key: str, expected: int | None = None) -> DataFrame:
    """``df``, after a check that keys are unique and their count is ``expected``."""
    n, distinct = df.agg(F.count("*"), F.count_distinct(key)).first()
    if n != distinct or (expected is not None and n != expected):
        raise ValueError(f"{n} rows, {distinct} distinct {key}, {expected if expected is not None else n} expected")
    return df


def hydrated(rows: DataFrame, details: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Fields filled from a detail table where they are null."""
    d = details.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    kept = [c for c in rows.columns if c not in fields]
    return rows.join(d, key, "left").select(*kept, *[F.coalesce(F.col(f), F.col(f"_{f}")).alias(f) if f in rows.columns else F.col(f"_{f}").alias(f) for f in fields])


def api_rows(pages: DataFrame, body: str, schema: str, rows: str, mapping: Mapping[str, Column]) -> DataFrame:
    """Rows of JSON API answers under an explicit schema, mapped to common fields."""
    return pages.select(F.from_json(body, schema).alias("b")).select(F.explode(F.col(f"b.{rows}")).alias("r")).select(*[c.alias(n) for n, c in mapping.items()])


EVENT_FIELDS = ("url", "title", "published_at", "fair_date", "start_time", "end_time", "school", "address")


def calendar_events(sources: Sequence[tuple[DataFrame, str, str, str, Mapping[str, Column]]]) -> DataFrame:
    """Calendars of several formats as one event table; fields a format lacks are null."""
    out = None
    for pages, body, schema, rows, mapping in sources:
        full = {f: mapping.get(f, F.lit(None)).cast("string") for f in EVENT_FIELDS}
        part = api_rows(pages, body, schema, rows, full)
        out = part if out is None else out.unionByName(part)
    return out


def write_snapshot(df: DataFrame, folder: str, key: str, digits: int = 2) -> DataFrame:
    """Rows partitioned by the key's prefix; returns the manifest (prefix, rows, checksum), written last.

    Readers that ask for one key add the prefix to the predicate and read one partition.
    """
    prefixed = df.withColumn("prefix", F.substring(F.sha2(F.col(key).cast("string"), 256), 1, digits))
    prefixed.write.mode("overwrite").partitionBy("prefix").parquet(f"{folder}/rows")
    manifest = prefixed.groupBy("prefix").agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("checksum"))
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return df.sparkSession.read.parquet(f"{folder}/manifest")


def verify_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Partitions whose rows or checksum differ from the manifest; empty when sound."""
    rows = spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows").withColumn("prefix", F.col("prefix").cast("string"))
    now = rows.groupBy("prefix").agg(F.count("*").alias("_rows"), F.sum(F.xxhash64(*[c for c in rows.columns if c != "prefix"]).cast("decimal(38,0)")).alias("_checksum"))
    return spark.read.parquet(f"{folder}/manifest").join(now, "prefix", "full_outer").where("NOT (rows <=> _rows) OR NOT (checksum <=> _checksum)")


def read_one(spark: SparkSession, folder: str, key: str, value: object, digits: int = 2) -> DataFrame:
    """Rows of one key; the prefix predicate prunes partitions."""
    prefix = F.substring(F.sha2(F.lit(value).cast("string"), 256), 1, digits)
    return spark.read.parquet(f"{folder}/rows").where((F.col("prefix").cast("string") == prefix) & (F.col(key) == F.lit(value)))


def raw_rows(merged: DataFrame, primary: str, duplicates: str) -> DataFrame:
    """H1: inverse of a merge: the primary's and the duplicates' own facts, one row per raw record."""
    return merged.select(F.explode(F.array_append(F.coalesce(duplicates, F.array().cast(merged.schema[duplicates].dataType)), F.col(primary))).alias("f")).select("f.*")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
