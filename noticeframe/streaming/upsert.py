"""T1, T4, T9, T11, T14 on streams: per-key state in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

class Fingerprints(StatefulProcessor):
    """Value state of a key: fingerprint, when it was first seen and last changed, its revision, and the order of its last row."""

    STATE = "fingerprint string, first_seen long, updated long, revision int, at long, tie {tie}"

    def __init__(self, tie: str):
        self.schema = StructType.fromDDL(self.STATE.format(tie=tie))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = max(rows, key=lambda r: (r["_at"], r["_tie"]))
        at = (newest["_at"], newest["_tie"])
        held = tuple(self.held.get()) if self.held.exists() else None
        if held is not None and at <= held[4:]:
            return
        fingerprint, first_seen, updated, revision = held[:4] if held else (None, newest["_at"], None, 0)
        changed = held is None or newest["_fp"] != fingerprint
        updated, revision = (newest["_at"], revision + 1) if changed else (updated, revision)
        self.held.update((newest["_fp"], first_seen, updated, revision, *at))
        yield Row(_k=key[0], _fp=newest["_fp"], first_seen=first_seen, updated=updated, revision=revision, outcome="new" if held is None else "changed" if changed else "unchanged")

    def close(self) -> None:
        pass


def upsert_stream(stream: DataFrame, key: str, fingerprint: str, at: str, tie: str) -> DataFrame:
    """``operators.state.upsert`` on a stream: a row per key of each micro-batch, from per-key state.

    A batch reads and writes the state of its own keys only. Rows that are not after a key's last one, and rows
    without a fingerprint, give nothing.
    """
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, tie)}
    rows = stream.select(F.col(key).alias("_k"), F.col(fingerprint).cast("string").alias("_fp"), F.unix_micros(F.col(at).cast("timestamp")).alias("_at"), F.col(tie).alias("_tie")).where("_fp IS NOT NULL")
    out = f"_k {kinds[key]}, _fp string, first_seen long, updated long, revision int, outcome string"
    found = rows.groupBy("_k").transformWithState(Fingerprints(kinds[tie]), StructType.fromDDL(out), "Update", "None")
    time = lambda c: F.timestamp_micros(c)
    return found.select(F.col("_k").alias(key), F.col("_fp").alias(fingerprint), time("first_seen").alias("first_seen_at"), time("updated").alias("updated_at"), "revision", "outcome")


def listing_stream(checks: DataFrame, key: str, hours: int = 6) -> DataFrame:
    """T4 as per-key state: rows (key, ts, seen, complete) in; (key, status, misses) out per key and batch."""
    gap = hours * 3600

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        misses, since, status = state.get if state.exists else (0, None, "active")
        for rows in sorted((r for b in batches for r in b[["ts", "seen", "complete"]].itertuples(index=False)), key=lambda r: r.ts):
            at = rows.ts.timestamp()
            if rows.seen:
                misses, since, status = 0, None, "active"
            elif rows.complete:
                if since is None or at - since >= gap:
                    misses, since = misses + 1, at
                status = "withdrawn" if misses >= 2 else "unconfirmed"
        state.update((misses, since, status))
        yield pd.DataFrame({key: [k[0]], "status": [status], "misses": [misses]})

    kind = checks.schema[key].dataType.simpleString()
    return checks.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, status string, misses int", "misses int, since double, status string", "update", "NoTimeout")


def newest_in_watermark(events: DataFrame, key: list[str], at: str, late: str) -> DataFrame:
    """Repeats of a key within the watermark are dropped."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def file_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, some files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def rotating_group(day: Column, groups: int) -> Column:
    """Group whose turn it is on a day."""
    return F.dayofyear(day) % groups
