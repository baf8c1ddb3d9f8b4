"""T1-T3, T9 on streams: the last version of each key as state, so that a batch touches its own keys only.

The state is kept by ``transformWithState`` in the state store (RocksDB), whose checkpoints hold what a batch changed, and not in a
table that every batch writes anew. What the state gives is the pair of a row and the version before it; the detectors are then
the same expressions as in batch.

Rows of a key within a micro-batch are taken in order of time and tie. A row that is not after the key's last version is late,
or a repeat, and gives nothing. Null keys form one key.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.changes import COMPARED, TALK, VERSION, as_versions, with_change

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_VERSION = ", ".join(f"{c}: {t}" for c, t in VERSION.items())


def use_state_store(spark: SparkSession) -> None:
    """Per-key state of any size needs the store that keeps it on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def valid_day(text: str | None) -> str | None:
    import datetime as dt

    try:
        return dt.date.fromisoformat((text or "")[:10]).isoformat() if (text or "")[4:5] == "-" else None
    except ValueError:
        return None


def locked(before: str | None, first_seen: str, new: str | None) -> str | None:
    """The publication that stays when a version says ``new`` and the state holds ``before``."""
    held, day = valid_day(before), valid_day(new)
    if day is None:
        return new
    if held is None:
        return first_seen if day > first_seen else new
    if held > first_seen:
        return first_seen
    return before if day > held else new


class Versions(StatefulProcessor):
    """Value state of a key: its last version, when it was, when the key was first seen, its revision and publication."""

    def __init__(self, state: StructType):
        self.schema = state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.last.get() if self.last.exists() else None
        now = before = None if held is None else tuple(held)
        for row in sorted(rows, key=lambda r: (r["_at"], r["_tie"])):
            new, at = row["new"], (row["_at"], row["_tie"])  # times as microseconds
            if now is not None and at <= (now[1], now[2]):
                continue
            old, first_seen, revision, published, updated = (now[0], now[3], now[4], now[5], now[6]) if now else (None, row["_day"], 0, None, row["_at"])
            changed = old is None or any(old[c] != new[c] for c in COMPARED)
            if old is None or new["kind"] == TALK:
                published = new["published_at"]
            else:
                published = locked(published, first_seen, new["published_at"])
            revision, updated = revision + 1, row["_at"] if changed else updated
            yield Row(_k=key[0], _at=row["_at"], _tie=row["_tie"], new=new, old=old, first_seen=first_seen, revision=revision, published=published, changed=changed, updated=updated)
            now = (new, *at, first_seen, revision, published, updated)
        if now is not before:
            self.last.update(now)

    def close(self) -> None:
        pass


def version_stream(stream: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """``(key, at, tie, new, old, first_seen, revision, published, changed, updated)`` of every row that is not late."""
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, tie)}
    time = F.col(at).cast("timestamp")
    rows = as_versions(stream, [key, at, tie]).select(F.col(key).alias("_k"), F.unix_micros(time).alias("_at"), F.col(tie).alias("_tie"), F.date_format(time, "yyyy-MM-dd").alias("_day"), "new")
    version = f"struct<{_VERSION}>"
    state = StructType.fromDDL(f"version {version}, at long, tie {kinds[tie]}, first_seen string, revision int, published string, updated long")
    out = f"_k {kinds[key]}, _at long, _tie {kinds[tie]}, new {version}, old {version}, first_seen string, revision int, published string, changed boolean, updated long"
    found = rows.groupBy("_k").transformWithState(Versions(state), StructType.fromDDL(out), "Append", "None")
    return found.select(
        F.col("_k").alias(key), F.timestamp_micros("_at").alias(at), F.col("_tie").alias(tie), "new", "old", "first_seen", "revision", "published", "changed", F.timestamp_micros("updated").alias("updated")
    )


def change_stream(stream: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """T2, T3 on a stream: the change of each row that changes something."""
    return with_change(version_stream(stream, key, at, tie), at)
