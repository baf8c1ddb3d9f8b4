"""Operator 3: SimHash fingerprints and multi-index hashing.

A fingerprint is 64 bits over the XXH64 values of a text's word shingles. Equal fingerprints are
first collapsed to one row, so a group of exact copies costs one row however large it is. The
distinct fingerprints are cut into ``segments`` equal segments. Two fingerprints within ``radius``
bits agree on at least one segment up to ``radius // segments`` bits, so each fingerprint probes the
table of segment values with the small Hamming ball around each of its own segments, and every match
is verified by its complete distance. No link is lost and no bucket is capped. Links are turned into
components by star contraction.

Null and empty texts have the fingerprint zero, which is linked like any other. Repeated rows are
copies. Rows with a null id keep their row; their component's smallest id ignores nulls.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, join_counted, whole_text
from .components import connected_components

SHINGLE_WORDS, RADIUS, SEGMENTS, SEED = 3, 3, 2, 42


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of one text."""
    import numpy as np
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not parts:
        return 0
    if len(parts) <= words:
        spans = [(0, None)]
    else:
        ends, at = [], -1
        for p in parts:
            at += len(p) + 1
            ends.append(at)
        spans = zip([0] + [e + 1 for e in ends[: len(ends) - words]], ends[words - 1 :])
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``(key, fp)``: the fingerprint as a signed long."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = [fingerprint(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), whole_text(text).alias(text)).mapInArrow(run, f"`{key}` {kind}, fp long")


def ball(bits: int, radius: int) -> list[int]:
    """All masks of ``bits`` bits with at most ``radius`` ones."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def links(distinct: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of distinct fingerprints (column ``fp``) within ``radius`` bits."""
    width = 64 // segments
    if width * segments != 64:
        raise ValueError("segments must divide 64")
    low = (1 << width) - 1
    value = lambda s: F.shiftrightunsigned("fp", s * width).bitwiseAND(F.lit(low))
    table = distinct.select(
        F.col("fp").alias("b"),
        F.posexplode(F.array(*[value(s) for s in range(segments)])).alias("segment", "value"),
    )
    around = F.lit(ball(width, radius // segments)).cast("array<bigint>")
    probe = distinct.select(
        F.col("fp").alias("a"),
        F.posexplode(F.array(*[value(s) for s in range(segments)])).alias("segment", "own"),
    ).select("a", "segment", F.explode(around).alias("mask"), "own").select("a", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
    return (
        probe.join(table, ["segment", "value"])
        .where("a < b")
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
        .select("a", "b")
        .distinct()
    )


def near_duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """``(key, fp, component_id)``: one row per input row; the component's smallest key."""
    rows = durable(fingerprints(docs, key, text, words))
    distinct = durable(rows.groupBy("fp").agg(F.min(key).alias("_rep"), F.count("*").alias("_n")))
    joined = connected_components(links(distinct.select("fp"), radius, segments))
    rooted = durable(distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", "_rep", "_n", F.coalesce("component", "fp").alias("_root")))
    named = rooted.groupBy("_root").agg(F.min("_rep").alias("component_id"), F.count("*").alias("_n"))
    ids = join_counted(rooted.select("fp", F.col("_n").alias("_rows"), "_root"), named, ["_root"], "_n")
    ids = ids.select("fp", "component_id", F.col("_rows").alias("_n"))
    return join_counted(rows.select(key, "fp"), ids, ["fp"], "_n").select(key, "fp", "component_id")
