"""Operator 13: Lloyd's k-means on integer vectors, round by round from what changed.

Vectors are written once, in blocks of ``BLOCK``, dealt by block. A round's assignments (owner and squared distance of each
vector) are a table of their own, dealt the same way, so a round moves 12 bytes a vector and the vectors stay where they are. Counts and sums of
the clusters are global integers, ``k * (dims + 1)`` of them. A round compares every vector with the
centroids that changed, and those whose owner changed with all; a vector that changes hands adds a signed
transfer to its old and its new cluster, added up in the block, the task and then by one small aggregate. Distances to an unchanged
owner are taken from the table. When no centroid changes, further rounds would repeat the assignments and are left out.

All numbers are integers: components are ``floor(scale * x)``, x as double, held at +-2**27 so that squared distances fit 64 bits.
Ties go to the smaller centroid. Rows whose vector is null, has another number of components, or any null or
non-finite one are left out. Null keys and repeated rows are vectors like others; equal seed hashes are ordered by vector. With
fewer vectors than ``k`` there are as many centroids; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

BLOCK, SCALE, HELD = 512, 1024, 2**27
DIMS, CENTROIDS, ROUNDS, SEED = 64, 8, 10, 3

Vector = list[int]


@dataclass
class Clustering:
    """What a run found. ``assigned`` has the key, ``cluster`` and ``distance`` of each vector; ``inertia`` is by cluster."""

    assigned: DataFrame
    centroids: list[Vector]
    counts: list[int]
    inertia: list[int]


def whole_vectors(vectors: DataFrame, key: str, embedding: str, dims: int) -> DataFrame:
    """``(key, x)`` of the rows with ``dims`` components, all finite."""
    x = F.col(embedding).cast("array<double>")
    return vectors.select(F.col(key), x.alias("x")).where(f"size(x) = {dims} AND forall(x, c -> c IS NOT NULL AND abs(c) < double('Infinity'))")


def integers(x, scale: int = SCALE):
    """NumPy doubles as held integers."""
    import numpy as np

    return np.clip(np.floor(np.asarray(x, np.float64) * scale), -HELD, HELD).astype(np.int64)


def first_centroids(kept: DataFrame, key: str, k: int, seed: int, scale: int = SCALE) -> list[Vector]:
    """The ``k`` vectors whose key has the smallest hash: ``k`` rows reach the driver."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = kept.select(F.sha2(named.cast("binary"), 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return [integers(r.x, scale).tolist() for r in sorted(rows, key=lambda r: (r.h, r.x))]


def in_blocks(kept: DataFrame, key: str, scale: int = SCALE) -> DataFrame:
    """``(block, keys, vectors)``: vectors as little-endian 32-bit integers, one row per ``BLOCK`` of them."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 33
        for whole in batches:
            for first in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(first, BLOCK)
                keys, x = batch.column(0), batch.column(1)
                held = integers(x.flatten().to_numpy(zero_copy_only=False), scale).astype("<i4").tobytes()
                one = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), one, pa.array([held], pa.binary())], names=["block", "keys", "vectors"])
                at += 1

    kind = kept.schema[key].dataType.simpleString()
    return kept.mapInArrow(run, f"block long, keys array<{kind}>, vectors binary")


def nearest(v, owners, distances, centroids, changed):
    """Owners and distances under ``centroids``, of which ``changed`` are new since ``distances``; null owners: of all.

    ``v`` holds the vectors as rows. All arrays are of 64-bit integers but ``changed``, of booleans.
    """
    import numpy as np

    again = np.ones(len(v), bool) if owners is None else changed[owners]
    who = np.full(len(v), len(centroids)) if owners is None else np.where(again, len(centroids), owners)
    best = np.full(len(v), np.iinfo(np.int64).max) if owners is None else np.where(again, np.iinfo(np.int64).max, distances)
    for c, centroid in enumerate(centroids):
        rows = np.arange(len(v)) if changed[c] or owners is None else np.flatnonzero(again)
        d = ((v[rows] - centroid) ** 2).sum(axis=1)
        won = (d < best[rows]) | (d == best[rows]) & (c < who[rows])
        best[rows[won]], who[rows[won]] = d[won], c
    return who, best


def transfers(v, before, after, k: int):
    """What each cluster gains, as counts and sums in one row of ``1 + dims`` signed integers a cluster."""
    import numpy as np

    gain = np.zeros((k, 1 + v.shape[1]), np.int64)
    counted = np.concatenate([np.ones((len(v), 1), np.int64), v], axis=1)
    moved = np.flatnonzero(after != before) if before is not None else np.arange(len(v))
    np.add.at(gain, after[moved], counted[moved])
    if before is not None:
        np.subtract.at(gain, before[moved], counted[moved])
    return gain


def dealt_by_block(blocks: DataFrame) -> DataFrame:
    """``blocks`` written in partitions by block, which joins on the block then take as they are.

    Adaptive execution forgets how a written plan was dealt, so it is off while this one is written.
    """
    conf = blocks.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return durable(blocks.repartition(int(conf.get("spark.sql.shuffle.partitions")), "block"))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def _assign(blocks: DataFrame, before: DataFrame | None, centroids: list[Vector], changed: list[bool]) -> DataFrame:
    """``(block, owners, distances, gain)`` from the vectors and the assignments before."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        new, is_new = np.array(centroids, np.int64), np.array(changed)
        for batch in batches:
            for i in range(batch.num_rows):
                block, held, *old = (batch.column(j)[i].as_py() for j in range(batch.num_columns))
                v = np.frombuffer(held, "<i4").reshape(-1, new.shape[1]).astype(np.int64)
                owners, distances = (np.frombuffer(old[0], "<i4").astype(np.int64), np.frombuffer(old[1], "<i8")) if old else (None, None)
                who, best = nearest(v, owners, distances, new, is_new)
                same = owners is not None and bool((who == owners).all())
                gain = None if same else transfers(v, owners, who, len(new)).astype("<i8").tobytes()
                row = [[block], [who.astype("<i4").tobytes()], [best.astype("<i8").tobytes()], [gain]]
                yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), *[pa.array(r, pa.binary()) for r in row[1:]]], names=["block", "owners", "distances", "gain"])

    rows = blocks.select("block", "vectors")
    if before is not None:
        rows = rows.join(before.select("block", "owners", "distances"), "block").select("block", "vectors", "owners", "distances")
    return rows.mapInArrow(run, "block long, owners binary, distances binary, gain binary")


def _added_up(rows: DataFrame, column: str, size: int) -> list[int]:
    """Entry by entry sum of the ``size`` 64-bit integers in each cell, per task and then over all; ``size`` rows reach the driver."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = np.zeros(size, np.int64)
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                total += np.frombuffer(cell, "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["at", "part"])

    parts = rows.where(F.col(column).isNotNull()).select(column).mapInArrow(run, "at int, part long")
    found = dict(parts.groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)"))).collect())
    return [int(found.get(i, 0)) for i in range(size)]


def _inertia(assigned: DataFrame, k: int) -> list[int]:
    """Distance summed over each cluster."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for owners, distances in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held, best = np.frombuffer(owners, "<i4"), np.frombuffer(distances, "<i8")
                for c in np.unique(held):
                    # As two halves: the sum of a block's distances may exceed 64 bits.
                    d = best[held == c]
                    whole = (int((d >> 32).sum()) << 32) + int((d & 0xFFFFFFFF).sum())
                    yield pa.RecordBatch.from_pydict({"at": pa.array([int(c)], pa.int32()), "part": pa.array([str(whole)])})

    parts = assigned.select("owners", "distances").mapInArrow(run, "at int, part string")
    found = dict(parts.groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)"))).collect())
    return [int(found.get(i, 0)) for i in range(k)]


def cluster(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE, key: str = "vec_id", embedding: str = "embedding"
) -> Clustering:
    """``rounds`` rounds from the vectors with the smallest hashes of ``seed:key``, then the final assignment."""
    kept = whole_vectors(vectors, key, embedding, dims)
    centroids = first_centroids(kept, key, k, seed, scale)
    kind = kept.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, cluster int, distance long"
    if not centroids:
        return Clustering(vectors.sparkSession.createDataFrame([], schema), [], [], [])
    k, width = len(centroids), dims + 1
    # Durable before they are dealt, as a block's rows follow the order of the input.
    blocks = dealt_by_block(durable(in_blocks(kept, key, scale)))
    sums, changed, now = [0] * (k * width), [True] * k, None
    for left in range(rounds, -1, -1):
        now = durable(_assign(blocks, now, centroids, changed))
        sums = [a + b for a, b in zip(sums, _added_up(now, "gain", k * width))]
        if not left:
            break
        held = [sums[c * width : (c + 1) * width] for c in range(k)]
        moved = [[s // h[0] for s in h[1:]] if h[0] else old for h, old in zip(held, centroids)]
        changed = [a != b for a, b in zip(moved, centroids)]
        centroids = moved
        if not any(changed):
            break

    def rows(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                keys, owners, distances = batch.column(0).slice(i, 1).flatten(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.frombuffer(owners, "<i4")), pa.array(np.frombuffer(distances, "<i8"))], names=[key, "cluster", "distance"])

    assigned = blocks.select("block", "keys").join(now.select("block", "owners", "distances"), "block").select("keys", "owners", "distances").mapInArrow(rows, schema)
    return Clustering(assigned, centroids, [sums[c * width] for c in range(k)], _inertia(now, k))
