"""Arrow batches in short slices, so that Python objects exist for a few rows at a time, however many a batch has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows that are Python objects at once.
SLICE = 256


def slices(batch: pa.Array | pa.RecordBatch, rows: int = SLICE) -> Iterator:
    """A batch's rows, a few at a time, without copying them."""
    return (batch.slice(at, rows) for at in range(0, len(batch), rows))


def mapped(cells: pa.Array, f: Callable, kind: pa.DataType) -> pa.Array:
    """``f`` of every cell, as Arrow values of a type."""
    return pa.concat_arrays([pa.array([], kind), *(pa.array(list(map(f, part.to_pylist())), kind) for part in slices(cells))])
