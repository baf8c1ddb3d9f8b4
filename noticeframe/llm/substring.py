"""Operator 4: exact repeats of 20 or more words, found by fixed-block anchors.

Every document is cut into non-overlapping blocks of ``BLOCK`` words, the reference index. A window
of ``WINDOW`` words, wherever it lies, has a whole block of its own document inside it, because
``2 * BLOCK - 1 <= WINDOW``. So if the same window occurs twice, each occurrence has, at the same
place inside, words that are an indexed block somewhere. The steps:

1. Anchors: the hashes of all blocks and of every rolling stretch of ``BLOCK`` words are dealt into
   buckets by hash. A hash is an anchor when it is an indexed block and occurs at two places or more.
2. Extension: windows that cover an anchor are hashed whole, in 96 bits below their bucket, and dealt into buckets
   again; for each the earliest place (document, start) is found. Runs of windows that are not the
   earliest of their kind are the maximal exact repeats that go.
3. Each document's words covered by such a run are removed.

Documents travel in chunks of ``CHUNK`` bytes or more, growing with the text up to ``MOST_CHUNK``, so that the rows
between chunks and buckets stay full (64 entries or more, up to about 0.5 TB of text; beyond, rows get smaller). A chunk names each distinct hash once per bucket,
however often it occurs there, so a passage that a third of all documents share costs one entry per
chunk, not one per document; answers come back as bit masks over those entries. Bucket counts follow
the size of the text, so each bucket stays within a task's memory. Nothing is capped or sampled.

Every pass cuts the same chunks, so an input that is no plain scan of files is written first. Null and empty texts have no words and nothing is removed from them. Repeated rows: among
equal document ids the order of the input decides. Rows with a null id come first. Extra columns are
not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, repeatable, whole_text
from .hashing import BASE, OTHER_BASE, WordHashes, mixed, rolled

WINDOW, BLOCK = 20, 10
CHUNK, MOST_CHUNK, BUCKET_BYTES, LEAST_BUCKETS = 3_000_000, 32_000_000, 6_000_000, 48
#: A chunk is at least so many of the text's bytes: with it a chunk's row for a bucket has 64 entries or more.
CHUNK_SHARE = 64 * 6 / BUCKET_BYTES
PACKING_LEVEL = 5
NULL_ID = -(2**63)


def _chunks(batches: Iterator, limit: int) -> Iterator[tuple[str, list[int], list[bytes]]]:
    """``(chunk id, document ids, texts)``: named by partition and place, so the same in every pass."""
    from pyspark import TaskContext

    part, n, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(NULL_ID if i is None else i)
            texts.append(t.encode("utf-8", "surrogatepass"))
            held += len(texts[-1])
            if held >= limit:
                yield f"{part}:{n}", ids, texts
                n, ids, texts, held = n + 1, [], [], 0
    if ids:
        yield f"{part}:{n}", ids, texts


class Chunk:
    """Words of the documents of a chunk, as one array of hashes with document bounds."""

    def __init__(self, ids: list[int], texts: list[bytes], known: WordHashes):
        import numpy as np

        self.ids, self.words = ids, [t.split() for t in texts]
        self.lengths = np.array([len(w) for w in self.words], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])
        self.hashes = np.concatenate([known.of(w) for w in self.words]) if len(ids) else np.zeros(0, dtype=np.uint64)
        self.doc = np.repeat(np.arange(len(ids), dtype=np.int64), self.lengths)
        self.start = np.arange(len(self.hashes), dtype=np.int64) - self.first[self.doc]

    def places(self, size: int):
        """Word places from which ``size`` words of the same document follow."""
        import numpy as np

        return np.flatnonzero(self.start + size <= self.lengths[self.doc])

    def anchors(self):
        """Distinct stretch hashes, ascending, with flags: indexed block here; more than once here."""
        import numpy as np

        at = self.places(BLOCK)
        h = mixed(rolled(self.hashes, BLOCK))[at] if len(at) else np.zeros(0, dtype=np.uint64)
        distinct, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        indexed = np.zeros(len(distinct), dtype=bool)
        indexed[inverse[self.start[at] % BLOCK == 0]] = True
        return at, inverse, distinct, indexed, counts > 1

    def windows(self, anchored):
        """Places of the windows that cover an anchor, and their hash pairs."""
        import numpy as np

        at = self.places(WINDOW)
        if not len(at):
            return at, np.zeros((0, 2), dtype=np.uint64)
        hits = np.concatenate([[0], np.cumsum(anchored)])
        at = at[hits[at + WINDOW - BLOCK + 1] > hits[at]]
        pair = [mixed(rolled(self.hashes, WINDOW, b))[at] for b in (BASE, OTHER_BASE)]
        return at, np.stack(pair, axis=1)


def _bucket(h, buckets: int):
    """Bucket by the upper 32 bits of a mixed hash."""
    import numpy as np

    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _groups(bucket, buckets: int):
    """Places by bucket, in their order."""
    import numpy as np

    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        yield b, order[bounds[b] : bounds[b + 1]]


def _row(arrow, names: list[str], rows: list[tuple]):
    kinds = {"chunk": arrow.string(), "bucket": arrow.int32(), "kind": arrow.int32(), "data": arrow.binary()}
    return arrow.RecordBatch.from_arrays([arrow.array(list(c), type=kinds[n]) for n, c in zip(names, zip(*rows))], names=names)


ENTRIES, ANSWERS = ["chunk", "bucket", "data"], ["chunk", "kind", "bucket", "data"]
ENTRY_SCHEMA, ANSWER_SCHEMA = "chunk string, bucket int, data binary", "chunk string, kind int, bucket int, data binary"


def _anchor_entries(buckets: int, limit: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        known = WordHashes()
        for name, ids, texts in _chunks(batches, limit):
            _, _, distinct, indexed, twice = Chunk(ids, texts, known).anchors()
            # 38 bits of the hash below its bucket, and two flags: five bytes an entry
            low = (distinct & np.uint64(0xFFFFFFFF)).astype("<u4")
            top = (((distinct >> np.uint64(32)) & np.uint64(0x3F)) << np.uint64(2)).astype(np.uint8) | (indexed.astype(np.uint8) << 1) | twice.astype(np.uint8)
            rows = [(name, b, low[at].tobytes() + top[at].tobytes()) for b, at in _groups(_bucket(distinct, buckets), buckets)]
            if rows:
                yield _row(pa, ENTRIES, rows)

    return run


def _anchor_answers(table):
    """Per chunk of a bucket: a bit per entry, set for anchors."""
    import numpy as np
    import pyarrow as pa

    chunks, data = table.column("chunk").to_pylist(), table.column("data").to_pylist()
    sizes = [len(d) // 5 for d in data]
    low = np.concatenate([np.frombuffer(d, "<u4", n) for d, n in zip(data, sizes)])
    top = np.concatenate([np.frombuffer(d, np.uint8, n, 4 * n) for d, n in zip(data, sizes)])
    h = (low.astype(np.uint64) << np.uint64(6)) | (top >> 2).astype(np.uint64)
    order = np.argsort(h)
    fresh = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    group = np.cumsum(fresh) - 1
    indexed = np.logical_or.reduceat((top[order] & 2) > 0, np.flatnonzero(fresh))
    often = np.add.reduceat(1 + (top[order] & 1).astype(np.int64), np.flatnonzero(fresh)) > 1
    mask = np.zeros(len(h), dtype=bool)
    mask[order] = (indexed & often)[group]
    b = table.column("bucket")[0].as_py()
    ends = np.cumsum([0, *sizes])
    found = [(c, 0, b, np.packbits(mask[x:y]).tobytes()) for c, x, y in zip(chunks, ends, ends[1:]) if mask[x:y].any()]
    return _row(pa, ANSWERS, found).to_pandas() if found else None


def _masked(chunk_groups: Iterator, answers: dict[int, bytes], size: int):
    """The answers' bits put back at the entries that were sent."""
    import numpy as np

    out = np.zeros(size, dtype=bool)
    for b, at in chunk_groups:
        if b in answers:
            out[at] = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=len(at)).astype(bool)
    return out


def _with_answers(docs: DataFrame, answers: DataFrame, limit: int) -> DataFrame:
    """Chunks (compressed documents) next to all their answers."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = pa.Codec("zstd", compression_level=PACKING_LEVEL)
        for name, ids, texts in _chunks(batches, limit):
            body = b"".join(texts)
            head = struct.pack("<q", len(ids)) + b"".join(struct.pack("<qq", i, len(t)) for i, t in zip(ids, texts))
            packed = codec.compress(head + body, asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([struct.pack("<q", len(head) + len(body)) + packed], pa.binary())], names=["chunk", "docs"])

    chunks = docs.mapInArrow(run, "chunk string, docs binary")
    grouped = answers.groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "data")).alias("answers"))
    return chunks.join(grouped, "chunk", "left")


def _opened(batches: Iterator) -> Iterator[tuple[str, Chunk, list[dict[int, bytes]]]]:
    import pyarrow as pa

    known = WordHashes()
    for batch in batches:
        for row in range(batch.num_rows):
            packed = batch.column("docs")[row].as_py()
            plain = pa.decompress(packed[8:], struct.unpack("<q", packed[:8])[0], codec="zstd", asbytes=True)
            n = struct.unpack_from("<q", plain)[0]
            ids, texts, at = [], [], 8 + 16 * n
            for i in range(n):
                key, size = struct.unpack_from("<qq", plain, 8 + 16 * i)
                ids.append(key)
                texts.append(plain[at : at + size])
                at += size
            found: list[dict[int, bytes]] = [{}, {}]
            for a in batch.column("answers")[row].as_py() or []:
                found[a["kind"]][a["bucket"]] = a["data"]
            yield batch.column("chunk")[row].as_py(), Chunk(ids, texts, known), found


def _anchored_windows(chunk: Chunk, answers: dict[int, bytes], buckets: int):
    """Distinct anchored windows of a chunk, each at its earliest place here.

    Places of all anchored windows, the entry each belongs to, and per entry: hash pair, earliest place.
    """
    import numpy as np

    at, inverse, distinct, _, _ = chunk.anchors()
    anchored = np.zeros(len(chunk.hashes), dtype=bool)
    if answers and len(at):
        mask = _masked(_groups(_bucket(distinct, buckets), buckets), answers, len(distinct))
        anchored[at] = mask[inverse]
    places, pair = chunk.windows(anchored)
    ids = np.array(chunk.ids, dtype=np.int64)
    rank = np.empty(len(ids), dtype=np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))  # equal ids: input order
    order = np.lexsort((chunk.start[places], rank[chunk.doc[places]]))
    places, pair = places[order], pair[order]
    _, first, entry = np.unique(pair.view([("a", "u8"), ("b", "u8")]).ravel(), return_index=True, return_inverse=True)
    by_place = np.argsort(first, kind="stable")  # entries in the order of their places, which compresses well
    new = np.empty(len(first), dtype=np.int64)
    new[by_place] = np.arange(len(first))
    return places, new[entry], pair[first[by_place]], places[first[by_place]], rank


def _window_entries(buckets: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for name, chunk, (anchors, _) in _opened(batches):
            _, _, pair, at, rank = _anchored_windows(chunk, anchors, buckets)
            ids = np.array(chunk.ids, dtype=np.int64)
            rows = []
            for b, e in _groups(_bucket(pair[:, 0], buckets), buckets):
                doc = chunk.doc[at[e]]
                where = ids[doc].tobytes() + rank[doc].astype("<i4").tobytes() + chunk.start[at[e]].astype("<i4").tobytes()
                hashes = pair[e, 0].tobytes() + (pair[e, 1] >> np.uint64(32)).astype("<u4").tobytes()
                rows.append((name, b, struct.pack("<i", len(e)) + hashes + pa.compress(where, codec="zstd", asbytes=True)))
            if rows:
                yield _row(pa, ENTRIES, rows)

    return run


def _window_answers(table):
    """Per chunk of a bucket: a bit per entry, set when its window starts earlier elsewhere."""
    import numpy as np
    import pyarrow as pa

    names, data = table.column("chunk").to_pylist(), table.column("data").to_pylist()
    sizes = [struct.unpack_from("<i", d)[0] for d in data]
    where = [pa.decompress(d[4 + 12 * n :], 16 * n, codec="zstd", asbytes=True) for d, n in zip(data, sizes)]
    read = lambda parts, kind, at, head=0: np.concatenate([np.frombuffer(d, kind, n, head + at * n) for d, n in zip(parts, sizes)])
    a, b = read(data, "<u8", 0, 4), read(data, "<u4", 8, 4)
    doc, rank, start = read(where, "<i8", 0), read(where, "<i4", 8), read(where, "<i4", 12)
    place = {c: i for i, c in enumerate(sorted(set(names), key=lambda c: tuple(map(int, c.split(":")))))}
    chunk = np.repeat([place[c] for c in names], sizes)
    order = np.lexsort((start, rank, chunk, doc, b, a))
    fresh = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
    mask = np.ones(len(a), dtype=bool)
    mask[order[fresh]] = False
    bucket = table.column("bucket")[0].as_py()
    ends = np.cumsum([0, *sizes])
    found = [(c, 1, bucket, np.packbits(mask[x:y]).tobytes()) for c, x, y in zip(names, ends, ends[1:]) if mask[x:y].any()]
    return _row(pa, ANSWERS, found).to_pandas() if found else None


def _grouped(entries: DataFrame, answer) -> DataFrame:
    def run(table):
        import pyarrow as pa

        found = answer(table)
        if found is None:
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.string(), pa.int32(), pa.int32(), pa.binary())], names=ANSWERS)
        return pa.Table.from_pandas(found, preserve_index=False).cast(pa.schema([("chunk", pa.string()), ("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())]))

    return entries.groupBy("bucket").applyInArrow(run, ANSWER_SCHEMA)


def _removed(buckets: int, key: str):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for _, chunk, (anchors, later) in _opened(batches):
            places, entry, pair, at, _ = _anchored_windows(chunk, anchors, buckets)
            gone = np.zeros(len(chunk.hashes) + 1, dtype=np.int64)
            if len(places):
                late = _masked(_groups(_bucket(pair[:, 0], buckets), buckets), later, len(pair))
                bad = places[late[entry] | (places != at[entry])]
                np.add.at(gone, bad, 1)
                np.add.at(gone, bad + WINDOW, -1)
            dropped = np.cumsum(gone)[:-1] > 0
            n_removed = np.add.reduceat(np.concatenate([dropped, [False]]).astype(np.int64), chunk.first[:-1])
            n_removed[chunk.lengths == 0] = 0
            kept = []
            for words, first, n in zip(chunk.words, chunk.first.tolist(), n_removed.tolist()):
                kept.append(b" ".join(words if not n else [w for w, d in zip(words, dropped[first : first + len(words)].tolist()) if not d]))
            ids = pa.array([None if i == NULL_ID else i for i in chunk.ids], pa.int64())
            digests = pa.array([hashlib.sha256(k).hexdigest() for k in kept])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(chunk.lengths), pa.array(n_removed), digests, pa.array(kept, pa.binary())], names=[key, "n_words", "n_removed", "kept_sha256", "kept"]
            )

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_words, n_removed, kept_sha256, kept)``: kept words joined by one space, as bytes."""
    plain = repeatable(docs.select(F.col(key).cast("long").alias(key), whole_text(text).alias(text)))
    size = plain.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, size // BUCKET_BYTES)
    limit = int(min(MOST_CHUNK, max(CHUNK, CHUNK_SHARE * size)))
    anchors = durable(_grouped(plain.mapInArrow(_anchor_entries(buckets, limit), ENTRY_SCHEMA), _anchor_answers))
    windows = _with_answers(plain, anchors, limit).mapInArrow(_window_entries(buckets), ENTRY_SCHEMA)
    later = durable(_grouped(windows, _window_answers))
    return _with_answers(plain, anchors.unionByName(later), limit).mapInArrow(
        _removed(buckets, key), f"`{key}` long, n_words long, n_removed long, kept_sha256 string, kept binary"
    )
