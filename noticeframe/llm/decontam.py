"""Operator 5: benchmark items inside long documents, by size-partitioned MinHash containment.

Containment of an item in a document is the share of the item's distinct five-word shingles that the
document has. A long document's own MinHash says nothing about a short item, so items are partitioned
by size: for the items of up to ``s`` shingles a document is cut into pieces of ``2 s`` shingles, one
every ``s``, and any place of such an item lies inside one piece. Piece and item then have sizes of
the same order and their signatures meet: a candidate shares at least one of ``PERMUTATIONS`` minima.
Pieces of ``2 s`` are made from those of ``s``, so all partitions cost one pass. Every candidate is
verified by exact containment of its shingles, words compared. Items for which the expected miss rate
is over ``MISS`` (very few distinct shingles for their length) are candidates wherever one shingle
occurs, so nothing depends on luck there.

Items are a query set, taken in blocks of at most ``ITEM_BLOCK`` items and ``BLOCK_BYTES`` of text. A block's index is
built once and broadcast; its arrays stay under 100 MB. Documents are read once per block and never shuffled.
Words are runs of anything but ASCII white space, control characters and punctuation, in lower case; a text of
fewer than five words has one shingle, all its words. Null and empty texts, and items without a word,
match nothing. Repeated rows match each; equal item ids are kept apart by row. Extra columns are not
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .hashing import WordHashes, mixed, rolled

SHINGLE_WORDS, CONTAINED, PERMUTATIONS, MISS, LEAST = 5, 0.8, 64, 1e-4, 8
#: Bounds of a block of items: their number, and code points of text, of which the hashes take eight bytes a word.
ITEM_BLOCK, BLOCK_BYTES = 20_000, 16_000_000
MAP_BITS_AN_ITEM, SPREAD = 64, 0x9E3779B97F4A7C15
#: Bounds of what a task works on at once.
ROWS_AT_ONCE, SHINGLES_AT_ONCE = 512, 500_000
WORD = re.compile(rb"[^\x00-\x20!-/:-@\[-`{-~]+")


def words(text: str) -> list[bytes]:
    return WORD.findall(text.lower().encode("utf-8", "surrogatepass"))


def shingles(parts: list[bytes], size: int = SHINGLE_WORDS) -> set[bytes]:
    return {b" ".join(parts[i : i + size]) for i in range(max(1, len(parts) - size + 1))} if parts else set()


def _hashes(parts: list[bytes], known: WordHashes):
    """Hash per shingle place; texts under five words have one."""
    h = known.of(parts)
    return mixed(rolled(h, min(SHINGLE_WORDS, len(parts)))) if parts else h


class ItemIndex:
    """Signatures of one block of items by size partition, as sorted arrays; built once and sent to every worker."""

    def __init__(self, items: list[tuple[object, str | None]]):
        import numpy as np

        known = WordHashes()
        self.factors = (np.random.default_rng(7).integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.items, rare, minima = [], [], {}
        for key, text in items:
            parts = words(text or "")
            if not parts:
                continue
            h = _hashes(parts, known)
            i, size = len(self.items), LEAST
            while size < len(h):
                size *= 2
            distinct = np.unique(h)
            self.items.append((key, text, distinct))
            like = CONTAINED * len(distinct) / (2 * size + (1 - CONTAINED) * len(distinct))
            if (1 - like) ** PERMUTATIONS > MISS:
                rare += [(x, i) for x in distinct.tolist()]
            else:
                minima.setdefault(size, []).append((i, np.array([(h * f).min() for f in self.factors], dtype=np.uint64)))
        rare.sort()
        self.rare = np.array([x for x, _ in rare], dtype=np.uint64)
        self.rare_owner = np.array([i for _, i in rare], dtype=np.int32)
        # By size: the minima of each permutation in order, whose they are, and a bit map of them that rules most places out.
        self.values, self.owners, self.maps, self.bits = {}, {}, {}, {}
        for size, found in minima.items():
            table = np.stack([m for _, m in found], axis=1)
            order = np.argsort(table, axis=1, kind="stable")
            self.values[size] = np.take_along_axis(table, order, axis=1)
            self.owners[size] = np.array([i for i, _ in found], dtype=np.int32)[order]
            bits = self.bits[size] = max(16, (MAP_BITS_AN_ITEM * len(found) - 1).bit_length())
            at = (table * np.uint64(SPREAD)) >> np.uint64(64 - bits)
            m = self.maps[size] = np.zeros((PERMUTATIONS, 1 << (bits - 3)), dtype=np.uint8)
            for k in range(PERMUTATIONS):
                np.bitwise_or.at(m[k], (at[k] >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at[k] & np.uint64(7)).astype(np.uint8))

    def size_in_bytes(self) -> int:
        arrays = [self.rare, self.rare_owner, *self.values.values(), *self.owners.values(), *self.maps.values(), *(d for _, _, d in self.items)]
        return sum(a.nbytes for a in arrays) + sum(len(t or "") for _, t, _ in self.items)

    def shared(self, item: int, own: set[bytes]) -> tuple[int, int]:
        """How many shingles an item has, and how many of them are among ``own``; words compared."""
        wanted = shingles(words(self.items[item][1] or ""))
        return len(wanted), len(wanted & own)

    def candidates(self, hashes: list) -> list[set[int]]:
        """Candidate items of each document, given its shingle hashes in order; all documents at once.

        Blocks never cross documents. The blocks of a size are merged in pairs for the next size, and a
        piece is a block with its successor in the same document.
        """
        import numpy as np

        found: list[set[int]] = [set() for _ in hashes]
        sizes = np.array([len(h) for h in hashes], dtype=np.int64)
        h = np.concatenate(hashes)
        doc = np.repeat(np.arange(len(hashes)), sizes)
        if len(self.rare):
            hits = np.flatnonzero(np.isin(h, self.rare))
            for at, x, y in zip(hits.tolist(), np.searchsorted(self.rare, h[hits], "left").tolist(), np.searchsorted(self.rare, h[hits], "right").tolist()):
                found[doc[at]].update(self.rare_owner[x:y].tolist())
        if not self.maps:
            return found
        base, top = min(self.maps), max(self.maps)
        place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        first, levels, size = np.flatnonzero(place % base == 0), [], base
        owner = doc[first]
        while size <= top:
            last = np.append(owner[1:] != owner[:-1], True)
            number = np.arange(len(owner)) - np.searchsorted(owner, owner)
            pairs = np.flatnonzero(number % 2 == 0)
            levels.append((size, owner, last, pairs))
            owner, size = owner[pairs], 2 * size
        for k, f in enumerate(self.factors):
            block = np.minimum.reduceat(h * f, first)
            for size, own, last, pairs in levels:
                if size in self.maps:
                    piece = np.append(np.minimum(block[:-1], block[1:]), block[-1:])
                    piece[last] = block[last]
                    at = (piece * np.uint64(SPREAD)) >> np.uint64(64 - self.bits[size])
                    hits = np.flatnonzero((self.maps[size][k][(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1))
                    if len(hits):
                        values, owners = self.values[size][k], self.owners[size][k]
                        lo, hi = np.searchsorted(values, piece[hits], "left"), np.searchsorted(values, piece[hits], "right")
                        for at, x, y in zip(hits[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                            found[own[at]].update(owners[x:y].tolist())
                if size < top:
                    block = np.minimum.reduceat(block, pairs)
        return found


def _contained(index: ItemIndex, known: WordHashes, texts: list[str | None]) -> Iterator[tuple[int, object, int, int]]:
    """``(text number, item, item shingles, shared)`` for every item contained in a text."""
    import numpy as np

    split = [words(t or "") for t in texts]
    numbers = [i for i, parts in enumerate(split) if parts]
    first = 0
    while index.items and first < len(numbers):
        stop, held, hashes = first, 0, []
        while stop < len(numbers) and held < SHINGLES_AT_ONCE:
            hashes.append(_hashes(split[numbers[stop]], known))
            held += len(hashes[-1])
            stop += 1
        for i, h, candidates in zip(numbers[first:stop], hashes, index.candidates(hashes)):
            own = None
            for c in sorted(candidates):
                name, _, distinct = index.items[c]
                if np.isin(distinct, h).sum() < CONTAINED * len(distinct):
                    continue
                own = shingles(split[i]) if own is None else own
                wanted, shared = index.shared(c, own)
                if shared >= CONTAINED * wanted:
                    yield i, name, wanted, shared
        first = stop


def _blocks(items: DataFrame, item: str, item_text: str) -> Iterator:
    """Broadcast indexes of at most ``ITEM_BLOCK`` items and about ``BLOCK_BYTES`` of text; at least one, maybe empty."""
    sc, block, held, sent = items.sparkSession.sparkContext, [], 0, 0
    for row in items.select(item, item_text).toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1] or "")
        if len(block) == ITEM_BLOCK or held >= BLOCK_BYTES:
            yield sc.broadcast(ItemIndex(block))
            block, held, sent = [], 0, sent + 1
    if block or not sent:
        yield sc.broadcast(ItemIndex(block))


def contained_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(key, item, item_shingles, shared, containment)`` per document and item contained in it."""
    kind, ikind = docs.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item}` {ikind}, item_shingles long, shared long, containment double"

    def searched(sent) -> DataFrame:
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            index, known = sent.value, WordHashes()
            itype = {"int": pa.int32(), "string": pa.string()}.get(ikind, pa.int64())
            for batch in batches:
                rows = []
                for part in (batch.slice(i, ROWS_AT_ONCE) for i in range(0, batch.num_rows, ROWS_AT_ONCE)):
                    keys = part.column(0).to_pylist()
                    rows += [(keys[i], name, n, shared, shared / n) for i, name, n, shared in _contained(index, known, part.column(1).to_pylist())]
                kinds = [batch.schema.field(0).type, itype, pa.int64(), pa.int64(), pa.float64()]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, type=x) for c, x in zip(columns, kinds)], names=[key, item, "item_shingles", "shared", "containment"])

        return docs.select(F.col(key), whole_text(text).alias(text)).mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [searched(b) for b in _blocks(items, item, item_text)])


def without_items(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain none of the items; no row is shuffled."""
    at = docs.columns.index(text)
    for sent in _blocks(items, item, item_text):

        def run(batches: Iterator, sent=sent) -> Iterator:
            import pyarrow as pa

            index, known = sent.value, WordHashes()
            for batch in batches:
                for part in (batch.slice(i, ROWS_AT_ONCE) for i in range(0, batch.num_rows, ROWS_AT_ONCE)):
                    bad = {i for i, _, _, _ in _contained(index, known, part.column(at).to_pylist())}
                    yield part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
