"""Operator 12: byte-level BPE over distinct words, and decoding by the token-byte table.

Texts are cut into pre-tokens by the vocabulary's pattern. Within a chunk of about ``CHUNK`` bytes of text a
pre-token is named by its number in the chunk's list of distinct ones, so what is shuffled for encoding is one entry per chunk
and distinct word, not one per occurrence, and positions travel as numbers. Two scans cut the same chunks: the first sends
each chunk's distinct words to the bucket that their hash names, where a word of any number of chunks is encoded once and its ids go
back to the chunks that hold it; the second sends each chunk's documents, as numbers, to the same place, where
they are put together again by position. A word that all texts hold has one entry per chunk: no key is hot.

Decoding looks ids up in the token-byte table, whose size is the vocabulary's, batch by batch as an Arrow take.

Both scans must give the same rows in the same order, so an input that is no plain scan of files is written first; each chunk's list
of words has a checksum, and a difference stops the job. Null and empty texts have no tokens. Repeated rows and null keys are encoded each. An empty table gives no
rows. Very long texts end their chunk. Special tokens' names are ordinary text. Other columns are not read. Ids that the
vocabulary lacks, and null ids, decode to a null; a null list decodes to a null.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import repeatable, whole_text
from .packing import PRE_TOKEN

#: Characters of text after which a chunk ends; a longer text ends its chunk.
CHUNK = 16 << 20
#: Words of a bucket that a task remembers; beyond it the table starts anew, and words met again are encoded again.
KNOWN = 300_000
#: Stretches between blanks that a task remembers at once, about as many as a chunk has; beyond it they are cut anew.
STRETCHES = 400_000
#: Signs that end a stretch of letters as a pre-token of their own.
ENDINGS = (".", ",", ";", ":", "!", "?")
#: Up to here ``isalpha`` says what the pattern calls a letter, in any version of Unicode.
LATIN_END = "\u0250"
#: Pre-tokens after which a row of documents ends, so that putting ids in their places takes little memory at a time.
ROW = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: lines of base64 bytes, a blank and the id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def token_table(vocabulary: str) -> pa.LargeBinaryArray:
    """Token bytes by id; the last entry, a null, stands for ids that are not there."""
    ranks = read_ranks(vocabulary)
    table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 2)
    for token, i in ranks.items():
        table[i] = token
    return pa.array(table, pa.large_binary())


def side_by_side(cells: pa.LargeBinaryArray) -> memoryview:
    """The bytes of all cells, one after the other, as Arrow holds them."""
    if not len(cells):
        return memoryview(b"")
    ends = memoryview(cells.buffers()[1]).cast("q")
    return memoryview(cells.buffers()[2] or b"")[ends[cells.offset] : ends[cells.offset + len(cells)]]


def bytes_of(ids: pa.ListArray, tokens: pa.LargeBinaryArray) -> pa.BinaryArray:
    """The bytes that each list of ids stands for, a few lists at a time."""
    import numpy as np

    last, out = len(tokens) - 1, []
    for first in range(0, len(ids), 64):
        lists = ids.slice(first, 64)
        flat = lists.flatten().cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
        taken = tokens.take(pa.array(np.where((flat < 0) | (flat > last), last, flat)))
        found, at = [], 0
        for n in lists.value_lengths().to_pylist():
            part = taken.slice(at, n or 0)
            at += n or 0
            found.append(None if n is None or part.null_count else bytes(side_by_side(part)))
        out.append(pa.array(found, pa.binary()))
    return pa.concat_arrays([pa.array([], pa.binary()), *out])


def packed(numbers) -> bytes:
    """Numbers below 2**31, compressed with their four bytes apart: high bytes are mostly zero, and so nearly free."""
    import zlib

    import numpy as np

    return zlib.compress(np.asarray(numbers, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(cell: bytes):
    import zlib

    import numpy as np

    return np.frombuffer(zlib.decompress(cell), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


class Numbers(dict):
    """The number of each word, by first appearance."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def letters(ink: str) -> bool:
    """Whether a stretch is Latin letters alone."""
    return ink.isalpha() and (ink.isascii() or max(ink) < LATIN_END)


class Stretches(dict):
    """The pre-tokens' numbers of what stands between two blanks; none where white space touches a blank.

    The usual pattern puts a blank at the head of the following token, so a text falls apart at
    every blank with ink on both sides, and a stretch is cut once in a chunk.
    """

    def __init__(self, split, numbers: Numbers):
        self.split, self.numbers = split, numbers

    def __missing__(self, ink: str) -> tuple[int, ...] | None:
        if len(self) >= STRETCHES:
            self.clear()
        if letters(ink) or ink.isascii() and ink.isdigit():
            found = (self.numbers.setdefault(" " + ink, len(self.numbers)),)  # letters alone, or digits alone, are one pre-token with the blank before them
        elif ink[-1:] in ENDINGS and ink[:-1].isascii() and ink[:-1].isalpha():
            found = (self.numbers.setdefault(" " + ink[:-1], len(self.numbers)), self.numbers[ink[-1]])
        elif ink and not ink[0].isspace() and not ink[-1].isspace():
            found = tuple(map(self.numbers.__getitem__, self.split(" " + ink)))
        else:
            found = None
        self[ink] = found
        return found


class Chunk:
    """One chunk in the making: its words by number."""

    def __init__(self, split, by_stretch: bool):
        self.split, self.numbers, self.size = split, Numbers(), 0
        self.stretches = Stretches(split, self.numbers) if by_stretch else None

    def numbered(self, text: str, some=list) -> Iterator[int]:
        """The numbers of a text's pre-tokens; ``some`` says which of its stretches to look at."""
        from itertools import chain

        self.size += len(text) + 16
        if self.stretches is not None:
            head, *rest = text.split(" ")
            if not (rest and (not head or head[-1].isspace())):
                # Cut before the rest, as numbers follow the order of the text either way.
                first = list(map(self.numbers.__getitem__, self.split(head)))
                got = list(map(self.stretches.__getitem__, some(rest)))
                if None not in got:
                    return chain(first, chain.from_iterable(got))
        return map(self.numbers.__getitem__, self.split(text))

    def add(self, text: str):
        """The numbers of a text's pre-tokens, in their places."""
        import numpy as np

        return np.fromiter(self.numbered(text), np.uint32)

    def learn(self, text: str) -> tuple:
        """Number a text's pre-tokens as ``add`` does, but without their places: a stretch that comes again in the text is not looked at again."""
        from collections import deque

        deque(self.numbered(text, dict.fromkeys), maxlen=0)
        return ()

    def checksum(self) -> int:
        import zlib

        return zlib.crc32("\0".join(self.numbers).encode("utf-8", "surrogatepass"))


def chunks(batches: Iterator[pa.RecordBatch], pattern: str, chunk: int, take=Chunk.add) -> Iterator:
    """``(chunk id, keys, numbers, None)`` of texts in a row, and ``(chunk id, [], [], chunk)`` at the end of each chunk. ``take`` may be ``Chunk.learn``: no numbers."""
    import regex
    from pyspark import TaskContext

    split, at = regex.compile(pattern).findall, TaskContext.get().partitionId() << 33
    now = Chunk(split, pattern == PRE_TOKEN)
    for batch in batches:
        keys, numbers, held = [], [], 0
        for k, t in zip(batch.column(0), batch.column(1)):
            numbers.append(take(now, t.as_py()))
            keys.append(k.as_py())
            held += len(numbers[-1])
            full = now.size >= chunk
            if full or held >= ROW:
                yield at, keys, numbers, None
                keys, numbers, held = [], [], 0
            if full:
                yield at, [], [], now
                at, now = at + 1, Chunk(split, pattern == PRE_TOKEN)
        if keys:
            yield at, keys, numbers, None
    yield at, [], [], now


def word_lists(texts: DataFrame, pattern: str, buckets: int, chunk: int = CHUNK) -> DataFrame:
    """``(bucket, chunk, words, numbers, check)``: what each chunk has for each bucket. ``texts`` has a key and a text."""

    def run(batches: Iterator) -> Iterator:
        import zlib
        from collections import defaultdict

        for at, _, _, ended in chunks(batches, pattern, chunk, Chunk.learn):
            if ended is None or not ended.numbers:
                continue
            dealt: dict[int, list[str]] = defaultdict(list)
            for word in ended.numbers:
                dealt[zlib.crc32(word.encode()) % buckets].append(word)
            check = ended.checksum()
            for bucket, words in dealt.items():
                # Lengths beside the words: a word may hold any character.
                row = [[bucket], [at], [zlib.compress("".join(words).encode(), 1)], [packed(list(map(len, words)))], [packed([ended.numbers[w] for w in words])], [check]]
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], names=["bucket", "of", "words", "lengths", "numbers", "check"])

    return texts.mapInArrow(run, "bucket int, of long, words binary, lengths binary, numbers binary, check long")


def encoded_lists(lists: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``(of, numbers, counts, ids, check)``: the ids of each list's words. Lists of a bucket stand in one partition."""

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import tiktoken

        encode = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=read_ranks(vocabulary), special_tokens={}).encode_ordinary
        known: dict[str, list[int]] = {}
        for batch in batches:
            for of, words, lengths, numbers, check in zip(*(c.to_pylist() for c in batch.columns)):
                joined, ends = zlib.decompress(words).decode(), np.cumsum(unpacked(lengths)).tolist()
                found = []
                for start, end in zip([0, *ends], ends):
                    word = joined[start:end]
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= KNOWN:
                            known.clear()
                        ids = known[word] = encode(word)
                    found.append(ids)
                counts = packed(list(map(len, found)))
                row = [[of], [numbers], [counts], [packed([i for ids in found for i in ids])], [check]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()))], names=["of", "numbers", "counts", "ids", "check"])

    return lists.select("of", "words", "lengths", "numbers", "check").mapInArrow(run, "of long, numbers binary, counts binary, ids binary, check long")


def texts_by_number(texts: DataFrame, pattern: str, key: str, chunk: int = CHUNK) -> DataFrame:
    """``(chunk, keys, sizes, numbers, check)``: documents in a row with their pre-tokens' numbers; the last row of a chunk has its checksum."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        held = None

        def seen(given: Iterator) -> Iterator:
            nonlocal held
            for batch in given:
                held = batch.schema.field(0).type
                yield batch

        for at, keys, numbers, ended in chunks(seen(batches), pattern, chunk):
            if ended is not None and not ended.size:
                continue
            whole = np.concatenate(numbers) if numbers else np.zeros(0, np.uint32)
            row = [pa.array([at], pa.int64()), pa.array([keys], pa.list_(held)), pa.array([packed([len(n) for n in numbers])]), pa.array([packed(whole)]), pa.array([ended.checksum() if ended else None], pa.int64())]
            yield pa.RecordBatch.from_arrays(row, names=["chunk", "keys", "sizes", "numbers", "check"])

    return texts.mapInArrow(run, f"chunk long, keys array<{kind}>, sizes binary, numbers binary, check long")


def gathered(starts, counts, at):
    """Where the values of the cells ``at`` stand, cell after cell, when a cell's values begin at ``starts`` and are ``counts`` many."""
    import numpy as np

    many = counts[at]
    return np.repeat(starts[at] - np.cumsum(many) + many, many) + np.arange(many.sum())


def encode(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, decoded: str | None = None) -> DataFrame:
    """``(key, ids)`` of every text. ``vocabulary`` is a rank file, which each machine can read; ``pattern`` cuts pre-tokens.

    ``decoded`` names a further column, the bytes that the ids stand for, looked up where the ids are put together: ``decode``
    of the result gives the same, but takes a second Python worker beside each of these, and sends the ids back to it.
    """
    texts = repeatable(docs.select(F.col(key), whole_text(text).alias(text)))
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = word_lists(texts, pattern, buckets, chunk).repartition(buckets, "bucket")
    found, rows = encoded_lists(lists, vocabulary, pattern), texts_by_number(texts, pattern, key, chunk)

    def put_together(documents: pa.Table, entries: pa.Table) -> pa.Table:
        import numpy as np

        numbers = [unpacked(n) for n in entries.column("numbers").to_pylist()]
        parts = [unpacked(c) for c in entries.column("counts").to_pylist()]
        own = [c for c in documents.column("check").to_pylist() if c is not None]
        if any(c != own[0] for c in entries.column("check").to_pylist()):
            raise ValueError("the documents came in another order in the second scan; write them to a table first")
        counts = np.zeros(sum(map(len, numbers)), np.int32)
        for at, n in zip(numbers, parts):
            counts[at] = n
        starts = np.cumsum(counts) - counts
        ids = np.zeros(counts.sum(dtype=np.int64), np.int32)
        for at, cell in zip(numbers, entries.column("ids").to_pylist()):
            ids[gathered(starts, counts, at)] = unpacked(cell)
        tokens, out = None if decoded is None else token_table(vocabulary), []
        for keys, sizes, cell in zip(documents.column("keys").combine_chunks(), documents.column("sizes").to_pylist(), documents.column("numbers").to_pylist()):
            places = unpacked(cell)
            flat = ids[gathered(starts, counts, places)]
            ends = np.concatenate([[0], np.cumsum(counts[places])])[np.concatenate([[0], np.cumsum(unpacked(sizes))])]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            own_columns = {key: keys.values, "ids": lists}
            if tokens is not None:
                own_columns[decoded] = bytes_of(lists, tokens)
            out.append(pa.table(own_columns))
        return pa.concat_tables(out)

    kind = docs.schema[key].dataType.simpleString()
    return rows.groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(put_together, f"`{key}` {kind}, ids array<int>" + (f", `{decoded}` binary" if decoded else ""))


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that each list of ids stands for."""

    @F.arrow_udf("binary")
    def looked_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = token_table(vocabulary)
        for batch in batches:
            yield bytes_of(batch, tokens)

    return encoded.withColumn(name, looked_up(F.col(ids)))
