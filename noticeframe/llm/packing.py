"""Operator 10: shortest-pack-first packing over the histogram of lengths.

Texts are tokenised and cut into full pieces and one remainder. The counts of remainders by length
form a histogram of at most ``limit`` rows, whatever the corpus. The packer works on counts, never on
documents: lengths are placed longest first, each time into the shortest pack so far if there is room
in it, otherwise into a new pack, which then is the shortest and takes further copies until it is full; what it returns is a list of
packing patterns with multiplicities, the packs that piece by piece placing gives. Pieces then meet their pattern by rank within their length: ranks come
from per-partition counts and prefix sums, so a length that a third of all rows share is not
gathered anywhere.

Null and empty texts have one token, the end mark. An empty table gives no rows. Repeated rows are
packed each. Other columns are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt_order, whole_text

LIMIT, END = 1024, 0
VOCABULARY = "byte_bpe_50k.json"
#: Entries of a worker's cache from a stretch between blanks to its ids, and the longest one kept.
CACHE, LONGEST = 300_000, 48
#: Fixed value: the pre-tokenising pattern of byte-level BPE files.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(rest)}


def cuts_at_blanks(path: str) -> bool:
    """Whether a tokeniser file is byte-level BPE with the usual cutting, no normalising, and ids in the order of its merges."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    model, cutting = said.get("model") or {}, said.get("pre_tokenizer") or {}
    odd = [said.get("normalizer"), *(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))]
    if model.get("type") != "BPE" or any(odd) or cutting.get("type") != "ByteLevel" or cutting.get("add_prefix_space") or not cutting.get("use_regex", True):
        return False
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    ids = [model["vocab"].get("".join(p), -1) for p in pairs]
    return all(a < b for a, b in zip(ids, ids[1:]))


class BlankCache:
    """Ids of whole texts, as little-endian 32-bit bytes, from cached ids of the stretches between blanks.

    The pre-tokeniser puts a blank at the head of the following token, so a text falls apart at
    every blank with ink on both sides, and each stretch's ids stand for themselves. They come from
    the file's own vocabulary, whose ids are its merge ranks, through the faster of two encoders. A
    text with any other blank next to white space, or with a special token's name, is encoded in
    one piece by the file's tokeniser; so are all texts when the file says anything else of its
    cutting, normalising or merging.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.by_stretch = cuts_at_blanks(path)
        if not self.by_stretch:
            return
        letters = byte_letters()
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in self.whole.get_vocab(with_added_tokens=False).items() if t not in self.special}
        self.ranked = tiktoken.Encoding("file", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    def _stretch(self, ink: str) -> bytes | None:
        if not ink or ink[0].isspace() or ink[-1].isspace():
            return None
        found = self.ranked(" " + ink)
        packed = struct.pack(f"<{len(found)}I", *found)
        if len(self.known) < CACHE and len(ink) <= LONGEST:
            self.known[ink] = packed
        return packed

    def ids(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        plain = self.by_stretch and not any(s in text for s in self.special) and not (rest and (not head or head[-1].isspace()))
        if plain:
            got = list(map(self.known.get, rest))
            if None in got:
                got = [self._stretch(x) if g is None else g for x, g in zip(rest, got)]
            if None not in got:
                first = self.ranked(head)
                return struct.pack(f"<{len(first)}I", *first) + b"".join(got)
        found = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)


def pieces(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``(key, start, length, ids_crc32, doc_tokens)``: every id of a text and its end mark, once."""

    def run(batches: Iterator) -> Iterator:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import pyarrow as pa

        cache = BlankCache(vocabulary)
        end = END.to_bytes(4, "little")
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                cols: tuple[list, ...] = ([], [], [], [], [])
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = cache.ids(t) + end
                    n = len(ids) // 4
                    for start in range(0, n, limit):
                        part = ids[4 * start : 4 * (start + limit)]
                        for col, v in zip(cols, (k, start, len(part) // 4, zlib.crc32(part), n)):
                            col.append(v)
                arrays = [pa.array(cols[0], type=whole.schema.field(0).type), *[pa.array(c, type=pa.int64()) for c in cols[1:]]]
                yield pa.RecordBatch.from_arrays(arrays, names=[key, "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), whole_text(text).alias(text)).mapInArrow(
        run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    )


def pack_histogram(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns ``(count, lengths)`` that place every length of the histogram as often as it counts."""
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # by room left
    done: list[tuple[int, tuple[int, ...]]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        top = limit - 1  # packs only fill up while a length is placed: no larger room comes back
        while left:
            top = next((r for r in range(top, length - 1, -1) if open_packs[r]), 0)
            if not top:
                per = limit // length
                new = [(left // per, (length,) * per), (1, (length,) * (left % per))]
                for count, lengths in new:
                    if count and lengths:
                        room = limit - length * len(lengths)
                        (open_packs[room] if room else done).append((count, lengths))
                break
            count, lengths = open_packs[top].pop()
            if count > left:
                open_packs[top].append((count - left, lengths))
                count = left
            left -= count
            (open_packs[top - length] if top > length else done).append((count, (*lengths, length)))
    return done + [p for packs in open_packs.values() for p in packs]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, rank_from, rank_to, first_sequence, offset, run)``: who of a length goes where; ``run`` ranks in a row share a sequence."""
    taken: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for length, copies in groupby(lengths):
            run = len(list(copies))
            out.append((length, taken[length], taken[length] + count * run, sequence, offset, run))
            taken[length] += count * run
            offset += length * run
        sequence += count
    return out


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """The pieces of ``docs`` with ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    dealt = dealt_order(pieces(docs, vocabulary, key, text, limit), [key, "start"])
    counts = dealt.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    # At most `limit` rows reach the driver.
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}
    plan = spark.createDataFrame(
        slots(pack_histogram(histogram, limit)), "length long, _from long, _to long, _seq long, _at long, _run long"
    )
    ordered = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = counts.select("_part", "length", (F.sum("_n").over(ordered) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("_part", "length").orderBy(F.col(key).asc_nulls_first(), "start", "_row")
    ranked = (
        dealt.withColumn("_local", F.row_number().over(inside) - 1)
        .join(before, ["_part", "length"])
        .withColumn("_rank", F.col("_before") + F.col("_local"))
    )
    # The plan has at most a few patterns per length: its size does not depend on the corpus.
    return ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).select(
        ranked[key], "start", ranked["length"], "ids_crc32", "doc_tokens",
        F.expr("_seq + (_rank - _from) div _run").alias("sequence_id"),
        (F.col("_at") + (F.col("_rank") - F.col("_from")) % F.col("_run") * ranked["length"]).alias("offset"),
    )
