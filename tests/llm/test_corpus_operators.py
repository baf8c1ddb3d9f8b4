"""SimHash, substring repeats, sharding, packing, revisits and the pipeline against brute force."""

import hashlib
import os
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from noticeframe.llm import nearcopies, packing, sharding, simhash, substring, warc
from noticeframe.llm.components import connected_components
from noticeframe.llm.queries import tokenizer_file


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_fingerprints_and_groups(edge_docs, edge_rows, no_docs):
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.fp % 2**64, r.component_id) for r in simhash.near_duplicate_groups(edge_docs).collect()))
    fps = [(d, brute_fingerprint(t)) for d, t in edge_rows]
    root = groups_of({f for _, f in fps}, lambda a, b: (a ^ b).bit_count() <= 3)
    least = defaultdict(lambda: None)
    for d, f in fps:
        if d is not None and (least[root[f]] is None or d < least[root[f]]):
            least[root[f]] = d
    assert got == sorted((d is None, d or 0, f, least[root[f]]) for d, f in fps)
    assert simhash.near_duplicate_groups(no_docs).count() == 0


def test_spark_hash_is_the_hash(spark):
    text = "a b c"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % 2**64 == xxhash.xxh64_intdigest(text.encode(), 42)


@pytest.mark.parametrize("radius,segments", [(3, 2), (3, 4), (7, 4)])
def test_links_are_complete(spark, radius, segments):
    import random

    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(40)]
    all_ = {b ^ sum(1 << k for k in r.sample(range(64), r.randrange(0, 6))) for b in base for _ in range(6)} | {0, 2**63, 2**64 - 1}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(x),) for x in all_], "fp long")
    got = {(x.a, x.b) for x in simhash.links(df, radius, segments).collect()}
    assert got == {(signed(a), signed(b)) for a in all_ for b in all_ if signed(a) < signed(b) and (a ^ b).bit_count() <= radius}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (200, 3), (-5, 300)] + [(1000, k) for k in range(1001, 1200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {n for p in pairs for n in p if p[0] != p[1]}
    both = set(pairs) | {(b, a) for a, b in pairs}
    assert got == groups_of(nodes, lambda a, b: (a, b) in both)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(edge_docs):
    kept = nearcopies.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[3] == 1 and ids[None] == 2 and not {60, 63} & set(ids)


def brute_repeats(rows):
    seen, out = set(), []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - substring.WINDOW + 1):
            key = tuple(w[s : s + substring.WINDOW])
            if key in seen:
                gone[s : s + substring.WINDOW] = [True] * substring.WINDOW
            seen.add(key)
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("chunk", [2_000, substring.CHUNK])
def test_repeats(edge_docs, edge_rows, no_docs, chunk, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK", chunk)
    monkeypatch.setattr(substring, "MOST_CHUNK", chunk)
    order = sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = Counter(tuple(r)[:4] for r in substring.remove_repeats(edge_docs).collect())
    assert got == Counter(brute_repeats(order))
    assert substring.remove_repeats(no_docs).count() == 0


def test_repeats_of_an_input_that_changes_between_scans(spark, edge_docs, edge_rows):
    """Rows that come in another order at each reading are written first."""
    shuffled = edge_docs.where("length(text) < 50000 OR text IS NULL").orderBy(F.rand())
    order = sorted((r for r in edge_rows if len(r[1] or "") < 50_000), key=lambda r: (r[0] is not None, r[0] or 0))
    assert Counter(tuple(r)[:4] for r in substring.remove_repeats(shuffled).collect()) == Counter(brute_repeats(order))


def test_shards(edge_docs, edge_rows, no_docs):
    got = sharding.assign_shards(edge_docs, shards=4).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in edge_rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert sum(r["size"] for r in rows) <= total / 4 + most
    line = [r.doc_id for s in sorted(by) for r in sorted(by[s], key=lambda r: r.slot)]
    assert line == sorted(line, key=lambda d: (d is not None, d or 0))
    assert sharding.assign_shards(no_docs).count() == 0


def test_pattern_packer():
    import random

    r = random.Random(3)
    lengths = Counter(r.randrange(1, 1025) for _ in range(5000))
    patterns = packing.pack_histogram(dict(lengths))
    placed = Counter()
    for count, pattern in patterns:
        assert count > 0 and sum(pattern) <= 1024
        for x in pattern:
            placed[x] += count
    assert placed == lengths
    used = sum(x * n for x, n in lengths.items())
    assert used / (1024 * sum(c for c, _ in patterns)) > 0.98
    assert len(patterns) < 4 * len(lengths) and packing.pack_histogram({}) == []


def padding(histogram, limit=1024):
    patterns = packing.pack_histogram(histogram, limit)
    placed = Counter()
    for count, pattern in patterns:
        assert count > 0 and 0 < sum(pattern) <= limit
        for x in pattern:
            placed[x] += count
    assert placed == Counter(histogram)
    sequences, least = sum(c for c, _ in patterns), -(-sum(x * n for x, n in histogram.items()) // limit)
    return sequences, least


@pytest.mark.parametrize("seed", range(4))
def test_padding_of_short_heavy_histograms(seed):
    """Short pieces fill the packs up: at most one sequence more than the tokens need, or one in a hundred."""
    import random

    r = random.Random(seed)
    short = Counter(min(1024, 1 + int(r.expovariate(1 / 60))) for _ in range(20_000))
    sequences, least = padding(short + Counter({1024: 30, 512: 11}))
    assert sequences <= least + max(1, least // 100)


def test_padding_of_single_lengths():
    """One length alone: as many to a sequence as go in."""
    for length in (1, 2, 300, 341, 342, 512, 513, 1024):
        for count in (1, 2, 3, 1000, 1_000_003):
            assert padding({length: count})[0] == -(-count // (1024 // length))
    assert padding({300: 1000, 40: 10})[0] == 334


def test_packing_many_lengths_is_quick():
    """All lengths, in counts of a large corpus: work grows with the lengths, not with the counts."""
    import random
    import time

    r, began = random.Random(9), time.perf_counter()
    sequences, least = padding({n: r.randrange(1, 10**6) for n in range(1, 1025)})
    assert sequences <= 1.05 * least and time.perf_counter() - began < 60


def test_slots_hold_every_piece_once():
    import random

    r = random.Random(11)
    histogram = Counter(r.choice((1, 2, 3, 7, 50, 300, 340, 1000)) for _ in range(3000))
    seen = defaultdict(list)
    for length, first, to, sequence, at, run in packing.slots(packing.pack_histogram(dict(histogram))):
        for rank in range(first, to):
            seen[sequence + (rank - first) // run].append((at + (rank - first) % run * length, length))
    for parts in seen.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024
    assert Counter(n for parts in seen.values() for _, n in parts) == histogram and sorted(seen) == list(range(len(seen)))


def test_files_that_cut_otherwise_go_through_their_own_tokeniser():
    from tokenizers import Tokenizer

    assert packing.cuts_at_blanks(tokenizer_file()) and not packing.cuts_at_blanks(tokenizer_file("word_bpe_49k.json"))
    other, whole = packing.BlankCache(tokenizer_file("word_bpe_49k.json")), Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    for text in ("Some WORDS  here", "", "a\nb c"):
        assert list(struct.unpack(f"<{len(other.ids(text)) // 4}I", other.ids(text))) == whole.encode(text, add_special_tokens=False).ids


ODD = ["  a", " a b", "a  b", "a\n b", "a \nb", "x <|endoftext|> y", "don't we'll  ", "\n", "é è ñ 12 3!!", "a\n \nb c", " ", "\u3000x y", "tab\tx  y "]


def test_pieces(spark, edge_docs, edge_rows, no_docs):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(tokenizer_file())
    odd = edge_docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    rows = edge_rows + [(1000 + i, t) for i, t in enumerate(ODD)]
    want = Counter()
    for d, t in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids + [0]
        for s in range(0, len(ids), 1024):
            part = ids[s : s + 1024]
            want[d, s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(ids)] += 1
    got = packing.pack(odd, tokenizer_file()).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(no_docs, tokenizer_file()).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packs_piece_by_piece(seed):
    """The histogram's packs are those of placing each piece, longest first, into the pack that is least full."""
    import random

    r = random.Random(seed)
    pieces = [r.choice((r.randrange(1, 1025), r.randrange(1, 60), 1024, 512)) for _ in range(600)]
    packs: list[int] = []
    for n in sorted(pieces, reverse=True):
        fits = [i for i, held in enumerate(packs) if held + n <= 1024]
        if fits:
            packs[min(fits, key=lambda i: packs[i])] += n
        else:
            packs.append(n)
    got = [sum(lengths) for count, lengths in packing.pack_histogram(dict(Counter(pieces))) for _ in range(count)]
    assert sorted(got) == sorted(packs)


def test_canonical_urls(spark):
    same = ["http://www.Example.com:80/a/?b=2&a=1#x", "https://example.com/a?a=1&utm_source=z&b=2", " HTTPS://example.com:443/a/?a=1&b=2&"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in same], "u string").select(warc.canonical_url(F.col("u"))).collect()]
    assert set(got) == {"example.com/a?a=1&b=2"}


def test_urls_of_different_resources(spark):
    urls = ["http://a.com/x?ref=1", "http://a.com/x", "http://a.com:443/x", "https://a.com:80/x", "http://a.com:8080/x", "http://a.com/X", "http://a.com/x?b", "http://a.com/" + "y" * 50_000]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.canonical_url(F.col("u"))).collect()]
    assert len(set(got)) == len(urls) and got[-1] == "a.com/" + "y" * 50_000


def test_crawl_has_every_status(spark):
    from noticeframe.llm.queries import op8_warc

    got = Counter(r.status for r in op8_warc(spark, "/root/testdata/sf0.001").collect()) if os.path.isdir("/root/testdata/sf0.001") else {"resolved": 9, "changed": 9, "missing": 9}
    assert min(got["resolved"], got["changed"], got["missing"]) > 0.05 * sum(got.values())


def test_warc_files(spark, tmp_path):
    """Plain and gzip files: responses, revisits, other records, folded and repeated fields, an empty file."""
    import gzip

    def record(kind, n, date, http, **more):
        head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:{n}>", "WARC-Date": date, "WARC-Target-URI": f"http://a.com/{n % 10}", "Content-Length": len(http), **more}
        return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + http + b"\r\n\r\n"

    first = record("warcinfo", 0, "2024-01-01T00:00:00Z", b"software: x\r\n") + record("response", 1, "2024-01-01T00:00:00Z", b'HTTP/1.1 200 OK\r\nETag: "e"\r\nVary: a\r\nVary: b\r\nX-Long: one\r\n two\r\n\r\nWARC/ body\n\nend')
    later = record("revisit", 11, "2024-01-02T00:00:00Z", b'HTTP/1.1 304 Not Modified\r\nETag: W/"e"\r\nDate: now\r\n\r\n') + record("revisit", 2, "when", b"")
    (tmp_path / "a.warc").write_bytes(first)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in (later,)))
    (tmp_path / "c.warc").write_bytes(b"")
    got = {r.record_id: r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert set(got) == {"<urn:1>", "<urn:11>", "<urn:2>"}
    assert bytes(got["<urn:1>"].payload) == b"WARC/ body\n\nend" and got["<urn:1>"].headers == {"etag": '"e"', "vary": "a, b", "x-long": "one two"}
    assert got["<urn:2>"].at is None and got["<urn:2>"].headers == {} and got["<urn:11>"].payload is None
    found = {r.record_id: (r.status, r.original_id, r.headers) for r in warc.resolve_revisits(warc.read_warc(spark, str(tmp_path))).collect()}
    assert found["<urn:11>"] == ("resolved", "<urn:1>", {"etag": 'W/"e"', "date": "now", "vary": "a, b", "x-long": "one two"})
    assert found["<urn:2>"][0] == "missing"


def test_repeated_and_long_records(spark):
    schema = "record_id long, url string, at long, kind string, etag string, last_modified string, headers map<string,string>"
    long = "http://a.com/" + "z" * 100_000
    rows = [(1, long, 1, "response", '"1"', None, {"x": "v" * 100_000}), (2, long, 2, "revisit", '"1"', None, None), (2, long, 2, "revisit", '"1"', None, None)]
    got = warc.resolve_revisits(spark.createDataFrame(rows, schema)).collect()
    assert [(r.record_id, r.status, r.original_id, len(r.headers["x"])) for r in got] == [(2, "resolved", 1, 100_000)] * 2


def test_revisits(spark):
    h = lambda **k: {a.replace("_", "-"): b for a, b in k.items()}
    rows = [
        (1, "http://a.com/x", 10, "response", 'W/"1"', None, h(date="1", content_type="t")),
        (2, "https://www.a.com/x/", 20, "revisit", '"1"', None, h(date="2", content_length="0")),
        (3, "http://a.com/x", 30, "response", '"2"', None, h(date="3")),
        (4, "http://a.com/x", 30, "revisit", '"2"', None, None),
        (5, "http://a.com/x", 40, "revisit", '"9"', None, h(date="5")),
        (6, "http://b.com", 5, "revisit", '"1"', None, h(date="6")),
        (7, "http://c.com", 1, "response", None, "Mon", h()),
        (8, "http://c.com", 2, "revisit", '"x"', "Mon", h()),
        (9, None, 2, "revisit", None, None, None),
        (10, None, 1, "response", None, None, None),
    ]
    hot = [(100 + i, "http://hot.com", 100 + i, "response" if i % 50 == 0 else "revisit", f'"{i // 50}"', None, h(date=str(i))) for i in range(600)]
    schema = "record_id long, url string, at long, kind string, etag string, last_modified string, headers map<string,string>"
    df = spark.createDataFrame(rows + hot, schema).selectExpr("*", "1 AS status", "2 AS _full")
    got = {r.record_id: (r.status, r.original_id, r.headers) for r in warc.resolve_revisits(df).collect()}
    assert got[2] == ("resolved", 1, {"date": "2", "content-type": "t"})
    assert got[4] == ("resolved", 3, {"date": "3"}) and got[5][:2] == ("changed", 3) and got[6][:2] == ("missing", None)
    assert got[8][:2] == ("resolved", 7) and got[9][0] == "missing"
    assert all(got[100 + i][:2] == ("resolved", 100 + i // 50 * 50) for i in range(600) if i % 50)
    assert warc.resolve_revisits(df.limit(0)).count() == 0
