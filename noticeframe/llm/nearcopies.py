"""Operator 3, wider: groups of texts whose five-word shingles have a similarity of 0.8 or more.

Three bits of a 64-bit SimHash are far stricter than that similarity, so this search adds a longer
fingerprint to SimHash's links: ``LENGTH`` minima of the shingle hashes under as many random factors, one bit of
each making the complete fingerprint. The search is multi-index hashing again. The first minima are
cut into ``SEGMENTS`` segments of ``SYMBOLS``; around each segment the ball of one changed symbol is
enumerated, as keys that leave one symbol out; the table gives who shares a key, and a match counts if
the complete fingerprints are within ``FAR`` bits. What is left is a candidate pair, and the exact
similarity of the two complete sets of shingles decides. At a similarity of 0.8 a pair shares a key with a chance of
0.995 and lies within ``FAR`` bits with one of 0.98; nothing depends on the size of the corpus.

Texts with equal words are one row from the start. A key's members are first held against its hub, the
member whose keys have the most members: in a family of edited copies that is the base. Links are
contracted; in keys whose members are still in several components, all members of different ones are
compared then, inside the join, so no pair goes uncompared and only those within ``FAR`` bits come out.

Words are runs of anything but ASCII white space, with A-Z in lower case; a text of fewer than five has one shingle,
all its words. Null and empty texts are copies of each other. Repeated rows are copies. Different texts of which
the same id is the smallest are versions of one document, and one group. Rows with a null id take no part. The id must be an integer.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import durable, join_counted, set_aside, whole_text
from .components import connected_components
from .hashing import WordHashes, mixed, rolled

SHINGLE_WORDS, LENGTH, FAR, SEGMENTS, SYMBOLS = 5, 256, 36, 4, 5
#: Similarity of 0.8 as a fraction, so that the test is exact.
SIMILAR = (4, 5)
#: Texts, and shingles of a long text, that a task works on at once.
TEXTS_AT_ONCE, SHINGLES_AT_ONCE = 256, 32_768
BITS = [f"bits{i}" for i in range(LENGTH // 64)]


def shingle_hashes(text: str, known: WordHashes):
    """Hash per shingle place."""
    h = known.of(text.encode("utf-8", "surrogatepass").lower().split())
    return mixed(rolled(h, min(SHINGLE_WORDS, len(h)))) if len(h) else h


def _minima(hashes: list, factors):
    """``LENGTH`` minima per text; a text without shingles has all ones."""
    import numpy as np

    out = np.full((len(hashes), LENGTH), 2**64 - 1, dtype=np.uint64)
    own = [i for i, h in enumerate(hashes) if len(h)]
    first = 0
    while first < len(own):
        stop, held = first, 0
        while stop < len(own) and held < SHINGLES_AT_ONCE:
            held += len(hashes[own[stop]])
            stop += 1
        block = [hashes[i] for i in own[first:stop]]
        bounds = np.cumsum([0, *map(len, block[:-1])])
        h = np.concatenate(block)
        for k, f in enumerate(factors):
            out[own[first:stop], k] = np.minimum.reduceat(h * f, bounds)
        first = stop
    return out


def _keys(symbols):
    """One key per segment and left-out symbol."""
    import numpy as np

    out = []
    for s in range(SEGMENTS):
        part = mixed(symbols[:, s * SYMBOLS : (s + 1) * SYMBOLS])
        for gone in range(SYMBOLS):
            key = np.full(len(part), s * SYMBOLS + gone + 1, dtype=np.uint64)
            for i in range(SYMBOLS):
                if i != gone:
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + part[:, i])
            out.append(key)
    return np.stack(out, axis=1)


def signatures(docs: DataFrame) -> DataFrame:
    """``(id, name, words0, words1, fp, n, bits..., keys)`` of ``(id, name, text)``: words0 and words1 hash the words, fp is the SimHash, n counts distinct shingles."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        known, factors = WordHashes(), np.random.default_rng(11).integers(0, 2**63, LENGTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            for part in (batch.slice(i, TEXTS_AT_ONCE) for i in range(0, batch.num_rows, TEXTS_AT_ONCE)):
                texts = part.column(2).to_pylist()
                names = np.array([divmod(xxhash.xxh3_128_intdigest(b" ".join(t.encode("utf-8", "surrogatepass").lower().split())), 2**64) for t in texts], dtype=np.uint64)
                hashes = [np.unique(shingle_hashes(t, known)) for t in texts]
                minima = _minima(hashes, factors)
                bits = np.packbits((mixed(minima) & np.uint64(1)).astype(np.uint8), axis=1).view("<i8")
                keys = _keys(minima[:, : SEGMENTS * SYMBOLS]).view(np.int64)
                some = np.array([len(h) > 0 for h in hashes])
                columns = [
                    part.column(0),
                    part.column(1),
                    *(pa.array(np.ascontiguousarray(names[:, i]).view(np.int64)) for i in (0, 1)),
                    pa.array(np.array([simhash.fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)),
                    pa.array([len(h) for h in hashes], pa.int64()),
                    *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(len(BITS))),
                    pa.array([k.tolist() if x else [] for k, x in zip(keys, some)], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "name", "words0", "words1", "fp", "n", *BITS, "keys"])

    schema = f"id long, name long, words0 long, words1 long, fp long, n long, {', '.join(f'{b} long' for b in BITS)}, keys array<bigint>"
    return docs.mapInArrow(run, schema)


def _within(other: str):
    """Complete distance, and sizes that allow the similarity."""
    apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"{other}{b}"))) for b in BITS), F.lit(0))
    p, q = SIMILAR
    n, m = F.col("n"), F.col(f"{other}n")
    return (apart <= FAR) & (q * F.least(n, m) >= p * F.greatest(n, m))


def _renamed(df: DataFrame, prefix: str, keep: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c == keep else f"{prefix}{c}") for c in df.columns])


def candidates(members: DataFrame, hubs: DataFrame) -> DataFrame:
    """``(node, hub)``: who shares a key with its hub, within ``FAR`` bits. ``members``: k, node, pop, n, bits."""
    return members.join(_renamed(hubs, "h_", "k"), "k").where(F.col("node") != F.col("h_node")).where(_within("h_")).select("node", F.col("h_node").alias("hub")).distinct()


def remaining(members: DataFrame) -> DataFrame:
    """``(node, hub)``: members of a key in different components (column ``c``), within ``FAR`` bits; the more popular is the hub.

    Column ``keys`` has all keys of a member: a pair that shares several is made at the least of them only.
    """
    other = _renamed(members, "h_", "k")
    met = members.join(other, "k").where(
        F.expr("(h_pop > pop OR h_pop = pop AND h_node < node) AND h_c <> c") & _within("h_") & F.expr("k = array_min(array_intersect(keys, h_keys))")
    )
    return met.select("node", F.col("h_node").alias("hub")).distinct()


def similar_pairs(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs ``(node, hub)`` whose complete sets of shingles are similar; texts of other rows are left where they are."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        known = WordHashes()
        for batch in batches:
            for i in range(batch.num_rows):
                own = np.unique(shingle_hashes(batch.column("text")[i].as_py(), known)).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, 1), pa.array([own], pa.list_(pa.int64()))], names=["node", "own"])

    wanted = pairs.select(F.explode(F.array("node", "hub")).alias("node")).distinct()
    texts = docs.select(F.col("id").alias("node"), "text").join(wanted, "node", "left_semi")
    sets = durable(texts.mapInArrow(run, "node long, own array<bigint>"))
    # The member's set travels to its hub: it has few hubs, a hub may have very many members.
    met = pairs.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("own").alias("theirs")), "hub")
    p, q = SIMILAR
    shared = F.size(F.array_intersect("own", "theirs"))
    return met.where((p + q) * shared >= p * (F.size("own") + F.size("theirs"))).select("node", "hub")


def _fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """``(node, hub)``: texts with one SimHash, and pairs of SimHashes within its radius."""
    distinct = durable(texts.groupBy("fp").agg(F.min("node").alias("lead")))
    same = texts.select("node", "fp").join(distinct, "fp").select("node", F.col("lead").alias("hub"))
    side = lambda n: distinct.select(F.col("fp").alias(n), F.col("lead").alias(f"lead_{n}"))
    near = simhash.links(distinct.select("fp")).join(side("a"), "a").join(side("b"), "b")
    return same.unionByName(near.select(F.greatest("lead_a", "lead_b").alias("node"), F.least("lead_a", "lead_b").alias("hub"))).where("node <> hub")


def similar_links(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs ``(node, hub)`` that join all texts with a similarity of 0.8 or more that the search finds: those of the second
    comparison, and for those of the first what its links come to, each node under the smallest of its component.

    ``docs``: id, text. ``texts``: a row per distinct text, with its node, SimHash, features and keys.
    """
    keys = texts.select("node", F.explode("keys").alias("k"))
    # Counts per key are made durable before they are joined back: a hot key's rows can then be split.
    sizes = durable(keys.groupBy("k").agg(F.count("*").alias("size")).where("size > 1"))
    held = durable(keys.join(sizes, "k"))
    pop = held.groupBy("node").agg(F.sum("size").alias("pop"))
    members = durable(held.select("k", "node").join(pop, "node").join(texts.select("node", "n", *BITS), "node"))
    best = F.max_by(F.struct("node", "pop", "n", *BITS), F.struct("pop", -F.col("node")))
    hubs = durable(members.groupBy("k").agg(best.alias("hub")).select("k", "hub.*"))
    first = durable(candidates(members, hubs).unionByName(_fingerprint_pairs(texts)).distinct())
    links = durable(similar_pairs(docs, first))
    joined = connected_components(links, "node", "hub")
    # Whoever is not the hub of a key has met its hub; the others of a key have met only in it.
    others = members.join(hubs.select("k", F.col("node").alias("h_node")), "k").where("node <> h_node").drop("h_node")
    labelled = durable(others.join(joined, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component"))
    mixed = durable(labelled.groupBy("k").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("k"))
    rest = durable(labelled.join(mixed, "k", "left_semi"))
    # Only keys that are still compared count as shared; others would hide a pair.
    open_keys = rest.groupBy("node").agg(F.collect_set("k").alias("keys"))
    rest = durable(rest.join(open_keys, "node"))
    more = durable(remaining(rest).join(first, ["node", "hub"], "left_anti"))
    return joined.select("node", F.col("component").alias("hub")).unionByName(similar_pairs(docs, more))


def near_copy_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, name, component_id)`` per row with an id; name hashes the text, component_id is the smallest id."""
    plain = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("name"), whole_text(text).alias("text"))
    rows = durable(signatures(plain))
    features = ["fp", "n", *BITS, "keys"]
    texts = durable(rows.groupBy("words0", "words1", *features).agg(F.min("id").alias("node"), F.count("*").alias("rows")))
    joined = connected_components(similar_links(plain.select("id", "text"), texts), "node", "hub")
    named = texts.join(joined, "node", "left").select("words0", "words1", F.coalesce("component", "node").alias("component_id"), "rows")
    return join_counted(rows.select(F.col("id").alias(key), "name", "words0", "words1"), named, ["words0", "words1"], "rows").select(key, "name", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their group, each once; rows without an id stay.

    Of several rows with that id the one whose text has the least hash stays, and of equal rows one.
    """
    aside, names = set_aside(docs)
    k, t = names[key], names[text]
    groups = durable(near_copy_groups(aside, k, t))
    firsts = groups.where(F.col(k) == F.col("component_id")).groupBy(k).agg(F.count("*").alias("n"), F.min("name").alias("name")).where("n > 1").select(k, "name")
    several = durable(firsts)
    gone = groups.where(F.col(k) != F.col("component_id")).select(k, "name").unionByName(groups.join(several.select(k), k, "left_semi").select(k, "name")).distinct()
    named = aside.withColumn("name", F.xxhash64(t))
    alone = named.where(F.col(k).isNotNull()).join(gone, [k, "name"], "left_anti")
    one = named.join(several, [k, "name"], "left_semi").dropDuplicates([k])
    kept = alone.unionByName(one).unionByName(named.where(F.col(k).isNull())).select(*names.values())
    return kept.toDF(*docs.columns)
