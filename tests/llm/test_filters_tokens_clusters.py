"""Filter interactions, byte-level BPE and delta Lloyd against brute force."""

import hashlib
import math
import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from noticeframe.llm import bpe, clustering, interactions
from noticeframe.llm.queries import tokenizer_file

from .conftest import prose


# --- filter interactions ---------------------------------------------------------------------------------------------


def brute_failures(rows):
    """Letters failed by each (doc_id, text, source) row."""
    out = []
    for k, text, _ in rows:
        t = text or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        failed = set()
        if len(words) < 50:
            failed.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            failed.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t):
            failed.add("C")
        if any(c in "#$%&*|" for c in t):
            failed.add("D")
        if k is not None and any(j is not None and j < k and (u or "") == t for j, u, _ in rows):
            failed.add("E")
        out.append(failed)
    return out


def brute_audit(rows, labels):
    flags = {c: {k for k, *v in labels if k is not None and v[i] == 1} for i, c in enumerate(("quality", "toxic"))}
    failed = brute_failures(rows)
    expected = {}
    for part in {s or "" for _, _, s in rows}:
        own = [(k, f) for (k, _, s), f in zip(rows, failed) if (s or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                here = [(k, f) for k, f in left if x in f]
                earlier = sum(x in f for _, f in own) - len(here)
                left = [(k, f) for k, f in left if x not in f]
                shapley[x] += len(here)
                expected[part, order, step] = [len(left), len(here), earlier, sum(f == {x} for _, f in own), *[sum(k in flags[c] for k, _ in here) for c in flags]]
        for (p, order, step), v in expected.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return expected


@pytest.fixture(scope="module")
def audited_rows(edge_rows):
    r = random.Random(5)
    rows = [(k, t, r.choice(("a", "a", "b", "", None))) for k, t in edge_rows]
    shout = "AB cd " * 40
    rows += [(100 + i, r.choice((shout, prose(3, 80) + " #", "a b", prose(i, 70), prose(7, 60, 20))), r.choice("ab")) for i in range(80)]
    return rows + [(100, shout, "c"), (500, shout, "c")]


def test_interactions_against_every_order(spark, audited_rows):
    docs = spark.createDataFrame(audited_rows, "doc_id long, text string, source string").selectExpr("*", "1 AS mask", "'x' AS w", "2 AS n", "'h' AS h")
    labels = [(100 + i, i % 2, i % 3 == 0 and 1 or 0) for i in range(80)] + [(None, 1, 1), (104, 0, 1), (105, None, None), (9999, 1, 1), (3, 1, 0)]
    got = interactions.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x")))
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.quality_lost, r.toxic_lost, r.shapley] for r in got.collect()}
    assert found == brute_audit(audited_rows, labels)


def test_interactions_of_nothing_and_of_other_filters(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.audit(no_docs.withColumn("source", F.lit("a")), labels).count() == 0
    docs = spark.createDataFrame([(1, "x"), (2, "y y"), (3, None)], "doc_id long, text string").withColumn("source", F.lit(7))
    got = interactions.audit(docs, labels, {"x": "size(w) = 1", "y": "t LIKE 'y%'"}, None, {}).orderBy("filter_order", "step")
    assert [tuple(r) for r in got.collect()] == [("7", "xy", 1, 2, 1, 0, 1, 2), ("7", "xy", 2, 1, 1, 0, 1, 2), ("7", "yx", 1, 2, 1, 0, 1, 2), ("7", "yx", 2, 1, 1, 0, 1, 2)]


def test_a_hot_text_joins_by_broadcast(spark):
    """Copies beyond the bar of hot keys: all but the first fail, wherever they are."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'copy' ELSE concat('own ', id) END AS text", "concat('s', id % 3) AS source")
    masks = interactions.failures(docs, {}, "E")
    assert masks.where("mask = 1").count() == 1999 and masks.where("mask = 1").agg(F.min("k")).first()[0] == 2


# --- byte-level BPE --------------------------------------------------------------------------------------------------

VOCABULARY = "byte_bpe_50k.tiktoken"


def ordinary():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(tokenizer_file(VOCABULARY)), special_tokens={}).encode_ordinary


ODD = ["a  b", " a\n\n b\t", "it's we'll 'sx", "naïve 日本語　文字 ١٢٣", "\x1c\x85​ x", "<|endoftext|> x", "🙂🙂🏽", "x" * 3000, " " * 500, "'", "\n", "é" * 20, "\U0010ffff\x00a"]


@pytest.mark.parametrize("chunk", [1, 2000, bpe.CHUNK])
def test_bpe_is_that_of_whole_texts(spark, edge_rows, edge_docs, no_docs, chunk):
    import public_tokenizers

    path = tokenizer_file(VOCABULARY)
    docs = edge_docs.unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"), allowMissingColumns=True)
    if chunk == 1:
        docs = docs.where("length(text) < 5000 OR text IS NULL")
    got = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN, chunk=chunk), path).collect()
    whole = ordinary()
    rows = [(k, t or "") for k, t in [*edge_rows, *((1000 + i, t) for i, t in enumerate(ODD))] if chunk > 1 or len(t or "") < 5000]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in got), key=key) == sorted(((k, whole(t), t.encode()) for k, t in rows), key=key)
    assert bpe.encode(no_docs, path, public_tokenizers.PATTERN).count() == 0


def test_every_character_is_cut_as_by_the_encoder():
    """Around each character of the plane of most scripts: the worker's pattern and the encoder's agree."""
    import public_tokenizers
    import regex

    whole, split = ordinary(), regex.compile(public_tokenizers.PATTERN).findall
    for c in [*range(0x3100), *range(0xA000, 0xA100), *range(0xFE00, 0x10000), 0x1D7CE, 0x1F600, 0xE0020]:
        s = f"a{chr(c)}{chr(c)}b {chr(c)} 1{chr(c)}"
        assert [i for w in split(s) for i in whole(w)] == whole(s)


def test_what_goes_between_machines(spark):
    """Distinct words of chunks and numbers, no text; every list of a word goes to the same bucket."""
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('the same words again ', 40) AS text").repartition(2)
    lists = bpe.word_lists(docs, r" ?\S+|\s+", 4).collect()
    assert sum(len(bpe.unpacked(r.numbers)) for r in lists) <= 2 * 7 and len({r.of for r in lists}) == 2
    rows = bpe.texts_by_number(docs, r" ?\S+|\s+", "doc_id").collect()
    assert sum(len(r["keys"]) for r in rows) == 300 and sum(len(r.numbers) for r in rows) < 300 * 160 / 5
    assert sum(r.check is not None for r in rows) == 2


def test_inputs_that_change_between_scans(spark, monkeypatch, edge_docs):
    """They are written first; were they not, checksums would stop the job."""
    import public_tokenizers

    from noticeframe.llm import common

    @F.udf("string")
    def other(i):
        import random

        return f"{i} {random.random()}"

    docs = spark.range(50).select(F.col("id").alias("doc_id"), other.asNondeterministic()("id").alias("text"))
    path = tokenizer_file(VOCABULARY)
    got = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path).collect()
    assert sorted(int(bytes(r.decoded).split()[0]) for r in got) == list(range(50))
    plain = edge_docs.select("doc_id", F.lower("text"))
    assert common.repeatable(plain) is plain and common.repeatable(plain.repartition(2)) is not plain and common.repeatable(docs) is not docs
    monkeypatch.setattr(bpe, "repeatable", lambda df: df)
    with pytest.raises(Exception, match="another order"):
        bpe.encode(docs, path, public_tokenizers.PATTERN).collect()


def test_a_full_table_of_words_starts_anew(spark, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(bpe, "KNOWN", 3)
    monkeypatch.setattr(bpe, "STRETCHES", 2)
    docs = spark.createDataFrame([(i, prose(i, 50)) for i in range(20)], "doc_id long, text string")
    whole = ordinary()
    assert {r.doc_id: list(r.ids) for r in bpe.encode(docs, tokenizer_file(VOCABULARY), public_tokenizers.PATTERN, chunk=300).collect()} == {i: whole(prose(i, 50)) for i in range(20)}


def test_decoding_takes_no_worker_of_its_own(spark, edge_docs):
    """Where ids are put together they are decoded too: no second Python step beside it, the same bytes as decoding afterwards."""
    import public_tokenizers

    from noticeframe.llm import queries

    path = tokenizer_file(VOCABULARY)
    got = bpe.encode(edge_docs, path, public_tokenizers.PATTERN, decoded="was")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, bytes(r.was))
    rows = sorted(bpe.decode(got, path).collect(), key=key)
    assert rows and all(r.was == r.decoded for r in rows)
    assert [bytes(r.was) for r in rows] == [bytes(r.was) for r in sorted(edge_docs.selectExpr("doc_id", "cast(coalesce(text, '') as binary) AS was").collect(), key=key)]
    plan = queries.op12_bpe(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "ArrowEvalPython" not in plan


def test_decoding_what_is_not_there(spark):
    rows = [(1, [0, 1]), (2, [0, 60_000]), (3, [None]), (4, None), (5, []), (6, [-1]), (7, [2**31 - 1])]
    got = dict(bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>"), tokenizer_file(VOCABULARY)).select("k", "decoded").collect())
    tokens = {i: t for t, i in bpe.read_ranks(tokenizer_file(VOCABULARY)).items()}
    assert got == {1: tokens[0] + tokens[1], 2: None, 3: None, 4: None, 5: b"", 6: None, 7: None}


# --- clustering ------------------------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, seed, dims):
    kept = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    named = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in named[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        owners = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, o) in zip(kept, owners) if o == n]
            if own:
                centroids[n] = [sum(c) // len(own) for c in zip(*own)]
    return [(i, o, d) for (i, _), (d, o) in zip(kept, assign())], centroids


def vectors(seed, n, dims, spread=1.0):
    r = random.Random(seed)
    middles = [[r.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [r.gauss(c, spread) for c in r.choice(middles)]) for i in range(n)]


def in_order(rows):
    return sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, *x[1:]))


@pytest.mark.parametrize(("seed", "rounds", "spread"), [(1, 10, 1.0), (2, 3, 0.3), (3, 0, 1.0), (4, 40, 0.05)])
def test_delta_rounds_are_lloyds_rounds(spark, seed, rounds, spread):
    rows = vectors(seed, 700, 4, spread)
    rows += [(i + 1000, v) for i, v in rows[:50]] + rows[:3] + [(None, rows[5][1]), (2000, None), (2001, []), (2002, [1.0] * 3), (2003, [1.0, None, 0.0, 0.0]), (2004, [float("nan")] * 4), (2005, [float("inf")] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "2 AS block", "3 AS x")
    found = clustering.cluster(df, k=6, rounds=rounds, dims=4)
    expected, centroids = brute_clusters(rows, 6, rounds, 3, 4)
    assert in_order(map(tuple, found.assigned.collect())) == in_order(expected)
    assert found.centroids == centroids and found.counts == [sum(o == n for _, o, _ in expected) for n in range(6)]
    assert found.inertia == [sum(d for _, o, d in expected if o == n) for n in range(6)]


def test_ties_and_empty_clusters(spark):
    """Equal seeds: the smaller number takes all, the others stay where they are."""
    rows = [(i, [1.0, -2.0]) for i in range(1200)] + [(5000, [3.0, 3.0])]
    found = clustering.cluster(spark.createDataFrame(rows, "vec_id int, embedding array<float>").repartition(3), k=4, rounds=5, dims=2)
    expected, centroids = brute_clusters(rows, 4, 5, 3, 2)
    assert in_order(map(tuple, found.assigned.collect())) == in_order(expected) and found.centroids == centroids


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    none = clustering.cluster(spark.createDataFrame([(1, None)], schema))
    assert none.assigned.count() == 0 and none.centroids == []
    one = clustering.cluster(spark.createDataFrame([(7, [0.5] * 64)], schema))
    assert [tuple(r) for r in one.assigned.collect()] == [(7, 0, 0)] and one.centroids == [[512] * 64]


def test_components_beyond_the_bound_are_held(spark):
    df = spark.createDataFrame([(1, [1e30, -1e30]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    found = clustering.cluster(df, k=1, rounds=0, dims=2)
    assert max(r.distance for r in found.assigned.collect()) == 2 * clustering.HELD**2


def test_vectors_stay_where_they_are(spark):
    """A later round moves assignments only: the blocks' side of the join has no exchange."""
    kept = clustering.whole_vectors(spark.createDataFrame(vectors(1, 900, 4), "vec_id long, embedding array<double>"), "vec_id", "embedding", 4)
    blocks = clustering.dealt_by_block(clustering.in_blocks(kept, "vec_id"))
    centroids = clustering.first_centroids(kept, "vec_id", 3, 3)
    first = clustering.durable(clustering._assign(blocks, None, centroids, [True] * 3))
    plan = clustering._assign(blocks, first, centroids, [True, False, False])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_plain_stretches_need_no_pattern():
    """op12: stretches of letters, of digits, or of letters and one ending are cut without the pattern, to the same pre-tokens."""
    import random

    import regex

    from noticeframe.llm import bpe

    cut, seen = regex.compile(bpe.PRE_TOKEN).findall, []
    chunk = bpe.Chunk(lambda t: seen.append(t) or cut(t), True)
    rng = random.Random(5)
    inks = ["", "it's", "'s", "a.", ".", "a..", "1.", "12", "a1", "é", "éa.", "²", "a²", "٣", "a\n", "\na", "A!", "don't.", *("".join(rng.choices("aZé中7²'.,!?;: \t-", k=rng.randint(1, 5))).replace(" ", "") for _ in range(3000))]
    for ink in inks:
        found = chunk.stretches[ink]
        words = list(chunk.numbers)
        if found is None:
            assert not ink or ink[0].isspace() or ink[-1].isspace()
        else:
            assert [words[n] for n in found] == cut(" " + ink)
    assert not {" 12", " a.", " A!"} & set(seen) and {" it's", " a..", " éa."} <= set(seen)


def test_the_first_scan_looks_at_a_stretch_of_a_text_once(edge_rows):
    """It numbers pre-tokens as the second does, without a lookup for each occurrence."""
    import regex

    from noticeframe.llm import bpe

    cut = regex.compile(bpe.PRE_TOKEN).findall
    placed, learnt = bpe.Chunk(cut, True), bpe.Chunk(cut, True)
    for _, t in [*edge_rows, (0, "two  blanks\n and é.\u00a0x ñandú. again again"), (0, " head again")]:
        placed.add(t or "")
        learnt.learn(t or "")
        assert list(placed.numbers) == list(learnt.numbers) and placed.size == learnt.size
    looked = []
    learnt.stretches = type("Seen", (bpe.Stretches,), {"__getitem__": lambda self, k: looked.append(k) or super(bpe.Stretches, self).__getitem__(k)})(cut, learnt.numbers)
    learnt.learn("one two two two")
    assert looked == ["two"]


def test_latin_letters_need_no_pattern():
    """Letters with accents are one pre-token, as the pattern says, and take no call of it."""
    import regex

    from noticeframe.llm import bpe

    cut, seen = regex.compile(bpe.PRE_TOKEN).findall, []
    chunk = bpe.Chunk(lambda t: seen.append(t) or cut(t), True)
    every = [chr(c) for c in range(0x80, 0x300)]
    for c in every:
        for ink in (f"a{c}b", f"{c}.", c):
            assert [list(chunk.numbers)[n] for n in chunk.add(f"x {ink}")] == cut(f"x {ink}"), ink
    seen.clear()
    chunk.add("x ciónció Éenèou Einßpf")
    assert seen == ["x"]
